"""terracell: gridded risk analytics and corpus preparation as Spark DataFrame jobs."""
