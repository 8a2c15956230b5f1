"""Cell tables: one row for each cell, keyed by r (row) and c (column), NULL for nodata."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Named places with latitude and longitude.
PLACES = [
    ("Ernakulam", 9.980, 76.280), ("MG Road", 9.966, 76.287), ("Edappally", 10.024, 76.308), ("Kaloor", 9.994, 76.292), ("Vyttila", 9.966, 76.318),
    ("Aluva", 10.108, 76.357), ("Kakkanad", 10.011, 76.340), ("Perumbavoor", 10.109, 76.475), ("Muvattupuzha", 9.982, 76.582), ("North Paravur", 10.158, 76.214),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a grid of 100 columns, with one column for each band.  Only columns that a query uses are
    computed; the scan reads event_id, event_type, value and props at most."""
    k = F.get_json_object("props", "$.k").cast("double")
    kinds = {"view": (10, 1), "click": (30, 2), "purchase": (40, 4), "signup": (50, 5), "error": (80, 8)}
    lulc = lambda n: F.coalesce(*[F.when(F.col("event_type") == t, F.lit(codes[n])) for t, codes in kinds.items()])
    i = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        F.floor(i / 100).cast("int").alias("r"), (i % 100).cast("int").alias("c"),
        F.col("value").alias("flow"), (F.lit(0.9) * k).alias("slope"),
        F.when(i % 17 != 0, (i * 37 % 1000) / 10.0).alias("dem"), lulc(0).alias("lulc"), lulc(1).alias("cover"),
        ((i * 7919 % 2001 - 1000) / 1000.0).alias("ndwi"), (i * 31 % 5000).cast("double").alias("dist_built"),
        (i * 613 % 1009 / 1009.0).alias("p100"), (i * 613 % 1009 / 1009.0 * 0.5 + i * 71 % 503 / 1006.0).alias("p150"), (i * 71 % 503 / 503.0).alias("p200"),
    )


GRID_SQL = """grid AS (
  SELECT (event_id // 100)::INT AS r, (event_id % 100)::INT AS c, value AS flow, 0.9e0 * (json_extract_string(props, '$.k'))::DOUBLE AS slope,
         CASE WHEN event_id % 17 <> 0 THEN (event_id * 37 % 1000) / 10e0 END AS dem,
         CASE event_type WHEN 'view' THEN 10 WHEN 'click' THEN 30 WHEN 'purchase' THEN 40 WHEN 'signup' THEN 50 WHEN 'error' THEN 80 END AS lulc,
         CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'purchase' THEN 4 WHEN 'signup' THEN 5 WHEN 'error' THEN 8 END AS cover,
         (event_id * 7919 % 2001 - 1000) / 1000e0 AS ndwi, (event_id * 31 % 5000)::DOUBLE AS dist_built,
         (event_id * 613 % 1009) / 1009e0 AS p100, (event_id * 613 % 1009) / 1009e0 * 0.5e0 + (event_id * 71 % 503) / 1006e0 AS p150, (event_id * 71 % 503) / 503e0 AS p200
  FROM events)"""


def places(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, *p) for k, p in enumerate(PLACES)], "ordinal int, name string, lat double, lon double")


PLACES_SQL = "places(ordinal, name, lat, lon) AS (VALUES " + ", ".join(f"({k}, '{n}', {a}e0, {o}e0)" for k, (n, a, o) in enumerate(PLACES)) + ")"
