"""Rainfall feeds: hourly sums over sliding windows, as a stream or over a table, their risk, and JSON forecasts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terracell.functions import columns as fn

#: Rainfall windows up to this many are broadcast to the cells.
BROADCAST_WINDOWS = 10_000

FEED = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def windowed(feed: DataFrame, length: str = "24 hours", slide: str = "6 hours", late: str = "1 hour") -> DataFrame:
    """window_start, mm, n of a feed (ts, value).  On a stream, rows later than the watermark are left out and a window
    is emitted once; on a table the watermark changes nothing."""
    timed = feed.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    sums = timed.groupBy(F.window("ts", length, slide).alias("w")).agg(F.sum("value").alias("mm"), F.count(F.lit(1)).alias("n"))
    return sums.select(F.col("w.start").alias("window_start"), "mm", "n")


def read_feed(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(FEED).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def write_windows(windows: DataFrame, path: str, checkpoint: str):
    """Start the stream into Parquet files; `checkpoint` lies in a shared folder and lets a lost query go on."""
    return windows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def forecast_sum(documents: DataFrame, hours: int = 24) -> DataFrame:
    """place, mm from JSON texts {"hourly": {"precipitation": [...]}}: the sum of the first hours, NULL counting as 0."""
    parsed = F.from_json("json", "hourly struct<precipitation: array<double>>")
    values = F.slice(F.coalesce(parsed["hourly"]["precipitation"], F.array().cast("array<double>")), 1, hours)
    return documents.select("place", F.aggregate(values, F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0))).alias("mm"))


def risk_by_window(windows: DataFrame, cells: DataFrame, scale: float = 1.0) -> DataFrame:
    """window_start, mm, n_cells, mean_risk, critical, high of each rainfall window (window_start, mm) over static cells
    (m100, m150, m200, hydro): the mapped risk at that rainfall, at least the physical one.

    Windows of a trigger are few; beyond BROADCAST_WINDOWS (counted) they are not broadcast but joined as they are."""
    mm = F.col("mm")
    r = fn.clip(mm, 0.0, 200.0)
    # what depends on the window alone is worked out once for each window
    share = [fn.rainfall_interpolation(r, *[F.lit(float(k == n)) for k in range(3)]).alias(f"w{n}") for n in range(3)]
    wanted = windows.select("window_start", (mm * scale).alias("mm")).select("window_start", "mm", *share, (F.least(mm / 200, F.lit(1.0)) * 0.2).alias("boost"), (mm / 200 * 1.2).alias("physical"))
    few = wanted.limit(BROADCAST_WINDOWS + 1).count() <= BROADCAST_WINDOWS
    each = cells.select("m100", "m150", "m200", F.coalesce("hydro", F.lit(0.0)).alias("hydro")).crossJoin(F.broadcast(wanted) if few else wanted)
    part = lambda m, w, used: F.when(used, F.col(m) * F.col(w)).otherwise(0.0)  # noqa: E731  a map that is not used may be NULL
    mapped = part("m100", "w0", F.col("mm") <= 150) + part("m150", "w1", F.col("mm") > 100) + part("m200", "w2", F.col("mm") > 150)
    at = each.select("window_start", "mm", fn.clip(mapped + F.col("hydro") * F.col("boost"), 0.0, 1.0).alias("mapped"), (F.col("hydro") * F.col("physical")).alias("physical"))
    risk = at.select("window_start", "mm", F.when(F.col("mapped").isNotNull(), F.least(F.greatest("mapped", "physical", F.lit(0.0)), F.lit(1.0))).alias("risk"))
    return risk.groupBy("window_start", "mm").agg(
        F.count("risk").alias("n_cells"), F.avg("risk").alias("mean_risk"), F.count_if(F.col("risk") >= 0.45).alias("critical"), F.count_if(F.col("risk") >= 0.25).alias("high")
    )


def start_risk(feed: DataFrame, cells: DataFrame, path: str, checkpoint: str, scale: float = 1.0, length: str = "24 hours", slide: str = "6 hours", late: str = "1 hour"):
    """Join each trigger's closed rainfall windows to the static cells and keep their risk in `path/batch=N`.

    Window sums live in the stream's state store and come back from `checkpoint` after a restart; a repeated trigger
    overwrites its own folder, so that every window is there once."""

    def put(windows: DataFrame, batch: int) -> None:
        risk_by_window(windows, cells, scale).write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return windowed(feed, length, slide, late).writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(put).start()
