"""States of fixed size: merged halves, streams, restarts; and risk of rainfall windows."""

import math
import os
import shutil

import numpy as np
import pytest
from pyspark.sql import functions as F

from terracell.functions import columns as fn
from terracell.operators import metric_state, metrics
from terracell.streaming import rainfall

RNG = np.random.default_rng(6)
SCORED = "pred double, target double"


def scored_of(spark, n, seed=1):
    rng = np.random.default_rng(seed)
    t = (rng.random(n) < 0.3).astype(float)
    p = np.clip(rng.normal(0.35 + 0.3 * t, 0.2), -0.1, 1.1).round(4)
    rows = [(float(a), float(b)) for a, b in zip(p, t)] + [(1.0, 1.0), (0.0, 0.0), (0.5, 1.0), (None, 1.0), (float("nan"), 0.0), (0.4, None)]
    return rows, spark.createDataFrame(rows, SCORED)


def known(rows):
    return [(p, t) for p, t in rows if p is not None and t is not None and not math.isnan(p)]


def plain(rows, names):
    return sorted(tuple(round(r[n], 9) if isinstance(r[n], float) else r[n] for n in names) for r in rows)


STATE = ["bin", "over", "t", "f", "sum_pred", "sum_target"]


def test_merged_halves_are_the_whole(spark):
    rows, df = scored_of(spark, 500)
    whole = metric_state.update(df, 100)
    halves = [metric_state.update(spark.createDataFrame(rows[k::3], SCORED), 100) for k in range(3)]
    assert plain(metric_state.merge(*halves).collect(), STATE) == plain(whole.collect(), STATE)
    assert whole.count() <= 2 * 102
    nothing = metric_state.update(df.limit(0), 100)
    assert plain(metric_state.merge(whole, nothing).collect(), STATE) == plain(whole.collect(), STATE)


def test_finished_metrics_against_the_rows(spark):
    rows, df = scored_of(spark, 600, 2)
    clean = spark.createDataFrame(known(rows), SCORED)
    got, exact = metric_state.finish(metric_state.update(df, 50)).first(), {r["metric"]: r["value"] for r in metrics.report(clean).collect()}
    for name in ("iou", "dice", "prec", "recall", "f1", "specificity", "accuracy"):
        assert np.isclose(got[name], exact[name])
    pairs = [(p, q) for p, t in known(rows) if t > 0.5 for q, u in known(rows) if u <= 0.5]
    auc = np.mean([(p > q) + 0.5 * (p == q) for p, q in pairs])
    assert 0 < got["auc_error"] < 0.02 and abs(got["auc"] - auc) <= got["auc_error"] + 1e-12
    fine = metric_state.finish(metric_state.update(df, 100_000)).first()
    assert abs(fine["auc"] - auc) <= fine["auc_error"] + 1e-12 < 1e-3 and abs(fine["ap"] - exact["ap"]) < 1e-3
    want = plain(metrics.calibration(clean).collect(), ["bin", "n", "mean_pred", "mean_target"])
    assert plain(metric_state.calibration(metric_state.update(df, 50), 50).collect(), ["bin", "n", "mean_pred", "mean_target"]) == want
    with pytest.raises(ValueError, match="divide"):
        metric_state.calibration(metric_state.update(df, 50), 50, 7)
    none = metric_state.finish(metric_state.update(df.limit(0), 10)).first()
    assert (none["tp"], none["iou"], none["dice"], none["auc"], none["ap"]) == (0, 1.0, 1.0, 0.0, 0.0)


def test_a_stream_keeps_the_same_state(spark, tmp_path):
    """Two runs with a restart from the checkpoint between them."""
    rows, df = scored_of(spark, 300, 3)
    feed = tmp_path / "feed"
    for k in range(2):
        spark.createDataFrame(rows[k::3], SCORED).write.mode("append").parquet(str(feed))
    run = lambda: metric_state.start_stream(spark.readStream.schema(SCORED).option("maxFilesPerTrigger", 2).parquet(str(feed)), str(tmp_path / "out"), str(tmp_path / "check"), 40).awaitTermination()
    run()
    spark.createDataFrame(rows[2::3], SCORED).write.mode("append").parquet(str(feed))
    run()
    assert len(os.listdir(tmp_path / "out")) > 2
    assert plain(metric_state.last_state(spark, str(tmp_path / "out")).collect(), STATE) == plain(metric_state.update(df, 40).collect(), STATE)


CELLS = "m100 double, m150 double, m200 double, hydro double"


def cells_of(spark, n=40):
    rng = np.random.default_rng(4)
    rows = [tuple(float(x) for x in rng.random(4)) for _ in range(n)] + [(0.2, None, None, 0.5), (None, 0.4, 0.6, 0.1), (0.3, 0.4, 0.5, None)]
    return rows, spark.createDataFrame(rows, CELLS)


def test_risk_of_windows_against_the_expressions(spark):
    rows, cells = cells_of(spark)
    windows = spark.createDataFrame([(k, float(mm)) for k, mm in enumerate([0, 40, 100, 130, 150, 180, 200, 390])], "window_start int, mm double")
    got = {r["window_start"]: r for r in rainfall.risk_by_window(windows, cells).collect()}
    for k, mm in enumerate([0, 40, 100, 130, 150, 180, 200, 390]):
        r = F.lit(float(mm))
        mapped = fn.hydro_boost(fn.rainfall_interpolation(r, F.col("m100"), F.col("m150"), F.col("m200")), F.col("hydro"), r)
        want = [x[0] for x in cells.select(fn.hybrid_risk(mapped, F.col("hydro"), r)).collect() if x[0] is not None]
        assert got[k]["n_cells"] == len(want) and np.isclose(got[k]["mean_risk"], np.mean(want))
        assert (got[k]["critical"], got[k]["high"]) == (sum(x >= 0.45 for x in want), sum(x >= 0.25 for x in want))
    assert rainfall.risk_by_window(windows.limit(0), cells).collect() == []


def test_rainfall_stream_to_risk_goes_on_after_a_restart(spark, tmp_path):
    """Each closed window is joined to the cells once; the second run takes the sums of the first from its checkpoint."""
    _, cells = cells_of(spark)
    hours = lambda a, b: spark.createDataFrame([(h, 2.0 + h % 5) for h in range(a, b)], "h int, value double").selectExpr("timestamp_ntz'2024-03-01 00:00:00' + make_dt_interval(0, h) AS ts", "value")
    feed, out = str(tmp_path / "feed"), str(tmp_path / "risk")
    run = lambda: rainfall.start_risk(spark.readStream.schema("ts timestamp_ntz, value double").parquet(feed), cells, out, str(tmp_path / "check"), 3.0).awaitTermination()
    hours(0, 40).write.mode("append").parquet(feed)
    run()
    first = spark.read.parquet(out).count()
    hours(40, 75).write.mode("append").parquet(feed)
    run()
    hours(75, 140).write.mode("append").parquet(feed)
    run()
    stream = plain(spark.read.parquet(out).select("window_start", "mm", "n_cells", "mean_risk").collect(), ["window_start", "mm", "n_cells", "mean_risk"])
    batch = plain(rainfall.risk_by_window(rainfall.windowed(hours(0, 140)), cells, 3.0).collect(), ["window_start", "mm", "n_cells", "mean_risk"])
    assert 0 < first < len(stream) < len(batch) and len({r[0] for r in stream}) == len(stream)
    assert stream == batch[: len(stream)]  # the later windows are not closed yet
    # a trigger that runs again overwrites its own folder
    last = sorted(os.listdir(tmp_path / "check" / "commits"), key=lambda n: (len(n), n))
    last = [n for n in last if n.isdigit()][-1]
    for n in (last, f".{last}.crc"):
        os.path.exists(tmp_path / "check" / "commits" / n) and os.remove(tmp_path / "check" / "commits" / n)
    run()
    assert plain(spark.read.parquet(out).select("window_start", "mm", "n_cells", "mean_risk").collect(), ["window_start", "mm", "n_cells", "mean_risk"])[: len(stream)] == stream
    shutil.rmtree(tmp_path / "check")
