import pytest
from pyspark.sql import functions as F

from terracell.sources import catalog, tiles
from terracell.sources.grid import grid, table
from terracell.streaming import rainfall

SF = "/root/testdata/sf0.001"


def test_tiles_round_trip_and_prune(spark, tmp_path):
    cells, path = grid(spark, SF).select("r", "c", "dem"), f"file://{tmp_path}/tiles"
    tiles.write_tiles(cells, path, side=4)
    window = tiles.read_window(spark, path, (2, 7), (10, 33), side=4)
    assert sorted(map(tuple, window.collect()), key=str) == sorted(map(tuple, cells.filter("r >= 2 AND r < 7 AND c >= 10 AND c < 33").select(window.columns).collect()), key=str)
    assert "PartitionFilters: [isnotnull(tile_r" in window._jdf.queryExecution().toString()


def test_small_formats(spark, tmp_path):
    (tmp_path / "a.tfw").write_text("30\n0\n0\n-30\n1015\n4985\n")
    assert catalog.world_file(spark, f"file://{tmp_path}/a.tfw") == (30.0, 0.0, 1000.0, 0.0, -30.0, 5000.0)
    (tmp_path / "a.geojson").write_text('{"type": "FeatureCollection", "features": [{"geometry": {"type": "Polygon", "coordinates": [[[1, 2], [3, 4], [5, 0], [1, 2]]]}}]}')
    rings = catalog.polygon_rings(spark, f"file://{tmp_path}/a.geojson").orderBy("point").collect()
    assert [(r["lon"], r["lat"]) for r in rings] == [(1, 2), (3, 4), (5, 0), (1, 2)]
    (tmp_path / "m.json").write_text('{"model_metrics": {"a": {"f1": 0.5, "iou": 0.25}}}')
    assert {tuple(r) for r in catalog.metric_table(spark, f"file://{tmp_path}/m.json").collect()} == {("a", "f1", 0.5), ("a", "iou", 0.25)}
    layers = spark.createDataFrame([("dem", 1, "x")], "role string, priority int, path string")
    catalog.require(layers, ["dem"])
    with pytest.raises(FileNotFoundError, match="slope"):
        catalog.require(layers, ["dem", "slope"])


def test_named_geometry_scan_and_bands(spark, tmp_path):
    ring = "[[[1, 2], [3, 4], [5, 0], [1, 2]]]"
    one = lambda n: f'{{"properties": {{"name": "{n}", "code": 7}}, "geometry": {{"type": "Polygon", "coordinates": {ring}}}}}'
    (tmp_path / "a.geojson").write_text(f'{{"type": "FeatureCollection", "features": [{one("north")}, {one("south")}]}}')
    found = catalog.polygon_by_name(spark, f"file://{tmp_path}/a.geojson", "south").orderBy("point").collect()
    assert [(x["feature"], x["name"], x["lon"], x["lat"]) for x in found] == [(1, "south", 1, 2), (1, "south", 3, 4), (1, "south", 5, 0), (1, "south", 1, 2)]
    assert catalog.polygon_by_name(spark, f"file://{tmp_path}/a.geojson", "west").count() == 0
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "x.tif").write_bytes(b"12345")
    assert [(x["name"], x["bytes"]) for x in catalog.scan(spark, f"file://{tmp_path}").collect()] == [("x.tif", 5)]
    cells = grid(spark, SF)
    tiles.write_bands(cells, f"file://{tmp_path}/bands", ["dem", "flow"])
    one_band = spark.read.parquet(f"file://{tmp_path}/bands").filter("band = 'dem'")
    assert one_band.count() == cells.filter("dem IS NOT NULL").count()
    tiles.write_report(spark.createDataFrame([("f1", 0.5)], "metric string, value double"), f"file://{tmp_path}/report")
    assert tuple(spark.read.json(f"file://{tmp_path}/report").select("metric", "value").first()) == ("f1", 0.5)


def test_sinks(spark, tmp_path):
    colours = spark.createDataFrame([(0, 0, 1, 2, 3, 200), (1, 2, 4, 5, 6, 0)], "row int, col int, r int, g int, b int, a int")
    assert tiles.overlay_png(colours)[:8] == b"\x89PNG\r\n\x1a\n"
    with pytest.raises(ValueError):
        tiles.overlay_png(colours, most=2)
    tiles.write_csv(colours, f"file://{tmp_path}/csv")
    assert spark.read.csv(f"file://{tmp_path}/csv", header=True).count() == 2
    assert tiles.as_json(colours.limit(1)).first()["json"].startswith('{"row":0')
    one = spark.createDataFrame([("CRITICAL", 20.0, 5)], "level string, critical_pct double, people long")
    assert "%20CRITICAL%3A%2020.0" in tiles.alert_link(one, "a@b.c").first()["link"]


def test_stream_gives_the_batch_result(spark, tmp_path):
    events = table(spark, SF, "events")
    events.orderBy("ts").coalesce(1).write.parquet(f"file://{tmp_path}/feed")
    out = f"file://{tmp_path}/out"
    rainfall.write_windows(rainfall.windowed(rainfall.read_feed(spark, f"file://{tmp_path}/feed")), out, f"file://{tmp_path}/state").awaitTermination(120)
    got = {r["window_start"]: (round(r["mm"], 6), r["n"]) for r in spark.read.parquet(out).collect()}
    want = {r["window_start"]: (round(r["mm"], 6), r["n"]) for r in rainfall.windowed(events).collect()}
    assert got and all(want[k] == v for k, v in got.items())
    last = events.agg(F.max("ts")).first()[0]
    assert len(want) - len(got) <= 5 and last is not None
