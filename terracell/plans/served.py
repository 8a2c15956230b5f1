"""Queries of what is served and compared: prediction jobs, overlays, searches, routing, quality of parts, zooms, orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from terracell.functions import columns as fn
from terracell.operators import align, jobs, metrics, patches
from terracell.sources import catalog as layers
from terracell.sources.grid import GRID_SQL, grid, table
from terracell.sources.shared import shared_path

from .catalog import query
from .files import EPSG, METRES, _from_utm_sql
from .risk import SCEN_SQL, scenario_cells

G = f"WITH {GRID_SQL} "


@query(f"WITH {SCEN_SQL} SELECT scenario_mm AS mm, max(prob) AS max_prob, round(avg(prob), 9) AS mean_prob, count(prob) AS cells FROM scen GROUP BY scenario_mm")
def predict_jobs(spark, sf_dir):
    """The three scenarios' rasters, one there already and two computed, and their figures as read back."""
    folder = shared_path(spark, "predictions")
    prob = {mm: scenario_cells(spark, sf_dir, mm).select("r", "c", "prob") for mm in (100, 150, 200)}
    jobs.predict(spark, {150: prob[150]}, folder, METRES, EPSG, 64, 32)
    return jobs.predict(spark, prob, folder, METRES, EPSG, 64, 32).withColumn("mean_prob", F.round("mean_prob", 9))


@query(f"""WITH {SCEN_SQL}, e AS (SELECT max(r) + 1 AS h, max(c) + 1 AS w FROM scen), f AS (SELECT greatest(1, ceil(greatest(h, w) / 200e0))::INT AS f FROM e),
o AS (SELECT r // f AS r, c // f AS c, avg(prob) AS prob FROM scen, f WHERE scenario_mm = 100 GROUP BY 1, 2), t AS (SELECT a.r, b.c FROM e, unnest([0, h]) AS a(r), unnest([0, w]) AS b(c)),
{_from_utm_sql('631480e0 + 30 * c', '1116880e0 - 30 * r')}
SELECT (max(r) + 1)::INT AS height, (max(c) + 1)::INT AS width, count(*) FILTER (WHERE prob BETWEEN 0 AND 1) AS coloured, (SELECT round(min(lon), 9) FROM u4) AS west, (SELECT round(min(lat), 9) FROM u4) AS south,
  (SELECT round(max(lon), 9) FROM u4) AS east, (SELECT round(max(lat), 9) FROM u4) AS north FROM o""")
def map_overlay(spark, sf_dir):
    """Size and geographic bounds of the served overlay, whose image a test decodes."""
    cells = scenario_cells(spark, sf_dir, 100).select("r", "c", "prob")
    out = jobs.overlay(cells, METRES, fn.from_utm, most=200)
    return out.select("height", "width", "coloured", *[F.round(x, 9).alias(x) for x in ("west", "south", "east", "north")])


@query("""WITH n AS (SELECT DISTINCT ' ' || upper(substr(p_type, 1, 3)) || CASE WHEN p_size % 3 = 0 THEN '' ELSE 'x' END AS needle FROM part UNION SELECT n_name AS needle FROM nation),
s AS (SELECT p_partkey AS ordinal, p_name || ' ' || lower(p_type) || ' ' || p_brand AS name FROM part)
SELECT needle, arg_min(name, ordinal) AS name, min(ordinal) AS ordinal FROM n LEFT JOIN s ON contains(lower(name), lower(trim(needle))) GROUP BY needle""")
def name_search(spark, sf_dir):
    """The first part whose name holds each of some needles, whatever the case."""
    part = table(spark, sf_dir, "part")
    needles = part.select(F.concat(F.lit(" "), F.upper(F.substring("p_type", 1, 3)), F.when(F.col("p_size") % 3 == 0, "").otherwise("x")).alias("needle"))
    names = part.select(F.col("p_partkey").alias("ordinal"), F.concat_ws(" ", "p_name", F.lower("p_type"), "p_brand").alias("name"))
    return jobs.first_hits(names, needles.union(table(spark, sf_dir, "nation").select("n_name")))


@query(G + """, a AS (SELECT DISTINCT 'tile_' || (r // 8) || '_' || (c // 8) AS role FROM grid), h AS (SELECT 'tile_' || (r // 8) || '_' || (c // 8) AS role FROM grid GROUP BY 1 HAVING count(*) FILTER (WHERE lulc = 80) >= 13)
SELECT role FROM a ANTI JOIN h USING (role)""")
def missing_tiles(spark, sf_dir):
    """Tiles of the grid that have no water layer: required roles without an entry of the catalog."""
    role = F.concat_ws("_", F.lit("tile"), F.floor(F.col("r") / 8).cast("string"), F.floor(F.col("c") / 8).cast("string")).alias("role")
    named = grid(spark, sf_dir).select(role, (F.col("lulc") == 80).alias("water"))
    return layers.missing(named.groupBy("role").agg(F.count_if("water").alias("n")).filter("n >= 13"), named.select("role").distinct())


@query("""SELECT role, arg_min(path, {'p': priority, 'q': path}) AS path, min(priority) AS priority FROM (
  SELECT event_type || '_' || (event_id % 7) AS role, CASE WHEN value > 400 THEN 0 WHEN value > 40 THEN 1 ELSE 2 END AS priority, 'store' || (user_id % 50) || '/layer' || event_id AS path FROM events) GROUP BY role""")
def layer_routing(spark, sf_dir):
    """The layer that serves each role: the best store that has one, then the next."""
    i, v = F.col("event_id"), F.col("value")
    priority = F.when(v > 400, 0).when(v > 40, 1).otherwise(2).alias("priority")
    path = F.concat(F.lit("store"), (F.col("user_id") % 50).cast("string"), F.lit("/layer"), i.cast("string")).alias("path")
    entries = table(spark, sf_dir, "events").select(F.concat_ws("_", "event_type", (i % 7).cast("string")).alias("role"), priority, path)
    return layers.resolved(entries).select("role", "path", "priority")


# ---- quality of parts

_PARTS = """WITH m AS (SELECT max(n_chars) + 1 AS m FROM documents), sc AS (SELECT source, n_chars / m::DOUBLE AS pred, quality::DOUBLE AS target FROM documents JOIN labels USING (doc_id), m),
cm AS (SELECT source, count(*) FILTER (WHERE pred >= 0.05 AND target > 0.5) AS tp, count(*) FILTER (WHERE pred >= 0.05 AND target <= 0.5) AS fp, count(*) FILTER (WHERE pred < 0.05 AND target > 0.5) AS fn, count(*) FILTER (WHERE pred < 0.05 AND target <= 0.5) AS tn FROM sc GROUP BY source) """


def _by_source(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    most = F.broadcast(docs.agg((F.max("n_chars") + 1).alias("m")))
    return docs.join(table(spark, sf_dir, "labels"), "doc_id").crossJoin(most).select("source", (F.col("n_chars") / F.col("m")).alias("pred"), F.col("quality").cast("double").alias("target"))


@query(_PARTS + """, r AS (SELECT source AS model, CASE WHEN tp + fp > 0 THEN tp / (tp + fp)::DOUBLE ELSE 0 END AS prec, CASE WHEN tp + fn > 0 THEN tp / (tp + fn)::DOUBLE ELSE 0 END AS recall, tp + fn AS p, fp + tn AS n FROM cm),
t AS (SELECT *, trunc(recall * p)::BIGINT AS tp FROM r), f AS (SELECT *, CASE WHEN prec > 0 THEN trunc(tp * (1 - prec) / prec)::BIGINT ELSE 0 END AS fp FROM t)
SELECT model, tp, fp, p - tp AS fn, n - fp AS tn, (tp + n - fp) / (p + n)::DOUBLE AS accuracy FROM f""")
def rebuilt_by_source(spark, sf_dir):
    """Confusion counts of each source rebuilt from its precision, recall and support."""
    measured = metrics.rates(metrics.confusion_by(_by_source(spark, sf_dir), "source", 0.05))
    models = measured.select(F.col("source").alias("model"), "prec", "recall", (F.col("tp") + F.col("fn")).alias("positives"), (F.col("fp") + F.col("tn")).alias("negatives"))
    return metrics.rebuilt_confusion(models)


@query(_PARTS + """, u AS (SELECT source AS variant, tp, fp, fn FROM cm UNION ALL SELECT 'all', sum(tp), sum(fp), sum(fn) FROM cm),
v AS (SELECT variant, CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn)::DOUBLE ELSE 0 END AS f1, CASE WHEN tp + fp + fn > 0 THEN tp / (tp + fp + fn)::DOUBLE ELSE 1 END AS iou FROM u)
SELECT v.variant, round(v.f1, 9) AS f1, round(v.iou, 9) AS iou, round(a.f1 - v.f1, 9) AS f1_loss, round(a.iou - v.iou, 9) AS iou_loss FROM v, v AS a WHERE a.variant = 'all'""")
def losses_by_source(spark, sf_dir):
    """Scores of each source beside those of all, and what is lost against them."""
    by = metrics.confusion_by(_by_source(spark, sf_dir), "source", 0.05)
    whole = by.agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn", "tn")]).select(F.lit("all").alias("source"), "*")
    results = metrics.rates(by.unionByName(whole)).select(F.col("source").alias("variant"), "f1", "iou")
    return metrics.ablation(results, "all").select("variant", *[F.round(c, 9).alias(c) for c in ("f1", "iou", "f1_loss", "iou_loss")])


@query(_PARTS + """, b AS (SELECT source, floor(pred * 10)::INT AS bin, avg(target) AS v FROM sc GROUP BY 1, 2) SELECT source, (row_number() OVER (PARTITION BY source ORDER BY v) - 1)::INT AS k, round(v, 9) AS value FROM b""")
def monotone_curves(spark, sf_dir):
    """Mean quality by length of each source, sorted into a curve that only grows."""
    means = _by_source(spark, sf_dir).groupBy("source", F.floor(F.col("pred") * 10).alias("bin")).agg(F.avg("target").alias("v"))
    curves = means.groupBy("source").agg(F.collect_list("v").alias("values"))  # at most eleven bins
    return metrics.monotone(curves, "source", "values").select("source", "k", F.round("value", 9).alias("value"))


# ---- zooms and orders

_ZOOM = """, e AS (SELECT max(r) AS h, max(c) AS w, round_even((max(r) + 1) * {z}e0, 0)::INT AS mh, round_even((max(c) + 1) * {z}e0, 0)::INT AS mw FROM grid),
t AS (SELECT a.i AS r, b.j AS c, a.i * (h / (mh - 1)::DOUBLE) AS y, b.j * (w / (mw - 1)::DOUBLE) AS x FROM e, (SELECT unnest(range((SELECT mh FROM e))) AS i) a, (SELECT unnest(range((SELECT mw FROM e))) AS j) b) """


@query(G + _ZOOM.format(z=0.37) + "SELECT t.r::INT AS r, t.c::INT AS c, lulc FROM t LEFT JOIN grid g ON g.r = floor(y + 0.5e0) AND g.c = floor(x + 0.5e0)")
def zoom_nearest(spark, sf_dir):
    return align.zoom(grid(spark, sf_dir).select("r", "c", "lulc"), "lulc", 0.37, 0, 64).withColumn("lulc", F.col("lulc").cast("int"))


@query(G + _ZOOM.format(z=1.6) + """, k AS (SELECT t.r, t.c, n.dem, (1 - abs(y - n.r)) * (1 - abs(x - n.c)) AS w FROM t LEFT JOIN grid n ON n.r BETWEEN floor(y)::INT AND floor(y)::INT + 1 AND n.c BETWEEN floor(x)::INT AND floor(x)::INT + 1)
SELECT r::INT AS r, c::INT AS c, round(sum(w * dem) FILTER (WHERE dem IS NOT NULL) / nullif(sum(w) FILTER (WHERE dem IS NOT NULL), 0), 5) AS dem FROM k GROUP BY r, c""")
def zoom_linear(spark, sf_dir):
    return align.zoom(grid(spark, sf_dir).select("r", "c", "dem"), "dem", 1.6, 1, 64).withColumn("dem", F.round("dem", 5))


@query(G + "SELECT pr, pc, row_number() OVER (ORDER BY md5('42|' || pr || '|' || pc), pr, pc) - 1 AS place FROM (SELECT DISTINCT r // 4 AS pr, c // 4 AS pc FROM grid)")
def shuffled_patches(spark, sf_dir):
    """All patches in a random order that is the same in every run."""
    return patches.shuffled(patches.tiled(grid(spark, sf_dir), 4).select("pr", "pc").distinct(), ["pr", "pc"])
