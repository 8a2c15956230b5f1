"""Queries of neighbourhoods, distances, resampling and patches."""

from __future__ import annotations

from pyspark.sql import functions as F

from terracell.operators import align, focal, patches, stats
from terracell.sources.grid import GRID_SQL, grid, table

from .catalog import query

G = f"WITH {GRID_SQL} "


def _box(band: str, size: int, name: str) -> str:
    """Mirrored box mean as a CTE: the grid is padded on all sides, then every padded box is summed."""
    h = size // 2
    copies = lambda x, last: f"unnest([{x}] || CASE WHEN {x} < {h} THEN [-1 - {x}] ELSE [] END || CASE WHEN {x} > {last} - {h} THEN [2 * {last} + 1 - {x}] ELSE [] END)"
    frame = f"RANGE BETWEEN {h} PRECEDING AND {h} FOLLOWING"
    return f""", {name}_e AS (SELECT max(r) AS h, max(c) AS w FROM grid), {name}_r AS (SELECT {copies('r', 'h')} AS r, c, {band} AS x, w FROM grid, {name}_e),
  {name}_p AS (SELECT r, {copies('c', 'w')} AS c, x FROM {name}_r), {name}_1 AS (SELECT r, c, sum(x) OVER (PARTITION BY r ORDER BY c {frame}) AS s, count(x) OVER (PARTITION BY r ORDER BY c {frame}) AS n FROM {name}_p),
  {name}_2 AS (SELECT r, c, sum(s) OVER (PARTITION BY c ORDER BY r {frame}) AS s, sum(n) OVER (PARTITION BY c ORDER BY r {frame}) AS n FROM {name}_1),
  {name} AS (SELECT b.r, b.c, s / nullif(n, 0) AS v FROM {name}_2 b JOIN grid g ON b.r = g.r AND b.c = g.c)"""


@query(G + _box("dem", 5, "m") + "SELECT r, c, round(v, 6) AS mean5 FROM m")
def box_mean(spark, sf_dir):
    return focal.box_mean(grid(spark, sf_dir), {"_v": F.col("dem")}, 5).select("r", "c", F.round("_v", 6).alias("mean5"))


@query(G + _box("dem", 11, "m") + "SELECT g.r, g.c, round(g.dem - v, 6) AS tpi FROM grid g JOIN m ON g.r = m.r AND g.c = m.c")
def position_index(spark, sf_dir):
    return focal.position_index(grid(spark, sf_dir)).select("r", "c", F.round("tpi", 6).alias("tpi"))


@query(G + _box("flow", 5, "m") + _box("flow * flow", 5, "q") + """, s AS (SELECT var_pop(flow) AS noise FROM grid), x AS (SELECT g.r, g.c, g.flow, m.v AS m, q.v - m.v * m.v AS v, noise FROM grid g JOIN m ON g.r = m.r AND g.c = m.c JOIN q ON g.r = q.r AND g.c = q.c, s)
SELECT r, c, round(m + v / (v + noise + 1e-6) * (flow - m), 6) AS lee FROM x""")
def lee_filter(spark, sf_dir):
    return focal.lee_filter(grid(spark, sf_dir), "flow").select("r", "c", F.round("lee", 6).alias("lee"))


@query(G + _box("CASE WHEN flow > 33.0e0 THEN 1e0 ELSE 0e0 END", 33, "m") + _box("CASE WHEN lulc = 50 THEN 1e0 ELSE 0e0 END", 33, "b") + "SELECT m.r, m.c, round(m.v, 9) AS drainage_density, round(b.v, 9) AS built_density FROM m JOIN b ON m.r = b.r AND m.c = b.c")
def density_maps(spark, sf_dir):
    masks = {"_d": F.when(F.col("flow") > 33.0, 1.0).otherwise(0.0), "_b": F.when(F.col("lulc") == 50, 1.0).otherwise(0.0)}
    return focal.box_mean(grid(spark, sf_dir), masks, 33).select("r", "c", F.round("_d", 9).alias("drainage_density"), F.round("_b", 9).alias("built_density"))


def _near(name: str, feature: str) -> str:
    """CTEs: for each cell the key of the nearest feature, from the nearest one of each column of its row."""
    return f""", {name}_0 AS (SELECT r, c, max(CASE WHEN {feature} THEN r END) OVER (PARTITION BY c ORDER BY r) AS a,
    min(CASE WHEN {feature} THEN r END) OVER (PARTITION BY c ORDER BY r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS b FROM grid),
  {name}_1 AS (SELECT r, c, CASE WHEN b IS NULL OR r - a <= b - r THEN a ELSE b END AS fr FROM {name}_0),
  {name} AS (SELECT g.r, g.c, arg_min({{'d2': (g.r - f.fr) * (g.r - f.fr) + (g.c - f.c) * (g.c - f.c), 'r': f.fr, 'c': f.c}}, (((g.r - f.fr) * (g.r - f.fr) + (g.c - f.c) * (g.c - f.c))::BIGINT::HUGEINT * 1000000000 + f.fr) * 100000 + f.c) AS n
    FROM grid g LEFT JOIN {name}_1 f ON g.r = f.r AND f.fr IS NOT NULL GROUP BY g.r, g.c)"""


_DISTANCE_SQL = G + _near("w", "lulc = 80") + _near("u", "lulc = 50") + " SELECT w.r, w.c, round(sqrt(w.n.d2) * 30e0, 6) AS to_water, round(sqrt(u.n.d2) * 30e0, 6) AS to_town FROM w JOIN u ON w.r = u.r AND w.c = u.c"
_HAND_SQL = G + _near("x", "flow > 33 AND dem IS NOT NULL") + """ SELECT g.r, g.c, x.n.r AS near_r, x.n.c AS near_c, round(g.dem - f.dem, 6) AS hand
FROM grid g JOIN x ON g.r = x.r AND g.c = x.c LEFT JOIN grid f ON f.r = x.n.r AND f.c = x.n.c"""


@query(_DISTANCE_SQL)
def distance_maps(spark, sf_dir):
    near = focal.nearest_features(grid(spark, sf_dir), {"water": F.col("lulc") == 80, "town": F.col("lulc") == 50}, cell=30.0)
    return near.select("r", "c", F.round("water_distance", 6).alias("to_water"), F.round("town_distance", 6).alias("to_town"))


@query(_HAND_SQL)
def height_above_drainage(spark, sf_dir):
    hand = focal.height_above_drainage(grid(spark, sf_dir), F.col("flow") > 33)
    return hand.select("r", "c", "near_r", "near_c", F.round("hand", 6).alias("hand"))


@query(_DISTANCE_SQL)
def distance_maps_all(spark, sf_dir):
    """The rows of distance_maps, which reads all features too, under its second name."""
    return distance_maps(spark, sf_dir)


@query(_HAND_SQL)
def height_above_drainage_all(spark, sf_dir):
    """The rows of height_above_drainage, which reads all features too, under its second name."""
    return height_above_drainage(spark, sf_dir)


@query(G + """, e AS (SELECT max(r)::DOUBLE AS nr, max(c)::DOUBLE AS nc, round_even((max(r) + 1) / 4e0, 0)::INT AS mr, round_even((max(c) + 1) / 4e0, 0)::INT AS mc FROM grid),
k AS (SELECT i.i AS r, j.j AS c, g.dem, g.flow FROM (SELECT unnest(range(0, (SELECT mr FROM e))) AS i) AS i, (SELECT unnest(range(0, (SELECT mc FROM e))) AS j) AS j, e
  JOIN grid g ON g.r = floor(i.i * nr / (mr - 1) + 0.5e0)::INT AND g.c = floor(j.j * nc / (mc - 1) + 0.5e0)::INT),
x AS (SELECT a.r, a.c, a.dem - arg_min(f.dem, (((a.r - f.r) * (a.r - f.r) + (a.c - f.c) * (a.c - f.c))::HUGEINT * 1000000000 + f.r) * 100000 + f.c) AS hand FROM k a, k f WHERE f.flow > 33 AND f.dem IS NOT NULL GROUP BY a.r, a.c, a.dem),
t AS (SELECT r, c, CASE WHEN r < 4 * mr AND c < 4 * mc THEN r * (mr - 1) / (4e0 * mr - 1) END AS y, c * (mc - 1) / (4e0 * mc - 1) AS x FROM grid, e),
b AS (SELECT t.r, t.c, x.hand, (1 - abs(t.y - x.r)) * (1 - abs(t.x - x.c)) AS w FROM t LEFT JOIN x ON x.r BETWEEN floor(t.y)::INT AND floor(t.y)::INT + 1 AND x.c BETWEEN floor(t.x)::INT AND floor(t.x)::INT + 1)
SELECT r, c, round(sum(w * hand) FILTER (WHERE hand IS NOT NULL) / nullif(sum(w) FILTER (WHERE hand IS NOT NULL), 0), 6) AS hand FROM b GROUP BY r, c""")
def height_above_drainage_coarse(spark, sf_dir):
    """Heights found on a grid four times coarser and interpolated back."""
    return focal.height_above_drainage_coarse(grid(spark, sf_dir), F.col("flow") > 33).select("r", "c", F.round("hand", 6).alias("hand"))


#: The target grid of the resampling queries: 1.7 source cells to a side, a little off the source's corner.
_TARGET = """t AS (SELECT i AS r, j AS c, (i + 0.5e0) * 1.7e0 + 0.3e0 AS y, (j + 0.5e0) * 1.7e0 - 0.2e0 AS x
  FROM (SELECT unnest(range(0, (SELECT ceil((max(r) + 1) / 1.7e0)::BIGINT FROM grid))) AS i) AS a, (SELECT unnest(range(0, (SELECT ceil((max(c) + 1) / 1.7e0)::BIGINT FROM grid))) AS j) AS b)"""


def _target(cells):
    extent = cells.agg(*[F.ceil((F.max(x) + 1) / F.lit(1.7)).cast("int").alias(f"_{x}") for x in ("r", "c")])
    rows = extent.select("_c", F.explode(F.sequence(F.lit(0), F.col("_r") - 1)).alias("r")).repartition("r")
    target = rows.select("r", F.explode(F.sequence(F.lit(0), F.col("_c") - 1)).alias("c"))
    return target, (F.col("r") + 0.5) * 1.7 + 0.3, (F.col("c") + 0.5) * 1.7 - 0.2


_NEAREST_SQL = G + f", {_TARGET} SELECT t.r::INT AS r, t.c::INT AS c, g.lulc FROM t LEFT JOIN grid g ON g.r = floor(t.y)::INT AND g.c = floor(t.x)::INT"


@query(_NEAREST_SQL)
def resample_nearest(spark, sf_dir):
    cells = grid(spark, sf_dir)
    return align.resample_nearest(cells, *_target(cells), ["lulc"])


_BILINEAR_SQL = G + f""", {_TARGET}, k AS (SELECT t.r, t.c, n.dem, (1 - abs(t.y - 0.5e0 - n.r)) * (1 - abs(t.x - 0.5e0 - n.c)) AS w FROM t LEFT JOIN grid n
  ON n.r BETWEEN floor(t.y - 0.5e0)::INT AND floor(t.y - 0.5e0)::INT + 1 AND n.c BETWEEN floor(t.x - 0.5e0)::INT AND floor(t.x - 0.5e0)::INT + 1)
SELECT r::INT AS r, c::INT AS c, round(sum(w * dem) FILTER (WHERE dem IS NOT NULL) / nullif(sum(w) FILTER (WHERE dem IS NOT NULL), 0), 6) AS dem FROM k GROUP BY r, c"""


@query(_BILINEAR_SQL)
def resample_bilinear(spark, sf_dir):
    cells = grid(spark, sf_dir).select("r", "c", "dem")
    extent = cells.agg(*[F.ceil((F.max(x) + 1) / F.lit(1.7)).alias(f"_{x}") for x in ("r", "c")])
    at = lambda r, c: ((r + 0.5) * 1.7 + 0.3, (c + 0.5) * 1.7 - 0.2)
    out = align.resample(cells, at, align.target_tiles(F.col("_r"), F.col("_c"), extent, 64), bilinear=["dem"], tile=64)
    return out.select("r", "c", F.round("dem", 6).alias("dem"))


@query(_NEAREST_SQL)
def resample_nearest_all(spark, sf_dir):
    """The rows of resample_nearest under its second name."""
    return resample_nearest(spark, sf_dir)


@query(_BILINEAR_SQL)
def resample_bilinear_all(spark, sf_dir):
    """The rows of resample_bilinear under its second name."""
    return resample_bilinear(spark, sf_dir)


@query(G + """, b AS (SELECT r // 7 AS r, c // 7 AS c, dem, lulc FROM grid), m AS (SELECT r, c, round(avg(dem), 6) AS dem, count(*) AS n_cells FROM b GROUP BY r, c),
k AS (SELECT r, c, lulc, count(*) AS n FROM b GROUP BY r, c, lulc), t AS (SELECT r, c, arg_max(lulc, n * 1000 - lulc) AS lulc FROM k GROUP BY r, c)
SELECT m.r, m.c, dem, n_cells, lulc FROM m JOIN t ON m.r = t.r AND m.c = t.c""")
def overview(spark, sf_dir):
    return align.downsample(grid(spark, sf_dir), 7, ["dem"], ["lulc"]).withColumn("dem", F.round("dem", 6))


@query(G + """, f AS (SELECT ceil((greatest(max(r), max(c)) + 1) / 30e0)::INT AS f FROM grid), b AS (SELECT r // f AS r, c // f AS c, dem, lulc FROM grid, f),
m AS (SELECT r, c, round(avg(dem), 6) AS dem, count(*) AS n_cells FROM b GROUP BY r, c), k AS (SELECT r, c, lulc, count(*) AS n FROM b GROUP BY r, c, lulc), t AS (SELECT r, c, arg_max(lulc, n * 1000 - lulc) AS lulc FROM k GROUP BY r, c)
SELECT m.r, m.c, dem, n_cells, lulc FROM m JOIN t ON m.r = t.r AND m.c = t.c""")
def overview_of_side(spark, sf_dir):
    """An overview of at most 30 cells to a side."""
    return align.overview(grid(spark, sf_dir), 30, ["dem"], ["lulc"]).withColumn("dem", F.round("dem", 6))


@query(G + """, e AS (SELECT max(r) AS h, max(c) AS w FROM grid), s AS (SELECT i AS pr, j AS pc FROM (SELECT unnest(range(0, (SELECT h // 16 + 1 FROM e))) AS i) AS a, (SELECT unnest(range(0, (SELECT w // 16 + 1 FROM e))) AS j) AS b, e WHERE i * 16 + 31 <= h AND j * 16 + 31 <= w)
SELECT pr::INT AS pr, pc::INT AS pc, count(*) AS n, count(*) FILTER (WHERE lulc = 80) AS positives, max(flow) AS peak, bool_and(flow IS NOT NULL) AS all_valid, count(*) = 1024 AS whole
FROM s JOIN grid ON r BETWEEN pr * 16 AND pr * 16 + 31 AND c BETWEEN pc * 16 AND pc * 16 + 31 GROUP BY pr, pc""")
def sliding_patches(spark, sf_dir):
    return patches.summary(patches.sliding(grid(spark, sf_dir), 32, 16), 32, "flow", F.col("lulc") == 80)


@query(G + "SELECT r // 32 AS pr, c // 32 AS pc, count(*) AS n, count(*) FILTER (WHERE lulc = 80) AS positives, max(dem) AS peak, bool_and(dem IS NOT NULL) AS all_valid, count(*) = 1024 AS whole FROM grid GROUP BY 1, 2")
def tiled_patches(spark, sf_dir):
    return patches.summary(patches.tiled(grid(spark, sf_dir), 32), 32, "dem", F.col("lulc") == 80)


@query(G + """, p AS (SELECT r // 4 AS pr, c // 4 AS pc, count(*) FILTER (WHERE lulc = 80 AND ndwi > 0.5) > 2 AS pos FROM grid GROUP BY 1, 2),
k AS (SELECT *, row_number() OVER (PARTITION BY pos ORDER BY md5('42|' || pr || '|' || pc), pr, pc) AS k, count(*) FILTER (WHERE pos) OVER () AS n FROM p)
SELECT pr, pc, pos FROM k WHERE pos OR k <= 2 * n""")
def balanced_patches(spark, sf_dir):
    tiles = patches.tiled(grid(spark, sf_dir), 4).groupBy("pr", "pc").agg((F.count_if((F.col("lulc") == 80) & (F.col("ndwi") > 0.5)) > 2).alias("pos"))
    return patches.balance(tiles, F.col("pos"), need_positive=False)


@query(G + "SELECT r // 32 AS pr, c // 32 AS pc, r // 2 AS r, c // 2 AS c, round(max(flow / (1 + exp(-ndwi))), 9) AS pooled FROM grid GROUP BY 1, 2, 3, 4")
def gated_pooling(spark, sf_dir):
    """A gate between two channels of each patch, then pooling."""
    gated = patches.attention_gate(patches.tiled(grid(spark, sf_dir), 32), "flow", "ndwi")
    return patches.pool_max(gated, "gated").withColumn("pooled", F.round("pooled", 9))


@query("SELECT vec_id, CASE WHEN ('0x' || substr(md5('42|' || vec_id), 1, 8))::BIGINT::DOUBLE / 4294967296e0 < 0.2 THEN 'val' ELSE 'train' END AS part FROM embeddings")
def train_split(spark, sf_dir):
    return patches.split(table(spark, sf_dir, "embeddings").select("vec_id"), F.col("vec_id")).select("vec_id", "part")


@query(G + "SELECT r, c, flow * 0.5e0 AS score FROM grid")
def tile_merge(spark, sf_dir):
    """Overlapping inference windows with a score of their own, merged by the largest."""
    windows = patches.sliding(grid(spark, sf_dir).select("r", "c", "flow"), 64, 56, partial=True)
    first = (F.floor(F.col("r") / 56) == F.col("pr")) & (F.floor(F.col("c") / 56) == F.col("pc"))
    return patches.merge_max(windows, F.when(first, F.col("flow") * 0.5).otherwise(F.col("flow") * 0.25 - 1))


@query(G + """, k(i, j, w) AS (VALUES (-1, 0, 1e0), (0, -1, 1e0), (0, 0, -4e0), (0, 1, 1e0), (1, 0, 1e0)) SELECT g.r, g.c, round(greatest(sum(w * n.flow), 0), 6) AS score
FROM grid g, k JOIN grid n ON n.r = g.r + i AND n.c = g.c + j AND n.r // 20 = g.r // 20 AND n.c // 20 = g.c // 20 GROUP BY g.r, g.c""")
def tile_convolution(spark, sf_dir):
    kernel = [[0, 1, 0], [1, -4, 1], [0, 1, 0]]
    return patches.convolve(patches.tiled(grid(spark, sf_dir), 20), "flow", kernel, 20).select("r", "c", F.round("score", 6).alias("score"))


@query(G + """, s AS (SELECT min(flow) a, (max(flow) - min(flow)) / 64 AS w FROM grid), b AS (SELECT least(floor((flow - a) / w), 63)::INT AS bin, a, w, count(*) AS n FROM grid, s GROUP BY 1, 2, 3),
k AS (SELECT bin, a + (bin + 1) * w AS hi, sum(n) OVER (ORDER BY bin) AS n0, sum(n * (a + bin * w + a + (bin + 1) * w) / 2) OVER (ORDER BY bin) AS s0, sum(n) OVER () AS n, sum(n * (a + bin * w + a + (bin + 1) * w) / 2) OVER () AS s FROM b)
SELECT round(arg_max(hi, n0 * (n - n0) * pow(s0 / n0 - (s - s0) / (n - n0), 2)), 9) AS threshold FROM k WHERE n > n0""")
def otsu_threshold(spark, sf_dir):
    return stats.otsu(grid(spark, sf_dir), "flow").select(F.round("threshold", 9).alias("threshold"))


def _refined_sql() -> str:
    """Every cell with the 49 cells around it, then the half window that its own means choose."""
    near = lambda a, b: f"avg(n.flow) FILTER (WHERE abs(n.r - g.r - ({a})) <= 1 AND abs(n.c - g.c - ({b})) <= 1)"
    means = {(a, b): f"m{i}{j}" for i, a in enumerate((-2, 0, 2)) for j, b in enumerate((-2, 0, 2))}
    chosen, halves = [], []
    for one, other, plane in focal.SIDES:
        part = lambda sign: " + ".join(n for (a, b), n in means.items() if sign * (a * plane[0] + b * plane[1]) > 0)  # noqa: E731,B023
        chosen.append(f"abs(({part(-1)}) - ({part(1)})) AS g{len(chosen)}, abs({means[other]} - m11) < abs({means[one]} - m11) AS s{len(chosen)}")
        halves.append(f"({plane[0]} * (n.r - d.r) + ({plane[1]}) * (n.c - d.c))")
    half = " ".join(f"WHEN d.k = {k} THEN CASE WHEN d.s THEN -1 ELSE 1 END * {h}" for k, h in enumerate(halves))
    return f""", m0 AS (SELECT g.r, g.c, g.flow, {', '.join(f'{near(a, b)} AS {n}' for (a, b), n in means.items())} FROM grid g JOIN grid n ON n.r BETWEEN g.r - 3 AND g.r + 3 AND n.c BETWEEN g.c - 3 AND g.c + 3 GROUP BY ALL),
m AS (SELECT r, c, flow, {', '.join(f'coalesce({n}, m11) AS {n}' for n in means.values())} FROM m0), e AS (SELECT r, c, flow, {', '.join(chosen)} FROM m),
d AS (SELECT r, c, flow, k, CASE k WHEN 0 THEN s0 WHEN 1 THEN s1 WHEN 2 THEN s2 ELSE s3 END AS s FROM (SELECT *, CASE WHEN g0 >= g1 AND g0 >= g2 AND g0 >= g3 THEN 0 WHEN g1 >= g2 AND g1 >= g3 THEN 1 WHEN g2 >= g3 THEN 2 ELSE 3 END AS k FROM e)),
h AS (SELECT d.r, d.c, d.flow, avg(n.flow) AS m, var_pop(n.flow) AS v FROM d JOIN grid n ON n.r BETWEEN d.r - 3 AND d.r + 3 AND n.c BETWEEN d.c - 3 AND d.c + 3 WHERE CASE {half} END <= 0 GROUP BY ALL)
SELECT r, c, round(m + CASE WHEN v > 1e-12 THEN greatest(v - m * m / 4, 0) / (1 + 0.25e0) / v ELSE 0 END * (flow - m), 5) AS lee FROM h"""


@query(G.replace("grid AS", "whole AS") + ", grid AS (SELECT r, c, CASE WHEN dem IS NOT NULL THEN flow END AS flow FROM whole)" + _refined_sql())
def refined_lee(spark, sf_dir):
    """Speckle filter of 7 x 7 cells along edges, over a band with holes."""
    cells = grid(spark, sf_dir).select("r", "c", F.when(F.col("dem").isNotNull(), F.col("flow")).alias("flow"))
    return focal.refined_lee(cells, "flow", 4.0, 32).select("r", "c", F.round("lee", 5).alias("lee"))


@query(G + """, p AS (SELECT r // 8 AS pr, c // 8 AS pc FROM grid GROUP BY 1, 2 HAVING count(*) = 64 AND count(*) FILTER (WHERE lulc = 80) >= 9 AND max(flow) > 20)
SELECT pr, pc, r, c, flow, slope, ndwi FROM grid JOIN p ON r // 8 = pr AND c // 8 = pc""")
def kept_patches(spark, sf_dir):
    """All channels of the cells of patches that are worth training on."""
    wanted = (F.col("positives") >= 9) & (F.col("peak") > 20)
    return patches.kept(grid(spark, sf_dir), 8, "flow", F.col("lulc") == 80, wanted).select("pr", "pc", "r", "c", "flow", "slope", "ndwi")
