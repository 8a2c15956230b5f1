"""Queries of network layers over tiles, with the layers written out as SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from terracell.operators import layers
from terracell.sources.grid import GRID_SQL, grid, table

from .catalog import query

G = f"WITH {GRID_SQL} "
#: The network of the query: tiles of 32 cells every 28, three channels, 2, 3 and 4 channels at the three depths.
SIDE, STEP, WIDTHS = 32, 28, [2, 3, 4]
BANDS = {"flow": "flow / 490", "slope": "slope / 90", "ndwi": "ndwi"}
SHAPES = layers.shapes(len(BANDS), WIDTHS)


class _Sql:
    """Layers as common table expressions (pr, pc, ch, r, c, v) over dense tiles."""

    def __init__(self) -> None:
        self.parts: list[str] = []
        first, self.first = 0, {}
        for name, shape in SHAPES.items():
            self.first[name] = first
            size = 1
            for s in shape:
                size *= s
            first += size

    def add(self, name: str, sql: str) -> str:
        self.parts.append(f"{name} AS ({sql})")
        return name

    def weight(self, name: str, place: str) -> str:
        return f"(SELECT v FROM w WHERE k = {self.first[name]} + {place})"

    def conv(self, x: str, name: str, out: str, side: int, end: str = "greatest({}, 0)") -> str:
        o, i, k, _ = SHAPES[name]
        h = k // 2
        kernel = f"(SELECT a.a AS o, b.b AS i, d.d AS dr, e.e AS dc, w.v AS w FROM range({o}) a(a), range({i}) b(b), range({k}) d(d), range({k}) e(e) JOIN w ON w.k = {self.first[name]} + ((a.a * {i} + b.b) * {k} + d.d) * {k} + e.e)"
        total = f"sum(x.v * k.w) + any_value(b.v)"
        sums = f"SELECT pr, pc, k.o AS ch, r - k.dr + {h} AS r, c - k.dc + {h} AS c, {end.format(total)} AS v FROM {x} x JOIN {kernel} k ON x.ch = k.i JOIN w b ON b.k = {self.first[name + '.bias']} + k.o GROUP BY 1, 2, 3, 4, 5"
        return self.add(out, f"SELECT * FROM ({sums}) WHERE r BETWEEN 0 AND {side - 1} AND c BETWEEN 0 AND {side - 1}")

    def block(self, x: str, name: str, side: int) -> str:
        for k in range(2):
            x = self.conv(x, f"{name}.{k}", f"{name}_{k}", side)
        return x

    def pool(self, x: str) -> str:
        return self.add(f"{x}_p", f"SELECT pr, pc, ch, r // 2 AS r, c // 2 AS c, max(v) AS v FROM {x} GROUP BY 1, 2, 3, 4, 5")

    def up(self, x: str, skip: str, name: str) -> str:
        i, o, _, _ = SHAPES[name]
        kernel = f"(SELECT b.b AS i, a.a AS o, d.d AS dr, e.e AS dc, w.v AS w FROM range({i}) b(b), range({o}) a(a), range(2) d(d), range(2) e(e) JOIN w ON w.k = {self.first[name]} + ((b.b * {o} + a.a) * 2 + d.d) * 2 + e.e)"
        raised = f"SELECT pr, pc, k.o + {o} AS ch, 2 * r + k.dr AS r, 2 * c + k.dc AS c, sum(x.v * k.w) + any_value(b.v) AS v FROM {x} x JOIN {kernel} k ON x.ch = k.i JOIN w b ON b.k = {self.first[name + '.bias']} + k.o GROUP BY 1, 2, 3, 4, 5"
        return self.add(name, f"SELECT * FROM {skip} UNION ALL {raised}")


def _network_sql() -> str:
    s = _Sql()
    s.add("w", "SELECT vec_id * len(embedding) + i AS k, embedding[i + 1]::DOUBLE / 4 AS v FROM embeddings, unnest(range(64)) AS t(i) WHERE vec_id < 20")
    s.add("e", "SELECT max(r) AS h, max(c) AS w FROM grid")
    cells = "SELECT i.i AS pr, j.j AS pc, a.a AS r, b.b AS c FROM (SELECT unnest(range((SELECT h // {0} + 1 FROM e))) AS i) i, (SELECT unnest(range((SELECT w // {0} + 1 FROM e))) AS j) j, range({1}) a(a), range({1}) b(b)".format(STEP, SIDE)
    s.add("t", cells)
    bands = " UNION ALL ".join(f"SELECT r, c, {k} AS ch, {x}::DOUBLE AS v FROM grid" for k, x in enumerate(BANDS.values()))
    s.add("b", bands)
    s.add("x", f"SELECT t.pr, t.pc, n.n AS ch, t.r, t.c, coalesce(b.v, 0) AS v FROM t CROSS JOIN range({len(BANDS)}) n(n) LEFT JOIN b ON b.ch = n.n AND b.r = t.pr * {STEP} + t.r AND b.c = t.pc * {STEP} + t.c")
    side = SIDE
    d0 = s.block("x", "down0", side)
    d1 = s.block(s.pool(d0), "down1", side // 2)
    d2 = s.block(s.pool(d1), "down2", side // 4)
    m1 = s.block(s.up(d2, d1, "up1"), "merge1", side // 2)
    m0 = s.block(s.up(m1, d0, "up0"), "merge0", side)
    s.conv(m0, "out", "score", side, "1 / (1 + exp(-({})))")
    return G + ", " + ", ".join(s.parts) + f" SELECT g.r, g.c, round(max(s.v), 6) AS score FROM score s JOIN grid g ON g.r = s.pr * {STEP} + s.r AND g.c = s.pc * {STEP} + s.c GROUP BY g.r, g.c"


def _weights(spark, sf_dir):
    """The first vectors of embeddings stand for trained weights."""
    numbers = layers.numbered(table(spark, sf_dir, "embeddings").filter("vec_id < 20"), "vec_id", "embedding").withColumn("value", F.col("value") / 4)
    return layers.load_weights(layers.weight_table(numbers, SHAPES), SHAPES)


@query(_network_sql())
def tile_network(spark, sf_dir):
    """An encoder-decoder with two poolings and skips, over overlapping tiles of the whole grid, merged by maximum."""
    cells = grid(spark, sf_dir).select("r", "c", (F.col("flow") / 490).alias("flow"), (F.col("slope") / 90).alias("slope"), "ndwi")
    return layers.predict(cells, list(BANDS), _weights(spark, sf_dir), SIDE, STEP).withColumn("score", F.round("score", 6))
