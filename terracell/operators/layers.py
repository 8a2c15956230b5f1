"""Network layers over tiles: tensors of several channels, convolutions, up-convolutions, skips, and an encoder-decoder.

A tile is a square of cells with all its channels, one numpy array (channel, row, column) built from the Arrow rows of its
cells.  Tiles overlap (`side` beyond `step`), so that every cell lies well inside one of them; cells outside the grid and
missing values are 0.  A tile is the unit of work: its cells are shuffled once, together with the halo that its
neighbours send, and only its scores come back, which are merged by the largest.

Weights are a table (name, shape, values), read whole once; their size is checked before they are broadcast.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StructField, StructType

from . import patches

#: Weights beyond this many numbers are not broadcast.
MOST_WEIGHTS = 50_000_000


# ---- layers on one tile: arrays (channel, row, column)


def conv(x: np.ndarray, kernel: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """Kernel (out, in, k, k) over x with zeros outside: shifted planes, one product of channels for each place."""
    k = kernel.shape[-1]
    h, (_, rows, cols) = k // 2, x.shape
    padded = np.pad(x, ((0, 0), (h, h), (h, h)))
    out = np.broadcast_to(bias[:, None, None], (len(kernel), rows, cols)).copy()
    for i in range(k):
        for j in range(k):
            out += np.tensordot(kernel[:, :, i, j], padded[:, i : i + rows, j : j + cols], 1)
    return out


def up_conv(x: np.ndarray, kernel: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """Strided up-convolution with kernel (in, out, s, s): every cell becomes s x s cells."""
    s, (_, rows, cols) = kernel.shape[-1], x.shape
    out = np.einsum("irc,ioab->oracb", x, kernel).reshape(kernel.shape[1], rows * s, cols * s)
    return out + bias[:, None, None]


def pool(x: np.ndarray, k: int = 2) -> np.ndarray:
    """The largest value of each k x k block."""
    n, rows, cols = x.shape
    return x.reshape(n, rows // k, k, cols // k, k).max((2, 4))


def relu(x: np.ndarray) -> np.ndarray:
    return np.maximum(x, 0)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def joined(*parts: np.ndarray) -> np.ndarray:
    """Channels of the branches one after the other."""
    return np.concatenate(parts)


def attention(gate: np.ndarray, skip: np.ndarray, w: dict[str, np.ndarray], name: str) -> np.ndarray:
    """skip, weighted in each cell by how well it goes with the gate."""
    both = relu(conv(gate, w[f"{name}.gate"], w[f"{name}.gate.bias"]) + conv(skip, w[f"{name}.skip"], w[f"{name}.skip.bias"]))
    return skip * sigmoid(conv(both, w[f"{name}.psi"], w[f"{name}.psi.bias"]))


def folded(kernel: np.ndarray, bias: np.ndarray, mean: np.ndarray, var: np.ndarray, gamma: np.ndarray, beta: np.ndarray, epsilon: float = 1e-5) -> tuple[np.ndarray, np.ndarray]:
    """Kernel and bias of a convolution with the batch normalisation behind it folded in."""
    scale = gamma / np.sqrt(var + epsilon)
    return kernel * scale[:, None, None, None], (bias - mean) * scale + beta


def encoder_decoder(x: np.ndarray, w: dict[str, np.ndarray], levels: int = 2) -> np.ndarray:
    """Probabilities (row, column) of a tile: `levels` times a block and pooling, a block at the bottom, and on the way up
    an up-convolution, the skip of that level beside it (gated where there are weights for that), and a block."""

    def block(x: np.ndarray, name: str) -> np.ndarray:
        k = 0
        while f"{name}.{k}" in w:
            x, k = relu(conv(x, w[f"{name}.{k}"], w[f"{name}.{k}.bias"])), k + 1
        return x

    skips = []
    for level in range(levels):
        x = block(x, f"down{level}")
        skips.append(x)
        x = pool(x)
    x = block(x, f"down{levels}")
    for level in reversed(range(levels)):
        x = up_conv(x, w[f"up{level}"], w[f"up{level}.bias"])
        skip = attention(x, skips[level], w, f"attention{level}") if f"attention{level}.gate" in w else skips[level]
        x = block(joined(skip, x), f"merge{level}")
    return sigmoid(conv(x, w["out"], w["out.bias"]))[0]


# ---- weights


def shapes(channels: int, widths: list[int], convs: int = 2) -> dict[str, tuple[int, ...]]:
    """Names and shapes of the weights of encoder_decoder with `widths` channels at each depth, in the order of use."""
    out: dict[str, tuple[int, ...]] = {}

    def block(name: str, come: int, go: int) -> None:
        for k in range(convs):
            out[f"{name}.{k}"], out[f"{name}.{k}.bias"] = (go, come if k == 0 else go, 3, 3), (go,)

    for level, width in enumerate(widths):
        block(f"down{level}", channels if level == 0 else widths[level - 1], width)
    for level in reversed(range(len(widths) - 1)):
        out[f"up{level}"], out[f"up{level}.bias"] = (widths[level + 1], widths[level], 2, 2), (widths[level],)
        block(f"merge{level}", 2 * widths[level], widths[level])
    out["out"], out["out.bias"] = (1, widths[0], 1, 1), (1,)
    return out


def weight_table(numbers: DataFrame, wanted: dict[str, tuple[int, ...]]) -> DataFrame:
    """name, shape, values of the wanted weights, cut one after the other from numbers (k from 0, value)."""
    rows, start = [], 0
    for name, shape in wanted.items():
        rows.append((name, list(shape), start, start + int(np.prod(shape))))
        start = rows[-1][3]
    layers = numbers.sparkSession.createDataFrame(rows, "name string, shape array<int>, first long, past long")
    held = numbers.filter(F.col("k") < start).join(F.broadcast(layers), (F.col("k") >= F.col("first")) & (F.col("k") < F.col("past")))
    return held.groupBy("name", "shape").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "value"))), lambda x: x["value"]).alias("values"))


def load_weights(table: DataFrame, wanted: dict[str, tuple[int, ...]] | None = None) -> dict[str, np.ndarray]:
    """Arrays by name; raises where a weight is missing, has another shape, or there are too many numbers to broadcast."""
    size = table.agg(F.sum(F.size("values"))).first()[0] or 0
    if size > MOST_WEIGHTS:
        raise ValueError(f"{size} weights are more than the {MOST_WEIGHTS} that may be broadcast")
    out = {r["name"]: np.array(r["values"], float).reshape(r["shape"]) for r in table.collect() if len(r["values"]) == int(np.prod(r["shape"]))}
    wrong = [n for n, s in (wanted or {}).items() if n not in out or out[n].shape != tuple(s)]
    if wrong:
        raise ValueError(f"weights missing or of another shape: {', '.join(sorted(wrong))}")
    return out


# ---- tiles of cells


def tensor(cells: pa.Table, bands: list[str], r0: int, c0: int, side: int, missing: float = 0.0) -> np.ndarray:
    """The tile at (r0, c0) from the Arrow rows of its cells."""
    out = np.full((len(bands), side, side), missing)
    at = cells.column("r").to_numpy() - r0, cells.column("c").to_numpy() - c0
    for k, b in enumerate(bands):
        x = cells.column(b).cast(pa.float64()).to_numpy(zero_copy_only=False)  # NULL as NaN
        out[k][at] = np.where(np.isnan(x), missing, x)
    return out


def _tiles(cells: DataFrame, bands: list[str], side: int, step: int) -> DataFrame:
    return patches.sliding(cells.select("r", "c", *bands), side, step, partial=True)


def tile_tensors(cells: DataFrame, bands: list[str], side: int = 512, step: int = 448) -> DataFrame:
    """pr, pc, tensor (one array of doubles as bytes for each band) of each tile: a form to keep for several networks."""

    def build(key: tuple, rows: pa.Table) -> pa.Table:
        pr, pc = (int(k.as_py()) for k in key)
        x = tensor(rows, bands, pr * step, pc * step, side)
        return pa.table({"pr": pa.array([pr], pa.int32()), "pc": pa.array([pc], pa.int32()), "tensor": pa.array([[p.tobytes() for p in x]], pa.list_(pa.binary()))})

    schema = StructType([StructField("pr", IntegerType()), StructField("pc", IntegerType()), StructField("tensor", ArrayType(BinaryType()))])
    return _tiles(cells, bands, side, step).groupBy("pr", "pc").applyInArrow(build, schema)


def over_tiles(cells: DataFrame, bands: list[str], network: Callable[[np.ndarray], np.ndarray], side: int = 512, step: int = 448, missing: float = 0.0) -> DataFrame:
    """pr, pc, r, c, score: the network (channel, row, column) -> (row, column) on each tile, for the cells that exist."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        pr, pc = (int(k.as_py()) for k in key)
        score = network(tensor(rows, bands, pr * step, pc * step, side, missing))
        at = rows.column("r").to_numpy() - pr * step, rows.column("c").to_numpy() - pc * step
        return rows.select(["pr", "pc", "r", "c"]).append_column("score", pa.array(score[at]))

    return _tiles(cells, bands, side, step).groupBy("pr", "pc").applyInArrow(run, "pr int, pc int, r int, c int, score double")


def predict(cells: DataFrame, bands: list[str], weights: dict[str, np.ndarray], side: int = 512, step: int = 448, levels: int = 2) -> DataFrame:
    """r, c, score: the encoder-decoder on overlapping tiles, merged by the largest score."""
    if side % (1 << levels):
        raise ValueError(f"a tile of side {side} cannot be pooled {levels} times")
    shared = cells.sparkSession.sparkContext.broadcast(weights)  # checked by load_weights
    scored = over_tiles(cells, bands, lambda x: encoder_decoder(x, shared.value, levels), side, step)
    return patches.merge_max(scored, F.col("score"))


def numbered(vectors: DataFrame, key: str, values: str) -> DataFrame:
    """k, value: the numbers of vectors one after the other, in the order of a dense integer key; all have one length."""
    each = vectors.select(key, F.size(values).alias("_n"), F.posexplode(values).alias("_i", "_v"))
    return each.select((F.col(key) * F.col("_n") + F.col("_i")).alias("k"), F.col("_v").cast("double").alias("value"))
