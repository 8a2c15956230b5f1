"""Packing of documents into sequences by a grouping genetic algorithm on islands.

Method
------
1. Texts become pieces of at most `size` ids; only longer documents are cut, and only their first piece may be shorter.
2. Pieces are dealt by a hash to demes of about `deme` pieces, and best fit gives each deme a first packing.  One that
   meets the lower bound (the sum of lengths over the size, or the number of pieces above half the size) cannot be
   improved and is done.
3. On every other deme two islands evolve a population, in tasks of their own.  Crossover injects whole well-filled
   sequences of one parent into the other; sequences that then hold a duplicate are dissolved, ill-filled ones partly;
   displaced pieces first replace one or two pieces of an open sequence where that fills it better, and the rest is best
   fitted, longest first.  The worst packing gives way to a better child.
4. Elites migrate `EPOCHS` times: each island's best packing goes to both, which evolve on from them.
5. Sequences that are still ill-filled, and have room for the shortest piece left, are dissolved and their pieces dealt
   anew to fewer demes.  A level counts only if it needs fewer sequences than those pieces had before; else these stay,
   and the search ends.  It also ends with one deme, or after LEVELS levels.

Demes have bounded size, so that no task holds more than one deme's lengths; texts never leave the first step.  Every
piece is packed whatever the search does; generations, epochs and levels only bound its effort.

Null texts count as empty and hold the end id alone.  Rows that repeat in full are packed as often as they occur.  An
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Written, texts
from .tokens import at_once, encoder

SIZE = 2048
DEME = 8192
#: Sequences filled to this share count as well-filled: they are injected, and stay when others are packed again.
WELL = 0.995
#: Migrations between the islands of a deme, and times that what is left is dealt anew.
EPOCHS, LEVELS = 2, 8
#: Packings of an island, and open sequences that one child tries to fill by replacement.
POPULATION, REPLACED = 8, 48
#: Ways of taking pieces out of one sequence that replacement tries: all for up to ten pieces, then none and single ones first.
WAYS = 64
#: About so many pieces are displaced at once, so that a generation costs much the same in a deme of any size.
MOVED = 1500
#: Stands for a null doc_id inside the islands, where pandas has no null integers.
NAMELESS = -(1 << 63)


def pieces_of(n: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of a document of n ids."""
    first = n % size or size
    return [(0, min(n, first))] + [(s, size) for s in range(first, n, size)] if n > size else [(0, n)]


def _pieces(path: str, end: int, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, True)
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for lo, hi in at_once(batch.column("text")):
                rows = batch.slice(lo, hi - lo)
                for i, ids in zip(rows.column("doc_id").to_pylist(), enc.encode_spaced(rows.column("text").to_pylist())):
                    ids = np.append(ids, end).astype("<u4")
                    for k, (s, n) in enumerate(pieces_of(len(ids), size)):
                        for x, v in zip(out, (i, k, s, n, zlib.crc32(ids[s : s + n]))):
                            x.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


# ---- one deme, in memory: a packing is an array with the sequence of each piece


def best_fit(length: np.ndarray, todo: np.ndarray, room: list[tuple[int, int]], fresh: int, size: int) -> tuple[dict[int, int], int]:
    """Put pieces, longest first, into the fullest sequence that has room, or a new one.

    room: sorted (free, sequence) of open sequences, changed in place.  Gives sequence by piece, and the next number."""
    put = {}
    for i in todo[np.argsort(-length[todo], kind="stable")].tolist():
        n = int(length[i])
        k = bisect.bisect_left(room, (n, -1))
        if k < len(room):
            free, seq = room.pop(k)
        else:
            free, seq, fresh = size, fresh, fresh + 1
        put[i] = seq
        if free > n:
            bisect.insort(room, (free - n, seq))
    return put, fresh


def _fill(packing: np.ndarray, length: np.ndarray) -> np.ndarray:
    return np.bincount(packing, length).astype(np.int64)


def fitness(packing: np.ndarray, length: np.ndarray, size: int) -> float:
    """Mean squared filling of the sequences in use: few and full is best."""
    full = _fill(packing, length)
    full = full[full > 0] / size
    return float((full * full).mean())


def lower_bound(length: np.ndarray, size: int) -> int:
    """No packing has fewer sequences: the sum over the size, and no two pieces above half the size fit together."""
    return max(-(-int(length.sum()) // size), int((length * 2 > size).sum()))


def _best_sum(d: np.ndarray, lo: int, hi: int) -> tuple[int, ...]:
    """Places of one or two entries of the sorted lengths d with the largest sum in (lo, hi]; none gives ()."""
    best, at = lo, ()
    k = int(np.searchsorted(d, hi, "right")) - 1
    if k >= 0 and d[k] > best:
        best, at = int(d[k]), (k,)
    if best < hi and len(d) > 1:
        i = np.arange(len(d))
        j = np.minimum(np.searchsorted(d, hi - d, "right") - 1, i - 1)
        two = np.where(j >= 0, d + d[j], -1)
        k = int(two.argmax())
        if two[k] > best:
            at = (k, int(j[k]))
    return at


def replace(members: list[int], spare: np.ndarray, length: np.ndarray, size: int) -> tuple[list[int], np.ndarray]:
    """members with none, one or two of them replaced by one or two spare pieces (sorted by length) so that the
    sequence is as full as possible; the pieces and the spare ones after it."""
    room, d = size - int(length[members].sum()), length[spare]
    ways = [()] + [(x,) for x in range(len(members))] + [(x, y) for x in range(len(members)) for y in range(x)]
    best, gain = None, 0
    for way in ways[:WAYS]:
        out = int(sum(length[members[x]] for x in way))
        at = _best_sum(d, out + gain, out + room)
        if at:
            best, gain = (way, at), int(d[list(at)].sum()) - out
            if gain == room:
                break
    if best is None:
        return members, spare
    way, at = best
    left = np.append(np.delete(spare, list(at)), [members[x] for x in way]).astype(np.int64)
    return [m for x, m in enumerate(members) if x not in way] + spare[list(at)].tolist(), left[np.argsort(length[left], kind="stable")]


def crossover(a: np.ndarray, b: np.ndarray, length: np.ndarray, size: int, rng: np.random.Generator) -> np.ndarray:
    """A child of a: some well-filled sequences of b whole, untouched sequences of a, and the displaced pieces by
    replacement and best fit."""
    full = _fill(b, length)
    good = np.flatnonzero(full >= min(WELL, np.quantile(full[full > 0] / size, 0.6)) * size)
    good = good[rng.random(len(good)) < rng.uniform(0.05, 0.5) * min(1, MOVED / len(length))]
    injected = np.isin(b, good)
    hit = np.zeros(int(a.max()) + 1, bool)
    hit[a[injected]] = True  # sequences of a that hold a piece twice now
    return _refilled(np.where(injected, b + len(hit), a), injected, hit[a] & ~injected, length, size, rng)


def mutation(a: np.ndarray, length: np.ndarray, size: int, rng: np.random.Generator) -> np.ndarray:
    """a with some of its sequences dissolved and their pieces placed again."""
    hit = rng.random(int(a.max()) + 1) < rng.random() * min(1, MOVED / len(length))
    return _refilled(a, np.zeros(len(a), bool), hit[a], length, size, rng)


def _refilled(child: np.ndarray, fixed: np.ndarray, displaced: np.ndarray, length: np.ndarray, size: int, rng: np.random.Generator) -> np.ndarray:
    """child with the displaced pieces, and those of some ill-filled sequences, placed by replacement and best fit;
    the sequences of fixed pieces stay as they are."""
    fresh = int(child.max()) + 1
    left = np.bincount(child[~displaced], length[~displaced], fresh).astype(np.int64)
    closed = np.zeros(fresh, bool)
    closed[child[fixed]] = True
    poor = np.flatnonzero((left > 0) & (left < WELL * size) & ~closed)
    closed[poor[rng.random(len(poor)) < rng.uniform(0.1, 0.8)]] = True
    spare = np.flatnonzero(displaced | closed[child] & ~fixed)
    left[closed] = size
    open_ = np.flatnonzero((left > 0) & (left < size))
    spare = spare[np.argsort(length[spare], kind="stable")]
    tried, child = rng.permutation(open_)[:REPLACED], child.copy()
    if len(spare) and len(tried):
        place = np.full(fresh, -1)
        place[tried] = np.arange(len(tried))
        held: list[list[int]] = [[] for _ in tried]
        taken = np.zeros(len(child), bool)
        taken[spare] = True
        for i in np.flatnonzero(~taken & (place[child] >= 0)).tolist():
            held[place[child[i]]].append(i)
        for seq, members in zip(tried.tolist(), held):
            if not len(spare):
                break
            members, spare = replace(members, spare, length, size)
            child[members] = seq
            left[seq] = length[members].sum()
    room = sorted((size - int(left[s]), int(s)) for s in open_ if left[s] < size)
    put, _ = best_fit(length, spare, room, fresh, size)
    for i, s in put.items():
        child[i] = s
    return np.unique(child, return_inverse=True)[1]


def packed_by_best_fit(length: np.ndarray, size: int) -> np.ndarray:
    put, _ = best_fit(length, np.arange(len(length)), [], 0, size)
    out = np.full(len(length), -1)
    out[list(put)] = list(put.values())
    return out


def evolve(length: np.ndarray, seeds: list[np.ndarray], size: int, rng: np.random.Generator, turns: int | None = None, population: int = POPULATION) -> np.ndarray:
    """The best packing after some generations, from the given ones, or best fit, and mutations of the first.

    By default there are 16 to 600 generations, fewer for many pieces, as a generation's work and the number needed grow
    with them: a full deme has 16, one of 1,350 pieces 600."""
    turns = int(np.clip(1.1e9 / max(1, len(length)) ** 2, 16, 600)) if turns is None else turns
    bound, group = lower_bound(length, size), list(seeds)
    for p in group:
        if len(np.unique(p)) <= bound:
            return p
    while len(group) < population:
        group.append(mutation(group[0], length, size, rng) if group else packed_by_best_fit(length, size))
    # fewest sequences first, then the fullest ones
    value = lambda p: (-len(np.unique(p)), fitness(p, length, size))
    score = [value(p) for p in group]
    for _ in range(turns):
        if -max(score)[0] <= bound:
            break
        picked = rng.permutation(len(group))
        x, y = (max(pair, key=score.__getitem__) for pair in (picked[: len(group) // 2], picked[len(group) // 2 :]))
        child = crossover(*((group[x], group[y]) if rng.random() < 0.5 else (group[y], group[x])), length, size, rng)
        worst, v = min(range(len(group)), key=score.__getitem__), value(child)
        if v > score[worst] and v not in score:
            group[worst], score[worst] = child, v
    return group[max(range(len(group)), key=score.__getitem__)]


# ---- islands as Spark groups


_ITEM = "doc_id long, piece int, start long, length long, ids_crc32 long, copy long"
_NAMES = [c.split()[0] for c in _ITEM.split(", ")]


def _ordered(pdf: pd.DataFrame) -> pd.DataFrame:
    return pdf.sort_values(_NAMES, kind="stable").reset_index(drop=True)


def _pack_once(items: DataFrame, demes: int, size: int, level: int) -> DataFrame:
    """items with sequence_id, offset, and `room`: what is left of the sequence."""

    def first(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = _ordered(pdf)
        length = pdf["length"].to_numpy()
        seq = packed_by_best_fit(length, size).astype(np.int64)
        return pdf.assign(seq=seq, done=bool(seq.max() + 1 <= lower_bound(length, size)))[[*_NAMES, "deme", "seq", "done"]]

    def evolved(pdf: pd.DataFrame) -> pd.DataFrame:
        """One epoch of an island, from the elites that came to it."""
        own = [_ordered(g) for _, g in pdf.groupby("came_from")]
        out, island = own[0], int(pdf["island"].iloc[0])
        rng = np.random.default_rng([level, int(out["deme"][0]), int(out["epoch"][0]), island])
        packing = evolve(out["length"].to_numpy(), [g["seq"].to_numpy() for g in own], size, rng)
        return out.assign(seq=packing.astype(np.int64), epoch=out["epoch"] + 1)[[*_NAMES, "deme", "seq", "epoch", "island"]]

    def chosen(pdf: pd.DataFrame) -> pd.DataFrame:
        ways = [_ordered(g) for _, g in pdf.groupby("island")]
        out = min(ways, key=lambda g: (g["seq"].nunique(), -fitness(g["seq"].to_numpy(), g["length"].to_numpy(), size)))
        out = out.sort_values(["seq", *_NAMES], kind="stable")
        ends = out.groupby("seq")["length"].cumsum()
        room = size - out.groupby("seq")["length"].transform("sum")
        out = out.assign(sequence_id=(level << 56) + out["deme"] * (1 << 24) + out["seq"], offset=ends - out["length"], room=room)
        return out[[*_NAMES, "sequence_id", "offset", "room"]]

    dealt = items.select(*_NAMES, F.pmod(F.xxhash64("doc_id", "piece", "copy", F.lit(level)), F.lit(demes)).alias("deme"))
    begun = Written(dealt.groupBy("deme").applyInPandas(first, f"{_ITEM}, deme long, seq long, done boolean"), "begun").df
    best = begun.filter("done").select(*_NAMES, "deme", "seq", F.lit(0).alias("island"))
    state = begun.filter("NOT done").select(*_NAMES, "deme", "seq", F.lit(0).alias("epoch"), F.explode(F.array(F.lit(0), F.lit(1))).alias("island"), F.lit(0).alias("came_from"))
    if state.limit(1).count():
        for epoch in range(EPOCHS + 1):
            elites = state.groupBy("deme", "island").applyInPandas(evolved, f"{_ITEM}, deme long, seq long, epoch int, island int")
            if epoch < EPOCHS:  # each elite goes to both islands
                state = elites.withColumnRenamed("island", "came_from").withColumn("island", F.explode(F.array(F.lit(0), F.lit(1))))
        best = best.union(elites.select(*_NAMES, "deme", "seq", "island"))
    return best.groupBy("deme").applyInPandas(chosen, f"{_ITEM}, sequence_id long, offset long, room long")


def pack(pieces: DataFrame, size: int = SIZE, deme: int = DEME) -> DataFrame:
    """pieces (doc_id, piece, start, length, ids_crc32) with sequence_id and offset."""
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    named = pieces.withColumn("doc_id", F.coalesce("doc_id", F.lit(NAMELESS)))
    todo = Written(named.groupBy(key).count().select(*key, F.explode(F.sequence(F.lit(1).cast("long"), F.col("count"))).alias("copy")), "pieces").df
    n, level, parts, before = todo.count(), 0, [], None
    while n:
        demes = max(1, -(-n // deme))
        packed = Written(_pack_once(todo, demes, size, level), "packed").df
        used = packed.filter("offset = 0").count()  # each sequence has one piece at its start
        if before is not None and used >= before[1]:
            parts.append(before[0])
            break
        ill = F.col("room") > (1 - WELL) * size
        shortest = packed.filter(ill).agg(F.min("length")).first()[0]
        opened = ill & (F.col("room") >= F.lit(shortest)) if shortest and demes > 1 else F.lit(False)
        parts.append(packed.filter(~opened))
        todo = packed.filter(opened)
        before, n, level = (todo, todo.filter("offset = 0").count()), todo.count(), level + 1
        if n and level >= LEVELS:
            parts.append(todo)
            break
    out = todo.select("*", F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset")) if not parts else parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.select(F.nullif(F.col("doc_id"), F.lit(NAMELESS)).alias("doc_id"), *key[1:], "sequence_id", "offset")


def pack_documents(docs: DataFrame, tokenizer: str, end: int, size: int = SIZE, deme: int = DEME) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of each piece of docs."""
    pieces = texts(docs).mapInArrow(_pieces(tokenizer, end, size), "doc_id long, piece int, start long, length long, ids_crc32 long")
    return pack(pieces, size, deme)
