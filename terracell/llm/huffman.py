"""Canonical length-limited Huffman codes over arrays of ids, in numpy."""

from __future__ import annotations

import numpy as np

LIMIT = 16


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """The optimal code length, at most `limit`, of each symbol (0 where the count is 0), by package-merge."""
    lengths = np.zeros(len(counts), np.uint8)
    used = np.flatnonzero(counts)
    used = used[np.argsort(counts[used], kind="stable")]
    n = len(used)
    if n > 1 << limit:
        raise ValueError(f"{n} symbols do not fit codes of {limit} bits")
    if n < 2:
        lengths[used] = 1
        return lengths
    items = counts[used].astype(np.float64)
    merged, is_item = items, [np.ones(n, bool)]
    for _ in range(limit - 1):
        packages = merged[: len(merged) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate([items, packages])
        order = np.argsort(both, kind="stable")
        merged = both[order]
        is_item.append(order < n)
    take, depth = 2 * n - 2, np.zeros(n + 1, np.int64)
    for level in reversed(is_item):
        own = int(level[:take].sum())  # the cheapest symbols get one bit more
        depth[own] += 1
        take = 2 * (take - own)
    lengths[used] = np.cumsum(depth[::-1])[::-1][1:]
    return lengths


def codes(lengths: np.ndarray) -> np.ndarray:
    """The canonical code of each symbol: by length, then by symbol."""
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    out = np.zeros(len(lengths), np.uint64)
    if len(order):
        own = lengths[order].astype(np.uint64)
        top = np.uint64(int(own.max()))
        steps = np.uint64(1) << (top - own)
        out[order] = (np.cumsum(steps) - steps) >> (top - own)
    return out


def encode(ids: np.ndarray, lengths: np.ndarray, code: np.ndarray, every: int) -> tuple[bytes, np.ndarray]:
    """The bits of ids, and the bit offset of every `every`-th id."""
    size = lengths[ids].astype(np.int64)
    ends = np.cumsum(size)
    begin = ends - size
    bits = code[ids] << (np.uint64(64) - (begin & 31).astype(np.uint64) - size.astype(np.uint64))
    words = (int(ends[-1]) + 31) // 32 + 1 if len(ids) else 1
    at = begin >> 5
    # codes never overlap, so that sums of parts are exact unions of bits
    held = np.bincount(at, (bits >> np.uint64(32)).astype(np.float64), words)
    held[: words] += np.bincount(at + 1, (bits & np.uint64(0xFFFFFFFF)).astype(np.float64), words + 1)[:words]
    return held.astype(">u4").tobytes(), begin[::every].astype(np.uint32)


class Decoder:
    """Table-driven decoding: the next LIMIT bits index the symbol and its length."""

    def __init__(self, lengths: np.ndarray, limit: int = LIMIT):
        self.limit = limit
        order = np.lexsort((np.arange(len(lengths)), lengths))
        order = order[lengths[order] > 0]
        spans = np.int64(1) << (limit - lengths[order].astype(np.int64))
        pad = (1 << limit) - int(spans.sum())
        self.symbol = np.concatenate([np.repeat(order, spans), np.zeros(pad, np.int64)]).astype(np.int32)
        self.size = lengths[self.symbol].astype(np.int64)

    def decode(self, bits: bytes, offsets: np.ndarray, n: int, every: int) -> np.ndarray:
        """n ids; the stretches between checkpoints are decoded side by side, one id of each at a time."""
        raw = np.frombuffer(bits + b"\0\0\0", np.uint8).astype(np.int64)
        window = raw[:-2] << 16 | raw[1:-1] << 8 | raw[2:]
        out = np.zeros((len(offsets), every), np.int32)
        at, last = offsets.astype(np.int64), len(window) - 1
        for k in range(every):
            peek = (window[np.minimum(at >> 3, last)] >> (24 - self.limit - (at & 7))) & ((1 << self.limit) - 1)
            out[:, k] = self.symbol[peek]
            at = at + self.size[peek]
        return out.ravel()[:n]
