"""Secret scan: fixed patterns, and a battery of randomness tests with false-discovery control.

Base spans come from three patterns (see BASE).  The method adds spans of kind `token`: runs of token characters that
look random.
1. The encoding of a token is inferred from its characters (hexadecimal, base 32, alphanumeric, base 64).
2. Three tests compare it with a random string over that alphabet: chi-squared uniformity of the alphabet, the number
   of runs above and below the alphabet's middle, and the serial correlation of neighbours.  Each gives a standard
   score; the statistic is the sum of their squares, small for random strings.
3. Tokens of letters only are the null sample: ordinary words.  Within each class of alphabet and length they are mixed
   with NULLS word-like strings, drawn from how letters, and digits, follow each other in all texts (a table of fixed size,
   without the candidates), so that the null is never smaller than that and fits the corpus at hand.  The share of the null with a statistic as small is the p-value of a token that mixes
   letters and digits.  Where fewer than TAIL of the null are as small, the share is extrapolated by a normal fit to the
   cube roots of the statistics (which are nearly normal), so that p-values have no floor and a single random token is
   found among many words, if its length allows it at all.  The Benjamini-Hochberg rule, with weights that grow with the
   logarithm of the length, turns p-values into a largest statistic for each class: of the tokens that it finds, a share
   of q at most is expected to be words.
   A token that the battery rejects as random at 0.1 % is never added.

The counts behind the rule are histograms of fixed size over all texts, summed per task and then by Spark.

Null texts count as empty; rows are judged one by one, so null or repeated ids change nothing; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import texts

#: Fixed patterns: kind, pattern, the group whose length counts, and its least length.
BASE = (
    ("assign", re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 2, 12),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 18),
    ("hex", re.compile(r"[0-9a-f]{16,}"), 0, 16),  # the runs of [0-9a-f]+ with 16 characters or more
)
KINDS = ("assign", "access", "hex", "token")
_TOKEN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
_ALPHABET = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz+/_=-"
#: Classes of token lengths, by their least length.
LENGTHS = (20, 24, 32, 40, 64, 128)
#: The statistic's histogram: bins of this width, the last one open.
STEP, BINS = 0.25, 400
#: Sizes of the alphabets; a class is an alphabet and a class of lengths.
ALPHABETS = (16, 32, 62, 64)
#: Word-like strings in the null of each class; below this many of them p-values are extrapolated.
NULLS, TAIL = 1 << 13, 32
#: Different words, and numbers, that the null draws from the counts of pairs.
DRAWN = 2048
#: Letters a to z and digits, each with a mark for the ends of a run; pairs of them are counted.
LETTERS, DIGITS = 27, 11

#: The 99.9 % quantile of chi-squared with three degrees of freedom: what exceeds it is rejected as random.
RANDOM_AT_MOST = 16.25

_INDEX = np.zeros(128, np.int64)
for _k, _c in enumerate(_ALPHABET):
    _INDEX[ord(_c)] = min(_k, 63)


def length_class(n: int) -> int:
    return int(np.searchsorted(LENGTHS, n, "right")) - 1


def _statistics_of(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The statistic of each row of m, tokens of one length as bytes, and the size of its alphabet."""
    x = _INDEX[m]
    n = m.shape[1]
    digit, upper, lower = x < 10, (x >= 10) & (x < 36), (x >= 36) & (x < 62)
    hexa = ((x < 16) | (x >= 36) & (x < 42)).all(axis=1) & ~((x >= 10) & (x < 16)).any(axis=1) | (x < 16).all(axis=1)
    base32 = ((x >= 10) & (x < 36) | (x >= 2) & (x < 8)).all(axis=1)
    alnum = (digit | upper | lower).all(axis=1)
    size = np.select([hexa, base32, alnum], [16, 32, 62], 64)
    x = np.where(hexa[:, None] & (x >= 36), x - 26, x)
    x = np.where((base32 & ~hexa)[:, None], np.where(x < 10, x - 2, x - 4), x)
    at = x + 64 * np.arange(len(x))[:, None]
    counts = np.bincount(at.ravel(), minlength=64 * len(x)).reshape(-1, 64)
    chi = (counts * counts).sum(axis=1) * size / n - n
    free = size - 1
    # Wilson and Hilferty: the cube root of chi-squared is nearly normal; only too large is against randomness
    uniform = np.maximum(((np.maximum(chi, 0) / free) ** (1 / 3) - (1 - 2 / (9 * free))) / np.sqrt(2 / (9 * free)), 0)
    high = x * 2 >= size[:, None]
    n1 = high.sum(axis=1)
    n0 = n - n1
    mean = 2.0 * n1 * n0 / n + 1
    var = np.maximum((mean - 1) * (mean - 2) / (n - 1), 1e-9)
    runs = (high[:, 1:] != high[:, :-1]).sum(axis=1) + 1
    balance = (n1 - n0) / np.sqrt(n)
    z_runs = np.where((n1 == 0) | (n0 == 0), balance, (runs - mean) / np.sqrt(var))
    c = x - x.mean(axis=1, keepdims=True)
    power = (c * c).sum(axis=1)
    serial = np.where(power > 0, (c[:, 1:] * c[:, :-1]).sum(axis=1) / np.maximum(power, 1e-9), 1.0) * np.sqrt(n)
    return uniform**2 + z_runs**2 + serial**2, size


def statistics(tokens: list[str]) -> np.ndarray:
    """The statistic of each token, computed side by side for tokens of one length."""
    return _judged(tokens)[0]


def _judged(tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The statistic and the class of each token."""
    out, size, by = np.zeros(len(tokens)), np.full(len(tokens), ALPHABETS[0]), {}
    for k, t in enumerate(tokens):
        by.setdefault(len(t), []).append(k)
    for n, at in by.items():
        for s in range(0, len(at), 4096):
            part = at[s : s + 4096]
            out[part], size[part] = _statistics_of(np.frombuffer("".join(tokens[k] for k in part).encode(), np.uint8).reshape(-1, n))
    lengths = np.array([length_class(len(t)) for t in tokens], np.int64)
    return out, np.searchsorted(ALPHABETS, size) * len(LENGTHS) + lengths


_AS_LETTER, _AS_DIGIT = np.zeros(256, np.int64), np.zeros(256, np.int64)
for _k in range(26):
    _AS_LETTER[ord("a") + _k] = _AS_LETTER[ord("A") + _k] = _k + 1
for _k in range(10):
    _AS_DIGIT[ord("0") + _k] = _k + 1


def pairs_of(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Counts of neighbouring letters, case folded, and of neighbouring digits, with the ends of their runs; candidates are
    left out, so that secrets do not shape the null they are held against."""
    x = np.frombuffer(_TOKEN.sub(lambda m: " " if _is_candidate(m[0]) else m[0], f" {text} ").encode("latin-1", "replace"), np.uint8)
    letter, digit = _AS_LETTER[x], _AS_DIGIT[x]
    return np.bincount(letter[:-1] * LETTERS + letter[1:], minlength=LETTERS**2), np.bincount(digit[:-1] * DIGITS + digit[1:], minlength=DIGITS**2)


def drawn_runs(pairs: np.ndarray, signs: str, allowed: str, rng: np.random.Generator, most: int = 24, least: int = 1) -> list[str]:
    """Runs of at least `least` allowed signs as the counts of pairs have them: a chain from the end of one run to the next.  Pairs
    count a little even where the corpus lacks them, so that an empty corpus has a chain too."""
    own = np.array([0] + [k + 1 for k, c in enumerate(signs) if c in allowed])
    n = pairs.reshape(len(signs) + 1, -1)[np.ix_(own, own)] + 1e-3
    n[0, 0] = 0.0
    table = (n / n.sum(1, keepdims=True)).cumsum(1)
    state, runs = np.zeros(DRAWN, np.int64), np.zeros((DRAWN, most), np.int64)
    for k in range(most):
        before, u = state, rng.random(DRAWN)
        if k < least:  # the run may not end yet
            u = table[before, 0] + u * (1 - table[before, 0])
        state = np.minimum((table[before] < u[:, None]).sum(1), len(own) - 1)
        if k >= least:
            state[before == 0] = 0  # ended
        runs[:, k] = state
    show = np.array(["", *(signs[k - 1] for k in own[1:])])
    return ["".join(show[r]) for r in runs]


def _word_stream(size: int, letters: np.ndarray, digits: np.ndarray, rng: np.random.Generator, n: int = 1 << 16) -> tuple[str, np.ndarray]:
    """A stream of n words drawn from the counts of pairs, in the way of an alphabet, and where its words start.  Styles
    change every 64 words: how often words are capitalised, followed by a number or a mark."""
    alphabet = "abcdefghijklmnopqrstuvwxyz"
    pool = drawn_runs(letters, alphabet, "abcdef" if size == 16 else alphabet, rng, least=3 if size == 16 else 4)
    numbers = drawn_runs(digits, "0123456789", "234567" if size == 32 else "0123456789", rng, 4)  # years and small numbers
    words = [pool[i] for i in rng.integers(0, DRAWN, n).tolist()]
    style = np.repeat(rng.random((-(-n // 64), 3)), 64, axis=0)[:n]
    style[:, 1] *= 0.6
    on = (rng.random((n, 3)) < style).tolist()
    number, mark = rng.integers(0, DRAWN, n).tolist(), rng.choice(list("___---/="), n).tolist()
    for i, (capital, counted, marked) in enumerate(on):
        w = words[i].upper() if size == 32 else words[i].capitalize() if capital and size > 32 else words[i]
        words[i] = w + (mark[i] if marked and size == 64 else "") + (numbers[number[i]] if counted else "")
    return "".join(words), np.cumsum([0] + [len(w) for w in words])


def word_null(letters: np.ndarray | None = None, digits: np.ndarray | None = None) -> np.ndarray:
    """The histogram [class, bin] of NULLS word-like strings in each class, from the corpus's counts of pairs."""
    letters = np.zeros(LETTERS**2) if letters is None else letters
    digits = np.zeros(DIGITS**2) if digits is None else digits
    rng, held = np.random.default_rng(7), np.zeros((len(ALPHABETS) * len(LENGTHS), BINS), np.int64)
    for k, size in enumerate(ALPHABETS):
        stream, starts = _word_stream(size, letters, digits, rng)
        for j, n in enumerate(LENGTHS):
            most, own = LENGTHS[j + 1] if j + 1 < len(LENGTHS) else 2 * n, k * len(LENGTHS) + j
            left, tries = NULLS, 0
            while left > 0 and tries < 40:  # strings whose characters do not need the whole alphabet belong to another class
                at = rng.choice(starts[starts < len(stream) - 2 * n], NULLS)
                stat, kind = _judged([stream[a : a + m] for a, m in zip(at.tolist(), rng.integers(n, most, NULLS).tolist())])
                stat = stat[kind == own][:left]
                held[own] += np.bincount(np.minimum(stat / STEP, BINS - 1).astype(np.int64), minlength=BINS)
                left, tries = left - len(stat), tries + 1
    return held


def base_spans(text: str) -> list[tuple[str, int, int]]:
    found = []
    for kind, pattern, group, least in BASE:
        found += [(kind, m.start(), m.end()) for m in pattern.finditer(text) if m.end(group) - m.start(group) >= least]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def _letters_only(t: str) -> bool:
    return t.isalpha()


def _is_candidate(t: str) -> bool:
    """Letters and digits both, and not a few words joined by marks."""
    return any("0" <= c <= "9" for c in t) and any(c.isalpha() for c in t)


def _tokens(text: str) -> list[tuple[int, str]]:
    return [(m.start(), m[0]) for m in _TOKEN.finditer(text)]


def _histogram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = np.zeros((2, len(ALPHABETS) * len(LENGTHS), BINS), np.int64)
    letters, digits = np.zeros(LETTERS**2, np.int64), np.zeros(DIGITS**2, np.int64)
    for batch in batches:
        for text in batch.column("text").to_pylist():
            a, b = pairs_of(text)
            letters += a
            digits += b
        tokens = [t for text in batch.column("text").to_pylist() for _, t in _tokens(text)]
        tokens = [t for t in tokens if _letters_only(t) or _is_candidate(t)]
        stat, kind = _judged(tokens)
        bins = np.minimum(stat / STEP, BINS - 1).astype(np.int64)
        role = np.array([0 if _letters_only(t) else 1 for t in tokens], np.int64)
        np.add.at(held, (role, kind, bins), 1)
    at = np.argwhere(held)
    rows = [np.column_stack([at, held[tuple(at.T)]])]
    for role, counts in ((2, letters), (3, digits)):
        k = np.flatnonzero(counts)
        rows.append(np.column_stack([np.full(len(k), role), np.zeros_like(k), k, counts[k]]))
    rows = np.concatenate(rows)
    yield pa.RecordBatch.from_arrays([pa.array(rows[:, k]) for k in range(4)], names=["role", "class", "bin", "n"])


def p_values(null: np.ndarray) -> np.ndarray:
    """For each class and bin of the null's histogram the chance that a word-like string has a statistic in that bin or
    below."""
    mids, edges = np.cbrt((np.arange(BINS) + 0.5) * STEP), np.cbrt(np.arange(1, BINS + 1) * STEP)
    p = np.empty(null.shape)
    for k, held in enumerate(null):
        n, counts = held.sum(), np.cumsum(held)
        mean = (held * mids).sum() / n
        sd = max(np.sqrt((held * (mids - mean) ** 2).sum() / n), 1e-3)
        # math.erfc holds its precision far out; TAIL null strings lie at or below the bin `at`
        normal = np.array([0.5 * math.erfc((mean - e) / sd / math.sqrt(2)) for e in edges])
        at = int(np.searchsorted(counts, TAIL))
        p[k] = (1 + counts) / (1 + n)
        p[k, :at] = np.minimum(p[k, :at], p[k, at] * normal[:at] / max(normal[at], 1e-300))
    return p


def limits(held: np.ndarray, q: float = 0.01, null: np.ndarray | None = None) -> np.ndarray:
    """For each class the number of first bins that count as random, from held[role, class, bin] (0 null, 1 candidates) and
    the null drawn from the corpus's pairs."""
    seen = held[1]
    total = seen.sum()
    out = np.zeros(held.shape[1], np.int64)
    if not total:
        return out
    p = p_values(held[0] + (word_null() if null is None else null))
    weight = np.log(np.tile(np.array(LENGTHS, float), len(ALPHABETS)))
    weight /= (weight * seen.sum(axis=1)).sum() / total  # mean 1 over candidates
    scaled = p / weight[:, None]
    order = np.argsort(scaled, axis=None, kind="stable")
    found = np.cumsum(seen.ravel()[order])
    passed = np.flatnonzero(scaled.ravel()[order] <= q * found / total)
    if len(passed):
        cut = scaled.ravel()[order][passed[-1]]
        out = (scaled <= cut).sum(axis=1)
    return np.minimum(out, int(RANDOM_AT_MOST / STEP))


def learn_limits(docs: DataFrame, q: float = 0.01) -> np.ndarray:
    held = np.zeros((2, len(ALPHABETS) * len(LENGTHS), BINS), np.int64)
    rows = texts(docs).select("text").mapInArrow(_histogram, "role long, class long, bin long, n long")
    letters, digits = np.zeros(LETTERS**2), np.zeros(DIGITS**2)
    for r in rows.groupBy("role", "class", "bin").agg(F.sum("n").alias("n")).collect():  # at most 2 * 24 * 400 + 27^2 + 11^2 rows
        if r["role"] < 2:
            held[r["role"], r["class"], r["bin"]] = r["n"]
        else:
            (letters if r["role"] == 2 else digits)[r["bin"]] = r["n"]
    return limits(held, q, word_null(letters, digits)) if held[1].any() else limits(held, q)


def _apart(found: list[tuple[str, int, int]], base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """The spans of found that no span of base overlaps; both sorted by start, found without overlaps."""
    out, k, reach = [], 0, 0
    for x in found:
        while k < len(base) and base[k][1] < x[2]:
            reach = max(reach, base[k][2])
            k += 1
        if reach <= x[1]:  # no base span that starts before the end of x reaches into it
            out.append(x)
    return out


def spans_of(text: str, limit: np.ndarray) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans, and all spans with the random tokens that overlap none of them."""
    base = base_spans(text)
    found = [(s, t) for s, t in _tokens(text) if _is_candidate(t)]
    if found:
        stat, kind = _judged([t for _, t in found])
        bins = np.minimum(stat / STEP, BINS - 1).astype(int)
        found = [("token", s, s + len(t)) for (s, t), b, k in zip(found, bins, kind) if b < limit[k]]
        found = _apart(found, base)
    return base, sorted(base + found, key=lambda s: (s[1], KINDS.index(s[0])))


def join(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def secret_spans(docs: DataFrame, q: float = 0.01) -> DataFrame:
    """doc_id, spans: array of (kind, start, end, base) in code points, end exclusive."""
    limit = learn_limits(docs, q)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))
        for batch in batches:
            out = []
            for text in batch.column("text").to_pylist():
                _, spans = spans_of(text, limit)
                out.append([{"kind": k, "start": s, "end": e, "base": k != "token"} for k, s, e in spans])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, kind)], names=["doc_id", "spans"])

    return texts(docs).mapInArrow(run, "doc_id long, spans array<struct<kind:string,start:long,end:long,base:boolean>>")


def span_digests(found: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans from secret_spans."""
    text = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    joined = lambda a: F.concat_ws(",", F.transform(a, text))
    base = F.filter("spans", lambda s: s["base"])
    of_kind = lambda k: F.filter("spans", lambda s: s["kind"] == k)
    counts = [F.size(of_kind(k)).cast("long").alias(f"n_{k}") for k in KINDS[:3]]
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
