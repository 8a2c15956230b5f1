"""Personal data by weak supervision, in DataFrame functions alone.

Base spans are the matches of four fixed patterns that pass their test (see BASE); they always stay.  The method then
looks at further candidates:
1. Loose patterns propose spans that no base span overlaps: written-out addresses, phone numbers without a plus sign,
   numbers grouped like cards.  Each candidate gets votes (1 for, 0 against, ? for no opinion) from labelers of three
   sorts: regular expressions on the span, gazetteers (domains, address blocks, issuer numbers, calling codes) and the
   words around it.  Base spans and failing base matches are candidates too, so that votes cover good and bad examples.
2. Candidates are counted by kind, votes and shape (length class, separators, neighbours): at most 4 * 3^6 * 3 * 5 * 16
   counts, whatever the input.  On those, expectation-maximisation estimates each labeler's reliabilities from the votes,
   and the posterior of each pattern of votes.
3. A logistic regression on kind, votes and shape, trained on the posteriors, is the final span classifier; the shape is
   what no labeler sees.  Loose candidates that pass their kind's test, overlap no base span and score at least
   `threshold` are added.

Scans, votes, counts and spans are DataFrame functions; the driver sees only the table of counts.

Offsets count code points.  Java has no match positions in SQL, so text is split at the matches, and the lengths of
the parts before give the places.  Groups repeat possessively, and a pattern is tried only where a run of its first
class begins or the match before ended: inside a run it would meet the same rest, so the matches are the same, and a
long run is read once.

Null texts count as empty.  A null or repeated doc_id is a row like any other (rows of one id and text have one
result each); an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import json
import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Written, texts

KINDS = ("email", "ip", "card", "phone")

#: Fixed patterns of the base spans; classes as in the contract.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a pattern to be tried at all.
NEEDED = {"email": "@", "ip": ".", "card": None, "phone": "+"}

#: Loose patterns of further candidates.
LOOSE = {
    "email": r"(?i)\b[a-z0-9._%+-]{1,64}\s?(?:\[at\]|\(at\)|\{at\})\s?[a-z0-9-]{1,63}\s?(?:(?:\[dot\]|\(dot\)|\.)\s?[a-z]{2,24})\b",
    "ip": r"(?<![0-9.])[0-9]{1,3}(?:\[\.\][0-9]{1,3}){3}(?![0-9.])",
    "card": r"(?<![0-9-])[0-9]{4}(?:\.[0-9]{4}){3}(?![0-9-])",
    "phone": r"(?<![0-9+().-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[-.])[0-9]{3}[-.][0-9]{4}(?![0-9-])",
}

#: Fixed values of the gazetteers.  Generic top-level domains; two letters are a country's.
DOMAINS = """com org net edu gov mil int info biz name pro aero coop museum jobs mobi travel tel cat asia post app dev cloud
online site tech store shop blog xyz page wiki news agency email group work world life live media studio design digital
network systems solutions services company academy university bank law health example""".split()
#: Address blocks with a name of their own (private, loopback, link, shared, documentation), and those nobody has.
BLOCKS = r"^(?:10\.|127\.|169\.254\.|172\.(?:1[6-9]|2[0-9]|3[01])\.|192\.168\.|192\.0\.2\.|198\.51\.100\.|203\.0\.113\.|100\.(?:6[4-9]|[7-9][0-9]|1[01][0-9]|12[0-7])\.)"
NO_BLOCK = r"^(?:0|2[4-9][0-9])\."
#: First digits of the issuers of payment cards, and of nobody.
ISSUERS = r"^(?:4|5[0-9]|222[1-9]|22[3-9]|2[3-6]|27[01]|2720|3[47]|30[0-5]|3[689]|35(?:2[89]|[3-8])|6011|64[4-9]|6[0-357-9]|81)"
NO_ISSUER = "^[019]"
#: Calling codes of countries; area and exchange of the North American plan.
CODES = r"^\+\D{0,2}(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|2[1-69][0-9]|3[578][0-9]|42[013]|50[0-9]|59[0-9]|6[78][0-9]|69[0-2]|8[058][0-9]|87[08]|9[679][0-9])"
AREAS = r"^\(?[2-9][0-9]{2}\D{1,2}[2-9][0-9]{2}"

CONTEXT = {
    "email": r"(?i)\b(?:e-?mail|mail|contact|write|correo|courriel)\b\W{0,3}\w{0,4}\W{0,3}$",
    "ip": r"(?i)\b(?:ip|host|server|address|adresse|client)\b\W{0,3}\w{0,4}\W{0,3}$",
    "card": r"(?i)\b(?:card|visa|credit|karte|carte|tarjeta|payment)\b\W{0,3}\w{0,4}\W{0,3}$",
    "phone": r"(?i)\b(?:tel|phone|call|fax|mobile|telefon|t[ée]l[ée]phone|tel[ée]fono)\b\W{0,3}\w{0,4}\W{0,3}$",
}
#: Characters before a span that the context labeler reads.
BEFORE = 30


LABELERS = ("strict", "test", "gazetteer", "context", "border", "variety")
SHAPE = ("size", "separator", "left", "right")
_SPAN = "struct<kind:string,start:int,end:int,base:boolean,test:boolean,pattern:string>"
#: Matches that are added up one by one; beyond that, sums of whole blocks are used.
BLOCK = 64

# Expressions are SQL text over the column `text` and, inside the lambdas, a span `s` as in `matches`: one parse each.


def _r(pattern: str) -> str:
    """A pattern as a raw SQL literal."""
    return f"r'{pattern}'"


def _digits(value: str) -> str:
    return f"regexp_replace({value}, '[^0-9]', '')"


def _luhn(value: str) -> str:
    """Whether ten divides the sum of the digits of value by Luhn's rule."""
    weighed = f"transform(split(reverse({_digits(value)}), ''), (c, k) -> IF(k % 2 = 0, ascii(c) - 48, (ascii(c) - 48) * 2 - IF(ascii(c) > 52, 9, 0)))"
    return f"aggregate({weighed}, 0, (x, d) -> x + d) % 10 = 0"


def passes(kind: str, value: str) -> str:
    """The test of a kind's matches."""
    if kind == "email":
        return "true"
    if kind == "ip":
        part = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"
        return f"regexp_replace({value}, {_r(chr(92) + '[' + chr(92) + '.' + chr(92) + ']')}, '.') RLIKE {_r(f'^{part}(?:[.]{part}){{3}}$')}"
    n = f"char_length({_digits(value)})"
    if kind == "card":
        return f"CASE WHEN {n} BETWEEN 16 AND 19 THEN {_luhn(value)} ELSE false END"
    return f"{n} BETWEEN 8 AND 15"


def gazetteer(kind: str, strict: bool, value: str) -> tuple[str, str]:
    """What the gazetteer of a kind votes for and against."""
    if kind == "email":
        last = f"lower(regexp_extract({value}, '([A-Za-z0-9-]+)$', 1))"
        known = ", ".join(f"'{d}'" for d in DOMAINS)
        return f"{last} RLIKE '^[a-z]{{2}}$' OR {last} IN ({known})", f"{last} RLIKE '^[0-9-]'"
    if kind == "ip":
        return f"{value} RLIKE {_r(BLOCKS)}", f"{value} RLIKE {_r(NO_BLOCK)}"
    if kind == "card":
        return f"{_digits(value)} RLIKE {_r(ISSUERS)}", f"{_digits(value)} RLIKE {_r(NO_ISSUER)}"
    known = f"{value} RLIKE {_r(CODES if strict else AREAS)}"
    return known, f"NOT {known}"


def matches(pattern: str) -> str:
    """Array of (start, value, before, after) of the leftmost matches that do not overlap; start counts code points.

    before and after are at most BEFORE characters and one character of what lies between the matches, or the nearest
    character of the next match where nothing does; so no part of a long text is looked up by its place."""
    p = _r(pattern)
    add = lambda a: f"aggregate({a}, 0, (x, y) -> x + y)"
    let = lambda value, name, body: f"element_at(transform(array({value}), {name} -> {body}), 1)"
    block = f"CAST(floor(k / {BLOCK}) AS INT)"
    pairs = f"zip_with(regexp_extract_all(text, {p}, 0), split(text, {p}, -1), (v, b) -> named_struct('before', char_length(b), 'value', v, 'text', b))"
    sums = f"transform(sequence(0, CAST(floor((size(w) - 1) / {BLOCK}) AS INT)), b -> {add(f'slice(w, b * {BLOCK} + 1, {BLOCK})')})"
    starts = f"aggregate({sums}, named_struct('at', 0, 'starts', CAST(array() AS ARRAY<INT>)), (z, x) -> named_struct('at', z.at + x, 'starts', concat(z.starts, array(z.at))), z -> z.starts)"
    inside = add(f"slice(w, {block} * {BLOCK} + 1, k % {BLOCK})")
    before = f"IF(x.before = 0, coalesce(right(get(p, k - 1).value, 1), ''), right(x.text, {BEFORE}))"
    after = "CASE WHEN get(p, k + 1).before > 0 THEN left(get(p, k + 1).text, 1) ELSE coalesce(left(get(p, k + 1).value, 1), '') END"
    placed = f"transform(p, (x, k) -> named_struct('start', get(q, {block}) + {inside} + x.before, 'value', x.value, 'before', {before}, 'after', {after}))"
    widths = "transform(p, x -> x.before + coalesce(char_length(x.value), 0))"
    # split gives one part more than there are matches
    return f"filter({let(pairs, 'p', let(widths, 'w', let(starts, 'q', placed)))}, x -> x.value IS NOT NULL)"


def _described(kind: str, strict: bool) -> str:
    """The span s with its votes, one character for each labeler, and its shape, one for each part."""
    value, start = "s.value", "s.start"
    end = f"({start} + char_length({value}))"
    before, after = "s.before", "s.after"
    test = passes(kind, value)
    vote = lambda yes, no="false": f"CASE WHEN {yes} THEN '1' WHEN {no} THEN '0' ELSE '?' END"
    border = f"NOT {before} RLIKE '[A-Za-z0-9]$' AND NOT {after} RLIKE '[A-Za-z0-9]'"
    varied = f"size(array_distinct(split(lower({value}), ''))) >= 4"
    votes = [f"'{1 if strict else '?'}'", vote(test, "true"), vote(*gazetteer(kind, strict, value)), vote(f"{before} RLIKE {_r(CONTEXT[kind])}"), vote(border, "true"), vote(varied, "true")]
    size = f"CASE WHEN char_length({value}) < 12 THEN 's' WHEN char_length({value}) < 24 THEN 'm' ELSE 'l' END"
    marks = f"regexp_replace({value}, '[A-Za-z0-9+@]', '')"
    separator = f"CASE WHEN {marks} = '' THEN 'n' WHEN {marks} RLIKE '^ +$' THEN 's' WHEN {marks} RLIKE '^-+$' THEN 'h' WHEN {marks} RLIKE '^[.]+$' THEN 'd' ELSE 'x' END"
    beside = lambda c: f"CASE WHEN {c} = '' OR {c} RLIKE '^[ \\n\\t]$' THEN 'b' WHEN {c} RLIKE '[A-Za-z0-9]' THEN 'a' WHEN {c} RLIKE '[\"(<:=,;]' THEN 'p' ELSE 'o' END"
    left = beside("right(s.before, 1)")
    pattern = ", ".join([*votes, size, separator, left, beside(after)])
    return f"named_struct('kind', '{kind}', 'start', {start}, 'end', {end}, 'base', {'true' if strict else 'false'} AND ({test}), 'test', ({test}), 'pattern', concat({pattern}))"


def found(docs: DataFrame) -> DataFrame:
    """doc_id, found: all matches of the fixed and the loose patterns, by kind as in KINDS, fixed ones first."""
    per_kind = []
    for kind in KINDS:
        need = "text RLIKE '[0-9]'" if kind != "email" else "true"
        if NEEDED[kind]:
            need += f" AND contains(text, '{NEEDED[kind]}')"
        for strict, pattern, tried in ((True, BASE[kind], need), (False, LOOSE[kind], f"text RLIKE {_r(LOOSE[kind])}")):
            per_kind.append(f"CASE WHEN {tried} THEN transform({matches(pattern)}, s -> {_described(kind, strict)}) ELSE CAST(array() AS ARRAY<{_SPAN}>) END")
    return texts(docs).select("doc_id", F.expr(f"concat({', '.join(per_kind)})").alias("found"))


# ---- the label model and the classifier, on the table of counts


def label_model(counts: dict[str, float], rounds: int = 40) -> dict[str, float]:
    """The posterior of each vote pattern of one kind, by expectation-maximisation over pattern counts.

    Each labeler votes 1, 0 or ? with probabilities of its own for true and false spans; votes are independent given
    the truth.  The start is the share of votes in favour."""
    share = {p: (p.count("1") + 0.5) / (p.count("1") + p.count("0") + 1) for p in counts}
    for _ in range(rounds):
        odds: list[dict[str, float]] = []
        weight = [sum(n * share[p] for p, n in counts.items()), sum(n * (1 - share[p]) for p, n in counts.items())]
        for k in range(len(LABELERS)):
            by = {}
            for v in "10?":
                true = sum(n * share[p] for p, n in counts.items() if p[k] == v)
                false = sum(n * (1 - share[p]) for p, n in counts.items() if p[k] == v)
                by[v] = math.log((true + 1) / (weight[0] + 3)) - math.log((false + 1) / (weight[1] + 3))
            odds.append(by)
        prior = math.log((weight[0] + 1) / (weight[1] + 1))
        share = {p: 1 / (1 + math.exp(-max(-30, min(30, prior + sum(o[v] for o, v in zip(odds, p)))))) for p in counts}
    return share


def _features(kind: str, pattern: str) -> list[str]:
    return [kind, *(f"{name}={v}" for name, v in zip((*LABELERS, *SHAPE), pattern)), *(f"{kind}:{name}={v}" for name, v in zip(SHAPE, pattern[len(LABELERS) :]))]


def span_classifier(counts: dict[tuple[str, str], float], target: dict[tuple[str, str], float], rounds: int = 400) -> dict[tuple[str, str], float]:
    """The score of each (kind, pattern): logistic regression on its features, by gradient descent on the posteriors."""
    keys = list(counts)
    number = {f: k for k, f in enumerate(sorted({f for key in keys for f in _features(*key)}))}
    at = np.array([[number[f] for f in _features(*key)] for key in keys])
    share = np.array([counts[key] for key in keys]) / sum(counts.values())
    wanted, weight = np.array([target[key] for key in keys]), np.zeros(len(number))
    score = lambda: 1 / (1 + np.exp(-np.clip(weight[at].sum(axis=1), -30, 30)))
    for _ in range(rounds):
        error = (wanted - score()) * share
        step = np.bincount(at.ravel(), np.repeat(error, at.shape[1]), len(number))
        weight += 2.0 * (step - 1e-4 * weight)
    return dict(zip(keys, score().tolist()))


def learn(spans: DataFrame) -> dict[tuple[str, str], float]:
    """Scores by (kind, pattern) from all candidates of spans (doc_id, found)."""
    rows = spans.select(F.explode("found").alias("s")).groupBy("s.kind", "s.pattern").agg(F.count(F.lit(1)).alias("n")).collect()
    counts = {(r["kind"], r["pattern"]): float(r["n"]) for r in sorted(rows, key=lambda r: (r["kind"], r["pattern"]))}
    target = {}
    for kind in KINDS:
        votes: dict[str, float] = {}
        for (k, p), n in counts.items():
            if k == kind:
                votes[p[: len(LABELERS)]] = votes.get(p[: len(LABELERS)], 0.0) + n
        share = label_model(votes)
        target |= {key: share[key[1][: len(LABELERS)]] for key in counts if key[0] == kind}
    return span_classifier(counts, target) if counts else {}


def pii_spans(docs: DataFrame, threshold: float = 0.9) -> DataFrame:
    """doc_id, base and spans: arrays of (kind, start, end) by kind as in KINDS and start; spans holds base."""
    held = Written(found(docs), "found").df
    scores = F.from_json(F.lit(json.dumps({f"{k}|{p}": x for (k, p), x in learn(held).items() if p[0] == "?"})), "map<string,double>")
    score = lambda s: F.coalesce(F.try_element_at(scores, F.concat_ws("|", s["kind"], s["pattern"])), F.lit(0.0))
    plain = lambda a: F.transform(a, lambda s: F.struct(s["kind"], s["start"], s["end"]))
    base = F.filter("found", lambda s: s["base"])
    chosen = lambda of: F.filter("found", lambda s: s["base"] | (s["pattern"].startswith("?") & s["test"] & (score(s) >= threshold) & ~F.exists(of, lambda b: _meets(b, s))))
    more = F.element_at(F.transform(F.array(F.array(*[_of_kind(base, kind) for kind in KINDS])), chosen), 1)
    by_kind = [F.array_sort(plain(_of_kind(more, kind))) for kind in KINDS]
    return held.select("doc_id", plain(base).alias("base"), F.concat(*by_kind).alias("spans"))


def _meets(spans: Column, s: Column) -> Column:
    """Whether s overlaps one of spans, which are sorted and do not overlap each other: by halving, so that a text with very
    many spans takes no quadratic time."""
    n = F.size(spans)

    def half(a: Column, _: Column) -> Column:
        middle = F.floor((a["lo"] + a["hi"]) / 2).cast("int")
        right = F.get(spans, middle)["start"] < s["end"]
        return F.when(a["lo"] >= a["hi"], a).when(right, F.struct((middle + 1).alias("lo"), a["hi"].alias("hi"))).otherwise(F.struct(a["lo"].alias("lo"), middle.alias("hi")))

    halvings = F.sequence(F.lit(0), F.ceil(F.log2(n + F.lit(1.0))).cast("int"))
    before = F.aggregate(halvings, F.struct(F.lit(0).alias("lo"), n.alias("hi")), half)["lo"]  # spans that begin before s ends
    return (n > 0) & (before > 0) & (F.get(spans, before - 1)["end"] > s["start"])


def _of_kind(spans: Column, kind: str) -> Column:
    return F.filter(spans, lambda s: s["kind"] == kind)


def span_digests(spans: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans from pii_spans."""
    joined = lambda a: F.concat_ws(",", F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))
    counts = [F.size(_of_kind(F.col("base"), kind)).cast("long").alias(f"n_{kind}") for kind in KINDS]
    return spans.select("doc_id", *counts, F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
