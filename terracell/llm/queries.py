"""The corpus queries and, where SQL can express them, their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import conversations, mixing, pii, spelling
from .common import documents, table
from .exact_dedup import exact_dedup
from .media import media_digests
from .minhash import near_duplicates
from .packing import pack_documents
from .quality import quality_scores
from .secret_scan import secret_spans, span_digests
from .substring_dedup import substring_dedup
from .token_files import token_file_digests
from .tokens import vocabulary
from .toxicity import toxicity_digests


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.span_digests(pii.pii_spans(documents(spark, sf_dir)))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(documents(spark, sf_dir))


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))


def op4_media_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_digests(documents(spark, sf_dir))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_file_digests(documents(spark, sf_dir), vocabulary("word_bpe_49k.json"), end=2)


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir), vocabulary("byte_bpe_50k.json"), end=0)


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return span_digests(secret_spans(documents(spark, sf_dir)))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir))


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(documents(spark, sf_dir))


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_digests(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair_digests(conversations.damaged(table(spark, sf_dir, "conversations")))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(documents(spark, sf_dir))


OP9_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""


#: Windows of 50 words by their text; words between blanks as in the operator, removed where a window starts earlier.
OP2_SQL = """
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS words FROM documents),
     windows AS (SELECT doc_id, i, array_to_string(words[i:i + 49], ' ') AS w FROM d, unnest(range(1, len(words) - 48)) AS r(i)),
     firsts AS (SELECT w, min(doc_id) AS source FROM windows GROUP BY w HAVING count(*) > 1),
     covered AS (SELECT DISTINCT v.doc_id, v.i + k AS p FROM windows v JOIN firsts f ON v.w = f.w AND f.source < v.doc_id, range(0, 50) AS t(k)),
     word AS (SELECT d.doc_id, p, words[p] AS w FROM d, unnest(range(1, len(words) + 1)) AS r(p)),
     kept AS (SELECT w.doc_id, string_agg(w.w, ' ' ORDER BY w.p) AS body, count(*) AS n FROM word w ANTI JOIN covered c ON w.doc_id = c.doc_id AND w.p = c.p GROUP BY w.doc_id)
SELECT d.doc_id, len(d.words)::BIGINT AS n_words, (len(d.words) - coalesce(k.n, 0))::BIGINT AS n_removed, sha256(coalesce(k.body, '')) AS kept_sha256
FROM d LEFT JOIN kept k ON d.doc_id = k.doc_id
"""


def pii_base_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op1_pii that the fixed patterns decide; SQL can express these."""
    return op1_pii(spark, sf_dir).drop("spans")


def secret_base_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op7_secret_scan that the fixed patterns decide; SQL can express these."""
    return op7_secret_scan(spark, sf_dir).drop("spans")


def _spans_sql(kinds: dict[str, tuple[str, str]], order: str) -> str:
    """Base spans by kind: (pattern, test of the match m).  Places come from the lengths of the parts between matches."""
    parts = []
    for k, (kind, (pattern, test)) in enumerate(kinds.items()):
        p = "'" + pattern.replace("'", "''") + "'"
        parts.append(f"""
SELECT doc_id, {k} AS k, '{kind}' AS kind, ms[i] AS m, list_sum(list_transform(bs[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0) AS start
FROM (SELECT doc_id, regexp_extract_all(t, {p}) AS ms, string_split_regex(t, {p}) AS bs FROM d), unnest(range(1, len(ms) + 1)) AS r(i) WHERE {test.format(m='ms[i]', p=p)}""")
    counts = ", ".join(f"count(*) FILTER (WHERE kind = '{kind}') AS n_{kind}" for kind in kinds)
    text = "kind || ':' || start::BIGINT || ':' || (start + length(m))::BIGINT"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
     s AS ({" UNION ALL ".join(parts)}),
     g AS (SELECT doc_id, {counts}, string_agg({text}, ',' ORDER BY {order}) AS spans FROM s GROUP BY doc_id)
SELECT d.doc_id, {", ".join(f"coalesce(n_{kind}, 0)::BIGINT AS n_{kind}" for kind in kinds)}, sha256(coalesce(spans, '')) AS base_sha256
FROM d LEFT JOIN g ON d.doc_id = g.doc_id
"""


_DIGITS = "regexp_replace({m}, '[^0-9]', '', 'g')"
_LUHN = f"list_sum(list_transform(list_reverse(string_split({_DIGITS}, '')), lambda c, k: CASE WHEN k % 2 = 1 THEN c::INT WHEN c::INT > 4 THEN c::INT * 2 - 9 ELSE c::INT * 2 END)) % 10 = 0"
_PART = "0*(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"
PII_BASE_SQL = _spans_sql(
    {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true"),
        "ip": (r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", f"regexp_full_match({{m}}, '{_PART}([.]{_PART}){{{{3}}}}')"),
        "card": (r"[0-9](?:[ -]?[0-9])+", f"CASE WHEN length({_DIGITS}) BETWEEN 16 AND 19 THEN {_LUHN} ELSE false END"),
        "phone": (r"\+[0-9][ ().0-9-]+[0-9]", f"length({_DIGITS}) BETWEEN 8 AND 15"),
    },
    "k, start",
)
_NAMES = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in name) for name in ("password", "passwd", "secret", "token", "api_?key"))
SECRET_BASE_SQL = _spans_sql(
    {
        "assign": (rf"""(?:{_NAMES})["']? *[:=] *["']?[A-Za-z0-9+/_.=-]+""", f"""length(regexp_extract({{m}}, '^(?:{_NAMES})["'']? *[:=] *["'']?(.*)$', 1)) >= 12"""),
        "access": ("AKIA[A-Z0-9]+", "length({m}) >= 18"),
        "hex": ("[0-9a-f]+", "length({m}) >= 16"),
    },
    "start, k",
)


def queries() -> dict:
    own = {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}
    return own | {"pii_base_spans": pii_base_spans, "secret_base_spans": secret_base_spans}


def oracle_sql() -> dict[str, str]:
    return {
        "op2_substring_dedup": OP2_SQL,
        "op9_exact_dedup": OP9_SQL,
        "op10_mix_sources": mixing.ORACLE_SQL,
        "op12_conversation_repair": conversations.ORACLE_SQL,
        "op13_spelling_variants": spelling.ORACLE_SQL,
        "pii_base_spans": PII_BASE_SQL,
        "secret_base_spans": SECRET_BASE_SQL,
    }
