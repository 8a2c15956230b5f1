"""Conversation structure repair: the cheapest edits that make the roles alternate, by one trie of row signatures.

Rows of a conversation are taken by (turn, nulls first; role; hash of text).  Each row becomes one letter, its role and
first fault: blank, duplicate of an earlier row, truncated.  A conversation's letters, in segments of at most 256 rows, are
its signatures.  Sorted signatures are dealt out by range, equal ones by conversation, so that no signature is a hot
key; each task walks its signatures as a prefix trie and computes a layer of the dynamic program once for each shared
prefix.  A layer holds, for each state of the role pattern `(s?(ua)+)?`, the cheapest cost, the rank of its edits in ASCII
order among the states, and the way back; so layers have a fixed size, and the edits are read off at terminal nodes.
Segments after a conversation's first start from each of the four states, and are chained where rows and answers of a
conversation meet again: in one sorted stream, which hashes repaired rows one by one.

Why ranks suffice: before trailing insertions are added, all edit strings of a layer have one letter of a row (K, R, D)
for each row and end in one, so none is a proper prefix of another and their order is decided inside them.

Null roles and texts count as one space, a null conv_id as a conversation of its own.  Rows that are repeated in full are
duplicates.  An empty role has no initial and is never legal.  Conversations without rows give zeros and an empty audit;
an empty table gives an empty result; other columns are ignored.  The rows of one conversation stream through one task, as
their hash is one, but only its letters are held there.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a signature.
SEGMENT = 256
#: States of the role pattern: nothing yet, after the system row, after a user row, after an assistant row.
EMPTY, SYSTEM, USER, ASSISTANT = range(4)
#: Edits that end a conversation in each state: insertions that are still needed.
_FINISH = {EMPTY: 0, SYSTEM: 2, USER: 1, ASSISTANT: 0}
_BLANK = "^[\\x20\\x09-\\x0D]*$"


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, dropped: rows after a fixed damage, by crc32 of `conv_id:turn` modulo 20.  Dropped rows
    stay, marked and without text, so that every conversation is known."""
    space = lambda x: F.coalesce(F.col(x).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat_ws(":", space("conv_id"), space("turn")).cast("binary")) % 20
    text = F.when(kind <= 1, F.lit("")).when(kind == 2, F.regexp_replace(space("text"), "[.!?]", "")).otherwise(space("text"))
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.when(kind == 4, F.lit("user")).otherwise(space("role")).alias("role"),
        text.alias("text"), (kind == 0).alias("dropped"), F.when(kind == 3, 2).otherwise(1).alias("copies"),
    )
    return rows.withColumn("copies", F.explode(F.sequence(F.lit(1), "copies"))).drop("copies")


def _rows(rows: DataFrame) -> DataFrame:
    space = lambda x: F.coalesce(F.col(x).cast("string"), F.lit(" ")).alias(x)
    dropped = F.col("dropped") if "dropped" in rows.columns else F.lit(False)
    out = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), space("role"), space("text"), dropped.alias("dropped"))
    return out.withColumn("hash", F.sha2("text", 256))


def _letter(initial: Column, must_go: Column, truncated: Column) -> Column:
    role = F.when(initial.isin("s", "u", "a"), initial).otherwise("x")
    return F.when(must_go, F.lit("d")).otherwise(F.when(truncated, F.upper(role)).otherwise(role))


def signatures(rows: DataFrame) -> DataFrame:
    """conv_id, segment, signature and the segment's counts; texts are read as flags and a hash, and not shuffled."""
    light = _rows(rows).filter(~F.col("dropped")).select(
        "conv_id", "turn", "role", "hash", F.substring("role", 1, 1).alias("initial"), F.col("text").rlike(_BLANK).alias("blank"), (~F.col("text").rlike("[.!?][\\x20\\x09-\\x0D]*$")).alias("open")
    )
    own = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "hash", "again")  # of equal rows the first is no copy
    same = Window.partitionBy("conv_id", "role", "hash").orderBy(F.col("turn").asc_nulls_first())
    marked = light.repartition("conv_id").withColumn("again", F.row_number().over(same) > 1)
    marked = marked.select("*", F.row_number().over(own).alias("place"), F.lag("initial").over(own).alias("before"), F.lag("turn").over(own).alias("turn_before"))
    duplicate, truncated = ~F.col("blank") & F.col("again"), ~F.col("blank") & ~F.col("again") & F.col("open")
    pair = F.concat("before", "initial")
    new_turn = F.col("turn").isNotNull() & ~F.col("turn").eqNullSafe(F.col("turn_before"))
    letters = F.sort_array(F.collect_list(F.struct("place", _letter(F.col("initial"), F.col("blank") | duplicate, truncated).alias("letter"))))  # at most 256
    segment = F.floor((F.col("place") - 1) / SEGMENT).cast("int")
    return marked.groupBy("conv_id", segment.alias("segment")).agg(
        F.concat(F.when(F.first(segment) == 0, "0").otherwise("1"), F.array_join(F.transform(letters, lambda x: x["letter"]), "")).alias("signature"),
        F.count_if("blank").alias("blank"), F.count_if(duplicate).alias("duplicate"), F.count_if(truncated).alias("truncated"), F.count_if(pair.isNotNull() & ~pair.isin("su", "ua", "au")).alias("illegal"),
        F.min("turn").alias("low"), F.max("turn").alias("high"), F.count_if(new_turn).alias("turns"),
    )


def _next(state: int) -> int:
    return ASSISTANT if state == USER else USER


def _steps(letter: str) -> list[list[tuple[int, int, str]]]:
    """For each state after a row of this letter: (state before, cost, edits)."""
    into: list[list[tuple[int, int, str]]] = [[(p, 3, "D")] for p in range(4)]
    if letter == "d":
        return into
    role, more = letter.lower(), int(letter.isupper())
    for p in range(4):
        at = p
        for inserted in range(2):
            cost, edits = 2 * inserted + more, "I" * inserted
            if role == "s" and at == EMPTY and not inserted:
                into[SYSTEM].append((p, cost, edits + "K"))
            target = _next(at)
            kept = role == ("a" if target == ASSISTANT else "u")
            into[target].append((p, cost + (0 if kept else 2), edits + ("K" if kept else "R")))
            at = target
    return into


_STEPS = {letter: _steps(letter) for letter in "suaxSUAXd"}

#: A layer: for each state its cost, the rank of its edits, and the way back (state before, edits of the row); None where
#: the state is not reached.
Layer = list[tuple[int, int, tuple[int, str] | None] | None]


def first_layer(state: int) -> Layer:
    return [(0, 0, None) if s == state else None for s in range(4)]


def next_layer(layer: Layer, letter: str) -> Layer:
    best = [min(((layer[p][0] + cost, layer[p][1], edits, p) for p, cost, edits in ways if layer[p]), default=None) for ways in _STEPS[letter]]
    order = {x: k for k, x in enumerate(sorted((b[1], b[2]) for b in best if b))}
    return [(b[0], order[b[1], b[2]], (b[3], b[2])) if b else None for b in best]


def edits_to(layers: list[Layer], state: int) -> str:
    out = []
    for layer in reversed(layers[1:]):
        state, edits = layer[state][2]
        out.append(edits)
    return "".join(reversed(out))


class Trie:
    """Sorted signatures in, answers out: for each start state (only EMPTY for first segments) and each state that it
    leads to, (start, state, cost, edits).  The path to the last signature is kept, with its layers."""

    def __init__(self) -> None:
        self.last, self.layers, self.answer, self.computed = "", [], [], 0

    def answers(self, signature: str) -> list[tuple[int, int, int, str]]:
        if signature == self.last:
            return self.answer
        shared = next((k for k, (a, b) in enumerate(zip(signature, self.last)) if a != b), min(len(signature), len(self.last)))
        if shared == 0:
            self.layers = [[first_layer(s)] for s in (range(4) if signature[0] == "1" else (EMPTY,))]
            shared = 1
        for path in self.layers:
            del path[shared:]
            for letter in signature[shared:]:
                path.append(next_layer(path[-1], letter))
                self.computed += 1
        starts = range(4) if signature[0] == "1" else (EMPTY,)
        self.answer = [(p, q, path[-1][q][0], edits_to(path, q)) for p, path in zip(starts, self.layers) for q in range(4) if path[-1][q]]
        self.last = signature
        return self.answer


def chained(segments: list[list[tuple[int, int, int, str]]]) -> tuple[int, str]:
    """Cost and edits of a conversation from the answers of its segments, in order."""
    layer, back = {EMPTY: (0, 0)}, []
    for answers in segments:
        best: dict[int, tuple] = {}
        for p, q, cost, edits in answers:
            if p in layer:
                way = layer[p][0] + cost, layer[p][1], edits, p
                best[q] = min(best.get(q, way), way)
        order = {x: k for k, x in enumerate(sorted((b[1], b[2]) for b in best.values()))}
        layer = {q: (b[0], order[b[1], b[2]]) for q, b in best.items()}
        back.append({q: (b[3], b[2]) for q, b in best.items()})
    cost, _, state = min((cost + 2 * _FINISH[q], rank, q) for q, (cost, rank) in layer.items())
    out = ["I" * _FINISH[state]]
    for ways in reversed(back):
        state, edits = ways[state]
        out.append(edits)
    return cost, "".join(reversed(out))


_ANSWERS = "array<struct<p: int, q: int, cost: int, edits: string>>"
_COUNTS = ["blank", "duplicate", "truncated", "illegal", "low", "high", "turns"]


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    trie, kind = Trie(), pa.list_(pa.struct([("p", pa.int32()), ("q", pa.int32()), ("cost", pa.int32()), ("edits", pa.string())]))
    for b in batches:
        found = [[dict(zip(("p", "q", "cost", "edits"), x)) for x in trie.answers(s)] for s in b.column("signature").to_pylist()]
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("conv_id", "segment", *_COUNTS)), pa.array(found, kind)], ["conv_id", "segment", *_COUNTS, "answers"])


def answered(signed: DataFrame) -> DataFrame:
    """signatures() with the answers of the trie."""
    dealt = signed.repartitionByRange("signature", F.xxhash64("conv_id")).sortWithinPartitions("signature")
    return dealt.select("conv_id", "segment", "signature", *_COUNTS).mapInArrow(_walk, f"conv_id long, segment int, {', '.join(f'{c} long' for c in _COUNTS)}, answers {_ANSWERS}")


def _stream(rows: DataFrame) -> DataFrame:
    """Answers and rows of each conversation next to each other: first its segments, then its rows, in order."""
    nulls = lambda names, kinds: [F.lit(None).cast(k).alias(n) for n, k in zip(names, kinds)]
    own = ["turn", "role", "text", "dropped", "hash"]
    head = answered(signatures(rows)).select("conv_id", "segment", *_COUNTS, "answers", *nulls(own, ["long", "string", "string", "boolean", "string"]))
    body = _rows(rows).select("conv_id", *nulls(["segment", *_COUNTS, "answers"], ["int", *["long"] * len(_COUNTS), _ANSWERS]), *own)
    return head.unionByName(body).repartition("conv_id").sortWithinPartitions("conv_id", F.col("segment").asc_nulls_last(), F.col("turn").asc_nulls_first(), "role", "hash").drop("hash")


class _Conversation:
    """One conversation of the stream: its answers, then its rows, against the edits."""

    def __init__(self, conv_id: int | None):
        self.conv_id, self.segments, self.counts, self.audit, self.at, self.cost = conv_id, [], [], None, 0, 0
        self.user = False  # whether the last repaired row is a user's

    def head(self, row: dict) -> None:
        self.segments.append([(x["p"], x["q"], x["cost"], x["edits"]) for x in row["answers"]])
        self.counts.append([row[c] for c in _COUNTS])

    def begin(self) -> None:
        if self.audit is None:
            self.cost, self.audit = chained(self.segments) if self.segments else (0, "")
            self.segments = []

    def _alternate(self) -> str:
        self.user = not self.user
        return "user" if self.user else "assistant"

    def inserted(self) -> Iterator[tuple[str, str]]:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.at += 1
            yield self._alternate(), ""

    def row(self, role: str, text: str) -> Iterator[tuple[str, str]]:
        """The repaired rows up to this one."""
        self.begin()
        yield from self.inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "R":
            yield self._alternate(), text
        elif edit == "K":
            if role[0] != "s":
                self._alternate()
            yield role, text

    def totals(self) -> dict:
        c = dict(zip(_COUNTS, zip(*self.counts))) if self.counts else {}
        low, high = ([x for x in c.get(k, ()) if x is not None] for k in ("low", "high"))
        sums = {k: sum(c.get(k, ())) for k in ("blank", "duplicate", "truncated", "illegal")}
        return {"conv_id": self.conv_id, "gaps": max(high) - min(low) + 1 - sum(c["turns"]) if low else 0, **sums, "cost": self.cost, "audit": self.audit}


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[_Conversation, tuple[str, str] | None]]:
    """(conversation, repaired row) in order, with None for the row at a conversation's end."""
    now = None
    for b in batches:
        for row in b.to_pylist():
            if now is None or now.conv_id != row["conv_id"]:
                if now:
                    yield from _end(now)
                now = _Conversation(row["conv_id"])
            if row["segment"] is not None:
                now.head(row)
            elif not row["dropped"]:
                yield from ((now, x) for x in now.row(row["role"], row["text"]))
    if now:
        yield from _end(now)


def _end(c: _Conversation) -> Iterator[tuple[_Conversation, tuple[str, str] | None]]:
    c.begin()
    yield from ((c, x) for x in c.inserted())
    yield c, None


def _in_batches(rows: Iterator[dict], schema: pa.Schema, most: int = 2000) -> Iterator[pa.RecordBatch]:
    held = []
    for r in rows:
        held.append(r)
        if len(held) >= most:
            yield pa.RecordBatch.from_pylist(held, schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


_DIGEST = pa.schema([("conv_id", pa.int64()), *((k, pa.int64()) for k in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), ("audit", pa.string()), ("repaired_sha256", pa.string())])
_REPAIRED = pa.schema([("conv_id", pa.int64()), ("place", pa.int64()), ("role", pa.string()), ("text", pa.string())])


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows():
        state, n = hashlib.sha256(), 0
        for c, row in _conversations(batches):
            if row is None:
                yield c.totals() | {"repaired_sha256": state.hexdigest()}
                state, n = hashlib.sha256(), 0
            else:
                state.update(f"{chr(10) if n else ''}{row[0]}:{row[1]}".encode())
                n += 1

    return _in_batches(rows(), _DIGEST)


def _written_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows():
        n = 0
        for c, row in _conversations(batches):
            if row is None:
                n = 0
            else:
                yield {"conv_id": c.conv_id, "place": n, "role": row[0], "text": row[1]}
                n += 1

    return _in_batches(rows(), _REPAIRED)


def repaired(rows: DataFrame) -> DataFrame:
    """conv_id, place, role, text: the repaired conversations of rows (conv_id, turn, role, text)."""
    return _stream(rows).mapInArrow(_written_out, "conv_id long, place long, role string, text string")


def repair_digests(rows: DataFrame) -> DataFrame:
    """One row for each conversation: faults, cost, edits and the hash of its repaired rows."""
    return _stream(rows).mapInArrow(_digest, "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string")


# ---- the same by recursion over rows in SQL

_CRC_TABLE = "(SELECT list(c ORDER BY i) FROM (SELECT i, list_reduce([i::BIGINT] || range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) AS t(i)))"


def crc32_sql(hex_text: str, table: str) -> str:
    """CRC-32 of bytes given as a hexadecimal string; table: a list of the 256 remainders."""
    return f"xor(list_reduce([4294967295::BIGINT] || list_transform(range(1, length({hex_text}) // 2 + 1), lambda i: ('0x' || substr({hex_text}, 2 * i - 1, 2))::BIGINT), lambda c, b: xor(c >> 8, {table}[(xor(c, b) & 255) + 1])), 4294967295)"


def _oracle() -> str:
    far = "{'c': 1000000000::BIGINT, 'a': 'Z', 'r': []::VARCHAR[]}"
    names = ("e", "s", "u", "a")

    def add(state: str, cost: str, edits: str, *rows: str) -> str:
        new = f"list_concat({state}.r, [{', '.join(rows)}])" if rows else f"{state}.r"
        return f"{{'c': {state}.c + {cost}, 'a': {state}.a || '{edits}', 'r': {new}}}"

    user, assistant, own = "'user:'", "'assistant:'", "role || ':' || text"

    def arrive(target: str) -> str:
        """The ways into a user or an assistant row that stays."""
        initial, head, between = ("u", user, assistant) if target == "u" else ("a", assistant, user)
        ways = []
        for state in names:
            straight = (state == "u") == (target == "a")
            edits, rows, cost = ("", [], 0) if straight else ("I", [between], 2)
            kept = add(f"q.{state}", f"{cost} + t", edits + "K", *rows, own)
            changed = add(f"q.{state}", f"{cost} + 2 + t", edits + "R", *rows, f"{head} || text")
            ways.append(f"CASE WHEN must THEN {far} WHEN i = '{initial}' THEN {kept} ELSE {changed} END")
        return f"list_min([{add(f'q.{target}', '3', 'D')}, {', '.join(ways)}])"

    system = f"CASE WHEN NOT must AND i = 's' THEN {add('q.e', 't', 'K', own)} ELSE {far} END"
    ends = [add("e", "0", ""), add("s", "4", "II", user, assistant), add("u", "2", "I", assistant), add("a", "0", "")]
    key = "hex(encode(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')))"
    return f"""
WITH RECURSIVE crc AS (SELECT {_CRC_TABLE} AS t),
k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc32_sql(key, 't')} % 20 AS k FROM conversations, crc),
d AS (SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role, CASE WHEN k = 1 THEN '' WHEN k = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
      FROM k, unnest(range(CASE WHEN k = 3 THEN 2 ELSE 1 END)) AS c(n) WHERE k <> 0),
e AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST) > 1 AS dup, regexp_full_match(text, '[\\x20\\x09-\\x0D]*') AS blank FROM d),
f AS (SELECT *, row_number() OVER w AS p, lag(substr(role, 1, 1)) OVER w || substr(role, 1, 1) AS pair FROM e WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), dup)),
g AS (SELECT *, substr(role, 1, 1) AS i, blank OR dup AS must, CASE WHEN regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') THEN 0 ELSE 1 END AS t FROM f),
q AS (SELECT conv_id, 0::BIGINT AS p, {{'c': 0::BIGINT, 'a': '', 'r': []::VARCHAR[]}} AS e, {far} AS s, {far} AS u, {far} AS a FROM (SELECT DISTINCT conv_id FROM conversations)
  UNION ALL SELECT q.conv_id, g.p, {add('q.e', '3', 'D')}, list_min([{add('q.s', '3', 'D')}, {system}]), {arrive('u')}, {arrive('a')}
  FROM q JOIN g ON q.conv_id IS NOT DISTINCT FROM g.conv_id AND g.p = q.p + 1),
z AS (SELECT conv_id, arg_max(list_min([{', '.join(ends)}]), p) AS z FROM q GROUP BY conv_id),
n AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE blank) AS blank, count(*) FILTER (WHERE dup AND NOT blank) AS duplicate,
      count(*) FILTER (WHERE t = 1 AND NOT must) AS truncated, count(*) FILTER (WHERE pair NOT IN ('su', 'ua', 'au')) AS illegal FROM g GROUP BY conv_id)
SELECT z.conv_id, {', '.join(f'coalesce({c}, 0)::BIGINT AS {c}' for c in ('gaps', 'blank', 'duplicate', 'truncated', 'illegal'))}, z.c AS cost, z.a AS audit, sha256(array_to_string(z.r, chr(10))) AS repaired_sha256
FROM z LEFT JOIN n ON z.conv_id IS NOT DISTINCT FROM n.conv_id
"""


ORACLE_SQL = _oracle()
