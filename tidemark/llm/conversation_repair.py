"""Repair of the structure of conversations (operator 13).

A conversation is right if its roles' initials read ``(s?(ua)+)?``. Rows are kept (K, free), given the role user or
assistant (R, 2) or deleted (D, 3; a must for blank and duplicate rows), and user or assistant rows without text are
inserted (I, 2); a truncated row that stays adds 1. The cheapest edits are a shortest path over (row, state of the
grammar), whose arcs cost small whole numbers: Dial's buckets settle the distances to the end, and a walk along tight arcs
that takes the least letter at each step reads off the edits, the audit. In a state a letter leads to one state only, so the
audit tells the repaired rows.

Conversations are cut into segments of ``span`` turns. A segment's paths are found for each pair of states before and
behind it; joining them from the first segment to the last gives those of the conversation. A segment's letters end with
that of its last row, insertions standing before their row, so that of two strings of equal cost none begins with the other
and the least of a whole is made of the least of its parts. Rows reach Python sorted and one batch at a time, never as the
group of a conversation: a segment holds a byte a row, a conversation its audit, which is a string of the result anyway,
and texts are hashed as they pass by.

Null conv_id, turn, role and text: a conversation of its own; first in order; one space; one space. Rows of one turn stand
by role and text. Repeated rows are rows, so the second is a duplicate. A role's initial is its first character; roles with
other initials than s, u and a are never kept. Columns beside these four are ignored. An empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby, islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from tidemark.llm.shared import written

BLANK = r"[^\x20\x09-\x0D]"
#: States: nothing yet; behind s; behind u; behind a. The ends of right conversations are 0 and 3.
START, AFTER_S, AFTER_U, AFTER_A = range(4)
#: The role that a state asks for, and where it leads: what rerole and insert make.
MADE = {START: ("user", AFTER_U), AFTER_S: ("user", AFTER_U), AFTER_U: ("assistant", AFTER_A), AFTER_A: ("user", AFTER_U)}
KEEPS = {(START, "s"): AFTER_S, (START, "u"): AFTER_U, (AFTER_S, "u"): AFTER_U, (AFTER_U, "a"): AFTER_A, (AFTER_A, "u"): AFTER_U}
FAR = 1 << 60
#: A row as a small number: its initial (3: any other), 4 if it has to go, 8 if it is truncated.
INITIALS = "sua"


def arcs(code: int) -> list[list[tuple[str, int, int, int]]]:
    """For each state the arcs of a row, by letter: (letter, cost, state it leads to, rows used up)."""
    out = []
    for state in range(4):
        own = [("D", 3, state, 1), ("I", 2, MADE[state][1], 0)]
        if not code & 4:
            cut = 1 if code & 8 else 0
            kept = KEEPS.get((state, INITIALS[code & 3])) if code & 3 < 3 else None
            own += [("R", 2 + cut, MADE[state][1], 1)] + ([("K", cut, kept, 1)] if kept is not None else [])
        out.append(sorted(own))
    return out


ARCS = [arcs(code) for code in range(16)]
#: Arcs into each state, for walking from the end: (state before, cost, rows used up).
BACK = [[[(q, cost, used) for q in range(4) for _, cost, to, used in a[q] if to == state] for state in range(4)] for a in ARCS]


def dial(codes: bytes, behind: int) -> list[int]:
    """Distances from each node 4 * row + state to the state ``behind`` the last row. Arcs cost 3 at most, so four buckets
    in a ring hold all nodes that are open."""
    n = len(codes)
    distance = [FAR] * (4 * n + 4)
    distance[4 * n + behind] = 0
    ring: list[list[int]] = [[4 * n + behind], [], [], []]
    now = idle = 0
    while idle < 4:
        bucket = ring[now & 3]
        idle = 0 if bucket else idle + 1
        while bucket:  # arcs without cost put nodes into the very bucket that is read
            node = bucket.pop()
            if distance[node] != now:
                continue
            row, state = node >> 2, node & 3
            into = [(4 * row + q, c) for q, c, used in BACK[codes[row]][state] if not used] if row < n else []
            into += [(4 * row - 4 + q, c) for q, c, used in BACK[codes[row - 1]][state] if used] if row else []
            for before, cost in into:
                if now + cost < distance[before]:
                    distance[before] = now + cost
                    ring[(now + cost) & 3].append(before)
        now += 1
    return distance


def walk(codes: bytes, distance: list[int], state: int) -> str | None:
    """The least letters among the cheapest from ``state`` before the first row; None if there are none."""
    if distance[state] >= FAR:
        return None
    row, out = 0, []
    while row < len(codes):
        left = distance[4 * row + state]
        for letter, cost, to, used in ARCS[codes[row]][state]:
            if cost + distance[4 * (row + used) + to] == left:
                out.append(letter)
                state, row = to, row + used
                break
    return "".join(out)


def paths(codes: bytes) -> list[tuple[int, int, int, str]]:
    """(state before, state behind, cost, letters) of the cheapest ways through a segment."""
    out = []
    for behind in range(4):
        distance = dial(codes, behind)
        out += [(before, behind, distance[before], letters) for before in range(4) if (letters := walk(codes, distance, before)) is not None]
    return out


@lru_cache(1 << 14)
def short_paths(codes: bytes) -> list[tuple[int, int, int, str]]:
    """The same; short segments are much alike."""
    return paths(codes)


def joined(ways: dict[int, tuple[int, str]], more: list[tuple[int, int, int, str]]) -> dict[int, tuple[int, str]]:
    """Ways from the beginning by the state they lead to, carried on through one more segment."""
    out: dict[int, tuple[int, str]] = {}
    for before, behind, cost, letters in more:
        if before in ways:
            way = (ways[before][0] + cost, ways[before][1] + letters)
            out[behind] = min(out.get(behind, way), way)
    return out


def finished(ways: dict[int, tuple[int, str]]) -> tuple[int, str]:
    """The cheapest way to a right end, with the rows inserted behind the last."""
    tail = {START: (0, ""), AFTER_S: (4, "II"), AFTER_U: (2, "I"), AFTER_A: (0, "")}
    return min((cost + tail[state][0], letters + tail[state][1]) for state, (cost, letters) in ways.items())


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) of the rows left, damaged by the checksum of ``conv_id:turn``: 0 drops a row, 1 takes
    its text, 2 the marks that end sentences, 3 repeats it, 4 makes its role user."""
    word = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    kind = F.crc32(F.concat(word[0], F.lit(":"), word[1]).cast("binary")) % 20
    text, role = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("text", "role"))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), kind.alias("kind"))
    rows = rows.where(F.col("kind") != 0)
    text = F.when(F.col("kind") == 1, F.lit("")).when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", F.when(F.col("kind") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(copies).alias("copy")).drop("copy")


def faults(rows: DataFrame, span: int) -> DataFrame:
    """``rows`` with their segment, fault (b, d, t or none) and code."""
    seen = Window.partitionBy("conv_id", "role", "text").orderBy(F.col("turn").asc_nulls_first())
    last = F.regexp_extract("text", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    fault = (
        F.when(~F.col("text").rlike(BLANK), "b").when(F.row_number().over(seen) > 1, "d").when(~last.isin(".", "!", "?"), "t").otherwise("")
    )
    initial = F.coalesce(F.array_position(F.lit(list(INITIALS)), F.substring("role", 1, 1)), F.lit(0))
    found = rows.withColumn("fault", fault).withColumn("initial", F.when(initial == 0, 3).otherwise(initial - 1).cast("int"))
    code = F.col("initial") + F.when(F.col("fault").isin("b", "d"), 4).when(F.col("fault") == "t", 8).otherwise(0)
    # A null turn is before all segments.
    return found.withColumn("segment", F.expr(f"turn div {span}")).select("conv_id", "segment", "turn", "role", "text", "fault", code.cast("int").alias("code"))


def _ordered(rows: DataFrame, *keys: str) -> DataFrame:
    """``rows`` dealt out by ``keys``, those of a conversation in order within a partition."""
    inner = [F.col(c).asc_nulls_first() for c in ("conv_id", "segment", "turn", "role", "text")]
    return rows.repartition(*keys).sortWithinPartitions(*inner, F.col("fault") == "d")


def _rows(batches) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*(c.to_pylist() for c in b.columns))


def _batches(rows: Iterator[tuple], names: list[str], kinds: list[pa.DataType], size: int = 1024) -> Iterator[pa.RecordBatch]:
    while part := list(islice(rows, size)):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part), kinds)], names)


SEGMENTS = pa.schema(
    [(c, pa.int64()) for c in ("conv_id", "segment", "low", "high", "turns", "blank", "duplicate", "truncated", "illegal", "first", "last")]
    + [("before", pa.list_(pa.int64())), ("behind", pa.list_(pa.int64())), ("costs", pa.list_(pa.int64())), ("letters", pa.list_(pa.string()))]
)
WHOLE = pa.schema([(c, pa.int64()) for c in ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost")] + [("audit", pa.string())])
LEGAL = {(0, 1), (1, 2), (2, 1)}


def segments(rows: DataFrame) -> DataFrame:
    """One row for each segment of ``faults``: its counts and the cheapest ways through it."""

    def sums(key: tuple, rows: Iterator[tuple]) -> tuple:
        codes, low, high, turns, counts, illegal = bytearray(), None, None, 0, dict.fromkeys("bdt", 0), 0
        for _, _, turn, fault, code in rows:
            if turn is not None and turn != high:
                low, high, turns = turn if low is None else low, turn, turns + 1
            if fault:
                counts[fault] += 1
            if codes and (codes[-1] & 3, code & 3) not in LEGAL:
                illegal += 1
            codes.append(code)
        found = (short_paths if len(codes) <= 32 else paths)(bytes(codes))
        return (*key, low, high, turns, *counts.values(), illegal, codes[0] & 3, codes[-1] & 3, *(list(x) for x in zip(*found)))

    def find(batches):
        return _batches((sums(k, g) for k, g in groupby(_rows(batches), lambda r: r[:2])), SEGMENTS.names, SEGMENTS.types)

    plain = _ordered(rows, "conv_id", "segment").select("conv_id", "segment", "turn", "fault", "code")
    return plain.mapInArrow(find, from_arrow_schema(SEGMENTS))


def repaired(found: DataFrame) -> DataFrame:
    """One row for each conversation of ``segments``: counts, cost and audit, folded over its segments in order."""

    def fold(conv_id, parts: Iterator[tuple]) -> tuple:
        ways, low, high, turns, counts, before = {START: (0, "")}, None, None, 0, [0] * 4, None
        for _, _, part_low, part_high, part_turns, *more, first, last, q, to, costs, letters in parts:
            if part_low is not None:
                low, high, turns = part_low if low is None else low, part_high, turns + part_turns
            counts = [a + b for a, b in zip(counts, more)]
            counts[3] += before is not None and (before, first) not in LEGAL
            before, ways = last, joined(ways, list(zip(q, to, costs, letters)))
        gaps = 0 if low is None else high - low + 1 - turns
        return (conv_id, gaps, *counts, *finished(ways))

    def run(batches):
        return _batches((fold(k, g) for k, g in groupby(_rows(batches), lambda r: r[0])), WHOLE.names, WHOLE.types)

    inner = [F.col(c).asc_nulls_first() for c in ("conv_id", "segment")]
    return found.repartition("conv_id").sortWithinPartitions(*inner).mapInArrow(run, from_arrow_schema(WHOLE))


def edited(rows: DataFrame, whole: DataFrame) -> DataFrame:
    """(conv_id, step, edit, role, text): each conversation's rows after repair, and the deleted ones without a role, in
    order of ``step``, by the audit of ``repaired``."""
    return _applied(rows, whole, lambda conv_id, steps: ((conv_id, k, *x) for k, x in enumerate(steps)), EDITED)


EDITED = pa.schema([("conv_id", pa.int64()), ("step", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])
HASHED = pa.schema([("conv_id", pa.int64()), ("repaired_sha256", pa.string())])


def hashed(rows: DataFrame, whole: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) of each conversation; its rows pass by and are never held together."""

    def digest(conv_id, steps):
        h, any_ = hashlib.sha256(), False
        for _, role, text in steps:
            if role is not None:
                h.update((("\n" if any_ else "") + role + ":" + text).encode())
                any_ = True
        yield conv_id, h.hexdigest()

    return _applied(rows, whole, digest, HASHED)


def _applied(rows: DataFrame, whole: DataFrame, use, schema: pa.Schema) -> DataFrame:
    """``use(conv_id, steps)`` for each conversation, where steps are (edit, role, text) in order."""
    none = [F.lit(None).cast(t).alias(c) for c, t in (("segment", "long"), ("turn", "long"), ("role", "string"), ("text", "string"), ("fault", "string"))]
    audits = whole.select("conv_id", *none, "audit")
    both = audits.unionByName(rows.select("conv_id", "segment", "turn", "role", "text", "fault", F.lit(None).cast("string").alias("audit")))
    inner = [F.col("conv_id").asc_nulls_first(), F.col("audit").isNull(), *(F.col(c).asc_nulls_first() for c in ("segment", "turn", "role", "text")), F.col("fault") == "d"]
    sorted_ = both.repartition("conv_id").sortWithinPartitions(*inner).select("conv_id", "audit", "role", "text")

    def steps(audit: str, rows: Iterator[tuple]):
        state = START
        for edit in audit:
            if edit == "I":
                role, state = MADE[state]
                yield edit, role, ""
                continue
            _, _, role, text = next(rows)
            if edit == "K":
                state = KEEPS[state, role[0]]
            elif edit == "R":
                role, state = MADE[state]
            yield edit, None if edit == "D" else role, text

    def run(batches):
        def out():
            for conv_id, group in groupby(_rows(batches), lambda r: r[0]):
                yield from use(conv_id, steps(next(group)[1], group))

        return _batches(out(), schema.names, schema.types)

    return sorted_.mapInArrow(run, from_arrow_schema(schema))


def repair(conversations: DataFrame, left: DataFrame, span: int = 1024) -> DataFrame:
    """One row for each conv_id of ``conversations``, for the rows that are ``left`` of them: conv_id, gaps, blank,
    duplicate, truncated, illegal, cost, audit and repaired_sha256."""
    rows = written(faults(left, span), "turns")
    whole = written(repaired(segments(rows)), "audits")
    digests = hashed(rows, whole)
    ids = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    out = ids.join(whole.withColumnRenamed("conv_id", "c1"), F.col("conv_id").eqNullSafe(F.col("c1")), "left").join(
        digests.withColumnRenamed("conv_id", "c2"), F.col("conv_id").eqNullSafe(F.col("c2")), "left"
    )
    numbers = [F.coalesce(c, F.lit(0)).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    empty = hashlib.sha256(b"").hexdigest()
    return out.select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(empty)).alias("repaired_sha256"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    return repair(table, damaged(table))


def _add(value: str, cost: str, letter: str) -> str:
    return f"(printf('%08d', left({value}, 8)::BIGINT + {cost}) || '{letter}' || substr({value}, 9))"


def _oracle() -> str:
    """The same rows in DuckDB: suffixes of each conversation, from its last row to its first, as (cost, letters) by state."""
    to = {0: 2, 1: 2, 2: 3, 3: 2}
    keeps = {0: ("s", 1, "u", 2), 1: ("u", 2), 2: ("a", 3), 3: ("u", 2)}
    rows, inserts = [], []
    for q in range(4):
        kept = " ".join(f"WHEN k.initial = '{c}' THEN {_add(f'd.v{n}', 'k.cut', 'K')}" for c, n in zip(keeps[q][::2], keeps[q][1::2]))
        rows.append(f"least({_add(f'd.v{q}', '3', 'D')}, CASE WHEN NOT k.go THEN {_add(f'd.v{to[q]}', '2 + k.cut', 'R')} END, CASE WHEN k.go THEN NULL {kept} END) AS w{q}")
        one_, two = f"w{to[q]}", f"w{to[to[q]]}"
        inserts.append(f"least(w{q}, {_add(one_, '2', 'I')}, {_add(_add(two, '2', 'I'), '2', 'I')}) AS v{q}")
    return f"""
WITH RECURSIVE source AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS word FROM conversations),
summed AS (
  SELECT word, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(word, ''), lambda x: ascii(x)::BIGINT)),
    lambda c, x: list_reduce(list_prepend(xor(c, x), range(8)), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)), 4294967295) % 20 AS kind
  FROM (SELECT DISTINCT word FROM source)),
damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM source JOIN summed USING (word), LATERAL (SELECT unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)))),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS nth,
    left(role, 1) AS initial
  FROM damaged),
marked AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 'b' WHEN first_copy < nth THEN 'd'
    WHEN regexp_extract(text, '([^\\x20\\x09-\\x0D])[\\x20\\x09-\\x0D]*$', 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault,
    lag(initial) OVER (PARTITION BY conv_id ORDER BY nth) AS before
  FROM (SELECT *, min(nth) OVER (PARTITION BY conv_id, role, text) AS first_copy FROM numbered)),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank,
    count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
    count(*) FILTER (nth > 1 AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n
  FROM marked GROUP BY conv_id),
work AS (SELECT conv_id, nth, initial, fault IN ('b', 'd') AS go, CASE WHEN fault = 't' THEN 1 ELSE 0 END AS cut FROM marked),
dist AS (
  SELECT conv_id, n + 1 AS nth, '00000000' AS v0, '00000004II' AS v1, '00000002I' AS v2, '00000000' AS v3 FROM counts
  UNION ALL
  SELECT conv_id, nth, {", ".join(inserts)} FROM (
    SELECT d.conv_id, k.nth, {", ".join(rows)} FROM dist d JOIN work k ON k.conv_id IS NOT DISTINCT FROM d.conv_id AND k.nth = d.nth - 1)),
best AS (SELECT conv_id, left(v0, 8)::BIGINT AS cost, substr(v0, 9) AS audit FROM dist WHERE nth = 1),
letters AS (
  SELECT conv_id, pos, audit[pos] AS letter, sum(CASE WHEN audit[pos] <> 'I' THEN 1 ELSE 0 END) OVER w AS nth,
    sum(CASE WHEN audit[pos] <> 'D' THEN 1 ELSE 0 END) OVER w AS made
  FROM (SELECT conv_id, audit, unnest(range(1, length(audit) + 1)) AS pos FROM best)
  WINDOW w AS (PARTITION BY conv_id ORDER BY pos)),
edits AS (
  SELECT l.conv_id, l.pos, l.letter, l.made, m.role, m.initial, CASE WHEN l.letter = 'I' THEN '' ELSE m.text END AS text,
    max(CASE WHEN l.letter = 'K' AND m.initial = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY l.conv_id) AS led
  FROM letters l LEFT JOIN marked m ON m.conv_id IS NOT DISTINCT FROM l.conv_id AND m.nth = l.nth AND l.letter <> 'I' WHERE l.letter <> 'D'),
texts AS (
  SELECT conv_id, string_agg(CASE WHEN letter = 'K' THEN role WHEN (made - led) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY pos) AS whole
  FROM edits GROUP BY conv_id)
SELECT i.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
  coalesce(illegal, 0)::BIGINT AS illegal, coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit, sha256(coalesce(whole, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) i
  LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM i.conv_id LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM i.conv_id
  LEFT JOIN texts t ON t.conv_id IS NOT DISTINCT FROM i.conv_id"""


ORACLE = _oracle()
