"""Structural repair of conversations at least cost.

A conversation's roles should read, by their initials, ``(s?(ua)+)?``: an optional system turn, then user
and assistant in turn.  A repair walks over the turns in order and keeps, reroles or deletes each,
and inserts empty turns anywhere.  The dynamic program runs over (turn, state of the grammar): backward it
finds the cost to go from every turn on in each of the four states, forward it walks greedily and takes,
of all edits that stay on a cheapest way, the one of the ASCII-least initial.  An edit's initial and the state
settle what the edit does, so that walk gives the least audit string.

Turns are dealt by conversation once and sorted there; the backward pass streams over them last turn
first, carrying four costs, and leaves with each turn the costs to go behind it.  A sort of the same
partition turns them round, without a shuffle, for the forward walk and the digests, which stream as well.
So a conversation of any length takes no memory of its size (its hash has to be taken in one sequence).
Equal rows of one turn are counted before anything is dealt.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewright.llm.arrow import pieces

REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: States of the grammar: nothing yet, after the system turn, a user turn, an assistant turn.
START, SYSTEM, USER, ASSISTANT = range(4)
#: The state after a user or assistant turn, whichever may follow, and that turn's role.
NEXT = (USER, USER, ASSISTANT, USER)
ROLE = ("", "", "user", "assistant")
#: Costs to go behind the last turn.
END = (0, 2 * INSERT, INSERT, 0)
SPACE = " \t\n\x0b\x0c\r"


def kept_state(state: int, initial: str) -> int | None:
    """The state after a kept turn of that role initial; None where it may not stand."""
    if initial == "s":
        return SYSTEM if state == START else None
    return NEXT[state] if initial == ("a" if state == USER else "u") else None


def cost_to_go(after: tuple[int, ...], initial: str, fault: str) -> tuple[int, ...]:
    """Costs to go before a turn, in each state, from those behind it."""
    base, extra = [], TRUNCATED if fault == "truncated" else 0
    for state in range(4):
        best = after[state] + DELETE
        if fault not in ("blank", "duplicate"):
            best = min(best, after[NEXT[state]] + REROLE + extra)
            to = kept_state(state, initial)
            if to is not None:
                best = min(best, after[to] + extra)
        base.append(best)
    user = min(base[USER], INSERT + base[ASSISTANT])
    return min(base[START], INSERT + user), min(base[SYSTEM], INSERT + user), user, min(base[ASSISTANT], INSERT + base[USER])


def walk(state: int, after: tuple[int, ...], initial: str, fault: str) -> list[tuple[str, int, int]]:
    """Edits (initial, state behind it, cost) up to and with one turn's own."""
    here, out, extra = cost_to_go(after, initial, fault), [], TRUNCATED if fault == "truncated" else 0
    while True:
        if here[state] == after[state] + DELETE:
            return [*out, ("D", state, DELETE)]
        if here[state] == INSERT + here[NEXT[state]]:
            state = NEXT[state]
            out.append(("I", state, INSERT))
            continue
        to = kept_state(state, initial)
        if to is not None and here[state] == after[to] + extra:
            return [*out, ("K", to, extra)]
        return [*out, ("R", NEXT[state], REROLE + extra)]


def walk_end(state: int) -> list[tuple[str, int, int]]:
    out = []
    while END[state]:
        state = NEXT[state]
        out.append(("I", state, INSERT))
    return out


class _Rows:
    """Rows gathered into batches of bounded size."""

    def __init__(self, schema: pa.Schema, limit: int = 4 << 20):
        self.schema, self.limit, self.rows, self.size = schema, limit, [], 0

    def add(self, *row: object) -> Iterator[pa.RecordBatch]:
        self.rows.append(row)
        self.size += 64 + sum(len(x) for x in row if isinstance(x, str))
        if self.size > self.limit:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*self.rows, strict=True), self.schema, strict=True)], schema=self.schema)
        self.rows, self.size = [], 0


_NONE = object()  # no conversation yet; None is one


def _stream(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[tuple]:
    for batch in batches:
        for piece in pieces(batch):
            yield from zip(*(piece.column(c).to_pylist() for c in columns), strict=True)


def _backward(schema: pa.Schema):
    """Adds the costs to go behind each turn's first copy; rows come last turn first."""
    columns = schema.names[:-4]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, now, costs = _Rows(schema), _NONE, END
        for row in _stream(batches, columns):
            conv, role, fault, copies = row[0], row[2], row[4], row[5]
            if now is _NONE or conv != now:
                now, costs = conv, END
            after = costs
            if copies:  # further copies are duplicates, or blank: deleted each
                after = tuple(c + DELETE * (copies - 1) for c in costs)
                costs = cost_to_go(after, role[:1], fault)
            yield from out.add(*row, *after)
        yield from out.flush()

    return run


def _forward(schema: pa.Schema):
    """Edits in order; rows come first turn first with the costs to go behind them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, now, state, seq = _Rows(schema), _NONE, START, 0

        def put(edits: list[tuple[str, int, int]], conv, turn, role, text, fault) -> Iterator[pa.RecordBatch]:
            nonlocal seq, state
            for edit, state, cost in edits:
                seq += 1
                new = {"I": (ROLE[state], ""), "R": (ROLE[state], text), "K": (role, text), "D": (None, None)}[edit]
                old = (None, None, None) if edit == "I" else (turn, role, fault)
                yield from out.add(conv, seq, edit, 1, cost, *new, *old)

        for conv, turn, role, text, fault, copies, *after in _stream(batches, ["conv_id", "turn", "role", "text", "fault", "copies", "a0", "a1", "a2", "a3"]):
            if now is _NONE or conv != now:
                if now is not _NONE:
                    yield from put(walk_end(state), now, None, None, None, None)
                now, state, seq = conv, START, 0
                yield from out.add(conv, 0, "", 0, 0, None, None, None, None, None)  # names the conversation
            if copies:
                yield from put(walk(state, tuple(after), role[:1], fault), conv, turn, role, text, fault)
            if copies > 1:
                seq += 1
                yield from out.add(conv, seq, "D", copies - 1, DELETE * (copies - 1), None, None, turn, role, "blank" if fault == "blank" else "duplicate")
        if now is not _NONE:
            yield from put(walk_end(state), now, None, None, None, None)
        yield from out.flush()

    return run


def repair(turns: DataFrame, copies: str | None = None) -> DataFrame:
    """The edits of every conversation of ``turns`` (conv_id, turn, role, text), in order within each partition,
    a conversation in one: conv_id, seq, edit (K, R, D or I), times (equal deletions in a row), cost, role and
    text of the repaired turn (null where deleted), and of the turn that was there, turn, old_role, fault (blank,
    duplicate, truncated or empty; null for insertions). A row of seq 0 and no edit names each conversation.

    A column named by ``copies`` says how often a row stands there (0: it only names its conversation).
    Turns go by ``turn``, nulls first, ties by role and text. Null roles and texts: one space, so such texts
    are blank; null conversation ids are one conversation; rows equal in all four columns are copies, all but
    the first deleted; roles of other initials cannot be kept; very long texts are carried, never copied into
    groups; an empty table gives an empty result; other columns are ignored.
    """
    types = dict(turns.dtypes)
    rows = turns.select(F.col("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"), (F.lit(1) if copies is None else F.col(copies)).cast("long").alias("copies"))
    # counted copies are dealt by conversation once: the window finds its rows in place
    rows = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies")).repartition("conv_id")
    nth = F.sum(F.signum("copies")).over(Window.partitionBy("conv_id", "role", "text").orderBy(F.asc_nulls_first("turn")).rowsBetween(Window.unboundedPreceding, -1))
    bare = F.rtrim(F.col("text"), F.lit(SPACE))
    fault = F.when(bare == "", "blank").when(nth > 0, "duplicate").when(~F.right(bare, F.lit(1)).isin(".", "!", "?"), "truncated").otherwise("")
    rows = rows.withColumn("fault", fault).select("conv_id", "turn", "role", "text", "fault", "copies")
    kind = turns.sparkSession.createDataFrame([], f"conv_id {types['conv_id']}").toArrow().schema.field("conv_id").type
    fields = [("conv_id", kind), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("fault", pa.string()), ("copies", pa.int64())]
    costs = pa.schema([*fields, *[(f"a{i}", pa.int64()) for i in range(4)]])
    back = rows.sortWithinPartitions("conv_id", F.desc_nulls_last("turn"), F.desc("role"), F.desc("text"))
    back = back.mapInArrow(_backward(costs), f"conv_id {types['conv_id']}, turn long, role string, text string, fault string, copies long, a0 long, a1 long, a2 long, a3 long")
    edits = pa.schema([("conv_id", kind), ("seq", pa.int64()), ("edit", pa.string()), ("times", pa.int64()), ("cost", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("turn", pa.int64()), ("old_role", pa.string()), ("fault", pa.string())])
    there = back.sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "text")
    return there.mapInArrow(_forward(edits), f"conv_id {types['conv_id']}, seq long, edit string, times long, cost long, role string, text string, turn long, old_role string, fault string")


FIGURES = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def _digests(schema: pa.Schema):
    """One row per conversation from its edits in order."""
    columns = ["conv_id", "seq", "edit", "times", "cost", "role", "text", "turn", "old_role", "fault"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, now = _Rows(schema), _NONE
        count, audit, sha, first, low, high, distinct, last = {}, [], hashlib.sha256(), True, None, None, 0, None

        def close() -> Iterator[pa.RecordBatch]:
            gaps = high - low + 1 - distinct if distinct else 0
            yield from out.add(now, gaps, *[count[c] for c in FIGURES[1:]], "".join(audit), sha.hexdigest())

        for conv, seq, edit, times, cost, role, text, turn, old, fault in _stream(batches, columns):
            if seq == 0:
                if now is not _NONE:
                    yield from close()
                now, count, audit, sha, first, low, high, distinct, last = conv, dict.fromkeys(FIGURES, 0), [], hashlib.sha256(), True, None, None, 0, None
                continue
            count["cost"] += cost
            audit.append(edit * times)
            if role is not None:
                sha.update((("" if first else "\n") + role + ":" + text).encode())
                first = False
            if edit == "I":
                continue
            if fault:
                count[fault] += times
            pairs = times if last is not None else times - 1
            if pairs and last is not None:
                count["illegal"] += last + old[:1] not in ("su", "ua", "au")
                pairs -= 1
            count["illegal"] += pairs  # of equal roles
            last = old[:1]
            if turn is not None:
                distinct += turn != high
                low, high = (turn if low is None else low), turn
        if now is not _NONE:
            yield from close()
        yield from out.flush()

    return run


def summaries(edits: DataFrame) -> DataFrame:
    """One row for each conversation of ``repair``'s result: conv_id, gaps among its turns, counts of faults and
    of illegal neighbours, cost, audit and repaired_sha256 (of the repaired ``role:text``, newline-joined)."""
    kind = dict(edits.dtypes)["conv_id"]
    arrow = edits.sparkSession.createDataFrame([], f"conv_id {kind}").toArrow().schema.field("conv_id").type
    schema = pa.schema([("conv_id", arrow), *[(c, pa.int64()) for c in FIGURES], ("audit", pa.string()), ("repaired_sha256", pa.string())])
    return edits.mapInArrow(_digests(schema), f"conv_id {kind}, " + ", ".join(f"{c} long" for c in FIGURES) + ", audit string, repaired_sha256 string")


def damage(turns: DataFrame) -> DataFrame:
    """The turns with reproducible faults and a column ``copies``, by the crc32 of ``conv_id:turn`` modulo 20: 0
    dropped (copies 0), 1 emptied, 2 without ``[.!?]``, 3 twice, 4 of role user. Nulls: one space, but for turn."""
    name = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    h = F.crc32(name.cast("binary")) % 20
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    return turns.select("conv_id", "turn", F.when(h == 4, "user").otherwise(role).alias("role"), F.when(h <= 1, "").when(h == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"), F.when(h == 0, 0).when(h == 3, 2).otherwise(1).alias("copies"))


def repair_query(turns: DataFrame) -> DataFrame:
    return summaries(repair(damage(turns), "copies"))


REPAIR_SQL = r"""
WITH RECURSIVE crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
h AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(list_reduce(list_prepend(4294967295, list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda x: CAST(ascii(x) AS BIGINT))),
      lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS h
  FROM conversations, crc),
d AS (
  SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role,
    CASE h WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
    unnest(range(CASE h WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy
  FROM h),
n AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS nth,
    rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare
  FROM d),
o AS (
  SELECT conv_id, turn, role, text, i, left(role, 1) AS r,
    CASE WHEN bare = '' THEN 'blank' WHEN nth > 1 THEN 'duplicate' WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
    lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1) AS pair
  FROM n),
c AS (
  SELECT i.conv_id, count(o.i) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM (SELECT DISTINCT conv_id FROM conversations) i LEFT JOIN o ON i.conv_id IS NOT DISTINCT FROM o.conv_id GROUP BY i.conv_id),
b(conv_id, i, v0, v1, v2, v3) AS (
  SELECT conv_id, n + 1, CAST(0 AS BIGINT), CAST(6 AS BIGINT), CAST(3 AS BIGINT), CAST(0 AS BIGINT) FROM c
  UNION ALL
  SELECT conv_id, i, least(b0, 3 + b2, 6 + b3), least(b1, 3 + b2, 6 + b3), least(b2, 3 + b3), least(b3, 3 + b2) FROM (
    SELECT o.conv_id, o.i,
      least(v0 + 4, gone + v2 + 3 + more, gone + more + CASE r WHEN 's' THEN v1 WHEN 'u' THEN v2 ELSE 1000000000000 END) AS b0,
      least(v1 + 4, gone + v2 + 3 + more, gone + more + CASE r WHEN 'u' THEN v2 ELSE 1000000000000 END) AS b1,
      least(v2 + 4, gone + v3 + 3 + more, gone + more + CASE r WHEN 'a' THEN v3 ELSE 1000000000000 END) AS b2,
      least(v3 + 4, gone + v2 + 3 + more, gone + more + CASE r WHEN 'u' THEN v2 ELSE 1000000000000 END) AS b3
    FROM (SELECT *, CASE WHEN fault IN ('blank', 'duplicate') THEN 1000000000000 ELSE 0 END AS gone, CASE WHEN fault = 'truncated' THEN 3 ELSE 0 END AS more FROM o) o
    JOIN b ON o.conv_id IS NOT DISTINCT FROM b.conv_id AND o.i = b.i - 1)),
f(conv_id, i, state, audit, cost, turns) AS (
  SELECT conv_id, CAST(1 AS BIGINT), 0, '', CAST(0 AS BIGINT), CAST([] AS VARCHAR[]) FROM c
  UNION ALL
  SELECT conv_id, CASE edit WHEN 'I' THEN i ELSE i + 1 END,
    CASE edit WHEN 'D' THEN state WHEN 'K' THEN kept ELSE nxt END, audit || edit,
    cost + CASE edit WHEN 'D' THEN 4 WHEN 'I' THEN 3 WHEN 'K' THEN more ELSE 3 + more END,
    CASE edit WHEN 'D' THEN turns WHEN 'K' THEN list_append(turns, role || ':' || text)
      ELSE list_append(turns, CASE nxt WHEN 2 THEN 'user:' ELSE 'assistant:' END || CASE edit WHEN 'I' THEN '' ELSE text END) END
  FROM (
    SELECT *, CASE WHEN r IS NOT NULL AND here[state + 1] = behind[state + 1] + 4 THEN 'D' WHEN here[state + 1] = 3 + here[nxt + 1] THEN 'I'
        WHEN kept IS NOT NULL AND here[state + 1] = behind[kept + 1] + more THEN 'K' ELSE 'R' END AS edit
    FROM (
      SELECT f.*, o.r, o.role, o.text, [p.v0, p.v1, p.v2, p.v3] AS here, [q.v0, q.v1, q.v2, q.v3] AS behind,
        CASE f.state WHEN 2 THEN 3 ELSE 2 END AS nxt,
        CASE WHEN o.r = 's' AND f.state = 0 THEN 1 WHEN o.r = 'u' AND f.state <> 2 THEN 2 WHEN o.r = 'a' AND f.state = 2 THEN 3 END AS kept,
        CASE WHEN o.fault = 'truncated' THEN 3 ELSE 0 END AS more
      FROM f JOIN b p ON f.conv_id IS NOT DISTINCT FROM p.conv_id AND f.i = p.i
      LEFT JOIN b q ON f.conv_id IS NOT DISTINCT FROM q.conv_id AND q.i = f.i + 1
      LEFT JOIN o ON f.conv_id IS NOT DISTINCT FROM o.conv_id AND o.i = f.i)
    WHERE r IS NOT NULL OR here[state + 1] > 0))
SELECT c.conv_id, CAST(gaps AS BIGINT) AS gaps, blank, duplicate, truncated, illegal, f.cost, f.audit, sha256(array_to_string(f.turns, chr(10))) AS repaired_sha256
FROM c JOIN f ON c.conv_id IS NOT DISTINCT FROM f.conv_id AND f.i = c.n + 1 AND f.state IN (0, 3)
"""
