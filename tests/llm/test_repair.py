"""Conversation repair against the enumeration of all short edit lists."""

import hashlib
import itertools
import random
import re
import zlib

import duckdb

from tracewright.llm.repair import REPAIR_SQL, repair, repair_query, summaries

GRAMMAR = re.compile(r"(s?(ua)+)?")
SPACE = " \t\n\x0b\x0c\r"


def faults(rows):
    out, seen = [], set()
    for _, role, text in rows:
        bare = text.rstrip(SPACE)
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "" if bare[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def cheapest(rows):
    """Cost, audit and repaired turns: all lists of edits of a cost are tried, for growing costs."""
    kinds, prefix = faults(rows), re.compile(r"(s?(ua)*u?)?")

    def tries(i, turns, left):
        if not prefix.fullmatch("".join(t[0][:1] or "-" for t in turns)):
            return
        if i == len(rows) and not left and GRAMMAR.fullmatch("".join(t[0][:1] for t in turns)):
            yield "", turns
        options = [("I", (r, ""), 3, i) for r in ("user", "assistant")]
        if i < len(rows):
            more = 3 * (kinds[i] == "truncated")
            options.append(("D", None, 4, i + 1))
            if kinds[i] not in ("blank", "duplicate"):
                options += [("K", rows[i][1:], more, i + 1), *(("R", (r, rows[i][2]), 3 + more, i + 1) for r in ("user", "assistant"))]
        for edit, turn, cost, to in options:
            if cost <= left:
                yield from ((edit + rest, made) for rest, made in tries(to, turns if turn is None else [*turns, turn], left - cost))

    for cost in itertools.count():
        if found := min(tries(0, [], cost), default=None):
            return cost, *found


def expected(rows):
    """The result of damaged rows (turn, role, text) in order."""
    cost, audit, turns = cheapest(rows)
    kinds, known = faults(rows), [t for t, _, _ in rows if t is not None]
    initials = [r[:1] for _, r, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials))
    gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
    return gaps, *(kinds.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in turns).encode()).hexdigest()


def ordered(rows):
    return sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), x[2].encode()))


def damaged(conv, rows):
    out = []
    for turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        h = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
        out += [(turn, "user" if h == 4 else role, text)] * (0 if h == 0 else 2 if h == 3 else 1)
    return ordered(out)


def random_turns(rng, n):
    return [(rng.choice([None, *range(6)]), rng.choice(["system", "user", "user", "assistant", "assistant", "tool", "", None]), rng.choice(["Hi.", "Hi.", "Well", "So?  \n", "", " \t", None, "Été", "…!"])) for _ in range(n)]


def test_repair_equals_enumeration(spark):
    rng = random.Random(1)
    conversations = {i: random_turns(rng, rng.randrange(5)) for i in range(120)}
    rows = [(c, *r, "x") for c, turns in conversations.items() for r in turns]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, cost string")
    found = {r[0]: tuple(r)[1:] for r in summaries(repair(df)).collect()}
    clean = lambda turns: ordered([(t, " " if r is None else r, " " if x is None else x) for t, r, x in turns])
    assert found == {c: expected(clean(t)) for c, t in conversations.items() if t}


def test_query_equals_enumeration_and_sql(spark, tmp_path):
    rng = random.Random(2)
    conversations = {i: [(t if rng.random() < 0.9 else None, *r[1:]) for t, r in enumerate(random_turns(rng, rng.randrange(1, 5)))] for i in [None, -3, *range(150)]}
    rows = [(c, *r) for c, turns in conversations.items() for r in turns]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4).write.parquet(f"{tmp_path}/c")
    result = repair_query(spark.read.parquet(f"{tmp_path}/c"))
    found = {r[0]: tuple(r)[1:] for r in result.collect()}
    assert found == {c: expected(damaged(c, t)) for c, t in conversations.items()}
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/c/*.parquet'")
    sql = con.sql(REPAIR_SQL)
    assert sql.columns == result.columns
    assert {r[0]: r[1:] for r in sql.fetchall()} == found


def test_edits_in_order_and_long_conversations(spark):
    rows = [(1, i, "user" if i % 2 == 0 else "assistant", f"Turn {i}.") for i in range(30_001)] + [(2, 0, "assistant", "A" * 3_000_000 + ".")] + [(3, 7, "user", "Same.")] * 500
    df = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string")
    edits = repair(df).collect()
    first = [r for r in edits if r.conv_id == 1]
    assert [r.seq for r in first] == list(range(30_003)) and first[-1].edit == "I" and first[-1].role == "assistant"
    assert [(r.edit, r.times, r.role) for r in edits if r.conv_id == 3] == [("", 0, None), ("K", 1, "user"), ("D", 499, None), ("I", 1, "assistant")]
    assert [(r.edit, r.role, len(r.text or "")) for r in edits if r.conv_id == 2][1:] == [("I", "user", 0), ("K", "assistant", 3_000_001)]
    sums = {r.conv_id: r for r in summaries(repair(df)).collect()}
    assert (sums[1].cost, sums[3].duplicate, sums[3].illegal, sums[3].gaps) == (3, 499, 499, 0) and sums[1].audit == "K" * 30_001 + "I"


def test_empty_table(spark):
    empty = spark.createDataFrame([], "conv_id string, turn long, role string, text string")
    assert repair_query(empty).collect() == []
