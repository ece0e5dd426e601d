import hashlib
import random
import re
import zlib

from pyspark.sql import functions as F

from tracewright.llm import chat, decontam, linededup, sharding
from tracewright.llm.common import Scratch


def test_shards_are_near_equal_and_gapless(spark):
    rnd = random.Random(1)
    rows = [(i, "x" * rnd.randrange(0, 400)) for i in range(6000)] + [(None, "n"), (None, "n"), (5, "y"), (7, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS shard", "2 AS slot")
    got = sharding.assign_shards(docs).collect()
    assert len(got) == len(rows)
    size, slots = [0] * 24, {}
    for r in got:
        size[r.shard] += r.size
        slots.setdefault(r.shard, []).append(r.slot)
    assert max(size) - min(size) < 0.02 * sum(size) / 24
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert sharding.assign_shards(docs.limit(0)).count() == 0


def test_growing_moves_slots_only_to_the_new_shard():
    loads = [(s, 100 + s % 7, 1) for s in range(512)]
    old = sharding.rebalance(sharding.initial_map(512, 4), loads, 4)
    new = sharding.rebalance(old, loads, 5)
    assert sum(old[s] != new[s] for s in old) < 512 / 4 and {new[s] for s in old} == set(range(5))


def test_places_equal_brute_force_and_maps_are_edited(spark, tmp_path):
    rnd = random.Random(4)
    rows = [(rnd.choice([i, None, 7]), rnd.choice([None, "", "é", "x" * rnd.randrange(900)])) for i in range(500)] + [(1, "long " * 400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS shard", "2 AS virtual_slot")
    maps = sharding.SlotMap(spark, str(tmp_path / "maps"))
    run = lambda n, **x: sharding.assign_shards(docs, n, 64, map_path=maps.path, **x).collect()
    got = run(3)
    assert maps.versions() == [0, 1] and maps.load(0) == sharding.initial_map(64, 3)
    load = {}
    for r in got:
        load.setdefault(r.virtual_slot, []).append(r)
    want = sharding.rebalance(maps.load(0), sorted((s, sum(r.size for r in x), len(x)) for s, x in load.items()), 3)
    assert maps.load(1) == want and all(r.shard == want[r.virtual_slot] for r in got)
    places = {}
    for slot, shard in sorted(want.items()):
        for r in sorted(load.get(slot, []), key=lambda r: (r.doc_id is not None, r.doc_id, r.text_crc32, r.size)):
            places.setdefault(shard, []).append((r.doc_id, r.text_crc32, r.size))
    assert {k: [x for _, x in sorted((r.slot, (r.doc_id, r.text_crc32, r.size)) for r in got if r.shard == k)] for k in places} == places
    sizes = lambda x: sorted((str(i), len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in x)
    assert sizes(rows) == sorted((str(r.doc_id), r.size, r.text_crc32) for r in got)
    # the next run loads the newest map: nothing moves, and one more shard only takes slots
    assert sorted(map(str, run(3))) == sorted(map(str, got)) and maps.versions() == [0, 1]
    run(4)
    grown = maps.load(2)
    moved = sum(r.size for s, x in load.items() if grown[s] != want[s] for r in x)
    assert maps.versions() == [0, 1, 2] and 3 in grown.values() and moved < sum(r.size for r in got) / 2
    run(3, version=1)
    assert maps.versions() == [0, 1, 2]


def test_chat_parts_and_round_trip(spark):
    part = lambda kind, text=None, ref=None, units=None: (kind, text, ref, units)
    rows = [
        (1, 0, "user", [part("text", "look \\l <b> </turn>\n"), part("image", None, "a.png", 64), part("text", "and"), part("audio", None, "b.wav", 3)]),
        (1, 1, "assistant", [part("text", "\\b<image:0>")]), (1, 1, "assistant", [part("text", "\\b<image:0>")]),
        (2, 0, None, None), (2, None, "user", [part("document", None, None, 2)]), (None, 0, "assistant", [part("text", None)]),
    ]
    turns = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts array<{chat.PART}>").withColumn("formatted", F.lit(1))
    out = {r.conv_id: r for r in chat.format_chat(turns).collect()}
    assert [(a.number, a.type, a.ref, a.tokens) for a in out[1].attachments] == [(0, "image", "a.png", 64), (1, "audio", "b.wav", 75)]
    assert out[1].attachment_tokens == 139 and out[2].attachment_tokens == 1200
    assert [out[1].formatted[s.start : s.start + s.length] for s in out[1].loss_spans] == ["\\b" + "b\\limage:0>"] * 2
    parsed = chat.format_chat(turns).select("conv_id", F.explode(chat.parse_chat(F.col("formatted"))).alias("p")).where("conv_id = 1").collect()
    assert parsed[1].p.text == "\\b<image:0>" and len(parsed) == 3
    assert chat.format_chat(turns.limit(0)).count() == 0
    odd = [(1, i, r, t) for i, (r, t) in enumerate([("to>ol", "a>b"), ("\\g<x>\n", ">\n"), ("", "</turn>\n"), (">", "y" * 200_000)])]
    odd = spark.createDataFrame(odd, "conv_id long, turn long, role string, text string")
    read = chat.format_chat(odd.withColumn("parts", chat.text_part(F.col("text")))).select(F.explode(chat.parse_chat(F.col("formatted"))).alias("p")).collect()
    assert [(x.p.role, x.p.text) for x in read] == [(r.role, r.text) for r in odd.collect()]


def test_decontamination_equals_brute_force(spark):
    rnd = random.Random(2)
    vocabulary = ["Alpha", "béta", "c3", "delta", "eps", "zeta"] + [f"w{i}" for i in range(40)]
    items = [(i, " ".join(rnd.choice(vocabulary) for _ in range(n))) for i, n in enumerate((30, 13, 12, 5, 1, 0, 20))] + [(8, None), (0, "again w1 w2 w3")]
    rows = []
    for i in range(60):
        words = [rnd.choice(vocabulary) for _ in range(rnd.randrange(0, 80))]
        for _ in range(rnd.randrange(0, 3)):
            t = (rnd.choice(items)[1] or "").split()
            a = rnd.randrange(0, max(1, len(t) - 12))
            words[len(words) // 2 : len(words) // 2] = t[a : a + rnd.choice([5, 12, 13, 16])]
        rows.append((i, "-" * (i % 2) + rnd.choice([" ", ", ", "\n"]).join(words)))
    rows += [(100, None), (101, ""), (102, "!!"), (None, items[1][1]), (3, items[0][1]), (3, items[0][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS term", "2 AS pos")
    bench = spark.createDataFrame(items, "item_id long, text string")
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in t or ""))

    def want(d, t):
        w, hit, names = split(t), set(), set()
        for i, text in items:
            q = split(text)
            n = min(13, len(q))
            for s in range(len(q) - n + 1) if q else ():
                for a in range(len(w) - n + 1):
                    if w[a : a + n] == q[s : s + n]:
                        hit |= set(range(a, a + n))
                        names.add(str(i))
        return (d, len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w))

    got = decontam.contamination(docs, bench).drop("text_hash").collect()
    key = lambda r: (r[0] is None, r)
    assert sorted((tuple(r) for r in got), key=key) == sorted((want(*r) for r in rows), key=key)
    assert decontam.contamination(docs.limit(0), bench).count() == 0
    assert {r.n_hit for r in decontam.contamination(docs, bench.limit(0)).collect()} == {0}
    with Scratch(spark, "test") as scratch:
        near = decontam.proximity_matches(decontam.build_index(docs, bench, scratch), 3, 40)
        assert near.where("doc_id = 3 AND item_id = 0").count() > 0


def test_items_that_begin_with_separators_keep_all_windows(spark):
    def brute(texts, items):
        split = lambda t: re.findall(r"[A-Za-z0-9]+", t.lower())
        out = []
        for i, t in enumerate(texts):
            w, hit, names = split(t), set(), set()
            for j, text in enumerate(items):
                q = split(text)
                n = min(13, len(q))
                for s in range(len(q) - n + 1) if q else ():
                    for a in range(len(w) - n + 1):
                        if w[a : a + n] == q[s : s + n]:
                            hit |= set(range(a, a + n))
                            names.add(j)
            out.append((i, len(hit), len(names)))
        return out

    items = [before + " ".join(f"i{k}w{j}" for j in range(n)) + after for k, (before, n, after) in enumerate((("\"", 14, "\""), ("# ", 13, ""), ("- (", 20, ")"), (" ", 5, "."), ("[", 1, "]"), ("", 14, "")))]
    inner = [re.findall(r"[a-z0-9]+", t) for t in items]
    texts = [*items, *["x " + " ".join(w[-13:]) for w in inner], *["-x " + " ".join(w[:13]) + " y" for w in inner], *[" ".join(w[-12:]) for w in inner], " ".join(inner[2][3:17])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = decontam.contamination(docs, bench).select("doc_id", "n_hit", "n_items").collect()
    assert sorted(map(tuple, got)) == brute(texts, items)


def test_line_dedup_equals_brute_force(spark):
    rnd = random.Random(3)
    common = [f"common line number {k} here" for k in range(6)]
    rows = []
    for i in range(120):
        own = [f"own line {i} {j}" for j in range(3)] + [c for k, c in enumerate(common) if rnd.random() < 0.15 * (k + 1)] + ["short"]
        rnd.shuffle(own)
        rows.append((i, "\n".join(own), f"s{i % (9 + i % 4)}"))
    rows += [(200, None, "s1"), (201, "", None), (None, common[5], "z"), (0, rows[0][1], "s0"), (202, " " + common[5] + "\r", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 AS h", "2 AS n_lines")
    sites, first = {}, {}
    for i, t, s in rows:
        for line in (t or "").split("\n"):
            k = line.strip(" \t\r")
            sites.setdefault(k, set()).add(s)
            if i is not None:
                first[k] = min(first.get(k, i), i)
    bad = {k for k, v in sites.items() if len(v) >= linededup.MIN_SITES and len(k) >= linededup.MIN_CHARS}
    assert bad and len(bad) < 6
    clean = lambda i, t: None if t is None else "\n".join(x for x in t.split("\n") if x.strip(" \t\r") not in bad or first.get(x.strip(" \t\r")) in (i, None))
    got = linededup.dedup_lines(docs).collect()
    assert sorted((str(r.doc_id), str(r.text)) for r in got) == sorted((str(i), str(clean(i, t))) for i, t, _ in rows)
    assert linededup.dedup_lines(docs.limit(0)).count() == 0


def test_long_lines_need_fewer_sites(spark):
    passage = lambda n: " ".join(f"p{n}w{i}" for i in range(n))
    rows = [(i, f"own {i} line of it\n{passage(51)}\n{passage(50)}\n" + "z" * 100_000, f"s{i % 4}") for i in range(8)]
    rows += [(20 + i, f"{passage(70)}\nown {i} line of it", f"s{i % 3}") for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for limit in (200_000, 0):  # broadcast and shuffled
        linededup.BROADCAST_ROWS, kept = limit, linededup.BROADCAST_ROWS
        try:
            got = {r.doc_id: r for r in linededup.dedup_lines(docs).collect()}
        finally:
            linededup.BROADCAST_ROWS = kept
        assert [passage(51) in got[i].text for i in range(8)] == [True] + [False] * 7
        assert all(passage(50) in got[i].text for i in range(8)) and all(passage(70) in got[20 + i].text for i in range(6))
