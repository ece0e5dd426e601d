"""Spelling variants against brute force over all pairs of words."""

import random
import re
import zlib
from collections import Counter

import duckdb

from tracewright.llm import spelling
from tracewright.llm.common import Scratch
from tracewright.llm.spelling import SPELLING_SQL, near, near_pairs, variants


def one_edit(x, y):
    """By definition: some deletion, replacement or insertion of one character makes them equal."""
    if len(x) > len(y):
        x, y = y, x
    if len(x) == len(y):
        return sum(a != b for a, b in zip(x, y, strict=True)) == 1
    return len(x) + 1 == len(y) and any(y[:i] + y[i + 1 :] == x for i in range(len(y)))


def brute(rows):
    counts = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 199 == 0 else run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    out, forms = {}, {}
    for w, n in words.items():
        others = [x for x in words if one_edit(w, x)]
        best = min(others, key=lambda x: (-words[x], x), default=None)
        if best is not None and words[best] >= 5 * n:
            forms[w] = best
        out[w] = [forms.get(w), w, n, len(others), words.get(forms.get(w))]
    for w, row in out.items():
        while row[1] in forms:
            row[1] = forms[row[1]]
    return {w: tuple(r) for w, r in out.items()}


def corpus(rng, n):
    bases = ["".join(rng.choices("abcdéÿ", k=rng.randrange(5, 11))) for _ in range(30)] + ["unterhaltung", "aaaaaaa", "aaaaaaaa", "Zufällig", "naïveté×"]
    words = []
    for b in bases:
        words.append(b)
        for _ in range(6):
            i = rng.randrange(len(b))
            words.append(rng.choice([b[:i] + b[i + 1 :], b[:i] + rng.choice("abcé") + b[i:], b[:i] + rng.choice("abcÉ") + b[i + 1 :]]))
    weights = [rng.choice([1, 1, 8, 60]) for _ in words]
    return [(i, rng.choice([" ", "\n", "1", "–", "Ā"]).join(rng.choices(words, weights, k=rng.randrange(400)))) for i in range(n)]


def test_variants_equal_brute_force_and_sql(spark, tmp_path):
    rng = random.Random(6)
    rows = corpus(rng, 60)
    rows += [(None, rows[3][1]), (5, None), (6, ""), (7, rows[7][1]), (7, rows[7][1])]
    df = spark.createDataFrame([(*r, "x", 3) for r in rows], "doc_id long, text string, word string, n int").repartition(5)
    found = variants(df)
    expected = brute(rows)
    assert sum(1 for r in expected.values() if r[0]) > 10
    assert {r[0]: tuple(r)[1:] for r in found.collect()} == expected
    df.write.parquet(f"{tmp_path}/d")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/d/*.parquet'")
    sql = con.sql(SPELLING_SQL)
    assert sql.columns == found.columns
    assert {r[0]: r[1:] for r in sql.fetchall()} == expected


def test_subdivided_blocks_lose_and_repeat_nothing(spark):
    rng = random.Random(7)
    words = sorted({"prefix" + "".join(rng.choices("ab", k=rng.randrange(3, 7))) + "suffix"[: rng.randrange(7)] for _ in range(220)} | {"x" * n for n in range(6, 15)} | {"ab" * 20 + "c" * k for k in range(3)})
    df = spark.createDataFrame([(w, 1 + i % 7) for i, w in enumerate(words)], "word string, n long")
    expected = sorted((x, y, 1 + j % 7) for x in words for j, y in enumerate(words) if one_edit(x, y))
    for block in (1, 4, 64):
        with Scratch(spark, "test") as scratch:
            assert sorted(map(tuple, near_pairs(df, scratch, block).collect())) == expected


def test_near():
    rng = random.Random(8)
    for _ in range(5000):
        x, y = ("".join(rng.choices("ab", k=rng.randrange(1, 6))) for _ in range(2))
        assert (near(x, y) is not None) == one_edit(x, y)


def test_empty_table_windows_and_long_texts(spark, monkeypatch):
    assert variants(spark.createDataFrame([], "doc_id string, text string")).collect() == []
    text = ("ordinary " * 20 + "ordinery " * 5) * 2000 + "y" * 300_000
    assert {r.word: r.n for r in variants(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()} == {"ordinary": 40_000, "ordinery": 10_000} or zlib.crc32(b"1:ordinary") % 199 == 0
    monkeypatch.setattr(spelling, "WINDOW", 5)
    for text in ("", "a", "abcdefghijkl mn opqrstuvw", "    é  zz"):
        parts = list(spelling.windows(text))
        assert "".join(parts) == text and [r for p in parts for r in spelling.RUNS.findall(p)] == spelling.RUNS.findall(text)
