import random
import re

import numpy as np

from tracewright.llm import ngramjoin, shingles
from tracewright.llm.common import Scratch
from tracewright.llm.components import components


def brute(rows):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common and 100 * common >= 75 * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    groups = {}
    for i, (d, _) in enumerate(rows):
        groups.setdefault(root(i), []).append(d)
    return sorted((rows[i][0], len(sets[i]), min(groups[root(i)])) for i in range(len(rows)))


def made(seed):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdeé") for _ in range(rnd.randrange(1, 5)))
    passage = [word() for _ in range(60)]
    rows = []
    for g in range(12):
        base = [word() for _ in range(rnd.choice([3, 5, 8, 40, 120, 300]))]
        for _ in range(rnd.choice([1, 2, 5, 40])):
            own = list(base)
            for _ in range(rnd.randrange(0, 1 + len(own) // 25)):
                own[rnd.randrange(len(own))] = word()
            if rnd.random() < 0.2:
                own += passage
            rows.append(" ".join(own).title() if rnd.random() < 0.3 else "\n".join(own))
    rows += ["", None, " \n", "a", "A", "a b", "x" * 300 + " y", rows[0], rows[0]]
    rnd.shuffle(rows)
    return list(enumerate(rows))


def test_equals_brute_force(spark):
    for seed, classes, local_hot in ((1, (16, 256), 64), (2, (2, 6), 3), (3, (1, 1), 2)):
        rows = made(seed)
        docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS key", "2 AS n", "'x' AS part").repartition(3)
        got = sorted(tuple(r) for r in ngramjoin.near_duplicates(docs, classes=classes, local_hot=local_hot).collect())
        assert got == brute(rows)


def test_pairs_across_dissimilar_sets_of_one_group(spark):
    """Short texts over a few words share most shingles, so groups stay apart until all pairs are tested."""
    rnd = random.Random(5)
    rows = list(enumerate(" ".join(rnd.choice("ab") for _ in range(rnd.randrange(9, 60))) for _ in range(150)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for classes, local_hot in (((16, 256), 64), ((2, 4), 2)):
        assert sorted(tuple(r) for r in ngramjoin.near_duplicates(docs, classes=classes, local_hot=local_hot).collect()) == brute(rows)


def test_combination_prefixes_miss_no_pair():
    rng = np.random.default_rng(4)
    for _ in range(300):
        n = int(rng.integers(64, 400))
        base = rng.integers(0, 2**63, n).astype(np.uint64)
        frequency = dict(zip(base.tolist(), rng.choice([2, 20, 400], n).tolist()))
        x, y = set(base.tolist()), set(base.tolist())
        while True:  # take tokens from both as long as they stay similar
            a, b = x - {rng.choice(list(x))}, y - {rng.choice(list(y))}
            if len(a & b) * 100 < 75 * len(a | b):
                break
            x, y = a, b
        s = []
        for z in (x, y):
            order = sorted(z, key=lambda t: (frequency[t], t))
            codes, ranks = ngramjoin.signatures(len(z), np.array(order, np.uint64), np.array([frequency[t] for t in order]))
            s.append(dict(zip(codes.tolist(), (len(z) + 1 - ranks).tolist(), strict=True)))
        # one of the shared combinations stands for as many shared tokens as there are
        assert any(min(s[0][c], s[1][c]) >= len(x & y) for c in s[0].keys() & s[1].keys())


def test_empty_and_null_ids(spark):
    docs = spark.createDataFrame([(None, "a b c d e f"), (4, "A b c d e f"), (None, "z"), (5, None)], "doc_id long, text string")
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in ngramjoin.near_duplicates(docs).collect()}
    assert got == {(None, 2, 4), (4, 2, 4), (None, 1, None), (5, 0, 5)}
    assert ngramjoin.near_duplicates(docs.limit(0)).count() == 0


def test_components_of_a_long_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (7, 7)], "a long, b long")
    with Scratch(spark, "test") as scratch:
        got = {r.node: r.label for r in components(links, scratch, "c").collect()}
    assert got == {i: 0 for i in range(1, 61)} | {101: 100}


def test_word_hashes_follow_the_word_rule():
    words, bounds = shingles.word_hashes(["The cat\tTHE\x0bÉ é", None, "", "cat " + "q" * 200])
    assert bounds.tolist() == [0, 5, 5, 5, 7]
    assert words[0] == words[2] and words[1] == words[5] and words[3] != words[4]
