import random

import numpy as np
import pyarrow as pa

from tracewright.llm import toxicity
from tracewright.llm.common import id_hash_mod
from pyspark.sql import functions as F


def made(n, seed):
    rnd = random.Random(seed)
    plain, bad = ["the", "sun", "rises", "over", "hills", "and", "river", "sings"], ["idiot", "moron", "scum"]
    rows = []
    for i in range(n):
        toxic = i % 5 == 0
        words = [rnd.choice(plain) for _ in range(rnd.randrange(5, 60))]
        if toxic:
            words.insert(rnd.randrange(len(words)), rnd.choice(bad))
        rows.append((i, " ".join(words), int(toxic)))
    return rows


def test_held_out_accuracy(spark):
    rows = made(600, 1)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(9000, None), (9001, ""), (None, "IDIOT " * 5000), (5, rows[5][1])], "doc_id long, text string").selectExpr("*", "1 AS score", "2 AS toxic")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(5, None), (None, 1)], "doc_id long, toxic int")
    got = toxicity.toxicity_query(docs, labels).collect()
    assert len(got) == len(rows) + 4
    truth = {i: y for i, _, y in rows}
    held = [r for r in got if r.doc_id in truth and r.held_out]
    assert len(held) > 100 and sum(r.predicted == truth[r.doc_id] for r in held) / len(held) > 0.98
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    assert next(r for r in got if r.doc_id is None).predicted == 1
    assert toxicity.toxicity_query(docs.limit(0), labels).count() == 0


def test_held_out_labels_are_not_read(spark):
    rows = made(200, 2)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    flipped = labels.withColumn("toxic", F.when(id_hash_mod(F.col("doc_id"), 3) == 1, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    same = lambda x: sorted((r.doc_id, round(r.score, 9)) for r in toxicity.toxicity_query(docs, x).collect())
    assert same(labels) == same(flipped)
    none = toxicity.toxicity_query(docs, labels.limit(0)).collect()
    assert len({r.score for r in none}) == 1


def test_grams_are_distinct_and_stay_in_their_text():
    row, slot = toxicity.grams(["abcabcabc", "", None, "xyz"])
    assert len(set(zip(row.tolist(), slot.tolist()))) == len(row)
    alone = [toxicity.grams([t])[1].tolist() for t in ("abcabcabc", "", None, "xyz")]
    assert [slot[row == i].tolist() for i in range(4)] == alone


def test_grams_are_of_characters():
    brute = lambda t: {t[i : i + k] for k in toxicity.LENGTHS for i in range(len(t) - k + 1)}
    texts = ["Привет, МИР", "naïve café", "日本語のテキスト", "a😀b 😀", "xx  yy\t\nxx"]
    hashes = {}
    for t in texts:
        clean = toxicity._clean(t)
        slots = toxicity.grams([t])[1].tolist()
        assert len(slots) == len(brute(clean))
        for g in brute(clean):  # a text of that n-gram alone has its hash among its own
            one = np.array([ord(c) for c in g], np.uint32)
            h = np.zeros(1, np.uint32)
            for c in one:
                h = h * np.uint32(0x01000193) + c + np.uint32(1)
            k = len(g) - 1
            mixed = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D + 2 * k)
            hashes[g] = int(mixed[0] >> np.uint32(32 - toxicity.BITS))
        assert sorted(slots) == sorted(hashes[g] for g in brute(clean))


def test_scores_equal_brute_force_on_other_scripts():
    rnd = random.Random(6)
    plain, bad = ["река", "été", "山", "soñar", "über"], ["дурак", "crétin"]
    rows = [(" ".join([*rnd.choices(plain, k=rnd.randrange(3, 30)), *rnd.choices(bad, k=int(i % 4 == 0))]), int(i % 4 == 0)) for i in range(200)]
    model = toxicity.fit([pa.RecordBatch.from_pydict({"text": [t for t, _ in rows], "toxic": pa.array([y for _, y in rows], pa.int32())})])
    texts = ["Дурак у реки", "un CRÉTIN là", "été 山 soñar", "", None]
    got = model.score(texts)
    for t, s in zip(texts, got, strict=True):
        slots = {int(x) for x in toxicity.grams([t])[1]}
        z = model.bias + sum(model.weights[model.table[x]] for x in slots if model.table[x] >= 0)
        assert abs(s - 1 / (1 + np.exp(-z))) < 1e-9
    assert got[0] > 0.7 > got[2] and got[1] > 0.7


def test_one_label_gives_the_prior():
    batch = pa.RecordBatch.from_pydict({"text": ["a", "b"], "toxic": pa.array([0, 0], pa.int32())})
    assert np.allclose(toxicity.fit([batch]).score(["a", "zzz", None]), toxicity.fit([batch]).score([""])[0])
