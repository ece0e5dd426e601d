import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from tracewright.llm import lm

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def test_gradients_match_differences():
    rng = np.random.default_rng(0)
    w = {k: rng.normal(0, 0.3, s) for k, s in {"in": (20, lm.DIM), "place": (lm.WINDOW, lm.DIM), "q": (lm.DIM,) * 2, "k": (lm.DIM,) * 2, "v": (lm.DIM,) * 2, "o": (lm.DIM,) * 2, "out": (lm.DIM, 7), "bias": (7,)}.items()}
    entry = rng.integers(0, 20, (3, lm.WINDOW))
    d = rng.normal(size=(3, lm.WINDOW, 7))
    g = lm.backward(w, entry, lm.forward(w, entry)[1], d)
    for k in w:
        at = tuple(rng.integers(0, n) for n in w[k].shape)
        if k == "in":
            at = (int(entry[0, 0]), 1)
        value = []
        for e in (1e-5, -1e-5):
            w[k][at] += e
            value.append((lm.forward(w, entry)[0] * d).sum())
            w[k][at] -= e
        assert abs((value[0] - value[1]) / 2e-5 - g[k][at]) < 1e-4


def test_windows_score_every_place_once():
    lengths = np.array([1, 15, 16, 17, 28, 29, 100])
    place, scored = lm.windows(lengths)
    assert sorted(place[scored].tolist()) == list(range(lengths.sum()))


def test_windows_carry_context_and_width():
    assert lm.WINDOW >= 16 and lm.DIM >= 16 and lm.CLASSES >= 40 and lm.OWN_CLASSES >= 24
    place, scored = lm.windows(np.array([100]))
    assert min(int(np.argmax(s)) for s in scored[1:]) >= lm.WINDOW // 4


def small_model(steps=3):
    rng = np.random.default_rng(1)
    words = rng.integers(1, 100, 300)
    starts = np.arange(300) % 2
    starts[-1] = 0
    inner = np.where(starts == 0, words, 0)
    counts = lm.IdCounts(words, words * starts, np.minimum(words, 5) * starts, inner)
    return lm.train(counts, starts, rng.integers(0, 300, 200), np.array([150, 50]), steps), counts, starts


def test_attention_is_causal():
    model, _, _ = small_model()
    rng = np.random.default_rng(2)
    a = rng.integers(0, 300, 16)
    b = a.copy()
    b[10:] = rng.integers(0, 300, 6)
    x, y = (lm.log_probabilities(model, s, np.array([16])) for s in (a, b))
    assert np.allclose(x[:10], y[:10], atol=1e-5) and not np.allclose(x[11:], y[11:])


def test_scores_equal_the_plain_forward_pass():
    model, _, _ = small_model(40)
    rng = np.random.default_rng(3)
    lengths = np.array([1, 16, 17, 40, 3])
    ids = rng.integers(0, 300, lengths.sum())
    got = lm.log_probabilities(model, ids, lengths, chunk=3)
    before, (place, scored) = lm.inputs_of(model, ids, lengths), lm.windows(lengths)
    want = np.zeros(len(ids))
    for p, s in zip(place, scored, strict=True):
        logits, _ = lm.forward(model.weights, np.where(p < 0, lm.OWN_INPUTS + lm.CLASSES, before[p])[None])
        chance = lm.softmax(logits[0].astype(float))
        for i in np.flatnonzero(s):
            want[p[i]] = math.log10(chance[i, model.kind[ids[p[i]]]]) + model.share[ids[p[i]]]
    assert np.allclose(got, want, atol=1e-4)


def test_words_after_a_context_add_up_to_one():
    model, counts, starts = small_model()
    # after any context: words seen, first ids of words never seen, further ids of a word, the end
    for context in ([], [5, 8, 7], [3] * 15):
        classed = [lm.log_probabilities(model, np.array([*context, i]), np.array([len(context) + 1]))[-1] - model.share[i] for i in range(300)]
        total = 0.0
        for i in range(300):
            if starts[i]:
                total += 10 ** (classed[i] - model.mass[i]) * counts.words[i] + 10 ** (classed[i] + model.share[i])
            else:
                total += 10 ** (classed[i] + model.share[i])
        assert abs(total - 1) < 2e-3


def test_base_scores_and_held_out_gain(spark):
    rnd = random.Random(3)
    bits = ["tion", "er", "an", "the", "ing", "or", "é"]
    make = lambda: " ".join("".join(rnd.choice(bits) for _ in range(rnd.choice([1, 1, 2, 3]))) for _ in range(rnd.randrange(1, 90)))
    rows = [(i, make().title() if i % 3 else make()) for i in range(400)] + [(900, None), (901, ""), (902, "\x0b \t"), (None, "an er"), (3, "an"), (904, "Z" * 5000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS score", "2 AS word")
    got = lm.lm_query(docs, PATH, public_tokenizers.PATTERN).collect()
    assert len(got) == len(rows)
    fold = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 7
    count = Counter()
    for i, t in rows:
        if fold(i) != 2:
            count.update(lm.words_of(t))
            count[None] += 1
    n, v = sum(count.values()), len(count)
    want = Counter()
    for i, t in rows:
        tokens = [*lm.words_of(t), None]
        want[i, len(tokens), sum(count[w] > 0 for w in tokens), round(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in tokens), 6), fold(i) == 2] += 1
    assert Counter((r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 6), r.held_out) for r in got) == want
    assert {r.train_tokens for r in got} == {n} and all(r.score < 0 and math.isfinite(r.score) for r in got)
    assert lm.lm_query(docs.limit(0), PATH, public_tokenizers.PATTERN).count() == 0


@pytest.mark.parametrize("limit", [0, 3])
def test_rare_words_are_joined(spark, monkeypatch, limit):
    monkeypatch.setattr(lm, "FREQUENT_WORDS", limit)
    docs = spark.createDataFrame([(i, "a b b c c c d e") for i in range(8)], "doc_id long, text string")
    got = lm.lm_query(docs, PATH, public_tokenizers.PATTERN).collect()
    n = got[0].train_tokens
    assert all(abs(r.base_score - sum(math.log10((k * n / 9 + 1) / (n + 7)) for k in (1, 2, 2, 3, 3, 3, 1, 1, 1))) < 1e-6 for r in got)


def test_weights_are_fitted_to_all_training_texts(spark, monkeypatch):
    monkeypatch.setattr(lm, "SAMPLE_TEXTS", 1)
    rnd = random.Random(5)
    rows = [(i if i % 3 else None, " ".join(rnd.choice(["an", "er", "ing", "the"]) for _ in range(rnd.randrange(0, 60)))) for i in range(300)] + [(7, None), (7, None)]
    learn = spark.createDataFrame(rows, "doc_id long, text string")
    content = lm.read_ranks(PATH)
    coder = lm.encoder(content, public_tokenizers.PATTERN)
    often = {w: 9 for w in (b"an", b"er", b"the")}
    ids, lengths = lm.Words(coder, often).sequences([lm.words_of(t) for _, t in rows])[:2]
    units = np.bincount(ids, minlength=coder.size + 1)
    zero = np.zeros_like(units)
    start = lm.train(lm.IdCounts(units, units, zero, units), zero, ids[:0], lengths[:0])
    frequent = spark.sparkContext.broadcast(often)
    model, seen = lm.fit_output(learn.repartition(2), start, frequent, content, public_tokenizers.PATTERN)
    assert seen == len(ids)
    assert lm.log_probabilities(model, ids, lengths).mean() > lm.log_probabilities(start, ids, lengths).mean()
    other, _ = lm.fit_output(learn.repartition(8), start, frequent, content, public_tokenizers.PATTERN)
    assert np.allclose(lm.log_probabilities(other, ids, lengths), lm.log_probabilities(model, ids, lengths), atol=1e-3)
    again, seen = lm.fit_output(learn.limit(0), start, frequent, content, public_tokenizers.PATTERN)
    assert seen == 0 and again is start


def test_id_counts_equal_brute_force(spark):
    texts = ["an er an thesession", "an er Tionheis x", None, "an thesession thesession q"]
    content = lm.read_ranks(PATH)
    coder = lm.encoder(content, public_tokenizers.PATTERN)
    counts = lm.word_counts(spark.createDataFrame([(t,) for t in texts], "text string")).cache()
    got = lm.id_counts(counts, 4, content, public_tokenizers.PATTERN)  # level 4: a count of 2
    seen = Counter(w for t in texts for w in lm.words_of(t))
    want = np.zeros((4, coder.size + 1), np.int64)
    want[0, -1] = len(texts)
    for w, c in seen.items():
        ids = coder.merge([b" " + w])[0]
        want[1, ids[0]] += c
        want[2, ids[0]] += c == 1
        want[0, ids[0]] += c
        for i in ids[1:] if c < 2 else ():
            want[3, i] += c
            want[0, i] += c
    assert all(np.array_equal(x, y) for x, y in zip((got.units, got.words, got.once, got.inner), want, strict=True))


def test_context_gains_on_held_out_texts(spark):
    rnd = random.Random(9)
    tongues = [[f"{a}{b}" for a in first for b in "aeiou"] for first in ("bdfg", "klmn", "prst")]
    rows = [(i, " ".join(rnd.choices(tongues[i % 3], k=40))) for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [r for r in lm.lm_query(docs, PATH, public_tokenizers.PATTERN).collect() if r.held_out]
    assert sum(r.score for r in got) > sum(r.base_score for r in got) + 0.2 * sum(r.n_tokens for r in got)


def test_quick_gradients_equal_the_plain_ones():
    model, _, _ = small_model()
    rng = np.random.default_rng(4)
    lengths = np.array([1, 16, 17, 40, 3])
    ids = rng.integers(0, 300, lengths.sum())
    before, (place, scored) = lm.inputs_of(model, ids, lengths), lm.windows(lengths)
    entry = np.where(place < 0, lm.OWN_INPUTS + lm.CLASSES, before[place])
    logits, saved = lm.forward(model.weights, entry)
    d = lm.softmax(logits)
    d[np.arange(len(place))[:, None], np.arange(lm.WINDOW), model.kind[ids[place]]] -= 1
    d *= scored[..., None] / np.float32(scored.sum())
    want, got = lm.backward(model.weights, entry, saved, d), lm.gradients(model, entry, ids[place], scored)
    assert want.keys() == got.keys() and all(np.allclose(got[k], want[k], atol=1e-6) for k in want)


def test_every_weight_and_cluster_is_learnt_from_all_training_texts(spark, monkeypatch):
    for name, value in (("SHARD_IDS", 3000), ("STEPS", 1), ("BATCH", 8)):
        monkeypatch.setattr(lm, name, value)
    cycle = ["an", "er", "ing", "the"] * 20
    rows = [(i % 290, " ".join(cycle[i % 4 : i % 4 + i % 60])) for i in range(300)] + [(7, None), (7, "")]
    content = lm.read_ranks(PATH)
    coder = lm.encoder(content, public_tokenizers.PATTERN)
    often = {w: 9 for w in (b"an", b"er", b"the")}
    ids, lengths = lm.Words(coder, often).sequences([lm.words_of(t) for _, t in rows])[:2]
    units = np.bincount(ids, minlength=coder.size + 1)
    counts = lm.IdCounts(units, units, np.zeros_like(units), units)
    frequent = spark.sparkContext.broadcast(often)
    coded = lm.code(spark.createDataFrame(rows, "doc_id long, text string"), frequent, content, public_tokenizers.PATTERN, "all").cache()
    near = lm.near_counts(coded.repartition(3), counts)
    assert np.array_equal(near, lm.near_landmarks(ids, lengths, lm.by_frequency(counts), len(units)))
    start = lm.train(counts, np.zeros_like(units), ids[:0], lengths[:0], near=near)
    one, seen = lm.fit(coded.repartition(2), start, len(ids))
    assert seen == len(ids) and all(not np.array_equal(one.weights[k], w) for k, w in start.weights.items())
    assert lm.log_probabilities(one, ids, lengths).mean() > lm.log_probabilities(start, ids, lengths).mean()
    other, _ = lm.fit(coded.repartition(5), start, len(ids))
    assert all(np.allclose(one.weights[k], w, atol=1e-4) for k, w in other.weights.items())
    less, seen = lm.fit(coded.where("doc_id <> 5"), start, len(ids))
    assert seen < len(ids) and any(not np.array_equal(one.weights[k], w) for k, w in less.weights.items())


def test_words_of_a_piece_are_looked_up_once_and_frequent_ones_merged_once(monkeypatch):
    monkeypatch.setattr(lm, "REMEMBERED_WORDS", 0)
    coder, asked, merge = lm.encoder(lm.read_ranks(PATH), public_tokenizers.PATTERN), Counter(), {}
    for name in ("merge", "merge_flat"):
        merge[name] = getattr(coder, name, None)
        monkeypatch.setattr(coder, name, lambda words, name=name: asked.update(words) or merge[name](words), raising=False)
    memory = lm.Words(coder, {b"an": 9, b"thesession": 7})
    texts = [[b"thesession", b"qxq", b"an", b"an"], [], [b"qxq"]]
    for _ in range(3):
        ids, lengths, per_token, tokens, count = memory.sequences(texts)
    assert asked[b" an"] == asked[b" thesession"] == 1 and asked[b" qxq"] == 3
    rare = merge["merge"]([b" qxq"])[0].tolist()
    first = [merge["merge"]([b" " + w])[0][0] for w in (b"thesession", b"an")]
    assert ids.tolist() == [first[0], *rare, first[1], first[1], coder.size, coder.size, *rare, coder.size]
    assert count.tolist() == [7, 0, 9, 9, 0, 0, 0, 0] and tokens.tolist() == [5, 1, 2] and lengths.sum() == per_token.sum() == len(ids)


def test_split_words_equal_the_plain_ones():
    texts = ["", None, " a", "B\x0b\x0cc \x1c\x85\xa0D\x00 ", "İÀ zZ", "\t\n\r ", "x" * 3000, "  q"]
    words, n = lm.split_words(pa.array(texts))
    assert lm.as_bytes(words) == [w for t in texts for w in lm.words_of(t)] and n.tolist() == [len(lm.words_of(t)) for t in texts]
    got = Counter()
    for batch in lm._count_words(iter([pa.record_batch({"text": pa.array(texts * 3)})])):
        for r in batch.to_pylist():
            got[r["word"] and r["word"].encode()] += r["c"]
    assert got == Counter([w for t in texts for w in lm.words_of(t)] * 3 + [None] * 24)


def test_near_landmarks_equal_brute_force():
    rng = np.random.default_rng(6)
    lengths = np.array([1, 30, 2, 9, 60])
    ids = rng.integers(0, 90, lengths.sum())
    order = rng.permutation(90)
    want, text = np.zeros((90, lm.LANDMARKS), np.int64), np.repeat(np.arange(5), lengths)
    for i in range(len(ids)):
        for j in range(max(0, i - lm.NEAR), min(len(ids), i + lm.NEAR + 1)):
            for k in np.flatnonzero(order[: lm.LANDMARKS] == ids[i]) if i != j and text[i] == text[j] else ():
                want[ids[j], k] += 1
    assert np.array_equal(lm.near_landmarks(ids, lengths, order, 90), want)
