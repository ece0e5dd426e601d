"""Language-model scores: a causal self-attention model over subword ids, trained in numpy.

Words are runs without ASCII white space, A-Z lower-cased; the subword ids of a word are those of a
space and the word under a public byte-level vocabulary.  A text is a sequence of ids: the first id of
every frequent word, which its count makes a choice among the words that begin with it, all ids of every
other word, and an end id.  The attention model predicts the class of the next id from the ids before it in a
window.  Ids that start a word and ids that continue one are in different classes; the most frequent
ids are classes of their own, the others are clustered by the ids they occur with.

A word of the training texts has the probability of its first id's class times its share of the
class's words.  The words seen once lend the class their mass for words never seen (Good and Turing),
which are spelled: their first id by its share of the words seen once, the further ids each by
its class and its share of it.  So the words' probabilities after any context add up to one at most.

Nothing is learnt from a sample.  Word counts come from a distributed count of all training texts, id counts from
the word counts, the clusters from pairs of near ids of all training texts.  All weights are trained on all training
texts: hashes deal the texts into shards, whose number grows with the training ids, and each shard's into
``ROUNDS`` rounds.  In a round a shard takes gradient steps over all windows of its texts, in the order of their hashes,
from the model of the round before; the mean of the shards' weights, by their ids, is the round's model.  So the
result does not depend on partitions, but for rounding.  Few texts are gone through several times.  Texts are turned into ids
once, in a table in the shared folder.  Long texts are cut into overlapping windows; every id is scored once, in the first window with
enough context before it.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, replace
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.llm.arrow import pieces, trimmed
from tracewright.llm.bpe import encoder, read_ranks, spread
from tracewright.llm.common import Scratch, give_back_memory, hold, id_hash_mod

WINDOW, STRIDE = 16, 12
DIM, OWN_INPUTS = 16, 1024
#: Classes: of single ids, of clusters of ids that start a word, and of clusters of others.
OWN_CLASSES, START_CLUSTERS, OTHER_CLUSTERS = 24, 16, 8
CLASSES = OWN_CLASSES + START_CLUSTERS + OTHER_CLUSTERS
#: Most frequent ids by which others are clustered, and the distance that counts as near.
LANDMARKS, NEAR = 48, 8
#: Bound of the words whose counts are broadcast.
FREQUENT_WORDS = 200_000
#: No text is sampled; a test still sets the name.
SAMPLE_TEXTS = 0
#: Least count of a frequent word, so that at any size some words are spelled as unseen ones will be.
LEAST_COUNT = 5
#: What an id that is never met in its part counts for.
UNMET = 0.05
#: Least steps in all, windows in a step, and the rate of the first half of them.
STEPS, BATCH, RATE = 400, 256, 0.01
#: Rounds over disjoint parts of all training texts (one where there is one shard), ids of a shard over all rounds, and
#: ids that are held at once (all, where texts are gone through several times).
ROUNDS, SHARD_IDS, HELD_IDS = 4, 4_000_000, STEPS * BATCH * STRIDE
#: Bounds of what a worker holds: words counted in pieces before they are sent on (some 25 bytes each), words with their
#: ids, and bytes of text that are split at once.
COUNTED_WORDS, REMEMBERED_WORDS, CODED_BYTES = 1_000_000, 400_000, 2 << 20
FOLDS, HELD_OUT = 7, 2


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


# --- corpus counts ------------------------------------------------------------------------------------


def as_bytes(words: pa.Array) -> list[bytes]:
    return words.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist()


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts in one array, as ``words_of`` gives them, and how many each text has."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts.cast(pa.string()), "")))
    flat = lists.flatten()
    real = pc.binary_length(flat).to_numpy() > 0  # white space at either end splits off nothing
    return flat.filter(pa.array(real)), np.add.reduceat(real.astype(np.int64), lists.offsets.to_numpy()[:-1])


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows(held: list[pa.Table], texts: int) -> Iterator[pa.RecordBatch]:
        sums = pa.concat_tables(held).group_by("word", use_threads=False).aggregate([("c", "sum")]).rename_columns(["word", "c"])
        yield from sums.select(["word", "c"]).to_batches()
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.string()), pa.array([texts], pa.int64())], ["word", "c"])

    held, n, texts = [], 0, 0
    for batch in batches:
        for piece in pieces(batch, limit=CODED_BYTES):
            found = pc.value_counts(split_words(piece.column("text"))[0])
            held.append(pa.table({"word": found.field("values"), "c": found.field("counts")}))
            n, texts = n + len(found), texts + piece.num_rows
            if n > COUNTED_WORDS:
                yield from rows(held, texts)
                held, n, texts = [], 0, 0
    if texts:
        yield from rows(held, texts)


def word_counts(texts: DataFrame) -> DataFrame:
    """word, c over all texts; the null word is the end of a text."""
    return texts.select("text").mapInArrow(trimmed(_count_words), "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


@dataclass
class IdCounts:
    """By id, the end last: ``units`` in the sequences of all texts, ``words`` that begin with it,
    ``once`` of those seen once, ``inner`` places after a word's first in words that are spelled."""

    units: np.ndarray
    words: np.ndarray
    once: np.ndarray
    inner: np.ndarray


def id_counts(counts: DataFrame, least: int, content: bytes, pattern: str) -> IdCounts:
    """Corpus counts of every subword id; words of a level below ``least`` are spelled. At most four rows
    per id reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(content, pattern)
        total = np.zeros((4, coder.size + 1), np.int64)
        for batch in batches:
            for part in pieces(batch, "word"):
                c, spelled = part.column("c").to_numpy(), part.column("level").to_numpy() < least
                is_word = part.column("word").is_valid().to_numpy(zero_copy_only=False)
                total[0, -1] += c[~is_word].sum()
                flat, length = coder.merge_flat([b" " + w for w in as_bytes(part.column("word").drop_null())])
                c, spelled, first = c[is_word], spelled[is_word], np.cumsum(length) - length
                np.add.at(total[1], flat[first], c)
                np.add.at(total[2], flat[first], c == 1)
                inner = np.repeat(spelled, length)
                inner[first] = False
                np.add.at(total[3], flat[inner], np.repeat(c, length)[inner])
        total[0] += total[1] + total[3]
        kind, seen = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(seen), pa.array(total[kind, seen])], ["kind", "id", "c"])

    got = counts.select("word", "c", _level().alias("level")).mapInArrow(run, "kind long, id long, c long").groupBy("kind", "id").agg(F.sum("c").alias("c")).toArrow()
    out = np.zeros((4, encoder(content, pattern).size + 1), np.int64)
    out[got.column("kind").to_numpy(), got.column("id").to_numpy()] = got.column("c").to_numpy()
    return IdCounts(*out)


def _level() -> Column:
    """A word's count in steps of 2^(1/4)."""
    return F.floor(F.log2("c") * 4).cast("int")


def frequent_words(counts: DataFrame) -> tuple[dict[bytes, int], int]:
    """The most frequent words with their counts, ``FREQUENT_WORDS`` at most: all from the least level on
    that few enough words reach, and ``LEAST_COUNT`` at least; and that level."""
    sizes = {r[0]: r[1] for r in counts.where("word is not null").groupBy(_level().alias("l")).agg(F.count(F.lit(1))).collect()}
    total, least = 0, math.floor(math.log2(LEAST_COUNT) * 4)
    for lv in sorted(sizes, reverse=True):
        if total + sizes[lv] > FREQUENT_WORDS:
            least = max(least, lv + 1)
            break
        total += sizes[lv]
    got = counts.where(F.col("word").isNotNull() & (_level() >= least)).select("word", "c").toArrow().sort_by([("c", "descending")])  # those used most lie together
    return dict(zip((w.encode() for w in got.column("word").to_pylist()), got.column("c").to_pylist(), strict=True)), least


# --- the model ------------------------------------------------------------------------------------------


@dataclass
class Model:
    """``weights``: by name; ``kind``: class of each id; ``share``: log10 share of an id in its class (where
    it starts a word: of words never seen); ``mass``: log10 of the class's words and the mass lent to
    words never seen; ``entry``: input row of each id (the row after them all is the start)."""

    weights: dict[str, np.ndarray]
    kind: np.ndarray
    share: np.ndarray
    mass: np.ndarray
    entry: np.ndarray


def near_landmarks(ids: np.ndarray, lengths: np.ndarray, order: np.ndarray, size: int) -> np.ndarray:
    """How often each id occurs within ``NEAR`` places of each landmark, the most frequent ids."""
    place = np.full(size, -1)
    place[order[:LANDMARKS]] = np.arange(min(LANDMARKS, size))
    # texts are laid NEAR places of no id apart, so no id is near those of another text
    laid = np.full(len(ids) + NEAR * (len(lengths) + 1), size * LANDMARKS, np.int64)
    where = np.arange(len(ids)) + np.repeat(NEAR * np.arange(1, len(lengths) + 1), lengths)
    laid[where] = ids.astype(np.int64) * LANDMARKS
    mark = place[ids]
    at = np.flatnonzero(mark >= 0)
    at, mark = where[at], mark[at]
    found, met = np.zeros((size + 1) * LANDMARKS, np.int64), np.empty((NEAR, len(at)), np.int64)
    for sign in (-1, 1):
        for d in range(1, NEAR + 1):
            met[d - 1] = laid[at + sign * d]
        met += mark
        found += np.bincount(met.ravel(), minlength=len(found))
    return found[: size * LANDMARKS].reshape(size, LANDMARKS)


def clusters(profile: np.ndarray, weight: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Cluster of each row by the direction of its profile; rows without one are in cluster 0."""
    norm = np.linalg.norm(profile, axis=1)
    known = np.flatnonzero(norm > 0)
    out = np.zeros(len(profile), np.int64)
    if not len(known) or k < 2:
        return out
    x = profile[known] / norm[known, None]
    heavy = np.argsort(-weight[known], kind="stable")
    centres = [x[heavy[0]]]  # spread out: each next one is the heavy row farthest from those before
    for _ in range(k - 2):
        distance = 1 - np.max(x @ np.array(centres).T, axis=1)
        centres.append(x[np.argmax(distance * np.sqrt(weight[known]))])
    centres = np.array(centres)
    for _ in range(rounds):
        mine = np.argmax(x @ centres.T, axis=1)
        for c in range(len(centres)):
            total = (x[mine == c] * weight[known][mine == c, None]).sum(axis=0)
            if total.any():
                centres[c] = total / np.linalg.norm(total)
    out[known] = 1 + np.argmax(x @ centres.T, axis=1)
    return out


def by_frequency(counts: IdCounts) -> np.ndarray:
    return np.argsort(-counts.units, kind="stable")


def classes(counts: IdCounts, starts_word: np.ndarray, near: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Class, share, mass and input row of each id. The most frequent ids and the end stand alone; the others are
    clustered by how much more often than usual they occur near each landmark."""
    size, order = len(counts.units), by_frequency(counts)
    place = np.empty(size, np.int64)
    place[order] = np.arange(size)
    own = place < OWN_CLASSES - 1
    weight = near.sum(axis=1)
    usual = (near.sum(axis=0) + 1.0) / (weight.sum() + LANDMARKS)
    profile = np.where(weight[:, None] >= 5, np.sqrt((near + 4 * usual) / (weight[:, None] + 4)) - np.sqrt(usual), 0.0)
    kind = np.empty(size, np.int64)
    for starts, k, first in ((1, START_CLUSTERS, OWN_CLASSES), (0, OTHER_CLUSTERS, OWN_CLASSES + START_CLUSTERS)):
        mine = np.flatnonzero((starts_word == starts) & ~own)
        kind[mine] = first + clusters(profile[mine], weight[mine].astype(float), k)
    kind[own] = place[own]
    kind[-1] = OWN_CLASSES - 1
    unseen = counts.once + UNMET  # the mass of words never seen
    begins = starts_word == 1
    piece = np.where(begins, unseen, counts.inner + UNMET)
    total = np.bincount(kind, np.where(begins, counts.words + unseen, piece), CLASSES)
    share, mass = np.log10(piece / total[kind]), np.log10(np.maximum(total, 1e-300))[kind]
    share[-1] = 0.0
    entry = np.where(place < OWN_INPUTS, place, OWN_INPUTS + kind)
    return kind, share, mass, entry


def softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(axis=-1, keepdims=True))
    x /= x.sum(axis=-1, keepdims=True)
    return x


MASK = np.triu(np.full((WINDOW, WINDOW), -1e9, np.float32), 1)


def forward(w: dict[str, np.ndarray], entry: np.ndarray) -> tuple[np.ndarray, tuple]:
    """Class logits (windows, places, classes) of windows of input rows, with what backward needs. The plain form of
    the model, which tests hold ``states`` and ``gradients`` against."""
    x = w["in"][entry] + w["place"]
    q, k, v = x @ w["q"], x @ w["k"], x @ w["v"]
    a = softmax(q @ k.transpose(0, 2, 1) * np.float32(DIM**-0.5) + MASK)
    m = a @ v
    h = x + m @ w["o"]
    t = np.tanh(h)
    return t @ w["out"] + w["bias"], (x, q, k, v, a, m, t)


def backward(w: dict[str, np.ndarray], entry: np.ndarray, saved: tuple, d: np.ndarray) -> dict[str, np.ndarray]:
    """Gradients of the weights from that of the logits."""
    x, q, k, v, a, m, t = saved
    flat = lambda y: y.reshape(-1, y.shape[-1])
    g = {"out": flat(t).T @ flat(d), "bias": flat(d).sum(axis=0)}
    dh = d @ w["out"].T * (1 - t * t)
    g["o"] = flat(m).T @ flat(dh)
    dm = dh @ w["o"].T
    da, dv = dm @ v.transpose(0, 2, 1), a.transpose(0, 2, 1) @ dm
    ds = a * (da - (da * a).sum(axis=-1, keepdims=True)) * np.float32(DIM**-0.5)
    dq, dk = ds @ k, ds.transpose(0, 2, 1) @ q
    g["q"], g["k"], g["v"] = flat(x).T @ flat(dq), flat(x).T @ flat(dk), flat(x).T @ flat(dv)
    dx = dh + dq @ w["q"].T + dk @ w["k"].T + dv @ w["v"].T
    g["place"] = dx.sum(axis=0)
    g["in"] = np.zeros_like(w["in"])
    np.add.at(g["in"], entry.ravel(), flat(dx))
    return g


def windows(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For sequences of the given lengths, laid end to end: places of each window, -1 past the end,
    and which of them the window scores."""
    n = 1 + np.maximum(0, -(-(lengths - WINDOW) // STRIDE))
    begin = np.cumsum(lengths) - lengths
    number = spread(np.zeros(len(n), np.int64), n)
    at = number[:, None] * STRIDE + np.arange(WINDOW)
    inside = at < np.repeat(lengths, n)[:, None]
    scored = inside & ((number == 0)[:, None] | (np.arange(WINDOW) >= WINDOW - STRIDE))
    return np.where(inside, at + np.repeat(begin, n)[:, None], -1), scored


def inputs_of(model: Model, ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Input row before each id: the start at a sequence's first."""
    before = np.empty(len(ids), np.int64)
    before[1:] = model.entry[ids[:-1]]
    before[np.cumsum(lengths) - lengths] = OWN_INPUTS + CLASSES
    return before


def maps(w: dict[str, np.ndarray]) -> np.ndarray:
    """The linear maps from an input to state, query, key and mixed value, side by side."""
    return np.concatenate([np.eye(DIM), w["q"] * DIM**-0.5, w["k"], w["v"] @ w["o"]], axis=1).astype(np.float32)


def tables(w: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """What an input row and a place each add to state, query, key and mixed value: every map before
    the attention weights is linear, so scoring looks its results up."""
    m = maps(w)
    return w["in"] @ m, w["place"] @ m


#: Exponents stay in the range of 32-bit floats.
LEAST, MOST = np.float32(-60), np.float32(60)
CAUSAL = np.tril(np.ones((WINDOW, WINDOW), np.float32))


def states(model: Model, ids: np.ndarray, lengths: np.ndarray, chunk: int = 512) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of ids of sequences laid end to end, each once, and the state that predicts each, with a one."""
    before = inputs_of(model, ids, lengths)
    place, scored = windows(lengths)
    by_entry, by_place = (np.concatenate([x, np.full((len(x), 1), one, np.float32)], axis=1) for x, one in zip(tables(model.weights), (1, 0), strict=True))
    for a in range(0, len(place), chunk):
        p, at = place[a : a + chunk], np.flatnonzero(scored[a : a + chunk])
        g = np.take(by_entry, np.where(p < 0, OWN_INPUTS + CLASSES, before[p]), axis=0)
        g += by_place
        x, q, k, v = (g[..., i * DIM : (i + 1) * DIM + i // 3] for i in range(4))  # the values and a one
        e = q @ k.transpose(0, 2, 1)
        np.exp(np.clip(e, LEAST, MOST, out=e), out=e)
        e *= CAUSAL
        m = e @ v
        h = m[..., :DIM] / m[..., DIM:]
        h += x
        t = np.ones((len(at), DIM + 1), np.float32)
        np.tanh(h.reshape(-1, DIM)[at], out=t[:, :DIM])
        yield p.ravel()[at], t


def exponents(t: np.ndarray, w: dict[str, np.ndarray]) -> np.ndarray:
    """Class logits of states with a one each, in the range of exponents."""
    z = t @ np.concatenate([w["out"], w["bias"][None]])
    if (np.abs(w["out"]).sum(axis=0) + np.abs(w["bias"])).max() > MOST:  # states are within -1 and 1
        np.clip(z, LEAST, MOST, out=z)
    return z


def log_probabilities(model: Model, ids: np.ndarray, lengths: np.ndarray, chunk: int = 512) -> np.ndarray:
    """log10 probability of every id of sequences laid end to end."""
    kind, out, ones = model.kind[ids], np.empty(len(ids)), np.ones(CLASSES, np.float32)
    for target, t in states(model, ids, lengths, chunk):
        z = exponents(t, model.weights)
        hit = z[np.arange(len(z)), kind[target]]
        out[target] = (hit - np.log(np.exp(z, out=z) @ ones)) / math.log(10)
    return out + model.share[ids]


def train(counts: IdCounts, starts_word: np.ndarray, ids: np.ndarray, lengths: np.ndarray, steps: int = STEPS, near: np.ndarray | None = None) -> Model:
    """Fits the weights to sequences in memory with Adam; without any they stay as drawn. ``near``: counts near
    landmarks, where they are not those of the sequences."""
    if near is None:
        near = near_landmarks(ids, lengths, by_frequency(counts), len(counts.units))
    kind, share, mass, entry = classes(counts, starts_word, near)
    rng = np.random.default_rng(7)
    shapes = {"in": (OWN_INPUTS + CLASSES + 1, DIM), "place": (WINDOW, DIM), "q": (DIM, DIM), "k": (DIM, DIM), "v": (DIM, DIM), "o": (DIM, DIM), "out": (DIM, CLASSES)}
    w = {k: rng.normal(0, 0.3 if k == "in" else DIM**-0.5 / 2, s).astype(np.float32) for k, s in shapes.items()}
    w["bias"] = np.log(np.bincount(kind, counts.units, CLASSES) + 1.0).astype(np.float32)
    w["bias"] -= w["bias"].max()
    model = Model(w, kind, share, mass, entry)
    if not len(ids):
        return model
    before, (place, scored) = inputs_of(model, ids, lengths), windows(lengths)
    adam = Adam(model)
    for step in range(1, steps + 1):
        rows = rng.integers(0, len(place), BATCH)
        adam.step(ids, before, place[rows], scored[rows], RATE * min(1.0, 2 * (1 - step / (steps + 1))))
    return model


def gradients(model: Model, entry: np.ndarray, targets: np.ndarray, scored: np.ndarray) -> dict[str, np.ndarray]:
    """Gradients of the mean negative log likelihood of the scored places, as ``backward`` gives them, by way of
    what input rows and places add (``maps``)."""
    w, (n, _) = model.weights, entry.shape
    m = maps(w)
    g = np.take(w["in"] @ m, entry, axis=0)
    g += w["place"] @ m
    x, q, k, v = (g[..., i * DIM : (i + 1) * DIM] for i in range(4))
    a = q @ k.transpose(0, 2, 1)
    np.exp(np.clip(a, LEAST, MOST, out=a), out=a)
    a *= CAUSAL
    a /= a @ np.ones((WINDOW, 1), np.float32)
    h = a @ v
    h += x
    at = np.flatnonzero(scored)
    t = np.ones((len(at), DIM + 1), np.float32)
    np.tanh(h.reshape(-1, DIM)[at], out=t[:, :DIM])
    p = exponents(t, w)
    np.exp(p, out=p)
    p *= np.float32(1 / max(1, len(at))) / (p @ np.ones((CLASSES, 1), np.float32))
    p[np.arange(len(at)), model.kind[targets.ravel()[at]]] -= np.float32(1 / max(1, len(at)))
    of_out = t.T @ p
    t = t[:, :DIM]
    dh = np.zeros((n * WINDOW, DIM), np.float32)
    dh[at] = p @ w["out"].T * (1 - t * t)
    dh = dh.reshape(n, WINDOW, DIM)
    d = np.empty((n, WINDOW, 4 * DIM), np.float32)
    d[..., :DIM] = dh
    da = dh @ v.transpose(0, 2, 1)
    da *= a
    da -= a * (da @ np.ones((WINDOW, 1), np.float32))
    np.matmul(da, k, out=d[..., DIM : 2 * DIM])
    np.matmul(da.transpose(0, 2, 1), q, out=d[..., 2 * DIM : 3 * DIM])
    np.matmul(a.transpose(0, 2, 1), dh, out=d[..., 3 * DIM :])
    d = d.reshape(-1, 4 * DIM)
    dx, (gq, gk, gv) = d @ m.T, np.split(x.reshape(-1, DIM).T @ d[:, DIM:], 3, axis=1)
    at = (entry.reshape(-1, 1) * DIM + np.arange(DIM)).ravel()
    of_entry = np.bincount(at, dx.ravel(), w["in"].size).astype(np.float32).reshape(w["in"].shape)
    return {"out": of_out[:DIM], "bias": of_out[DIM], "in": of_entry, "place": dx.reshape(n, -1).sum(axis=0).reshape(WINDOW, DIM), "q": gq * np.float32(DIM**-0.5), "k": gk, "v": gv @ w["o"].T, "o": w["v"].T @ gv}


class Adam:
    """Gradient steps on a model's weights, which are changed in place."""

    def __init__(self, model: Model):
        self.model, self.steps = model, 0
        self.flat = np.concatenate([x.ravel() for x in model.weights.values()])
        for (k, x), part in zip(model.weights.items(), np.split(self.flat, np.cumsum([x.size for x in model.weights.values()])[:-1]), strict=True):
            model.weights[k] = part.reshape(x.shape)  # a view
        self.first, self.second = np.zeros_like(self.flat), np.zeros_like(self.flat)

    def step(self, ids: np.ndarray, before: np.ndarray, p: np.ndarray, s: np.ndarray, rate: float) -> None:
        """One step on windows with places ``p``, of which ``s`` are scored."""
        w, first, second = self.model.weights, self.first, self.second
        self.steps += 1
        one, two = np.float32(rate / (1 - 0.9**self.steps)), np.float32(1 / (1 - 0.99**self.steps))
        of = gradients(self.model, np.where(p < 0, OWN_INPUTS + CLASSES, before[p]), ids[p], s)
        g = np.concatenate([of[k].ravel() for k in w])
        first += np.float32(0.1) * (g - first)
        g *= g
        g -= second
        g *= np.float32(0.01)
        second += g
        np.sqrt(np.multiply(second, two, out=g), out=g)
        g += np.float32(1e-8)
        self.flat -= one * first / g


class Shard:
    """One round of a shard: gradient steps over all windows of its texts, as they come. What it holds at once
    depends on the order of its texts alone, not on how they reach it."""

    def __init__(self, start: Model, turn: int, rounds: int, expected: float, epochs: int):
        self.adam = Adam(replace(start, weights={k: v.copy() for k, v in start.weights.items()}))
        self.turn, self.rounds, self.expected, self.epochs = turn, rounds, expected, epochs
        self.texts: list[np.ndarray] = []
        self.held = self.seen = 0
        self.rng = np.random.default_rng(7)

    def add(self, ids: np.ndarray) -> None:
        self.texts.append(ids)
        self.held += len(ids)
        if self.held >= HELD_IDS:
            self._learn()

    def _learn(self) -> None:
        ids, lengths = np.concatenate(self.texts), np.fromiter(map(len, self.texts), np.int64, len(self.texts))
        before, (place, scored) = inputs_of(self.adam.model, ids, lengths), windows(lengths)
        steps = max(1, round(len(place) / BATCH))
        for epoch in range(self.epochs):
            for i, rows in enumerate(np.array_split(self.rng.permutation(len(place)), steps)):
                met = self.seen + len(ids) * (epoch + i / steps) / self.epochs
                done = (self.turn + min(1.0, met / self.expected)) / self.rounds
                self.adam.step(ids, before, place[rows], scored[rows], RATE * min(1.0, max(0.02, 2 * (1 - done))))
        self.seen += len(ids)
        self.texts, self.held = [], 0

    def result(self) -> pa.RecordBatch:
        """The weights by their places, times the ids seen, and these last."""
        if self.held:
            self._learn()
        values = np.concatenate([*(x.ravel() for x in self.adam.model.weights.values()), [1.0]]) * self.seen
        return pa.RecordBatch.from_arrays([pa.array(np.arange(len(values), dtype=np.int32)), pa.array(values)], ["at", "v"])


def fit(coded: DataFrame, model: Model, total: int) -> tuple[Model, int]:
    """The model with all weights trained on all sequences of a coded table with ``total`` ids, and the number of ids
    it saw. A text takes part in one round of one shard, with all its ids. A row for each weight (some
    19,000) reaches the driver each round."""
    spark, form = coded.sparkSession, id_form(len(model.kind))
    shards = max(1, -(-total // SHARD_IDS))
    rounds = ROUNDS if shards > 1 else 1
    expected, epochs, seen = max(1.0, total / shards / rounds), math.ceil(STEPS / max(1, total / STRIDE / BATCH)), 0
    dealt = coded.select("ids", F.xxhash64("doc_id", "ids").alias("h")).withColumn("shard", F.pmod(F.shiftright("h", 8), F.lit(shards)))
    for turn in range(rounds):
        start = spark.sparkContext.broadcast(model)

        def run(batches: Iterator[pa.RecordBatch], start=start, turn=turn) -> Iterator[pa.RecordBatch]:
            forget_words()
            own, number = None, -1
            for batch in batches:
                for shard, ids in zip(batch.column("shard").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                    if shard != number:
                        if own is not None:
                            yield own.result()
                        own, number = Shard(start.value, turn, rounds, expected, epochs), shard
                    own.add(np.frombuffer(ids, form))
            if own is not None:
                yield own.result()

        mine = dealt.where(F.pmod("h", F.lit(rounds)) == turn).repartition(shards, "shard").sortWithinPartitions("shard", "h", "ids").select("shard", "ids")
        got = mine.mapInArrow(trimmed(run), "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).toArrow()
        start.unpersist()
        if not got.num_rows:
            continue
        sums = np.zeros(got.num_rows)
        sums[got.column("at").to_numpy()] = got.column("v").to_numpy()
        seen += round(sums[-1])
        ends = np.cumsum([x.size for x in model.weights.values()])[:-1]
        parts = np.split(sums[:-1] / sums[-1], ends)
        model = replace(model, weights={k: x.reshape(w.shape).astype(np.float32) for (k, w), x in zip(model.weights.items(), parts, strict=True)})
    return model, seen


def fit_output(learn: DataFrame, model: Model, frequent: Broadcast, content: bytes, pattern: str, token: str | None = None) -> tuple[Model, int]:
    """``fit`` on texts: doc_id, text."""
    with Scratch(learn.sparkSession, "lm") as scratch:
        coded = scratch.write(code(learn, frequent, content, pattern, token or uuid.uuid4().hex), "coded")
        total = coded.agg(F.coalesce(F.sum(F.octet_length("ids")), F.lit(0))).first()[0] // id_form(len(model.kind)).itemsize
        return fit(coded, model, total)


def near_counts(coded: DataFrame, counts: IdCounts) -> np.ndarray:
    """``near_landmarks`` of all sequences of a coded table. At most a row per id and landmark reaches the driver."""
    order, size = by_frequency(counts), len(counts.units)
    form = id_form(size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_words()
        found, held, n = np.zeros((size, LANDMARKS), np.int64), [], 0
        for batch in batches:
            for ids in batch.column("ids").to_pylist():
                held.append(np.frombuffer(ids, form))
                n += len(held[-1])
                if n >= HELD_IDS:
                    found += near_landmarks(np.concatenate(held), np.fromiter(map(len, held), np.int64, len(held)), order, size)
                    held, n = [], 0
        if held:
            found += near_landmarks(np.concatenate(held), np.fromiter(map(len, held), np.int64, len(held)), order, size)
        flat = found.ravel()
        at = np.flatnonzero(flat)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(flat[at])], ["at", "c"])

    got = coded.select("ids").mapInArrow(trimmed(run), "at int, c long").groupBy("at").agg(F.sum("c").alias("c")).toArrow()
    out = np.zeros(size * LANDMARKS, np.int64)
    out[got.column("at").to_numpy()] = got.column("c").to_numpy()
    return out.reshape(size, LANDMARKS)


class _Numbers(dict):
    """Numbers words from 1 as they are first asked for, and lists those since ``new`` was emptied."""

    def __init__(self, numbers: Iterable[tuple[bytes, int]]):
        super().__init__(numbers)
        self.new: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self) + 1
        self.new.append(word)
        return number


class Words:
    """A worker's memory of words: their numbers, ids in a sequence and, for frequent words, counts. Frequent words are
    merged once and stay; the others are forgotten when there are too many."""

    def __init__(self, coder, frequent: dict[bytes, int]):
        self.coder, self.frequent = coder, frequent
        ids, length = coder.merge_flat([b" " + w for w in frequent])
        # the first ids of all frequent words, which are never forgotten, and their counts; number 0 is the end
        self.kept = np.concatenate([[coder.size], ids[np.cumsum(length) - length]]).astype(np.int32), np.array([0, *frequent.values()], np.int64)
        self._forget()

    def _forget(self) -> None:
        self.number = _Numbers(zip(self.frequent, range(1, len(self.frequent) + 1), strict=True))
        self.ids, self.count = self.kept
        self.start, self.length = np.arange(len(self.ids)), np.ones(len(self.ids), np.int64)

    def sequences(self, texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        return self.coded(pa.array(list(chain.from_iterable(texts)), pa.binary()), np.array([len(t) for t in texts]))

    def coded(self, words: pa.Array, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all texts with their ends, ids per text, ids per token, tokens per text, count per token (0: not frequent),
        of texts with so many of the words each. A word is looked up once."""
        if len(self.number) > REMEMBERED_WORDS:
            self._forget()
        met = words.dictionary_encode()
        number = np.fromiter(map(self.number.__getitem__, as_bytes(met.dictionary)), np.int64, len(met.dictionary))
        new, self.number.new = self.number.new, []
        made, length = self.coder.merge_flat([b" " + w for w in new])
        self.start = np.concatenate([self.start, len(self.ids) + np.cumsum(length) - length])
        self.length = np.concatenate([self.length, length])
        self.ids = np.concatenate([self.ids, made])
        self.count = np.concatenate([self.count, np.zeros(len(new), np.int64)])
        tokens = lengths + 1
        numbers = np.zeros(int(tokens.sum()), np.int64)
        inner = np.ones(len(numbers), bool)
        inner[np.cumsum(tokens) - 1] = False
        numbers[inner] = number[met.indices.to_numpy()]
        per_token = self.length[numbers]
        return self.ids[spread(self.start[numbers], per_token)], np.add.reduceat(per_token, np.cumsum(tokens) - tokens), per_token, tokens, self.count[numbers]


_WORDS: dict[str, Words] = {}


def remembered(token: str, content: bytes, pattern: str, frequent: Broadcast) -> Words:
    """A worker's memory of words, kept for all tasks of one run, which ``token`` names."""
    hold("lm", _WORDS.clear)
    if token not in _WORDS:
        _WORDS.clear()
        _WORDS[token] = Words(encoder(content, pattern), frequent.value)
        hold("lm", _WORDS.clear)  # the encoder's cache is held by the words
    return _WORDS[token]


def forget_words() -> None:
    """Drops a worker's memory of words, which the stages after coding need not have beside theirs."""
    _WORDS.clear()


def id_form(size: int) -> np.dtype:
    """How ids below ``size`` are stored."""
    return np.dtype("<u2" if size <= 1 << 16 else "<i4")


def packed(values: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """The bytes of consecutive runs of values, as binary."""
    bounds = np.concatenate([[0], np.cumsum(lengths)]) * values.itemsize
    return pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def unpacked(column: pa.Array, form: np.dtype | str) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), form)


INNER, KNOWN, RARE, END = range(4)
CODED = {"n_tokens": "long", "n_hot": "long", "size": "double", "hot": "double", "ids": "binary", "marks": "binary", "rare": "array<string>"}


def code(rows: DataFrame, frequent: Broadcast, content: bytes, pattern: str, token: str) -> DataFrame:
    """The given columns but for the text, and of each text: tokens, frequent words, log10 of the product of these words'
    counts, and of the counts plus 1, packed ids with a mark for each (``INNER`` or that of the token it begins),
    and the words that are not frequent. Some 5 bytes a token: a batch of texts is held by Spark and by a worker."""
    others = [c for c in rows.columns if c != "text"]
    kinds = [f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in others]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = remembered(token, content, pattern, frequent)
        form = id_form(memory.coder.size + 1)
        for batch in batches:
            for piece in pieces(batch, limit=CODED_BYTES):
                words, n = split_words(piece.column("text"))
                ids, lengths, per_token, tokens, count = memory.coded(words, n)
                at, rare = np.cumsum(tokens) - tokens, count == 0
                rare[at + tokens - 1] = False
                inner = np.ones(len(rare), bool)
                inner[at + tokens - 1] = False
                bounds = np.concatenate([[0], np.cumsum(np.add.reduceat(rare.astype(np.int64), at))]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(bounds), words.filter(pa.array(rare[inner])))
                mark = np.where(count > 0, KNOWN, np.where(rare, RARE, END))
                marks = np.full(len(ids), INNER, np.uint8)
                marks[np.cumsum(per_token) - per_token] = mark
                known = count > 0
                sums = [np.add.reduceat(x, at) for x in (known.astype(np.int64), np.log10(np.maximum(count, 1)), np.where(known, np.log10(count + 1), 0.0))]
                yield pa.RecordBatch.from_arrays([*(piece.column(c) for c in others), *map(pa.array, (tokens, *sums)), packed(ids.astype(form), lengths), packed(marks, lengths), lists], [*others, *CODED])

    return rows.mapInArrow(trimmed(run), ", ".join([*kinds, *(f"{c} {t}" for c, t in CODED.items())]))


def score_texts(docs: DataFrame, training, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row with doc_id, n_tokens, n_known, train_tokens, base_score and score; ``training`` says
    by id which texts may be learnt from.

    Null and empty texts are the end alone; very long texts are cut into windows like others (a text of n bytes
    takes some 100 n bytes of a worker's memory while it is scored); repeated
    rows get one result each; scores do not depend on partitions, but for rounding; ids of equal frequency are ordered by number; a null id counts as
    empty text for the fold; without training texts all counts are 0; an empty table gives an
    empty result; other columns are ignored.
    """
    spark, content = docs.sparkSession, read_ranks(ranks_path)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    with Scratch(spark, "lm") as scratch:
        learn = rows.where(training(F.col("doc_id")))
        counts = scratch.write(word_counts(learn), "counts")
        n, v, ends = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1)), F.coalesce(F.sum(F.when(F.col("word").isNull(), F.col("c"))), F.lit(0))).first()
        v += ends == 0  # the end is a token of the model even without texts
        below = n + v + 1
        coder = encoder(content, pattern)
        starts = np.zeros(coder.size + 1, np.int64)
        starts[[i for b, i in coder.ranks.items() if b[:1] == b" "]] = 1
        often, least = frequent_words(counts)
        token = uuid.uuid4().hex
        frequent = spark.sparkContext.broadcast(often)
        of_ids = id_counts(counts, least, content, pattern)
        fold = F.coalesce(training(F.col("doc_id")), F.lit(False)).alias("learn")
        coded = scratch.write(code(rows.select("doc_id", fold, "text"), frequent, content, pattern, token), "coded")
        frequent.unpersist()
        learnt = coded.where("learn")
        nothing = np.zeros(0, np.int32)
        start = train(of_ids, starts, nothing, nothing, near=near_counts(learnt, of_ids))
        del often
        give_back_memory()
        model, _ = fit(learnt, start, int(of_ids.units.sum()))
        trained, form = spark.sparkContext.broadcast(model), id_form(coder.size + 1)
        names = ["doc_id", "n_tokens", "n_hot", "size", "hot", "rare"]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            forget_words()
            own = trained.value
            for batch in batches:
                for piece in pieces(batch, "ids", limit=1 << 19):
                    ids, marks = unpacked(piece.column("ids"), form), unpacked(piece.column("marks"), np.uint8)
                    logs = log_probabilities(own, ids, pc.binary_length(piece.column("marks")).to_numpy().astype(np.int64))
                    first = np.flatnonzero(marks != INNER)
                    spelled, head, mark = np.add.reduceat(logs, first), ids[first], marks[first]
                    # the class of the first id and one part of the class's words
                    unit = logs[first] - own.share[head] - own.mass[head]
                    tokens, rare = piece.column("n_tokens").to_numpy(), mark == RARE  # these are scored below, where their counts are joined
                    at = np.cumsum(tokens) - tokens
                    score = np.add.reduceat(np.where(mark == KNOWN, unit, np.where(rare, 0.0, spelled)), at)
                    bounds = pa.array(np.concatenate([[0], np.cumsum(np.add.reduceat(rare.astype(np.int64), at))]).astype(np.int32))
                    lists = [pa.ListArray.from_arrays(bounds, pa.array(x[rare].astype(np.float32))) for x in (spelled, unit)]
                    yield pa.RecordBatch.from_arrays([*(piece.column(c) for c in names), pa.array(score), *lists], [*names, "unsized", "spelled", "unit"])

        kind = docs.schema[id_col].dataType.simpleString()
        scores = coded.select(*names, "ids", "marks").mapInArrow(trimmed(run), f"doc_id {kind}, n_tokens long, n_hot long, size double, hot double, rare array<string>, unsized double, spelled array<float>, unit array<float>")
        scored = scratch.write(scores.withColumn("row", F.monotonically_increasing_id()), "scored")  # fixed once it is written
        scratch.drop("coded")
        rare = scored.select("row", F.explode(F.arrays_zip("rare", "spelled", "unit")).alias("e")).select("row", F.col("e.rare").alias("word"), "e.spelled", "e.unit")
        c = F.coalesce("c", F.lit(0))
        model_score = F.when(c > 0, F.col("unit") + F.log10(c)).otherwise(F.col("spelled"))
        sums = rare.join(counts, "word", "left").groupBy("row").agg(F.sum(F.log10((c + 1) / F.lit(float(below)))).alias("tail"), F.sum(model_score).alias("tail_score"), F.count(F.when(c > 0, 1)).alias("n_tail"))
        out = scored.drop("rare", "spelled", "unit").join(sums, "row", "left")
        # frequent words and the end, whose counts are above 0 with any training text
        n_hot, base = F.col("n_hot") + int(ends > 0), F.col("hot") - F.col("n_hot") * math.log10(below) + math.log10((ends + 1) / below)
        out = out.select("doc_id", "n_tokens", (n_hot + F.coalesce("n_tail", F.lit(0))).cast("long").alias("n_known"), F.lit(n).cast("long").alias("train_tokens"), (base + F.coalesce("tail", F.lit(0.0))).alias("base_score"), (F.col("unsized") + F.col("size") + F.coalesce("tail_score", F.lit(0.0))).alias("score"))
        return scratch.keep(out, "result")


def lm_query(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    scored = score_texts(docs, lambda i: id_hash_mod(i, FOLDS) != HELD_OUT, ranks_path, pattern)
    return scored.withColumn("held_out", id_hash_mod(F.col("doc_id"), FOLDS) == HELD_OUT)
