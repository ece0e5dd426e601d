"""Toxicity scores from a character n-gram linear classifier whose binary features are scaled by
naive Bayes log-count ratios.

Texts are lower-cased, runs of ASCII white space become one space, and every n-gram of the listed
numbers of characters (code points) is hashed.  Training counts, over a bounded sample of labelled texts, in how
many texts of either label each hash occurs; the log ratio of the smoothed shares scales the
feature; the hashes that tell the labels apart most surely are kept; logistic regression is fitted
to the scaled features.  Scoring visits whole texts.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm.arrow import map_pieces, pieces
from tracewright.llm.common import give_back_memory, hold, id_hash_mod

LENGTHS = (3, 4, 5, 6)
BITS = 20
#: Bounds of the training sample: rows, chosen by a hash of their id, and bytes of their texts.
MAX_ROWS, MAX_BYTES = 5_000, 20_000_000
MAX_FEATURES = 4000
THRESHOLD = 0.7
_SPACE = re.compile(r"[\x09-\x0d\x20]+")


def _clean(text: str | None) -> str:
    return " " + _SPACE.sub(" ", (text or "").lower()) + " "


def grams(texts: list[str | None], table: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text number, hash) pairs, sorted. With a table of feature numbers by hash, pairs of
    (text number, feature number) for the hashes that have one."""
    raw = [_clean(t) for t in texts]
    data = np.frombuffer("".join(raw).encode("utf-32-le"), np.uint32)
    ends = np.cumsum([len(x) for x in raw])
    owner = np.repeat(np.arange(len(raw)), [len(x) for x in raw])
    left = ends[owner] - np.arange(len(data))  # characters up to the end of the own text
    codes, h = [], np.zeros(len(data), np.uint32)
    for k in range(max(LENGTHS)):
        h = h[: len(data) - k] * np.uint32(0x01000193) + data[k:] + np.uint32(1)
        if k + 1 in LENGTHS:
            mixed = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D + 2 * k)
            slot = (mixed >> np.uint32(32 - BITS)).astype(np.int64)
            inside = left[: len(slot)] > k
            if table is None:
                codes.append((owner[: len(slot)][inside] << BITS) | slot[inside])
            else:
                feature = table[slot]
                inside &= feature >= 0
                codes.append((owner[: len(slot)][inside] << BITS) | feature[inside])
    pairs = np.sort(np.concatenate(codes))
    pairs = pairs[np.diff(pairs, prepend=-1) != 0]
    return pairs >> BITS, pairs & ((1 << BITS) - 1)


@dataclass
class Model:
    """``table``: feature number of each hash, -1 for none; ``weights``: by feature; ``bias``."""

    table: np.ndarray
    weights: np.ndarray
    bias: float

    def score(self, texts: list[str | None]) -> np.ndarray:
        row, feature = grams(texts, self.table)
        z = self.bias + np.bincount(row, self.weights[feature], minlength=len(texts))
        return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def fit(batches: list[pa.RecordBatch], steps: int = 120, ridge: float = 2e-4, smoothing: float = 0.5) -> Model:
    """Batches of (text, toxic). With one label only, or no rows, every score is the smoothed share of label 1."""
    total, seen = np.zeros((2, 1 << BITS)), np.zeros(2)
    parts = [p for b in batches for p in pieces(b, limit=1 << 20)]
    for p in parts:
        y = np.array(p.column("toxic").to_pylist(), np.int64)
        row, slot = grams(p.column("text").to_pylist())
        for label in (0, 1):
            total[label] += np.bincount(slot[y[row] == label], minlength=1 << BITS)
            seen[label] += (y == label).sum()
    prior = (seen[1] + 0.5) / (seen.sum() + 1)
    bias = float(np.log(prior / (1 - prior)))
    empty = Model(np.full(1 << BITS, -1, np.int32), np.zeros(1), bias)
    if not seen.all():
        return empty
    share = (total + smoothing) / (seen[:, None] + 2 * smoothing)
    ratio = np.log(share[1] / share[0])
    spread = np.sqrt(1 / (total[1] + smoothing) + 1 / (total[0] + smoothing))
    surety = np.where(total.sum(axis=0) >= 3, np.abs(ratio) / spread, 0)
    chosen = np.argsort(-surety, kind="stable")[:MAX_FEATURES]
    chosen = chosen[surety[chosen] > 2]
    if not len(chosen):
        return empty
    table = empty.table
    table[chosen] = np.arange(len(chosen))
    scale = ratio[chosen]
    rows, columns, labels, n = [], [], [], 0
    for p in parts:
        row, feature = grams(p.column("text").to_pylist(), table)
        rows.append(row + n)
        columns.append(feature)
        labels += p.column("toxic").to_pylist()
        n += p.num_rows
    row, column, y = np.concatenate(rows), np.concatenate(columns), np.array(labels, float)
    value = scale[column]
    w, speed, size, b, b_speed, b_size = np.zeros(len(chosen)), np.zeros(len(chosen)), np.zeros(len(chosen)), bias, 0.0, 0.0
    for step in range(1, steps + 1):  # Adam on the full sample
        z = b + np.bincount(row, value * w[column], minlength=n)
        error = (1 / (1 + np.exp(-np.clip(z, -60, 60))) - y) / n
        g = np.bincount(column, value * error[row], minlength=len(chosen)) + ridge * w
        speed, size = 0.9 * speed + 0.1 * g, 0.999 * size + 0.001 * g * g
        b_speed, b_size = 0.9 * b_speed + 0.1 * error.sum(), 0.999 * b_size + 0.001 * error.sum() ** 2
        rate, up, up2 = 0.1, 1 - 0.9**step, 1 - 0.999**step
        w = w - rate * speed / up / (np.sqrt(size / up2) + 1e-9)
        b = b - rate * b_speed / up / (np.sqrt(b_size / up2) + 1e-9)
    return Model(table, w * scale, float(b))


def training_rows(docs: DataFrame, labels: DataFrame, usable, id_col: str, text_col: str, label_col: str) -> list[pa.RecordBatch]:
    """The bounded sample. Only labels pass through the broadcast, at most ``MAX_ROWS`` of them in
    expectation; repeated ids take their largest label; rows without id or label are left out."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("l_id")).agg(F.max(label_col).cast("int").alias("toxic"))
    known = known.where(usable(F.col("l_id")))
    count = known.count()
    keep = min(1.0, MAX_ROWS / max(1, count))
    place = F.pmod(F.xxhash64(F.col("l_id"), F.lit("sample")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = docs.select(F.col(id_col).alias("l_id"), F.col(text_col).alias("text")).join(F.broadcast(known.where(place < keep)), "l_id").select("text", "toxic", place.alias("place"))
    size = sample.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if size > MAX_BYTES:
        sample = sample.where(F.col("place") < keep * MAX_BYTES / size)
    got = sample.select("text", "toxic").toArrow()
    return got.to_batches()


def score_documents(docs: DataFrame, labels: DataFrame, usable=lambda i: F.lit(True), id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """Every row with its score: doc_id, score (0 to 1) and predicted (score >= 0.7).

    ``usable`` says by id which labels may be learnt from. Null and empty texts score as a text
    without words; repeated rows get one result each; with no usable label of either kind all
    scores are the prior; an empty table gives an empty result; other columns are ignored. Texts are scored
    whole, a piece of many or one long text at a time: a text of n bytes takes up to some 100 n bytes of a
    worker's memory, so one of 20 MB wants 2 GB. Ties do not occur: equal texts have equal scores.
    """
    model = fit(training_rows(docs, labels, usable, id_col, text_col, label_col))
    give_back_memory()

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        hold("toxicity")
        score = model.score(batch.column("text").to_pylist())
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))], ["doc_id", "score", "predicted"])

    kind = docs.schema[id_col].dataType.simpleString()
    return map_pieces(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")), kernel, f"doc_id {kind}, score double, predicted int")


def with_scores(docs: DataFrame, labels: DataFrame, score_col: str, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """All columns of ``docs`` and the score, learnt from every label."""
    model = fit(training_rows(docs, labels, lambda i: F.lit(True), id_col, text_col, label_col))
    give_back_memory()

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        hold("toxicity")
        return batch.append_column(score_col, pa.array(model.score(batch.column(text_col).to_pylist())))

    rest = docs.drop(score_col)
    return map_pieces(rest, kernel, rest.withColumn(score_col, F.lit(0.0)).schema, text_col)


FOLDS, HELD_OUT = 3, 1


def toxicity_query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Scores of all documents, learnt from labels outside the held-out fold."""
    scored = score_documents(docs, labels, lambda i: id_hash_mod(i, FOLDS) != HELD_OUT)
    return scored.select("doc_id", (id_hash_mod(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "score", "predicted")
