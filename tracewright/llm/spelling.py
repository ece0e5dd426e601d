"""Spelling variants among the words of a corpus: words one edit apart, the rarer pointing to the frequent.

Two words are near when one code point is inserted, deleted or replaced.  If the shorter has ``a``
characters, one edit leaves one of its halves intact at an end, so the two share a prefix or a suffix of
``a // 2`` characters.  The dictionary is sorted forward and reversed at once: every word stands, for its
own length and for the one below, in the block of its prefix and in that of its suffix, and blocks are ranges of
one sorted table that tasks scan in a stream.

A block of more than ``BLOCK`` words is subdivided by the same argument on what its words do not share:
half of that middle stays intact, so each word goes on to one block that extends the shared prefix and to one
that extends the shared suffix, until blocks are small or nothing is left to share.  Blocks are counted before
they are scanned, so no task gathers a large one.  A pair is accepted in one block only: of the two halves
that may be intact, the prefix counts first.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.llm.arrow import pieces, trimmed
from tracewright.llm.common import Scratch

RUNS = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: Least code points and occurrences of a word; how much more frequent a form is.
LEAST_LENGTH, LEAST_COUNT, RATIO = 6, 5, 5
#: One in so many runs loses a character.
DAMAGED = 199
#: Words of a block that are compared directly; different words that a task counts at once.
BLOCK, COUNTED = 64, 400_000
#: Characters of a text that are searched for runs at once.
WINDOW = 1 << 20
#: A bound that no shared prefix reaches.
ANY = 2**31 - 1


def windows(text: str) -> Iterator[str]:
    """The text in parts that end where no run does."""
    at = 0
    while at < len(text):
        end = at + WINDOW
        if end < len(text):
            run = RUNS.match(text, end)
            end = run.end() if run else end
        yield text[at:end]
        at = end


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words and their occurrences in a task's texts; a word may be reported in several rows."""
    seen: Counter[str] = Counter()
    rows = lambda: pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])
    for batch in batches:
        for piece in pieces(batch):
            for key, text in zip(piece.column("doc_id").to_pylist(), piece.column("text").to_pylist(), strict=True):
                start = zlib.crc32(f"{'' if key is None else key}:".encode())
                for part in windows((text or "").translate(LOWER)):
                    for run, n in Counter(RUNS.findall(part)).items():
                        # shorter runs cannot become words
                        if len(run) >= LEAST_LENGTH:
                            h = zlib.crc32(run.encode(), start)
                            if h % DAMAGED == 0:
                                run = run[: h % len(run)] + run[h % len(run) + 1 :]
                                if len(run) < LEAST_LENGTH:
                                    continue
                            seen[run] += n
                if len(seen) > COUNTED:
                    yield rows()
                    seen.clear()
    if seen:
        yield rows()


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n) of all words of whole texts that are long and frequent enough."""
    texts = docs.select(F.col(id_col).cast("string").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return texts.mapInArrow(trimmed(_tally), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


def lcp(x: str, y: str) -> int:
    """Length of the longest shared prefix."""
    n = min(len(x), len(y))
    if x[:n] == y[:n]:
        return n
    low, high = 0, n - 1  # the shared prefix has low characters at least, high at most
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if x[:mid] == y[:mid] else (low, mid - 1)
    return low


def near(x: str, y: str) -> int | None:
    """The shared prefix's length if one edit leads from one to the other, else None."""
    if x == y:
        return None
    p = lcp(x, y)
    if len(x) == len(y):
        return p if x[p + 1 :] == y[p + 1 :] else None
    short, long = (x, y) if len(x) < len(y) else (y, x)
    return p if len(long) == len(short) + 1 and short[p:] == long[p + 1 :] else None


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Both directions of every near pair, from blocks that follow one another in sorted order."""
    key, words, counts, size, below = None, [], [], 0, 0
    out: tuple[list, list, list] = ([], [], [])

    def compare() -> None:
        # those of the block's length, then those one longer: the longer among themselves belong elsewhere
        own = [i for i, w in enumerate(words) if len(w) == size]
        more = [i for i, w in enumerate(words) if len(w) > size]
        for at, i in enumerate(own):
            for j in own[at + 1 :] + more:
                p = near(words[i], words[j])
                if p is not None and p < below:
                    for a, b in ((i, j), (j, i)):
                        out[0].append(words[a])
                        out[1].append(words[b])
                        out[2].append(counts[b])

    rows = lambda: pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.string()), pa.array(out[2], pa.int64())], ["word", "other", "other_n"])
    for batch in batches:
        for k, s, b, w, n in zip(*(batch.column(c).to_pylist() for c in ("key", "size", "below", "word", "n")), strict=True):
            if k != key:
                compare()
                key, words, counts, size, below = k, [], [], s, b
                if len(out[0]) > 50_000:
                    yield rows()
                    for x in out:
                        x.clear()
            words.append(w)
            counts.append(n)
    compare()
    if out[0]:
        yield rows()


def _block(size: Column, prefix: Column, suffix: Column, below: Column) -> Column:
    """A block of words of ``size`` characters or one more that share so long a prefix and suffix."""
    key = F.concat_ws("\n", size.cast("string"), prefix.cast("string"), suffix.cast("string"), below.cast("string"), F.left("word", prefix), F.right("word", suffix))
    return F.struct(key.alias("key"), size.alias("size"), prefix.alias("prefix"), suffix.alias("suffix"), below.alias("below"))


def _entries(words: DataFrame) -> DataFrame:
    """Every word in its blocks by prefix and by suffix, for its own length and the one below."""
    n, none = F.length("word"), F.lit(0)
    made = []
    for size in (n, n - 1):
        half = F.floor(size / 2).cast("int")
        made += [_block(size, half, none, F.lit(ANY)), _block(size, none, half, half)]
    return words.withColumn("at", F.explode(F.array(*made))).select("at.*", "word", "n")


def _subdivided(entries: DataFrame) -> DataFrame:
    """The same words in blocks that share half of the middle as well."""
    size, prefix, suffix, below = (F.col(c) for c in ("size", "prefix", "suffix", "below"))
    half = F.floor((size - prefix - suffix) / 2).cast("int")
    made = F.array(_block(size, prefix + half, suffix, below), _block(size, prefix, suffix + half, F.least(below, prefix + half)))
    return entries.select("word", "n", F.explode(made).alias("at")).select("at.*", "word", "n")


def near_pairs(words: DataFrame, scratch: Scratch, block: int = BLOCK) -> DataFrame:
    """(word, other, other_n) of all near pairs of a table (word, n) of distinct words, each in both
    directions. Blocks that can be subdivided no further hold words of one pattern around one place: their
    pairs are results, save for words one character longer among each other, which are not compared."""
    found, left, turn = [], _entries(words), 0
    while True:
        left = scratch.write(left, f"blocks-{turn}")
        large = left.where("size - prefix - suffix > 1").groupBy("key").count().where(F.col("count") > block).select("key")
        large = scratch.write(large, f"large-{turn}")
        found.append(left.join(large, "key", "left_anti"))
        if large.isEmpty():
            break
        left = _subdivided(left.join(large, "key", "left_semi"))
        turn += 1
    blocks = found[0]
    for more in found[1:]:
        blocks = blocks.unionByName(more)
    ranges = blocks.select("key", "size", "below", "word", "n").repartitionByRange("key").sortWithinPartitions("key")
    return ranges.mapInArrow(trimmed(_scan), "word string, other string, other_n long")


def _roots(forms: DataFrame, scratch: Scratch) -> DataFrame:
    """(word, root) of words with a form: forms are followed to the last by doubling the step each turn. Counts
    grow at least fivefold with each form, so there are no cycles and few turns."""
    roots, turn = scratch.write(forms.select("word", F.col("form").alias("root")), "roots-0"), 0
    while True:
        on = roots.select(F.col("word").alias("root"), F.col("root").alias("to"))
        further = roots.join(on, "root", "left").select("word", F.coalesce("to", "root").alias("root"), F.col("to").isNotNull().alias("moved"))
        turn += 1
        roots = scratch.write(further, f"roots-{turn}")
        moved = not roots.where("moved").isEmpty()
        scratch.drop(f"roots-{turn - 1}")
        roots = roots.select("word", "root")
        if not moved:
            return roots


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """Every word of the corpus with its form and root: word, n, n_near (near words), form (the near
    word of largest count, ties by code points, if that count is five times the word's or more, else null),
    form_n and root (the last form that forms lead to, else the word).

    Null and empty texts have no words; a null id counts as an empty one; rows of one id and text are counted
    each; very long texts are searched window by window, very long words are words like others; an empty table gives
    an empty result; other columns are ignored.
    """
    with Scratch(docs.sparkSession, "spelling") as scratch:
        words = scratch.write(word_counts(docs, id_col, text_col), "words")
        best = F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other")))
        near = near_pairs(words, scratch, block).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
        near = near.select(F.col("word").alias("of"), "n_near", F.col("best.other").alias("other"), (-F.col("best.less")).alias("other_n"))
        joined = words.join(near, F.col("word") == F.col("of"), "left")
        is_form = F.col("other_n") >= RATIO * F.col("n")
        formed = scratch.write(joined.select("word", F.when(is_form, F.col("other")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(is_form, F.col("other_n")).alias("form_n")), "formed")
        roots = _roots(formed.where("form IS NOT NULL"), scratch).withColumnRenamed("word", "of")
        out = formed.join(roots, F.col("word") == F.col("of"), "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
        return scratch.keep(out, "result")


SPELLING_SQL = r"""
WITH RECURSIVE crc AS MATERIALIZED (
  SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
r AS (
  SELECT doc_id, run, count(*) AS n FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS run FROM documents)
  WHERE length(run) >= 6 GROUP BY 1, 2),
k AS (
  SELECT doc_id, run, n,
    list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run, ''), lambda x: CAST(unicode(x) AS BIGINT)) AS points FROM r),
h AS (
  SELECT run, n, xor(list_reduce(list_prepend(4294967295, flatten(list_transform(points, lambda x: CASE WHEN x < 128 THEN [x] ELSE [192 + (x >> 6), 128 + (x & 63)] END))),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS h FROM k, crc),
d AS (
  SELECT CASE WHEN h % 199 = 0 THEN left(run, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) + 2 AS BIGINT)) ELSE run END AS word, n FROM h),
w AS MATERIALIZED (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM d WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
p AS MATERIALIZED (SELECT word, n, i, left(word, i - 1) AS a, substr(word, i + 1) AS b FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w)),
e AS (
  SELECT x.word, y.word AS other, y.n AS other_n FROM p x JOIN p y ON x.i = y.i AND x.a = y.a AND x.b = y.b AND x.word <> y.word
  UNION SELECT y.word, x.word, x.n FROM p x JOIN w y ON y.word = x.a || x.b
  UNION SELECT x.word, y.word, y.n FROM p x JOIN w y ON y.word = x.a || x.b),
m AS (SELECT word, count(*) AS n_near, arg_min(other, (-other_n, other)) AS other, max(other_n) AS other_n FROM e GROUP BY word),
f AS MATERIALIZED (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 5 * n THEN other END AS form, CASE WHEN other_n >= 5 * n THEN other_n END AS form_n
  FROM w LEFT JOIN m ON w.word = m.word),
c(word, root, form) AS (
  SELECT word, word, form FROM f UNION ALL SELECT c.word, f.word, f.form FROM c JOIN f ON c.form = f.word)
SELECT f.word, f.form, c.root, f.n, CAST(f.n_near AS BIGINT) AS n_near, CAST(f.form_n AS BIGINT) AS form_n
FROM f JOIN c ON f.word = c.word AND c.form IS NULL
"""
