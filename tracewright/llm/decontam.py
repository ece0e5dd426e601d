"""Benchmark decontamination over a distributed positional inverted index, in DataFrame
functions only.

``build_index`` stores one posting (term, document, position) for every corpus token whose term
the test items use, as a columnar table in the shared folder.  ``phrase_matches`` orders the
terms of every test window by corpus frequency, takes the rarest term's list, adjusts its
positions by the term's offset to window starts, intersects those with the second-rarest term's
list and at last with the lists of all terms.  ``proximity_matches`` asks only that an item's
rarest terms lie close together.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.llm.common import Scratch, eager, load, lower_ascii, spread_join

#: Runs between words: every ASCII character that is neither a letter nor a digit.
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WINDOW = 13
#: Tables of at most so many narrow rows are broadcast; larger ones are joined by shuffles.
BROADCAST_ROWS = 300_000
KEY = ["doc_id", "text_hash"]


def _parts(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), SEPARATORS)


def word_count(text: Column) -> Column:
    """Words of a text: its parts without the empty ones that a separator at either end makes."""
    p = _parts(text)
    ends = (F.element_at(p, 1) == "").cast("long") + F.when(F.size(p) > 1, (F.element_at(p, -1) == "").cast("long")).otherwise(0)
    return F.size(p).cast("long") - ends


def words(rows: DataFrame, keep: list[str], text_col: str) -> DataFrame:
    """One row per word: the ``keep`` columns, the lower-cased ``word`` and its ``pos``, which
    counts from 1 in a text that begins with a separator and from 0 in others."""
    exploded = rows.select(*keep, F.posexplode(_parts(F.col(text_col))).alias("pos", "w")).where("w != ''")
    return exploded.select(*keep, "pos", F.when(F.col("w").rlike("[A-Z]"), lower_ascii(F.col("w"))).otherwise(F.col("w")).alias("word"))


def _bounded(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


@dataclass
class Index:
    """Postings (term, doc_id, text_hash, pos), the item words they were built for
    (item, item_id, pos, term, length) and the posting count of every term."""

    postings: DataFrame
    items: DataFrame
    frequency: DataFrame
    item_rows: int


def build_index(docs: DataFrame, items: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> Index:
    """Stores the postings of all documents for the vocabulary of all items.

    Documents are keyed by id and text hash, so rows that share an id but not a text stay apart,
    repeated rows share their postings, and null ids are keys like others.
    """
    item_words = words(items.select(F.col(item_col).alias("item_id"), F.col(item_text).alias("t")).distinct().withColumn("item", F.xxhash64("item_id", "t")), ["item", "item_id"], "t")
    # windows count an item's words from 0, whether or not it begins with a separator
    item = Window.partitionBy("item")
    item_words = scratch.write(item_words.withColumn("length", F.count(F.lit(1)).over(item)).withColumn("pos", F.col("pos") - F.min("pos").over(item)), "item_words")
    vocabulary = item_words.select("word").distinct().withColumn("term", F.xxhash64("word"))
    vocabulary = scratch.write(vocabulary, "vocabulary")
    n_terms, n_words = vocabulary.count(), item_words.count()
    corpus = words(docs.select(F.col(id_col).alias("doc_id"), eager(F.xxhash64(F.col(text_col))).alias("text_hash"), F.col(text_col).alias("t")), KEY, "t")
    postings = scratch.write(spread_join(corpus, vocabulary, ["word"], ["doc_id", "pos"], n_terms, BROADCAST_ROWS).select("term", *KEY, "pos"), "postings")
    frequency = scratch.write(postings.groupBy("term").agg(F.count(F.lit(1)).alias("df")), "frequency")
    terms = item_words.withColumn("term", F.xxhash64("word")).select("item", "item_id", "pos", "term", "length")
    return Index(postings, terms, frequency, n_words)


def item_windows(index: Index, n: int = WINDOW) -> DataFrame:
    """Every window of every item whose terms all occur in the corpus, one row per term: item,
    start, pos, term, rank (1: rarest). An item of fewer than ``n`` words is one window."""
    width = F.least(F.col("length"), F.lit(n))
    rows = index.items.join(_bounded(index.frequency, index.item_rows), "term", "left").withColumn("width", width)
    rows = rows.select("*", F.explode(F.sequence(F.greatest(F.lit(0).cast("long"), F.col("pos") - F.col("width") + 1), F.least(F.col("pos").cast("long"), F.col("length") - F.col("width")))).alias("start"))
    same = Window.partitionBy("item", "start")
    ranked = rows.withColumn("rank", F.row_number().over(same.orderBy("df", "term", "pos"))).withColumn("known", F.count("df").over(same))
    return ranked.where("known = width").select("item", "start", F.col("pos").alias("q"), "term", "rank", "width")


def phrase_matches(index: Index, scratch: Scratch, n: int = WINDOW) -> DataFrame:
    """Maximal exact matches of at least one window: doc_id, text_hash, item, item_id, first and
    last (document word positions) of each run of item words that holds whole windows."""
    windows = scratch.write(item_windows(index, n), "windows")
    single = windows.where("rank = 1")
    second = windows.where("rank = 2").select("item", "start", F.col("q").alias("q2"), F.col("term").alias("term2"))
    plan = scratch.write(single.join(second, ["item", "start"], "left").select("item", "start", "q", "term", "q2", "term2"), "plan")
    # the rarest list, its positions adjusted to the diagonal on which the item would lie
    starts = spread_join(index.postings, plan, ["term"], ["doc_id", "pos"], index.item_rows * n, BROADCAST_ROWS).select(*KEY, "item", "start", (F.col("pos") - F.col("q")).cast("int").alias("diagonal"), "q2", "term2")
    starts = scratch.write(starts.distinct(), "starts")
    second_terms = plan.select(F.col("term2").alias("term")).where("term is not null").distinct()
    listed = spread_join(index.postings, second_terms, ["term"], ["doc_id", "pos"], index.item_rows, BROADCAST_ROWS, "left_semi").select(*[F.col(k).alias(f"p_{k}") for k in KEY], F.col("pos").alias("p_pos"), F.col("term").alias("p_term"))
    same_doc = F.col("doc_id").eqNullSafe(F.col("p_doc_id")) & F.col("text_hash").eqNullSafe(F.col("p_text_hash"))
    met = starts.where("term2 is not null").join(listed, same_doc & (F.col("diagonal") + F.col("q2") == F.col("p_pos")) & (F.col("term2") == F.col("p_term")), "left_semi")
    met = met.unionByName(starts.where("term2 is null"))  # windows of one word
    candidates = scratch.write(met.select(*KEY, "item", "start", "diagonal"), "candidates")
    # all lists: what the candidates' windows expect at every position
    expected = candidates.join(_bounded(windows.select("item", "start", "q", "term"), index.item_rows * n), ["item", "start"]).select(*KEY, "item", "diagonal", "q", "term").distinct()
    keys = candidates.select(*[F.col(k).alias(f"c_{k}") for k in KEY]).distinct()
    near = index.postings.join(_bounded(keys, keys.count()), F.col("doc_id").eqNullSafe(F.col("c_doc_id")) & F.col("text_hash").eqNullSafe(F.col("c_text_hash")), "left_semi")
    near = near.select(*[F.col(k).alias(f"p_{k}") for k in KEY], F.col("pos").alias("p_pos"), F.col("term").alias("p_term"))
    matched = expected.join(near, same_doc & (F.col("diagonal") + F.col("q") == F.col("p_pos")) & (F.col("term") == F.col("p_term")), "left_semi")
    line = Window.partitionBy(*KEY, "item", "diagonal").orderBy("q")
    runs = matched.withColumn("run", F.col("q") - F.row_number().over(line)).groupBy(*KEY, "item", "diagonal", "run").agg(F.min("q").alias("a"), F.max("q").alias("b"))
    lengths = index.items.select("item", "item_id", "length").distinct()
    whole = runs.join(_bounded(lengths, index.item_rows), "item").where(F.col("b") - F.col("a") + 1 >= F.least(F.col("length"), F.lit(n)))
    return whole.select(*KEY, "item", "item_id", (F.col("a") + F.col("diagonal")).alias("first"), (F.col("b") + F.col("diagonal")).alias("last"))


def proximity_matches(index: Index, n_terms: int = 4, slop: int = 8) -> DataFrame:
    """Documents in which an item's ``n_terms`` rarest terms (all of them, if it has fewer) occur
    within ``slop`` words of one occurrence of the rarest: doc_id, text_hash, item, item_id, pos
    (of that occurrence)."""
    terms = index.items.select("item", "item_id", "term").distinct().join(index.frequency, "term", "left")
    ranked = terms.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(F.col("df").asc_nulls_first(), "term"))).where(F.col("rank") <= n_terms)
    ranked = ranked.withColumn("needed", F.count(F.lit(1)).over(Window.partitionBy("item"))).where("df is not null")
    hits = spread_join(index.postings, ranked, ["term"], ["doc_id", "pos"], index.item_rows, BROADCAST_ROWS)
    anchor = hits.where("rank = 1").select(*KEY, "item", "item_id", "needed", F.col("pos").alias("at"))
    others = hits.select(F.col("doc_id").alias("o_doc"), F.col("text_hash").alias("o_hash"), F.col("item").alias("o_item"), F.col("rank").alias("o_rank"), F.col("pos").alias("o_pos"))
    block = lambda c: F.floor(c / (slop + 1)).cast("long")  # noqa: E731  an equi-join on blocks of positions, not a range join
    anchor = anchor.select("*", F.explode(F.array(block(F.col("at")) - 1, block(F.col("at")), block(F.col("at")) + 1)).alias("block"))
    near = anchor.join(others.withColumn("o_block", block(F.col("o_pos"))), F.col("doc_id").eqNullSafe(F.col("o_doc")) & (F.col("text_hash") == F.col("o_hash")) & (F.col("item") == F.col("o_item")) & (F.col("block") == F.col("o_block")))
    return near.where(F.abs(F.col("o_pos") - F.col("at")) <= slop).groupBy(*KEY, "item", "item_id", "needed", F.col("at").alias("pos")).agg(F.count_distinct("o_rank").alias("found")).where("found = needed").select(*KEY, "item", "item_id", "pos")


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = WINDOW) -> DataFrame:
    """Every document with its hits: doc_id, text_hash, n_words, n_hit (words inside any
    occurrence of a window), n_items, items_sha256, contaminated (n_hit > 0 and a twentieth of
    the words at least).

    Null and empty texts have no words; items without words have no windows; a very long text has
    its postings spread like others'; repeated rows get one result each; terms of equal frequency are
    ordered by hash, which changes no result; null ids are ids like others; empty tables give empty
    results or no hits; other columns are ignored.
    """
    spark = docs.sparkSession
    with Scratch(spark, "decontamination") as scratch:
        index = build_index(docs, items, scratch, id_col, text_col)
        runs = scratch.write(phrase_matches(index, scratch, n), "runs")
        hit = runs.select(*KEY, F.explode(F.sequence("first", "last")).alias("pos")).distinct().groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_hit"))
        names = runs.groupBy(*KEY).agg(F.sort_array(F.collect_set(F.coalesce(F.col("item_id").cast("string"), F.lit("")))).alias("ids"))
        same = hit.alias("h").join(names.alias("i"), F.col("h.doc_id").eqNullSafe(F.col("i.doc_id")) & F.col("h.text_hash").eqNullSafe(F.col("i.text_hash")))
        found = scratch.keep(same.select("h.doc_id", "h.text_hash", "n_hit", F.size("ids").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "ids").cast("binary"), 256).alias("items_sha256")), "found")
    found = _bounded(found.withColumnsRenamed({k: f"f_{k}" for k in KEY}), found.count())
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("text_hash"), word_count(F.col(text_col)).alias("n_words"))
    out = rows.join(found, F.col("doc_id").eqNullSafe(F.col("f_doc_id")) & F.col("text_hash").eqNullSafe(F.col("f_text_hash")), "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return out.select(
        "doc_id", "text_hash", "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("items_sha256"),
        ((n_hit > 0) & (n_hit * 20 >= F.col("n_words"))).alias("contaminated"),
    )


def decontam_query(spark, sf_dir: str) -> DataFrame:
    return contamination(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark")).drop("text_hash")


DECONTAM_SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
i AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
il AS (SELECT item_id, ws, least(len(ws), 13) AS width FROM i WHERE len(ws) > 0),
iw AS (
  SELECT DISTINCT item_id, width, array_to_string(list_slice(ws, s, s + width - 1), ' ') AS gram
  FROM (SELECT item_id, ws, width, unnest(range(1, len(ws) - width + 2)) AS s FROM il)),
widths AS (SELECT DISTINCT width FROM iw),
dg AS (
  SELECT doc_id, width, s, array_to_string(list_slice(ws, s, s + width - 1), ' ') AS gram
  FROM (SELECT doc_id, ws, width, unnest(range(1, len(ws) - width + 2)) AS s FROM w, widths WHERE len(ws) >= width)),
hits AS (SELECT dg.doc_id, dg.s, dg.width, iw.item_id FROM dg JOIN iw ON dg.gram = iw.gram AND dg.width = iw.width),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + width)) AS p FROM hits) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(w.ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, coalesce(items_sha256, sha256('')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w.ws) AS contaminated
FROM w LEFT JOIN pos ON w.doc_id = pos.doc_id LEFT JOIN items ON w.doc_id = items.doc_id
"""
