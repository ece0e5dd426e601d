"""Removal of lines that spread over many sites.

One HyperLogLog sketch per line hash, merged by aggregation, estimates how many distinct sites hold
a line.  Lines whose estimate lies within the sketch's error of the threshold get an exact distinct
count, so every decision equals the exact one but for sketch errors beyond ``BAND`` deviations.
Lines that reach the threshold are boilerplate: they stay in the document of the smallest id that
holds them, so no content is lost altogether, and go from all others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.llm.common import Scratch, eager, spread_join

MIN_SITES = 10
#: Lines of more words than this are too long to be written twice by chance, and need fewer sites.
LONG_WORDS, LONG_MIN_SITES = 50, 4
#: Shorter lines (in characters, without outer blanks) recur by chance and are left alone.
MIN_CHARS = 12
LG_K = 10
#: Deviations of the estimate within which lines are counted exactly.
BAND = 5
BROADCAST_ROWS, BROADCAST_POSITIONS = 200_000, 2_000_000
LINE = ["h", "c"]
SPACES = r"[\x20\x09-\x0D]+"


def line_key(line: Column) -> Column:
    return F.btrim(line, F.lit(" \t\r"))


def _lines(docs: DataFrame, id_col: str, text_col: str, site_col: str, min_chars: int) -> DataFrame:
    rows = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("doc_id"), eager(F.xxhash64(F.col(text_col))).alias("text_hash"), F.coalesce(F.col(site_col).cast("string"), F.lit("\x00")).alias("site"), F.split(F.col(text_col), "\n").alias("parts"))
    exploded = rows.select("doc_id", "text_hash", "site", F.posexplode("parts").alias("pos", "raw")).select("doc_id", "text_hash", "site", "pos", line_key(F.col("raw")).alias("line"))
    long = (F.length("line") > 2 * LONG_WORDS) & (F.size(F.split("line", SPACES)) > LONG_WORDS)
    return exploded.where(F.length("line") >= min_chars).select("doc_id", "text_hash", "site", "pos", F.xxhash64("line").alias("h"), F.hash("line").alias("c"), long.alias("long"))


def boilerplate_lines(lines: DataFrame, scratch: Scratch, min_sites: int = MIN_SITES, long_min_sites: int = LONG_MIN_SITES) -> DataFrame:
    """Hashes of the lines on enough distinct sites (``min_sites``, or ``long_min_sites`` where ``long``),
    with the smallest id holding each."""
    error = 1.04 / 2 ** (LG_K / 2)
    needed = F.when(F.col("long"), long_min_sites).otherwise(min_sites)
    sketched = lines.groupBy(*LINE).agg(F.hll_sketch_agg("site", LG_K).alias("sketch"), F.min("doc_id").alias("first_id"), F.max("long").alias("long"), F.count(F.lit(1)).alias("n"))
    # occurrences bound sites from above, so rarer lines need no estimate
    estimated = sketched.where(F.col("n") >= needed).select(*LINE, "first_id", "long", F.hll_sketch_estimate("sketch").alias("sites"))
    estimated = scratch.write(estimated.where(F.col("sites") >= needed * (1 - BAND * error) - 0.5), "estimated")
    near = estimated.where(F.col("sites") <= needed * (1 + BAND * error) + 0.5).select(*LINE)
    found = spread_join(lines, near, LINE, ["doc_id", "pos"], near.count(), BROADCAST_ROWS, "left_semi")
    exact = found.groupBy(*LINE).agg(F.count_distinct("site").alias("exact"))
    counted = estimated.join(exact, LINE, "left").where(F.coalesce(F.col("exact"), F.col("sites")) >= needed)
    return scratch.write(counted.select(*LINE, "first_id"), "boilerplate")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", min_sites: int = MIN_SITES, min_chars: int = MIN_CHARS, long_min_sites: int = LONG_MIN_SITES) -> DataFrame:
    """Every row of ``docs`` with all its columns, its text without removed lines, and two columns
    ``n_lines`` and ``n_removed``. Lines of more than ``LONG_WORDS`` words go from ``long_min_sites`` sites on.

    A null text has no lines and stays null; an empty text is one short line; a null site is a
    site of its own; lines held by null-id rows only are kept; equal lines of one document share
    their decision; repeated rows are cleaned alike; where rows share the smallest id, all of them
    keep the line; a very long text is split into lines within its row; an empty table gives an empty result. Extra
    columns pass through; columns already named ``n_lines`` or ``n_removed`` are replaced.
    """
    spark = docs.sparkSession
    with Scratch(spark, "line-dedup") as scratch:
        lines = _lines(docs, id_col, text_col, site_col, min_chars)
        found = boilerplate_lines(lines, scratch, min_sites, long_min_sites)
        hits = spread_join(lines, found, LINE, ["doc_id", "pos"], found.count(), BROADCAST_ROWS)
        gone = hits.where(F.col("first_id").isNotNull() & ~F.col("doc_id").eqNullSafe(F.col("first_id")))
        gone = gone.groupBy(F.col("doc_id").alias("__g_id"), F.col("text_hash").alias("__g_hash")).agg(F.collect_set("pos").alias("__g_pos"))
        gone = scratch.keep(gone, "removed")
    count, positions = gone.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("__g_pos")), F.lit(0))).first()
    if count <= BROADCAST_ROWS and positions <= BROADCAST_POSITIONS:
        gone = F.broadcast(gone)
    rest = docs.drop("n_lines", "n_removed")
    joined = rest.withColumn("__g_own", F.xxhash64(F.col(text_col))).join(gone, rest[id_col].eqNullSafe(F.col("__g_id")) & (F.col("__g_own") == F.col("__g_hash")), "left")
    kept = F.array_join(F.filter(F.split(F.col(text_col), "\n"), lambda _, i: ~F.array_contains("__g_pos", i)), "\n")
    text = F.when(F.col("__g_pos").isNull(), F.col(text_col)).otherwise(kept)
    n_lines = F.coalesce(F.size(F.split(F.col(text_col), "\n")), F.lit(0))
    n_lines = F.when(F.col(text_col).isNull(), 0).otherwise(n_lines).cast("long")
    return joined.select(
        *[text.alias(c) if c == text_col else F.col(c) for c in rest.columns],
        n_lines.alias("n_lines"), F.when(F.col("__g_pos").isNull(), 0).otherwise(F.size("__g_pos")).cast("long").alias("n_removed"),
    )


def line_query(docs: DataFrame) -> DataFrame:
    """Per document: lines, removed lines, and length and digest of the remaining text."""
    text = F.coalesce("text", F.lit(""))
    return dedup_lines(docs).select("doc_id", "n_lines", "n_removed", F.length(text).cast("long").alias("clean_chars"), F.sha2(text.cast("binary"), 256).alias("clean_sha256"))


LINE_SQL = f"""
WITH l AS (
  SELECT doc_id, coalesce(source, chr(1)) AS site, pos, parts[pos] AS raw, trim(parts[pos], ' ' || chr(9) || chr(13)) AS line
  FROM (SELECT doc_id, source, parts, unnest(range(1, len(parts) + 1)) AS pos
        FROM (SELECT doc_id, source, string_split(text, chr(10)) AS parts FROM documents WHERE text IS NOT NULL))),
b AS (
  SELECT line, min(doc_id) AS first_id FROM l WHERE length(line) >= {MIN_CHARS}
  GROUP BY line HAVING count(DISTINCT site) >= CASE
    WHEN length(line) > {2 * LONG_WORDS} AND len(regexp_split_to_array(line, '{SPACES}')) > {LONG_WORDS} THEN {LONG_MIN_SITES} ELSE {MIN_SITES} END),
m AS (SELECT l.doc_id, l.pos, l.raw, coalesce(l.doc_id <> b.first_id, false) AS gone FROM l LEFT JOIN b ON l.line = b.line),
d AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed,
    coalesce(string_agg(raw, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS clean
  FROM m GROUP BY doc_id)
SELECT t.doc_id, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
  CAST(length(coalesce(clean, '')) AS BIGINT) AS clean_chars, sha256(coalesce(clean, '')) AS clean_sha256
FROM documents t LEFT JOIN d ON t.doc_id = d.doc_id
"""
