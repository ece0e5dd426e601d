"""A corpus pipeline of five stages: toxicity, line dedup, near duplicates, decontamination, encoding.

Every stage takes (spark, docs, sf_dir) and works on all rows that the stage before kept; all but the
last return the columns of ``documents``, extra ones included, whatever their names (but for names that
begin with two underscores).

In every stage null and empty texts are texts without words: the first four stages keep them, each row
that is not a repeat of another, and the last encodes them as no ids. Very long texts are handled whole.
Repeated rows share their decisions; an empty table gives an empty table with the same columns.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewright.llm import bpe, decontam, linededup, ngramjoin, toxicity
from tracewright.llm.common import Scratch, load

#: At most so many ids of removed rows (some hundred bytes each in memory) are broadcast.
BROADCAST_IDS = 1_000_000


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score stays below 0.7; all labels may be learnt from. The score is a
    column beside the row, so nothing is joined back. Null ids and repeated rows are scored like others."""
    return toxicity.with_scores(docs, load(spark, sf_dir, "labels"), "__toxicity").where(F.col("__toxicity") < toxicity.THRESHOLD).select(*docs.columns)


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without cross-site boilerplate lines; one that loses all its lines goes. ``n_chars``
    follows the text where lines went. A null source is a site of its own; a line stays in the rows of
    the smallest id that holds it, and everywhere if only rows without an id hold it."""
    own = [c for c in docs.columns if c in ("n_lines", "n_removed")]  # a caller's columns of those names
    cleaned = linededup.dedup_lines(docs.withColumnsRenamed({c: f"__own_{c}" for c in own}))
    cleaned = cleaned.where(~((F.col("n_removed") > 0) & (F.col("text") == "")))
    size = F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars")) if "n_chars" in docs.columns else None
    return cleaned.select(*[size.cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(f"__own_{c}").alias(c) if c in own else F.col(c) for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each class of near duplicates, once. Rows without an id stay
    where their class has no other, one for each class; rows without an id and without words all stay."""
    if _repeats(docs):
        return _one_of_each_class(spark, docs)
    classes = ngramjoin.near_duplicates(docs)
    gone = classes.where(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("__k_id"))
    with Scratch(spark, "near-duplicates") as scratch:
        gone = scratch.keep(gone, "gone")
    # ids of removed rows alone; beyond the bound whole texts are shuffled by id
    few = F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone
    return docs.join(few, docs["doc_id"].eqNullSafe(gone["__k_id"]), "left_anti")


def _one_of_each_class(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """As above where ids repeat: rows are told apart by id and text hash, and a class is named by the
    least of its members, those with an id before those without."""
    own = docs.withColumn("__own", F.struct(F.col("doc_id").isNull().alias("unnamed"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("hash")))
    classes = ngramjoin.near_duplicates(own, "__own").where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    keep = classes.select(F.col("doc_id.id").alias("__k_id"), F.col("doc_id.hash").alias("__k_hash"), (F.col("doc_id.unnamed") & (F.col("n_shingles") == 0)).alias("__k_alone")).distinct()
    with Scratch(spark, "near-duplicates") as scratch:
        keep = scratch.keep(keep, "kept")
    kept = docs.join(keep, docs["doc_id"].eqNullSafe(keep["__k_id"]) & (F.xxhash64(docs["text"]) == keep["__k_hash"]))
    # maps have no order of their own
    order = [F.to_json(F.struct(c)) if "map<" in kind else F.col(c) for c, kind in docs.dtypes]
    first = F.row_number().over(Window.partitionBy("__k_id", "__k_hash").orderBy(*order))
    once = kept.where("NOT __k_alone").withColumn("__first", first).where("__first = 1")
    return once.select(*docs.columns).unionByName(kept.where("__k_alone").select(*docs.columns))


def _repeats(docs: DataFrame) -> bool:
    """Whether an id occurs more than once."""
    return not docs.groupBy("doc_id").count().where("count > 1").isEmpty()


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by benchmark items. Rows of one id and different texts are
    judged apart; a null id is an id like others."""
    found = decontam.contamination(docs, load(spark, sf_dir, "benchmark")).where("contaminated").select(F.col("doc_id").alias("__c_id"), F.col("text_hash").alias("__c_hash")).distinct()
    with Scratch(spark, "contaminated") as scratch:
        found = scratch.keep(found, "found")
    return docs.join(found, docs["doc_id"].eqNullSafe(found["__c_id"]) & (F.xxhash64(docs["text"]) == found["__c_hash"]), "left_anti")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte-level BPE ids of every row, with digests of ids and decoded bytes; other columns go."""
    return bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_boilerplate),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("byte_bpe", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = load(spark, sf_dir, "documents")
    with Scratch(spark, "pipeline") as scratch:
        for i, (name, stage) in enumerate(STAGES):
            last = i == len(STAGES) - 1
            docs = (scratch.keep if last else scratch.write)(stage(spark, docs, sf_dir), name)
            if i:
                scratch.drop(STAGES[i - 1][0])
    return docs


#: The toxicity model and the tokenizer are beyond SQL.
ORACLE_SQL = None
