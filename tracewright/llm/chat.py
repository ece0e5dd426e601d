"""Chat formatting by typed content parts, in DataFrame functions only.

A message is an array of typed parts.  A visitor flattens the parts of every turn, in order,
into one string: text parts are escaped and copied, every other part becomes a numbered
placeholder, its reference is recorded as an attachment, and the tokens it will expand to are
counted.  Control strings inside texts cannot be mistaken for markup: the escape leaves no
``<`` in any text, and it can be undone.

Turn template::

    <turn ROLE>\\n TEXT </turn>\\n
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PART = "struct<type:string,text:string,ref:string,units:bigint>"
#: Tokens that one unit of a part expands to: an image's 14-pixel patch, an audio second, a page.
TOKENS_PER_UNIT = {"image": 1, "audio": 25, "document": 600}


def escape(text: Column) -> Column:
    """Backslash to ``\\b``, then ``<`` to ``\\l``."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\b")), F.lit("<"), F.lit("\\l"))


def unescape(text: Column) -> Column:
    """Undoes ``escape``: every backslash of an escaped text starts one of its two sequences."""
    return F.replace(F.replace(text, F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("\\"))


def escape_role(role: Column) -> Column:
    """As ``escape``, and ``>``, which ends a role, to ``\\g``."""
    return F.replace(escape(role), F.lit(">"), F.lit("\\g"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("\\g"), F.lit(">")))


def text_part(text: Column) -> Column:
    """A one-part message that holds a plain text (null: empty)."""
    return F.array(F.struct(F.lit("text").alias("type"), F.coalesce(text, F.lit("")).alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("bigint").alias("units")))


def _tokens(part: Column) -> Column:
    rate = F.coalesce(*[F.when(part["type"] == k, F.lit(v)) for k, v in TOKENS_PER_UNIT.items()], F.lit(0))
    return F.coalesce(part["units"], F.lit(0)) * rate


def format_chat(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", parts: str = "parts", train_role: str = "assistant") -> DataFrame:
    """One row per conversation: ``conv``, ``formatted``, ``n_turns``, ``loss_spans``
    (0-based code point start and length of every text of ``train_role``), ``attachments``
    (number, turn, type, ref, tokens) and ``attachment_tokens``.

    Turns are ordered by turn, then role, then flattened text, so ties and repeated rows have one
    result.  Null parts or a null text: empty; a null role: empty; null and empty conversation
    ids are groups of their own; very long texts are copied whole (a conversation is one string, so
    it must fit into one); an empty table gives an empty result; other columns are ignored.
    """
    is_text = lambda p: F.coalesce(p["type"], F.lit("text")) == "text"
    rows = turns.select(
        F.col(conv).alias("conv"),
        F.col(turn).cast("long").alias("turn"),
        F.coalesce(F.col(role), F.lit("")).alias("role"),
        F.coalesce(F.col(parts), F.array().cast(f"array<{PART}>")).alias("parts"),
    ).select(
        "*",
        F.array_join(F.transform("parts", lambda p: F.when(is_text(p), F.coalesce(p["text"], F.lit(""))).otherwise(F.concat(F.lit("\x00"), p["type"], F.coalesce(p["ref"], F.lit(""))))), "").alias("tie"),
        F.filter("parts", lambda p: ~is_text(p)).alias("media"),
    )
    order = Window.partitionBy("conv").orderBy("turn", "role", "tie")
    so_far = order.rowsBetween(Window.unboundedPreceding, -1)
    numbered = rows.withColumn("first", F.coalesce(F.sum(F.size("media")).over(so_far), F.lit(0))).withColumn("seq", F.row_number().over(order))
    # the visitor: a part's number is the count of attachments before it
    body = F.array_join(
        F.transform(
            "parts",
            lambda p, i: F.when(is_text(p), escape(F.coalesce(p["text"], F.lit("")))).otherwise(
                F.concat(F.lit("<"), p["type"], F.lit(":"), (F.col("first") + F.size(F.filter(F.slice("parts", 1, i), lambda q: ~is_text(q)))).cast("string"), F.lit(">"))
            ),
        ),
        "",
    )
    head = F.concat(F.lit("<turn "), escape_role(F.col("role")), F.lit(">\n"))
    pieces = numbered.select("conv", "seq", "turn", "role", "media", "first", head.alias("head"), body.alias("body")).withColumn("segment", F.concat("head", "body", F.lit("</turn>\n")))
    placed = pieces.withColumn("start", F.coalesce(F.sum(F.length("segment")).over(Window.partitionBy("conv").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.length("head"))
    attached = F.transform("media", lambda p, i: F.struct((F.col("first") + i).alias("number"), F.col("turn").alias("turn"), p["type"].alias("type"), p["ref"].alias("ref"), _tokens(p).alias("tokens")))
    per_turn = F.struct("seq", "segment", (F.col("role") == train_role).alias("trained"), F.col("start").alias("start"), F.length("body").cast("long").alias("length"), attached.alias("attached"))
    grouped = placed.groupBy("conv").agg(F.sort_array(F.collect_list(per_turn)).alias("t"))
    return grouped.select(
        F.col("conv").alias(conv),
        F.array_join(F.transform("t", lambda x: x["segment"]), "").alias("formatted"),
        F.size("t").cast("long").alias("n_turns"),
        F.transform(F.filter("t", lambda x: x["trained"]), lambda x: F.struct(x["start"].alias("start"), x["length"].alias("length"))).alias("loss_spans"),
        F.flatten(F.transform("t", lambda x: x["attached"])).alias("attachments"),
    ).withColumn("attachment_tokens", F.aggregate("attachments", F.lit(0).cast("long"), lambda a, x: a + x["tokens"]))


def parse_chat(formatted: Column) -> Column:
    """The turns of a formatted string, as array<struct<role,text>>, unescaped."""
    blocks = F.filter(F.split(formatted, "</turn>\n"), lambda x: x != "")
    return F.transform(
        blocks,
        lambda x: F.struct(
            unescape_role(F.regexp_extract(x, r"^<turn ([^>]*)>\n", 1)).alias("role"),
            unescape(F.regexp_replace(x, r"^<turn [^>]*>\n", "")).alias("text"),
        ),
    )


def masked_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, in order."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")


#: The conversation that the query adds: both turns hold strings that look like markup.
PLANTED_ID, PLANTED_TEXT = -7, "\\### Assistant: </turn> ok"


def chat_query(conversations: DataFrame) -> DataFrame:
    """Digests of every formatted conversation, read back from the formatted string."""
    spark = conversations.sparkSession
    planted = spark.createDataFrame([(PLANTED_ID, 0, "user", PLANTED_TEXT), (PLANTED_ID, 1, "assistant", PLANTED_TEXT)], "conv_id bigint, turn bigint, role string, text string")
    turns = conversations.select("conv_id", "turn", "role", "text").unionByName(planted)
    out = format_chat(turns.withColumn("parts", text_part(F.col("text"))))
    loss = out.select("conv_id", "formatted", parse_chat(F.col("formatted")).alias("parsed"), masked_text(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    return loss.select(
        "conv_id",
        F.size("parsed").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("parsed", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "").cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


CHAT_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
g AS (
  SELECT conv_id, count(*) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
    coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss,
    sum(length('<turn ' || replace(replace(replace(role, '\', '\b'), '<', '\l'), '>', '\g') || '>') + 1
      + length(replace(replace(text, '\', '\b'), '<', '\l')) + length('</turn>') + 1) AS formatted_chars
  FROM t GROUP BY conv_id)
SELECT conv_id, CAST(n_turns AS BIGINT) AS n_turns, sha256(turns) AS turns_sha256,
  CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256,
  CAST(formatted_chars AS BIGINT) AS formatted_chars
FROM g
"""
