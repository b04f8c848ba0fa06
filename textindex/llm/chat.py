"""Operator 6: chat formatting of typed content parts.

A turn's content is an array of parts ``(type, text, ref, units, width, height)``.
A visitor flattens them in order: text parts are escaped, image, audio and
document parts become placeholders, whose references and expanded token counts
are recorded as attachments, in the order of the placeholders. Turns are marked
``<turn role="...">`` ... ``</turn>`` and a line feed. Control strings inside
texts are escaped by ``&amp;`` and ``&lt;`` (``&quot;`` in roles), which is
undone by replacing them back, ``&amp;`` last. The loss mask is the list of
places, in code points, of the assistant turns' contents.

Edge cases: null text is empty, a null role is the empty role, a null or empty
array of parts gives an empty turn, a part of unknown type counts as a document;
rows with equal turn numbers are ordered by role, then content; null turns come
first; rows with a null conv_id form one conversation; an empty table gives no
conversations. Other columns are not read and may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textindex.llm.common import read
from textindex.llm.native import let, running

PART = ("struct<type:string,text:string,ref:string,units:double,width:int,height:int>")
TURN_END = "</turn>\n"
ROLE_START, ROLE_END = '<turn role="', '">'
PLACEHOLDERS = ("image", "audio", "document")

# Expanded tokens: an image is one token a patch, audio so many a second and a
# document so many a page.
PATCH, PER_SECOND, PER_PAGE = 28, 12.5, 256


def escape(text: Column) -> Column:
    return F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("&"), F.lit("&amp;")),
                     F.lit("<"), F.lit("&lt;"))


def unescape(text: Column) -> Column:
    for kind in PLACEHOLDERS:
        text = F.replace(text, F.lit(f"<{kind}/>"), F.lit(""))
    return F.replace(F.replace(text, F.lit("&lt;"), F.lit("<")), F.lit("&amp;"), F.lit("&"))


def _kind(part: Column) -> Column:
    return (F.when(part["type"].isin("text", *PLACEHOLDERS), part["type"])
            .when(part["type"].isNull() & part["text"].isNotNull(), F.lit("text"))
            .otherwise(F.lit("document")))


def _tokens(part: Column) -> Column:
    kind = _kind(part)
    units = F.coalesce(part["units"], F.lit(1.0))
    patches = (F.ceil(F.coalesce(part["width"], F.lit(PATCH)) / PATCH)
               * F.ceil(F.coalesce(part["height"], F.lit(PATCH)) / PATCH))
    return (F.when(kind == "image", patches)
            .when(kind == "audio", F.ceil(units * PER_SECOND))
            .otherwise(F.ceil(units * PER_PAGE))).cast("long")


def visit(parts: Column) -> Column:
    """``(content, attachments)`` of an array of parts."""
    parts = F.coalesce(parts, F.array().cast(f"array<{PART}>"))
    content = F.array_join(F.transform(parts, lambda p: F.when(
        _kind(p) == "text", escape(p["text"])).otherwise(
            F.concat(F.lit("<"), _kind(p), F.lit("/>")))), "")
    attachments = F.transform(
        F.filter(parts, lambda p: _kind(p) != "text"),
        lambda p: F.struct(_kind(p).alias("type"), p["ref"].alias("ref"),
                           _tokens(p).alias("tokens")))
    return F.struct(content.alias("content"), attachments.alias("attachments"))


def _head(role: Column) -> Column:
    return F.concat(F.lit(ROLE_START), F.replace(escape(role), F.lit('"'), F.lit("&quot;")),
                    F.lit(ROLE_END))


def format_conversations(turns: DataFrame) -> DataFrame:
    """``(conv_id, formatted, loss_mask, attachments)`` from ``(conv_id, turn, role, parts)``."""
    visited = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"),
                           visit(F.col("parts")).alias("v"))
    grouped = visited.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct(
        F.col("turn").isNotNull().alias("numbered"), F.coalesce("turn", F.lit(0)).alias("turn"),
        "role", "v.content", "v.attachments"))).alias("turns"))
    heads = F.transform("turns", lambda t: F.length(_head(t["role"])).cast("long"))
    lengths = F.zip_with("turns", heads, lambda t, h: h + F.length(t["content"]) + len(TURN_END))
    starts = F.zip_with(running(lengths), heads, lambda at, h: at + h)
    mask = F.filter(F.zip_with("turns", starts, lambda t, s: F.struct(
        (t["role"] == "assistant").alias("loss"), s.alias("start"),
        (s + F.length(t["content"])).alias("end"))), lambda m: m["loss"])
    return grouped.select(
        "conv_id",
        F.array_join(F.transform("turns", lambda t: F.concat(
            _head(t["role"]), t["content"], F.lit(TURN_END))), "").alias("formatted"),
        F.transform(mask, lambda m: F.struct(m["start"], m["end"])).alias("loss_mask"),
        F.flatten(F.transform("turns", lambda t: t["attachments"])).alias("attachments"))


def parse_turns(formatted: Column) -> Column:
    """Array of (role, text) read back from the formatted text, unescaped."""
    def turn(piece: Column) -> Column:
        role = F.substring(F.substring_index(piece, ROLE_END, 1), F.lit(len(ROLE_START) + 1),
                           F.length(piece))
        return let(role, lambda r: F.struct(
            unescape(F.replace(r, F.lit("&quot;"), F.lit('"'))).alias("role"),
            unescape(F.substring(piece, F.length(r) + F.lit(len(ROLE_START) + len(ROLE_END) + 1),
                                 F.length(piece))).alias("text")))

    pieces = F.split(formatted, TURN_END, -1)
    return let(pieces, lambda p: F.transform(F.slice(p, F.lit(1), F.size(p) - 1), turn))


def loss_text(formatted: Column, mask: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(mask, lambda m: unescape(F.substring(
        formatted, (m["start"] + 1).cast("int"), (m["end"] - m["start"]).cast("int")))), "")


def text_turns(conversations: DataFrame) -> DataFrame:
    """The turns of a table of plain texts: one text part each."""
    none = F.lit(None)
    part = F.struct(F.lit("text").alias("type"), F.coalesce("text", F.lit("")).alias("text"),
                    none.cast("string").alias("ref"), none.cast("double").alias("units"),
                    none.cast("int").alias("width"), none.cast("int").alias("height"))
    return conversations.select("conv_id", "turn", "role", F.array(part).alias("parts"))


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Format every conversation and conversation -7, and read the results back."""
    probe = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("\\### Assistant: </turn> ok").alias("text"))
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    done = format_conversations(text_turns(rows.unionByName(probe)))
    back = done.select(
        "conv_id", "formatted", "attachments", parse_turns(F.col("formatted")).alias("turns"),
        loss_text(F.col("formatted"), F.col("loss_mask")).alias("loss"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(
        t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.encode(said, "UTF-8"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.encode("loss", "UTF-8"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        F.size("attachments").cast("long").alias("n_attachments"),
        F.aggregate("attachments", F.lit(0).cast("long"),
                    lambda s, a: s + a["tokens"]).alias("attachment_tokens"))


# The template is fixed, so the digests follow from the rows alone: escaping
# lengthens a text by 4 for each "&" and 3 for each "<", and a turn has 22 characters
# of marks beside its role.
OP6_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
sized AS (
  SELECT *, length(text) + 4 * (length(text) - length(replace(text, '&', '')))
            + 3 * (length(text) - length(replace(text, '<', ''))) + length(role) + 22 AS chars FROM turns)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(chars)::BIGINT AS formatted_chars, 0::BIGINT AS n_attachments, 0::BIGINT AS attachment_tokens
FROM sized GROUP BY conv_id"""
