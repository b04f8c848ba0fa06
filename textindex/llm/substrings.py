"""Operator 1: substring dedup by hashing lines and units of lines.

Every line is a unit. A line of several sentences (cut after runs of ``.``, ``!`` and
``?``) holds further units, so that a passage is found inside a longer paragraph too:
each sentence of ``min_words`` words or more, and each such sentence together with the
shorter ones that follow it (for a line's first, also those before it), so short
sentences go with their neighbour. Units are normalised to their lower-cased words and
hashed to 128 bits. Digests are grouped over all documents (counted in the tasks first,
so a passage that a third of all documents holds is one row a task), the occurrence
that comes first by document id and place is kept, and all others are removed. Removed
units are reported with their places in the original text; of units inside each other,
the outer one.

A line's units lie apart or inside each other, and then differ in their number of
words, so a unit's first occurrence never overlaps a later one: every removed word
leads back to one that stays.

``min_line_words`` is the least number of words of a line that goes as a whole: 3, so that
headings and list marks of one or two words, which repeat in unrelated texts, stay; 1
removes every repeated line. Lines without a word stay.

Edge cases: null text is empty; rows that share a doc_id and text are one document,
so the same place in them counts once; rows that share a doc_id alone are documents of
their own, told apart and ranked by a hash of the text; a null doc_id is the last in rank; units repeated
in one document lose all but the first; an empty table gives no rows. Other
columns are not read and may have any name.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textindex.llm.common import materialize, read
from textindex.llm.shingles import plain_words

MIN_WORDS = 5
MIN_LINE_WORDS = 3
LINE = re.compile(r"[^\n]+")
SENTENCE = re.compile(r"[^.!?]+[.!?]*")
_LAST = (1 << 63) - 1


def units(text: str, min_words: int = MIN_WORDS,
          min_line_words: int = MIN_LINE_WORDS) -> Iterator[tuple[int, int, bytes]]:
    """``(start, end, digest)`` of each unit."""
    def unit(start: int, end: int, words: list[bytes]) -> tuple[int, int, bytes]:
        return start, end, xxhash.xxh3_128_digest(b" ".join(words))

    for line in LINE.finditer(text):
        sentences = [(m.start() + line.start(), m.end() + line.start(), plain_words(m[0]))
                     for m in SENTENCE.finditer(line[0])]
        sentences = [s for s in sentences if s[2]]
        whole = [w for s in sentences for w in s[2]]
        if whole and len(whole) >= min(min_words, min_line_words):
            yield unit(line.start(), line.end(), whole)
        joined: list[list[tuple[int, int, list[bytes]]]] = []
        n_long = 0
        for sentence in sentences:
            is_long = len(sentence[2]) >= min_words
            n_long += is_long
            if not joined or (is_long and n_long > 1):
                joined.append([])
            joined[-1].append(sentence)
            if is_long and len(sentence[2]) < len(whole):
                yield unit(*sentence)
        if len(joined) > 1:
            for group in joined:
                if len(group) > 1:
                    yield unit(group[0][0], group[-1][1], [w for s in group for w in s[2]])


def _unit_rows(min_words: int, min_line_words: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, texts, starts, ends, digests = [], [], [], [], []
            for doc, h, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                for start, end, digest in units(text or "", min_words, min_line_words):
                    docs.append(doc)
                    texts.append(h)
                    starts.append(start)
                    ends.append(end)
                    digests.append(digest)
            both = np.frombuffer(b"".join(digests), dtype="<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_pydict({
                "k": pa.array(docs, pa.int64()), "h": pa.array(texts, pa.int64()), "start": pa.array(starts, pa.int32()),
                "end": pa.array(ends, pa.int32()), "a": pa.array(both[:, 0].copy()),
                "b": pa.array(both[:, 1].copy())})
    return rows


def repeated_units(docs: DataFrame, min_words: int = MIN_WORDS,
                   min_line_words: int = MIN_LINE_WORDS) -> DataFrame:
    """``(k, h, start, end)`` of every unit to remove, ``docs`` being ``(k, h, text)``.

    Texts are parsed once. The first places are written before they meet the units, so
    that both sides of the join are plain shuffles, which Spark splits at a hot unit.
    """
    found = materialize(docs.select("k", "h", "text").mapInArrow(
        _unit_rows(min_words, min_line_words), "k long, h long, start int, end int, a long, b long"), "units")
    place = F.struct("k", "h", "start")
    first = materialize(found.groupBy("a", "b").agg(F.min(place).alias("first"), F.max(place).alias("last"))
                        .filter("first != last").select("a", "b", "first"), "first-units")
    return (found.join(first, ["a", "b"]).filter(place != F.col("first"))
            .select("k", "h", "start", "end"))


def outermost(found: DataFrame) -> DataFrame:
    """Of the units that lie inside each other, the outer ones, once each."""
    before = (Window.partitionBy("k", "h").orderBy("start", F.desc("end"))
              .rowsBetween(Window.unboundedPreceding, -1))
    return (found.withColumn("reached", F.coalesce(F.max("end").over(before), F.lit(0)))
            .filter("start >= reached").drop("reached"))


def remove_repeats(docs: DataFrame, min_words: int = MIN_WORDS,
                   min_line_words: int = MIN_LINE_WORDS) -> DataFrame:
    """``(doc_id, n_removed, removed_chars, removed, text)``: the text without repeats,
    and the places of what was removed as ``start:end``, comma-joined."""
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"),
                       F.coalesce("doc_id", F.lit(_LAST)).alias("k"),
                       F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"))
    spans = materialize(outermost(repeated_units(base, min_words, min_line_words)).groupBy("k", "h")
                        .agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans")), "spans")
    joined = base.join(spans, ["k", "h"], "left").withColumn(
        "spans", F.coalesce("spans", F.array().cast("array<struct<start:int,end:int>>")))
    # what stays lies between the removed spans
    stops = F.concat(F.transform("spans", lambda s: s["start"]), F.array(F.length("text")))
    starts = F.concat(F.array(F.lit(0)), F.transform("spans", lambda s: s["end"]))
    pieces = F.zip_with(starts, stops, lambda a, b: F.substring("text", a + 1, b - a))
    return joined.select(
        "doc_id", F.size("spans").cast("long").alias("n_removed"),
        F.aggregate("spans", F.lit(0).cast("long"),
                    lambda n, s: n + s["end"] - s["start"]).alias("removed_chars"),
        F.array_join(F.transform("spans", lambda s: F.concat_ws(
            ":", s["start"].cast("string"), s["end"].cast("string"))), ",").alias("removed"),
        F.when(F.size("spans") == 0, F.col("text")).otherwise(F.array_join(pieces, "")).alias("text"))


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Remove repeated units from all documents; one row a document."""
    return remove_repeats(read(spark, sf_dir, "documents"))


OP1_SQL = r"""
WITH pieces AS (
  SELECT doc_id, unnest(parts) AS piece, generate_subscripts(parts, 1) AS i
  FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\n.!?]+[.!?]*|\n|[.!?]+') AS parts FROM documents)),
placed AS (
  SELECT doc_id, i, piece,
    sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY i) - length(piece) AS s,
    sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY i) AS e,
    count(*) FILTER (piece = chr(10)) OVER (PARTITION BY doc_id ORDER BY i) AS line,
    regexp_extract_all(lower(piece), '[\p{L}\p{N}]+') AS words FROM pieces),
lines AS (
  SELECT doc_id, line, min(s) AS s, max(e) AS e, sum(len(words)) AS n,
    string_agg(array_to_string(words, ' '), ' ' ORDER BY i) FILTER (len(words) > 0) AS key
  FROM placed WHERE piece <> chr(10) GROUP BY doc_id, line),
sentences AS (
  SELECT p.doc_id, p.line, p.i, p.s, p.e, len(p.words) AS n, l.n AS line_n, array_to_string(p.words, ' ') AS key,
    greatest(1, count(*) FILTER (len(p.words) >= 5) OVER (PARTITION BY p.doc_id, p.line ORDER BY p.i)) AS part
  FROM placed p JOIN lines l USING (doc_id, line) WHERE len(p.words) > 0),
joined AS (
  SELECT doc_id, min(s) AS s, max(e) AS e, string_agg(key, ' ' ORDER BY i) AS key
  FROM sentences GROUP BY doc_id, line, part HAVING count(*) > 1 AND sum(n) < max(line_n)),
units AS (
  SELECT doc_id, s, e, key FROM lines WHERE n >= 3
  UNION ALL SELECT doc_id, s, e, key FROM sentences WHERE n >= 5 AND n < line_n
  UNION ALL SELECT doc_id, s, e, key FROM joined),
ranked AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY doc_id, s) AS nth FROM units),
reach AS (
  SELECT doc_id, s, e, max(e) OVER (PARTITION BY doc_id ORDER BY s, e DESC
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached FROM ranked WHERE nth > 1),
spans AS (SELECT doc_id, s, e FROM reach WHERE reached IS NULL OR s >= reached),
removed AS (
  SELECT doc_id, count(*) AS n, sum(e - s)::BIGINT AS chars,
    string_agg(s::BIGINT::VARCHAR || ':' || e::BIGINT::VARCHAR, ',' ORDER BY s) AS places FROM spans GROUP BY doc_id),
kept AS (
  SELECT p.doc_id, string_agg(p.piece, '' ORDER BY p.i) AS text
  FROM placed p ASOF LEFT JOIN spans x ON p.doc_id = x.doc_id AND p.s >= x.s
  WHERE x.e IS NULL OR p.s >= x.e GROUP BY p.doc_id)
SELECT d.doc_id, coalesce(r.n, 0) AS n_removed, coalesce(r.chars, 0) AS removed_chars,
  coalesce(r.places, '') AS removed, coalesce(k.text, '') AS text
FROM documents d LEFT JOIN removed r USING (doc_id) LEFT JOIN kept k USING (doc_id)"""
