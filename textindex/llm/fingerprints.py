"""Operator 9: document fingerprints by a homomorphic multiset hash.

Each paragraph (a line, cut further at sentence ends, so that a one-line text
has several) is hashed to a wide vector of bits; a document's fingerprint is the
sum of its paragraphs' vectors, modulo a power of two, and the number of
paragraphs. The sum does not depend on order, and paragraphs are inserted or
deleted by adding or subtracting their vectors. Three 20-bit counters share one
60-bit word, so a word holds them modulo 2**60 and one addition serves three.

The counters, centred (twice the counter less the number of paragraphs), are a
random projection of the multiset of paragraphs; their cosine estimates how much
of two documents agrees (standard error about 0.06 with 240 counters).

Edge cases: null text is the empty text (one empty paragraph); equal texts have
equal fingerprints; rows that share a doc_id share their next document, which is
the next larger doc_id (among rows of that id, the text of least hash); a null
doc_id sorts before all others; the last id is followed by the first; a table of
one id is followed by itself. Only ``doc_id`` and ``text`` are read, so other
columns may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textindex.llm.common import materialize, read
from textindex.llm.native import let

PARAGRAPH_END = r"\n|(?<=[.!?])\x20+"
SHIFTS = 20                       # words per 64-bit hash
HASHES = 4
WORDS = SHIFTS * HASHES           # 240 counters
COUNTER_BITS = 20
_ONES = 1 | 1 << 20 | 1 << 40     # bit 0 of each counter
_WORD = (1 << 60) - 1
_COUNTER = (1 << COUNTER_BITS) - 1


def paragraphs(text: Column) -> Column:
    return F.split(text, PARAGRAPH_END)


def fingerprint(parts: Column) -> Column:
    """Array of longs: the number of paragraphs, then ``WORDS`` sums modulo 2**60."""
    def sums(hashes: Column) -> Column:
        def word(k: int) -> Column:
            return F.aggregate(hashes, F.lit(0).cast("long"), lambda s, h: (
                s + F.shiftright(h, k).bitwiseAND(F.lit(_ONES))).bitwiseAND(F.lit(_WORD)))
        return F.array(*[word(k) for k in range(SHIFTS)])

    def vector(ps: Column) -> Column:
        return F.concat(F.array(F.size(ps).cast("long")),
                        *[let(hashes(ps, seed), sums) for seed in range(HASHES)])

    def hashes(ps: Column, seed: int) -> Column:
        return F.transform(ps, lambda p: F.xxhash64(p, F.lit(seed)))

    return let(parts, vector)


def combine(a: Column, b: Column, sign: int = 1) -> Column:
    """Fingerprint of the union (``sign`` 1) or difference (-1) of two multisets."""
    return F.zip_with(a, b, lambda x, y: F.pmod(x + F.lit(sign).cast("long") * y, F.lit(_WORD + 1)))


def as_text(fp: Column) -> Column:
    """Fixed-width lower-case hex, 15 digits a word."""
    return F.array_join(F.transform(fp, lambda w: F.lpad(F.lower(F.hex(w)), 15, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Cosine of the centred counters, cut to 0..1; exactly 1 for equal fingerprints."""
    def counters(fp: Column) -> Column:
        n = F.get(fp, F.lit(0))
        words = F.slice(fp, 2, WORDS)
        return F.flatten(F.transform(words, lambda w: F.array(*[
            (F.shiftright(w, s).bitwiseAND(F.lit(_COUNTER)) * 2 - n).cast("double")
            for s in (0, COUNTER_BITS, 2 * COUNTER_BITS)])))

    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)

    cosine = let(counters(a), lambda x: let(counters(b), lambda y: let(
        F.sqrt(dot(x, x) * dot(y, y)),
        lambda norm: F.when(norm > 0, dot(x, y) / norm).otherwise(F.lit(0.0)))))
    return F.when(a == b, F.lit(1.0)).otherwise(
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), cosine)))


def previous_ids(docs: DataFrame) -> DataFrame:
    """``(k, pick, prev_k, prev_half)`` for each distinct document key ``k``.

    ``prev_k`` is the next smaller key (the largest, for the smallest) and
    ``prev_half`` the code points that its edit takes from ``k``. Keys are dealt
    by range, so no task sees them all; only the last key of each range meets
    the others, one row a range.
    """
    ids = docs.groupBy("k").agg(F.max("half").alias("half"), F.min("h").alias("pick"))
    ranged = materialize(ids.repartitionByRange("k").withColumn("part", F.spark_partition_id()),
                         "fingerprint-ids")
    last = ranged.groupBy("part").agg(F.max(F.struct("k", "half")).alias("last"))
    ordered = Window.orderBy("part")
    before = last.select("part", F.coalesce(
        F.lag("last").over(ordered),
        F.max_by("last", "part").over(Window.partitionBy())).alias("before"))
    here = Window.partitionBy("part").orderBy("k")
    return (ranged.withColumn("prev", F.lag(F.struct("k", "half")).over(here))
            .join(before, "part")
            .withColumn("prev", F.coalesce("prev", "before"))
            .select("k", "pick", F.col("prev.k").alias("prev_k"),
                    F.col("prev.half").alias("prev_half")))


def document_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edit with the next document."""
    # the id is read back from the key: both uses of the texts then ask for the
    # same columns, and share one shuffle
    first = F.lit(-(1 << 63))
    base = docs.select(F.coalesce("doc_id", first).alias("k"),
                       F.coalesce("text", F.lit("")).alias("text"))
    ids = previous_ids(base.select("k", F.floor(F.length("text") / 2).cast("int").alias("half"),
                                   F.xxhash64("text").alias("h")))
    # Both uses of the texts are dealt by the key alone, so they share one shuffle;
    # the test by XOR, unlike an equality, does not become a second join key.
    following = (base.join(ids, "k")
                 .filter(F.xxhash64("text").bitwiseXOR(F.col("pick")) == 0)
                 .select(F.col("prev_k").alias("k"),
                         F.struct(F.left("text", "prev_half").alias("head"),
                                  fingerprint(paragraphs(F.col("text"))).alias("next_fp")).alias("next"))
                 .groupBy("k").agg(F.max("next").alias("next")))
    both = (base.join(following, "k", "left")
            .withColumn("fp", fingerprint(paragraphs(F.col("text"))))
            .withColumn("n_chars", F.length("text"))
            .withColumn("half", F.floor(F.col("n_chars") / 2).cast("int"))
            .withColumn("edited", F.concat(F.left("text", F.col("n_chars") - F.col("half")),
                                           F.left("next.head", "half")))
            .withColumn("edited_fp", fingerprint(paragraphs(F.col("edited")))))
    return both.select(
        F.nullif("k", first).alias("doc_id"), F.col("n_chars").cast("long").alias("n_chars"),
        F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"),
        as_text(F.col("fp")).alias("fingerprint"),
        as_text(F.col("edited_fp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"),
        likeness(F.col("fp"), F.col("next.next_fp")).alias("near_next"))


def op9_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text."""
    return document_fingerprints(read(spark, sf_dir, "documents"))
