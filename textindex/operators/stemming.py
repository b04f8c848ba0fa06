"""C4: stemming as a vocabulary job.

The suffix steps of ``functions.stemming`` run once for each distinct term of a
language, as SQL expressions; the resulting dictionary is joined back to the tokens.
A ``StemDictionary`` keeps it, so that later runs stem only terms that are new.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textindex.functions.stemming import SPARK, english_steps, spanish_steps
from textindex.functions.stopwords import ENGLISH, SPANISH
from textindex.session import ensure_checkpoint_dir

BROADCAST_BYTES = 32 << 20
BLOCK_BYTES = 8 << 20        # of text whose distinct terms meet their stems together


def _apply(words: DataFrame, steps: list[dict[str, str]]) -> DataFrame:
    for step in steps:
        words = words.withColumns({name: F.expr(sql) for name, sql in step.items()})
    return words.select("language", "term", "stem")


def stem_words(words: DataFrame) -> DataFrame:
    """``(language, term, stem)`` of distinct ``(language, term)``; Spanish or English."""
    spanish = F.col("language") == SPANISH
    return (_apply(words.filter(spanish), spanish_steps(SPARK))
            .unionByName(_apply(words.filter(~spanish), english_steps(SPARK))))


def stem_vocabulary(terms_df: DataFrame, term_col: str = "term",
                    language_col: str = "language") -> DataFrame:
    """``(language, term, stem)`` for each distinct term of ``terms_df``."""
    return stem_words(terms_df.select(F.coalesce(language_col, F.lit(ENGLISH)).alias("language"),
                                      F.col(term_col).alias("term")).distinct())


class StemDictionary:
    """Stems kept under a folder on shared storage, so that a term is stemmed once.

    ``<root>/part-<uuid>/`` holds ``(language, term, stem)`` of the terms that one run
    found unseen. A part counts once Spark has committed it; parts of runs at the same
    time may repeat a term, always with the same stem.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    def read(self) -> DataFrame:
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        folder = path(self.root)
        fs = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [s.getPath().toString() for s in fs.listStatus(folder)] if fs.exists(folder) else []
        parts = [n for n in names if fs.exists(path(f"{n}/_SUCCESS"))]
        if not parts:
            return self.spark.createDataFrame([], "language string, term string, stem string")
        return self.spark.read.schema("language string, term string, stem string").parquet(*parts)

    def stems(self, vocabulary: DataFrame) -> DataFrame:
        """``(language, term, stem)`` of the given terms; unseen ones are stemmed and kept."""
        key = ["language", "term"]
        unseen = vocabulary.join(self.read(), key, "left_anti")
        stem_words(unseen).write.parquet(f"{self.root}/part-{uuid.uuid4().hex}")
        return vocabulary.join(self.read(), key).dropDuplicates(key)


def stem_tokens(texts: DataFrame, analyzed: Callable[[DataFrame], DataFrame],
                dictionary: StemDictionary | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``(..., language, pos, term)`` of the rows ``analyzed(texts)(..., language, terms)``, with
    each term replaced by its stem. ``analyzed`` adds to the columns of any rows of ``texts``.

    Only the vocabulary is shuffled: the stems of terms that change are broadcast where
    their counted size allows. Beyond it the texts are dealt into blocks of about
    ``block_bytes`` by a hash of the whole row, and a block meets the stems of its own
    distinct terms (cogrouped), so tokens are neither shuffled nor sorted.
    """
    ensure_checkpoint_dir(texts.sparkSession)
    rows, key = analyzed(texts), ["language", "term"]
    others = [c for c in rows.columns if c != "terms"]
    # outer: else Spark adds a filter on the terms' number, for which it analyzes texts twice
    tokens = rows.select(*others, F.posexplode_outer("terms").alias("pos", "term")).filter("pos IS NOT NULL")
    vocabulary = tokens.select(*key).distinct()
    if dictionary is not None:
        vocabulary = vocabulary.checkpoint(eager=True)
    # checkpointed before the filter, which would otherwise be pushed through all steps
    stems = (stem_words(vocabulary) if dictionary is None else dictionary.stems(vocabulary)).checkpoint(eager=True)
    stems = stems.filter("stem <> term")
    size = stems.agg(F.count(F.lit(1)).alias("n"), F.coalesce(
        F.sum(F.octet_length("term") + F.octet_length("stem")), F.lit(0)).alias("b")).first()
    if size["b"] + 64 * size["n"] <= BROADCAST_BYTES:
        return (tokens.join(F.broadcast(stems), key, "left")
                .select(*others, "pos", F.coalesce("stem", "term").alias("term")))
    lengths = [F.coalesce(F.octet_length(c), F.lit(0)).cast("long") for c, kind in texts.dtypes if kind == "string"]
    held = texts.agg(F.coalesce(F.sum(sum(lengths, F.lit(0))), F.lit(0)).alias("b")).first()["b"]
    block = F.pmod(F.xxhash64(*texts.columns), F.lit(max(1, -(-held // block_bytes)))).alias("_block")
    met = (analyzed(texts.withColumn("_block", block)).select("_block", "language", F.explode_outer("terms").alias("term"))
           .distinct()
           .join(stems, key).select("_block", *key, "stem"))
    dealt = analyzed(texts.withColumn("_block", block).repartition("_block")).select("_block", *others, "terms")

    def replaced(left: pa.Table, right: pa.Table) -> pa.Table:
        found = [left.slice(0, 0).drop_columns(["_block"])]
        for language in pc.unique(left["language"]):
            mine = left.filter(pc.equal(left["language"], language)).drop_columns(["_block"])
            known = right.filter(pc.equal(right["language"], language)).combine_chunks()
            terms = pc.list_flatten(mine["terms"])
            at = pc.index_in(terms, value_set=known["term"])
            new = pa.chunked_array(pc.coalesce(known["stem"].take(at), terms)).combine_chunks()
            ends = pc.cumulative_sum(pc.list_value_length(mine["terms"])).combine_chunks()
            offsets = pa.concat_arrays([pa.array([0], ends.type), ends])
            kind = mine.schema.field("terms")
            found.append(mine.set_column(mine.schema.get_field_index("terms"), kind,
                                         pa.ListArray.from_arrays(offsets, new).cast(kind.type)))
        return pa.concat_tables(found)

    return (dealt.groupBy("_block").cogroup(met.groupBy("_block"))
            .applyInArrow(replaced, dealt.drop("_block").schema)
            .select(*others, F.posexplode("terms").alias("pos", "term")))
