"""The training-corpus pipeline: five stages over ``documents``.

Each stage takes ``(spark, docs, sf_dir)``, works on all rows that its predecessor
kept, and is written as Parquet and read again before the next. All but the last
return the columns of ``documents``; the last adds the mixture's columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textindex.llm.common import materialize, read
from textindex.llm.decontaminate import remove_contaminated
from textindex.llm.jaccard import drop_near_copies
from textindex.llm.language import UNDETERMINED, fit, identify
from textindex.llm.linededup import dedup_lines
from textindex.llm.mixing import mix

# A text whose trigrams' best cosine is lower resembles no language of the corpus. Of texts
# of 10 random Latin letter words 1 to 3 % reach 0.045, of Cyrillic ones none; the lowest
# document of sf0.01 has 0.053 ("Von."), of the first 6,000 of sf0.1 0.048.
MIN_LANGUAGE_LIKENESS = 0.045
NEAR_COPY_WORDS, NEAR_COPY_THRESHOLD = 5, 80   # word shingles, hundredths


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents whose text is found to be in one of the corpus' languages."""
    found = identify(docs, fit(docs), with_likeness=True)
    return (found.filter((F.col("lang_pred") != UNDETERMINED) & (F.col("likeness") >= MIN_LANGUAGE_LIKENESS))
            .select(*docs.columns))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop lines that a document of smaller id holds; ``n_chars`` follows the text.

    A document that loses all its text that way goes.
    """
    kept = dedup_lines(docs)
    return (kept.filter(F.trim("text") != "")
            .select(*[F.length("text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars"
                      else F.col(c) for c in docs.columns]))


def near_copy_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near copies."""
    return drop_near_copies(docs, words=NEAR_COPY_WORDS, threshold=NEAR_COPY_THRESHOLD)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that contain an item of the benchmark."""
    return remove_contaminated(docs, read(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Give every document its place in the mixture of sources."""
    return mix(docs)


STAGES = [
    ("language", language_stage),
    ("lines", line_stage),
    ("near_copies", near_copy_stage),
    ("benchmark", benchmark_stage),
    ("mixing", mixing_stage),
]

# The first stage's trained vectors and the last stage's schedule are not SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``, each written and read again."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
