"""Registered queries of the training-data operators, and their DuckDB SQL.

Operators 2, 3, 5, 8, 9, 11 and 12 train, schedule, hash, tokenize or iterate in ways that SQL can't repeat;
``tests/llm`` holds them against brute force instead.
"""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession

from textindex.llm.chat import OP6_SQL, op6_chat_format
from textindex.llm.decontaminate import OP10_SQL, op10_decontamination
from textindex.llm.fingerprints import op9_document_fingerprints
from textindex.llm.jaccard import OP7_SQL, op7_jaccard_join
from textindex.llm.language import op8_language_id
from textindex.llm.linededup import OP4_SQL, op4_line_dedup
from textindex.llm.merkle import OP13_SQL, op13_merkle_manifest
from textindex.llm.mixing import op2_mixing
from textindex.llm.pieces import op11_sentence_pieces
from textindex.llm.secrets import op3_secret_scan
from textindex.llm.substrings import OP1_SQL, op1_substring_dedup
from textindex.llm.warc import op5_warc
from textindex.llm.whitening import op12_embedding_whitening

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {f.__name__: f for f in (
    op1_substring_dedup, op2_mixing, op3_secret_scan, op4_line_dedup, op5_warc, op6_chat_format,
    op7_jaccard_join, op8_language_id, op9_document_fingerprints, op10_decontamination,
    op11_sentence_pieces, op12_embedding_whitening, op13_merkle_manifest)}
QUERIES["pipeline"] = corpus_pipeline.run

ORACLES: dict[str, str] = {
    "op1_substring_dedup": OP1_SQL,
    "op4_line_dedup": OP4_SQL,
    "op6_chat_format": OP6_SQL,
    "op7_jaccard_join": OP7_SQL,
    "op10_decontamination": OP10_SQL,
    "op13_merkle_manifest": OP13_SQL,
}
if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
