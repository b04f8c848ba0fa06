"""Operator 4: line dedup through sharded minimal perfect hashes.

A line's key is the line stripped of ASCII white space with A-Z lower-cased. Keys
of ``min_chars`` code points or more are hashed to 128 bits; distinct hashes are
dealt into shards. Two passes:

* ``build_index`` counts the distinct hashes and writes one row for each shard: a
  minimal perfect hash (levels of bit arrays, in which a hash that is alone at its
  place is settled, the others going on to the next level) and three compact arrays
  that it indexes: 32-bit fingerprints, counts of holders, and first holders. The
  lines themselves are not kept.
* ``kept_lines`` probes a stored index with documents, those it was built from or
  others. Documents do not join lines: they are dealt into small blocks, a block
  sends each distinct hash once to the hash's shard (so a line in a third of all
  documents costs a row for each block, not for each document), probes the arrays
  there, and gets back only the hashes whose lines it must drop. A shard is handed
  out once for every ``PART_BLOCKS`` blocks, so that no task meets more rows of one
  line than that.

A line goes if at least ``min_holders`` documents of the index hold it and the first
of them is smaller than the line's document. Different keys are taken as equal if
their 128-bit hashes are. A hash that was not indexed is told by its fingerprint,
wrongly in one of 2^32 cases; hashes of documents of the index are always right.

Blocks follow the rows and the bytes of the texts; a block holds the texts that fall
into it, so about ``BLOCK_BYTES`` and its longest texts. Rows go to blocks by id and
text, so null or repeated ids with different texts are spread.

Edge cases: null or empty text is one empty line; short keys are never dropped; a
line repeated in its smallest document stays there each time; rows that share a
doc_id are one document when lines are dropped, each gets a result, and each distinct
one counts as a holder where they differ in text or lie in different batches; a null
doc_id is the largest; an empty table gives an index without rows and no rows. Only
the id and text columns are read, and ``dedup_lines`` keeps all other columns as
they are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textindex.llm.common import block_of, blocks_for, materialize, read

MIN_CHARS = 10
MIN_HOLDERS = 2
DOCS_PER_BLOCK = 64        # documents that get their answers together
BLOCK_BYTES = 2 << 20      # bytes of their texts
SHARD_LINES = 50_000       # lines a shard is sized for, repeated ones included
PART_BLOCKS = 1 << 18      # blocks that probe one copy of a shard
_GAMMA = 1.5               # bits a hash at each level
_LAST = (1 << 63) - 1      # a null doc_id


def line_key(line: bytes) -> bytes:
    return line.strip(b" \t\n\x0b\x0c\r").lower()


def key_hashes(text: str | None, min_chars: int = MIN_CHARS) -> tuple[list[bytes], list[bytes | None]]:
    """The lines of a text, and each key's 16-byte hash (None for a short key)."""
    lines = (text or "").encode("utf-8", "surrogatepass").split(b"\n")
    hashes: list[bytes | None] = []
    for line in lines:
        key = line_key(line)
        long_enough = len(key) >= min_chars and (
            len(key) >= 4 * min_chars or len(key.decode("utf-8", "surrogatepass")) >= min_chars)
        hashes.append(xxhash.xxh3_128_digest(key) if long_enough else None)
    return lines, hashes


def _mix(high: np.ndarray, low: np.ndarray, level: int) -> np.ndarray:
    """A 64-bit hash of a 128-bit one, another for each level."""
    x = high ^ (low * np.uint64(2 * level + 0x9E3779B97F4A7C15 | 1))
    x ^= x >> np.uint64(31)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


class LineShard:
    """A minimal perfect hash over distinct hashes, and the arrays it indexes."""

    def __init__(self, levels: list[np.ndarray], ranks: list[int], fingerprints: np.ndarray,
                 counts: np.ndarray, first: np.ndarray):
        self.levels, self.ranks = levels, ranks
        self.fingerprints, self.counts, self.first = fingerprints, counts, first
        self._before = [np.concatenate([[0], np.cumsum(bits, dtype=np.int64)]) for bits in levels]

    @classmethod
    def build(cls, high: np.ndarray, low: np.ndarray, counts: np.ndarray, first: np.ndarray) -> LineShard:
        """``high`` and ``low`` are the halves of distinct hashes."""
        levels, ranks, settled = [], [], 0
        left = np.arange(len(high))
        while len(left):
            size = max(1, int(len(left) * _GAMMA))
            at = (_mix(high[left], low[left], len(levels)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(alone)
            ranks.append(settled)
            settled += int(alone.sum())
            left = left[~alone[at]]
        shard = cls(levels, ranks, np.zeros(len(high), np.uint32), np.zeros(len(high), np.uint32),
                    np.zeros(len(high), np.int64))
        index = shard.index(high, low)
        shard.fingerprints[index] = (low >> np.uint64(32)).astype(np.uint32)
        shard.counts[index] = np.minimum(counts, 0xFFFFFFFF)
        shard.first[index] = first
        return shard

    def index(self, high: np.ndarray, low: np.ndarray) -> np.ndarray:
        """A hash's number, 0..n-1; -1 for most hashes that were not indexed."""
        out = np.full(len(high), -1, dtype=np.int64)
        left = np.arange(len(high))
        for level, (bits, rank, before) in enumerate(zip(self.levels, self.ranks, self._before)):
            if not len(left):
                break
            at = (_mix(high[left], low[left], level) % np.uint64(len(bits))).astype(np.int64)
            hit = bits[at]
            out[left[hit]] = rank + before[at[hit]]
            left = left[~hit]
        return out

    def probe(self, high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Counts of holders (0 if unknown) and first holders of the given hashes."""
        index = self.index(high, low)
        known = index >= 0
        known[known] = self.fingerprints[index[known]] == (low[known] >> np.uint64(32)).astype(np.uint32)
        counts, first = np.zeros(len(high), np.int64), np.full(len(high), _LAST)
        counts[known] = self.counts[index[known]]
        first[known] = self.first[index[known]]
        return counts, first

    def to_row(self, shard: int) -> pa.Table:
        """The shard as one row of ``INDEX_SCHEMA``."""
        return pa.table({
            "shard": pa.array([shard], pa.int32()),
            "sizes": pa.array([[len(bits) for bits in self.levels]], pa.list_(pa.int32())),
            "ranks": pa.array([self.ranks], pa.list_(pa.int32())),
            "bits": pa.array([[np.packbits(bits).tobytes() for bits in self.levels]], pa.list_(pa.binary())),
            "fingerprints": pa.array([self.fingerprints.tobytes()], pa.binary()),
            "counts": pa.array([self.counts.tobytes()], pa.binary()),
            "firsts": pa.array([self.first.tobytes()], pa.binary())})

    @classmethod
    def of_row(cls, row: dict) -> LineShard:
        levels = [np.unpackbits(np.frombuffer(bits, np.uint8), count=size).astype(bool)
                  for bits, size in zip(row["bits"], row["sizes"])]
        return cls(levels, row["ranks"], np.frombuffer(row["fingerprints"], np.uint32),
                   np.frombuffer(row["counts"], np.uint32), np.frombuffer(row["firsts"], np.int64))


INDEX_SCHEMA = ("shard int, sizes array<int>, ranks array<int>, bits array<binary>, "
                "fingerprints binary, counts binary, firsts binary")


@dataclass
class LineIndex:
    """A stored index: a row for each shard that holds a line, and how many shards there are."""

    rows: DataFrame
    shards: int


def _halves(hashes: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(b"".join(hashes), dtype="<u8").reshape(-1, 2)
    return both[:, 0].copy(), both[:, 1].copy()


def _ids(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return column.cast(pa.int64()).fill_null(_LAST).to_numpy(zero_copy_only=False) if isinstance(
        column, pa.Array) else column.cast(pa.int64()).fill_null(_LAST).to_numpy()


def _line_holders(min_chars: int, shards: int):
    """Rows (shard, hash, holders, smallest holder) of each batch of documents."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: dict[bytes, set[int]] = {}
            for doc, text in zip(_ids(batch.column(0)).tolist(), batch.column(1)):
                for h in set(key_hashes(text.as_py(), min_chars)[1]):
                    if h is not None:
                        held.setdefault(h, set()).add(doc)
            if held:
                a, b = _halves(list(held))
                yield pa.RecordBatch.from_pydict({
                    "shard": pa.array((a % np.uint64(shards)).astype(np.int32)),
                    "a": pa.array(a.view(np.int64)), "b": pa.array(b.view(np.int64)),
                    "n": pa.array([len(x) for x in held.values()], pa.int64()),
                    "first": pa.array([min(x) for x in held.values()], pa.int64())})
    return rows


def _build_shard(key: tuple, table: pa.Table) -> pa.Table:
    """The index row of a shard's distinct hashes."""
    a, b, n, first = (table.column(c).to_numpy() for c in ("a", "b", "n", "first"))
    return LineShard.build(a.view(np.uint64), b.view(np.uint64), n, first).to_row(key[0].as_py())


def build_index(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                min_chars: int = MIN_CHARS) -> LineIndex:
    """Index the distinct lines of ``docs``, written to the shared folder.

    Shards follow the counted lines; a shard's rows are combined before they are
    gathered, so a common line costs it a row.
    """
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    lines = docs.agg(F.coalesce(F.sum(
        F.octet_length(body) - F.octet_length(F.replace(body, F.lit("\n"), F.lit(""))) + 1),
        F.lit(0)).alias("n")).first()["n"]
    shards = blocks_for(lines, SHARD_LINES)
    held = docs.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").alias("text")).mapInArrow(
        _line_holders(min_chars, shards), "shard int, a long, b long, n long, first long")
    distinct = held.groupBy("shard", "a", "b").agg(F.sum("n").alias("n"), F.min("first").alias("first"))
    return LineIndex(materialize(distinct.groupBy("shard").applyInArrow(_build_shard, INDEX_SCHEMA),
                                 "line-index"), shards)


def _questions(min_chars: int, shards: int):
    """Rows (shard, part, block, hash): each distinct hash of a block in a batch of documents."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            asked = {(block, h) for block, text in zip(batch.column("block").to_pylist(), batch.column("text"))
                     for h in key_hashes(text.as_py(), min_chars)[1] if h is not None}
            if asked:
                a, b = _halves([h for _, h in asked])
                block = np.array([k for k, _ in asked], dtype=np.int64)
                yield pa.RecordBatch.from_pydict({
                    "shard": pa.array((a % np.uint64(shards)).astype(np.int32)),
                    "part": pa.array((block // PART_BLOCKS).astype(np.int32)),
                    "block": pa.array(block.astype(np.int32)),
                    "a": pa.array(a.view(np.int64)), "b": pa.array(b.view(np.int64))})
    return rows


def _probe_shard(min_holders: int):
    def answers(key: tuple, asked: pa.Table, index: pa.Table) -> pa.Table:
        """Probe a shard for the blocks that ask it; the lines that enough documents hold."""
        a, b = (asked.column(c).to_numpy().view(np.uint64) for c in ("a", "b"))
        held = index.num_rows > 0
        counts, first = (LineShard.of_row(index.to_pylist()[0]).probe(a, b) if held else
                         (np.zeros(len(a), np.int64), np.full(len(a), _LAST)))
        told = counts >= min_holders
        return pa.table({"block": pa.array(asked.column("block").to_numpy()[told], pa.int32()),
                         "a": pa.array(a[told].view(np.int64)), "b": pa.array(b[told].view(np.int64)),
                         "first": pa.array(first[told], pa.int64())})
    return answers


def kept_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
               min_chars: int = MIN_CHARS, payload: list[str] | None = None,
               index: LineIndex | None = None, min_holders: int = MIN_HOLDERS) -> DataFrame:
    """``(<doc_id>, kept, n_lines, n_dropped, kept_sha256)`` and the columns of ``payload``.

    ``kept`` is the text without its dropped lines. ``index`` (made with the same
    ``min_chars``) may come from other documents, as for new documents against an
    older corpus, which take ``min_holders=1``; without it, ``docs`` are indexed first.
    """
    index = index or build_index(docs, doc_id, text, min_chars)
    size = docs.agg(F.count(F.lit(1)).alias("n"),
                    F.coalesce(F.sum(F.octet_length(F.col(f"`{text}`"))), F.lit(0)).alias("b")).first()
    blocks = max(blocks_for(size["n"], DOCS_PER_BLOCK), blocks_for(size["b"], BLOCK_BYTES))
    parts = blocks_for(blocks, PART_BLOCKS)
    carried = payload or []
    rows = docs.select(block_of(F.struct(F.col(f"`{doc_id}`"), F.col(f"`{text}`")), blocks).alias("block"),
                       F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").alias("text"),
                       F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in carried]).alias("rest"))
    rows = rows.repartition("block")
    # all columns, so that the texts are dealt once for the questions and the answers
    asked = rows.mapInArrow(
        _questions(min_chars, index.shards), "shard int, part int, block int, a long, b long")
    handed = index.rows.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    answers = asked.groupBy("shard", "part").cogroup(handed.groupBy("shard", "part")).applyInArrow(
        _probe_shard(min_holders), "block int, a long, b long, first long")

    def finish(key: tuple, texts: pa.Table, said: pa.Table) -> pa.Table:
        pairs = np.stack([said.column("a").to_numpy(), said.column("b").to_numpy()], axis=1)
        known = {h.tobytes(): f for h, f in zip(np.ascontiguousarray(pairs), said.column("first").to_pylist())}
        kept, n_lines, n_dropped, sha = [], [], [], []
        for doc, value in zip(_ids(texts.column("id")).tolist(), texts.column("text").to_pylist()):
            lines, hashes = key_hashes(value, min_chars)
            left = [line for line, h in zip(lines, hashes) if known.get(h, doc) >= doc]
            data = b"\n".join(left)
            kept.append(data.decode("utf-8", "surrogatepass"))
            n_lines.append(len(lines))
            n_dropped.append(len(lines) - len(left))
            sha.append(hashlib.sha256(data).hexdigest())
        return pa.table({"id": texts.column("id"), "kept": pa.array(kept, pa.string()),
                         "n_lines": pa.array(n_lines, pa.int64()),
                         "n_dropped": pa.array(n_dropped, pa.int64()),
                         "kept_sha256": pa.array(sha, pa.string()), "rest": texts.column("rest")})

    result = T.StructType([
        T.StructField("id", rows.schema["id"].dataType), T.StructField("kept", T.StringType()),
        T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType()),
        T.StructField("kept_sha256", T.StringType()), T.StructField("rest", rows.schema["rest"].dataType)])
    done = rows.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(finish, result)
    return done.select(F.col("id").alias(doc_id), "kept", "n_lines", "n_dropped", "kept_sha256",
                       *[F.col("rest").getField(c).alias(c) for c in carried])


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                min_chars: int = MIN_CHARS, index: LineIndex | None = None,
                min_holders: int = MIN_HOLDERS) -> DataFrame:
    """``docs`` with the repeated lines of ``text`` dropped; all columns as before.

    ``index`` and ``min_holders`` are those of ``kept_lines``.
    """
    others = [c for c in docs.columns if c not in (doc_id, text)]
    names = {c: f"c{i}" for i, c in enumerate(others)}
    plain = docs.select(F.col(f"`{doc_id}`"), F.col(f"`{text}`"),
                        *[F.col(f"`{c}`").alias(n) for c, n in names.items()])
    done = kept_lines(plain, doc_id, text, min_chars, list(names.values()), index, min_holders)
    return done.select(*[F.col("kept").alias(c) if c == text else
                         F.col(names.get(c, c)).alias(c) for c in docs.columns])


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drop repeated lines of all documents; counts and digest of what is kept."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return kept_lines(docs).select("doc_id", "n_lines", "n_dropped", "kept_sha256")


OP4_SQL = r"""
WITH lines AS (
  SELECT doc_id, i, line, trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS stripped
  FROM (SELECT doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS i
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents))),
keyed AS (
  SELECT doc_id, i, line,
    translate(stripped, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
firsts AS (
  SELECT key, min(doc_id) AS first FROM keyed WHERE length(key) >= 10
  GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
marked AS (
  SELECT k.*, f.first IS NOT NULL AND f.first <> k.doc_id AS dropped
  FROM keyed k LEFT JOIN firsts f ON k.key = f.key AND length(k.key) >= 10)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id"""
