"""Operator 10: benchmark decontamination by size-partitioned MinHash containment.

Test items are partitioned by their number of shingles; a class of items of at
most ``q`` shingles is sought in windows of about ``2 q`` shingles, one starting
every ``q``, so a short item is not lost in a long document: an item that is
contained lies in some window, with a Jaccard similarity that the class bounds
from below. Windows' MinHash signatures are built bottom-up, as the minimum of
their halves' signatures. An item and a document are candidates if any signature
value of a window equals the item's (bands of one row, the setting that containment
in larger sets asks for). Candidates are verified exactly: an item is contained
when at least ``threshold`` of its distinct shingles are in the whole document.

Items of up to ``EXACT_SHINGLES`` shingles have no signature: every shingle of a
document is looked up among so many of theirs that a contained item must show one,
so none is missed. With 64 values, an item of four shingles or more in one place is
missed with a probability below 1e-5; an item whose parts are scattered is found by
any of its parts.

Items are collected in blocks of bounded count and size. Every block is sought in
all documents, and its index released once what it found is written, so any number
of items is handled and one block's index is held at a time.

Edge cases: texts of fewer words than a shingle are one shingle; null or empty
documents and items match nothing; rows that repeat a document or an item each
give a result row; null ids are kept as null; empty tables give no rows. Only the
id and text columns are read; ``remove_contaminated`` keeps all other columns.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textindex.llm.common import block_of, blocks_for, materialize, read
from textindex.llm.shingles import mix, plain_words, shingle_hashes

SHINGLE_WORDS = 5
THRESHOLD = (4, 5)                # contained: at least 4 of 5 shingles
VALUES = 64                       # MinHash values of a signature
BASE = 8                          # shingles of the smallest windows
EXACT_SHINGLES = 3                # items of up to so many are looked up by their shingles
BLOCK_ITEMS, BLOCK_BYTES = 20_000, 32 << 20
_TOGETHER = 1 << 16               # shingles whose signatures are made at once
_FILTER_BITS = 20

_DRAWN = np.random.default_rng(99).integers(1, 1 << 32, (2, VALUES), dtype=np.uint64)
_FACTORS = (_DRAWN[0] | np.uint64(1)).astype(np.uint32)
_SHIFTS = _DRAWN[1].astype(np.uint32)
_NONE = np.uint32(0xFFFFFFFF)


def base_signatures(shingles: np.ndarray) -> np.ndarray:
    """MinHash values (one row each) of every run of ``BASE`` shingles."""
    short = mix(shingles).astype(np.uint32)
    short = np.concatenate([short, np.repeat(short[-1:], -len(short) % BASE)])
    columns = np.ascontiguousarray(short.reshape(-1, BASE).T)
    out = np.empty((VALUES, columns.shape[1]), dtype=np.uint32)
    for j in range(VALUES):
        x = columns * _FACTORS[j]
        x ^= x >> np.uint32(15)
        x *= np.uint32(0x85EBCA6B)
        x ^= _SHIFTS[j]
        x.min(axis=0, out=out[j])
    return out


def signature(shingles: np.ndarray) -> np.ndarray:
    return base_signatures(shingles).min(axis=1)


def size_class(shingles: int) -> int:
    """Class c holds items of up to ``BASE * 2**c`` shingles."""
    c = 0
    while BASE << c < shingles:
        c += 1
    return c


@dataclass
class ItemClass:
    """Items of one size class: their keys (signature values or shingles), sorted, each with its item."""

    keys: np.ndarray
    items: np.ndarray
    seen: np.ndarray

    @classmethod
    def build(cls, keys: list[np.ndarray], members: list[int]) -> ItemClass:
        items = np.repeat(np.array(members, dtype=np.int64), [len(k) for k in keys])
        flat = np.concatenate(keys)
        order = np.argsort(flat, kind="stable")
        seen = np.zeros(1 << _FILTER_BITS, dtype=bool)
        seen[flat & np.uint64((1 << _FILTER_BITS) - 1)] = True
        return cls(flat[order], items[order], seen)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(place, item)`` of each key that an item has; a place is that of the last axis."""
        hit = np.nonzero(self.seen[keys & np.uint64((1 << _FILTER_BITS) - 1)])
        found = keys[hit]
        low, high = np.searchsorted(self.keys, found, "left"), np.searchsorted(self.keys, found, "right")
        times = high - low
        first = np.repeat(low - (np.cumsum(times) - times), times)
        return np.repeat(hit[-1], times), self.items[first + np.arange(len(first))]


@dataclass
class ItemIndex:
    """A block of test items."""

    ids: list
    shingles: list[np.ndarray]
    classes: dict[int, ItemClass] = field(default_factory=dict)
    short: ItemClass | None = None

    @classmethod
    def build(cls, rows: list[tuple], threshold: tuple[int, int] = THRESHOLD) -> ItemIndex:
        ids, sets = [], []
        for item, text in rows:
            found = np.unique(shingle_hashes(plain_words(text), SHINGLE_WORDS))
            if len(found):
                ids.append(item)
                sets.append(found)
        index, by_class, short = cls(ids, sets), {}, []
        for i, found in enumerate(sets):
            if len(found) <= EXACT_SHINGLES:
                short.append(i)
            else:
                by_class.setdefault(size_class(len(found)), []).append(i)
        for c, members in by_class.items():
            index.classes[c] = ItemClass.build([_keys(signature(sets[i])[:, None])[:, 0] for i in members], members)
        if short:
            over, under = threshold
            # a document that lacks all of these has too few of the others
            keys = [sets[i][:len(sets[i]) - max(1, -(-over * len(sets[i]) // under)) + 1] for i in short]
            index.short = ItemClass.build(keys, short)
        return index

    def candidates(self, shingles: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """``(from, to, item)``: runs of base windows of ``shingles`` that may hold an item."""
        if self.short:
            at, items = self.short.find(shingles)
            yield at // BASE, at // BASE + 1, items
        if not self.classes:
            return
        runs = base_signatures(shingles)
        count = runs.shape[1]
        for c in range(max(self.classes) + 1):
            ahead = 1 << c
            later = np.full_like(runs, _NONE)
            if ahead < count:
                later[:, :count - ahead] = runs[:, ahead:]
            runs = np.minimum(runs, later)      # now of 2 * ahead base windows each
            if c not in self.classes:
                continue
            at, items = self.classes[c].find(_keys(runs[:, ::ahead]))
            yield at * ahead, np.minimum(at * ahead + 2 * ahead, count), items

    def contained(self, item: int, document: np.ndarray) -> int:
        """How many of an item's shingles are in a document's sorted distinct ones."""
        wanted = self.shingles[item]
        at = np.searchsorted(document, wanted)
        return int((document[np.minimum(at, len(document) - 1)] == wanted).sum())


def _keys(signatures: np.ndarray) -> np.ndarray:
    """Signature values made distinct by their row."""
    rows = np.arange(VALUES, dtype=np.uint64)[:, None] << np.uint64(32)
    return mix(signatures.astype(np.uint64) | rows)


def _search(held, threshold: tuple[int, int]):
    over, under = threshold

    def verify(index: ItemIndex, docs: list, sets: list[np.ndarray]) -> Iterator[tuple]:
        padded = [np.concatenate([s, np.repeat(s[-1:], -len(s) % BASE)]) for s in sets]
        ends = np.cumsum([len(p) // BASE for p in padded])
        pairs = set()
        for start, stop, items in index.candidates(np.concatenate(padded)):
            first = np.searchsorted(ends, start, "right")
            last = np.searchsorted(ends, stop - 1, "right")
            for d in range(int((last - first).max()) + 1 if len(first) else 0):
                inside = first + d <= last
                pairs.update(zip((first[inside] + d).tolist(), items[inside].tolist()))
        distinct: dict[int, np.ndarray] = {}
        for d, item in sorted(pairs):
            if d not in distinct:
                distinct[d] = np.unique(sets[d])
            n, size = index.contained(item, distinct[d]), len(index.shingles[item])
            if n * under >= over * size:
                yield docs[d], index.ids[item], n, size

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = held.value
        for batch in batches:
            out: list[tuple] = []
            docs, sets, size = [], [], 0
            for doc, text in zip(batch.column(0), batch.column(1)):
                found = shingle_hashes(plain_words(text.as_py()), SHINGLE_WORDS)
                if len(found):
                    docs.append(doc.as_py())
                    sets.append(found)
                    size += len(found)
                if size >= _TOGETHER:
                    out += verify(index, docs, sets)
                    docs, sets, size = [], [], 0
            if docs:
                out += verify(index, docs, sets)
            if out:
                d, i, n, s = zip(*out)
                yield pa.RecordBatch.from_pydict({
                    "doc": pa.array(d, batch.schema.field(0).type), "item": pa.array(i),
                    "matched": pa.array(n, pa.int64()), "item_shingles": pa.array(s, pa.int64())})

    return rows


def contaminated(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id",
                 text: str = "text", threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """``(<doc_id>, <item_id>, matched, item_shingles, containment)``, a row for each
    document that contains an item."""
    spark = docs.sparkSession
    wanted = items.select(F.col(f"`{item_id}`").alias("item"), F.col(f"`{text}`").alias("text"))
    size = wanted.agg(F.count(F.lit(1)).alias("n"),
                      F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first()
    blocks = max(blocks_for(size["n"], BLOCK_ITEMS), blocks_for(size["b"], BLOCK_BYTES))
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc"), F.col(f"`{text}`").alias("text"))
    schema = (f"doc {rows.schema['doc'].dataType.simpleString()}, "
              f"item {wanted.schema['item'].dataType.simpleString()}, matched long, item_shingles long")
    parts = []
    for b in range(blocks):
        block = wanted.filter(block_of(F.struct("item", "text"), blocks) == b).collect()
        held = spark.sparkContext.broadcast(ItemIndex.build([(r["item"], r["text"]) for r in block], threshold))
        parts.append(materialize(rows.mapInArrow(_search(held, threshold), schema), "contaminated"))
        held.unpersist(blocking=True)
    return reduce(DataFrame.unionByName, parts).select(
        F.col("doc").alias(doc_id), F.col("item").alias(item_id), "matched", "item_shingles",
        (F.col("matched") / F.col("item_shingles")).alias("containment"))


def remove_contaminated(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """``docs`` without the documents that contain an item; rows with a null id stay
    unless another row of null id contains one."""
    bad = contaminated(docs, items, doc_id).select(F.col(doc_id).alias("_bad")).distinct()
    return docs.join(bad, docs[doc_id].eqNullSafe(bad["_bad"]), "left_anti")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents that contain an item of the benchmark, with the items."""
    return contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


OP10_SQL = r"""
WITH texts AS (
  SELECT 'd' AS kind, doc_id AS id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS w FROM documents
  UNION ALL
  SELECT 'i', item_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') FROM benchmark),
shingles AS (
  SELECT DISTINCT kind, id, array_to_string(w[i:i + 4], ' ') AS s
  FROM (SELECT kind, id, w, unnest(generate_series(1, greatest(len(w) - 4, 1))) AS i FROM texts WHERE len(w) > 0)),
sizes AS (SELECT id, count(*) AS n FROM shingles WHERE kind = 'i' GROUP BY id)
SELECT d.id AS doc_id, i.id AS item_id, count(*) AS matched, any_value(n) AS item_shingles,
  count(*) / any_value(n) AS containment
FROM shingles d JOIN shingles i ON d.kind = 'd' AND i.kind = 'i' AND d.s = i.s JOIN sizes ON sizes.id = i.id
GROUP BY d.id, i.id HAVING 5 * count(*) >= 4 * any_value(n)"""
