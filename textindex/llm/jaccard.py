"""Operator 7: n-gram Jaccard join with grouped prefixes.

A document's set is its distinct shingles. Two sets link when their Jaccard
similarity reaches the threshold t; sets are ordered by their shingles' document
frequency, rare ones first, and linked sets share a shingle among the first
``n - ceil(t n) + 1`` of both (their prefixes). The steps:

1. Documents are dealt into blocks. Each block sends its distinct shingles to the
   shards of a frequency table, as packed arrays, and gets frequencies back in the
   same order. Keys are shortened for this, so frequencies are upper bounds, the
   same for all documents: the order stays one order, and a shingle counted once
   occurs once. A set of which more than ``n - ceil(t n)`` shingles occur only in
   it links with nothing and is settled here, as most clean documents are.
2. Equal sets collapse into one, sets of equal prefix and size into one group.
3. Groups that share a prefix shingle are candidates. Their connected components
   (families) are cut into blocks of sets, by size; pairs of blocks whose sizes
   allow a link are the tasks. In a task, group pairs are filtered by a common
   prefix shingle and by size, then expanded, and members are verified by exact
   intersection. A task returns the links' spanning forest and each set's number
   of links, not its pairs, so thousands of near copies cost no pair rows.
4. Connected components of the links give each document the smallest id it reaches.

Sets of fewer than ``t / (1 - t)`` shingles link only with equal sets. Shingles are
compared by 64-bit hashes.

Edge cases: null or empty text, or text without words, is the empty set, linked
with nothing; fewer words than a shingle are one shingle; rows that repeat a
doc_id are documents of their own, and rows of a null doc_id reach null only if
nothing else is reached; an empty table gives no rows. Only id and text columns
are read; ``drop_near_copies`` keeps all other columns.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textindex.llm.common import block_of, blocks_for, materialize, number_within, read
from textindex.llm.graph import components
from textindex.llm.shingles import shingle_hashes, spaced_words

SHINGLE_WORDS = 4
THRESHOLD = 85                 # in hundredths
DOCS_PER_BLOCK = 128
SHARD_BYTES = 6 << 20          # text whose shingles a frequency shard is sized for
FAMILY_BLOCK = 64              # sets of a family that meet another such block in a task
_COLUMNS = 1 << 14             # shingles whose intersections are counted at once
_LAST = (1 << 63) - 1


def shingle_set(text: str | None, words: int = SHINGLE_WORDS) -> np.ndarray:
    """The sorted distinct shingles of a whole text."""
    return np.unique(shingle_hashes(spaced_words(text), words))


def needed(n: int, threshold: int) -> int:
    """The least intersection of a set of ``n`` with any set that it links with."""
    return -(-threshold * n // 100)


def _block_shingles(texts: pa.ChunkedArray, words: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """A block's sets, and its distinct shingles with the number of sets that hold each."""
    sets = [shingle_set(t, words) for t in texts.to_pylist()]
    both, counts = np.unique(np.concatenate(sets), return_counts=True)
    return sets, both, counts


def _shard_order(shingles: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """Each shingle's shard, and an order by shard that keeps the shingles sorted."""
    shard = ((shingles >> np.uint64(32)) % np.uint64(shards)).astype(np.int32)
    return shard, np.argsort(shard, kind="stable")


def _ask(words: int, shards: int):
    def ask(key: tuple, texts: pa.Table) -> pa.Table:
        _, both, counts = _block_shingles(texts.column("text"), words)
        shard, order = _shard_order(both, shards)
        found, starts = np.unique(shard[order], return_index=True)
        keys = both[order].astype(np.uint32)
        counts = np.minimum(counts[order], 255).astype(np.uint8)
        ends = [*starts[1:], len(order)]
        return pa.table({
            "shard": pa.array(found.astype(np.int32)),
            "block": pa.array([key[0].as_py()] * len(found), pa.int32()),
            "keys": pa.array([keys[a:b].tobytes() for a, b in zip(starts, ends)], pa.binary()),
            "counts": pa.array([counts[a:b].tobytes() for a, b in zip(starts, ends)], pa.binary())})
    return ask


def _answer(key: tuple, asked: pa.Table) -> pa.Table:
    """Frequencies (255 stands for more) of all keys of a shard, for each block that asked."""
    keys = [np.frombuffer(k, np.uint32) for k in asked.column("keys").to_pylist()]
    counts = np.concatenate([np.frombuffer(c, np.uint8) for c in asked.column("counts").to_pylist()])
    _, where = np.unique(np.concatenate(keys), return_inverse=True)
    totals = np.minimum(np.bincount(where, counts)[where], 255).astype(np.uint8)
    parts = np.split(totals, np.cumsum([len(k) for k in keys])[:-1])
    return pa.table({"block": asked.column("block"), "shard": asked.column("shard"),
                     "counts": pa.array([p.tobytes() for p in parts], pa.binary())})


def _settle(words: int, threshold: int, shards: int):
    smallest = -(-threshold // (100 - threshold))     # n shingles in n + 1 reach n / (n + 1)

    def settle(key: tuple, texts: pa.Table, said: pa.Table) -> pa.Table:
        """Each document's set size and digest, and the ordered set if it may link."""
        sets, both, _ = _block_shingles(texts.column("text"), words)
        _, order = _shard_order(both, shards)
        frequency = np.zeros(len(both), dtype=np.uint8)
        if len(both):
            replies = sorted(zip(said.column("shard").to_pylist(), said.column("counts").to_pylist()))
            frequency[order] = np.frombuffer(b"".join(c for _, c in replies), np.uint8)
        digests, blobs, alone = [], [], []
        for found in sets:
            digests.append(xxhash.xxh3_128_digest(found.tobytes()))
            times = frequency[np.searchsorted(both, found)]
            lone = int((times == 1).sum())
            alone.append(lone)
            may_link = len(found) >= smallest and lone <= len(found) - needed(len(found), threshold)
            blobs.append(found[np.lexsort((found, times))].tobytes() if may_link else None)
        return pa.table({
            "id": texts.column("id"), "n": pa.array([len(s) for s in sets], pa.int64()),
            "a": pa.array(digests, pa.binary()), "lone": pa.array(alone, pa.int32()),
            "shingles": pa.array(blobs, pa.binary())})
    return settle


def shingle_sets(docs: DataFrame, words: int, threshold: int) -> DataFrame:
    """``(id, n, a, lone, shingles)`` from ``(id, text)``: ``a`` is the set's 128-bit digest,
    ``shingles`` are ordered by frequency, and null where no other set can link."""
    size = docs.agg(F.count(F.lit(1)).alias("n"),
                    F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first()
    blocks, shards = blocks_for(size["n"], DOCS_PER_BLOCK), blocks_for(size["b"], SHARD_BYTES)
    rows = docs.select(block_of(F.col("id"), blocks).alias("block"), "id", "text").repartition("block")
    asked = rows.groupBy("block").applyInArrow(
        _ask(words, shards), "shard int, block int, keys binary, counts binary")
    said = asked.groupBy("shard").applyInArrow(_answer, "block int, shard int, counts binary")
    kind = rows.schema["id"].dataType.simpleString()
    return materialize(rows.groupBy("block").cogroup(said.groupBy("block")).applyInArrow(
        _settle(words, threshold, shards),
        f"id {kind}, n long, a binary, lone int, shingles binary"), "shingle-sets")


def _prefix(n: int, lone: int, blob: bytes, threshold: int) -> np.ndarray:
    """The shared shingles of a set's prefix."""
    return np.frombuffer(blob, "<u8")[lone:n - needed(n, threshold) + 1]


def _group_rows(threshold: int):
    """Rows (group, set, n): the group of equal prefix and size, for each set."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            groups = []
            for n, blob in zip(batch.column("n").to_pylist(), batch.column("shingles").to_pylist()):
                held = blob[:8 * (n - needed(n, threshold) + 1)]
                groups.append(xxhash.xxh3_64_intdigest(held, seed=n) - (1 << 63))
            yield pa.RecordBatch.from_pydict({"g": pa.array(groups, pa.int64()),
                                              "a": batch.column("a"), "n": batch.column("n")})
    return rows


def _token_rows(threshold: int):
    """Rows (token, group): the shared prefix shingles of each set's group."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens, groups = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for n, lone, blob in zip(*(batch.column(c).to_pylist() for c in ("n", "lone", "shingles"))):
                held = blob[:8 * (n - needed(n, threshold) + 1)]
                found = _prefix(n, lone, blob, threshold)
                tokens.append(found.view(np.int64))
                groups.append(np.full(len(found), xxhash.xxh3_64_intdigest(held, seed=n) - (1 << 63)))
            yield pa.RecordBatch.from_pydict({"token": pa.array(np.concatenate(tokens)),
                                              "g": pa.array(np.concatenate(groups))})
    return rows


def _families(sets: DataFrame, threshold: int) -> DataFrame:
    """``(a, n, family)``: sets whose groups hang together by shared prefix shingles."""
    light = sets.select("a", "n", "lone", "shingles")
    groups = materialize(light.mapInArrow(_group_rows(threshold), "g long, a binary, n long"), "groups")
    tokens = materialize(light.mapInArrow(_token_rows(threshold), "token long, g long").distinct(), "tokens")
    hubs = materialize(tokens.groupBy("token").agg(
        F.min("g").alias("hub"), F.count(F.lit(1)).alias("times")).filter("times > 1")
        .select("token", "hub"), "hubs")
    edges = tokens.join(hubs, "token").select(F.col("g").alias("src"), F.col("hub").alias("dst"))
    labels = materialize(components(edges), "family-labels")
    return groups.join(labels, groups["g"] == labels["node"], "left").select(
        "a", "n", F.coalesce("label", "g").alias("family"))


def _verify(threshold: int):
    def verify(key: tuple, rows: pa.Table) -> pa.Table:
        """Spanning links (src, dst) of a pair of blocks, and (src, links) of each set."""
        sizes, copies, side = (rows.column(c).to_numpy() for c in ("n", "copies", "block"))
        names, lone, blobs = (rows.column(c).to_pylist() for c in ("a", "lone", "shingles"))
        sets = [np.frombuffer(b, "<u8") for b in blobs]
        held = [b[:8 * (n - needed(int(n), threshold) + 1)] for b, n in zip(blobs, sizes.tolist())]
        _, group = np.unique([xxhash.xxh3_64_intdigest(h, seed=n) for h, n in zip(held, sizes.tolist())],
                             return_inverse=True)
        heads = np.array([np.flatnonzero(group == g)[0] for g in range(group.max() + 1)])
        # groups that share a prefix shingle, of sizes that can link
        prefixes = [_prefix(int(sizes[h]), lone[h], blobs[h], threshold) for h in heads]
        near = _common(prefixes) > 0
        size = sizes[heads]
        near &= 100 * np.minimum.outer(size, size) >= threshold * np.maximum.outer(size, size)
        np.fill_diagonal(near, True)
        pairs = np.triu(near[np.ix_(group, group)], 1)
        i, j = key[1].as_py(), key[2].as_py()
        if i != j:                       # pairs within a block belong to its own task
            pairs &= side[:, None] != side[None, :]
        out_src, out_dst, out_links = [], [], []
        if pairs.any():
            some = np.flatnonzero(pairs.any(axis=0) | pairs.any(axis=1))
            inter = _common([sets[x] for x in some])
            union = sizes[some][:, None] + sizes[some][None, :] - inter
            linked = pairs[np.ix_(some, some)] & (100 * inter >= threshold * union)
            links = linked @ copies[some] + linked.T @ copies[some]
            for x, n in zip(some, links):
                if n:
                    out_src.append(names[x])
                    out_dst.append(None)
                    out_links.append(int(n))
            root = list(range(len(some)))

            def find(x: int) -> int:
                while root[x] != x:
                    root[x] = root[root[x]]
                    x = root[x]
                return x

            for x, y in zip(*(p.tolist() for p in np.nonzero(linked))):
                rx, ry = find(x), find(y)
                if rx != ry:
                    root[ry] = rx
                    out_src.append(names[some[x]])
                    out_dst.append(names[some[y]])
                    out_links.append(0)
        return pa.table({"src": pa.array(out_src, pa.binary()), "dst": pa.array(out_dst, pa.binary()),
                         "links": pa.array(out_links, pa.int64())})
    return verify


def _common(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of a task's sets."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, where, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times[where] > 1
    owner, where = owner[shared], where[shared]
    _, where = np.unique(where, return_inverse=True)
    out = np.zeros((len(sets), len(sets)), dtype=np.int64)
    order = np.argsort(where, kind="stable")
    owner, where = owner[order], where[order]
    last = int(where[-1]) + 1 if len(where) else 0
    for at in range(0, last, _COLUMNS):
        low, high = np.searchsorted(where, [at, at + _COLUMNS])
        table = np.zeros((len(sets), min(_COLUMNS, last - at)), dtype=np.float32)
        table[owner[low:high], where[low:high] - at] = 1
        out += (table @ table.T).astype(np.int64)
    # the diagonal lacks shingles that only one set has; nothing reads it
    return out


def _links(sets: DataFrame, threshold: int) -> DataFrame:
    """Spanning links and link counts of ``(a, n, lone, shingles, copies)``."""
    family = _families(sets, threshold)
    ranked = number_within(family, "family", ["n", "a"], "rank")
    members = materialize(ranked.select(
        "family", "a", "n", F.floor(F.col("rank") / FAMILY_BLOCK).cast("int").alias("block")), "members")
    cells = materialize(members.groupBy("family", "block").agg(
        F.count(F.lit(1)).alias("held"), F.min("n").alias("least"), F.max("n").alias("most")), "cells")
    x, y = cells.alias("x"), cells.alias("y")
    pairs = (x.join(y, (F.col("x.family") == F.col("y.family")) & (F.col("x.block") <= F.col("y.block"))
                    & (100 * F.col("x.most") >= threshold * F.col("y.least")))
             .filter((F.col("x.block") < F.col("y.block")) | (F.col("x.held") > 1))
             .select("x.family", F.col("x.block").alias("i"), F.col("y.block").alias("j")))
    sides = pairs.select("family", "i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("block"))
    work = members.select("family", "block", "a").join(materialize(sides, "block-pairs"), ["family", "block"])
    full = materialize(work, "work").join(sets, "a")
    return materialize(full.groupBy("family", "i", "j").applyInArrow(
        _verify(threshold), "src binary, dst binary, links long"), "links")


def jaccard_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                       words: int = SHINGLE_WORDS, threshold: int = THRESHOLD) -> DataFrame:
    """``(<doc_id>, n_shingles, component_id, n_links)``, one row a document.

    ``n_links`` counts the documents that it links with, equal sets included.
    """
    found = shingle_sets(docs.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").alias("text")),
                         words, threshold)
    k = F.coalesce("id", F.lit(_LAST))
    whole = found.filter("n > 0")
    sets = materialize(
        whole.filter("shingles IS NOT NULL").groupBy("a").agg(
            F.first("n").alias("n"), F.first("lone").alias("lone"), F.first("shingles").alias("shingles"),
            F.count(F.lit(1)).alias("copies")), "sets")
    links = _links(sets, threshold)
    labels = components(links.filter("dst IS NOT NULL"))
    degrees = links.filter("dst IS NULL").groupBy(F.col("src").alias("a")).agg(F.sum("links").alias("links"))
    own = whole.groupBy("a").agg(F.min(k).alias("least"), F.count(F.lit(1)).alias("copies"))
    labelled = (own.join(labels.withColumnRenamed("node", "a"), "a", "left")
                .join(degrees, "a", "left")
                .select("a", "least", F.coalesce("label", "a").alias("label"),
                        (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")))
    labelled = materialize(labelled, "labelled")
    least = materialize(labelled.groupBy("label").agg(F.min("least").alias("component_id")), "least")
    named = materialize(labelled.join(least, "label").select("a", "component_id", "n_links"), "named")
    joined = found.select("id", "n", F.when(F.col("n") > 0, F.col("a")).alias("a")).join(named, "a", "left")
    return joined.select(
        F.col("id").alias(doc_id), F.col("n").alias("n_shingles"),
        F.when(F.col("n") == 0, F.col("id")).otherwise(
            F.nullif("component_id", F.lit(_LAST))).alias("component_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def drop_near_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                     words: int = SHINGLE_WORDS, threshold: int = THRESHOLD) -> DataFrame:
    """``docs`` with one document of each component: the one of the smallest id.

    Rows that share the smallest id of a component all stay.
    """
    gone = (jaccard_components(docs, doc_id, text, words, threshold)
            .filter(~F.col("component_id").eqNullSafe(F.col(doc_id)))
            .select(F.col(doc_id).alias("_gone")).distinct())
    return docs.join(gone, docs[doc_id].eqNullSafe(gone["_gone"]), "left_anti")


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Link near copies among all documents; one row a document with its component."""
    return jaccard_components(read(spark, sf_dir, "documents"))


OP7_SQL = r"""
WITH RECURSIVE texts AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS s
  FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 3, 1))) AS i FROM texts WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c
  FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM common JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b
  WHERE 100 * c >= 85 * (p.n + q.n - c)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (
  SELECT doc_id AS node, doc_id AS seen FROM documents
  UNION SELECT r.node, e.b FROM reach r JOIN edges e ON e.a = r.seen)
SELECT d.doc_id, coalesce(any_value(s.n), 0) AS n_shingles, min(r.seen) AS component_id,
  (SELECT count(*) FROM edges e WHERE e.a = d.doc_id) AS n_links
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id JOIN reach r ON r.node = d.doc_id
GROUP BY d.doc_id"""
