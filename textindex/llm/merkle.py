"""Operator 13: a Merkle manifest of a dataset, by cogrouped subtree exchange.

A row's leaf is the hash of its length-prefixed fields, taken where the row lies, so
that no text is shuffled. Leaves of one language ascend by id. ``2 ** HEIGHT``
consecutive leaves make a superblock, an aligned subtree, and its top is a leaf of the
tier above, where superblocks are cut again until a language has one node, its
subroot; the subroots, ordered by language, are the leaves of one more such tree.

Down again, each superblock needs only the siblings on the way from its own top to the
root. A tier's nodes are cogrouped by superblock with these outer nodes, one row each,
in ``applyInPandas``: the call finishes the local reduction, joins every leaf's own
siblings to the outer ones, and folds the leaf, tampered or not, up to the root. So a
group holds ``2 ** HEIGHT`` nodes whatever a language's size, and what is exchanged
besides the leaves is one row for each superblock.

A run of two nodes becomes the hash of both, the last node of an odd level the hash of
itself; only a node alone on its level stays as it is.

Edge cases: a null field is hashed as ``-``; null languages form the first group; null
ids come first in theirs, and rows of one id ascend by leaf, so equal rows are leaves
side by side. A null id is not tampered with, nor is a null ``n_chars``, whose leaf
stays and verifies. An empty table gives no rows. Columns that are not fields are
neither read nor hashed, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textindex.llm.common import materialize, number_within, read

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
HEIGHT = 10             # superblocks of 2 ** HEIGHT nodes
TAMPERED = 7            # divides the crc32 of the ids of tampered rows


def digest(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(fields: list[Column]) -> Column:
    """Hash of the fields, each prefixed by its length in bytes."""
    def field(c: Column) -> Column:
        value = c.cast("string")
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))

    return F.sha2(F.concat(*[field(c) for c in fields]), 256)


def leaves(docs: DataFrame) -> DataFrame:
    """``(k, idx, node, tampered, doc_id)``: a row's group key, place in it and hashes."""
    plain = [F.col(c) for c in FIELDS]
    changed = [F.try_add(F.col(c), F.lit(1)) if c == "n_chars" else F.col(c) for c in FIELDS]
    hit = F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % TAMPERED == 0
    hashed = docs.select(
        "doc_id", F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit("")).alias("k"),
        leaf_of(plain).alias("node"),
        F.when(hit & F.col("n_chars").isNotNull(), leaf_of(changed)).alias("changed"))
    return (number_within(hashed, "k", ["doc_id", "node"], "idx")
            .select("k", F.col("idx").cast("long").alias("idx"), "node",
                    F.coalesce("changed", "node").alias("tampered"),
                    F.col("doc_id").cast("string").alias("doc_id")))


def raised(node: str, levels: int) -> str:
    """A node alone on ``levels`` levels of a larger tree."""
    for _ in range(levels):
        node = digest(node)
    return node


def level_above(nodes: list[str]) -> list[str]:
    return [digest(*nodes[i:i + 2]) for i in range(0, len(nodes), 2)]


def _lift(nodes: list[str], heights: list[int], several: bool, below: int) -> list[str]:
    """A superblock's nodes, those of unfinished height raised to the tier's."""
    return [raised(x, below - h) for x, h in zip(nodes, heights)] if several else nodes


def tops(tier: DataFrame, level: int, height: int) -> DataFrame:
    """The tier above: ``(k, idx, node, h)``, the top of each superblock.

    ``h`` counts the levels that are done. A group of several superblocks brings all
    its tops to one height; only its last can be lower, and is raised when it is met.
    """
    below = level * height

    def reduce(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("idx")
        nodes, h = block["node"].tolist(), int(block["h"].iloc[0])
        if len(nodes) > 1 or block["idx"].iloc[0] > 0:
            nodes, h = _lift(nodes, block["h"].tolist(), True, below), below
            while len(nodes) > 1:
                nodes, h = level_above(nodes), h + 1
        return pd.DataFrame({"k": block["k"].iloc[:1], "idx": block["idx"].iloc[:1] // 2 ** height,
                             "node": nodes, "h": h})

    return (tier.select("k", "idx", "node", "h", F.shiftright("idx", height).alias("block"))
            .groupBy("k", "block").applyInPandas(reduce, "k string, idx long, node string, h int"))


def tiers(base: DataFrame, height: int) -> list[DataFrame]:
    """``base`` and all tiers above it, up to one node for each ``k``."""
    out = [base.withColumn("h", F.lit(0))]
    while out[-1].filter("idx > 0").limit(1).count():
        out.append(materialize(tops(out[-1], len(out) - 1, height), "merkle-tier"))
    return out


def ways(nodes: list[str]) -> list[list[str]]:
    """Each node's siblings up to the top: L or R and the hash, or - for none."""
    where, out = list(range(len(nodes))), [[] for _ in nodes]
    while len(nodes) > 1:
        for i, at in enumerate(where):
            other = at ^ 1
            out[i].append("-" if other >= len(nodes) else ("R" if other > at else "L") + nodes[other])
        nodes, where = level_above(nodes), [at >> 1 for at in where]
    return out


def fold(node: str, way: list[str]) -> str:
    for step in way:
        node = digest(node) if step == "-" else (
            digest(node, step[1:]) if step[0] == "R" else digest(step[1:], node))
    return node


def _paths(nodes: pd.DataFrame, outer: pd.DataFrame, below: int) -> Iterator[list[str]]:
    """The whole way up of each row of a superblock, in order."""
    several = len(nodes) > 1 or nodes["idx"].iloc[0] > 0
    heights = nodes["h"].tolist()
    lifted = _lift(nodes["node"].tolist(), heights, several, below)
    beyond = list(outer["way"].iloc[0])
    for i, own in enumerate(ways(lifted)):
        lone = ["-"] * (below - heights[i]) if several else []
        yield lone + own + beyond


def down(base: DataFrame, upper: list[DataFrame], outer: DataFrame, height: int) -> DataFrame:
    """Outer nodes of the superblocks of ``base``: ``(k, idx, way, subroot)``.

    ``outer`` has them for the one node of each ``k``; each tier's nodes meet those of
    the tier above by superblock.
    """
    def exchange(below: int):
        def ways_down(nodes: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
            nodes = nodes.sort_values("idx")
            return pd.DataFrame({"k": nodes["k"], "idx": nodes["idx"], "subroot": above["subroot"].iloc[0],
                                 "way": list(_paths(nodes, above, below))})
        return ways_down

    # the last tier has the groups' single nodes, as ``outer`` has
    for level in range(len(upper) - 1, 0, -1):
        tier = upper[level - 1].withColumn("block", F.shiftright("idx", height))
        outer = materialize(
            tier.groupBy("k", "block").cogroup(outer.withColumn("block", F.col("idx")).groupBy("k", "block"))
            .applyInPandas(exchange(level * height), "k string, idx long, subroot string, way array<string>"),
            "merkle-outer")
    return outer


def manifest(docs: DataFrame, height: int = HEIGHT) -> DataFrame:
    """``(doc_id, leaf, subroot, root, proof, folded_root, verified)`` for every row.

    ``proof`` lists the siblings from leaf to root, each marked L or R by its side, or
    ``-`` where a level has none.
    """
    spark = docs.sparkSession
    base = materialize(leaves(docs), "merkle-leaves")
    own = tiers(base, height)
    subroots = own[-1].select("k", "node", "h")
    # the groups' subroots are the leaves of one more tree, whose only group is ""
    ranked = materialize(number_within(subroots.withColumn("all", F.lit("")), "all", ["k"], "idx")
                         .select(F.lit("").alias("k"), F.col("idx").cast("long").alias("idx"), "node",
                                 F.col("k").alias("group")), "merkle-subroots")
    top = tiers(ranked, height)
    root = top[-1].first()
    if root is None:
        return spark.createDataFrame([], f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, leaf string, "
                                         "subroot string, root string, proof array<string>, folded_root string, "
                                         "verified boolean")
    root = root["node"]
    start = top[-1].select("k", "idx", F.lit(None).cast("string").alias("subroot"),
                           F.array().cast("array<string>").alias("way"))
    blocks = down(ranked, top[1:], start, height)

    def subroot_ways(nodes: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        nodes = nodes.sort_values("idx").assign(h=0)
        return pd.DataFrame({"k": nodes["group"], "idx": 0, "subroot": nodes["node"],
                             "way": list(_paths(nodes, above, 0))})

    outer = materialize(
        ranked.withColumn("block", F.shiftright("idx", height)).groupBy("k", "block")
        .cogroup(blocks.withColumn("block", F.col("idx")).groupBy("k", "block"))
        .applyInPandas(subroot_ways, "k string, idx long, subroot string, way array<string>"), "merkle-outer")
    outer = down(base, own[1:], outer, height)

    def finish(nodes: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        nodes = nodes.sort_values("idx").assign(h=0)
        found = list(_paths(nodes, above, 0))
        folded = [fold(x, way) for x, way in zip(nodes["tampered"], found)]
        return pd.DataFrame({"doc_id": nodes["doc_id"], "leaf": nodes["node"],
                             "subroot": above["subroot"].iloc[0], "root": root, "proof": found,
                             "folded_root": folded, "verified": [f == root for f in folded]})

    return (base.withColumn("block", F.shiftright("idx", height)).groupBy("k", "block")
            .cogroup(outer.withColumn("block", F.col("idx")).groupBy("k", "block"))
            .applyInPandas(finish, "doc_id string, leaf string, subroot string, root string, "
                                   "proof array<string>, folded_root string, verified boolean")
            .withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType)))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, roots, proof digest and folded root of every document."""
    siblings = F.transform(F.filter("proof", lambda s: s != "-"), lambda s: F.substring(s, 2, 64))
    return manifest(read(spark, sf_dir, "documents")).select(
        "doc_id", "leaf", "subroot", "root",
        F.sha2(F.array_join(siblings, ""), 256).alias("proof_sha256"), "folded_root", "verified")


_FIELD = "coalesce(strlen({0}::VARCHAR) || ':' || {0}::VARCHAR, '-')"


def _leaf_sql(n_chars: str) -> str:
    return "sha256(" + " || ".join(_FIELD.format(n_chars if c == "n_chars" else c) for c in FIELDS) + ")"


def _tree_sql(name: str, start: str) -> str:
    """A recursive table of all levels of the trees over ``start``'s ``(k, idx, node)``."""
    return f"""{name}(k, level, idx, node) AS (
  SELECT k, 0, idx, node FROM {start}
  UNION ALL
  SELECT k, max(level) + 1, idx // 2, sha256(string_agg(node, '' ORDER BY idx))
  FROM (SELECT *, count(*) OVER (PARTITION BY k) AS nodes FROM {name})
  WHERE nodes > 1 GROUP BY k, idx // 2)"""


def _steps_sql(start: str, tree: str, first: int) -> str:
    return f"""SELECT d.rid, {first} + u.level AS step, s.node AS sibling,
    CASE WHEN s.node IS NULL THEN '-' WHEN s.idx % 2 = 1 THEN 'R' || s.node ELSE 'L' || s.node END AS way
  FROM {start} d JOIN (SELECT k, max(level) AS height FROM {tree} GROUP BY k) h USING (k)
  JOIN (SELECT unnest(range(64)) AS level) u ON u.level < h.height
  LEFT JOIN {tree} s ON s.k = d.k AND s.level = u.level AND s.idx = xor(d.idx >> u.level, 1)"""


OP13_SQL = f"""
WITH RECURSIVE polynomial AS (
  SELECT list_transform(range(256), lambda v: list_reduce(list_prepend(v, range(8)), lambda c, i:
    CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS steps),
hashed AS (
  SELECT doc_id, coalesce('=' || lang, '') AS k, {_leaf_sql("n_chars")} AS node,
    CASE WHEN n_chars IS NOT NULL AND xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT,
        list_transform(regexp_extract_all(doc_id::VARCHAR, '.'), lambda ch: ascii(ch)::BIGINT)),
        lambda c, b: xor(c >> 8, steps[1 + (xor(c, b) & 255)]))) % {TAMPERED} = 0
      THEN {_leaf_sql("(n_chars + 1)")} END AS changed
  FROM documents, polynomial),
base AS (
  SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id NULLS FIRST, node) - 1 AS idx,
    row_number() OVER () AS rid FROM hashed),
{_tree_sql("own", "base")},
subroots AS (SELECT k, arg_max(node, level) AS subroot FROM own GROUP BY k),
ordered AS (SELECT '' AS k, k AS lang, row_number() OVER (ORDER BY k) - 1 AS idx, subroot AS node FROM subroots),
{_tree_sql("top", "ordered")},
placed AS (SELECT d.rid, '' AS k, o.idx FROM base d JOIN ordered o ON o.lang = d.k),
steps AS (
  {_steps_sql("base", "own", 0)}
  UNION ALL
  {_steps_sql("placed", "top", 64)}),
ways AS (
  SELECT rid, list(way ORDER BY step) AS way, string_agg(sibling, '' ORDER BY step) AS siblings
  FROM steps GROUP BY rid),
folded AS (
  SELECT b.*, siblings, list_reduce(list_prepend(coalesce(changed, node), coalesce(way, []::VARCHAR[])), lambda a, s:
    CASE WHEN s = '-' THEN sha256(a) WHEN s[1] = 'R' THEN sha256(a || s[2:]) ELSE sha256(s[2:] || a) END) AS folded_root
  FROM base b LEFT JOIN ways USING (rid))
SELECT doc_id, f.node AS leaf, subroot, r.node AS root, sha256(coalesce(siblings, '')) AS proof_sha256,
  folded_root, folded_root = r.node AS verified
FROM folded f JOIN subroots USING (k) CROSS JOIN (SELECT arg_max(node, level) AS node FROM top) r
"""
