"""Operator 2: mixing sources to target weights by Pfair scheduling.

A source's documents are cut into blocks, and a source of weight ``w`` (its share of the
weights of all sources that still have blocks) gives its block ``i`` (from 0) the release
time ``floor(i / w)`` and the deadline ``ceil((i + 1) / w)``, in slots of one block.
Earliest deadline first among the released blocks meets every deadline, so after any
number of slots each source is within one block of its target. Weights are taken as they
are, as fractions of integers, so that holds against the unrounded targets however long
the mixture runs.

When a source runs out, a new phase starts there, in which the others go on with their
weights scaled up; every document gets a position and none is repeated.

The driver holds a row of counts for each source and lays out one slot for each block,
never a document. Blocks hold ``block_docs`` documents, or as many more as keep their
number near ``MAX_BLOCKS``: at most that and one for each source. A phase costs as many
steps as it has slots, whatever the number of sources.

Edge cases: a null source is a source of its own; a weight that is missing, not finite or
not positive, for a source that has documents, counts as the smallest of the others (1 if
there is none); equal deadlines go to the source with the larger weight, then the smaller
name; repeated rows are mixed each; an empty table gives no rows; columns of the result's
names that ``docs`` already has are replaced.
"""

from __future__ import annotations

import heapq
import math
from fractions import Fraction

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textindex.llm.common import BROADCAST_BYTES, materialize, number_within, read

BLOCK_DOCS = 16
MAX_BLOCKS = 1 << 18
TEMPERATURE = 0.5
RESULT = ("block", "phase", "release", "deadline", "slot", "position")


def target_weights(counts: dict, temperature: float = TEMPERATURE) -> dict:
    """Weights that flatten the sources' sizes: each its count to the power ``temperature``."""
    return {s: n ** temperature for s, n in counts.items()}


def _name(source) -> tuple:
    return (source is not None, str(source))


def integer_weights(weights: dict, sources) -> dict:
    """Integers in exactly the proportions of the weights."""
    given = {s: weights.get(s) for s in sources}
    good = {s: Fraction(w) for s, w in given.items() if w is not None and math.isfinite(w) and w > 0}
    least = min(good.values(), default=Fraction(1))
    whole = {s: good.get(s, least) for s in given}
    scale = math.lcm(*[w.denominator for w in whole.values()])
    return {s: int(w * scale) for s, w in whole.items()}


def release(i: int, p: int, q: int) -> int:
    return i * q // p


def deadline(i: int, p: int, q: int) -> int:
    return -(-(i + 1) * q // p)


def schedule(blocks: dict, weights: dict) -> list[tuple]:
    """``(source, block, phase, release, deadline)`` slot by slot, earliest deadline first."""
    shares = integer_weights(weights, [s for s, n in blocks.items() if n > 0])
    names = sorted(shares, key=lambda s: (-shares[s], _name(s)))
    p, left, done = [shares[s] for s in names], [blocks[s] for s in names], [0] * len(names)
    following = list(range(len(names) + 1))      # of a source that has run out: one after it

    def alive(k: int) -> int:
        while following[k] != k:
            following[k] = following[following[k]]
            k = following[k]
        return k

    out: list[tuple] = []
    q, phase = sum(p), 0
    while alive(0) < len(names):
        # All first blocks are released at once, and their deadlines ascend with the
        # order of names; only sources that have had a slot enter the heaps.
        start, fresh, used = len(out), alive(0), {}
        waiting: list[tuple[int, int]] = []
        ready: list[tuple[int, int]] = []
        while True:
            while waiting and waiting[0][0] <= len(out) - start:
                _, k = heapq.heappop(waiting)
                heapq.heappush(ready, (deadline(used[k], p[k], q), k))
            first = (deadline(0, p[fresh], q), fresh) if fresh < len(names) else None
            if first is not None and (not ready or first < ready[0]):
                end, k = first
                fresh = alive(fresh + 1)
            else:
                end, k = heapq.heappop(ready)
            i = used.get(k, 0)
            out.append((names[k], done[k], phase, start + release(i, p[k], q), start + end))
            used[k], done[k], left[k] = i + 1, done[k] + 1, left[k] - 1
            if not left[k]:
                break
            heapq.heappush(waiting, (release(i + 1, p[k], q), k))
        q, phase, following[k] = q - p[k], phase + 1, k + 1
    return out


def _numbered(docs: DataFrame) -> DataFrame:
    """``docs`` as ``(source, row, n)``: n is a row's number in its source, shuffled."""
    every = [F.col(f"`{c}`") for c in docs.columns]
    keyed = docs.select(
        F.col("source"), F.xxhash64(F.col("doc_id"), F.lit(1)).alias("o1"),
        F.xxhash64(*every).alias("o2"), F.struct(*every).alias("row"))
    return number_within(keyed, "source", ["o1", "o2"])


def mix(docs: DataFrame, weights: dict | None = None, block_docs: int = BLOCK_DOCS,
        max_blocks: int = MAX_BLOCKS) -> DataFrame:
    """``docs`` with each row's block of its source, phase, release time, deadline,
    slot, and position in the mixture (from 0, without gaps)."""
    docs = docs.drop(*[c for c in RESULT if c in docs.columns])
    spark = docs.sparkSession
    numbered = _numbered(docs)
    counts = {r["source"]: r["n"] for r in
              docs.groupBy("source").agg(F.count(F.lit(1)).alias("n")).collect()}
    block_docs = max(block_docs, -(-sum(counts.values()) // max_blocks))
    plan = schedule({s: -(-n // block_docs) for s, n in counts.items()}, weights or target_weights(counts))
    slots = pd.DataFrame(plan, columns=["s", "block", "phase", "release", "deadline"])
    slots["slot"] = range(len(slots))
    sizes = [min(block_docs, counts[s] - b * block_docs) for s, b, *_ in plan]
    slots["before"] = pd.Series(sizes, dtype="int64").cumsum() - pd.Series(sizes, dtype="int64")
    slots["s"] = [None if s is None else str(s) for s in slots["s"]]
    kind = "s string, block long, phase int, release long, deadline long, slot long, before long"
    placed = materialize(spark.createDataFrame(slots, kind) if len(slots) else
                         spark.createDataFrame([], kind), "mixing-slots").withColumnRenamed("block", "b")
    if len(slots) * 64 <= BROADCAST_BYTES:
        placed = F.broadcast(placed)
    timed = (numbered.withColumn("block", F.floor(F.col("n") / block_docs))
             .join(placed, F.col("source").cast("string").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b"))))
    return timed.select("row.*", "block", "phase", "release", "deadline", "slot",
                        (F.col("before") + F.col("n") % block_docs).alias("position"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mix all documents by source, weights flattened with temperature 0.5."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "source")
    return mix(docs)
