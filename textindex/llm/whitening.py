"""Operator 12: embedding whitening by Chebyshev-filtered subspace iteration.

The leading eigenvectors of the vectors' covariance V are found without forming V:
a pass gives ``V Q`` for a thin block Q as the sum over all rows of
``(x - mean) ((x - mean)' Q)``, centred before multiplying. A cycle runs the
Chebyshev recurrence over some passes, which damps all of the spectrum below the
block's smallest Ritz value against what lies above, then orthonormalises the block
(QR) and solves the projected problem (Rayleigh-Ritz). Cycles end when the wanted
pairs' residuals are at the rounding level and a cycle whose other block vectors
were drawn anew finds the same leading values (certified), so that no direction can
be missing because the first block had none of it.

A pass is two DataFrame steps: tasks sum their own rows to one matrix, a row for
each dimension, and the rows are summed by dimension. The driver gets dimensions x
block numbers, whatever the number of vectors.

Entries become longs first (``floor(1024 c) + 100000``), so sums, means and each
row's ``deviation`` are exact, and ``x - mean`` is taken as ``(n x - S) / n``.

Edge cases: vectors that are null or hold a null, NaN or infinite entry are not
fitted and not returned. Vectors of another length than most (of equally many: the
longer) have no covariance with the rest and count as such. Entries beyond 2**40 are
cut to it; a ``deviation`` beyond a long is null. A component whose eigenvalue is at
the rounding level of the trace (one vector, equal vectors, dependent dimensions) has
``whitened`` null, and ``identity_error`` is taken over the others (0 if there are
none). Fewer dimensions than components give as many as there are; empty tables and
empty vectors give no rows. Repeated rows and null ids are rows like any other.
Other columns are neither read nor returned.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textindex.llm.common import materialize, read

COMPONENTS = 8
GUARDS = 24              # block vectors besides the wanted ones
DEGREE = 10              # most passes in a cycle
AMPLIFIED = 1e10         # most that a cycle enlarges the leading direction against the cut; rounding bounds it
MAX_CYCLES = 60
RESIDUAL = 2e-13         # of a wanted pair, against the largest Ritz value
SAME = 1e-10             # relative change of the values that a fresh cycle may find
RANK = 1e-13             # eigenvalues under this share of the trace count as none
SEED = 7
_ROWS = 4096             # vectors that are multiplied at a time
_LIMIT = float(1 << 40)


def quantized(vectors: DataFrame, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """``(vec_id, x)`` of the vectors that can be fitted, written to the shared folder."""
    good = vectors.filter(F.col(vector).isNotNull() & (F.size(vector) > 0)
                          & F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c.cast("double"))
                                     & (F.abs(c.cast("double")) < float("inf"))))
    whole = materialize(good.select(F.col(key).alias("vec_id"), F.transform(
        vector, lambda c: (F.floor(F.greatest(F.lit(-_LIMIT), F.least(
            F.lit(_LIMIT), c.cast("double") * 1024))) + 100000).cast("long")).alias("x")), "vectors")
    most = whole.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(
        F.desc("n"), F.desc("d")).first()
    return whole.filter(F.size("x") == most["d"]) if most else whole


def _matrix(column: pa.Array) -> np.ndarray:
    rows = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(rows, -1) if rows else np.zeros((0, 0), np.int64)


@dataclass(frozen=True)
class Centre:
    """Number and exact sums of the vectors."""
    n: int
    sums: tuple[int, ...]

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """``x - S / n``, from the exact ``n x - S`` where that fits a long."""
        if self.n * float(np.abs(x).max(initial=0)) < 2.0 ** 61:
            return self.exact(x).astype(np.float64) / self.n
        return x.astype(np.float64) - np.array([s / self.n for s in self.sums])

    def exact(self, x: np.ndarray) -> np.ndarray:
        return x * np.int64(self.n) - np.array(self.sums, np.int64)

    def squares(self, x: np.ndarray) -> list[int | None]:
        """Each row's sum of ``(n x - S) ** 2``; null beyond a long."""
        about = (self.deviations(x) ** 2).sum(axis=1) * float(self.n) ** 2
        if about.max(initial=0.0) < 2.0 ** 62 and self.n * float(np.abs(x).max(initial=0)) < 2.0 ** 61:
            return (self.exact(x) ** 2).sum(axis=1).tolist()
        whole = [sum((int(v) * self.n - s) ** 2 for v, s in zip(row, self.sums)) for row in x.tolist()]
        return [v if v < 1 << 63 else None for v in whole]


def summed(vectors: DataFrame, width: int, part: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over all blocks of vectors of ``part(block)``, a matrix of ``width`` columns."""
    columns = [f"c{j}" for j in range(width)]

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS):
                one = part(_matrix(batch.column("x").slice(at, _ROWS)))
                total = one if total is None else total + one
        if total is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(len(total)), pa.int32()), *[pa.array(total[:, j]) for j in range(width)]],
                ["i", *columns])

    partial = vectors.select("x").mapInArrow(sums, "i int, " + ", ".join(f"{c} double" for c in columns))
    rows = partial.groupBy("i").agg(*[F.sum(c).alias(c) for c in columns]).collect()
    out = np.zeros((len(rows), width))
    for row in rows:
        out[row["i"]] = [row[c] for c in columns]
    return out


def centre_of(vectors: DataFrame) -> Centre:
    """Count and exact sums by dimension."""
    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, None
        for batch in batches:
            if batch.num_rows:
                n += batch.num_rows
                one = [int(s) for s in _matrix(batch.column("x")).sum(axis=0)]
                total = one if total is None else [a + b for a, b in zip(total, one)]
        if n:
            yield pa.RecordBatch.from_pydict({"i": pa.array(range(len(total)), pa.int32()), "s": list(map(str, total)),
                                              "n": [n] * len(total)})

    rows = (vectors.select("x").mapInArrow(sums, "i int, s string, n long")
            .groupBy("i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"), F.sum("n").alias("n"))
            .orderBy("i").collect())
    return Centre(rows[0]["n"] if rows else 0, tuple(int(r["s"]) for r in rows))


@dataclass(frozen=True)
class Whitening:
    centre: Centre
    trace: float
    values: np.ndarray          # falling eigenvalues
    components: np.ndarray      # a unit column each
    identity_error: float
    passes: int

    @property
    def scaled(self) -> np.ndarray:
        """Columns that whiten; those of no variance are NaN."""
        live = self.values > RANK * self.trace
        return np.where(live, self.components / np.sqrt(np.where(live, self.values, 1.0)), np.nan)


def fit(vectors: DataFrame, components: int = COMPONENTS, guards: int = GUARDS, degree: int = DEGREE,
        seed: int = SEED) -> Whitening | None:
    """Leading eigenpairs of the covariance of ``x``; None without vectors."""
    centre = centre_of(vectors)
    d, n = len(centre.sums), centre.n
    if not n:
        return None
    wanted, width = min(components, d), min(components + guards, d)
    rng = np.random.default_rng(seed)
    passes = 0

    def times(block: np.ndarray) -> np.ndarray:
        nonlocal passes
        passes += 1

        def part(x: np.ndarray) -> np.ndarray:
            c = centre.deviations(x)
            return c.T @ (c @ block)

        return summed(vectors, block.shape[1], part) / n

    def ritz(block: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Orthonormal Ritz vectors by falling value, their values, and V times them."""
        q, _ = np.linalg.qr(block)
        product = times(q)
        small = q.T @ product
        values, turn = np.linalg.eigh((small + small.T) / 2)
        turn = turn[:, ::-1]
        return q @ turn, values[::-1], product @ turn

    def filtered(block: np.ndarray, product: np.ndarray, cut: float, top: float) -> np.ndarray:
        """Chebyshev polynomial of V times the block: at most 1 on [0, cut], scaled to 1 at ``top``."""
        half = cut / 2
        scale = first = half / (top - half)
        before, now = block, (product - half * block) * (first / half)
        growth = np.arccosh(top / half - 1)     # of the polynomial at ``top``, a pass
        for _ in range(1, min(degree, int(np.log(AMPLIFIED) / growth))):
            following = 1 / (2 / first - scale)
            before, now = now, (times(now) - half * now) * (2 * following / half) - scale * following * before
            scale = following
        return now

    trace = float(summed(vectors, 1, lambda x: (centre.deviations(x) ** 2).sum(axis=0)[:, None]).sum()) / n
    block, values, product = ritz(rng.standard_normal((d, width)))
    certified = width == d or trace == 0.0
    checking, last = False, float("inf")
    for _ in range(0 if certified else MAX_CYCLES):
        cut = max(float(values[-1]), RANK * trace)
        if values[0] <= cut:            # all of the block's values agree
            break
        block, found, product = ritz(filtered(block, product, cut, float(values[0])))
        residual = np.linalg.norm(product[:, :wanted] - block[:, :wanted] * found[:wanted], axis=0).max()
        before, values = values, found
        settled = residual <= RESIDUAL * values[0] and (checking or residual > last / 2)
        last = residual
        if not settled:             # until rounding keeps the residuals from falling
            checking = False
            continue
        if checking and np.all(np.abs(before[:wanted] - values[:wanted]) <= SAME * values[0]):
            certified = True
            break
        checking = True
        fresh = np.column_stack([block[:, :wanted], rng.standard_normal((d, width - wanted))])
        block, fresh_values, product = ritz(fresh)
        values = np.append(values[:wanted], fresh_values[wanted:])
    if not certified:
        raise ArithmeticError(f"eigenvectors not certified after {passes} passes")
    found = Whitening(centre, trace, np.maximum(values[:wanted], 0.0), block[:, :wanted], 0.0, passes)
    live = np.flatnonzero(~np.isnan(found.scaled[0])) if trace else np.zeros(0, int)
    if not len(live):
        return found
    scaled = found.scaled[:, live]

    def moments(x: np.ndarray) -> np.ndarray:
        w = centre.deviations(x) @ scaled
        return np.column_stack([w.T @ w, w.sum(axis=0)])

    total = summed(vectors, len(live) + 1, moments) / n
    covariance = total[:, :-1] - np.outer(total[:, -1], total[:, -1])
    error = float(np.abs(covariance - np.eye(len(live))).max())
    return Whitening(centre, trace, found.values, found.components, error, passes + 2)


OUTPUT = ("vec_id long, component int, n long, deviation long, whitened double, explained double, "
          "identity_error double")


def whiten(vectors: DataFrame, model: Whitening | None) -> DataFrame:
    """A row for each vector and component."""
    schema = OUTPUT.replace("vec_id long", f"vec_id {vectors.schema['vec_id'].dataType.simpleString()}")
    if model is None:
        return vectors.sparkSession.createDataFrame([], schema)
    k = len(model.values)
    scaled = model.scaled if model.trace else np.full((len(model.centre.sums), k), np.nan)
    explained = model.values / model.trace if model.trace else np.zeros(k)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS):
                piece = batch.slice(at, _ROWS)
                x = _matrix(piece.column("x"))
                m = len(x)
                each = pa.array(np.repeat(np.arange(m), k))
                yield pa.RecordBatch.from_arrays([
                    piece.column("vec_id").take(each),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                    pa.array(np.full(m * k, model.centre.n, np.int64)),
                    pa.array(model.centre.squares(x), pa.int64()).take(each),
                    pa.array((model.centre.deviations(x) @ scaled).ravel(), from_pandas=True),
                    pa.array(np.tile(explained, m)),
                    pa.array(np.full(m * k, model.identity_error)),
                ], ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return vectors.mapInArrow(rows, schema)


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector on the eight leading components, whitened."""
    vectors = quantized(read(spark, sf_dir, "embeddings"))
    return whiten(vectors, fit(vectors))
