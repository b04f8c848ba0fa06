"""Column helpers for operators that stay inside Spark SQL expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_CHUNK = 256


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once per row.

    A column used inside a lambda is otherwise evaluated again for each element.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _scan(values: Column) -> Column:
    """Exclusive running sums of ``values``: same size, first entry 0."""
    sums = F.aggregate(values, F.array(F.lit(0).cast("long")),
                       lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))
    return F.slice(sums, F.lit(1), F.size(values))


def running(values: Column) -> Column:
    """Exclusive running sums of an array of longs.

    Appending to an array copies it, so sums are made in chunks and the chunks'
    totals are summed apart; the cost stays near linear in the array's size.
    """
    def by_chunks(vals: Column) -> Column:
        last = F.expr("0") + F.floor((F.size(vals) - 1) / _CHUNK)
        chunks = F.transform(F.sequence(F.lit(0).cast("long"), F.greatest(last, F.lit(0).cast("long"))),
                             lambda c: F.slice(vals, (c * _CHUNK + 1).cast("int"), F.lit(_CHUNK)))
        return let(chunks, with_chunks)

    def with_chunks(chunks: Column) -> Column:
        totals = F.transform(chunks, lambda ch: F.aggregate(
            ch, F.lit(0).cast("long"), lambda s, x: s + x))
        return F.flatten(F.zip_with(chunks, let(totals, _scan), lambda ch, off: F.transform(
            _scan(ch), lambda x: x + off)))

    return let(values, by_chunks)


def ascii_lower(col: Column) -> Column:
    """A-Z lower-cased, all other characters as they are."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
