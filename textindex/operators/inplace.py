"""F1 + F2 where the texts lie: postings of whole documents without exchanging a token.

Spark analyzes a text into its terms; an Arrow function groups the terms of some documents
at a time by (document, term) in numpy. A row of documents counts as a document of its own:
rows that share an id are for ``build_postings``, which meets them in a shuffle.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Functions that run in tasks travel with the job, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

STEP_TOKENS = 500_000       # tokens grouped at a time, or one document's


def postings_in_place(documents: DataFrame, terms, keep=()) -> DataFrame:
    """``(*keep, term, doc_id, tf, positions)`` of each row of documents, in its partition.

    ``terms`` is the column of a row's analyzed terms, an array without nulls.
    """
    rows = documents.select(*keep, "doc_id", terms.alias("terms"))
    schema = T.StructType([*[rows.schema[c] for c in keep], T.StructField("term", T.StringType()),
                           rows.schema["doc_id"], T.StructField("tf", T.IntegerType()),
                           T.StructField("positions", T.ArrayType(T.IntegerType()))])
    kept, step = list(keep), STEP_TOKENS

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from grouped(batch, kept, step)

    return rows.mapInArrow(post, schema)


def grouped(batch: pa.RecordBatch, keep: list[str], step: int) -> Iterator[pa.RecordBatch]:
    lists = batch.column("terms")
    ends = lists.offsets.to_numpy().astype("int64")
    first, rows = 0, len(lists)
    while first < rows:
        last = max(first + 1, int(np.searchsorted(ends, ends[first] + step, "right")) - 1)
        total = int(ends[last] - ends[first])
        if total:
            words = lists.values.slice(int(ends[first]), total).dictionary_encode()
            names = words.dictionary.take(by_name := pc.sort_indices(words.dictionary))
            rank = np.empty(len(names), "int64")
            rank[by_name.to_numpy()] = np.arange(len(names))
            codes = rank[words.indices.to_numpy()]
            size = np.diff(ends[first:last + 1])
            row = np.repeat(np.arange(last - first), size)
            pos = np.arange(total) - np.repeat(ends[first:last] - ends[first], size)
            key = codes * (last - first) + row              # runs of equal terms, for what sorts them next
            order = np.argsort(key, kind="stable")          # positions stay in order
            key = key[order]
            starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            at = order[starts]
            cuts = np.append(starts, total).astype("int32")
            held = batch.slice(first, last - first)
            found = {c: held.column(c).take(pa.array(row[at])) for c in (*keep, "doc_id")}
            found |= {"term": names.take(pa.array(codes[at])), "tf": pa.array(np.diff(cuts)),
                      "positions": pa.ListArray.from_arrays(pa.array(cuts), pa.array(pos[order].astype("int32")))}
            yield pa.RecordBatch.from_pydict({c: found[c] for c in (*keep, "term", "doc_id", "tf", "positions")})
        first = last
