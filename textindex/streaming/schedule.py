"""J2 as a stream: fetch times that keep each host's crawl delay.

URLs arrive as a stream of ``(host, url, depth, crawl_delay)``; every one gets the next
free slot of its host, a delay after the one before. A host's state is one row (its slot
number, and where the delay that now holds began), kept by ``applyInPandasWithState`` in
the checkpoint, so a restart goes on where it ended. With ``forget_after``, a host without
a URL for so many seconds is forgotten, its delay being long past; a checkpoint keeps to
the choice it began with.

Within a micro-batch a host's URLs are ordered by (depth, url), as the batch operator
``crawl_schedule`` orders all of them; a stream that is replayed in order of depth gives
its offsets. A host's rows of one micro-batch meet in one task, so the source's limit on a
micro-batch bounds them.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

# The function travels with the job, so executors need not have this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

OUTPUT = "host string, url string, depth int, slot long, fetch_offset_s double"
STATE = "slot long, since long, offset double, delay double"


def next_slots(last: tuple | None, delays) -> tuple[tuple, list[int], list[float]]:
    """Slots and offsets of URLs with these delays, after a host's ``last`` state.

    The state is the last slot, the slot ``since`` which ``delay`` holds, and that slot's
    offset, so an offset is one product and no sum of many rounded delays.
    """
    slot, since, offset, delay = last or (0, 1, 0.0, None)
    slots, offsets = [], []
    for wanted in delays:
        slot += 1
        if delay is None:
            delay = wanted
        elif wanted != delay:
            offset, since, delay = offset + (slot - 1 - since) * delay, slot - 1, wanted
        slots.append(slot)
        offsets.append(offset + (slot - since) * delay)
    return (slot, since, offset, delay), slots, offsets


def schedule_stream(urls: DataFrame, forget_after: int | None = None) -> DataFrame:
    """``(host, url, depth, slot, fetch_offset_s)`` of a stream of allowed URLs."""
    def assign(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        found = pd.concat(list(rows)).sort_values(["depth", "url"], na_position="first")
        last, slots, offsets = next_slots(state.get if state.exists else None,
                                          found["crawl_delay"].fillna(0.0).astype(float).tolist())
        state.update(last)
        if forget_after:
            state.setTimeoutDuration(forget_after * 1000)
        yield pd.DataFrame({"host": found["host"], "url": found["url"], "depth": found["depth"],
                            "slot": slots, "fetch_offset_s": offsets})

    rows = urls.select("host", "url", F.col("depth").cast("int").alias("depth"),
                       F.col("crawl_delay").cast("double").alias("crawl_delay"))
    return rows.groupBy("host").applyInPandasWithState(
        assign, OUTPUT, STATE, "append",
        GroupStateTimeout.ProcessingTimeTimeout if forget_after else GroupStateTimeout.NoTimeout)


def start_schedule_stream(urls: DataFrame, output: str, checkpoint_location: str,
                          available_now: bool = False, forget_after: int | None = None) -> StreamingQuery:
    """Write the schedule of ``urls`` as Parquet under ``output``.

    A run over what exists cannot forget: with a timeout Spark goes on looking for hosts
    whose time has come, and would not end.
    """
    if available_now and forget_after:
        raise ValueError("available_now and forget_after exclude each other")
    writer = (schedule_stream(urls, forget_after).writeStream.format("parquet").outputMode("append")
              .option("path", output).option("checkpointLocation", checkpoint_location))
    return (writer.trigger(availableNow=True) if available_now else writer).start()
