"""Append the micro-batches of a stream to a table."""

from __future__ import annotations

import logging
import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..table import TimeSeriesTable

log = logging.getLogger("tidemark")


def append_stream(stream: DataFrame, table: TimeSeriesTable, checkpoint: str, late: str = "reject", aside: str | None = None, name: str | None = None, **trigger) -> StreamingQuery:
    """Each micro-batch is one append, committed once: the commit holds the batch's number under the stream's
    name (by default its checkpoint), so a batch that is run again after a crash is left out.

    A bucket is written once per entity. Rows of a bucket that the table covers are late: they end the stream
    (late='reject') or are set aside one by one (late='skip'), counted in the log and, with aside, written there
    as Parquet, one folder a batch; the other rows of their batch are appended.
    """
    if late not in ("reject", "skip"):
        raise ValueError("late is reject or skip")
    who = name or os.path.abspath(checkpoint)

    def append(batch: DataFrame, number: int) -> None:
        table.refresh()
        if table.state.batches.get(who, -1) >= number:
            return
        if late == "reject":
            if not batch.isEmpty():
                table.append(batch, batch=(who, number))
            return
        split = table.split_late(batch).persist()
        try:
            counts = {r["__late"]: r["n"] for r in split.groupBy("__late").agg(F.count(F.lit(1)).alias("n")).collect()}
            if n := counts.get(True, 0):
                log.warning("batch %d of %s: %d late row(s) set aside", number, who, n)
                if aside:
                    split.where("__late").drop("__late").write.mode("overwrite").parquet(f"{aside.rstrip('/')}/batch={number}")
            if counts.get(False, 0):
                table.append(split.where("not __late").drop("__late"), batch=(who, number))
        finally:
            split.unpersist()

    return stream.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
