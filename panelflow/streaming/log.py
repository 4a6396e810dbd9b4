"""An event log that holds each event of a stream once, whatever is run again.

A batch's events are written to the folder of its number, whose content a repeated batch replaces;
so a batch that failed, or was written but not noted as done before a restart, leaves no event
twice. Messages go out after the write, and a mark beside the batch says that they did: they are
sent once, but for a stop between sending and marking.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from panelflow.operators.monitor import EVENT, alert_text
from panelflow.sources import store


def log_batch(folder: str, tell: Callable[[str], bool] | None = None) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: the batch's events to folder/batch=<number>, then one message of them by `tell`."""

    def write(events: DataFrame, number: int) -> None:
        spark, at = events.sparkSession, f"{folder}/events/batch={number}"
        events.write.mode("overwrite").parquet(at)
        mark = f"{folder}/told/batch={number}"
        if tell is None or store.exists(spark, mark):
            return
        kept = spark.read.parquet(at)
        if kept.isEmpty() or tell(alert_text(kept).first()["text"]):
            spark.range(1).write.mode("overwrite").parquet(mark)

    return write


def start(events: DataFrame, folder: str, tell: Callable[[str], bool] | None = None, **trigger) -> StreamingQuery:
    """Runs a stream of events into the log in folder; its checkpoint lies there too, so a restart goes on where it was."""
    writer = events.writeStream.foreachBatch(log_batch(folder, tell)).option("checkpointLocation", f"{folder}/checkpoint").outputMode("append")
    return (writer.trigger(**trigger) if trigger else writer).start()


def read(spark: SparkSession, folder: str) -> DataFrame:
    """The log's events, with their batch."""
    at = f"{folder}/events"
    if not store.exists(spark, at):
        return spark.createDataFrame([], EVENT + ", batch long")
    return spark.read.schema(EVENT + ", batch long").parquet(at)
