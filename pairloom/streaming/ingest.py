"""Snapshots that grow from a stream of functions.

This is an addition of our own: what it keeps from incremental export is that an address is taken in once.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pairloom.operators.ranges import numbered
from pairloom.sources import manifest
from pairloom.sources.snapshot import Snapshot
from pairloom.sources.tables import written


def append_new(folder: str):
    """A foreachBatch function that appends a batch's functions whose address the folder lacks; repeating a batch adds
    nothing."""

    def write(batch: DataFrame, _: int) -> None:
        path = f"{folder}/functions.parquet"
        fresh = batch.dropDuplicates(["address"])
        try:
            stored = batch.sparkSession.read.parquet(path).select("address")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
        else:
            fresh = fresh.join(stored, "address", "left_anti").select(*batch.columns)
        fresh.write.mode("append").parquet(path)

    return write


def ingest(stream: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Takes in what is there and then ends; started again with one checkpoint, it goes on where it ended."""
    return stream.writeStream.foreachBatch(append_new(folder)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def append_records(folder: str, children: tuple[str, ...], name: str = "stream"):
    """A foreachBatch function that takes a batch's records in as functions with their rows in other tables, all in one commit.

    children: array columns of structs, each the rows of the table of its name. A batch is known by the stream's name and its
    number, so one that comes again after a failure adds nothing in any table. Of records of one address in a batch one is
    taken. Null arrays have no rows.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        if f"{name}-{number}" in manifest.state(spark, folder).batches:
            return
        once = written(batch.dropDuplicates(["address"]).drop("id"), "batch")
        records = written(numbered(once, "address", column="id").withColumn("id", F.col("id") + 1), "records")
        frames = {"functions": records.drop(*children)}
        for c in children:
            frames[c] = records.select(F.col("id").alias("func_id"), F.explode(c).alias("row")).select("func_id", "row.*")
        snapshot = Snapshot(frames)
        if manifest.state(spark, folder).version < 0:
            snapshot.save(folder, batch=f"{name}-{number}")
        else:
            snapshot.append(folder, f"{name}-{number}")

    return write


def ingest_records(stream: DataFrame, folder: str, checkpoint: str, children: tuple[str, ...], name: str = "stream") -> StreamingQuery:
    """Takes in the records that are there, with their child rows, and then ends."""
    return stream.writeStream.foreachBatch(append_records(folder, children, name)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
