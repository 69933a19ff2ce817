"""Structured Streaming: sources over growing folders, runs to the end of what is there."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..storage import fresh_path


def stream_of(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A stream of a table's files; `ts` as an event time. A table may be one file or a folder of files."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    reader = spark.readStream.schema(schema)
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
    fs = fs_path.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.getFileStatus(fs_path).isDirectory():
        rows = reader.parquet(f"{sf_dir}/{name}.parquet")
    else:
        rows = reader.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)
    return rows.withColumn("ts", F.col("ts").cast("timestamp")) if "ts" in rows.columns else rows


def scratch(spark: SparkSession) -> str:
    """A new folder for offsets and results in the shared folder."""
    return fresh_path(spark, "stream")


def settled(stream: DataFrame, timeout_s: int = 600) -> DataFrame:
    """Run an append stream over all that is there into Parquet, and read that."""
    folder = scratch(stream.sparkSession)
    run = stream.writeStream.format("parquet").option("checkpointLocation", f"{folder}/offsets").option("path", f"{folder}/rows").trigger(availableNow=True).start()
    return _ended(stream, run, folder, timeout_s)


def settled_aggregate(stream: DataFrame, timeout_s: int = 600) -> DataFrame:
    """Run an aggregating stream in complete mode; each batch replaces the result before."""
    folder = scratch(stream.sparkSession)

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/rows")

    run = stream.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{folder}/offsets").trigger(availableNow=True).start()
    return _ended(stream, run, folder, timeout_s)


def _ended(stream: DataFrame, run, folder: str, timeout_s: int) -> DataFrame:
    try:
        if not run.awaitTermination(timeout_s):
            raise TimeoutError("the stream didn't end")
    finally:
        run.stop()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/rows")


def ledger(stream: DataFrame, id: str, after: int) -> DataFrame:
    """What came behind the cursor."""
    return stream.where(F.col(id) > after)


def latest(stream: DataFrame, by: str, order: str, value: str) -> DataFrame:
    """The last note of each key."""
    return stream.groupBy(by).agg(F.max_by(value, order).alias(value), F.max(order).alias(order))


def settled_updates(stream: DataFrame, *keys: str, timeout_s: int = 600) -> DataFrame:
    """Run an updating stream, whose state its watermark bounds; the last row of each key counts."""
    folder = scratch(stream.sparkSession)

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("__batch", F.lit(number)).write.mode("overwrite").parquet(f"{folder}/rows/{number}")

    run = stream.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{folder}/offsets").trigger(availableNow=True).start()
    try:
        if not run.awaitTermination(timeout_s):
            raise TimeoutError("the stream didn't end")
    finally:
        run.stop()
    rows = stream.sparkSession.read.schema(StructType([*stream.schema.fields, StructField("__batch", IntegerType())])).option("recursiveFileLookup", "true").parquet(f"{folder}/rows")
    rest = [c for c in stream.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "__batch").alias("r")).select(*keys, "r.*")


def tallied(stream: DataFrame, by: str, kind: str, opening: str, closing: str) -> DataFrame:
    """by, opened, closed: running tallies of each key, kept in the state store between batches."""
    import pandas as pd
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(key: tuple, frames, state: GroupState):
        opened, closed = state.get if state.exists else (0, 0)
        for frame in frames:
            opened += int((frame[kind] == opening).sum())
            closed += int((frame[kind] == closing).sum())
        state.update((opened, closed))
        yield pd.DataFrame({by: [key[0]], "opened": [opened], "closed": [closed]})

    field = dict(stream.dtypes)[by]
    return stream.select(by, kind).groupBy(by).applyInPandasWithState(step, f"{by} {field}, opened long, closed long", "opened long, closed long", "update", GroupStateTimeout.NoTimeout)


def live(snapshot: DataFrame, stream: DataFrame, folder: str, timeout_s: int = 600) -> DataFrame:
    """A sink for watchers: the snapshot first, as message 0, then a message of rows for each batch of the stream.

    A batch that is sent again after a failure replaces its own message, so a watcher sees each row once.
    """
    snapshot.write.mode("overwrite").json(f"{folder}/messages/message=0")

    def send(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").json(f"{folder}/messages/message={number + 1}")

    run = stream.writeStream.foreachBatch(send).option("checkpointLocation", f"{folder}/offsets").trigger(availableNow=True).start()
    try:
        if not run.awaitTermination(timeout_s):
            raise TimeoutError("the stream didn't end")
    finally:
        run.stop()
    return snapshot.sparkSession.read.schema(StructType([*snapshot.schema.fields, StructField("message", IntegerType())])).json(f"{folder}/messages")
