"""Structured Streaming over the event table.

Files of the shared folder are the only sinks: checkpoints and results survive a lost
executor or driver.  ``spark.checkpoint.dir`` names that folder.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``; a local one only where that is unset in local mode."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        import tempfile

        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="sparkeval-streams-")
    return f"{base}/streams/{uuid.uuid4().hex}"


def event_stream(spark: SparkSession, sf_dir: str, watermark: str | None = None) -> DataFrame:
    """The ``events`` table as a stream; its times become instants in the session's zone."""
    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    # a glob, since a stream reads a folder or a pattern
    rows = spark.readStream.schema(schema).parquet(path.removesuffix("s.parquet") + "[s].parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    return rows.withWatermark("ts", watermark) if watermark else rows


def run_to_end(spark: SparkSession, stream: DataFrame, plan, mode: str = "append") -> DataFrame:
    """What ``plan`` of the stream has put out once all input that is there is read.

    ``append`` goes to a Parquet sink, which keeps each batch once; ``complete`` replaces one table by batch number.
    """
    folder = shared_folder(spark)
    out = plan(stream)
    writer = out.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{folder}/state").outputMode(mode)
    if mode == "append":
        writer.format("parquet").option("path", f"{folder}/out").start().awaitTermination()
        return spark.read.schema(out.schema).parquet(f"{folder}/out")
    last = {}

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")
        last["number"] = number

    writer.foreachBatch(put).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{folder}/out/batch={last['number']}") if last else spark.createDataFrame([], out.schema)


def relay(spark: SparkSession, stream: DataFrame, key: str) -> DataFrame:
    """Rows of the stream in a sink by batch number: a batch that is run again replaces itself."""
    folder = shared_folder(spark)

    def put(batch: DataFrame, number: int) -> None:
        batch.dropDuplicates([key]).write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    q = stream.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{folder}/state").foreachBatch(put).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out").dropDuplicates([key])
