"""Finished runs of streams: all data at hand, then stop."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.shared import shared_folder


def finished(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is there and return the table of its output.

    State and offsets go to the shared folder, so a restart goes on from them.
    In append mode the last windows are written when the watermark passes them;
    ``complete`` writes them all."""
    spark = stream.sparkSession
    folder = shared_folder(spark, f"stream-{name}")
    writer = stream.writeStream.option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).outputMode(mode)
    if mode == "append":
        writer.format("parquet").option("path", f"{folder}/out").start().awaitTermination()
        return spark.read.schema(stream.schema).parquet(f"{folder}/out")
    # Complete results are aggregates: each batch replaces the table.
    writer.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(f"{folder}/out")).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


def batch_folder(folder: str, batch: int) -> str:
    return f"{folder}/batch={batch}"


def write_once(rows: DataFrame, folder: str, batch: int, by: tuple = ()) -> None:
    """Write a batch under its number: when it runs again after a failure it takes the
    place of what it left, so that every row is there once."""
    rows.write.mode("overwrite").partitionBy(*by).parquet(batch_folder(folder, batch))


def read_batches(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """What all batches wrote, with ``batch``, the number of each; nothing if there was
    no batch."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], f"{schema}, batch bigint")
    return spark.read.schema(f"{schema}, batch bigint").parquet(folder)


def run_batches(stream: DataFrame, folder: str, handle: Callable[[DataFrame, int], None]) -> None:
    """Run a stream over what is there, batch by batch; offsets lie in the folder, so a
    run after a failure begins with the batch that failed, under the same number."""
    stream.writeStream.option("checkpointLocation", f"{folder}/offsets").trigger(availableNow=True).foreachBatch(handle).start().awaitTermination()


def exported(stream: DataFrame, name: str, folder: str | None = None) -> DataFrame:
    """Export a stream to a folder of batches, each written once."""
    spark = stream.sparkSession
    folder = folder or shared_folder(spark, f"stream-{name}")
    run_batches(stream, folder, lambda df, batch: write_once(df, f"{folder}/out", batch))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stream.schema)
    return read_batches(spark, f"{folder}/out", schema).drop("batch")
