"""The call log as a stream, and window aggregates on event streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def validity_windows(calls: DataFrame, width: str = "1 day") -> DataFrame:
    """window_start, model_type, n, n_valid of calls (logged_at, model_type, json_valid); batch or stream."""
    return (
        calls.groupBy(F.window("logged_at", width).alias("w"), "model_type")
        .agg(F.count("*").alias("n"), F.count_if(F.coalesce("json_valid", F.lit(False))).alias("n_valid"))
        .select(F.col("w.start").alias("window_start"), "model_type", "n", "n_valid")
    )


def read_calls(spark: SparkSession, path: str, schema, most_files: int = 4) -> DataFrame:
    """The call log as a file stream, from a folder or one file; files that were read are never read again."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", most_files)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isFile():
        return reader.option("pathGlobFilter", at.getName()).parquet(at.getParent().toString())
    return reader.parquet(path)


def once_per_call(calls: DataFrame, key: str = "log_id", late: str = "400 days") -> DataFrame:
    """Calls without second deliveries; state is kept as long as a delivery may be late."""
    return calls.withWatermark("logged_at", late).dropDuplicatesWithinWatermark([key])


def run_to_end(stream: DataFrame, out: str, checkpoint: str) -> DataFrame:
    """Runs an aggregating stream over all that is there and returns its final table.

    Each trigger replaces the table as a whole, so a restart after a lost executor cannot double it.
    """
    spark = stream.sparkSession

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/at-{number % 2}")
        batch.sparkSession.createDataFrame([(number,)], "n long").coalesce(1).write.mode("overwrite").parquet(f"{out}/latest")

    q = stream.writeStream.outputMode("complete").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(put).start()
    q.awaitTermination()
    newest = spark.read.parquet(f"{out}/latest").first()[0]
    return spark.read.schema(stream.schema).parquet(f"{out}/at-{newest % 2}")


def append_new(stream: DataFrame, out: str, checkpoint: str) -> None:
    """Appends what is new as JSON lines; the checkpoint is what a restart resumes from."""
    stream.writeStream.format("json").outputMode("append").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
