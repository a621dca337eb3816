"""Streams of documents: tokens as they come, and running counts of strings that survive restarts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.sources import store
from lexiloom.sources.corpus import tokens


def stream_documents(spark: SparkSession, folder: str, per_trigger: int = 8) -> DataFrame:
    """Documents of the Parquet files that are in the folder, or come to it; a single file will do."""
    stream = spark.readStream.schema(spark.read.parquet(folder).schema).option("maxFilesPerTrigger", per_trigger)
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isFile():
        # A stream watches folders, so a single file is picked from its own.
        return stream.option("pathGlobFilter", path.getName()).parquet(path.getParent().toString())
    return stream.parquet(folder)


def annotate_to(docs: DataFrame, path: str, checkpoint: str):
    """Writes the tokens of a stream of documents; stateless, and exactly once by the file sink's log."""
    return tokens(docs).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def counts_to(docs: DataFrame, path: str, checkpoint: str):
    """Keeps (surface, n) over all that has come. Each trigger's counts are merged with the table before it
    and written under the trigger's number, so a trigger that runs again replaces its own table."""

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = batch.groupBy("surface").agg(F.count("*").alias("n"))
        if number:
            new = new.unionByName(spark.read.parquet(f"{path}/{number - 1}")).groupBy("surface").agg(F.sum("n").alias("n"))
        new.write.mode("overwrite").parquet(f"{path}/{number}")

    return tokens(docs).writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_counts(spark: SparkSession, folder: str) -> DataFrame:
    """(surface, n) after all files of the folder have gone through the stream."""
    path, checkpoint = store.scratch(spark, "counts"), store.scratch(spark, "counts-log")
    query = counts_to(stream_documents(spark, folder), path, checkpoint)
    query.awaitTermination()
    # Progress that had rows names the triggers that wrote a table.
    number = max(p["batchId"] for p in query.recentProgress if p["numInputRows"])
    return spark.read.parquet(f"{path}/{number}")


def run_annotation(spark: SparkSession, folder: str) -> DataFrame:
    """The tokens of all files of the folder, written by a stream and read again."""
    path, checkpoint = store.scratch(spark, "tokens"), store.scratch(spark, "tokens-log")
    annotate_to(stream_documents(spark, folder), path, checkpoint).awaitTermination()
    return spark.read.parquet(path)
