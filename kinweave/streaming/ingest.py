"""Incremental ingest with Structured Streaming: contract, dead letters, first deliveries.

Lines of JSON come from a folder (or any source with a column ``raw``). Each micro-batch
appends accepted canonical records, which no earlier batch has delivered, and dead letters.
A batch writes into a folder named by its id and overwrites it when it runs again, so a
restart from the checkpoint neither loses nor repeats a record. Identities are resolved over
the lake by :func:`kinweave.plans.resolve.resolve`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from kinweave.plans.resolve import first_deliveries
from kinweave.sources.contracts import canonical, contract_error, parse


def _lake(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(path)


def _batch(lake: str):
    def run(lines: DataFrame, batch_id: int) -> None:
        spark = lines.sparkSession
        parsed = parse(lines)
        error = F.when(F.col("broken"), F.lit("not a JSON object")).otherwise(contract_error(F.col("not_text")))
        checked = parsed.withColumn("error", error).persist()
        try:
            good = first_deliveries(canonical(checked))
            folder = spark._jvm.org.apache.hadoop.fs.Path(f"{lake}/records")
            if folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
                earlier = _lake(spark, f"{lake}/records", good.schema).withColumn("_file", F.input_file_name())
                earlier = earlier.where(~F.col("_file").contains(f"/batch={batch_id}/")).select("record_id")
                good = good.join(earlier, "record_id", "left_anti")
            good.write.mode("overwrite").parquet(f"{lake}/records/batch={batch_id}")
            letters = checked.where("error is not null").select(
                F.to_json(F.struct("error", *[c for c in ("topic", "partition", "offset") if c in checked.columns], "raw")).alias("value")
            )
            letters.write.mode("overwrite").text(f"{lake}/dead_letters/batch={batch_id}")
        finally:
            checked.unpersist()

    return run


def start(lines: DataFrame, lake: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Begin ingest of a streaming frame with a text column ``raw``."""
    counted = lines.observe("lines", F.count("*").alias("n"))
    writer = counted.writeStream.foreachBatch(_batch(lake)).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="2 seconds")
    return writer.start()


def folder_lines(spark: SparkSession, folder: str, files_per_batch: int | None = 200, bytes_per_batch: str | None = None) -> DataFrame:
    """Lines of new files of a folder; a batch takes so many files, or files of so many bytes (such as "64k") if that is given."""
    source = spark.readStream
    source = source.option("maxBytesPerTrigger", bytes_per_batch) if bytes_per_batch else source.option("maxFilesPerTrigger", files_per_batch)
    return source.text(folder).select(F.col("value").alias("raw"))


def topic_lines(spark: SparkSession, servers: str, topics: list[str], most: int = 200, delay: str = "2s") -> DataFrame:
    """Lines of Kafka topics; needs Spark's Kafka connector on the class path.

    A batch begins when ``most`` messages wait, or after ``delay``, and takes ``most`` at most.
    """
    source = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", ",".join(topics))
    source = source.option("minOffsetsPerTrigger", most).option("maxTriggerDelay", delay)
    rows = source.option("startingOffsets", "earliest").option("maxOffsetsPerTrigger", most).load()
    return rows.select(F.col("value").cast("string").alias("raw"), "topic", "partition", "offset")


def records(spark: SparkSession, lake: str, like: DataFrame) -> DataFrame:
    return _lake(spark, f"{lake}/records", like.schema)
