"""File-source ingest: each micro-batch of new publications is parsed, extracted and published by the store.

An extension: the batch path does the same work. A batch that is replayed after a failure finds
its snapshots stored and publishes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.plans.store import Store


def publication_stream(spark: SparkSession, path: str, max_files: int = 1000) -> DataFrame:
    """(rfc, raw, metadata_hash) of text files named rfc<number>.txt as they arrive."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("maxFilesPerTrigger", max_files).option("pathGlobFilter", "*.txt").load(path)
    number = F.regexp_extract("path", r"rfc(\d+)\.txt$", 1)
    return files.where(number != "").select(number.cast("long").alias("rfc"), F.col("content").alias("raw"), F.lit("").alias("metadata_hash"))


def start(spark: SparkSession, path: str, store: Store, checkpoint: str, once: bool = True):
    """The running query; with once=True it takes what is there and ends."""

    def publish(batch: DataFrame, _: int) -> None:
        kept = batch.persist()
        try:
            store.ingest(kept)
        finally:
            kept.unpersist()

    writer = publication_stream(spark, path).writeStream.option("checkpointLocation", checkpoint).foreachBatch(publish)
    return (writer.trigger(availableNow=True) if once else writer).start()
