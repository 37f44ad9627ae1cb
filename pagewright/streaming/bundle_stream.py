"""Bundles as they arrive: each is complete in itself, so the stream keeps no state and needs no watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pagewright.operators.nested import nested_nodes
from pagewright.plans.session import tables_of


def stream_bundles(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    """Files of structuredData as a stream with the columns of ``read_bundles``."""
    raw = spark.readStream.option("wholetext", True).option("maxFilesPerTrigger", files_per_trigger).option("pathGlobFilter", "*.json").text(path)
    name = F.input_file_name()
    return raw.select(F.xxhash64(name).alias("bundle_id"), F.xxhash64(name).alias("doc_id"), name.alias("filename"), F.lit("digital").alias("layer"), F.col("value").alias("payload"))


def stream_nodes(bundles: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Flatten each bundle and append its nodes as Parquet; exactly once through the stream's checkpoint."""
    nodes = nested_nodes(bundles, dedupe=False)
    return nodes.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_knowledge(bundles: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Run the whole analysis on each arriving batch of bundles."""
    from pagewright.api import analyze_bundles

    def each(batch: DataFrame, epoch: int) -> None:
        with tables_of(batch.sparkSession):
            analyze_bundles(batch).withColumn("epoch", F.lit(epoch)).write.mode("append").parquet(out)

    return bundles.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
