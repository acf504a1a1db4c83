"""Streaming ingestion of evidence (an extension; the batch operators need none of it).

New files of activities are taken up once each; a checkpoint in the caller's folder remembers which, so a rerun goes on
where the last one ended. Each batch is aggregated by itself and appended; best_of() merges the batches' rows when they
are read, as maxima, counts of sets and flags can be merged in any order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

SCHEMA = "compound string, target string, document string, relation string, pchembl double, year int, inactive boolean"


def partial(batch: DataFrame) -> DataFrame:
    p = F.when(~F.coalesce("inactive", F.lit(False)), F.col("pchembl"))
    return batch.where("compound IS NOT NULL AND target IS NOT NULL").groupBy("compound", "target").agg(
        F.max(p).alias("pchembl"), F.max_by("relation", F.when(p.isNotNull(), F.struct(p, "document"))).alias("relation"),
        F.bool_or("inactive").alias("inactive"), F.collect_set("document").alias("documents"), F.min("year").alias("year"),
    )


def ingest(spark: SparkSession, incoming: str, out: str, checkpoint: str) -> StreamingQuery:
    """Take up all files that have not been, then stop."""
    stream = spark.readStream.schema(SCHEMA).option("mode", "DROPMALFORMED").json(incoming)

    def add(batch: DataFrame, number: int) -> None:
        partial(batch).withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def best_of(spark: SparkSession, out: str) -> DataFrame:
    t = spark.read.parquet(out)
    return t.groupBy("compound", "target").agg(
        F.max("pchembl").alias("pchembl"), F.max_by("relation", F.when(F.col("pchembl").isNotNull(), F.struct("pchembl", "batch"))).alias("relation"),
        F.bool_or("inactive").alias("inactive"), F.size(F.array_distinct(F.flatten(F.collect_list("documents")))).alias("n_documents"), F.min("year").alias("year"),
    )
