"""Incremental counts of terms as new document files arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concord.functions import text as T


def term_stream(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """Running term counts over a folder of Parquet files with a ``text`` column."""
    docs = spark.readStream.schema(schema).parquet(folder)
    return docs.select(F.explode(T.stats_tokens(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("n"))


def start(counts: DataFrame, name: str, checkpoint: str):
    return counts.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
