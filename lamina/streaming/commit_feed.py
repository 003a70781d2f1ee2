"""Branch tips and commit counts of an append-only feed, kept up to date by Structured Streaming.

The feed has rows (branch, state, ts). Tips are an aggregation in update mode; activity counts per
window close when the watermark passes, so late rows within it still count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FEED = "branch string, state long, ts timestamp"


def read(spark: SparkSession, path: str, schema: str = FEED, files_per_batch: int = 100) -> DataFrame:
    """A feed of Parquet files as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def tips(feed: DataFrame) -> DataFrame:
    """branch, state, ts of each branch's newest commit; ties in time go to the greater id."""
    return feed.groupBy("branch").agg(F.max_by("state", F.struct("ts", "state")).alias("state"), F.max("ts").alias("ts"))


def activity(feed: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """start, branch, commits per window; rows later than the watermark are dropped."""
    counted = feed.withWatermark("ts", late).groupBy(F.window("ts", window), "branch").agg(F.count("*").alias("commits"))
    return counted.select(F.col("window.start").alias("start"), "branch", "commits")


def keep(df: DataFrame, name: str, mode: str, checkpoint: str):
    """Run a stream into a table in memory until what is there is worked off."""
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
