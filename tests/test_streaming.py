from pyspark.sql import functions as F

from lamina.streaming import commit_feed


def test_tips_of_a_feed(spark, tmp_path):
    rows = [("a", 1, "2024-01-01 00:00:00"), ("a", 2, "2024-01-01 02:00:00"), ("b", 3, "2024-01-01 02:00:00"), ("b", 4, "2024-01-01 02:00:00")]
    feed = spark.createDataFrame(rows, "branch string, state long, ts string").withColumn("ts", F.to_timestamp("ts"))
    for row in range(2):
        feed.where(F.col("state") % 2 == row).write.mode("append").parquet(str(tmp_path / "feed"))
    stream = commit_feed.read(spark, str(tmp_path / "feed"), files_per_batch=1)
    commit_feed.keep(commit_feed.tips(stream), "tips", "complete", str(tmp_path / "c1"))
    assert {(r["branch"], r["state"]) for r in spark.table("tips").collect()} == {("a", 2), ("b", 4)}
    commit_feed.keep(commit_feed.activity(stream), "activity", "update", str(tmp_path / "c2"))
    latest = spark.table("activity").groupBy("start", "branch").agg(F.max("commits").alias("n")).collect()
    assert {(r["branch"], r["start"].hour, r["n"]) for r in latest} == {("a", 0, 1), ("a", 2, 1), ("b", 2, 2)}
