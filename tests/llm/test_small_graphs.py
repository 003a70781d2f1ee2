"""What the near-duplicate join does for small tables in many partitions."""

import random
import uuid

import pytest
from pyspark.sql import functions as F

from lamina.llm import common, jaccard_join


def least_of(edges):
    """The least node of the component of each node that is not the least itself."""
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root if find(x) != x}


def graph(seed):
    rng = random.Random(seed)
    chain = [(i, i + 1) for i in range(1000, 1090)]
    star = [(5, i) for i in range(2000, 2060)]
    loose = [(rng.randrange(3000, 3200), rng.randrange(3000, 3200)) for _ in range(110)]
    edges = [*chain, *star, *loose, (7, 7), (9, 8), (8, 9), (-4, 1 << 60)]
    rng.shuffle(edges)
    return edges


@pytest.mark.parametrize("held", [False, True])
@pytest.mark.parametrize("most", [jaccard_join.TASK_EDGES, 100, 0])
def test_components_in_one_task_and_in_rounds(spark, most, held):
    edges = graph(3)
    table = spark.createDataFrame(edges, "a long, b long").repartition(7)
    got = [tuple(r) for r in jaccard_join.components(table, most=most, held=held).select("node", "root").collect()]
    assert len(got) == len(set(got)) and dict(got) == least_of(edges)
    assert jaccard_join.components(table.limit(0), most=most, held=held).count() == 0


def jobs(spark, run):
    group = str(uuid.uuid4())
    spark.sparkContext.setJobGroup(group, group)
    try:
        run()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


def test_a_small_graph_needs_no_rounds(spark):
    table = spark.createDataFrame(graph(4), "a long, b long").repartition(7)
    few = jobs(spark, lambda: jaccard_join.components(table).collect())
    assert few <= 8


def test_small_parts_are_read_together(spark, monkeypatch):
    table = spark.range(1000).repartition(40).select("id", F.lit("x").alias("x"))
    small = common.gathered(table)
    assert small.rdd.getNumPartitions() == 1
    monkeypatch.setattr(common, "READ_BYTES", 1)
    large = common.gathered(table)
    assert large.rdd.getNumPartitions() == 40
    want = [(i, "x") for i in range(1000)]
    assert sorted(map(tuple, small.collect())) == sorted(map(tuple, large.collect())) == want


def test_one_row_of_a_class_is_kept(spark):
    """Also where texts of one doc_id are in it more than once, in several sets."""
    body = " ".join(f"w{i}" for i in range(200))
    rows = [(1, body), (1, body), (1, body + " end"), (2, body), (2, body + " end"), (3, "alone"), (4, ""), (None, body)]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    kept = [(r["doc_id"], r["class_id"], r["n_links"]) for r in jaccard_join.join(table).where("kept").collect()]
    assert sorted(kept, key=str) == sorted([(1, 1, 4), (3, 3, 0), (4, 4, 0), (None, None, 0)], key=str)
