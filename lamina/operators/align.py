"""The alignment passes that are relational: nodes as rows (file, side, parent, pos, key).

``side`` is ``old`` or ``new``; passes return pairs (file, parent, old_pos, new_pos).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

_SCOPE = ("file", "parent")


def occurrence_index(nodes: DataFrame) -> DataFrame:
    """Place of each child among equal keys of its parent, and the same where there are several."""
    same = W.partitionBy("file", "side", "parent", "key")
    index = F.row_number().over(same.orderBy("pos")) - 1
    return nodes.withColumns({"occurrence": index, "duplicate": F.when(F.count("*").over(same) > 1, index)})


def _paired(nodes: DataFrame, *by: str) -> DataFrame:
    one = lambda side: F.max(F.when(F.col("side") == side, F.col("pos")))
    both = nodes.groupBy(*_SCOPE, *by).agg(one("old").alias("old_pos"), one("new").alias("new_pos"))
    return both.where("old_pos is not null and new_pos is not null")


def unique_pairs(nodes: DataFrame) -> DataFrame:
    """Pairs of children whose key is unique on both sides, in one aggregation."""
    count = lambda side: F.count(F.when(F.col("side") == side, 1))
    one = lambda side: F.max(F.when(F.col("side") == side, F.col("pos")))
    both = nodes.groupBy(*_SCOPE, "key").agg(count("old").alias("o"), count("new").alias("n"), one("old").alias("old_pos"), one("new").alias("new_pos"))
    return both.where("o = 1 and n = 1").select(*_SCOPE, "old_pos", "new_pos")


def in_order_pairs(nodes: DataFrame) -> DataFrame:
    """The k-th child of a key on one side with the k-th on the other."""
    numbered = nodes.withColumn("nth", F.row_number().over(W.partitionBy("file", "side", "parent", "key").orderBy("pos")))
    return _paired(numbered, "key", "nth").select(*_SCOPE, "old_pos", "new_pos")


def reordered(nodes: DataFrame) -> DataFrame:
    """Parents whose two child lists hold the same keys: ``equal`` or ``reordered``."""
    keys = lambda side: F.transform(F.array_sort(F.collect_list(F.when(F.col("side") == side, F.struct("pos", "key")))), lambda x: x["key"])
    lists = nodes.groupBy(*_SCOPE).agg(keys("old").alias("a"), keys("new").alias("b"))
    same = lists.where(F.array_sort("a") == F.array_sort("b"))
    return same.select(*_SCOPE, F.when(F.col("a") == F.col("b"), "equal").otherwise("reordered").alias("order"))


def wide(nodes: DataFrame, limit: int = 48) -> DataFrame:
    """Parents whose child lists' cross product is over the limit."""
    count = lambda side: F.count(F.when(F.col("side") == side, 1))
    return nodes.groupBy(*_SCOPE).agg((count("old") * count("new")).alias("cross")).where(F.col("cross") > limit)


def lines_added(lines: DataFrame) -> DataFrame:
    """file, text, n: lines that the new side has more often than the old one."""
    count = lambda side: F.count(F.when(F.col("side") == side, 1))
    both = lines.groupBy("file", "text").agg((count("new") - count("old")).alias("n"))
    return both.where("n > 0")


def changed_lines(lines: DataFrame) -> DataFrame:
    """file, line of new lines whose text the old side doesn't have at all."""
    old = lines.where("side = 'old'").select("file", "text").distinct()
    return lines.where("side = 'new'").join(old, ["file", "text"], "left_anti").select("file", "line")
