"""Listings for people: path specs and diffs of states."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.operators import manifests


def matching(paths: DataFrame, specs: list[str]) -> DataFrame:
    """Rows whose path is one of the specs or lies in one of their folders; ``.`` and none take all."""
    specs = [s.rstrip("/") for s in specs if s not in (".", "")]
    if not specs:
        return paths
    test = F.lit(False)
    for spec in specs:
        test = test | (F.col("path") == spec) | F.col("path").startswith(spec + "/")
    return paths.where(test)


def targets(status: DataFrame, specs: list[str], update: bool = False, everything: bool = False) -> DataFrame:
    """Paths that an add takes from a status: ``update`` leaves untracked ones out, ``everything`` needs no specs.

    Of a renamed file the old path goes with the new one.
    """
    rows = status.where("unstaged is not null" + ("" if update else " or untracked"))
    rows = rows if everything or (update and not specs) else matching(rows, specs)
    left = rows.where("unstaged_from is not null").select(F.col("unstaged_from").alias("path"), F.lit(True).alias("deleted"))
    return rows.select("path", F.coalesce(F.col("unstaged") == "deleted", F.lit(False)).alias("deleted")).unionByName(left)


def state_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Renames (seq 0) and other changes (seq 1): seq, change, path, to_path; whoever shows them sorts by seq and path."""
    moved = manifests.exact_renames(old, new)
    changed = manifests.diff(old, new)
    gone = moved.select(F.col("from_path").alias("path")).unionByName(moved.select(F.col("to_path").alias("path")))
    rest = changed.join(gone, "path", "left_anti").select(F.lit(1).alias("seq"), "change", "path", F.lit(None).cast("string").alias("to_path"))
    return moved.select(F.lit(0).alias("seq"), F.lit("renamed").alias("change"), F.col("from_path").alias("path"), "to_path").unionByName(rest)


def three_way_listing(base: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """Paths that any side changed, with what each side did to them."""
    rows = manifests.stacked({"b": base, "l": left, "r": right})
    did = lambda s: F.when(F.col("b_blob").isNull() & F.col(f"{s}_blob").isNotNull(), "added").when(F.col("b_blob").isNotNull() & F.col(f"{s}_blob").isNull(), "removed").when((F.col("b_blob") != F.col(f"{s}_blob")) | (F.col("b_mode") != F.col(f"{s}_mode")), "modified")
    return rows.select("path", did("l").alias("left"), did("r").alias("right")).where("left is not null or right is not null")
