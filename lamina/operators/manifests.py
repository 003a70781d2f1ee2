"""Manifest operators: diff, exact renames, three-way planning, resolutions, status.

Sides are stacked and folded by path in one aggregation, so any number of manifests meets in a
single shuffle; contents are never read where blob ids decide.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lamina.operators.history import cut


def stacked(sides: dict[str, DataFrame], key: str = "path", columns: tuple[str, ...] = ("blob", "mode")) -> DataFrame:
    """One row a path with each side's columns as ``<side>_<column>``; null where a side lacks the path."""
    rows = None
    for name, side in sides.items():
        one = side.select(key, F.lit(name).alias("__side"), F.struct(*columns).alias("__entry"))
        rows = one if rows is None else rows.unionByName(one)
    entry = {name: F.first(F.when(F.col("__side") == name, F.col("__entry")), ignorenulls=True).alias(f"__{name}") for name in sides}
    folded = rows.groupBy(key).agg(*entry.values())
    return folded.select(key, *[F.col(f"__{n}")[c].alias(f"{n}_{c}") for n in sides for c in columns])


def diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Changed paths only: path, change (added, removed, modified, mode), both blobs."""
    both = stacked({"old": old, "new": new})
    change = (
        F.when(F.col("old_blob").isNull(), "added")
        .when(F.col("new_blob").isNull(), "removed")
        .when(F.col("old_blob") != F.col("new_blob"), "modified")
        .when(F.col("old_mode") != F.col("new_mode"), "mode")
    )
    return both.withColumn("change", change).where("change is not null").select("path", "change", "old_blob", "new_blob")


def _ranked(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """``rows`` with ``nth``, their place (from 1) among those of equal keys, however many these are.

    Rows are sorted over all tasks; a task numbers what it has, and what earlier tasks have of a key is added.
    """
    sorted_ = cut(rows.repartitionByRange(*keys, order).sortWithinPartitions(*keys, order).withColumn("row", F.monotonically_increasing_id()))
    part = F.shiftright("row", 33)
    runs = sorted_.groupBy(*keys, part.alias("part")).agg(F.min("row").alias("begin"), F.count("*").alias("n"))
    before = W.partitionBy(*keys).orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    runs = runs.select(*keys, "part", "begin", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"))
    return sorted_.withColumn("part", part).join(runs, [*keys, "part"]).withColumn("nth", F.col("row") - F.col("begin") + F.col("earlier") + 1).drop("row", "part", "begin", "earlier")


def exact_renames(old: DataFrame, new: DataFrame) -> DataFrame:
    """from_path, to_path, blob: removed and added paths of equal content, paired in path order.

    The pairing is what a greedy walk of sorted removed paths over sorted added ones gives. A blob that
    comes and goes once is paired by aggregation; only others, such as empty files, are ranked.
    """
    changed = diff(old, new).where("change in ('added', 'removed')").withColumn("blob", F.coalesce("old_blob", "new_blob"))
    gone, come = (F.when(F.col("change") == c, F.col("path")) for c in ("removed", "added"))
    times = changed.groupBy("blob").agg(F.count(gone).alias("a"), F.count(come).alias("b"), F.max(gone).alias("from_path"), F.max(come).alias("to_path")).where("a > 0 and b > 0")
    once = times.where("a = 1 and b = 1").select("from_path", "to_path", "blob")
    many = times.where("a > 1 or b > 1").select("blob")
    both = _ranked(changed.join(many, "blob", "left_semi").select("blob", "change", "path"), ["blob", "change"], "path")
    sides = both.groupBy("blob", "nth").agg(F.max(gone).alias("from_path"), F.max(come).alias("to_path"))
    return once.unionByName(sides.where("from_path is not null and to_path is not null").select("from_path", "to_path", "blob"))


def presence(b: Column, left: Column, right: Column) -> Column:
    """Outcome of a path by which sides have it and whether their blobs differ."""
    return (
        F.when(b.isNull() & left.isNotNull() & right.isNotNull(), F.when(left == right, "add_agree").otherwise("add_add"))
        .when(b.isNull() & left.isNotNull(), "keep_left_add")
        .when(b.isNull(), "keep_right_add")
        .when(left.isNull() & right.isNull(), "remove_both")
        .when(right.isNull(), F.when(left == b, "remove_right").otherwise("keep_left_modified"))
        .when(left.isNull(), F.when(right == b, "remove_left").otherwise("keep_right_modified"))
        .when((left == b) & (right == b), "unchanged")
        .when(left == right, "agree")
        .when(right == b, "take_left")
        .when(left == b, "take_right")
        .otherwise("content_merge")
    )


PRESENCE_SQL = """CASE WHEN b_blob IS NULL AND l_blob IS NOT NULL AND r_blob IS NOT NULL THEN CASE WHEN l_blob = r_blob THEN 'add_agree' ELSE 'add_add' END
    WHEN b_blob IS NULL AND l_blob IS NOT NULL THEN 'keep_left_add' WHEN b_blob IS NULL THEN 'keep_right_add'
    WHEN l_blob IS NULL AND r_blob IS NULL THEN 'remove_both'
    WHEN r_blob IS NULL THEN CASE WHEN l_blob = b_blob THEN 'remove_right' ELSE 'keep_left_modified' END
    WHEN l_blob IS NULL THEN CASE WHEN r_blob = b_blob THEN 'remove_left' ELSE 'keep_right_modified' END
    WHEN l_blob = b_blob AND r_blob = b_blob THEN 'unchanged' WHEN l_blob = r_blob THEN 'agree'
    WHEN r_blob = b_blob THEN 'take_left' WHEN l_blob = b_blob THEN 'take_right' ELSE 'content_merge' END"""


def merged_mode(b: Column, left: Column, right: Column) -> Column:
    """Three-way mode; ``conflict`` where both sides changed it differently."""
    return (
        F.when(left.isNull() & right.isNull(), "regular")
        .when(right.isNull(), left)
        .when(left.isNull(), right)
        .when(left == right, left)
        .when(~left.eqNullSafe(b) & ~right.eqNullSafe(b), "conflict")
        .when(~right.eqNullSafe(b), right)
        .otherwise(left)
    )


MODE_SQL = """CASE WHEN l_mode IS NULL AND r_mode IS NULL THEN 'regular' WHEN r_mode IS NULL THEN l_mode WHEN l_mode IS NULL THEN r_mode WHEN l_mode = r_mode THEN l_mode
    WHEN l_mode IS DISTINCT FROM b_mode AND r_mode IS DISTINCT FROM b_mode THEN 'conflict' WHEN r_mode IS DISTINCT FROM b_mode THEN r_mode ELSE l_mode END"""


def kind_conflict(left: Column, right: Column) -> Column:
    """A symlink against another kind; sides that are absent don't conflict."""
    return left.isNotNull() & right.isNotNull() & ((left == "symlink") != (right == "symlink"))


#: Outcomes that keep the left side's, then the right side's content.
LEFT = ("unchanged", "agree", "take_left", "keep_left_add", "keep_left_modified", "add_agree")
RIGHT = ("take_right", "keep_right_add", "keep_right_modified")


def three_way(base: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """path, the sides' blobs and modes, outcome, the blob kept (null: merge, conflict or gone) and its mode."""
    rows = stacked({"b": base, "l": left, "r": right})
    outcome = presence(F.col("b_blob"), F.col("l_blob"), F.col("r_blob"))
    rows = rows.withColumn("outcome", F.when(kind_conflict(F.col("l_mode"), F.col("r_mode")), "kind_conflict").otherwise(outcome))
    blob = F.when(F.col("outcome").isin(*LEFT), F.col("l_blob")).when(F.col("outcome").isin(*RIGHT), F.col("r_blob"))
    return rows.withColumns({"blob": blob, "mode": merged_mode(F.col("b_mode"), F.col("l_mode"), F.col("r_mode"))})


def plan_three_way(base: DataFrame, left: DataFrame, right: DataFrame, renames=exact_renames) -> DataFrame:
    """Three-way plan with renames followed: ``path`` is the base's (or an added) path, ``target`` where the result goes.

    ``renames(old, new)`` gives from_path and to_path; blob ids alone show the exact ones. Paths that both sides renamed to different places are ``rename_conflict``.
    """
    moves = {}
    for name, side in (("l", left), ("r", right)):
        moves[name] = renames(base, side).select(F.col("from_path"), F.col("to_path"))
    back = {}
    for name, side in (("l", left), ("r", right)):
        named = side.join(moves[name], side["path"] == moves[name]["to_path"], "left")
        back[name] = named.select(F.coalesce("from_path", "path").alias("path"), "blob", "mode", "to_path")
    rows = stacked({"b": base.withColumn("to_path", F.lit(None).cast("string")), **back}, columns=("blob", "mode", "to_path"))
    outcome = presence(F.col("b_blob"), F.col("l_blob"), F.col("r_blob"))
    split = F.col("l_to_path").isNotNull() & F.col("r_to_path").isNotNull() & (F.col("l_to_path") != F.col("r_to_path"))
    rows = rows.withColumn("outcome", F.when(split, "rename_conflict").when(kind_conflict(F.col("l_mode"), F.col("r_mode")), "kind_conflict").otherwise(outcome))
    return rows.select("path", F.coalesce("l_to_path", "r_to_path", "path").alias("target"), "outcome", "b_blob", "l_blob", "r_blob", merged_mode(F.col("b_mode"), F.col("l_mode"), F.col("r_mode")).alias("mode"))


def resolve(plan: DataFrame, resolutions: DataFrame) -> DataFrame:
    """A three-way plan with conflicts settled by (path, choice), choice ``ours`` or ``theirs``."""
    open_ = F.col("outcome").isin("content_merge", "add_add", "kind_conflict")
    chosen = F.when(F.col("choice") == "ours", F.col("l_blob")).when(F.col("choice") == "theirs", F.col("r_blob"))
    joined = plan.join(resolutions.select("path", "choice"), "path", "left")
    return joined.select("path", F.when(open_ & F.col("choice").isNotNull(), F.concat(F.lit("resolved_"), F.col("choice"))).otherwise(F.col("outcome")).alias("outcome"), F.when(open_, chosen).otherwise(F.col("blob")).alias("blob"))


def effective(head: DataFrame, staging: DataFrame) -> DataFrame:
    """HEAD with the staging overlay applied: staged entries win, tombstones remove."""
    rows = stacked({"h": head.withColumn("deleted", F.lit(False)), "s": staging}, columns=("blob", "mode", "deleted"))
    kept = rows.where(~F.coalesce("s_deleted", F.lit(False)))
    return kept.select("path", F.coalesce("s_blob", "h_blob").alias("blob"), F.coalesce("s_mode", "h_mode").alias("mode"))


def _compared(a: str, b: str) -> Column:
    old, new = F.col(f"{a}_blob"), F.col(f"{b}_blob")
    changed = (old != new) | (F.col(f"{a}_mode") != F.col(f"{b}_mode"))
    return F.when(old.isNull() & new.isNotNull(), "added").when(old.isNotNull() & new.isNull(), "deleted").when(changed, "modified")


def status(head: DataFrame, staging: DataFrame, tree: DataFrame) -> DataFrame:
    """path, staged, unstaged, untracked of all paths that aren't clean; one fold over three inputs."""
    rows = stacked({"h": head.withColumn("deleted", F.lit(False)), "s": staging, "w": tree.withColumn("deleted", F.lit(False))}, columns=("blob", "mode", "deleted"))
    gone = F.coalesce("s_deleted", F.lit(False))
    rows = rows.withColumns({"e_blob": F.when(~gone, F.coalesce("s_blob", "h_blob")), "e_mode": F.when(~gone, F.coalesce("s_mode", "h_mode"))})
    untracked = F.col("e_blob").isNull() & F.col("w_blob").isNotNull()
    rows = rows.select("path", _compared("h", "e").alias("staged"), F.when(~untracked, _compared("e", "w")).alias("unstaged"), untracked.alias("untracked"))
    return rows.where("staged is not null or unstaged is not null or untracked")


def status_with_renames(head: DataFrame, staging: DataFrame, tree: DataFrame, renames=exact_renames) -> DataFrame:
    """path, staged, unstaged, staged_from, unstaged_from, untracked: ``status`` with renames folded.

    A staged rename shows at its new path; the old one no longer counts as staged. A rename in the tree
    is no deletion and no untracked file: it shows at the new path alone.
    """
    index = effective(head, staging)
    staged = renames(head, index).select(F.col("from_path").alias("sf"), F.col("to_path").alias("st"))
    moved = renames(index, tree).select(F.col("from_path").alias("wf"), F.col("to_path").alias("wt"))
    rows = status(head, staging, tree).join(moved.select("wf"), F.col("path") == F.col("wf"), "left_anti")
    rows = rows.join(staged.select(F.col("sf").alias("left")), F.col("path") == F.col("left"), "left")
    rows = rows.join(staged, F.col("path") == F.col("st"), "left").join(moved, F.col("path") == F.col("wt"), "left")
    rows = rows.select(
        "path",
        F.when(F.col("left").isNull(), F.col("staged")).alias("staged"),
        F.when(F.col("wf").isNotNull(), "added").otherwise(F.col("unstaged")).alias("unstaged"),
        F.col("sf").alias("staged_from"),
        F.col("wf").alias("unstaged_from"),
        (F.col("untracked") & F.col("wf").isNull()).alias("untracked"),
    )
    return rows.where("staged is not null or unstaged is not null or untracked")


def unchanged(a: DataFrame, b: DataFrame, keys: tuple[str, ...] = ("state",)) -> DataFrame:
    """Keys with whether both manifests' ids are equal."""
    return a.select(*keys, F.col("manifest").alias("a")).join(b.select(*keys, F.col("manifest").alias("b")), list(keys), "full_outer").select(*keys, F.col("a").eqNullSafe(F.col("b")).alias("unchanged"))
