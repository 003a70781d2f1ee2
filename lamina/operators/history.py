"""History operators over a commit graph given as edges (child, parent, ord).

Closures run as frontier rounds: the new states of a round are joined to their parents and what was
seen before is taken out. Small graphs (a checked number of edges) take one grouped traversal per
repository instead, which needs no job per level. Linear chains use pointer doubling.
"""

from __future__ import annotations

import tempfile
from collections import deque

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Edges up to which one task may traverse a repository.
LOCAL_EDGES = 2_000_000
#: Edges up to which one task may look for a merge base: numbers in arrays, some 60 bytes an edge.
WALKED_EDGES = 10_000_000


def cut(df: DataFrame) -> DataFrame:
    """Write once to the reliable checkpoint folder and go on from there."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(context.getConf().get("spark.checkpoint.dir") or tempfile.mkdtemp(prefix="lamina-"))
    return df.checkpoint(eager=True)


def _walk(edges: pd.DataFrame, starts: list) -> list[tuple]:
    """(state, depth, visit) in breadth-first order; parents in the order of ``ord``."""
    parents: dict = {}
    for child, parent in edges.sort_values(["child", "ord", "parent"])[["child", "parent"]].itertuples(index=False):
        parents.setdefault(child, []).append(parent)
    depth = dict.fromkeys(starts, 0)
    queue = deque(depth)
    while queue:
        state = queue.popleft()
        for parent in parents.get(state, ()):
            if parent not in depth:
                depth[parent] = depth[state] + 1
                queue.append(parent)
    return [(state, d, i) for i, (state, d) in enumerate(depth.items())]


def closure(edges: DataFrame, tips: DataFrame, stop: DataFrame | None = None, local: int = LOCAL_EDGES) -> DataFrame:
    """state, depth, visit of all states reachable from ``tips`` (state), tips at depth 0.

    ``visit`` is the place in the breadth-first queue, on either way: by depth, then the place of the
    child that met the state first, then ``ord``, then id.

    ``stop`` (state): states that are neither returned nor walked through.
    """
    if stop is not None:
        gone = stop.select(F.col("state").alias("__stop"))
        edges = edges.join(gone, edges["parent"] == gone["__stop"], "left_anti")
        tips = tips.join(gone, tips["state"] == gone["__stop"], "left_anti")
    tips = tips.select("state").distinct()
    if edges.limit(local + 1).count() <= local:
        kind = tips.schema["state"].dataType.simpleString()
        rows = edges.select("child", "parent", F.col("ord").cast("int").alias("ord"))
        rows = rows.unionByName(tips.select(F.col("state").alias("child"), F.lit(None).cast(kind).alias("parent"), F.lit(-1).alias("ord")))

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            starts = sorted(pdf.loc[pdf["ord"] == -1, "child"].tolist())
            rest = pdf[pdf["ord"] >= 0]
            found = _walk(rest if kind == "string" else rest.astype({"parent": "int64"}), starts)
            return pd.DataFrame(found, columns=["state", "depth", "visit"])

        return rows.groupBy(F.lit("all").alias("repository")).applyInPandas(run, f"state {kind}, depth int, visit long").select("state", "depth", "visit")
    seen = _placed(tips.withColumn("depth", F.lit(0)), ["state"], 0)
    front, depth, n = seen, 0, seen.count()
    while True:
        depth += 1
        met = front.join(edges, front["state"] == edges["child"]).groupBy(F.col("parent").alias("state"))
        step = met.agg(F.min(F.struct("visit", F.col("ord").cast("int").alias("ord"))).alias("by")).withColumn("depth", F.lit(depth))
        front = _placed(step.join(seen.select("state"), "state", "left_anti"), ["by", "state"], n)
        size = front.count()
        if not size:
            return seen.select("state", "depth", "visit")
        n += size
        seen = cut(seen.unionByName(front))


def _placed(rows: DataFrame, order: list[str], first: int) -> DataFrame:
    """state, depth and visit: numbers from ``first`` on in the given order, which no single task needs to see."""
    row = F.monotonically_increasing_id()
    rows = cut(rows.orderBy(*order).select("state", "depth", row.alias("row")))
    part = F.shiftright("row", 33).alias("part")
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    begins = rows.groupBy(part).agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("begin"))
    at = F.col("row").bitwiseAND((1 << 33) - 1) + F.col("begin") + first
    return rows.withColumn("part", part).join(F.broadcast(begins), "part").select("state", "depth", at.alias("visit"))


def log(edges: DataFrame, start: DataFrame, limit: int) -> DataFrame:
    """The first ``limit`` states of a breadth-first walk, nearest first."""
    return closure(edges, start).orderBy("visit").limit(limit).select("state", "depth", "visit")


def merge_base(edges: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    """The common ancestor of least depth sum, then least id: state, distance.

    The edges are derived once. Up to ``WALKED_EDGES`` of them (with numbers for ids) one task walks both histories.
    """
    edges = cut(edges.select("child", "parent", "ord"))
    if edges.schema["child"].dataType.simpleString() == "bigint" and edges.count() <= WALKED_EDGES:
        return _meeting(edges, a, b)
    left, right = closure(edges, a), closure(edges, b)
    both = left.select("state", F.col("depth").alias("a")).join(right.select("state", F.col("depth").alias("b")), "state")
    return both.select("state", (F.col("a") + F.col("b")).alias("distance")).orderBy("distance", "state").limit(1)


def _meeting(edges: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    tips = [df.select(F.col("state").alias("child"), F.lit(None).cast("long").alias("parent"), F.lit(i).alias("side")) for i, df in enumerate((a, b))]
    rows = edges.select("child", "parent", F.lit(2).alias("side")).unionByName(tips[0]).unionByName(tips[1])

    def run(batches):
        found: list[list[np.ndarray]] = [[np.empty(0, np.int64)] for _ in range(4)]
        for batch in batches:
            side, child, parent = (batch.column(c).fill_null(0).to_numpy(zero_copy_only=False) for c in ("side", "child", "parent"))
            for to, made in zip(found, (child[side == 0], child[side == 1], child[side == 2], parent[side == 2]), strict=True):
                to.append(made)
        *starts, child, parent = (np.concatenate(f) for f in found)
        found.clear()
        states = np.unique(np.concatenate([child, parent, *starts]))
        child, parent, *starts = (np.searchsorted(states, x).astype(np.int32) for x in (child, parent, *starts))
        parent = parent[np.argsort(child, kind="stable")]
        begin = np.concatenate([[0], np.cumsum(np.bincount(child, minlength=len(states)))])
        near, far = (_depths(begin, parent, s) for s in starts)
        both = np.flatnonzero((near >= 0) & (far >= 0))
        if len(both):
            at = both[np.argmin(near[both] + far[both])]  # states ascend, so the first is that of least id
            yield pa.RecordBatch.from_arrays([pa.array(states[[at]]), pa.array((near + far)[[at]], pa.int32())], names=["state", "distance"])

    return rows.coalesce(1).mapInArrow(run, "state long, distance int")


def _depths(begin: np.ndarray, parent: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Least depth of each state, -1 where it isn't reached; the parents of ``k`` are at ``begin[k]`` up to ``begin[k + 1]``."""
    depth = np.full(len(begin) - 1, -1, np.int32)
    front, level = np.unique(starts), 0
    while len(front):
        depth[front] = level
        n = begin[front + 1] - begin[front]
        places = np.repeat(begin[front] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        front = np.unique(parent[places])
        front, level = front[depth[front] < 0], level + 1
    return depth


def first_parents(edges: DataFrame) -> DataFrame:
    return edges.where("ord = 0").select(F.col("child").alias("state"), "parent")


def linear_chain(edges: DataFrame, tips: DataFrame) -> DataFrame:
    """state, distance along first parents from each of ``tips``: (tip, state, distance).

    Pointer doubling: jumps of 1, 2, 4, ... are squared, and a chain of length n takes log2(n) joins.
    """
    jumps = cut(first_parents(edges).select(F.col("state").alias("from"), F.col("parent").alias("to")))
    chain = cut(tips.select(F.col("state").alias("tip"), "state", F.lit(0).cast("long").alias("distance")))
    length = 1
    while not jumps.isEmpty():
        more = chain.join(jumps, chain["state"] == jumps["from"]).select("tip", F.col("to").alias("state"), (F.col("distance") + length).alias("distance"))
        chain = cut(chain.unionByName(more))
        again = jumps.select(F.col("from").alias("mid"), F.col("to").alias("end"))
        jumps = cut(jumps.join(again, jumps["to"] == again["mid"]).select("from", F.col("end").alias("to")))
        length *= 2
    return chain


def ancestors_of(edges: DataFrame, start: DataFrame) -> DataFrame:
    """All ancestors with their depth, the start itself left out."""
    return closure(edges, start).where("depth > 0").select("state", "depth")


def is_ancestor(edges: DataFrame, tip: DataFrame, candidates: DataFrame) -> DataFrame:
    """Which candidates (state) lie in the tip's history, itself included."""
    seen = closure(edges, tip).select("state", F.lit(True).alias("found"))
    return candidates.join(seen, "state", "left").select("state", F.coalesce("found", F.lit(False)).alias("is_ancestor"))


def bisect_candidates(edges: DataFrame, good: DataFrame, bad: DataFrame) -> DataFrame:
    """state, step of the linear chain after ``good`` up to ``bad``, oldest first."""
    chain = linear_chain(edges, bad)
    at = good.select(F.col("state").alias("good")).join(chain, F.col("good") == F.col("state")).select("tip", F.col("distance").alias("stop"))
    kept = chain.join(at, "tip").where(F.col("distance") < F.col("stop"))
    return kept.select("state", (F.col("stop") - F.col("distance")).alias("step"))


def resolve_ref(refs: DataFrame, names: DataFrame) -> DataFrame:
    """name, state: of HEAD, full ids, heads, tags and remotes the first that a name stands for.

    ``refs``: kind (head, id, branch, tag, remote), name, state; HEAD is matched in any case.
    """
    rank = F.when(F.col("kind") == "head", 0).when(F.col("kind") == "id", 1).when(F.col("kind") == "branch", 2).when(F.col("kind") == "tag", 3).otherwise(4)
    keyed = refs.select(F.when(F.col("kind") == "head", F.upper("name")).otherwise(F.col("name")).alias("key"), "state", rank.alias("rank"))
    asked = names.select("name", F.explode(F.array_distinct(F.array(F.col("name"), F.upper("name")))).alias("key"))
    met = asked.join(keyed, "key").where((F.col("key") == F.col("name")) | (F.col("rank") == 0))
    return met.groupBy("name").agg(F.min_by("state", F.struct("rank", "state")).alias("state"))
