"""Set operators on small tables, and every query with a SQL twin against DuckDB."""

import glob
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from lamina.functions import hashing, paths
from lamina.operators import history, integrity, intents, kernels, manifests, sync
from lamina.plans import registry


@pytest.fixture(scope="module")
def dag(spark):
    """root <- s1 <- (s2, s3) <- s4 (a merge), and a branch of its own."""
    edges = [(1, 0, 0), (2, 1, 0), (3, 1, 0), (4, 2, 0), (4, 3, 1), (9, 8, 0)]
    return spark.createDataFrame(edges, "child long, parent long, ord int")


def states(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "state long")


@pytest.mark.parametrize("local", [history.LOCAL_EDGES, 0])
def test_closures(spark, dag, local):
    got = {(r["state"], r["depth"]) for r in history.closure(dag, states(spark, 4), local=local).collect()}
    assert got == {(4, 0), (2, 1), (3, 1), (1, 2), (0, 3)}
    stopped = history.closure(dag, states(spark, 4), stop=states(spark, 1), local=local)
    assert {r["state"] for r in stopped.collect()} == {4, 2, 3}
    assert history.closure(dag, states(spark), local=local).count() == 0


def test_history(spark, dag):
    one = lambda df: [tuple(r) for r in df.collect()]
    assert one(history.log(dag, states(spark, 4), 3)) == [(4, 0, 0), (2, 1, 1), (3, 1, 2)]
    assert one(history.merge_base(dag, states(spark, 2), states(spark, 3))) == [(1, 2)]
    assert one(history.merge_base(dag, states(spark, 4), states(spark, 4))) == [(4, 0)]
    assert history.merge_base(dag, states(spark, 4), states(spark, 9)).count() == 0
    assert {(r["state"], r["distance"]) for r in history.linear_chain(dag, states(spark, 4)).collect()} == {(4, 0), (2, 1), (1, 2), (0, 3)}
    assert {(r["state"], r["step"]) for r in history.bisect_candidates(dag, states(spark, 1), states(spark, 4)).collect()} == {(2, 1), (4, 2)}
    assert {(r["state"], r["is_ancestor"]) for r in history.is_ancestor(dag, states(spark, 4), states(spark, 3, 9)).collect()} == {(3, True), (9, False)}


def test_sync(spark, dag):
    assert {r["state"] for r in sync.missing_states(dag, states(spark, 4), states(spark, 0, 1)).collect()} == {4, 2, 3}
    assert {r["state"] for r in sync.upload_set(dag, states(spark, 4), states(spark, 2)).collect()} == {4, 3, 1, 0}
    assert {r["state"] for r in sync.shallow_boundaries(dag, states(spark, 4, 2, 3)).collect()} == {2, 3}
    assert sync.fast_forward(dag, states(spark, 4), states(spark, 3)).first()[0]
    assert not sync.fast_forward(dag, states(spark, 3), states(spark, 4)).first()[0]


def side(spark, **files):
    return spark.createDataFrame([(p, *(v if isinstance(v, tuple) else (v, "regular"))) for p, v in files.items()], "path string, blob string, mode string")


def test_presence_matrix(spark):
    base = side(spark, a="1", b="1", c="1", d="1", e="1", f="1", g="1", h="1", i="1")
    left = side(spark, a="1", b="2", c="1", d="2", e="2", g="1", h="2", x="1", y="1", z="1")
    right = side(spark, a="1", b="1", c="2", d="2", e="3", f="1", i="2", x="1", y="2", w="1")
    got = {r["path"]: r["outcome"] for r in manifests.three_way(base, left, right).collect()}
    assert got == {
        "a": "unchanged", "b": "take_left", "c": "take_right", "d": "agree", "e": "content_merge", "f": "remove_left", "g": "remove_right",
        "h": "keep_left_modified", "i": "keep_right_modified", "x": "add_agree", "y": "add_add", "z": "keep_left_add", "w": "keep_right_add",
    }


def test_modes_and_kinds(spark):
    base = side(spark, a=("1", "regular"), b=("1", "regular"), c=("1", "regular"))
    left = side(spark, a=("1", "executable"), b=("1", "executable"), c=("1", "symlink"))
    right = side(spark, a=("1", "regular"), b=("1", "symlink"))
    got = {r["path"]: (r["outcome"], r["mode"]) for r in manifests.three_way(base, left, right).collect()}
    assert got == {"a": ("unchanged", "executable"), "b": ("kind_conflict", "conflict"), "c": ("remove_right", "symlink")}


def test_renames(spark):
    old, new = side(spark, a="1", b="1", c="2"), side(spark, x="1", y="1", z="1", c="2")
    assert {tuple(r)[:2] for r in manifests.exact_renames(old, new).collect()} == {("a", "x"), ("b", "y")}
    plan = manifests.plan_three_way(side(spark, a="1", b="5"), side(spark, l="1", b="5"), side(spark, r="1", b="6"))
    assert {r["path"]: r["outcome"] for r in plan.collect()} == {"a": "rename_conflict", "b": "take_right"}


def test_status_uses_the_effective_index(spark):
    head = side(spark, a="1", b="1", c="1")
    staging = spark.createDataFrame([("b", True, None, None), ("d", False, "9", "regular")], "path string, deleted boolean, blob string, mode string")
    tree = side(spark, a="2", c="1", d="9", e="1")
    got = {r["path"]: (r["staged"], r["unstaged"], r["untracked"]) for r in manifests.status(head, staging, tree).collect()}
    assert got == {"a": (None, "modified", False), "b": ("deleted", None, False), "d": ("added", None, False), "e": (None, None, True)}


def test_integrity(spark):
    blobs = spark.createDataFrame([("ab01", 1), ("ab02", 2), ("ac01", 3), ("ab01", 1)], "blob string, size long")
    assert {(r["blob"], r["base"]) for r in integrity.delta_bases(blobs).collect()} == {("ab01", None), ("ab02", "ab01"), ("ac01", None)}
    assert {tuple(r) for r in integrity.repack_sizes(blobs).collect()} == {("ab", 2, 3), ("ac", 1, 3)}


def test_scalar_functions(spark):
    row = spark.range(1).select(
        paths.query_parameters(F.lit("?a=1&b&=x&c=d=e&a=2")).alias("q"),
        paths.normalized(F.lit("a\\b/c")).alias("n"),
        paths.normalized(F.lit("a/../c")).alias("up"),
        paths.extension(F.lit("x/.bashrc")).alias("dot"),
        paths.extension(F.lit("x/a.tar.gz")).alias("gz"),
        paths.is_text_only(F.lit("x/Makefile")).alias("text"),
        paths.language(F.lit("x/go.mod")).alias("mod"),
        paths.bisect_steps(F.lit(0), F.lit(9)).alias("steps"),
        paths.size_text(F.lit(2560)).alias("size"),
        hashing.is_state_id(F.lit("0" * 64)).alias("id"),
        hashing.short_id(F.lit("0" * 64)).alias("short"),
    ).first()
    assert row["q"] == {"a": "2", "b": "", "c": "d=e"}
    assert (row["n"], row["up"], row["dot"], row["gz"], row["text"], row["mod"], row["steps"], row["size"], row["id"], len(row["short"])) == ("a/b/c", None, None, "gz", True, "gomod", 4, "2.5 KiB", True, 12)


def test_disjointness_is_symmetric(spark):
    names = sorted({a for a, _ in intents.ALWAYS_DISJOINT} | {"move_node", "delete_subtree"})
    pairs = spark.createDataFrame([(a, b, s) for a in names for b in names for s in (True, False)], "a string, b string, s boolean")
    one = pairs.withColumn("x", intents.disjoint(F.col("a"), F.col("b"), F.col("s"))).withColumn("y", intents.disjoint(F.col("b"), F.col("a"), F.col("s")))
    assert one.where("x <> y").count() == 0


def test_kernels_over_frames(spark):
    rows = spark.createDataFrame([("a.rs", "fn a() {}\n", "fn b() {}\n"), ("b.txt", "x\n", "y\n"), ("c.rs", "fn a() {}\n", "fn a() {}\n")], "path string, old string, new string")
    assert [(r["path"], r["intent"]) for r in kernels.structural_diff(rows).collect()] == [("a.rs", "rename_identifier")]
    assert sorted((r["path"], r["op"]) for r in kernels.text_diff(rows).collect()) == [("a.rs", "delete"), ("a.rs", "insert"), ("b.txt", "delete"), ("b.txt", "insert")]
    assert {r["path"] for r in kernels.syntax_nodes(rows.select("path", F.col("old").alias("text"))).collect()} == {"a.rs", "c.rs"}
    again = rows.unionByName(rows.withColumn("path", F.concat(F.lit("z"), "path")))
    assert {r["path"] for r in kernels.once(again, ("old", "new"), kernels.text_diff, "op").collect()} == {"a.rs", "b.txt", "za.rs", "zb.txt"}


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_its_sql(spark, data, name):
    base = duckdb.connect()
    for file in glob.glob(f"{data}/*.parquet"):
        base.sql(f"CREATE VIEW {os.path.basename(file)[:-8]} AS SELECT * FROM '{file}'")
    df, want = registry.QUERIES[name](spark, data), base.sql(registry.ORACLES[name])
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    rows = want.select(*[f'"{c}"' for c in columns]).fetchall()
    assert sorted(map(repr, map(tuple, df.select(*columns).collect()))) == sorted(map(repr, rows))


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_query_runs(spark, data, name):
    assert registry.QUERIES[name](spark, data).count() > 0
