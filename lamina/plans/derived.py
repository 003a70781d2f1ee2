"""Repositories derived from the supplied tables by expressions that SQL can evaluate as well.

Documents become three sides of a merge and a working tree, events a commit graph with branch
tips, line items the manifests of states. The strings are the same definitions in DuckDB SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lamina.functions.hashing import text_hash

SIDES = ("base", "left", "right")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _path(prefix: Column) -> Column:
    return F.concat(prefix, F.col("source"), F.lit("/"), F.col("doc_id"), F.lit("."), F.col("lang"))


def _suffixed(*rules: tuple[int, str]) -> Column:
    text = F.coalesce(F.col("text"), F.lit(""))
    out = text
    for modulus, suffix in reversed(rules):
        out = F.when(F.col("doc_id") % modulus == 0, F.concat(text, F.lit(suffix))).otherwise(out)
    return out


def _mode(extra: Column | None = None) -> Column:
    mode = F.when(F.col("doc_id") % 23 == 0, "executable").otherwise("regular")
    return mode if extra is None else F.when(extra, F.when(mode == "regular", "executable").otherwise("regular")).otherwise(mode)


def manifest(spark: SparkSession, sf_dir: str, side: str, texts: bool = False) -> DataFrame:
    """path, blob, mode (and text) of one side."""
    docs = read(spark, sf_dir, "documents")
    by = F.col("doc_id")
    if side == "base":
        kept, text, prefix, mode = docs, _suffixed(), F.lit(""), _mode()
    elif side == "left":
        kept, text = docs.where(by % 11 != 0), _suffixed((7, "L"))
        prefix, mode = F.when(by % 17 == 0, "moved/").otherwise(""), _mode(by % 37 == 0)
    else:
        kept, text = docs.where(by % 13 != 0), _suffixed((70, "L"), (5, "R"))
        prefix, mode = F.when(by % 51 == 0, "other/").when(by % 34 == 0, "moved/").otherwise(""), F.when(by % 41 == 0, "symlink").otherwise(_mode(by % 74 == 0))
    own = [_path(prefix).alias("path"), text_hash(text).alias("blob"), mode.alias("mode")]
    return kept.select(*own, *[text.alias("text")] * texts)


_TEXT = "coalesce(text, '')"
_MODE = "CASE WHEN doc_id % 23 = 0 THEN 'executable' ELSE 'regular' END"
_FLIP = "CASE WHEN doc_id % 23 = 0 THEN 'regular' ELSE 'executable' END"


def _side_sql(prefix: str, text: str, mode: str, where: str) -> str:
    return f"SELECT {prefix} || source || '/' || doc_id || '.' || lang AS path, sha256({text}) AS blob, {mode} AS mode FROM documents WHERE {where}"


MANIFESTS_SQL = {
    "base": _side_sql("''", _TEXT, _MODE, "true"),
    "left": _side_sql("CASE WHEN doc_id % 17 = 0 THEN 'moved/' ELSE '' END", f"CASE WHEN doc_id % 7 = 0 THEN {_TEXT} || 'L' ELSE {_TEXT} END", f"CASE WHEN doc_id % 37 = 0 THEN {_FLIP} ELSE {_MODE} END", "doc_id % 11 <> 0"),
    "right": _side_sql(
        "CASE WHEN doc_id % 51 = 0 THEN 'other/' WHEN doc_id % 34 = 0 THEN 'moved/' ELSE '' END",
        f"CASE WHEN doc_id % 70 = 0 THEN {_TEXT} || 'L' WHEN doc_id % 5 = 0 THEN {_TEXT} || 'R' ELSE {_TEXT} END",
        f"CASE WHEN doc_id % 41 = 0 THEN 'symlink' WHEN doc_id % 74 = 0 THEN {_FLIP} ELSE {_MODE} END",
        "doc_id % 13 <> 0",
    ),
}
SIDES_SQL = ", ".join(f"{k} AS ({v})" for k, v in MANIFESTS_SQL.items())


def staging(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Staging overlay: path, deleted, blob, mode."""
    docs, by = read(spark, sf_dir, "documents"), F.col("doc_id")
    deleted = by % 9 == 0
    prefix = F.when(by % 50 == 7, "new/").otherwise("")
    text = _suffixed((1, "S"))
    rows = docs.where(deleted | (by % 10 == 1) | (by % 50 == 7))
    return rows.select(_path(prefix).alias("path"), deleted.alias("deleted"), F.when(~deleted, text_hash(text)).alias("blob"), F.when(~deleted, _mode()).alias("mode"))


STAGING_SQL = f"""SELECT CASE WHEN doc_id % 50 = 7 THEN 'new/' ELSE '' END || source || '/' || doc_id || '.' || lang AS path, doc_id % 9 = 0 AS deleted,
    CASE WHEN doc_id % 9 <> 0 THEN sha256({_TEXT} || 'S') END AS blob, CASE WHEN doc_id % 9 <> 0 THEN {_MODE} END AS mode
    FROM documents WHERE doc_id % 9 = 0 OR doc_id % 10 = 1 OR doc_id % 50 = 7"""


def working(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Working tree: path, blob, mode; some files gone, some changed, some never tracked."""
    docs, by = read(spark, sf_dir, "documents"), F.col("doc_id")
    prefix = F.when(by % 40 == 3, "tmp/").otherwise("")
    return docs.where(by % 8 != 0).select(_path(prefix).alias("path"), text_hash(_suffixed((12, "W"))).alias("blob"), _mode().alias("mode"))


WORKING_SQL = f"""SELECT CASE WHEN doc_id % 40 = 3 THEN 'tmp/' ELSE '' END || source || '/' || doc_id || '.' || lang AS path,
    sha256(CASE WHEN doc_id % 12 = 0 THEN {_TEXT} || 'W' ELSE {_TEXT} END) AS blob, {_MODE} AS mode FROM documents WHERE doc_id % 8 <> 0"""


def commit_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """child, parent, ord: the event before of the same user, and for purchases the next user's last one.

    The as-of lookup is one window over both kinds of rows, so no event meets all of another user's.
    """
    events = read(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    users = events.agg((F.max("user_id") + 1).alias("n"))
    order = W.partitionBy("user_id").orderBy("ts", "event_id")
    first = events.withColumn("parent", F.lag("event_id").over(order)).where("parent is not null").select(F.col("event_id").alias("child"), "parent", F.lit(0).alias("ord"))
    asks = events.where("event_type = 'purchase'").crossJoin(F.broadcast(users))  # one row
    asks = asks.select(((F.col("user_id") + 1) % F.col("n")).alias("user_id"), "ts", F.lit(0).alias("kind"), F.col("event_id").alias("asking"), F.lit(None).cast("long").alias("seen"))
    both = asks.unionByName(events.select("user_id", "ts", F.lit(1).alias("kind"), F.lit(None).cast("long").alias("asking"), F.col("event_id").alias("seen")))
    before = W.partitionBy("user_id").orderBy("ts", "kind", "seen").rowsBetween(W.unboundedPreceding, -1)
    second = both.withColumn("parent", F.last("seen", ignorenulls=True).over(before)).where("asking is not null and parent is not null")
    return first.unionByName(second.select(F.col("asking").alias("child"), "parent", F.lit(1).alias("ord"))).dropDuplicates(["child", "parent"])


EDGES_SQL = """edges AS (SELECT child, parent, min(ord) AS ord FROM (
    SELECT event_id AS child, lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS parent, 0 AS ord FROM events
    UNION ALL
    SELECT child, parent, 1 FROM (
        SELECT a.event_id AS child, b.event_id AS parent, row_number() OVER (PARTITION BY a.event_id ORDER BY b.ts DESC, b.event_id DESC) AS n
        FROM events a JOIN events b ON b.user_id = (a.user_id + 1) % (SELECT max(user_id) + 1 FROM events) AND b.ts < a.ts WHERE a.event_type = 'purchase')
    WHERE n = 1) WHERE parent IS NOT NULL GROUP BY child, parent)"""


def branches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """name, state: each user's last event is a branch tip; users ending in 3 have lost theirs."""
    events = read(spark, sf_dir, "events").where("user_id % 10 <> 3")
    last = events.groupBy("user_id").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("state"))
    return last.select(F.concat(F.lit("u"), "user_id").alias("name"), "state")


BRANCHES_SQL = "branches AS (SELECT 'u' || user_id AS name, event_id AS state FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events WHERE user_id % 10 <> 3) WHERE n = 1)"


def state_blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """state, path, blob, size: an order is a state, its lines are the files."""
    lines = read(spark, sf_dir, "lineitem")
    cents = lambda c: F.round(F.col(c) * 100).cast("long").cast("string")
    body = F.concat_ws("|", F.col("l_partkey"), F.col("l_suppkey"), cents("l_quantity"), cents("l_extendedprice"))
    return lines.select(F.col("l_orderkey").alias("state"), F.col("l_linenumber").cast("string").alias("path"), text_hash(body).alias("blob"), F.length(body).cast("long").alias("size"))


BLOBS_SQL = """blobs AS (SELECT state, path, sha256(body) AS blob, length(body)::BIGINT AS size FROM (SELECT l_orderkey AS state, l_linenumber::VARCHAR AS path,
    concat_ws('|', l_partkey, l_suppkey, round(l_quantity * 100)::BIGINT, round(l_extendedprice * 100)::BIGINT) AS body FROM lineitem))"""
