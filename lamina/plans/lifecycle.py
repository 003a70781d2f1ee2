"""Queries that take whole repositories through their verbs; what SQL expects follows from how the sides are made.

Every document is a file. ``left`` adds an end to the last line of some, ``right`` a first line to others and
drops some, so a line merge has one outcome for each. Stores are temporary folders of this machine: these
queries check the verbs, they are no way to hold a large repository.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.plans import derived as d
from lamina.repo import MergeConflict, Repo

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

_PATH = "source || '/' || doc_id || '.txt'"
_FILES = "files AS (SELECT " + _PATH + " AS path, doc_id, coalesce(text, '') AS t FROM documents)"
#: Texts of each side; null where the side lacks the file.
_SIDES = {
    "base": "t",
    "left": "CASE WHEN doc_id % 7 = 0 THEN t || 'L' ELSE t END",
    "right": "CASE WHEN doc_id % 13 = 0 THEN NULL WHEN doc_id % 5 = 0 THEN 'R' || chr(10) || t ELSE t END",
    "merged": "CASE WHEN doc_id % 13 = 0 AND doc_id % 7 <> 0 THEN NULL WHEN doc_id % 35 = 0 AND doc_id % 13 <> 0 AND t = '' THEN 'L' ELSE CASE WHEN doc_id % 5 = 0 AND doc_id % 13 <> 0 THEN 'R' || chr(10) ELSE '' END || t || CASE WHEN doc_id % 7 = 0 THEN 'L' ELSE '' END END",
}


def _sql(side: str) -> str:
    return f"SELECT path, sha256(text) AS blob FROM (SELECT path, {_SIDES[side]} AS text FROM files) WHERE text IS NOT NULL"


def query(sql: str):
    def register(run):
        QUERIES[run.__name__] = run
        ORACLES[run.__name__] = f"WITH {_FILES} {sql}"
        return run

    return register


def _tree(spark, sf_dir: str, side: str) -> DataFrame:
    docs, by, t = d.read(spark, sf_dir, "documents"), F.col("doc_id"), F.coalesce("text", F.lit(""))
    text = {
        "base": t,
        "left": F.when(by % 7 == 0, F.concat(t, F.lit("L"))).otherwise(t),
        "right": F.when(by % 13 == 0, F.lit(None)).when(by % 5 == 0, F.concat(F.lit("R\n"), t)).otherwise(t),
    }[side]
    rows = docs.select(F.concat("source", F.lit("/"), by, F.lit(".txt")).alias("path"), text.alias("text")).where("text is not null")
    return rows.select("path", F.col("text").cast("binary").alias("content"), F.lit("regular").alias("mode"))


def _repo(spark, sf_dir: str) -> tuple[Repo, dict[str, str]]:
    """A store with base on main, left on main after it, right on a branch of base."""
    repo = Repo.init(spark, f"{tempfile.mkdtemp(prefix='lamina-')}/store")
    repo.set_identity("a", "a@example.org")
    states = {"base": repo.commit("base", _tree(spark, sf_dir, "base"), "1")}
    repo.create_branch("side")
    states["left"] = repo.commit("left", _tree(spark, sf_dir, "left"), "2")
    repo.checkout("side")
    states["right"] = repo.commit("right", _tree(spark, sf_dir, "right"), "3")
    return repo, states


def _kept(repo: Repo, name: str = "HEAD") -> DataFrame:
    return repo.files(repo.manifest(name)).select("path", F.sha2("content", 256).alias("blob"))


def _settled(verb, *args):
    """A verb run again with the left side's choice where both sides changed one place."""
    try:
        return verb(*args)
    except MergeConflict as error:
        return verb(*args, resolutions={p: "ours" for p, _ in error.conflicts})


@query(" UNION ALL ".join(f"SELECT '{s}' AS side, * FROM ({_sql(s)})" for s in ("base", "left", "right")))
def repo_states(spark, sf_dir):
    """What was committed comes back from the store."""
    repo, states = _repo(spark, sf_dir)
    out = [_kept(repo, state).select(F.lit(side).alias("side"), "path", "blob") for side, state in states.items()]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query(_sql("merged"))
def repo_merge(spark, sf_dir):
    """Main merges the branch: base and plan are found, texts merged line by line."""
    repo, _ = _repo(spark, sf_dir)
    repo.checkout("main")
    _settled(repo.merge, "side", None)
    return _kept(repo)


@query(_sql("base"))
def repo_revert(spark, sf_dir):
    """The branch's state undone is the base again."""
    repo, states = _repo(spark, sf_dir)
    repo.revert(states["right"])
    return _kept(repo)


@query(" UNION ALL ".join(f"SELECT '{v}' AS verb, * FROM ({_sql('merged')})" for v in ("cherry_pick", "rebase")))
def repo_replay(spark, sf_dir):
    """The branch's change on top of main, by cherry-pick and by rebase."""
    repo, states = _repo(spark, sf_dir)
    repo.checkout("main")
    repo.create_branch("picked")
    repo.checkout("picked")
    _settled(repo.cherry_pick, states["right"])
    repo.checkout("side")
    try:
        repo.rebase("main")
    except MergeConflict as error:
        repo.rebase_continue({p: "ours" for p, _ in error.conflicts})
    return _kept(repo, "picked").select(F.lit("cherry_pick").alias("verb"), "*").unionByName(_kept(repo, "side").select(F.lit("rebase").alias("verb"), "*"))


@query(" UNION ALL ".join(f"SELECT '{w}' AS place, * FROM ({_sql(s)})" for w, s in (("clone", "left"), ("pushed", "base"), ("fetched", "right"))))
def repo_transfer(spark, sf_dir):
    """A clone's main, what it pushed to its source, and what the source's branch brought by a later fetch."""
    repo, states = _repo(spark, sf_dir)
    copy = Repo.clone(spark, str(repo.root), f"{tempfile.mkdtemp(prefix='lamina-')}/copy")
    cloned = _kept(copy, "main").select(F.lit("clone").alias("place"), "*")
    copy.checkout("main")
    copy.revert(states["left"])
    copy.push("origin", "main")
    copy.fetch("origin")
    pushed = _kept(repo, "main").select(F.lit("pushed").alias("place"), "*")
    return cloned.unionByName(pushed).unionByName(_kept(copy, "origin/side").select(F.lit("fetched").alias("place"), "*"))


@query(_sql("left"))
def repo_stash(spark, sf_dir):
    """Changes put aside on base and taken up again."""
    repo, states = _repo(spark, sf_dir)
    repo.checkout(states["base"])
    repo.stash(_tree(spark, sf_dir, "left"))
    return repo.files(repo.stash_apply(drop=True)).select("path", F.sha2("content", 256).alias("blob"))


@query(f"SELECT path, CASE WHEN doc_id % 7 = 0 THEN 'modified' END AS staged, CASE WHEN doc_id % 13 = 0 THEN 'deleted' WHEN doc_id % 7 = 0 OR doc_id % 5 = 0 THEN 'modified' END AS unstaged, false AS untracked FROM files WHERE doc_id % 7 = 0 OR doc_id % 13 = 0 OR doc_id % 5 = 0")
def repo_status(spark, sf_dir):
    """Left is staged on base, right is the working tree; nothing is renamed, so all twins of texts stay apart."""
    repo, states = _repo(spark, sf_dir)
    repo.checkout(states["base"])
    changed = repo.diff(states["base"], states["left"]).select("path")
    repo.add(_tree(spark, sf_dir, "left").join(changed, "path"))
    return repo.status(_tree(spark, sf_dir, "right")).select("path", "staged", "unstaged", "untracked")


@query("SELECT unnest(['base', 'left', 'right', 'merge']) AS message, unnest(['1', '2', '3', NULL]) AS stamp, unnest([2, 1, 1, 0])::INTEGER AS depth, unnest([2, 1, 1, NULL])::INTEGER AS base_distance")
def repo_log(spark, sf_dir):
    """The log after a merge, and each state's distance to the branches' base."""
    repo, states = _repo(spark, sf_dir)
    repo.checkout("main")
    _settled(repo.merge, "side", "merge")
    known = spark.createDataFrame([(states["base"], 2), (states["left"], 1), (states["right"], 1)], "state string, base_distance int")
    rows = repo.log(limit=4).join(known, "state", "left")
    return rows.select("message", F.when(F.col("message") != "merge", F.col("timestamp")).alias("stamp"), "depth", "base_distance")


@query("SELECT unnest(['state', 'blob']) AS kind, unnest([1, (SELECT count(DISTINCT t || 'L') FROM files WHERE doc_id % 7 = 0 AND t || 'L' NOT IN (SELECT t FROM files))])::BIGINT AS items")
def repo_gc(spark, sf_dir):
    """The left state loses its branch: what it alone had is found, and pruned for good."""
    repo, states = _repo(spark, sf_dir)
    repo.create_branch("old", states["base"])
    repo.remove_branch("main")
    found = repo.gc(prune=True, prune_history=True)
    if repo.fsck() or [n for _, n, _ in repo.gc()] != [0, 0]:
        raise AssertionError("something is left or lost")
    return spark.createDataFrame([(k, n) for k, n, _ in found], "kind string, items long")
