"""A repository of states over Parquet tables, with the verbs of everyday versioning.

``blobs`` (blob, kind, bytes), ``manifests`` (manifest, path, blob, mode), ``states`` (state, manifest, message,
timestamp, author_name, author_email) and ``edges`` (child, parent, ord) are append-only Parquet tables, handled
as DataFrames. What moves, such as refs, the staging overlay, stashes and half-done work, is one small JSON file
that is replaced whole, under a lock. The folder must be one that the driver and all executors reach.
"""

from __future__ import annotations

import base64
import contextlib
import fcntl
import hashlib
import json
import os
import shutil
import time
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.functions.hashing import ROOT
from lamina.operators import history, integrity, kernels, manifests, sync
from lamina.sources import html_view, working_tree

FORMAT = 1
BLOBS = "blob string, kind string, bytes binary"
MANIFESTS = "manifest string, path string, blob string, mode string"
STATES = "state string, manifest string, message string, timestamp string, author_name string, author_email string"
EDGES = "child string, parent string, ord int"
SCAN = "path string, size long, mtime long, ctime long, mode string, blob string"
_TABLES = {"blobs": BLOBS, "manifests": MANIFESTS, "states": STATES, "edges": EDGES}


class RepoError(Exception):
    """An operation that can't be done; ``kind`` says why."""

    def __init__(self, kind: str, message: str):
        super().__init__(message)
        self.kind = kind


def content_json(kind: str, content: bytes) -> bytes:
    """Canonical bytes of a content, whose SHA-256 is the blob id."""
    if kind == "text":
        body = {"kind": "text", "content": content.decode()}
    elif kind == "symlink":
        body = {"kind": "symlink", "target": content.decode()}
    else:
        body = {"kind": "binary", "bytes": base64.b64encode(content).decode()}
    return json.dumps(body, separators=(",", ":"), ensure_ascii=False).encode()


def content_kind(content: bytes, mode: str) -> str:
    if mode == "symlink":
        return "symlink"
    try:
        content.decode()
    except UnicodeDecodeError:
        return "binary"
    return "binary" if b"\0" in content else "text"


def commit_id(manifest: str, parents: list[str], message: str, timestamp: str, name: str, email: str) -> str:
    parts = [manifest, *sorted(parents), message, timestamp, name, email]
    return hashlib.sha256(b"\0".join(p.encode() for p in parts)).hexdigest()


def manifest_id(entries: list[tuple[str, str, str]]) -> str:
    made = hashlib.sha256()
    for path, blob, mode in sorted(entries, key=lambda e: e[0].encode()):
        made.update(path.encode() + b"\0" + blob.encode() + (b"" if mode == "regular" else b"\0" + mode.encode()))
    return made.hexdigest()


class Repo:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, Path(root)
        self.hooks: dict[str, Callable[..., bool]] = {}
        if not (self.root / "refs.json").exists():
            raise RepoError("not_found", f"no repository at {root}")
        if self.refs()["format"] > FORMAT:
            raise RepoError("format", "the repository is of a newer format")

    # Storage

    @classmethod
    def init(cls, spark: SparkSession, root: str, branch: str = "main") -> Repo:
        """A repository with the empty root state."""
        top = Path(root)
        top.mkdir(parents=True, exist_ok=True)
        if (top / "refs.json").exists():
            raise RepoError("exists", "there is a repository already")
        refs = {"format": FORMAT, "head": {"branch": branch}, "heads": {branch: ROOT}, "tags": {}, "remotes": {}, "urls": {}, "staging": {}, "stash": [], "config": {}, "work": {}, "shallow": []}
        (top / "refs.json").write_text(json.dumps(refs))
        repo = cls(spark, root)
        repo._append("states", [(ROOT, manifest_id([]), "", "0", "", "")])
        return repo

    @classmethod
    def discover(cls, spark: SparkSession, start: str) -> Repo:
        """The repository of a folder or of one above it, kept in ``.lamina``."""
        for folder in [Path(start).resolve(), *Path(start).resolve().parents]:
            if (folder / ".lamina" / "refs.json").exists():
                return cls(spark, str(folder / ".lamina"))
        raise RepoError("not_found", f"no repository at or above {start}")

    def refs(self) -> dict:
        return json.loads((self.root / "refs.json").read_text())

    @contextlib.contextmanager
    def _changing(self):
        """The refs under a lock; written whole at the end, or left as they were."""
        with open(self.root / "lock", "w") as lock:
            try:
                fcntl.flock(lock, fcntl.LOCK_EX | fcntl.LOCK_NB)
            except OSError as error:
                raise RepoError("locked", "another process holds the repository") from error
            refs = self.refs()
            yield refs
            part = self.root / "refs.json.part"
            with open(part, "w") as file:
                json.dump(refs, file)
                file.flush()
                os.fsync(file.fileno())
            part.replace(self.root / "refs.json")

    def table(self, name: str) -> DataFrame:
        path = self.root / name
        if not path.exists():
            return self.spark.createDataFrame([], _TABLES[name])
        return self.spark.read.schema(_TABLES[name]).parquet(str(path))

    def _append(self, name: str, rows) -> None:
        df = rows if isinstance(rows, DataFrame) else self.spark.createDataFrame(rows, _TABLES[name])
        df.write.mode("append").option("compression", "zstd").parquet(str(self.root / name))

    def hashed(self, files: DataFrame) -> DataFrame:
        """path, mode, blob, kind, content of (path, content, mode); stores nothing."""

        def run(batches):
            for pdf in batches:
                content = [bytes(c) for c in pdf["content"]]
                pdf["kind"] = [content_kind(c, m) for c, m in zip(content, pdf["mode"], strict=True)]
                pdf["blob"] = [hashlib.sha256(content_json(k, c)).hexdigest() for k, c in zip(pdf["kind"], content, strict=True)]
                yield pdf[["path", "mode", "blob", "kind", "content"]]

        return files.select("path", "content", "mode").mapInPandas(run, "path string, mode string, blob string, kind string, content binary")

    def write_blobs(self, files: DataFrame) -> DataFrame:
        """Store (path, content, mode) contents that aren't there yet; gives path, blob, mode."""
        named = history.cut(self.hashed(files))
        fresh = named.dropDuplicates(["blob"]).join(self.table("blobs").select("blob"), "blob", "left_anti")
        self._append("blobs", fresh.select("blob", "kind", F.col("content").alias("bytes")))
        return named.select("path", "blob", "mode")

    def import_blobs(self, blobs: DataFrame) -> None:
        """Store (blob, kind, bytes) from elsewhere; ids that don't fit their bytes are refused."""
        bad = self._corrupt(blobs).first()
        if bad:
            raise RepoError("corrupt", f"blob {bad['blob']} doesn't fit its id")
        self._append("blobs", blobs.select("blob", "kind", "bytes").join(self.table("blobs").select("blob"), "blob", "left_anti"))

    # Names

    def edges(self) -> DataFrame:
        return self.table("edges")

    def _one(self, state: str) -> DataFrame:
        return self.spark.createDataFrame([(state,)], "state string")

    def head(self) -> str:
        refs = self.refs()
        return refs["heads"].get(refs["head"]["branch"], ROOT) if "branch" in refs["head"] else refs["head"]["state"]

    def resolve(self, name: str) -> str:
        """HEAD in any case, a full id, then heads, tags and remotes."""
        refs = self.refs()
        if name.upper() == "HEAD":
            return self.head()
        if len(name) == 64 and self.table("states").where(F.col("state") == name.lower()).first():
            return name.lower()
        for kind in ("heads", "tags", "remotes"):
            if name in refs[kind]:
                return refs[kind][name]
        raise RepoError("unknown_ref", f"nothing is called {name}")

    def state(self, name: str):
        row = self.table("states").where(F.col("state") == self.resolve(name)).first()
        if row is None:
            raise RepoError("missing_state", f"{name} isn't there")
        return row

    def manifest(self, name: str) -> DataFrame:
        """path, blob, mode of a state."""
        return self.table("manifests").where(F.col("manifest") == self.state(name)["manifest"]).select("path", "blob", "mode")

    def files(self, entries: DataFrame) -> DataFrame:
        """path, content, mode of manifest entries."""
        return entries.join(self.table("blobs"), "blob").select("path", F.col("bytes").alias("content"), "mode")

    def branches(self) -> list[str]:
        return sorted(self.refs()["heads"])

    def create_branch(self, name: str, at: str = "HEAD") -> None:
        state = self.resolve(at)
        with self._changing() as refs:
            if name in refs["heads"]:
                raise RepoError("exists", f"there is a branch {name}")
            refs["heads"][name] = state

    def remove_branch(self, name: str) -> None:
        with self._changing() as refs:
            if refs["head"].get("branch") == name:
                raise RepoError("current", "the current branch can't go")
            if refs["heads"].pop(name, None) is None:
                raise RepoError("unknown_ref", f"no branch {name}")

    def tag(self, name: str, at: str = "HEAD") -> None:
        state = self.resolve(at)
        if not name or name.upper() == "HEAD" or any(c in name for c in " ~^:?*[\\") or ".." in name:
            raise RepoError("bad_name", f"{name!r} can't be a tag")
        with self._changing() as refs:
            if name in refs["tags"]:
                raise RepoError("exists", f"there is a tag {name}")
            refs["tags"][name] = state

    def tags(self) -> list[str]:
        return sorted(self.refs()["tags"])

    def remove_tag(self, name: str) -> None:
        with self._changing() as refs:
            if refs["tags"].pop(name, None) is None:
                raise RepoError("unknown_ref", f"no tag {name}")

    def set_identity(self, name: str, email: str) -> None:
        with self._changing() as refs:
            refs["config"] |= {"name": name, "email": email}

    def identity(self) -> tuple[str, str]:
        """From the environment, else the repository."""
        config = self.refs()["config"]
        return os.environ.get("LAMINA_AUTHOR_NAME") or config.get("name", ""), os.environ.get("LAMINA_AUTHOR_EMAIL") or config.get("email", "")

    def _hook(self, name: str, *args) -> None:
        if name in self.hooks and self.hooks[name](*args) is False:
            raise RepoError("hook", f"{name} refused")

    # States

    def persist(self, entries: DataFrame, parents: list[str], message: str, stamp: str | None = None, author: tuple[str, str] | None = None) -> str:
        """A new state of (path, blob, mode); gives its id."""
        entries = history.cut(entries.select("path", "blob", "mode"))
        key = F.struct(F.col("path").cast("binary").alias("p"), F.concat(F.col("path").cast("binary"), F.lit(b"\0"), F.col("blob").cast("binary"), F.when(F.col("mode") == "regular", F.lit(b"")).otherwise(F.concat(F.lit(b"\0"), F.col("mode").cast("binary")))).alias("e"))
        row = entries.agg(F.sha2(F.unhex(F.array_join(F.transform(F.sort_array(F.collect_list(key)), lambda x: F.hex(x["e"])), "")), 256).alias("m")).first()
        name, email = author or self.identity()
        stamp = stamp or str(int(time.time()))
        state = commit_id(row["m"], parents, message, stamp, name, email)
        if not self.table("states").where(F.col("manifest") == row["m"]).first():
            self._append("manifests", entries.select(F.lit(row["m"]).alias("manifest"), "path", "blob", "mode"))
        self._append("edges", [(state, p, i) for i, p in enumerate(parents)])
        self._append("states", [(state, row["m"], message, stamp, name, email)])
        return state

    def _advance(self, refs: dict, state: str) -> None:
        if "branch" in refs["head"]:
            refs["heads"][refs["head"]["branch"]] = state
        else:
            refs["head"] = {"state": state}

    def add(self, files: DataFrame, deleted: list[str] = ()) -> None:
        """Stage (path, content, mode), and paths that go."""
        rows = self.write_blobs(files).collect()
        with self._changing() as refs:
            refs["staging"] |= {r["path"]: {"blob": r["blob"], "mode": r["mode"]} for r in rows}
            refs["staging"] |= {p: None for p in deleted}

    def staging(self) -> DataFrame:
        rows = [(p, e is None, (e or {}).get("blob"), (e or {}).get("mode")) for p, e in self.refs()["staging"].items()]
        return self.spark.createDataFrame(rows, "path string, deleted boolean, blob string, mode string")

    def commit(self, message: str, files: DataFrame | None = None, stamp: str | None = None) -> str:
        """A state of the given files, else of HEAD with what is staged; HEAD itself if nothing changed."""
        self._hook("pre_commit")
        entries = self.write_blobs(files) if files is not None else manifests.effective(self.manifest("HEAD"), self.staging())
        entries = history.cut(entries)
        if manifests.diff(self.manifest("HEAD"), entries).isEmpty():
            return self.head()
        self._hook("commit_msg", message)
        state = self.persist(entries, [self.head()], message, stamp)
        with self._changing() as refs:
            self._advance(refs, state)
            refs["staging"] = {}
        return state

    def checkout(self, name: str, root: str | None = None, force: bool = False) -> str:
        """HEAD to a branch or state; with ``root`` its files are written there too, over a clean tree."""
        state = self.resolve(name)
        if root:
            self._guard(root, force)
            known = [r["path"] for r in self.manifest("HEAD").select("path").collect()]
            working_tree.materialize(self.files(self.manifest(state)), root, known)
        with self._changing() as refs:
            refs["head"] = {"branch": name} if name in refs["heads"] else {"state": state}
            refs["staging"] = {}
        return state

    def reset(self, name: str, mode: str = "hard", root: str | None = None, force: bool = False) -> None:
        """Move the branch; mixed and hard drop what is staged, hard writes the files over a clean tree."""
        state = self.resolve(name)
        if root and mode == "hard":
            self._guard(root, force)
            known = [r["path"] for r in self.manifest("HEAD").select("path").collect()]
            working_tree.materialize(self.files(self.manifest(state)), root, known)
        with self._changing() as refs:
            self._advance(refs, state)
            if mode != "soft":
                refs["staging"] = {}

    def scan(self, root: str, full: bool = False) -> tuple[DataFrame, DataFrame, int]:
        """Entries (path, blob, mode) of a working tree, the files that were read (path, blob, kind, bytes), their number.

        A file whose size, times and mode are those of the last scan is not read: its blob is known. The
        listing is walked by the driver, which bounds this verb to trees of people's size.
        """
        now = working_tree.scan(self.spark, root)
        known = self.root / "scan"
        before = self.spark.read.schema(SCAN).parquet(str(known)) if known.exists() and not full else self.spark.createDataFrame([], SCAN)
        keys = ["path", "size", "mtime", "ctime", "mode"]
        kept = history.cut(now.join(before, keys).select(*keys, "blob"))
        changed = [r["path"] for r in working_tree.changed_since(now, before).select("path").collect()]
        fresh = history.cut(self.hashed(working_tree.load(self.spark, root, set(changed))))
        read = now.join(fresh.select("path", "blob"), "path").select(*keys, "blob")
        entries = history.cut(kept.unionByName(read))
        if changed or kept.count() != before.count():
            entries.coalesce(1).write.mode("overwrite").parquet(f"{known}.part")
            shutil.rmtree(known, ignore_errors=True)
            (self.root / "scan.part").rename(known)
            self.spark.catalog.refreshByPath(str(known))
        return entries.select("path", "blob", "mode"), fresh.select("path", "blob", "kind", F.col("content").alias("bytes")), len(changed)

    def _seen(self, tree: DataFrame | str) -> tuple[DataFrame, DataFrame]:
        """Entries of a tree, given as (path, content, mode) or as its folder, and contents the store may lack."""
        if isinstance(tree, str):
            entries, fresh, _ = self.scan(tree)
            lost = entries.join(self.table("blobs").select("blob"), "blob", "left_anti").join(fresh.select("blob"), "blob", "left_anti").select("path").collect()
            if lost:  # read by an earlier scan, never stored
                paths = {r["path"] for r in lost}
                more = self.hashed(working_tree.load(self.spark, tree, paths)).select("path", "blob", "kind", F.col("content").alias("bytes"))
                fresh = history.cut(fresh.unionByName(more))
            return entries, fresh.select("blob", "kind", "bytes")
        named = history.cut(self.hashed(tree))
        return named.select("path", "blob", "mode"), named.select("blob", "kind", F.col("content").alias("bytes"))

    def status(self, tree: DataFrame | str) -> DataFrame:
        """Two columns on every path that isn't clean, renames folded; stores nothing.

        ``tree``: (path, content, mode), or the folder, of which only changed files are read.
        """
        if isinstance(tree, str):
            entries = self.scan(tree)[0]
            clean = manifests.diff(manifests.effective(self.manifest("HEAD"), self.staging()), entries).isEmpty()
            if clean:
                return manifests.status_with_renames(self.manifest("HEAD"), self.staging(), entries)
        entries, contents = self._seen(tree)
        return manifests.status_with_renames(self.manifest("HEAD"), self.staging(), entries, renames=lambda old, new: self._moves(old, new, contents).select("from_path", "to_path"))

    def is_clean(self, tree: DataFrame | str) -> bool:
        entries = self.scan(tree)[0] if isinstance(tree, str) else self.hashed(tree)
        return manifests.status(self.manifest("HEAD"), self.staging(), entries).isEmpty()

    def _guard(self, root: str, force: bool) -> None:
        """Nothing that isn't committed is overwritten unless ``force`` says so."""
        if not force and not self.is_clean(root):
            raise RepoError("dirty", "the working tree has changes that aren't committed")

    # Reading

    def log(self, name: str = "HEAD", limit: int = 20) -> DataFrame:
        walked = history.log(self.edges(), self._one(self.resolve(name)), limit)
        return walked.join(self.table("states"), "state").orderBy("visit").select("state", "message", "timestamp", "author_name", "depth")

    def diff(self, old: str, new: str) -> DataFrame:
        return manifests.diff(self.manifest(old), self.manifest(new))

    def _changes(self, old: DataFrame, new: DataFrame, contents: DataFrame | None = None, path: str | None = None) -> DataFrame:
        """path, from_path, change and both texts and kinds of what differs between two sets of entries, renames as one change."""
        moves = history.cut(self._moves(old, new, contents).select("from_path", "to_path"))
        came = moves.join(old.select(F.col("path").alias("from_path"), F.col("blob").alias("old_blob")), "from_path").join(new.select(F.col("path").alias("to_path"), F.col("blob").alias("new_blob")), "to_path")
        came = came.select(F.col("to_path").alias("path"), "from_path", F.lit("renamed").alias("change"), "old_blob", "new_blob")
        ends = moves.select(F.col("from_path").alias("path")).unionByName(moves.select(F.col("to_path").alias("path")))
        rest = manifests.diff(old, new).join(ends, "path", "left_anti").withColumn("from_path", F.lit(None).cast("string"))
        rows = came.unionByName(rest.select(*came.columns))
        if path is not None:
            rows = rows.where((F.col("path") == path) | (F.col("from_path") == path))
        return self.texts(rows, contents, old="old_blob", new="new_blob")

    def _compared(self, what: str | tuple[str, str], tree: DataFrame | str | None = None, path: str | None = None) -> DataFrame:
        """Changes of the ``tree``, of what is ``staged``, or from one state to another."""
        head = self.manifest("HEAD")
        if what == "tree":
            entries, contents = self._seen(tree)
            return self._changes(manifests.effective(head, self.staging()), entries, contents, path)
        if what == "staged":
            return self._changes(head, manifests.effective(head, self.staging()), None, path)
        return self._changes(self.manifest(what[0]), self.manifest(what[1]), None, path)

    def views(self, what: str | tuple[str, str], tree: DataFrame | str | None = None, path: str | None = None) -> DataFrame:
        """Views, one row a file, of the same changes as ``diff_tree``, ``diff_staged`` and ``diff_states`` tell."""
        return html_view.views(self._compared(what, tree, path))

    def diff_tree(self, tree: DataFrame | str, path: str | None = None) -> DataFrame:
        """What a working tree, or one path of it, has that isn't staged."""
        return kernels.described(self._compared("tree", tree, path))

    def diff_staged(self, path: str | None = None) -> DataFrame:
        """What is staged against HEAD, all of it or one path."""
        return kernels.described(self._compared("staged", path=path))

    def diff_states(self, old: str, new: str, path: str | None = None) -> DataFrame:
        """What changed from one state to another, all of it or one path."""
        return kernels.described(self._compared((old, new), path=path))

    def renames(self, old: str, new: str) -> DataFrame:
        """from_path, to_path, the new blob and kind: exact, or with_edits where a source file's structure is kept."""
        return self._moves(self.manifest(old), self.manifest(new))

    def _moves(self, old: DataFrame, new: DataFrame, contents: DataFrame | None = None) -> DataFrame:
        exact = history.cut(manifests.exact_renames(old, new).withColumn("kind", F.lit("exact")))

        def rest(side: DataFrame, other: DataFrame, end: str) -> DataFrame:
            own = side.where("mode <> 'symlink'").join(other.select("path"), "path", "left_anti")
            return history.cut(own.join(exact.select(F.col(end).alias("path")), "path", "left_anti").select("path", "blob"))

        gone, come = rest(old, new, "from_path"), rest(new, old, "to_path")
        read = [self.texts(rows, contents, text="blob").where("text is not null").select("path", "text") for rows in (gone, come)]
        edited = kernels.edited_renames(*read).join(come.withColumnRenamed("path", "to_path"), "to_path")
        return exact.unionByName(history.cut(edited.select("from_path", "to_path", "blob", F.lit("with_edits").alias("kind"))))

    def texts(self, rows: DataFrame, contents: DataFrame | None = None, **columns: str) -> DataFrame:
        """The texts of blob columns: ``texts(df, old='old_blob')`` adds ``old``, null where it is no text, and
        ``old_kind``; ``contents`` holds blobs that aren't stored."""
        blobs = self.table("blobs").select("blob", "kind", "bytes")
        if contents is not None:
            blobs = blobs.unionByName(contents).dropDuplicates(["blob"])
        for name, blob in columns.items():
            text = F.when(F.col("kind") == "text", F.col("bytes").cast("string"))
            one = blobs.select(F.col("blob").alias(blob), text.alias(name), F.col("kind").alias(f"{name}_kind"))
            rows = rows.join(one, blob, "left")
        return rows

    def intents(self, old: str, new: str) -> DataFrame:
        """Mutations of all changed files; unchanged files are never read."""
        changed = self.diff(old, new).where("change = 'modified'")
        return kernels.structural_diff(self.texts(changed, old="old_blob", new="new_blob").select("path", "old", "new"))

    def blame(self, path: str, name: str = "HEAD") -> list[tuple[int, str, str]]:
        """(line, state, text) along the first-parent chain."""
        from lamina.kernel.textdiff import blame

        chain = history.linear_chain(self.edges(), self._one(self.resolve(name)))
        entries = chain.join(self.table("states"), "state").join(self.table("manifests").where(F.col("path") == path), "manifest")
        rows = self.texts(entries.select("state", "distance", "blob"), text="blob").orderBy(F.desc("distance")).collect()
        return blame([(r["state"], r["text"] or "") for r in rows])

    def merge_base(self, a: str, b: str) -> str:
        """The nearest common state. Where history is cut short, a base that may lie beyond the cut is an error."""
        left, right = self.resolve(a), self.resolve(b)
        shallow = self.refs()["shallow"]
        if left == right:
            return left
        edges = self.edges()
        if shallow:
            if left in shallow or right in shallow:
                raise RepoError("shallow", "history is cut short; fetch more of it")
            there = self.table("states").select(F.col("state").alias("parent"))
            edges = edges.join(there, "parent", "left_semi").join(self.spark.createDataFrame([(s,) for s in shallow], "child string"), "child", "left_anti").select("child", "parent", "ord")
        row = history.merge_base(edges, self._one(left), self._one(right)).first()
        if row is None and shallow:
            raise RepoError("shallow", "history is cut short; fetch more of it")
        if row is None:
            raise RepoError("unrelated", f"{a} and {b} share nothing")
        return row["state"]

    def is_ancestor(self, above: str, below: str) -> bool:
        return bool(history.is_ancestor(self.edges(), self._one(self.resolve(below)), self._one(self.resolve(above))).first()["is_ancestor"])

    # Merging

    def plan(self, base: str, ours: str, theirs: str, renames: bool = True, resolutions: dict[str, str] | None = None) -> tuple[DataFrame, list[tuple[str, str]]]:
        """(path, blob, mode) after a three-way merge, and (path, reason) of conflicts."""
        sides = [self.manifest(s) for s in (base, ours, theirs)]
        return self._planned(sides, renames, resolutions or {})

    def _planned(self, sides: list[DataFrame], renames: bool, resolutions: dict[str, str]) -> tuple[DataFrame, list[tuple[str, str]]]:
        rows = manifests.plan_three_way(*sides, renames=self._moves) if renames else manifests.three_way(*sides).withColumn("target", F.col("path"))
        rows = history.cut(rows.select("path", "target", "outcome", "b_blob", "l_blob", "r_blob", "mode"))
        chosen = self.spark.createDataFrame(list(resolutions.items()), "path string, choice string")
        rows = rows.join(chosen, "path", "left")
        settled = F.when(F.col("choice") == "ours", F.col("l_blob")).when(F.col("choice") == "theirs", F.col("r_blob"))
        open_ = F.col("choice").isNull()
        inside = self.texts(rows.where((F.col("outcome") == "content_merge") & open_), base="b_blob", left="l_blob", right="r_blob")
        merged = history.cut(kernels.merge_files(inside.where("base is not null and left is not null and right is not null").select(F.col("target").alias("path"), "base", "left", "right")))
        conflicts = [(r["path"], r["message"]) for r in merged.where("not clean").select("path", "message").collect()]
        conflicts += [(r["target"], "binary contents differ") for r in inside.where("base is null or left is null or right is null").select("target").collect()]
        hard = ("add_add", "kind_conflict", "rename_conflict")
        conflicts += [(r["path"], r["outcome"]) for r in rows.where(F.col("outcome").isin(*hard) & open_).select("path", "outcome").collect()]
        meet = rows.where(~F.col("outcome").startswith("remove")).groupBy("target").agg(F.count("*").alias("n"), F.max(open_).alias("open")).where("n > 1 and open")
        conflicts += [(r["target"], "rename_conflict") for r in meet.collect()]
        conflicts += [(r["path"], "mode") for r in rows.where((F.col("mode") == "conflict") & open_ & ~F.col("outcome").startswith("remove")).select("path").collect()]
        written = self.write_blobs(merged.where("clean").join(rows.select(F.col("target").alias("path"), "mode"), "path").select("path", F.col("text").cast("binary").alias("content"), "mode"))
        blob = F.when(F.col("choice").isNotNull(), settled).when(F.col("outcome").isin(*manifests.LEFT), F.col("l_blob")).when(F.col("outcome").isin(*manifests.RIGHT), F.col("r_blob"))
        kept = rows.select(F.col("target").alias("path"), blob.alias("blob"), F.when(F.col("mode") == "conflict", "regular").otherwise(F.col("mode")).alias("mode")).where("blob is not null")
        return kept.unionByName(written), sorted(set(conflicts))

    def merge(self, name: str, message: str | None = None, resolutions: dict[str, str] | None = None) -> str:
        """Merge a branch or state into HEAD; moves ahead where HEAD is the base."""
        other, head = self.resolve(name), self.head()
        if other == head:
            raise RepoError("up_to_date", "there is nothing to merge")
        base = self.merge_base(head, other)
        self._hook("pre_merge", name)
        if base == head:
            state = other
        else:
            entries, conflicts = self.plan(base, head, other, resolutions=resolutions)
            if conflicts:
                raise MergeConflict(conflicts)
            state = self.persist(entries, [head, other], message or f"merge {name}")
        with self._changing() as refs:
            self._advance(refs, state)
        return state

    def _parent(self, state: str) -> str:
        parents = [r["parent"] for r in self.edges().where(F.col("child") == state).collect()]
        if len(parents) != 1:
            raise RepoError("not_linear", "merges and the root have no single parent")
        return parents[0]

    def revert(self, name: str) -> str:
        """Undo one state on top of HEAD."""
        target = self.resolve(name)
        entries, conflicts = self.plan(target, self._parent(target), "HEAD", renames=False)
        if conflicts:
            raise MergeConflict(conflicts)
        return self._committed(entries, f"revert {self.state(target)['message']}")

    def _committed(self, entries: DataFrame, message: str, author: tuple[str, str] | None = None) -> str:
        entries = history.cut(entries)
        if manifests.diff(self.manifest("HEAD"), entries).isEmpty():
            return self.head()
        state = self.persist(entries, [self.head()], message, author=author)
        with self._changing() as refs:
            self._advance(refs, state)
        return state

    def cherry_pick(self, name: str, resolutions: dict[str, str] | None = None) -> str:
        """Repeat one state's change on top of HEAD, with its message and author."""
        target = self.resolve(name)
        entries, conflicts = self.plan(self._parent(target), "HEAD", target, resolutions=resolutions)
        if conflicts:
            raise MergeConflict(conflicts)
        row = self.state(target)
        return self._committed(entries, row["message"], (row["author_name"], row["author_email"]))

    def rebase(self, onto: str) -> str:
        """Repeat HEAD's own linear states on another; stops at a conflict, to be continued or aborted."""
        head, goal = self.head(), self.resolve(onto)
        base = self.merge_base(head, goal)
        chain = history.bisect_candidates(self.edges(), self._one(base), self._one(head)).orderBy("step").collect()
        if not chain and base != head:
            raise RepoError("not_linear", "the history above the base isn't linear")
        with self._changing() as refs:
            refs["work"]["rebase"] = {"start": head, "branch": refs["head"], "todo": [r["state"] for r in chain]}
            self._advance(refs, goal)
        return self.rebase_continue()

    def rebase_continue(self, resolutions: dict[str, str] | None = None, files: DataFrame | None = None) -> str:
        """Go on; the state that stopped is settled by choices, or is the given (path, content, mode)."""
        work = self.refs()["work"].get("rebase")
        if not work:
            raise RepoError("no_work", "no rebase is under way")
        while work["todo"]:
            if files is not None:
                row = self.state(work["todo"][0])
                self._committed(self.write_blobs(files), row["message"], (row["author_name"], row["author_email"]))
            else:
                self.cherry_pick(work["todo"][0], resolutions)
            resolutions = files = None
            with self._changing() as refs:
                refs["work"]["rebase"]["todo"].pop(0)
                work = refs["work"]["rebase"]
        with self._changing() as refs:
            del refs["work"]["rebase"]
        return self.head()

    def rebase_abort(self) -> None:
        with self._changing() as refs:
            work = refs["work"].pop("rebase", None)
            if not work:
                raise RepoError("no_work", "no rebase is under way")
            self._advance(refs, work["start"])

    # Stash

    def stash(self, tree: DataFrame, message: str = "", untracked: bool = False) -> str:
        """Put the changes of a working tree (path, content, mode) aside, deletions too."""
        hashed = history.cut(self.write_blobs(tree))
        changed = manifests.diff(self.manifest("HEAD"), hashed)
        if not untracked:
            changed = changed.where("change <> 'added'")
        rows = changed.select("path").join(hashed, "path", "left").collect()
        if not rows:
            raise RepoError("clean", "nothing to put aside")
        entry = {"id": hashlib.sha256(json.dumps([str(r) for r in rows]).encode()).hexdigest(), "message": message, "base": self.head(), "files": {r["path"]: [r["blob"], r["mode"]] for r in rows}}
        with self._changing() as refs:
            refs["stash"].insert(0, entry)
        return entry["id"]

    def stashes(self) -> list[tuple[int, str, str]]:
        return [(i, s["id"], s["message"]) for i, s in enumerate(self.refs()["stash"])]

    def stash_apply(self, index: int = 0, drop: bool = False) -> DataFrame:
        """(path, blob, mode) of HEAD with a stash merged in."""
        entry = self.refs()["stash"][index]
        files = self.spark.createDataFrame([(p, b is None, b, m) for p, (b, m) in entry["files"].items()], "path string, deleted boolean, blob string, mode string")
        base = self.manifest(entry["base"])
        entries, conflicts = self._planned([base, self.manifest("HEAD"), manifests.effective(base, files)], False, {})
        if conflicts:
            raise MergeConflict(conflicts)
        if drop:
            self.stash_drop(index)
        return entries

    def stash_drop(self, index: int | None = None) -> None:
        with self._changing() as refs:
            refs["stash"] = [] if index is None else refs["stash"][:index] + refs["stash"][index + 1 :]

    # Bisect

    def bisect(self, good: str, bad: str, test: Callable[[str], int]) -> str | None:
        """First bad state between two, by a test that gives 0 (good), 125 (skip) or else (bad)."""
        chain = [r["state"] for r in history.bisect_candidates(self.edges(), self._one(self.resolve(good)), self._one(self.resolve(bad))).orderBy("step").collect()]
        low, high, skipped = 0, len(chain) - 1, set()
        while low < high:
            some = [i for i in range(low, high) if i not in skipped]
            if not some:
                return None
            middle = min(some, key=lambda i: abs(i - (low + high) // 2))
            said = test(chain[middle])
            if said == 125:
                skipped.add(middle)
            elif said == 0:
                low = middle + 1
            else:
                high = middle
        return chain[low] if chain else None

    def bisect_start(self, bad: str, good: str) -> int:
        """Begin a kept search between two states; gives the number of candidates."""
        was = {"branch": b} if (b := self.refs()["head"].get("branch")) else {"state": self.head()}
        if self.refs()["work"].get("bisect"):
            raise RepoError("exists", "a bisect is under way")
        return self._bisect_kept({"head": was, "bad": self.resolve(bad), "good": self.resolve(good), "skipped": []})

    def _bisect_kept(self, work: dict) -> int:
        chain = self._between(work["good"], work["bad"])
        if not chain:
            raise RepoError("nothing", "no states lie between good and bad")
        with self._changing() as refs:
            refs["work"]["bisect"] = work
        return len(chain)

    def _between(self, good: str, bad: str) -> list[str]:
        return [r["state"] for r in history.bisect_candidates(self.edges(), self._one(good), self._one(bad)).orderBy("step").collect()]

    def _bisecting(self) -> dict:
        if not (work := self.refs()["work"].get("bisect")):
            raise RepoError("no_work", "no bisect is under way")
        return work

    def bisect_mark(self, verdict: str, name: str = "HEAD") -> str | None:
        """Mark a state good, bad or skip; gives the next to test, or None once ``bisect_found`` knows the first bad one."""
        work, state = self._bisecting(), self.resolve(name)
        if verdict == "skip":
            work["skipped"].append(state)
        elif verdict in ("good", "bad"):
            work[verdict] = state
        else:
            raise RepoError("bad_verdict", f"{verdict!r} is neither good, bad nor skip")
        self._bisect_kept(work)
        return self.bisect_next()

    def bisect_next(self) -> str | None:
        """The untested state nearest to the middle; the last candidate is known to be bad."""
        work = self._bisecting()
        chain = self._between(work["good"], work["bad"])[:-1]
        some = [i for i, s in enumerate(chain) if s not in work["skipped"]]
        return chain[min(some, key=lambda i: abs(i - len(chain) // 2))] if some else None

    def bisect_found(self) -> list[str]:
        """The states of which one is the first bad: one, if none was skipped before it."""
        work = self._bisecting()
        return self._between(work["good"], work["bad"])

    def bisect_reset(self, root: str | None = None) -> str:
        """End the search and go back to where it began."""
        head = self._bisecting()["head"]
        with self._changing() as refs:
            del refs["work"]["bisect"]
        return self.checkout(head.get("branch") or head["state"], root, force=True)

    # Upkeep

    def _tips(self) -> DataFrame:
        refs = self.refs()
        tips = {*refs["heads"].values(), *refs["tags"].values(), *refs["remotes"].values(), self.head(), *[s["base"] for s in refs["stash"]]}
        return self.spark.createDataFrame([(t,) for t in sorted(tips)], "state string")

    def _reachable(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        refs = self.refs()
        kept = self.table("states").select("state", "manifest").join(self.table("manifests"), "manifest").join(self.table("blobs").select("blob", F.octet_length("bytes").cast("long").alias("size")), "blob", "left").select("state", "path", "blob", "size")
        extra = [(e["blob"],) for e in refs["staging"].values() if e] + [(b,) for s in refs["stash"] for b, _ in s["files"].values() if b]
        states, blobs = integrity.reachable(self.edges(), self._tips(), kept, self.spark.createDataFrame(extra, "blob string"))
        return kept, states, blobs

    def gc(self, prune: bool = False, prune_history: bool = False) -> list[tuple[str, int, int]]:
        """(kind, items, bytes) that nothing reaches; staging and stashes count as roots.

        ``prune`` drops such blobs, ``prune_history`` such states with their edges and manifests.
        """
        kept, states, blobs = self._reachable()
        loose = self.table("blobs").join(blobs, "blob", "left_anti")
        dead = self.table("states").join(states, "state", "left_anti").where(F.col("state") != ROOT)
        sums = loose.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("bytes")), F.lit(0)).alias("b")).first()
        out = [("state", dead.count(), 0), ("blob", sums["n"], int(sums["b"]))]
        if prune:
            self._rewrite("blobs", self.table("blobs").join(blobs, "blob", "left_semi"))
        if prune_history and out[0][1]:
            held = history.cut(states.unionByName(self._one(ROOT)).distinct())
            kept_states = history.cut(self.table("states").join(held, "state", "left_semi"))
            self._rewrite("edges", self.edges().join(held.select(F.col("state").alias("child")), "child", "left_semi").select("child", "parent", "ord"))
            self._rewrite("manifests", self.table("manifests").join(kept_states.select("manifest").distinct(), "manifest", "left_semi").select("manifest", "path", "blob", "mode"))
            self._rewrite("states", kept_states.select(*[f.split()[0] for f in STATES.split(", ")]))
        return out

    def _rewrite(self, name: str, rows: DataFrame) -> None:
        """Replace a table; the new files are whole before the old ones go."""
        fresh, old = self.root / f"{name}.new", self.root / f"{name}.old"
        rows.write.mode("overwrite").option("compression", "zstd").parquet(str(fresh))
        (self.root / name).rename(old)
        fresh.rename(self.root / name)
        shutil.rmtree(old)
        self.spark.catalog.refreshByPath(str(self.root / name))

    def repack(self) -> int:
        """Write the blobs anew, sorted by id, in few files; gives their number."""
        self._rewrite("blobs", self.table("blobs").dropDuplicates(["blob"]).repartitionByRange("blob").sortWithinPartitions("blob"))
        return self.table("blobs").count()

    def fsck(self) -> list[tuple[str, str]]:
        """(kind, detail) of what is broken, ids recomputed."""
        refs = self.refs()
        states, entries = self.table("states"), self.table("manifests")
        named = [(k, v) for kind in ("heads", "tags", "remotes") for k, v in refs[kind].items()]
        kept = states.select("state", "manifest").join(entries, "manifest").select("state", "blob")
        empty = states.where(F.col("manifest") == manifest_id([])).select("state", F.lit(None).cast("string").alias("blob"))
        found = integrity.fsck(self.edges(), states.select("state"), kept.unionByName(empty).where("blob is not null"), self.table("blobs").select("blob"), self.spark.createDataFrame(named, "name string, state string"))
        out = [(r["kind"], r["detail"]) for r in found.where("kind <> 'missing_manifest'").collect()]
        lost = states.select("state", "manifest").where(F.col("manifest") != manifest_id([])).join(entries, "manifest", "left_anti").collect()
        out += [("missing_manifest", r["state"]) for r in lost]
        if "branch" in refs["head"] and refs["head"]["branch"] not in refs["heads"]:
            out.append(("head_branch", refs["head"]["branch"]))
        parents = self.edges().groupBy("child").agg(F.collect_list("parent").alias("parents"))
        rows = states.where(F.col("state") != ROOT).join(parents, states["state"] == parents["child"], "left")

        def wrong(batches):
            for pdf in batches:
                good = [commit_id(r.manifest, list(r.parents) if r.parents is not None else [], r.message, r.timestamp, r.author_name, r.author_email) == r.state for r in pdf.itertuples()]
                yield pdf[[not g for g in good]][["state"]]

        out += [("wrong_id", r["state"]) for r in rows.drop("child").mapInPandas(wrong, "state string").collect()]
        out += [("corrupt_blob", r["blob"]) for r in self._corrupt(self.table("blobs")).collect()]
        gone = [p for p, e in refs["staging"].items() if e is None]
        if gone:
            asked = self.spark.createDataFrame([(p,) for p in gone], "path string")
            out += [("staged_delete_of_unknown", r["path"]) for r in asked.join(self.manifest("HEAD"), "path", "left_anti").collect()] if not lost else []
        staged = self.spark.createDataFrame([(e["blob"],) for e in refs["staging"].values() if e], "blob string")
        out += [("staged_blob_missing", r["blob"]) for r in staged.distinct().join(self.table("blobs").select("blob"), "blob", "left_anti").collect()]
        out += [("orphan_temporary", p.name) for p in self.root.iterdir() if p.suffix in (".part", ".new", ".old")]
        return sorted(out)

    def _corrupt(self, blobs: DataFrame) -> DataFrame:
        """Blobs (blob, kind, bytes) whose canonical bytes don't hash to their id."""

        def wrong(batches):
            for pdf in batches:
                good = [hashlib.sha256(content_json(k, bytes(b))).hexdigest() == i for i, k, b in zip(pdf["blob"], pdf["kind"], pdf["bytes"], strict=True)]
                yield pdf[[not g for g in good]][["blob"]]

        return blobs.select("blob", "kind", "bytes").mapInPandas(wrong, "blob string")

    def prune_refs(self) -> list[str]:
        """Drop refs whose state isn't there."""
        there = {r["state"] for r in self.table("states").join(self._tips(), "state", "left_semi").select("state").collect()}
        gone = []
        with self._changing() as refs:
            for kind in ("heads", "tags", "remotes"):
                gone += [k for k, v in refs[kind].items() if v not in there]
                refs[kind] = {k: v for k, v in refs[kind].items() if v in there}
        return sorted(gone)

    # Other repositories

    def add_remote(self, name: str, root: str) -> None:
        with self._changing() as refs:
            refs["urls"][name] = root

    def remotes(self) -> dict[str, str]:
        return dict(sorted(self.refs()["urls"].items()))

    def remove_remote(self, name: str) -> None:
        """Forget a remote and what was fetched of its branches; states stay until they are collected."""
        with self._changing() as refs:
            if refs["urls"].pop(name, None) is None:
                raise RepoError("unknown_ref", f"no remote {name}")
            refs["remotes"] = {k: v for k, v in refs["remotes"].items() if not k.startswith(f"{name}/")}

    def fetch(self, name: str, depth: int | None = None) -> int:
        """Bring a remote's missing states, manifests, blobs, branches and tags; gives the number of states.

        With ``depth`` only so many states of each walk come, and where history stops is kept.
        """
        remote = Repo(self.spark, self.refs()["urls"][name])
        theirs = remote.refs()
        tips = self.spark.createDataFrame([(s,) for s in {*theirs["heads"].values(), *theirs["tags"].values()}], "state string")
        walked = history.closure(remote.edges(), tips)
        walked = walked.where(F.col("visit") < depth) if depth else walked
        missing = history.cut(walked.select("state").join(self.table("states").select("state"), "state", "left_anti"))
        count = missing.count()
        self._take(remote, missing)
        with self._changing() as refs:
            refs["remotes"] |= {f"{name}/{k}": v for k, v in theirs["heads"].items()}
            refs["tags"] = theirs["tags"] | refs["tags"]
            held = self.table("states").select("state")
            refs["shallow"] = [r["state"] for r in sync.shallow_boundaries(self.edges(), held).collect()]
        return count

    def _take(self, other: Repo, states: DataFrame) -> None:
        rows = history.cut(other.table("states").join(states, "state", "left_semi"))
        wanted = rows.select("manifest").distinct().join(self.table("states").select("manifest").distinct(), "manifest", "left_anti")
        entries = history.cut(other.table("manifests").join(wanted, "manifest", "left_semi"))
        self.import_blobs(other.table("blobs").join(entries.select("blob").distinct(), "blob", "left_semi"))
        self._append("manifests", entries)
        self._append("edges", other.edges().join(states.select(F.col("state").alias("child")), "child", "left_semi").select("child", "parent", "ord"))
        self._append("states", rows.select(*[f.split()[0] for f in STATES.split(", ")]))

    def push(self, name: str, branch: str) -> int:
        """Send a branch ahead; gives the number of states sent."""
        self._hook("pre_push", name, branch)
        remote = Repo(self.spark, self.refs()["urls"][name])
        tip, there = self.resolve(branch), remote.refs()["heads"].get(branch)
        if there and there != ROOT and not self.is_ancestor(there, tip):
            raise RepoError("not_ahead", f"{branch} of {name} has states that aren't here")
        missing = history.cut(sync.upload_set(self.edges(), self._one(tip), remote.table("states").select("state")))
        count = missing.count()
        remote._take(self, missing)
        with remote._changing() as refs:
            refs["heads"][branch] = tip
            refs["tags"] = refs["tags"] | self.refs()["tags"]
        return count

    @classmethod
    def clone(cls, spark: SparkSession, source: str, target: str, depth: int | None = None) -> Repo:
        """A new repository with all of another; nothing is left behind where that fails."""
        try:
            repo = cls.init(spark, target)
            repo.add_remote("origin", source)
            repo.fetch("origin", depth)
            theirs = Repo(spark, source).refs()
            with repo._changing() as refs:
                refs["heads"], refs["head"] = dict(theirs["heads"]), theirs["head"]
        except Exception:
            shutil.rmtree(target, ignore_errors=True)
            raise
        return repo


class MergeConflict(RepoError):
    """``conflicts``: (path, reason)."""

    def __init__(self, conflicts: list[tuple[str, str]]):
        super().__init__("conflict", "; ".join(f"{p}: {why}" for p, why in conflicts))
        self.conflicts = conflicts
