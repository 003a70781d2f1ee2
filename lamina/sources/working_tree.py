"""Working trees as DataFrames, and states written back to disk."""

from __future__ import annotations

import fnmatch
import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folders that hold metadata, not content.
SKIPPED = (".git", ".lamina")
IGNORE_FILES = (".gitignore", ".laminaignore")
STAT = "path string, size long, mtime long, ctime long, mode string"


def _rules(folder: Path) -> list[tuple[str, bool]]:
    out = []
    for name in IGNORE_FILES:
        if (folder / name).is_file():
            for line in (folder / name).read_text(errors="replace").splitlines():
                if (rule := line.strip()) and not rule.startswith("#"):
                    out.append((rule.lstrip("!"), not rule.startswith("!")))
    return out


def _ignored(rules: list[tuple[str, bool]], path: str, folder: bool) -> bool:
    """The last rule that fits decides; a rule with a slash is anchored, one that ends in a slash is for folders."""
    out = False
    for rule, drop in rules:
        body = rule.rstrip("/")
        if rule.endswith("/") and not folder:
            continue
        name = path if "/" in body else path.rsplit("/", 1)[-1]
        if fnmatch.fnmatch(name, body.lstrip("/")):
            out = drop
    return out


def walk(root: str) -> list[tuple[str, int, int, int, str]]:
    """(path, size, mtime, ctime, mode) of all files, times in nanoseconds; symlinks are listed, not followed."""
    top, out = Path(root), []
    rules: dict[str, list[tuple[str, bool]]] = {}
    for folder, names, files in os.walk(top):
        rel = Path(folder).relative_to(top).as_posix()
        above = rules.get(Path(rel).parent.as_posix() if rel != "." else "", [])
        rules[rel] = above + _rules(Path(folder))
        own = "" if rel == "." else rel + "/"
        names[:] = sorted(n for n in names if n not in SKIPPED and not _ignored(rules[rel], own + n, True) and not os.path.islink(os.path.join(folder, n)))
        linked = [n for n in os.listdir(folder) if os.path.islink(os.path.join(folder, n)) and os.path.isdir(os.path.join(folder, n))]
        for name in sorted([*files, *linked]):
            if _ignored(rules[rel], own + name, False):
                continue
            stat = os.lstat(os.path.join(folder, name))
            mode = "symlink" if os.path.islink(os.path.join(folder, name)) else "executable" if stat.st_mode & 0o111 else "regular"
            out.append((own + name, stat.st_size, stat.st_mtime_ns, stat.st_ctime_ns, mode))
    return sorted(out)


def scan(spark: SparkSession, root: str) -> DataFrame:
    """path, size, mtime, ctime, mode; reads no content."""
    return spark.createDataFrame(walk(root), STAT)


def changed_since(now: DataFrame, before: DataFrame) -> DataFrame:
    """Files of a scan whose size, times or mode an earlier scan doesn't have: what must be read again."""
    return now.join(before, ["path", "size", "mtime", "ctime", "mode"], "left_anti")


def load(spark: SparkSession, root: str, only: set[str] | None = None) -> DataFrame:
    """path, content, mode of all files or of ``only`` some: contents by Spark's file reader, a symlink's content is its target.

    That reader passes over names that begin with a dot or an underscore; those are opened by the executors.
    """
    stats = [(s[0], s[-1]) for s in walk(root) if only is None or s[0] in only]
    links = [(p, bytearray(os.readlink(os.path.join(root, p)).encode()), m) for p, m in stats if m == "symlink"]
    hidden = [(p, m) for p, m in stats if m != "symlink" and any(x[0] in "._" for x in p.split("/"))]
    files = [(p, m) for p, m in stats if m != "symlink" and (p, m) not in set(hidden)]
    out = spark.createDataFrame(links, "path string, content binary, mode string")
    top = Path(root).resolve().as_posix()
    if hidden:

        def read(batches):
            for pdf in batches:
                pdf["content"] = [(Path(top) / p).read_bytes() for p in pdf["path"]]
                yield pdf[["path", "content", "mode"]]

        out = out.unionByName(spark.createDataFrame(hidden, "path string, mode string").mapInPandas(read, "path string, content binary, mode string"))
    if files:
        found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(top)
        plain = F.expr(f"substring(url_decode(replace(regexp_replace(path, '^file:/+', '/'), '+', '%2B')), {len(top) + 2})")
        named = found.select(plain.alias("path"), "content")
        out = named.join(spark.createDataFrame(files, "path string, mode string"), "path").select("path", "content", "mode").unionByName(out)
    return out


def materialize(files: DataFrame, root: str, known: list[str] = ()) -> int:
    """Write (path, content, mode) under ``root``; of ``known`` paths those not written are deleted."""
    top, written = Path(root), set()
    for row in files.select("path", "content", "mode").toLocalIterator():
        path = top / row["path"]
        if ".." in Path(row["path"]).parts or path.is_absolute() and Path(row["path"]).is_absolute():
            raise ValueError(f"unsafe path {row['path']}")
        path.parent.mkdir(parents=True, exist_ok=True)
        if path.is_symlink() or path.exists():
            path.unlink()
        if row["mode"] == "symlink":
            path.symlink_to(bytes(row["content"]).decode())
        else:
            temporary = path.with_name(path.name + ".part")
            temporary.write_bytes(bytes(row["content"]))
            temporary.chmod(0o755 if row["mode"] == "executable" else 0o644)
            temporary.replace(path)
        written.add(row["path"])
    for path in set(known) - written:
        (top / path).unlink(missing_ok=True)
    return len(written)
