"""Import of one git commit's tree."""

from __future__ import annotations

import subprocess

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_MODES = {"100644": "regular", "100755": "executable", "120000": "symlink"}


def parse_tree_line(line: Column) -> dict:
    """mode, kind, object and path of a line of a tree listing, as expressions; nulls where it is malformed."""
    fits = line.rlike(r"^\d{6} \w+ [0-9a-f]{40,64}\t.+$")
    part = lambda i: F.when(fits, F.regexp_extract(line, r"^(\d{6}) (\w+) ([0-9a-f]+)\t(.+)$", i))
    return {"mode": part(1), "kind": part(2), "object": part(3), "path": part(4)}


def read_git(spark: SparkSession, repository: str, commit: str = "HEAD") -> DataFrame:
    """path, content, mode of a commit; submodules and unsafe paths are skipped."""
    run = lambda *a: subprocess.run(["git", "-C", repository, *a], check=True, capture_output=True).stdout
    lines = [(x,) for x in run("ls-tree", "-r", "-z", commit).decode().split("\0") if x]
    listed = spark.createDataFrame(lines, "line string")
    rows = listed.select(*[c.alias(k) for k, c in parse_tree_line(F.col("line")).items()]).where("kind = 'blob'")
    rows = rows.where(~F.array_contains(F.split("path", "/"), "..") & ~F.col("path").startswith("/"))
    mode = F.create_map(*[F.lit(x) for pair in _MODES.items() for x in pair])[F.col("mode")]

    def contents(batches):
        for pdf in batches:
            pdf["content"] = [subprocess.run(["git", "-C", repository, "cat-file", "blob", o], check=True, capture_output=True).stdout for o in pdf["object"]]
            yield pdf[["path", "content", "mode"]]

    return rows.withColumn("mode", mode).where("mode is not null").mapInPandas(contents, "path string, content binary, mode string")
