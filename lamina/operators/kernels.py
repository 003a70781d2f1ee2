"""Per-file kernels over DataFrames, as Arrow-batched maps.

Rows whose blob ids already settle the outcome never reach a kernel; equal pairs or triples of
blobs are computed once and joined back. Short texts of one form share a run of a structural kernel
(``kernel.forms``).
"""

from __future__ import annotations

from hashlib import blake2b
from os.path import splitext

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.functions.paths import language_of
from lamina.kernel import diff as _diff
from lamina.kernel import forms
from lamina.kernel import merge as _merge
from lamina.kernel import textdiff as _text
from lamina.kernel.graph import Graph, apply
from lamina.kernel.parse import parse_path

#: Characters of a new file that a description shows.
PREVIEW = 200
EDITS = "path string, seq int, op string, line int, content string"
MUTATIONS = "path string, seq int, op string, intent string, node string, parent string, before int, payload string"
ALIGNED = "path string, old_id string, new_id string, kind string, method string, parent_old string, parent_new string"
MERGED = "path string, clean boolean, text string, message string, overlaps array<string>"
NODES = "path string, id string, kind string, payload string, children array<string>"

_ARROW = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}


def _mapped(rows: DataFrame, columns: tuple[str, ...], schema: str, kernel) -> DataFrame:
    """``kernel(*row)`` yields result tuples; texts of null count as empty.

    Kernels take far longer than moving their rows, so these are first spread evenly.
    """
    fields = [f.split(" ", 1) for f in schema.split(", ")]

    def run(batches):
        for batch in batches:
            given = [["" if v is None else v for v in batch.column(c).to_pylist()] for c in columns]
            out = [r for row in zip(*given, strict=True) for r in kernel(*row)]
            made = zip(*out, strict=True) if out else [()] * len(fields)
            yield pa.RecordBatch.from_arrays([pa.array(c, _ARROW[kind]) for c, (_, kind) in zip(made, fields, strict=True)], names=[n for n, _ in fields])

    return _spread(rows, columns).mapInArrow(run, schema)


def _spread(rows: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    spark = rows.sparkSession
    spread = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return rows.select(*columns).repartition(spread, columns[0])


def _named(files) -> dict[str, object]:
    """The nodes of some trees by id."""
    return {n.id: n for file in files for n in file.root.walk()}


def text_diff(pairs: DataFrame) -> DataFrame:
    """Line edits of (path, old, new); unchanged rows are left out before the kernel."""
    changed = pairs.where("not (old <=> new)")
    return _mapped(changed, ("path", "old", "new"), EDITS, lambda path, old, new: [(path, i, e.op, e.line, e.content) for i, e in enumerate(_text.diff_text(old, new))])


def text_merge(triples: DataFrame, compat: bool = False) -> DataFrame:
    """Line merge of (path, base, left, right): path, clean, text, message, overlaps."""

    def kernel(path, base, left, right):
        text, line = _text.merge_text(base, left, right, compat)
        return [(path, text is not None, text, "" if line is None else f"line {line}", [])]

    return _mapped(triples, ("path", "base", "left", "right"), MERGED, kernel)


def merge_files(triples: DataFrame) -> DataFrame:
    """Structural merge where the path has a language and all sides parse, line merge elsewhere."""

    def outcome(files):
        if not all(files):
            return None
        merged = _merge.merge_trees(*files)
        return forms.said(merged.text) if merged.clean else None, merged.message, [forms.said(" / ".join(o)) for o in merged.overlaps]

    def kernel(path, base, left, right):
        language = language_of(path)
        if language and len({base, left, right}) == 3 and (found := forms.once("merge", language, (base, left, right), outcome)):
            (text, message, overlaps), words = found
            if text is None:
                return [(path, False, None, message, [o(words) for o in overlaps])]
            if forms.parses(language, merged := text(words)):
                return [(path, True, merged, "", [])]
        merged = _merge.merge_files(path, base, left, right)
        return [(path, merged.clean, merged.text, merged.message, [" / ".join(o) for o in merged.overlaps])]

    settled = F.when(F.col("left").eqNullSafe(F.col("right")) | F.col("right").eqNullSafe(F.col("base")), F.col("left")).when(F.col("left").eqNullSafe(F.col("base")), F.col("right"))
    plain = F.coalesce(F.expr("left <=> right or right <=> base or left <=> base"), F.lit(False))
    done = triples.where(plain).select("path", F.lit(True).alias("clean"), F.coalesce(settled, F.lit("")).alias("text"), F.lit("").alias("message"), F.array().cast("array<string>").alias("overlaps"))
    return _mapped(triples.where(~plain), ("path", "base", "left", "right"), MERGED, kernel).unionByName(done)


def structural_diff(pairs: DataFrame, parents: bool = True) -> DataFrame:
    """Mutations with intents of (path, old, new) where both sides parse; without ``parents`` that column is left out."""

    def outcome(files):
        if not all(files):
            return ()
        made, named = _diff.diff(*files)[0], _named(files)
        ids = [i for m in made for i in ((m.node, m.parent) if parents else (m.node,)) if i]
        ids = list(dict.fromkeys(ids))
        at = {i: k for k, i in enumerate(ids)} | {"": -1}
        told = [(i, m.op, _diff.intent(files[0], m), at[m.node], at[m.parent] if parents else -1, m.before, forms.said(m.payload)) for i, m in enumerate(made)]
        return told, forms.digests([named[i] for i in ids])

    def kernel(path, old, new):
        language = language_of(path)
        if language is None:
            return
        if found := forms.once(f"diff {parents}", language, (old, new), outcome):
            if not found[0]:
                return
            (told, digests), words = found
            ids = [d.hex() for d in digests(words)] + [""]
            for i, op, intent, node, parent, before, payload in told:
                yield (path, i, op, intent, ids[node], *[ids[parent]] * parents, before, payload(words))
            return
        files = parse_path(path, old), parse_path(path, new)
        if not all(files):
            return
        for i, m in enumerate(_diff.diff(*files)[0]):
            yield (path, i, m.op, _diff.intent(files[0], m), m.node, *[m.parent] * parents, m.before, m.payload)

    schema = MUTATIONS if parents else MUTATIONS.replace("parent string, ", "")
    return _mapped(pairs.where("not (old <=> new)"), ("path", "old", "new"), schema, kernel)


def described(rows: DataFrame) -> DataFrame:
    """path, from_path, change and lines for people, of (path, from_path, change, old, new).

    Intents where both sides parse, line edits elsewhere; the beginning of what is new.
    """

    def kernel(path, start, change, old, new):
        if change == "added":
            lines = [new[:PREVIEW] + "..." * (len(new) > PREVIEW)]
        elif change == "removed":
            lines = []
        else:
            lines = _merge.file_intents(path, old, new)
            if lines is None:
                parsed = ["ast" if parse_path(path, t) else "text" for t in (old, new)] if language_of(path) else []
                lines = [f"parse mode: {parsed[0]} (left), {parsed[1]} (right)"] if parsed else []
                lines += [f"{'-' if e.op == 'delete' else '+'}{e.line + 1} {e.content}" for e in _text.diff_text(old, new)]
        yield path, start or None, change, lines

    return _mapped(rows, ("path", "from_path", "change", "old", "new"), "path string, from_path string, change string, lines array<string>", kernel)


def applied_diff(pairs: DataFrame) -> DataFrame:
    """path and text: the old side of (path, old, new) with the mutations that lead to the new one applied."""

    def outcome(files):
        return (forms.said(apply(files[0], _diff.diff(*files)[0]).text()) if all(files) else None,)

    def kernel(path, old, new):
        language = language_of(path)
        if language is None:
            return
        if found := forms.once("apply", language, (old, new), outcome):
            (text,), words = found
            if text:
                yield path, text(words)
            return
        files = parse_path(path, old), parse_path(path, new)
        if all(files):
            yield path, apply(files[0], _diff.diff(*files)[0]).text()

    return _mapped(pairs, ("path", "old", "new"), "path string, text string", kernel)


def _outline(root) -> str:
    """Kinds of a tree's nodes without payloads and child order: equal where a diff neither inserts nor deletes."""
    keys: dict[int, str] = {}
    for node in reversed(list(root.walk())):
        keys[id(node)] = blake2b("\0".join([node.kind, *sorted(keys[id(c)] for c in node.children)]).encode(), digest_size=16).hexdigest()
    return keys[id(root)]


def edited_renames(removed: DataFrame, added: DataFrame) -> DataFrame:
    """from_path, to_path of removed and added (path, text) of one extension that differ by edits and moves only.

    A greedy walk of sorted removed paths over sorted added ones. Only files of one outline can pair,
    so each outline is walked by itself; a structural diff decides.
    """

    def outlined(path, text):
        if file := parse_path(path, text):
            yield path, splitext(path)[1], _outline(file.root), text

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("path")
        gone, come = (pdf[pdf["side"] == s] for s in ("removed", "added"))
        out = []
        if len(gone) and len(come):
            free = {p: parse_path(p, t) for p, t in zip(come["path"], come["text"], strict=True)}
            for path, text in zip(gone["path"], gone["text"], strict=True):
                file = parse_path(path, text)
                to = next((p for p, new in free.items() if not any(m.op in ("insert_subtree", "delete_subtree") for m in _diff.diff(file, new)[0])), None)
                if to is not None:
                    del free[to]
                    out.append((path, to))
        return pd.DataFrame(out, columns=["from_path", "to_path"])

    schema = "path string, extension string, outline string, text string"
    sides = [_mapped(df, ("path", "text"), schema, outlined).withColumn("side", F.lit(s)) for df, s in ((removed, "removed"), (added, "added"))]
    return sides[0].unionByName(sides[1]).groupBy("extension", "outline").applyInPandas(run, "from_path string, to_path string")


#: Rows whose alignment makes one batch.
ALIGNED_ROWS = 1000
_HEX = np.frombuffer("".join(f"{i:02x}" for i in range(256)).encode(), dtype=np.uint16)


def _hex(digests: list[bytes]) -> pa.Array:
    """Hashes of 32 bytes as strings."""
    data = _HEX[np.frombuffer(b"".join(digests), dtype=np.uint8)]
    return pa.StringArray.from_buffers(len(digests), pa.py_buffer(np.arange(0, 64 * len(digests) + 1, 64, dtype=np.int32)), pa.py_buffer(data))


def alignment(pairs: DataFrame) -> DataFrame:
    """Which node of the old side became which of the new one, and by which pass."""
    sides, names = ("old_id", "new_id", "parent_old", "parent_new"), [f.split(" ")[0] for f in ALIGNED.split(", ")]

    def outcome(files):
        """Places of each edge's ids among the hashes, what doesn't vary, and the hashes."""
        if not all(files):
            return ()
        edges, named = _diff.diff(*files, detailed=True)[1], _named(files)
        at = {i: k for k, i in enumerate(dict.fromkeys(e[s] for e in edges for s in sides))}
        places = {s: np.array([at[e[s]] for e in edges], dtype=np.int64) for s in sides}
        fixed = {c: pa.array([e[c] for e in edges], pa.string()) for c in ("kind", "method")}
        return places, fixed, forms.digests([named[i] for i in at])

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, ALIGNED_ROWS):
                yield from aligned(batch.slice(start, ALIGNED_ROWS))

    def aligned(batch):
        paths = pa.array(["" if p is None else p for p in batch.column("path").to_pylist()], pa.string())
        texts = [["" if t is None else t for t in batch.column(c).to_pylist()] for c in ("old", "new")]
        hashes, alike, alone = [], {}, []
        for row, (path, old, new) in enumerate(zip(paths.to_pylist(), *texts, strict=True)):
            language = language_of(path)
            if language is None:
                continue
            if found := forms.once("align", language, (old, new), outcome):
                if found[0]:
                    alike.setdefault(id(found[0]), (found[0], [], []))
                    _, rows, begins = alike[id(found[0])]
                    rows.append(row)
                    begins.append(len(hashes))
                    hashes += found[0][2](found[1])
                continue
            files = parse_path(path, old), parse_path(path, new)
            if all(files):
                alone += [(path, *[e[c] for c in names[1:]]) for e in _diff.diff(*files, detailed=True)[1]]
        if alone:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*alone, strict=True)], names=names)
        ids = _hex(hashes)
        for (places, fixed, _), rows, begins in alike.values():
            n = len(places["old_id"])
            made = {"path": paths.take(pa.array(np.repeat(rows, n)))}
            made |= {c: ids.take(pa.array((np.array(begins)[:, None] + at).ravel())) for c, at in places.items()}
            made |= {c: v.take(pa.array(np.tile(np.arange(n), len(rows)))) for c, v in fixed.items()}
            yield pa.RecordBatch.from_arrays([made[c] for c in names], names=names)

    return _spread(pairs, ("path", "old", "new")).mapInArrow(run, ALIGNED)


def syntax_nodes(files: DataFrame) -> DataFrame:
    """Distinct nodes of each (path, text) that parses."""

    def kernel(path, text):
        if file := parse_path(path, text):
            for i, (kind, payload, children) in sorted(Graph.of(file).nodes.items()):
                yield path, i, kind, payload, list(children)

    return _mapped(files, ("path", "text"), NODES, kernel)


def round_trip(files: DataFrame) -> DataFrame:
    """path, parsed, same: whether a text parses, and comes back unchanged from its stored graph."""

    def kernel(path, text):
        file = parse_path(path, text)
        yield path, file is not None, file is None or Graph.restore(Graph.of(file).snapshot()).tree().text() == text

    return _mapped(files, ("path", "text"), "path string, parsed boolean, same boolean", kernel)


def blame(versions: DataFrame) -> DataFrame:
    """path, line, state, content of the last version of each path: rows (path, seq, state, text).

    A path's versions meet in one group: its own linear history, however many paths there are.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["seq", "state"])
        found = _text.blame([(s, t or "") for s, t in zip(pdf["state"], pdf["text"], strict=True)])
        return pd.DataFrame([(pdf["path"].iloc[0], *row) for row in found], columns=["path", "line", "state", "content"])

    return versions.select("path", "seq", "state", "text").groupBy("path").applyInPandas(run, "path string, line int, state long, content string")


def once(rows: DataFrame, keys: tuple[str, ...], operator, *columns: str) -> DataFrame:
    """Run a kernel operator once for each distinct set of ``keys`` and give each row its result."""
    named = rows.withColumn("__key", F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.sha2(F.col(k), 256), F.lit("")) for k in keys]), 256))
    distinct = named.dropDuplicates(["__key"])
    done = operator(distinct.withColumn("__path", F.col("path")))
    return named.select("path", "__key").join(distinct.select(F.col("path").alias("__first"), "__key"), "__key").join(done.withColumnRenamed("path", "__first"), "__first").select("path", *columns)
