"""Views of changes: one row a file, computed where the texts are, and one HTML page of them for people."""

from __future__ import annotations

import html
import json

import pyarrow as pa
from pyspark.sql import DataFrame

from lamina.kernel.diff import compact, diff
from lamina.kernel.parse import parse_path
from lamina.kernel.textdiff import diff_text

VIEW = "path string, path_from string, mode string, intents array<string>, edits string"
_PAGE = "<!doctype html><meta charset=utf-8><title>{title}</title><style>body{{font:14px monospace}}del{{background:#fdd}}ins{{background:#dfd}}</style><h1>{title}</h1>{body}<script type=application/json id=data>{data}</script>"


def view(path: str, old: str | None, new: str | None, kinds: tuple[str | None, str | None] | None = None, start: str | None = None) -> dict:
    """What a page shows of one file: mode, intents, line edits.

    ``kinds`` of both contents (text, binary, symlink; None where a side lacks the file); by default a
    text where there is one. ``start``: the path that the file was renamed from.
    """
    kinds = kinds or tuple(None if t is None else "text" for t in (old, new))
    files = (None, None)
    if None in kinds:
        mode = "unchanged" if kinds[0] == kinds[1] else "added" if kinds[0] is None else "deleted"
    elif kinds[0] != kinds[1]:
        mode = "kind_changed"
    elif old == new and kinds[0] == "text":
        mode = "unchanged"
    elif kinds[0] != "text":
        mode = kinds[0]
    else:
        files = parse_path(path, old), parse_path(path, new)
        mode = "ast" if all(files) else "text"
    intents = compact(files[0], diff(*files)[0]) if mode == "ast" else []
    edits = [(e.op, e.line, e.content) for e in diff_text(old or "", new or "")] if mode != "unchanged" and "binary" not in kinds else []
    if start:
        mode, intents = "rename", [f"rename {start} to {path}", *intents]
    return {"path": path, "path_from": start, "mode": mode, "intents": intents, "edits": edits}


def views(rows: DataFrame) -> DataFrame:
    """The views of (path, from_path, old, new, old_kind, new_kind)."""
    columns = ("path", "from_path", "old", "new", "old_kind", "new_kind")

    def run(batches):
        for batch in batches:
            made = [view(path, old, new, (a, b), start) for path, start, old, new, a, b in zip(*(batch.column(c).to_pylist() for c in columns), strict=True)]
            out = [[v["path"] for v in made], [v["path_from"] for v in made], [v["mode"] for v in made], [v["intents"] for v in made], [json.dumps(v["edits"]) for v in made]]
            kinds = (pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=[f.split()[0] for f in VIEW.split(", ")])

    return rows.select(*columns).mapInArrow(run, VIEW)


def write_views(made: DataFrame, target: str, title: str = "changes") -> int:
    """Write views as a page, file by file in the order of paths: it is for people, and so of people's size."""
    found = [r.asDict() | {"edits": json.loads(r["edits"])} for r in made.orderBy("path").toLocalIterator()]
    tag = {"delete": "del", "insert": "ins"}
    body = "".join(f"<h2>{html.escape(v['path'])} ({v['mode']})</h2><ul>{''.join(f'<li>{html.escape(i)}</li>' for i in v['intents'])}</ul>" + "".join(f"<div><{tag[op]}>{line + 1} {html.escape(text)}</{tag[op]}></div>" for op, line, text in v["edits"]) for v in found)
    with open(target, "w", encoding="utf-8") as file:
        file.write(_PAGE.format(title=html.escape(title), body=body, data=json.dumps(found).replace("<", "\\u003c")))
    return len(found)


def write_html(pairs: DataFrame, target: str, title: str = "changes") -> int:
    """Write the views of (path, old, new) texts."""
    from pyspark.sql import functions as F

    kind = lambda c: F.when(F.col(c).isNotNull(), "text").alias(f"{c}_kind")
    return write_views(views(pairs.select("path", F.lit(None).cast("string").alias("from_path"), "old", "new", kind("old"), kind("new"))), target, title)
