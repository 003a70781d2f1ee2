"""Content ids as Column expressions; each equals the identity rule bit for bit."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

def nul() -> Column:
    return F.lit(b"\x00")


#: Id of the root state, which no content has.
ROOT = "0" * 64


def text_hash(text: Column) -> Column:
    """Lower-case hex SHA-256 of a string's UTF-8 or of bytes."""
    return F.sha2(text.cast("binary"), 256)


def node_hash(kind: Column, payload: Column, children: Column | None = None) -> Column:
    """Id of a node: kind, nul(), payload, nul(), then the children's raw digests.

    ``children``: an array of hex ids.
    """
    parts = [kind.cast("binary"), nul(), payload.cast("binary"), nul()]
    if children is not None:
        parts.append(F.unhex(F.array_join(children, "")))
    return F.sha2(F.concat(*parts), 256)


def manifest_entry(path: Column, blob: Column, mode: Column) -> Column:
    """Bytes of one manifest entry, in hex; the mode counts only where it isn't regular."""
    plain = F.concat(path.cast("binary"), nul(), blob.cast("binary"))
    return F.hex(F.when(mode == "regular", plain).otherwise(F.concat(plain, nul(), mode.cast("binary"))))


def manifest_hash(entries: Column) -> Column:
    """Id of a manifest from an array of (path bytes, entry hex); entries are put in order of path bytes."""
    ordered = F.sort_array(entries)
    return F.sha2(F.unhex(F.array_join(F.transform(ordered, lambda e: e[entries_field(1)]), "")), 256)


def entries_field(i: int) -> str:
    return ("p", "e")[i]


def commit_hash(manifest: Column, parents: Column, message: Column, timestamp: Column, name: Column, email: Column) -> Column:
    """Id of a commit; parents count in sorted order, whatever order they are kept in."""
    said = F.transform(F.array_sort(parents), lambda p: F.concat(F.hex(p.cast("binary")), F.lit("00")))
    head = F.concat(F.hex(manifest.cast("binary")), F.lit("00"), F.array_join(said, ""))
    tail = [F.hex(c.cast("binary")) for c in (message, timestamp, name, email)]
    return F.sha2(F.unhex(F.concat(head, F.concat_ws("00", *tail))), 256)


def short_id(state: Column, length: int = 12) -> Column:
    return F.substring(state, 1, length)


def is_state_id(value: Column) -> Column:
    return value.rlike("^[0-9a-fA-F]{64}$")
