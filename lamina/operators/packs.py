"""Packs: blobs stored whole or as what differs from a neighbour, whichever is smaller when compressed.

A delta keeps the length of the common beginning and end and the bytes in between. Only every second
blob of a shard may be a delta, of the one before it in the order of ids, which is whole: reading a blob
back takes one other blob at most, and so one join.
"""

from __future__ import annotations

import struct

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Fixed value: compression level of packed blobs.
LEVEL = 3
PACKED = "blob string, base string, encoding string, size long, body binary"


def build_delta(base: bytes, target: bytes) -> bytes:
    """Lengths of the common beginning and end, and the bytes of ``target`` in between."""
    most = min(len(base), len(target))
    head = _common(base, target, most)
    tail = _common(base[head:][::-1], target[head:][::-1], most - head)
    return struct.pack("<QQ", head, tail) + target[head : len(target) - tail]


def _common(a: bytes, b: bytes, most: int) -> int:
    """Length of the common beginning, by halving."""
    low, high = 0, most
    while low < high:
        middle = (low + high + 1) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low


def apply_delta(base: bytes, delta: bytes) -> bytes:
    head, tail = struct.unpack_from("<QQ", delta)
    if head + tail > len(base):
        raise ValueError("the delta is of another base")
    return base[:head] + delta[16:] + (base[len(base) - tail :] if tail else b"")


def pack(blobs: DataFrame) -> DataFrame:
    """blob, base, encoding (zstd or delta), size (of the content) and body of distinct (blob, bytes).

    Neighbours are those of groups of four leading digits; no task sorts a whole shard.
    """
    once = blobs.select("blob", F.col("bytes").cast("binary").alias("bytes")).dropDuplicates(["blob"])
    order = W.partitionBy(F.substring("blob", 1, 4)).orderBy("blob")
    placed = once.select("blob", (F.row_number().over(order) % 2 == 0).alias("second"), F.lag("blob").over(order).alias("before"))
    pairs = placed.where("second").select("blob", F.col("before").alias("base"))
    whole = once.select(F.col("blob").alias("base"), F.col("bytes").alias("base_bytes"))
    rows = once.join(pairs, "blob", "left").join(whole, "base", "left").select("blob", "base", "bytes", "base_bytes")

    def run(batches):
        press = zstandard.ZstdCompressor(level=LEVEL).compress
        for batch in batches:
            out: list[tuple] = []
            for blob, base, content, other in zip(*(batch.column(c).to_pylist() for c in ("blob", "base", "bytes", "base_bytes")), strict=True):
                body, kind, of = press(content), "zstd", None
                if base is not None:
                    delta = press(build_delta(other, content))
                    if len(delta) < len(body):
                        body, kind, of = delta, "delta", base
                out.append((blob, of, kind, len(content), body))
            columns = list(zip(*out, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.string(), pa.string(), pa.int64(), pa.binary()), strict=True)], names=[f.split()[0] for f in PACKED.split(", ")])

    return rows.mapInArrow(run, PACKED)


def unpack(packed: DataFrame) -> DataFrame:
    """blob and bytes of all packed blobs."""
    bases = packed.where("encoding = 'zstd'").select(F.col("blob").alias("base"), F.col("body").alias("base_body"))
    rows = packed.select("blob", "base", "encoding", "body").join(bases, "base", "left")

    def run(batches):
        for batch in batches:
            out = []
            for kind, body, other in zip(*(batch.column(c).to_pylist() for c in ("encoding", "body", "base_body")), strict=True):
                plain = zstandard.ZstdDecompressor().decompress(body)
                if kind == "delta":
                    if other is None:
                        raise ValueError("a delta's base is missing")
                    plain = apply_delta(zstandard.ZstdDecompressor().decompress(other), plain)
                out.append(plain)
            yield pa.RecordBatch.from_arrays([batch.column("blob"), pa.array(out, pa.binary())], names=["blob", "bytes"])

    return rows.select("blob", "encoding", "body", "base_body").mapInArrow(run, "blob string, bytes binary")


def verified(blobs: DataFrame) -> DataFrame:
    """blob, size and whether the bytes hash to the id."""
    return blobs.select("blob", F.octet_length("bytes").cast("long").alias("size"), (F.sha2("bytes", 256) == F.col("blob")).alias("same"))
