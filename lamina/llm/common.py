"""Helpers shared by the training-data operators: tables, lineage cuts and vectorised text work."""

from __future__ import annotations

import gc
import re
import tempfile

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Bytes of a batch that goes to Python.
ARROW_BYTES = 8 << 20
_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Bytes of a checkpoint that one task reads, where its parts are smaller.
READ_BYTES = 1 << 20
#: Bytes of text worked on at once, so that the eight-byte temporaries stay small.
SLICE = 1 << 20

_FACTOR = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the reliable checkpoint folder and read it from there.

    The folder is the cluster's ``spark.checkpoint.dir``; only where none is set and all runs on one
    machine (tests, a laptop) a temporary one takes its place. Spark removes checkpoints that are no
    longer used where ``spark.cleaner.referenceTracking.cleanCheckpoints`` says so.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        shared = context.getConf().get("spark.checkpoint.dir")
        if not shared and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="lamina-"))
    return df.checkpoint(eager=True)


def gathered(df: DataFrame) -> DataFrame:
    """``cut(df)``, and small parts of it are read together, about ``READ_BYTES`` in a task: what a small table
    leaves in many partitions is no task each. A table of larger parts is read as it was written."""
    held = cut(df)
    parts = held._jdf.queryExecution().logical().rdd()
    path = held.sparkSession._jvm.org.apache.hadoop.fs.Path(parts.getCheckpointFile().get())
    size = path.getFileSystem(held.sparkSession.sparkContext._jsc.hadoopConfiguration()).getContentSummary(path).getLength()
    tasks = size // READ_BYTES + 1
    return held.coalesce(tasks) if tasks < parts.getNumPartitions() else held


def lean(docs: DataFrame) -> DataFrame:
    """``docs``, once the session hands texts to Python in batches of ``ARROW_BYTES`` at most: however long
    they are, a task holds few of them at once. A smaller setting stays."""
    conf = docs.sparkSession.conf
    size, unit = re.fullmatch(r"(-?\d+)\s*([kmg]?)b?", conf.get(_BYTES).lower()).groups()
    now = int(size) << {"": 0, "k": 10, "m": 20, "g": 30}[unit]
    if now <= 0 or now > ARROW_BYTES:
        conf.set(_BYTES, str(ARROW_BYTES))
    return docs


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def swept(spark: SparkSession) -> None:
    """Let Spark drop the shuffles and checkpoints of earlier rounds: it does so once the driver's JVM has
    found that nothing refers to them any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def width(docs: DataFrame) -> int:
    """Partitions for a shuffle of ``docs``: as many as are read, so that what one task holds does not grow
    with the table."""
    return max(docs.sparkSession.sparkContext.defaultParallelism, docs.rdd.getNumPartitions())


def binary(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and offsets of an Arrow string column; a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), offsets


def slices(data: np.ndarray, offsets: np.ndarray, most: int = SLICE):
    """Runs of whole rows of about ``most`` bytes: (first row, bytes, offsets from 0)."""
    first, rows = 0, len(offsets) - 1
    while first < rows:
        last = int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1
        last = min(max(last, first + 1), rows)
        low = offsets[first]
        yield first, data[low : offsets[last]], (offsets[first : last + 1] - low).astype(np.int64)
        first = last


def byte_set(*ranges: tuple[int, int]) -> np.ndarray:
    """A table of 256 booleans that is false for the bytes of the given ranges."""
    table = np.ones(256, bool)
    for low, high in ranges:
        table[low : high + 1] = False
    return table


#: Bytes of words between white space (space, tab to carriage return).
SPACED = byte_set((0x20, 0x20), (0x09, 0x0D))
#: Bytes of lower-cased letters, digits and everything beyond ASCII.
LETTERED = byte_set((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))
#: A-Z lower-cased, all else as it is.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_SYMBOLS = np.array([int.from_bytes(__import__("hashlib").blake2b(bytes([i]), digest_size=8).digest(), "little") for i in range(256)], np.uint64)


class _Powers:
    """Powers of an odd number and of its inverse modulo 2**64, as far as they were needed."""

    up = np.ones(1, np.uint64)
    down = np.ones(1, np.uint64)

    @classmethod
    def upto(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = max(n, SLICE + 1024)
            for name, base in (("up", _FACTOR), ("down", pow(_FACTOR, -1, 1 << 64))):
                powers = np.full(size, base, np.uint64)
                powers[0] = 1
                setattr(cls, name, np.cumprod(powers, dtype=np.uint64))
        return cls.up[:n], cls.down[:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def spans(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words as (start, end) in bytes, and for each row the index of its first word (plus the total)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = table[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    begin = inside.copy()
    begin[1:] &= ~inside[:-1] | edge[1:-1]
    end = inside.copy()
    end[:-1] &= ~inside[1:] | edge[1:-1]
    start, stop = np.flatnonzero(begin), np.flatnonzero(end) + 1
    return start, stop, np.searchsorted(start, offsets)


def word_hashes(data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """64-bit hashes of the given spans of bytes, all at once from one running sum."""
    up, down = _Powers.upto(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_SYMBOLS[data] * up[: len(data)], out=total[1:])
    return mixed((total[stop] - total[start]) * down[start] + (stop - start).astype(np.uint64))


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the windows of ``n`` consecutive words, ``len(words) - n + 1`` of them (or none)."""
    count = len(words) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    out = words[:count].copy()
    for i in range(1, n):
        out *= np.uint64(_FACTOR)
        out += words[i : i + count]
    return mixed(out)


def appended(batch: pa.RecordBatch, columns: dict[str, pa.Array]) -> pa.RecordBatch:
    """The batch with columns added; one of the same name gives way."""
    kept = [n for n in batch.schema.names if n not in columns]
    return pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(n)) for n in kept] + list(columns.values()), names=kept + list(columns))


