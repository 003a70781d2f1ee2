"""Best-fit packing by hierarchical residual merging.

A partition packs its own pieces best-fit (longest first). Bins within ``SLACK`` tokens of full are
done; the others become items of the next round, dealt into fewer and fewer groups of bounded size
and packed best-fit again, until one group is left or a round no longer helps. Only lengths move:
a bin is a row of its id and fill, and a piece's place is its offset plus its bins' bases.

Null or empty texts are one piece, the end id. Equal rows are packed each for itself. Ties in
length keep the order of arrival, then of bin ids.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.llm import tokens
from lamina.llm.common import cut, lean

#: Tokens of a sequence, and the id that ends a document.
SIZE, END = 2048, 0
#: Bins with at most so many free tokens are nearly full and leave the rounds.
SLACK = 4
#: Items of one best-fit run at most.
GROUP = 32_768
#: Groups merged into one from round to round.
FAN_IN = 8
ROUNDS = 8

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, bin long, place long"


def best_fit(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each item: longest first, each into the fullest bin that still takes it."""
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    free: dict[int, list[int]] = {}
    open_sizes = made = 0  # a bit for each free size that some bin has
    for i in np.argsort(-lengths, kind="stable").tolist():
        length = int(lengths[i])
        fits = open_sizes >> length
        if length and fits:
            room = length + (fits & -fits).bit_length() - 1
            at = free[room].pop()
            if not free[room]:
                open_sizes &= ~(1 << room)
        else:
            at, room = made, size
            made += 1
        bins[i], offsets[i] = at, size - room
        if left := room - length:
            free.setdefault(left, []).append(at)
            open_sizes |= 1 << left
    return bins, offsets


def pieces_of(docs: DataFrame, vocabulary: str, size: int = SIZE, end: int = END) -> DataFrame:
    """Pieces of all documents, already packed within each partition."""

    def run(batches):
        head = TaskContext.get().partitionId() << 36
        made = 0
        rows: list[tuple] = []

        def packed():
            nonlocal made, rows
            columns = [np.array(c, np.int64) for c in zip(*rows, strict=True)]
            at, place = best_fit(columns[3], size)
            names = ("doc_id", "piece", "start", "length", "ids_crc32")
            arrays = [pa.array(c, pa.int32() if n == "piece" else pa.int64()) for n, c in zip(names, columns, strict=False)]
            if columns[5].any():
                arrays[0] = pa.array(columns[0], pa.int64(), mask=columns[5].astype(bool))
            out = pa.RecordBatch.from_arrays([*arrays, pa.array(at + (head + made)), pa.array(place)], names=[*names, "bin", "place"])
            made += int(at.max()) + 1
            rows = []
            return out

        for batch in tokens.kept(batches):
            ids = batch.column("doc_id").to_pylist()
            for doc_id, found in zip(ids, tokens.arrays(batch.column("text"), vocabulary), strict=True):
                whole = np.append(found, np.uint32(end)).astype("<u4")
                first = len(whole) % size or size
                flat, cuts = whole.tobytes(), [0, *range(first, len(whole) + 1, size)]
                for k in range(len(cuts) - 1):
                    rows.append((doc_id or 0, k, cuts[k], cuts[k + 1] - cuts[k], zlib.crc32(flat[4 * cuts[k] : 4 * cuts[k + 1]]), doc_id is None))
                if len(rows) >= GROUP:
                    yield packed()
        if rows:
            yield packed()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, PIECES)


def _merged(items: DataFrame, groups: int, turn: int, size: int) -> DataFrame:
    """One round: (bin, into, base) of every item, the new bins' ids unlike all earlier ones."""

    def run(batches):
        head = ((turn + 1) << 56) + (TaskContext.get().partitionId() << 36)
        made, ids, fills = 0, [], []

        def packed():
            nonlocal made, ids, fills
            name, fill = np.concatenate(ids), np.concatenate(fills)
            at, base = best_fit(fill, size)
            out = pa.RecordBatch.from_arrays([pa.array(name), pa.array(at + (head + made)), pa.array(base)], names=["bin", "into", "base"])
            made += int(at.max()) + 1
            ids, fills = [], []
            return out

        for batch in batches:
            ids.append(batch.column("bin").to_numpy())
            fills.append(batch.column("fill").to_numpy())
            if sum(map(len, ids)) >= 2 * GROUP:
                yield packed()
        if ids and sum(map(len, ids)):
            yield packed()

    dealt = items.repartition(groups, F.xxhash64("bin", F.lit(turn))).sortWithinPartitions(F.desc("fill"), "bin")
    return dealt.mapInArrow(run, "bin long, into long, base long")


def pack(docs: DataFrame, vocabulary: str, size: int = SIZE, end: int = END, slack: int = SLACK) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: one row a piece."""
    pieces = cut(pieces_of(lean(docs), vocabulary, size, end))
    fills = pieces.groupBy("bin").agg(F.sum("length").alias("fill")).where(F.col("fill") < size - slack)
    places, groups = None, 0
    for turn in range(ROUNDS):
        items = cut(fills)
        n = items.count()
        least = -(-n // GROUP)
        groups = max(least, groups // FAN_IN) if turn else max(least, -(-n // (GROUP // 8)))
        if n < 2:
            break
        step = cut(_merged(items, max(1, groups), turn, size))
        if places is None:
            places = step.withColumnRenamed("into", "sequence")
        else:
            now = step.select(F.col("bin").alias("sequence"), "into", F.col("base").alias("more"))
            places = places.join(now, "sequence", "left").select("bin", F.coalesce("into", "sequence").alias("sequence"), (F.col("base") + F.coalesce("more", F.lit(0))).alias("base"))
        fills = step.join(items, "bin").groupBy(F.col("into").alias("bin")).agg(F.sum("fill").alias("fill")).where(F.col("fill") < size - slack)
        left = step.select("into").distinct().count()
        if groups <= 1 or left > 0.995 * n:
            break
    out = pieces
    if places is not None:
        out = pieces.join(places, "bin", "left").withColumns({"place": F.col("place") + F.coalesce("base", F.lit(0)), "bin": F.coalesce("sequence", "bin")})
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", F.col("bin").alias("sequence_id"), F.col("place").alias("offset"))
