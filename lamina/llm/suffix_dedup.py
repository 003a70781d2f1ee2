"""Repeated byte strings across documents, by interval expansion on Burrows-Wheeler transforms.

A byte goes when a string of ``LENGTH`` bytes that covers it also starts in a document with a smaller
doc_id. The work is dealt in three narrowing steps, each exact for what it passes on:

1. Content-defined chunks. A chunk is judged with the ``LENGTH - 1`` bytes after it, so that it owns
   every string that starts in it. Of equal chunks only that of the smallest doc_id goes on; in
   all other documents the chunk's strings are repeats already.
2. Minimizers. Every string has one: the least hash of its ``GRAM``-byte grams. Strings that occur
   in two documents share it, so only minimizers seen in two documents go on.
3. Segments, the runs of strings under one minimizer, are dealt by it, and each distinct one enters
   a Burrows-Wheeler transform. Intervals of suffixes with a common prefix are expanded backward,
   breadth first, by increasing prefix length, which stops at ``LENGTH``: the intervals that are left
   are the repeated strings. The smallest doc_id of each decides.

What meets in one task is met there first: of a minimizer two documents stand for all that a task saw, and of equal
segments the smallest document's goes on, so a passage that very many documents share is no heavy key.

Null texts are empty. Rows with a null doc_id neither lose bytes nor take any. Equal doc_ids are
one document: its rows never repeat each other. Text shorter than ``LENGTH`` bytes stays whole. Chunks are
equal by 128-bit hashes. The number of tasks follows the input's partitions, and a task takes its share
bucket by bucket.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.llm.common import binary, lean, mixed, slices, width

LENGTH, GRAM = 50, 24
#: Mean bytes of a chunk (a power of two).
CHUNK = 256
#: Values gathered by a task before it sends them on; bytes of distinct segments in one transform.
FLUSH, TRANSFORM = 2_000_000, 1_500_000

_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
_LOW = np.uint64((1 << 48) - 1)


def _words(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as a number."""
    if len(data) < 8:
        return np.zeros(0, np.uint64)
    flat = np.ascontiguousarray(data)
    return np.array(np.ndarray((len(flat) - 7,), "<u8", flat, strides=(1,)))


def _chunks(words: np.ndarray, offsets: np.ndarray, chunk: int) -> np.ndarray:
    """Where chunks begin, rows' starts among them, ascending."""
    cut = (words * _A) >> np.uint64(64 - chunk.bit_length() + 1) == 0
    cut[1:] &= ~cut[:-1].copy()
    return np.unique(np.concatenate([np.flatnonzero(cut), offsets[:-1][np.diff(offsets) > 0]]))


def _minimizers(words: np.ndarray, n: int, length: int, gram: int) -> np.ndarray:
    """Least gram hash (48 bits) of the string of ``length`` bytes from each place on."""
    count = n - gram + 1
    h = words[:count] * _A
    for i in range(8, gram - 7, 8):
        h ^= (words[i : i + count] * _B) ^ (h >> np.uint64(29))
        h *= _C
    h ^= h >> np.uint64(32)
    h = (h * _B) >> np.uint64(16)
    width, span = length - gram + 1, 1
    while 2 * span <= width:
        h = np.minimum(h[:-span], h[span:])
        span *= 2
    return np.minimum(h[: len(h) - (width - span)], h[width - span :]) if width > span else h


class _Piece:
    """A run of texts with its chunks and, for the strings that start in some of them, minimizers."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, length: int, chunk: int):
        self.data, self.offsets, self.length = data, offsets, length
        self.words = _words(data)
        self.begin = _chunks(self.words, offsets, chunk)
        self.row = np.searchsorted(offsets, self.begin, "right") - 1
        end = offsets[self.row + 1] if len(self.begin) else self.begin
        self.stop = np.minimum(np.append(self.begin[1:], len(data))[: len(self.begin)], end)
        reach = np.minimum(self.stop + length - 1, end)
        some = reach - self.begin >= length  # chunks in which a string starts
        self.begin, self.row, reach, self.stop = self.begin[some], self.row[some], reach[some], np.minimum(self.stop, end - length + 1)[some]
        flat = memoryview(np.ascontiguousarray(data))
        digests = b"".join([xxhash.xxh3_128_digest(flat[a:b]) for a, b in zip(self.begin.tolist(), reach.tolist(), strict=True)])
        self.hash = np.frombuffer(digests, "<i8").reshape(-1, 2)

    def owned(self, own: list[np.ndarray]) -> np.ndarray:
        """Which chunks are the first of their kind, by each row's list of such chunks."""
        out = np.zeros(len(self.row), bool)
        edges = np.searchsorted(self.row, np.arange(len(own) + 1))
        for row, mine in enumerate(own):
            a, b = edges[row], edges[row + 1]
            if b > a and len(mine):
                out[a:b] = np.isin(self.hash[a:b, 0], mine)
        return out

    def runs(self, own: np.ndarray, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Row, first and last start, and minimizer of the runs of strings in the given chunks."""
        n = len(self.data)
        if n < self.length or not own.any():
            return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
        edge = np.zeros(n + 1, np.int8)
        np.add.at(edge, self.begin[own], 1)
        np.add.at(edge, self.stop[own], -1)
        live = np.cumsum(edge[: n - self.length + 1], dtype=np.int8) > 0
        least = _minimizers(self.words, n, self.length, gram)
        most = self.length - gram + 1  # strings under one place of a gram
        new = live.copy()
        new[1:] &= ~live[:-1] | (least[1:] != least[:-1])
        first = np.flatnonzero(new)
        end = live.copy()
        end[:-1] &= ~live[1:] | new[1:]
        last = np.flatnonzero(end)
        parts = (last - first) // most + 1  # longer runs, of periodic text, are split
        begin = np.repeat(first, parts) + most * (np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts))
        stop = np.minimum(begin + most - 1, np.repeat(last, parts))
        return np.searchsorted(self.offsets, begin, "right") - 1, begin, stop, least[begin]


def _texts(batch: pa.RecordBatch):
    """Runs of rows of a batch as pieces: (first row, number of rows, bytes, offsets)."""
    data, offsets = binary(batch.column("text"))
    for first, piece, at in slices(data, offsets):
        yield first, len(at) - 1, piece, at


def _lists(column, first: int, n: int) -> list[np.ndarray]:
    """A list column's rows as arrays; a null is empty."""
    out = []
    for value in column.slice(first, n):
        out.append(value.values.to_numpy(zero_copy_only=False) if value.is_valid else np.zeros(0, np.int64))
    return out


def _values(column, first: int, n: int, kind: str) -> list[np.ndarray]:
    """A binary column's rows as arrays; a null is empty."""
    return [np.frombuffer(v.as_buffer(), kind) if v.is_valid else np.zeros(0, kind) for v in column.slice(first, n)]


def transform(text: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Suffix order (by ``length`` symbols at least) and Burrows-Wheeler transform of symbols 0 to 256, cyclic."""
    n = len(text)
    twice = np.concatenate([text, text[:64]]) if n >= 64 else np.resize(text, n + 64)
    key = np.zeros(n, np.int64)
    for i in range(7):
        key = key << 9 | twice[i : i + n]
    depth = 7
    while True:
        order = np.argsort(key)
        rank = np.empty(n, np.int64)
        ordered = key[order]
        rank[order] = np.cumsum(np.concatenate([[0], ordered[1:] != ordered[:-1]]))
        if depth >= length or rank[order[-1]] == n - 1:
            return order, text[order - 1]
        key = rank * (n + 1) + rank[(np.arange(n) + depth) % n]
        depth *= 2


def expand(bwt: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Interval of each suffix, by its first ``length`` symbols, and common prefixes where shorter.

    Level by level: the intervals of strings ``c + w`` are the images of those of ``w`` under each
    symbol's backward step, so a border appears between neighbours once and at the length they share.
    """
    back = np.argsort(bwt, kind="stable")  # from a place to the one it is stepped back to from
    symbols = bwt[back]
    border = np.ones(len(bwt), bool)
    border[1:] = symbols[1:] != symbols[:-1]
    first = border.copy()
    common = np.full(len(bwt), length, np.int64)
    common[border] = 0
    for level in range(1, length):
        interval = np.cumsum(border)[back]
        now = first.copy()
        now[1:] |= interval[1:] != interval[:-1]
        fresh = now & ~border
        if not fresh.any() and level > 1 and (now == border).all():
            break
        common[fresh] = level
        border = now
    return np.cumsum(border) - 1, common


def repeated(segments: np.ndarray, lengths: np.ndarray, docs: np.ndarray, length: int) -> np.ndarray:
    """Smallest doc of each string of distinct segments; ``docs``: the smallest that holds the segment."""
    n, width = segments.shape
    text = np.zeros((n, width + 1), np.int64)
    inside = np.arange(width) < lengths[:, None]
    text[:, :width][inside] = segments[inside].astype(np.int64) + 1
    keep = np.concatenate([inside, np.ones((n, 1), bool)], 1)
    flat = text[keep]
    head = np.cumsum(lengths + 1) - (lengths + 1)
    order, bwt = transform(flat, length)
    interval, _ = expand(bwt, length)
    of = np.empty(len(flat), np.int64)
    of[order] = interval
    starts = width - length + 1
    live = np.arange(starts) <= (lengths - length)[:, None]
    where = np.minimum(head[:, None] + np.arange(starts), len(flat) - 1)
    least = np.full(int(interval[-1]) + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, of[where][live], np.broadcast_to(docs[:, None], live.shape)[live])
    return np.where(live, least[of[where]], np.iinfo(np.int64).max)


def _dealt(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return (mixed(hashes) % np.uint64(buckets)).astype(np.int64)


SEGMENTS = ["bucket", "codes", "names", "counts", "at", "lengths", "bodies"]
_BACK = "bucket int, names binary, counts binary, body binary"


def _sent_back(name: np.ndarray, body: np.ndarray, buckets: int):
    """Values with the documents they are for, a row for each bucket of documents."""
    bucket = _dealt(name.view(np.uint64), buckets)
    order = np.lexsort((name, bucket))
    name, body = name[order], body[order]
    edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
    rows: list[list] = [[], [], [], []]
    for b in range(buckets):
        part = slice(edges[b], edges[b + 1])
        if edges[b + 1] > edges[b]:
            used, count = np.unique(name[part], return_counts=True)
            for column, value in zip(rows, (b, used.tobytes(), count.astype("<i4").tobytes(), body[part].tobytes()), strict=True):
                column.append(value)
    return pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int32()), *[pa.array(r, pa.binary()) for r in rows[1:]]], names=["bucket", "names", "counts", "body"])


def _here(back: pa.RecordBatch, buckets: int) -> pa.RecordBatch:
    """Values that go back to their documents without meeting others, in buckets after those that do meet."""
    shifted = pa.array(back.column("bucket").to_numpy() + buckets, pa.int32())
    return pa.RecordBatch.from_arrays([shifted, back.column("body"), back.column("names"), back.column("counts")], names=["bucket", "codes", "names", "counts"])


def _passed(batch: pa.RecordBatch, row: int, bucket: int) -> pa.RecordBatch:
    columns = [batch.column(c).slice(row, 1) for c in ("names", "counts", "codes")]
    return pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), *columns], names=["bucket", "names", "counts", "body"])


def _firsts(code: np.ndarray, name: np.ndarray, count: np.ndarray, body: np.ndarray) -> np.ndarray:
    """Which segments some smaller document has as well, minimizer and all bytes alike."""
    words = np.zeros((len(code), -(-body.shape[1] // 8) * 8), np.uint8)
    words[:, : body.shape[1]] = body
    h = mixed(code + mixed(count.astype(np.uint64)))
    for column in words.view("<u8").T:
        h = mixed(h + column * _B)
    order = np.lexsort((name, h))
    new = np.concatenate([[True], h[order][1:] != h[order][:-1]])
    first = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
    same = (code[order] == code[first]) & (count[order] == count[first]) & (words[order] == words[first]).all(1)
    out = np.zeros(len(code), bool)
    out[order] = same & (name[order] > name[first])
    return out


def _each_bucket(batches, names: tuple[str, ...], kinds: tuple):
    """The values of one bucket after the other, as one array for each of the named columns; rows come sorted."""
    at, held = None, []
    for batch in batches:
        columns = [batch.column(n) for n in names]
        for row, bucket in enumerate(batch.column("bucket").to_pylist()):
            if bucket != at and held:
                yield [np.concatenate(c) for c in zip(*held, strict=True)]
                held = []
            at = bucket
            held.append([np.frombuffer(c[row].as_buffer(), k) for c, k in zip(columns, kinds, strict=True)])
    if held:
        yield [np.concatenate(c) for c in zip(*held, strict=True)]


def _sorted(rows: DataFrame, parts: int) -> DataFrame:
    """``rows`` dealt by bucket; a task takes its buckets one by one, so it holds no more than one of them."""
    return rows.repartition(parts, "bucket").sortWithinPartitions("bucket")


def _gathered(rows: DataFrame, parts: int, wide: int, into: tuple[str, str]) -> DataFrame:
    """One row a document with all values sent to it, ``wide`` bytes each."""

    def run(batches):
        for names, counts, body in _each_bucket(batches, ("names", "counts", "body"), (np.int64, "<i4", np.uint8)):
            name, body = np.repeat(names, counts), body.reshape(-1, wide)
            order = np.argsort(name, kind="stable")
            name, body = name[order], body[order]
            head = np.flatnonzero(np.concatenate([[True], name[1:] != name[:-1]]))
            ends = np.append(head[1:], len(name))
            for low in range(0, len(head), 20_000):
                some = slice(low, low + 20_000)
                found = [body[a:b].tobytes() for a, b in zip(head[some].tolist(), ends[some].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(name[head[some]]), pa.array(found, pa.binary())], names=list(into))

    return _sorted(rows, parts).mapInArrow(run, f"{into[0]} long, {into[1]} binary")


def mark(docs: DataFrame, text: str = "text", length: int = LENGTH, gram: int = GRAM, chunk: int = CHUNK, carry: str | None = None, as_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, n_copied (bytes of chunks that an earlier document has whole)
    and what is left of the text: kept (bytes).

    ``carry`` names a column to pass along. With ``as_text`` kept is a string; of a character
    that loses some of its bytes the others go too.
    """
    parts = width(lean(docs))
    buckets = 8 * parts
    carried = [carry] if carry else []
    base = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"), *carried)

    def chunked(batches):
        for batch in batches:
            names = batch.column("doc_id").to_numpy()
            for first, _, data, at in _texts(batch):
                piece = _Piece(data, at, length, chunk)
                yield pa.RecordBatch.from_arrays([pa.array(names[first + piece.row]), pa.array(piece.hash[:, 0]), pa.array(piece.hash[:, 1])], names=["doc_id", "h1", "h2"])

    named = base.where("doc_id is not null")
    chunks = named.mapInArrow(chunked, "doc_id long, h1 long, h2 long")
    own = chunks.groupBy("h1", "h2").agg(F.min("doc_id").alias("owner")).groupBy(F.col("owner").alias("owner_id")).agg(F.collect_list("h1").alias("own"))
    placed = named.repartition(parts, "doc_id")  # one exchange, which all three passes over the texts read
    known = placed.join(own.hint("shuffle_hash"), placed["doc_id"] == own["owner_id"], "left").drop("owner_id")

    def anchored(batches):
        codes, names, size = [], [], 0

        def sent():
            nonlocal codes, names, size
            code, name = np.sort(np.concatenate(codes)), np.array(names, np.int64)
            codes, names, size = [], [], 0
            least, owner = code >> np.uint64(16), name[(code & np.uint64(0xFFFF)).astype(np.int64)]
            head = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
            many = np.repeat(np.minimum.reduceat(owner, head) < np.maximum.reduceat(owner, head), np.diff(np.append(head, len(code))))
            yield _here(_sent_back(owner[many], least[many], buckets), buckets)  # met here already
            # two of its documents stand for such a minimizer elsewhere
            order = np.lexsort((owner, least))
            new = np.concatenate([[True], least[order][1:] != least[order][:-1]])
            code = np.sort(code[order[new | np.append(new[1:], True)]])
            bucket = _dealt(code >> np.uint64(16), buckets)
            order = np.argsort(bucket, kind="stable")
            code, bucket = code[order], bucket[order]
            edges = np.searchsorted(bucket, np.arange(buckets + 1))
            rows: list[list] = [[], [], []]
            for b in np.unique(bucket).tolist():
                part = code[edges[b] : edges[b + 1]]
                used, local = np.unique((part & np.uint64(0xFFFF)).astype(np.int64), return_inverse=True)
                rows[0].append(b)
                rows[1].append(((part >> np.uint64(16) << np.uint64(16)) | local.astype(np.uint64)).tobytes())
                rows[2].append(name[used].tobytes())
            n = len(rows[0])
            yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int32()), pa.array(rows[1], pa.binary()), pa.array(rows[2], pa.binary()), pa.nulls(n, pa.binary())], names=["bucket", "codes", "names", "counts"])

        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            for first, n, data, at in _texts(batch):
                if len(names) + n > 0xFFFF and size:
                    yield from sent()
                piece = _Piece(data, at, length, chunk)
                row, _, _, least = piece.runs(piece.owned(_lists(batch.column("own"), first, n)), gram)
                code = np.unique((least << np.uint64(16)) | (row + len(names)).astype(np.uint64))
                names += [i or 0 for i in ids[first : first + n]]
                codes.append(code)
                size += len(code)
                if size >= FLUSH or len(names) >= 0xFFFF - 4096:
                    yield from sent()
        if size:
            yield from sent()

    def met(batches):
        """Minimizers of two documents or more, given back to each of them."""

        def shared_by(codes, names):
            code, name = np.concatenate(codes), np.concatenate(names)
            order = np.argsort(code, kind="stable")
            code, name = code[order], name[order]
            head = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
            many = np.minimum.reduceat(name, head) < np.maximum.reduceat(name, head)
            keep = np.repeat(many, np.diff(np.append(head, len(code))))
            return _sent_back(name[keep], code[keep], buckets)

        codes, names, at = [], [], None
        for batch in batches:
            for row, bucket in enumerate(batch.column("bucket").to_pylist()):
                if bucket >= buckets:
                    yield _passed(batch, row, bucket - buckets)
                    continue
                if bucket != at and codes:
                    yield shared_by(codes, names)
                    codes, names = [], []
                at = bucket
                code, name = (np.frombuffer(batch.column(c)[row].as_buffer(), k) for c, k in (("codes", np.uint64), ("names", np.int64)))
                codes.append(code >> np.uint64(16))
                names.append(name[(code & np.uint64(0xFFFF)).astype(np.int64)])
        if codes:
            yield shared_by(codes, names)

    anchors = known.where("own is not null").mapInArrow(anchored, "bucket int, codes binary, names binary, counts binary")
    shared = _gathered(_sorted(anchors, parts).mapInArrow(met, _BACK), parts, 8, ("met_id", "found"))
    wide = 2 * length - gram

    def segmented(batches):
        held: list[tuple] = []
        names: list[int] = []
        size = 0

        def sent():
            nonlocal held, names, size
            code, at, count, body = (np.concatenate(x) for x in zip(*held, strict=True))
            owner = np.array(names, np.int64)[(code & np.uint64(0xFFFF)).astype(np.int64)]
            held, names, size = [], [], 0
            code = code >> np.uint64(16)
            if not len(code):
                return
            later = _firsts(code, owner, count, body)
            gone = np.stack([at[later], at[later] + count[later] - length], 1)  # all of its strings start before
            back = _here(_sent_back(owner[later], gone, buckets), buckets)
            none = pa.nulls(back.num_rows, pa.binary())
            yield pa.RecordBatch.from_arrays([*back.columns, none, none, none], names=SEGMENTS)
            code, owner, at, count, body = (x[~later] for x in (code, owner, at, count, body))
            bucket = _dealt(code, buckets)
            order = np.argsort(bucket, kind="stable")
            edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
            rows: list[list] = [[] for _ in range(6)]
            for b in np.unique(bucket).tolist():
                part = order[edges[b] : edges[b + 1]]
                for column, value in zip(rows, (b, code[part].tobytes(), owner[part].tobytes(), at[part].tobytes(), count[part].tobytes(), body[part].tobytes()), strict=True):
                    column.append(value)
            kinds = [pa.array(r, pa.binary()) for r in rows[1:]]
            yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int32()), kinds[0], kinds[1], pa.nulls(len(rows[0]), pa.binary()), *kinds[2:]], names=SEGMENTS)

        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            for first, n, data, at in _texts(batch):
                piece = _Piece(data, at, length, chunk)
                row, begin, stop, least = piece.runs(piece.owned(_lists(batch.column("own"), first, n)), gram)
                found = _values(batch.column("found"), first, n, "<u8")
                hit = np.zeros(len(row), bool)
                edges = np.searchsorted(row, np.arange(n + 1))
                for r, values in enumerate(found):
                    if len(values):
                        hit[edges[r] : edges[r + 1]] = np.isin(least[edges[r] : edges[r + 1]], values)
                row, begin, stop, least = row[hit], begin[hit], stop[hit], least[hit]
                if len(names) + n > 0xFFFF and held:
                    yield from sent()
                count = stop - begin + length
                inside = np.arange(wide) < count[:, None]
                body = np.where(inside, data[np.minimum(begin[:, None] + np.arange(wide), len(data) - 1)], 0).astype(np.uint8) if len(row) else np.zeros((0, wide), np.uint8)
                held.append(((least << np.uint64(16)) | (row + len(names)).astype(np.uint64), (begin - at[row]).astype(np.int64), count.astype("<u2"), body))
                names += [i or 0 for i in ids[first : first + n]]
                size += len(row)
                if size >= FLUSH // 20 or len(names) >= 0xFFFF - 4096:
                    yield from sent()
        if size:
            yield from sent()

    def judged(batches):
        """Runs of repeated strings of each document: first and last start."""
        kinds = ("<u8", "<i8", "<i8", "<u2", np.uint8)

        def own():
            for batch in batches:
                bucket = batch.column("bucket").to_numpy()
                for row in np.flatnonzero(bucket >= buckets).tolist():
                    passed.append(_passed(batch, row, int(bucket[row]) - buckets))
                yield batch.filter(pa.array(bucket < buckets))

        passed: list[pa.RecordBatch] = []
        for values in _each_bucket(own(), ("codes", "names", "at", "lengths", "bodies"), kinds):
            yield from repeats_of(*values)
            while passed:
                yield passed.pop()
        yield from passed

    def repeats_of(code, name, at, count, body):
        body = body.reshape(-1, wide)
        turns, lost = max(1, body.nbytes // TRANSFORM), []
        turn = mixed(code + np.uint64(1)) % np.uint64(turns)
        order = np.argsort(turn, kind="stable")
        edges = np.searchsorted(turn[order], np.arange(turns + 1))
        for t in range(turns):
            part = order[edges[t] : edges[t + 1]]
            if not len(part):
                continue
            packed = np.ascontiguousarray(np.concatenate([body[part], count[part].view(np.uint8).reshape(-1, 2)], 1)).view(f"V{wide + 2}").ravel()
            _, place, of = np.unique(packed, return_index=True, return_inverse=True)
            least = np.full(len(place), np.iinfo(np.int64).max)
            np.minimum.at(least, of, name[part])
            smallest = repeated(body[part][place], count[part][place].astype(np.int64), least, length)
            gone = smallest[of] < name[part][:, None]
            edge = np.diff(np.pad(gone.astype(np.int8), ((0, 0), (1, 1))), axis=1)
            row, low = np.nonzero(edge == 1)
            high = np.nonzero(edge == -1)[1]
            if len(row):
                where = at[part][row]
                lost.append((name[part][row], np.stack([where + low, where + high - 1], 1)))
        if lost:
            yield _sent_back(np.concatenate([n for n, _ in lost]), np.concatenate([x for _, x in lost]), buckets)

    candidates = known.join(shared.hint("shuffle_hash"), known["doc_id"] == shared["met_id"]).drop("met_id")
    segments = candidates.mapInArrow(segmented, "bucket int, codes binary, names binary, counts binary, at binary, lengths binary, bodies binary")
    gone = _gathered(_sorted(segments, parts).mapInArrow(judged, _BACK), parts, 16, ("gone_id", "gone"))

    def cleaned(batches):
        for batch in batches:
            out: list[list] = [[] for _ in range(5)]
            for first, n, data, at in _texts(batch):
                piece = _Piece(data, at, length, chunk)
                mine = piece.owned(_lists(batch.column("own"), first, n))
                edge = np.zeros(len(data) + 1, np.int32)
                np.add.at(edge, piece.begin[~mine], 1)
                np.add.at(edge, piece.stop[~mine] - 1 + length, -1)
                copied = np.concatenate([[0], np.cumsum(np.cumsum(edge[:-1]) > 0)])
                out[4] += (copied[at[1:]] - copied[at[:-1]]).tolist()
                for row, pairs in enumerate(_values(batch.column("gone"), first, n, "<i8")):
                    if len(pairs):
                        pairs = pairs.reshape(-1, 2) + at[row]
                        np.add.at(edge, pairs[:, 0], 1)
                        np.add.at(edge, pairs[:, 1] + length, -1)
                lost = np.cumsum(edge[:-1]) > 0
                for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                    part = lost[a:b]
                    out[0].append(b - a)
                    removed = int(part.sum())
                    out[1].append(removed)
                    out[2].append(int(part[:1].sum()) + int((part[1:] & ~part[:-1]).sum()) if removed else 0)
                    out[3].append((data[a:b][~part] if removed else data[a:b]).tobytes())
            kept = pa.array([v.decode(errors="ignore") for v in out[3]], pa.string()) if as_text else pa.array(out[3], pa.binary())
            own = {c: batch.column(c) for c in ("doc_id", *carried)}
            figures = {n: pa.array(v, pa.int64()) for n, v in zip(("n_bytes", "n_removed", "n_spans", "n_copied"), (*out[:3], out[4]), strict=True)}
            yield pa.RecordBatch.from_pydict(own | figures | {"kept": kept})

    last = known.join(gone.hint("shuffle_hash"), known["doc_id"] == gone["gone_id"], "left").drop("gone_id")
    kind = "string" if as_text else "binary"
    passed = "".join(f", `{c}` {base.schema[c].dataType.simpleString()}" for c in carried)
    done = last.mapInArrow(cleaned, f"doc_id long{passed}, n_bytes long, n_removed long, n_spans long, n_copied long, kept {kind}")
    none = F.lit(0).cast("long")
    rest = base.where("doc_id is null").select("doc_id", *carried, F.octet_length("text").cast("long").alias("n_bytes"), none.alias("n_removed"), none.alias("n_spans"), none.alias("n_copied"), F.col("text").cast(kind).alias("kept"))
    return done.unionByName(rest)
