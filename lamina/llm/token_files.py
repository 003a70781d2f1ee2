"""Token-ID output as wavelet matrices, one compressed file a shard.

A wavelet matrix keeps a sequence of ids as one bit-plane for each bit, most significant first; each
plane orders the ids by the bits above it (zeros first, stably). A plane is stored as chunks that are
compressed apart, with a directory of the ones before each chunk, so that access, rank, count and
select unpack only the chunks they touch: no lookup decodes the sequence.

Documents are dealt by ranges of doc_id and written in ascending order. Null or empty texts hold
the end id alone; rows with a null doc_id come first; equal rows are written as often as they came;
only doc_id and text are read of the input. An id that the planes cannot hold is an error.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.llm import tokens
from lamina.llm.common import cut, lean, partitions

END = 2
#: Tokens of one matrix at most (beyond it only a longer single document).
SHARD = 1 << 20
#: Bytes of a chunk of a plane, and chunks of a matrix that stay unpacked for lookups.
CHUNK, KEPT = 8192, 256
_HEAD = "<4sQI"


def bits_for(vocabulary: str) -> int:
    """Bits that hold every id of a vocabulary file, special tokens included."""
    with open(vocabulary, encoding="utf-8") as file:
        spec = json.load(file)
    most = max([*spec["model"]["vocab"].values(), *[t["id"] for t in spec.get("added_tokens", [])]])
    return max(1, int(most).bit_length())


class WaveletMatrix:
    """Succinct sequence of ids below ``2 ** bits``, as it stands in a file."""

    def __init__(self, data: bytes):
        magic, self.n, self.bits = struct.unpack_from(_HEAD, data)
        if magic != b"WVM2":
            raise ValueError("not a wavelet matrix")
        self.data, at = memoryview(data), struct.calcsize(_HEAD)
        chunks = self.chunks = -(-self.n // (8 * CHUNK))
        self.zeros = np.frombuffer(data, "<u8", self.bits, at).astype(np.int64)
        at += 8 * self.bits
        self.before = np.frombuffer(data, "<u8", self.bits * chunks, at).reshape(self.bits, chunks).astype(np.int64)
        at += 8 * self.bits * chunks
        sizes = np.frombuffer(data, "<u4", self.bits * chunks, at).astype(np.int64)
        at += 4 * self.bits * chunks
        self.ends = (at + np.cumsum(sizes)).reshape(self.bits, chunks)
        self.starts = self.ends - sizes.reshape(self.bits, chunks)
        self.held: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        self.unpacked = 0

    @staticmethod
    def build(ids: np.ndarray, bits: int) -> bytes:
        ids = np.asarray(ids)
        if len(ids) and (int(ids.max()) >> bits or int(ids.min()) < 0):
            raise ValueError(f"an id does not fit {bits} bits")
        now = np.ascontiguousarray(ids, np.uint16 if bits <= 16 else np.uint32)
        zeros, before, bodies, pack = [], [], [], zstandard.ZstdCompressor(level=1).compress
        for level in range(bits - 1, -1, -1):
            one = (now & now.dtype.type(1 << level)).astype(bool)
            plane = np.packbits(one, bitorder="little")
            places = range(0, len(plane), CHUNK)
            if len(plane):
                ones = np.add.reduceat(np.bitwise_count(plane).astype(np.int64), list(places))
                before.append(np.cumsum(ones) - ones)
            bodies += [pack(plane[a : a + CHUNK].tobytes()) for a in places]
            low = np.flatnonzero(~one)
            zeros.append(len(low))
            if level:
                now = np.concatenate([now[low], now[np.flatnonzero(one)]])
        head = struct.pack(_HEAD, b"WVM2", len(ids), bits) + np.array(zeros, "<u8").tobytes()
        directory = np.concatenate(before).astype("<u8").tobytes() if before else b""
        return head + directory + np.array(list(map(len, bodies)), "<u4").tobytes() + b"".join(bodies)

    def _bytes(self, plane: int, chunk: int) -> bytes:
        self.unpacked += 1
        return zstandard.ZstdDecompressor().decompress(self.data[self.starts[plane, chunk] : self.ends[plane, chunk]], max_output_size=CHUNK)

    def _chunk(self, plane: int, chunk: int) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of a chunk, and the ones in it before each byte."""
        key = (plane, chunk)
        if key not in self.held:
            if len(self.held) >= KEPT:
                self.held.pop(next(iter(self.held)))
            body = np.frombuffer(self._bytes(plane, chunk), np.uint8)
            self.held[key] = body, np.concatenate([[0], np.cumsum(np.bitwise_count(body), dtype=np.int64)])
        return self.held[key]

    def decode(self) -> np.ndarray:
        """All ids: the planes are undone from the last to the first."""
        now = np.zeros(self.n, np.uint16 if self.bits <= 16 else np.uint32)
        for level in range(self.bits):  # level counts bits from the least
            at = self.bits - 1 - level
            plane = np.frombuffer(b"".join([self._bytes(at, c) for c in range(self.chunks)]), np.uint8)
            one = np.unpackbits(plane, count=self.n, bitorder="little").view(bool)
            out = np.empty_like(now)
            out[np.flatnonzero(~one)] = now[: self.zeros[at]]
            out[np.flatnonzero(one)] = now[self.zeros[at] :] | now.dtype.type(1 << level)
            now = out
        return now

    def _ranks(self, plane: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ones of a plane before each place, and the bit at each (0 at the very end)."""
        rank, bit = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        rank[at >= self.n] = self.n - self.zeros[plane]
        chunk = at // (8 * CHUNK)
        for c in np.unique(chunk[at < self.n]).tolist():
            some = np.flatnonzero((chunk == c) & (at < self.n))
            body, ones = self._chunk(plane, c)
            inside = at[some] - 8 * CHUNK * c
            byte, rest = body[inside // 8].astype(np.int64), inside % 8
            rank[some] = self.before[plane, c] + ones[inside // 8] + np.bitwise_count(byte & ((1 << rest) - 1))
            bit[some] = byte >> rest & 1
        return rank, bit

    def access_all(self, at) -> np.ndarray:
        """The ids at the given places."""
        at = np.array(at, np.int64)
        value = np.zeros(len(at), np.int64)
        for plane in range(self.bits):
            ones, bit = self._ranks(plane, at)
            at = np.where(bit, self.zeros[plane] + ones, at - ones)
            value = value << 1 | bit
        return value

    def access(self, at: int) -> int:
        return int(self.access_all([at])[0])

    def _mapped(self, token: int, at) -> np.ndarray:
        """Where places of the sequence stand among an id's run after the last plane."""
        at = np.array(at, np.int64)
        for plane in range(self.bits):
            ones, _ = self._ranks(plane, at)
            at = self.zeros[plane] + ones if token >> (self.bits - 1 - plane) & 1 else at - ones
        return at

    def ranks(self, token: int, before) -> np.ndarray:
        """Occurrences of an id before each of the places."""
        mapped = self._mapped(token, [0, *before])
        return mapped[1:] - mapped[0]

    def rank(self, token: int, before: int) -> int:
        return int(self.ranks(token, [before])[0])

    def count(self, token: int) -> int:
        return self.rank(token, self.n)

    def select(self, token: int, k: int) -> int:
        """Place of the k-th occurrence (from 0) of an id; -1 where there are fewer."""
        low, high = self._mapped(token, [0, self.n]).tolist()
        if k < 0 or k >= high - low:
            return -1
        at = low + k
        for plane in range(self.bits - 1, -1, -1):
            bit = token >> (self.bits - 1 - plane) & 1
            want = at - int(self.zeros[plane]) if bit else at
            first = self.before[plane] if bit else 8 * CHUNK * np.arange(self.chunks) - self.before[plane]
            chunk = int(np.searchsorted(first, want, "right")) - 1  # the chunk that holds that bit
            body, _ = self._chunk(plane, chunk)
            bits = np.unpackbits(body, bitorder="little")
            at = 8 * CHUNK * chunk + int(np.flatnonzero(bits == bit)[want - int(first[chunk])])
        return at

    def occurrences(self, token: int) -> list[int]:
        return [self.select(token, k) for k in range(self.count(token))]


def folder(spark: SparkSession, name: str) -> str:
    """A new folder that the driver and all executors share; whoever asks for it owns and removes it."""
    cut(spark.range(0))
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


FILE = "part int, shard int, base long, n_tokens long, doc_ids binary, null_ids binary, lengths binary, matrix binary"


def write(docs: DataFrame, path: str, vocabulary: str, end: int = END, bits: int | None = None, shard: int = SHARD) -> None:
    """Write all documents as shards in ascending doc_id order; a range of doc_ids is one file."""
    bits = bits or bits_for(vocabulary)

    def run(batches):
        part, number, base = TaskContext.get().partitionId(), 0, 0
        names: list[int | None] = []
        held: list[bytes] = []
        size = 0

        def flushed():
            nonlocal number, base, names, held, size
            lengths = np.array([len(h) // 4 + 1 for h in held], np.int64)
            ids = np.frombuffer((end.to_bytes(4, "little")).join([*held, b""]), "<u4")
            matrix = WaveletMatrix.build(ids, bits)
            row = [part, number, base, len(ids), np.array([n or 0 for n in names], "<i8").tobytes(), np.array([n is None for n in names]).tobytes(), lengths.tobytes(), matrix]
            number, base, names, held, size = number + 1, base + len(ids), [], [], 0
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), *[pa.binary()] * 4]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names=[f.split()[0] for f in FILE.split(", ")])

        for batch in tokens.kept(batches):
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), tokens.encoded(batch.column("text"), vocabulary), strict=True):
                if held and size + len(ids) // 4 >= shard:
                    yield flushed()
                names.append(doc_id)
                held.append(ids)
                size += len(ids) // 4 + 1
        if held:
            yield flushed()

    dealt = lean(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("string")).repartitionByRange(partitions(docs.sparkSession), "doc_id").sortWithinPartitions("doc_id")
    dealt.mapInArrow(run, FILE).write.option("compression", "none").parquet(path)


def read_back(spark: SparkSession, path: str, end: int = END) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, decoded from the files.

    ``first_id`` and ``n_ends`` come from lookups: the id at the document's start, and how often the
    end id stands in its range.
    """
    files = lean(spark.read.parquet(path))
    totals = {r["part"]: r["n"] for r in files.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()}
    heads, total = {}, 0
    for part in sorted(totals):
        heads[part] = total
        total += totals[part]

    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                get = lambda name, b=batch, r=row: b.column(name)[r].as_py()
                matrix = WaveletMatrix(get("matrix"))
                ids = matrix.decode().astype("<u4")
                lengths = np.frombuffer(get("lengths"), np.int64)
                ends = np.cumsum(lengths)
                flat, stops = memoryview(ids.tobytes()), (4 * ends).tolist()
                crcs = [zlib.crc32(flat[a:b]) for a, b in zip([0, *stops[:-1]], stops, strict=True)]
                names = pa.array(np.frombuffer(get("doc_ids"), "<i8"), pa.int64(), mask=np.frombuffer(get("null_ids"), bool))
                starts = ends - lengths + (heads[get("part")] + get("base"))
                ended = np.diff(matrix.ranks(end, np.concatenate([[0], ends])))
                lead = matrix.access_all(ends - lengths)
                yield pa.RecordBatch.from_arrays([names, pa.array(starts), pa.array(lengths), pa.array(crcs, pa.int64()), pa.array(lead), pa.array(ended)], names=["doc_id", "start", "n_tokens", "ids_crc32", "first_id", "n_ends"])

    return files.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long, first_id long, n_ends long")
