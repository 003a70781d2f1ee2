"""Language-model scores by a hashed maximum-entropy model with a class-factored softmax.

Words (A-Z lower-cased) and one end per text are the tokens. All training tokens are counted; the
``HEAD`` most frequent are known to every executor, the rest is looked up by shuffle. All head words, by
falling count, form ``WIDE - 1`` classes of like mass, and each class ``WIDE`` parts of like mass; all remaining words, with those
never seen, are the last class. A token's probability is

    P(class | history) * P(part | class, history) * share of the token in its part

The first two factors are softmaxes, the last is a share of add-one counts (a frequent word is a part
by itself), so all probabilities, one unseen word among them, sum to one. The features are n-grams and skips of the last
three tokens, whichever words they are: the last and the one before alone, the last two, and the last with the third last. Each template
hashes whole words into a weight table of its own, for parts together with the class.

Training starts from the counts (bias terms) and takes gradient updates in many trainers at once
over every training token; row by row, the trainers' steps are averaged by how often they met the
row's features, in a tree. Scoring runs in sparse numpy batches. Words are told apart by 64-bit hashes.

Null and empty texts are one end. Equal rows get equal scores; a row with a null doc_id is scored
and counted as trained on (its fold is null, not 2). Only doc_id and text are read of the input.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.llm.common import LOWER, SPACED, binary, cut, lean, mixed, partitions, slices, spans, width, word_hashes

#: Head words; classes, and parts of each.
HEAD, WIDE = 1 << 19, 32
#: Bits of a template's row number, for class weights and for part weights.
CLASS_BITS, PART_BITS = 15, 16
#: Templates as the places before the token that they join, for classes and for parts.
CLASS_TEMPLATES, PART_TEMPLATES = ((1,), (2,), (1, 2), (1, 3)), ((1,), (1, 2))
#: Tokens of a gradient step; step size; bound of a weight.
BATCH, RATE, MOST = 1 << 13, 0.5, 8.0
#: Partitions of the input that one trainer takes, and trainers' steps that are summed at once.
TAKEN, FAN_IN = 4, 32
#: Tokens that a task gathers before it sends counts or questions on.
FLUSH = 4_000_000
#: Distinct rare words of a bucket, about.
RARE_WORDS = 1_000_000
_ONES = np.ones(WIDE, np.float32)
#: Hash that stands for the end of a text.
END = np.uint64(0x5EEDE4D0F7E87001)


def _tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, each text's end included, and where each text's begin."""
    data = LOWER[data]
    start, stop, first = spans(data, offsets, SPACED)
    words = word_hashes(data, start, stop)
    words = np.where(words == END, END ^ np.uint64(1), words)
    return np.insert(words, first[1:], END), first + np.arange(len(first))


class _Table:
    """Sorted keys, found through their leading bits."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        bits = max(1, min(20, int(len(keys)).bit_length()))
        self.shift = np.uint64(64 - bits)
        self.first = np.searchsorted(keys >> self.shift, np.arange((1 << bits) + 1, dtype=np.uint64)).astype(np.int32)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Place of each hash, or -1."""
        out = np.full(len(hashes), -1, np.int32)
        lead = (hashes >> self.shift).astype(np.int64)
        at, end = self.first[lead], self.first[lead + 1]
        open_ = np.flatnonzero(at < end)
        while len(open_):
            here = at[open_]
            hit = self.keys[here] == hashes[open_]
            out[open_[hit]] = here[hit]
            open_ = open_[~hit]
            at[open_] += 1
            open_ = open_[at[open_] < end[open_]]
        return out


def _split(mass: np.ndarray, parts: int) -> np.ndarray:
    """Number of the part (of at most ``parts``, of like mass, in order) of each of some items."""
    before = np.cumsum(mass) - mass
    raw = np.minimum((before / max(mass.sum(), 1e-300) * parts).astype(np.int64), parts - 1)
    return np.unique(raw, return_inverse=True)[1]


class Model:
    """The vocabulary's head with its classes and parts, and the weights.

    ``head``: (hash, count) of head words; ``total``, ``kinds``: all training tokens and distinct ones.
    """

    def __init__(self, head: list[tuple[int, int]], total: int, kinds: int):
        hashes = np.array([h for h, _ in head], np.int64).view(np.uint64)
        counts = np.array([c for _, c in head], np.int64)
        order = np.lexsort((hashes, -counts))
        mass = counts[order] + 1.0
        cls, part = _split(mass, WIDE - 1), np.zeros(len(order), np.int64)
        edges = np.searchsorted(cls, np.arange(WIDE))
        for low, high in zip(edges, edges[1:], strict=False):
            part[low:high] = _split(mass[low:high], WIDE)
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        by_hash = np.argsort(hashes)
        place = back[by_hash]
        self.table, self.count, self.cls, self.part = _Table(hashes[by_hash]), counts[by_hash], cls[place], part[place]
        self.total, self.kinds = total, kinds
        rare = (total - int(counts.sum())) + (kinds - len(head)) + 1  # add-one counts of the last class
        self.rare = float(np.log(rare))
        parts = np.bincount(self.cls * WIDE + self.part, self.count + 1, WIDE * WIDE).reshape(WIDE, WIDE)
        self.share = np.log((self.count + 1) / parts[self.cls, self.part])  # of a word in its part
        masses = parts.sum(1)
        masses[-1] = rare
        with np.errstate(divide="ignore", invalid="ignore"):
            self.bias = np.log(masses / masses.sum()).astype(np.float32)
            self.inside = np.where(parts > 0, np.log(parts / parts.sum(1, keepdims=True)), -np.inf).astype(np.float32)
        self.weights = np.zeros((len(CLASS_TEMPLATES) << CLASS_BITS, WIDE), np.float32)
        self.members = np.zeros((len(PART_TEMPLATES) << PART_BITS, WIDE), np.float32)
        self.buffers = None

    def __getstate__(self) -> dict:
        """Weights travel at half width, and not at all while they are zero."""
        state = self.__dict__ | {"buffers": None}
        for name in ("weights", "members"):
            state[name] = state[name].shape, state[name].astype(np.float16).tobytes() if state[name].any() else None
        return state

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        for name in ("weights", "members"):
            shape, body = state[name]
            self.__dict__[name] = np.zeros(shape, np.float32) if body is None else np.frombuffer(body, np.float16).reshape(shape).astype(np.float32)

    def own(self) -> Model:
        """A model to be trained on, whose weights are its own."""
        out = Model.__new__(Model)
        out.__dict__.update(self.__dict__ | {"weights": self.weights.copy(), "members": self.members.copy(), "buffers": None})
        return out

    def look(self, hashes: np.ndarray, first: np.ndarray):
        """Place in the head (or -1), class, and the feature hashes of each token."""
        at = self.table.find(hashes)
        cls = np.where(at >= 0, self.cls[at], WIDE - 1) if len(self.count) else np.full(len(hashes), WIDE - 1)
        place = np.arange(len(hashes)) - np.repeat(first[:-1], np.diff(first))
        known = mixed(hashes)
        before = {k: np.where(place >= k, np.concatenate([np.zeros(k, np.uint64), known])[: len(known)], np.uint64(0)) for k in (1, 2, 3)}
        features = {}
        for template in {*CLASS_TEMPLATES, *PART_TEMPLATES}:
            h = np.full(len(hashes), sum(template) * 0x9E3779B97F4A7C15 % (1 << 64), np.uint64)
            for k in template:
                h = mixed(h ^ before[k])
            features[template] = h
        return at, cls, features

    def class_rows(self, features: dict, b) -> list[np.ndarray]:
        """Rows of a batch in each template's table; tables follow each other."""
        return [(features[t][b] >> np.uint64(64 - CLASS_BITS)).astype(np.uint16) for t in CLASS_TEMPLATES]

    def part_rows(self, features: dict, b, cls: np.ndarray) -> list[np.ndarray]:
        own = cls.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
        return [(mixed(features[t][b] + own) >> np.uint64(64 - PART_BITS)).astype(np.uint16) for t in PART_TEMPLATES]

    def _logits(self, weights: np.ndarray, bits: int, rows: list[np.ndarray], base: np.ndarray) -> np.ndarray:
        """Sums of the rows' weights over ``base``, in a buffer that the next call takes again."""
        n = len(rows[0])
        if self.buffers is None or len(self.buffers[0]) < n:
            self.buffers = np.empty((max(n, BATCH), WIDE), np.float32), np.empty((max(n, BATCH), WIDE), np.float32)
        out, more = (x[:n] for x in self.buffers)
        for i, row in enumerate(rows):
            np.take(weights[i << bits : (i + 1) << bits], row, axis=0, out=more if i else out, mode="clip")
            if i:
                out += more
        out += base
        return out

    @staticmethod
    def _target(logit: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Log of the softmax at one place of each row. Weights are bounded, so no logit overflows."""
        own = logit[np.arange(len(logit)), at].astype(np.float64)
        np.exp(logit, out=logit)
        return own - np.log(logit @ _ONES)

    @staticmethod
    def _slope(logit: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Softmax less the indicator of the right place, in place."""
        np.exp(logit, out=logit)
        logit *= (1 / (logit @ _ONES))[:, None]
        logit[np.arange(len(logit)), at] -= 1
        return logit

    def logs(self, hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place in the head and natural log of the probability; of a rare token, without ``log(c + 1)``."""
        at, cls, features = self.look(hashes, first)
        out = np.where(at >= 0, self.share[at], -self.rare) if len(self.count) else np.full(len(hashes), -self.rare)
        for low in range(0, len(hashes), BATCH):
            b = slice(low, low + BATCH)
            out[b] += self._target(self._logits(self.weights, CLASS_BITS, self.class_rows(features, b), self.bias), cls[b])
        some = np.flatnonzero(at >= 0)
        for low in range(0, len(some), BATCH):
            b = some[low : low + BATCH]
            out[b] += self._target(self._logits(self.members, PART_BITS, self.part_rows(features, b, cls[b]), self.inside[cls[b]]), self.part[at[b]])
        return at, out

    def step(self, at: np.ndarray, cls: np.ndarray, features: dict, b: slice, met: tuple[np.ndarray, np.ndarray]) -> None:
        """One gradient update on a batch; ``met`` counts the use of each row of both weight tables."""

        def update(weights: np.ndarray, parts: list[np.ndarray], bits: int, slope: np.ndarray, used: np.ndarray) -> None:
            for i, row in enumerate(parts):
                own, count = weights[i << bits : (i + 1) << bits], used[i << bits : (i + 1) << bits]
                order = np.argsort(row, kind="stable")  # by counting, as rows are 16-bit
                ordered = row[order]
                head = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
                n = np.diff(np.append(head, len(row)))
                touched = ordered[head]
                count[touched] += n
                total = slope[order[head]]
                many = np.flatnonzero(n > 1)
                if len(many):  # most rows are met once in a batch
                    inside = np.repeat(n > 1, n)
                    total[many] = np.add.reduceat(slope[order[inside]], np.cumsum(n[many]) - n[many])
                total *= (RATE / np.sqrt(count[touched] * (n + 8.0))).astype(np.float32)[:, None]
                own[touched] = np.clip(own[touched] - total, -MOST, MOST)

        rows = self.class_rows(features, b)
        update(self.weights, rows, CLASS_BITS, self._slope(self._logits(self.weights, CLASS_BITS, rows, self.bias), cls[b]), met[0])
        some = np.flatnonzero(at[b] >= 0) + b.start
        if len(some):
            rows = self.part_rows(features, some, cls[some])
            logit = self._logits(self.members, PART_BITS, rows, self.inside[cls[some]])
            update(self.members, rows, PART_BITS, self._slope(logit, self.part[at[some]]), met[1])


def fold(doc_id: str = "doc_id", folds: int = 7):
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds


def _each(batch: pa.RecordBatch):
    data, offsets = binary(batch.column("text"))
    for first, piece, at in slices(data, offsets):
        yield first, *_tokens(piece, at)


def counted(docs: DataFrame) -> DataFrame:
    """(word, n) of all tokens; tasks count before anything is shuffled."""

    def run(batches):
        held, size = [], 0

        def sent():
            nonlocal held, size
            word, n = np.unique(np.concatenate(held), return_counts=True)
            held, size = [], 0
            return pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(n, pa.int64())], names=["word", "n"])

        for batch in batches:
            for _, hashes, _ in _each(batch):
                held.append(hashes)
                size += len(hashes)
                if size >= FLUSH:
                    yield sent()
        if size:
            yield sent()

    return docs.select("text").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


STEPS = "block int, part int, at binary, used binary, moved binary"
_PIECES = 8


def _summed(batches, tables: tuple[tuple[int, int], ...], fan_in: int):
    """Sums of steps, weighted by use, for each block of rows and each part of the trainers."""
    sums: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
    for batch in batches:
        columns = [batch.column(c) for c in ("at", "used", "moved")]
        for row, (block, part) in enumerate(zip(batch.column("block").to_pylist(), batch.column("part").to_pylist(), strict=True)):
            rows, width = tables[block // _PIECES]
            at, used = (np.frombuffer(c[row].as_buffer(), kind) for c, kind in zip(columns, ("<i4", "<f4"), strict=False))
            moved = columns[2][row].as_buffer()
            if moved.size == 2 * width * len(at):  # a trainer's own steps, at half width
                moved = np.frombuffer(moved, "<f2").reshape(-1, width) * used[:, None]
            else:
                moved = np.frombuffer(moved, "<f4")
            total = sums.setdefault((block, part // fan_in), (np.zeros(rows // _PIECES, np.float32), np.zeros((rows // _PIECES, width), np.float32)))
            total[0][at] += used
            total[1][at] += moved.reshape(-1, width)
    for (block, part), (used, moved) in sums.items():
        at = np.flatnonzero(used)
        yield _step(block, part, at, used[at], moved[at])


def _step(block: int, part: int, at: np.ndarray, used: np.ndarray, moved: np.ndarray, kind: str = "<f4") -> pa.RecordBatch:
    values = (block, part, at.astype("<i4").tobytes(), used.astype("<f4").tobytes(), moved.astype(kind).tobytes())
    kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names=[f.split()[0] for f in STEPS.split(", ")])


def train(docs: DataFrame, counts: DataFrame, rounds: int = 1, taken: int = TAKEN, fan_in: int = FAN_IN) -> Model:
    """Fit on all of ``docs``; the driver sees the head and weights of fixed size.

    A trainer takes ``taken`` partitions, as far as that leaves work for all cores. Its steps are added
    up in a tree, ``fan_in`` trainers at a time, so no task reads more however many trainers there are.
    """
    spark = docs.sparkSession
    sums = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.count("*").alias("kinds")).first()
    head = counts.orderBy(F.desc("n"), "word").limit(HEAD).toArrow()
    model = Model(list(zip(head.column("word").to_pylist(), head.column("n").to_pylist(), strict=True)), int(sums["total"]), int(sums["kinds"]))
    if not len(model.count):
        return model
    texts = docs.select("text")
    trainers = max(1, min(texts.rdd.getNumPartitions(), max(spark.sparkContext.defaultParallelism, -(-texts.rdd.getNumPartitions() // taken))))
    tables = tuple(x.shape for x in (model.weights, model.members))
    for _ in range(rounds):
        handed = spark.sparkContext.broadcast(model)  # of fixed size

        def run(batches, handed=handed):
            own = handed.value.own()
            met = np.zeros(len(own.weights)), np.zeros(len(own.members))
            for batch in batches:
                for _, hashes, first in _each(batch):
                    at, cls, features = own.look(hashes, first)
                    for low in range(0, len(hashes), BATCH):
                        own.step(at, cls, features, slice(low, min(low + BATCH, len(hashes))), met)
            for kind, now, was, used in ((0, own.weights, handed.value.weights, met[0]), (1, own.members, handed.value.members, met[1])):
                size = len(now) // _PIECES
                for i in range(_PIECES):
                    a, b = i * size, (i + 1) * size
                    at = np.flatnonzero(used[a:b])
                    if len(at):
                        yield _step(kind * _PIECES + i, TaskContext.get().partitionId(), at, used[a:b][at], (now[a:b] - was[a:b])[at], "<f2")

        steps = texts.coalesce(trainers).mapInArrow(run, STEPS)
        left = trainers
        while True:
            groups = -(-left // fan_in)
            dealt = steps.repartition(min(2 * _PIECES * groups, partitions(spark)), "block", F.floor(F.col("part") / fan_in))
            steps = dealt.mapInArrow(lambda batches: _summed(batches, tables, fan_in), STEPS)
            left = groups
            if groups == 1:
                break
        for row in steps.toLocalIterator():
            table = (model.weights, model.members)[row["block"] // _PIECES]
            at, used, moved = (np.frombuffer(row[c], kind) for c, kind in (("at", "<i4"), ("used", "<f4"), ("moved", "<f4")))
            table[row["block"] % _PIECES * (len(table) // _PIECES) + at] += moved.reshape(-1, table.shape[1]) / used[:, None]
        model.__setstate__(model.__getstate__())  # as the executors will see it
    return model


SCORED = "kind int, bucket int, key long, doc_id long, n_tokens long, n_known long, base double, score double, words binary, owners binary, keys binary, names binary"
_KINDS = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), *[pa.binary()] * 4)
_NAMES = [f.split()[0] for f in SCORED.split(", ")]


def _rows(n: int, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([columns[k] if k in columns else pa.nulls(n, t) for k, t in zip(_NAMES, _KINDS, strict=True)], names=_NAMES)


def score(docs: DataFrame, model: Model, counts: DataFrame) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score and score (log10) of every row.

    A row's head tokens are scored where it is read. Its rare tokens go by bucket of their hash to
    their counts, and what they add comes back by doc_id and a hash of the text. Counts come first in a bucket,
    so that questions stream past them.
    """
    spark = docs.sparkSession
    buckets = max(width(docs), model.kinds // RARE_WORDS)
    handed = spark.sparkContext.broadcast(model)
    ten, below = np.log(10), float(np.log10(model.total + model.kinds + 1))

    def run(batches):
        model = handed.value
        words, owners, keys, ids, size = [], [], [], [], 0

        def sent():
            nonlocal words, owners, keys, ids, size
            word, owner, key, name = np.concatenate(words), np.concatenate(owners), np.concatenate(keys), np.concatenate(ids, 1)
            bucket = (mixed(word) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
            rows: list[list] = [[] for _ in range(5)]
            for b in np.unique(bucket).tolist():
                part = order[edges[b] : edges[b + 1]]
                used, local = np.unique(owner[part], return_inverse=True)
                for column, value in zip(rows, (b, word[part].tobytes(), local.astype("<i4").tobytes(), key[used].tobytes(), name[:, used].tobytes()), strict=True):
                    column.append(value)
            words, owners, keys, ids, size = [], [], [], [], 0
            n = len(rows[0])
            return _rows(n, kind=pa.array([1] * n, pa.int32()), bucket=pa.array(rows[0], pa.int32()), **{k: pa.array(v, pa.binary()) for k, v in zip(("words", "owners", "keys", "names"), rows[1:], strict=True)})

        total = 0
        for batch in batches:
            names = batch.column("doc_id")
            number = np.stack([names.fill_null(0).to_numpy(), names.is_valid().cast(pa.int64()).to_numpy()])
            for row, hashes, first in _each(batch):
                at, logs = model.logs(hashes, first)
                known = at >= 0
                n = len(first) - 1
                head = first[:-1]
                base = np.add.reduceat((np.where(known, np.log10(model.count[at] + 1.0), 0.0) if len(model.count) else np.zeros(len(at))) - below, head)
                place = np.arange(len(hashes), dtype=np.uint64) - np.repeat(head, np.diff(first)).astype(np.uint64)
                key = mixed(np.add.reduceat(mixed(hashes + mixed(place + np.uint64(1))), head)).view(np.int64)
                yield _rows(
                    n,
                    kind=pa.array(np.zeros(n, np.int32)),
                    bucket=pa.array((mixed(key.view(np.uint64) + number[0, row : row + n].view(np.uint64)) % np.uint64(buckets)).astype(np.int32)),
                    key=pa.array(key),
                    doc_id=names.slice(row, n),
                    n_tokens=pa.array(np.diff(first)),
                    n_known=pa.array(np.add.reduceat(known.astype(np.int64), head)),
                    base=pa.array(base),
                    score=pa.array(np.add.reduceat(logs, head) / ten),
                )
                words.append(hashes[~known])
                owners.append(np.repeat(np.arange(total, total + n), np.diff(first))[~known])
                keys.append(key)
                ids.append(number[:, row : row + n])
                total += n
                size += len(words[-1])
                if size >= FLUSH // 2:
                    yield sent()
                    total = 0
        if size:
            yield sent()

    def packed(batches):
        """Counts of rare words, by bucket."""
        for batch in batches:
            word, n = batch.column("word").to_numpy().view(np.uint64), batch.column("n").to_numpy()
            keep = handed.value.table.find(word) < 0
            word, n = word[keep], n[keep]
            bucket = (mixed(word) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
            some = [b for b in range(buckets) if edges[b + 1] > edges[b]]
            parts = [order[edges[b] : edges[b + 1]] for b in some]
            yield _rows(len(some), kind=pa.array([2] * len(some), pa.int32()), bucket=pa.array(some, pa.int32()), words=pa.array([word[p].tobytes() for p in parts], pa.binary()), owners=pa.array([n[p].tobytes() for p in parts], pa.binary()))

    def met(batches):
        words, n, at, table, count = [], [], None, None, None
        for batch in batches:
            kind, bucket = batch.column("kind").to_numpy(), batch.column("bucket").to_numpy()
            plain = np.flatnonzero(kind == 0)
            if len(plain):
                out = batch.take(pa.array(plain))
                yield pa.RecordBatch.from_arrays([out.column("key"), out.column("doc_id"), pa.array(np.ones(len(plain), np.int64)), *[out.column(c) for c in ("n_tokens", "n_known", "base", "score")]], names=PARTS)
            for row in np.flatnonzero(kind).tolist():
                if bucket[row] != at:
                    words, n, at, table = [], [], int(bucket[row]), None
                body = [batch.column(c)[row] for c in ("words", "owners", "keys", "names")]
                if kind[row] == 2:
                    words.append(np.frombuffer(body[0].as_buffer(), np.uint64))
                    n.append(np.frombuffer(body[1].as_buffer(), np.int64))
                    continue
                if table is None:
                    word = np.concatenate(words) if words else np.zeros(0, np.uint64)
                    order = np.argsort(word)
                    table, count = _Table(word[order]), np.concatenate(n)[order] if n else np.zeros(1, np.int64)
                    words, n = [], []
                hashes, owner, key, name = (np.frombuffer(v.as_buffer(), t) for v, t in zip(body, (np.uint64, "<i4", np.int64, np.int64), strict=True))
                place, name = table.find(hashes), name.reshape(2, -1)
                more = np.log10(np.where(place >= 0, count[place], 0) + 1.0)
                gain = np.bincount(owner, more, len(key))
                seen = np.bincount(owner[place >= 0], minlength=len(key))
                some = np.flatnonzero(seen)
                none = pa.array(np.zeros(len(some), np.int64))
                named = pa.array(name[0, some], mask=name[1, some] == 0)
                yield pa.RecordBatch.from_arrays([pa.array(key[some]), named, none, none, pa.array(seen[some].astype(np.int64)), pa.array(gain[some]), pa.array(gain[some])], names=PARTS)

    asked = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SCORED)
    known = counts.mapInArrow(packed, SCORED)
    parts = asked.unionByName(known).repartition(buckets, "bucket").sortWithinPartitions("bucket", F.desc("kind")).mapInArrow(met, "key long, doc_id long, copies long, n_tokens long, n_known long, base double, score double")
    summed = parts.groupBy("doc_id", "key").agg(*[F.sum(c).alias(c) for c in ("copies", "n_tokens", "n_known", "base", "score")])
    each = summed.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    whole = lambda c: (F.col(c) / F.col("copies")).cast("long").alias(c)
    return each.select("doc_id", whole("n_tokens"), whole("n_known"), (F.col("base") / F.col("copies")).alias("base_score"), (F.col("score") / F.col("copies")).alias("score"))


PARTS = ["key", "doc_id", "copies", "n_tokens", "n_known", "base", "score"]


def fit_and_score(docs: DataFrame, held_fold: int = 2, folds: int = 7) -> tuple[DataFrame, Model]:
    """Train on all rows outside the held-out fold and score every row."""
    base = lean(docs).select("doc_id", "text")
    taught = base.where(~F.coalesce(fold(folds=folds) == held_fold, F.lit(False)))
    counts = cut(counted(taught))
    model = train(taught, counts)
    return score(base, model, counts), model
