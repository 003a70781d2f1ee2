"""Benchmark decontamination by winnowing.

Every window of ``WINDOW`` words keeps its least ``GRAM``-gram hash as a fingerprint, on the test side as on
the training side, so a shared span of that length always shares one; where some test item is shorter, both
sides winnow by its length. Fingerprints of texts and of items meet in an equi-join, whose test side is
broadcast under a checked number of rows and shuffled beyond it. Each hit is then extended over the words of
the text and of the item: windows that agree in all bytes are merged into spans, whose words are marked.

Texts go by a hash until then; where two share one, each is held against the items of both. Null and empty
texts have no words and no hits; items without words are none; equal item ids count once (no id: the empty one);
equal rows are judged alike. Nothing of texts or items reaches the driver.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.llm.common import LETTERED, LOWER, appended, binary, cut, gram_hashes, lean, slices, spans, word_hashes

#: Words of a window, and of a fingerprint.
WINDOW, GRAM = 13, 5
#: Rows of a fingerprint table, and bytes of item texts, that may be broadcast.
PRINTS, HELD = 1_000_000, 32 << 20


def fingerprints(grams: np.ndarray, width: int) -> np.ndarray:
    """Places of the least (then leftmost) hash of every window of ``width`` grams, ascending."""
    count = len(grams) - width + 1
    if count <= 0:
        return np.zeros(0, np.int64)
    least, at = grams[:count].copy(), np.arange(count)
    for i in range(1, width):
        better = grams[i : i + count] < least
        least[better] = grams[i : i + count][better]
        at[better] = np.flatnonzero(better) + i
    return at[np.flatnonzero(np.diff(at, prepend=-1))]


def _hashed(data: np.ndarray, offsets: np.ndarray):
    """Lower-cased bytes, words as (start, end), their hashes, and each text's first word."""
    data = LOWER[data]
    start, stop, first = spans(data, offsets, LETTERED)
    return data, start, stop, word_hashes(data, start, stop), first


def prints(texts: DataFrame, span: int, gram: int) -> DataFrame:
    """(key, print) of all texts (key, text): distinct fingerprints for each run of a text."""

    def run(batches):
        for batch in batches:
            data, offsets = binary(batch.column("text"))
            keys = batch.column("key").to_numpy()
            for row, piece, at in slices(data, offsets):
                _, _, _, hashes, first = _hashed(piece, at)
                grams = gram_hashes(hashes, gram)
                places = fingerprints(grams, span - gram + 1)
                owner = np.searchsorted(first, places, "right") - 1
                inside = places + gram <= first[owner + 1] if len(places) else np.zeros(0, bool)
                found, owner = grams[places[inside]], owner[inside]
                order = np.lexsort((found, owner))
                found, owner = found[order], owner[order]
                new = np.ones(len(found), bool)
                new[1:] = (found[1:] != found[:-1]) | (owner[1:] != owner[:-1])
                yield pa.RecordBatch.from_arrays([pa.array(keys[row + owner[new]]), pa.array(found[new].view(np.int64))], names=["key", "print"])

    return texts.select("key", "text").mapInArrow(run, "key long, print long")


def least_words(texts: DataFrame) -> int:
    """Words of the shortest text that has any; 0 where none has."""

    def run(batches):
        least = 0
        for batch in batches:
            for _, piece, at in slices(*binary(batch.column("text"))):
                n = np.diff(spans(LOWER[piece], at, LETTERED)[2])
                if (n > 0).any():
                    least = min(least or int(n.max()), int(n[n > 0].min()))
        if least:
            yield pa.RecordBatch.from_arrays([pa.array([least], pa.int64())], names=["n"])

    return texts.select("text").mapInArrow(run, "n long").agg(F.min("n")).first()[0] or 0


class Pairs:
    """A text's words, to be held against one item after the other."""

    def __init__(self, text: bytes):
        self.words, self.hashes = self.split(text)

    @staticmethod
    def split(text: bytes) -> tuple[list[bytes], np.ndarray]:
        flat = np.frombuffer(text, np.uint8)
        data, start, stop, hashes, _ = _hashed(flat, np.array([0, len(flat)]))
        raw = data.tobytes()
        return [raw[a:b] for a, b in zip(start.tolist(), stop.tolist(), strict=True)], hashes

    def spans(self, item: tuple[list[bytes], np.ndarray], window: int) -> list[tuple[int, int]]:
        """Spans (first, after last) of the text's words inside windows of the item."""
        words, hashes = item
        n = min(window, len(words))
        if not n or n > len(self.words):
            return []
        theirs = gram_hashes(hashes, n)
        places = np.flatnonzero(np.isin(gram_hashes(self.hashes, n), theirs)).tolist()
        known = {tuple(words[i : i + n]) for i in range(len(theirs))} if places else set()
        return _union([(p, p + n) for p in places if tuple(self.words[p : p + n]) in known])


def _union(marks: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(marks):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def candidates(docs: DataFrame, items: DataFrame, window: int, gram: int, most: int) -> DataFrame | None:
    """(key, items) of texts that share a fingerprint with items, ``items`` as structs of name and text."""
    items = items.withColumn("key", F.xxhash64("name", "text"))
    span = min(window, least_words(items))
    if not span:
        return None
    gram = min(gram, span)
    theirs = cut(prints(items, span, gram).distinct()).select(F.col("key").alias("item"), "print")
    theirs = F.broadcast(theirs) if theirs.count() <= most else theirs
    met = prints(docs, span, gram).join(theirs, "print").select("key", "item").distinct()
    named = items.select(F.col("key").alias("item"), F.struct("name", "text").alias("it"))
    return cut(met.join(named, "item").groupBy("key").agg(F.collect_set("it").alias("items")))


def mark(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, gram: int = GRAM, most: int = PRINTS, held: int = HELD) -> DataFrame:
    """``docs`` with ``n_words``, ``hit_spans`` (word places), ``n_hit``, ``hit_items`` and ``contaminated``.

    Contaminated: one word in 20 or more is hit. Columns of the input with these names give way.
    """
    added = {"n_words": "long", "hit_spans": "array<struct<first:int,last:int>>", "n_hit": "long", "hit_items": "array<string>", "contaminated": "boolean"}
    kinds = [pa.int64(), pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())])), pa.int64(), pa.list_(pa.string()), pa.bool_()]
    own = [f for f in lean(docs).schema.fields if f.name not in added]
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in own], *[f"{k} {v}" for k, v in added.items()]])
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    tests = items.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("name"), F.col(item_text).cast("string").alias("text")).where("text is not null").distinct()
    met = candidates(docs.select(F.xxhash64(body).alias("key"), body.alias("text")), tests, window, gram, most)
    keyed = docs.select(*[f.name for f in own], F.xxhash64(body).alias("__key"))
    if met is None:
        keyed = keyed.withColumn("__items", F.lit(None).cast("array<struct<name:string,text:string>>"))
    else:
        met = met.select(F.col("key").alias("__key"), F.col("items").alias("__items"))
        size = met.agg(F.coalesce(F.sum(F.aggregate("__items", F.lit(64).cast("long"), lambda n, x: n + 64 + F.length(x["text"]))), F.lit(0))).first()[0]
        keyed = keyed.join(F.broadcast(met) if size <= held else met, "__key", "left")

    def run(batches):
        split: dict[str, tuple] = {}
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text))
            data, offsets = binary(column)
            counted = [np.diff(spans(LOWER[piece], at, LETTERED)[2]) for _, piece, at in slices(data, offsets)]
            n = np.concatenate(counted) if counted else np.zeros(0, np.int64)
            rows: list[tuple] = []
            for row, those in enumerate(batch.column(batch.schema.get_field_index("__items"))):
                marks, names = [], set()
                if those.is_valid:
                    pairs = Pairs(data[offsets[row] : offsets[row + 1]].tobytes())
                    for item in those.as_py():
                        if item["text"] not in split:
                            if len(split) > 10_000:
                                split.clear()
                            split[item["text"]] = Pairs.split(item["text"].encode())
                        if found := pairs.spans(split[item["text"]], window):
                            marks += found
                            names.add(item["name"])
                joined = _union(marks)
                hit = sum(b - a for a, b in joined)
                rows.append((int(n[row]), [{"first": a, "last": b} for a, b in joined], hit, sorted(names), hit > 0 and 20 * hit >= n[row]))
            columns = zip(*rows, strict=True) if rows else [[]] * 5
            arrays = {k: pa.array(list(c), kind) for (k, c), kind in zip(zip(added, columns, strict=True), kinds, strict=True)}
            yield appended(batch.select([f.name for f in own]), arrays)

    return keyed.mapInArrow(run, schema)
