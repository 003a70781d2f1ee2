"""Toxicity by class-conditional Kneser-Ney models.

Two interpolated bigram models, one of toxic and one of ordinary texts, are compared token by token.
Both fall back from bigrams to the spread of words, then of stems, over the words before them, and from
there to counts that they share: an expression seen ``RARE`` times or less in a class rests on them alone,
and so weighs the same in both. The log-likelihood ratios of a text are normalised by length (their mean) and by
the length of a short window (the highest means of one), and a logistic curve turns them into a score.

The models are fitted on a bounded sample of labelled rows: at most ``SAMPLE_DOCS`` toxic and
``ORDINARY`` times as many ordinary ones, the first by a hash of doc_id, each with its whole text. They
are counted where they are read; what is rare in both classes never reaches the driver. Empty and null
texts get the score of no evidence; rows without a usable label teach nothing; equal rows score alike.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.llm.common import LETTERED, LOWER, appended, binary, cut, gram_hashes, lean, slices, spans, word_hashes

SAMPLE_DOCS = 3000
#: Ordinary texts for each toxic one, so that a word's absence from them means something.
ORDINARY = 3
#: Counts up to which an expression rests on the shared step alone (if in both classes), bytes of a stem,
#: tokens of the short window, bound of one token's ratio.
RARE, STEM, WINDOW, BOUND = 3, 5, 4, 6.0
THRESHOLD = 0.7


def discounts(counts_of_counts: np.ndarray) -> np.ndarray:
    """What is taken off counts of 1, 2 and more, from how many expressions occur once to four times."""
    n1, n2, n3, n4 = (float(n) for n in counts_of_counts)
    y = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
    taken = [k - (k + 1) * y * (b / a) if a and b else y for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
    return np.clip(taken, 0.1, [0.95, 1.9, 2.85])


def taken_off(counts: np.ndarray, discount: np.ndarray) -> np.ndarray:
    return np.where(counts > 0, discount[np.clip(counts, 1, 3).astype(np.int64) - 1], 0.0)


class Model:
    """Two classes (ordinary, toxic) over the expressions that are not rare in both, and the logistic curve.

    ``words``: word, stem, both spreads; ``stems``: stem, both spreads, spread of its words;
    ``pairs``: word before, word, both counts, both totals of the word before; ``sums``: for each class the
    spread of all words, that of the words left out, and the same of stems; all as 64-bit integers.
    ``off``: discounts by class, for words, stems and pairs.
    """

    def __init__(self, words: np.ndarray, stems: np.ndarray, pairs: np.ndarray, sums: np.ndarray, off: np.ndarray):
        words, stems = (x[np.argsort(x[:, 0].view(np.uint64))] for x in (words, stems))
        self.words, self.stems = (np.ascontiguousarray(x[:, 0]).view(np.uint64) for x in (words, stems))
        stem_of, _ = self._at(self.stems, np.ascontiguousarray(words[:, 1]).view(np.uint64))
        head, tail = (np.ascontiguousarray(pairs[:, i]).view(np.uint64) for i in (0, 1))
        grams = gram_hashes(np.stack([head, tail], 1).ravel(), 2)[::2] if len(pairs) else head
        order = np.argsort(grams)
        self.grams, self.heads = grams[order], np.unique(head)
        known, all_words = float(sums[:, 0].sum()) + 1, words[:, 2:4].sum(1)
        inside = stems[:, 3] + 1.0
        self.single, self.new, self.extra, self.back = [], [], [], []
        for c in (0, 1):
            total, left, stem_total, stem_left = (float(v) for v in sums[c])
            word_off, stem_off, pair_off = (taken_off(x, d) for x, d in zip((words[:, 2 + c], stems[:, 1 + c], pairs[:, 2 + c]), off[c], strict=True))
            rest = (word_off.sum() + left) / total if total else 1.0
            low = (stem_off.sum() + stem_left) / stem_total if stem_total else 1.0
            stem = (stems[:, 1 + c] - stem_off) / max(stem_total, 1) + low * stems[:, 3] / known
            own = (words[:, 2 + c] - word_off) / max(total, 1)
            self.single.append(own + rest * stem[stem_of] * all_words / inside[stem_of] if len(stem) else own)
            self.new.append(np.append(rest * stem / inside, rest * low / known))
            extra = (pairs[:, 2 + c] - pair_off) / np.maximum(pairs[:, 4 + c], 1)
            self.extra.append(extra[order])
            self.back.append(1 - np.bincount(np.searchsorted(self.heads, head), extra, len(self.heads)))
        self.weights = np.zeros(4)

    @staticmethod
    def _at(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(table):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
        return at, table[at] == keys

    def ratios(self, hashes: np.ndarray, stems: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Log-likelihood ratio (toxic over ordinary) of each token after the one before it.

        It is taken from that of a word whose very stem is unknown, about which the classes agree.
        """
        if not len(hashes):
            return np.zeros(0)
        word, known = self._at(self.words, hashes)
        stem, seen_stem = self._at(self.stems, stems)
        stem = np.where(seen_stem, stem, len(self.stems))
        begins = np.zeros(len(hashes), bool)
        begins[first[:-1][first[:-1] < len(hashes)]] = True
        head, seen_head = self._at(self.heads, np.concatenate([hashes[:1], hashes[:-1]]))
        seen_head &= ~begins
        gram, seen = self._at(self.grams, np.concatenate([np.zeros(1, np.uint64), gram_hashes(hashes, 2)]))
        seen &= ~begins
        logs = []
        for c in (0, 1):
            single = self.new[c][stem]
            single[known] = self.single[c][word[known]]
            level = np.ones(len(hashes))
            level[seen_head] = np.maximum(self.back[c][head[seen_head]], 1e-9)
            chance = level * single
            chance[seen] += self.extra[c][gram[seen]]
            logs.append(np.log(chance) - np.log(level * self.new[c][-1]))
        return np.clip(logs[1] - logs[0], -BOUND, BOUND)

    def features(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """For each text: 1, mean ratio, highest and second highest ratio per short window."""
        data = LOWER[data]
        start, stop, first = spans(data, offsets, LETTERED)
        ratio = self.ratios(word_hashes(data, start, stop), word_hashes(data, start, np.minimum(stop, start + STEM)), first)
        n = np.diff(first)
        out = np.zeros((len(n), 4))
        out[:, 0] = 1
        some = np.flatnonzero(n)
        if len(some):
            out[some, 1] = np.add.reduceat(ratio, first[some]) / n[some]
            gain, end, owner = np.maximum(ratio, 0), np.repeat(first[1:], n), np.repeat(np.arange(len(some)), n[some])
            for peak in (2, 3):
                sums = gain.copy()  # of the window that begins at each token, cut at its text's end
                for k in range(1, WINDOW):
                    sums[:-k] += np.where(np.arange(k, len(gain)) < end[:-k], gain[k:], 0)
                top = np.maximum.reduceat(sums, first[some])
                out[some, peak] = top / WINDOW
                at = np.flatnonzero(sums == top[owner])
                best = at[np.unique(owner[at], return_index=True)[1]]
                inside = best[:, None] + np.arange(WINDOW)
                gain[inside[inside < end[best][:, None]]] = 0  # the second peak lies outside the first window
        return out

    def fit_curve(self, x: np.ndarray, labels: np.ndarray) -> None:
        """Ridge-penalised logistic regression by Newton steps on features of texts the counts haven't seen."""
        w = np.zeros(4)
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            slope = x.T @ (labels - p) - 0.01 * w
            bend = (x * (p * (1 - p))[:, None]).T @ x + 0.01 * np.eye(4)
            w = w + np.linalg.solve(bend, slope)
        self.weights = w

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.features(data, offsets) @ self.weights, -30, 30)))


def _tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Word, stem and word before (0 at a text's start) of all tokens, and each text's tokens."""
    data = LOWER[data]
    start, stop, first = spans(data, offsets, LETTERED)
    words, stems = word_hashes(data, start, stop), word_hashes(data, start, np.minimum(stop, start + STEM))
    before = np.concatenate([words[:0], np.zeros(min(len(words), 1), np.uint64), words[:-1]])
    before[first[:-1][first[:-1] < len(words)]] = 0
    return words, stems, before, np.diff(first)


def _counted(sample: DataFrame) -> Model:
    """The two classes of a sample (toxic, text), counted where the texts are; rare expressions stay there."""

    def run(batches):
        for batch in batches:
            data, offsets = binary(batch.column("text"))
            toxic = batch.column("toxic").to_numpy()
            for row, piece, at in slices(data, offsets):
                words, stems, before, n = _tokens(piece, at)
                label = np.repeat(toxic[row : row + len(n)], n)
                yield pa.RecordBatch.from_arrays([pa.array(label, pa.int32()), *[pa.array(x.view(np.int64)) for x in (words, stems, before)]], names=["toxic", "word", "stem", "before"])

    tokens = sample.select("toxic", "text").mapInArrow(run, "toxic int, word long, stem long, before long")
    seen = cut(tokens.groupBy("toxic", "before", "word", "stem").agg(F.count("*").alias("n")))
    side = lambda value, c: F.sum(F.when(F.col("toxic") == c, value).otherwise(0)).alias(f"n{c}")
    both = lambda value: [side(value, 0), side(value, 1)]
    words = seen.groupBy("word", "stem").agg(*both(F.lit(1)))
    inside = words.groupBy("stem").agg(F.sum(F.col("n0") + F.col("n1")).alias("inside"))
    stems = seen.select("toxic", "before", "stem").distinct().groupBy("stem").agg(*both(F.lit(1))).join(inside, "stem")
    pairs = seen.where("before <> 0").groupBy("before", "word").agg(*both(F.col("n")))
    totals = seen.where("before <> 0").groupBy("before").agg(*[c.alias(f"t{i}") for i, c in enumerate(both(F.col("n")))])
    some = (F.col("n0") > RARE) | (F.col("n1") > RARE)

    def table(df: DataFrame, *columns: str) -> np.ndarray:
        got = df.select(*[F.col(c).cast("long") for c in columns]).toArrow()
        return np.stack([got.column(c).to_numpy() for c in columns], 1).astype(np.int64)

    def sums(df: DataFrame) -> tuple[list[list[int]], np.ndarray]:
        """For each class: all counts, those of rows left out, and discounts."""
        total = lambda value: F.coalesce(F.sum(value), F.lit(0)).cast("long")
        wanted = []
        for c in (0, 1):
            n = F.col(f"n{c}")
            wanted += [total(n), total(F.when(some, 0).otherwise(n)), *[total((n == k).cast("long")) for k in (1, 2, 3, 4)]]
        row = list(df.agg(*[w.alias(f"s{i}") for i, w in enumerate(wanted)]).first())
        return [row[0:2], row[6:8]], np.array([discounts(np.array(row[2:6])), discounts(np.array(row[8:12]))])

    (word_sums, word_off), (stem_sums, stem_off), (_, pair_off) = sums(words), sums(stems), sums(pairs)
    spread = np.array([a + b for a, b in zip(word_sums, stem_sums, strict=True)], np.int64)
    return Model(
        table(words.where(some), "word", "stem", "n0", "n1"),
        table(stems.where(some), "stem", "n0", "n1", "inside"),
        table(pairs.where(some).join(totals, "before"), "before", "word", "n0", "n1", "t0", "t1"),
        spread,
        np.stack([word_off, stem_off, pair_off], 1),
    )


def remainder(doc_id: str = "doc_id", fold: int = 3):
    """crc32 of doc_id as text, modulo the number of folds."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % fold


def train(docs: DataFrame, labels: DataFrame, most_docs: int = SAMPLE_DOCS) -> Model:
    """Fit on labelled rows whose fold is not 1. Two thirds of the sample are counted, one third fits the curve."""
    lean(docs)
    usable = labels.where(F.col("toxic").isin(0, 1) & (remainder() != 1)).select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    drawn = None
    for value in (0, 1):
        some = usable.where(F.col("toxic") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_docs if value else ORDINARY * most_docs)
        drawn = some if drawn is None else drawn.unionByName(some)
    drawn = cut(drawn)  # at most (ORDINARY + 1) * most_docs rows
    sample = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text")).join(F.broadcast(drawn), "doc_id")
    third = F.pmod(F.xxhash64("text"), F.lit(3)) == 0  # copies fall together
    sample = cut(sample.select("toxic", "text", third.alias("held")).dropDuplicates(["toxic", "text"]))
    model = _counted(sample.where("not held"))

    def run(batches):
        for batch in batches:
            data, offsets = binary(batch.column("text"))
            found = [model.features(piece, at) for _, piece, at in slices(data, offsets)]
            x = np.concatenate(found) if found else np.zeros((0, 4))
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), *[pa.array(x[:, i]) for i in range(4)]], names=["toxic", "a", "b", "c", "d"])

    got = sample.where("held").select("toxic", "text").mapInArrow(run, "toxic int, a double, b double, c double, d double").toArrow()
    model.fit_curve(np.stack([got.column(c).to_numpy() for c in "abcd"], 1), got.column("toxic").to_numpy().astype(float))
    return model


def score(docs: DataFrame, model: Model, text: str = "text", into: str = "score") -> DataFrame:
    """``docs`` with the score as a column, which replaces one of the same name."""
    handed = lean(docs).sparkSession.sparkContext.broadcast(model)  # bounded by the sample

    def run(batches):
        for batch in batches:
            data, offsets = binary(batch.column(batch.schema.get_field_index(text)))
            found = [handed.value.scores(piece, at) for _, piece, at in slices(data, offsets)]
            yield appended(batch, {into: pa.array(np.concatenate(found) if found else np.zeros(0), pa.float64())})

    own = [f for f in docs.schema.fields if f.name != into]
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in own], f"`{into}` double"])
    return docs.mapInArrow(run, schema)
