"""One text of some megabytes among short ones, through every operator."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lamina.llm import decontamination, jaccard_join, lm_scoring, packing, quality_rules, suffix_dedup, token_counts, token_files, toxicity

BYTE_BPE, WORD_BPE = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))
_RNG = random.Random(11)
LONG = " ".join(f"{_RNG.choice('abcdefgh')}{_RNG.randrange(3000)}" for _ in range(420_000))
PASSAGE = " ".join(f"q{i}" for i in range(40))
TEXTS = {1: "short " + PASSAGE, 2: LONG[: len(LONG) // 2] + " " + PASSAGE + " " + LONG[len(LONG) // 2 :], 3: LONG, 4: LONG, 5: None}


@pytest.fixture(scope="module")
def docs(spark):
    assert len(LONG) > 2_000_000
    return spark.createDataFrame(list(TEXTS.items()), "doc_id long, text string").repartition(2)


def test_quality(docs):
    got = {r["doc_id"]: r for r in quality_rules.judge(docs).collect()}
    words = LONG.split(" ")
    grams = Counter(zip(words, words[1:], words[2:], strict=False))
    repeated = {i + k for i, g in enumerate(zip(words, words[1:], words[2:], strict=False)) if grams[g] > 1 for k in range(3)}
    assert got[3]["n_words"] == len(words) and got[3]["n_repeat_words"] == len(repeated) and got[5]["n_words"] == 0


def test_suffix_dedup(docs):
    got = {r["doc_id"]: r for r in suffix_dedup.mark(docs).collect()}
    assert got[2]["n_removed"] >= len(PASSAGE) and got[1]["n_removed"] == 0
    assert got[4]["n_removed"] == len(LONG) and bytes(got[4]["kept"]) == b""
    assert got[3]["n_removed"] == len(LONG)  # both halves lie in the longer text, and so do the strings over their seam's sides


def test_scores(spark, docs):
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 0), (4, 0)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    rows = toxicity.score(docs.withColumn("score", docs["doc_id"] * 10), model).collect()
    assert len(rows) == 5 and all(0 <= r["score"] <= 1 for r in rows) and len({r["score"] for r in rows if r["doc_id"] in (3, 4)}) == 1
    scored, _ = lm_scoring.fit_and_score(docs)
    got = {r["doc_id"]: r for r in scored.collect()}
    assert got[3]["n_tokens"] == len(LONG.split(" ")) + 1 and got[3]["score"] == pytest.approx(got[4]["score"]) and got[5]["n_tokens"] == 1


def test_tokens(spark, docs):
    engine = Tokenizer.from_file(BYTE_BPE)
    whole = [*engine.encode(LONG, add_special_tokens=False).ids, 0]
    rows = [r for r in packing.pack(docs, BYTE_BPE).collect() if r["doc_id"] == 3]
    flat = np.array(whole, "<u4")
    assert sum(r["length"] for r in rows) == len(whole)
    for r in rows[::50]:
        assert r["ids_crc32"] == zlib.crc32(flat[r["start"] : r["start"] + r["length"]].tobytes())
    path = token_files.folder(spark, "flat")
    counted = token_counts.counted(spark, path, token_counts.write_flat(docs, path, BYTE_BPE))
    assert {r["doc_id"]: r["n_tokens"] for r in counted.collect()}[4] == len(whole) - 1
    path = token_files.folder(spark, "tokens")
    token_files.write(docs, path, WORD_BPE, shard=1000)
    want = np.array([*Tokenizer.from_file(WORD_BPE).encode(LONG, add_special_tokens=False).ids, 2], "<u4")
    got = {r["doc_id"]: r for r in token_files.read_back(spark, path).collect()}
    assert got[3]["ids_crc32"] == zlib.crc32(want.tobytes()) and got[3]["n_ends"] == int((want == 2).sum())


def test_joins(spark, docs):
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in jaccard_join.join(docs).collect()}
    assert got == {1: (1, 0), 2: (2, 2), 3: (2, 2), 4: (2, 2), 5: (5, 0)}
    items = spark.createDataFrame([(7, PASSAGE), (8, LONG[:3000])], "item_id long, text string")
    marked = {r["doc_id"]: r for r in decontamination.mark(docs, items).collect()}
    words = len(re.findall(r"\S+", LONG[:3000]))
    assert marked[2]["hit_items"] == ["7", "8"] and marked[1]["n_hit"] == 40
    assert words - 1 <= marked[3]["n_hit"] <= words and not marked[3]["contaminated"]
    assert hashlib.sha256(marked[3]["text"].encode()).digest() == hashlib.sha256(LONG.encode()).digest()
