"""The pipeline's stages: what they drop, keep and cut."""

import random

import corpus_pipeline
import pytest

from lamina.llm import decontamination
from lamina.llm.common import read

WORDS = "amber birch cedar dune ember fjord grove heath inlet jetty knoll ledge marsh north ocean".split()


def prose(seed: int, n: int = 90) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + str(rng.randrange(50)) for _ in range(n))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    top = tmp_path_factory.mktemp("sf")
    texts = {i: prose(i) for i in range(60)}
    for i in range(0, 60, 4):
        texts[i] += " you filthy gronk and wretched snarl"
    texts[101] = prose(7) + " end"
    texts[102] = "start " + prose(9, 40) + " middle " + prose(201, 60)
    benchmark = prose(333, 30)
    texts[103] = benchmark + " " + prose(334, 60)
    texts[104], texts[105] = "", None
    rows = [(i, t, "en", "s", len(t or "")) for i, t in texts.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(top / "documents.parquet"))
    spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(str(top / "labels.parquet"))
    spark.createDataFrame([(1, benchmark)], "item_id long, text string").write.parquet(str(top / "benchmark.parquet"))
    return str(top)


def test_stages_take_effect(spark, folder):
    docs = read(spark, folder, "documents")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "ngram_jaccard_join", "suffix_dedup", "benchmark_decontamination", "best_fit_packing"]
    kept = {}
    for name, stage in list(stages.items())[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        kept[name] = {r["doc_id"]: r for r in docs.collect()}
    clean = {i for i in range(60) if i % 4}
    assert clean <= set(kept["toxicity"]) and not set(kept["toxicity"]) & {i for i in range(60) if i % 4 == 0}
    assert set(kept["toxicity"]) - set(kept["ngram_jaccard_join"]) == {101}
    cut = kept["suffix_dedup"][102]
    assert cut["text"].startswith("start ") and prose(9, 30) not in cut["text"] and cut["n_chars"] == len(cut["text"])
    assert set(kept["suffix_dedup"]) - set(kept["benchmark_decontamination"]) == {103}
    assert {104, 105} <= set(kept["benchmark_decontamination"])
    packed = stages["best_fit_packing"](spark, docs, folder).collect()
    assert {r["doc_id"] for r in packed} == set(kept["benchmark_decontamination"])


def test_what_is_left_has_no_benchmark_passage(spark, data):
    docs, items = read(spark, data, "documents"), read(spark, data, "benchmark")
    left = dict(corpus_pipeline.STAGES)["benchmark_decontamination"](spark, docs, data)
    assert decontamination.mark(left, items).where("n_hit > 0").count() == 0
    clean = decontamination.mark(docs, items).where("n_hit = 0").count()
    assert left.count() == clean < docs.count()


def test_near_duplicates_of_odd_rows(spark, folder):
    text = prose(1, 60)
    rows = [(1, text), (1, text), (2, text), (2, prose(2, 60)), (None, text), (None, None), (3, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    left = dict(corpus_pipeline.STAGES)["ngram_jaccard_join"](spark, docs, folder)
    assert sorted((str(r["doc_id"]), r["text"] or "") for r in left.collect()) == sorted([("1", text), ("2", prose(2, 60)), ("None", text), ("None", ""), ("3", "")])


def test_extra_columns_pass(spark, folder):
    docs = read(spark, folder, "documents").selectExpr("*", "doc_id % 3 as n_words", "'x' as kept", "array(1) as own", "1.5 as score")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns, name
        assert out.where("kept = 'x' and score = 1.5 and own[0] = 1").count() == out.count(), name


def test_empty_documents(spark, folder):
    docs = read(spark, folder, "documents").where("false")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, folder).count() == 0, name


def test_run(spark, folder):
    rows = corpus_pipeline.run(spark, folder).collect()
    assert rows and {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"} == set(rows[0].asDict())
