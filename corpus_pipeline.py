"""A training-corpus pipeline: five operators, each over all that the one before it kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.llm import decontamination, jaccard_join, packing, suffix_dedup, token_files, toxicity
from lamina.llm.common import cut, read
from lamina.llm.queries import vocabulary


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored under the threshold stay; the models learn from ``docs`` and the labels table."""
    model = toxicity.train(docs.select("doc_id", "text"), read(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model, into="__toxicity")
    return scored.where(F.col("__toxicity") < toxicity.THRESHOLD).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of similar rows one stays, of the least doc_id; rows without a doc_id stay."""
    classes = cut(jaccard_join.join(docs.select("doc_id", "text")).where("doc_id is not null"))
    texts = classes.groupBy(F.col("doc_id").alias("__id"), F.col("mark").alias("__mark")).agg(F.max("kept").alias("__kept"), F.count("*").alias("__rows"))
    same = lambda found: (docs["doc_id"] == found["__id"]) & (F.xxhash64(docs["text"]) == found["__mark"])
    gone = texts.where(~F.col("__kept"))
    left = docs.join(gone, same(gone), "left_anti")
    twice = texts.where("__kept and __rows > 1")  # a document given more than once under its own id
    if not twice.head(1):
        return left
    return left.join(twice, same(twice), "left_anti").unionByName(docs.join(twice, same(twice), "left_semi").dropDuplicates(["doc_id", "text"]))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts lose the spans that an earlier document has; n_chars follows.

    A document with nothing left goes, unless its text was empty before.
    """
    held = docs.withColumn("__own", F.struct(*docs.columns)).select("doc_id", "text", "__own")
    marked = suffix_dedup.mark(held, carry="__own", as_text=True)
    kept = marked.where((F.col("n_removed") == 0) | (F.length("kept") > 0))
    cut = F.col("n_removed") > 0
    now = {"text": F.when(cut, F.col("kept")).otherwise(F.col("__own.text")), "n_chars": F.when(cut, F.length("kept").cast("long")).otherwise(F.col("__own.n_chars"))}
    return kept.select(*[(now[c] if c in now else F.col("__own")[c]).alias(c) for c in docs.columns])


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark passage go, however long they are: what is left has no hit."""
    marked = decontamination.mark(docs.withColumn("__own", F.struct(*docs.columns)).select("__own", "text"), read(spark, sf_dir, "benchmark"))
    return marked.where("n_hit = 0").select("__own.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All that is left, packed into sequences."""
    return packing.pack(docs, vocabulary("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("suffix_dedup", cut_repeats),
    ("benchmark_decontamination", drop_contaminated),
    ("best_fit_packing", pack),
]

#: SQL can express neither the models nor the packing; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each stage's result written and read again."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = token_files.folder(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
