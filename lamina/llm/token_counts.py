"""Token counts by a separator scan of flat, unindexed token files.

A file is a stream of little-endian unsigned ids of one width and nothing else; each document is
followed by a separator, an id that no text yields. Files are read as ranges of fixed size, each range by
whichever task gets it. Separators are found range by range; a prefix scan over one summary a range, first
inside runs of ranges and then over the runs, carries the last separator and the number of documents
before it, so documents may cross any number of ranges. Names of documents are a table beside the
files, which is met by file and number after the scan.

Null or empty texts count 0 tokens; equal rows count each for itself; tokens after a file's last
separator are a document that is not ended. Only doc_id and text are read of the input.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lamina.llm import tokens
from lamina.llm.common import cut, lean, partitions

#: Ids of a range; ranges of a run of the prefix scan.
BLOCK, RUN = 1 << 19, 4096
#: Ids are unsigned 16-bit; the separator is the id that no vocabulary of this width gives out.
KIND, SEPARATOR = "<u2", 0xFFFF
_WIDTH = np.dtype(KIND).itemsize


def _store(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return (fs.LocalFileSystem(), path) if path.startswith("/") else fs.FileSystem.from_uri(path)


def write_flat(docs: DataFrame, path: str, vocabulary: str, separator: int = SEPARATOR) -> DataFrame:
    """Write flat files under ``path`` in a shared store; (file, document, doc_id) of all documents.

    A task writes one file, named by its attempt; files of attempts that failed are named by no row.
    """
    spark = lean(docs).sparkSession

    def run(batches):
        store, top = _store(path)
        store.create_dir(f"{top}/ids", recursive=True)
        name, sink, number = f"ids/{TaskContext.get().partitionId()}-{TaskContext.get().taskAttemptId()}.bin", None, 0
        try:
            for batch in tokens.kept(batches):
                if not batch.num_rows:
                    continue
                sink = sink or store.open_output_stream(f"{top}/{name}")
                for ids in tokens.arrays(batch.column("text"), vocabulary):
                    if len(ids) and int(ids.max()) >= min(separator, 1 << 8 * _WIDTH):
                        raise ValueError(f"id {int(ids.max())} is the separator or wider than the file's ids")
                    sink.write(np.append(ids, np.uint32(separator)).astype(KIND).tobytes())
                yield pa.RecordBatch.from_arrays([pa.array([name] * batch.num_rows), pa.array(np.arange(number, number + batch.num_rows)), batch.column("doc_id")], names=["file", "document", "doc_id"])
                number += batch.num_rows
        finally:
            if sink:
                sink.close()

    named = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "file string, document long, doc_id long")
    named.write.parquet(f"{path}/names")
    return spark.read.parquet(f"{path}/names")


def flat_files(spark: SparkSession, path: str) -> DataFrame:
    """(file, bytes) of all files in a folder; their contents are not read."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), F.col("length").alias("bytes"))


def written_files(spark: SparkSession, path: str, names: DataFrame) -> DataFrame:
    """(file, bytes) of the files that ``names`` knows, as ``write_flat`` left them."""
    held = names.select("file").distinct()
    if not held.head(1):
        return spark.createDataFrame([], "file string, bytes long")
    found = flat_files(spark, f"{path}/ids").withColumn("name", F.concat(F.lit("ids/"), F.substring_index("file", "/", -1)))
    return found.join(held.select(F.col("file").alias("name")), "name").select("file", "bytes")


def scan(files: DataFrame, separator: int = SEPARATOR, block: int = BLOCK, run_of: int = RUN) -> DataFrame:
    """file, document (from 0), start, n_tokens and ended of every document of the files (file, bytes)."""
    step = block * _WIDTH
    ranges = files.where("bytes > 0").select("file", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("bytes") - 1) / step))).alias("block"))

    def run(batches):
        for batch in batches:
            found, length = [], []
            for file, number in zip(batch.column("file").to_pylist(), batch.column("block").to_pylist(), strict=True):
                store, path = _store(file)
                with store.open_input_file(path) as source:
                    body = source.read_at(min(step, source.size() - number * step), number * step)
                flat = np.frombuffer(body, KIND, len(body) // _WIDTH)
                found.append(np.flatnonzero(flat == separator))
                length.append(len(flat))
            yield pa.RecordBatch.from_arrays([batch.column("file"), batch.column("block"), pa.array(length, pa.int64()), pa.array(found, pa.list_(pa.int64()))], names=["file", "block", "length", "at"])

    dealt = ranges.select("file", "block").repartition(partitions(files.sparkSession), "file", "block")
    seen = cut(dealt.mapInArrow(run, "file string, block long, length long, at array<long>"))
    last = lambda c: F.element_at(c, F.when(F.size(c) > 0, -1))
    summed = seen.select("file", "block", F.floor(F.col("block") / run_of).alias("run"), "length", F.size("at").cast("long").alias("n"), (F.col("block") * block + last("at") + 1).alias("open"))
    zero = F.lit(0).cast("long")
    runs = summed.groupBy("file", "run").agg(F.sum("n").alias("n"), F.max("open").alias("open"), F.max("block").alias("top"))
    over = W.partitionBy("file").orderBy("run").rowsBetween(W.unboundedPreceding, -1)
    runs = runs.select("file", "run", F.coalesce(F.sum("n").over(over), zero).alias("run_n"), F.coalesce(F.max("open").over(over), zero).alias("run_open"), F.max("top").over(W.partitionBy("file")).alias("top"))
    inside = W.partitionBy("file", "run").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    carried = summed.select("file", "block", "run", F.coalesce(F.sum("n").over(inside), zero).alias("in_n"), F.coalesce(F.max("open").over(inside), zero).alias("in_open")).join(runs, ["file", "run"])
    carried = carried.select("file", "block", (F.col("run_n") + F.col("in_n")).alias("documents"), F.greatest("run_open", "in_open").alias("open"), (F.col("block") == F.col("top")).alias("final"))
    joined = seen.join(carried, ["file", "block"])
    ends = F.transform("at", lambda p: p + F.col("block") * block)
    tail = F.when(F.col("final") & (F.coalesce(last("at"), F.lit(-1).cast("long")) < F.col("length") - 1), F.array(F.col("block") * block + F.col("length"))).otherwise(F.array().cast("array<long>"))
    rows = joined.select("file", "documents", "open", F.size("at").alias("n"), F.concat(ends, tail).alias("ends"))
    rows = rows.select("*", F.posexplode("ends").alias("i", "end"))
    start = F.when(F.col("i") == 0, F.col("open")).otherwise(F.col("ends")[F.greatest(F.col("i") - 1, F.lit(0))] + 1)
    return rows.select("file", (F.col("documents") + F.col("i")).alias("document"), start.alias("start"), (F.col("end") - start).alias("n_tokens"), (F.col("i") < F.col("n")).alias("ended"))


def counted(spark: SparkSession, path: str, names: DataFrame, separator: int = SEPARATOR, block: int = BLOCK) -> DataFrame:
    """doc_id, file, document, start, n_tokens, ended of all documents that ``write_flat`` wrote."""
    found = scan(written_files(spark, path, names), separator, block).withColumn("file", F.concat(F.lit("ids/"), F.substring_index("file", "/", -1)))
    return found.join(names, ["file", "document"], "left").select("doc_id", "file", "document", "start", "n_tokens", "ended")
