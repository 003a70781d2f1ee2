"""URL filters: host-suffix and path-prefix expressions joined to a rule table by hash.

Each url becomes the expressions ``host suffix + path prefix`` that some rule could bear; they meet
the rules on the first 32 bits of a SHA-256 digest, and full digests confirm. The longest rule
wins. All of it is DataFrame work; the rule table is broadcast only under a checked row count and
joined by shuffle beyond it. A null url, or one without ``://``, has an empty host and path and
fits no rule. Equal rows are judged once and given back as often as they came.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: (verdict, host, path prefix)
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
#: Verdict where no rule fits.
DEFAULT = "allow"
#: Rows of rules up to which their table may be broadcast.
BROADCAST_RULES = 100_000

_SCHEMA = T.StructType([T.StructField(n, T.StringType()) for n in ("rule_verdict", "rule_host", "rule_path")])


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path as the rules see them."""
    whole = F.coalesce(url, F.lit(""))
    at = F.locate("://", whole)
    rest = F.when(at > 0, F.substring(whole, at + 3, F.length(whole))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*(/[^?#]*)", 1)
    return host, path


def rule_table(spark: SparkSession, rules=RULES) -> DataFrame:
    return spark.createDataFrame([tuple(r) for r in rules], _SCHEMA)


def judge(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = DEFAULT, broadcast_rules: int = BROADCAST_RULES) -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` and ``verdict``; the input's columns of these names give way.

    Of rules of equal length the longer host wins, then ``block``.
    """
    digest = lambda host, path: F.sha2(F.concat(host, F.lit("\n"), path), 256)
    rules = rules.dropna().dropDuplicates().withColumn("digest", digest(F.col("rule_host"), F.col("rule_path"))).withColumn("short", F.conv(F.substring("digest", 1, 8), 16, 10).cast("long"))
    shapes = rules.agg(F.count("*").alias("n"), F.array_sort(F.collect_set(F.length("rule_path"))).alias("lengths")).first()
    if shapes["n"] <= broadcast_rules:
        rules = F.broadcast(rules)
    own = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    host, path = host_path(F.col(url))
    given = pages.select(*own, host.alias("host"), path.alias("path"))
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    lengths = F.array(*[F.lit(int(n)) for n in shapes["lengths"]]) if shapes["lengths"] else F.array().cast("array<int>")
    prefixes = F.transform(F.filter(lengths, lambda n: n <= F.length("path")), lambda n: F.substring(F.col("path"), F.lit(1), n))
    both = F.flatten(F.transform(suffixes, lambda h: F.transform(prefixes, lambda p: F.struct(h.alias("h"), p.alias("p")))))
    keys = given.select(url, "host", "path").distinct()
    tried = keys.select(url, F.explode(both).alias("x")).select(F.col(url).alias("__url"), digest(F.col("x.h"), F.col("x.p")).alias("__digest"))
    tried = tried.withColumn("__short", F.conv(F.substring("__digest", 1, 8), 16, 10).cast("long"))
    # digests are of one length, so a prefix is the whole; as no equality it stays out of the join's keys
    met = tried.join(rules, (F.col("__short") == F.col("short")) & F.startswith("__digest", "digest"))
    rank = F.struct((F.length("rule_host") + F.length("rule_path")).alias("n"), F.length("rule_host").alias("h"), F.col("rule_verdict").alias("v"))
    best = met.groupBy("__url").agg(F.max_by(F.struct(F.concat("rule_host", "rule_path").alias("rule"), F.col("rule_verdict").alias("verdict")), rank).alias("__best"))
    return given.join(best, given[url] == F.col("__url"), "left").select(*[given[c] for c in own], given["host"], given["path"], F.col("__best.rule").alias("rule"), F.coalesce(F.col("__best.verdict"), F.lit(default)).alias("verdict"))
