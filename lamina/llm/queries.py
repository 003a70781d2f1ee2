"""Queries over the training-data operators and, where SQL can express them, their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from lamina.llm import decontamination, jaccard_join, lm_scoring, packing, quality_rules, suffix_dedup, token_counts, token_files, toxicity, url_filters
from lamina.llm.common import read

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def query(run):
    QUERIES[run.__name__] = run
    return run


@query
def op1_quality_rules(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_rules.judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query
def op2_suffix_dedup(spark, sf_dir):
    marked = suffix_dedup.mark(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return marked.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op3_toxicity(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, read(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", (toxicity.remainder() == 1).alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


@query
def op4_lm_scoring(spark, sf_dir):
    scored, model = lm_scoring.fit_and_score(read(spark, sf_dir, "documents"))
    held = F.coalesce(lm_scoring.fold() == 2, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", F.lit(model.total).cast("long").alias("train_tokens"), "base_score", "score")


@query
def op5_best_fit_packing(spark, sf_dir):
    return packing.pack(read(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


@query
def op6_token_files(spark, sf_dir):
    path = token_files.folder(spark, "tokens")
    token_files.write(read(spark, sf_dir, "documents"), path, vocabulary("word_bpe_49k.json"))
    return token_files.read_back(spark, path)


@query
def op7_token_counts(spark, sf_dir):
    path = token_files.folder(spark, "flat")
    names = token_counts.write_flat(read(spark, sf_dir, "documents"), path, vocabulary("byte_bpe_50k.json"))
    return token_counts.counted(spark, path, names).select("doc_id", "file", "document", "start", "n_tokens")


@query
def op8_ngram_jaccard_join(spark, sf_dir):
    return jaccard_join.join(read(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "class_id", "n_links")


@query
def op9_url_filters(spark, sf_dir):
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    return url_filters.judge(pages, url_filters.rule_table(spark)).select("page_id", "host", "path", "rule", "verdict")


@query
def op10_decontamination(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    marked = decontamination.mark(docs, read(spark, sf_dir, "benchmark"))
    return marked.select("doc_id", "n_words", "n_hit", F.size("hit_items").cast("long").alias("n_items"), F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256"), "contaminated")


def _quality_sql() -> str:
    rules = {
        "n_words": "n_words",
        "mean_word_chars": "CASE WHEN n_words > 0 THEN word_chars / n_words ELSE 0 END",
        "symbol_ratio": "CASE WHEN n_words > 0 THEN n_symbols / n_words ELSE 0 END",
        "stop_ratio": "CASE WHEN n_words > 0 THEN n_stop / n_words ELSE 0 END",
        "dup_line_ratio": "CASE WHEN n_lines > 0 THEN n_dup_lines / n_lines ELSE 0 END",
        "repeat_ratio": "CASE WHEN n_words > 0 THEN n_repeat_words / n_words ELSE 0 END",
        "upper_ratio": "CASE WHEN word_chars > 0 THEN n_upper / word_chars ELSE 0 END",
    }
    tests = [f"({rules[r.figure]}) < {r.low}" for r in quality_rules.RULES if r.low is not None] + [f"({rules[r.figure]}) > {r.high}" for r in quality_rules.RULES if r.high is not None]
    stops = ", ".join(f"'{w}'" for w in sorted({w for words in quality_rules.STOP_WORDS.values() for w in words.split()}))
    return rf"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
    w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
    g AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) > 2)),
    r AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM (SELECT doc_id, i, unnest([0, 1, 2]) AS k FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g) WHERE c > 1) GROUP BY doc_id),
    f AS (SELECT w.doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars, (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
      len(l)::BIGINT AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words, len(list_filter(w, lambda x: lower(rtrim(x, '.,!?;:')) IN ({stops}))) AS n_stop, length(t) - length(regexp_replace(t, '\p{{Lu}}', '', 'g')) AS n_upper
      FROM w LEFT JOIN r USING (doc_id)), b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT ({' OR '.join(tests)}) AS kept FROM b"""


def _url_sql() -> str:
    rules = " UNION ALL ".join(f"SELECT '{v}' AS v, '{h}' AS h, '{p}' AS p" for v, h, p in url_filters.RULES)
    return rf"""WITH rules AS ({rules}), u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
    s AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*(/[^?#]*)', 1) AS path FROM u),
    m AS (SELECT s.*, rules.*, row_number() OVER (PARTITION BY page_id ORDER BY length(h) + length(p) DESC NULLS LAST, length(h) DESC, v DESC) AS k FROM s LEFT JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
    SELECT page_id, host, path, h || p AS rule, coalesce(v, '{url_filters.DEFAULT}') AS verdict FROM m WHERE k = 1"""


def _decontamination_sql() -> str:
    words = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return f"""WITH d AS (SELECT doc_id, {words} AS w FROM documents), b AS (SELECT item_id, {words} AS w FROM benchmark),
    i AS (SELECT item_id, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS g FROM (SELECT item_id, w, least(len(w), 13) AS n, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS i FROM b WHERE len(w) > 0)),
    sizes AS (SELECT DISTINCT n FROM i), x AS (SELECT doc_id, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
    m AS (SELECT doc_id, x.n, x.i, item_id FROM x JOIN i ON x.g = i.g AND x.n = i.n), h AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM (SELECT doc_id, i, unnest(range(n)) AS k FROM m) GROUP BY doc_id),
    t AS (SELECT doc_id, list_sort(list(DISTINCT item_id::VARCHAR)) AS items FROM m GROUP BY doc_id)
    SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(h.n, 0)::BIGINT AS n_hit, coalesce(len(items), 0)::BIGINT AS n_items, sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(h.n, 0) > 0 AND 20 * coalesce(h.n, 0) >= len(w) AS contaminated
    FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)"""


ORACLES |= {"op1_quality_rules": _quality_sql(), "op9_url_filters": _url_sql(), "op10_decontamination": _decontamination_sql()}
