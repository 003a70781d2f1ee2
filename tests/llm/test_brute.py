"""Operators against plain Python on small hostile tables and on the smallest supplied data."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from lamina.llm import decontamination, jaccard_join, lm_scoring, packing, quality_rules, suffix_dedup, token_counts, token_files, tokens, toxicity, url_filters

from lamina.llm.common import mixed, word_hashes

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
BYTE_BPE, WORD_BPE = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))
LONG = "the quick brown fox jumps over a lazy dog and runs " * 30
PASSAGE = "one passage of some length that more than one document carries around unchanged, word by word by word"
TEXTS = [
    (1, "alpha " + PASSAGE + " omega"),
    (2, PASSAGE),
    (3, None),
    (4, ""),
    (5, " \t\n "),
    (6, LONG),
    (7, LONG),
    (8, LONG + "tail"),
    (9, "ééé ñandú Straße " + PASSAGE + " 漢字 ünï"),
    (10, "x"),
    (11, "a" * 400),
    (12, "a" * 300),
    (13, "ab" * 200),
    (14, "\n".join(["same line here"] * 5)),
    (15, "w " * 3),
    (16, "tie tie tie tie"),
    (17, "line\r\nwith <|endoftext|> 'll and  double   spaces\t.\n\n\nend "),
    (18, "one two three four"),
    (20, "hello <|endoftext|> world<|startoftext|>!"),
    (21, "<|ENDOFTEXT|> <|endoftext|><|endoftext|>"),
    (19, "one two three four"),
    (9, "ééé ñandú Straße " + PASSAGE + " 漢字 ünï"),
]
NULL_ID = (None, "null id " + PASSAGE)


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "src", len(t or ""), 7) for i, t in [*TEXTS, NULL_ID]]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n_words int").repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


def texts_of(spark, data):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()}


def test_quality_figures(docs, empty):
    for row in quality_rules.judge(docs).collect():
        words = WORD.findall(row["text"] or "")
        grams = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
        covered = {i + k for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for k in range(3)}
        lines = [x for x in (row["text"] or "").split("\n") if WORD.search(x)]
        assert row["n_words"] == len(words)
        assert row["word_chars"] == sum(map(len, words))
        assert row["n_repeat_words"] == len(covered)
        assert row["n_dup_lines"] == len(lines) - len(set(lines))
        assert row["base_failed"] == (len(words) < 50 or 100 * len(covered) > 50 * len(words))
        assert not (row["kept"] and row["base_failed"])
    assert quality_rules.judge(empty).count() == 0


def test_native_operators_run_no_python(spark, docs):
    pages = spark.createDataFrame([(1, "http://a.org/")], "page_id long, url string")
    for made in (quality_rules.judge(docs), url_filters.judge(pages, url_filters.rule_table(spark))):
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan


def test_url_filters(spark):
    urls = ["http://a.example.org/es/x", "https://example.org/en/12?x", "http://x.com/fr/", "http://X.COM/de/1", "notexample.org/es/", None, "", "http://org", "ftp://org/", "http://example.org/es/", "http://u@x.com:80/fr/#f", "http://badexample.org/es/y"]
    rows = [(i, u, "clash") for i, u in enumerate([*urls, urls[0], urls[0]])]
    pages = spark.createDataFrame(rows, "page_id long, url string, rule string")
    got = {r["page_id"]: r for r in url_filters.judge(pages, url_filters.rule_table(spark)).collect()}
    shuffled = {r["page_id"]: r for r in url_filters.judge(pages, url_filters.rule_table(spark), broadcast_rules=0).collect()}
    assert got == shuffled and len(got) == len(rows)
    for i, url, _ in rows:
        rest = (url or "").partition("://")[2] if "://" in (url or "") else ""
        host = re.split(r"[/?#]", rest)[0]
        path = re.split(r"[?#]", rest[len(host) :])[0]
        host = host.lower()
        fit = [(len(h) + len(p), h + p, v) for v, h, p in url_filters.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fit, default=(0, None, url_filters.DEFAULT))
        assert (got[i]["host"], got[i]["path"], got[i]["rule"], got[i]["verdict"]) == (host, path, best[1], best[2])
    assert url_filters.judge(pages.where("false"), url_filters.rule_table(spark)).count() == 0


def test_urls_meet_rules_on_short_hashes_only(spark):
    pages = spark.createDataFrame([(1, "http://a.org/")], "page_id long, url string")
    plan = url_filters.judge(pages, url_filters.rule_table(spark))._jdf.queryExecution().executedPlan().toString()
    joins = [line for line in plan.split("\n") if "Join" in line and "short" in line]
    assert joins and all(re.search(r"\[__short#\d+L\], \[short#\d+L\]", line) for line in joins)


def brute_dedup(texts: dict, length: int = 50) -> dict:
    first, out = {}, {}
    for i in sorted(texts):
        body = texts[i].encode()
        lost = bytearray(len(body))
        own = set()
        for s in range(len(body) - length + 1):
            part = body[s : s + length]
            if part in first:
                lost[s : s + length] = b"\1" * length
            else:
                own.add(part)
        first.update(dict.fromkeys(own, i))
        spans = sum(1 for k in range(len(lost)) if lost[k] and (k == 0 or not lost[k - 1]))
        out[i] = (len(body), sum(lost), spans, bytes(x for x, g in zip(body, lost, strict=True) if not g))
    return out


def test_suffix_dedup(docs, empty):
    want = brute_dedup({i: t or "" for i, t in TEXTS})
    rows = suffix_dedup.mark(docs).collect()
    assert len(rows) == len(TEXTS) + 1
    for r in rows:
        if r["doc_id"] is None:
            assert r["n_removed"] == 0
        else:
            assert (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) == want[r["doc_id"]]
    assert suffix_dedup.mark(empty).count() == 0


def test_suffix_dedup_on_data(spark, data):
    want = brute_dedup(texts_of(spark, data))
    got = suffix_dedup.mark(spark.read.parquet(f"{data}/documents.parquet")).collect()
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in got} == want


def test_suffix_dedup_in_many_small_messages(spark, data, monkeypatch):
    """What a task meets by itself and what only tasks together meet give one result."""
    monkeypatch.setattr(suffix_dedup, "FLUSH", 400)
    want = brute_dedup(texts_of(spark, data))
    for parts in (1, 7):
        got = suffix_dedup.mark(spark.read.parquet(f"{data}/documents.parquet").repartition(parts)).collect()
        assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in got} == want


@pytest.mark.parametrize("length", [30, 50, 64, 100, 150])
def test_suffix_dedup_of_any_length(spark, length):
    rng = random.Random(length)
    passages = ["".join(rng.choices("abc de", k=rng.randrange(20, 260))) for _ in range(12)]
    texts = {i: " ".join(rng.choice(passages)[rng.randrange(0, 20) :] for _ in range(rng.randrange(1, 5))) for i in range(60)}
    got = suffix_dedup.mark(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), length=length).collect()
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in got} == brute_dedup(texts, length)
    assert any(r["n_removed"] for r in got) and all(r["n_copied"] <= r["n_removed"] for r in got)


def test_intervals_are_common_prefixes():
    text = np.append(np.frombuffer(b"abracadabra abracadabra cad", np.uint8).astype(np.int64) + 1, 0)
    order, bwt = suffix_dedup.transform(text)
    interval, common = suffix_dedup.expand(bwt, 5)
    whole = [tuple(np.concatenate([text[s:], text[:s]]))[:5] for s in order]
    for k in range(1, len(order)):
        same = next((n for n in range(5) if whole[k][n] != whole[k - 1][n]), 5)
        assert common[k] == same and (interval[k] == interval[k - 1]) == (same == 5)


def shingles(text):
    words = WORD.findall(text)
    return frozenset([tuple(words[i : i + 5]) for i in range(len(words) - 4)] if len(words) >= 5 else [tuple(words)] if words else [])


def brute_join(rows: list) -> list:
    """(doc_id, class_id, n_links, kept rows of the class) of each row."""
    sets = [shingles(t or "") for _, t in rows]
    inverted = defaultdict(list)
    for i, s in enumerate(sets):
        for gram in s if rows[i][0] is not None else ():
            inverted[gram].append(i)
    common = Counter((i, j) for some in inverted.values() for i in some for j in some if i < j)
    root, links = list(range(len(rows))), Counter()

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (i, j), n in common.items():
        if 10 * n >= 8 * (len(sets[i]) + len(sets[j]) - n):
            links.update((i, j))
            a, b = sorted((find(i), find(j)))
            root[b] = a
    least = defaultdict(list)
    for i, (name, _) in enumerate(rows):
        least[find(i)].append(name)
    return [(name, None if name is None else min(least[find(i)]), links[i]) for i, (name, _) in enumerate(rows)]


def joined(docs, **options):
    """The join's rows, of which each class keeps one that bears its name."""
    rows = jaccard_join.join(docs, **options).collect()
    for name, n in Counter(r["class_id"] for r in rows if r["kept"] and r["doc_id"] is not None).items():
        assert n == 1 or any(r["class_id"] == name and not r["n_links"] for r in rows), name
    assert all(r["doc_id"] == r["class_id"] for r in rows if r["kept"])
    return Counter((r["doc_id"], r["class_id"], r["n_links"]) for r in rows)


def test_jaccard_join(docs, empty, spark, data):
    assert joined(docs) == Counter(brute_join([*TEXTS, NULL_ID]))
    assert jaccard_join.join(empty).count() == 0
    table = spark.read.parquet(f"{data}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in table.collect()]
    for options in ({}, {"block": 3}, {"block_shingles": 500}):
        assert joined(table, **options) == Counter(brute_join(rows))


def test_join_of_odd_rows(spark):
    rows = [(None, LONG), (1, LONG), (2, LONG), (2, LONG), (2, PASSAGE), (3, PASSAGE + " more"), (3, "of its own"), (None, None), (4, None), (5, "漢 " * 700_000)]
    some = spark.createDataFrame(rows, "doc_id long, text string")
    assert joined(some) == Counter(brute_join(rows))
    kept = Counter(r["class_id"] for r in jaccard_join.join(some).collect() if r["kept"])
    assert kept == Counter({1: 1, 2: 1, 3: 1, 4: 1, 5: 1, None: 2})


def test_a_large_family_of_near_copies(spark):
    """Links decided by distances to a pivot are those of comparing all pairs."""
    rng = random.Random(5)
    body = [f"b{k}" for k in range(120)]
    rows = []
    for i in range(150):
        words = list(body[: rng.choice((120, 120, 110, 95))])
        for _ in range(rng.choice((0, 1, 1, 2, 3, 4, 5, 6))):
            words[rng.randrange(len(words))] = f"own{rng.randrange(40)}"
        rows.append((i, " ".join(words)))
    some = spark.createDataFrame(rows, "doc_id long, text string")
    want = Counter(brute_join(rows))
    for block in (8, 40):
        assert joined(some, block=block) == want
    assert len({n for _, _, n in want}) > 20


def planted(seed: int, words: int, swaps: int) -> tuple[str, str]:
    """Two texts of ``words`` different words, of which ``swaps``, spread evenly, differ."""
    first = [f"w{seed}x{k}" for k in range(words)]
    other = list(first)
    for k in range(swaps):
        other[(2 * k + 1) * words // (2 * swaps)] += "y"
    return " ".join(first), " ".join(other)


def test_recall_near_the_threshold(spark):
    """Lone pairs of a similarity of 0.80 to 0.85: nine in ten are found at least."""
    rows, shapes = [], [(words, swaps) for words in range(90, 400) for swaps in range(1, 9) if 0.8 <= jaccard(*planted(0, words, swaps)) <= 0.85]
    for seed in range(1500):
        rows += [(2 * seed + k, t) for k, t in enumerate(planted(seed, *shapes[seed * 7 % len(shapes)]))]
    got = jaccard_join.join(spark.createDataFrame(rows, "doc_id long, text string")).where("n_links = 1 and doc_id <> class_id").count()
    print("recall from 0.80 to 0.85:", got / 1500)
    assert got >= 0.98 * 1500


def jaccard(left: str, right: str) -> float:
    a, b = shingles(left), shingles(right)
    return len(a & b) / len(a | b)


def test_members_with_many_candidates_stop_early(spark):
    """A family of like texts is tied at whole signatures, where a text of half their shingles is not."""
    depth, trees = jaccard_join.DEPTH, jaccard_join.TREES
    needs = [jaccard_join.enough(d, trees, 0.8, 0.995) for d in range(6, depth + 1)]
    assert needs[0] <= 0 < needs[1] and needs == sorted(needs)
    body = [f"f{k}" for k in range(200)]
    family = [(i, " ".join([*body, f"end{i}"])) for i in range(60)]
    some = spark.createDataFrame([*family, (99, " ".join(body[:40]))], "doc_id long, text string")
    signed = jaccard_join.sketches(some, "text", trees, depth, 6).withColumnRenamed("rid", "rep")
    roots = jaccard_join.components(jaccard_join.candidates(signed, trees, depth, 6, 0.8, 0.995))
    assert roots.select("root").distinct().count() == 1 and 59 <= roots.count() <= 60
    assert joined(some)[99, 99, 0] == 1


def test_forest_depth_reaches_recall():
    for trees in (4, 20, 64):
        depth = jaccard_join.depth_for(trees, 12, 0.8, 0.99)
        assert depth == 1 or 1 - (1 - 0.8**depth) ** trees >= 0.99


def brute_marks(text, items):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    words, hit, met = word.findall(text.translate(LOWER)), set(), set()
    for name, item in items.items():
        own = word.findall((item or "").translate(LOWER))
        n = min(13, len(own))
        windows = {tuple(own[i : i + n]) for i in range(len(own) - n + 1)} if n else set()
        for i in range(len(words) - n + 1):
            if n and tuple(words[i : i + n]) in windows:
                hit.update(range(i, i + n))
                met.add(str(name))
    return len(words), len(hit), sorted(met), len(hit) > 0 and 20 * len(hit) >= len(words)


@pytest.mark.parametrize("least", [0, 5])
@pytest.mark.parametrize("most", [decontamination.PRINTS, 0])
def test_decontamination(spark, docs, empty, most, least):
    items = {1: PASSAGE.upper(), 2: "Two Three", 3: None, 4: "", 5: LONG, 10: "x", 11: "漢字 ünï", 12: " ".join(["tie"] * 3), 13: None, 14: "w " * 2}
    items = {k: v for k, v in items.items() if len((v or "").split()) >= least}
    table = spark.createDataFrame([*items.items(), (1, PASSAGE.upper())], "item_id long, text string")
    rows = decontamination.mark(docs, table, most=most, held=most).collect()
    assert len(rows) == len(TEXTS) + 1
    for r in rows:
        assert (r["n_words"], r["n_hit"], r["hit_items"], r["contaminated"]) == brute_marks(r["text"] or "", items)
    assert decontamination.mark(empty, table).count() == 0
    assert all(r["n_hit"] == 0 for r in decontamination.mark(docs, table.where("false")).collect())


def test_decontamination_on_data(spark, data):
    bench = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()}
    got = decontamination.mark(spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/benchmark.parquet")).collect()
    assert any(r["n_hit"] for r in got)
    for r in got:
        assert (r["n_words"], r["n_hit"], r["hit_items"], r["contaminated"]) == brute_marks(r["text"], bench)


def test_toxicity(spark, docs, empty):
    bad, good = "you are a filthy gronk", "what a calm and sunny day"
    rows = [(i, f"{good} number {i % 9} {bad if i % 5 == 0 else 'and birds sing'} near tree {i % 7} at {i}") for i in range(400)]
    some = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(400)] + [(7, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.train(some, labels)
    for r in toxicity.score(some, model).collect():
        assert (r["score"] >= toxicity.THRESHOLD) == (r["doc_id"] % 5 == 0)
    scored = toxicity.score(docs, model).collect()
    assert len(scored) == len(TEXTS) + 1 and all(0 <= r["score"] <= 1 for r in scored)
    assert len({r["score"] for r in scored if not WORD.search(r["text"] or "")}) == 1
    assert toxicity.score(empty, model).count() == 0
    untaught = toxicity.train(some, labels.where("false"))
    assert toxicity.score(some, untaught).where("score between 0 and 1").count() == 400


def plain_ratios(sample: list[tuple[int, str]], text: str) -> list[float]:
    """Log-likelihood ratios of a text's words by Kneser-Ney models kept in dictionaries."""
    word_of = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    split = lambda t: word_of.findall(t.translate(LOWER))
    stem = lambda w: w.encode()[: toxicity.STEM]
    tables = [[defaultdict(int) for _ in range(3)] for _ in (0, 1)]  # spreads of words, of stems, counts of pairs
    totals = [Counter(), Counter()]
    seen = [set(), set()]
    for c, t in sample:
        before = None
        for w in split(t):
            if (before, w) not in seen[c]:
                seen[c].add((before, w))
                tables[c][0][w] += 1
            if before is not None:
                tables[c][2][before, w] += 1
                totals[c][before] += 1
            before = w
    for c in (0, 1):
        for s in {(b, stem(w)) for b, w in seen[c]}:
            tables[c][1][s[1]] += 1
    inside = Counter()
    for c in (0, 1):
        for w, n in tables[c][0].items():
            inside[stem(w)] += n
    known = sum(sum(t[0].values()) for t in tables) + 1
    kept = [{k for t in tables for k, n in t[level].items() if n > toxicity.RARE} for level in range(3)]

    def off(c, level, n):
        ones = [sum(m == k for m in tables[c][level].values()) for k in (1, 2, 3, 4)]
        y = ones[0] / (ones[0] + 2 * ones[1]) if ones[0] and ones[1] else 0.5
        k = min(n, 3)
        raw = k - (k + 1) * y * ones[k] / ones[k - 1] if n and ones[k] and ones[k - 1] else y
        return min(max(raw, 0.1), (0.95, 1.9, 2.85)[k - 1]) if n else 0.0

    def freed(c, level):
        total = sum(tables[c][level].values())
        return sum(off(c, level, tables[c][level].get(k, 0)) if k in kept[level] else n for k, n in tables[c][level].items()) / total, total

    out, before = [], None
    for w in split(text):
        logs = []
        for c in (0, 1):
            (rest, total), (low, stem_total) = freed(c, 0), freed(c, 1)
            s = stem(w)
            by_stem = None
            if s in kept[1]:
                n = tables[c][1].get(s, 0)
                by_stem = (n - off(c, 1, n)) / stem_total + low * inside[s] / known
            single = rest * low / known if by_stem is None else rest * by_stem / (inside[s] + 1)
            if w in kept[0]:
                n = tables[c][0].get(w, 0)
                single = (n - off(c, 0, n)) / total + rest * by_stem * (tables[0][0].get(w, 0) + tables[1][0].get(w, 0)) / (inside[s] + 1)
            part = lambda n, c=c: (n - off(c, 2, n)) / max(totals[c][before], 1)
            heads = [k for k in kept[2] if k[0] == before]
            level = max(1 - sum(part(tables[c][2].get(k, 0)) for k in heads), 1e-9) if heads else 1.0
            chance = level * single + (part(tables[c][2].get((before, w), 0)) if (before, w) in kept[2] else 0)
            logs.append(math.log(chance) - math.log(level * rest * low / known))
        out.append(min(max(logs[1] - logs[0], -toxicity.BOUND), toxicity.BOUND))
        before = w
    return out


def test_toxicity_is_kneser_ney(spark):
    rng = random.Random(2)
    words = "calm sunny day birds sing bluebird bluebell gronk snarl snarling filth filthy you are a tree Ünï".split()
    sample = [(c, " ".join(rng.choices(words, [1 + (k % 5 if c else k % 7) ** 2 for k in range(len(words))], k=rng.randrange(1, 40)))) for c in (0, 1) * 12]
    model = toxicity._counted(spark.createDataFrame(sample, "toxic int, text string"))
    for text in (sample[0][1], sample[3][1], "you are a bluebottle", "never seen before", "Gronk, snarl. FILTHY ünï"):
        data = np.frombuffer(text.encode(), np.uint8)
        tokens_, stems, _, n = toxicity._tokens(data, np.array([0, len(data)]))
        got = model.ratios(tokens_, stems, np.array([0, len(tokens_)]))
        assert got == pytest.approx(plain_ratios(sample, text), abs=1e-9)


def test_lm_scores(docs, empty):
    scored, model = lm_scoring.fit_and_score(docs)
    rows = scored.collect()
    assert len(rows) == len(TEXTS) + 1
    own = {i: [*WORD.findall((t or "").translate(LOWER)), None] for i, t in [*TEXTS, NULL_ID]}
    taught = [i for i, _ in [*TEXTS, NULL_ID] if i is None or zlib.crc32(str(i).encode()) % 7 != 2]
    count = Counter(w for i in taught for w in own[i])
    total, kinds = sum(count.values()), len(count)
    assert model.total == total and model.kinds == kinds
    for r in rows:
        words = own[r["doc_id"]]
        assert r["n_tokens"] == len(words) and r["n_known"] == sum(count[w] > 0 for w in words)
        assert r["base_score"] == pytest.approx(sum(math.log10((count[w] + 1) / (total + kinds + 1)) for w in words))
        assert r["score"] < 0
    assert lm_scoring.fit_and_score(empty)[0].count() == 0
    for r in rows:  # the model, token by token
        texts = {t for i, t in [*TEXTS, NULL_ID] if i == r["doc_id"]}
        assert any(r["score"] == pytest.approx(plain_score(model, t, count), rel=1e-5) for t in texts)


def scalar_hash(word: str) -> int:
    data = np.frombuffer(word.encode(), np.uint8)
    return int(word_hashes(data, np.array([0]), np.array([len(data)]))[0])


def plain_score(model, text, count) -> float:
    """log10 of a text's probability with dictionaries and plain loops."""
    wrap = (1 << 64) - 1
    mix = lambda x: int(mixed(np.array([x & wrap], np.uint64))[0])
    rank = {int(h): k for k, h in enumerate(model.table.keys)}
    words = [*WORD.findall((text or "").translate(LOWER)), None]
    hashes = [int(lm_scoring.END) if w is None else scalar_hash(w) for w in words]
    total = 0.0

    def softmax(logit):
        top = max(logit)
        return [x - top - math.log(sum(math.exp(y - top) for y in logit)) for x in logit]

    for i, h in enumerate(hashes):
        feature = {}
        for template in {*lm_scoring.CLASS_TEMPLATES, *lm_scoring.PART_TEMPLATES}:
            f = sum(template) * 0x9E3779B97F4A7C15 & wrap
            for k in template:
                f = mix(f ^ (mix(hashes[i - k]) if i >= k else 0))
            feature[template] = f
        at = rank.get(h)
        cls = model.cls[at] if at is not None else lm_scoring.WIDE - 1
        logit = [float(x) for x in model.bias]
        for n, t in enumerate(lm_scoring.CLASS_TEMPLATES):
            row = model.weights[(n << lm_scoring.CLASS_BITS) + (feature[t] >> (64 - lm_scoring.CLASS_BITS))]
            logit = [a + float(b) for a, b in zip(logit, row, strict=True)]
        total += softmax(logit)[cls]
        if at is None:
            total += math.log(count[words[i]] + 1) - model.rare
            continue
        logit = [float(x) for x in model.inside[cls]]
        for n, t in enumerate(lm_scoring.PART_TEMPLATES):
            row = mix(feature[t] + int(cls) * 0xC2B2AE3D27D4EB4F) >> (64 - lm_scoring.PART_BITS)
            logit = [a + float(b) for a, b in zip(logit, model.members[(n << lm_scoring.PART_BITS) + row], strict=True)]
        total += softmax(logit)[model.part[at]] + model.share[at]
    return total / math.log(10)


def test_lm_rows_of_one_id(spark):
    """Rows are told apart by doc_id and text: equal ids, no id and equal texts each keep their own."""
    rows = [(0, "a b c"), (None, "a b c"), (3, "a b c"), (3, "a b c"), (3, "d e"), (None, None), (0, None), (8, "long " * 500_000)]
    some = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter((r["doc_id"], r["n_tokens"]) for r in lm_scoring.fit_and_score(some)[0].collect())
    assert got == Counter((i, len((t or "").split()) + 1) for i, t in rows)


def test_rare_words_come_back(spark, docs, monkeypatch):
    """With a head of two words, all others go by way of the buckets; counts stay exact."""
    whole = {(r["doc_id"], r["n_tokens"]): r["base_score"] for r in lm_scoring.fit_and_score(docs)[0].collect()}
    monkeypatch.setattr(lm_scoring, "HEAD", 2)
    monkeypatch.setattr(lm_scoring, "RARE_WORDS", 3)
    scored, model = lm_scoring.fit_and_score(docs)
    rows = scored.collect()
    assert len(model.count) == 2 and len(rows) == len(TEXTS) + 1
    for r in rows:
        assert r["base_score"] == pytest.approx(whole[r["doc_id"], r["n_tokens"]]) and r["score"] < 0


def test_trainers_are_summed_in_a_tree(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").repartition(7)
    counts = lm_scoring.counted(docs)
    flat, tree = (lm_scoring.train(docs, counts, taken=1, fan_in=k) for k in (32, 2))
    assert np.allclose(flat.weights, tree.weights, atol=1e-4) and np.allclose(flat.members, tree.members, atol=1e-4)
    assert np.abs(flat.weights).max() > 0.01


def test_lm_is_a_distribution():
    rng = np.random.default_rng(3)
    hashes = rng.integers(1, 1 << 62, 900)
    counts = (rng.zipf(1.3, 900) % 1000 + 1).astype(int)
    head = list(zip(hashes[:700].tolist(), counts[:700].tolist(), strict=True))
    rest = list(zip(hashes[700:].tolist(), counts[700:].tolist(), strict=True))
    model = lm_scoring.Model(head, int(counts.sum()), 900)
    model.weights[:] = rng.normal(size=model.weights.shape)
    model.members[:] = rng.normal(size=model.members.shape)
    start = np.array([hashes[0], hashes[5]], np.int64).view(np.uint64)
    total = 0.0
    for word, n in [*head, *rest, (12345, 0)]:
        text = np.append(start, np.array([word], np.int64).view(np.uint64))
        at, logs = model.logs(text, np.array([0, 3]))
        total += math.exp(logs[2]) * (1 if at[2] >= 0 else n + 1)
    assert total == pytest.approx(1, rel=1e-4)


def test_lm_beats_base_on_held_out(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    held = {r["doc_id"] for r in docs.where(lm_scoring.fold() == 2).select("doc_id").collect()}
    rows = [r for r in lm_scoring.fit_and_score(docs)[0].collect() if r["doc_id"] in held]
    gain = sum(r["score"] - r["base_score"] for r in rows) / sum(r["n_tokens"] for r in rows)
    print("log10 a held-out token over the base:", gain)
    assert gain > 0


@pytest.fixture(scope="module")
def ids_of():
    engines = {p: Tokenizer.from_file(p) for p in (BYTE_BPE, WORD_BPE)}
    return lambda text, path, end: [*engines[path].encode(text or "", add_special_tokens=False).ids, end]


def flat(ids):
    return b"".join(i.to_bytes(4, "little") for i in ids)


def test_packing(spark, docs, empty, ids_of, data):
    long = docs.unionByName(spark.createDataFrame([(99, LONG * 30, "en", "s", 1, 1)], docs.schema))
    for some in (long, spark.read.parquet(f"{data}/documents.parquet")):
        rows = packing.pack(some, BYTE_BPE).collect()
        want = Counter()
        for r in some.select("doc_id", "text").collect():
            ids = ids_of(r["text"], BYTE_BPE, 0)
            at = k = 0
            while at < len(ids):
                stop = at + (len(ids) % 2048 or 2048 if k == 0 else 2048)
                want[r["doc_id"] or 0, k, at, stop - at, zlib.crc32(flat(ids[at:stop]))] += 1
                at, k = stop, k + 1
        assert Counter((r["doc_id"] or 0, r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
        bins = defaultdict(list)
        for r in rows:
            bins[r["sequence_id"]].append((r["offset"], r["length"]))
        for parts in bins.values():
            at = 0
            for offset, length in sorted(parts):
                assert offset == at
                at += length
            assert at <= 2048
        assert len(bins) <= 1.1 * -(-sum(r["length"] for r in rows) // 2048) + 1
    assert packing.pack(empty, BYTE_BPE).count() == 0


def test_token_files(spark, docs, empty, ids_of):
    path = token_files.folder(spark, "test")
    token_files.write(docs, path, WORD_BPE, shard=40)
    rows = sorted(token_files.read_back(spark, path).collect(), key=lambda r: r["start"])
    want = sorted([*TEXTS, NULL_ID], key=lambda x: (x[0] is not None, x[0] or 0))
    at = 0
    for r, (i, text) in zip(rows, want, strict=True):
        ids = ids_of(text, WORD_BPE, 2)
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (i, at, len(ids), zlib.crc32(flat(ids)))
        at += len(ids)
    none = token_files.folder(spark, "none")
    token_files.write(empty, none, WORD_BPE)
    assert token_files.read_back(spark, none).count() == 0


def test_wavelet_matrix():
    rng = np.random.default_rng(0)
    for n in (0, 1, 9, 700, 3000, 200_000):
        ids = (rng.zipf(1.4, n) % 500).astype(np.uint32)
        matrix = token_files.WaveletMatrix(token_files.WaveletMatrix.build(ids, 9))
        assert (matrix.decode() == ids).all()
        some = list(range(0, n, 1 + n // 70))
        assert (matrix.access_all(some) == ids[some]).all() and all(matrix.access(p) == ids[p] for p in some[:5])
        for token in {0, 1, 499, *ids[:3].tolist()}:
            places = np.flatnonzero(ids == token).tolist()
            assert matrix.count(token) == len(places)
            assert n > 3000 or matrix.occurrences(token) == places
            assert matrix.rank(token, n // 2) == sum(p < n // 2 for p in places)
            assert matrix.select(token, len(places)) == -1


def test_lookups_unpack_few_chunks():
    ids = (np.random.default_rng(1).zipf(1.4, 1 << 20) % 500).astype(np.uint32)
    data = token_files.WaveletMatrix.build(ids, 16)
    chunks = token_files.WaveletMatrix(data).chunks * 16
    for look in (lambda m: m.access(700_000), lambda m: m.rank(3, 500_000), lambda m: m.select(1, 1000)):
        matrix = token_files.WaveletMatrix(data)
        look(matrix)
        assert matrix.unpacked <= 3 * 16 < chunks


def test_ids_that_do_not_fit_are_errors():
    for ids, bits in (([5, 70000], 16), ([5, 512], 9)):
        with pytest.raises(ValueError):
            token_files.WaveletMatrix.build(np.array(ids), bits)
    assert token_files.bits_for(WORD_BPE) == 16


@pytest.mark.parametrize("block", [3, 50, token_counts.BLOCK])
def test_token_counts(spark, docs, empty, ids_of, block):
    path = token_files.folder(spark, "flat")
    names = token_counts.write_flat(docs, path, BYTE_BPE)
    got = Counter((r["doc_id"], r["n_tokens"], r["ended"]) for r in token_counts.counted(spark, path, names, block=block).collect())
    assert got == Counter((i, len(ids_of(t, BYTE_BPE, 0)) - 1, True) for i, t in [*TEXTS, NULL_ID])
    none = token_files.folder(spark, "none")
    assert token_counts.counted(spark, none, token_counts.write_flat(empty, none, BYTE_BPE)).count() == 0


@pytest.mark.parametrize("run_of", [1, 2, 4096])
def test_scan_of_foreign_files(spark, tmp_path, run_of):
    for name, ids in (("a", [5, 9, 9, 7, 7, 7, 3]), ("b", [9]), ("c", []), ("d", [1, 2])):
        (tmp_path / name).write_bytes(np.array(ids, "<u2").tobytes())
    found = token_counts.scan(token_counts.flat_files(spark, str(tmp_path)), 9, block=2, run_of=run_of)
    got = sorted((r["file"][-1], r["document"], r["start"], r["n_tokens"], r["ended"]) for r in found.collect())
    assert got == [("a", 0, 0, 1, True), ("a", 1, 2, 0, True), ("a", 2, 3, 4, False), ("b", 0, 0, 0, True), ("d", 0, 0, 2, False)]


def test_cached_pieces_are_the_whole_text(ids_of, spark, data):
    some = [*texts_of(spark, data).values(), *[t for _, t in TEXTS]]
    for path in (BYTE_BPE, WORD_BPE):
        worker = tokens.Encoder(path, cache=50)
        want = [flat(ids_of(t, path, 0)[:-1]) for t in some]
        assert worker.bytes_of_all([t or "" for t in some]) == want
        assert worker.bytes_of_column(pa.array([t or "" for t in some], pa.large_string())) == want
    assert [a.tobytes() for a in tokens.arrays(pa.array(some), BYTE_BPE)] == [flat(ids_of(t, BYTE_BPE, 0)[:-1]) for t in some]
