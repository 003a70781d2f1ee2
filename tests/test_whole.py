"""Jobs done in full: no switch by size, no rows left out."""

import random

from lamina.operators import history, kernels
from lamina.plans import registry
from lamina.repo import Repo


def test_walks_of_both_sizes_visit_alike(spark):
    rng = random.Random(5)
    names = [f"{rng.randrange(1 << 30):08x}" for _ in range(24)]
    edges = [(names[i], names[j], k) for i in range(1, 24) for k, j in enumerate(rng.sample(range(max(0, i - 8), i), min(i, rng.choice((2, 2, 3)))))]
    dag = spark.createDataFrame(edges, "child string, parent string, ord int")
    tips = spark.createDataFrame([(names[23],), (names[21],)], "state string")
    near, far = ({tuple(r) for r in history.closure(dag, tips, local=n).select("state", "depth", "visit").collect()} for n in (len(edges), 0))
    assert near == far
    assert sorted(v for _, _, v in far) == list(range(len(far)))
    by_id = [s for _, s in sorted((d, s) for s, d, _ in near)]
    assert by_id != [s for s, _, _ in sorted(near, key=lambda r: r[2])]


def test_sizes_of_all_documents(spark, tmp_path):
    sizes = [(1, 1023), (2, 2560), (3, (1 << 20) - 1), (4, 1 << 20), (5, 5 << 20), (6, None)]
    spark.createDataFrame(sizes, "doc_id long, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    got = {tuple(r) for r in registry.QUERIES["size_text"](spark, str(tmp_path)).collect()}
    assert got == {(1, "1023 bytes"), (2, "2.5 KiB"), (3, "1024.0 KiB"), (4, "1.0 MiB"), (5, "5.0 MiB"), (6, None)}


def test_every_document_is_diffed_and_merged(spark, tmp_path):
    texts = [(i, f"one {i}\ntwo\nthree", "s") for i in range(1, 144)]
    spark.createDataFrame(texts, "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    for name in ("text_diff", "text_merge"):
        got = {r["path"] for r in registry.QUERIES[name](spark, str(tmp_path)).select("path").collect()}
        assert got == {f"s/{i}.txt" for i, _, _ in texts}


def test_only_edits_make_a_rename(spark):
    rows = lambda files: spark.createDataFrame(list(files.items()), "path string, text string")
    gone = rows({"a.py": "def f(a):\n    return a\n", "b.py": "x = 1\n", "c.rs": "fn f() { 1 }\n", "d.txt": "one\n"})
    come = rows({"u.py": "def g(b):\n    return b\n", "v.rs": "fn g() { 2 }\n", "w.txt": "two\n", "x.py": "x = 1\ny = 2\n", "y.js": "x = 1\n"})
    assert {tuple(r) for r in kernels.edited_renames(gone, come).collect()} == {("a.py", "u.py"), ("c.rs", "v.rs")}


def test_a_merge_follows_a_rename_with_edits(spark, tmp_path):
    def tree(**files):
        return spark.createDataFrame([(f"{p}.py", bytearray(t.encode()), "regular") for p, t in files.items()], "path string, content binary, mode string")

    repo = Repo.init(spark, str(tmp_path / "store"))
    repo.set_identity("a", "a@example.org")
    text = "def f(a):\n    return 1\n\n\ndef g(b):\n    return 2\n"
    repo.commit("one", tree(a=text), "1")
    repo.create_branch("side")
    repo.commit("two", tree(a=text.replace("return 2", "return 4")), "2")
    repo.checkout("side")
    repo.commit("three", tree(c=text.replace("return 1", "return 3")), "3")
    repo.merge("main")
    got = {r["path"]: bytes(r["content"]).decode() for r in repo.files(repo.manifest("HEAD")).collect()}
    assert got == {"c.py": text.replace("return 1", "return 3").replace("return 2", "return 4")}
