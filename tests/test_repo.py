"""The repository verbs end to end, and sources and sinks on disk."""

import os
import subprocess

import pytest

from lamina.functions.hashing import ROOT
from lamina.repo import MergeConflict, Repo, RepoError, commit_id, content_json, manifest_id
from lamina.sources import git_snapshot, html_view, working_tree


@pytest.fixture
def tree(spark):
    def make(files):
        rows = [(p, bytearray(t.encode() if isinstance(t, str) else t), "regular") for p, t in files.items()]
        return spark.createDataFrame(rows, "path string, content binary, mode string")

    return make


@pytest.fixture
def repo(spark, tmp_path):
    made = Repo.init(spark, str(tmp_path / "store"))
    made.set_identity("a", "a@example.org")
    return made


def texts(repo, name="HEAD"):
    return {r["path"]: bytes(r["content"]).decode() for r in repo.files(repo.manifest(name)).collect()}


BASE = {"a.py": "def f(a):\n    return a\n", "b.txt": "x\ny\n"}


def test_a_day_of_work(spark, repo, tree, tmp_path):
    assert repo.head() == ROOT
    one = repo.commit("one", tree(BASE), "1")
    assert repo.commit("again", tree(BASE), "2") == one
    repo.create_branch("side")
    two = repo.commit("two", tree(BASE | {"a.py": BASE["a.py"] + "\ndef g():\n    pass\n"}), "3")
    repo.checkout("side")
    repo.commit("three", tree({"a.py": "def f(b):\n    return b\n", "c.txt": BASE["b.txt"]}), "4")
    assert [(r["from_path"], r["to_path"]) for r in repo.renames(one, "side").collect()] == [("b.txt", "c.txt")]
    assert {r["intent"] for r in repo.intents(one, "side").collect()} == {"rename_identifier"}
    merged = repo.merge("main")
    assert texts(repo) == {"a.py": "def f(b):\n    return b\n\ndef g():\n    pass\n", "c.txt": "x\ny\n"}
    assert repo.merge_base("main", "side") == two and repo.is_ancestor(one, merged)
    assert [r["message"] for r in repo.log().collect()][0] == "merge main"
    with pytest.raises(RepoError):
        repo.merge("side")
    assert repo.fsck() == [] and repo.gc() == [("state", 0, 0), ("blob", 0, 0)]
    repo.tag("v1")
    with pytest.raises(RepoError):
        repo.tag("v1")
    assert repo.resolve("v1") == merged == repo.resolve("head")
    other = Repo.clone(spark, str(repo.root), str(tmp_path / "clone"))
    assert other.branches() == ["main", "side"] and texts(other) == texts(repo) and other.fsck() == []
    third = other.commit("five", tree({"n.txt": "n\n"}), "9")
    assert other.push("origin", "side") == 1
    assert repo.resolve("side") == third


def test_conflicts_and_resolutions(repo, tree):
    repo.commit("one", tree({"t.txt": "a\nb\n"}), "1")
    repo.create_branch("side")
    repo.commit("ours", tree({"t.txt": "A\nb\n"}), "2")
    repo.checkout("side")
    repo.commit("theirs", tree({"t.txt": "Z\nb\n"}), "3")
    with pytest.raises(MergeConflict) as error:
        repo.merge("main")
    assert [p for p, _ in error.value.conflicts] == ["t.txt"]
    with pytest.raises(MergeConflict):
        repo.rebase("main")
    repo.rebase_continue({"t.txt": "theirs"})
    assert texts(repo) == {"t.txt": "Z\nb\n"}


def test_rewriting(repo, tree):
    one = repo.commit("one", tree({"a.txt": "1\n2\n3\n"}), "1")
    two = repo.commit("two", tree({"a.txt": "1\n2\n3\n", "b.txt": "b\n"}), "2")
    three = repo.commit("three", tree({"a.txt": "1\n2\n4\n", "b.txt": "b\n"}), "3")
    repo.revert(two)
    assert texts(repo) == {"a.txt": "1\n2\n4\n"}
    repo.reset(one)
    assert repo.head() == one
    repo.cherry_pick(three)
    assert texts(repo) == {"a.txt": "1\n2\n4\n"}
    assert repo.bisect(one, three, lambda s: 0 if s == two else 1) == three
    assert [(line, text) for line, _, text in repo.blame("a.txt", three)] == [(0, "1"), (1, "2"), (2, "4")]
    assert [owner for _, owner, _ in repo.blame("a.txt", three)] == [one, one, three]


def test_staging_status_and_stash(repo, tree):
    repo.commit("one", tree({"a.txt": "a\n", "b.txt": "b\n"}), "1")
    repo.add(tree({"c.txt": "c\n"}), deleted=["b.txt"])
    got = {r["path"]: (r["staged"], r["unstaged"], r["untracked"]) for r in repo.status(tree({"a.txt": "z\n", "c.txt": "c\n", "u.txt": "u\n"})).collect()}
    assert got == {"a.txt": (None, "modified", False), "b.txt": ("deleted", None, False), "c.txt": ("added", None, False), "u.txt": (None, None, True)}
    repo.commit("two", stamp="2")
    assert set(texts(repo)) == {"a.txt", "c.txt"}
    repo.stash(tree({"a.txt": "z\n"}), "mine")
    assert [m for _, _, m in repo.stashes()] == ["mine"]
    after = repo.stash_apply(drop=True)
    assert {r["path"] for r in after.collect()} == {"a.txt"} and repo.stashes() == []


def test_upkeep(repo, tree):
    repo.commit("one", tree({"a.txt": "a\n"}), "1")
    repo.create_branch("gone")
    repo.checkout("gone")
    repo.commit("two", tree({"a.txt": "b\n"}), "2")
    repo.checkout("main")
    repo.remove_branch("gone")
    assert repo.gc(prune=True)[0] == ("state", 1, 0)
    assert repo.repack() == 1
    with repo._changing() as refs:
        refs["heads"]["lost"] = "f" * 64
    assert ("dangling_ref", "lost") in repo.fsck()
    assert repo.prune_refs() == ["lost"] and repo.fsck() == [("missing_blob", b) for _, b in repo.fsck()]
    repo.hooks["pre_commit"] = lambda: False
    with pytest.raises(RepoError):
        repo.commit("no", tree({"x": "x"}))
    with pytest.raises(RepoError):
        repo.remove_branch("main")


def test_ids():
    assert content_json("text", 'é"\n\x01'.encode()) == '{"kind":"text","content":"é\\"\\n\\u0001"}'.encode()
    assert manifest_id([("b", "2", "regular"), ("a", "1", "executable")]) == manifest_id([("a", "1", "executable"), ("b", "2", "regular")])
    assert commit_id("m", ["b", "a"], "x", "1", "n", "e") == commit_id("m", ["a", "b"], "x", "1", "n", "e")


def test_working_tree(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "a b.txt").write_text("a+%")
    (tmp_path / "d" / "run").write_text("r")
    (tmp_path / "d" / "run").chmod(0o755)
    (tmp_path / "d" / "x.log").write_text("no")
    (tmp_path / ".gitignore").write_text("*.log\n")
    os.symlink("a b.txt", tmp_path / "link")
    got = {r["path"]: (bytes(r["content"]), r["mode"]) for r in working_tree.load(spark, str(tmp_path)).collect()}
    assert got == {"a b.txt": (b"a+%", "regular"), "d/run": (b"r", "executable"), ".gitignore": (b"*.log\n", "regular"), "link": (b"a b.txt", "symlink")}
    before = spark.createDataFrame(working_tree.walk(str(tmp_path)), working_tree.STAT)
    (tmp_path / "a b.txt").write_text("changed")
    assert [r["path"] for r in working_tree.changed_since(working_tree.scan(spark, str(tmp_path)), before).collect()] == ["a b.txt"]
    out = tmp_path.parent / f"{tmp_path.name}-out"
    out.mkdir()
    (out / "old").write_text("x")
    assert working_tree.materialize(working_tree.load(spark, str(tmp_path)).where("path <> '.gitignore'"), str(out), ["old"]) == 3
    assert not (out / "old").exists() and os.readlink(out / "link") == "a b.txt" and os.access(out / "d" / "run", os.X_OK)


def test_git_snapshot(spark, tmp_path):
    run = lambda *a: subprocess.run(["git", "-C", str(tmp_path), *a], check=True, capture_output=True)
    run("init", "-q")
    (tmp_path / "a.txt").write_text("a")
    (tmp_path / "sp ace").write_text("s")
    run("add", "-A")
    run("-c", "user.name=a", "-c", "user.email=a@example.org", "commit", "-qm", "one")
    got = {r["path"]: (bytes(r["content"]), r["mode"]) for r in git_snapshot.read_git(spark, str(tmp_path)).collect()}
    assert got == {"a.txt": (b"a", "regular"), "sp ace": (b"s", "regular")}


def test_merges_that_git_refuses(tmp_path):
    """Edits on neighbouring lines merge here; git's line merge stops at them."""
    from lamina.kernel.merge import merge_files

    base, ours, theirs = "fn a() { x = 1; y = 2; }\n", "fn a() { x = 3; y = 2; }\n", "fn a() { x = 1; y = 4; }\n"
    for name, text in (("base", base), ("ours", ours), ("theirs", theirs)):
        (tmp_path / name).write_text(text)
    git = subprocess.run(["git", "merge-file", "-p", *[str(tmp_path / n) for n in ("ours", "base", "theirs")]], capture_output=True)
    assert git.returncode != 0
    assert merge_files("a.rs", base, ours, theirs).text == "fn a() { x = 3; y = 4; }\n"


def test_html_view(spark, tmp_path):
    pairs = spark.createDataFrame([("a.rs", "fn a() {}\n", "fn b() {}\n"), ("n", None, "<x>\n")], "path string, old string, new string")
    assert html_view.write_html(pairs, str(tmp_path / "v.html")) == 2
    page = (tmp_path / "v.html").read_text()
    assert "rename `a` to `b`" in page and "&lt;x&gt;" in page
