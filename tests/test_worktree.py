"""Verbs over a working tree: what they read, show and refuse; sessions, shallow history, upkeep."""

import pytest
from pyspark.sql import functions as F

from lamina.repo import Repo, RepoError

CODE = "fn a(x: u32) -> u32 {\n    let y = x + 1;\n    y\n}\n"


@pytest.fixture
def place(spark, tmp_path):
    folder = tmp_path / "tree"
    folder.mkdir()
    repo = Repo.init(spark, str(tmp_path / "store"))
    repo.set_identity("a", "a@example.org")

    def write(**files):
        for name, text in files.items():
            path = folder / name.replace("__", ".")
            path.unlink() if text is None else path.write_text(text)

    def commit(message, stamp):
        from lamina.sources import working_tree

        return repo.commit(message, working_tree.load(spark, str(folder)), stamp)

    return repo, folder, write, commit


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_only_changed_files_are_read(place):
    repo, folder, write, commit = place
    write(**{f"f{i}__txt": f"text {i}\n" for i in range(30)})
    commit("one", "1")
    assert repo.scan(str(folder))[2] == 30 and repo.scan(str(folder))[2] == 0
    write(f3__txt="changed\n")
    assert repo.scan(str(folder))[2] == 1 and repo.scan(str(folder))[2] == 0
    assert [(r["path"], r["unstaged"]) for r in repo.status(str(folder)).collect()] == [("f3.txt", "modified")]
    write(f4__txt=None)
    assert {r["path"] for r in repo.status(str(folder)).collect()} == {"f3.txt", "f4.txt"}
    assert repo.scan(str(folder), full=True)[2] == 29


def test_status_stores_nothing_and_folds_renames(place):
    repo, folder, write, commit = place
    write(a__rs=CODE, b__txt="b\n", c__txt="c\n")
    commit("one", "1")
    stored = repo.table("blobs").count()
    write(a__rs=None, moved__rs=CODE.replace("+ 1", "+ 2"), b__txt=None, d__txt="b\n", new__txt="n\n")
    got = rows(repo.status(str(folder)))
    assert got == [("d.txt", None, "added", None, "b.txt", False), ("moved.rs", None, "added", None, "a.rs", False), ("new.txt", None, None, None, None, True)]
    assert repo.table("blobs").count() == stored
    assert rows(repo.status(str(folder))) == got  # contents that no scan reads again
    told = {r["path"]: (r["from_path"], r["change"], list(r["lines"])) for r in repo.diff_tree(str(folder)).collect()}
    assert told["moved.rs"][:2] == ("a.rs", "renamed") and told["moved.rs"][2] == ["edit literal to `2`"]
    assert told["d.txt"] == ("b.txt", "renamed", []) and told["new.txt"] == (None, "added", ["n\n"])
    assert [r["path"] for r in repo.diff_tree(str(folder), "new.txt").collect()] == ["new.txt"]


def test_staged_diff(spark, place):
    repo, folder, write, commit = place
    write(a__txt="a\n", b__txt="b\n")
    one = commit("one", "1")
    repo.add(spark.createDataFrame([("c.txt", bytearray(b"a\n"), "regular"), ("b.txt", bytearray(b"B\n"), "regular")], "path string, content binary, mode string"), ["a.txt"])
    assert rows(repo.diff_staged().select("path", "from_path", "change")) == [("b.txt", None, "modified"), ("c.txt", "a.txt", "renamed")]
    assert list(repo.diff_staged("b.txt").first()["lines"]) == ["-1 b", "+1 B"]
    write(a__txt=None, b__txt="B\n", c__txt="a\n")
    got = {r["path"]: (r["staged"], r["staged_from"]) for r in repo.status(str(folder)).collect()}
    assert got["c.txt"] == ("added", "a.txt") and got["b.txt"] == ("modified", None)
    two = repo.commit("two", stamp="2")
    assert rows(repo.diff_states(one, two, "a.txt").select("path", "from_path")) == [("c.txt", "a.txt")]


def test_dirty_trees_are_not_overwritten(place):
    repo, folder, write, commit = place
    write(a__txt="a\n")
    one = commit("one", "1")
    write(a__txt="b\n")
    two = commit("two", "2")
    write(a__txt="mine\n")
    for verb in (lambda: repo.checkout(one, str(folder)), lambda: repo.reset(one, "hard", str(folder))):
        with pytest.raises(RepoError) as error:
            verb()
        assert error.value.kind == "dirty" and (folder / "a.txt").read_text() == "mine\n" and repo.head() == two
    repo.checkout(one, str(folder), force=True)
    assert (folder / "a.txt").read_text() == "a\n"
    repo.checkout("main", str(folder))
    assert (folder / "a.txt").read_text() == "b\n"


def test_shallow_clones_know_their_limits(spark, place, tmp_path):
    repo, folder, write, commit = place
    write(a__txt="0\n")
    base = commit("base", "0")
    repo.create_branch("side")
    for i in (1, 2, 3):
        write(a__txt=f"{i}\n")
        commit(f"m{i}", str(i))
    repo.checkout("side")
    for i in (4, 5):
        write(a__txt=f"{i}\n")
        commit(f"s{i}", str(i))
    assert repo.merge_base("main", "side") == base
    short = Repo.clone(spark, str(repo.root), str(tmp_path / "short"), depth=4)
    with pytest.raises(RepoError) as error:
        short.merge_base("main", "side")
    assert error.value.kind == "shallow"
    assert Repo.clone(spark, str(repo.root), str(tmp_path / "whole")).merge_base("main", "side") == base


def test_bisect_session(place):
    repo, folder, write, commit = place
    states = []
    for i in range(9):
        write(n__txt=f"{i}\n")
        states.append(commit(f"c{i}", str(i)))
    assert repo.bisect_start("HEAD", states[0]) == 8
    with pytest.raises(RepoError):
        repo.bisect_start("HEAD", states[0])
    tested, at = 0, repo.bisect_next()
    while at:
        tested += 1
        at = repo.bisect_mark("bad" if states.index(at) >= 5 else "good", at)
    assert repo.bisect_found() == [states[5]] and tested <= 4
    assert repo.bisect_reset() == states[8]
    with pytest.raises(RepoError):
        repo.bisect_next()
    repo.bisect_start("HEAD", states[6])
    assert repo.bisect_mark("skip", states[7]) is None and repo.bisect_found() == states[7:]


def test_upkeep(place):
    repo, folder, write, commit = place
    write(a__txt="a\n")
    one = commit("one", "1")
    repo.create_branch("gone")
    repo.checkout("gone")
    write(a__txt="lost\n")
    commit("two", "2")
    repo.checkout("main")
    repo.remove_branch("gone")
    assert repo.gc() == [("state", 1, 0), ("blob", 1, 5)]
    repo.gc(prune=True, prune_history=True)
    assert repo.gc() == [("state", 0, 0), ("blob", 0, 0)] and repo.table("edges").count() == 1 and repo.fsck() == []
    assert {r["state"] for r in repo.table("states").collect()} == {one, "0" * 64}
    (repo.root / "x.part").write_text("")
    repo._rewrite("blobs", repo.table("blobs").withColumn("bytes", F.lit(b"other")))
    assert {k for k, _ in repo.fsck()} == {"corrupt_blob", "orphan_temporary"}
    repo.add_remote("o", "/nowhere")
    assert repo.remotes() == {"o": "/nowhere"}
    repo.remove_remote("o")
    assert repo.remotes() == {}


def test_rebase_goes_on_from_edited_files(spark, place):
    repo, folder, write, commit = place
    write(t__txt="a\nb\n")
    commit("one", "1")
    repo.create_branch("side")
    write(t__txt="A\nb\n")
    commit("ours", "2")
    repo.checkout("side")
    write(t__txt="Z\nb\n")
    commit("theirs", "3")
    with pytest.raises(RepoError):
        repo.rebase("main")
    write(t__txt="AZ\nb\n")
    from lamina.sources import working_tree

    repo.rebase_continue(files=working_tree.load(spark, str(folder)))
    assert [bytes(r["content"]) for r in repo.files(repo.manifest("HEAD")).collect()] == [b"AZ\nb\n"]
    assert [r["message"] for r in repo.log().collect()][:2] == ["theirs", "ours"]


def test_views_of_every_kind(spark, place, tmp_path):
    repo, folder, write, commit = place
    make = lambda files: spark.createDataFrame([(p, bytearray(c), m) for p, (c, m) in files.items()], "path string, content binary, mode string")
    text = "regular"
    one = repo.commit("one", make({"a.rs": (CODE.encode(), text), "t.txt": (b"x\n", text), "b": (b"\0a", text), "l": (b"a.rs", "symlink"), "k": (b"k", text), "m.txt": (b"moved\n", text), "gone": (b"g", text), "bad.json": (b"{\"a\": 1}", text)}), "1")
    two = repo.commit("two", make({"a.rs": (CODE.replace("+ 1", "+ 2").encode(), text), "t.txt": (b"y\n", text), "b": (b"\0b", text), "l": (b"t.txt", "symlink"), "k": (b"\0", text), "n.txt": (b"moved\n", text), "new": (b"n", text), "bad.json": (b"{\"a\": ", text)}), "2")
    got = {r["path"]: (r["mode"], r["path_from"]) for r in repo.views((one, two)).collect()}
    assert got == {"a.rs": ("ast", None), "t.txt": ("text", None), "b": ("binary", None), "l": ("symlink", None), "k": ("kind_changed", None), "n.txt": ("rename", "m.txt"), "gone": ("deleted", None), "new": ("added", None), "bad.json": ("text", None)}
    assert list(repo.diff_states(one, two, "bad.json").first()["lines"])[0] == "parse mode: ast (left), text (right)"
    from lamina.sources import html_view

    assert html_view.write_views(repo.views((one, two)), str(tmp_path / "v.html")) == 9


def test_packs(spark):
    import random

    from lamina.operators import packs

    rng = random.Random(1)
    for _ in range(300):
        base, target = (bytes(rng.choices(b"ab", k=rng.randrange(0, 12))) for _ in range(2))
        assert packs.apply_delta(base, packs.build_delta(base, target)) == target
    with pytest.raises(ValueError):
        packs.apply_delta(b"", packs.build_delta(b"aaaa", b"aaaa"))
    body = bytes(rng.randbytes(5000))
    blobs = spark.createDataFrame([(f"00{i:02x}" + "0" * 58 + f"{j:02x}", bytearray(body + bytes([i, j]))) for i in range(4) for j in range(5)], "blob string, bytes binary")
    made = packs.pack(blobs.unionByName(blobs))
    kinds = [r["encoding"] for r in made.collect()]
    assert len(kinds) == 20 and kinds.count("delta") == 8
    assert {r["blob"]: bytes(r["bytes"]) for r in packs.unpack(made).collect()} == {r["blob"]: bytes(r["bytes"]) for r in blobs.collect()}
