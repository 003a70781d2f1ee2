from pathlib import Path

from lamina import cli


def test_commands(spark, tmp_path, capsys):
    def said(*argv, code=0):
        assert cli.main(["-C", str(tmp_path), *argv], spark) == code, capsys.readouterr()
        return capsys.readouterr().out.strip()

    file = tmp_path / "a.rs"
    said("init")
    said("config", "a", "a@example.org")
    file.write_text("fn a() {}\n")
    first = said("commit", "--message", "one", "--all")
    said("branch", "side")
    file.write_text("fn a() {}\nfn b() {}\n")
    assert said("status") == "a.rs\t\tmodified\t\t\tFalse"
    assert said("diff") == "modified a.rs\n  insert Function"
    assert said("add", ".") == "1 paths"
    second = said("commit", "--message", "two")
    said("checkout", "side")
    assert file.read_text() == "fn a() {}\n"
    file.write_text("fn c() {}\n")
    said("commit", "--message", "three", "--all")
    said("merge", "main")
    assert file.read_text() == "fn c() {}\nfn b() {}\n"
    assert said("merge-base", "main", "side") == second
    assert len(said("log").splitlines()) == 5
    assert said("diff", first, "side") == "modified\ta.rs"
    said("diff", first, "side", "--html", str(tmp_path / "v.html"))
    assert (tmp_path / "v.html").exists()
    (tmp_path / "v.html").unlink()
    file.write_text("fn c() {}\nfn b() { x(); }\n")
    assert said("stash", "--message", "later") == "0\tlater"
    assert file.read_text() == "fn c() {}\nfn b() {}\n"
    said("stash", "pop")
    assert file.read_text() == "fn c() {}\nfn b() { x(); }\n"
    said("tag", "v1")
    assert said("tag") == "v1" and said("branch") == "main\nside"
    assert said("fsck") == "" and said("gc").splitlines()[0] == "state\t0\t0"
    assert len(said("blame", "a.rs").splitlines()) == 2
    said("merge", "side", code=2)
    said("reset", first, code=2)
    said("reset", first, "--force")
    assert file.read_text() == "fn a() {}\n"


def test_drivers(tmp_path, capsys):
    paths = {}
    for name, text in {"base": "fn a() {}\n", "ours": "fn b() {}\n", "theirs": "fn a() {}\nfn c() {}\n", "bad": "fn z() {}\n"}.items():
        (tmp_path / name).write_text(text)
        paths[name] = str(tmp_path / name)
    assert cli.main(["diff-driver", "x.rs", paths["base"], paths["ours"]]) == 0
    assert "rename `a` to `b`" in capsys.readouterr().out
    assert cli.main(["merge-driver", paths["ours"], paths["base"], paths["theirs"], "x.rs"]) == 0
    assert Path(paths["ours"]).read_text() == "fn b() {}\nfn c() {}\n"
    assert cli.main(["merge-driver", paths["bad"], paths["base"], paths["ours"], "x.rs"]) == 1
    assert Path(paths["bad"]).read_text().startswith("<<<<<<< ours")
    (tmp_path / "bin").write_bytes(b"\xff\x00")
    assert cli.main(["merge-driver", str(tmp_path / "bin"), paths["base"], paths["theirs"], "x"]) == 2
