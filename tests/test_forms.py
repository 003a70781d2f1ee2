"""Runs shared by form give what each text gives by itself."""

import random
import time

import pytest

from lamina.kernel import diff as _diff
from lamina.kernel import forms
from lamina.kernel import merge as _merge
from lamina.kernel.graph import apply
from lamina.kernel.parse import parse_path
from lamina.operators import kernels

STARTS = {
    "a.json": '{\n  "a": 1,\n  "b": {"k": -2.5e3, "a": null},\n  "c": ["x", "x", true]\n}\n',
    "a.rs": "fn one<'a>() {\n    let x = \"s\"; // note\n    If(x, 'c', 12);\n}\n\nstruct Two { a: u8, b: u8 }\n",
    "a.sql": "-- note\nselect a, 'b' from t where a = 1;\nselect b from t;\n",
    "a.py": "def f(a):\n    return a + 1\n\nclass B:\n    x = 'y'\n",
    "a.html": "<p>one <b>two</b></p>\n",
    "a.css": "/* note */ .a { color: #ff0; } .b-c { width: 10px; }\n",
    "a.js": "import { a } from `b`;\nconst x = a(1, 'y')\nif (x) { x = 2 }\n",
    "a.txt": "one\ntwo\n",
}
WORDS = ["a", "zz", "If", "if", "null", "true", "12", "0", '"s"', '"x y"', "{", "}", "(", ")", ",", ";", ":", "\n", " ", "'q'", "#", "//", "-", "'", "x"]


def _varied(text: str, rng: random.Random) -> str:
    for _ in range(rng.randint(0, 3)):
        i = rng.randrange(len(text) + 1)
        text = text[:i] + rng.choice(WORDS) * rng.randint(0, 1) + text[i + rng.randint(0, 3) :]
    return text


def _rows() -> list[tuple[str, str, str, str]]:
    rng, out = random.Random(7), []
    for path, text in STARTS.items():
        for i in range(60):
            base = _varied(text, rng) if i % 3 == 0 else text.replace("1", str(rng.randint(1, 30)))
            out.append((f"{len(out)}{path}", base, _varied(base, rng), _varied(base, rng)))
    return out


@pytest.fixture(scope="module")
def rows(spark):
    given = _rows()
    return given, spark.createDataFrame(given, "path string, old string, new string, other string").cache()


def test_shared_runs_of_diff_and_apply(rows):
    given, df = rows
    want, texts = [], []
    for path, old, new, _ in given:
        files = parse_path(path, old), parse_path(path, new)
        if all(files):
            made = _diff.diff(*files)[0]
            texts.append((path, apply(files[0], made).text()))
            if old != new:
                want += [(path, i, m.op, _diff.intent(files[0], m), m.node, m.parent, m.before, m.payload) for i, m in enumerate(made)]
    assert len(want) > 200
    assert sorted(map(tuple, kernels.structural_diff(df).collect()), key=str) == sorted(want, key=str)
    assert sorted(map(tuple, kernels.structural_diff(df, parents=False).collect()), key=str) == sorted([(*w[:5], *w[6:]) for w in want], key=str)
    assert sorted(map(tuple, kernels.applied_diff(df).collect())) == sorted(texts)


def test_shared_runs_of_alignment(rows):
    given, df = rows
    want = []
    for path, old, new, _ in given:
        files = parse_path(path, old), parse_path(path, new)
        if all(files):
            want += [(path, *[e[c] for c in ("old_id", "new_id", "kind", "method", "parent_old", "parent_new")]) for e in _diff.diff(*files, detailed=True)[1]]
    assert len(want) > 2000
    assert sorted(map(tuple, kernels.alignment(df).collect())) == sorted(want)


def test_shared_runs_of_merge(rows):
    given, df = rows
    want = []
    for path, *texts in given:
        m = _merge.merge_files(path, *texts)
        want.append((path, m.clean, m.text, m.message, [" / ".join(o) for o in m.overlaps]))
    assert {w[1] for w in want} == {True, False}
    got = kernels.merge_files(df.selectExpr("path", "old as base", "new as left", "other as right"))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_texts_of_one_form_cost_one_run():
    made = []
    start = time.thread_time()
    for i in range(20_000):
        old = f'{{"type": "t{i}", "user": {i + 1000000}, "props": {{"k": "v"}}}}\n'
        found, words = forms.once("test", "json", (old, old.replace('"t', '"x')), lambda files: made.append(files) or (forms.digests([files[1].root]),))
        assert len(found[0](words)[0]) == 32
    assert len(made) == 1
    assert time.thread_time() - start < 8  # each by itself takes some 20 s
    assert forms.once("test", "json", ("1" * (forms.SHARED_CHARS + 1),), lambda files: (1,)) is None
    assert not forms.parses("json", "{") and forms.parses("json", "{}")
