"""Merge bases of histories that are deep and of many edges."""

import random

import pytest

from lamina.operators import history


def _tips(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "state long")


def test_deep_histories_take_no_round_a_level(spark, monkeypatch):
    monkeypatch.setattr(history, "closure", lambda *_, **__: pytest.fail("one job a level"))
    edges = [(i, i - 1, 0) for i in range(1, 3001)] + [(10_000 + i, 10_000 + i - 1 if i else 1500, 0) for i in range(2000)]
    df = spark.createDataFrame(edges, "child long, parent long, ord int")
    assert [tuple(r) for r in history.merge_base(df, _tips(spark, 3000), _tips(spark, 11_999)).collect()] == [(1500, 3500)]
    assert history.merge_base(df, _tips(spark, 3000), _tips(spark, 99_999)).count() == 0
    assert history.merge_base(df, _tips(spark), _tips(spark, 5)).count() == 0


def test_either_way_gives_the_same(spark, monkeypatch):
    rng = random.Random(5)
    edges = sorted({(c, rng.randrange(c)) for c in range(1, 300)} | {(c, rng.randrange(max(0, c - 9), c)) for c in range(2, 300)})
    df = spark.createDataFrame([(c, p, 0) for c, p in edges], "child long, parent long, ord int")
    for a, b in ((299, 298), (250, 120), (7, 7)):
        got = []
        for most in (history.LOCAL_EDGES, 0):
            monkeypatch.setattr(history, "WALKED_EDGES", most)
            got.append([tuple(r) for r in history.merge_base(df, _tips(spark, a), _tips(spark, b)).collect()])
        assert got[0] == got[1] and got[0]
