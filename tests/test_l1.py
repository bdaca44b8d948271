"""Nearest descriptors by blocks of arrays against the plain comparison of all pairs."""

import time

import numpy as np
import pytest

from pointfold.operators import forest, l1, matching


def plain(rows, to, k):
    dist = np.stack([np.abs(to - q).sum(1) for q in rows])
    at = np.argsort(dist, 1, kind="stable")[:, :k]
    return at, np.take_along_axis(dist, at, 1)


def case(name):
    r = np.random.default_rng(7)
    whole, real = r.integers(-(10**6), 10**6, (700, 36)), r.normal(size=(700, 33))
    odd = real.copy()
    odd[::50, 3], odd[7::90, 5] = np.nan, np.inf
    return {
        "whole": whole,
        "real": real,
        "copies": whole[r.integers(0, 40, 700)],
        "few values": r.integers(0, 3, (700, 4)),
        "near copies and one far out": np.concatenate([np.full((600, 8), 5) + r.integers(0, 3, (600, 8)), [[10**12] * 8], r.integers(0, 99, (99, 8))]),
        "scales": real * 10.0 ** r.integers(-6, 7, 33),
        "equal": np.ones((700, 9)),
        "not finite": odd,
        "long": r.normal(size=(40, 3_000)),
        "one": whole[:1],
    }[name]


@pytest.mark.parametrize("name", ["whole", "real", "copies", "few values", "near copies and one far out", "scales", "equal", "not finite", "long", "one"])
@pytest.mark.parametrize("k", [1, 2, 7, 900])
def test_nearest_is_exact(monkeypatch, name, k):
    monkeypatch.setattr(l1, "EXACT", 500)
    rows = case(name)
    with np.errstate(invalid="ignore"):
        for ask, to in ((rows, rows), (rows[::3], rows[1::2] if len(rows) > 1 else rows)):
            want, got = plain(ask, to, k), l1.nearest(ask, to, k)
            assert np.array_equal(got[0], want[0]) and np.array_equal(got[1], want[1], equal_nan=True)
            assert got[1].dtype == want[1].dtype


@pytest.mark.parametrize("name", ["whole", "real", "copies", "few values", "near copies and one far out", "scales", "equal", "one"])
@pytest.mark.parametrize("held", [50, forest.HELD])
def test_together_without_a_border_is_exact(monkeypatch, name, held):
    monkeypatch.setattr(forest, "HELD", held)
    rows = case(name).astype(float)
    ask = rows[::3] + 1
    for k in (1, 3, 900):
        at, dist = plain(ask, rows, k)
        q, t, d = forest.Forest(rows).within(ask, k, np.inf)
        assert q.tolist() == np.repeat(np.arange(len(ask)), at.shape[1]).tolist()
        assert np.array_equal(d, dist.ravel()) and np.array_equal(t, at.ravel())


def test_together_meets_a_share_and_finds_the_nearest():
    points = np.random.default_rng(8).normal(size=(8_000, 36))
    f, ask = forest.Forest(points), points[::4]
    most, reach = forest.tuned(f, ask, 2, 256)
    assert 256 < most < 6_000 and 0 < reach < np.inf
    want = l1.nearest(ask, points, 2)[1][:, 1]
    q, _, dist = f.nearest(ask, 2)
    assert np.bincount(q, minlength=len(ask)).tolist() == [2] * len(ask)
    assert np.mean(dist[1::2] == want) >= 0.9


def test_near_copies_wait_in_bounded_memory(monkeypatch):
    """Half of a group within a step of the grid: candidates are settled often, and the nearest stay right."""
    r = np.random.default_rng(11)
    points = np.rint(np.concatenate([r.normal(0, 30, (700, 36)), r.normal(0, 125_000, (700, 36))]))
    monkeypatch.setattr(forest, "HELD", 20_000)
    sizes, whole = [], l1.exact
    monkeypatch.setattr(l1, "exact", lambda a, b, p, q: sizes.append(len(p)) or whole(a, b, p, q))
    q, t, dist = forest.Forest(points).within(points, 2, np.inf)
    assert len(sizes) > 5 and max(sizes) <= 20_000 + l1.TILE + 2 * len(points)
    at, want = plain(points, points, 2)
    assert np.array_equal(t, at.ravel()) and np.array_equal(dist, want.ravel())


def test_each_query_has_its_number_of_neighbours(monkeypatch):
    points = np.random.default_rng(9).normal(size=(900, 12))
    f = forest.Forest(points)
    monkeypatch.setattr(forest, "tuned", lambda *args: (300, 0.0))  # its own leaf only, which is too few
    q, t, dist = f.nearest(points, 100)
    assert np.bincount(q).tolist() == [100] * 900
    for i in range(0, 900, 90):
        mine = q == i
        assert len(set(t[mine])) == 100 and (np.diff(dist[mine]) >= 0).all()
        assert np.allclose(dist[mine], np.abs(points[t[mine]] - points[i]).sum(1))


def test_time_of_a_large_group_without_shapes(spark):
    """6,000 descriptors of one label; query by query this took over a minute."""
    rows = [(1, i, x) for i, x in enumerate(np.random.default_rng(10).integers(-(10**6), 10**6, (6_000, 36)).tolist())]
    df = spark.createDataFrame(rows, "label long, kp_id long, desc array<long>").cache()
    df.count()
    began = time.time()
    got = {x.q: x.dist for x in forest.forest_nearest(df, df, 2).where("rank = 2").collect()}
    want = {x.q: x.dist for x in matching.l1_nearest(df, df, 2).where("rank = 2").collect()}
    took = time.time() - began
    df.unpersist()
    assert len(want) == 6_000 and sum(got[k] == want[k] for k in want) / len(want) >= 0.9
    assert took < 30
