"""Nearest neighbours by levels of cells against plain Python."""

import numpy as np
import pytest

from pointfold.operators import surface

ROW = "frame long, pid long, x long, y long, z long"


def brute(a, b, k, others):
    out = []
    for f, i, *p in a:
        d = sorted((sum((u - v) ** 2 for u, v in zip(p, q, strict=True)), j) for g, j, *q in b if g == f and not (others and j == i))
        out += [(f, i, j, d2, n + 1) for n, (d2, j) in enumerate(d[:k])]
    return sorted(out)


def got_of(df):
    return sorted((r.frame, r.pid, r.o_pid, r.d2, r["rank"]) for r in df.collect())


def cloud(seed=0):
    """Two clusters, a dense spot with equal points, points far out on both sides, and a frame of two points."""
    r = np.random.default_rng(seed)
    parts = [r.normal(0, 40, (150, 3)), r.normal(0, 8, (120, 3)) + [900, -300, 50], np.full((20, 3), 17.0), [[60_000, -5, 9], [-2_000_000, 7, 7], [60_300, 0, 0]]]
    at = np.concatenate(parts).astype(int).tolist()
    return [(0, i, *p) for i, p in enumerate(at)] + [(1, 5, 0, 0, 0), (1, 6, 100_000, 0, 0)]


@pytest.mark.parametrize(("k", "others", "far"), [(1, False, 4096), (8, True, 4096), (8, True, 50), (3, False, 0), (500, False, 4096)])
def test_against_plain_python(spark, monkeypatch, k, others, far):
    monkeypatch.setattr(surface, "FAR", far)
    rows = cloud()
    df = spark.createDataFrame(rows, ROW).repartition(3)
    assert got_of(surface.nearest(df, df, k, 20, others)) == brute(rows, rows, k, others)


def test_other_clouds_and_no_rows(spark):
    rows = cloud()
    a = [(0, 1, 30, 30, 30), (0, 2, 10**7, 0, 0), (2, 1, 0, 0, 0)]  # frame 2 has no points to find
    left, right = spark.createDataFrame(a, ROW), spark.createDataFrame(rows, ROW)
    assert got_of(surface.nearest(left, right, 2, 25)) == brute(a, rows, 2, False)
    assert surface.nearest(left.limit(0), right, 2, 25).count() == 0
    assert surface.nearest(left, right.limit(0), 2, 25).count() == 0


def joins(df):
    return df._jdf.queryExecution().analyzed().toString().count("Join ")


def test_joins_do_not_grow_with_the_span(spark):
    r = np.random.default_rng(1)
    found = set()
    for span in (1_000, 100_000, 3_000_000):
        df = spark.createDataFrame([(0, i, *p) for i, p in enumerate(r.integers(0, span, (50, 3)).tolist())], ROW)
        found.add(joins(surface.nearest(df, df, 4, 100)))
    assert len(found) == 1 and found.pop() <= 3


def test_a_far_row_costs_its_path_only(spark, monkeypatch):
    r = np.random.default_rng(2)
    rows = [(0, i, *p) for i, p in enumerate(r.integers(0, 2_000, (6_000, 3)).tolist())]
    monkeypatch.setattr(surface, "FAR", 2_000)
    kept = []
    whole = surface.descended
    monkeypatch.setattr(surface, "descended", lambda *args: kept.append(whole(*args)) or kept[-1])
    a = [(0, 0, 3_000_000, 1_000, 1_000)]
    got = surface.nearest(spark.createDataFrame(a, ROW), spark.createDataFrame(rows, ROW), 5, 50)
    assert got_of(got) == brute(a, rows, 5, False)
    assert len(kept) == 1 and kept[0].count() < 300  # cells of 50, of some 5,800 that are taken
