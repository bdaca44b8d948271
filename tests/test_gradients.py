"""Gradients of intensity and their histograms against numpy, and turned."""

import math

import numpy as np
import pytest

from pointfold.operators import descriptors as ds

ROW = "frame long, kx long, ky long, kz long, x long, y long, z long, intensity long, nx double, ny double, nz double"


def cloud(seed=0, n=40):
    r = np.random.default_rng(seed)
    at = r.integers(0, 120, (n, 3))
    normal = r.normal(size=(n, 3))
    normal /= np.linalg.norm(normal, axis=1, keepdims=True)
    return at, r.integers(0, 700, n), normal


def table(spark, at, intensity, normal):
    rows = [(0, i, 0, 0, *map(int, p), int(v), *map(float, n)) for i, (p, v, n) in enumerate(zip(at, intensity, normal, strict=True))]
    return spark.createDataFrame(rows, ROW)


def plain(at, intensity, normal, radius):
    g, n = np.full(at.shape, np.nan), len(at)
    near = [np.flatnonzero(((at - p) ** 2).sum(1) <= radius**2) for p in at]
    for i, js in enumerate(near):
        d = at[js] - at[js].mean(0)
        if np.linalg.matrix_rank(d) == 3:
            f = np.linalg.lstsq(d, intensity[js] - intensity[js].mean(), rcond=None)[0]
            g[i] = f - (f @ normal[i]) * normal[i]
    h = np.zeros((n, 4, 8))
    for i, js in enumerate(near):
        for j in js:
            size = np.linalg.norm(g[j])
            far = np.linalg.norm(at[j] - at[i])
            if far > 0 and size > 0:
                ring = far / radius * 4
                turn = math.acos(np.clip((at[j] - at[i]) @ g[j] / far / size, -1, 1)) / math.pi * 8
                for a in range(4):
                    for b in range(8):
                        h[i, a, b] += max(1 - abs(ring - a), 0) * max(1 - abs(turn - b), 0) * size
    length = np.sqrt((h**2).sum((1, 2)))
    return g, h / np.where(length > 0, length, 1)[:, None, None]


def both(spark, at, intensity, normal, radius):
    v = table(spark, at, intensity, normal)
    g = ds.gradients(v, radius)
    got = {r.kx: [r.gx, r.gy, r.gz] for r in g.collect()}
    h = ds.gradient_histograms(v, g.join(v.select("frame", "kx", "ky", "kz", "x", "y", "z"), ["frame", "kx", "ky", "kz"]), radius)
    return got, {r.kx: [r[n] for n in ds.GRADIENTS] for r in h.collect()}


def test_against_numpy(spark):
    at, intensity, normal = cloud()
    at[:2] = [[900, 0, 0], [905, 0, 0]]  # two apart: no gradient
    want_g, want_h = plain(at, intensity, normal, 60)
    got_g, got_h = both(spark, at, intensity, normal, 60)
    assert set(got_g) == set(np.flatnonzero(~np.isnan(want_g[:, 0])).tolist()) and len(got_g) > 30
    for i, g in got_g.items():
        assert g == pytest.approx(want_g[i], rel=1e-6, abs=1e-6)
    for i, h in got_h.items():
        assert h == pytest.approx(want_h[i].ravel(), abs=1e-6)
        assert sum(x * x for x in h) == pytest.approx(1)


def test_histograms_do_not_change_when_all_turns(spark):
    at, intensity, normal = cloud(1)
    turn = np.array([[0, -1, 0], [0, 0, 1], [-1, 0, 0]])  # axes exchanged: whole numbers stay whole
    _, h = both(spark, at, intensity, normal, 60)
    _, turned = both(spark, at @ turn.T + 500, intensity, normal @ turn.T, 60)
    assert set(h) == set(turned)
    for i in h:
        assert h[i] == pytest.approx(turned[i], abs=1e-6)
