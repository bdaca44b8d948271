"""Keypoints, trials and growth on small clouds made by hand, against plain Python."""

import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointfold.operators import components, growth, matching, spatial, surface
from pointfold.operators.comovement import objects, with_later


@pytest.fixture(autouse=True)
def folder(spark, tmp_path):
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(str(tmp_path / "shared"))


def test_a_chain_of_100_parts_is_one_object(spark):
    m = spark.createDataFrame([(f, p) for f in range(99) for p in (f, f + 1)], "frame long, label long")
    # each neighbour moves twice alone, so only frames of both would count; keep pairs apart in time instead
    pairs = spark.createDataFrame([(i, i + 1) for i in range(99)], "a long, b long")
    assert {r.root for r in components.connected(pairs).collect()} == {0}
    assert {r.object_id for r in objects(m.where("frame % 2 = 0"), m.limit(0)).collect()} == set(range(0, 100, 2))


def test_later_moves_over_blocks_of_frames(spark):
    rows = [(f, p) for p in (1, 2) for f in range(0, 60, p)]
    got = {(r.frame, r.label): r.later for r in with_later(spark.createDataFrame(rows, "frame long, label long"), 7).collect()}
    assert got == {(f, p): sum(g >= f and q == p for g, q in rows) for f, p in rows}


def test_nearest_has_no_widest_radius(spark):
    p = spark.createDataFrame([(0, 1, 0, 0, 0), (0, 2, 90_000, 5, 0), (1, 3, 0, 0, 0)], "frame long, pid long, x long, y long, z long")
    got = {(r.frame, r.pid, r.o_pid) for r in surface.nearest(p, p, 3, 10, others=True).collect()}
    assert got == {(0, 1, 2), (0, 2, 1)}
    assert surface.nearest(p.limit(0), p.limit(0), 1, 10).count() == 0


def test_rays_by_steps(spark):
    """The first step lies 1.25 voxels away and counts as 1; cells are entered once; up to 2.5 only new ones count."""
    key = (0, 3, 2, 12)
    v = spark.createDataFrame([key], "frame long, kx long, ky long, kz long")
    camera = tuple(surface.CAMERA[a] for a in "xyz")
    assert camera == (10, 8, -20)
    d = [c - k for c, k in zip(camera, key[1:], strict=True)]
    norm = math.sqrt(sum(x * x for x in d))
    want, last = {}, key[1:]
    for i in range(int(norm / 0.25)):
        at = [k + x / norm * (1 + 0.25 * (i + 1)) for k, x in zip(key[1:], d, strict=True)]
        if at[2] < -13:
            break
        cell = tuple(math.floor(x + 0.5) for x in at)
        if cell != last:
            want[cell] = 1 + 0.25 * i
            last = cell
    got = {(r.ox, r.oy, r.oz): r.distance for r in surface.rays(v).collect()}
    assert got == want
    near = [c for c, dist in want.items() if dist <= 2.5]
    far = min((dist, c) for c, dist in want.items() if dist > 2.5)
    old = spark.createDataFrame([(0, *c, False) for c in [*near, far[1]]], "frame long, kx long, ky long, kz long, is_new boolean")
    assert [(r.distance, r.ox) for r in surface.occluders(v, old).collect()] == [(far[0], far[1][0])]
    (r,) = surface.occluders(v, old.withColumn("is_new", F.lit(True))).collect()
    assert r.distance == min(want.values())


def plain_matches(a, b):
    """Rank by rank: a's rows ask for b's; of those that ask for one, the nearest gets it."""
    dist = np.abs(a[:, None] - b[None]).sum(2)
    rank = np.argsort(dist, 1, kind="stable")
    match = {}
    for r in range(min(len(a), len(b))):
        best = {}
        for i in range(len(a)):
            if i not in match:
                best[rank[i, r]] = min(best.get(rank[i, r], (math.inf, 0)), (dist[i, rank[i, r]], i))
        match |= {i: t for t, (_, i) in best.items()}
    return match


def test_trials_against_plain_python(spark):
    r = np.random.default_rng(3)
    turn = np.array([[0.8, -0.6, 0], [0.6, 0.8, 0], [0, 0, 1.0]])
    shift = np.array([500.0, 40, 10])
    labels = {4: 16, 9: 14}
    prev, curr, centres, t = [], [], [], 0
    for label, n in labels.items():
        at, desc = r.uniform(0, 80, (n, 3)) + 100 * label, r.uniform(0, 100, (n, 8))
        centres.append((1, label, *map(float, at.mean(0))))
        prev += [(1, label, k, *map(float, p), [float(x) for x in d]) for k, (p, d) in enumerate(zip(at, desc, strict=True))]
        if label == 4:
            for p, d in zip(at, desc, strict=True):
                curr.append((1, t, *map(float, turn @ p + shift + r.normal(0, 1, 3)), [float(x) for x in d + r.normal(0, 2, 8)]))
                t += 1
    for _ in range(20):
        curr.append((1, t, *map(float, r.uniform(0, 900, 3)), [float(x) for x in r.uniform(0, 100, 8)]))
        t += 1
    kinds = "kp_id long, vx double, vy double, vz double, desc array<double>"
    p, c = spark.createDataFrame(prev, f"frame long, label long, {kinds}"), spark.createDataFrame(curr, f"frame long, {kinds}")
    order = lambda kp, i: (kp * 7919 + i * 104729 + kp * i * 13) % 1009
    middle = spark.createDataFrame(centres, "frame long, label long, x double, y double, z double")
    scored, found = matching.trials(p, c, middle, 100, 20, 3, 60.0, order)
    got = {(x.label, x.trial): (round(x.score, 6), x.n) for x in scored.collect()}
    want, sets = {}, {}
    cat, cd = np.array([x[2:5] for x in curr]), np.array([x[5] for x in curr])
    for _, label, *centre in centres:
        at, d = (np.array([x[k] for x in prev if x[1] == label]) for k in (slice(3, 6), 6))
        near = np.abs(cd[:, None] - d[None]).sum(2).min(1)

        def fit(m, at=at):
            i, j = np.array(list(m)), np.array(list(m.values()))
            pm, qm = at[i].mean(0), cat[j].mean(0)
            x = matching.fitted((at[i] - pm).T @ (cat[j] - qm), pm, qm)
            return np.array(x[:9]).reshape(3, 3), np.array(x[9:])

        def inside(f, centre=centre, near=near):
            return [k for k in range(len(cat)) if ((cat[k] - f[0] @ centre - f[1]) ** 2).sum() <= 1e4 and 0 < near[k] < 60]

        for trial in range(20):
            some = sorted(range(len(at)), key=lambda k: (order(k, trial), k))[:3]
            m = plain_matches(d[some], cd)
            maybe = inside(fit({some[i]: j for i, j in m.items()}))
            if len(maybe) < max(6, len(at) // 4):
                continue
            again = plain_matches(cd[maybe], d)
            kept = inside(fit({j: maybe[i] for i, j in again.items()}))
            if len(kept) >= len(maybe):
                want[label, trial] = (round(len(kept) // len(at) + 3 * (60 - near[kept].mean()) / 60, 6), len(kept))
                sets[label, trial] = set(kept)
    assert got == want
    assert {k[0] for k in want} == {4}
    best = matching.best_trials(scored).collect()
    top = max(v[0] for v in want.values())
    assert [(x.label, x.trial) for x in best] == [(4, min(k[1] for k, v in want.items() if v[0] == top))]
    assert np.allclose([best[0][c] for c in matching.RIGID[:9]], turn.ravel(), atol=0.1)
    held = {}
    for x in found.collect():
        held.setdefault((x.label, x.trial), set()).add(x.t)
    assert all(held[k] == s for k, s in sets.items())
    lost = spark.createDataFrame([(1, 4), (1, 9)], "frame long, label long")
    stand, reset = matching.matches(scored, found, lost, lambda best, used: lost.withColumn("accepted", F.lit(True)))
    assert ([x.label for x in stand.collect()], [x.label for x in reset.collect()]) == ([4], [9])
    stand, reset = matching.matches(scored, found, lost, lambda best, used: lost.withColumn("accepted", F.col("label") == 9))
    assert (stand.count(), reset.count()) == (0, 2)


def test_a_match_that_is_not_accepted_uses_up_its_inliers(spark):
    rows = [(1, 3, 0, 1.0), (1, 5, 2, 2.0), (1, 7, 1, 0.5)]
    scored = spark.createDataFrame(rows, "frame long, label long, trial long, score double")
    found = spark.createDataFrame([(1, 3, 0, 10), (1, 3, 0, 11), (1, 5, 2, 11), (1, 5, 2, 12), (1, 7, 1, 13)], "frame long, label long, trial long, t long")
    lost = scored.select("frame", "label")
    refused = lambda best, used: best.select("frame", "label", (F.col("label") != 3).alias("accepted"))
    stand, reset = matching.matches(scored, found, lost, refused)
    assert [x.label for x in stand.collect()] == [7]
    assert sorted(x.label for x in reset.collect()) == [3, 5]


def walked(cell):
    """Cells on the line from the camera to a voxel's middle, by stepping over the next plane crossed; exact, in fractions."""
    origin = [surface.ORIGIN[a] for a in "xyz"]
    p = [Fraction(2 * k + 1, 2) * 40 + o for k, o in zip(cell, origin, strict=True)]
    t = Fraction(origin[2]) / p[2]
    at = [math.floor((t * v - o) / 40) for v, o in zip(p, origin, strict=True)]
    step = [1 if v > 0 else -1 for v in p]
    out = []
    while at != list(cell):
        ahead = [((k + (s > 0)) * 40 + o) / v for k, s, o, v in zip(at, step, origin, p, strict=True)]
        if min(ahead) > t:  # a line that starts on a plane isn't in the cell before it
            out.append(tuple(at))
        t = min(ahead)
        at = [k + s * (x == t) for k, s, x in zip(at, step, ahead, strict=True)]
    return out


def test_lines_cross_every_cell(spark):
    cells = [(0, 3, 2, 12), (0, 19, 14, 11), (0, 0, 0, 0), (0, 10, 9, 5), (0, 2, 13, 7), (0, 17, 0, 9)]
    v = spark.createDataFrame(cells, "frame long, kx long, ky long, kz long")
    got: dict = {}
    for r in surface.crossed(v).collect():
        got.setdefault((r.kx, r.ky, r.kz), set()).add((r.ox, r.oy, r.oz))
    walk = {(r.kx, r.ky, r.kz, r.ox, r.oy, r.oz) for r in surface.rays(v).collect()}
    missed = 0
    for _, *k in cells:
        want = set(walked(tuple(k)))
        assert got.get(tuple(k), set()) == want
        missed += sum((*k, *c) not in walk for c in want)
    assert missed  # steps of a quarter voxel jump over some


def test_hidden_shares_by_lines(spark):
    at = (4, 3, 11)
    between = walked(at)[2]
    of = spark.createDataFrame([(0, 1, *at), (0, 1, *at), (0, 1, 12, 9, 11), (0, 2, *at)], "frame long, label long, kx long, ky long, kz long")
    by = spark.createDataFrame([(0, *between), (0, *at), (1, *walked((12, 9, 11))[0])], "frame long, kx long, ky long, kz long")
    got = {r.label: r.share for r in matching.hidden_shares(of, by).collect()}
    assert got == {1: pytest.approx(2 / 3), 2: 1.0}


def test_growth_with_real_normals_against_plain_python(spark):
    """Two planes that meet in an edge, with their own normals: rounds as in the docstring."""
    cells = [(0, i, j, 5) for i in range(7) for j in range(5)] + [(0, 7, j, k) for j in range(5) for k in range(6, 10)]
    normal = lambda k: (0.0, 0.0, -1.0) if k[3] == 5 else (-1.0, 0.0, 0.0)
    rows = [(*k, *(40 * x + 3 for x in k[1:]), k[1] * 9 % 50, k[2] * 7 % 40, k[3], *normal(k)) for k in cells]
    v = spark.createDataFrame(rows, "frame long, kx long, ky long, kz long, x long, y long, z long, r long, g long, b long, nx double, ny double, nz double")
    seeds = {(0, 1, 1, 5): 1, (0, 5, 4, 5): 2, (0, 7, 2, 9): 3}
    s = spark.createDataFrame([(*k, n) for k, n in seeds.items()], "frame long, kx long, ky long, kz long, label long")
    rounds = growth.rounds_of(40, 200)
    assert (rounds, growth.rounds_of(0.008, 0.08)) == (8, 16)
    got = {(r.kx, r.ky, r.kz): (r.label, None if r.d is None else round(r.d, 6)) for r in growth.grow(v, spatial.adjacency(v), s, rounds).collect()}
    at = {r[1:4]: np.array(r[4:], float) for r in rows}
    label, best = {k[1:]: n for k, n in seeds.items()}, {}
    for i in range(rounds):
        centre = {}
        for n in set(label.values()):
            own = np.array([at[k] for k, m in label.items() if m == n])
            unit = own[:, 6:].sum(0)
            centre[n] = np.concatenate([own[:, :6].mean(0), unit / max(np.linalg.norm(unit), 1e-12)]) if i else np.zeros(9)
        asks = {}
        for k, n in label.items():
            for o in at:
                if o != k and max(abs(a - b) for a, b in zip(o, k, strict=True)) <= 1 and label.get(o) != n:
                    x, c = at[o], centre[n]
                    d = (1 - abs(x[6:] @ c[6:])) + np.linalg.norm(x[3:6] - c[3:6]) / 255 * 0.2 + np.linalg.norm(x[:3] - c[:3]) / 200 * 0.4
                    asks[o] = min(asks.get(o, (math.inf, 0)), (round(d, 12), n))
        for o, (d, n) in asks.items():
            if d < best.get(o, math.inf) - 1e-12:
                best[o], label[o] = d, n
    assert got == {k: (label.get(k), round(best[k], 6) if k in best else None) for k in at}
    assert {n for n, _ in got.values()} == {1, 2, 3}


def test_refining_grows_again_from_the_centres(spark):
    cells = [(0, i, j, 5) for i in range(9) for j in range(3)]
    rows = [(*k, *(40 * x for x in k[1:]), 1, 2, 3, 0.0, 0.0, -1.0) for k in cells]
    v = spark.createDataFrame(rows, "frame long, kx long, ky long, kz long, x long, y long, z long, r long, g long, b long, nx double, ny double, nz double")
    seeds = spark.createDataFrame([(0, 0, 0, 5, 1), (0, 8, 2, 5, 2)], "frame long, kx long, ky long, kz long, label long")
    edges = spatial.adjacency(v)
    again = growth.refined(growth.grow(v, edges, seeds, 8), edges, 8)
    label = {(r.kx, r.ky): r.label for r in again.collect()}
    assert len(label) == 27
    assert all(label[i, j] == 1 for i in range(4) for j in range(3))
    assert all(label[i, j] == 2 for i in range(5, 9) for j in range(3))
