"""The label tracker against plain Python, known motions, and over a stream with restarts and deletions."""

import colorsys
import math

import numpy as np
import pytest

from pointfold.operators import tracker as T
from pointfold.streaming import label_tracking as L


def scene(labels=(1, 2, 3), frames=8, seed=0):
    """(label, frame, x, y, z, r, g, b) of parts that move by known steps, points that belong to none, and each part's offset and turn by frame."""
    r = np.random.default_rng(seed)
    out, known = [], {}
    for k in labels:
        p = r.uniform(-60, 60, (60, 3)) + [400 * k, -100, 1000]
        rgb = r.integers(0, 256, (60, 3))
        step, turn = r.uniform(-9, 9, 3), r.uniform(-0.02, 0.02, 3)
        c = T.thinned(np.concatenate([p, rgb], 1), 2 * T.GRID)[:, :3].mean(0)
        for f in range(frames):
            at = (p - c) @ T.rotations(turn[None] * f)[0].T + c + step * f
            known[k, f] = c + step * f
            out += [(k, f, *map(float, x), *map(float, y)) for x, y in zip(at, rgb, strict=True)]
    clutter = [(None, f, *map(float, x), *map(float, y)) for f in range(frames) for x, y in zip(r.uniform([200, -300, 800], [1500, 200, 1200], (400, 3)), r.integers(0, 256, (400, 3)), strict=True)]
    return out, clutter, known


ROW = "label long, frame long, x double, y double, z double, r double, g double, b double"


def tables(spark, rows, clutter):
    first = spark.createDataFrame([x for x in rows if x[1] == 0], ROW)
    points = spark.createDataFrame([(None, *x[1:]) for x in rows] + clutter, ROW)
    return points.repartition(3), first


def test_labels_are_found_over_seven_frames(spark):
    rows, clutter, known = scene()
    got = {(r.label, r.frame): r for r in T.tracked(*tables(spark, rows, clutter)).collect()}
    assert set(got) == {(k, f) for k, f in known if f}
    for at, r in got.items():
        assert max(abs(v - w) for v, w in zip((r.x, r.y, r.z), known[at], strict=True)) <= 20
        assert T.LEAST <= r.particles <= T.MOST


def test_empty_tables_and_labels_without_points(spark):
    rows, clutter, _ = scene((1,), 2)
    points, first = tables(spark, rows, clutter)
    assert T.tracked(points.limit(0), first).count() == 0
    assert T.tracked(points, first.limit(0)).count() == 0
    far = first.selectExpr("label", "frame", "x + 9e5 AS x", "y", "z", "r", "g", "b")
    assert T.tracked(points, far).count() == 0


def plain_step(t, cloud, frame, least, most):
    """One step with numbers only; random numbers and thinned clouds are the library's."""
    u3, u5, noise = T.uniforms(most, t.label, t.frame, 3), T.uniforms(most, t.label, t.frame, 5), T.gaussians(most, t.label, t.frame, 4)
    drawn, seen = [], set()
    for n in range(most):
        total, parent = 0.0, 0
        for i, w in enumerate(t.weights):
            total += w
            parent = i
            if u3[n] <= total:
                break
        p = [t.particles[parent][j] + noise[n][j] * T.STEP[j] + (t.motion[j] if u5[n] < T.MOTION else 0) for j in range(6)]
        drawn.append(list(t.pose) if n == 0 else p)
        seen.add(tuple(math.floor(v / b) for v, b in zip(drawn[-1], T.BIN, strict=True)))
        k = len(seen)
        if k > 1:
            a = 2 / (9 * (k - 1))
            if n + 1 >= least and n + 1 >= (k - 1) / 0.4 * (1 - a + math.sqrt(a) * 2.3263478740408408) ** 3:
                break
    cloud = T.thinned(cloud, T.GRID).tolist()
    fits = []
    for x, y, z, roll, pitch, yaw in drawn:
        turn = T.rotations(np.array([[roll, pitch, yaw]]))[0].tolist()
        fit = 0.0
        for px, py, pz, h, s, _ in t.reference.tolist():
            at = [sum(a * b for a, b in zip(row, (px, py, pz), strict=True)) + c for row, c in zip(turn, (x, y, z), strict=True)]
            cell = [math.floor(a / 5) for a in at]
            middle = [(c + 0.5) * 5 for c in cell]
            near = [(sum((a - m) ** 2 for a, m in zip(q[:3], middle, strict=True)), n) for n, q in enumerate(cloud) if all(abs(math.floor(a / 5) - c) <= 2 for a, c in zip(q[:3], cell, strict=True))]
            if near:
                q = cloud[min(near)[1]]
                d2 = sum((a - b) ** 2 for a, b in zip(q[:3], at, strict=True))
                if d2 <= 100:
                    hue, sat, _ = colorsys.rgb_to_hsv(*[c / 255 for c in q[3:]])
                    off = min(abs(hue - h), 1 - abs(hue - h))
                    fit += 1 / (1 + d2 / 100) / (1 + off**2 + (sat - s) ** 2)
        fits.append(fit)
    best, worst = max(fits), min(fits)
    weights = [math.exp(15 * (f - best) / (best - worst)) if best > worst else 1.0 for f in fits]
    weights = [w / sum(weights) for w in weights]
    return drawn, weights, [sum(w * p[j] for w, p in zip(weights, drawn, strict=True)) for j in range(6)]


def test_steps_are_those_of_plain_python():
    rows, clutter, _ = scene((5,), 4)
    by_frame = {f: np.array([x[2:] for x in rows + clutter[::20] if x[1] == f]) for f in range(4)}
    t = T.Tracker.begin(5, np.array([x[2:] for x in rows if x[1] == 0][:20]), 0, 30)
    for f in range(1, 4):
        drawn, weights, pose = plain_step(t, by_frame[f], f, 20, 60)
        t = t.step(by_frame[f], f, 20, 60)
        assert t.particles == pytest.approx(np.array(drawn))
        assert t.weights == pytest.approx(np.array(weights))
        assert t.pose == pytest.approx(np.array(pose))
    assert t.step(np.zeros((0, 6)), 9).pose.tolist() == t.pose.tolist()


def test_colours_and_bound():
    r = np.random.default_rng(0)
    rgb = np.concatenate([r.integers(0, 256, (50, 3)), [[0, 0, 0], [7, 7, 7], [255, 0, 0], [9, 9, 1]]]).astype(float)
    assert T.hue(rgb) == pytest.approx(np.array([colorsys.rgb_to_hsv(*(c / 255)) for c in rgb]))
    assert T.bound(np.array([2, 11, 101])) == pytest.approx([16.4, 57.9, 339.2], rel=0.02)  # chi-squared at 0.99 over 0.4: 6.63, 23.2, 135.8


def test_stream_restarts_deletes_and_late_frames(spark, tmp_path):
    rows, clutter, _ = scene((1, 2), 7, 3)
    points, first = tables(spark, rows, clutter)
    want = {(r.label, r.frame): r for r in T.tracked(points, first).collect()}
    source, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    point = points.selectExpr("'point' AS kind", "CAST(NULL AS long) AS label", "frame", *T.VALUES)
    begin = first.selectExpr("'reference' AS kind", "label", "frame", *T.VALUES)

    def feed(df):
        df.write.mode("append").parquet(source)
        L.start(spark.readStream.schema(L.INPUT).parquet(source), first, out, state).awaitTermination()

    feed(begin.unionByName(point.where("frame < 3")))  # several frames in a batch
    held = {r.label: r for r in L.held(spark, state).collect()}
    assert set(held) == {1, 2} and held[1].frame == 2 and T.LEAST <= held[1].particles <= T.MOST
    assert [r.label for r in L.held(spark, state, 2).collect()] == [2]
    feed(point.where("frame IN (2, 3)"))  # frame 2 comes again, late
    feed(L.deletion(spark, 2, 4).unionByName(point.where("frame = 4")))
    assert [r.label for r in L.held(spark, state).collect()] == [1]
    feed(point.where("frame > 4"))  # a restart each time; the deleted label doesn't come back
    got = {(r.label, r.frame): r for r in spark.read.schema(T.RESULT).parquet(out).collect()}
    assert set(got) == {(k, f) for k, f in want if k == 1 or f < 4}
    assert spark.read.parquet(out).count() == len(got)
    assert held[1].pose == pytest.approx([got[1, 2][p] for p in T.POSE])
    known = scene((1, 2), 7, 3)[2]
    for at, r in got.items():  # batches thin points before they come together, streams after
        assert max(abs(r[p] - want[at][p]) for p in "xyz") < 20
        assert max(abs(v - w) for v, w in zip((r.x, r.y, r.z), known[at], strict=True)) <= 20


def test_parts_among_points_like_theirs_are_found(spark):
    """Parts of one plane of grey points in rows, each with its own step: a shift by a row meets as many points, of the part beside it."""
    r = np.random.default_rng(8)
    rows, known = [], {}
    for k in range(4):
        p = np.array([[40 * i + 200 * k, 40 * j, 900] for i in range(5) for j in range(5)]) + r.uniform(-1, 1, (25, 3))
        rgb, step = r.integers(125, 129, (25, 3)), np.array([(k % 3 - 1) * 5, k % 2 * 4, (k % 5 - 2) * 2])
        for f in range(7):
            known[k, f] = p.mean(0) + step * f
            rows += [(k, f, *map(float, x), *map(float, y)) for x, y in zip(p + step * f, rgb, strict=True)]
    got = {(x.label, x.frame): x for x in T.tracked(*tables(spark, rows, [])).collect()}
    assert set(got) == {(k, f) for k, f in known if f}
    for at, x in got.items():
        assert max(abs(v - w) for v, w in zip((x.x, x.y, x.z), known[at], strict=True)) <= 2
