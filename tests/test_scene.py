"""Operators over surfaces, matching and state on small clouds made by hand, against numpy."""

import math
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointfold.jobs import scene
from pointfold.operators import growth, matching, spatial, surface
from pointfold.streaming import voxel_state

SF = "/root/testdata/sf0.001"
STEPS = [(i, j, k) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1) if i or j or k]


def plane(frame=0, z=5, size=8):
    return [(frame, i, j, z) for i in range(size) for j in range(size)]


def cloud(spark, cells):
    """A voxel in the middle of each cell."""
    rows = [(f, i, j, k, i * 40 - 380, j * 40 - 330, k * 40 + 820, 10, 20, 30) for f, i, j, k in cells]
    return spark.createDataFrame(rows, "frame long, kx long, ky long, kz long, x long, y long, z long, r long, g long, b long")


def test_normals_match_eigenvectors(spark):
    v = scene.whole(spark, SF).where("frame = 0")
    got = {(r.kx, r.ky, r.kz): r for r in surface.normals(spatial.two_ring_sums(v, spatial.adjacency(v)), v).collect()}
    at = {(r.kx, r.ky, r.kz): np.array([r.x, r.y, r.z], float) for r in v.collect()}
    assert got.keys() == at.keys()
    near = {k: [n for s in STEPS if (n := tuple(map(sum, zip(k, s, strict=True)))) in at] for k in at}
    for k, p in at.items():
        ring = [k, *near[k], *[m for n in near[k] for m in near[n]]]
        m = np.cov(np.array([at[n] for n in ring]).T, bias=True) if len(ring) > 1 else np.zeros((3, 3))
        values, vectors = np.linalg.eigh(m)
        r = got[k]
        n = np.array([r.nx, r.ny, r.nz])
        if np.trace(m) == 0:
            assert not n.any()
            continue
        assert r.curvature == pytest.approx(max(values[0], 0) / np.trace(m), abs=1e-6)
        if values[1] - values[0] > 1e-3 * values[2]:
            assert abs(n @ vectors[:, 0]) == pytest.approx(1, abs=1e-6)
            assert n @ p <= 1e-6


def test_plane_faces_the_camera(spark):
    v = cloud(spark, plane())
    for r in surface.normals(spatial.two_ring_sums(v, spatial.adjacency(v)), v).collect():
        assert (abs(r.nx), abs(r.ny), r.nz, r.curvature) == pytest.approx((0, 0, -1, 0), abs=1e-6)


def test_nearest_looks_further_only_where_needed(spark):
    v = cloud(spark, [(0, 0, 0, 0), (0, 1, 0, 0), (0, 2, 0, 0), (0, 15, 0, 0)]).withColumn("pid", F.col("kx"))
    got = {(r.pid, r["rank"]): (r.o_pid, r.d2) for r in surface.nearest(v, v, 2, 50, others=True).collect()}
    assert got == {(0, 1): (1, 1600), (0, 2): (2, 6400), (1, 1): (0, 1600), (1, 2): (2, 1600), (2, 1): (1, 1600), (2, 2): (0, 6400), (15, 1): (2, 13 * 13 * 1600), (15, 2): (1, 14 * 14 * 1600)}


def test_occluders(spark):
    # the ray from (10, 9, 8) runs almost along z
    gone = cloud(spark, [(1, 9, 8, 8)]).select(*spatial.KEY)
    block = [(1, i, j, 2) for i in range(5, 12) for j in range(5, 12)]
    seen = cloud(spark, block).select(*spatial.KEY, F.lit(True).alias("is_new"))
    (r,) = surface.occluders(gone, seen).collect()
    assert (r.kx, r.ky, r.kz, r.oz) == (9, 8, 8, 2) and r.distance > 4
    assert not surface.occluders(gone, seen.where("kx < 6")).count()
    near = cloud(spark, [(1, i, j, 7) for i in range(5, 12) for j in range(5, 12)])
    assert surface.occluders(gone, near.select(*spatial.KEY, F.lit(True).alias("is_new"))).count() == 1
    assert surface.occluders(gone, near.select(*spatial.KEY, F.lit(False).alias("is_new"))).count() == 0


def test_growth_fills_a_plane_from_two_seeds(spark):
    v = cloud(spark, plane(size=6) + [(0, 18, 12, 3)]).withColumn("nx", F.lit(0.0)).withColumn("ny", F.lit(0.0)).withColumn("nz", F.lit(-1.0))
    seeds = spark.createDataFrame([(0, 0, 0, 5, 1), (0, 5, 5, 5, 2)], "frame long, kx long, ky long, kz long, label long")
    out = growth.grow(v, spatial.adjacency(v), seeds, 6).collect()
    assert len(out) == 37
    label = {(r.kx, r.ky, r.kz): r.label for r in out}
    assert label.pop((18, 12, 3)) is None
    assert set(label.values()) == {1, 2}
    none = growth.grow(v, spatial.adjacency(v), seeds.where("label > 2"), 2)
    assert none.where("label IS NOT NULL").count() == 0


def test_pruned_seeds_need_enough_voxels(spark):
    v = cloud(spark, plane(size=3) + [(0, 18, 12, 3)])
    got = growth.pruned(v.select(*spatial.KEY, "x", "y", "z"), v, 102, 3).collect()
    assert {(r.kx, r.ky) for r in got} == {(i, j) for i in range(3) for j in range(3)}


def test_seeds_near_an_existing_one_go(spark):
    rows = [(f, i, 0, 0, 40 * i, 0, 0) for f in (0, 1) for i in range(8)]
    v = spark.createDataFrame(rows, "frame int, kx long, ky long, kz long, x long, y long, z long")
    had = v.where("frame = 0 AND kx = 2").select("frame", "x", "y", "z")
    got = {(r.frame, r.kx) for r in growth.pruned(v, v, 102, 2, had).collect()}
    # within 102 of x = 80 in frame 0 are kx 0 to 4
    assert got == {(0, 5), (0, 6), (0, 7)} | {(1, i) for i in range(8)}


def test_greedy_ranks_by_brute_force(spark):
    rng = np.random.default_rng(5)
    d = spark.createDataFrame([(i % 2, i, [int(x) for x in rng.integers(0, 4, 4)]) for i in range(60)], "label long, kp_id long, desc array<long>")
    near = matching.l1_nearest(d.where("kp_id % 4 < 2"), d.where("kp_id % 4 >= 2"), 3, block=4)
    got = {(r.q, r.t, r.dist, r["rank"]) for r in matching.greedy_ranks(near, 3).collect()}
    by = defaultdict(list)
    rows = d.collect()
    for a in rows:
        for b in rows:
            if a.label == b.label and a.kp_id % 4 < 2 <= b.kp_id % 4:
                by[a.kp_id].append((sum(abs(x - y) for x, y in zip(a.desc, b.desc, strict=True)), b.kp_id))
    want, done = set(), set()
    for rank in (1, 2, 3):
        best = {}
        for q in by.keys() - done:
            near = sorted(by[q])
            if len(near) >= rank:
                dist, t = near[rank - 1]
                best[t] = min(best.get(t, (math.inf, 0)), (dist, q))
        for t, (dist, q) in best.items():
            want.add((q, t, dist, rank))
            done.add(q)
    assert got == want


def test_rigid_recovers_a_turn(spark):
    rng = np.random.default_rng(2)
    turn = np.array([[0.36, 0.48, -0.8], [-0.8, 0.6, 0], [0.48, 0.64, 0.6]])
    p = rng.normal(size=(50, 3))
    rows = [(7, *map(float, a), *map(float, turn @ a + [1, 2, 3])) for a in p]
    (r,) = matching.rigid(spark.createDataFrame(rows, "frame long, x double, y double, z double, o_x double, o_y double, o_z double"), "frame").collect()
    assert np.allclose(np.array(r[1:10]).reshape(3, 3), turn) and np.allclose(r[10:], [1, 2, 3])


def test_scores_without_inliers(spark):
    near = spark.createDataFrame([(1, 5), (1, 500), (2, 500), (3, 5)], "label long, dist long")
    got = {r.label: r for r in matching.scores(near, 100).collect()}
    assert (got[1].inliers, got[1].error, got[1].score) == (1, 5, 3 * 95 / 100)
    assert got[3].score == 1 + 3 * 95 / 100
    assert got[2].error == matching.NONE_ERROR and got[2].score < 0


def test_state_keeps_what_is_hidden_and_drops_what_is_gone(spark):
    back = plane(0, 10, 14)
    front = [(1, i, j, 3) for i in range(4, 9) for j in range(4, 9)]
    seen = {k[1:] for k in back} - {(i, j, 10) for i in range(4, 9) for j in range(4, 9)} - {(0, 0, 10)}
    v = cloud(spark, back + front + [(1, *k) for k in sorted(seen)] + [(1, 19, 14, 0)])
    state = {(r.kx, r.ky, r.kz): r for r in voxel_state.fold(spark, v, [0, 1]).collect()}
    assert (0, 0, 10) not in state  # gone, nothing in front
    assert (19, 14, 0) in state  # alone, but new
    hidden = {k for k, r in state.items() if r.occluded_frame == 1}
    assert hidden and hidden <= {(i, j, 10) for i in range(4, 9) for j in range(4, 9)}
    assert all(state[k].seen_frame == 0 for k in hidden)
    r = state[(1, 1, 10)]
    assert (r.first_frame, r.seen_frame, r.prev_x) == (0, 1, r.x)
    assert state[(5, 5, 3)].first_frame == 1 and state[(5, 5, 3)].prev_x is None


def same(got, want):
    return sorted(map(tuple, got.select(want.columns).collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)


def test_stream_equals_fold_with_empty_late_and_repeated_batches(spark, tmp_path):
    points = scene.t.points(spark, SF).where("frame < 6").cache()
    v = spatial.voxels(spatial.crop(points))

    def feed(where):
        points.where(where).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def run():
        stream = spark.readStream.schema(points.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        q = voxel_state.start(stream, str(tmp_path / "out"), str(tmp_path / "ck"))
        q.processAllAvailable()
        q.stop()
        return voxel_state.current(spark, str(tmp_path / "out"))

    assert same(voxel_state.current(spark, str(tmp_path / "out")), spark.createDataFrame([], voxel_state.SCHEMA))
    feed("frame < 2")  # two frames in a batch
    feed("frame < 0")  # none
    feed("frame = 3")  # there is no frame 2
    feed("frame IN (1, 2)")  # late
    assert same(run(), voxel_state.fold(spark, v, [0, 1, 3]))
    feed("frame = 4")
    assert same(run(), voxel_state.fold(spark, v, [0, 1, 3, 4]))
    for name in ("4", ".4.crc"):  # as if it had stopped before the batch was done
        (tmp_path / "ck" / "commits" / name).unlink(missing_ok=True)
    feed("frame = 5")
    assert same(run(), voxel_state.fold(spark, v, [0, 1, 3, 4, 5]))
    assert len(list((tmp_path / "out" / "state").iterdir())) <= 3


def test_change_flags_where_a_patch_tilts(spark):
    flags = [r.changed for r in scene.x5_change_flags(spark, SF).collect()]
    assert 0 < sum(flags) < len(flags)
