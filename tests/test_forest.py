"""The forest of k-d trees against the exact search."""

import numpy as np
import pytest

from pointfold.operators import forest, matching


def test_every_descriptor_is_in_each_tree_once():
    r = np.random.default_rng(0)
    points = np.concatenate([r.normal(size=(500, 6)), np.ones((60, 6))])
    f = forest.Forest(points)
    for root in f.roots:
        todo, leaves = [root], []
        while todo:
            n = todo.pop()
            if f.dim[n] < 0:
                leaves += f.runs[n].tolist()
            else:
                todo += [f.low[n], f.high[n]]
        assert sorted(leaves) == list(range(560))


def test_checks_are_bounded_and_all_of_them_are_exact():
    r = np.random.default_rng(1)
    points = r.integers(0, 50, (400, 5)).astype(float)
    f = forest.Forest(points)
    for q in r.integers(0, 50, (40, 5)).astype(float):
        d = np.abs(points - q).sum(1)
        at, dist = f.search(q, 3, 10_000)
        assert at.tolist() == np.lexsort((np.arange(400), d))[:3].tolist() and dist.tolist() == np.sort(d)[:3].tolist()

    class Counting(np.ndarray):
        def __getitem__(self, at):
            out = np.asarray(super().__getitem__(at))
            if isinstance(at, list):
                seen.append(len(at))
            return out

    big = r.normal(size=(20_000, 12))
    f = forest.Forest(big)
    f.points = big.view(Counting)
    for q in big[:20] + 0.01:
        seen = []
        f.search(q, 5, 100)
        assert sum(seen) <= 100


@pytest.mark.parametrize("shard", [65_536, 700])
def test_recall_over_large_labels(spark, shard):
    """2,000 descriptors a label that lie near a few shapes, 256 checks."""
    r = np.random.default_rng(2)
    shapes = r.integers(0, 3000, (3, 36))
    rows = [(label, i * 3 + label, (shapes[label] + r.normal(0, 1, 5) @ r.integers(-300, 300, (5, 36)) * 0 + np.outer(r.normal(0, 300, 1), np.ones(36))[0] + r.normal(0, 60, 36)).astype(int).tolist()) for label in range(3) for i in range(2_000)]
    df = spark.createDataFrame(rows, "label long, kp_id long, desc array<long>")
    asks = df.where("kp_id % 40 < 3")
    got = {(x.label, x.q): x.dist for x in forest.forest_nearest(asks, df, 2, shard=shard).where("rank = 2").collect()}
    want = {(x.label, x.q): x.dist for x in matching.l1_nearest(asks, df, 2).where("rank = 2").collect()}
    assert set(got) == set(want)
    assert sum(got[k] == want[k] for k in want) / len(want) >= 0.9


def test_no_rows_and_small_groups(spark):
    df = spark.createDataFrame([(1, 1, [1, 2]), (1, 2, [1, 4]), (2, 3, [0, 0])], "label long, kp_id long, desc array<long>")
    got = sorted((x.label, x.q, x["rank"], x.t, x.dist) for x in forest.forest_nearest(df, df, 3).collect())
    assert got == [(1, 1, 1, 1, 0.0), (1, 1, 2, 2, 2.0), (1, 2, 1, 2, 0.0), (1, 2, 2, 1, 2.0), (2, 3, 1, 3, 0.0)]
    assert forest.forest_nearest(df.limit(0), df, 3).count() == forest.forest_nearest(df, df.limit(0), 3).count() == 0


@pytest.mark.parametrize("shard", [65_536, 1_000])
def test_recall_where_descriptors_lie_anyhow(spark, shard):
    """2,000 descriptors a label without shapes: 256 checks find too few of the nearest."""
    r = np.random.default_rng(3)
    rows = [(label, i * 2 + label, r.integers(-1000, 1000, 36).tolist()) for label in range(2) for i in range(2_000)]
    df = spark.createDataFrame(rows, "label long, kp_id long, desc array<long>")
    asks = df.where("kp_id % 20 < 2")
    got = {(x.label, x.q): x.dist for x in forest.forest_nearest(asks, df, 2, shard=shard).where("rank = 2").collect()}
    want = {(x.label, x.q): x.dist for x in matching.l1_nearest(asks, df, 2).where("rank = 2").collect()}
    assert sum(got[k] == want[k] for k in want) / len(want) >= 0.9


def test_checks_grow_only_where_they_must():
    r = np.random.default_rng(4)
    loose, close = r.normal(size=(2_000, 36)), np.repeat(r.normal(size=(500, 36)), 4, 0) + r.normal(0, 1e-4, (2_000, 36))
    assert 256 < forest.enough(forest.Forest(loose), loose, 2, 256) <= 2_000
    assert forest.enough(forest.Forest(close), close, 2, 256) == 256
