import numpy as np
import pyarrow.parquet as pq
import pytest

from pointfold.llm.vector_graph import MOST, SHARDS, build, cosine, nearest, op6_vector_graph, shard_count


def brute(ids, x, queries, k):
    out = {}
    for i, q in queries:
        s = cosine(x, q[None])
        out[i] = sorted((-v, j) for v, j in zip(s, ids, strict=True) if j != i)[:k]
    return out


def test_recall_of_the_query(spark):
    rows = pq.read_table("/root/testdata/sf0.1/embeddings.parquet").to_pylist()
    ids = [r["vec_id"] for r in rows]
    x = np.array([r["embedding"] for r in rows], float)
    want = brute(ids, x, [(i, v) for i, v in zip(ids, x, strict=True) if i % 50 == 0], 5)
    got: dict = {}
    for r in op6_vector_graph(spark, "/root/testdata/sf0.1").collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
        assert r.score == pytest.approx(cosine(x[ids.index(r.vec_id)], x[ids.index(r.query_id)]), abs=1e-12)
    assert set(got) == set(want)
    hits = sum(len({v for v, _ in got[i].values()} & {j for _, j in w}) for i, w in want.items())
    assert hits / sum(map(len, want.values())) >= 0.95


def test_recall_over_several_shards(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = df.collect()
    ids, x = [r.vec_id for r in rows], np.array([r.embedding for r in rows], float)
    want = brute(ids, x, [(i, v) for i, v in zip(ids, x, strict=True) if i % 50 == 0], 5)
    got: dict = {}
    for r in nearest(df, df.where("vec_id % 50 = 0"), shard=200).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    assert shard_count(len(ids), 200) == 10
    assert sum(len(got[i] & {j for _, j in w}) for i, w in want.items()) / sum(map(len, want.values())) >= 0.9


def test_shards_grow_with_the_table():
    assert shard_count(1) == 1
    assert shard_count(SHARDS * MOST) == shard_count(10**6) == SHARDS
    assert shard_count(10 * SHARDS * MOST) == 10 * SHARDS


def test_an_id_with_two_vectors(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (0, [0.0, 1.0]), (0, [0.0, 1.0]), (1, [1.0, 0.1]), (2, [0.1, 1.0]), (2, [0.1, 1.0]), (3, [1.0, 1.0])], "vec_id long, embedding array<double>")
    got = sorted((r.rank, r.vec_id) for r in nearest(df, df.where("vec_id = 0"), k=3).collect())
    assert got == [(1, 1), (1, 2), (2, 3), (2, 3), (3, 1), (3, 2)]


def test_several_shards_copies_and_odd_vectors(spark):
    r = np.random.default_rng(1)
    x = r.normal(size=(600, 8)).astype(np.float32)
    x[100:300] = x[100]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    odd = [(1000, None), (1001, []), (1002, [0.0] * 8), (1003, [float("nan")] * 8), (1004, [1.0, None] * 4), (1005, [1.0, 2.0]), (1006, [2.0, 4.1]), (None, [1.0] * 8), (1007, [float("inf")] * 8), (1008, [1e30] * 8)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>").repartition(3)
    q = df.where("vec_id % 50 = 0 OR vec_id > 999")
    got: dict = {}
    for g in nearest(df, q, shard=150, block=7).collect():
        got.setdefault(g.query_id, []).append((g.rank, g.vec_id))
    assert sorted(got[100]) == [(1, 101), (2, 102), (3, 103), (4, 104), (5, 105)]
    assert sorted(got[150]) == [(1, 100), (2, 101), (3, 102), (4, 103), (5, 104)]
    assert got[1005] == [(1, 1006)]
    assert {1000, 1001, 1002, 1003, 1004, 1007}.isdisjoint(got)
    assert len(got[1008]) == 5
    ids = [*range(600), 1008]
    full = np.concatenate([x.astype(float), np.full((1, 8), 1e30)])
    want = brute(ids, full, [(i, full[ids.index(i)]) for i in ids if i % 50 == 0], 5)
    hits = sum(len({v for _, v in got[i]} & {j for _, j in w}) for i, w in want.items())
    assert hits / (5 * len(want)) > 0.95
    assert nearest(df.limit(0), q.limit(0)).count() == 0


def test_graph_is_bounded():
    x = np.random.default_rng(0).normal(size=(700, 16)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    graph, _ = build(x)
    assert graph.shape == (700, 24)
    assert (graph != np.arange(700)[:, None]).all()
