"""Operator 6: nearest neighbours by a robust-pruned directed graph over each shard of the vectors.

Vectors are dealt into shards by a hash of their ids. A shard's graph starts with random edges; twice, each vector's
greedy search from the centre proposes neighbours, and of these the nearest stay that aren't much closer to one
already kept than to the vector (relaxed by `alpha`), and edges back are pruned alike. Queries stream through every
shard, which is sent once, each by beam search, and the best of all shards are kept. Equal vectors are one node with all
their ids. Shards grow with the table up to MOST vectors, so that up to SHARDS * MOST vectors a query meets a bounded
number of shards; beyond, that number grows.

Result for odd input: vectors that are null, empty, zero or hold null or non-finite numbers take no part; vectors are only
compared with those of equal length; a vec_id that repeats is found for each of its different vectors, none of which is
a candidate for the others, and null ids take no part; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pointfold.llm.common import in_batches, partitions, table, written

#: Vectors in a shard, on average: at least SHARD, at most MOST, and between them as many as give SHARDS shards.
SHARD, MOST, SHARDS = 4096, 131_072, 64
#: Queries that step together.
BLOCK = 512
EDGES, BEAM, SEARCH_BEAM, ALPHA = 24, 40, 64, 1.2


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Between unit vectors, last axes."""
    return np.sqrt(np.maximum(2 - 2 * np.einsum("...d,...d->...", a, b), 0))


def beam_search(x: np.ndarray, graph: np.ndarray, start: int, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """For each query the `beam` nearest nodes met (ids, -1 for none; and distances), walking the graph from start; all queries step together."""
    b, n = len(q), len(x)
    seen = np.zeros((b, n + 1), bool)  # the last column is for -1
    ids = np.full((b, beam), -1)
    dist = np.full((b, beam), np.inf, np.float32)
    open_ = np.zeros((b, beam), bool)
    ids[:, 0], dist[:, 0], open_[:, 0] = start, distances(q, x[start][None]), True
    seen[:, start] = True
    live = np.arange(b)
    while len(live):
        rank = np.where(open_[live], dist[live], np.inf)
        best = rank.argmin(1)
        live, best = live[(ok := np.isfinite(rank[np.arange(len(live)), best]))], best[ok]
        if not len(live):
            break
        open_[live, best] = False
        near = graph[ids[live, best]]
        new = (near >= 0) & ~seen[live[:, None], near]
        seen[live[:, None], near] = True
        d = distances(q[live][:, None], x[near])
        d[~new] = np.inf
        all_d = np.concatenate([dist[live], d], 1)
        all_i = np.concatenate([ids[live], np.where(new, near, -1)], 1)
        all_o = np.concatenate([open_[live], new], 1)
        keep = np.argpartition(all_d, beam - 1, 1)[:, :beam]
        rows = np.arange(len(live))[:, None]
        dist[live], ids[live], open_[live] = all_d[rows, keep], all_i[rows, keep], all_o[rows, keep]
    order = np.argsort(dist, 1, kind="stable")
    rows = np.arange(b)[:, None]
    return ids[rows, order], dist[rows, order]


def pruned(x: np.ndarray, points: np.ndarray, cand: np.ndarray, edges: int, alpha: float) -> np.ndarray:
    """Of each point's candidates (-1 for none) at most `edges`, near and diverse."""
    out = np.full((len(points), edges), -1)
    for lo in range(0, len(points), 128):
        p, c = points[lo : lo + 128], np.sort(cand[lo : lo + 128], 1)
        c[:, 1:][c[:, 1:] == c[:, :-1]] = -1
        d = distances(x[p][:, None], x[c])
        d[(c < 0) | (c == p[:, None])] = np.inf
        v = x[c]
        between = np.sqrt(np.maximum(2 - 2 * (v @ v.transpose(0, 2, 1)), 0))
        rows = np.arange(len(p))
        for r in range(edges):
            k = d.argmin(1)
            ok = np.isfinite(d[rows, k])
            if not ok.any():
                break
            out[lo + rows[ok], r] = c[rows[ok], k[ok]]
            d[alpha * between[rows, k] <= d] = np.inf
            d[rows, k] = np.inf
    return out


def build(x: np.ndarray, edges: int = EDGES, beam: int = BEAM, alpha: float = ALPHA, seed: int = 0) -> tuple[np.ndarray, int]:
    """Graph (rows of neighbours, -1 for none) and start node, of unit vectors."""
    n, r = len(x), np.random.default_rng(seed)
    start = int((x @ x.mean(0)).argmax())
    if n <= edges + 1:
        full = np.tile(np.arange(n), (n, 1))
        return np.where(full == np.arange(n)[:, None], -1, full), start
    graph = r.integers(0, n, (n, edges))
    for a in (1.0, alpha):
        order = r.permutation(n)
        for lo in range(0, n, 512):
            p = order[lo : lo + 512]
            met, _ = beam_search(x, graph, start, x[p], beam)
            graph[p] = pruned(x, p, np.concatenate([met, graph[p]], 1), edges, a)
            # edges back
            to, by = graph[p].ravel(), np.repeat(p, edges)
            to, by = to[to >= 0], by[to >= 0]
            sort = np.argsort(to, kind="stable")
            to, by = to[sort], by[sort]
            heads, first, count = np.unique(to, return_index=True, return_counts=True)
            wide = int(count.max())
            back = np.full((len(heads), wide), -1)
            slot = np.arange(len(to)) - np.repeat(first, count)
            back[np.repeat(np.arange(len(heads)), count), slot] = by
            graph[heads] = pruned(x, heads, np.concatenate([graph[heads], back], 1), edges, a)
    return graph, start


def usable(vectors: DataFrame) -> DataFrame:
    v = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("v")).where("vec_id IS NOT NULL AND v IS NOT NULL AND size(v) > 0")
    good = ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0)
    return v.where(good).withColumn("dim", F.size("v"))


def index(vectors: DataFrame, shards: dict[int, int]) -> DataFrame:
    """A row for each shard: dim, shard, vectors (distinct, as doubles), ids, owners (the node of each id), graph, start."""
    count = F.create_map(*[F.lit(x) for kv in shards.items() for x in kv]) if shards else F.create_map(F.lit(0), F.lit(1))
    dealt = vectors.withColumn("shard", F.pmod(F.xxhash64("vec_id"), count[F.col("dim")]).cast("int"))

    def make(pdf: pd.DataFrame) -> pd.DataFrame:
        v = np.stack(pdf["v"].to_numpy()).astype(np.float64) + 0.0
        nodes, owner = np.unique(v, axis=0, return_inverse=True)
        unit = unit_rows(nodes)
        graph, start = build(unit)
        ids = pdf["vec_id"].to_numpy(np.int64)
        pairs = np.unique(np.stack([owner.ravel(), ids], 1), axis=0)
        return pd.DataFrame({"dim": [pdf["dim"].iloc[0]], "shard": [pdf["shard"].iloc[0]], "vectors": [nodes.tobytes()], "ids": [pairs[:, 1].tobytes()], "owners": [pairs[:, 0].astype(np.int64).tobytes()], "graph": [graph.astype(np.int32).tobytes()], "start": [start]})

    return dealt.groupBy("dim", "shard").applyInPandas(make, "dim int, shard int, vectors binary, ids binary, owners binary, graph binary, start int")


def unit_rows(v: np.ndarray) -> np.ndarray:
    top = np.abs(v).max(1, keepdims=True)
    v = v / top
    return (v / np.sqrt((v * v).sum(1, keepdims=True))).astype(np.float32)


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """In double precision; scaled first, so that large numbers don't overflow."""
    a, b = a / np.abs(a).max(-1, keepdims=True), b / np.abs(b).max(-1, keepdims=True)
    return (a * b).sum(-1) / np.sqrt((a * a).sum(-1) * (b * b).sum(-1))


def searched(nodes: np.ndarray, ids: np.ndarray, owners: np.ndarray, graph: np.ndarray, start: int, qid: np.ndarray, q: np.ndarray, k: int) -> tuple[list, list, list]:
    """Number of the query, vec_id and score of the k best of this shard for each query, its own id left out."""
    met, _ = beam_search(unit_rows(nodes), graph, start, unit_rows(q), min(SEARCH_BEAM, len(nodes)))
    met = met[:, : 3 * k]
    score = np.where(met >= 0, cosine(nodes[met], q[:, None]), -np.inf)
    begin, end = np.searchsorted(owners, np.arange(len(nodes))), np.searchsorted(owners, np.arange(len(nodes)), side="right")
    a, b, c = [], [], []
    for i, own in enumerate(qid.tolist()):
        found = []
        for node, s in zip(met[i].tolist(), score[i].tolist(), strict=True):
            if node >= 0:
                found += [(-s, v) for v in ids[begin[node] : min(end[node], begin[node] + k + 1)].tolist() if v != own]
        for s, v in sorted(found)[:k]:
            a.append(i)
            b.append(v)
            c.append(-s)
    return a, b, c


def shard_count(n: int, least: int = SHARD, most: int = MOST) -> int:
    """Shards of n vectors."""
    return -(-n // min(max(least, n // SHARDS), most))


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found for each of queries (vec_id, embedding)."""
    parts = partitions(vectors.sparkSession)
    v = usable(vectors)
    q = usable(queries).withColumn("qkey", F.xxhash64("v")).dropDuplicates(["vec_id", "qkey"])
    # one number for each vector length
    shards = {r.dim: shard_count(r.n, shard) for r in v.groupBy("dim").agg(F.count("*").alias("n")).collect()}
    graphs = written(index(v, shards), "graphs")
    number = F.create_map(*[F.lit(x) for kv in shards.items() for x in kv]) if shards else F.create_map(F.lit(0), F.lit(1))
    # where shards are fewer than tasks, each is sent to several, for a part of the queries
    splits = max(2 * parts // max(sum(shards.values()), 1), 1)
    every = F.sequence(F.lit(0), number[F.col("dim")] - 1)
    asked = q.where(number[F.col("dim")].isNotNull()).withColumn("split", F.pmod(F.xxhash64("vec_id", F.lit(3)), F.lit(splits)).cast("int")).withColumn("shard", F.explode(every))
    held = graphs.withColumn("split", F.explode(F.sequence(F.lit(0), F.lit(splits - 1))))
    rows = held.withColumn("is_query", F.lit(False)).unionByName(asked.withColumn("is_query", F.lit(True)), allowMissingColumns=True)
    rows = rows.repartition(parts, "dim", "shard", "split").sortWithinPartitions("dim", "shard", "split", "is_query")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, of = (), None
        for b in batches:
            asks = np.array(b["is_query"].to_pylist(), bool)
            place = list(zip(b["dim"].to_pylist(), b["shard"].to_pylist(), b["split"].to_pylist(), asks.tolist(), strict=True))
            lo = 0
            while lo < b.num_rows:
                if not asks[lo]:
                    as_array = lambda c, t: np.frombuffer(b[c][lo].as_buffer(), t)  # noqa: B023, E731
                    nodes = as_array("vectors", np.float64).reshape(-1, place[lo][0])
                    here = (nodes, as_array("ids", np.int64), as_array("owners", np.int64), as_array("graph", np.int32).reshape(len(nodes), -1), b["start"][lo].as_py())
                    of = place[lo][:3]
                    lo += 1
                    continue
                if of != place[lo][:3]:  # a shard without vectors
                    lo += 1
                    continue
                hi = lo
                while hi < min(b.num_rows, lo + block) and place[hi] == place[lo]:
                    hi += 1
                some = b.slice(lo, hi - lo)
                qid, key = (np.array(some[c].to_pylist(), np.int64) for c in ("vec_id", "qkey"))
                asking = some["v"].flatten().to_numpy(zero_copy_only=False).reshape(hi - lo, -1)
                at, found, score = searched(*here, qid, asking, k)
                yield pa.RecordBatch.from_arrays([pa.array(qid[at]), pa.array(key[at]), pa.array(found, pa.int64()), pa.array(score, pa.float64())], names=["query_id", "qkey", "vec_id", "score"])
                lo = hi

    found = in_batches(rows, search, "query_id long, qkey long, vec_id long, score double")
    best = Window.partitionBy("query_id", "qkey").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op6_vector_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings")
    return nearest(v, v.where("vec_id % 50 = 0"))
