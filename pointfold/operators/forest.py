"""Approximate nearest descriptors by a forest of randomised k-d trees, with a bounded number of checks for each query.

Each group's descriptors are one forest, or several of at most SHARD of them. A node splits them at their mean along one of the
dimensions that vary most, drawn at random for each tree. A query goes down all trees at once: what it passes by waits in one queue,
nearest border first, until CHECKS descriptors are compared. So a query's cost doesn't grow with its group where descriptors lie near
shapes. Where they lie anyhow, in many dimensions, any bounded number of checks misses most of the nearest once a group is large. If a
sample of a group's queries finds too few of its nearest, all go through the trees together instead: each meets the leaves whose border
is at most as far away as those were that held the nearest of RECALL of the sample. That is a share of the group.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pointfold.operators import l1

TREES, CHECKS, LEAF, WIDEST, LOOK = 4, 256, 8, 5, 128
#: Descriptors in a forest, and queries that meet it at a time.
SHARD, BLOCK = 65_536, 16_384
#: Share of the sampled queries, SAMPLE at most for each forest and block, that must find all they look for.
RECALL, SAMPLE = 0.95, 512
#: Where queries go through a tree together, a node of so many descriptors is met as a whole.
WHOLE = 64
#: Candidates that may wait to be compared exactly.
HELD = 4_194_304


class Forest:
    """Trees as arrays: dimension and place of each split, the two nodes below; a leaf has dimension -1 and a run of `order`."""

    def __init__(self, points: np.ndarray, trees: int = TREES, seed: int = 0) -> None:
        self.points = points
        self.dim, self.cut, self.low, self.high, self.runs, self.size = [], [], [], [], [], []
        r = np.random.default_rng(seed)
        self.roots = [self._grow(np.arange(len(points)), r) for _ in range(trees)]

    def _node(self, dim: int, cut: float) -> int:
        for column, value in ((self.dim, dim), (self.cut, cut), (self.low, -1), (self.high, -1), (self.runs, None), (self.size, 0)):
            column.append(value)
        return len(self.dim) - 1

    def _grow(self, ids: np.ndarray, r: np.random.Generator) -> int:
        root = self._node(-1, 0.0)
        todo = [(root, ids)]
        while todo:
            node, ids = todo.pop()
            self.size[node] = len(ids)
            some = self.points[ids if len(ids) <= LOOK else r.choice(ids, LOOK, replace=False)]
            spread = some.var(0)
            if len(ids) <= LEAF or not spread.any():
                self.runs[node] = ids
                continue
            dim = int(r.choice(np.argsort(-spread, kind="stable")[: min(WIDEST, np.count_nonzero(spread))]))
            at = float(some[:, dim].mean())
            below = self.points[ids, dim] < at
            if below.all() or not below.any():  # of the looked-at ones some lie on each side, so of all too
                self.runs[node] = ids
                continue
            self.dim[node], self.cut[node] = dim, at
            self.low[node], self.high[node] = self._node(-1, 0.0), self._node(-1, 0.0)
            todo += [(self.low[node], ids[below]), (self.high[node], ids[~below])]
        return root

    def search(self, q: np.ndarray, k: int, checks: int = CHECKS) -> tuple[np.ndarray, np.ndarray]:
        """Places and distances of the k nearest met, nearest first, ties to the smaller place."""
        queue = [(0.0, n, root) for n, root in enumerate(self.roots)]
        heapq.heapify(queue)
        count, seen, met = len(queue), set(), []
        left = max(checks, k)
        kth = np.inf
        while queue and left > 0:
            away, _, node = heapq.heappop(queue)
            if away > kth:
                break
            while self.dim[node] >= 0:
                off = q[self.dim[node]] - self.cut[node]
                near, far = (self.low[node], self.high[node]) if off < 0 else (self.high[node], self.low[node])
                heapq.heappush(queue, (away + abs(off), count, far))
                count += 1
                node = near
            new = [i for i in self.runs[node].tolist() if i not in seen][:left]
            if new:
                seen.update(new)
                left -= len(new)
                d = np.abs(self.points[new] - q).sum(1)
                met = sorted([*met, *zip(d.tolist(), new, strict=True)])[:k]
                kth = met[-1][0] if len(met) == k else np.inf
        return np.array([i for _, i in met], int), np.array([d for d, _ in met])

    def _under(self, node: int) -> np.ndarray:
        """Places of all descriptors below a node."""
        todo, runs = [node], []
        while todo:
            node = todo.pop()
            if self.dim[node] < 0:
                runs.append(self.runs[node])
            else:
                todo += [self.low[node], self.high[node]]
        return np.concatenate(runs)

    def _walk(self, root: int, queries: np.ndarray, reach: float):
        """Places of the descriptors of each node that is met as a whole, with the queries whose border to it is at most reach away and how far that is."""
        todo = [(root, np.arange(len(queries)), np.zeros(len(queries)))]
        while todo:
            node, ask, away = todo.pop()
            if self.dim[node] < 0 or self.size[node] <= WHOLE:
                yield self._under(node), ask, away
                continue
            off = queries[ask, self.dim[node]] - self.cut[node]
            for below, past in ((self.low[node], off), (self.high[node], -off)):
                to = away + np.maximum(past, 0)
                go = to <= reach
                if go.any():
                    todo.append((below, ask[go], to[go]))

    def within(self, queries: np.ndarray, k: int, reach: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Number of the query, place and distance of the k nearest in leaves whose border is at most reach away, nearest first, ties to the smaller place; with an unlimited reach those of all descriptors."""
        k = min(k, len(self.points))
        a, b, slack = l1.grid(queries, self.points)
        columns = np.ascontiguousarray(a.T)
        best = np.full((k, len(queries)), l1.MOST, np.int16)
        met, held = [], 0

        def settled() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            q, t, sums = (np.concatenate(x) for x in zip(*met, strict=True))
            near = sums <= limits(best, slack)[q]
            q, t = q[near], t[near]
            dist = l1.exact(queries, self.points, q, t)
            least = np.full(best.shape, np.inf)
            np.minimum.at(least, (t % k, q), dist)
            near = np.flatnonzero(dist <= least.max(0)[q])
            # several trees may have met the same
            near = near[np.unique(q[near] * len(self.points) + t[near], return_index=True)[1]]
            q, t, dist = q[near], t[near], dist[near]
            at, count = l1.first(q, len(queries), k, t, dist)
            at = at[np.arange(k) < count[:, None]]
            return q[at], t[at], dist[at]

        for root in self.roots if reach < np.inf else self.roots[:1]:
            for ids, ask, _ in self._walk(root, queries, reach):
                part = np.argsort(ids % k, kind="stable")
                ids, ends = ids[part], np.searchsorted(ids[part] % k, np.arange(k + 1))
                width = l1.TILE // len(ids) + 1
                for some in (ask[lo : lo + width] for lo in range(0, len(ask), width)):
                    sums = l1.apart(b[ids], columns.take(some, 1))
                    for j, (lo, hi) in enumerate(zip(ends, ends[1:], strict=False)):
                        if lo < hi:
                            best[j, some] = np.minimum(best[j, some], sums[lo:hi].min(0))
                    # the nearest of each of k parts are k descriptors, so none of the k nearest is farther
                    t, q = l1.within(sums, limits(best[:, some], slack))
                    met.append((some[q], ids[t], sums[t, q]))
                    held += len(q)
                    if held > HELD:
                        q, t, _ = settled()
                        met, held = [(q, t, np.zeros(len(q), np.int16))], 0
        return settled()

    def nearest(self, queries: np.ndarray, k: int, checks: int = CHECKS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Number of the query, place and distance of about the k nearest, after at least `checks` of them (see tuned())."""
        _, reach = tuned(self, queries, k, checks)
        out = [self.within(queries, k, reach)] if reach >= 0 else []
        # too few descriptors lie within reach of some, or checks are enough
        short = np.bincount(out[0][0], minlength=len(queries)) < min(k, len(self.points)) if out else np.ones(len(queries), bool)
        out = [tuple(x[~short[q]] for x in (q, t, dist)) for q, t, dist in out]
        for q in np.flatnonzero(short).tolist():
            t, dist = self.search(queries[q], k, checks)
            out.append((np.full(len(t), q), t, dist))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def limits(best: np.ndarray, slack: int) -> np.ndarray:
    return np.minimum(best.max(0).astype(int) + slack, l1.MOST).astype(np.int16)


def tuned(forest: Forest, queries: np.ndarray, k: int, checks: int) -> tuple[int, float]:
    """checks and -1, if after so many RECALL of a sample of the queries find their k nearest of the forest. Else the descriptors that one of the sample meets on average and how far borders of leaves may be away for that; at most all descriptors, which is exact."""
    if len(forest.points) <= checks:
        return checks, -1.0
    some = queries[np.linspace(0, len(queries) - 1, min(SAMPLE, len(queries))).astype(int)]
    at, dist = l1.nearest(some, forest.points, k)
    least = dist.sum(1) * (1 + 1e-9)
    if np.mean([forest.search(q, k, checks)[1].sum() <= e for q, e in zip(some, least, strict=True)]) >= RECALL:
        return checks, -1.0
    away, met = np.full(at.shape, np.inf), []
    for root in forest.roots:
        where, far, sizes = np.empty(len(forest.points), int), [], []
        for ids, _, to in forest._walk(root, some, np.inf):
            where[ids] = len(far)
            far.append(to)
            sizes.append(len(ids))
        far = np.array(far)
        away = np.minimum(away, far[where[at], np.arange(len(some))[:, None]])
        met.append((far, np.array(sizes)))
    reach = float(np.quantile(away.max(1), RECALL, method="higher"))
    count = int(sum((sizes @ (far <= reach)).mean() for far, sizes in met))
    return (max(count, checks + 1), reach) if count < len(forest.points) else (len(forest.points), np.inf)


def enough(forest: Forest, queries: np.ndarray, k: int, checks: int) -> int:
    """Descriptors that a query is compared with: checks, or more where these find too few of the nearest (see tuned())."""
    return tuned(forest, queries, k, checks)[0]


def forest_nearest(queries: DataFrame, targets: DataFrame, k: int, by: tuple[str, ...] = ("label",), checks: int = CHECKS, trees: int = TREES, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """by, q, rank, t, dist: about the k nearest targets by, kp_id, desc of each query by the summed differences of their descriptors, after at least `checks` of them (see tuned()); ties to the smaller t."""
    sizes = targets.groupBy(*by).agg(F.ceil(F.count("*") / shard).cast("int").alias("shards"))
    asks = queries.groupBy(*by).agg(F.ceil(F.count("*") / block).cast("int").alias("parts"))
    counts = sizes.join(asks, list(by))
    number = lambda c: F.pmod(F.xxhash64("kp_id"), F.col(c)).cast("int")
    spread = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    left = queries.join(counts, list(by)).withColumn("a", number("parts")).withColumn("b", spread("shards")).select(*by, "a", "b", "kp_id", "desc")
    right = targets.join(counts, list(by)).withColumn("b", number("shards")).withColumn("a", spread("parts"))
    right = right.select(*[F.col(x).alias(x) for x in (*by, "a", "b", "kp_id", "desc")])  # perhaps of the same origin

    def best(ask: pd.DataFrame, to: pd.DataFrame) -> pd.DataFrame:
        if not len(ask) or not len(to):
            return pd.DataFrame([], columns=[*by, "q", "t", "dist"])
        to, ask = to.sort_values("kp_id"), ask.sort_values("kp_id")
        points = np.stack(to["desc"]).astype(float)
        kept = l1.firsts(points, k)
        q, t, dist = Forest(points[kept], trees).nearest(np.stack(ask["desc"]).astype(float), k, checks)
        return pd.DataFrame({c: ask[c].iloc[0] for c in by} | {"q": ask["kp_id"].to_numpy()[q], "t": to["kp_id"].to_numpy()[kept][t], "dist": dist})

    kinds = dict(queries.dtypes)
    parts = int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    schema = ", ".join(f"{c} {kinds[c]}" for c in by) + ", q long, t long, dist double"
    # dealt by what is to do, not by bytes
    left, right = (x.repartition(parts, *by, "a", "b") for x in (left, right))
    found = left.groupBy(*by, "a", "b").cogroup(right.groupBy(*by, "a", "b")).applyInPandas(best, schema)
    first = Window.partitionBy(*by, "q").orderBy("dist", "t")
    return found.withColumn("rank", F.row_number().over(first).cast("long")).where(F.col("rank") <= k)
