"""Operator 12: hard negatives by best-first search of R-trees packed by sorting and tiling.

Components become whole numbers floor(256 * x), and a row's score is its inner product with the anchor. Rows are dealt by ranges of
(vector length, first component, a hash of the id), so that copies spread, and each block of at most `rows` of them is packed into a
tree: sorted by label, then by the components that vary most, each time cut into tiles, down to leaves of LEAF
rows, with a minimum bounding box and the range of labels of every node. A box gives an interval for each coordinate's
product and so for the score. An anchor's queue takes the box of the highest possible score first, and drops
boxes that can't meet a label or lie outside all score windows or strictly below the window's k-th best; ties are searched,
as the smaller vec_id wins. First each anchor asks for its k best rows of its own label, then, for the windows that
these positives give, for the best rows of other labels; the best of all blocks are kept.

Result for odd input: rows with a null vec_id, label or vector, an empty vector, or a null or non-finite component take no part, nor
do rows with a component of LARGEST over the root of the vector's length and more, as a hundred times their scores might not fit a long; only vectors of one length are compared;
rows that repeat are rows of their own, found as often as they occur, but an anchor that repeats (same id, label and vector)
gives its rows once, and leaves out one of its copies; rows of the anchor's id with another vector or label are other rows; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pointfold.llm.common import in_batches, partitions, table, written

#: Components beyond this over the root of the length could make scores a hundred times which doesn't fit a long.
LARGEST = 1_100_000.0
#: Rows in a leaf and in a tree; children of a node; nodes taken off the queue at a time.
LEAF, ROWS, FAN, TAKEN = 64, 65_536, 16, 32
LOW, HIGH = -(1 << 63), (1 << 63) - 1


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, label, x (whole numbers) and dim of the rows that can take part."""
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("v"))
    v = v.where("vec_id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL AND size(v) > 0")
    v = v.where(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) >= F.lit(LARGEST) / F.sqrt(F.size("v")))))
    return v.select("vec_id", "label", F.transform("v", lambda x: F.floor(x * 256).cast("long")).alias("x"), F.size("v").alias("dim"))


def tiled(x: np.ndarray, label: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """An order of the rows whose runs of `leaf` are tiles: sorted by label, cut, each piece sorted by the next key, and so on. The keys are the label and the components that vary most."""
    n = len(x)
    spread = np.argsort(-x.astype(float).var(0), kind="stable")
    keys = [label, *(x[:, j] for j in spread[:3])]
    pieces = [np.arange(n)]
    for left, key in zip(range(len(keys), 0, -1), keys, strict=True):
        new = []
        for p in pieces:
            leaves = -(-len(p) // leaf)
            cuts = max(round(leaves ** (1 / left)), 1)
            size = leaf * -(-leaves // cuts)
            p = p[np.argsort(key[p], kind="stable")]
            new += [p[i : i + size] for i in range(0, len(p), size)]
        pieces = new
    return np.concatenate(pieces)


class Tree:
    """Rows in tiled order, and levels of boxes: the lowest over runs of LEAF rows, each other over runs of FAN boxes."""

    def __init__(self, ids: np.ndarray, label: np.ndarray, x: np.ndarray) -> None:
        self.ids, self.label, self.x = ids, label, x.astype(np.int64)
        self.most = int(np.abs(self.x).max())
        self.rows = self.x.astype(float) if self.most**2 * x.shape[1] < 1 << 53 else self.x
        lo, hi, label_lo, label_hi, size = self.rows, self.rows, label, label, LEAF
        self.levels = []
        while True:
            at = np.arange(0, len(lo), size)
            lo, hi = np.minimum.reduceat(lo, at), np.maximum.reduceat(hi, at)
            label_lo, label_hi = np.minimum.reduceat(label_lo, at), np.maximum.reduceat(label_hi, at)
            self.levels.append((lo, hi, label_lo, label_hi))
            if len(lo) == 1:
                break
            size = FAN

    def search(self, q: np.ndarray, label: int, same: bool, windows: list[tuple[int, int]], k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each window of scores the rows and scores of its k best of the label, or of others; ties to the smaller id."""
        # scores in doubles where they are exact
        rows = self.rows if int(np.abs(q).max()) * self.most * len(q) < 1 << 53 else self.x
        q = q.astype(rows.dtype)
        at = [np.zeros(0, np.int64) for _ in windows]
        score = [np.zeros(0, np.int64) for _ in windows]
        least = [lo if lo <= top else HIGH + 1 for lo, top in windows]  # rises to the k-th best score

        def opened(level: int, nodes: np.ndarray) -> None:
            lo, hi, first, last = (c[nodes] for c in self.levels[level])
            fits = (first <= label) & (label <= last) if same else (first != label) | (last != label)
            a, b = lo * q, hi * q
            least_of, most_of = np.minimum(a, b).sum(1).astype(np.int64), np.maximum(a, b).sum(1).astype(np.int64)
            for n, x, y in zip(nodes[fits].tolist(), least_of[fits].tolist(), most_of[fits].tolist(), strict=True):
                if any(y >= at_least and x <= top for at_least, (_, top) in zip(least, windows, strict=True)):
                    heapq.heappush(queue, (-y, level, n, x))

        queue: list[tuple[int, int, int, int]] = []
        opened(len(self.levels) - 1, np.array([0]))
        while queue:
            taken: dict[int, list[int]] = {}
            for _ in range(min(TAKEN, len(queue))):
                y, level, n, x = heapq.heappop(queue)
                if any(-y >= at_least and x <= top for at_least, (_, top) in zip(least, windows, strict=True)):
                    taken.setdefault(level, []).append(n)
            for level, nodes in taken.items():
                size, most = (FAN, len(self.levels[level - 1][0])) if level else (LEAF, len(rows))
                inside = (np.array(nodes)[:, None] * size + np.arange(size)).ravel()
                inside = inside[inside < most]
                if level:
                    opened(level - 1, inside)
                    continue
                inside = inside[(self.label[inside] == label) == same]
                s = (rows[inside] @ q).astype(np.int64)
                for w, (_, top) in enumerate(windows):
                    ok = (s >= least[w]) & (s <= top)
                    if ok.any():
                        i, t = np.concatenate([at[w], inside[ok]]), np.concatenate([score[w], s[ok]])
                        best = np.lexsort((self.ids[i], -t))[:k]
                        at[w], score[w] = i[best], t[best]
                        if len(best) == k:
                            least[w] = max(least[w], int(score[w][-1]))
        return list(zip(at, score, strict=True))


def trees(rows: DataFrame, most: int = ROWS) -> DataFrame:
    """tree, dim, ids, labels, vectors: a row for each tree, in tiled order."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]] = []

        def out() -> pa.RecordBatch:
            dim = held[0][0]
            ids, label, x = (np.concatenate([h[i] for h in held]) for i in (1, 2, 3))
            order = tiled(x, label)
            ids, label, x = ids[order], label[order], x[order]
            small = np.int16 if np.abs(x).max() < 1 << 15 else np.int32
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([small().itemsize], pa.int32()), *(pa.array([c.tobytes()], pa.binary()) for c in (ids, label, x.astype(small)))], names=["dim", "width", "ids", "labels", "vectors"])

        n = 0
        for b in batches:
            dims = b["dim"].to_numpy()
            ids, label, flat = b["vec_id"].to_numpy(), b["label"].to_numpy(), b["x"].flatten().to_numpy()
            begin = np.concatenate([[0], np.cumsum(dims)])
            lo = 0
            while lo < len(dims):
                if held and (held[0][0] != dims[lo] or n >= most):
                    yield out()
                    n = 0
                same = np.flatnonzero(dims[lo:] != dims[lo])
                hi = min(lo + (int(same[0]) if len(same) else len(dims) - lo), lo + most - n)
                held.append((int(dims[lo]), ids[lo:hi], label[lo:hi], flat[begin[lo] : begin[hi]].reshape(hi - lo, -1)))
                n += hi - lo
                lo = hi
        if held:
            yield out()

    n = partitions(rows.sparkSession)
    first = F.col("x")[0]
    dealt = rows.repartitionByRange(n, "dim", first, F.xxhash64("vec_id")).sortWithinPartitions("dim", first)
    packed = in_batches(dealt, pack, "dim int, width int, ids binary, labels binary, vectors binary")
    return packed.withColumn("part", F.spark_partition_id()).withColumn("nth", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1))


def counted(packed: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """The trees with a number, from 0 on and in order of their vectors' length; the first and last number of each length; and how many there are. One row for each partition and each length goes through the driver."""
    spark = packed.sparkSession
    starts, n = [], 0
    for r in packed.groupBy("part").agg(F.count("*").alias("n")).orderBy("part").collect():
        starts.append((r.part, n))
        n += r.n
    trees = packed.join(F.broadcast(spark.createDataFrame(starts, "part int, start long")), "part").withColumn("tree", F.col("start") + F.col("nth")).drop("part", "nth", "start")
    return trees, trees.groupBy("dim").agg(F.min("tree").alias("first"), F.max("tree").alias("last")), n


def searched(packed: DataFrame, asks: DataFrame, same: bool, k: int) -> DataFrame:
    """ask, at (the window's place), vec_id, score, own: of each tree the k best rows for each window of each of asks (ask, vec_id, label, x, dim, windows); own marks a copy of the asking row. Each tree is read by several tasks, for a part of the asks each, if there are fewer trees than tasks."""
    parts = partitions(packed.sparkSession)
    trees, of_length, n = counted(packed)
    splits = max(2 * parts // max(n, 1), 1)
    asked = asks.join(F.broadcast(of_length), "dim").withColumn("tree", F.explode(F.sequence("first", "last"))).drop("first", "last")
    asked = asked.withColumn("split", F.pmod(F.xxhash64("ask", F.lit(5)), F.lit(splits)).cast("int")).withColumn("is_ask", F.lit(True))
    held = trees.withColumn("split", F.explode(F.sequence(F.lit(0), F.lit(splits - 1)))).withColumn("is_ask", F.lit(False))
    rows = held.unionByName(asked, allowMissingColumns=True).repartition(parts, "tree", "split").sortWithinPartitions("tree", "split", "is_ask")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here: Tree | None = None
        for b in batches:
            out: list[list] = [[], [], [], [], []]
            asking, ask, label, own, x, windows = (b[c].to_pylist() for c in ("is_ask", "ask", "label", "vec_id", "x", "windows"))
            for r in range(b.num_rows):
                if not asking[r]:
                    part = lambda c, t: np.frombuffer(b[c][r].as_buffer(), t)  # noqa: B023, E731
                    here = Tree(part("ids", np.int64), part("labels", np.int64), part("vectors", f"i{b['width'][r].as_py()}").reshape(-1, b["dim"][r].as_py()))
                    continue
                q = np.array(x[r], np.int64)
                for w, (at, score) in enumerate(here.search(q, label[r], same, [(w["lo"], w["hi"]) for w in windows[r]], k)):
                    mine = (here.ids[at] == own[r]) & (here.x[at] == q).all(1) & same
                    for c, new in zip(out, ([ask[r]] * len(at), [w] * len(at), here.ids[at].tolist(), score.tolist(), mine.tolist()), strict=True):
                        c += new
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.bool_()), strict=True)], names=["ask", "at", "vec_id", "score", "own"])

    return in_batches(rows, search, "ask long, at int, vec_id long, score long, own boolean")


def ranked(rows: DataFrame, k: int, *by: str | Column) -> DataFrame:
    """Adds rank, of the k best of each group."""
    best = Window.partitionBy(*by).orderBy(F.col("score").desc(), "vec_id")
    return rows.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def mined(vectors: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, rows: int = ROWS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for each of anchors (vec_id, label, embedding) and each of its `positives` best rows of the same label, the `negatives` best rows of other labels with low * positive_score <= 100 * negative_score <= high * positive_score."""
    packed = written(trees(usable(vectors), rows), "trees")
    one = usable(anchors).dropDuplicates(["vec_id", "label", "x"]).withColumn("ask", F.xxhash64("vec_id", "label", "x"))
    every = F.array(F.struct(F.lit(LOW).alias("lo"), F.lit(HIGH).alias("hi")))
    one = written(one, "anchors")
    # one more than asked for, as the anchor itself is among the rows
    found = ranked(searched(packed, one.withColumn("windows", every), True, positives + 1), positives + 1, "ask")
    itself = Window.partitionBy("ask", "own").orderBy("rank")
    found = found.withColumn("nth", F.row_number().over(itself)).where("NOT own OR nth > 1").drop("rank", "nth")
    best = written(ranked(found, positives, "ask").select("ask", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"), (F.col("rank") - 1).alias("at")), "positives")
    floor = "({0} - pmod({0}, 100L)) div 100"  # of whole numbers
    window = F.struct("at", F.expr("-(" + floor.format(f"(-{low} * positive_score)") + ")").alias("lo"), F.expr(floor.format(f"({high} * positive_score)")).alias("hi"))
    asks = one.join(best.groupBy("ask").agg(F.sort_array(F.collect_list(window)).alias("windows")), "ask")
    hits = ranked(searched(packed, asks, False, negatives), negatives, "ask", "at")
    out = hits.join(best, ["ask", "at"]).join(one.select("ask", F.col("vec_id").alias("anchor_id")), "ask")
    return out.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings").select("vec_id", F.expr("IF(vec_id % 7 = 0, (label + 1) % 10, label)").alias("label"), "embedding")
    return mined(v, v.where("vec_id % 100 = 0"))


OP12_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [CAST(floor(256 * CAST(c AS DOUBLE)) AS BIGINT) for c in embedding] AS x
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
), pairs AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, CAST(list_sum([a.x[i] * b.x[i] for i in range(1, len(a.x) + 1)]) AS BIGINT) AS score
  FROM v a, v b WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
), positives AS (
  SELECT anchor_id, other AS positive_id, score AS positive_score FROM pairs WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5
)
SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER best AS INTEGER) AS rank, n.other AS negative_id, p.positive_score, n.score AS negative_score
FROM positives p JOIN pairs n ON n.anchor_id = p.anchor_id AND NOT n.same AND 30 * p.positive_score <= 100 * n.score AND 100 * n.score <= 90 * p.positive_score
WINDOW best AS (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.other)
QUALIFY row_number() OVER best <= 10
"""
