"""Correspondences between descriptors, rigid transforms and scores."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pointfold.operators import l1
from pointfold.operators.cut import cut
from pointfold.operators.spatial import KEY, radius_pairs
from pointfold.operators.surface import crossed

#: what an error is where there is no inlier: the largest single-precision number
NONE_ERROR = 3.4028234663852886e38


def l1_nearest(queries: DataFrame, targets: DataFrame, k: int, by: tuple[str, ...] = ("label",), block: int = 16_384) -> DataFrame:
    """by, q, rank, t, dist: the k nearest targets by, kp_id, desc of each query, by the summed differences of their descriptors; ties to the smaller t.

    Exact, so every query meets every target of its group; but a task holds one block of either, however large a group is,
    and gives k rows for each query, not pairs. Blocks of a group follow from its size. Within a block see l1.nearest().
    """
    sizes = targets.groupBy(*by).agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    asks = queries.groupBy(*by).agg(F.ceil(F.count("*") / block).cast("int").alias("parts"))
    counts = sizes.join(asks, list(by))
    number = lambda c: F.pmod(F.xxhash64("kp_id"), F.col(c)).cast("int")
    spread = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    left = queries.join(counts, list(by)).withColumn("a", number("parts")).withColumn("b", spread("blocks")).select(*by, "a", "b", "kp_id", "desc")
    right = targets.join(counts, list(by)).withColumn("b", number("blocks")).withColumn("a", spread("parts"))
    right = right.select(*[F.col(x).alias(x) for x in (*by, "a", "b", "kp_id", "desc")])  # perhaps of the same origin
    whole = dict(queries.dtypes)["desc"] == "array<bigint>"

    def best(ask: pd.DataFrame, to: pd.DataFrame) -> pd.DataFrame:
        if not len(ask) or not len(to):
            return pd.DataFrame([], columns=[*by, "q", "t", "dist"])
        to = to.sort_values("kp_id")
        at, dist = l1.nearest(np.stack(ask["desc"]), np.stack(to["desc"]), k)
        out = {"q": np.repeat(ask["kp_id"].to_numpy(), at.shape[1]), "t": to["kp_id"].to_numpy()[at.ravel()], "dist": dist.ravel()}
        return pd.DataFrame({c: ask[c].iloc[0] for c in by} | out)

    kinds = dict(queries.dtypes)
    parts = int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    schema = ", ".join(f"{c} {kinds[c]}" for c in by) + f", q long, t long, dist {'long' if whole else 'double'}"
    # dealt by what is to do, not by bytes
    left, right = (x.repartition(parts, *by, "a", "b") for x in (left, right))
    found = left.groupBy(*by, "a", "b").cogroup(right.groupBy(*by, "a", "b")).applyInPandas(best, schema)
    first = Window.partitionBy(*by, "q").orderBy("dist", "t")
    return found.withColumn("rank", F.row_number().over(first).cast("long")).where(F.col("rank") <= k)


def greedy_ranks(near: DataFrame, k: int, by: tuple[str, ...] = ("label",)) -> DataFrame:
    """by, q, t, dist, rank: rank by rank each unmatched query proposes its neighbour of that rank, and a target takes the nearest proposal (ties to the smaller q). A target may be taken again at a later rank; queries without a match are left out."""
    taken = None
    for rank in range(1, k + 1):
        ask = near.where(F.col("rank") == rank)
        if taken is not None:
            ask = ask.join(taken.select(*by, "q"), [*by, "q"], "left_anti")
        won = ask.groupBy(*by, "t").agg(F.min(F.struct("dist", "q")).alias("m")).select(*by, "m.q", "t", "m.dist", F.lit(rank).cast("long").alias("rank"))
        taken = won if taken is None else taken.unionByName(won)
    return taken


def scores(nearest: DataFrame, threshold: int) -> DataFrame:
    """label, size, inliers, error, score: inliers lie at 0 < dist < threshold; the share of inliers is a whole division."""
    ok = (F.col("dist") > 0) & (F.col("dist") < threshold)
    s = nearest.groupBy("label").agg(F.count("*").alias("size"), F.sum(ok.cast("long")).alias("inliers"), F.sum(F.when(ok, F.col("dist"))).alias("total"))
    s = s.withColumn("error", F.coalesce(F.col("total") / F.col("inliers"), F.lit(NONE_ERROR)))
    return s.select("label", "size", "inliers", "error", (F.expr("inliers div size") + 3 * (threshold - F.col("error")) / threshold).alias("score"))


def hidden_shares(of: DataFrame, by: DataFrame) -> DataFrame:
    """frame, label, share: of each label's places (frame, label and the key of their voxel), those whose line to the camera crosses a voxel of `by` (key). A voxel that several labels ask for is looked at once."""
    there = by.select("frame", *[F.col(f"k{a}").alias(f"o{a}") for a in "xyz"])
    hid = crossed(of.select(*KEY).distinct()).join(there, ["frame", "ox", "oy", "oz"], "left_semi").select(*KEY).distinct().withColumn("hid", F.lit(1.0))
    return of.join(hid, KEY, "left").groupBy("frame", "label").agg(F.avg(F.coalesce("hid", F.lit(0.0))).alias("share"))


#: Rotation in rows, then the shift.
RIGID = [f"r{i}{j}" for i in range(3) for j in range(3)] + ["tx", "ty", "tz"]


def fitted(h: np.ndarray, p: np.ndarray, q: np.ndarray) -> list[float]:
    """The rotation and shift that best move points with mean p and co-moments h to points with mean q."""
    u, _, vt = np.linalg.svd(h)
    rot = vt.T @ np.diag([1, 1, np.sign(np.linalg.det(vt.T @ u.T)) or 1]) @ u.T
    return [*rot.ravel(), *(q - rot @ p)]


def rigid(pairs: DataFrame, *by: str) -> DataFrame:
    """by, r00 to r22, tx, ty, tz that best move x, y, z to o_x, o_y, o_z in the least squares. Sums are combined before the shuffle; only one row for each group meets numpy."""
    sums = [F.sum(c).alias(f"s_{c}") for c in ("x", "y", "z", "o_x", "o_y", "o_z")] + [F.sum(F.col(a) * F.col(f"o_{b}")).alias(f"s_{a}{b}") for a in "xyz" for b in "xyz"]
    g = pairs.groupBy(*by).agg(F.count("*").alias("n"), *sums)

    def solve(batches):
        for batch in batches:
            rows = []
            for r in batch.to_dict("records"):
                p, q = (np.array([r[f"s_{o}{a}"] for a in "xyz"], float) / r["n"] for o in ("", "o_"))
                h = np.array([[r[f"s_{a}{b}"] for b in "xyz"] for a in "xyz"], float) / r["n"] - np.outer(p, q)
                rows.append([*[r[c] for c in by], *fitted(h, p, q)])
            yield pd.DataFrame(rows, columns=[*by, *RIGID])

    return g.mapInPandas(solve, ", ".join(f"{c} long" for c in by) + ", " + ", ".join(f"{n} double" for n in RIGID))


def moved(a: str = "x", b: str = "y", c: str = "z") -> list[Column]:
    """Columns a, b and c moved by RIGID."""
    return [F.col(f"r{i}0") * F.col(a) + F.col(f"r{i}1") * F.col(b) + F.col(f"r{i}2") * F.col(c) + F.col(f"t{'xyz'[i]}") for i in range(3)]


def samples(kps: DataFrame, by: tuple[str, ...], trials: int, size: int, order: Callable[[Column, Column], Column] = lambda kp, i: F.xxhash64(kp, i)) -> DataFrame:
    """by, trial, kp_id: for each group and trial `size` keypoints without replacement, those that come first by order(kp_id, trial)."""
    every = kps.select(*by, "kp_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(trials - 1).cast("long"))).alias("trial"))
    first = Window.partitionBy(*by, "trial").orderBy(order(F.col("kp_id"), F.col("trial")), "kp_id")
    return every.withColumn("i", F.row_number().over(first)).where(F.col("i") <= size).drop("i")


GROUP, TRIAL = ("frame", "label"), ("frame", "label", "trial")


def inliers(places: DataFrame, prev: DataFrame, curr: DataFrame, radius: int, threshold: float) -> DataFrame:
    """TRIAL, t, dist: current keypoints whose voxel is within radius of a trial's place (x, y, z), with the distance to their nearest descriptor of the label's old keypoints, where that is above 0 and below the threshold. A label and a keypoint are compared once, whatever the number of trials."""
    at = curr.select("frame", F.col("kp_id").alias("t"), F.col("vx").alias("x"), F.col("vy").alias("y"), F.col("vz").alias("z"))
    near = radius_pairs(places.select(*TRIAL, *"xyz"), at, radius).select(*TRIAL, F.col("o_t").alias("t"))
    asked = near.select(*GROUP, "t").distinct().join(curr.select("frame", F.col("kp_id").alias("t"), F.col("desc").alias("other")), ["frame", "t"])
    dist = F.aggregate(F.zip_with("desc", "other", lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, x: s + x)
    best = prev.select(*GROUP, "desc").join(asked, list(GROUP)).groupBy(*GROUP, "t").agg(F.min(dist).alias("dist")).where((F.col("dist") > 0) & (F.col("dist") < threshold))
    return near.join(best, [*GROUP, "t"])


def trials(prev: DataFrame, curr: DataFrame, centres: DataFrame, radius: int, n: int = 100, size: int = 3, threshold: float = 100.0, order: Callable[[Column, Column], Column] = lambda kp, i: F.xxhash64(kp, i)) -> tuple[DataFrame, DataFrame]:
    """For each lost label (prev: frame, label, kp_id, vx, vy, vz, desc; centres: frame, label, x, y, z) n trials to find it among the frame's unlabelled keypoints (curr, without label).

    A trial samples `size` old keypoints, matches them by descriptor, fits a transform, and looks for inliers around the
    moved centre. With at least a quarter of the label's keypoints and six, it fits anew to all of them and looks again; if
    there are no fewer then, it has a score. First: TRIAL, score, n, size, RIGID of each such trial; second: TRIAL, t of their inliers.
    """
    here = prev.select(*GROUP, F.col("kp_id").alias("q"), *[F.col(f"v{a}").alias(a) for a in "xyz"])
    there = curr.select("frame", F.col("kp_id").alias("t"), *[F.col(f"v{a}").alias(f"o_{a}") for a in "xyz"])
    sampled = samples(prev, GROUP, n, size, order)
    # the same keypoint of several labels or trials is looked up once
    asked = prev.join(sampled.select(*GROUP, "kp_id").distinct(), [*GROUP, "kp_id"], "left_semi")
    ids = asked.select(*GROUP, "kp_id", F.xxhash64(*GROUP, "kp_id").alias("one"), "desc")
    near = l1_nearest(ids.select("frame", F.col("one").alias("kp_id"), "desc"), curr, size, ("frame",)).withColumnRenamed("q", "one")
    near = near.join(ids.select(*GROUP, F.col("kp_id").alias("q"), "one"), ["frame", "one"]).drop("one")
    near = sampled.withColumnRenamed("kp_id", "q").join(near, [*GROUP, "q"])
    pairs = greedy_ranks(near, size, TRIAL).join(here, [*GROUP, "q"]).join(there, ["frame", "t"])
    enough = prev.groupBy(*GROUP).agg(F.count("*").alias("size"))
    first = rigid(pairs, *TRIAL).join(centres.select(*GROUP, *"xyz"), list(GROUP))
    found = inliers(first.select(*TRIAL, *[m.alias(a) for m, a in zip(moved(), "xyz", strict=True)]), prev, curr, radius, threshold)
    good = found.groupBy(*TRIAL).agg(F.count("*").alias("maybe")).join(enough, list(GROUP)).where("maybe >= size div 4 AND maybe >= 6")
    good = cut(good)
    held = found.join(good.select(*TRIAL), list(TRIAL), "left_semi").join(curr.select("frame", F.col("kp_id").alias("t"), "desc", *[F.col(f"v{a}").alias(f"o_{a}") for a in "xyz"]), ["frame", "t"])
    old = good.select(*TRIAL).join(prev.select(*GROUP, "kp_id", *[F.col(f"v{a}").alias(a) for a in "xyz"], "desc"), list(GROUP))

    def refit(mine: pd.DataFrame, to: pd.DataFrame) -> pd.DataFrame:
        """Inliers and old keypoints of one trial: matched rank by rank, then fitted."""
        if not len(mine) or not len(to):
            return pd.DataFrame([], columns=[*TRIAL, *RIGID])
        mine, to = mine.sort_values("t").reset_index(drop=True), to.sort_values("kp_id").reset_index(drop=True)
        dist = np.abs(np.stack(mine["desc"])[:, None] - np.stack(to["desc"])[None]).sum(2)
        rank = np.argsort(dist, 1, kind="stable")
        left, match = np.ones(len(mine), bool), np.full(len(mine), -1)
        for r in range(min(len(mine), len(to))):
            asks = np.flatnonzero(left)
            goal = rank[asks, r]
            by_distance = asks[np.lexsort((asks, dist[asks, goal]))]
            _, first_of = np.unique(rank[by_distance, r], return_index=True)
            won = by_distance[first_of]
            match[won], left[won] = rank[won, r], False
        p, q = to[["x", "y", "z"]].to_numpy(float)[match[match >= 0]], mine[["o_x", "o_y", "o_z"]].to_numpy(float)[match >= 0]
        h = (p - p.mean(0)).T @ (q - q.mean(0))
        return pd.DataFrame([[*[mine[c].iloc[0] for c in TRIAL], *fitted(h, p.mean(0), q.mean(0))]], columns=[*TRIAL, *RIGID])

    again = held.groupBy(*TRIAL).cogroup(old.groupBy(*TRIAL)).applyInPandas(refit, "frame long, label long, trial long, " + ", ".join(f"{c} double" for c in RIGID))
    again = cut(again.join(centres.select(*GROUP, *"xyz"), list(GROUP)))
    kept = inliers(again.select(*TRIAL, *[m.alias(a) for m, a in zip(moved(), "xyz", strict=True)]), prev, curr, radius, threshold)
    scored = kept.groupBy(*TRIAL).agg(F.count("*").alias("n"), F.avg("dist").alias("error")).join(good, list(TRIAL)).where("n >= maybe")
    score = F.expr("n div size") + 3 * (threshold - F.col("error")) / threshold
    out = again.join(scored, list(TRIAL)).select(*TRIAL, score.alias("score"), "n", "size", *RIGID)
    return out, kept.select(*TRIAL, "t")


def best_trials(scores: DataFrame, by: tuple[str, ...] = GROUP) -> DataFrame:
    """Of each group's trials (by, trial, score and others) the one with the largest score, if above 0; ties to the smaller trial. Combined before rows move."""
    rest = [c for c in scores.columns if c not in by]
    order = F.struct(F.col("score").alias("__s"), (-F.col("trial")).alias("__t"), F.struct(*rest).alias("row"))
    return scores.where("score > 0").groupBy(*by).agg(F.max(order).alias("m")).select(*by, "m.row.*")


def matches(scored: DataFrame, found: DataFrame, lost: DataFrame, hidden: Callable[[DataFrame, DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """From trials() for the lost labels (frame, label): the matches (as best_trials, moving), and frame, label of those to reset.

    A match stands if hidden(best, its inliers) (frame, label, accepted) accepts it and none of its inliers belongs to the match of a smaller
    label, be that accepted or not: a match that isn't accepted has used up its inliers. So labels need no order in time, and no keypoint is used twice.
    """
    best = cut(best_trials(scored))
    used = cut(found.join(best.select(*TRIAL), list(TRIAL), "left_semi"))
    first = used.groupBy("frame", "t").agg(F.min("label").alias("owner"))
    lose = used.join(first, ["frame", "t"]).where("owner < label").select(*GROUP).distinct()
    stand = best.join(hidden(best, used).where("accepted").select(*GROUP), list(GROUP), "left_semi").join(lose, list(GROUP), "left_anti")
    return stand, lost.select(*GROUP).join(stand.select(*GROUP), list(GROUP), "left_anti")
