"""Pose of a labelled part from frame to frame, by a particle filter for each label.

A part's reference points are kept about their centre. A particle is a pose (x, y, z, roll, pitch, yaw). For each frame particles are
drawn anew by weight and moved at random, as many as bound the error of their spread over cells of poses; each is weighed by how well the
reference points, placed at the pose, meet points of the frame. Where the frame has points like those of the part beside it, the weighted
mean lies between them; so the mean, the last pose and the heaviest particles are each laid onto the points they meet, and the best of them,
by fit and by how far a step goes, is the label's pose. Random numbers are hashes of label, frame and place, so reruns and restarts agree. Points go to the labels in whose reach they are by an equi-join on cells; a
label and frame are one group, thinned to a point for each cell of GRID, so its size is bounded by the reach.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Particles at least and at most; the bound of the error and how surely it holds; cells of poses (millimetres, radians).
LEAST, MOST, EPSILON, DELTA, BIN = 600, 1000, 0.2, 0.99, (100.0, 100.0, 100.0, 0.1, 0.1, 0.1)
#: Deviations of a step and of the start; share of particles that also repeat the last motion; sharpness of weights.
STEP, START, MOTION, SHARP = (15.0, 15.0, 15.0, 0.095, 0.095, 0.095), (3.2, 3.2, 3.2, 0.0032, 0.0032, 0.0032), 0.25, 15.0
#: Points match up to DISTANCE apart; one point of a frame for each cell of GRID; a label may move by REACH beyond its reference.
DISTANCE, GRID, REACH = 10.0, 10, 100
#: Heaviest particles that are laid onto points, and the cells, half as wide as points may be off, in which each round finds them.
HEAVIEST, SIDES = 16, (10.0, 10.0, 10.0, 5.0, 5.0, 5.0)
#: Coherence of points of unlike labels.
UNLIKE = 0.1
POSE = ["x", "y", "z", "roll", "pitch", "yaw"]
_M1, _M2, _GOLD = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def uniforms(n: int, *key: int) -> np.ndarray:
    """n numbers in (0, 1) from a hash of the key and their places."""
    h = np.zeros(1, np.uint64)
    for part in (*[np.array([k & (2**64 - 1)], np.uint64) for k in key], np.arange(n, dtype=np.uint64)):
        h = (h ^ part) + _GOLD
        h = (h ^ (h >> np.uint64(30))) * _M1
        h = (h ^ (h >> np.uint64(27))) * _M2
        h = h ^ (h >> np.uint64(31))
    return ((h >> np.uint64(11)).astype(float) + 0.5) / float(1 << 53)


def gaussians(n: int, *key: int) -> np.ndarray:
    """(n, 6) normal deviates."""
    u, v = uniforms(6 * n, *key, 1), uniforms(6 * n, *key, 2)
    return (np.sqrt(-2 * np.log(u)) * np.cos(2 * np.pi * v)).reshape(n, 6)


def bound(k: np.ndarray, epsilon: float = EPSILON, delta: float = DELTA) -> np.ndarray:
    """Particles needed for k occupied cells of poses: a quantile of the chi-squared distribution with k - 1 degrees of freedom, over 2 * epsilon."""
    f = np.maximum(k - 1.0, 1.0)
    return f / (2 * epsilon) * (1 - 2 / (9 * f) + np.sqrt(2 / (9 * f)) * NormalDist().inv_cdf(delta)) ** 3


def hue(rgb: np.ndarray) -> np.ndarray:
    """Hue, saturation and value, each from 0 to 1, of colours from 0 to 255."""
    r, g, b = rgb[..., 0], rgb[..., 1], rgb[..., 2]
    top, low = rgb.max(-1), rgb.min(-1)
    d = np.where(top > low, top - low, 1.0)
    h = np.where(top == low, 0.0, np.where(top == r, (g - b) / d % 6, np.where(top == g, (b - r) / d + 2, (r - g) / d + 4))) / 6
    return np.stack([h, np.where(top > 0, (top - low) / np.where(top > 0, top, 1.0), 0.0), top / 255], -1)


def hsv(r: Column, g: Column, b: Column) -> list[Column]:
    """As hue(), for columns."""
    top, low = F.greatest(r, g, b).cast("double"), F.least(r, g, b).cast("double")
    d = top - low
    turn = (g - b) / d
    h = F.when(d == 0, 0.0).when(top == r, F.when(turn < 0, turn + 6).otherwise(turn)).when(top == g, (b - r) / d + 2).otherwise((r - g) / d + 4) / 6
    return [h, F.when(top > 0, d / top).otherwise(0.0), top / 255]


def coherence(d2: Column, one: list[Column], other: list[Column], same_label: Column | None = None, distance: float = DISTANCE) -> Column:
    """How well two points match, at most 1: by distance (d2 squared), by colour (hue goes round, value doesn't count) and, if given, by label."""
    turn = F.abs(one[0] - other[0])
    turn = F.least(turn, 1 - turn)
    color = 1 / (1 + turn * turn + (one[1] - other[1]) * (one[1] - other[1]))
    return 1 / (1 + d2 / (distance * distance)) * color * (F.when(same_label, 1.0).otherwise(UNLIKE) if same_label is not None else F.lit(1.0))


@dataclass
class Tracker:
    """A label's state. reference: points about their centre with hue, saturation and value; pose and motion: of the part; particles and weights: as of its last frame."""

    label: int
    reference: np.ndarray
    pose: np.ndarray
    motion: np.ndarray
    particles: np.ndarray
    weights: np.ndarray
    frame: int

    @staticmethod
    def begin(label: int, points: np.ndarray, frame: int, least: int = LEAST) -> Tracker:
        """points: x, y, z, r, g, b."""
        points = thinned(points, 2 * GRID)
        pose = np.concatenate([points[:, :3].mean(0), np.zeros(3)])
        reference = np.concatenate([points[:, :3] - pose[:3], hue(points[:, 3:])], 1)
        particles = pose + gaussians(least, label, frame, 0) * START
        return Tracker(label, reference, pose, np.zeros(6), particles, np.full(least, 1 / least), frame)

    def drawn(self, least: int, most: int) -> np.ndarray:
        """Particles for the next frame: the pose itself, then others by weight and moved at random, until their number bounds the error."""
        parent = np.searchsorted(np.cumsum(self.weights)[:-1], uniforms(most, self.label, self.frame, 3))
        out = self.particles[parent] + gaussians(most, self.label, self.frame, 4) * STEP
        out += np.where(uniforms(most, self.label, self.frame, 5) < MOTION, 1.0, 0.0)[:, None] * self.motion
        out[0] = self.pose
        _, first = np.unique(np.floor(out / BIN), axis=0, return_index=True)
        fresh = np.zeros(most, int)
        fresh[first] = 1
        enough = np.flatnonzero((np.arange(1, most + 1) >= bound(np.cumsum(fresh))) & (np.cumsum(fresh) > 1))
        return out[: max(least, int(enough[0]) + 1 if len(enough) else most)]

    def step(self, cloud: np.ndarray, frame: int, least: int = LEAST, most: int = MOST) -> Tracker:
        """After a frame's points (x, y, z, r, g, b) near the label; as it was without points."""
        if not len(cloud):
            return Tracker(self.label, self.reference, self.pose, self.motion, self.particles, self.weights, frame)
        particles = self.drawn(least, most)
        fit = matched(self.reference, particles, cloud)
        spread = fit.max() - fit.min()
        weights = np.exp(SHARP * ((fit - fit.max()) / spread)) if spread > 0 else np.ones(len(fit))
        weights /= weights.sum()
        pose = (particles * weights[:, None]).sum(0)
        return Tracker(self.label, self.reference, pose, pose - self.pose, particles, weights, frame)

    def follow(self, cloud: np.ndarray, frame: int) -> Tracker:
        """A step whose pose is not the mean, which may lie between places that look alike, but the likeliest place: weighed as particles are, and by the distance that a step, with the last motion or without, goes."""
        t = self.step(cloud, frame)
        if not len(cloud):
            return t
        starts = np.concatenate([np.stack([t.pose, self.pose, self.pose + self.motion]), t.particles[np.argsort(-t.weights, kind="stable")[:HEAVIEST]]])
        poses = np.concatenate([starts, laid(self.reference, starts, cloud)])
        apart = np.min([(((poses - at) / STEP) ** 2).sum(1) for at in (self.pose, self.pose + self.motion)], 0)
        pose = poses[(SHARP * matched(self.reference, poses, cloud) / len(self.reference) - apart / 2).argmax()]
        return Tracker(t.label, t.reference, pose, pose - self.pose, t.particles, t.weights, frame)


def thinned(points: np.ndarray, grid: float) -> np.ndarray:
    """Means over cells, in the order of the cells."""
    cell, of = np.unique(np.floor(points[:, :3] / grid), axis=0, return_inverse=True)
    of = of.ravel()
    order = np.lexsort((*points.T[::-1], of))  # sums don't depend on the order of rows
    total = np.zeros((len(cell), points.shape[1]))
    np.add.at(total, of[order], points[order])
    return total / np.bincount(of)[:, None]


def rotations(angles: np.ndarray) -> np.ndarray:
    """(n, 3, 3) for roll, pitch and yaw: about x, then y, then z."""
    (cr, cp, cy), (sr, sp, sy) = np.cos(angles).T, np.sin(angles).T
    rows = [[cy * cp, cy * sp * sr - sy * cr, cy * sp * cr + sy * sr], [sy * cp, sy * sp * sr + cy * cr, sy * sp * cr - cy * sr], [-sp, cp * sr, cp * cr]]
    return np.stack([np.stack(r, -1) for r in rows], -2)


class Cells:
    """For each cell near a cloud's points, the point nearest to its middle; up to two cells away."""

    def __init__(self, cloud: np.ndarray, side: float) -> None:
        self.side = side
        self.low = np.floor(cloud[:, :3].min(0) / side) - 3
        self.size = (np.floor(cloud[:, :3].max(0) / side) - self.low + 4).astype(np.int64)
        # each point in the cells around it, and for each cell the point nearest to its middle
        around = np.stack(np.meshgrid(*[np.arange(-2, 3)] * 3, indexing="ij"), -1).reshape(-1, 3)
        cells = (np.floor(cloud[:, :3] / side) - self.low).astype(np.int64)[:, None] + around
        away = (((cells + self.low + 0.5) * side - cloud[:, None, :3]) ** 2).sum(-1).ravel()
        codes, point = self._code(cells).ravel(), np.repeat(np.arange(len(cloud)), len(around))
        order = np.lexsort((point, away, codes))
        codes, point = codes[order], point[order]
        head = np.concatenate([[True], codes[1:] != codes[:-1]])
        self.codes, self.point = codes[head], point[head]

    def _code(self, c: np.ndarray) -> np.ndarray:
        return ((c[..., 0] * self.size[1]) + c[..., 1]) * self.size[2] + c[..., 2]

    def near(self, placed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether there is a point near each place, and its number."""
        at = np.floor(placed / self.side) - self.low
        inside = ((at >= 0) & (at < self.size)).all(-1)
        wanted = self._code(np.where(inside[..., None], at, 0).astype(np.int64))
        found = np.minimum(np.searchsorted(self.codes, wanted), len(self.codes) - 1)
        return inside & (self.codes[found] == wanted), self.point[found]


def placed_at(reference: np.ndarray, poses: np.ndarray) -> np.ndarray:
    return np.einsum("pij,rj->pri", rotations(poses[:, 3:]), reference[:, :3]) + poses[:, None, :3]


def matched(reference: np.ndarray, poses: np.ndarray, cloud: np.ndarray) -> np.ndarray:
    """For each pose the sum of the reference points' coherence with the cloud's points nearest to the middle of their cell; none beyond DISTANCE counts."""
    cloud = thinned(cloud, GRID)
    placed = placed_at(reference, poses)
    hit, near = Cells(cloud, DISTANCE / 2).near(placed)
    d2 = ((cloud[near, :3] - placed) ** 2).sum(-1)
    color = hue(cloud[:, 3:])[near] - reference[None, :, 3:]
    turn = np.minimum(np.abs(color[..., 0]), 1 - np.abs(color[..., 0]))
    value = 1 / (1 + d2 / DISTANCE**2) / (1 + turn**2 + color[..., 1] ** 2)
    return np.where(hit & (d2 <= DISTANCE**2), value, 0.0).sum(1)


def laid(reference: np.ndarray, poses: np.ndarray, cloud: np.ndarray) -> np.ndarray:
    """Each pose after rounds that find the cloud's points near the placed reference points and move the reference onto them, with least squares. Where these points fix no rotation it stays; a pose without points stays."""
    cloud, poses, ref = thinned(cloud, GRID), poses.copy(), reference[:, :3]
    cells = {side: Cells(cloud, side) for side in set(SIDES)}
    for side in SIDES:
        hit, near = cells[side].near(placed_at(reference, poses))
        w = hit / np.maximum(hit.sum(1), 1)[:, None]
        own, to = w @ ref, (w[..., None] * cloud[near, :3]).sum(1)
        spread = np.einsum("pr,pri,prj->pij", w, ref[None] - own[:, None], cloud[near, :3] - to[:, None])
        u, s, vt = np.linalg.svd(spread)
        sign = np.where(np.linalg.det(u @ vt) < 0, -1.0, 1.0)
        vt[:, 2] *= sign[:, None]
        r = np.einsum("pki,pjk->pij", vt, u)
        angles = np.stack([np.arctan2(r[:, 2, 1], r[:, 2, 2]), np.arcsin(np.clip(-r[:, 2, 0], -1, 1)), np.arctan2(r[:, 1, 0], r[:, 0, 0])], 1)
        angles = np.where((s[:, 1] > 1e-6 * np.maximum(s[:, 0], 1))[:, None], angles, poses[:, 3:])
        moved = np.concatenate([to - np.einsum("pij,pj->pi", rotations(angles), own), angles], 1)
        poses = np.where(hit.any(1)[:, None], moved, poses)
    return poses


def regions(references: DataFrame, reach: int = REACH) -> DataFrame:
    """label, the ends of its box, reach wider on each side, and cx, cy, cz: the cells, as wide as the reach, that it meets."""
    ends = [e for a in "xyz" for e in ((F.min(a) - reach).alias(f"lo_{a}"), (F.max(a) + reach).alias(f"hi_{a}"))]
    out = references.groupBy("label").agg(*ends)
    for a in "xyz":
        out = out.withColumn(f"c{a}", F.explode(F.sequence(F.floor(F.col(f"lo_{a}") / reach), F.floor(F.col(f"hi_{a}") / reach))))
    return out


def routed(points: DataFrame, near: DataFrame, reach: int = REACH) -> DataFrame:
    """The points' columns with the label of each region (see regions) that they are in."""
    keyed = points.withColumns({f"c{a}": F.floor(F.col(a) / reach) for a in "xyz"})
    both = keyed.join(near, ["cx", "cy", "cz"])
    for a in "xyz":
        both = both.where(F.col(a).between(F.col(f"lo_{a}"), F.col(f"hi_{a}")))
    return both.select(*points.columns, "label")


VALUES = ["x", "y", "z", "r", "g", "b"]
RESULT = "label long, frame long, " + ", ".join(f"{p} double" for p in POSE) + ", particles int"


def result(t: Tracker) -> pd.DataFrame:
    return pd.DataFrame({"label": [t.label], "frame": [t.frame], **{p: [v] for p, v in zip(POSE, t.pose, strict=True)}, "particles": [len(t.particles)]})


def tracked(points: DataFrame, references: DataFrame, reach: int = REACH) -> DataFrame:
    """label, frame, pose and number of particles: of each label in references (label, frame, x, y, z, r, g, b) in each later frame of points with any near it. A label's frames pass through its task one by one."""
    frame = lambda df: df.select(F.col("label").cast("long").alias("label"), F.col("frame").cast("long").alias("frame"), *[F.col(v).cast("double").alias(v) for v in VALUES])
    first = references.groupBy("label").agg(F.max("frame").alias("since"))
    near = routed(points.select("frame", *VALUES), regions(references, reach), reach).join(first, "label").where("frame > since")
    cell = [F.floor(F.col(a) / GRID).alias(f"t{a}") for a in "xyz"]
    near = near.groupBy("label", "frame", *cell).agg(*[F.avg(v).alias(v) for v in VALUES])
    rows = frame(references).withColumn("kind", F.lit(0)).unionByName(frame(near).withColumn("kind", F.lit(1)))
    parts = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tracker, of, held = None, None, []

        def done() -> Iterator[pd.DataFrame]:
            nonlocal tracker
            label, at, kind = of
            values = np.concatenate(held)
            if not kind:
                tracker = Tracker.begin(label, values, at)
            elif tracker is not None and tracker.label == label:
                tracker = tracker.follow(values, at)
                yield result(tracker)

        for f in frames:
            keys = f[["label", "frame", "kind"]].to_numpy()
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), len(f)]
            values = f[VALUES].to_numpy(float)
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if lo == hi:
                    continue
                if of is not None and of != tuple(keys[lo].tolist()):
                    yield from done()
                    held = []
                of = tuple(keys[lo].tolist())
                held.append(values[lo:hi])
        if held:
            yield from done()

    return rows.repartition(parts, "label").sortWithinPartitions("label", "frame", "kind", *VALUES).mapInPandas(run, RESULT)
