"""Seeds pruned and carried over, and clusters grown over voxel edges in synchronous rounds."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointfold.functions.columns import feature_distance
from pointfold.operators.spatial import KEY, radius_pairs
from pointfold.operators.cut import cut
from pointfold.operators.surface import nearest

FEATURES = ["x", "y", "z", "r", "g", "b", "nx", "ny", "nz"]


def rounds_of(voxel: float, seed: float) -> int:
    """Rounds of growth for these sizes, by single-precision arithmetic."""
    return int(np.float32(1.8) * np.float32(seed) / np.float32(voxel)) - 1


def least_of(voxel: float, radius: float) -> float:
    """A seed needs more voxels within radius than this: a twentieth of a disc's."""
    return 0.05 * math.pi * radius * radius / (voxel * voxel)


def pruned(seeds: DataFrame, v: DataFrame, radius: int, least: float, existing: DataFrame | None = None) -> DataFrame:
    """Seeds (key, x, y, z) with more than `least` voxels within radius, themselves included, and none of them an existing seed (frame, x, y, z of its voxel)."""
    if existing is not None:
        seeds = seeds.join(radius_pairs(seeds, existing.select("frame", "x", "y", "z"), radius).select(*KEY).distinct(), KEY, "left_anti")
    near = radius_pairs(seeds, v.select("frame", "x", "y", "z"), radius).groupBy(*KEY).agg(F.count("*").alias("near"))
    return seeds.join(near.where(F.col("near") > least), KEY)


def carried(labels: DataFrame, v: DataFrame, moved: DataFrame | None = None) -> DataFrame:
    """frame, label, key: the voxel nearest to where a label is expected. labels: key and label of the frame before, by the new frame's number.

    A label that was matched (moved: frame, label and the place x, y, z where its transform takes its old centre) is expected there, another at the mean of its voxels that are still there; without any, it is dropped.
    """
    mean = [F.floor(F.sum(a) / F.count("*")).alias(a) for a in "xyz"]
    at = labels.join(v.select(*KEY, "x", "y", "z"), KEY).groupBy("frame", F.col("label").alias("pid")).agg(*mean)
    if moved is not None:
        matched = moved.select("frame", F.col("label").alias("pid"), *[F.col(a).cast("double").alias(a) for a in "xyz"])
        at = matched.unionByName(at.join(matched, ["frame", "pid"], "left_anti").select("frame", "pid", *[F.col(a).cast("double").alias(a) for a in "xyz"]))
    to = v.select("frame", F.struct("kx", "ky", "kz").alias("pid"), "x", "y", "z")
    return nearest(at, to, 1, 100).select("frame", F.col("pid").alias("label"), "o_pid.kx", "o_pid.ky", "o_pid.kz")


def centroids(owned: DataFrame) -> DataFrame:
    """Means of each label's voxels; the normal is the normalised sum."""
    n = F.sqrt(sum(F.sum(c) * F.sum(c) for c in FEATURES[6:]))
    unit = [F.when(n > 0, F.sum(c) / n).otherwise(0.0).alias(c) for c in FEATURES[6:]]
    return owned.where("label IS NOT NULL").groupBy("frame", "label").agg(F.count("*").alias("n"), *[(F.sum(c) / F.count("*")).alias(c) for c in FEATURES[:6]], *unit)


def grow(v: DataFrame, edges: DataFrame, seeds: DataFrame, rounds: int) -> DataFrame:
    """v with label and d (distance when it was taken; null for a seed's own voxel or one never reached).

    In each round every voxel is offered to its neighbours' clusters and goes to the nearest centroid if that is nearer than its d; ties to the smaller label. The first round measures from zero centroids. Voxels, edges and each round are written out, so that no round reads the input again and lineage stays one round long. Only (frame, label) centroids and keys are shuffled in a round.
    """
    own = cut(v.join(seeds.select(*KEY, "label"), KEY, "left").withColumn("d", F.lit(None).cast("double")))
    there = cut(edges.select(*KEY, *[F.col(f"n{a}").alias(f"m{a}") for a in "xyz"]))
    for i in range(rounds):
        c = centroids(own).select("frame", "label", *[(F.lit(0.0) if i == 0 else F.col(f)).alias(f"c_{f}") for f in FEATURES])
        offers = own.where("label IS NOT NULL").select(*KEY, "label").join(there, KEY).select("frame", *[F.col(f"m{a}").alias(f"k{a}") for a in "xyz"], F.col("label").alias("by")).distinct()
        asked = offers.join(own, KEY).where("label IS NULL OR by <> label").join(c.withColumnRenamed("label", "by"), ["frame", "by"])
        d = feature_distance({f: F.col(f) for f in FEATURES}, {f: F.col(f"c_{f}") for f in FEATURES})
        best = asked.groupBy(*KEY).agg(F.min(F.struct(d.alias("d"), "by")).alias("best"))
        better = F.col("best.d") < F.coalesce("d", F.lit(float("inf")))
        own = cut(own.join(best, KEY, "left").select(*KEY, *FEATURES, F.when(better, F.col("best.by")).otherwise(F.col("label")).alias("label"), F.when(better, F.col("best.d")).otherwise(F.col("d")).alias("d")))
    return own


def refined(own: DataFrame, edges: DataFrame, rounds: int) -> DataFrame:
    """own (as grow gives it) grown anew from the voxels nearest to its clusters' centres."""
    c = centroids(own).select("frame", F.col("label").alias("pid"), *"xyz")
    to = own.select("frame", F.struct("kx", "ky", "kz").alias("pid"), *[F.col(a).cast("double").alias(a) for a in "xyz"])
    seeds = nearest(c, to, 1, 100).select("frame", "o_pid.*", F.col("pid").alias("label"))
    # clusters with one centre voxel: the smaller label keeps it
    return grow(own.drop("label", "d"), edges, seeds.groupBy(*KEY).agg(F.min("label").alias("label")), rounds)
