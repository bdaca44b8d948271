"""Filters, voxels and spatial joins: every neighbourhood is an equi-join on grid cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pointfold.functions.columns import BOX, SEED, cell, cells

KEY = ["frame", "kx", "ky", "kz"]


def crop(points: DataFrame) -> DataFrame:
    for axis, (lo, hi) in BOX.items():
        points = points.where(F.col(axis).between(lo, hi))
    return points


def voxels(points: DataFrame) -> DataFrame:
    """Count and means of each occupied voxel; sums are whole, with one division at the end."""
    return points.groupBy("frame", *cells()).agg(F.count("*").alias("n"), *[(F.sum(c) / F.count("*")).alias(c) for c in "xyzrgb"])


def offsets() -> Column:
    """The 26 steps to a cell's neighbours."""
    steps = [(i, j, k) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1) if i or j or k]
    return F.array(*[F.struct(*[F.lit(s).alias(a) for s, a in zip(o, "xyz", strict=True)]) for o in steps])


def adjacency(v: DataFrame) -> DataFrame:
    """frame, key and neighbour's key (nx, ny, nz) of all neighbouring occupied voxels. Exploding 26 keys before one shuffle is linear in voxels."""
    k = v.select(*KEY)
    moved = k.withColumn("o", F.explode(offsets())).select(*KEY, *[(F.col(f"k{a}") + F.col(f"o.{a}")).alias(f"n{a}") for a in "xyz"])
    there = k.select("frame", *[F.col(f"k{a}").alias(f"n{a}") for a in "xyz"])
    return moved.join(there, ["frame", "nx", "ny", "nz"]).select(*KEY, "nx", "ny", "nz")


def radius_pairs(a: DataFrame, b: DataFrame, radius: int) -> DataFrame:
    """Pairs of rows (left's columns, right's with o_ before) of one frame within radius: cells as wide as the radius, 27 of them on one side."""
    near = F.array(*[F.struct(*[F.lit(s).alias(x) for s, x in zip((i, j, k), "xyz", strict=True)]) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)])
    left = a.withColumn("o", F.explode(near)).select(*a.columns, *[(cell(x, radius) + F.col(f"o.{x}")).alias(f"c{x}") for x in "xyz"])
    right = b.select(*[F.col(c).alias(f"o_{c}") for c in b.columns], *[cell(x, radius).alias(f"c{x}") for x in "xyz"], F.col("frame"))
    pairs = left.join(right, ["frame", "cx", "cy", "cz"]).drop("cx", "cy", "cz")
    d2 = sum((F.col(x) - F.col(f"o_{x}")) * (F.col(x) - F.col(f"o_{x}")) for x in "xyz")
    return pairs.withColumn("d2", d2).where(F.col("d2") <= radius * radius)


def without_outliers(points: DataFrame, radius: int, least: int) -> DataFrame:
    """Points with at least `least` others within radius. Counting needs no pairs in memory: they are summed as they are joined."""
    p = points.select("frame", "pid", "x", "y", "z")
    near = radius_pairs(p, p, radius).where("pid <> o_pid").groupBy("frame", "pid").agg(F.count("*").alias("neighbours"))
    return points.join(near.where(F.col("neighbours") >= least), ["frame", "pid"])


def two_ring_sums(v: DataFrame, edges: DataFrame) -> DataFrame:
    """Sums for each voxel's covariance over itself, its neighbours and their neighbours, as often as they are reached."""
    far = edges.select(*KEY, F.col("nx").alias("mx"), F.col("ny").alias("my"), F.col("nz").alias("mz"))
    second = edges.select("frame", F.col("kx").alias("mx"), F.col("ky").alias("my"), F.col("kz").alias("mz"), "nx", "ny", "nz")
    # how often a ring-two voxel is reached, before positions come in
    ring = far.join(second, ["frame", "mx", "my", "mz"]).groupBy(*KEY, "nx", "ny", "nz").agg(F.count("*").alias("w"))
    one = edges.select(*KEY, "nx", "ny", "nz", F.lit(1).cast("long").alias("w"))
    own = v.select(*KEY, *[F.col(f"k{a}").alias(f"n{a}") for a in "xyz"], F.lit(1).cast("long").alias("w"))
    at = v.select("frame", *[F.col(f"k{a}").alias(f"n{a}") for a in "xyz"], *[F.floor(a).alias(a) for a in "xyz"])
    rows = ring.unionByName(one).unionByName(own).join(at, ["frame", "nx", "ny", "nz"])
    moments = [F.sum(F.col("w")).alias("n"), *[F.sum(F.col("w") * F.col(a)).alias(f"s{a}") for a in "xyz"], *[F.sum(F.col("w") * F.col(a) * F.col(b)).alias(f"s{a}{b}") for a, b in ("xx", "xy", "xz", "yy", "yz", "zz")]]
    return rows.groupBy(*KEY).agg(*moments)


def state_changes(v: DataFrame) -> DataFrame:
    """For each voxel and frame whether it is new, kept or gone since the frame before."""
    after = v.select((F.col("frame") + 1).alias("frame"), "kx", "ky", "kz", F.lit(True).alias("was"))
    joined = v.select(*KEY, F.lit(True).alias("now")).join(after, KEY, "full_outer")
    return joined.select(*KEY, F.when(F.col("now").isNull(), "gone").when(F.col("was").isNull(), "new").otherwise("kept").alias("status"))


def seeds(v: DataFrame) -> DataFrame:
    """For each occupied seed cell the voxel nearest to its centre; ties to the smaller key."""
    s = v.select(*KEY, *[F.floor(a).alias(a) for a in "xyz"]).select("*", *[cell(a, SEED).alias(f"s{a}") for a in "xyz"])
    origin = {"x": -400, "y": -350, "z": 800}
    d2 = sum((F.col(a) - (origin[a] + F.col(f"s{a}") * SEED + SEED // 2)) * (F.col(a) - (origin[a] + F.col(f"s{a}") * SEED + SEED // 2)) for a in "xyz")
    best = F.min(F.struct(d2.alias("d2"), "kx", "ky", "kz")).alias("m")
    return s.groupBy("frame", "sx", "sy", "sz").agg(best).select("frame", "sx", "sy", "sz", "m.kx", "m.ky", "m.kz", "m.d2")


def new_labels(frames_used: DataFrame, wanted: DataFrame) -> DataFrame:
    """frame, i (from 1), label: the i-th of the wanted seeds of a frame takes the largest free label below the most used one, then the next; then labels above it."""
    most = frames_used.groupBy("frame").agg(F.max("label").alias("most"))
    every = most.select("frame", F.explode(F.when(F.col("most") > 1, F.sequence(F.lit(1).cast("long"), F.col("most") - 1))).alias("label"))
    free = every.join(frames_used, ["frame", "label"], "left_anti")
    free = free.withColumn("i", F.row_number().over(Window.partitionBy("frame").orderBy(F.col("label").desc())))
    count = free.groupBy("frame").agg(F.count("*").alias("n_free"))
    w = wanted.join(most, "frame", "left").join(count, "frame", "left").join(free, ["frame", "i"], "left")
    return w.select("frame", "i", F.coalesce("label", F.coalesce("most", F.lit(0)) + F.col("i") - F.coalesce("n_free", F.lit(0))).alias("label"))
