"""Normals by principal components in closed form, nearest neighbours, occlusion along camera rays."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pointfold.functions.columns import ORIGIN, VOXEL
from pointfold.operators.cut import cut
from pointfold.operators.spatial import KEY, offsets


def normals(sums: DataFrame, at: DataFrame) -> DataFrame:
    """Key, nx, ny, nz, curvature from the sums of two_ring_sums; towards the camera at the origin. Zero where the covariance gives no direction.

    The least eigenvalue of a symmetric 3 x 3 matrix has a closed form, its vector is the longest cross product of two rows of M - value, so all stays in built-in functions.
    """
    d = {c: F.col(c).cast("double") for c in ("n", "sx", "sy", "sz")}
    cov = [((F.col("n") * F.col(f"s{a}{b}") - F.col(f"s{a}") * F.col(f"s{b}")).cast("double") / (d["n"] * d["n"])).alias(f"c{a}{b}") for a, b in ("xx", "xy", "xz", "yy", "yz", "zz")]
    m = sums.select(*KEY, *cov).withColumn("q", (F.col("cxx") + F.col("cyy") + F.col("czz")) / 3)
    off = F.col("cxy") * F.col("cxy") + F.col("cxz") * F.col("cxz") + F.col("cyz") * F.col("cyz")
    a, b, e = (F.col(c) - F.col("q") for c in ("cxx", "cyy", "czz"))
    m = m.withColumn("p", F.sqrt((a * a + b * b + e * e + 2 * off) / 6))
    det = a * (b * e - F.col("cyz") * F.col("cyz")) - F.col("cxy") * (F.col("cxy") * e - F.col("cyz") * F.col("cxz")) + F.col("cxz") * (F.col("cxy") * F.col("cyz") - b * F.col("cxz"))
    half = F.when(F.col("p") > 0, F.greatest(F.least(det / (2 * F.col("p") * F.col("p") * F.col("p")), F.lit(1.0)), F.lit(-1.0))).otherwise(F.lit(1.0))
    m = m.withColumn("e", F.col("q") + 2 * F.col("p") * F.cos(F.acos(half) / 3 + 2 * math.pi / 3))
    rows = [[F.col("cxx") - F.col("e"), F.col("cxy"), F.col("cxz")], [F.col("cxy"), F.col("cyy") - F.col("e"), F.col("cyz")], [F.col("cxz"), F.col("cyz"), F.col("czz") - F.col("e")]]
    crosses = [_cross(rows[i], rows[j]) for i, j in ((0, 1), (0, 2), (1, 2))]
    best = F.greatest(*[F.struct(sum(x * x for x in v).alias("len"), *[x.alias(n) for x, n in zip(v, "xyz", strict=True)]) for v in crosses])
    m = m.withColumn("v", best).join(at.select(*KEY, "x", "y", "z"), KEY)
    towards = F.when(sum(F.col(f"v.{x}") * F.col(x) for x in "xyz") > 0, -1.0).otherwise(1.0)
    unit = [F.when(F.col("v.len") > 0, F.col(f"v.{x}") * towards / F.sqrt("v.len")).otherwise(0.0).alias(f"n{x}") for x in "xyz"]
    return m.select(*KEY, *unit, F.when(F.col("q") > 0, F.greatest(F.col("e"), F.lit(0.0)) / (3 * F.col("q"))).otherwise(0.0).alias("curvature"))


def _cross(a: list[Column], b: list[Column]) -> list[Column]:
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


#: Rows with more points than this in the cells around them go down from larger cells to smaller ones instead.
FAR = 4096
CELL = ["cx", "cy", "cz"]
UP = ["ux", "uy", "uz"]


def _raised(df: DataFrame) -> DataFrame:
    """Adds ux, uy, uz: the cell of size radius * 2 ** level that holds the cell cx, cy, cz."""
    return df.withColumns({u: F.expr(f"shiftright(c{u[1]}, level)") for u in UP})


def _around(df: DataFrame) -> DataFrame:
    """A row for each of the 27 cells around ux, uy, uz, itself included."""
    return df.withColumn("o", F.explode(F.array_append(offsets(), F.struct(*[F.lit(0).alias(a) for a in "xyz"])))).withColumns({u: F.col(u) + F.col(f"o.{u[1]}") for u in UP}).drop("o")


def nearest(a: DataFrame, b: DataFrame, k: int, radius: int, others: bool = False) -> DataFrame:
    """frame, pid, o_pid, d2, rank: the k nearest of b (frame, pid, x, y, z) to each row of a, or all if they are fewer; ties to the smaller o_pid; with `others`, never the row itself.

    Cells as wide as the radius are counted at all levels, each twice as wide as the one before. A cell's rows climb to the first level whose cell
    holds k of b: none of the k nearest is then beyond the 27 cells around them a level higher, where they are joined.
    Rows that would meet more than FAR points there go down again instead, see descended(). The number of joins does not depend on the
    clouds' span or on how sparse a row's surroundings are.
    """
    keyed = lambda df: cut(df.select("frame", "pid", "x", "y", "z", *[F.floor(F.col(x) / radius).cast("long").alias(f"c{x}") for x in "xyz"]))
    a, b = (keyed(a),) * 2 if a is b else (keyed(a), keyed(b))
    need = k + others
    base = cut(b.groupBy("frame", *CELL).agg(F.count("*").alias("n")))
    asking = a.select("frame", *CELL).distinct()
    # one row, whatever the clouds
    ends = base.select(*CELL).union(asking.select(*CELL)).agg(*[F.max(c) - F.min(c) for c in CELL]).first()
    top = max((e or 0).bit_length() for e in ends) + 1
    levels = F.explode(F.sequence(F.lit(0), F.lit(top))).alias("level")
    counts = cut(_raised(base.select("*", levels)).groupBy("frame", "level", *UP).agg(F.sum("n").alias("n")))
    path = _raised(asking.select("*", levels)).join(counts, ["frame", "level", *UP], "left").groupBy("frame", *CELL)
    held = path.agg(F.least(F.min(F.when(F.col("n") >= need, F.col("level"))) + 1, F.lit(top)).alias("level"))
    held = _raised(held.withColumn("level", F.coalesce("level", F.lit(top))))
    met = _around(held).join(counts, ["frame", "level", *UP]).groupBy("frame", *CELL, "level").agg(F.sum("n").alias("met"))
    met = cut(_raised(met))
    used = [r.level for r in met.where(F.col("met") <= FAR).select("level").distinct().collect()]  # a number for each level
    there = b.select("frame", F.col("pid").alias("o_pid"), *[F.col(x).alias(f"o_{x}") for x in "xyz"], *CELL)
    near = _around(a.join(met.where(F.col("met") <= FAR), ["frame", *CELL]).drop(*CELL))
    pairs = near.join(_raised(there.withColumn("level", F.explode(F.array(*map(F.lit, used or [0]))))), ["frame", "level", *UP])
    out = _ranked(pairs, k, others)
    if not met.where(F.col("met") > FAR).limit(1).count():
        return out
    far = descended(a, met.where(F.col("met") > FAR), counts, radius, need)
    return out.unionByName(_ranked(far.join(there, ["frame", *CELL]), k, others))


def _ranked(pairs: DataFrame, k: int, others: bool) -> DataFrame:
    d2 = sum((F.col(x) - F.col(f"o_{x}")) * (F.col(x) - F.col(f"o_{x}")) for x in "xyz")
    near = pairs.select("frame", "pid", "o_pid", d2.alias("d2"))
    if others:
        near = near.where("pid <> o_pid")
    rank = F.row_number().over(Window.partitionBy("frame", "pid").orderBy("d2", "o_pid"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k)


def descended(a: DataFrame, cells: DataFrame, counts: DataFrame, radius: int, need: int) -> DataFrame:
    """frame, pid, x, y, z of the rows of a in cells (frame, cx, cy, cz, level and ux, uy, uz at that level), each with the smallest cells cx, cy, cz that can hold one of the `need` nearest.

    From the 27 cells around a row, each round goes to the eight within each, a level down, and leaves out those that begin farther off than
    others end that hold enough. A row far from all others keeps a few cells of each level. Rounds are written out.
    """
    row = Window.partitionBy("frame", "pid")

    def kept(open_: DataFrame) -> DataFrame:
        size = F.lit(float(radius)) * F.pow(F.lit(2.0), "level")
        lo = {x: F.col(f"u{x}") * size - F.col(x) for x in "xyz"}
        begins = sum(F.pow(F.greatest(v, -v - size, F.lit(0.0)), 2) for v in lo.values())
        ends = sum(F.pow(F.greatest(v + size, -v), 2) for v in lo.values())
        seen = open_.join(counts, ["frame", "level", *UP]).withColumns({"begins": begins, "ends": ends})
        seen = seen.withColumn("sum", F.sum("n").over(row.orderBy("ends", *UP)))
        seen = seen.withColumn("reach", F.min(F.when(F.col("sum") >= need, F.col("ends"))).over(row))
        return cut(seen.where("reach IS NULL OR begins <= reach").drop("n", "begins", "ends", "sum", "reach"))

    open_ = kept(_around(a.join(cells.drop("met"), ["frame", *CELL]).drop(*CELL)))
    halves = F.array(*[F.struct(*[F.lit(i).alias(x) for i, x in zip((i, j, l), "xyz", strict=True)]) for i in (0, 1) for j in (0, 1) for l in (0, 1)])
    while open_.where("level > 0").limit(1).count():
        inner = open_.where("level > 0").withColumn("o", F.explode(halves)).withColumns({u: F.col(u) * 2 + F.col(f"o.{u[1]}") for u in UP}).withColumn("level", F.col("level") - 1).drop("o")
        open_ = kept(inner.unionByName(open_.where("level = 0")))
    return open_.select("frame", "pid", "x", "y", "z", *[F.col(u).alias(c) for u, c in zip(UP, CELL, strict=True)])


def statistical_outliers(points: DataFrame, k: int, factor: float, radius: int) -> DataFrame:
    """frame, pid, mean_d, kept: whether the mean distance to the k nearest others is within factor deviations above a frame's mean. One row a frame is joined back."""
    near = nearest(points, points, k, radius, others=True)
    m = near.groupBy("frame", "pid").agg(F.avg(F.sqrt("d2")).alias("mean_d"))
    cut = m.groupBy("frame").agg((F.avg("mean_d") + factor * F.coalesce(F.stddev("mean_d"), F.lit(0.0))).alias("cut"))
    return m.join(cut, "frame").select("frame", "pid", "mean_d", (F.col("mean_d") <= F.col("cut")).alias("kept"))


#: Steps of a ray in voxels; an occluder nearer than NEAR hides only if it is new; the near plane in front of the camera, in millimetres.
STEP, NEAR, PLANE = 0.25, 2.5, 300
CAMERA = {a: math.floor(-ORIGIN[a] / VOXEL) for a in "xyz"}


def rays(voxels: DataFrame) -> DataFrame:
    """The key of each voxel with distance, ox, oy, oz: the cells that its ray to the camera's cell enters, up to the near plane. Rays start a voxel away, in steps of a quarter; the first step counts as distance 1. A cell counts where the ray enters it."""
    d = {a: CAMERA[a] - F.col(f"k{a}") for a in "xyz"}
    g = voxels.select(*KEY).withColumn("norm", F.sqrt(sum(v * v for v in d.values()).cast("double"))).where("norm > 0")
    steps = F.greatest(F.floor(F.col("norm") / STEP), F.lit(1)).cast("int")
    at = lambda a, i: F.col(f"k{a}") + d[a] / F.col("norm") * (1 + STEP * (i + 1))
    path = F.transform(F.sequence(F.lit(0), steps - 1), lambda i: F.struct((1 + STEP * i).alias("distance"), at("z", i).alias("z"), *[F.round(at(a, i)).cast("long").alias(f"o{a}") for a in "xyz"]))
    g = g.select(*KEY, F.filter(path, lambda s: s["z"] >= math.floor((PLANE - ORIGIN["z"]) / VOXEL)).alias("path"))
    other = lambda s, i, a: s[a] != F.get("path", i - 1)[a]
    enters = F.filter("path", lambda s, i: (i == 0) | other(s, i, "ox") | other(s, i, "oy") | other(s, i, "oz"))
    return g.select(*KEY, F.explode(enters).alias("s")).select(*KEY, "s.distance", "s.ox", "s.oy", "s.oz").where("ox <> kx OR oy <> ky OR oz <> kz")


def crossed(voxels: DataFrame, size: int = VOXEL) -> DataFrame:
    """The key of each voxel with ox, oy, oz: the cells that the line from the camera to its middle crosses before it, from where the line is as deep as the grid's origin.

    The line enters a cell at each plane between cells that it crosses, so its cells are those between crossings that follow one another: none is missed, however short the line is in it.
    """
    axes = [(a, (F.col(f"k{a}") + 0.5) * size + ORIGIN[a]) for a in "xyz"]
    middle = {a: F.col(f"p{a}") for a in "xyz"}
    v = voxels.select(*KEY, *[m.alias(f"p{a}") for a, m in axes]).where("kz >= 0 AND pz > 0")
    first = F.lit(float(ORIGIN["z"])) / middle["z"]

    def planes(a: str) -> Column:
        """Where along the line (0: camera, 1: the voxel's middle) it crosses planes of this axis."""
        start, end = F.floor((middle[a] * F.col("first") - ORIGIN[a]) / float(size)), F.col(f"k{a}")
        low, high = F.least(start, end) + 1, F.greatest(start, end)
        at = F.transform(F.sequence(low, high), lambda k: (k * float(size) + ORIGIN[a]) / middle[a])
        return F.when(low <= high, at).otherwise(F.array().cast("array<double>"))

    v = v.withColumn("first", first)
    at = F.array_sort(F.array_distinct(F.concat(F.array("first", F.lit(1.0)), F.filter(F.concat(*map(planes, "xyz")), lambda t: (t > F.col("first")) & (t < 1.0)))))
    between = F.transform(F.slice("at", F.lit(1), F.size("at") - 1), lambda t, i: (t + F.get("at", i + 1)) / 2)
    cells = F.transform("between", lambda m: F.struct(*[F.floor((m * middle[a] - ORIGIN[a]) / float(size)).alias(f"o{a}") for a in "xyz"]))
    out = v.withColumn("at", at).withColumn("between", between).select(*KEY, F.explode(cells).alias("c")).select(*KEY, "c.*")
    return out.where("ox <> kx OR oy <> ky OR oz <> kz")


def occluders(gone: DataFrame, occupied: DataFrame) -> DataFrame:
    """Key, distance (in voxels), ox, oy, oz: the first occupied voxel on the ray from a gone voxel to the camera; up to NEAR voxels away, only one that is new (occupied.is_new) counts. Cells are joined and the least step kept: linear in gone voxels."""
    o = occupied.select("frame", *[F.col(f"k{a}").alias(f"o{a}") for a in "xyz"], "is_new")
    hit = rays(gone).join(o, ["frame", "ox", "oy", "oz"]).where((F.col("distance") > NEAR) | F.col("is_new"))
    return hit.groupBy(*KEY).agg(F.min(F.struct("distance", "ox", "oy", "oz")).alias("m")).select(*KEY, "m.*")
