"""Keypoints on voxels and their descriptors: histograms of normal angles, and colour sums."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointfold.functions.columns import ORIGIN, VOXEL, cell, lab
from pointfold.operators.spatial import KEY, radius_pairs
from pointfold.operators.surface import nearest

BINS = 11
PARTS = [f"h{i}" for i in range(3 * BINS)]


def keypoints(v: DataFrame, by: list[str], size: int = 2 * VOXEL) -> DataFrame:
    """by, kp_id (number of the cell), x, y, z: the centres of cells of `size` that hold voxels (x, y, z) of each group."""
    cells = v.select(*by, *[cell(a, size).alias(f"c{a}") for a in "xyz"]).distinct()
    # 21 bits for each axis
    kp = sum((F.col(f"c{a}") + (1 << 20)) * (1 << s) for a, s in zip("xyz", (42, 21, 0), strict=True))
    return cells.select(*by, kp.alias("kp_id"), *[(F.col(f"c{a}") * size + size // 2 + ORIGIN[a]).alias(a) for a in "xyz"])


def angle(y: Column, x: Column) -> Column:
    """atan2 with signed zeros, as the floating-point standard has it and SQL engines do: Spark's own takes -0.0 for 0.0, which turns half a turn into none or round to the other end."""
    minus = lambda v: (v == 0) & v.cast("string").startswith("-")
    return F.when((y == 0) & ((x < 0) | minus(x)), F.when(minus(y), -math.pi).otherwise(math.pi)).otherwise(F.atan2(y, x))


def with_bins(pairs: DataFrame) -> DataFrame:
    """Adds b0, b1, b2 to pairs of points (x, nx, ..., o_x, o_nx, ...): the bins of the three angles between their normals and the line between them, seen from the point whose normal is closer to the line. Null where normal and line agree. Step by step, so that what several columns use is computed once."""
    dot = lambda a, b: sum((F.col(x) * F.col(y) for x, y in zip(a[1:], b[1:], strict=True)), F.col(a[0]) * F.col(b[0]))
    cross = lambda a, b, to: {to[i]: F.col(a[j]) * F.col(b[k]) - F.col(a[k]) * F.col(b[j]) for i, j, k in ((0, 1, 2), (1, 2, 0), (2, 0, 1))}
    three = lambda n: [f"__{n}{a}" for a in "xyz"]
    d, line, first, second, c, v, w = map(three, "dlfscvw")
    here, there = ["nx", "ny", "nz"], ["o_nx", "o_ny", "o_nz"]
    p = pairs.withColumns({n: (F.col(f"o_{a}") - F.col(a)).cast("double") for n, a in zip(d, "xyz", strict=True)})
    p = p.withColumn("__len", F.sqrt(dot(d, d)))
    p = p.withColumns({"__one": dot(here, d) / F.col("__len"), "__two": dot(there, d) / F.col("__len")})
    p = p.withColumn("__swap", F.abs("__one") < F.abs("__two"))
    either = lambda a, b: F.when(F.col("__swap"), b).otherwise(a)
    p = p.withColumns({n: either(F.col(x), -F.col(x)) / F.col("__len") for n, x in zip(line, d, strict=True)} | {n: either(F.col(x), F.col(y)) for n, x, y in zip(first, here, there, strict=True)} | {n: either(F.col(y), F.col(x)) for n, x, y in zip(second, here, there, strict=True)})
    p = p.withColumns(cross(line, first, c)).withColumn("__size", F.sqrt(dot(c, c)))
    p = p.withColumns({n: F.when(F.col("__size") > 0, F.col(x) / F.col("__size")) for n, x in zip(v, c, strict=True)}).withColumns(cross(first, v, w))
    third = F.when(F.col("__size") > 0, either(F.col("__one"), -F.col("__two")))
    p = p.withColumns({"__y": dot(w, second), "__x": dot(first, second)})
    p = p.withColumns({"__a0": (angle(F.col("__y"), F.col("__x")) + math.pi) / (2 * math.pi), "__a1": (dot(v, second) + 1) / 2, "__a2": (third + 1) / 2})
    return p.withColumns({f"b{i}": F.when(F.col(f"__a{i}").isNotNull(), F.least(F.greatest(F.floor(F.col(f"__a{i}") * BINS), F.lit(0)), F.lit(BINS - 1))) for i in range(3)})


def histograms(v: DataFrame, radius: int) -> DataFrame:
    """Key and h0 to h32 of each voxel with neighbours (voxels: x, y, z, nx, ny, nz): three histograms of the angles between it and its neighbours within radius, smoothed over the neighbours by one over the squared distance; each sums to 100.

    Both passes are sums that are combined before rows move; pairs are made twice rather than kept.
    """
    own = v.select(*KEY, *"xyz", "nx", "ny", "nz")
    pairs = radius_pairs(own, own, radius).where("d2 > 0")
    binned = with_bins(pairs).select(*KEY, "b0", "b1", "b2")
    simple = binned.groupBy(*KEY).agg(*[(F.sum((F.col(f"b{i // BINS}") == i % BINS).cast("long")) * 100.0 / F.count("*")).alias(n) for i, n in enumerate(PARTS)])
    other = simple.select("frame", *[F.col(f"k{a}").alias(f"o_k{a}") for a in "xyz"], *PARTS)
    near = pairs.select(*KEY, "o_kx", "o_ky", "o_kz", "d2").join(other, ["frame", "o_kx", "o_ky", "o_kz"])
    total = near.groupBy(*KEY).agg(*[F.sum(F.coalesce(n, F.lit(0.0)) / F.col("d2")).alias(n) for n in PARTS])
    blocks = [sum(F.col(n) for n in PARTS[i : i + BINS]) for i in range(0, 3 * BINS, BINS)]
    return total.select(*KEY, *[F.when(blocks[i // BINS] > 0, F.col(n) / blocks[i // BINS] * 100).alias(n) for i, n in enumerate(PARTS)])


def colour_sums(places: DataFrame, v: DataFrame, radius: int) -> DataFrame:
    """places (frame, x, y, z and others) with lab_l, lab_a, lab_b: sums, not means, over the voxels (r, g, b) within radius; and near, their number."""
    own = [c for c in places.columns]
    near = radius_pairs(places, v.select("frame", *"xyzrgb"), radius)
    colours = lab(*[F.col(f"o_{c}").cast("double") for c in "rgb"])
    return near.groupBy(*own).agg(*[F.sum(x).alias(f"lab_{n}") for x, n in zip(colours, "lab", strict=True)], F.count("*").alias("near"))


def described(kps: DataFrame, v: DataFrame, radius: int) -> DataFrame:
    """kps (frame, label, kp_id, x, y, z) with vx, vy, vz, the means of the voxel nearest to each, and desc: that voxel's histograms and the colour sums around the keypoint, 36 numbers. Keypoints without a valid descriptor are left out."""
    ids = kps.select("frame", F.struct("label", "kp_id").alias("pid"), *"xyz")
    at = nearest(ids, v.select("frame", F.struct("kx", "ky", "kz").alias("pid"), *"xyz"), 1, radius)
    at = at.select("frame", "pid.label", "pid.kp_id", "o_pid.kx", "o_pid.ky", "o_pid.kz")
    shape = v.select(*KEY, *[F.col(a).alias(f"v{a}") for a in "xyz"]).join(histograms(v, radius), KEY)
    colour = colour_sums(kps, v, radius)
    desc = F.array(*PARTS, "lab_l", "lab_a", "lab_b")
    out = colour.join(at, ["frame", "label", "kp_id"]).join(shape, KEY).select("frame", "label", "kp_id", *"xyz", "vx", "vy", "vz", desc.alias("desc"))
    return out.where(~F.exists("desc", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))


#: Bins of distance and of angle of a histogram of gradients.
RINGS, TURNS = 4, 8
GRADIENTS = [f"g{i}{j}" for i in range(RINGS) for j in range(TURNS)]


def gradients(v: DataFrame, radius: int) -> DataFrame:
    """Key and gx, gy, gz of each voxel (x, y, z, intensity; nx, ny, nz of unit length): how its intensity grows around it, by least squares over the voxels within radius, in the plane at right angles to its normal. Null where those voxels lie in one plane or line, so that no gradient follows.

    All sums are combined before rows move; the three equations are solved in closed form.
    """
    own = v.select("frame", "kx", "ky", "kz", *"xyz", "intensity")
    near = radius_pairs(own.select("frame", "kx", "ky", "kz", *"xyz"), own.drop("kx", "ky", "kz"), radius)
    d = {a: F.col(f"o_{a}") - F.col(a) for a in "xyz"} | {"i": F.col("o_intensity")}
    pairs = ("xx", "xy", "xz", "yy", "yz", "zz", "xi", "yi", "zi")
    sums = near.groupBy(*KEY).agg(F.count("*").alias("n"), *[F.sum(d[a]).alias(f"s_{a}") for a in "xyzi"], *[F.sum(d[a] * d[b]).alias(f"s_{a}{b}") for a, b in pairs])
    m = sums.select(*KEY, *[(F.col("n") * F.col(f"s_{a}{b}") - F.col(f"s_{a}") * F.col(f"s_{b}")).cast("double").alias(f"m{a}{b}") for a, b in pairs])
    xx, xy, xz, yy, yz, zz, xi, yi, zi = (F.col(f"m{p}") for p in pairs)
    m = m.withColumns({"a0": yy * zz - yz * yz, "a1": xz * yz - xy * zz, "a2": xy * yz - xz * yy, "b1": xx * zz - xz * xz, "b2": xy * xz - xx * yz, "c2": xx * yy - xy * xy})
    m = m.withColumn("det", xx * F.col("a0") + xy * F.col("a1") + xz * F.col("a2")).where("det <> 0")
    a0, a1, a2, b1, b2, c2 = (F.col(c) for c in ("a0", "a1", "a2", "b1", "b2", "c2"))
    g = [(a0 * xi + a1 * yi + a2 * zi) / F.col("det"), (a1 * xi + b1 * yi + b2 * zi) / F.col("det"), (a2 * xi + b2 * yi + c2 * zi) / F.col("det")]
    m = m.select(*KEY, *[x.alias(f"f{a}") for x, a in zip(g, "xyz", strict=True)]).join(v.select(*KEY, "nx", "ny", "nz"), KEY)
    m = m.withColumn("along", F.col("fx") * F.col("nx") + F.col("fy") * F.col("ny") + F.col("fz") * F.col("nz"))
    return m.select(*KEY, *[(F.col(f"f{a}") - F.col("along") * F.col(f"n{a}")).alias(f"g{a}") for a in "xyz"])


def gradient_histograms(places: DataFrame, v: DataFrame, radius: int) -> DataFrame:
    """Key of places (key, x, y, z) and g00 to g37: of the gradients (gx, gy, gz) of voxels v within radius, how long they are by distance (RINGS) and by angle to the line from the place (TURNS), each shared between the bins beside it; of unit length. It doesn't change when all turn together."""
    near = radius_pairs(places.select(*KEY, *"xyz"), v.select("frame", *"xyz", "gx", "gy", "gz"), radius).where("d2 > 0")
    size = F.sqrt(F.col("o_gx") * F.col("o_gx") + F.col("o_gy") * F.col("o_gy") + F.col("o_gz") * F.col("o_gz"))
    near = near.withColumn("size", size).where("size > 0").withColumn("far", F.sqrt(F.col("d2").cast("double")))
    cos = sum((F.col(f"o_{a}") - F.col(a)) * F.col(f"o_g{a}") for a in "xyz") / (F.col("far") * F.col("size"))
    near = near.withColumn("ring", F.col("far") / radius * RINGS).withColumn("turn", F.acos(F.greatest(F.least(cos, F.lit(1.0)), F.lit(-1.0))) / math.pi * TURNS)
    share = lambda c, i: F.greatest(1 - F.abs(F.col(c) - i), F.lit(0.0))
    total = near.groupBy(*KEY).agg(*[F.sum(share("ring", int(n[1])) * share("turn", int(n[2])) * F.col("size")).alias(n) for n in GRADIENTS])
    length = F.sqrt(sum(F.col(n) * F.col(n) for n in GRADIENTS))
    return total.withColumn("length", length).select(*KEY, *[F.when(F.col("length") > 0, F.col(n) / F.col("length")).otherwise(0.0).alias(n) for n in GRADIENTS])
