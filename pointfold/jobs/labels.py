"""Queries of the label tracker and of the coherence of points."""

from __future__ import annotations

from pyspark.sql import functions as F

from pointfold.functions import columns as c
from pointfold.jobs.base import query
from pointfold.jobs.scene import LABELS, labelled
from pointfold.operators import spatial, tracker
from pointfold.sources import tables as t

KEY = spatial.KEY
HSV = """greatest({0}r,{0}g,{0}b)::DOUBLE top{1}, greatest({0}r,{0}g,{0}b)-least({0}r,{0}g,{0}b) d{1}, CASE WHEN {0}r={0}g AND {0}g={0}b THEN 0.0 WHEN {0}r>={0}g AND {0}r>={0}b THEN (({0}g-{0}b)::DOUBLE/(greatest({0}r,{0}g,{0}b)-least({0}r,{0}g,{0}b))+CASE WHEN {0}g<{0}b THEN 6 ELSE 0 END)/6 WHEN {0}g>={0}b THEN (({0}b-{0}r)::DOUBLE/(greatest({0}r,{0}g,{0}b)-least({0}r,{0}g,{0}b))+2)/6 ELSE (({0}r-{0}g)::DOUBLE/(greatest({0}r,{0}g,{0}b)-least({0}r,{0}g,{0}b))+4)/6 END h{1}"""


@query(f"WITH {t.PARTS} SELECT label, frame, true AS near FROM parts WHERE frame>0 GROUP BY label, frame")
def t11_tracked_labels(spark, sf_dir):
    """Whether the filter of each part finds it, in each frame after the first, within half a voxel of where its known motion puts it."""
    p = t.parts(spark, sf_dir)
    first = p.where("frame = 0")
    poses = tracker.tracked(p, first)
    # the pose is that of the reference points thinned, as the filter begins
    grid = [F.floor(F.col(a) / (2 * tracker.GRID)).alias(f"t{a}") for a in "xyz"]
    middle = first.groupBy("label", *grid).agg(*[F.avg(a).alias(a) for a in "xyz"]).groupBy("label").agg(*[F.avg(a).alias(f"m{a}") for a in "xyz"])
    off = [F.abs(F.col(a) - F.col(f"m{a}") - F.expr(s) * F.col("frame")) for a, s in zip("xyz", t.PART_STEP, strict=True)]
    return poses.join(middle, "label").select("label", "frame", (F.greatest(*off) <= c.VOXEL / 2).alias("near"))


@query(f"WITH p AS (SELECT p_partkey%40 u, CAST(floor(p_partkey/40.0) AS BIGINT) v, (p_partkey*2654435)%16777216 rgb FROM part), q AS (SELECT u, v, rgb//65536 r, rgb//256%256 g, rgb%256 b FROM p) SELECT u, v, round(h, 9) hue, round(CASE WHEN top>0 THEN d/top ELSE 0.0 END, 9) saturation, round(top/255, 9) AS value FROM (SELECT u, v, {HSV.format('', '')} FROM q)")
def t13_hsv(spark, sf_dir):
    """Hue, saturation and value of the pixels."""
    p = t.pixels(spark, sf_dir).select("u", "v", *[x.cast("long").alias(n) for n, x in zip("rgb", c.unpacked(F.col("rgb")), strict=True)])
    return p.select("u", "v", *[F.round(x, 9).alias(n) for n, x in zip(("hue", "saturation", "value"), tracker.hsv(*map(F.col, "rgb")), strict=True)])


@query(f"""WITH {LABELS}, m AS (SELECT e.*, (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z) d2, a.label=b.label same, {HSV.format('a.', 'a')}, {HSV.format('b.', 'b')} FROM edges e JOIN l a ON a.frame=e.frame AND a.kx=e.kx AND a.ky=e.ky AND a.kz=e.kz JOIN l b ON b.frame=e.frame AND b.kx=e.nx AND b.ky=e.ny AND b.kz=e.nz),
w AS (SELECT *, least(abs(ha-hb), 1-abs(ha-hb)) turn, CASE WHEN topa>0 THEN da/topa ELSE 0.0 END-CASE WHEN topb>0 THEN db/topb ELSE 0.0 END sat FROM m)
SELECT frame, kx, ky, kz, round(sum(1/(1+d2/1600.0)*(1/(1+turn*turn+sat*sat))*CASE WHEN same THEN 1.0 ELSE 0.1 END), 6) coherence FROM w GROUP BY frame, kx, ky, kz""")
def t13_coherence(spark, sf_dir):
    """How well each voxel's neighbours match it, by distance, colour and label together."""
    v = labelled(spark, sf_dir).select(*KEY, *"xyzrgb", "label")
    there = v.select("frame", *[F.col(f"k{a}").alias(f"n{a}") for a in "xyz"], *[F.col(x).alias(f"o_{x}") for x in (*"xyzrgb", "label")])
    m = spatial.adjacency(v).join(v, KEY).join(there, ["frame", "nx", "ny", "nz"])
    d2 = sum((F.col(a) - F.col(f"o_{a}")) * (F.col(a) - F.col(f"o_{a}")) for a in "xyz")
    colors = [tracker.hsv(*[F.col(f"{o}{x}") for x in "rgb"]) for o in ("", "o_")]
    value = tracker.coherence(d2, *colors, F.col("label") == F.col("o_label"), c.VOXEL)
    return m.groupBy(*KEY).agg(F.round(F.sum(value), 6).alias("coherence"))
