"""Queries over surfaces, clusters, occlusion, matching and state, by operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pointfold.functions import columns as c
from pointfold.jobs.base import CROSS, EDGES, KEYS, VOX, box, crossing, query, voxels
from pointfold.operators import growth, matching, spatial, surface
from pointfold.operators.cut import cut
from pointfold.sources import tables as t
from pointfold.streaming import voxel_state

KEY = spatial.KEY
OWN = "CAST(floor(kx/5.0) AS BIGINT)*100+CAST(floor(ky/5.0) AS BIGINT)*10+CAST(floor(kz/5.0) AS BIGINT)"
WHOLE = "q AS (SELECT frame, kx, ky, kz, n, " + ", ".join(f"CAST(floor({a}) AS BIGINT) {a}" for a in "xyzrgb") + " FROM vox)"
LABELS = f"{EDGES}, {WHOLE}, l AS (SELECT *, {OWN} label FROM q)"
D2 = "(a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z)"
NEAR = 102  # a little over half of a seed cell
ROUNDS, LEAST = growth.rounds_of(c.VOXEL, c.SEED), growth.least_of(c.VOXEL, NEAR)


def whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Voxels with means floored to whole numbers, so that sums over them are exact."""
    return voxels(spark, sf_dir).select(*KEY, "n", *[F.floor(a).alias(a) for a in "xyzrgb"])


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Voxels with the number of their seed cell as label."""
    label = F.floor(F.col("kx") / 5) * 100 + F.floor(F.col("ky") / 5) * 10 + F.floor(F.col("kz") / 5)
    return whole(spark, sf_dir).withColumn("label", label)


def _normals(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = whole(spark, sf_dir)
    return surface.normals(spatial.two_ring_sums(v, spatial.adjacency(v)), v)


@query(f"""WITH {VOX}, {WHOLE}, p AS (SELECT a.frame, a.kx, a.ky, a.kz, {D2} d2, row_number() OVER (PARTITION BY a.frame, a.kx, a.ky, a.kz ORDER BY {D2}, b.kx, b.ky, b.kz) i FROM q a JOIN q b ON a.frame=b.frame AND (a.kx<>b.kx OR a.ky<>b.ky OR a.kz<>b.kz)),
m AS (SELECT frame, kx, ky, kz, avg(sqrt(d2)) mean_d FROM p WHERE i<=8 GROUP BY ALL), s AS (SELECT frame, avg(mean_d)+coalesce(stddev_samp(mean_d), 0) cut FROM m GROUP BY frame)
SELECT m.frame, kx, ky, kz, round(mean_d, 6) mean_d FROM m JOIN s ON m.frame=s.frame AND mean_d<=cut""")
def f5_statistical_outliers(spark, sf_dir):
    """Voxels whose mean distance to the eight nearest is at most a deviation above the frame's mean."""
    p = whole(spark, sf_dir).select("frame", F.struct("kx", "ky", "kz").alias("pid"), "x", "y", "z")
    return surface.statistical_outliers(p, 8, 1.0, 100).where("kept").select("frame", "pid.*", F.round("mean_d", 6).alias("mean_d"))


@query(f"WITH {LABELS}, u AS (SELECT *, CASE WHEN label%3=0 THEN -1 ELSE label END owner FROM l) SELECT frame, kx, ky, kz, x, y, z FROM u WHERE owner=-1")
def f7_unlabelled(spark, sf_dir):
    """Voxels without an owner (here every third label is taken away)."""
    u = labelled(spark, sf_dir).withColumn("owner", F.when(F.col("label") % 3 == 0, -1).otherwise(F.col("label")))
    return u.where("owner = -1").select(*KEY, "x", "y", "z")


@query("SELECT label, vec_id kp_id, len(list_filter(embedding[1:36], lambda e: isnan(e) OR isinf(e))) = 0 valid FROM embeddings")
def f8_descriptor_validity(spark, sf_dir):
    bad = lambda e: F.isnan(e) | (F.abs(e) == float("inf"))
    e = t.read(spark, sf_dir, "embeddings")
    return e.select("label", F.col("vec_id").alias("kp_id"), (~F.exists(F.slice("embedding", 1, 36), bad)).alias("valid"))


@query(f"WITH {t.POINTS} SELECT frame, count(*) n, min(z-901)>=0 valid FROM pts GROUP BY frame")
def f10_negative_depth(spark, sf_dir):
    """A frame with any point behind the camera (here moved to z = 901) is not valid."""
    return t.points(spark, sf_dir).groupBy("frame").agg(F.count("*").alias("n"), (F.min(F.col("z") - 901) >= 0).alias("valid"))


@query(f"WITH {t.POINTS} SELECT frame, pid, {KEYS} FROM pts")
def f11_voxel_keys(spark, sf_dir):
    return t.points(spark, sf_dir).select("frame", "pid", *c.cells())


@query(f"WITH {LABELS} SELECT e.*, CASE WHEN a.label=b.label THEN 1.0::DOUBLE ELSE 0.1::DOUBLE END coherence FROM edges e JOIN l a ON a.frame=e.frame AND a.kx=e.kx AND a.ky=e.ky AND a.kz=e.kz JOIN l b ON b.frame=e.frame AND b.kx=e.nx AND b.ky=e.ny AND b.kz=e.nz")
def f17_label_coherence(spark, sf_dir):
    v = labelled(spark, sf_dir).select(*KEY, "label")
    there = v.select("frame", *[F.col(f"k{a}").alias(f"n{a}") for a in "xyz"], F.col("label").alias("other"))
    e = spatial.adjacency(v).join(v, KEY).join(there, ["frame", "nx", "ny", "nz"])
    return e.select(*KEY, "nx", "ny", "nz", F.when(F.col("label") == F.col("other"), 1.0).otherwise(0.1).alias("coherence"))


@query(f"WITH {t.POINTS} SELECT frame, CAST(floor((x+400)/20.0) AS BIGINT) cx, CAST(floor((y+350)/20.0) AS BIGINT) cy, CAST(floor((z-800)/20.0) AS BIGINT) cz, avg(x) x, avg(y) y, avg(z) z FROM pts GROUP BY frame, cx, cy, cz")
def f21_downsample(spark, sf_dir):
    return t.points(spark, sf_dir).groupBy("frame", *c.cells(20, "c")).agg(*[F.avg(a).alias(a) for a in "xyz"])


@query(f"""WITH {VOX}, p AS (SELECT frame, kx, ky, kz, CAST(sum(r-128) AS BIGINT) a, CAST(sum(g-128) AS BIGINT) b, CAST(sum(b-128) AS BIGINT) c, sum(r)/count(*) curvature FROM (SELECT *, {KEYS} FROM box) GROUP BY frame, kx, ky, kz)
SELECT frame, kx, ky, kz, round(a/sqrt(a*a+b*b+c*c), 9) nx, round(b/sqrt(a*a+b*b+c*c), 9) ny, round(c/sqrt(a*a+b*b+c*c), 9) nz, curvature FROM p WHERE a<>0 OR b<>0 OR c<>0""")
def a2_input_normals(spark, sf_dir):
    """Normals that come with points (here made of colours): summed and normalised for each voxel, curvature averaged."""
    g = box(spark, sf_dir).groupBy("frame", *c.cells()).agg(*[F.sum(F.col(s) - 128).alias(n) for s, n in zip("rgb", "abc", strict=True)], (F.sum("r") / F.count("*")).alias("curvature"))
    length = F.sqrt((F.col("a") * F.col("a") + F.col("b") * F.col("b") + F.col("c") * F.col("c")).cast("double"))
    return g.where("a <> 0 OR b <> 0 OR c <> 0").select(*KEY, *[F.round(F.col(s) / length, 9).alias(n) for s, n in zip("abc", ("nx", "ny", "nz"), strict=True)], "curvature")


#: Normals (nrm) of the voxels (vox) and their neighbours (edges): sums over two rings, the least eigenvalue of their covariance by its closed form, and the longest cross product of two rows.
NORMALS = """ring AS (SELECT frame, kx, ky, kz, kx nx, ky ny, kz nz FROM vox UNION ALL SELECT * FROM edges UNION ALL SELECT e.frame, e.kx, e.ky, e.kz, f.nx, f.ny, f.nz FROM edges e JOIN edges f ON f.frame=e.frame AND f.kx=e.nx AND f.ky=e.ny AND f.kz=e.nz),
flr AS (SELECT frame, kx, ky, kz, CAST(floor(x) AS BIGINT) x, CAST(floor(y) AS BIGINT) y, CAST(floor(z) AS BIGINT) z FROM vox),
mom AS (SELECT r.frame, r.kx, r.ky, r.kz, count(*) n, sum(x) sx, sum(y) sy, sum(z) sz, sum(x*x) xx, sum(x*y) xy, sum(x*z) xz, sum(y*y) yy, sum(y*z) yz, sum(z*z) zz FROM ring r JOIN flr w ON w.frame=r.frame AND w.kx=r.nx AND w.ky=r.ny AND w.kz=r.nz GROUP BY r.frame, r.kx, r.ky, r.kz),
cov AS (SELECT frame, kx, ky, kz, CAST(n*xx-sx*sx AS DOUBLE)/(n::DOUBLE*n) xx, CAST(n*xy-sx*sy AS DOUBLE)/(n::DOUBLE*n) xy, CAST(n*xz-sx*sz AS DOUBLE)/(n::DOUBLE*n) xz, CAST(n*yy-sy*sy AS DOUBLE)/(n::DOUBLE*n) yy, CAST(n*yz-sy*sz AS DOUBLE)/(n::DOUBLE*n) yz, CAST(n*zz-sz*sz AS DOUBLE)/(n::DOUBLE*n) zz FROM mom),
mid AS (SELECT *, (xx+yy+zz)/3 q FROM cov), par AS (SELECT *, xx-q a, yy-q b, zz-q c, sqrt(((xx-q)*(xx-q)+(yy-q)*(yy-q)+(zz-q)*(zz-q)+2*(xy*xy+xz*xz+yz*yz))/6) p FROM mid),
eig AS (SELECT *, q+2*p*cos(acos(CASE WHEN p>0 THEN greatest(least((a*(b*c-yz*yz)-xy*(xy*c-yz*xz)+xz*(xy*yz-b*xz))/(2*p*p*p), 1.0), -1.0) ELSE 1.0 END)/3+2*pi()/3) e FROM par),
crs AS (SELECT frame, kx, ky, kz, q, e, unnest([{'x': xy*yz-xz*(yy-e), 'y': xz*xy-(xx-e)*yz, 'z': (xx-e)*(yy-e)-xy*xy}, {'x': xy*(zz-e)-xz*yz, 'y': xz*xz-(xx-e)*(zz-e), 'z': (xx-e)*yz-xy*xz}, {'x': (yy-e)*(zz-e)-yz*yz, 'y': yz*xz-xy*(zz-e), 'z': xy*yz-(yy-e)*xz}]) v FROM eig),
lng AS (SELECT frame, kx, ky, kz, q, e, v.x vx, v.y vy, v.z vz, v.x*v.x+v.y*v.y+v.z*v.z len FROM crs QUALIFY row_number() OVER (PARTITION BY frame, kx, ky, kz ORDER BY v.x*v.x+v.y*v.y+v.z*v.z DESC, v.x DESC, v.y DESC, v.z DESC)=1),
twd AS (SELECT l.*, CASE WHEN vx*x+vy*y+vz*z>0 THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END s FROM lng l JOIN flr USING (frame, kx, ky, kz)),
nrm AS (SELECT frame, kx, ky, kz, CASE WHEN len>0 THEN vx*s/sqrt(len) ELSE 0.0 END nx, CASE WHEN len>0 THEN vy*s/sqrt(len) ELSE 0.0 END ny, CASE WHEN len>0 THEN vz*s/sqrt(len) ELSE 0.0 END nz, CASE WHEN q>0 THEN greatest(e, 0.0)/(3*q) ELSE 0.0 END curvature FROM twd)"""


@query(f"WITH {EDGES}, {NORMALS} SELECT frame, kx, ky, kz, round(nx, 6)+0.0 nx, round(ny, 6)+0.0 ny, round(nz, 6)+0.0 nz, round(curvature, 6)+0.0 curvature FROM nrm")
def a3_normals(spark, sf_dir):
    """Normals and curvature over two rings of neighbours."""
    n = _normals(spark, sf_dir)
    return n.select(*KEY, *[(F.round(x, 6) + 0.0).alias(x) for x in ("nx", "ny", "nz", "curvature")])


TILTED = EDGES.replace("pts AS", "flat AS", 1).replace("box AS (", "pts AS (SELECT * REPLACE (CASE WHEN z BETWEEN 1020 AND 1079 THEN z+(frame%2*2-1)*CAST(floor((x+205)/2.0) AS BIGINT) ELSE z END AS z) FROM flat), box AS (", 1)


@query(f"WITH {TILTED}, {NORMALS} SELECT a.frame, a.kx, a.ky, a.kz, 1-(a.nx*p.nx+a.ny*p.ny+a.nz*p.nz)>=0.2 AS changed FROM nrm a JOIN nrm p ON p.frame=a.frame-1 AND p.kx=a.kx AND p.ky=a.ky AND p.kz=a.kz")
def x5_change_flags(spark, sf_dir):
    """Voxels seen in a frame and the one before, whose normal turned by 0.2 or more of its cosine; one of the patches tilts to and fro."""
    tilt = (F.col("frame") % 2 * 2 - 1) * F.floor((F.col("x") + 205) / 2)
    p = spatial.crop(t.points(spark, sf_dir).withColumn("z", F.col("z") + F.when(F.col("z").between(1020, 1079), tilt).otherwise(0)))
    v = cut(spatial.voxels(p).select(*KEY, *[F.floor(a).alias(a) for a in "xyz"]))
    n = cut(surface.normals(spatial.two_ring_sums(v, spatial.adjacency(v)), v).drop("curvature"))
    before = n.select((F.col("frame") + 1).alias("frame"), "kx", "ky", "kz", *[F.col(x).alias(f"prev_{x}") for x in ("nx", "ny", "nz")])
    flag = c.changed([F.col(x) for x in ("nx", "ny", "nz")], [F.col(f"prev_{x}") for x in ("nx", "ny", "nz")])
    return n.join(before, KEY).select(*KEY, flag.alias("changed"))


@query(f"WITH {LABELS} SELECT l.frame, l.label, count(*) n, sum(l.x)/count(*) x, sum(l.y)/count(*) y, sum(l.z)/count(*) z FROM l JOIN q p ON p.frame=l.frame-1 AND p.kx=l.kx AND p.ky=l.ky AND p.kz=l.kz GROUP BY l.frame, l.label")
def a5_surviving_centroids(spark, sf_dir):
    """Means of each label's voxels that the frame before had too."""
    v = labelled(spark, sf_dir)
    before = v.select((F.col("frame") + 1).alias("frame"), "kx", "ky", "kz")
    return v.join(before, KEY, "left_semi").groupBy("frame", "label").agg(F.count("*").alias("n"), *[(F.sum(a) / F.count("*")).alias(a) for a in "xyz"])


#: Cells that the rays of rows {of} (with key) enter: the first step in each.
PATHS = """SELECT frame, kx, ky, kz, ox, oy, oz, 1+0.25::DOUBLE*min(i) distance FROM (SELECT r.frame, r.kx, r.ky, r.kz, i, CAST(round(r.kx+(10-r.kx)/norm*(1+0.25::DOUBLE*(i+1))) AS BIGINT) ox, CAST(round(r.ky+(8-r.ky)/norm*(1+0.25::DOUBLE*(i+1))) AS BIGINT) oy, CAST(round(r.kz+(-20-r.kz)/norm*(1+0.25::DOUBLE*(i+1))) AS BIGINT) oz
FROM (SELECT *, sqrt(CAST((10-kx)*(10-kx)+(8-ky)*(8-ky)+(-20-kz)*(-20-kz) AS DOUBLE)) norm FROM {of}) r, range(0, 400) w(i) WHERE i<greatest(1, floor(norm/0.25)) AND r.kz+(-20-r.kz)/norm*(1+0.25::DOUBLE*(i+1))>=-13) WHERE ox<>kx OR oy<>ky OR oz<>kz GROUP BY ALL"""
CROSSED = f"{CROSS}, {WHOLE}, l AS (SELECT *, {OWN} label FROM q)"
#: Gone voxels with the first occupied voxel on their ray to the camera.
RAYS = f"""{CROSSED}, gone AS (SELECT p.frame+1 frame, p.kx, p.ky, p.kz, p.label FROM l p WHERE p.frame<(SELECT max(frame) FROM q) AND NOT EXISTS (SELECT 1 FROM q WHERE q.frame=p.frame+1 AND q.kx=p.kx AND q.ky=p.ky AND q.kz=p.kz)),
occ AS (SELECT frame, kx, ky, kz FROM q UNION SELECT frame+1, kx, ky, kz FROM q), occ2 AS (SELECT o.frame, o.kx, o.ky, o.kz, NOT EXISTS (SELECT 1 FROM q WHERE q.frame=o.frame-1 AND q.kx=o.kx AND q.ky=o.ky AND q.kz=o.kz) is_new FROM occ o),
cell AS ({PATHS.format(of="gone")}),
hid AS (SELECT c.frame, c.kx, c.ky, c.kz, distance, ox, oy, oz FROM cell c JOIN occ2 o ON o.frame=c.frame AND o.kx=ox AND o.ky=oy AND o.kz=oz WHERE distance>2.5 OR is_new QUALIFY row_number() OVER (PARTITION BY c.frame, c.kx, c.ky, c.kz ORDER BY distance)=1)"""


def of_cells(v: DataFrame) -> DataFrame:
    """v with the number of the seed cell as label."""
    return v.withColumn("label", F.floor(F.col("kx") / 5) * 100 + F.floor(F.col("ky") / 5) * 10 + F.floor(F.col("kz") / 5))


def crossed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As labelled, of the cloud whose patches hide one another."""
    return of_cells(crossing(spark, sf_dir).select(*KEY, "n", *[F.floor(a).alias(a) for a in "xyzrgb"]))


def _gone_and_hidden(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    v = crossed(spark, sf_dir).select(*KEY, "label")
    most = v.agg(F.max("frame")).scalar()
    before = v.where(F.col("frame") < most).select((F.col("frame") + 1).alias("frame"), "kx", "ky", "kz", "label")
    gone = before.join(v.select(*KEY), KEY, "left_anti")
    marks = v.select(*KEY, F.lit(False).alias("was")).unionByName(before.select(*KEY, F.lit(True).alias("was")))
    occupied = marks.groupBy(*KEY).agg((~F.bool_or("was")).alias("is_new"))
    return gone, surface.occluders(gone, occupied)


@query(f"WITH {RAYS} SELECT frame, kx, ky, kz, distance, ox, oy, oz FROM hid")
def j9_occluders(spark, sf_dir):
    """For voxels gone since the frame before, what hides them from the camera."""
    return _gone_and_hidden(spark, sf_dir)[1]


@query(f"WITH {RAYS}, n AS (SELECT frame+1 frame, label, count(*) voxels FROM l WHERE frame<(SELECT max(frame) FROM q) GROUP BY ALL) SELECT n.frame, n.label, voxels, count(g.kx) gone, count(h.kx) hidden, count(h.kx)=voxels tracked FROM n LEFT JOIN gone g ON g.frame=n.frame AND g.label=n.label LEFT JOIN hid h ON h.frame=g.frame AND h.kx=g.kx AND h.ky=g.ky AND h.kz=g.kz GROUP BY n.frame, n.label, voxels")
def a7_hidden_per_label(spark, sf_dir):
    """Voxels of each label of the frame before, how many are gone and how many of those are hidden; a label with all hidden is tracked on."""
    gone, hid = _gone_and_hidden(spark, sf_dir)
    v = crossed(spark, sf_dir)
    n = v.where(F.col("frame") < v.agg(F.max("frame")).scalar()).groupBy((F.col("frame") + 1).alias("frame"), "label").agg(F.count("*").alias("voxels"))
    g = gone.join(hid.select(*KEY, "distance"), KEY, "left").groupBy("frame", "label").agg(F.count("*").alias("gone"), F.count("distance").alias("hidden"))
    zero = lambda x: F.coalesce(x, F.lit(0)).alias(x)
    return n.join(g, ["frame", "label"], "left").select("frame", "label", "voxels", zero("gone"), zero("hidden"), (F.coalesce("hidden", F.lit(0)) == F.col("voxels")).alias("tracked"))


@query(f"WITH {t.POINTS} SELECT frame, sum(x)/count(*) x, sum(y)/count(*) y, sum(z)/count(*) z FROM pts GROUP BY frame")
def a16_centroid(spark, sf_dir):
    return t.points(spark, sf_dir).groupBy("frame").agg(*[(F.sum(a) / F.count("*")).alias(a) for a in "xyz"])


@query(f"WITH {LABELS}, k AS (SELECT *, {KEYS} FROM pts) SELECT k.frame, pid, CAST(coalesce(label*2654435%16777216, 0) AS BIGINT) colour FROM k LEFT JOIN l USING (frame, kx, ky, kz)")
def j5_full_resolution_colours(spark, sf_dir):
    """Every point in the colour of its label; black outside. Colours come from a multiplicative hash, so any number of labels has them."""
    v = labelled(spark, sf_dir).select(*KEY, (F.col("label") * 2654435 % 16777216).alias("colour"))
    return t.points(spark, sf_dir).select("frame", "pid", *c.cells()).join(v, KEY, "left").select("frame", "pid", F.coalesce("colour", F.lit(0)).alias("colour"))


@query(f"WITH {LABELS} SELECT frame, kx, ky, kz, x, y, z, CAST(label*2654435%16777216 AS BIGINT) colour FROM l WHERE label%3<>0")
def v6_coloured_voxels(spark, sf_dir):
    """Labelled voxels (here without every third label) in the colours of their labels."""
    v = labelled(spark, sf_dir).where("label % 3 <> 0")
    return v.select(*KEY, *"xyz", (F.col("label") * 2654435 % 16777216).alias("colour"))


SEEDS = "s AS (SELECT frame, sx, sy, sz, kx, ky, kz, x, y, z, r, g, b FROM (SELECT *, CAST(floor((x+400)/200.0) AS BIGINT) sx, CAST(floor((y+350)/200.0) AS BIGINT) sy, CAST(floor((z-800)/200.0) AS BIGINT) sz FROM q) QUALIFY row_number() OVER (PARTITION BY frame, sx, sy, sz ORDER BY (x-(sx*200-300))*(x-(sx*200-300))+(y-(sy*200-250))*(y-(sy*200-250))+(z-(sz*200+900))*(z-(sz*200+900)), kx, ky, kz)=1)"


def _seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = whole(spark, sf_dir)
    return spatial.seeds(v).join(v.select(*KEY, "x", "y", "z"), KEY)


@query(f"WITH {LABELS}, {SEEDS} SELECT a.frame, a.sx, a.sy, a.sz, b.kx, b.ky, b.kz, {D2} d2 FROM (SELECT frame, sx, sy, sz, sx*200-300 x, sy*200-250 y, sz*200+900 z FROM s) a JOIN q b ON a.frame=b.frame QUALIFY row_number() OVER (PARTITION BY a.frame, a.sx, a.sy, a.sz ORDER BY {D2}, b.kx, b.ky, b.kz)=1")
def j6_nearest_voxel(spark, sf_dir):
    """The voxel nearest to each occupied seed cell's centre, wherever it lies."""
    s = _seeds(spark, sf_dir).select("frame", F.struct("sx", "sy", "sz").alias("pid"), *[(F.col(f"s{a}") * c.SEED + c.SEED // 2 + c.ORIGIN[a]).alias(a) for a in "xyz"])
    to = whole(spark, sf_dir).select("frame", F.struct("kx", "ky", "kz").alias("pid"), "x", "y", "z")
    return surface.nearest(s, to, 1, 100).select("frame", "pid.*", "o_pid.*", "d2")


@query(f"WITH {LABELS}, {SEEDS} SELECT a.frame, a.kx, a.ky, a.kz, b.kx ox, b.ky oy, b.kz oz, {D2} d2 FROM s a JOIN q b ON a.frame=b.frame AND {D2}<={NEAR * NEAR}")
def j7_radius_search(spark, sf_dir):
    v = whole(spark, sf_dir).select(*KEY, "x", "y", "z")
    near = spatial.radius_pairs(_seeds(spark, sf_dir).select(*KEY, "x", "y", "z"), v, NEAR)
    return near.select(*KEY, *[F.col(f"o_k{a}").alias(f"o{a}") for a in "xyz"], "d2")


@query(f"WITH {LABELS} SELECT DISTINCT e.frame, e.kx, e.ky, e.kz FROM edges e WHERE e.frame>0 AND EXISTS (SELECT 1 FROM q p WHERE p.frame=e.frame-1 AND p.kx=e.kx AND p.ky=e.ky AND p.kz=e.kz) AND NOT EXISTS (SELECT 1 FROM q p WHERE p.frame=e.frame-1 AND p.kx=e.nx AND p.ky=e.ny AND p.kz=e.nz)")
def j10_new_neighbours(spark, sf_dir):
    """Old voxels that touch a new one."""
    v = voxels(spark, sf_dir).select(*KEY)
    before = v.select((F.col("frame") + 1).alias("frame"), "kx", "ky", "kz")
    new = v.where("frame > 0").join(before, KEY, "left_anti").select("frame", *[F.col(f"k{a}").alias(f"n{a}") for a in "xyz"])
    e = spatial.adjacency(v).join(new, ["frame", "nx", "ny", "nz"], "left_semi")
    return e.select(*KEY).distinct().join(before, KEY, "left_semi")


@query(f"WITH {LABELS}, kept AS (SELECT * FROM l WHERE label%3<>0) SELECT e.* FROM edges e JOIN kept a ON a.frame=e.frame AND a.kx=e.kx AND a.ky=e.ky AND a.kz=e.kz JOIN kept b ON b.frame=e.frame AND b.kx=e.nx AND b.ky=e.ny AND b.kz=e.nz")
def j12_labels_deleted(spark, sf_dir):
    """Edges that stay when labels (here every third) are deleted with their voxels. Keys are dropped before edges form, so none dangles."""
    v = labelled(spark, sf_dir)
    matched = v.select("frame", "label").where("label % 3 = 0").distinct()
    return spatial.adjacency(v.join(matched, ["frame", "label"], "left_anti"))


@query(f"""WITH {LABELS}, m AS (SELECT frame, label, sum(x)/count(*) x, sum(y)/count(*) y, sum(z)/count(*) z FROM l GROUP BY frame, label), e2 AS (SELECT DISTINCT e.frame, a.label, b.label neighbor FROM edges e JOIN l a ON a.frame=e.frame AND a.kx=e.kx AND a.ky=e.ky AND a.kz=e.kz JOIN l b ON b.frame=e.frame AND b.kx=e.nx AND b.ky=e.ny AND b.kz=e.nz WHERE a.label<>b.label)
SELECT e2.*, m.x, m.y, m.z FROM e2 JOIN m ON m.frame=e2.frame AND m.label=e2.neighbor""")
def j16_neighbour_centres(spark, sf_dir):
    """Centres of the clusters around each cluster."""
    v = labelled(spark, sf_dir)
    there = v.select("frame", *[F.col(f"k{a}").alias(f"n{a}") for a in "xyz"], F.col("label").alias("neighbor"))
    pairs = spatial.adjacency(v).join(v.select(*KEY, "label"), KEY).join(there, ["frame", "nx", "ny", "nz"]).where("label <> neighbor").select("frame", "label", "neighbor").distinct()
    mean = v.groupBy("frame", F.col("label").alias("neighbor")).agg(*[(F.sum(a) / F.count("*")).alias(a) for a in "xyz"])
    return pairs.join(mean, ["frame", "neighbor"])


DESC = "d AS (SELECT label, vec_id kp_id, list_transform(embedding[1:36], lambda e: CAST(round(CAST(e AS DOUBLE)*1000000) AS BIGINT)) v FROM embeddings), p AS (SELECT a.label, a.kp_id q, b.kp_id t, CAST(list_sum(list_transform(list_zip(a.v, b.v), lambda z: abs(z[1]-z[2]))) AS BIGINT) dist FROM d a JOIN d b ON a.label=b.label AND a.kp_id%2=0 AND b.kp_id%2=1), near AS (SELECT *, row_number() OVER (PARTITION BY label, q ORDER BY dist, t) rank FROM p QUALIFY rank<=3)"
RANKS = f"""{DESC}, r1 AS (SELECT * FROM near WHERE rank=1 QUALIFY row_number() OVER (PARTITION BY label, t ORDER BY dist, q)=1),
r2 AS (SELECT * FROM near n WHERE rank=2 AND NOT EXISTS (SELECT 1 FROM r1 WHERE r1.label=n.label AND r1.q=n.q) QUALIFY row_number() OVER (PARTITION BY label, t ORDER BY dist, q)=1),
r3 AS (SELECT * FROM near n WHERE rank=3 AND NOT EXISTS (SELECT 1 FROM r1 WHERE r1.label=n.label AND r1.q=n.q) AND NOT EXISTS (SELECT 1 FROM r2 WHERE r2.label=n.label AND r2.q=n.q) QUALIFY row_number() OVER (PARTITION BY label, t ORDER BY dist, q)=1)"""
THRESHOLD = 3_600_000


def _near(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    d = t.descriptors(spark, sf_dir)
    return matching.l1_nearest(d.where("kp_id % 2 = 0"), d.where("kp_id % 2 = 1"), k)


@query(f"WITH {DESC} SELECT label, q, t, dist FROM near WHERE rank=1 AND dist>0 AND dist<{THRESHOLD}")
def j17_inliers(spark, sf_dir):
    """Even keypoints and their nearest odd one of the same label, where that is near enough."""
    return _near(spark, sf_dir, 1).where(f"dist > 0 AND dist < {THRESHOLD}").select("label", "q", "t", "dist")


@query(f"WITH {RANKS} SELECT label, q, t, dist, rank FROM (SELECT * FROM r1 UNION ALL SELECT * FROM r2 UNION ALL SELECT * FROM r3)")
def j18_greedy_ranks(spark, sf_dir):
    return matching.greedy_ranks(_near(spark, sf_dir, 3), 3)


@query(f"WITH {DESC}, i AS (SELECT * FROM near WHERE rank=1 AND dist>0 AND dist<{THRESHOLD}) SELECT label, kp_id FROM d WHERE kp_id%2=1 AND kp_id NOT IN (SELECT t FROM i)")
def j19_used_inliers_removed(spark, sf_dir):
    used = j17_inliers(spark, sf_dir).select(F.col("t").alias("kp_id"))
    return t.descriptors(spark, sf_dir).where("kp_id % 2 = 1").join(used, "kp_id", "left_anti").select("label", "kp_id")


@query(f"""WITH {DESC}, s AS (SELECT label, count(*) size, CAST(count(*) FILTER (dist>0 AND dist<{THRESHOLD}) AS BIGINT) inliers, coalesce(sum(dist) FILTER (dist>0 AND dist<{THRESHOLD})/count(*) FILTER (dist>0 AND dist<{THRESHOLD}), 3.4028234663852886e38) error FROM near WHERE rank=1 GROUP BY label)
SELECT label, size, inliers, error, inliers//size+3*({THRESHOLD}-error)/{THRESHOLD} score FROM s""")
def t6_scores(spark, sf_dir):
    """Mean error of inliers and the score made of it, for each label."""
    return matching.scores(_near(spark, sf_dir, 1), THRESHOLD)


@query(f"WITH {t.POINTS} SELECT DISTINCT frame, 0.0::DOUBLE r00, -1.0::DOUBLE r01, 1.0::DOUBLE r10, 1.0::DOUBLE r22, 10.0::DOUBLE tx, -20.0::DOUBLE ty, 5.0::DOUBLE tz FROM pts")
def t4_rigid_transform(spark, sf_dir):
    """Recovers, for each frame, a quarter turn and a shift from points and their moved places."""
    moved = c.transformed([0, -1, 0, 10, 1, 0, 0, -20, 0, 0, 1, 5], F.col("x"), F.col("y"), F.col("z"))
    p = t.points(spark, sf_dir).select("frame", "x", "y", "z", *[m.alias(f"o_{a}") for m, a in zip(moved, "xyz", strict=True)])
    return matching.rigid(p, "frame").select("frame", *[(F.round(x, 6) + 0.0).alias(x) for x in ("r00", "r01", "r10", "r22", "tx", "ty", "tz")])


#: Where labels of the frame before (here those that `some` picks) are expected: matched ones moved as a whole, the others at the mean of what is left.
EXPECTED = """b4 AS (SELECT a.frame, a.label, floor(sum(a.x)/count(*)) x, floor(sum(a.y)/count(*)) y, floor(sum(a.z)/count(*)) z FROM (SELECT l.frame+1 frame, l.label, q.x, q.y, q.z FROM l JOIN q ON q.frame=l.frame+1 AND q.kx=l.kx AND q.ky=l.ky AND q.kz=l.kz WHERE {some}) a GROUP BY a.frame, a.label)"""
NEAREST = "SELECT a.frame, a.label, b.kx, b.ky, b.kz FROM {at} a JOIN q b ON a.frame=b.frame QUALIFY row_number() OVER (PARTITION BY a.frame, a.label ORDER BY {d2}, b.kx, b.ky, b.kz)=1"
CARRIED = f"{EXPECTED.format(some='l.label%3=1')}, c1 AS ({NEAREST.format(at='b4', d2=D2)})"


def _carried(spark: SparkSession, sf_dir: str, some: str = "true", moved: DataFrame | None = None) -> DataFrame:
    v = labelled(spark, sf_dir)
    return growth.carried(v.where(some).select((F.col("frame") + 1).alias("frame"), "kx", "ky", "kz", "label"), v, moved)


@query(f"""WITH {LABELS}, {EXPECTED.format(some='true')}, m AS (SELECT l.frame+1 frame, label, -(sum(y)/count(*))+10 x, sum(x)/count(*)-20 y, sum(z)/count(*)+5 z FROM l WHERE label%4=2 AND frame<(SELECT max(frame) FROM l) GROUP BY l.frame, label),
at_ AS (SELECT frame, label, x, y, z FROM m UNION ALL SELECT frame, label, x, y, z FROM b4 WHERE label%4<>2) {NEAREST.format(at='at_', d2=D2)}""")
def g1_carried_seeds(spark, sf_dir):
    """Seeds of the labels of the frame before: every fourth label is taken as matched, with a quarter turn and a shift as its transform; the others stay where what is left of them is."""
    v = labelled(spark, sf_dir)
    centre = v.where(F.col("frame") < v.agg(F.max("frame")).scalar()).where("label % 4 = 2").groupBy((F.col("frame") + 1).alias("frame"), "label").agg(*[(F.sum(a) / F.count("*")).alias(a) for a in "xyz"])
    place = c.transformed([0, -1, 0, 10, 1, 0, 0, -20, 0, 0, 1, 5], F.col("x"), F.col("y"), F.col("z"))
    moved = centre.select("frame", "label", *[p.alias(a) for p, a in zip(place, "xyz", strict=True)])
    return _carried(spark, sf_dir, "true", moved)


@query(f"WITH {LABELS}, {CARRIED}, was AS (SELECT frame+1 frame, label, sum(x)/count(*) px, sum(y)/count(*) py, sum(z)/count(*) pz FROM l GROUP BY frame, label) SELECT c1.frame, c1.label, px, py, pz, q.x, q.y, q.z FROM c1 JOIN was USING (frame, label) JOIN q USING (frame, kx, ky, kz)")
def v11_motion_lines(spark, sf_dir):
    """From the old centre of each carried label (here every third) to its seed in the next frame."""
    v = labelled(spark, sf_dir)
    was = v.groupBy((F.col("frame") + 1).alias("frame"), "label").agg(*[(F.sum(a) / F.count("*")).alias(f"p{a}") for a in "xyz"])
    return _carried(spark, sf_dir, "label % 3 = 1").join(was, ["frame", "label"]).join(v.select(*KEY, *"xyz"), KEY).select("frame", "label", "px", "py", "pz", *"xyz")


PRUNED = f"{SEEDS}, g AS (SELECT a.frame, a.sx, a.sy, a.sz, a.kx, a.ky, a.kz, count(*) near FROM s a JOIN q b ON a.frame=b.frame AND {D2}<={NEAR * NEAR} GROUP BY a.frame, a.sx, a.sy, a.sz, a.kx, a.ky, a.kz HAVING count(*)>{LEAST})"


@query(f"WITH {LABELS}, {SEEDS}, {PRUNED.replace(SEEDS + ', ', '')}, {CARRIED}, had AS (SELECT c1.frame, q.x, q.y, q.z FROM c1 JOIN q USING (frame, kx, ky, kz)) SELECT * FROM g WHERE NOT EXISTS (SELECT 1 FROM had b JOIN q a ON a.frame=b.frame AND {D2}<={NEAR * NEAR} WHERE a.frame=g.frame AND a.kx=g.kx AND a.ky=g.ky AND a.kz=g.kz)")
def g3_pruned_seeds(spark, sf_dir):
    """New seeds with enough voxels around them and no carried seed in reach; here every third label of the frame before is carried."""
    v = whole(spark, sf_dir)
    had = _carried(spark, sf_dir, "label % 3 = 1").join(v.select(*KEY, "x", "y", "z"), KEY)
    return growth.pruned(_seeds(spark, sf_dir), v, NEAR, LEAST, had).select("frame", "sx", "sy", "sz", "kx", "ky", "kz", "near")


def _rounds(own: str = "own", label: str = "g.label", seeds: str = "(SELECT *, row_number() OVER (PARTITION BY frame ORDER BY sx, sy, sz) label FROM g)") -> str:
    """CTEs own0 to ownN, one for each round of growth; normals are all (0, 0, 1) here, so only sums of whole numbers enter."""
    f = "xyzrgb"
    out = f"{own}0 AS MATERIALIZED (SELECT q.*, {label}, CAST(NULL AS DOUBLE) d FROM q LEFT JOIN {seeds} g USING (frame, kx, ky, kz))"
    for i in range(ROUNDS):
        mean = ", ".join(f"0.0::DOUBLE {a}" if i == 0 else f"sum({a})/count(*) {a}" for a in f)
        rgb, xyz = ("+".join(f"(a.{x}-m.{x})*(a.{x}-m.{x})" for x in n) for n in ("rgb", "xyz"))
        out += f""", {own}_m{i} AS (SELECT frame, label, {mean} FROM {own}{i} WHERE label IS NOT NULL GROUP BY frame, label),
{own}_ask{i} AS (SELECT DISTINCT e.frame, e.nx kx, e.ny ky, e.nz kz, o.label FROM {own}{i} o JOIN edges e USING (frame, kx, ky, kz) WHERE o.label IS NOT NULL),
{own}_best{i} AS (SELECT a.frame, a.kx, a.ky, a.kz, m.label, {1.0 if i == 0 else 0.0}::DOUBLE+sqrt({rgb})/255*0.2::DOUBLE+sqrt({xyz})/200*0.4::DOUBLE dist FROM {own}_ask{i} k JOIN {own}{i} a USING (frame, kx, ky, kz) JOIN {own}_m{i} m ON m.frame=k.frame AND m.label=k.label WHERE a.label IS NULL OR a.label<>k.label QUALIFY row_number() OVER (PARTITION BY a.frame, a.kx, a.ky, a.kz ORDER BY dist, m.label)=1),
{own}{i + 1} AS MATERIALIZED (SELECT o.* REPLACE (CASE WHEN b.dist<coalesce(o.d, 'inf'::DOUBLE) THEN b.label ELSE o.label END AS label, CASE WHEN b.dist<coalesce(o.d, 'inf'::DOUBLE) THEN b.dist ELSE o.d END AS d) FROM {own}{i} o LEFT JOIN {own}_best{i} b USING (frame, kx, ky, kz))"""
    return out


GROWN = f"{LABELS}, {PRUNED}, {_rounds()}"


def _grown(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = cut(whole(spark, sf_dir))
    w = Window.partitionBy("frame").orderBy("sx", "sy", "sz")
    seeds = growth.pruned(spatial.seeds(v).join(v.select(*KEY, "x", "y", "z"), KEY), v, NEAR, LEAST).withColumn("label", F.row_number().over(w).cast("long"))
    flat = v.withColumn("nx", F.lit(0.0)).withColumn("ny", F.lit(0.0)).withColumn("nz", F.lit(1.0)).drop("n")
    return growth.grow(flat, spatial.adjacency(v), seeds, ROUNDS)


@query(f"WITH {GROWN} SELECT frame, kx, ky, kz, label, round(d, 6) d FROM own{ROUNDS} WHERE label IS NOT NULL")
def g6_grown_clusters(spark, sf_dir):
    """Clusters grown from pruned seeds, with equal normals: owner and distance of each voxel reached."""
    return _grown(spark, sf_dir).where("label IS NOT NULL").select(*KEY, "label", F.round("d", 6).alias("d"))


@query(f"WITH {GROWN} SELECT frame, label, count(*) n, sum(x)/count(*) x, sum(y)/count(*) y, sum(z)/count(*) z, sum(r)/count(*) r, sum(g)/count(*) g, sum(b)/count(*) b FROM own{ROUNDS} WHERE label IS NOT NULL GROUP BY frame, label")
def a4_cluster_centroids(spark, sf_dir):
    return growth.centroids(_grown(spark, sf_dir)).drop("nx", "ny", "nz")


@query(f"WITH {GROWN} SELECT frame, label, list((kx*10000+ky*100+kz) ORDER BY kx*10000+ky*100+kz)::VARCHAR voxels FROM own{ROUNDS} WHERE label IS NOT NULL GROUP BY frame, label")
def g8_cluster_voxels(spark, sf_dir):
    """The keys of each cluster's voxels, in order."""
    k = F.col("kx") * 10000 + F.col("ky") * 100 + F.col("kz")
    g = _grown(spark, sf_dir).where("label IS NOT NULL").groupBy("frame", "label").agg(F.sort_array(F.collect_list(k)).alias("k"))
    return g.select("frame", "label", F.concat(F.lit("["), F.array_join(F.col("k").cast("array<string>"), ", "), F.lit("]")).alias("voxels"))


#: Grown anew from the voxels nearest to the clusters' centres.
REFINED = f"""{GROWN}, mid AS (SELECT frame, label, sum(x)/count(*) x, sum(y)/count(*) y, sum(z)/count(*) z FROM own{ROUNDS} WHERE label IS NOT NULL GROUP BY frame, label),
core AS (SELECT a.frame, a.label, b.kx, b.ky, b.kz FROM mid a JOIN q b ON a.frame=b.frame QUALIFY row_number() OVER (PARTITION BY a.frame, a.label ORDER BY {D2}, b.kx, b.ky, b.kz)=1),
{_rounds("ref", "g.label", "(SELECT frame, kx, ky, kz, min(label) label FROM core GROUP BY frame, kx, ky, kz)")}"""


@query(f"WITH {REFINED} SELECT frame, kx, ky, kz, label, round(d, 6) d FROM ref{ROUNDS} WHERE label IS NOT NULL")
def g9_refined_clusters(spark, sf_dir):
    """Clusters grown anew from the middles of those of g6."""
    v = cut(whole(spark, sf_dir))
    own = cut(_grown(spark, sf_dir))
    return growth.refined(own, spatial.adjacency(v), ROUNDS).where("label IS NOT NULL").select(*KEY, "label", F.round("d", 6).alias("d"))


FRAMES, TURNED = 7, 12


def _states() -> str:
    """CTEs s0 to s6, the state after each frame; a voxel counts as changed where its mean red is TURNED away from the last one."""
    old = "kx, ky, kz, x, y, z, r, g, b, first_frame, seen_frame, occluded_frame, label"
    out = f"s0 AS MATERIALIZED (SELECT kx, ky, kz, x, y, z, r, g, b, NULL::DOUBLE prev_r, 0 first_frame, 0 seen_frame, NULL::BIGINT occluded_frame, {OWN} label, false changed FROM vox WHERE frame=0)"
    for f in range(1, FRAMES):
        now = ", ".join(f"n.{a} now_{a}" for a in "xyzrgb")
        out += f""", b{f} AS MATERIALIZED (SELECT {f}::BIGINT frame, {old}, n.here IS NOT NULL here, s.first_frame IS NOT NULL old, now_x, now_y, now_z, now_r, now_g, now_b FROM (SELECT {old} FROM s{f - 1}) s FULL JOIN (SELECT kx, ky, kz, {now}, true here FROM vox n WHERE frame={f}) n USING (kx, ky, kz)),
e{f} AS (SELECT a.kx, a.ky, a.kz, count(*) near, bool_or(NOT o.old) new_near FROM b{f} a JOIN b{f} o ON abs(a.kx-o.kx)<=1 AND abs(a.ky-o.ky)<=1 AND abs(a.kz-o.kz)<=1 AND (a.kx<>o.kx OR a.ky<>o.ky OR a.kz<>o.kz) GROUP BY a.kx, a.ky, a.kz),
u{f} AS (SELECT frame, kx, ky, kz FROM b{f} WHERE old AND NOT here), c{f} AS ({PATHS.format(of=f"u{f}")}),
h{f} AS (SELECT c.kx, c.ky, c.kz, distance, CASE WHEN o.here THEN 0 ELSE coalesce(o.occluded_frame, 0) END other FROM c{f} c JOIN b{f} o ON o.kx=ox AND o.ky=oy AND o.kz=oz WHERE distance>2.5 OR NOT o.old QUALIFY row_number() OVER (PARTITION BY c.kx, c.ky, c.kz ORDER BY distance)=1),
k{f} AS (SELECT kx, ky, kz, {", ".join(f"coalesce(now_{a}, {a}) {a}" for a in "xyzrgb")}, r prev_r, coalesce(first_frame, {f}) first_frame, CASE WHEN here THEN {f} ELSE seen_frame END seen_frame, CASE WHEN here THEN NULL ELSE coalesce(occluded_frame, {f}) END occluded_frame, label, coalesce(here AND old AND abs(now_r-r)>={TURNED}, false) changed
FROM b{f} LEFT JOIN e{f} USING (kx, ky, kz) LEFT JOIN h{f} USING (kx, ky, kz) WHERE NOT old OR (coalesce(near, 0)>1 AND (here OR coalesce(distance>4 AND NOT (coalesce(new_near, false) AND coalesce(occluded_frame, 0)<>other), false)))),
v{f} AS (SELECT label, sum(CASE WHEN changed THEN -1 ELSE 1 END) votes FROM k{f} WHERE label IS NOT NULL GROUP BY label),
s{f} AS MATERIALIZED (SELECT k.* REPLACE (CASE WHEN NOT changed AND votes>=3 THEN k.label END AS label) FROM k{f} k LEFT JOIN v{f} v ON v.label=k.label)"""
    return out


@query(f"WITH {CROSS}, {_states()} SELECT kx, ky, kz, x, r, prev_r, CAST(first_frame AS BIGINT) first_frame, CAST(seen_frame AS BIGINT) seen_frame, CAST(occluded_frame AS BIGINT) occluded_frame, label, changed FROM s{FRAMES - 1}")
def x2_voxel_state(spark, sf_dir):
    """Voxels after the last frame, inserted, updated, kept while hidden or deleted frame by frame, with when they were first and last seen or hidden, and which of the first frame's labels they still have."""
    v = cut(crossing(spark, sf_dir))
    labels = of_cells(v.where(F.col("frame") == v.agg(F.min("frame")).scalar())).select(*voxel_state.AT, "label")
    turned = lambda: F.abs(F.col("r") - F.col("prev_r")) >= TURNED
    state = voxel_state.fold(spark, v, None, labels, turned)
    return state.select(*voxel_state.AT, "x", "r", "prev_r", "first_frame", "seen_frame", "occluded_frame", "label", "changed")


@query(f"WITH {t.MOVES} SELECT frame, label, true moving FROM moves UNION ALL SELECT frame, label, false FROM resets")
def w8_union(spark, sf_dir):
    """Moving parts and parts to reset in one table."""
    return t.moves(spark, sf_dir).withColumn("moving", F.lit(True)).unionByName(t.resets(spark, sf_dir).withColumn("moving", F.lit(False)))


@query(f"WITH {LABELS}, prev AS (SELECT frame+1 frame, kx, ky, kz, label FROM l) SELECT frame, kx, ky, kz, label FROM prev WHERE frame<=(SELECT max(frame) FROM l) AND EXISTS (SELECT 1 FROM l WHERE l.frame=prev.frame AND l.kx=prev.kx AND l.ky=prev.ky AND l.kz=prev.kz)")
def x6_labels_persist(spark, sf_dir):
    """Labels of the frame before on voxels that are still there."""
    v = labelled(spark, sf_dir)
    return v.select((F.col("frame") + 1).alias("frame"), "kx", "ky", "kz", "label").join(v.select(*KEY), KEY, "left_semi")
