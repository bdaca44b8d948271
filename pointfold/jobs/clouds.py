"""Queries over clouds, voxels and parts that move, by operator."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from pointfold.functions import columns as c
from pointfold.jobs.base import COUNTERS, EDGES, KEYS, VOX, box, query, shared, voxels
from pointfold.operators import comovement, forest, matching, spatial
from pointfold.operators.cut import cut, folder
from pointfold.sources import pcd, pcd_source, report
from pointfold.sources import tables as t
from pointfold.streaming import counters as by_pair


@query(f"WITH {t.POINTS} SELECT i, frame, count(*) n FROM pts JOIN range(0, 20) q(i) ON i % 7 = frame GROUP BY i, frame")
def s3_cyclic_replay(spark, sf_dir):
    """Frame i of the replay is stored frame i modulo 7."""
    n = t.points(spark, sf_dir).groupBy("frame").agg(F.count("*").alias("n"))
    steps = spark.range(20).select(F.col("id").alias("i"), (F.col("id") % 7).alias("frame"))
    return steps.join(n, "frame").select("i", "frame", "n")


@query("""SELECT u, v, CASE WHEN depth<>0 THEN CAST((u-20)*depth AS DOUBLE)/525000.0 END x, CASE WHEN depth<>0 THEN CAST((25-v)*depth AS DOUBLE)/525000.0 END y, CASE WHEN depth<>0 THEN depth/1000.0::DOUBLE END z
FROM (SELECT p_partkey%40 u, CAST(floor(p_partkey/40.0) AS BIGINT) v, CASE WHEN p_size%7=0 THEN 0 ELSE 800+p_size*10 END depth FROM part)""")
def s5_back_projection(spark, sf_dir):
    p = t.pixels(spark, sf_dir)
    ok = F.col("depth") != 0
    x, y = ((F.col("u") - 20) * F.col("depth")).cast("double") / 525000, ((25 - F.col("v")) * F.col("depth")).cast("double") / 525000
    return p.select("u", "v", F.when(ok, x).alias("x"), F.when(ok, y).alias("y"), F.when(ok, F.col("depth") / 1000).alias("z"))


@query(f"WITH {t.POINTS} SELECT CAST(frame AS VARCHAR) file, CAST(x AS DOUBLE) x, CAST(y AS DOUBLE) y, CASE WHEN z%7<>0 THEN CAST(z AS DOUBLE) END z, CAST(r*65536+g*256+b AS DOUBLE) rgb FROM pts")
def s4_cloud_text(spark, sf_dir):
    """The points written as text, a cloud for each frame (some depths as nan, odd frames with their fields in another order), and read back."""
    p = t.points(spark, sf_dir).withColumn("file", F.col("frame").cast("string"))
    rgb = F.col("r") * 65536 + F.col("g") * 256 + F.col("b")
    z = F.when(F.col("z") % 7 == 0, "nan").otherwise(F.col("z").cast("string"))
    odd = F.col("frame") % 2 == 1
    data = p.select("file", F.when(odd, F.concat_ws(" ", z, "x", "y", rgb)).otherwise(F.concat_ws(" ", "x", "y", z, rgb)).alias("value"))
    fields = F.when(odd, "FIELDS z x y rgb").otherwise("FIELDS x y z rgb")
    head = p.select("file", "frame").distinct().select("file", F.explode(F.array(F.lit("# cloud"), F.lit("VERSION .7"), fields, F.lit("WIDTH 1"), F.lit("DATA ascii"))).alias("value"))
    return pcd.parsed(head.union(data), ["x", "y", "z", "rgb"])


@query(f"WITH {t.POINTS} SELECT frame, pid, CAST(x AS DOUBLE) x, CAST(y AS FLOAT) y, z, CAST(r AS INTEGER) r, g, b, CAST(nz AS VARCHAR) pair FROM (SELECT *, x*1000+y nz FROM pts)")
def s4_cloud_files(spark, sf_dir):
    """The points written to files, frame by frame as text, as records or as compressed columns, and read back from all of them; x, y and a field of two numbers among their columns."""
    p = t.points(spark, sf_dir).select("frame", "pid", F.col("x").cast("double").alias("x"), F.col("y").cast("float").alias("y"), "z", F.col("r").cast("int").alias("r"), "g", "b", F.array("x", "y").alias("at"))
    spark.dataSource.register(pcd_source.PointClouds)
    path = folder(spark, "clouds")
    p = cut(p)
    for i, encoding in enumerate(("ascii", "binary", "binary_compressed")):
        p.where(F.col("frame") % 3 == i).write.format("pointcloud").option("encoding", encoding).mode("append").save(path)
    back = spark.read.format("pointcloud").load(path)
    return back.select("frame", "pid", "x", "y", "z", "r", "g", "b", (F.col("at")[0] * 1000 + F.col("at")[1]).cast("string").alias("pair"))


@query(f"WITH {t.MOVES} SELECT frame, string_agg(CAST(label AS VARCHAR) || ';', '' ORDER BY label) || ',' || count(*) || ',' line FROM moves GROUP BY frame UNION ALL SELECT -1, 'lost_labels,total,'")
def s6_csv_rows(spark, sf_dir):
    """Lines of a report: a header, then for each frame its labels, each with a semicolon, and their number."""
    return report.lines(t.moves(spark, sf_dir))


@query(f"WITH {t.POINTS} SELECT * FROM pts WHERE x BETWEEN -400 AND 400 AND y BETWEEN -350 AND 250 AND z BETWEEN 800 AND 1300")
def f1_crop_box(spark, sf_dir):
    return box(spark, sf_dir)


@query(f"WITH {t.POINTS} SELECT frame, pid, z FROM pts WHERE z BETWEEN 900 AND 1000")
def f2_pass_through(spark, sf_dir):
    return t.points(spark, sf_dir).where(F.col("z").between(900, 1000)).select("frame", "pid", "z")


@query("SELECT vec_id, label FROM embeddings WHERE isfinite(embedding[1]) AND isfinite(embedding[2]) AND isfinite(embedding[3])")
def f3_finite(spark, sf_dir):
    e = t.read(spark, sf_dir, "embeddings")
    for i in range(3):
        x = F.col("embedding")[i]
        e = e.where(~F.isnan(x) & (F.abs(x) < float("inf")))
    return e.select("vec_id", "label")


@query(f"""WITH {VOX}, q AS (SELECT frame, kx, ky, kz, CAST(floor(x) AS BIGINT) x, CAST(floor(y) AS BIGINT) y, CAST(floor(z) AS BIGINT) z FROM vox)
SELECT a.frame, a.kx, a.ky, a.kz, count(*) neighbours FROM q a JOIN q b ON a.frame=b.frame AND (a.kx<>b.kx OR a.ky<>b.ky OR a.kz<>b.kz) AND (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z)<=6400 GROUP BY ALL HAVING count(*)>=10""")
def f4_radius_outliers(spark, sf_dir):
    """Voxels with ten others within two voxel sizes."""
    v = voxels(spark, sf_dir).select(*spatial.KEY, *[F.floor(a).alias(a) for a in "xyz"]).withColumn("pid", F.struct("kx", "ky", "kz"))
    return spatial.without_outliers(v, 80, 10).select(*spatial.KEY, "neighbours")


@query(f"WITH {VOX} SELECT frame, pid FROM pts WHERE pid NOT IN (SELECT pid FROM box)")
def f6_negative_extraction(spark, sf_dir):
    p = t.points(spark, sf_dir)
    return p.join(box(spark, sf_dir).select("pid"), "pid", "left_anti").select("frame", "pid")


@query(f"WITH {t.POINTS} SELECT frame, pid, CAST(x AS DOUBLE)/z x, CAST(y AS DOUBLE)/z y, ln(z) z FROM pts")
def f9_camera_transform(spark, sf_dir):
    p = t.points(spark, sf_dir)
    return p.select("frame", "pid", (F.col("x") / F.col("z")).alias("x"), (F.col("y") / F.col("z")).alias("y"), F.ln("z").alias("z"))


@query(f"WITH {t.POINTS} SELECT frame, least(min(x),0) min_x, greatest(max(x),0) max_x, least(min(y),0) min_y, greatest(max(y),0) max_y, least(min(z),0) min_z, greatest(max(z),0) max_z FROM pts GROUP BY frame")
def f12_bounding_box(spark, sf_dir):
    """Of each frame's points and the camera's origin."""
    ends = [f(g(a), F.lit(0)).alias(f"{n}_{a}") for a in "xyz" for n, f, g in (("min", F.least, F.min), ("max", F.greatest, F.max))]
    return t.points(spark, sf_dir).groupBy("frame").agg(*ends)


@query("""WITH p AS (SELECT p_partkey, (p_partkey*3)%256 r, (p_partkey*7)%256 g, (p_partkey*11)%256 b FROM part),
q AS (SELECT *, (0.412453::DOUBLE*r+0.357580::DOUBLE*g+0.180423::DOUBLE*b)/95.047::DOUBLE x, (0.212671::DOUBLE*r+0.715160::DOUBLE*g+0.072169::DOUBLE*b)/100.0::DOUBLE y, (0.019334::DOUBLE*r+0.119193::DOUBLE*g+0.950227::DOUBLE*b)/108.883::DOUBLE z FROM p),
w AS (SELECT *, CASE WHEN x>0.008856 THEN pow(x,0.3333) ELSE 7.787*x+0.138 END fx, CASE WHEN y>0.008856 THEN pow(y,0.3333) ELSE 7.787*y+0.138 END fy, CASE WHEN z>0.008856 THEN pow(z,0.3333) ELSE 7.787*z+0.138 END fz FROM q)
SELECT p_partkey, round(least(116*fy-16,100)/100,6) l, round(least(greatest(500*(fx-fy),-300),300)/300,6) a, round(least(200*(fy-fz),300)/300,6) b2 FROM w""")
def f13_colour_to_lab(spark, sf_dir):
    k = F.col("p_partkey")
    p = t.read(spark, sf_dir, "part").select(k, *[c_.cast("double") for c_ in (k * 3 % 256, k * 7 % 256, k * 11 % 256)]).toDF("p_partkey", "r", "g", "b")
    return p.select("p_partkey", *[F.round(x, 6).alias(n) for x, n in zip(c.lab(F.col("r"), F.col("g"), F.col("b")), ("l", "a", "b2"), strict=True)])


@query(f"WITH {t.POINTS} SELECT frame, pid, CAST(r*65536+g*256+b AS INTEGER) rgb, CAST(r AS INTEGER) r, CAST(g AS INTEGER) g, CAST(b AS INTEGER) b FROM pts")
def f14_packed_colours(spark, sf_dir):
    p = t.points(spark, sf_dir).withColumn("rgb", c.packed(F.col("r"), F.col("g"), F.col("b")))
    return p.select("frame", "pid", "rgb", *[x.alias(n) for x, n in zip(c.unpacked(F.col("rgb")), "rgb", strict=True)])


@query(f"WITH {EDGES} SELECT e.*, round(sqrt((v.r-w.r)*(v.r-w.r)+(v.g-w.g)*(v.g-w.g)+(v.b-w.b)*(v.b-w.b))/255*0.2+sqrt((v.x-w.x)*(v.x-w.x)+(v.y-w.y)*(v.y-w.y)+(v.z-w.z)*(v.z-w.z))/200*0.4,6) d FROM edges e JOIN vox v ON v.frame=e.frame AND v.kx=e.kx AND v.ky=e.ky AND v.kz=e.kz JOIN vox w ON w.frame=e.frame AND w.kx=e.nx AND w.ky=e.ny AND w.kz=e.nz")
def f15_feature_distance(spark, sf_dir):
    """Of neighbouring voxels, with equal normals."""
    v = voxels(spark, sf_dir)
    there = v.select("frame", *[F.col(f"k{a}").alias(f"n{a}") for a in "xyz"], *[F.col(a).alias(f"o_{a}") for a in "xyzrgb"])
    e = spatial.adjacency(v).join(v, spatial.KEY).join(there, ["frame", "nx", "ny", "nz"])
    normal = {"nx": F.lit(0.0), "ny": F.lit(0.0), "nz": F.lit(1.0)}
    d = c.feature_distance({a: F.col(a) for a in "xyzrgb"} | normal, {a: F.col(f"o_{a}") for a in "xyzrgb"} | normal)
    return e.select(*spatial.KEY, "nx", "ny", "nz", F.round(d, 6).alias("d"))


@query(f"WITH {t.POINTS} SELECT frame, pid, CAST(-y+10 AS BIGINT) x, CAST(x-20 AS BIGINT) y, CAST(z+5 AS BIGINT) z FROM pts")
def f18_rigid_transform(spark, sf_dir):
    """A quarter turn around z and a shift."""
    moved = c.transformed([0, -1, 0, 10, 1, 0, 0, -20, 0, 0, 1, 5], F.col("x"), F.col("y"), F.col("z"))
    return t.points(spark, sf_dir).select("frame", "pid", *[m.cast("long").alias(a) for m, a in zip(moved, "xyz", strict=True)])


@query(f"WITH {VOX} SELECT * FROM vox")
def a1_voxelise(spark, sf_dir):
    return voxels(spark, sf_dir)


@query(f"""WITH {EDGES}, own AS (SELECT frame, kx, ky, kz, kx nx, ky ny, kz nz FROM vox), two AS (SELECT e.frame, e.kx, e.ky, e.kz, f.nx, f.ny, f.nz FROM edges e JOIN edges f ON f.frame=e.frame AND f.kx=e.nx AND f.ky=e.ny AND f.kz=e.nz),
q AS (SELECT * FROM own UNION ALL SELECT * FROM edges UNION ALL SELECT * FROM two), at_ AS (SELECT frame, kx, ky, kz, CAST(floor(x) AS BIGINT) x, CAST(floor(y) AS BIGINT) y, CAST(floor(z) AS BIGINT) z FROM vox)
SELECT q.frame, q.kx, q.ky, q.kz, count(*) n, CAST(sum(x) AS BIGINT) sx, CAST(sum(y) AS BIGINT) sy, CAST(sum(z) AS BIGINT) sz, CAST(sum(x*x) AS BIGINT) sxx, CAST(sum(x*y) AS BIGINT) sxy, CAST(sum(x*z) AS BIGINT) sxz, CAST(sum(y*y) AS BIGINT) syy, CAST(sum(y*z) AS BIGINT) syz, CAST(sum(z*z) AS BIGINT) szz
FROM q JOIN at_ w ON w.frame=q.frame AND w.kx=q.nx AND w.ky=q.ny AND w.kz=q.nz GROUP BY q.frame, q.kx, q.ky, q.kz""")
def a3_two_ring_covariance(spark, sf_dir):
    v = voxels(spark, sf_dir)
    return spatial.two_ring_sums(v, spatial.adjacency(v))


@query(f"WITH {t.MOVES}, v AS (SELECT label, CAST(sum(CASE WHEN frame%3=0 THEN -1 ELSE 1 END) AS BIGINT) votes, count(*) n FROM moves GROUP BY label) SELECT label, votes, n, votes>=3 stable FROM v")
def a6_stable_votes(spark, sf_dir):
    """One vote for each unchanged row of a label, one against for each changed one (here every third frame); labels below three votes are lost."""
    v = t.moves(spark, sf_dir).groupBy("label").agg(F.sum(F.when(F.col("frame") % 3 == 0, -1).otherwise(1)).alias("votes"), F.count("*").alias("n"))
    return v.withColumn("stable", F.col("votes") >= 3)


@query(f"WITH {t.MOVES} SELECT frame, max(label) max_label, count(*) n FROM moves GROUP BY frame")
def a8_max_label(spark, sf_dir):
    return t.moves(spark, sf_dir).groupBy("frame").agg(F.coalesce(F.max("label"), F.lit(0)).alias("max_label"), F.count("*").alias("n"))


@query(f"WITH {COUNTERS} SELECT a, b, cnt FROM cnt ORDER BY cnt DESC, a, b LIMIT 1")
def a15_strongest_pair(spark, sf_dir):
    return comovement.counters(t.moves(spark, sf_dir), t.resets(spark, sf_dir)).orderBy(F.col("cnt").desc(), "a", "b").limit(1)


@query(f"WITH {VOX} SELECT pid, p.frame, n FROM (SELECT *, {KEYS} FROM box) p JOIN vox USING (frame, kx, ky, kz)")
def j1_voxel_of_point(spark, sf_dir):
    v = voxels(spark, sf_dir).select(*spatial.KEY, "n")
    return box(spark, sf_dir).select("frame", "pid", *c.cells()).join(v, spatial.KEY).select("pid", "frame", "n")


@query(f"WITH {EDGES} SELECT * FROM edges")
def j2_adjacency(spark, sf_dir):
    return spatial.adjacency(voxels(spark, sf_dir))


@query(f"WITH {VOX}, a AS (SELECT frame, kx, ky, kz FROM vox), p AS (SELECT frame+1 frame, kx, ky, kz FROM vox), u AS (SELECT * FROM a UNION SELECT * FROM p) SELECT u.*, CASE WHEN NOT EXISTS (FROM a WHERE a=u) THEN 'gone' WHEN NOT EXISTS (FROM p WHERE p=u) THEN 'new' ELSE 'kept' END status FROM u".replace("a=u", "a.frame=u.frame AND a.kx=u.kx AND a.ky=u.ky AND a.kz=u.kz").replace("p=u", "p.frame=u.frame AND p.kx=u.kx AND p.ky=u.ky AND p.kz=u.kz").replace("(FROM", "(SELECT 1 FROM"))
def j3_state_changes(spark, sf_dir):
    return spatial.state_changes(voxels(spark, sf_dir))


@query(f"WITH {VOX}, k AS (SELECT *, {KEYS} FROM pts) SELECT k.frame, pid, coalesce(n, 0) label FROM k LEFT JOIN vox USING (frame, kx, ky, kz)")
def j4_full_resolution_labels(spark, sf_dir):
    """Every input point with its voxel's label (here its count), 0 outside."""
    v = voxels(spark, sf_dir).select(*spatial.KEY, F.col("n").alias("label"))
    return t.points(spark, sf_dir).select("frame", "pid", *c.cells()).join(v, spatial.KEY, "left").select("frame", "pid", F.coalesce("label", F.lit(0)).alias("label"))


@query("""WITH d AS (SELECT label, vec_id kp_id, list_transform(embedding[1:36], lambda e: CAST(round(CAST(e AS DOUBLE)*1000000) AS BIGINT)) v FROM embeddings), p AS (SELECT a.label, a.kp_id, b.kp_id near, CAST(list_sum(list_transform(list_zip(a.v, b.v), lambda z: abs(z[1]-z[2]))) AS BIGINT) dist FROM d a JOIN d b ON a.label=b.label AND a.kp_id<>b.kp_id)
SELECT label, kp_id, near, dist FROM p QUALIFY row_number() OVER (PARTITION BY kp_id ORDER BY dist, near)=1""")
def j8_descriptor_nearest(spark, sf_dir):
    """Nearest other descriptor of the same label by summed differences; ties to the smaller id. Of two, one is the keypoint itself, unless others are equal to it."""
    d = t.descriptors(spark, sf_dir)
    near = matching.l1_nearest(d, d, 2).where("q <> t")
    return near.groupBy("label", "q").agg(F.min(F.struct("rank", "t", "dist")).alias("m")).select("label", F.col("q").alias("kp_id"), F.col("m.t").alias("near"), "m.dist")


@query("SELECT label, true found FROM embeddings GROUP BY label HAVING count(*)>1")
def j8_forest_recall(spark, sf_dir):
    """Whether the forest finds at least nine in ten of each label's nearest other descriptors."""
    d = t.descriptors(spark, sf_dir)
    near = forest.forest_nearest(d, d, 2).where("q <> t").groupBy("label", "q").agg(F.min("dist").alias("found"))
    exact = matching.l1_nearest(d, d, 2).where("q <> t").groupBy("label", "q").agg(F.min("dist").alias("dist"))
    both = exact.join(near, ["label", "q"], "left")
    return both.groupBy("label").agg((F.avg((F.coalesce("found", F.lit(-1.0)) == F.col("dist")).cast("int")) >= 0.9).alias("found"))


@query(f"WITH {EDGES} SELECT v.frame, v.kx, v.ky, v.kz, count(e.nx) neighbours FROM vox v LEFT JOIN edges e USING (frame, kx, ky, kz) GROUP BY ALL HAVING count(e.nx)<=1")
def j11_noise_voxels(spark, sf_dir):
    v = voxels(spark, sf_dir)
    n = spatial.adjacency(v).groupBy(*spatial.KEY).agg(F.count("*").alias("neighbours"))
    return v.select(*spatial.KEY).join(n, spatial.KEY, "left").withColumn("neighbours", F.coalesce("neighbours", F.lit(0))).where("neighbours <= 1")


@query(f"WITH {EDGES}, o AS (SELECT *, CAST(floor(kx/5.0) AS BIGINT)*100+CAST(floor(ky/5.0) AS BIGINT)*10+CAST(floor(kz/5.0) AS BIGINT) s FROM vox) SELECT DISTINCT e.frame, a.s label, b.s neighbor FROM edges e JOIN o a ON a.frame=e.frame AND a.kx=e.kx AND a.ky=e.ky AND a.kz=e.kz JOIN o b ON b.frame=e.frame AND b.kx=e.nx AND b.ky=e.ny AND b.kz=e.nz WHERE a.s<>b.s")
def j14_cluster_neighbours(spark, sf_dir):
    """Neighbouring clusters (here seed cells) over voxel edges: owners follow from keys, so no join is needed beyond the edges."""
    own = lambda p: F.floor(F.col(f"{p}x") / 5) * 100 + F.floor(F.col(f"{p}y") / 5) * 10 + F.floor(F.col(f"{p}z") / 5)
    e = spatial.adjacency(voxels(spark, sf_dir)).select("frame", own("k").alias("label"), own("n").alias("neighbor"))
    return e.where("label <> neighbor").distinct()


@query(f"WITH {VOX} SELECT p.frame, pid FROM (SELECT *, {KEYS} FROM box) p WHERE p.frame>0 AND NOT EXISTS (SELECT 1 FROM vox v WHERE v.frame=p.frame-1 AND v.kx=p.kx AND v.ky=p.ky AND v.kz=p.kz)")
def j20_cloud_changes(spark, sf_dir):
    """Points in voxels that were empty in the frame before."""
    before = voxels(spark, sf_dir).select((F.col("frame") + 1).alias("frame"), "kx", "ky", "kz")
    return box(spark, sf_dir).where("frame > 0").select("frame", "pid", *c.cells()).join(before, spatial.KEY, "left_anti").select("frame", "pid")


@query(f"WITH {t.MOVES}, m AS (SELECT frame, max(label) most FROM moves GROUP BY frame) SELECT frame, label FROM m, range(1, 12) q(label) WHERE label<most EXCEPT SELECT frame, label FROM moves")
def w6_free_labels(spark, sf_dir):
    used = t.moves(spark, sf_dir)
    most = used.groupBy("frame").agg(F.max("label").alias("most")).where("most > 1")
    return most.select("frame", F.explode(F.sequence(F.lit(1).cast("long"), F.col("most") - 1)).alias("label")).join(used, ["frame", "label"], "left_anti")


@query(f"""WITH {t.MOVES}, m AS (SELECT frame, max(label) most FROM moves GROUP BY frame), f AS (SELECT frame, label, row_number() OVER (PARTITION BY frame ORDER BY label DESC) i FROM (SELECT frame, label FROM m, range(1, 12) q(label) WHERE label<most EXCEPT SELECT frame, label FROM moves)), n AS (SELECT frame, count(*) n FROM f GROUP BY frame)
SELECT m.frame, q.i, coalesce(f.label, most+q.i-coalesce(n,0)) label FROM m CROSS JOIN range(1, 6) q(i) LEFT JOIN n ON n.frame=m.frame LEFT JOIN f ON f.frame=m.frame AND f.i=q.i""")
def w7_new_labels(spark, sf_dir):
    """Labels for five new seeds in each frame."""
    used = t.moves(spark, sf_dir)
    wanted = used.select("frame").distinct().select("frame", F.explode(F.sequence(F.lit(1), F.lit(5))).alias("i")).withColumn("i", F.col("i").cast("long"))
    return spatial.new_labels(used, wanted)


@query(f"WITH {t.MOVES} SELECT m.frame, label FROM moves m WHERE m.frame<(SELECT max(frame) FROM moves) AND NOT EXISTS (SELECT 1 FROM moves n WHERE n.frame=m.frame+1 AND n.label=m.label)")
def w10_vanished_parts(spark, sf_dir):
    m = t.moves(spark, sf_dir)
    nxt = m.select((F.col("frame") - 1).alias("frame"), "label")
    last = m.agg(F.max("frame")).scalar()
    return m.where(F.col("frame") < last).join(nxt, ["frame", "label"], "left_anti")


@query(f"WITH {VOX} SELECT frame, kx, ky, kz, {', '.join(f'{a}, lag({a}) OVER (PARTITION BY kx, ky, kz ORDER BY frame) prev_{a}' for a in 'xyzrgb')} FROM vox")
def w11_previous_values(spark, sf_dir):
    w = Window.partitionBy("kx", "ky", "kz").orderBy("frame")
    return voxels(spark, sf_dir).select(*spatial.KEY, *"xyzrgb", *[F.lag(a).over(w).alias(f"prev_{a}") for a in "xyzrgb"])


@query(f"""WITH {VOX}, q AS (SELECT frame, kx, ky, kz, CAST(floor(x) AS BIGINT) x, CAST(floor(y) AS BIGINT) y, CAST(floor(z) AS BIGINT) z FROM vox), s AS (SELECT *, CAST(floor((x+400)/200.0) AS BIGINT) sx, CAST(floor((y+350)/200.0) AS BIGINT) sy, CAST(floor((z-800)/200.0) AS BIGINT) sz FROM q),
d AS (SELECT *, (x-(sx*200-300))*(x-(sx*200-300))+(y-(sy*200-250))*(y-(sy*200-250))+(z-(sz*200+900))*(z-(sz*200+900)) d2 FROM s)
SELECT frame, sx, sy, sz, kx, ky, kz, d2 FROM d QUALIFY row_number() OVER (PARTITION BY frame, sx, sy, sz ORDER BY d2, kx, ky, kz)=1""")
def g2_candidate_seeds(spark, sf_dir):
    return spatial.seeds(voxels(spark, sf_dir))


@query(f"WITH {COUNTERS} SELECT a, b, cnt FROM cnt")
def x7_counters_by_pair(spark, sf_dir):
    """The same counters as a stream keeps them, after blocks of a sixth of all frames."""
    moves, resets = t.moves(spark, sf_dir), t.resets(spark, sf_dir)
    last = moves.agg(F.max("frame")).first()[0] or 0
    return by_pair.folded(moves, resets, last // 6 + 1)


@query(f"WITH {COUNTERS} SELECT a, b, cnt FROM cnt")
def c1_comovement_counters(spark, sf_dir):
    return comovement.counters(t.moves(spark, sf_dir), t.resets(spark, sf_dir))


OBJECTS = f"""WITH RECURSIVE {COUNTERS}, e AS (SELECT a, b FROM cnt WHERE cnt>0 UNION SELECT b, a FROM cnt WHERE cnt>0),
parts AS (SELECT DISTINCT m.label part FROM moves m LEFT JOIN lr USING (label) WHERE m.frame>=coalesce(f,0)),
reach AS (SELECT part, part other FROM parts UNION SELECT part, b FROM reach JOIN e ON a=other) SELECT min(other) object_id, part FROM reach GROUP BY part"""


@query(OBJECTS)
def c3_objects(spark, sf_dir):
    shared(spark)
    return comovement.objects(t.moves(spark, sf_dir), t.resets(spark, sf_dir))


#: Part after part: stars of the smallest free part and its partners, then one pass that merges into each star what shares a part with it.
GREEDY = f"""WITH RECURSIVE {COUNTERS}, e AS (SELECT a, b FROM cnt WHERE cnt>0 UNION SELECT b, a FROM cnt WHERE cnt>0),
parts AS (SELECT part, list(b) FILTER (WHERE b IS NOT NULL) partners, row_number() OVER (ORDER BY part) i FROM (SELECT DISTINCT m.label part FROM moves m LEFT JOIN lr USING (label) WHERE m.frame>=coalesce(f,0)) LEFT JOIN e ON a=part GROUP BY part),
pick AS (SELECT CAST(0 AS BIGINT) i, CAST([] AS BIGINT[]) gone, CAST([] AS BIGINT[]) centres UNION ALL SELECT p.i, CASE WHEN list_contains(gone, part) THEN gone ELSE list_concat(list_append(gone, part), coalesce(partners, [])) END, CASE WHEN list_contains(gone, part) THEN centres ELSE list_append(centres, part) END FROM pick JOIN parts p ON p.i=pick.i+1),
star AS (SELECT part c, list_append(coalesce(partners, []), part) m, row_number() OVER (ORDER BY part) i FROM parts WHERE list_contains((SELECT centres FROM pick ORDER BY i DESC LIMIT 1), part)),
pass AS (SELECT CAST(0 AS BIGINT) i, (SELECT list({{'c': c, 'm': m}} ORDER BY c) FROM star) segs UNION ALL SELECT s.i, CASE WHEN len(list_filter(segs, lambda x: x.c=s.c))=0 THEN segs ELSE list_append(list_filter(segs, lambda x: x.c<>s.c AND NOT list_has_any(x.m, s.m)), {{'c': s.c, 'm': flatten(list_transform(list_filter(segs, lambda x: x.c=s.c OR list_has_any(x.m, s.m)), lambda x: x.m))}}) END FROM pass JOIN star s ON s.i=pass.i+1)
SELECT DISTINCT seg.c object_id, unnest(seg.m) part FROM (SELECT unnest(segs) seg FROM (SELECT segs FROM pass ORDER BY i DESC LIMIT 1))"""


@query(GREEDY)
def c4_greedy_objects(spark, sf_dir):
    """Objects as one part after another finds them, with one pass of merging."""
    return comovement.greedy_objects(t.moves(spark, sf_dir), t.resets(spark, sf_dir))


@query(f"SELECT object_id, count(*) parts FROM ({OBJECTS}) GROUP BY object_id UNION ALL SELECT NULL, count(*) FROM ({OBJECTS})")
def a14_object_sizes(spark, sf_dir):
    """Parts of each object, and of all (without an object)."""
    return c3_objects(spark, sf_dir).rollup("object_id").agg(F.count("*").alias("parts"))


@query(f"SELECT object_id, list(DISTINCT part ORDER BY part)::VARCHAR parts FROM ({OBJECTS}) GROUP BY object_id")
def w3_sorted_parts(spark, sf_dir):
    """Each object's parts, sorted and once each."""
    g = c3_objects(spark, sf_dir).groupBy("object_id").agg(F.array_sort(F.collect_set("part")).alias("p"))
    return g.select("object_id", F.concat(F.lit("["), F.array_join(F.col("p").cast("array<string>"), ", "), F.lit("]")).alias("parts"))


@query(f"SELECT p.part, coalesce(min(o.object_id), 0) object_id FROM (SELECT DISTINCT user_id%15+1 part FROM events) p LEFT JOIN ({OBJECTS}) o ON o.part=p.part GROUP BY p.part")
def j15_object_of_part(spark, sf_dir):
    """The object of each part, 0 for parts without one (here those above 12)."""
    parts = t.read(spark, sf_dir, "events").select((F.col("user_id") % 15 + 1).alias("part")).distinct()
    return parts.join(c3_objects(spark, sf_dir), "part", "left").groupBy("part").agg(F.coalesce(F.min("object_id"), F.lit(0)).alias("object_id"))


@query(f"WITH {t.MOVES} SELECT frame, label FROM resets UNION ALL SELECT m.frame, label FROM moves m WHERE m.frame<(SELECT max(frame) FROM moves) AND NOT EXISTS (SELECT 1 FROM moves n WHERE n.frame=m.frame+1 AND n.label=m.label)")
def w9_all_resets(spark, sf_dir):
    """Parts to reset, with those that moved and vanished."""
    return t.resets(spark, sf_dir).unionByName(w10_vanished_parts(spark, sf_dir))
