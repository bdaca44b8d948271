"""Queries over keypoints, descriptors and the search for lost labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pointfold.functions import columns as c
from pointfold.jobs.base import KEYS, query
from pointfold.jobs.scene import D2, KEY, LABELS, labelled
from pointfold.operators import descriptors as ds
from pointfold.operators import matching, spatial, surface
from pointfold.operators.cut import cut
from pointfold.sources import tables as t

RADIUS = c.SEED // 2


def toned(v: DataFrame) -> DataFrame:
    """v with colours, taken from the middle of their range, as normals."""
    d = [(F.col(a) - 128).cast("double") for a in "rgb"]
    size = F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2])
    return v.withColumns({f"n{a}": F.when(size > 0, x / size).otherwise(0.0) for a, x in zip("xyz", d, strict=True)})


#: ang: the three angles of all pairs of voxels within RADIUS, step by step; simple, fine: the two passes of the histograms.
ANGLES = f"""tone AS (SELECT *, CAST(r-128 AS DOUBLE) dr, CAST(g-128 AS DOUBLE) dg, CAST(b-128 AS DOUBLE) db FROM l), normal AS (SELECT *, CASE WHEN sqrt(dr*dr+dg*dg+db*db)>0 THEN dr/sqrt(dr*dr+dg*dg+db*db) ELSE 0 END nx, CASE WHEN sqrt(dr*dr+dg*dg+db*db)>0 THEN dg/sqrt(dr*dr+dg*dg+db*db) ELSE 0 END ny, CASE WHEN sqrt(dr*dr+dg*dg+db*db)>0 THEN db/sqrt(dr*dr+dg*dg+db*db) ELSE 0 END nz FROM tone),
pair AS (SELECT a.frame, a.kx, a.ky, a.kz, b.kx ox, b.ky oy, b.kz oz, {D2} d2, CAST(b.x-a.x AS DOUBLE) dx, CAST(b.y-a.y AS DOUBLE) dy, CAST(b.z-a.z AS DOUBLE) dz, a.nx ax, a.ny ay, a.nz az, b.nx bx, b.ny by_, b.nz bz FROM normal a JOIN normal b ON a.frame=b.frame AND {D2}<={RADIUS * RADIUS} AND {D2}>0),
p1 AS (SELECT *, sqrt(dx*dx+dy*dy+dz*dz) len FROM pair), p2 AS (SELECT *, (ax*dx+ay*dy+az*dz)/len one, (bx*dx+by_*dy+bz*dz)/len two FROM p1), p3 AS (SELECT *, abs(one)<abs(two) swap FROM p2),
p4 AS (SELECT frame, kx, ky, kz, ox, oy, oz, d2, CASE WHEN swap THEN -dx ELSE dx END/len lx, CASE WHEN swap THEN -dy ELSE dy END/len ly, CASE WHEN swap THEN -dz ELSE dz END/len lz, CASE WHEN swap THEN bx ELSE ax END fx, CASE WHEN swap THEN by_ ELSE ay END fy, CASE WHEN swap THEN bz ELSE az END fz, CASE WHEN swap THEN ax ELSE bx END sx, CASE WHEN swap THEN ay ELSE by_ END sy, CASE WHEN swap THEN az ELSE bz END sz, CASE WHEN swap THEN -two ELSE one END third FROM p3),
p5 AS (SELECT *, ly*fz-lz*fy cx, lz*fx-lx*fz cy, lx*fy-ly*fx cz FROM p4), p6 AS (SELECT *, sqrt(cx*cx+cy*cy+cz*cz) size FROM p5), p7 AS (SELECT *, CASE WHEN size>0 THEN cx/size END vx, CASE WHEN size>0 THEN cy/size END vy, CASE WHEN size>0 THEN cz/size END vz FROM p6),
p8 AS (SELECT *, fy*vz-fz*vy wx, fz*vx-fx*vz wy, fx*vy-fy*vx wz FROM p7), ang AS (SELECT *, atan2(wx*sx+wy*sy+wz*sz, fx*sx+fy*sy+fz*sz) f0, vx*sx+vy*sy+vz*sz f1, CASE WHEN size>0 THEN third END f2 FROM p8),
bin AS (SELECT *, CASE WHEN f0 IS NOT NULL THEN least(greatest(floor((f0+pi())/(2*pi())*11), 0), 10) END b0, CASE WHEN f1 IS NOT NULL THEN least(greatest(floor((f1+1)/2*11), 0), 10) END b1, CASE WHEN f2 IS NOT NULL THEN least(greatest(floor((f2+1)/2*11), 0), 10) END b2 FROM ang),
simple AS (SELECT frame, kx, ky, kz, {", ".join(f"count(*) FILTER (b{i // 11}={i % 11})*100.0::DOUBLE/count(*) h{i}" for i in range(33))} FROM bin GROUP BY frame, kx, ky, kz),
total AS (SELECT a.frame, a.kx, a.ky, a.kz, {", ".join(f"sum(h{i}/d2) h{i}" for i in range(33))} FROM pair a JOIN simple s ON s.frame=a.frame AND s.kx=a.ox AND s.ky=a.oy AND s.kz=a.oz GROUP BY a.frame, a.kx, a.ky, a.kz),
fine AS (SELECT frame, kx, ky, kz, {", ".join("CASE WHEN {0}>0 THEN h{1}/({0})*100 END h{1}".format("(" + "+".join(f"h{j}" for j in range(i - i % 11, i - i % 11 + 11)) + ")", i) for i in range(33))} FROM total)"""


@query(f"WITH {LABELS}, {ANGLES} SELECT frame, kx, ky, kz, {', '.join(f'round(h{i}, 6) h{i}' for i in range(33))} FROM fine")
def a10_angle_histograms(spark, sf_dir):
    """Of voxels within half a seed cell, with colours as normals."""
    h = ds.histograms(toned(labelled(spark, sf_dir)), RADIUS)
    return h.select(*KEY, *[F.round(n, 6).alias(n) for n in ds.PARTS])


def _cells(by: str, of: str, where: str = "true") -> str:
    number = "+".join(f"(CAST(floor(({a}-({c.ORIGIN[a]}))/80.0) AS BIGINT)+1048576)*{1 << s}" for a, s in zip("xyz", (42, 21, 0), strict=True))
    centre = ", ".join(f"CAST(floor(({a}-({c.ORIGIN[a]}))/80.0) AS BIGINT)*80+40+({c.ORIGIN[a]}) {a}" for a in "xyz")
    return f"SELECT DISTINCT {by}, {number} kp_id, {centre} FROM {of} WHERE {where}"


COLOURS = "scaled AS (SELECT frame, x, y, z, (0.412453::DOUBLE*r+0.357580::DOUBLE*g+0.180423::DOUBLE*b)/95.047::DOUBLE x0, (0.212671::DOUBLE*r+0.715160::DOUBLE*g+0.072169::DOUBLE*b)/100.0::DOUBLE y0, (0.019334::DOUBLE*r+0.119193::DOUBLE*g+0.950227::DOUBLE*b)/108.883::DOUBLE z0 FROM l), bent AS (SELECT frame, x, y, z, " + ", ".join(f"CASE WHEN {a}0>0.008856 THEN pow({a}0,0.3333) ELSE 7.787*{a}0+0.138 END f{a}" for a in "xyz") + " FROM scaled), lab AS (SELECT frame, x, y, z, least(116*fy-16,100)/100 l, least(greatest(500*(fx-fy),-300),300)/300 a, least(200*(fy-fz),300)/300 b FROM bent)"


@query(f"WITH {LABELS}, {COLOURS} SELECT p.frame, p.kx, p.ky, p.kz, round(sum(q.l), 6) lab_l, round(sum(q.a), 6) lab_a, round(sum(q.b), 6) lab_b, count(*) near FROM l p JOIN lab q ON p.frame=q.frame AND {D2.replace('a.', 'p.').replace('b.', 'q.')}<={RADIUS * RADIUS} GROUP BY p.frame, p.kx, p.ky, p.kz")
def a9_colour_sums(spark, sf_dir):
    """Sums, not means, of colours in their uniform space within half a seed cell."""
    v = labelled(spark, sf_dir)
    out = ds.colour_sums(v.select(*KEY, *"xyz"), v, RADIUS)
    return out.select(*KEY, *[F.round(f"lab_{a}", 6).alias(f"lab_{a}") for a in "lab"], "near")


#: Every keypoint with its descriptor as text: whole thousandths.
DESCRIBED = f"""kp AS ({_cells("frame, label", "l")}), col AS (SELECT p.frame, label, kp_id, sum(q.l) lab_l, sum(q.a) lab_a, sum(q.b) lab_b FROM kp p JOIN lab q ON p.frame=q.frame AND {D2.replace("a.", "p.").replace("b.", "q.")}<={RADIUS * RADIUS} GROUP BY p.frame, label, kp_id),
at_ AS (SELECT a.frame, a.label, kp_id, b.kx, b.ky, b.kz FROM kp a JOIN q b ON a.frame=b.frame QUALIFY row_number() OVER (PARTITION BY a.frame, a.label, kp_id ORDER BY {D2}, b.kx, b.ky, b.kz)=1)"""


@query(f"WITH {LABELS}, {ANGLES}, {COLOURS}, {DESCRIBED} SELECT frame, label, kp_id, concat_ws(' ', {', '.join(f'CAST(round(h{i}*1000) AS BIGINT)' for i in range(33))}, {', '.join(f'CAST(round(lab_{a}*1000) AS BIGINT)' for a in 'lab')}) descriptor FROM col JOIN at_ USING (frame, label, kp_id) JOIN fine USING (frame, kx, ky, kz) WHERE {' AND '.join(f'h{i} IS NOT NULL' for i in (0, 11, 22))}")
def a11_descriptors(spark, sf_dir):
    """Of each label's keypoints: 33 values of angles and 3 of colours, those that are numbers."""
    v = toned(labelled(spark, sf_dir))
    d = ds.described(ds.keypoints(v, ["frame", "label"]), v, RADIUS)
    return d.select("frame", "label", "kp_id", F.array_join(F.transform("desc", lambda x: F.round(x * 1000).cast("long").cast("string")), " ").alias("descriptor"))


#: Gradients of the voxels' intensity, the sum of their colours, in the plane of the camera; and the histograms of them.
SUMS = ("xx", "xy", "xz", "yy", "yz", "zz", "xi", "yi", "zi")
GRADIENT = f"""tone AS (SELECT *, r+g+b intensity FROM l), pr AS (SELECT a.frame, a.kx, a.ky, a.kz, b.x-a.x x, b.y-a.y y, b.z-a.z z, b.intensity i FROM tone a JOIN tone b ON a.frame=b.frame AND {D2}<={RADIUS * RADIUS}),
sm AS (SELECT frame, kx, ky, kz, {", ".join(f"CAST(count(*)*sum({a}*{b})-sum({a})*sum({b}) AS DOUBLE) m{a}{b}" for a, b in SUMS)} FROM pr GROUP BY frame, kx, ky, kz),
co AS (SELECT *, myy*mzz-myz*myz a0, mxz*myz-mxy*mzz a1, mxy*myz-mxz*myy a2, mxx*mzz-mxz*mxz b1, mxy*mxz-mxx*myz b2, mxx*myy-mxy*mxy c2 FROM sm), dt AS (SELECT *, mxx*a0+mxy*a1+mxz*a2 det FROM co),
gr AS (SELECT frame, kx, ky, kz, (a0*mxi+a1*myi+a2*mzi)/det gx, (a1*mxi+b1*myi+b2*mzi)/det gy FROM dt WHERE det<>0),
nb AS (SELECT a.frame, a.kx, a.ky, a.kz, sqrt(CAST({D2} AS DOUBLE)) far, (b.x-a.x)*g.gx+(b.y-a.y)*g.gy along, sqrt(g.gx*g.gx+g.gy*g.gy) size FROM l a JOIN l b ON a.frame=b.frame AND {D2}<={RADIUS * RADIUS} AND {D2}>0 JOIN gr g ON g.frame=b.frame AND g.kx=b.kx AND g.ky=b.ky AND g.kz=b.kz),
bn AS (SELECT *, far/{RADIUS}*4 ring, acos(greatest(least(along/(far*size), 1.0), -1.0))/pi()*8 turn FROM nb WHERE size>0),
hs AS (SELECT frame, kx, ky, kz, {", ".join(f"sum(greatest(1-abs(ring-{i}), 0.0)*greatest(1-abs(turn-{j}), 0.0)*size) g{i}{j}" for i in range(4) for j in range(8))} FROM bn GROUP BY frame, kx, ky, kz), hl AS (SELECT *, sqrt({"+".join(f"g{i}{j}*g{i}{j}" for i in range(4) for j in range(8))}) length FROM hs)"""


@query(f"WITH {LABELS}, {GRADIENT} SELECT frame, kx, ky, kz, {', '.join(f'round(CASE WHEN length>0 THEN g{i}{j}/length ELSE 0 END, 6) g{i}{j}' for i in range(4) for j in range(8))} FROM hl")
def a18_gradient_histograms(spark, sf_dir):
    """Rotation-invariant histograms, 4 distances by 8 angles, of how intensity (the sum of colours) grows around voxels; normals point to the camera."""
    v = labelled(spark, sf_dir).withColumn("intensity", F.col("r") + F.col("g") + F.col("b")).withColumns({"nx": F.lit(0.0), "ny": F.lit(0.0), "nz": F.lit(1.0)})
    v = cut(v)
    g = ds.gradients(v, RADIUS).join(v.select(*KEY, *"xyz"), KEY)
    h = ds.gradient_histograms(v, g, RADIUS)
    return h.select(*KEY, *[F.round(n, 6).alias(n) for n in ds.GRADIENTS])


LEAST = 3
#: Voxels of the scene whose parts jump, and labels none of whose voxels is seen any more, by the first frame without them.
JUMPED = f"""{t.JUMPING}, l AS (SELECT frame, kx, ky, kz, count(*) n, {", ".join(f"CAST(floor(sum({a})/count(*)) AS BIGINT) {a}" for a in "xyzrgb")}, min(label) label FROM (SELECT *, {KEYS} FROM pts WHERE x BETWEEN -400 AND 400 AND y BETWEEN -350 AND 250 AND z BETWEEN 800 AND 1300) GROUP BY frame, kx, ky, kz),
lost AS (SELECT p.frame+1 frame, p.label FROM l p LEFT JOIN l q ON q.frame=p.frame+1 AND q.kx=p.kx AND q.ky=p.ky AND q.kz=p.kz WHERE p.frame<(SELECT max(frame) FROM l) GROUP BY p.frame, p.label HAVING count(q.kx)=0)"""


def jumped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Voxels of the scene whose parts jump, with their part as label and normals that turn with it."""
    p = spatial.crop(t.jumps(spark, sf_dir))
    v = p.groupBy("frame", *c.cells()).agg(F.count("*").alias("n"), *[F.floor(F.sum(a) / F.count("*")).alias(a) for a in "xyzrgb"], F.min("label").alias("label"), *[F.sum(n).cast("double").alias(n) for n in ("nx", "ny", "nz")])
    size = F.sqrt(F.col("nx") * F.col("nx") + F.col("ny") * F.col("ny") + F.col("nz") * F.col("nz"))
    return v.withColumn("size", size).withColumns({n: F.when(F.col("size") > 0, F.col(n) / F.col("size")).otherwise(0.0) for n in ("nx", "ny", "nz")}).drop("size")


def lost_of(now: DataFrame) -> tuple[DataFrame, DataFrame]:
    """frame, label of the labels that no voxel of the frame before shows any more, be it gone or hidden; and all voxels, by the number of the next frame."""
    v = now.withColumn("frame", F.col("frame") + 1)
    there = now.select(*KEY, F.lit(1).alias("there"))
    of = v.where(F.col("frame") <= now.agg(F.max("frame")).scalar()).join(there, KEY, "left")
    return of.groupBy("frame", "label").agg(F.count("there").alias("n")).where("n = 0").select("frame", "label"), v


@query(f"WITH {JUMPED}, kp AS ({_cells('o.frame, o.label', '(SELECT l.frame+1 frame, label, x, y, z FROM l) o JOIN lost USING (frame, label)').replace('SELECT DISTINCT o.frame, o.label', 'SELECT DISTINCT frame, label')}) SELECT frame, label, count(*) keypoints, count(*)>{LEAST} tracked FROM kp GROUP BY frame, label")
def t1_lost_keypoints(spark, sf_dir):
    """Labels that are not seen any more, with how many keypoints of the frame before they have; with too few, they are reset instead of tracked."""
    lost, v = lost_of(cut(jumped(spark, sf_dir)))
    kp = ds.keypoints(v.join(lost, ["frame", "label"], "left_semi"), ["frame", "label"])
    return kp.groupBy("frame", "label").agg(F.count("*").alias("keypoints")).withColumn("tracked", F.col("keypoints") > LEAST)


@query(f"WITH {JUMPED} SELECT lost.frame, label, sum(x)/count(*) x, sum(y)/count(*) y, sum(z)/count(*) z FROM lost JOIN (SELECT frame+1 frame, label, x, y, z FROM l) USING (frame, label) GROUP BY lost.frame, label")
def v11_lost_centres(spark, sf_dir):
    """Where the labels were that are not seen any more."""
    lost, v = lost_of(cut(jumped(spark, sf_dir)))
    return v.join(lost, ["frame", "label"], "left_semi").groupBy("frame", "label").agg(*[(F.sum(a) / F.count("*")).alias(a) for a in "xyz"])


def _planes(a: str) -> str:
    start = f"CAST(floor((p{a}*first-({c.ORIGIN[a]}))/40.0) AS BIGINT)"
    return f"[(k*40.0::DOUBLE+({c.ORIGIN[a]}))/p{a} for k in range(least({start}, k{a})+1, greatest({start}, k{a})+1)]"


#: The cells that the lines from the camera to the voxels {of} cross before them.
LINES = f"""SELECT frame, kx, ky, kz, {", ".join(f"CAST(floor(((a0+a1)/2*p{a}-({c.ORIGIN[a]}))/40.0) AS BIGINT) o{a}" for a in "xyz")} FROM (SELECT *, unnest(at_[1:len(at_)-1]) a0, unnest(at_[2:]) a1 FROM (SELECT *, list_sort(list_distinct(list_concat([first, 1.0::DOUBLE], list_filter(list_concat(list_concat({_planes("x")}, {_planes("y")}), {_planes("z")}), lambda u: u>first AND u<1.0)))) at_
FROM (SELECT *, 800.0::DOUBLE/pz AS first FROM (SELECT DISTINCT frame, kx, ky, kz, {", ".join(f"(kx+0.5::DOUBLE)*40+({c.ORIGIN[a]}) p{a}".replace("(kx", f"(k{a}") for a in "xyz")} FROM {{of}} WHERE kz>=0))))"""
HIDDEN = "SELECT w.frame, w.label, avg(CASE WHEN h.kx IS NULL THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END) f FROM {of} w LEFT JOIN (SELECT DISTINCT p.frame, p.kx, p.ky, p.kz FROM ({lines}) p JOIN {by} o ON o.frame=p.frame AND o.kx=ox AND o.ky=oy AND o.kz=oz WHERE ox<>p.kx OR oy<>p.ky OR oz<>p.kz) h ON h.frame=w.frame AND h.kx=w.kx AND h.ky=w.ky AND h.kz=w.kz GROUP BY w.frame, w.label"
PLACED = "SELECT k.frame, k.label, b.kx, b.ky, b.kz FROM {kp} k JOIN {of} b ON k.frame=b.frame QUALIFY row_number() OVER (PARTITION BY k.frame, k.label, kp_id ORDER BY (k.x-b.x)*(k.x-b.x)+(k.y-b.y)*(k.y-b.y)+(k.z-b.z)*(k.z-b.z), b.kx, b.ky, b.kz)=1"
#: What hides at most this share of old keypoints, or of inliers, leaves a match standing.
HIDES = 0.7


@query(f"""WITH {JUMPED}, prev AS (SELECT frame+1 frame, kx, ky, kz, x, y, z, label FROM l), k0 AS ({_cells("frame, label", "(SELECT prev.* FROM prev JOIN lost USING (frame, label))")}), k1 AS ({_cells("frame, label", "(SELECT l.* FROM l JOIN lost USING (frame, label))")}),
was AS ({PLACED.format(kp="k0", of="prev")}), now_ AS ({PLACED.format(kp="k1", of="l")}),
a AS ({HIDDEN.format(of="was", by="l", lines=LINES.format(of="was"))}), b AS ({HIDDEN.format(of="now_", by="prev", lines=LINES.format(of="now_"))}) SELECT a.frame, a.label, round(a.f, 9) AS before, round(b.f, 9) AS after, a.f<={HIDES} OR b.f<={HIDES} accepted FROM a JOIN b ON a.frame=b.frame AND a.label=b.label""")
def a13_occlusion_fractions(spark, sf_dir):
    """For each lost label: the share of its old keypoints that the frame without it hides, and of its keypoints where it is now that the frame before hides; accepted if either is at most 0.7."""
    v = cut(jumped(spark, sf_dir))
    lost, before = lost_of(v)
    places = []
    for of in (before, v):
        kp = ds.keypoints(of.join(lost, ["frame", "label"], "left_semi"), ["frame", "label"])
        ids = kp.select("frame", F.struct("label", "kp_id").alias("pid"), *"xyz")
        at = surface.nearest(ids, of.select("frame", F.struct("kx", "ky", "kz").alias("pid"), *"xyz"), 1, RADIUS)
        places.append(at.select("frame", "pid.label", "o_pid.*"))
    return occluded(places[0], places[1], before, v).select("frame", "label", F.round("before", 9).alias("before"), F.round("after", 9).alias("after"), "accepted")


def occluded(old: DataFrame, new: DataFrame, before: DataFrame, now: DataFrame) -> DataFrame:
    """frame, label, before, after, accepted: of the places old (frame, label, key) what the voxels now hide, and of new what those before hid."""
    a, b = matching.hidden_shares(old, now), matching.hidden_shares(new, before)
    both = a.withColumnRenamed("share", "before").join(b.withColumnRenamed("share", "after"), ["frame", "label"])
    return both.withColumn("accepted", (F.col("before") <= HIDES) | (F.col("after") <= HIDES))


@query(f"WITH {LABELS}, tone AS (SELECT *, CAST(r-128 AS DOUBLE) dr, CAST(g-128 AS DOUBLE) dg, CAST(b-128 AS DOUBLE) db FROM l), n AS (SELECT *, sqrt(dr*dr+dg*dg+db*db) s FROM tone) SELECT a.frame, a.kx, a.ky, a.kz, round(1-(a.dr*p.dr+a.dg*p.dg+a.db*p.db)/(a.s*p.s), 6) change FROM n a JOIN n p ON p.frame=a.frame-1 AND p.kx=a.kx AND p.ky=a.ky AND p.kz=a.kz WHERE a.s>0 AND p.s>0")
def f16_change_measure(spark, sf_dir):
    """One minus the cosine of a voxel's normals now and in the frame before (with colours as normals)."""
    v = toned(labelled(spark, sf_dir)).where("nx <> 0 OR ny <> 0 OR nz <> 0").select(*KEY, "nx", "ny", "nz")
    was = v.select((F.col("frame") + 1).alias("frame"), "kx", "ky", "kz", *[F.col(n).alias(f"p{n}") for n in ("nx", "ny", "nz")])
    change = c.change([F.col(n) for n in ("nx", "ny", "nz")], [F.col(f"p{n}") for n in ("nx", "ny", "nz")])
    return v.join(was, KEY).select(*KEY, F.round(change, 6).alias("change"))


@query(f"WITH {LABELS} {_cells('frame', 'l', 'label%3=0')}")
def t2_unlabelled_keypoints(spark, sf_dir):
    """Keypoints of the voxels of a frame without a label (here every third label's)."""
    return ds.keypoints(labelled(spark, sf_dir).where("label % 3 = 0"), ["frame"])


def _mixed(kp: Column, trial: Column) -> Column:
    return (kp % 1000003 * 7919 + trial * 104729) % 1000003


SAMPLED = f"kp AS ({_cells('frame, label', 'l')}), pick AS (SELECT frame, label, trial, kp_id, x, y, z FROM kp, range(0, 20) w(trial) QUALIFY row_number() OVER (PARTITION BY frame, label, trial ORDER BY (kp_id%1000003*7919+trial*104729)%1000003, kp_id)<=3)"


def _sampled(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    kp = ds.keypoints(labelled(spark, sf_dir), ["frame", "label"])
    return kp, matching.samples(kp, ("frame", "label"), 20, 3, _mixed)


@query(f"WITH {LABELS}, {SAMPLED} SELECT frame, label, trial, kp_id FROM pick")
def t3_samples(spark, sf_dir):
    """Three keypoints for each of 20 trials of each label, without replacement, by arithmetic instead of chance."""
    return _sampled(spark, sf_dir)[1].select("frame", "label", "trial", "kp_id")


@query(f"WITH {LABELS}, {SAMPLED}, s AS (SELECT frame, label, trial, CAST(sum((x+y+z+2000)%97) AS BIGINT) score FROM pick GROUP BY ALL) SELECT frame, label, trial, score FROM s WHERE score>0 QUALIFY row_number() OVER (PARTITION BY frame, label ORDER BY score DESC, trial)=1")
def w4_best_trials(spark, sf_dir):
    """The trial with the largest score of each label (here a number made of its sampled places)."""
    kp, some = _sampled(spark, sf_dir)
    score = some.join(kp, ["frame", "label", "kp_id"]).groupBy("frame", "label", "trial").agg(F.sum((F.col("x") + F.col("y") + F.col("z") + 2000) % 97).alias("score"))
    return matching.best_trials(score).select("frame", "label", "trial", "score")


def found(spark: SparkSession, sf_dir: str, trials: int = 100) -> tuple[DataFrame, DataFrame]:
    """Matches of lost labels among new voxels, and labels to reset. In a frame with too few new keypoints labels neither move nor are reset."""
    v = cut(jumped(spark, sf_dir))
    lost, before = lost_of(v)
    before = cut(before)
    new = v.join(before.select(*KEY), KEY, "left_anti")
    kp = ds.keypoints(new.where("frame > 0"), ["frame"]).withColumn("label", F.lit(0).cast("long"))
    curr = cut(ds.described(kp, v, RADIUS).drop("label"))
    enough = curr.groupBy("frame").agg(F.count("*").alias("n")).where(F.col("n") > LEAST).select("frame")
    curr = curr.join(enough, "frame", "left_semi")
    lost = cut(lost.join(enough, "frame", "left_semi"))
    prev = ds.described(ds.keypoints(before.join(lost, ["frame", "label"], "left_semi"), ["frame", "label"]), before, RADIUS)
    many = prev.groupBy("frame", "label").agg(F.count("*").alias("n")).where(F.col("n") > LEAST)
    prev = cut(prev.join(many.drop("n"), ["frame", "label"], "left_semi"))
    centres = before.groupBy("frame", "label").agg(*[F.avg(a).alias(a) for a in "xyz"])
    scored, inliers = matching.trials(prev, curr, centres, c.SEED, trials)

    def hidden(best: DataFrame, used: DataFrame) -> DataFrame:
        cell = lambda kps: [F.floor((F.col(f"{kps}v{a}") - c.ORIGIN[a]) / float(c.VOXEL)).alias(f"k{a}") for a in "xyz"]
        old = prev.join(best.select("frame", "label"), ["frame", "label"], "left_semi").select("frame", "label", *cell(""))
        at = curr.select("frame", F.col("kp_id").alias("t"), *[f"v{a}" for a in "xyz"])
        return occluded(old, used.join(at, ["frame", "t"]).select("frame", "label", *cell("")), before, v)

    return matching.matches(cut(scored), inliers, lost, hidden)


def _states() -> str:
    """What becomes of each lost label of the scene: what jumps moves, unless its old place is hidden now and its new one was hidden before."""
    moving = ", ".join(f"({j[0]}, {k}, {'true' if k != 4 else 'false'})" for k, j in t.JUMPS.items())
    return f"SELECT lost.frame, lost.label, CASE WHEN moves THEN 'moving' ELSE 'reset' END state FROM lost JOIN (VALUES {moving}) m(frame, label, moves) ON m.frame=lost.frame AND m.label=lost.label"


@query(f"WITH {JUMPED} {_states()}")
def t8_lost_labels(spark, sf_dir):
    """What became of each lost label: moving, where its best trial stands, or reset."""
    stand, reset = found(spark, sf_dir)
    return stand.select("frame", "label", F.lit("moving").alias("state")).unionByName(reset.select("frame", "label", F.lit("reset").alias("state")))
