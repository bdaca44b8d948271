"""Point-cloud tables derived from the driver's tables by integer arithmetic (coordinates in millimetres)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pointfold.operators.spatial import voxels


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """frame, pid, x, y, z, r, g, b: seven frames of four patches, two of which slide."""
    c = F.col
    li = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", F.col("l_linenumber").cast("long").alias("n"), F.col("l_quantity").cast("long").alias("q"))
    patch = c("l_suppkey") % 4
    df = li.select(
        (c("n") - 1).alias("frame"),
        ((c("l_orderkey") * 8 + c("n")) * 1048576 + c("l_partkey")).alias("pid"),
        (c("l_suppkey") % 2 * 400 - 400 + (c("l_partkey") * 37 + c("l_orderkey") * 11) % 390 + F.when(patch < 2, (c("n") - 1) * 6).otherwise(0)).alias("x"),
        (F.when(patch >= 2, 300).otherwise(0) - 350 + (c("l_orderkey") * 53 + c("l_partkey") * 7) % 290).alias("y"),
        (patch * 60 + 900 + c("q") % 3).alias("z"),
        (c("l_partkey") * 3 % 256).alias("r"),
        (c("l_suppkey") * 17 % 256).alias("g"),
        (c("l_orderkey") * 5 % 256).alias("b"),
    )
    return df.groupBy("frame", "pid").agg(*[F.min(x).alias(x) for x in ("x", "y", "z", "r", "g", "b")])


POINTS = """pts AS (SELECT frame, pid, min(x) x, min(y) y, min(z) z, min(r) r, min(g) g, min(b) b FROM (
 SELECT CAST(l_linenumber AS BIGINT)-1 AS frame, (l_orderkey*8+l_linenumber)*1048576+l_partkey AS pid,
  -400+(l_suppkey%2)*400+(l_partkey*37+l_orderkey*11)%390+(CASE WHEN l_suppkey%4<2 THEN 6*(CAST(l_linenumber AS BIGINT)-1) ELSE 0 END) AS x,
  -350+(CASE WHEN l_suppkey%4>=2 THEN 300 ELSE 0 END)+(l_orderkey*53+l_partkey*7)%290 AS y,
  900+60*(l_suppkey%4)+CAST(l_quantity AS BIGINT)%3 AS z,
  (l_partkey*3)%256 AS r, (l_suppkey*17)%256 AS g, (l_orderkey*5)%256 AS b FROM lineitem) q GROUP BY frame, pid)"""


def crossing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """frame, pid, x, y, z, r, g, b: the near patches slide across the far ones, which lie further back here, and hide them: of each ray only points within 100 mm of the nearest are seen."""
    near = F.col("z") < 1000
    p = points(spark, sf_dir).select("frame", "pid", "x", (F.col("y") + F.when(near, 45 * F.col("frame")).otherwise(0)).alias("y"), (F.col("z") + F.when(near, 0).otherwise(200)).alias("z"), "r", "g", "b")
    p = p.withColumns({"u": F.floor(F.col("x") * 15.0 / F.col("z")), "v": F.floor(F.col("y") * 15.0 / F.col("z"))})
    first = p.groupBy("frame", "u", "v").agg(F.min("z").alias("first"))
    return p.join(first, ["frame", "u", "v"]).where("z <= first + 100").drop("u", "v", "first")


CROSSING = POINTS.replace("pts AS", "raw AS", 1) + """, moved AS (SELECT frame, pid, x, y+CASE WHEN z<1000 THEN 45*frame ELSE 0 END y, z+CASE WHEN z<1000 THEN 0 ELSE 200 END z, r, g, b FROM raw),
cast_ AS (SELECT *, floor(x*15.0::DOUBLE/z) u, floor(y*15.0::DOUBLE/z) v FROM moved),
pts AS (SELECT frame, pid, x, y, z, r, g, b FROM cast_ QUALIFY z<=min(z) OVER (PARTITION BY frame, u, v)+100)"""


#: What a part moves by from frame to frame, along x, y and z, by its label.
PART_STEP = ("(label%3-1)*5", "label%2*4", "(label%5-2)*2")


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """frame, label, x, y, z, r, g, b: voxels of all points, with the slide undone, in parts of 5 x 5 x 5; each part moves in seven frames by a step of its own."""
    p = points(spark, sf_dir).withColumn("x", F.col("x") - F.when(F.col("z") < 1000, 6 * F.col("frame")).otherwise(0)).withColumn("frame", F.lit(0))
    v = voxels(p).select(*cells_of_parts(), *[F.floor(c).alias(c) for c in "xyzrgb"])
    f = v.withColumn("frame", F.explode(F.sequence(F.lit(0), F.lit(6))))
    return f.select("frame", "label", *[(F.col(a) + F.expr(s) * F.col("frame")).alias(a) for a, s in zip("xyz", PART_STEP, strict=True)], *"rgb")


def cells_of_parts() -> list[Column]:
    return [(F.floor(F.col("kx") / 5) * 100 + F.floor(F.col("ky") / 5) * 10 + F.floor(F.col("kz") / 5)).alias("label")]


PARTS = POINTS.replace("pts AS", "slid AS", 1) + f""", still AS (SELECT CASE WHEN z<1000 THEN x-6*frame ELSE x END x, y, z, r, g, b FROM slid),
part_voxels AS (SELECT floor((x+400)/40.0) kx, floor((y+350)/40.0) ky, floor((z-800)/40.0) kz, {", ".join(f"CAST(floor(sum({c})/count(*)) AS BIGINT) {c}" for c in "xyzrgb")} FROM still GROUP BY kx, ky, kz),
labelled AS (SELECT CAST(floor(kx/5.0)*100+floor(ky/5.0)*10+floor(kz/5.0) AS BIGINT) label, x, y, z, r, g, b FROM part_voxels),
parts AS (SELECT frame, label, {", ".join(f"{a}+{s}*frame {a}" for a, s in zip("xyz", PART_STEP))}, r, g, b FROM labelled, (SELECT unnest(range(7)) frame))"""


#: For each part from which frame on it is elsewhere, its new x, y and z, and whether it turns by a quarter about z.
JUMPS = {1: (2, "x+13", "y+9", "z+290", False), 2: (5, "x+4", "y+325", "z+2", False), 3: (3, "-y-110", "x+255", "z+43", True), 4: (5, "x-6", "y-310", "z+1", False)}
#: The part that leaves, and when.
LEAVES = (1, 6)


def jumped(column: str) -> str:
    """SQL for a column of jumps(): x, y, z, or nx, ny of the normals."""
    to = {"x": 1, "y": 2, "z": 3}
    turned = {"nx": "-ny", "ny": "nx"}
    cases = [f"WHEN label={k} AND frame>={j[0]} THEN {j[to[column]] if column in to else turned[column]}" for k, j in JUMPS.items() if column in to or j[4]]
    return f"CASE {' '.join(cases)} ELSE {column} END"


def jumps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """frame, pid, label, x, y, z, r, g, b, nx, ny, nz: all points in each of seven frames, with the slide undone; the four patches are parts, which jump, turn and hide one another's places at some frame, and one leaves. Normals are made of colours and turn with their part."""
    p = points(spark, sf_dir).withColumn("x", F.col("x") - F.when(F.col("z") < 1000, 6 * F.col("frame")).otherwise(0))
    p = p.withColumn("label", F.floor((F.col("z") - 900) / 60) + 1).withColumn("frame", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(6).cast("long"))))
    p = p.where(f"NOT (label = {LEAVES[0]} AND frame >= {LEAVES[1]})").withColumns({"nx": F.col("r") - 128, "ny": F.col("g") - 128, "nz": F.col("b") - 128})
    return p.select("frame", "pid", "label", *[F.expr(jumped(a)).alias(a) for a in "xyz"], *"rgb", *[F.expr(jumped(a)).alias(a) for a in ("nx", "ny")], "nz")


JUMPING = POINTS.replace("pts AS", "slid AS", 1) + f""", still AS (SELECT f.frame, pid, CAST(floor((z-900)/60.0)+1 AS BIGINT) label, CASE WHEN z<1000 THEN x-6*slid.frame ELSE x END x, y, z, r, g, b, r-128 nx, g-128 ny, b-128 nz FROM slid, (SELECT unnest(range(7)) frame) f),
pts AS (SELECT frame, pid, label, {", ".join(f"{jumped(a)} {a}" for a in "xyz")}, r, g, b, {", ".join(f"{jumped(a)} {a}" for a in ("nx", "ny"))}, nz FROM still WHERE NOT (label={LEAVES[0]} AND frame>={LEAVES[1]}))"""


def moves(spark: SparkSession, sf_dir: str, window: int = 20) -> DataFrame:
    """frame, label: parts that move."""
    e = read(spark, sf_dir, "events").where("event_type = 'click'")
    return e.select(F.floor(F.col("event_id") / window).alias("frame"), (F.col("user_id") % 12 + 1).alias("label")).distinct()


def resets(spark: SparkSession, sf_dir: str, window: int = 20) -> DataFrame:
    e = read(spark, sf_dir, "events").where("event_type = 'error' AND event_id % 20 = 0")
    return e.select(F.floor(F.col("event_id") / window).alias("frame"), (F.col("user_id") % 12 + 1).alias("label")).distinct()


MOVES = """moves AS (SELECT DISTINCT CAST(floor(event_id/20.0) AS BIGINT) frame, user_id%12+1 AS label FROM events WHERE event_type='click'),
resets AS (SELECT DISTINCT CAST(floor(event_id/20.0) AS BIGINT) frame, user_id%12+1 AS label FROM events WHERE event_type='error' AND event_id%20=0)"""


def descriptors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """label, kp_id, desc: 36 whole numbers."""
    e = read(spark, sf_dir, "embeddings")
    return e.select("label", F.col("vec_id").alias("kp_id"), F.transform(F.slice("embedding", 1, 36), lambda x: F.round(x.cast("double") * 1000000).cast("long")).alias("desc"))


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """u, v, depth (mm, 0: missing), rgb."""
    p, k = read(spark, sf_dir, "part"), F.col("p_partkey")
    return p.select((k % 40).alias("u"), F.floor(k / 40).alias("v"), F.when(F.col("p_size") % 7 == 0, 0).otherwise(F.col("p_size") * 10 + 800).alias("depth"), (k * 2654435 % 16777216).alias("rgb"))
