"""The decorator that registers a query with its SQL, and what queries share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pointfold.functions import columns as c
from pointfold.operators import spatial
from pointfold.operators.cut import shared  # noqa: F401
from pointfold.sources import tables as t

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
KEYS = ", ".join(f"CAST(floor(({a}-({c.ORIGIN[a]}))/40.0) AS BIGINT) k{a}" for a in "xyz")
BOX_SQL = f"box AS (SELECT * FROM pts WHERE x BETWEEN -400 AND 400 AND y BETWEEN -350 AND 250 AND z BETWEEN 800 AND 1300), vox AS (SELECT frame, kx, ky, kz, count(*) n, sum(x)/count(*) x, sum(y)/count(*) y, sum(z)/count(*) z, sum(r)/count(*) r, sum(g)/count(*) g, sum(b)/count(*) b FROM (SELECT *, {KEYS} FROM box) GROUP BY frame, kx, ky, kz)"
VOX = f"{t.POINTS}, {BOX_SQL}"
#: Voxels of the cloud whose patches hide one another.
CROSS = f"{t.CROSSING}, {BOX_SQL}"
EDGES = f"{VOX}, d(i) AS (VALUES (-1),(0),(1)), edges AS (SELECT v.frame, v.kx, v.ky, v.kz, w.kx nx, w.ky ny, w.kz nz FROM vox v, d a, d b, d c, vox w WHERE (a.i<>0 OR b.i<>0 OR c.i<>0) AND w.frame=v.frame AND w.kx=v.kx+a.i AND w.ky=v.ky+b.i AND w.kz=v.kz+c.i)"
COUNTERS = f"""{t.MOVES}, lr AS (SELECT label, max(frame) f FROM resets GROUP BY label),
both_ AS (SELECT p.label a, q.label b, p.frame, greatest(coalesce(x.f,0), coalesce(y.f,0)) r FROM moves p JOIN moves q ON p.frame=q.frame AND p.label<q.label LEFT JOIN lr x ON x.label=p.label LEFT JOIN lr y ON y.label=q.label),
first_ AS (SELECT a, b, min(frame) f FROM both_ WHERE frame>=r GROUP BY a, b),
cnt AS (SELECT a, b, CAST(sum(CASE WHEN n=2 THEN 1 ELSE -1 END) AS BIGINT) cnt FROM (SELECT a, b, m.frame, count(*) n FROM first_ JOIN moves m ON m.label IN (a, b) AND m.frame>=f GROUP BY a, b, m.frame) GROUP BY a, b)"""


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def box(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.crop(t.points(spark, sf_dir))


def voxels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.voxels(box(spark, sf_dir))


def crossing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.voxels(spatial.crop(t.crossing(spark, sf_dir)))
