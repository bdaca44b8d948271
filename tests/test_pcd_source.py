"""Point-cloud files written and read back in their three encodings."""

import struct

import numpy as np
import pytest

from pointfold.sources import pcd_source as P


@pytest.fixture(autouse=True)
def registered(spark):
    spark.dataSource.register(P.PointClouds)


SCHEMA = "frame long, x double, y float, n int, h array<float>, s short"


def rows(n=500):
    r = np.random.default_rng(0)
    return [(i, float(v), float(np.float32(w)), int(k), [float(np.float32(a)) for a in h], i % 7) for i, (v, w, k, h) in enumerate(zip(r.normal(size=n), r.normal(size=n), r.integers(-9, 9, n), r.normal(size=(n, 3)), strict=True))]


@pytest.mark.parametrize("encoding", ["ascii", "binary", "binary_compressed"])
@pytest.mark.parametrize("split", [900, 1 << 20])
def test_written_and_read_back(spark, tmp_path, encoding, split):
    want = rows()
    df = spark.createDataFrame(want, SCHEMA).repartition(3)
    path = str(tmp_path / "clouds")
    df.write.format("pointcloud").option("encoding", encoding).mode("append").save(path)
    got = spark.read.format("pointcloud").option("split", split).load(path)
    assert got.columns == ["file", "row", "frame", "x", "y", "n", "h", "s"]
    assert got.schema["h"].dataType.simpleString() == "array<float>"
    assert sorted(tuple(r)[2:] for r in got.collect()) == want
    assert got.select("file", "row").distinct().count() == 500
    if split == 900 and encoding != "binary_compressed":
        assert got.rdd.getNumPartitions() > 20  # a file spreads over tasks
    df.limit(10).write.format("pointcloud").option("encoding", encoding).mode("overwrite").save(path)
    assert spark.read.format("pointcloud").load(path).count() == 10


def test_nulls_missing_fields_comments_and_empty_bodies(spark, tmp_path):
    (tmp_path / "a.pcd").write_text("#x is what this is\n# .PCD\nVERSION .7\nFIELDS x y _ rgb\nSIZE 4 4 1 4\nTYPE F F U U\nCOUNT 1 1 2 1\nWIDTH 3\nHEIGHT 1\nPOINTS 3\nDATA ascii\n1 nan 0 0 255\n#no point\n\n2.5 x 0 0 4294967295\n3 4 0 0 7")
    (tmp_path / "b.pcd").write_text("FIELDS y\nSIZE 8\nTYPE F\nCOUNT 1\nWIDTH 0\nHEIGHT 1\nPOINTS 0\nDATA binary\n")
    (tmp_path / "c.pcd").write_bytes(b"FIELDS y\nSIZE 8\nTYPE F\nCOUNT 1\nWIDTH 2\nHEIGHT 1\nPOINTS 2\nDATA binary\n" + struct.pack("<2d", 7.5, float("nan")))
    (tmp_path / "_SUCCESS").write_text("")
    got = spark.read.format("pointcloud").load(str(tmp_path))
    assert got.columns == ["file", "row", "x", "y", "rgb"]
    assert sorted([tuple(r)[2:] for r in got.collect()], key=repr) == sorted([(1.0, None, 255), (2.5, None, 4294967295), (3.0, 4.0, 7), (None, 7.5, None), (None, None, None)], key=repr)
    one = spark.read.format("pointcloud").schema("y double, z int").load(str(tmp_path / "c.pcd"))
    assert sorted(map(tuple, one.collect()), key=repr) == [(7.5, None), (None, None)]
    spark.createDataFrame([(1, None, None), (2, 5.0, [1.0, None])], "i int, x double, h array<double>").coalesce(1).write.format("pointcloud").mode("append").save(str(tmp_path / "nulls"))
    back = spark.read.format("pointcloud").load(str(tmp_path / "nulls"))
    assert sorted(map(tuple, back.select("i", "x", "h").collect())) == [(1, None, [None, None]), (2, 5.0, [1.0, None])]


def test_compression():
    r = np.random.default_rng(1)
    for data in (b"", b"a", b"ab" * 900, bytes(3000), r.integers(0, 4, 5000).astype(np.uint8).tobytes(), r.integers(0, 256, 5000).astype(np.uint8).tobytes()):
        assert P.expanded(P.compressed(data), len(data)) == data
    assert len(P.compressed(bytes(3000))) < 60
    # a reference that overlaps itself, and one with a long length
    assert P.expanded(bytes([0, 65, 32, 0]), 4) == b"AAAA"
    assert P.expanded(bytes([1, 65, 66, 224, 5, 1]), 16) == b"AB" * 8
    with pytest.raises(ValueError):
        P.expanded(bytes([0, 65]), 2)


@pytest.mark.parametrize("encoding", ["ascii", "binary", "binary_compressed"])
def test_a_task_holds_one_bounded_file_at_a_time(spark, tmp_path, encoding):
    want = rows()
    path = str(tmp_path / "clouds")
    spark.createDataFrame(want, SCHEMA).coalesce(1).write.format("pointcloud").option("encoding", encoding).option("points", 90).mode("append").save(path)
    got = spark.read.format("pointcloud").load(path)
    assert sorted(tuple(r)[2:] for r in got.collect()) == want
    assert sorted(r["count"] for r in got.groupBy("file").count().collect()) == [50, 90, 90, 90, 90, 90]


def test_batches_are_bounded(tmp_path):
    body = np.arange(2 * P.POINTS + 7, dtype="<f8")
    (tmp_path / "c.pcd").write_bytes(f"FIELDS y\nSIZE 8\nTYPE F\nCOUNT 1\nWIDTH {len(body)}\nHEIGHT 1\nPOINTS {len(body)}\nDATA binary\n".encode() + body.tobytes())
    source = P.PointClouds({"path": str(tmp_path / "c.pcd")})
    reader = source.reader(source.schema())
    batches = [b for part in reader.partitions() for b in reader.read(part)]
    assert [b.num_rows for b in batches] == [P.POINTS, P.POINTS, 7]
    assert [v for b in batches for v in b["row"].to_pylist()] == list(range(len(body)))
