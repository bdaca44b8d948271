"""Angles between normals where products are zero, against plain Python."""

import math

import pytest
from pyspark.sql import functions as F

from pointfold.operators.descriptors import angle, with_bins


def test_zeros_keep_their_sign(spark):
    values = [0.0, -0.0, 1.0, -1.0, 0.5, -0.5]
    rows = [(y, x) for y in values for x in values]
    got = spark.createDataFrame(rows, "y double, x double").repartition(2).select("y", "x", angle(F.col("y"), F.col("x")).alias("a")).collect()
    assert len(got) == len(rows)
    for r in got:
        want = math.atan2(r.y, r.x)
        assert math.copysign(1, r.a) == math.copysign(1, want) or want == 0
        assert r.a == pytest.approx(want)


def test_bins_of_normals_that_meet_at_zero(spark):
    """A missing normal, and one at right angles to another with a negative part: the first angle is half a turn."""
    names = ["x", "y", "z", "nx", "ny", "nz"]
    pairs = [((0, 0, 0, -0.6, -0.8, 0.0), (0, 2, 0, 0.0, 0.0, -1.0)), ((0, 0, 0, -0.7, -0.7, -0.1), (1, 0, 0, 0.0, 0.0, 0.0)), ((0, 0, 0, 0.6, 0.8, 0.0), (0, 2, 0, 0.0, 0.0, 0.0))]
    kinds = ", ".join(f"{o}{n} {'long' if n in 'xyz' else 'double'}" for o in ("", "o_") for n in names)
    got = with_bins(spark.createDataFrame([(*a, *b) for a, b in pairs], kinds)).select("nx", "b0").collect()
    assert {r.nx: r.b0 for r in got} == {-0.6: 10, -0.7: 10, 0.6: 5}
