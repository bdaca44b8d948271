from fractions import Fraction

import numpy as np
import pyarrow.parquet as pq
import pytest

from pointfold.llm import whitening as W
from pointfold.llm.whitening import beyond, characteristic, combined, op11_whitening, primes, products, residues, whitened

SF = "/root/testdata/sf0.01"


def scatter_of(y):
    y = [[int(v) for v in r] for r in y]
    n, d = len(y), len(y[0])
    s = [sum(r[i] for r in y) for i in range(d)]
    return [[n * sum(r[i] * r[j] for r in y) - s[i] * s[j] for j in range(d)] for i in range(d)]


def faddeev(a):
    """det(t - a) by whole numbers, another way."""
    d, c = len(a), [1]
    m = [[0] * d for _ in range(d)]
    for k in range(1, d + 1):
        m = [[sum(a[i][l] * m[l][j] for l in range(d)) + (c[-1] if i == j else 0) for j in range(d)] for i in range(d)]
        t = sum(a[i][l] * m[l][i] for i in range(d) for l in range(d))
        c.append(-t // k)
    return c


def check(rows, got, most=8):
    """rows: (vec_id, vector) of those that take part, ids unlike."""
    ids = [i for i, _ in rows]
    x = np.floor(1024 * np.array([v for _, v in rows], float)) + 100000
    n, d = x.shape
    e, u = np.linalg.eigh(np.cov(x.T, bias=True).reshape(d, d))
    e, u = e[::-1], u[:, ::-1]
    k = min(most, int((e > e[0] * 1e-9).sum()))
    assert len(got) == n * k
    w = np.zeros((n, k))
    whole = [[int(v) for v in r] for r in x]
    sums = [sum(c) for c in zip(*whole, strict=True)]
    deviation = {i: sum((n * v - s) ** 2 for v, s in zip(r, sums, strict=True)) for i, r in zip(ids, whole, strict=True)}
    at = {i: j for j, i in enumerate(ids)}
    for r in got:
        w[at[r.vec_id], r.component - 1] = r.whitened
        assert r.n == n and int(r.deviation_text) == deviation[r.vec_id]
        assert r.deviation == (deviation[r.vec_id] if deviation[r.vec_id] < 2**63 else None)
        assert r.explained == pytest.approx(e[r.component - 1] / e.sum(), rel=1e-9)
        assert r.identity_error == got[0].identity_error
    c = w - w.mean(0)
    error = np.abs(c.T @ c / n - np.eye(k)).max()
    assert error < 1e-9 and abs(got[0].identity_error - error) < 1e-9
    return w, (x - x.mean(0)), e, u, k


def test_query(spark):
    table = pq.read_table(f"{SF}/embeddings.parquet").to_pylist()
    w, x, e, u, k = check([(r["vec_id"], r["embedding"]) for r in table], op11_whitening(spark, SF).collect())
    assert k == 8
    for j in range(k):  # either sign, the same for all rows
        want = x @ u[:, j] / np.sqrt(e[j])
        assert min(np.abs(w[:, j] - want).max(), np.abs(w[:, j] + want).max()) < 1e-8


def test_polynomial_equals_another_method(spark):
    y = np.random.default_rng(0).integers(-900, 900, (7, 6))
    a = scatter_of(y)
    want = faddeev(a)
    assert characteristic(spark, np.array(a, object)) == want
    ps = primes(2 * max(map(abs, want)))
    assert combined(ps, residues(np.array(a, object), np.array(ps)).tolist()) == want
    zero = np.array([[4, 0, 0], [0, 0, 0], [0, 0, 9]], object)  # no pivot
    assert characteristic(spark, zero) == [1, -13, 36, 0]


def test_roots_are_counted_with_their_number():
    c = [1, -7, 15, -9]  # (t - 1)(t - 3)^2
    assert [beyond(c, a, 1) for a in (0, 1, 2, 3, 5, 6, 7)] == [3, 3, 2, 2, 2, 0, 0]
    lo, s, above, m = W.isolated(c, 2, 7)
    assert m == 2 and above == 0 and Fraction(lo, 1 << s) < 3 <= Fraction(lo + 1, 1 << s)


def test_large_numbers_add_up_exactly():
    y = np.random.default_rng(2).integers(-(1 << 43), 1 << 43, (600, 3))
    want = [[sum(int(a) * int(b) for a, b in zip(y[:, i], y[:, j], strict=True)) for j in range(3)] for i in range(3)]
    assert products(y).tolist() == want
    small = y % 4_000_000
    assert products(small).tolist() == [[int(sum(small[:, i].astype(object) * small[:, j])) for j in range(3)] for i in range(3)]


def test_equal_eigenvalues_low_rank_and_close_ones(spark):
    cross = [(i, v.tolist()) for i, v in enumerate(np.concatenate([np.eye(5), -np.eye(5)]))]
    df = spark.createDataFrame(cross, "vec_id long, embedding array<double>")
    w, x, e, u, k = check(cross, whitened(df).collect())
    assert k == 5
    r = np.random.default_rng(3)
    few = [(i, v.tolist()) for i, v in enumerate(r.normal(size=(4, 12)))]
    assert check(few, whitened(spark.createDataFrame(few, df.schema)).collect())[-1] == 3
    close = [(i, v.tolist()) for i, v in enumerate(np.concatenate([np.diag([1000.0, 1000.0009765625, 3.0]), -np.diag([1000.0, 1000.0009765625, 3.0])]))]
    w, x, e, u, k = check(close, whitened(spark.createDataFrame(close, df.schema)).collect())
    assert np.abs(np.sort(np.abs(w).max(0)) - np.sqrt(3)).max() < 1e-9  # each component is one axis, near though the first two are


def test_odd_input(spark):
    r = np.random.default_rng(1)
    good = [(i, v.tolist()) for i, v in enumerate(r.normal(size=(40, 3)))]
    copies = [(100 + i, [0.5, -0.25, 0.125]) for i in range(20)]
    odd = [(50, None), (51, []), (52, [1.0, None, 2.0]), (53, [float("nan"), 1.0, 1.0]), (54, [float("inf"), 1.0, 1.0]), (55, [1.0, 2.0]), (56, [1e12, 1.0, 1.0])]
    df = spark.createDataFrame([(*x, 7) for x in good + odd + copies], "vec_id long, embedding array<double>, n int").repartition(3)
    check(good + copies, whitened(df).collect())
    null = spark.createDataFrame([(None, [1.0]), (None, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>")
    got = whitened(null).collect()
    assert len(got) == 3 and sum(x.vec_id is None for x in got) == 2 and got[0].explained == 1.0
    large = [(i, [v * 1e8]) for i, v in enumerate([1.0, 2.0, 40.0])]
    check(large, whitened(spark.createDataFrame(large, "vec_id long, embedding array<double>")).collect())
    for none in (df.limit(0), df.where("vec_id = 50"), df.where("vec_id = 1"), df.where("vec_id >= 100")):
        assert whitened(none).columns == whitened(df).columns
        assert whitened(none).count() == 0
