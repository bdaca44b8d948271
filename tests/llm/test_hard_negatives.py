import duckdb
import numpy as np
import pytest

from pointfold.llm import hard_negatives as H
from pointfold.llm.hard_negatives import OP12_SQL, Tree, mined, op12_hard_negatives, tiled


def brute(rows, anchors, positives=5, negatives=10, low=30, high=90):
    """rows: (vec_id, label, whole numbers) of those that take part; anchors: places of them."""
    out = []
    for a in anchors:
        i, label, q = rows[a]
        scored = [(-sum(u * v for u, v in zip(q, x, strict=True)), j, other) for b, (j, other, x) in enumerate(rows) if b != a and len(x) == len(q)]
        for p, pid, _ in sorted(r for r in scored if r[2] == label)[:positives]:
            ok = sorted((s, j) for s, j, other in scored if other != label and low * -p <= 100 * -s <= high * -p)
            out += [(i, pid, r + 1, j, -p, -s) for r, (s, j) in enumerate(ok[:negatives])]
    return sorted(out)


def got_of(df):
    return sorted((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in df.collect())


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.1"])
def test_query(spark, sf):
    path = f"/root/testdata/{sf}/embeddings.parquet"
    rows = []
    for r in spark.read.parquet(path).collect():
        label = (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label
        rows.append((r.vec_id, label, [int(np.floor(256 * float(c))) for c in r.embedding]))
    want = brute(rows, [n for n, r in enumerate(rows) if r[0] % 100 == 0])
    assert got_of(op12_hard_negatives(spark, f"/root/testdata/{sf}")) == want
    c = duckdb.connect()
    c.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{path}'")
    cols = "anchor_id, positive_id, rank, negative_id, positive_score, negative_score"
    assert sorted(c.sql(f"SELECT {cols} FROM ({OP12_SQL})").fetchall()) == want


def test_queue_prunes_and_stays_exact():
    r = np.random.default_rng(4)
    centres = r.integers(-2000, 2000, (40, 6))
    x = (centres[r.integers(0, 40, 8000)] + r.integers(-20, 20, (8000, 6))).astype(np.int64)
    label = r.integers(0, 4, 8000)
    order = tiled(x, label)
    assert sorted(order.tolist()) == list(range(8000))
    tree = Tree(order, label[order], x[order])
    read = []
    inside = tree.rows

    class Counting(np.ndarray):
        def __getitem__(self, at):
            out = np.asarray(super().__getitem__(at))
            read.append(len(out))
            return out

    tree.rows = inside.view(Counting)
    for n in range(0, 8000, 400):
        s = x @ x[n]
        for same in (True, False):
            windows = [(H.LOW, H.HIGH), (int(s.max()) // 3, int(s.max()) // 2), (5, 4)]
            for (lo, top), (at, score) in zip(windows, tree.search(x[n], int(label[n]), same, windows, 7), strict=True):
                want = sorted((-int(s[i]), i) for i in range(8000) if (label[i] == label[n]) == same and lo <= s[i] <= top)[:7]
                assert list(zip((-score).tolist(), tree.ids[at].tolist(), strict=True)) == want
    assert sum(read) < 0.25 * 8000 * 40  # most boxes are never opened


def test_ties_large_numbers_and_equal_rows():
    x = np.array([[10**7, -(10**7)]] * 5 + [[10**7, 10**7 - 1]] * 3, np.int64)
    tree = Tree(np.array([9, 3, 5, 1, 7, 2, 4, 6]), np.array([1, 2, 1, 2, 1, 2, 1, 2]), x)
    ((at, score),) = tree.search(np.array([10**7, 10**7]), 2, True, [(H.LOW, H.HIGH)], 3)
    assert tree.ids[at].tolist() == [2, 6, 1] and score.tolist() == [10**14 + 10**14 - 10**7] * 2 + [0]


def test_odd_input(spark):
    r = np.random.default_rng(5)
    v = r.normal(size=(260, 4))
    v[30:120] = v[30]  # ties: a third of all rows
    good = [(i, int(n), x.tolist()) for i, n, x in zip(range(260), r.integers(0, 3, 260), v, strict=True)]
    good += [good[7], good[100], good[100], (100, 1, [0.5, 0.5, 0.5, 0.5]), (300, 2, [3.0, 4.0]), (301, 2, [3.5, 4.0]), (302, 1, [1.0, 1.5]), (400, 1, [0.0] * 4), (401, 0, [1e4, -1e4, 3.0, 1.0])]
    odd = [(None, 1, [1.0] * 4), (500, None, [1.0] * 4), (600, 1, None), (700, 1, []), (800, 1, [1.0, None, 1.0, 1.0]), (900, 1, [float("nan")] * 4), (1000, 1, [float("inf")] * 4), (1100, 1, [1e30] * 4)]
    df = spark.createDataFrame([(*x, 3) for x in good + odd], "vec_id long, label int, embedding array<double>, score int").repartition(3)
    whole = [(i, n, [int(np.floor(256 * c)) for c in x]) for i, n, x in good]
    want, seen = [], set()
    for n, row in enumerate(whole):
        if row[0] % 20 == 0 and repr(row) not in seen:  # an anchor that repeats gives its rows once
            seen.add(repr(row))
            want += brute(whole, [n])
    got = got_of(mined(df, df.where("vec_id % 20 = 0"), rows=37))
    assert len(want) > 100 and got == sorted(want)
    assert {300} <= {g[0] for g in got}
    none = df.limit(0)
    assert mined(none, none).columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert mined(none, none).count() == mined(df, none).count() == 0
