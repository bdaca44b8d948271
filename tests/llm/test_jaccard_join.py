import random
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from pointfold.llm.jaccard_join import RTree, Sizes, alike, brute_force, class_links, classes, components, equal_groups, one_of_each, op5_jaccard_join, signatures


def corpus(seed: int):
    r = random.Random(seed)
    text = lambda n: [r.choice("abcdefghijklmnop") + r.choice("xyz") for _ in range(n)]
    out = [None, "", " \n", "one", "ONE", "one two", "one two", "a b c", "é É"]
    for n in (8, 20, 40, 90, 300):
        base = text(n)
        for _ in range(9):
            w = list(base)
            for _ in range(r.randint(0, max(1, n // 25))):
                w[r.randrange(n)] = "Edit" + str(r.randrange(3))
            out.append("  ".join(w[: r.randint(n - n // 12, n)]))
    out += [" ".join(text(r.randint(1, 30))) for _ in range(40)]
    ids = list(range(len(out)))
    r.shuffle(ids)
    return list(zip([None if i == 5 else i for i in ids], out, strict=True))


@pytest.mark.parametrize(("seed", "percent", "most"), [(1, 85, 4096), (2, 60, 4096), (3, 80, 3)])
def test_against_brute_force(spark, seed, percent, most):
    rows = corpus(seed)
    df = spark.createDataFrame([(*x, 1, 2) for x in rows], "doc_id long, text string, n int, c int").repartition(3)
    null = 2**63 - 1
    got = alike(df, 4, percent, most).select(*[F.when(F.col(c) != null, F.col(c)) for c in ("doc", "n", "component")]).collect()
    order = lambda x: str(x)
    assert sorted(map(tuple, got), key=order) == sorted(brute_force(rows, 4, percent), key=order)


def test_large_groups_go_in_pairs_of_parts(spark):
    rows = corpus(4)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    null = 2**63 - 1
    got = alike(df, 4, 80, 3, 2).select(*[F.when(F.col(c) != null, F.col(c)) for c in ("doc", "n", "component")]).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, brute_force(rows, 4, 80)))


@pytest.mark.parametrize("most", [4096, 3])
def test_every_link_of_every_class(spark, most):
    rows = [x for x in corpus(5) if x[0] is not None]
    pairs, members = class_links(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), 4, 70, most, most)
    of = {r.doc: r.c for r in members.collect()}
    sets = {}
    for i, t in rows:
        w = (t or "").lower().split() if (t or "").isascii() else (t or "").translate({c: c + 32 for c in range(65, 91)}).split()
        sets[i] = {tuple(w[k : k + 4]) for k in range(len(w) - 3)} or ({tuple(w)} if w else set())
    alike_ = {(i, j) for i, a in sets.items() for j, b in sets.items() if i != j and a and b and 100 * len(a & b) >= 70 * len(a | b)}
    got = pairs.collect()
    assert len({(r.a, r.b) for r in got}) == len(got)
    assert {(r.a, r.b) for r in got} == {(of[i], of[j]) for i, j in alike_ if sets[i] != sets[j]}
    assert {r.doc: r.links for r in members.collect()} == {i: sum(p[0] == i for p in alike_) for i in sets}
    assert any(r.same > 3 for r in got)


def test_query_against_brute_force(spark):
    rows = [(r["doc_id"], r["text"]) for r in pq.read_table("/root/testdata/sf0.001/documents.parquet").to_pylist()]
    assert sorted(map(tuple, op5_jaccard_join(spark, "/root/testdata/sf0.001").collect())) == sorted(brute_force(rows, 4, 85))


def test_one_of_each_and_no_rows(spark):
    t = " ".join(map(str, range(50)))
    df = spark.createDataFrame([(4, t, "a"), (2, t, "b"), (2, t, "b"), (3, t + " more", "c"), (9, None, "d"), (8, None, "d"), (None, t, "e")], "doc_id long, text string, root string")
    assert sorted(r.doc_id for r in one_of_each(df).collect()) == [2, 8, 9]
    assert one_of_each(df.limit(0)).count() == 0
    clash = df.selectExpr("*", "1 AS doc", "2 AS key", "3 AS row", "4 AS nr", "5 AS __doc")
    assert one_of_each(clash).columns == clash.columns
    assert one_of_each(clash).where("doc = 1 AND key = 2 AND row = 3 AND nr = 4 AND __doc = 5").count() == 3


def test_components_of_a_long_path(spark):
    links = spark.range(60).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")).where("a <> 30")
    got = {r.c: r.root for r in components(links).collect()}
    assert got == {i: 0 if i <= 30 else 31 for i in range(61) if i not in (0, 31)}


def test_tree_misses_nothing():
    r = np.random.default_rng(0)
    points = r.integers(0, 6, (500, 32))
    sizes = points.sum(1)
    tree = RTree(points, sizes)
    for i in range(0, 500, 17):
        bound = np.minimum(points, points[i]).sum(1)
        want = np.flatnonzero(160 * bound >= 60 * (sizes + sizes[i]))
        assert sorted(tree.near(points[i], int(sizes[i]), 60)) == want.tolist()


def test_sets_of_chance_share_no_group():
    """Empty groups did: of 2,000 sets of 400 n-grams over 100 had an equal one, a share of them whatever their number."""
    r = np.random.default_rng(0)
    for n in (40, 400, 2000):
        sizes, seen = Sizes(80), Counter()
        for _ in range(2000):
            seen.update(set(signatures(np.unique(r.integers(0, 2**64, n, dtype=np.uint64)), sizes).tolist()))
        assert max(seen.values()) <= 3


@pytest.mark.parametrize("percent", [60, 80, 85])
def test_alike_sets_share_a_group_however_their_hashes_lie(percent):
    """N-grams packed into few groups, each of which has a difference, so that only empty groups are equal; and differences dealt by chance."""
    r = np.random.default_rng(percent)
    sizes = Sizes(percent)
    only_empty = 0
    for n in (4, 9, 30, 90, 400, 1500):
        for trial in range(60):
            slots = r.choice(2**32, max((100 - percent) * n // percent // (trial % 4 + 1), 1), replace=False).astype(np.uint64)
            a = (np.concatenate([slots, r.choice(slots, max(n - len(slots), 0))])[:n] << np.uint64(32)) + np.arange(1, n + 1, dtype=np.uint64)
            more = r.integers(0, (100 - percent) * n // percent + 1)
            b = np.concatenate([a, (np.resize(slots, more) << np.uint64(32)) + np.arange(n + 1, n + 1 + more, dtype=np.uint64)])
            b = b[r.permutation(len(b))[: max(len(b) - int(r.integers(0, 3)), 1)]]
            same = len(np.intersect1d(a, b))
            if 100 * same < percent * (len(a) + len(b) - same) or (len(a) == len(b) == same):
                continue
            assert np.intersect1d(signatures(np.sort(a), sizes), signatures(np.sort(b), sizes)).size
            only_empty += more >= len(slots)
    assert only_empty > 50


def test_groups_of_the_same_classes_are_one(spark):
    """Two near copies have dozens of equal groups; the links of one are those of all."""
    words = [f"w{i}" for i in range(400)]
    rows = [(1, " ".join(words)), (2, " ".join([*words[:399], "other"])), (3, " ".join(words[::-1]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").select(F.col("doc_id").alias("doc"), F.col("doc_id").alias("key"), "text")
    packed = classes(docs, 4, 4, 85).where("part IS NOT NULL").select("part", "sig", "of")
    assert [r.m for r in equal_groups(packed, 4).collect()] == [2, 2]
