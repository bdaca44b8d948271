import math
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest

from pointfold.llm import quality
from pointfold.llm.quality import Regression, features, fitted, op13_quality, sample, scored

SF = "/root/testdata/sf0.01"


def plain_fit(texts, labels, epochs, order):
    """The updates one number at a time."""
    z, n = {}, {}

    def weight(i):
        a = z.get(i, 0.0)
        return 0.0 if abs(a) <= quality.L1 else -(a - math.copysign(quality.L1, a)) / ((quality.BETA + math.sqrt(n.get(i, 0.0))) / quality.ALPHA + quality.L2)

    for rows in order[:epochs]:
        for r in rows:
            at, size = texts[r]
            x = {int(i): float((at == i).sum()) / max(size, 1) for i in set(at.tolist())} | {quality.ROWS: 1.0}
            w = {i: weight(i) for i in x}
            p = 1 / (1 + math.exp(-sum(w[i] * v for i, v in x.items())))
            for i, v in x.items():
                g = (p - labels[r]) * v
                s = (math.sqrt(n.get(i, 0.0) + g * g) - math.sqrt(n.get(i, 0.0))) / quality.ALPHA
                z[i] = z.get(i, 0.0) + g - s * w[i]
                n[i] = n.get(i, 0.0) + g * g
    return weight, set(z)


def test_updates_are_those_of_plain_python():
    said = ["a b c a b", "A!! B!! C!!", "x y", "", "c b a 12 | x", "the the the the"]
    texts, y = [features(t) for t in said], np.array([1, 0, 1, 0, 1, 0.0])
    r = np.random.default_rng(1)
    weight, seen = plain_fit(texts, y, 4, [r.permutation(len(texts)).tolist() for _ in range(4)])
    m = Regression()
    m.fit(texts, y, epochs=4)
    for i in seen - {quality.ROWS}:
        assert m.weights[i] == pytest.approx(weight(i), abs=1e-6)
    assert m.bias == pytest.approx(weight(quality.ROWS), abs=1e-9)
    assert np.count_nonzero(m.weights) <= len(seen)
    at, size = texts[0]
    assert m.score(at, size) == pytest.approx(1 / (1 + math.exp(-(sum(weight(i) for i in at.tolist()) / size + m.bias))), abs=1e-6)


def test_features_are_n_grams():
    at, n = features("Ab cd\tAB  Cd")
    assert n == 4 and len(at) == 4 + 3 + 4 + 3 + 2 + 3
    words, pairs, shapes = at[:4], at[4:7], at[7:11]
    assert words[0] == words[2] and words[1] == words[3] and words[0] != words[1]
    assert pairs[0] == pairs[2] != pairs[1]
    assert shapes[0] == shapes[3] and len({*shapes[:3].tolist()}) == 3
    repeats = features("a a b")[0][-2:]
    assert repeats[0] != repeats[1] and repeats[1] == features("q r")[0][-1]
    assert features(None)[1] == features("")[1] == features(" \n")[1] == 0


def test_held_out_documents(spark):
    labels = {r["doc_id"]: r["quality"] for r in pq.read_table(f"{SF}/labels.parquet").to_pylist()}
    docs = pq.read_table(f"{SF}/documents.parquet").num_rows
    got = op13_quality(spark, SF).collect()
    assert len(got) == docs
    out = [r for r in got if r.held_out and r.doc_id in labels]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    for label in (0, 1):
        mine = [r.predicted == label for r in out if labels[r.doc_id] == label]
        assert len(mine) > 10 and sum(mine) / len(mine) > 0.95


def test_only_rows_to_learn_from_are_used(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    turned = labels.selectExpr("doc_id", "IF(crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 3 = 1, 1 - quality, quality) AS quality")
    a, b = fitted(docs, labels), fitted(docs.selectExpr("doc_id", "text", "'x' AS lang", "'y' AS source"), turned)
    assert (a.weights == b.weights).all() and a.bias == b.bias
    few = sample(docs, labels, 50)
    assert len(few) == 50 and few == sample(docs.repartition(5), labels.repartition(3), 50)


def test_odd_input(spark):
    text = "word " * 30_000 + "end!!"
    rows = [(1, None, 1, "s"), (2, "", 2, "s"), (None, "Good words here", 3, "s"), (3, "Good words here", 4, None), (3, "Good words here", 5, "t"), (4, text, 6, "u")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score long, row string")
    labels = spark.createDataFrame([(1, None, 0), (None, 1, 0), (3, 1, 0), (3, 0, 0), (9, 0, 1), (2, 7, 1)], "doc_id long, quality int, text int")
    m = fitted(docs, labels)
    got = scored(docs, m, docs.columns).select("row.*", "score").collect()
    assert len(got) == 6 and len(got[0]) == 5
    by = {r[2]: r[4] for r in got}
    assert by[1] == by[2] and by[3] == by[4] == by[5]
    none = fitted(docs, labels.limit(0))
    assert {r.score for r in scored(docs, none, ["doc_id"]).collect()} == {0.5}
    assert scored(docs.limit(0), m, ["doc_id"]).count() == 0
    assert fitted(docs.limit(0), labels).bias == 0.0
