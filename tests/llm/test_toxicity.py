import zlib

import numpy as np
import pyarrow.parquet as pq

from pointfold.llm.toxicity import FILTERS, WIDTHS, Classifier, best_cut, for_threshold, hashed, held_out, judged, op10_toxicity, sample, scored, thresholds, train


def test_held_out_rows_rank_well(spark):
    sf = "/root/testdata/sf0.1"
    labels = {r["doc_id"]: r["toxic"] for r in pq.read_table(f"{sf}/labels.parquet").to_pylist()}
    lang = {r["doc_id"]: r["lang"] for r in pq.read_table(f"{sf}/documents.parquet", columns=["doc_id", "lang"]).to_pylist()}
    got = op10_toxicity(spark, sf).collect()
    assert len(got) == 10_000
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert 0 <= r.score <= 1
        assert r.predicted == int(r.score >= 0.7)
    test = [(r.score, labels[r.doc_id], lang[r.doc_id]) for r in got if r.held_out and r.doc_id in labels]
    assert auc([t[:2] for t in test]) > 0.97
    many = [k for k in set(lang.values()) if sum(y for _, y, x in test if x == k) >= 10]
    assert {"de", "en", "es", "fr"} == set(many)
    for k in many:
        assert auc([(s, y) for s, y, x in test if x == k]) > 0.95, k
    # clean documents stay and most toxic ones go
    for label, least in ((0, 0.97), (1, 0.85)):
        mine = [r.predicted == label for r in got if r.held_out and labels.get(r.doc_id) == label]
        assert sum(mine) / len(mine) > least, (label, sum(mine) / len(mine))


def auc(pairs):
    s, y = map(np.array, zip(*pairs, strict=True))
    rank = np.argsort(np.argsort(s))
    return (rank[y == 1].sum() - (y == 1).sum() * ((y == 1).sum() - 1) / 2) / ((y == 1).sum() * (y == 0).sum())


def test_words_and_odd_texts(spark):
    h = hashed("Trash, trash; TRASHED é")
    assert h.shape == (4, 3)
    assert (h[0] == h[1]).all()
    assert h[0, 0] != h[2, 0]
    assert (h[0, 1:] == h[2, 1:]).all()
    assert hashed(None).shape == (0, 3)
    model = Classifier()
    model.tabled()
    df = spark.createDataFrame([(1, None, 0.5), (2, "", 0.5), (2, "", 0.5), (None, "x " * 50_000, 0.1)], "doc_id long, text string, __score double")
    got = scored(df, model).collect()
    assert len(got) == 4
    assert len({r["__score"] for r in got if not r.text}) == 1
    assert scored(df.limit(0), model).count() == 0


def test_labels_that_teach_nothing(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, None), (None, 1), (2, 0)], "doc_id long, toxic int")
    model, cuts = train(docs, labels)
    assert model is None
    assert cuts == {}
    assert {r["__score"] for r in scored(docs, model).collect()} == {0.0}


def test_best_cut():
    assert best_cut(np.array([0.1, 0.9, 0.8, 0.2]), np.array([0.0, 1.0, 1.0, 0.0])) == 0.5


def test_thresholds_come_from_all_labelled_rows(spark):
    r = np.random.default_rng(3)
    rows = [(i, "ab"[i % 2], float(r.normal(2 * (i % 7 == 0), 1)), int(i % 7 == 0)) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, lang string, __logit double, toxic int")
    apart = {x.doc_id for x in df.where(for_threshold("doc_id")).collect()}
    rows = [x for x in rows if zlib.crc32(str(x[0]).encode()) % 3 != 1 and x[0] in apart]
    cut, by_lang = thresholds(df.drop("toxic"), df.select("doc_id", "toxic"))
    f1 = lambda own, at: (lambda p, y: 2 * (p & y).sum() / (p.sum() + y.sum()))(np.array([x[2] >= at for x in own]), np.array([x[3] == 1 for x in own]))
    for at, own in [(cut, rows), *[(by_lang[k], [x for x in rows if x[1] == k]) for k in "ab"]]:
        best = best_cut(np.array([x[2] for x in own]), np.array([float(x[3]) for x in own]))
        assert f1(own, at) > f1(own, best) - 0.01


def test_cut_is_the_same_whatever_the_sample(spark):
    """The sample has as many rows of either label and no long text; the cut still is the best one on all rows."""
    docs = spark.createDataFrame([(i, ("bad " if i % 10 == 0 else "good ") + f"w{i % 5} " * (8000 if i % 4 == 0 else 3) + ("bad" if i % 20 == 1 else "")) for i in range(400)], "doc_id long, text string")
    labels = docs.selectExpr("doc_id", "CAST(doc_id % 10 = 0 AS INT) AS toxic")
    got, model, _ = judged(docs, labels, ["doc_id"], 40)
    rows = [(x.score, float(x.toxic)) for x in got.select("row.doc_id", "score").join(labels, "doc_id").where(~held_out("doc_id")).collect()]
    s, y = map(np.array, zip(*rows, strict=True))
    f1 = lambda at: 2 * ((s >= at) & (y == 1)).sum() / ((s >= at).sum() + y.sum())
    assert f1(0.7) > f1(best_cut(s, y)) - 0.01


def test_scores_against_a_plain_forward_pass():
    r = np.random.default_rng(5)
    model = Classifier(3)
    model.bias[:] = r.normal(0, 0.2, len(model.bias))
    model.tabled()
    texts = [hashed(t) for t in ("", "one", "two words", "Some more words, and more; and more words", "z " * 50)]
    want, tops = [], []
    for t in texts:
        words = [sum(model.emb[j] for j in row) for row in t]
        z = []
        for size, width in enumerate(WIDTHS):
            for f in range(FILTERS):
                here = [sum(float(words[i + k] @ model.filters[size][k, :, f]) for k in range(width)) for i in range(len(words) - width + 1)]
                z.append(max([0.0] + [v + model.bias[size * FILTERS + f] for v in here]))
        tops.append(z)
        want.append(float(np.array(z) @ model.out + model.out_bias))
    assert np.allclose([model.logit(t) for t in texts], want, atol=1e-4)
    z, at, words, begin = model.pooled_batch(texts)
    assert np.allclose(z, tops, atol=1e-4)
    for i, t in enumerate(texts):
        one, spot = model.pooled(t, places=True)
        assert np.allclose(z[i], one, atol=1e-5)
        assert (np.where(at[i] >= 0, at[i] - begin[i], -1) == spot).all()


def test_gradients_against_differences():
    model = Classifier(4)
    texts = [hashed(t) for t in ("bad words here", "good ones", "", "x y z x y z")]
    y = np.array([1, 0, 0, 1])

    def loss() -> float:
        model.tabled()
        v = model.pooled_batch(texts)[0] @ model.out + model.out_bias
        return float(np.log1p(np.exp(-v * (2 * y - 1))).sum())

    model.tabled()
    z, at, words, _ = model.pooled_batch(texts)
    d = (1 / (1 + np.exp(-(z @ model.out + model.out_bias))) - y).astype(np.float32)
    params = [model.emb, *model.filters, model.bias, model.out]
    for p, g in zip(params, model.gradients(z, at, words, d), strict=True):
        for at_ in np.argsort(-np.abs(g.ravel()))[:3].tolist():
            old, e = p.ravel()[at_], 2e-3
            p.ravel()[at_] = old + e
            up = loss()
            p.ravel()[at_] = old - e
            down = loss()
            p.ravel()[at_] = old
            assert abs((up - down) / (2 * e) - g.ravel()[at_]) < 0.05 * max(1, abs(g.ravel()[at_]))


def test_sample_takes_one_text_of_a_repeated_id_and_no_row_for_thresholds(spark):
    docs = spark.createDataFrame([(i % 50, f"t{i}") for i in range(5000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    rows = sample(docs, labels, 1000)
    known = [x.doc_id for x in labels.where(~held_out("doc_id")).where(~for_threshold("doc_id")).collect() if x.doc_id < 50]
    assert sorted(r.text for r in rows) == sorted(min(f"t{i}" for i in range(k, 5000, 50)) for k in known)
