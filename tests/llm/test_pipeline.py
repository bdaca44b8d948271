import hashlib

import pyarrow.parquet as pq

import corpus_pipeline
from pointfold.llm import jaccard_join, line_dedup
from pointfold.llm.bpe import library, word_bpe_path
from pointfold.llm.common import table, written

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = table(spark, SF, "documents")
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    calm = written(stages["toxicity"](spark, docs, SF), "t1")
    assert calm.columns == columns
    assert 150 < calm.count() <= 200
    rows = sorted((r.doc_id, r.text) for r in calm.collect())
    lines = written(stages["line_dedup"](spark, calm, SF), "t2")
    assert lines.columns == columns
    want = {i: w for (i, _), w in zip(rows, line_dedup.brute_force(rows, 10), strict=True)}
    got = lines.collect()
    assert {r.doc_id: hashlib.sha256((r.text or "").encode()).hexdigest() for r in got} == {i: w[2] for i, w in want.items()}
    assert all(r.n_chars == len(r.text or "") for r in got)
    one = written(stages["jaccard_join"](spark, lines, SF), "t3")
    assert one.columns == columns
    rows = sorted((r.doc_id, r.text) for r in got)
    assert sorted(r.doc_id for r in one.collect()) == sorted(i for i, _, c in jaccard_join.brute_force(rows, 5, 80) if i == c)
    mix = written(stages["mixing"](spark, one, SF), "t4")
    assert mix.columns == columns
    assert {r.doc_id for r in mix.collect()} <= {r.doc_id for r in one.collect()}
    out = stages["bpe"](spark, mix, SF).collect()
    assert len(out) == mix.count()
    texts = {r.doc_id: r.text for r in mix.collect()}
    ids = sorted(texts)
    want = dict(zip(ids, library([texts[i] for i in ids], word_bpe_path()), strict=True))
    for r in out:
        assert (r.n_tokens, hashlib.sha256(r.ids.encode()).hexdigest(), r.decoded_sha256) == want[r.doc_id]


def test_run(spark):
    n = pq.read_metadata(f"{SF}/documents.parquet").num_rows
    assert 0 < corpus_pipeline.run(spark, SF).count() < 3 * n


def test_odd_input(spark, tmp_path):
    """Null, empty and very long texts, null and repeated ids, rows that repeat, extra columns with clashing names; empty tables."""
    long = " ".join(f"w{i % 997}" for i in range(60_000))
    rows = [(1, None, "en", "a"), (2, "", "en", None), (3, " \n\t", None, "a"), (4, long, "en", "b"), (4, long, "en", "b"), (None, "some text of no id at all", None, None), (None, None, None, None), (5, "x", "de", "a"), (5, "y z", "de", "a")]
    rows += [(10 + i, f"common line\nown words {i} {i * i} {i + 7} and some more", "fr", "c") for i in range(15)]
    names = ["part", "row", "__doc", "__score", "__lines", "doc", "key", "h", "id", "size", "__ids"]
    docs = spark.createDataFrame([(*r, len(r[1]) if r[1] is not None else None) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", *[f"{k} AS {n}" for k, n in enumerate(names)])
    labels = spark.createDataFrame([(1, 1, 0), (4, 0, 1), (5, None, None), (None, 1, 1), (12, 1, 0)], "doc_id long, quality int, toxic int")
    for which, some in (("rows", docs), ("none", docs.limit(0))):
        folder = str(tmp_path / which)
        some.write.parquet(f"{folder}/documents.parquet")
        (labels if which == "rows" else labels.limit(0)).write.parquet(f"{folder}/labels.parquet")
        now, kept = table(spark, folder, "documents"), {}
        for name, stage in corpus_pipeline.STAGES:
            now = written(stage(spark, now, folder), f"odd-{name}")
            kept[name] = now.collect()
            if name != "bpe":
                assert now.columns == docs.columns
        if which == "none":
            assert not any(kept.values())
            continue
        assert sorted(r.doc_id or 0 for r in kept["line_dedup"]) == sorted(r.doc_id or 0 for r in kept["toxicity"])
        assert all("common line" not in (r.text or "") for r in kept["line_dedup"])
        assert [r.doc_id for r in kept["jaccard_join"]].count(4) <= 1
        assert all(tuple(r[n] for n in names) == tuple(range(len(names))) for r in kept["mixing"])
        assert len(kept["bpe"]) == len(kept["mixing"]) > 0
        assert corpus_pipeline.run(spark, folder).count() == len(kept["bpe"])
