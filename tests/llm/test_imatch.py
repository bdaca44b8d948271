import hashlib
import random
import re

import pyarrow.parquet as pq
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from pointfold.llm.imatch import fingerprints, in_band, likeness, op9_imatch, with_next


def test_query_against_plain_python(spark):
    rows = sorted(pq.read_table("/root/testdata/sf0.01/documents.parquet").to_pylist(), key=lambda r: -r["doc_id"])
    got = {r.doc_id: r for r in op9_imatch(spark, "/root/testdata/sf0.01").collect()}
    assert len(got) == len(rows)
    by_text: dict = {}
    for r, nxt in zip(rows, [*rows[1:], rows[0]], strict=True):
        t, x = r["text"], got[r["doc_id"]]
        half = len(t) // 2
        edited = t[: len(t) - half] + nxt["text"][:half]
        assert x.n_chars == len(t)
        assert x.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert by_text.setdefault(t, x.fingerprint) == x.fingerprint
        assert 0 <= x.near_next <= 1
    mean = lambda f: sum(map(f, got.values())) / len(got)
    assert mean(lambda x: x.near_edited) > 0.2
    assert mean(lambda x: x.near_next) < 0.1
    assert len({x.fingerprint for x in got.values()}) > 0.9 * len(by_text)


@pytest.mark.parametrize("n", [1, 2, 40])
def test_next(spark, n):
    r = random.Random(n)
    ids = [r.randrange(10**9) ** 2 for _ in range(n - 1)] + [None]
    df = spark.createDataFrame([(i, f"t{i}") for i in ids], "doc_id long, text string").repartition(3)
    ordered = sorted(ids, key=lambda i: (i is None, -(i or 0)))
    want = {a: f"t{b}" for a, b in zip(ordered, [*ordered[1:], ordered[0]], strict=True)}
    assert {x.doc_id: x.next_text for x in with_next(df, "text").collect()} == want


def test_repeated_rows_and_no_rows(spark):
    df = spark.createDataFrame([(1, "a b c", 1), (1, "a b c", 2), (2, None, 3), (3, "", 4)], "doc_id long, text string, lex int")
    got = fingerprints(df).select("doc_id", F.col("fingerprint.parts").alias("f")).collect()
    assert len({str(r.f) for r in got if r.doc_id == 1}) == 1
    assert len({str(r.f) for r in got if r.doc_id > 1}) == 1
    assert fingerprints(df.limit(0)).count() == 0
    assert with_next(df.limit(0), "text").count() == 0


def test_terms_of_a_large_group_of_copies_stay(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(40)) for x in "ab")
    texts = [a] * 100 + [f"{a} more"] + [b] * 100 + [f"{b} other"] + [f"w{i} v{i // 2}" for i in range(100)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.text: r.fingerprint.parts for r in fingerprints(df).where(F.col("text").isin(a, b)).collect()}
    assert all(any(parts[0]) for parts in got.values())
    assert got[a] != got[b]


def test_ids_at_both_ends_one_outlier_and_ids_shared_by_many(spark):
    ids = [-(2**63) + 1, 3, 2**63 - 1, None, None] + [7] * 300 + list(range(100, 400))
    df = spark.createDataFrame([(i, f"t{k} " * (k % 5)) for k, i in enumerate(ids)], "doc_id long, text string").repartition(3)
    df = df.withColumn("part", F.lit(1)).withColumn("own", F.lit("x")).withColumn("cell", F.lit(2)).withColumn("id", F.lit(0))
    rows = with_next(df.withColumn("at", F.struct(F.col("doc_id").isNull().alias("a"), (~F.col("doc_id").isNull()).alias("b"), "doc_id", "text")), "text", "doc_id").collect()
    ordered = sorted(rows, key=lambda r: (r.doc_id is None, -(r.doc_id or 0)))
    assert len(rows) == len(ids)
    assert sorted((r.next_doc_id is None, r.next_doc_id or 0) for r in rows) == sorted((i is None, i or 0) for i in ids)
    follows = {r.doc_id: r.next_doc_id for r in ordered if r.doc_id not in (7, None)}
    one_by_one = sorted({i for i in ids if i is not None}, reverse=True)
    assert all(follows[a] == b for a, b in zip(one_by_one, one_by_one[1:], strict=False) if a != 7)
    assert sum(r.doc_id == 7 and r.next_doc_id == 7 for r in rows) == 299
    sizes = with_next(df, "doc_id", prepare=lambda d: d.withColumn("__n", F.count("*").over(Window.partitionBy("__part")))).agg(F.max("__n")).first()[0]
    assert sizes < 0.6 * len(ids)


def test_fingerprints_against_plain_python(spark):
    """Band, parts and likenesses as written down in the docstring, over hashes from Spark."""
    r = random.Random(4)
    texts = [" ".join(f"w{int(r.paretovariate(0.4))}" for _ in range(r.choice([0, 3, 40, 400, 3000]))) for _ in range(80)] + ["Ab ab\x0bc", None, "ab c x" * 900]
    df = spark.createDataFrame(list(enumerate(texts + texts[:5])), "doc_id long, text string")
    band = {x.term for x in in_band(df).collect()}
    words = {t: {w for w in re.split(r"[\x20\x09-\x0D]+", (t or "").lower()) if w} for t in texts}
    seen = sorted({w for ws in words.values() for w in ws})
    hashes = dict(zip(seen, [x.h for x in spark.createDataFrame([(i, w) for i, w in enumerate(seen)], "i int, w string").select("i", F.xxhash64("w").alias("h")).orderBy("i").collect()], strict=True))
    distinct = {t or "" for t in texts}
    count = {h: sum(w in words.get(t, ()) for t in distinct) for w, h in hashes.items()}
    assert band == {h for h, n in count.items() if 2 <= n <= max(10, 0.05 * len(distinct))}
    fp = fingerprints(df)
    got = {x.text: x.fingerprint for x in fp.collect()}
    for t in texts:
        terms = {hashes[w] for w in words[t]} & band
        scale = max(len(terms) // 16, 1).bit_length() - 1
        f = got[t or ""]
        if abs(f.scale - scale) > 0:  # a term outside the band may pass for one inside
            continue
        for level in range(4):
            some = {h for h in terms if (h % 2**64 >> 18) % 2 ** (scale + level) == 0}
            assert all(f.parts[level][h % 2**64 >> 59] != 0 for h in some)
    pairs = fp.select(F.col("fingerprint").alias("a"), F.lit(1).alias("x")).join(fp.select(F.col("fingerprint").alias("b"), F.lit(1).alias("x")), "x")
    for x in pairs.select("a", "b", likeness(F.col("a"), F.col("b")).alias("l")).collect():
        top = max(x.a.scale, x.b.scale)
        if x.a == x.b:
            want = 1.0
        elif top - min(x.a.scale, x.b.scale) > 3:
            want = 0.0
        else:
            both = [(p, q) for p, q in zip(x.a.parts[top - x.a.scale], x.b.parts[top - x.b.scale], strict=True) if p or q]
            want = sum(p == q for p, q in both) / len(both) if both else 0.0
        assert x.l == want
