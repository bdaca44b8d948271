import random

import pyarrow.parquet as pq

from pointfold.llm.bpe import digest, encode, library, op7_bpe, vocabulary, word_bpe_path


def odd_texts() -> list[str | None]:
    r = random.Random(3)
    out = [None, "", " \t\r\n", "it's they'RE we'LL", "<|startoftext|>hi<|endoftext|><|endoftext|> x", "<|endoftext", "ΑΣ ΣΑΣ Σ", "İstanbul ǅ ß ẞ", "é ȩ́ Å ﬁ", "\x1c\x1d\x85\xa0 　a​b", "١٢٣ 12 ½ Ⅷ", "🙂🏳️‍🌈!!??", "x" * 5000, "ab" * 3000, "\x00\x01", "don't 'S 'Ve"]
    for _ in range(400):
        out.append("".join(chr(r.choice([r.randrange(32, 127), r.randrange(160, 600), r.randrange(0x300, 0x800), r.randrange(0x1E00, 0x2100), r.randrange(0x3000, 0x9000), r.randrange(0x1F300, 0x1F700)])) for _ in range(30)))
    return out


def test_as_the_library(spark):
    texts = odd_texts()
    df = spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts)], "doc_id long, text string, row int").repartition(3)
    got = {r[0]: tuple(r)[1:] for r in digest(encode(df, word_bpe_path())).collect()}
    for i, w in enumerate(library(texts, word_bpe_path())):
        assert got[i] == w, repr(texts[i])


def test_query_as_the_library(spark):
    rows = pq.read_table("/root/testdata/sf0.001/documents.parquet").to_pylist()
    want = {r["doc_id"]: w for r, w in zip(rows, library([r["text"] for r in rows], word_bpe_path()), strict=True)}
    assert {r[0]: tuple(r)[1:] for r in op7_bpe(spark, "/root/testdata/sf0.001").collect()} == want


def test_decoding_ids_and_no_rows(spark):
    v = vocabulary(word_bpe_path())
    ids, back, n = v.encode("Some words, <|endoftext|>twice twice")
    assert v.decode([int(x) for x in ids.split()]) == back
    assert len(ids.split()) == n
    assert encode(spark.createDataFrame([], "doc_id long, text string"), word_bpe_path()).count() == 0
