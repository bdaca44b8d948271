"""A corpus pipeline: STAGES, each on all that the one before it kept.

toxicity: a text whose score reaches its language's threshold goes (0.7 where a language has too few labels to calibrate).
line_dedup: lines in ten or more documents go from all of them.
jaccard_join: of documents alike by five-word shingles (similarity 0.8 or more), linked directly or through others, one stays.
mixing: documents are repeated or left out so that sources come near their target weights.
bpe: token ids of what is left.

Odd input: a null text has score, lines, n-grams and tokens of an empty one, and the mix takes no text without words; a
text that is nothing but blanks stays until then; a null doc_id is the last of its group and of rows equal in doc_id and
text one stays; without labels of both kinds no text is toxic; empty tables give empty tables; other columns, whatever
their names, go through all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointfold.llm import bpe, jaccard_join, line_dedup, mixing, toxicity
from pointfold.llm.common import table, written


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows, _, cuts = toxicity.judged(docs, table(spark, sf_dir, "labels"), docs.columns)
    cut = F.lit(toxicity.THRESHOLD)
    for lang, at in sorted(cuts.items()):
        cut = F.when(F.col("lang") == lang, at).otherwise(cut)
    return rows.where(F.col("score") < cut).select("row.*")


def without_common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.drop_common_lines(docs, counts=False)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.one_of_each(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.take(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens, ids (decimal, one space between), decoded_sha256."""
    out = bpe.encode(docs.select("doc_id", "source", "text"), bpe.word_bpe_path())
    return out.select("doc_id", "source", F.col("__tokens").alias("n_tokens"), F.col("__ids").alias("ids"), F.sha2("__decoded", 256).alias("decoded_sha256"))


STAGES = [("toxicity", not_toxic), ("line_dedup", without_common_lines), ("jaccard_join", one_of_each), ("mixing", mixed), ("bpe", tokens)]
#: SQL can't express the classifier, the random rounding or BPE.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
