"""Operator 9: I-Match fingerprints over randomised parts of a lexicon.

Terms are the lower-cased words of a text. The lexicon holds the terms whose inverse document frequency is in a band,
counted exactly over all distinct texts. As the band's lower edge is a share of the texts, the lexicon has at most
1 / LOWEST times as many terms as a text has on average, whatever the corpus, and goes to all tasks as a bitmap of two
bits a term, sized by the counted terms (one other term in about 250 passes for one of them, the same one everywhere).
A fingerprint hashes the sorted distinct lexicon terms of the text that fall in each of PARTS random parts of the
lexicon. So that a part holds about one term of any text, long or short, the parts are thinned by a power of two (the
scale) that follows from the number of terms; so of a long text, a fixed random part of the lexicon's terms counts. The
hashes of the next LEVELS - 1 powers are kept too, to compare with longer texts.

Result for odd input: null text counts as empty; texts without lexicon terms all have the same fingerprint; rows that
share a doc_id follow one another in order of their texts' hashes; a null doc_id comes last in descending order; other
columns of `docs` are ignored; an empty table gives an empty result. A single document is its own next one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pointfold.llm.common import partitions, table, written

PARTS, LEVELS = 32, 4
#: The lexicon's band, as shares of the distinct texts; a term needs two texts at least, and one of up to ten is never too frequent.
LOWEST, HIGHEST = 1e-4, 0.05
SPLIT = r"[\x20\x09-\x0D]+"


def term_hashes(text: Column) -> Column:
    """Distinct hashes of the terms."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), SPLIT), lambda w: w != "")
    return F.array_distinct(F.transform(words, lambda w: F.xxhash64(w)))


def in_band(docs: DataFrame, lowest: float = LOWEST, highest: float = HIGHEST) -> DataFrame:
    """term (hash), df: the terms that enough and not too many distinct texts hold. Copies of a text count once, by a 128-bit hash; they are dropped, and terms counted, within a task before any move."""
    text = F.coalesce("text", F.lit(""))
    once = docs.select(F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2"), term_hashes(text).alias("of")).dropDuplicates(["k1", "k2"])
    # a row of each text goes under the term 0, so that one count gives the number of texts too
    seen = written(once.select(F.explode(F.concat("of", F.array(F.lit(0).cast("long")))).alias("term")).groupBy("term").agg(F.count("*").alias("df")), "terms")
    n = seen.where("term = 0").agg(F.coalesce(F.max("df"), F.lit(0))).scalar()
    least, most = F.greatest(F.lit(2.0), n * lowest), F.greatest(F.lit(10.0), n * highest)
    return seen.where((F.col("term") != 0) & (F.col("df") >= least) & (F.col("df") <= most))


def place(term: Column, words: int) -> tuple[Column, Column]:
    """Of a term: its word in a bitmap of so many (a power of two), and its two bits in it."""
    bit = lambda shift: F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(term, shift).bitwiseAND(63).cast("int"))
    return term.bitwiseAND(words - 1).cast("int"), bit(31).bitwiseOR(bit(37))


def lexicon(docs: DataFrame, lowest: float = LOWEST, highest: float = HIGHEST) -> tuple[DataFrame, int]:
    """One row, `lex`: the lexicon's bitmap as longs; and their number."""
    held = written(in_band(docs, lowest, highest).select("term"), "lexicon")
    size = max(1 << (held.count() // 2).bit_length(), 64)
    word, bits = place(F.col("term"), size)
    every = docs.sparkSession.range(0, size, 1, 1).select(F.col("id").cast("int").alias("w"), F.lit(0).cast("long").alias("bits"))
    full = held.select(word.alias("w"), bits.alias("bits")).union(every).groupBy("w").agg(F.bit_or("bits").alias("bits"))
    return full.agg(F.transform(F.sort_array(F.collect_list(F.struct("w", "bits"))), lambda x: x["bits"]).alias("lex")), size


def with_fingerprint(df: DataFrame, text: str, name: str, lex: tuple[DataFrame, int]) -> DataFrame:
    """Adds name: struct of scale, and parts: LEVELS arrays of PARTS hashes (0 for none), thinned by the scale, the next one and so on."""
    def held(h: Column) -> Column:
        word, bits = place(h, lex[1])
        # the bitmap is named once, so that Spark keeps it out of the rows
        return F.get(F.col("__lex"), word).bitwiseAND(bits) == bits

    keep = [c for c in df.columns if c != name]
    df = df.withColumn("__lex", lex[0].scalar()).select(*keep, F.array_sort(F.filter(term_hashes(F.col(text)), held)).alias("__terms"))
    df = df.withColumn("__scale", F.floor(F.log2(F.greatest(F.size("__terms"), F.lit(PARTS // 2)) / (PARTS / 2))).cast("int"))
    # thinned once for all levels; from here on a text has few terms
    thin = lambda h: F.shiftrightunsigned(h, 18)
    df = df.withColumn("__terms", F.filter("__terms", lambda h: thin(h).bitwiseAND(F.expr("shiftleft(1L, __scale)") - 1) == 0))
    part = lambda h: F.shiftrightunsigned(h, 59).cast("int")
    run = lambda p, h, out: F.struct(p.alias("p"), h.alias("h"), out.alias("out"))

    def hashes(terms: Column) -> Column:
        """The hash of each part. As a part is the first bits of a term, a part's terms follow one another in the sorted array: one pass with a running hash."""
        start = run(F.lit(-1), F.lit(0).cast("long"), F.array().cast("array<struct<p:int,h:bigint>>"))
        done = lambda a: F.concat(a["out"], F.array(F.struct(a["p"].alias("p"), a["h"].alias("h"))))
        runs = F.aggregate(terms, start, lambda a, t: F.when(part(t) == a["p"], run(a["p"], F.xxhash64(a["h"], t), a["out"])).otherwise(run(part(t), F.xxhash64(F.lit(9), t), done(a))), done)
        return F.map_from_entries(runs)

    def aligned(of: Column) -> Column:
        # named twice, so that Spark computes it before, and not within, the loop over parts
        return F.when(of.isNotNull(), F.transform(F.sequence(F.lit(0), F.lit(PARTS - 1)), lambda p: F.coalesce(F.try_element_at(of, p).bitwiseAND(2**32 - 1), F.lit(0).cast("long"))))

    levels = []
    for level in range(LEVELS):
        df = df.withColumn(f"__runs{level}", hashes(F.filter("__terms", lambda h: thin(h).bitwiseAND(F.expr(f"shiftleft({1 << level}L, __scale)") - 1) == 0)))
        levels.append(aligned(F.col(f"__runs{level}")))
    return df.select(*keep, F.struct(F.col("__scale").alias("scale"), F.array(*levels).alias("parts")).alias(name))


def as_text(f: Column) -> Column:
    hexed = lambda p: F.when(p == 0, "-").otherwise(F.lpad(F.lower(F.hex(p)), 8, "0"))
    return F.concat_ws("|", F.concat(f["scale"].cast("string")), F.array_join(F.transform(f["parts"], lambda x: F.array_join(F.transform(x, hexed), ".")), "|"))


def likeness(a: Column, b: Column) -> Column:
    """Equal parts among those that either text has terms in, at the larger scale of the two. 1 if the fingerprints are equal; 0 where scales are LEVELS or more apart, as one text then has over 2**(LEVELS - 1) times the terms of the other, and no more than that share can be equal."""
    top = F.greatest(a["scale"], b["scale"])
    x, y = (F.get(f["parts"], top - f["scale"]) for f in (a, b))
    pairs = F.filter(F.arrays_zip(x.alias("x"), y.alias("y")), lambda p: (p["x"] != 0) | (p["y"] != 0))
    same = F.size(F.filter(pairs, lambda p: p["x"] == p["y"]))
    return F.when(a == b, 1.0).when(F.size(pairs) > 0, same / F.size(pairs)).otherwise(0.0)


def with_next(docs: DataFrame, *carried: str, prepare: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """Adds next_<c> for each carried column: its value in the document that follows in descending doc_id, after the last the first. prepare: adds columns to carry, once to each row, where it lies.

    Documents are dealt by ranges of doc_id of about equal counts; rows that share one doc_id with many others, or have none,
    by ranges of their texts' hashes too. Each range also gets a copy of the first document of the next one, so no range
    has to look at another. Only rows equal in doc_id and text always lie together.
    """
    ranges = partitions(docs.sparkSession)
    # a sketch of bounded size
    cuts = F.percentile_approx("doc_id", F.array(*[F.lit(i / ranges) for i in range(1, ranges)]), 10_000) if ranges > 1 else F.array().cast("array<bigint>")
    ends = docs.select(F.col("doc_id").cast("long").alias("doc_id")).agg(cuts.alias("cuts"), F.count("*").alias("n"), F.count("doc_id").alias("known")).first()
    found = sorted(ends.cuts or [], reverse=True)
    bounds = F.array(*[F.lit(x).cast("long") for x in found]).cast("array<bigint>")
    u = F.col("__tie").cast("double") / 2.0**64 + 0.5
    within = lambda first, more: first + F.least(F.floor(u * (more + 1)), more).cast("int")
    above, equal = F.size(F.filter("__cuts", lambda b: b > F.col("doc_id"))), F.size(F.filter("__cuts", lambda b: b == F.col("doc_id")))
    unknown = F.lit(ranges * (ends.n - ends.known) // max(ends.n, 1))
    order = ["__none", "__down", "__tie"]
    placed = docs.withColumns({"__none": F.col("doc_id").isNull(), "__down": F.bitwise_not(F.coalesce(F.col("doc_id").cast("long"), F.lit(0))), "__tie": F.xxhash64("doc_id", "text"), "__cuts": bounds})
    placed = placed.withColumn("__part", F.when(F.col("__none"), within(F.lit(len(found) + 1), unknown)).otherwise(within(above, equal))).drop("__cuts")
    # the first document of each range, for the range before it; the first of all, for the last: one row for each range
    first = placed.groupBy("__part").agg(F.min(F.struct(*order)).alias("f"))
    along = Window.orderBy("__part")
    to = F.coalesce(F.lag("__part").over(along), F.max("__part").over(Window.partitionBy()))
    edges = first.select("__part", "f.*", to.alias("__to"))
    copies = placed.join(F.broadcast(edges), ["__part", *order]).drop("__part").withColumnRenamed("__to", "__part").withColumn("__copy", F.lit(True))
    both = placed.withColumn("__copy", F.lit(False)).unionByName(copies).repartition(ranges, "__part")
    both = prepare(both)
    w = Window.partitionBy("__part").orderBy("__copy", *order)
    for c in carried:
        both = both.withColumn(f"next_{c}", F.lead(c).over(w))
    return both.where("NOT __copy").drop("__part", "__copy", *order)


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, text, fingerprint (see with_fingerprint) of every document."""
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return with_fingerprint(docs, "text", "fingerprint", lexicon(docs))


def op9_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    lex = lexicon(docs)
    both = with_next(docs, "text", "fp", prepare=lambda df: with_fingerprint(df, "text", "fp", lex))
    both = both.withColumn("n", F.length("text")).withColumn("half", F.floor(F.col("n") / 2).cast("int"))
    both = both.select("doc_id", "n", "fp", "next_fp", F.concat(F.expr("substring(text, 1, n - half)"), F.expr("substring(next_text, 1, half)")).alias("edited"))
    both = with_fingerprint(both, "edited", "edited_fp", lex)
    return both.select(
        "doc_id",
        F.col("n").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        as_text(F.col("fp")).alias("fingerprint"),
        as_text(F.col("edited_fp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"),
        likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
    )
