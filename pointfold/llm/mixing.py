"""Operator 8: mix sources to target weights, by pivotal rounding of how often each document is taken.

A source's share is its target over its size, so a document is taken floor(share) times and once more with the
probability of the fraction. The fractions are rounded dependently: two documents pass words from one to the other,
at random and without bias, until one of them is whole, and the one left over goes on. Groups of about `fan` documents of
one source and one size class (sizes between two powers of two) do this side by side, their residuals in the next round, and so on
up a tree, so a class's words stay as they are but for its last document's, which is rounded alone. What these last documents
leave of a source's target is settled by a few documents of each of its classes, drawn by hash: from large to small, each may be taken more or less often, and
of the ways to do so the BEAM nearest to the target go on. Random numbers are hashes, so reruns agree.

Result for odd input: null text has size 0 and is taken 0 words; null is a source of its own, after all others; rows
that repeat are documents of their own, which may be taken differently often; other columns pass through unchanged; an
empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pointfold.llm.common import WORD, table, written

#: Documents in a group, on average; a group is one row.
FAN = 32
#: Documents of each source and size class that may settle the rest, and ways to settle it that are kept; all of a source's are one row.
SETTLING, BEAM = 4, 64


def targets(sizes: DataFrame, weights: tuple[float, ...] = (1, 2, 3), cap: float = 3.0, share: float = 1.0) -> DataFrame:
    """source, source_size, target: `share` of all sizes by weight, but at most cap times a source's size; the excess goes to the others by weight, so all below their caps get the same per weight. A row for each source."""
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    s = s.withColumn("i", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    s = s.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("i") % len(weights) + 1).cast("int")))
    s = s.withColumn("most", F.col("source_size") * cap)
    by_level = Window.orderBy(F.col("most") / F.col("weight"), "i")
    everything = Window.partitionBy()
    s = s.withColumn("total", F.sum("source_size").over(everything) * share)
    # sources in the order in which they reach their caps: the first k are capped if the rest can then give no more than the level of the k-th
    s = s.withColumn("capped_before", F.sum("most").over(by_level) - F.col("most"))
    s = s.withColumn("weight_from", F.sum("weight").over(everything) - F.sum("weight").over(by_level) + F.col("weight"))
    s = s.withColumn("level", (F.col("total") - F.col("capped_before")) / F.col("weight_from"))
    s = s.withColumn("free", F.col("level") * F.col("weight") < F.col("most"))
    level = F.min(F.when(F.col("free"), F.struct("rank", "level"))).over(everything)["level"]
    s = s.withColumn("rank", F.row_number().over(by_level)).withColumn("at", level)
    return s.select("source", "source_size", F.when(F.col("at").isNull(), F.col("most")).otherwise(F.least("most", F.col("at") * F.col("weight"))).alias("target"))


def uniform(*cols: Column) -> Column:
    """A number in [0, 1) from a hash of cols."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 11) / float(1 << 53)


#: Two documents until one is whole. Of p words, moving `up` words raises the held one to whole or lowers the next one to none, moving `down` the other way; chances make the expectation stay. x.p and a.p are fractions, x.size and a.size words.
_PIVOT = """
aggregate(items, struct(cast(null AS bigint) AS id, cast(0 AS bigint) AS size, cast(0 AS double) AS p, cast(array() AS array<struct<id:bigint,extra:int>>) AS done),
  (a, x) -> CASE
    WHEN a.id IS NULL THEN struct(x.id AS id, x.size AS size, x.p AS p, a.done AS done)
    ELSE transform(array(struct(
        least((1 - a.p) * a.size, x.p * x.size) AS up,
        least(a.p * a.size, (1 - x.p) * x.size) AS down,
        shiftrightunsigned(xxhash64(a.id, x.id, {level}), 11) / 9007199254740992D AS u)),
      m -> CASE
        WHEN m.u * (m.up + m.down) < m.down THEN
          IF((1 - a.p) * a.size <= x.p * x.size,
            struct(x.id AS id, x.size AS size, greatest(x.p - m.up / x.size, 0D) AS p, concat(a.done, array(struct(a.id AS id, 1 AS extra))) AS done),
            struct(a.id AS id, a.size AS size, least(a.p + m.up / a.size, 1D) AS p, concat(a.done, array(struct(x.id AS id, 0 AS extra))) AS done))
        ELSE
          IF(a.p * a.size <= (1 - x.p) * x.size,
            struct(x.id AS id, x.size AS size, least(x.p + m.down / x.size, 1D) AS p, concat(a.done, array(struct(a.id AS id, 0 AS extra))) AS done),
            struct(a.id AS id, a.size AS size, greatest(a.p - m.down / a.size, 0D) AS p, concat(a.done, array(struct(x.id AS id, 1 AS extra))) AS done))
      END)[0]
  END)
"""


def size_class(size: Column) -> Column:
    return F.floor(F.log2(size)).cast("int")


def rounded(fractions: DataFrame, fan: int = FAN) -> DataFrame:
    """id and extra (0 or 1) for rows source, id, size and p, a fraction, so that for each source and size class the sum of size * extra is that of size * p but for the rest of one document."""
    level, out = 0, None
    rest = fractions.select("source", size_class(F.col("size")).alias("class"), "id", "size", "p")
    while True:
        count = rest.groupBy("source", "class").agg(F.count("*").alias("n"))
        most = count.agg(F.max("n")).first()[0] or 0
        if most <= 1:
            break
        groups = F.ceil(F.col("n") / fan).cast("long")
        same = F.col("source").eqNullSafe(F.col("of")) & (F.col("class") == F.col("of_class"))
        dealt = rest.join(count.withColumnsRenamed({"source": "of", "class": "of_class"}), same).withColumn("g", F.pmod(F.xxhash64(F.lit(level), "id"), groups))
        item = F.struct(F.xxhash64(F.lit(-level - 1), "id").alias("by"), "id", "size", "p")
        packed = dealt.groupBy("source", "class", "g").agg(F.sort_array(F.collect_list(item)).alias("items"))
        done = written(packed.select("source", "class", F.expr(_PIVOT.format(level=level)).alias("a")), f"round{level}")
        settled = done.select(F.explode("a.done").alias("d")).select("d.id", "d.extra")
        out = settled if out is None else out.union(settled)
        rest = done.select("source", "class", F.col("a.id").alias("id"), F.col("a.size").alias("size"), F.col("a.p").alias("p"))
        level += 1
    last = rest.select("id", (uniform(F.lit(-1), F.col("id")) < F.col("p")).cast("int").alias("extra"))
    return last if out is None else out.union(last)


#: Ways to take the items, largest first, each from 0 to `most` times: sorted by how far the source is off its target, then by how much was changed; of ways with the same gap one is kept.
_SETTLE = """
aggregate(items, array(struct(abs(gap) AS off, 0L AS moved, gap AS gap, cast(array() AS array<int>) AS picks)),
  (ways, x) -> slice(transform(
    array(array_sort(flatten(transform(ways, w -> transform(sequence(0, {most}), n -> struct(
      abs(w.gap - (n - x.copies) * x.size) AS off,
      w.moved + abs(n - x.copies) AS moved,
      w.gap - (n - x.copies) * x.size AS gap,
      concat(w.picks, array(n)) AS picks)))))),
    all -> filter(all, (w, i) -> i = 0 OR w.gap <> all[i - 1].gap))[0], 1, {beam}),
  ways -> ways[0].picks)
"""


def settling(rows: DataFrame, most: int, beam: int = BEAM) -> DataFrame:
    """id and copies of the documents that settle what rows (source, id, size, copies, target) leave of each source's target."""
    gaps = rows.groupBy("source").agg((F.max("target") - F.sum(F.col("copies") * F.col("size"))).alias("gap")).withColumnRenamed("source", "of")
    drawn = Window.partitionBy("source", size_class(F.col("size"))).orderBy(F.xxhash64(F.lit(-2), "id"), "id")
    some = rows.where("size > 0").select("source", "id", "size", "copies", F.row_number().over(drawn).alias("nth")).where(F.col("nth") <= SETTLING)
    items = some.groupBy("source").agg(F.sort_array(F.collect_list(F.struct((-F.col("size")).alias("by"), "id", "size", "copies"))).alias("items"))
    picks = items.join(gaps, F.col("source").eqNullSafe(F.col("of"))).select("items", F.expr(_SETTLE.format(most=most, beam=beam)).alias("picks"))
    return picks.select(F.explode(F.arrays_zip("items.id", "picks")).alias("x")).select(F.col("x.id").alias("id"), F.col("x.picks").alias("copies"))


def numbered(rows: DataFrame, *keys: str) -> DataFrame:
    """id: the same for a row in every run, different for rows that repeat."""
    same = Window.partitionBy(*keys).orderBy(F.lit(0))
    return rows.withColumn("id", F.xxhash64(*keys, F.row_number().over(same)))


def mix(docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), cap: float = 3.0, share: float = 1.0, fan: int = FAN) -> DataFrame:
    """A row for each of docs (doc_id, source, size), with source_size, target and copies, how often the mix takes it."""
    small = docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), F.xxhash64("text").alias("h"))
    small = written(numbered(small, "doc_id", "source", "h"), "sizes")
    goal = written(targets(small, weights, cap, share).withColumnRenamed("source", "of"), "targets")
    all_ = small.join(goal, F.col("source").eqNullSafe(F.col("of"))).drop("of").withColumn("share", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
    all_ = all_.withColumn("whole", F.floor("share").cast("int")).withColumn("p", F.col("share") - F.col("whole"))
    extra = rounded(all_.where("p > 0 AND size > 0"), fan)
    copies = F.when(F.col("size") > 0, F.col("whole") + F.coalesce("extra", F.lit(0))).otherwise(0).alias("copies")
    out = written(all_.join(extra, "id", "left").select("doc_id", "source", "h", "id", "size", "source_size", "target", copies), "rounded")
    anew = settling(out, int(cap)).withColumnRenamed("copies", "anew")
    return out.join(anew, "id", "left").select(*[c for c in out.columns if c != "copies"], F.coalesce("anew", "copies").alias("copies"))


def take(docs: DataFrame, **kwargs: object) -> DataFrame:
    """The rows of docs, each as often as the mix takes it, with the columns of docs."""
    copies = mix(docs, **kwargs).groupBy("doc_id", "source", "h").agg(F.sum("copies").alias("copies"), F.count("*").alias("rows"))
    keyed = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", "source", F.xxhash64("text").alias("h"))
    c = copies.select(F.col("doc_id").alias("d"), F.col("source").alias("s"), F.col("h").alias("k"), "copies", "rows").where("copies > 0")
    joined = keyed.join(c, F.col("doc_id").eqNullSafe(F.col("d")) & F.col("source").eqNullSafe(F.col("s")) & (F.col("h") == F.col("k")))
    # rows that repeat share their copies evenly, what is left over by their number
    many = joined.where("rows > 1").withColumn("i", F.row_number().over(Window.partitionBy("d", "s", "k").orderBy(F.lit(0))))
    many = many.withColumn("n", F.floor(F.col("copies") / F.col("rows")) + (F.col("i") <= F.col("copies") % F.col("rows")).cast("long"))
    every = joined.where("rows = 1").select("row", F.col("copies").alias("n")).union(many.select("row", "n"))
    return every.where("n > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("n").cast("int")))).select("row.*")


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))
