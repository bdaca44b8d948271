"""Operator 10: toxicity by a convolutional text classifier, trained here in numpy.

A text is its words, lower-cased and without punctuation at their ends, each embedded as the sum of hashed rows for
the word and for its first four and five bytes. Filters of several widths run over the words, the largest value of each filter
over the whole text goes to a logistic layer. As filters are linear, their values for every hash row are tabled once
and a text costs look-ups and sums only.

Fitting uses at most SAMPLE labelled rows, those with the least hashes of their ids, evenly from both labels, on the
driver (a bounded size, whatever the corpus), a batch of texts at a time. Thresholds come from the labelled rows that
are neither held out nor open to fitting, one in CALIBRATE of those to learn from, all of them and whole texts included,
counted by bins of their values: the score is shifted so that the best threshold is 0.7 overall, and `thresholds` gives
one for each language. Where these hold fewer than LEAST rows of a label, all rows to learn from give the threshold.

Result for odd input: null and empty texts have no words and a constant low score; labels that are null or whose doc_id
is null or unknown aren't used; of rows that share a doc_id, the least text is fitted on; if a label is missing altogether, all scores are 0; repeated rows score alike; other
columns pass through unchanged; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pointfold.llm.common import SPACE, in_batches, table, word_hashes, written

#: Bounds of what the driver fits on: rows, and bytes of their texts (longer texts wait for the next fit).
SAMPLE, SAMPLE_TEXT = 6_000, 20_000
ROWS, DIM, WIDTHS, FILTERS, SEEN = 1 << 15, 12, (1, 2, 3), 10, 20_000
THRESHOLD = 0.7
#: One in so many rows to learn from is kept for thresholds; rows of each label that a threshold needs.
CALIBRATE, LEAST = 4, 20
#: Bins of values before the logistic function, for each unit; values beyond LIMIT count as LIMIT.
BINS, LIMIT = 64, 30.0

_EDGE = np.zeros(256, bool)
_EDGE[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[np.flatnonzero(_EDGE)] = 32


def hashed(text: str | None) -> np.ndarray:
    """Rows of the embedding for each word: (words, 3), for the word and for its first four and five bytes. Punctuation counts as white space, letters A-Z as small ones."""
    buf = _FOLD[np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)]
    part = np.uint64(ROWS // 4)
    rows = [(word_hashes(buf) % part).astype(np.int32) + ROWS // 2]
    inside = ~SPACE[buf]
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    from_start = np.arange(len(buf)) - np.maximum.accumulate(np.where(start, np.arange(len(buf)), 0)) if len(buf) else buf
    for k, most in enumerate((4, 5)):
        # the first letters alone, as words of their own: same number and order
        head = np.where(inside & (from_start < most), buf, 32).astype(np.uint8)
        rows.append((word_hashes(head) % part).astype(np.int32) + np.int32(k * (ROWS // 4)))
    return np.stack(rows, 1)


class Classifier:
    def __init__(self, seed: int = 0) -> None:
        r = np.random.default_rng(seed)
        # small, so that words that fitting never met add little to the largest values
        self.emb = r.normal(0, 0.03, (ROWS, DIM)).astype(np.float32)
        self.filters = [r.normal(0, 0.3, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.bias = np.zeros(len(WIDTHS) * FILTERS, np.float32)
        self.out = r.normal(0, 0.3, len(WIDTHS) * FILTERS).astype(np.float32)
        self.out_bias = np.float32(-2)
        self.shift = 0.0

    def tabled(self) -> None:
        """The value at every filter position for every hash row, side by side."""
        self.table = np.concatenate([self.emb @ f[k] for f, w in zip(self.filters, WIDTHS, strict=True) for k in range(w)], 1)

    def pooled(self, words: np.ndarray, places: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """Largest value of each filter, at least 0, and where it was (-1: nowhere)."""
        v = self.table[words[:, 0]]
        for j in range(1, words.shape[1]):
            v += self.table[words[:, j]]
        best, where, at = [], [], 0
        for w in WIDTHS:
            n = len(words) - w + 1
            if n <= 0:
                best.append(np.full(FILTERS, -np.inf, np.float32))
                where.append(np.full(FILTERS, -1))
            else:
                x = v[:n, at : at + FILTERS]
                for k in range(1, w):
                    x = x + v[k : k + n, at + k * FILTERS : at + (k + 1) * FILTERS]
                best.append(x.max(0))
                if places:
                    where.append(x.argmax(0))
            at += w * FILTERS
        z = np.concatenate(best) + self.bias
        if not places:
            return np.maximum(z, 0), None
        spot = np.concatenate(where)
        spot[z <= 0] = -1
        return np.maximum(z, 0), spot

    def logit(self, words: np.ndarray) -> float:
        return float(self.pooled(words)[0] @ self.out + self.out_bias) + self.shift

    def pooled_batch(self, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """As pooled, of several texts side by side: (texts, filters) values and places, all words, and where each text begins among them. After each text stand as many words of no value as the widest filter needs."""
        gap = max(WIDTHS) - 1
        size = np.array([len(t) + gap for t in texts])
        begin = np.concatenate([[0], np.cumsum(size)])
        words = np.full((begin[-1], 3), -1, np.int32)
        for t, lo in zip(texts, begin[:-1], strict=True):
            words[lo : lo + len(t)] = t
        blank = words[:, 0] < 0
        v = self.table[words[:, 0]] + self.table[words[:, 1]] + self.table[words[:, 2]]
        v[blank] = -np.inf
        best, where, at = [], [], 0
        for w in WIDTHS:
            n = begin[-1] - gap
            x = v[:n, at : at + FILTERS].copy()
            for k in range(1, w):
                x += v[k : k + n, at + k * FILTERS : at + (k + 1) * FILTERS]
            x = np.concatenate([x, np.full((gap, FILTERS), -np.inf, np.float32)])
            top = np.maximum.reduceat(x, begin[:-1])
            first = np.where(x == np.repeat(top, size, axis=0), np.arange(begin[-1])[:, None], begin[-1])
            best.append(top)
            where.append(np.minimum.reduceat(first, begin[:-1]))
            at += w * FILTERS
        z = np.concatenate(best, 1) + self.bias
        spot = np.concatenate(where, 1)
        spot[~(z > 0)] = -1
        return np.maximum(z, 0), spot, words, begin

    def fit(self, texts: list[np.ndarray], labels: np.ndarray, epochs: int | None = None, batch: int = 64, rate: float = 0.05, seed: int = 1) -> None:
        r = np.random.default_rng(seed)
        params = [self.emb, *self.filters, self.bias, self.out]
        power = [np.full_like(p, 1e-6) for p in params]
        weight = np.where(labels == 1, 0.5 / max(labels.mean(), 1e-6), 0.5 / max(1 - labels.mean(), 1e-6))
        for _ in range(epochs or min(max(-(-SEEN // len(texts)), 4), 12)):
            order = r.permutation(len(texts))
            for lo in range(0, len(order), batch):
                part = order[lo : lo + batch]
                self.tabled()
                z, at, words, _ = self.pooled_batch([texts[i] for i in part])
                d = ((1 / (1 + np.exp(-(z @ self.out + self.out_bias))) - labels[part]) * weight[part] / len(part)).astype(np.float32)
                g = self.gradients(z, at, words, d)
                self.out_bias -= np.float32(rate) * d.sum()
                for p, q, x in zip(params, power, g, strict=True):
                    q += x * x
                    p -= np.float32(rate) * x / np.sqrt(q) * (x != 0)
        self.tabled()

    def gradients(self, z: np.ndarray, at: np.ndarray, words: np.ndarray, d: np.ndarray) -> list[np.ndarray]:
        """Of embedding, filters, bias and output, for d: each text's gradient before the logistic function. Only the place of a filter's largest value counts."""
        g = [np.zeros_like(p) for p in (self.emb, *self.filters)]
        live = at >= 0
        dz = np.where(live, d[:, None] * self.out, 0).astype(np.float32)
        for size, width in enumerate(WIDTHS):
            cols = slice(size * FILTERS, (size + 1) * FILTERS)
            dw, i = dz[:, cols], np.maximum(at[:, cols], 0)
            for k in range(width):
                rows = words[np.minimum(i + k, len(words) - 1)]
                rows = np.where(live[:, cols, None], rows, 0)
                g[1 + size][k] = np.einsum("bf,bfd->df", dw, self.emb[rows].sum(2))
                np.add.at(g[0], rows, (dw[:, :, None] * self.filters[size][k].T)[:, :, None, :])
        return [*g, dz.sum(0), d @ z]


def best_cut(scores: np.ndarray, labels: np.ndarray) -> float:
    """Halfway between the two scores between which the F1 of 'at least this score' is best."""
    order = np.argsort(-scores, kind="stable")
    s, y = scores[order], labels[order]
    f1 = 2 * np.cumsum(y) / (np.arange(1, len(y) + 1) + max(y.sum(), 1))
    k = int(f1.argmax())
    return float((s[k] + s[k + 1]) / 2) if k + 1 < len(s) else float(s[k]) - 1e-3


def held_out(doc_id: object) -> object:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1


def labelled(labels: DataFrame) -> DataFrame:
    """doc_id and toxic of the labelled rows to learn from, one for each doc_id; never a held-out row."""
    known = labels.where("toxic IN (0, 1) AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    return known.where(~F.coalesce(held_out("doc_id"), F.lit(True)))


def for_threshold(doc_id: object) -> Column:
    """Rows to learn from that give thresholds and are never fitted on."""
    return F.pmod(F.xxhash64(F.lit(7), F.col(doc_id)), F.lit(CALIBRATE)) == 0


def sample(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> list:
    """Labelled rows to fit on: (text, toxic), at most `most`, half of each label if there are as many. Ordered by a hash of doc_id, so reruns agree. Only a bounded number of ids is taken before texts are looked up, and of each one text, chosen before rows move."""
    ids = labelled(labels).where(~for_threshold("doc_id")).withColumn("by", F.xxhash64("doc_id"))
    picked = ids.where("toxic = 1").orderBy("by").limit(most // 2).union(ids.where("toxic = 0").orderBy("by").limit(most // 2))
    texts = docs.where(F.length("text") <= SAMPLE_TEXT).select("doc_id", "text")
    rows = texts.join(F.broadcast(picked), "doc_id").groupBy("doc_id", "toxic", "by").agg(F.min("text").alias("text")).select("text", "toxic", "by").collect()
    return sorted(rows, key=lambda r: (r.by, r.text))


def fitted(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> Classifier | None:
    rows = sample(docs, labels, most)
    y = np.array([r.toxic for r in rows], float)
    if not len(y) or y.min() == y.max():
        return None
    model = Classifier()
    model.fit([hashed(r.text) for r in rows], y)
    return model


def thresholds(rows: DataFrame, labels: DataFrame) -> tuple[float, dict[str, float]]:
    """The cut over all rows for thresholds, and that of each language with at least LEAST of either label. rows: doc_id, lang, __logit.

    As best_cut, from counts of bins: only bins and labels of each language come together, one row of each to the driver.
    """
    # three kinds of counts: of all rows to learn from, of those for thresholds, and of the latter by language
    known = rows.join(labelled(labels), "doc_id").withColumn("apart", for_threshold("doc_id"))
    kinds = [F.struct(F.lit(k).alias("kind"), lang.alias("lang")) for k, lang in (("every", F.lit(None).cast("string")), ("apart", F.lit(None).cast("string")), ("lang", F.col("lang")))]
    own = known.select(F.explode(F.array(*kinds)).alias("of"), "__logit", "toxic", "apart").where("apart OR of.kind = 'every'").select("of.*", "__logit", "toxic")
    own = own.where("kind <> 'lang' OR lang IS NOT NULL").withColumn("bin", F.floor(F.greatest(F.least("__logit", F.lit(LIMIT)), F.lit(-LIMIT)) * BINS).cast("int"))
    bins = own.groupBy("kind", "lang", "bin").agg(F.sum("toxic").alias("pos"), F.count("*").alias("n"), F.min("__logit").alias("lo"), F.max("__logit").alias("hi"))
    w = Window.partitionBy("kind", "lang")
    down = w.orderBy(F.col("bin").desc())
    f1 = 2 * F.sum("pos").over(down) / (F.sum("n").over(down) + F.greatest(F.sum("pos").over(w), F.lit(1)))
    cut = F.coalesce((F.col("lo") + F.lead("hi").over(down)) / 2, F.col("lo") - 1e-3)
    best = bins.select("kind", "lang", "bin", "pos", "n", f1.alias("f1"), cut.alias("cut")).groupBy("kind", "lang")
    found = best.agg(F.sum("pos").alias("pos"), F.sum("n").alias("n"), F.max(F.struct("f1", "bin", "cut")).alias("best")).where(f"kind = 'every' OR (pos >= {LEAST} AND n - pos >= {LEAST})")
    cuts = {(r["kind"], r["lang"]): r["best"]["cut"] for r in found.collect()}
    return cuts.get(("apart", None), cuts.get(("every", None), 0.0)), {lang: at for (kind, lang), at in cuts.items() if kind == "lang"}


def judged(docs: DataFrame, labels: DataFrame, keep: list[str], most: int = SAMPLE) -> tuple[DataFrame, Classifier | None, dict[str, float]]:
    """row (a struct of the columns `keep` of docs), lang and score, the classifier, and for each language with enough labels the score from which a text counts as toxic. Texts are read once; their values are written out and give the cuts and the scores."""
    model = fitted(docs, labels, most)
    lang = F.col("lang") if "lang" in docs.columns else F.lit(None)
    rows = docs.select(F.struct(*keep).alias("row"), F.col("doc_id").cast("long").alias("id"), lang.cast("string").alias("lang"), "text")
    rows = valued(rows, model).select("row.row", "row.id", "row.lang", F.col("logit").alias("__logit"))
    if model is None:
        return rows.select("row", "lang", F.lit(0.0).alias("score")), None, {}
    rows = written(rows, "logits")
    cut, by_lang = thresholds(rows.select(F.col("id").alias("doc_id"), "lang", "__logit"), labels)
    model.shift = float(np.log(THRESHOLD / (1 - THRESHOLD)) - cut)
    cuts = {k: float(1 / (1 + np.exp(-np.clip(at + model.shift, -LIMIT, LIMIT)))) for k, at in by_lang.items()}
    return rows.select("row", "lang", as_score(F.col("__logit") + model.shift).alias("score")), model, cuts


def train(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> tuple[Classifier | None, dict[str, float]]:
    """The classifier, and for each language with enough rows the score from which a text counts as toxic."""
    return judged(docs, labels, ["doc_id"], most)[1:]


def as_score(logit: Column) -> Column:
    return F.when(logit.isNull(), 0.0).otherwise(1 / (1 + F.exp(-F.greatest(F.least(logit, F.lit(LIMIT)), F.lit(-LIMIT)))))


def valued(docs: DataFrame, model: Classifier | None) -> DataFrame:
    """row (the columns of docs) and logit, from the text alone; null without a model."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # fixed size: ROWS x DIM, and its table

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            s = [m.logit(hashed(t.as_py())) if m else None for t in b["row"].field("text")]
            yield pa.RecordBatch.from_arrays([b["row"], pa.array(s, pa.float64())], names=["row", "logit"])

    rows = docs.select(F.struct(*docs.columns).alias("row"))
    return in_batches(rows, scan, f"row {rows.schema['row'].dataType.simpleString()}, logit double")


def scored(docs: DataFrame, model: Classifier | None) -> DataFrame:
    """The columns of docs with __score, from the text alone; a column of docs of that name is replaced."""
    return valued(docs, model).select(*[F.col(f"row.`{c}`") for c in docs.columns if c != "__score"], as_score(F.col("logit")).alias("__score"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out, _, _ = judged(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"), ["doc_id"])
    return out.select("row.doc_id", "score").select("doc_id", F.coalesce(held_out("doc_id"), F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
