"""Toxicity by cumulative-link ordinal regression on sparse word features.

One weight a feature is shared by ordered thresholds: P(grade >= k) = 1 / (1 + exp(theta_k - w.x)), theta_1 < theta_2 < ...
Labels say only whether a document is toxic. Toxic rows are graded 1 to 3 by how many features they hold that set the toxic
rows apart; the features are the words, beginnings and endings of words that do so by a chi-square test, present or not,
so unrelated words of long documents add nothing. Training sees a bounded, hash-ordered sample of the labelled rows (``max_rows``); scoring covers
every document and the whole of its text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sidetrace.llm import textvec
from sidetrace.llm.common import prepare

#: Labelled rows of each class that training reads at most.
MAX_ROWS = 3_000
GRADES = 3
#: A word is a feature if this many training rows of the toxic class hold it and its chi-square is as large.
LEAST_ROWS, LEAST_CHI2 = 8, 30.0


#: Bytes at the edges of words that are not part of them.
_EDGES = np.zeros(256, bool)
_EDGES[[c for c in range(33, 128) if not chr(c).isalnum()]] = True


def bare(data: np.ndarray) -> np.ndarray:
    """The bytes with ASCII punctuation turned into spaces, so that it doesn't cling to words."""
    return np.where(_EDGES[data], np.uint8(32), data)


#: Lengths in bytes of the word beginnings and endings that are features beside whole words, for inflected stems.
STARTS, ENDS = (4, 5, 6), (5,)


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature hashes of all texts, those of a text together, and for each text the index of its first.

    Words are cut at white space and ASCII punctuation, A-Z lower-cased.
    """
    h, first, parts = textvec.words_and_parts(bare(data), offsets, STARTS, ENDS)
    return np.stack([h, *parts], axis=1).ravel(), first * (1 + len(parts))


def feature_sets(column: pa.Array) -> Iterator[np.ndarray]:
    """Sorted distinct feature hashes of each text."""
    for _, count, data, offsets in textvec.blocks(column):
        h, first = features(data, offsets)
        for i in range(count):
            yield np.unique(h[first[i] : first[i + 1]])


@dataclass
class Model:
    features: np.ndarray  # sorted hashes
    weights: np.ndarray
    thresholds: np.ndarray

    def grades(self, score: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1, 2, ..., one column each."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - score[:, None], -500, 500)))

    def score(self, column: pa.Array) -> np.ndarray:
        out = np.zeros(len(column))
        if not len(self.features):
            return out
        for row, count, data, offsets in textvec.blocks(column):
            h, first = features(data, offsets)
            at = np.minimum(np.searchsorted(self.features, h), len(self.features) - 1)
            hit = np.flatnonzero(self.features[at] == h)
            text = np.searchsorted(first, hit, "right") - 1
            pairs = np.unique(text * len(self.features) + at[hit])
            np.add.at(out, row + pairs // len(self.features), self.weights[pairs % len(self.features)])
        return out


def fit_cumulative(rows: list[np.ndarray], grades: np.ndarray, width: int, rounds: int = 800, ridge: float = 1e-5) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ordered thresholds by gradient descent with Adam's steps; rows hold feature numbers, grades run from 0."""
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    column = np.concatenate([*rows, np.zeros(0, np.int64)]).astype(np.int64)
    top = max(1, int(grades.max(initial=1)))
    x = np.zeros(width + top)
    share = [min(max((grades >= k).mean(), 1e-4), 1 - 1e-4) for k in range(1, top + 1)]
    x[width] = np.log((1 - share[0]) / share[0])
    x[width + 1 :] = np.log(np.maximum(np.diff([np.log((1 - s) / s) for s in share]), 0.1))
    mean, square = np.zeros_like(x), np.zeros_like(x)
    n = max(1, len(rows))
    for t in range(1, rounds + 1):
        theta = np.cumsum(np.r_[x[width], np.exp(x[width + 1 :])])
        score = np.bincount(owner, x[column], len(rows))
        above = 1 / (1 + np.exp(np.clip(theta[None, :] - score[:, None], -500, 500)))
        edge = np.c_[np.ones(len(rows)), above, np.zeros(len(rows))]
        slope = np.c_[np.zeros(len(rows)), above * (1 - above), np.zeros(len(rows))]
        i = np.arange(len(rows))
        p = np.maximum(edge[i, grades] - edge[i, grades + 1], 1e-12)
        to_score = -(slope[i, grades] - slope[i, grades + 1]) / p / n
        to_theta = np.zeros(top + 2)
        np.add.at(to_theta, grades, slope[i, grades] / p / n)
        np.add.at(to_theta, grades + 1, -slope[i, grades + 1] / p / n)
        by_theta = to_theta[1 : top + 1]
        later = np.cumsum(by_theta[::-1])[::-1]
        gradient = np.r_[np.bincount(column, to_score[owner], width) + ridge * x[:width], later[0], later[1:] * np.exp(x[width + 1 :])]
        mean, square = 0.9 * mean + 0.1 * gradient, 0.99 * square + 0.01 * gradient**2
        x -= 0.05 * (mean / (1 - 0.9**t)) / (np.sqrt(square / (1 - 0.99**t)) + 1e-8)
    return x[:width], np.cumsum(np.r_[x[width], np.exp(x[width + 1 :])])


def fit(chosen: np.ndarray, rows: list[np.ndarray], toxic: np.ndarray) -> Model:
    """A model over the chosen features, sorted, from the feature numbers and labels of training rows; without both classes it rejects nothing."""
    toxic = np.asarray(toxic, bool)
    if not len(chosen) or not toxic.any() or toxic.all():
        return Model(np.zeros(0, np.uint64), np.zeros(0), np.arange(1, GRADES + 1) * 20.0)
    count = np.array([len(r) for r in rows])
    low, high = np.quantile(count[toxic], [1 / 3, 2 / 3])
    grades = np.where(toxic, 1 + (count > low) + (count > high), 0)
    weights, thresholds = fit_cumulative(rows, grades.astype(np.int64), len(chosen))
    return Model(chosen, weights, thresholds)


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Model:
    """Fits on at most max_rows toxic and 2 * max_rows other labelled rows, first by a hash of doc_id.

    labels: doc_id, toxic (0 or 1; null rows are left out). Only the sample's ids are broadcast. Features are counted and
    chosen on the executors; the driver sees the chosen ones and which of them each sampled row holds. Rows of one class
    with the same two least feature hashes, as most near-copies are, count once, lest a family stand for its words.
    """
    spark = prepare(docs.sparkSession)
    known = labels.where("doc_id is not null and toxic is not null").select(F.col("doc_id").cast("long"), (F.col("toxic") > 0).alias("toxic"))
    order = [F.xxhash64("doc_id"), "doc_id"]
    sample = known.where("toxic").orderBy(*order).limit(max_rows).union(known.where("not toxic").orderBy(*order).limit(2 * max_rows)).collect()
    ids = spark.createDataFrame([(r[0], r[1]) for r in sample], "doc_id long, toxic boolean")

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [textvec.signed(w) for w in feature_sets(batch["text"])]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["toxic"], pa.array(found, pa.list_(pa.int64()))], names=["doc_id", "toxic", "features"])

    texts = docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(ids), "doc_id")
    rows = texts.mapInArrow(make, "doc_id long, toxic boolean, features array<long>").where("size(features) > 0")
    family = [F.col("toxic"), F.col("features")[0], F.try_element_at("features", F.lit(2))]
    rows = rows.groupBy(*(c.alias(f"k{i}") for i, c in enumerate(family))).agg(F.min(F.struct("doc_id", "toxic", "features")).alias("r")).select("r.*").checkpoint()
    classes = {r[0]: r[1] for r in rows.groupBy("toxic").count().collect()}
    a, b = classes.get(True, 0), classes.get(False, 0)
    counts = rows.select("toxic", F.explode("features").alias("f")).groupBy("f").agg(F.count_if("toxic").alias("t"), F.count_if(~F.col("toxic")).alias("o"))
    both = F.col("t") + F.col("o")
    chi2 = F.try_divide(F.pow(F.col("t") * F.lit(float(b)) - F.col("o") * F.lit(float(a)), F.lit(2.0)) * float(a + b), both * (a + b - both) * F.lit(float(a) * float(b)))
    apart = counts.where((F.col("t") >= LEAST_ROWS) & (chi2 >= LEAST_CHI2) & (F.col("t") * b > 3 * F.col("o") * a)).select("f").collect()
    chosen = np.sort(np.array([r[0] for r in apart], np.int64).view(np.uint64))
    shared = spark.sparkContext.broadcast(chosen)

    def narrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [np.flatnonzero(np.isin(shared.value, np.array(f, np.int64).view(np.uint64))) for f in batch["features"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["toxic"], pa.array(held, pa.list_(pa.int64()))], names=["doc_id", "toxic", "held"])

    told = rows.mapInArrow(narrow, "doc_id long, toxic boolean, held array<long>").collect()
    told.sort(key=lambda r: (r["doc_id"], r["toxic"], r["held"]))
    return fit(chosen, [np.array(r["held"], np.int64) for r in told], np.array([r["toxic"] for r in told], bool))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of docs and p_toxic (of grade 1 or more), expected_severity (0 to 3), severity (the likeliest grade).

    Clashing columns are replaced. Null and empty texts hold no words and get the lowest severity.
    """
    spark = prepare(docs.sparkSession)
    docs = docs.drop("p_toxic", "expected_severity", "severity")
    shared = spark.sparkContext.broadcast(model)
    names = docs.columns

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = shared.value.grades(shared.value.score(batch["text"]))
            each = -np.diff(np.c_[np.ones(len(p)), p, np.zeros(len(p))], axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p[:, 0].round(6)), pa.array(p.sum(axis=1).round(6)), pa.array(each.argmax(axis=1).astype(np.int32))], names=[*names, "p_toxic", "expected_severity", "severity"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), "p_toxic double, expected_severity double, severity int"])
    return docs.mapInArrow(make, schema)


def rejected() -> Column:
    """Whether grade 1 or more is likelier than not, in rows of score."""
    return F.col("p_toxic") >= 0.5


def toxicity(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """Trains on labels and scores docs; toxic says whether grade 1 or more is likelier than not."""
    return score(docs, train(docs, labels, max_rows)).withColumn("toxic", rejected())
