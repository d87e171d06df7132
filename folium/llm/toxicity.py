"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Features are the presence of character n-grams of 3 to 6 code points (lower case, white space as one space), hashed into
2**20 buckets.  Fitting takes two passes over a bounded sample of labelled rows:

1. documents of each class are counted for every bucket; r = log((p + a) / |p|) - log((q + a) / |q|) is its log-count ratio,
   and the ``features`` buckets with the largest r * r * (1 / (1 / (p + a) + 1 / (q + a))), its squared z-score, are kept, of those with r of 1 or more either way;
2. a logistic regression with an L2 penalty is fitted to the kept buckets, each scaled by its r.

A score needs one table look-up an n-gram; nothing is shuffled, and what is broadcast has a fixed size.

The sample: at most about ``SAMPLE`` labelled rows of each class, chosen by a hash of doc_id; with fewer, all of them.  The regression
takes rows of it up to ``ENTRIES`` features in all (some 100 MB on the driver), which only many very long texts reach.
Whole texts are used in fitting and scoring.

Defined results: null and empty texts have no n-grams and get the model's prior; a null doc_id counts as held out; labels
that are null are left out, of several labels for one doc_id the largest counts; without both classes every score is the
prior (share of label 1, or 0 without labels).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

BUCKET_BITS, SIZES, FEATURES, LEAST_RATIO, SAMPLE, ENTRIES = 20, (3, 4, 5, 6), 1 << 14, 1.0, 12_000, 25_000_000
_CHUNK = 1 << 14


@dataclass
class Model:
    prior: float
    slot: np.ndarray  # int32 by bucket, 0: not a feature
    weight: np.ndarray  # float64 by slot
    bias: float

    def score(self, text: str | None) -> float:
        found = present(text, self.slot)
        if not len(found):
            return float(self.prior)
        return float(1 / (1 + np.exp(-np.clip(self.weight[found].sum() + self.bias, -50, 50))))


def grams(text: str) -> Iterator[np.ndarray]:
    """Buckets of the n-grams of a text, size by size.  Texts are taken in stretches, so that long ones stay small."""
    text = " " + " ".join(text.lower().split()) + " "
    longest, stretch = SIZES[-1], 1 << 18
    for at in range(0, max(1, len(text) - longest + 1), stretch):
        part = text[at : at + stretch + longest - 1]
        points = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        h = points.copy()
        for n in range(2, longest + 1):
            if len(points) < n:
                break
            h = h[:-1] * np.uint64(0x9E3779B97F4A7C15) + points[n - 1 :]
            if n in SIZES:
                yield ((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def present(text: str | None, slot: np.ndarray | None = None) -> np.ndarray:
    """Distinct buckets of a text, or distinct slots other than 0."""
    if not text or text.isspace():
        return np.empty(0, np.int64)
    found = []
    for b in grams(text):
        if slot is not None:
            b = slot[b]
            b = b[b > 0]
        found.append(np.unique(b))
    return np.unique(np.concatenate(found)) if found else np.empty(0, np.int64)


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def sample_labels(labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, toxic) of the rows to learn from: about sample rows of each class at most."""
    known = labels.where(F.col("toxic").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    count = {bool(r[0]): r[1] for r in known.groupBy(F.col("toxic") > 0).count().collect()}
    share = {k: min(1.0, sample / max(1, n)) for k, n in count.items()}
    least = F.when(F.col("toxic") > 0, F.lit(share.get(True, 1.0))).otherwise(F.lit(share.get(False, 1.0)))
    return known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < least * (1 << 20)), count.get(True, 0), count.get(False, 0)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, features: int = FEATURES, alpha: float = 1.0) -> Model:
    spark = common.prepare(docs.sparkSession)
    picked, positive, negative = sample_labels(labels, sample)
    prior = positive / (positive + negative) if positive + negative else 0.0
    buckets = 1 << BUCKET_BITS
    nothing = Model(prior, np.zeros(buckets, np.int32), np.zeros(1), float(np.log((prior + 1e-9) / (1 - prior + 1e-9))))
    if not positive or not negative:
        return nothing
    # At most 2 * sample ids go out (some 400 KB), so that texts needn't be shuffled by doc_id.
    rows = docs.select("doc_id", "text").join(F.broadcast(picked.select("doc_id", F.col("toxic").cast("int").alias("toxic"))), "doc_id").select("text", "toxic")
    rows = rows.repartition(min(8, common.partitions(spark)))
    rows = common.written(rows, "toxicity-sample")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros((2, buckets), np.int32)
        n = np.zeros(2, np.int64)
        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                df[int(toxic > 0), present(text)] += 1
                n[int(toxic > 0)] += 1
        if n.any():
            yield pa.RecordBatch.from_pydict({"chunk": pa.array([-1], pa.int32()), "counts": pa.array([n.astype(np.int32).tobytes()], pa.binary())})
            for k in range(buckets // _CHUNK):
                part = df[:, k * _CHUNK : (k + 1) * _CHUNK]
                if part.any():
                    yield pa.RecordBatch.from_pydict({"chunk": pa.array([k], pa.int32()), "counts": pa.array([part.tobytes()], pa.binary())})

    def total(key, pdf):
        import pandas as pd

        return pd.DataFrame({"chunk": [key[0]], "counts": [sum(np.frombuffer(x, np.int32).astype(np.int64) for x in pdf["counts"]).tobytes()]})

    df, n = np.zeros((2, buckets)), np.zeros(2)
    # Counts by class for a fixed number of buckets: 16 MB, whatever the corpus.
    counted = rows.mapInArrow(common.lean(count), "chunk int, counts binary").groupBy("chunk").applyInPandas(total, "chunk int, counts binary")
    for chunk, counts in counted.toLocalIterator():
        x = np.frombuffer(counts, np.int64)
        if chunk < 0:
            n = x.astype(float)
        else:
            df[:, chunk * _CHUNK : (chunk + 1) * _CHUNK] = x.reshape(2, -1)
    q, p = df + alpha
    if not n.all():
        return nothing
    ratio = np.log(p / (n[1] + 2 * alpha)) - np.log(q / (n[0] + 2 * alpha))
    strength = ratio * ratio / (1 / p + 1 / q)
    strength[(df.sum(axis=0) < 5) | (np.abs(ratio) < LEAST_RATIO)] = 0
    keep = np.sort(np.argsort(-strength, kind="stable")[:features])
    keep = keep[strength[keep] > 0]
    slot = np.zeros(buckets, np.int32)
    slot[keep] = np.arange(1, len(keep) + 1)
    scale = np.concatenate(([0.0], ratio[keep]))
    table = spark.sparkContext.broadcast(slot)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [present(t, table.value).astype(np.int32) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_pydict({"slots": pa.array([x.tobytes() for x in found], pa.binary()), "toxic": pa.array([int(t > 0) for t in batch.column(1).to_pylist()], pa.int32())})

    x, y, entries = [], [], 0
    for slots, toxic in rows.mapInArrow(common.lean(vectors), "slots binary, toxic int").toLocalIterator(prefetchPartitions=True):
        x.append(np.frombuffer(slots, np.int32))
        y.append(toxic)
        entries += len(x[-1])
        if entries >= ENTRIES:
            break
    table.unpersist()
    weight, bias = regress(x, np.array(y), scale, np.log(prior / (1 - prior)))
    del x, y
    common.tidy(spark, 0)
    return Model(prior, slot, weight, bias)


def regress(x: list[np.ndarray], y: np.ndarray, scale: np.ndarray, odds: float, penalty: float = 0.05, rounds: int = 200) -> tuple[np.ndarray, float]:
    """Weights by slot (scale included) and bias of a logistic regression; classes count as in the corpus."""
    ends = np.cumsum([0, *map(len, x)])
    col = np.concatenate(x) if len(x) else np.empty(0, np.int32)
    # Rows are taken some million features at a time, so that only their slots are held as a whole.
    cuts = [0, *(np.flatnonzero(np.diff(ends // 2_000_000)) + 1).tolist()]
    spans = [(a, b) for a, b in zip(cuts, [*cuts[1:], len(x)]) if b > a]
    seen = np.log(max(1, y.sum()) / max(1, (1 - y).sum()))
    each = np.where(y > 0, np.exp(odds - seen), 1.0)
    each /= each.mean()
    # Rows aren't scaled to one length: that would make a long text's few telling n-grams faint.
    w, bias = np.zeros(len(scale)), odds
    gw, gb = np.zeros(len(scale)), 0.0
    for _ in range(rounds):
        dw, db = penalty / max(1, len(x)) * w, 0.0
        for a, b in spans:
            own = col[ends[a] : ends[b]]
            row = np.repeat(np.arange(b - a), np.diff(ends[a : b + 1]))
            value = scale[own]
            z = np.bincount(row, value * w[own], b - a) + bias
            g = (1 / (1 + np.exp(-np.clip(z, -50, 50))) - y[a:b]) * each[a:b] / max(1, len(x))
            dw = dw + np.bincount(own, value * g[row], len(scale))
            db += g.sum()
        gw, gb = gw + dw * dw, gb + db * db
        w -= 0.1 * dw / np.sqrt(gw + 1e-10)
        bias -= 0.1 * db / np.sqrt(gb + 1e-10)
    return w * scale, float(bias)


def score(docs: DataFrame, model: Model, column: str = "toxicity") -> DataFrame:
    """docs with a score (double) as a new last column (one of that name is replaced)."""
    from pyspark.sql import types as T

    spark = common.prepare(docs.sparkSession)
    shared = spark.sparkContext.broadcast(model)
    kept = docs.select([c for c in docs.columns if c != column])
    at = kept.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            scores = pa.array([m.score(t) for t in batch.column(at).to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, scores], names=[*batch.schema.names, column])

    return kept.mapInArrow(common.lean(run), T.StructType([*kept.schema.fields, T.StructField(column, T.DoubleType())]))


def scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of docs."""
    docs = docs.select("doc_id", "text")
    model = fit(docs, labels.select("doc_id", "toxic"))
    found = score(docs, model)
    return found.select("doc_id", held_out().alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that the classifier doesn't reject, with the columns of docs."""
    model = fit(docs.select("doc_id", "text"), labels.select("doc_id", "toxic"))
    column = "toxicity_of_text"
    while column in docs.columns:
        column += "_"
    return score(docs, model, column).where(F.col(column) < 0.5).select(docs.columns)
