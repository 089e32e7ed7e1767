"""Toxicity: a linear classifier over character n-grams, their features scaled by naive Bayes log-count ratios.

A feature is the presence of an n-gram (3 to 5 lower-cased characters, hashed) times the log ratio of its smoothed
share among toxic and other training texts; a ridge logistic regression weighs the features. Only n-grams whose presence
depends on the label, by a likelihood-ratio test, have a feature, which leaves few to sort out in each text: most are passed
over by one look into a table. Executors count n-grams and list texts' features; the driver gets counts of buckets and
lists of features, never a text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkernel as tk
from .common import stored, table, text_of
from .quality_gbt import fold, scored

#: Labelled ids of each class that a fit uses at most: those with the smallest hashes.
FIT_ROWS = 3000
THRESHOLD = 0.3
ORDERS = (3, 4, 5)
BITS = 20
#: The least likelihood-ratio statistic of a feature (one in a thousand by chance), the features that a model has, those of
#: the largest statistics, and the ridge: the best log loss over folds of the training rows, among statistics of 8 to 40,
#: ridges of 0.02 to 1.5, and, where many n-grams pass, 1000 to 8000 features or all of them.
G_LEAST, FEATURES, RIDGE, STEPS = 10.83, 4000, 0.5, 400
#: Bytes of a text whose n-grams are held at once.
SPAN_BYTES = 4 << 20
_PRIME = np.uint64(0x100000001B3)
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


def _lower() -> np.ndarray:
    out = np.arange(0x10000, dtype=np.uint32)
    for i in range(0x10000):
        c = chr(i).lower()
        out[i] = ord(" ") if chr(i).isspace() else ord(c) if len(c) == 1 else i
    return out


_LOWER: list[np.ndarray] = []


def grams(b: tk.Block) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """For each order: the bucket of the n-gram at every character, the characters' row offsets, and the order."""
    if not _LOWER:
        _LOWER.append(_lower())
    chars = np.frombuffer(b.data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), dtype=np.uint32)
    lead = np.zeros(len(b.data) + 1, dtype=np.int64)
    np.cumsum((b.data & 0xC0) != 0x80, out=lead[1:])
    off = lead[b.off]
    low = _LOWER[0][np.minimum(chars, 0xFFFF)]
    c = np.where(chars < 0x10000, low, chars).astype(np.uint64) + np.uint64(1)
    h = c.copy()
    for n in range(2, max(ORDERS) + 1):
        if len(c) < n:
            return
        h = h[: len(c) - n + 1] * _PRIME + c[n - 1 :]
        if n in ORDERS:
            yield ((h + np.uint64(n)) * _SPREAD >> np.uint64(64 - BITS)).astype(np.int64), off, n


def _spans(b: tk.Block) -> Iterator[tk.Block]:
    """A block of one long text as blocks that overlap by what an n-gram needs, so that none is lost; another block as it is."""
    if b.n != 1 or len(b.data) <= SPAN_BYTES:
        yield b
        return
    lead = lambda i: int(i) - next((k for k in range(4) if i - k <= 0 or (i - k < len(b.data) and b.data[i - k] & 0xC0 != 0x80)), 0)
    for lo in range(0, len(b.data), SPAN_BYTES):
        lo, hi = lead(lo), min(len(b.data), lo + SPAN_BYTES + 4 * max(ORDERS))  # noqa: PLW2901
        hi = hi if hi == len(b.data) else lead(hi)
        yield tk.Block(b.data[lo:hi], np.array([0, hi - lo]), b.lo, b.hi)


def present(b: tk.Block, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Rows and buckets of the distinct n-grams of a block's rows, of all buckets or those `wanted`; none crosses rows."""
    parts = []
    for part in _spans(b):
        keys = [np.zeros(0, dtype=np.int64)]
        for bucket, off, n in grams(part):
            at = np.arange(len(bucket)) if wanted is None else np.flatnonzero(wanted[bucket])
            row = np.searchsorted(off, at, side="right") - 1
            inside = at + n <= off[row + 1]
            keys.append(row[inside] << BITS | bucket[at[inside]])
        parts.append(np.unique(np.concatenate(keys)))
    key = parts[0] if len(parts) == 1 else np.unique(np.concatenate(parts))
    return key >> BITS, key & ((1 << BITS) - 1)


class Model:
    """A bias, and a weight for each bucket that has a feature (ratio times coefficient)."""

    def __init__(self, bias: float, weight: np.ndarray):
        self.bias = bias
        self.at = np.flatnonzero(weight)
        self.weight = weight[self.at].astype(np.float64)

    def scores(self, column: pa.Array) -> np.ndarray:
        dense = np.zeros(1 << BITS)
        dense[self.at] = self.weight
        wanted = dense != 0
        out = [np.zeros(0)]
        for b in tk.blocks(column):
            row, bucket = present(b, wanted)
            out.append(np.bincount(row, dense[bucket], b.n) + self.bias)
        return 1 / (1 + np.exp(-np.clip(np.concatenate(out), -500, 500)))


def dependence(count: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The likelihood-ratio statistic of presence and label; count: texts of either label with the n-gram, n: all texts of either."""
    share = count.sum(axis=0) / n.sum()
    total = np.zeros(count.shape[1])
    for y in (0, 1):
        for seen, expected in ((count[y], n[y] * share), (n[y] - count[y], n[y] * (1 - share))):
            total += np.where(seen > 0, seen * np.log(np.maximum(seen, 1e-300) / np.maximum(expected, 1e-300)), 0)
    return 2 * total


def ratios(count: np.ndarray, n: np.ndarray, least: float = G_LEAST, features: int = FEATURES) -> np.ndarray:
    """Naive Bayes log-count ratios of the buckets that have a feature, 0 of others; of equal statistics all or none."""
    share = (count + 1) / (n[:, None] + 2)
    g = dependence(count, n)
    passed = np.sort(g[g >= least])
    if len(passed) > features:
        at = passed[-features]
        least = at if (passed >= at).sum() == features else np.nextafter(at, np.inf)
    return np.where(g >= least, np.log(share[1] / share[0]), 0.0)


def fit(lists: list[np.ndarray], y: np.ndarray, ratio: np.ndarray, prior: float) -> Model:
    """Weigh features: lists has the buckets with a feature of each text, y the texts' labels, ratio that of all buckets; prior
    is the share of label 1 that scores are calibrated to."""
    prior = min(max(prior, 1e-4), 1 - 1e-4)
    bias = float(np.log(prior / (1 - prior)))
    wanted = ratio != 0
    if not len(y) or y.min() == y.max() or not wanted.any():
        return Model(bias, np.zeros(len(ratio)))
    n = np.array([(y == 0).sum(), (y == 1).sum()], dtype=np.float64)
    number = np.cumsum(wanted) - 1
    r = np.repeat(np.arange(len(y), dtype=np.int32), [len(x) for x in lists])
    c = number[np.concatenate(lists)].astype(np.int32)
    v = ratio[wanted][c].astype(np.float32)
    w = np.zeros(int(wanted.sum()))
    weight = np.where(y == 1, prior / n[1], (1 - prior) / n[0])  # rows weigh as in the population
    m, s = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for t in range(1, STEPS + 1):  # Adam: deterministic, no step size to fit
        z = np.bincount(r, v * w[c], len(y)) + bias
        d = weight * (1 / (1 + np.exp(-z)) - y)
        g = np.append(np.bincount(c, v * d[r], len(w)) + RIDGE * w / len(w), d.sum())
        m, s = 0.9 * m + 0.1 * g, 0.999 * s + 0.001 * g * g
        step = 0.02 * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.999**t)) + 1e-8)
        w, bias = w - step[:-1], bias - float(step[-1])
    dense = np.zeros(len(ratio))
    dense[wanted] = w * ratio[wanted]
    return Model(bias, dense)


def train(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Model:
    """Fit on the texts of at most `rows` labelled ids of each class; the prior is of all labels. Null labels and ids don't count,
    a null text is empty, and an id's texts each count."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("y"))
    totals = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    pick = lambda y: known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    sample = docs.select("doc_id", "text").join(F.broadcast(pick(0).unionByName(pick(1))), "doc_id")  # ids are few by their bound
    sample = stored(sample.select("doc_id", "y", F.coalesce("text", F.lit("")).alias("text")), "toxic-sample")
    size = 1 << BITS

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros((2, size), dtype=np.int64)
        for batch in batches:
            y = batch.column(0).to_numpy()
            for b in tk.blocks(batch.column(1)):
                row, bucket = present(b)
                for label in (0, 1):
                    count[label] += np.bincount(bucket[y[b.lo + row] == label], minlength=size)
        at = np.flatnonzero(count.any(axis=0))
        for i in range(0, len(at), 1 << 16):
            part = at[i : i + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(count[0, part]), pa.array(count[1, part])], names=["bucket", "n0", "n1"])

    n = np.zeros(2)
    for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect():
        n[r["y"]] = r["n"]
    prior = totals.get(1, 0) / max(1, sum(totals.values()))
    if not n.all():
        return fit([], np.zeros(0), np.zeros(size), prior)
    # A bucket of fewer texts than any feature needs is not sent: a text adds some 2 * ln(all / rarer class) to the statistic.
    rare = G_LEAST / (4 * float(np.log(n.sum() / n.min())))
    parts = sample.select("y", "text").mapInArrow(counted, "bucket long, n0 long, n1 long").groupBy("bucket").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    got = parts.where(F.col("n0") + F.col("n1") >= F.lit(rare)).toArrow()
    count = np.zeros((2, size))
    for y in (0, 1):
        count[y, got.column("bucket").to_numpy()] = got.column(f"n{y}").to_numpy()
    ratio = ratios(count, n)
    wanted = np.packbits(ratio != 0)

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mask = np.unpackbits(wanted, count=size).astype(bool)
        for batch in batches:
            for b in tk.blocks(batch.column(2)):
                row, bucket = present(b, mask)
                first = np.searchsorted(row, np.arange(b.n + 1)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(first), pa.array(bucket.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(b.lo, b.n), batch.column(1).slice(b.lo, b.n), lists], names=["doc_id", "y", "buckets"])

    rows_ = sample.mapInArrow(listed, "doc_id long, y int, buckets array<int>").orderBy("doc_id", "buckets").toArrow()
    flat = rows_.column("buckets").combine_chunks()
    return fit([np.asarray(x.values, dtype=np.int64) for x in flat], rows_.column("y").to_numpy().astype(np.float64), ratio, prior)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs with a column score in place of the text: likelihood of toxicity, learnt outside the held-out fold.

    Null texts are empty ones and have a score too; equal texts have equal scores; a column named score is replaced. Without
    labels of both kinds, all scores are the base rate.
    """
    model = train(docs, labels.where(fold("doc_id", 4) != 2))
    return scored(docs, model.scores)


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of documents with its score, whether it is held out, and the prediction; a null text is empty, equal texts have equal scores."""
    got = classify(text_of(table(spark, sf_dir, "documents")), table(spark, sf_dir, "labels"))
    return got.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
