"""Quality classifier: histogram gradient-boosted trees over document statistics.

The statistics of all texts of an Arrow batch are computed together in numpy. Trees are grown level by level from
histograms of gradients over quantile bins, for the logistic loss, and are stored as complete binary trees in flat
arrays: a batch of documents descends one level with one gather, whatever branches its rows take.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkernel as tk
from .common import table, text_of

#: Labelled rows that a fit uses at most: those with the smallest hashes of their ids.
FIT_ROWS = 20_000
THRESHOLD = 0.3
TREES, DEPTH, BINS, RATE, RIDGE, LEAST_WEIGHT = 60, 4, 64, 0.2, 1.0, 2.0

_CLASSES = {
    "upper": range(0x41, 0x5B),
    "lower": range(0x61, 0x7B),
    "digit": range(0x30, 0x3A),
    "stop": b".!?",
    "comma": b",;:",
    "bang": b"!",
    "symbol": b"#$%&*+<=>@\\^_`{|}~",
    "bracket": b"()[]\"'/-",
    "newline": b"\n\r",
    "space": [0x20, *range(0x09, 0x0E)],
    "other": range(0x80, 0x100),
}
_MEMBER = {}
for _name, _bytes in _CLASSES.items():
    _MEMBER[_name] = np.zeros(256, dtype=np.uint8)
    _MEMBER[_name][list(_bytes)] = 1

FEATURES = (*_CLASSES, "bytes", "words", "word_bytes", "longest", "distinct", "repeats", "most_common", "capitalised", "symbol_end", "sentence_words", "line_words", "all_upper")


def _counts(mask: np.ndarray, off: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(mask) + 1, dtype=np.int64)
    np.cumsum(mask, out=sums[1:])
    return (sums[off[1:]] - sums[off[:-1]]).astype(np.float64)


def statistics(column: pa.Array) -> np.ndarray:
    """Rows by FEATURES of a string column; an empty text has zeros."""
    out = [np.zeros((0, len(FEATURES)))]
    for b in tk.blocks(column):
        w = tk.Words(b)
        size = np.diff(b.off).astype(np.float64)
        safe = np.maximum(size, 1)
        n = np.diff(w.first).astype(np.float64)
        words = np.maximum(n, 1)
        cols = [_counts(_MEMBER[c][b.data], b.off) for c in _CLASSES]
        stops, lines = cols[3], cols[8]
        length = w.end - w.start
        rows = w.rows()
        h = w.hashes()
        key = np.sort((rows.astype(np.uint64) << np.uint64(40)) | (h >> np.uint64(24)))
        new = np.ones(len(key), dtype=bool)
        new[1:] = key[1:] != key[:-1]
        at = np.flatnonzero(new)
        of = (key[at] >> np.uint64(40)).astype(np.int64)
        distinct = np.bincount(of, minlength=b.n)
        common = np.zeros(b.n)
        np.maximum.at(common, of, np.diff(np.append(at, len(key))).astype(np.float64))
        longest = np.zeros(b.n)
        np.maximum.at(longest, rows, length.astype(np.float64))
        again = np.zeros(len(h), dtype=bool)
        again[1:] = (h[1:] == h[:-1]) & (rows[1:] == rows[:-1])
        first, last = (b.data[w.start], b.data[w.end - 1]) if len(h) else (np.zeros(0, np.uint8),) * 2
        by_word = lambda mask: np.bincount(rows, weights=mask.astype(np.float64), minlength=b.n) / words  # noqa: E731, B023
        letters = np.maximum(cols[0] + cols[1], 1)
        stats = [c / safe for c in cols] + [
            np.log1p(size), np.log1p(n), _counts_words(length, w.first) / words, np.log1p(longest), distinct / words, by_word(again), common / words,
            by_word(_MEMBER["upper"][first]), by_word(_MEMBER["symbol"][last]), np.log1p(n / (stops + 1)), np.log1p(n / (lines + 1)), cols[0] / letters,
        ]
        out.append(np.stack(stats, axis=1))
    return np.concatenate(out)


def _counts_words(length: np.ndarray, first: np.ndarray) -> np.ndarray:
    return _counts(length, first)


@dataclass
class Forest:
    """Complete trees of one depth: `feature` and `cut` are (trees, 2^depth - 1), `leaf` is (trees, 2^depth)."""

    base: float
    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray

    def margins(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        depth = int(self.leaf.shape[1]).bit_length() - 1 if len(self.leaf) else 0
        for f, c, v in zip(self.feature, self.cut, self.leaf, strict=True):
            at = np.zeros(len(x), dtype=np.int64)
            for _ in range(depth):
                at = 2 * at + 1 + (x[rows, f[at]] > c[at])
            out += v[at - len(f)]
        return out

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margins(x)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, bins: int = BINS, rate: float = RATE) -> Forest:
    """Grow a forest on rows x with labels y in {0, 1}; without rows of both labels, the base rate alone."""
    p = min(max(float(y.mean()), 1e-3), 1 - 1e-3) if len(y) else 0.5
    base = float(np.log(p / (1 - p)))
    empty = Forest(base, np.zeros((0, 2**depth - 1), np.int64), np.zeros((0, 2**depth - 1)), np.zeros((0, 2**depth)))
    if not len(y) or y.min() == y.max():
        return empty
    n, width = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(width)]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)])  # bin b holds x <= edges[b]
    margin = np.full(n, base)
    features, cuts, leaves = [], [], []
    for _ in range(trees):
        prob = 1 / (1 + np.exp(-margin))
        g, h = prob - y, prob * (1 - prob)
        feature, cut = np.zeros(2**depth - 1, np.int64), np.full(2**depth - 1, np.inf)
        node = np.zeros(n, dtype=np.int64)
        for level in range(depth):
            many = 2**level
            best = np.full(many, 1e-9)
            pick = np.zeros(many, np.int64)
            where = np.full(many, -1)
            for j in range(width):
                key = node * bins + binned[j]
                gs = np.bincount(key, g, many * bins).reshape(many, bins)
                hs = np.bincount(key, h, many * bins).reshape(many, bins)
                gl, hl = gs.cumsum(1), hs.cumsum(1)
                gt, ht = gl[:, -1:], hl[:, -1:]
                gain = gl**2 / (hl + RIDGE) + (gt - gl) ** 2 / (ht - hl + RIDGE) - gt**2 / (ht + RIDGE)
                gain[(hl < LEAST_WEIGHT) | (ht - hl < LEAST_WEIGHT)] = 0
                gain[:, len(edges[j]) :] = 0
                top = gain.argmax(1)
                value = gain[np.arange(many), top]
                better = value > best
                best[better], pick[better], where[better] = value[better], j, top[better]
            for k in range(many):
                if where[k] >= 0:
                    feature[many - 1 + k], cut[many - 1 + k] = pick[k], edges[pick[k]][where[k]]
            node = 2 * node + (x[np.arange(n), feature[many - 1 + node]] > cut[many - 1 + node])
        gs, hs = np.bincount(node, g, 2**depth), np.bincount(node, h, 2**depth)
        leaf = -rate * gs / (hs + RIDGE)
        margin += leaf[node]
        features.append(feature)
        cuts.append(cut)
        leaves.append(leaf)
    return Forest(base, np.array(features), np.array(cuts), np.array(leaves))


def scored(docs: DataFrame, score: Callable[[pa.Array], np.ndarray], text_col: str = "text", keep_text: bool = False, to: str = "score") -> DataFrame:
    """docs with a column of scores, double, computed a batch at a time, after its other columns; the text goes unless kept.

    A column that is named like the scores is replaced.
    """
    names = [f.name for f in docs.schema.fields if (keep_text or f.name != text_col) and f.name.lower() != to.lower()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = score(batch.column(batch.schema.get_field_index(text_col)))
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(n)) for n in names), pa.array(got, pa.float64())], names=[*names, to])
        tk.release()

    kept = "".join(f"`{n}` {docs.schema[n].dataType.simpleString()}, " for n in names)
    return docs.mapInArrow(run, f"{kept}`{to}` double")


def fold(column: str, of: int) -> Column:
    """The held-out fold's number of a row: crc32 of its id, as text."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % of


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = FIT_ROWS) -> Forest:
    """Fit on at most `rows` rows of labels (doc_id and the label), joined to docs' texts; null labels and ids don't count.

    The sample's ids are few by its bound, so they are broadcast and no text is shuffled; only statistics come to the driver.
    """
    sample = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    texts = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("doc_id", F.col("y").cast("int").alias("y"), "text")

    def stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = statistics(batch.column(2))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([r.tobytes() for r in x], pa.binary())], names=["doc_id", "y", "x"])

    got = texts.mapInArrow(stats, "doc_id long, y int, x binary").orderBy("doc_id", "x").toPandas()
    x = np.array([np.frombuffer(r) for r in got["x"]]).reshape(len(got), len(FEATURES))
    return fit(x, got["y"].to_numpy(np.float64))


def classify(docs: DataFrame, labels: DataFrame, keep_text: bool = False, to: str = "score") -> DataFrame:
    """docs with a column of scores: likelihood of quality, learnt outside the held-out fold.

    Null texts are empty ones and have a score too; equal texts have equal scores; a column named like the scores is replaced.
    Without labels of both kinds, all scores are the base rate.
    """
    forest = train(docs, labels.where(fold("doc_id", 5) != 0))
    return scored(docs, lambda column: forest.scores(statistics(column)), keep_text=keep_text, to=to)


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of documents with its score, whether it is held out, and the prediction; nulls and ties as `classify` says."""
    docs = text_of(table(spark, sf_dir, "documents"))
    got = classify(docs, table(spark, sf_dir, "labels"))
    return got.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
