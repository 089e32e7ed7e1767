"""Substring dedup behind a count-min prefilter: exact removal of windows of words that repeat across documents.

First pass: every window of WINDOW words is charged to its anchor, the smallest hash of the shorter runs in it. Equal
windows have equal anchors, so the number of documents with an anchor is no less than that with any of its windows,
and neighbouring windows mostly share one, which makes anchors some twenty times fewer. Each partition counts the
anchors of its documents into a count-min sketch and emits its cells by block; merged, only "at least twice" matters,
a bit a cell. Sketches overestimate: no repeated window is lost.

Second pass: only windows whose anchor may repeat are grouped, exactly, by 96 bits (two independent hashes of their
words), for the smallest document of each. Third: windows that start in a smaller document too are marked, and the words under them go.
The two groupings combine before they shuffle and emit a window once a document, so common passages don't pile up.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..staging import free_shuffles
from . import textkernel as tk
from .common import stored, table, text_of

WINDOW, ANCHOR = 50, 10
#: Rows of the sketch, and the most cells of one. Beyond, estimates get looser and more windows reach the exact pass;
#: the two bitmaps that are broadcast never exceed 2 * MOST_CELLS / 8 bytes = 64 MB.
ROWS, MOST_CELLS = 2, 1 << 28
#: Bytes of text a cell: one or two cells an anchor and more.
BYTES_PER_CELL = 16
BLOCK_BITS = 18
#: Merged sketches that a block is left with after the first of two steps.
MERGED = 16


def _sliding_min(a: np.ndarray, k: int) -> np.ndarray:
    """Minimum of each k neighbours, by doubling."""
    n, m, span = len(a) - k + 1, a, 1
    while span * 2 <= k:
        m = np.minimum(m[:-span], m[span:])
        span *= 2
    return np.minimum(m[:n], m[k - span : k - span + n])


def anchored(b: tk.Block, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, tk.Words, np.ndarray]:
    """Of a block: the windows' starts (word positions), anchors and rows; its words and their hashes."""
    w = tk.Words(b)
    h = w.hashes()
    start, g = tk.windows(h, w.first, min(anchor, window), 11)
    row_of = w.rows()
    room = window - min(anchor, window) + 1  # short runs in a window
    if len(g) < room:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), w, h
    low = _sliding_min(g, room)
    head = start[: len(low)]
    rows = row_of[head]
    inside = head + window <= w.first[rows + 1]  # else the window would run into the next row
    return head[inside], low[inside], rows[inside], w, h


def _changes(rows: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Where a run of one key in one row begins."""
    new = np.ones(len(keys), dtype=bool)
    new[1:] = (keys[1:] != keys[:-1]) | (rows[1:] != rows[:-1])
    return np.flatnonzero(new)


def _cells(keys: np.ndarray, row: int, cells: int) -> np.ndarray:
    return (tk.mix(keys + tk.stream(101 + row, 1)[0]) & np.uint64(cells - 1)).astype(np.int64)


def sketch(docs: DataFrame, cells: int, window: int = WINDOW, anchor: int = ANCHOR) -> list[np.ndarray]:
    """The merged sketch of docs' anchors, as bitmaps of the cells that count two documents or more."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = [[] for _ in range(ROWS)]
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for r in range(ROWS):
                cell, n = np.unique(np.concatenate(held[r]), return_counts=True)
                block = cell >> BLOCK_BITS
                cut = np.flatnonzero(np.diff(block)) + 1
                parts = zip(np.split(cell & ((1 << BLOCK_BITS) - 1), cut), np.split(n, cut), block[np.append(0, cut)].tolist(), strict=True) if len(cell) else ()
                rows = [(r, k, c.astype(np.uint32).tobytes(), np.minimum(m, 2).astype(np.uint8).tobytes()) for c, m, k in parts]
                held[r].clear()
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["r", "block", "cell", "n"])

        for batch in batches:
            for b in tk.blocks(batch.column(0)):
                _, low, rows, _, _ = anchored(b, window, anchor)
                at = _changes(rows, low)
                order = np.lexsort((low[at], rows[at]))
                at = at[order]
                at = at[_changes(rows[at], low[at])]  # once a document
                for r in range(ROWS):
                    held[r].append(_cells(low[at], r, cells))
                size += len(at)
                if size > 1 << 20:
                    yield from flush()
                    size = 0
        if size:
            yield from flush()
        tk.release()

    def added(group: pd.DataFrame) -> np.ndarray:
        total = np.zeros(1 << BLOCK_BITS, dtype=np.uint8)
        for c, n in zip(group["cell"], group["n"], strict=True):
            at = np.frombuffer(c, np.uint32)
            total[at] = np.minimum(total[at] + np.frombuffer(n, np.uint8), 2)
        return total

    def some(group: pd.DataFrame) -> pd.DataFrame:
        """The sketches of some partitions as one."""
        total = added(group)
        at = np.flatnonzero(total).astype(np.uint32)
        return pd.DataFrame({"r": [int(group["r"].iloc[0])], "block": [int(group["block"].iloc[0])], "cell": [at.tobytes()], "n": [total[at].tobytes()]})

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        bits = np.packbits(added(group) >= 2, bitorder="little").tobytes()
        return pd.DataFrame({"r": [int(group["r"].iloc[0])], "block": [int(group["block"].iloc[0])], "bits": [bits]})

    # Partitions' sketches merge in two steps, so a block's task never holds those of all.
    sent = docs.select("text").mapInArrow(count, "r int, block int, cell binary, n binary").withColumn("part", F.spark_partition_id() % MERGED)
    merged = sent.groupBy("r", "block", "part").applyInPandas(some, "r int, block int, cell binary, n binary")
    parts = merged.groupBy("r", "block").applyInPandas(merge, "r int, block int, bits binary")
    out = [np.zeros(max(1, cells >> 3), dtype=np.uint8) for _ in range(ROWS)]
    width = 1 << BLOCK_BITS >> 3
    for p in parts.toLocalIterator():  # bitmaps of a bounded size, whatever the input
        bits = np.frombuffer(p["bits"], np.uint8)
        out[p["r"]][p["block"] * width : p["block"] * width + width] = bits[: len(out[p["r"]])]
    return out


def repeats(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """id, version, text -> id, version, starts: where, in words, windows start that a row of a smaller id has as well.

    version tells rows of one id apart. Rows with a null id take no part; rows with none to mark have no row.
    """
    spark = docs.sparkSession
    docs = docs.where(F.col("id").isNotNull())
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    cells = 1 << min(MOST_CELLS.bit_length() - 1, max(BLOCK_BITS, (size // BYTES_PER_CELL).bit_length()))
    shipped = spark.sparkContext.broadcast(sketch(docs, cells, window, anchor))

    def candidates(positions: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bits = shipped.value
            for batch in batches:
                ids, versions = batch.column(0).to_numpy(), batch.column(1).to_numpy()
                for b in tk.blocks(batch.column(2)):
                    head, low, rows, w, h = anchored(b, window, anchor)
                    at = _changes(rows, low)
                    maybe = np.ones(len(at), dtype=bool)
                    for r in range(ROWS):
                        c = _cells(low[at], r, cells)
                        maybe &= (bits[r][c >> 3] >> (c & 7).astype(np.uint8) & 1).astype(bool)
                    use = np.repeat(maybe, np.diff(np.append(at, len(low))))
                    head, rows = head[use], rows[use]
                    if not len(head):
                        continue
                    every, x = tk.windows(h, w.first, window, 21)
                    _, y = tk.windows(w.hashes(1), w.first, window, 22)
                    y >>= np.uint64(32)  # what is shuffled is mostly these hashes
                    k = np.searchsorted(every, head)
                    x, y = x[k], y[k]
                    order = np.lexsort((head, y, x, rows))
                    head, rows, x, y = head[order], rows[order], x[order], y[order]
                    new = np.ones(len(head), dtype=bool)
                    new[1:] = (x[1:] != x[:-1]) | (y[1:] != y[:-1]) | (rows[1:] != rows[:-1])
                    first = np.flatnonzero(new)
                    cols = [pa.array(x[first].view(np.int64)), pa.array(y[first].astype(np.uint32).view(np.int32)), pa.array(ids[b.lo + rows[first]])]
                    names = ["x", "y", "id"]
                    if positions:
                        starts = pa.array((head - w.first[rows]).astype(np.int32))
                        cols += [pa.array(versions[b.lo + rows[first]]), pa.ListArray.from_arrays(pa.array(np.append(first, len(head)).astype(np.int32)), starts)]
                        names += ["version", "starts"]
                    out = pa.RecordBatch.from_arrays(cols, names=names)
                    for i in range(0, out.num_rows, 50_000):
                        yield out.slice(i, 50_000)
            tk.release()

        return run

    source = docs.select("id", "version", "text")
    seen = source.mapInArrow(candidates(False), "x long, y int, id long").groupBy("x", "y").agg(F.min("id").alias("least"), F.max("id").alias("most"))
    repeated = stored(seen.where(F.col("least") < F.col("most")).select("x", "y", "least"), "repeated-windows")
    del seen
    free_shuffles(spark)
    marked = source.mapInArrow(candidates(True), "x long, y int, id long, version long, starts array<int>").join(repeated, ["x", "y"]).where(F.col("id") > F.col("least"))
    # A document's marks are no more than its words.
    marks = stored(marked.groupBy("id", "version").agg(F.flatten(F.collect_list("starts")).alias("starts")), "marks")
    del marked
    free_shuffles(spark)  # the windows are gone before texts are joined to the marks
    return marks


def covered(n: int, starts: np.ndarray, window: int) -> np.ndarray:
    """Which of n words lie under a window that begins at one of `starts`."""
    edge = np.zeros(n + 1, dtype=np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.minimum(starts + window, n), -1)
    return np.cumsum(edge[:-1]) > 0


def dedup(docs: DataFrame, window: int = WINDOW, digest: bool = False) -> DataFrame:
    """doc_id, text -> doc_id, n_words, n_removed and text (or kept_sha256): the words left, joined by one space.

    Null texts have no words; texts shorter than a window keep theirs, as do rows with a null id; of rows with one id,
    none counts as smaller; extra columns are dropped.
    """
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("version", F.xxhash64("text"))
    marks = repeats(d.select(F.col("doc_id").cast("long").alias("id"), "version", "text"), window).withColumnsRenamed({"id": "m_id", "version": "m_version"})
    both = d.join(marks, (F.col("doc_id") == F.col("m_id")) & (F.col("version") == F.col("m_version")), "left").select("doc_id", "text", "starts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, starts in zip(batch.column(1), batch.column(2), strict=True):
                words = text.as_buffer().to_pybytes().split()  # of bytes, so at the contract's six bytes
                n = len(words)
                if starts.is_valid and len(starts):
                    gone = covered(n, starts.values.to_numpy(), window)
                    words = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                kept = b" ".join(words)
                rows.append((n, n - len(words), hashlib.sha256(kept).hexdigest() if digest else kept.decode()))
            n, removed, kept = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256" if digest else "text"])
        tk.release()

    return both.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words long, n_removed long, {'kept_sha256' if digest else 'text'} string")


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of documents with its words counted, those removed, and a digest of the rest; a null text has no words, of rows with one id none is smaller."""
    return dedup(text_of(table(spark, sf_dir, "documents")), digest=True)


#: Windows as lists of words: meant for tables of about a thousand documents.
ORACLE = rf"""
WITH t AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, len(w) - {WINDOW} + 2)) AS i FROM t WHERE len(w) >= {WINDOW}),
h AS (SELECT doc_id, i, md5(array_to_string(w[i : i + {WINDOW - 1}], ' ')) AS h FROM p),
r AS (SELECT h, min(doc_id) AS least FROM h GROUP BY h HAVING min(doc_id) < max(doc_id)),
m AS (SELECT DISTINCT doc_id, i + unnest(range({WINDOW})) AS k FROM h JOIN r USING (h) WHERE doc_id > least),
g AS (SELECT doc_id, list(k) AS ks, count(*) AS n FROM m GROUP BY doc_id)
SELECT t.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_removed,
       sha256(array_to_string(CASE WHEN n IS NULL THEN w ELSE (SELECT coalesce(list(w[j] ORDER BY j), []) FROM unnest(range(1, len(w) + 1)) u(j) WHERE NOT list_contains(ks, j)) END, ' ')) AS kept_sha256
FROM t LEFT JOIN g ON t.doc_id = g.doc_id
"""
