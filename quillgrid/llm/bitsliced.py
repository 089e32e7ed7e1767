"""Exact top-k by inner product over a bit-sliced index.

Rows are dealt by a hash of their id into blocks of a bounded number of rows, and each block becomes one index row:
for every attribute, a bitmap per bit of its quantised value. A query multiplies attributes by its own components with
shifts and adds of whole bitmaps (carry-save adders), which yields the bit slices of all scores of the block. The k
best rows are then found from the most significant slice downward: the candidates that have the slice's bit either
fit (taken whole) or remain the only candidates. What is left at the last slice ties, and goes to the smallest ids.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import stored, table

K = 5
SCALE = 256
#: Rows of an index block, and queries of a chunk; a task holds one of each at a time.
BLOCK_ROWS = 16384
CHUNK_ROWS = 256
#: Cells of the grid of blocks and chunks for each core.
CELLS = 4
#: Components beyond this size have no exact product sum in 64 bits.
LARGEST = 1 << 24


def quantised(vectors: DataFrame, id_col: str, vec_col: str, scale: int = SCALE) -> DataFrame:
    """id, q array<long>: floor(scale * x). Rows with a null id, vector or component, or a non-finite one, go.

    Scores are exact in 64 bits, so a component whose quantised size exceeds LARGEST is an error when the row is read.
    """
    d = vectors.select(F.col(id_col).cast("long").alias("id"), F.transform(vec_col, lambda x: x.cast("double")).alias("x"))
    bad = F.exists("x", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    d = d.where(F.col("id").isNotNull() & F.col("x").isNotNull()).where(~bad)
    fits = lambda x: F.when(F.abs(x * scale) <= LARGEST, F.floor(x * scale).cast("long")).otherwise(F.raise_error(F.lit("a component is too large for exact scores")).cast("long"))
    return d.select("id", F.transform("x", fits).alias("q"))


class Slices:
    """The bit slices of a block: `planes[d]` is a (bits, words) array of v - low, `low` each attribute's minimum."""

    def __init__(self, ids: np.ndarray, v: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, v = ids[order], v[order]
        n, dims = v.shape
        self.low = v.min(axis=0) if n else np.zeros(dims, dtype=np.int64)
        u = (v - self.low).astype(np.uint64)
        self.bits = [int(x).bit_length() for x in (u.max(axis=0) if n else np.zeros(dims, dtype=np.uint64))]
        self.words = -(-n // 64) or 1
        self.planes = []
        for d in range(dims):
            rows = np.zeros((self.bits[d], self.words * 64), dtype=np.uint8)
            for b in range(self.bits[d]):
                rows[b, :n] = (u[:, d] >> np.uint64(b)) & np.uint64(1)
            self.planes.append(np.packbits(rows, axis=1, bitorder="little").view(np.uint64))
        self.all = np.zeros(self.words * 64, dtype=np.uint8)
        self.all[:n] = 1
        self.all = np.packbits(self.all, bitorder="little").view(np.uint64)

    def to_bytes(self) -> bytes:
        head = np.array([len(self.ids), len(self.low), self.words, *self.bits, *self.low], dtype=np.int64)
        return b"".join([head.tobytes(), self.ids.astype(np.int64).tobytes(), self.all.tobytes(), *(p.tobytes() for p in self.planes)])

    @classmethod
    def of(cls, raw: bytes) -> Slices:
        self = cls.__new__(cls)
        n, dims, self.words = (int(x) for x in np.frombuffer(raw, np.int64, 3))
        self.bits = np.frombuffer(raw, np.int64, dims, 24).tolist()
        self.low = np.frombuffer(raw, np.int64, dims, 24 + 8 * dims)
        at = 24 + 16 * dims
        self.ids = np.frombuffer(raw, np.int64, n, at)
        at += 8 * n
        self.all = np.frombuffer(raw, np.uint64, self.words, at)
        at += 8 * self.words
        self.planes = []
        for b in self.bits:
            self.planes.append(np.frombuffer(raw, np.uint64, b * self.words, at).reshape(b, self.words))
            at += 8 * b * self.words
        return self

    def scores(self, q: np.ndarray) -> tuple[list[np.ndarray], int]:
        """Bit slices of the inner products with q, less an offset common to all rows, and that offset."""
        columns: list[list[np.ndarray]] = []
        offset = int((q.astype(object) * self.low.astype(object)).sum()) if len(q) else 0
        for d, weight in enumerate(q.tolist()):
            bits = self.bits[d]
            if not weight or not bits:
                continue
            plane = self.planes[d]
            if weight < 0:  # weight * u = |weight| * (top - u) - |weight| * top, and top - u is the complement
                plane = ~plane & self.all
                offset += weight * ((1 << bits) - 1)
                weight = -weight
            for j in range(weight.bit_length()):
                if weight >> j & 1:
                    while len(columns) < j + bits:
                        columns.append([])
                    for b in range(bits):
                        columns[j + b].append(plane[b])
        out, carry = [], np.zeros((0, self.words), dtype=np.uint64)
        at = 0
        while at < len(columns) or len(carry):
            own = columns[at] if at < len(columns) else []
            stack = np.concatenate([np.array(own, dtype=np.uint64).reshape(-1, self.words), carry])
            carries = []
            while len(stack) > 2:
                m = len(stack) // 3
                a, b, c = stack[:m], stack[m : 2 * m], stack[2 * m : 3 * m]
                ab = a ^ b
                carries.append((a & b) | (c & ab))
                stack = np.concatenate([ab ^ c, stack[3 * m :]])
            if len(stack) == 2:
                carries.append(stack[:1] & stack[1:])
                stack = stack[:1] ^ stack[1:]
            out.append(stack[0] if len(stack) else np.zeros(self.words, dtype=np.uint64))
            carry = np.concatenate(carries) if carries else carry[:0]
            at += 1
        return out, offset

    def top(self, q: np.ndarray, own: int, k: int) -> list[tuple[int, int]]:
        """(id, score) of the k best rows but those with the id `own`, ties to the smaller id."""
        slices, offset = self.scores(q)
        lo, hi = np.searchsorted(self.ids, [own, own + 1])
        left = self.all.copy()
        for i in range(lo, hi):
            left[i >> 6] &= ~(np.uint64(1) << np.uint64(i & 63))
        chosen = np.zeros_like(left)
        want = k
        for s in reversed(slices):
            both = left & s
            n = int(np.bitwise_count(both).sum())
            if n <= want:
                chosen |= both
                want -= n
                left &= ~s
                if not want:
                    break
            else:
                left = both
        at = _ones(chosen)
        if want:
            at = np.concatenate([at, _ones(left)[:want]])
        total = np.zeros(len(at), dtype=object)
        for b, s in enumerate(slices):
            total += ((s[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)).astype(object) << b
        return [(int(self.ids[i]), int(t) + offset) for i, t in zip(at, total, strict=True)]


def _ones(bitmap: np.ndarray) -> np.ndarray:
    """Positions of the bits that are set."""
    full = np.flatnonzero(bitmap)
    if not len(full):
        return full
    bits = np.unpackbits(bitmap[full].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    r, c = np.nonzero(bits)
    return full[r] * 64 + c


def _matrix(q: pd.Series) -> np.ndarray:
    return np.array(q.tolist(), dtype=np.int64).reshape(len(q), -1)


def build_index(rows: DataFrame, blocks: int) -> DataFrame:
    """id, q -> block, dims, index (binary). Vectors of unequal lengths go to index rows of their own."""
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")).withColumn("dims", F.size("q"))

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        v = _matrix(group["q"])
        return pd.DataFrame({"block": [int(group["block"].iloc[0])], "dims": [v.shape[1]], "index": [Slices(group["id"].to_numpy(np.int64), v).to_bytes()]})

    return dealt.groupBy("block", "dims").applyInPandas(pack, "block int, dims int, index binary")


def grid(blocks: int, chunks: int, cells: int) -> tuple[int, int]:
    """Parts of the blocks and slots of the chunks. Only where there are fewer blocks than cells are chunks told apart too."""
    parts = min(blocks, cells)
    return parts, min(chunks, -(-cells // parts))


def top_k(rows: DataFrame, queries: DataFrame, k: int = K, block_rows: int = BLOCK_ROWS, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """query_id, rank, id, score: each query's k best rows by inner product, all if fewer.

    rows and queries have id and q. A query meets only rows of its own length, and not those of its own id. Blocks of the
    index and chunks of queries are dealt to the cells of a grid, whose size goes by the cluster's cores and not by the
    rows, so what travels grows in proportion to the tables. In a cell every chunk meets every block by an equality join,
    which no broadcast through the driver replaces; each pair is one bounded piece of work, and k candidates a query and
    cell go on. Empty tables give an empty result; repeated ids are rows.
    """
    blocks = max(1, -(-rows.count() // block_rows))
    chunks = max(1, -(-queries.count() // chunk_rows))
    parts, slots = grid(blocks, chunks, CELLS * rows.sparkSession.sparkContext.defaultParallelism)
    index = stored(build_index(rows, blocks), "bit-slices").withColumnRenamed("index", "index_")
    q = queries.withColumn("chunk", F.pmod(F.xxhash64(F.col("id"), F.lit(1)), F.lit(chunks)).cast("int")).withColumn("dims", F.size("q"))

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        v = _matrix(group["q"])
        kind = next(x for x in ("<i2", "<i4", "<i8") if (v.astype(x) == v).all())
        return pd.DataFrame({"chunk": [int(group["chunk"].iloc[0])], "dims": [v.shape[1]], "ids": [group["id"].to_numpy(np.int64).tobytes()], "kind": [kind], "qs": [v.astype(kind).tobytes()]})

    packed = q.groupBy("chunk", "dims").applyInPandas(pack, "chunk int, dims int, ids binary, kind string, qs binary")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    visits = packed.withColumn("slot", F.col("chunk") % slots).withColumn("part", every(parts))
    blocks_of = index.withColumn("part", F.col("block") % parts).withColumn("slot", every(slots))
    cell = ["part", "slot", "dims"]
    n = 2 * parts * slots  # so that few cells share a task
    pairs = visits.repartition(n, *cell).join(blocks_of.repartition(n, *cell).hint("merge"), cell).coalesce(n)  # a join deals to spark.sql.shuffle.partitions at least, most of them empty here

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, ids, found = None, [], []

        def best() -> pd.DataFrame:
            return pd.DataFrame([(i, x, -t) for i, own in zip(ids, found, strict=True) for t, x in own], columns=["query_id", "id", "score"]).astype("int64")

        for batch in batches:
            for r in batch.itertuples():
                if held != (r.chunk, r.dims, r.part):  # a chunk's blocks come one after the other
                    yield best()
                    held, ids = (r.chunk, r.dims, r.part), np.frombuffer(r.ids, np.int64).tolist()
                    qs = np.frombuffer(r.qs, r.kind).astype(np.int64).reshape(len(ids), -1)
                    found = [[] for _ in ids]
                s = Slices.of(r.index_)
                for at, (i, v) in enumerate(zip(ids, qs, strict=True)):
                    found[at] = sorted(found[at] + [(-t, x) for x, t in s.top(v, i, k)])[:k]
        yield best()

    best = pairs.mapInPandas(search, "query_id long, id long, score long")
    place = W.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return best.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best rows of every query; vectors that are null or hold null or non-finite components take no part, ties go to the smaller id."""
    rows = quantised(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return top_k(rows, rows.where(F.col("id") % 50 == 0)).withColumnRenamed("id", "vec_id").select("query_id", "rank", "vec_id", "score")


ORACLE = f"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * {SCALE}) AS BIGINT)) AS q FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2])) AS BIGINT) AS score
      FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q) WHERE a.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= {K}
"""
