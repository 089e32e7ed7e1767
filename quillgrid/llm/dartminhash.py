"""MinHash near-dedup by DartMinHash: weighted signatures from hashed darts, banded joining, exact verification.

Darts fall on the plane of weight and rank above every element, at unit density and the same ones wherever the element
occurs. A document keeps the darts that fall below an element's weight and a rank bound that leaves it about k ln k;
each dart belongs to one of k coordinates, and a coordinate's value is its earliest dart. Two documents agree in a
coordinate with the probability of their weighted Jaccard similarity. (T. Christiani, DartMinHash, 2020.)

Elements are a document's shingles. One that occurs more than once weighs up to TILT more than one that occurs once: 1 +
TILT * (1 - 1 / count). Raw counts would make near duplicates of unlike documents that repeat one line often. Two
documents are near duplicates if their similarity by these weights is high enough, or that of the shingles as sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkernel as tk
from .common import stored, table, text_of, without
from .components import components

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 24, 5
#: Most bits of the filter of documents to compare: 64 MB. More documents than it tells apart pass it and are joined away.
FILTER_BITS = 1 << 29
#: How much more a repeated shingle weighs at most.
TILT = 0.25
#: Documents on either side of a meeting within a large bucket.
BLOCK = 256
#: Rows whose darts are thrown at once: some thousand darts each.
DART_ROWS = 256
_U = np.uint64
#: Poisson(1) counts: how many darts a unit area gets, by a uniform number.
_POISSON = np.cumsum([np.exp(-1) / f for f in (1, 1, 2, 6, 24, 120, 720, 5040, 40320, 362880, 3628800)])


def _unit(h: np.ndarray) -> np.ndarray:
    return (h >> _U(11)).astype(np.float64) / (1 << 53)


def _throw(keys: np.ndarray, weights: np.ndarray, rows: np.ndarray, theta: np.ndarray, k: int, best: np.ndarray) -> None:
    """Throw the darts of elements below their weights and their rows' rank bounds; best[row * k + j] keeps the earliest.

    The plane is cut into regions whose weights and ranks double: region (nu, rho) has 2^rho unit areas, each with
    Poisson(1) darts that the element's hash decides. All areas of a region that can matter are thrown at once.
    """
    bound = theta[rows]
    for nu in range(int(np.log2(1 + weights.max(initial=0.0))) + 1 if len(keys) else 0):
        low, width = 2.0**nu - 1, 2.0**nu
        for rho in range(64):
            floor = (2.0**rho - 1) / width
            at = np.flatnonzero((weights > low) & (bound > floor))
            if not len(at):
                break
            areas = np.minimum(np.ceil((bound[at] - floor) * width), 2.0**rho).astype(np.int64)
            e = np.repeat(at, areas)
            area = np.arange(len(e)) - np.repeat(np.cumsum(areas) - areas, areas)
            h = tk.mix(tk.mix(keys[e] + tk.stream(nu * 64 + rho, 1)[0]) + area.astype(_U))
            darts = np.searchsorted(_POISSON, _unit(h), side="right")
            for i in range(int(darts.max(initial=0))):
                on = np.flatnonzero(darts > i)
                x, d = e[on], tk.mix(h[on] + tk.stream(7000 + i, 1)[0])
                weight = low + width * _unit(tk.mix(d + _U(1)))
                rank = floor + (area[on] + _unit(tk.mix(d + _U(2)))) / width
                hit = (weight < weights[x]) & (rank < bound[x])
                d, x = d[hit], x[hit]
                # Ranks are positive, so the bits of a float order as it does; the dart's own bits follow.
                value = rank[hit].astype(np.float32).view(np.uint32).astype(_U) << _U(32) | d >> _U(32)
                np.minimum.at(best, rows[x] * k + (tk.mix(d + _U(3)) % _U(k)).astype(np.int64), value)


def signatures(keys: np.ndarray, weights: np.ndarray, rows: np.ndarray, n: int, k: int) -> np.ndarray:
    """(n, k) signatures of n weighted sets, given as elements with a key, a weight and a row; empty sets have all ones."""
    none = _U(0xFFFFFFFFFFFFFFFF)
    best = np.full(n * k, none)
    total = np.bincount(rows, weights, n)
    theta = np.where(total > 0, (k * np.log(k) + 2 * k) / np.maximum(total, 1e-300), 0)
    todo = np.ones(len(keys), dtype=bool)
    while todo.any():
        _throw(keys[todo], weights[todo], rows[todo], theta, k, best)
        open_ = (best.reshape(n, k) == none).any(axis=1) & (total > 0)
        theta = theta * 2  # rows with a coordinate still empty throw further; what is there stays the earliest
        todo = open_[rows]
    return best.reshape(n, k)


def shingles(b: tk.Block, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of a block's rows: keys, rows and counts, by row and key; and each row's content hash.

    A row of fewer words has one shingle of all its words, a row without words none.
    """
    w = tk.Words(b)
    h = w.hashes()
    start, g = tk.windows(h, w.first, size, 31)
    rows = w.rows()
    count = np.diff(w.first)
    up, down = tk.powers(len(h) + 1)
    sums = np.zeros(len(h) + 1, dtype=np.uint64)
    np.cumsum(tk.mix(h + _U(5)) * up[: len(h)], out=sums[1:])
    content = tk.mix((sums[w.first[1:]] - sums[w.first[:-1]]) * down[w.first[:-1]] + count.astype(_U))
    short = np.flatnonzero((count > 0) & (count < size))
    keys, of = np.concatenate([g, content[short]]), np.concatenate([rows[start], short])
    order = np.lexsort((keys, of))
    keys, of = keys[order], of[order]
    new = np.ones(len(keys), dtype=bool)
    new[1:] = (keys[1:] != keys[:-1]) | (of[1:] != of[:-1])
    at = np.flatnonzero(new)
    return keys[at], of[at], np.diff(np.append(at, len(keys))), content


def _second(keys: np.ndarray, of: np.ndarray, times: np.ndarray, n: int) -> np.ndarray:
    """The other half of each row's content hash, by its shingles."""
    out = np.zeros(n, dtype=np.uint64)
    np.add.at(out, of, tk.mix(keys + _U(99)) * times.astype(_U))
    return out


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """(n, bands) keys, each a hash of `rows` coordinates."""
    h = np.broadcast_to(tk.stream(57, bands), (len(sig), bands)).copy()
    for r in range(rows):
        h = tk.mix(h ^ tk.mix(sig[:, r::rows][:, :bands] + _U(r + 1)))
    return h


def weights_of(times: np.ndarray, tilt: float) -> np.ndarray:
    """Weights of elements that occur so many times."""
    return 1 + tilt * (1 - 1 / times)


def sketches(docs: DataFrame, shingle: int = SHINGLE, bands: int = BANDS, rows: int = ROWS, tilt: float = TILT) -> DataFrame:
    """doc_id, text -> doc_id, c1, c2 (128 bits of the words' hash) and keys array<long>; no keys for texts without words.

    Further columns stay, after doc_id.
    """
    kept = [f for f in docs.schema.fields if f.name not in ("doc_id", "text")]
    names = ["doc_id", *(f.name for f in kept), "c1", "c2", "keys"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in tk.blocks(batch.column(1), max_rows=DART_ROWS):
                keys, of, times, content = shingles(b, shingle)
                second = _second(keys, of, times, b.n)
                full = np.bincount(of, minlength=b.n) > 0
                found = band_keys(signatures(keys, weights_of(times, tilt), of, b.n, bands * rows), bands, rows)[full]
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(full * bands)).astype(np.int32)), pa.array(found.reshape(-1).view(np.int64)))
                same = [batch.column(i).slice(b.lo, b.n) for i in (0, *range(2, batch.num_columns))]
                yield pa.RecordBatch.from_arrays([*same, pa.array(content.view(np.int64)), pa.array(second.view(np.int64)), lists], names=names)
        tk.release()

    also = "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in kept)
    return docs.select("doc_id", "text", *[f"`{f.name}`" for f in kept]).mapInArrow(run, f"doc_id long{also}, c1 long, c2 long, keys array<long>")


def _filter(rows: DataFrame) -> tuple[bytes, int]:
    """A Bloom filter of rows (doc_id, mark) and its size in bits: at most FILTER_BITS, whatever their number, so it may be broadcast."""
    bits = 1 << min(FILTER_BITS.bit_length() - 1, max(15, (rows.count() * 16).bit_length()))
    cells = rows.select(F.explode(F.array(*_cells(bits))).alias("cell"))
    # bitmap_bit_position counts from 0 within a bucket of 2^15 bits, buckets from 1
    parts = cells.groupBy(F.bitmap_bucket_number("cell").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("cell")).alias("part"))
    out = bytearray((bits >> 3) + 4096)
    for r in parts.toLocalIterator():
        out[(r["k"] - 1) * 4096 : r["k"] * 4096] = r["part"]
    return bytes(out), bits


def _cells(bits: int) -> list[Column]:
    return [F.pmod(F.xxhash64("doc_id", "mark", F.lit(i)), F.lit(bits)) + 1 for i in range(2)]


def packed(keys: np.ndarray, times: np.ndarray) -> bytes:
    """Sorted distinct keys, and how often each occurs where any does more than once."""
    head = np.array([len(keys)], dtype=np.uint64).tobytes() + keys.tobytes()
    return head + times.astype(np.uint32).tobytes() if (times > 1).any() else head


def unpacked(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = int(np.frombuffer(raw, np.uint64, 1)[0])
    keys = np.frombuffer(raw, np.uint64, n, 8)
    return keys, np.frombuffer(raw, np.uint32, n, 8 + 8 * n).astype(np.int64) if len(raw) > 8 + 8 * n else np.ones(n, dtype=np.int64)


def _sets(docs: DataFrame, involved: DataFrame, shingle: int) -> DataFrame:
    """id and its shingles as sorted keys with counts, `packed`, for the contents involved.

    involved: id, c1, c2 and one row, (doc_id, mark), of each content. Texts are not shuffled: rows that a filter of
    these rules out are dropped where they are read.
    """
    raw_filter, bits = _filter(involved)
    shipped = docs.sparkSession.sparkContext.broadcast(raw_filter)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.frombuffer(shipped.value, np.uint8)
        for batch in batches:
            maybe = np.ones(batch.num_rows, dtype=bool)
            for i in (1, 2):
                cell = batch.column(i).to_numpy() - 1
                maybe &= (held[cell >> 3] >> (cell & 7).astype(np.uint8) & 1).astype(bool)
            batch = batch.filter(pa.array(maybe))  # noqa: PLW2901
            for b in tk.blocks(batch.column(0)):
                keys, of, times, content = shingles(b, shingle)
                second = _second(keys, of, times, b.n)
                first = np.searchsorted(of, np.arange(b.n + 1))
                raw = [packed(keys[i:j], times[i:j]) for i, j in zip(first[:-1], first[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(content.view(np.int64)), pa.array(second.view(np.int64)), pa.array(raw, pa.binary())], names=["c1", "c2", "keys"])
        tk.release()

    read = docs.select("text", *[c.alias(f"cell{i}") for i, c in enumerate(_cells(bits))]).mapInArrow(run, "c1 long, c2 long, keys binary")
    # Copies of one content combine before they shuffle.
    return read.dropDuplicates(["c1", "c2"]).join(involved.select("c1", "c2", "id"), ["c1", "c2"]).select("id", "keys")


def similarities(a: bytes, b: bytes, tilt: float) -> tuple[float, float]:
    """Jaccard similarity of two packed sets, and the weighted one."""
    (x, m), (y, n) = unpacked(a), unpacked(b)
    if not len(x) or not len(y):
        return (float(len(x) == len(y)),) * 2
    at = np.minimum(np.searchsorted(y, x), len(y) - 1)
    on = y[at] == x
    common = int(on.sum())
    plain = common / (len(x) + len(y) - common)
    if not tilt or int(m.sum() + n.sum()) == len(x) + len(y):
        return plain, plain
    least = weights_of(np.minimum(m[on], n[at[on]]), tilt).sum()
    return plain, float(least / (weights_of(m, tilt).sum() + weights_of(n, tilt).sum() - least))


def reach(least: float, tilt: float) -> float:
    """How far near duplicates can be apart as sets, in Jaccard distance: elements weigh 1 to 1 + tilt."""
    return 1 - least / (least + (1 - least) * (1 + tilt))


def _with_sets(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """pairs (a, b, ...) with the sets of both, as ka and kb."""
    left = sets.select(F.col("id").alias("a"), F.col("keys").alias("ka"))
    return pairs.join(left, "a").join(sets.select(F.col("id").alias("b"), F.col("keys").alias("kb")), "b")


def _judged(pairs: DataFrame, sets: DataFrame, least: float, tilt: float) -> DataFrame:
    """The pairs (a, b) with their distance as sets, and near, whether they are near duplicates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [similarities(x.as_buffer(), y.as_buffer(), tilt) for x, y in zip(batch.column(2), batch.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([1 - x for x, _ in found], pa.float64()), pa.array([max(x) >= least for x in found], pa.bool_())], names=["a", "b", "apart", "near"])
        tk.release()

    return _with_sets(pairs, sets).select("a", "b", "ka", "kb").mapInArrow(run, "a long, b long, apart double, near boolean")


def _across(members: DataFrame, sets: DataFrame, least: float, tilt: float, block: int = BLOCK) -> DataFrame:
    """a, b: all links between members of one bucket but different classes.

    members: p (the bucket's pivot), id, class, out (not of the pivot's class), apart (the distance from the pivot). One of such
    a pair is out. Jaccard distance is a metric, so near duplicates lie in rings around the pivot that are no farther
    apart than they may be: those that are out meet the members of the rings within reach, in blocks of some `block` rows
    which meet each other once. A meeting counts common shingles through an inverted index and yields links only, so no
    pair is ever a row, no task gets a whole bucket, and nothing is left out.
    """
    far = reach(least, tilt)
    m = stored(members.withColumn("ring", F.floor(F.col("apart") / F.lit(far / 2 + 1e-9)).cast("int")), "dart-rings")
    right = m.select("p", F.col("ring").alias("q"), "id", "class")
    left = m.where("out").select("p", F.explode(F.transform(F.sequence(F.lit(-2), F.lit(2)), lambda i: F.col("ring") + i)).alias("q"), "id", "class")
    parts = lambda d, to: d.groupBy("p", "q").agg(F.ceil(F.count("*") / block).cast("int").alias(to))
    blocks = stored(parts(left, "lefts").join(parts(right, "rights"), ["p", "q"]), "dart-blocks")
    dealt = lambda of: F.pmod(F.xxhash64("id"), F.col(of)).cast("int")
    every = lambda of: F.explode(F.sequence(F.lit(0), F.col(of) - 1))
    left = left.join(blocks, ["p", "q"]).select("p", "q", dealt("lefts").alias("l"), every("rights").alias("r"), "id", "class")
    right = right.join(blocks, ["p", "q"]).select("p", "q", every("lefts").alias("l"), dealt("rights").alias("r"), "id", "class")

    def meet(ours: pd.DataFrame, others: pd.DataFrame) -> pd.DataFrame:
        found: list[tuple[int, int]] = []
        if len(ours) and len(others):
            sets_ = [unpacked(x) for x in others["keys"]]
            size, total = np.array([len(x) for x, _ in sets_]), np.array([weights_of(n, tilt).sum() for _, n in sets_])
            token, times = np.concatenate([x for x, _ in sets_]), np.concatenate([n for _, n in sets_])
            order = np.argsort(token, kind="stable")
            token, times, owner = token[order], times[order], np.repeat(np.arange(len(sets_)), size)[order]
            ids, names = others["id"].to_numpy(), others["class"].to_numpy()
            for i, name, raw in zip(ours["id"].tolist(), ours["class"].tolist(), ours["keys"], strict=True):
                x, n = unpacked(raw)
                lo, hi = np.searchsorted(token, x, side="left"), np.searchsorted(token, x, side="right")
                hits = hi - lo
                at = np.repeat(lo - np.cumsum(hits) + hits, hits) + np.arange(hits.sum())
                common = np.bincount(owner[at], minlength=len(size))
                shared = np.bincount(owner[at], weights_of(np.minimum(times[at], np.repeat(n, hits)), tilt), len(size))
                near = (common >= least * (len(x) + size - common)) | (shared >= least * (weights_of(n, tilt).sum() + total - shared))
                found.extend((i, j) for j in ids[near & (names != name)].tolist())
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    keys = ("p", "q", "l", "r")
    with_sets = lambda d: d.join(sets, "id").select(*[F.col(c).alias(c) for c in (*keys, "id", "class", "keys")]).groupBy(*keys)
    return with_sets(left).cogroup(with_sets(right)).applyInPandas(meet, "a long, b long").distinct()


def grouped(docs: DataFrame, least: float = SIMILARITY, shingle: int = SHINGLE, bands: int = BANDS, rows: int = ROWS, tilt: float = TILT, block: int = BLOCK) -> DataFrame:
    """doc_id, text -> doc_id, c1, c2 (the content's hash), group and class_id of every row: classes of near duplicates.

    group tells classes apart; class_id is the class's smallest doc_id, null where no member has one. Further columns
    stay, but those named like the result's, keys or mark are replaced or dropped.

    Texts of the same words are one class at once, texts without words too; each content goes on as one node, whatever
    the ids of its rows. The members of a bucket are compared with its smallest and its largest, which is all pairs up to
    three members; where a larger bucket then still holds several classes, `_across` finds every link between two of
    them. Links are pairs of exact similarity `least` or more, and classes are what links connect. Null texts are empty
    ones; ids play no part: rows of one id with two texts, and rows with a null id, have the class of their words.
    """
    docs = without(docs, "c1", "c2", "group", "class_id", "keys", "mark")
    docs = docs.withColumn("doc_id", F.col("doc_id").cast("long")).withColumn("text", F.coalesce("text", F.lit("")))
    docs = docs.withColumn("mark", F.xxhash64("text"))
    sig = stored(sketches(docs, shingle, bands, rows, tilt), "dart-sketches")
    # The first row of a content, by (doc_id, mark) with a null id last, stands for it.
    first = F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "mark")).alias("row")
    unique = sig.groupBy("c1", "c2").agg(first, F.first("keys").alias("keys"))
    # Written at once, so that a content keeps its number.
    unique = stored(unique.select("c1", "c2", "row.doc_id", "row.mark", "keys", F.monotonically_increasing_id().alias("id")), "dart-unique")
    member = unique.select(F.explode("keys").alias("key"), "id")
    shared = member.groupBy("key").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.count("*").alias("n")).where(F.col("lo") < F.col("hi"))
    buckets = stored(member.join(stored(shared, "dart-shared"), "key"), "dart-buckets")
    pair = lambda d, x, y: d.where(F.col(x) > F.col(y)).select(F.col(x).alias("a"), F.col(y).alias("b"))
    pairs = stored(pair(buckets, "id", "lo").unionByName(pair(buckets, "hi", "id")).distinct(), "dart-pairs")
    met = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
    involved = stored(unique.select("id", "c1", "c2", "doc_id", "mark").join(met, "id"), "dart-involved")
    sets = stored(_sets(docs, involved, shingle), "dart-sets")
    judged = stored(_judged(pairs, sets, least, tilt), "dart-judged")
    label = components(judged.where("near").select("a", "b"))

    # Larger buckets of more than one class: what the two pivots don't decide. Buckets of one pivot meet together.
    named = buckets.where(F.col("n") > 3).select("id", F.col("lo").alias("p")).distinct().join(label, F.col("id") == F.col("node"), "left").select("p", "id", F.coalesce("label", "id").alias("class"))
    home = stored(named.where(F.col("p") == F.col("id")).select("p", F.col("class").alias("home")), "dart-home")
    # Written before it is counted, so that a pivot of very many members is split like any skewed key of a join.
    placed = stored(named.join(home, "p").select("p", "id", "class", (F.col("class") != F.col("home")).alias("out")), "dart-placed")
    mixed = placed.where("out").select("p").distinct()
    distance = judged.select(F.col("a").alias("id"), F.col("b").alias("p"), "apart")
    members = placed.join(stored(mixed, "dart-mixed"), "p").join(distance, ["p", "id"], "left").withColumn("apart", F.coalesce("apart", F.lit(0.0)))  # the pivot has none
    more = stored(_across(members, sets, least, tilt, block), "dart-more")
    class_of = lambda side: label.select(F.col("node").alias(side), F.col("label").alias(f"c{side}"))
    more = more.join(class_of("a"), "a", "left").join(class_of("b"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    above = components(more.distinct())
    label = label.join(above.select(F.col("node").alias("label"), F.col("label").alias("top")), "label", "left").select("node", F.coalesce("top", "label").alias("label"))
    alone = above.join(label, "node", "left_anti")  # classes of one content that were linked just now
    label = stored(label.unionByName(alone), "dart-labels")

    # Contents that nothing links are classes of their own; the others take the smallest doc_id that their label has.
    one = unique.select("c1", "c2", "doc_id", "id")
    named = stored(one.join(label, F.col("id") == F.col("node"), "left").select("c1", "c2", "doc_id", "label", F.coalesce("label", "id").alias("group")), "dart-named")
    least_id = named.where("label is not null").groupBy("label").agg(F.min("doc_id").alias("least_id"))
    linked = named.where("label is not null").join(least_id, "label").select("c1", "c2", "group", F.col("least_id").alias("class_id"))
    every = stored(linked.unionByName(named.where("label is null").select("c1", "c2", "group", F.col("doc_id").alias("class_id"))), "dart-classes")
    return sig.drop("keys", "mark").join(every, ["c1", "c2"])


def classes(docs: DataFrame, **options) -> DataFrame:
    """doc_id, text -> doc_id, class_id of every row, as `grouped` finds them."""
    return grouped(docs.select("doc_id", "text"), **options).select("doc_id", "class_id")


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and class_id of every row of documents: the smallest id among its near duplicates by five-word shingles.

    Null and empty texts, and texts without words, are one class; texts of fewer than five words have one shingle, all
    their words; repeated rows are rows of the result. An empty table gives an empty result. Classes don't depend on order.
    """
    return classes(text_of(table(spark, sf_dir, "documents")))
