"""Mixing sources to target weights by weighted fair queueing, in DataFrame operations only.

Every document has a place in its source's shuffled queue. A copy that ends c words into the queue finishes at the
virtual time c / target of the source; the mix is all copies in order of finish time, cut at the total budget. A
source whose target exceeds its size is read a second time, in the same shuffled order, so one row holds both finish
times and nothing is exploded for the queues.

Queue positions are prefix sums over two levels: a shuffled order is cut into even slices of hash space, the slices'
sums are accumulated (sources x slices rows), and only the rows of one slice of one source are sorted together. All
copies are then range-sorted by finish time, over the whole mix, into partitions of a bounded number of rows; their sums tell
which partition the budget ends in, and only that one is accumulated row by row. No task holds a whole source.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, stored, table

WEIGHTS = (3, 1, 2)
#: The budget in halves of all sizes: 150 %.
BUDGET_HALVES = 3
MAX_PASSES = 2
SEED = "mix-1"
#: Rows that one slice of a queue holds at least, on average, and that a partition of the sorted mix does.
SLICE_ROWS, SORT_ROWS = 256, 65536


def words_in(text: Column) -> Column:
    """Words of a text; both functions are linear scans, and nothing is split into arrays of strings."""
    squeezed = F.regexp_replace(F.coalesce(text, F.lit("")), WORD, "w")
    return F.length(squeezed) - F.length(F.replace(squeezed, F.lit("w"), F.lit("")))


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, halves: int = BUDGET_HALVES, passes: int = MAX_PASSES) -> DataFrame:
    """source, source_size -> also ordinal, weight, target (double) and budget (double).

    Water-filling in closed form: sources in order of cap over weight meet their cap until the level that the rest
    of the budget allows lies below it; the others get weight times that level. One row a source, so small windows.
    """
    order = W.orderBy(F.col("source").asc_nulls_last())
    s = sources.withColumn("ordinal", F.row_number().over(order) - 1)
    s = s.withColumn("weight", F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), (F.col("ordinal") % len(weights) + 1).cast("int")))
    s = s.withColumn("cap", F.col("source_size") * passes)
    every = W.partitionBy()
    by_level = W.orderBy(F.col("cap") / F.col("weight"), F.col("ordinal"))
    s = s.withColumn("all2", F.sum("source_size").over(every) * halves)
    s = s.withColumn("caps_before", F.sum("cap").over(by_level) - F.col("cap"))
    s = s.withColumn("weights_left", F.sum("weight").over(every) - F.sum("weight").over(by_level) + F.col("weight"))
    s = s.withColumn("level_n", F.col("all2") - F.col("caps_before") * 2)
    s = s.withColumn("is_open", F.col("weight") * F.col("level_n") <= F.col("cap") * 2 * F.col("weights_left"))
    s = s.withColumn("first_open", F.min(F.when(F.col("is_open"), F.struct(F.col("cap") / F.col("weight"), "ordinal", "level_n", "weights_left"))).over(every))
    level = F.col("first_open.level_n"), F.col("first_open.weights_left")
    capped = F.col("first_open").isNull() | (F.struct(F.col("cap") / F.col("weight"), "ordinal") < F.struct(F.col("first_open.col1"), F.col("first_open.ordinal")))
    target = F.when(capped, F.col("cap").cast("double")).otherwise((F.col("weight") * level[0]).cast("double") / (level[1] * 2).cast("double"))
    return s.select("source", "source_size", "ordinal", "weight", target.alias("target"), (F.col("all2").cast("double") / 2.0).alias("budget"))


def mix(docs: DataFrame, seed: str = SEED, slice_rows: int = SLICE_ROWS, also: tuple[str, ...] = (), sort_rows: int = SORT_ROWS) -> DataFrame:
    """doc_id, source, text -> doc_id, source, size, source_size, target, copies (0..2) and taken of every row.

    Null texts and texts without words have size 0 and are taken as the queue passes them; a null source is a source
    of its own, last in order; repeated doc_ids are rows of their own, and rows with a null id are shuffled by their
    texts; an empty table gives an empty result. Ties in the shuffle hash fall to doc_id, then size, equal finish times to
    source, then shuffle order. Columns named in `also` stay, and what is still tied falls to them; others are dropped.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    name = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("null:"), F.sha2(text.cast("binary"), 256)))
    d = docs.select("doc_id", "source", *also, words_in(text).cast("long").alias("size"), F.sha2(F.concat_ws(":", F.lit(seed), name), 256).alias("key"))
    d = stored(d, "mix-sizes")  # the texts are read once
    rows = d.count()
    # Slices hold about as many rows whatever their source; both the slices and their rows grow with the root of a large table.
    per = max(slice_rows, math.isqrt(rows))
    held = stored(d.groupBy("source").agg(F.ceil(F.count("*") / per).alias("slices")), "mix-sources")  # one row a source
    d = d.alias("d").join(held.alias("h"), F.col("d.source").eqNullSafe(F.col("h.source"))).select("d.*", "slices")
    d = d.withColumn("slice", F.floor(F.conv(F.substring("key", 1, 8), 16, 10).cast("long") * F.col("slices") / (1 << 32)).cast("long")).drop("slices")

    # Queue positions: sums of whole slices before, then the running sum within the slice.
    sums = d.groupBy("source", "slice").agg(F.sum("size").alias("slice_size"))
    sums = stored(sums, "mix-slices")
    goals = stored(targets(sums.groupBy("source").agg(F.sum("slice_size").alias("source_size"))), "mix-targets")
    before = W.partitionBy("source").orderBy("slice")
    starts = sums.withColumn("start", F.sum("slice_size").over(before) - F.col("slice_size"))
    starts = starts.alias("s").join(goals.alias("g"), F.col("s.source").eqNullSafe(F.col("g.source"))).select("s.source", "s.slice", "start", "source_size", "ordinal", "target")
    inside = W.partitionBy("source", "slice").orderBy("key", "doc_id", "size", *also).rowsBetween(W.unboundedPreceding, W.currentRow)
    q = d.withColumn("run", F.sum("size").over(inside)).alias("d").join(starts.alias("t"), F.col("d.source").eqNullSafe(F.col("t.source")) & (F.col("d.slice") == F.col("t.slice")))
    q = q.select("doc_id", "d.source", *also, "size", "key", "ordinal", "source_size", "target", (F.col("start") + F.col("run")).alias("c"))
    finish = lambda c: F.when(F.col("target") > 0, c.cast("double") / F.col("target"))
    q = q.withColumn("f0", finish(F.col("c"))).withColumn("f1", finish(F.col("c") + F.col("source_size")))
    q = stored(q, "mix-queue")

    # All copies in order of finish: a global range sort, written once with each row's partition and place.
    order = ["f", "ordinal", "key", "doc_id", *also, "nth"]
    copy = lambda f, n: q.where(F.col(f).isNotNull()).select("size", "ordinal", "key", "doc_id", *also, F.col(f).alias("f"), F.lit(n).alias("nth"))
    copies = copy("f0", 0).unionByName(copy("f1", 1))
    laid = copies.repartitionByRange(max(1, -(-2 * rows // sort_rows)), *order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id())
    laid = stored(laid, "mix-sorted")
    parts = laid.groupBy(F.shiftright("place", 33).alias("part")).agg(F.sum("size").alias("n"))
    parts = parts.withColumn("through", F.sum("n").over(W.orderBy("part")))  # one row a partition
    budget = goals.agg(F.max("budget")).first()[0]
    end = parts.where(F.col("through") > F.lit(budget)).orderBy("part").first()
    if end is None:  # nothing exceeds the budget
        in_mix = lambda f, n: F.col(f).isNotNull()
    else:
        part = laid.where((F.col("place") >= end["part"] << 33) & (F.col("place") < end["part"] + 1 << 33))
        through = F.sum("size").over(W.orderBy("place").rowsBetween(W.unboundedPreceding, W.currentRow)) + F.lit(end["through"] - end["n"])
        over = part.withColumn("through", through).where(F.col("through") > F.lit(budget)).orderBy("place").select(*order).first()
        kinds = dict(copies.dtypes)
        cut = F.struct(*[F.lit(over[c]).cast(kinds[c]) for c in order])
        in_mix = lambda f, n: F.col(f).isNotNull() & (F.struct(F.col(f), *order[1:-1], F.lit(n)) < cut)
    taken = (in_mix("f0", 0).cast("int") + in_mix("f1", 1).cast("int")).alias("copies")
    return q.select("doc_id", "source", *also, "size", "source_size", "target", taken).withColumn("taken", F.col("size") * F.col("copies"))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of documents with its size and what the mix takes of it; nulls, ties and repeats as `mix` says."""
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


ORACLE = rf"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         sha256('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), 'null:' || sha256(coalesce(text, '')))) AS key
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS ordinal, source_size * 2 AS cap FROM s),
v AS (SELECT *, CASE ordinal % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight, CAST(sum(source_size) OVER () AS BIGINT) * 3 AS all2 FROM w),
l AS (SELECT *, CAST(cap AS DOUBLE) / weight AS ratio FROM v),
x AS (SELECT *, CAST(sum(cap) OVER o AS BIGINT) - cap AS caps_before, CAST(sum(weight) OVER () - sum(weight) OVER o AS BIGINT) + weight AS weights_left
      FROM l WINDOW o AS (ORDER BY ratio, ordinal)),
y AS (SELECT *, all2 - caps_before * 2 AS level_n FROM x),
z AS (SELECT level_n AS ln, weights_left AS wl, ratio AS r, ordinal AS o FROM y WHERE weight * level_n <= cap * 2 * weights_left ORDER BY ratio, ordinal LIMIT 1),
g AS (SELECT y.source, y.source_size, y.ordinal, all2 / 2.0::DOUBLE AS budget,
             CASE WHEN z.r IS NULL OR (y.ratio, y.ordinal) < (z.r, z.o) THEN CAST(cap AS DOUBLE)
                  ELSE CAST(weight * z.ln AS DOUBLE) / CAST(z.wl * 2 AS DOUBLE) END AS target
      FROM y LEFT JOIN z ON true),
q AS (SELECT d.doc_id, d.size, d.key, g.ordinal, g.source_size, g.target, g.budget,
             CAST(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS c
      FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source),
k AS (SELECT *, 0 AS nth, CASE WHEN target > 0 THEN CAST(c AS DOUBLE) / target END AS f FROM q
      UNION ALL SELECT *, 1 AS nth, CASE WHEN target > 0 THEN CAST(c + source_size AS DOUBLE) / target END AS f FROM q),
t AS (SELECT *, sum(size) OVER (ORDER BY f, ordinal, key, doc_id, nth ROWS UNBOUNDED PRECEDING) AS through FROM k WHERE f IS NOT NULL)
SELECT q.doc_id, q.size, q.source_size, q.target, CAST(coalesce(u.taken, 0) AS BIGINT) AS taken
FROM q LEFT JOIN (SELECT doc_id, sum(size) AS taken FROM t WHERE through <= budget GROUP BY doc_id) u ON q.doc_id = u.doc_id
"""
