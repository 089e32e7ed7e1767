"""WARC fixity: Merkle trees over records and offset ranges, and an audit that descends only where replicas differ.

Pages are written as WARC records into shards of a bounded number of bytes; a shard's records are in the order of their
keys, the hashes that their record ids come from, and each has a byte range. A leaf of a shard's tree is the hash of a
record's bytes. The nodes above go by the keys' leading digits, so each covers a run of records, an offset range; it hashes
its children's hashes and the lengths of their ranges, in order. A range's start is kept but not hashed: a record that is
lost or added moves what follows, yet changes only the nodes above itself. An audit compares the shards' roots and, level by
level, the children of nodes that differ, so what it reads beyond the roots is in proportion to the damage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import stored, table

#: Bytes of a shard, on average.
SHARD_BYTES = 8 << 20
#: Hexadecimal digits of a key that the nodes of one level add: 16 children a node. The remainder of the first eight is the shard.
DIGITS, SHARD_DIGITS = 1, 8
DATE = "1970-01-01T00:00:00Z"


def _record_id(key: Column) -> Column:
    part = lambda at, n: F.substring(key, at, n)
    return F.concat(F.lit("<urn:uuid:"), part(1, 8), F.lit("-"), part(9, 4), F.lit("-"), part(13, 4), F.lit("-"), part(17, 4), F.lit("-"), part(21, 12), F.lit(">"))


def record(url: Column, html: Column, key: Column, date: str = DATE) -> Column:
    """The bytes of a page's WARC record; a null page is an empty one. Line ends in a url become spaces, so that it stays one field."""
    body = F.coalesce(html, F.lit("")).cast("binary")
    head = F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: "), _record_id(key), F.lit(f"\r\nWARC-Date: {date}\r\nWARC-Target-URI: "),
        F.regexp_replace(F.coalesce(url, F.lit("")), r"[\r\n]", " "), F.lit("\r\nWARC-Payload-Digest: sha256:"), F.sha2(body, 256),
        F.lit("\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"),
    )
    return F.concat(head.cast("binary"), body, F.lit("\r\n\r\n").cast("binary"))


def key_of(page_id: Column, url: Column, html: Column) -> Column:
    """What a record is known by: the hash of its page's id, or, without one, of its url and content."""
    content = F.concat(F.lit("null:"), F.sha2(F.concat_ws("\n", F.coalesce(url, F.lit("")), F.coalesce(html, F.lit(""))).cast("binary"), 256))
    return F.sha2(F.coalesce(page_id.cast("string"), content).cast("binary"), 256)


def number_of(key: Column) -> Column:
    return F.conv(F.substring(key, 1, SHARD_DIGITS), 16, 10).cast("long")


def archive(pages: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """page_id, url, html -> page_id, key, nth, shard, ordinal, offset, length, record: stored WARC shards.

    Shards are dealt by a key's hash, records ordered by key; repeated rows are records of their own, told apart by nth.
    A shard's records come together once, as its file would need them. Extra columns are dropped; an empty table has none.
    """
    d = pages.select("page_id", "url", "html", key_of(F.col("page_id"), F.col("url"), F.col("html")).alias("key"))
    d = d.select("page_id", "key", record(F.col("url"), F.col("html"), F.col("key")).alias("record")).withColumn("length", F.octet_length("record").cast("long"))
    shards = max(1, -(-(d.agg(F.sum("length")).first()[0] or 0) // shard_bytes))
    d = d.withColumn("shard", number_of(F.col("key")) % shards)
    order = W.partitionBy("shard").orderBy("key", "record")
    upto = order.rowsBetween(W.unboundedPreceding, W.currentRow)
    d = d.withColumn("ordinal", F.row_number().over(order).cast("long") - 1).withColumn("offset", F.sum("length").over(upto) - F.col("length"))
    d = d.withColumn("nth", F.row_number().over(W.partitionBy("shard", "key").orderBy("ordinal")).cast("long") - 1)
    return stored(d.select("page_id", "key", "nth", "shard", "ordinal", "offset", "length", "record"), "warc", compression="zstd")


def tree(shards: DataFrame, digits: int = DIGITS, depth: int | None = None) -> list[DataFrame]:
    """Levels of all shards' trees, leaves first, roots last: shard, node, nth, lo, hi (its byte range), hash.

    A leaf's node is its record's key, that of an inner node the leading digits that its records share. depth: the levels
    above the leaves; two trees are compared if it is the same. By default, so many that a lowest node has some 16 records.
    """
    leaf = shards.select("shard", F.col("key").alias("node"), "nth", F.col("offset").alias("lo"), (F.col("offset") + F.col("length")).alias("hi"), F.sha2("record", 256).alias("hash"))
    out = [stored(leaf, "merkle-0")]
    if depth is None:
        most = out[0].groupBy("shard").count().agg(F.max("count")).first()[0] or 0
        depth = 1
        while 16 ** (digits * depth) < most:
            depth += 1
    for up in range(depth - 1, -1, -1):
        child = F.struct("node", "nth", (F.col("hi") - F.col("lo")).alias("size"), "hash")
        above = F.substring("node", 1, digits * up) if up else F.lit("")
        nodes = out[-1].groupBy("shard", above.alias("above")).agg(F.sort_array(F.collect_list(child)).alias("c"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        line = F.array_join(F.transform("c", lambda x: F.concat_ws(":", x["size"].cast("string"), x["hash"])), "\n")
        out.append(stored(nodes.select("shard", F.col("above").alias("node"), F.lit(0).cast("long").alias("nth"), "lo", "hi", F.sha2(line.cast("binary"), 256).alias("hash")), f"merkle-{len(out)}"))
    return out


def audit(ours: list[DataFrame], theirs: list[DataFrame], digits: int = DIGITS) -> DataFrame:
    """shard, node, nth, lo, hi, status of the leaves that differ: changed, missing (of theirs) or extra (in theirs).

    Nodes match if their hashes do; below those that don't, children are compared. A range is ours, or theirs of what is extra.
    """
    if len(ours) != len(theirs):
        raise ValueError("trees of different depths: build the second with the depth of the first")
    bad: DataFrame | None = None
    for level, (a, b) in enumerate(zip(reversed(ours), reversed(theirs), strict=True)):
        if bad is not None:
            known = F.substring("node", 1, digits * (level - 1)) if level > 1 else F.lit("")
            under = bad.select("shard", F.col("node").alias("above")).distinct()
            below = lambda x: x.withColumn("above", known).join(under, ["shard", "above"], "left_semi").drop("above")  # noqa: E731, B023
            a, b = below(a), below(b)  # noqa: PLW2901
        x, y = a.alias("x"), b.alias("y")
        met = x.join(y, (F.col("x.shard") == F.col("y.shard")) & (F.col("x.node") == F.col("y.node")) & (F.col("x.nth") == F.col("y.nth")), "full")
        first = lambda c: F.coalesce(F.col(f"x.{c}"), F.col(f"y.{c}")).alias(c)
        status = F.when(F.col("y.hash").isNull(), "missing").when(F.col("x.hash").isNull(), "extra").otherwise("changed").alias("status")
        bad = stored(met.where(~F.col("x.hash").eqNullSafe(F.col("y.hash"))).select(*map(first, ("shard", "node", "nth", "lo", "hi")), status), "merkle-bad")
    return bad


def damaged(shards: DataFrame) -> DataFrame:
    """A replica with planted damage, for trials: of 97 records one has another byte in its middle, one is all zeros, one is lost."""
    kind = number_of(F.col("key")) % 97
    byte = F.when(F.expr("substring(record, cast(length / 2 as int), 1)") == F.lit(b"\x00"), F.lit(b"\x01")).otherwise(F.lit(b"\x00"))
    flipped = F.concat(F.expr("substring(record, 1, cast(length / 2 as int) - 1)"), byte, F.expr("substring(record, cast(length / 2 as int) + 1)"))
    zeros = F.unhex(F.repeat(F.lit("00"), F.col("length").cast("int")))
    left = shards.where(kind != 3)
    return stored(left.withColumn("record", F.when(kind == 1, flipped).when(kind == 2, zeros).otherwise(F.col("record"))), "warc-replica", compression="zstd")


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archive all pages, keep a replica with planted damage, and return every record with what the audit says of it.

    Null urls and pages are empty ones, rows without an id are known by their content, repeated rows are records of their own.
    """
    shards = archive(table(spark, sf_dir, "pages"))
    ours = tree(shards)
    theirs = tree(damaged(shards), depth=len(ours) - 1)
    bad = audit(ours, theirs).select("shard", "node", "nth", "status")
    leaves = ours[0].select("shard", "node", "nth", F.col("hash").alias("record_sha256"))
    names = shards.select("page_id", "shard", F.col("key").alias("node"), "nth", "ordinal", "offset", "length")
    found = names.join(leaves, ["shard", "node", "nth"]).join(bad, ["shard", "node", "nth"], "left")
    return found.select("page_id", "shard", "ordinal", "offset", "length", "record_sha256", F.coalesce("status", F.lit("intact")).alias("status"))


ORACLE = rf"""
WITH k AS (SELECT page_id, url, html, sha256(coalesce(CAST(page_id AS VARCHAR), 'null:' || sha256(coalesce(url, '') || chr(10) || coalesce(html, '')))) AS key FROM pages),
r AS (
  SELECT page_id, key,
         'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10)
         || 'WARC-Record-ID: <urn:uuid:' || key[1:8] || '-' || key[9:12] || '-' || key[13:16] || '-' || key[17:20] || '-' || key[21:32] || '>' || chr(13) || chr(10)
         || 'WARC-Date: {DATE}' || chr(13) || chr(10) || 'WARC-Target-URI: ' || regexp_replace(coalesce(url, ''), '[
]', ' ', 'g') || chr(13) || chr(10)
         || 'WARC-Payload-Digest: sha256:' || sha256(coalesce(html, '')) || chr(13) || chr(10) || 'Content-Type: text/html; charset=utf-8' || chr(13) || chr(10)
         || 'Content-Length: ' || CAST(strlen(coalesce(html, '')) AS VARCHAR) || chr(13) || chr(10) || chr(13) || chr(10) || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10) AS record
  FROM k),
s AS (SELECT page_id, key, record, CAST('0x' || key[1:8] AS BIGINT) AS number, CAST(strlen(record) AS BIGINT) AS length,
             CAST(greatest(1, (sum(strlen(record)) OVER () + {SHARD_BYTES} - 1) // {SHARD_BYTES}) AS BIGINT) AS shards FROM r),
p AS (SELECT *, number % shards AS shard FROM s)
SELECT page_id, shard, row_number() OVER w - 1 AS ordinal, CAST(sum(length) OVER w AS BIGINT) - length AS "offset", length, sha256(record) AS record_sha256,
       CASE WHEN number % 97 IN (1, 2) THEN 'changed' WHEN number % 97 = 3 THEN 'missing' ELSE 'intact' END AS status
FROM p WINDOW w AS (PARTITION BY shard ORDER BY key, record ROWS UNBOUNDED PRECEDING)
"""
