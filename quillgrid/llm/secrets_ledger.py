"""Secret scans over an incremental ledger of content-addressed blobs, in DataFrame operations only.

A blob is a distinct text, addressed by its SHA-256; every path (or historical version of a path) names one blob.
The ledger is a Parquet table of one row per blob and rule version that was scanned, with what was found. A scan
takes the (blob, rule version) pairs that the ledger lacks, scans each blob once, appends them, and joins the
findings back to all paths. Copies, however many, are scanned once, and a rerun scans only what is new.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_path, stored, table, text_of, without

_any_case = lambda word: "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)

#: kind -> (pattern, group that holds the secret, its least length); matches are leftmost and do not overlap.
RULES: dict[str, tuple[str, int, int]] = {
    "assign": ("(" + "|".join(map(_any_case, ("password", "passwd", "secret", "token", "api_?key"))) + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    "access": ("AKIA[A-Z0-9]+", 0, 16),
    "hex": ("[0-9a-f]+", 0, 32),
}
#: Name it anew whenever RULES changes: ledgers tell versions by it.
RULE_VERSION = "base-1"


#: Elements, or characters, that long arrays and texts are cut into, so that work on them stays linear.
PART = 1024


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value computed once."""
    return F.transform(F.array(value), body)[0]


def _running(items: Column, start: Column, step: Callable[[Column, Column], Column], empty: Column) -> Column:
    """array of what `step(state, item)` yields as `out` for each item in order, where it isn't null; its `at` is the next state.

    A fold that appends copies what it has at every step, so it goes over parts of the array, each with a list of its own.
    """
    parts = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.size(items) / PART).cast("int") - 1, F.lit(0))), lambda i: F.slice(items, i * PART + 1, PART))

    def one(acc: Column, x: Column) -> Column:
        return _let(step(acc["at"], x), lambda y: F.struct(y["at"].alias("at"), F.when(y["out"].isNull(), acc["out"]).otherwise(F.concat(acc["out"], F.array(y["out"]))).alias("out")))

    def whole(acc: Column, part: Column) -> Column:
        inner = F.aggregate(part, F.struct(acc["at"].alias("at"), empty.alias("out")), one)
        return _let(inner, lambda y: F.struct(y["at"].alias("at"), F.concat(acc["out"], F.array(y["out"])).alias("out")))

    return F.flatten(F.aggregate(parts, F.struct(start.alias("at"), F.slice(F.array(empty), 1, 0).alias("out")), whole)["out"])


def spans(text: Column, kind: str, order: int, rules: dict[str, tuple[str, int, int]] = RULES) -> Column:
    """array<struct<start, ord, end, kind>> of a kind's findings, in code points.

    A text's pieces between the matches and the matches themselves alternate, so running lengths give positions.
    """
    pattern, group, least = rules[kind]
    whole = group == 0
    if whole:  # a run of one class can be asked for its least length at once: the leftmost match takes a run to its end
        pattern = f"{pattern.removesuffix('+')}{{{least - (4 if kind == 'access' else 0)},}}"
    regex = F.lit(pattern)
    lengths = F.transform(F.regexp_extract_all(text, regex, F.lit(0)), lambda m: F.length(m))
    gaps = F.transform(F.split(text, regex, -1), lambda g: F.length(g))
    sizes = lengths if whole else F.transform(F.regexp_extract_all(text, regex, F.lit(group)), lambda m: F.length(m))
    zipped = F.arrays_zip(gaps.alias("g"), lengths.alias("l"), sizes.alias("n"))
    empty = F.expr("cast(array() as array<struct<start:bigint,ord:int,end:bigint,kind:string>>)")

    def step(at: Column, z: Column) -> Column:
        begin = at + z["g"]
        end = begin + F.coalesce(z["l"], F.lit(0))
        found = F.struct(begin.alias("start"), F.lit(order).alias("ord"), end.alias("end"), F.lit(kind).alias("kind"))
        return F.struct(end.alias("at"), F.when(z["l"].isNotNull() & (z["n"] >= least), found).alias("out"))

    return F.when(text.rlike(pattern), _running(zipped, F.lit(0).cast("bigint"), step, empty)).otherwise(empty)


def scan_blobs(blobs: DataFrame, rules: dict[str, tuple[str, int, int]] = RULES) -> DataFrame:
    """blob, text -> blob, findings: array<struct<start, ord, end, kind>> by start, then kind as listed."""
    each = [spans(F.col("text"), k, i, rules) for i, k in enumerate(rules)]
    return blobs.select("blob", F.array_sort(F.concat(*each)).alias("findings"))


_LEDGER = "blob string, version string, findings array<struct<start:bigint,ord:int,end:bigint,kind:string>>"


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def scan(paths: DataFrame, ledger: str, rules: dict[str, tuple[str, int, int]] = RULES, version: str = RULE_VERSION, blobs_only: bool = False) -> DataFrame:
    """Scan what the ledger at this path lacks and return paths' columns but text, with blob and findings.

    paths has a text column and any others, such as path and version. A null text is the empty blob; an empty table
    leaves the ledger as it is; repeated rows each get the findings. Extra columns are carried; those
    named blob or findings are replaced. blobs_only: return the ledger's blobs and findings of this version, unjoined. A ledger has only whole files: Spark's commit makes an append visible when the job ends.
    """
    spark = paths.sparkSession
    named = without(paths, "blob", "findings").withColumn("text", F.coalesce(F.col("text"), F.lit(""))).withColumn("blob", F.sha2(F.col("text").cast("binary"), 256))
    fresh = not _exists(spark, ledger)
    blobs = named.select("blob", "text").dropDuplicates(["blob"])
    if not fresh:
        known = spark.read.schema(_LEDGER).parquet(ledger).where(F.col("version") == version).select("blob")
        blobs = named.select("blob", "text").join(known, "blob", "left_anti").dropDuplicates(["blob"])
    scan_blobs(blobs, rules).select("blob", F.lit(version).alias("version"), "findings").write.mode("append").parquet(ledger)
    found = spark.read.schema(_LEDGER).parquet(ledger).where(F.col("version") == version).select("blob", "findings")
    return found if blobs_only else named.drop("text").join(found, "blob")


def commit(paths: DataFrame, root: str, rules: dict[str, tuple[str, int, int]] = RULES, rule_version: str = RULE_VERSION) -> int:
    """Record path, version, text (and other columns) in the history at this folder, and scan the blobs that are new to it.

    The history, root/paths, has one row per path and version with its blob; a version that is there already stays as it is, a
    path and version that comes twice with different texts in one call keeps the smaller blob. Returns the number of rows added.
    """
    spark = paths.sparkSession
    named = without(paths, "blob", "findings").withColumn("blob", F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256))
    new = stored(named.groupBy("path", "version").agg(F.min("blob").alias("blob")), "ledger-new")
    where = f"{root}/paths"
    if _exists(spark, where):
        known = spark.read.schema(new.schema).parquet(where).select("path", "version")
        met = (F.col("n.path").eqNullSafe(F.col("k.path"))) & (F.col("n.version").eqNullSafe(F.col("k.version")))
        new = stored(new.alias("n").join(known.alias("k"), met, "left_anti"), "ledger-new")
    scan(named.join(new.select("blob").distinct(), "blob", "left_semi").select("text"), f"{root}/blobs", rules, rule_version, blobs_only=True)
    new.write.mode("append").parquet(where)
    return new.count()


def report(spark: SparkSession, root: str, rule_version: str = RULE_VERSION) -> DataFrame:
    """path, version, blob and findings of every path and version in a history, as a version of the rules found them."""
    found = spark.read.schema(_LEDGER).parquet(f"{root}/blobs").where(F.col("version") == rule_version).select("blob", "findings")
    return spark.read.parquet(f"{root}/paths").join(found, "blob", "left").select("path", "version", "blob", "findings")


def joined(findings: Column) -> Column:
    return F.array_join(F.transform(findings, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def _part(parts: Column, begin: Column, end: Column) -> Column:
    """Characters begin..end of a text that is cut into parts."""
    first, last = (begin / PART).cast("int"), (end / PART).cast("int")
    left, right = (begin % PART).cast("int"), (end % PART).cast("int")
    at = lambda i: F.coalesce(F.try_element_at(parts, i + 1), F.lit(""))
    across = F.concat(F.substring(at(first), left + 1, F.lit(PART)), F.array_join(F.slice(parts, first + 2, F.greatest(last - first - 1, F.lit(0))), ""), F.substring(at(last), F.lit(1), right))
    return F.when(first == last, F.substring(at(first), left + 1, right - left)).otherwise(across)


def redacted(text: Column, findings: Column, mark: str = "[SECRET]") -> Column:
    """The text with every finding replaced; findings that overlap an earlier one are covered by extending it."""
    empty = F.expr("cast(array() as array<struct<begin:bigint,end:bigint>>)")

    def step(at: Column, x: Column) -> Column:
        gap = F.struct(at.alias("begin"), x["start"].alias("end"))
        return F.struct(F.greatest(at, x["end"]).alias("at"), F.when(x["start"] >= at, gap).alias("out"))

    def cut(parts: Column) -> Column:
        gaps = _running(findings, F.lit(0).cast("bigint"), step, empty)
        head = F.array_join(F.transform(gaps, lambda g: F.concat(_part(parts, g["begin"], g["end"]), F.lit(mark))), "")
        return F.concat(head, _part(parts, F.array_max(F.transform(findings, lambda x: x["end"])), F.length(text).cast("bigint")))

    return F.when(F.size(findings) > 0, _let(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PART}}}"), F.lit(0)), cut)).otherwise(text)


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of documents with its secrets, from a ledger that begins empty; a null text has none, repeated rows have theirs each."""
    found = scan(text_of(table(spark, sf_dir, "documents")), shared_path(spark, "ledger"))
    count = lambda kind: F.size(F.filter("findings", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    listed = joined(F.col("findings"))
    return found.select("doc_id", *map(count, RULES), F.sha2(listed.cast("binary"), 256).alias("base_sha256"), listed.alias("spans"))


def _oracle() -> str:
    parts = []
    for i, (kind, (pattern, group, least)) in enumerate(RULES.items()):
        p = pattern.replace("'", "''")
        parts.append(f"""
  SELECT doc_id, {i} AS ord, '{kind}' AS kind, sum(length(g) + coalesce(length(m), 0)) OVER (PARTITION BY doc_id ORDER BY n) - coalesce(length(m), 0) AS s,
         coalesce(length(m), 0) AS len, coalesce(length(x), 0) >= {least} AS keep
  FROM (SELECT doc_id, unnest(string_split_regex(text, '{p}')) AS g, unnest(list_concat(regexp_extract_all(text, '{p}', 0), [NULL])) AS m,
               unnest(list_concat(regexp_extract_all(text, '{p}', {group}), [NULL])) AS x, unnest(range(len(regexp_extract_all(text, '{p}', 0)) + 1)) AS n FROM t)""")
    return f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
f AS ({' UNION ALL '.join(parts)}),
k AS (SELECT doc_id, CAST(count(*) FILTER (kind = 'assign') AS BIGINT) AS n_assign, CAST(count(*) FILTER (kind = 'access') AS BIGINT) AS n_access,
             CAST(count(*) FILTER (kind = 'hex') AS BIGINT) AS n_hex,
             string_agg(kind || ':' || CAST(CAST(s AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(s + len AS BIGINT) AS VARCHAR), ',' ORDER BY s, ord) AS spans
      FROM f WHERE keep GROUP BY doc_id)
SELECT t.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM t LEFT JOIN k ON t.doc_id = k.doc_id"""


ORACLE = _oracle()
