"""A training corpus in five stages: quality, near duplicates, secrets, source mix, tokens."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgrid.llm import bpe_trie, dartminhash, mixing, quality_gbt, secrets_ledger
from quillgrid.llm.common import fresh, row_hashes, shared_path, table
from quillgrid.staging import scope


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. A null text is scored as the empty one; ids may be null or repeat."""
    (score,) = fresh(docs, "score")
    scored = quality_gbt.classify(docs, table(spark, sf_dir, "labels"), keep_text=True, to=score)
    return scored.where(F.col(score) >= quality_gbt.THRESHOLD).select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays, once: that with the smallest id, a null id being the last.

    Classes go by text: documents without an id take part, and two texts of one id are two documents. Where ids are
    equal, the hash of the words and then that of the row decide. Rows with neither id nor text have nothing to compare
    and stay.
    """
    r1, r2 = fresh(docs, "r1", "r2")
    rows = docs.withColumns(dict(zip((r1, r2), row_hashes(docs), strict=True)))
    blank = F.col("doc_id").isNull() & F.col("text").isNull()
    told = rows.where(~blank).select("doc_id", "text", F.col(r1).alias("r1"), F.col(r2).alias("r2"))
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "c1", "c2", "r1", "r2")).alias("first")
    stay = dartminhash.grouped(told).groupBy("group").agg(first).select(F.col("first.r1").alias(r1), F.col("first.r2").alias(r2))
    kept = rows.where(~blank).join(stay, [r1, r2], "left_semi").dropDuplicates([r1, r2])
    return kept.select(docs.columns).unionByName(docs.where(blank))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; all documents stay, with n_chars of the new text. Null texts stay null."""
    blob, findings = fresh(docs, "blob", "findings")
    found = secrets_ledger.scan(docs.select("text"), shared_path(spark, "ledger"), blobs_only=True).where(F.size("findings") > 0)
    both = docs.withColumn(blob, F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)).join(found.withColumnsRenamed({"blob": blob, "findings": findings}), blob, "left")
    cut = F.when(F.col(findings).isNull(), F.col("text")).otherwise(secrets_ledger.redacted(F.col("text"), F.col(findings)))
    size = F.when(F.col(findings).isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType))
    return both.withColumn("text", cut).withColumn("n_chars", size).select(docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, once or twice.

    Rows that are alike in every column come as often as the mix takes them together; ids may be null or repeat.
    """
    r1, r2, copies = fresh(docs, "r1", "r2", "copies")
    rows = docs.withColumns(dict(zip((r1, r2), row_hashes(docs), strict=True)))
    mixed = mixing.mix(rows.select("doc_id", "source", "text", F.col(r1).alias("r1"), F.col(r2).alias("r2")), also=("r1", "r2")).where(F.col("copies") > 0)
    taken = mixed.groupBy(F.col("r1").alias(r1), F.col("r2").alias(r2)).agg(F.sum("copies").cast("int").alias(copies))
    both = rows.dropDuplicates([r1, r2]).join(taken, [r1, r2])
    return both.withColumn(copies, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens and ids of every row, and decoded_sha256 of what these ids decode to; a null text has no ids."""
    return bpe_trie.encode_checked(docs.select("doc_id", "source", "text"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality),
    ("MinHash near-dedup", near_dedup),
    ("secret scans", secrets),
    ("mixing sources to target weights", mix),
    ("BPE encoding and decoding", tokens),
]

#: Neither the classifier nor the near duplicates can be put in SQL; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages, each written and read again; a stage's own intermediate tables, and its input, go once it is written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for i, (_, stage) in enumerate(STAGES[:-1]):
        with scope() as mine:
            docs = mine.keep(stage(spark, docs, sf_dir), f"stage-{i}")
        if before is not None:
            before.drop()
        before = mine
    return STAGES[-1][1](spark, docs, sf_dir)
