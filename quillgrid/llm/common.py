"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..staging import shared_dir, shared_path, stored  # noqa: F401

#: The word of every contract: maximal runs of bytes other than these.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(docs: DataFrame) -> DataFrame:
    """doc_id and text of every row, a null text as the empty one."""
    return docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))


def fresh(docs: DataFrame, *names: str) -> list[str]:
    """Names like these that no column of docs has, so that working columns never clash with a caller's."""
    taken = {c.lower() for c in docs.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"  # noqa: PLW2901
        taken.add(name.lower())
        out.append(name)
    return out


def without(docs: DataFrame, *names: str) -> DataFrame:
    """docs less its columns of these names, which an operator gives anew."""
    return docs.drop(*[c for c in docs.columns if c.lower() in names])


def row_hashes(docs: DataFrame) -> list[Column]:
    """Two 64-bit hashes of a whole row, nulls included: rows that agree in both are alike in every column."""
    cells = [c for name in docs.columns for c in (F.col(f"`{name}`").isNull(), F.col(f"`{name}`"))]
    return [F.xxhash64(F.lit(i), *cells) for i in (1, 2)]
