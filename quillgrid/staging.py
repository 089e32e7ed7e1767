"""Intermediate tables in the folder that the driver and all executors see."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset, a local session gets a folder of its own; a cluster's executors would not see one."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not sc.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="quillgrid-")
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def _drop(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session has ended: its owner clears the shared folder
        pass


def clear() -> None:
    """Remove all intermediate tables written so far: call it once the results that read them are stored or no longer needed."""
    while _written:
        _drop(*_written.pop())


atexit.register(clear)


def free_shuffles(spark: SparkSession) -> None:
    """Have Spark remove the shuffle files that no frame needs any more: it does so as the driver collects its garbage, which
    an idle driver seldom does. Worth its fraction of a second after a table is written that large shuffles led to."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


class scope:
    """`with scope() as s:` removes at its end the intermediate tables that were written within, but for those that `s.keep` wrote."""

    def __enter__(self) -> scope:
        self._before = len(_written)
        self._kept: list[tuple[SparkSession, str]] = []
        return self

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """As `stored`, and stays."""
        out = stored(df, name)
        self._kept.append(_written.pop())
        return out

    def drop(self) -> None:
        """Remove what was kept: once nothing reads it any more."""
        while self._kept:
            one = self._kept.pop()
            if one in _written:
                _written.remove(one)
            _drop(*one)

    def __exit__(self, *_: object) -> None:
        while len(_written) > self._before:
            _drop(*_written.pop())
        _written.extend(self._kept)


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed by `clear` or when the driver's Python ends."""
    path = f"{shared_dir(spark)}/quillgrid-{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def stored(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Cut the lineage: write to the shared folder and read again, so a lost executor costs no recomputation."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, rows: int) -> DataFrame:
    """df in partitions of about so many rows, for what takes long for each: one task reads a small file, however many rows it has."""
    n = df.count()
    return df.repartition(-(-n // rows)) if n > rows else df
