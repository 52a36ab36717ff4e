"""Helpers that several operators of this folder share."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used where one machine's session names no shared folder, as in tests.
LOCAL_SHARED = "/tmp/checkpoints"

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or what ``setCheckpointDir`` was given.

    On a cluster one of them has to be set, as a folder of each machine's own would lose rows.
    """
    context = spark.sparkContext
    set_ = context._jsc.sc().getCheckpointDir()
    named = spark.conf.get("spark.checkpoint.dir", None) or (set_.get() if set_.isDefined() else None)
    if not named and not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return (named or LOCAL_SHARED).rstrip("/")


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it again.

    This cuts the lineage: what follows no longer depends on shuffle files of executors that may
    be lost, and a costly step runs once.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/sabaki/{tag}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    _written.append((spark, path))
    return spark.read.schema(schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def written() -> int:
    """The number of tables written so far, to be given to ``discard``."""
    return len(_written)


def discard(since: int, keep: int = 0) -> None:
    """Delete the tables written after ``since`` but the last ``keep``; nothing may read them any more."""
    gone = _written[since : len(_written) - keep]
    del _written[since : len(_written) - keep]
    for spark, path in gone:
        _delete(spark, path)


def drop_materialised() -> None:
    """Delete the tables that this process has written to the shared folder."""
    while _written:
        try:
            _delete(*_written.pop())
        except Exception:  # the session has ended
            continue


atexit.register(drop_materialised)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def renamed(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``df`` under names that no operator adds, and the new name of each old one in lower case."""
    names = [f"in_{i}" for i in range(len(df.columns))]
    return df.toDF(*names), {c.lower(): n for c, n in zip(df.columns, names, strict=True)}
