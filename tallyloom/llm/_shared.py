"""Helpers that the operators of this subpackage share: table access and lineage cuts."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Paths of the tables made inside each ``tables_until_here`` that is open.
_OPEN: list[list[str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` (a file or a folder) below ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as ``spark.checkpoint.dir`` names it.

    Only where a session on one machine (tests, a laptop) names none, a folder of that machine is set; on a cluster that is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.getCheckpointDir():
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that the executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tallyloom-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def written(df: DataFrame, what: str) -> tuple[DataFrame, str]:
    """``df`` written as a parquet table to the shared folder and read again, and its path.

    The lineage ends there, so a lost executor costs no recomputation of what led to the table.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    for paths in _OPEN:
        paths.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


@contextlib.contextmanager
def tables_until_here(spark: SparkSession) -> Iterator[None]:
    """Removes all tables of ``written`` that are made inside, at the end.

    Results are read from such tables, so the caller saves what it needs before it leaves; as in

        with tables_until_here(spark):
            operator(docs).write.parquet(path)
    """
    paths: list[str] = []
    _OPEN.append(paths)
    try:
        yield
    finally:
        _OPEN.remove(paths)
        drop_written(spark, *paths)


def drop_written(spark: SparkSession, *paths: str) -> None:
    """Removes tables of ``written`` that nothing will read again."""
    jvm = spark._jvm
    for path in paths:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def with_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only id and text, under fixed names, null texts as empty ones."""
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


