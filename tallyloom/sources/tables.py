"""Reading names and registries: CSV with a header, plain lines, SQLite, JSON; and writing results."""

from __future__ import annotations

import csv
import sqlite3
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROW = "_row_id"


class InputError(ValueError):
    """The input can't be read as asked."""


def work_dir(spark: SparkSession, what: str) -> str:
    """A new path for ``what`` in the folder that all executors share, as ``spark.checkpoint.dir`` names it.

    A folder of this machine serves only a local master; elsewhere an unset folder is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise InputError("spark.checkpoint.dir names no folder that the executors share")
        base = tempfile.mkdtemp(prefix="tallyloom-")
    return f"{base.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """One row (``_row_id``, text) for each line as it is, blank ones too."""
    return spark.read.text(path).select(F.monotonically_increasing_id().alias(ROW), F.col("value").alias("text"))


def header_of(first_line: str) -> list[str]:
    """Column names of the first line; an error without any."""
    names = next(csv.reader([first_line.rstrip("\r\n")]), [])
    if not names:
        raise InputError("Empty CSV or no header row")
    return names


def text_column(names: list[str], wanted: str | None) -> str:
    """The column that holds the names: the only one, or the one asked for."""
    if len(names) == 1:
        return names[0]
    if wanted is None:
        raise InputError(f"the file has multiple columns: {', '.join(names)}; name the one with the texts by -c")
    if wanted not in names:
        raise InputError(f"Column {wanted!r} not found among {', '.join(names)}")
    return wanted


def read_csv(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """``_row_id`` and all columns as strings, quoted as RFC 4180 has it; empty and missing cells are empty strings.

    Cells may hold line feeds, so a file is one task's; files without such cells are split between tasks with ``multi_line`` false.
    """
    first = spark.read.text(path).head()
    names = header_of(first["value"] if first else "")
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    rows = spark.read.csv(path, schema=schema, header=True, quote='"', escape='"', multiLine=multi_line, enforceSchema=True)
    return rows.na.fill("").select(F.monotonically_increasing_id().alias(ROW), *(F.col(f"`{n}`") for n in names))


def write_csv(df: DataFrame, path: str, single_file: bool = True) -> None:
    """A CSV folder in the order of ``_row_id``, with header, empty cells for nulls."""
    out = df.sort(ROW).drop(ROW) if ROW in df.columns else df
    (out.coalesce(1) if single_file else out).write.mode("overwrite").csv(path, header=True, quote='"', escape='"', emptyValue="", nullValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def read_registry_sqlite(spark: SparkSession, path: str, table: str = "lm_data", batch: int = 100_000) -> DataFrame:
    """(aff_abbr string, desig_num string, f_num bigint), distinct, of a local SQLite file.

    The file lives on the driver; rows are fetched in batches and become partitions. For a database that the cluster
    reaches, ``spark.read.jdbc`` gives a frame of the same columns.
    """
    schema = "aff_abbr string, desig_num string, f_num bigint"
    if not table.isidentifier():
        raise InputError(f"{table!r} is no table name")
    out = spark.createDataFrame([], schema)
    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as db:
        rows = db.execute(f"SELECT DISTINCT aff_abbr, CAST(desig_num AS TEXT), f_num FROM {table} WHERE aff_abbr <> '' AND desig_num IS NOT NULL AND f_num IS NOT NULL")
        while part := rows.fetchmany(batch):
            out = out.unionByName(spark.createDataFrame(part, schema))
    return out


def write_lookup(table: DataFrame, path: str, form: str = "parquet") -> None:
    """The lookup as Parquet or JSON lines."""
    table.write.mode("overwrite").format(form).save(path)


def read_lookup(spark: SparkSession, path: str, form: str = "parquet") -> DataFrame:
    return spark.read.format(form).schema("aff string, desig string, fnums array<bigint>").load(path)


def read_labelled(spark: SparkSession, path: str) -> DataFrame:
    """(text, aff_abbr, desig_num) as strings: numbers keep their zeros, and a float's ``.0`` goes."""
    rows = spark.read.csv(path, header=True, quote='"', escape='"', multiLine=True, inferSchema=False)
    return rows.withColumn("desig_num", F.regexp_replace("desig_num", r"\.0$", ""))


def write_errors(errors: DataFrame, path: str) -> bool:
    """Writes the error report as CSV if there is any error; tells whether it did."""
    if errors.isEmpty():
        return False
    write_csv(errors, path, single_file=False)
    return True


def write_split(split: DataFrame, path: str) -> None:
    """Writes labelled rows with their ``split`` to a new place: Spark can't overwrite the files that it reads."""
    split.write.mode("errorifexists").partitionBy("split").parquet(path)


def read_split(spark: SparkSession, path: str, split: str) -> DataFrame:
    """The rows of one split; only its folder is read."""
    return spark.read.parquet(path).where(F.col("split") == split)
