"""Extraction from a stream: the batch plan as a stateless projection, rows appended as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..plans.extractor import Extractor


def read_text_stream(spark: SparkSession, path: str, files_at_once: int | None = None) -> DataFrame:
    """Lines of files that appear in a folder, as ``text``."""
    reader = spark.readStream
    if files_at_once:
        reader = reader.option("maxFilesPerTrigger", files_at_once)
    return reader.text(path).withColumnRenamed("value", "text")


def read_table_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    """Rows of Parquet files that appear in a folder; a single file is read as the only one of its folder."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    reader = spark.readStream.schema(schema)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isFile():
        return reader.option("pathGlobFilter", at.getName()).parquet(str(at.getParent()))
    return reader.parquet(path)


def extract_stream(stream: DataFrame, extractor: Extractor, text_col: str, out_path: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Starts the query that appends records as Parquet; files and offsets are committed together, so a restart repeats none.

    ``once`` stops it when what is there now has been read.
    """
    writer = extractor.transform(stream, text_col).writeStream.outputMode("append").format("parquet").option("checkpointLocation", checkpoint)
    if once:
        writer = writer.trigger(availableNow=True)
    return writer.start(out_path)
