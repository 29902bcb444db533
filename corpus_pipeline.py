"""A corpus pipeline of five operators, each stage working on all that its predecessor kept.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir), and its result is written as
Parquet and read again as the next stage's docs. All but the last return the columns of ``documents``.

Defined results of every stage: an empty table gives an empty one; columns beyond those of ``documents``, whatever their
names, are neither read nor returned; texts of any length are read whole; lang, source and n_chars may be null and
are never read. What null ids and texts, ties and repeated rows give is said at each stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm import jaccard_join, line_dedup, packing, pii, quality
from tallyloom.llm._shared import drop_written, shared_dir, table, tables_until_here, written
from tallyloom.llm.queries import DEMO_KEY, vocabulary

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _as_documents(docs: DataFrame) -> DataFrame:
    """The columns of ``documents``, the length that of the text as it is now."""
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it learns from labels of documents that aren't held out.

    A null text is scored as an empty one and stays null if it is kept. A score at the threshold is kept. Each of several rows
    with one id is scored; a row without id is scored and teaches nothing.
    """
    docs = docs.select(*COLUMNS)
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model, out_col="score").where(F.col("score") >= quality.CUT).select(*COLUMNS)


def cut_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without repeated passages of lines; a document of which nothing is left, a copy to its last line, goes.

    A null text becomes an empty one and stays. The first occurrence, by id (null first), then text hash and place, stays. Rows with
    equal id and text are one document: none of them counts as the other's repetition, and they are cut alike.
    """
    cut = line_dedup.dedup_passages(docs.select(*COLUMNS))
    return _as_documents(cut.where((F.col("n_removed") == 0) | (F.translate("text", "\n ", "") != "")))


def keep_one(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: that of the least id, null being least, then of the first row in the table.

    So of rows with one id and copied texts one stays, and one whose text is another stays too. Rows without a word (null and
    empty texts among them) are in no group and stay all.
    """
    rows, path = written(docs.select(F.struct("doc_id", F.monotonically_increasing_id().alias("row")).alias("key"), *COLUMNS), "rows")
    found = jaccard_join.near_copies(rows, id_col="key")
    stay = found.where(F.col("id") == F.col("class_id")).select(F.col("id").alias("kept"))
    return rows.join(stay.hint("merge"), F.col("key.row") == F.col("kept.row"), "left_semi").select(*COLUMNS)


def hide_personal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with pseudonyms for personal data; null texts stay null, repeated rows are changed alike."""
    return _as_documents(pii.pseudonymise(docs.select(*COLUMNS), DEMO_KEY))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences with the checksums of their token ids.

    Every row is packed, repeated ones too; a null or empty text is the end-of-document id alone.
    """
    pieces = packing.pack(docs, vocabulary("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("quality", keep_good),
    ("lines", cut_lines),
    ("near copies", keep_one),
    ("personal data", hide_personal),
    ("packing", pack),
]

#: Neither a fitted classifier nor keyed pseudonyms nor tokenizers can be expressed in SQL; see tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``, each result written to the shared folder and read again."""
    docs, before = table(spark, sf_dir, "documents"), None
    for k, (name, stage) in enumerate(STAGES[:-1]):
        path = f"{shared_dir(spark)}/stage-{k}-{uuid.uuid4().hex}"
        with tables_until_here(spark):  # a stage's own tables go as soon as its result lies there
            stage(spark, docs, sf_dir).write.option("compression", "zstd").parquet(path)
        docs = spark.read.parquet(path)
        if before is not None:
            drop_written(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
