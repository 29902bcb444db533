"""From records to the columns of the command line's output."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.records import format_bool, format_list, format_multiple, format_score
from ..operators.lookup import lookup
from .extractor import RECORD, Extractor

FIELDS = tuple("pred_is_union pred_aff pred_unknown pred_desig pred_union_score pred_fnum pred_fnum_multiple".split())


def predict(df: DataFrame, extractor: Extractor, table: DataFrame | None, text_col: str) -> DataFrame:
    """``df`` with the seven text columns ``FIELDS``; input columns of these names are replaced."""
    out = extractor.transform(df, text_col, prefix="_x_")
    if table is None:
        out = out.withColumn("_x_fnums", F.array().cast("array<bigint>"))
    else:
        out = lookup(out, table, "_x_affiliation", "_x_designation", "_x_fnums")
    cells = {
        "pred_is_union": format_bool("_x_is_union"),
        "pred_aff": F.coalesce("_x_affiliation", F.lit("")),
        "pred_unknown": format_bool("_x_affiliation_unrecognized"),
        "pred_desig": F.coalesce("_x_designation", F.lit("")),
        "pred_union_score": format_score("_x_union_score"),
        "pred_fnum": format_list("_x_fnums"),
        "pred_fnum_multiple": format_multiple("_x_fnums"),
    }
    kept = [F.col(f"`{c}`") for c in df.columns if c not in cells]
    return out.select(*kept, *(cell.alias(name) for name, cell in cells.items()))


__all__ = ["FIELDS", "RECORD", "predict"]
