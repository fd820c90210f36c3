"""Strict delimited text: a column loads whole or not at all."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..catalog import RID, numbered
from ..model import Kind, QueryError, Status

# What a field of each kind may look like; doubles may have leading blanks, signs, exponents, hex, inf, nan.
SHAPES = {
    Kind.U32: r"^[0-9]+$",
    Kind.I64: r"^-?[0-9]+$",
    Kind.F64: r"^\s*[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|[iI][nN][fF]([iI][nN][iI][tT][yY])?|[nN][aA][nN])$",
}


def read_columns(spark: SparkSession, path: str, columns: dict[str, tuple[int, Kind]], header: bool = False, delimiter: str = ",") -> DataFrame:
    """One frame with a row number and the named columns (position, kind) of a delimited file, in one pass.

    Quotes are text, extra fields are allowed, CRLF ends count as line ends. UNSUPPORTED_TYPE if any line is too short
    or any field is not of its kind: one aggregate counts the bad rows before anything is returned.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select(F.regexp_replace("value", r"\r$", "").alias("line"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"))
    # ids grow along the file, and a file's splits are in order: ranks by a range sort give row numbers
    rows = numbered(lines.orderBy("file", "block", "id").select("line"))
    if header:
        rows = rows.where(F.col(RID) > 0).withColumn(RID, F.col(RID) - 1)
    fields = F.split("line", re.escape(delimiter), -1)
    out, bad = [F.col(RID)], F.lit(False)
    for name, (at, kind) in columns.items():
        field = F.get(fields, F.lit(at))
        if kind is Kind.STR:
            value, wrong = field, field.isNull()
        else:
            shown = F.ltrim(field) if kind is Kind.F64 else field
            value = shown.try_cast(kind.spark)
            wrong = field.isNull() | ~field.rlike(SHAPES[kind]) | value.isNull()
            if kind is Kind.U32:
                wrong |= value > 2**32 - 1
            if kind is Kind.F64:
                wrong |= value.isin(float("inf"), float("-inf")) & ~F.lower(shown).rlike("inf")
        out.append(value.alias(name))
        bad |= F.coalesce(wrong, F.lit(True))
    if rows.select(F.count_if(bad)).first()[0]:
        raise QueryError(Status.UNSUPPORTED_TYPE, f"{path} has a field that does not fit")
    return rows.select(*out)
