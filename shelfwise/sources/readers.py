"""Reading stock files: CSV, JSON and folders of either, batch or streaming."""

from __future__ import annotations

from decimal import Decimal

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from shelfwise.operators.positions import with_defaults

# Texts that stand for a missing field.
NULL_MARKERS = ("NULL", "null", "", "N/A", "NA")
CSV_OPTIONS = {
    "sep": ",",
    "header": True,
    "enforceSchema": True,  # columns by position; the header line is only skipped
    "quote": '"',
    "escape": '"',
    "ignoreLeadingWhiteSpace": True,
    "ignoreTrailingWhiteSpace": True,
    "mode": "PERMISSIVE",  # short rows are padded with NULL, long ones cut
}


def _known(name: str) -> Column:
    """A field's text, NULL for the markers of a missing field."""
    text = F.col(name)
    return F.when(~text.isin(*NULL_MARKERS), text)


def _unfit(field: T.StructField) -> Column:
    """True if a field has a text that its type cannot hold."""
    known = _known(field.name)
    return known.isNotNull() & known.try_cast(field.dataType).isNull()


def _texts(
    spark: SparkSession, path: str | list[str], schema: T.StructType, multi_line: bool
) -> DataFrame:
    text = T.StructType([T.StructField(field.name, T.StringType()) for field in schema])
    options = CSV_OPTIONS | {"multiLine": multi_line}
    return spark.read.options(**options).schema(text).csv(path)


def read_stock_csv(
    spark: SparkSession,
    path: str | list[str],
    schema: T.StructType,
    defaults: dict[str, object] | None = None,
    bad_values: str = "raise",
    multi_line: bool = False,
) -> DataFrame:
    """CSV files, a folder or a glob, as the declared schema.

    Fields arrive as text first because five different markers mean NULL. A text that
    does not fit its type stops the load, as long as ``bad_values`` is ``"raise"``;
    ``"skip"`` leaves its row out, which ``rejected_rows`` then returns, and ``"null"``
    loads NULL. ``defaults`` fill the columns that the files do not have; a column that a
    file has may be NULL. ``multi_line`` admits line breaks in quoted fields, at one task
    a file.
    """
    if bad_values not in ("raise", "skip", "null"):
        raise ValueError("bad_values must be raise, skip or null")
    raw = _texts(spark, path, schema, multi_line)
    columns = []
    for field in schema:
        value = _known(field.name).try_cast(field.dataType)
        if bad_values == "raise":
            message = F.concat(F.lit(f"bad value in {field.name}: "), F.col(field.name))
            value = F.when(_unfit(field), F.raise_error(message)).otherwise(value)
        columns.append(value.alias(field.name))
    if bad_values == "skip":
        raw = raw.filter(~_any_unfit(schema))
    typed = raw.select(*columns)
    if not defaults:
        return typed
    header = spark.read.options(sep=CSV_OPTIONS["sep"], quote='"', escape='"', header=True).csv(path)
    absent = {field.name for field in schema.fields[len(header.columns) :]}
    return with_defaults(typed, {k: v for k, v in defaults.items() if k in absent})


def _any_unfit(schema: T.StructType) -> Column:
    bad = F.lit(False)
    for field in schema:
        bad |= _unfit(field)
    return bad


def rejected_rows(
    spark: SparkSession, path: str | list[str], schema: T.StructType, multi_line: bool = False
) -> DataFrame:
    """The rows with a text that its type cannot hold: all fields as text and their names."""
    raw = _texts(spark, path, schema, multi_line)
    names = F.array_compact(F.array(*[F.when(_unfit(f), F.lit(f.name)) for f in schema]))
    return raw.withColumn("bad_fields", names).filter(F.size("bad_fields") > 0)


def read_json(
    spark: SparkSession,
    path: str | list[str],
    schema: T.StructType,
    multi_line: bool = True,
) -> DataFrame:
    """JSON files whose outer array (if any) is unpacked into rows, at one task a file.

    Without ``multi_line`` the files hold one object, or one array of objects, a line and are
    split among tasks.
    """
    return spark.read.schema(schema).option("multiLine", multi_line).json(path)


def read_folder(
    spark: SparkSession, path: str, schema: T.StructType, file_format: str = "parquet",
    glob: str = "*",
) -> DataFrame:
    """All files of a staging folder."""
    return (
        spark.read.format(file_format)
        .schema(schema)
        .option("pathGlobFilter", glob)
        .option("recursiveFileLookup", True)
        .load(path)
    )


def stream_folder(
    spark: SparkSession,
    path: str,
    schema: T.StructType | str,
    file_format: str = "parquet",
    glob: str = "*",
    files_per_batch: int | None = None,
) -> DataFrame:
    """New files of an append-only folder as a stream."""
    reader = (
        spark.readStream.format(file_format).schema(schema).option("pathGlobFilter", glob)
    )
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)


def literal_rows(spark: SparkSession, rows: list[dict], schema: T.StructType) -> DataFrame:
    """INSERT ... VALUES: a few rows by column name; columns left out are NULL.

    The rows become part of the plan, so Spark knows how small they are and needs no
    exchange of the table that they meet.
    """

    def value(row: dict, field: T.StructField):
        given = row.get(field.name)
        if given is not None and isinstance(field.dataType, T.DecimalType):
            return Decimal(str(given))
        return given

    columns = [[value(row, field) for row in rows] for field in schema]
    kinds = to_arrow_schema(schema)
    arrays = [pa.array(column, kind.type) for column, kind in zip(columns, kinds)]
    return spark.createDataFrame(pa.Table.from_arrays(arrays, schema=kinds), schema)
