"""Tab-separated dumps: no header, no quoting, lines end with a line feed only.

Rows keep `line`, a struct that orders them as the file does, for the operators in which the
first or last row of a file wins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark import schema
from waymark.functions.numbers import to_float, to_int8, to_int16, to_int32, to_uint32


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, value) of the non-empty lines; a carriage return is part of its line."""
    text = spark.read.option("lineSep", "\n").text(path).withColumn("line", F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row")))
    return text.where("value <> ''").select("line", "value")


def fields(df: DataFrame, columns: list[str], value: str = "value") -> DataFrame:
    """One string column a field; a row with fewer tabs has nulls at its end."""
    parts = F.split(F.col(value), "\t", -1)
    return df.select(*[c for c in df.columns if c != value], *[F.get(parts, i).alias(c) for i, c in enumerate(columns)])


def places(rows: DataFrame, signed_elevation: bool = False) -> tuple[DataFrame, DataFrame]:
    """(typed, rejected): short rows and those without coordinates are set apart."""
    ok = F.coalesce(F.col("timezone").isNotNull() & F.col("latitude").try_cast("float").isNotNull() & F.col("longitude").try_cast("float").isNotNull(), F.lit(False))
    height = F.when(F.col("elevation") != "", to_int16(F.col("elevation"), signed_elevation)).otherwise(to_int16(F.col("dem"), signed_elevation))
    typed = rows.where(ok).select("line", to_int32(F.col("id")).alias("id"), "name", F.col("latitude").cast("float").alias("latitude"), F.col("longitude").cast("float").alias("longitude"), "feature_code", "country_iso2", "cc2", "admin1", "admin2", "admin3", "admin4", to_uint32(F.col("population")).alias("population"), height.cast("float").alias("elevation"), "timezone")
    return typed, rows.where(~ok)


def alt_names(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    ok = F.col("valid_from").isNotNull()
    flags = [to_int8(F.col(c)).alias(c) for c in ("preferred", "short", "colloquial", "historic")]
    return rows.where(ok).select("line", to_int32(F.col("place_id")).alias("place_id"), "lang", "name", *flags), rows.where(~ok)


def read_places(spark: SparkSession, path: str, **options) -> DataFrame:
    return places(fields(lines(spark, path), schema.PLACE_COLUMNS), **options)[0]


def read_alt_names(spark: SparkSession, path: str) -> DataFrame:
    return alt_names(fields(lines(spark, path), schema.ALT_NAME_COLUMNS))[0]


def read_postcode_dump(spark: SparkSession, path: str) -> DataFrame:
    """The separate postal-code dump, typed; nothing else reads it yet."""
    rows = fields(lines(spark, path), schema.POSTCODE_COLUMNS)
    return rows.withColumns({"latitude": to_float(F.col("latitude")), "longitude": to_float(F.col("longitude")), "accuracy": to_int32(F.col("accuracy"))}).drop("line")
