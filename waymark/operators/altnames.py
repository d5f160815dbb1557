"""Alternate names: filters, the preferred pick, postcodes, languages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Languages that are no names; the one that marks postcodes.
NO_NAMES = ("link", "wkdt", "fr_1793")
POSTCODE = "post"


def usable(rows: DataFrame) -> DataFrame:
    return rows.where(~F.col("lang").isin(*NO_NAMES)).where("not (colloquial = 1 or historic = 1)")


def name_class(preferred: Column, short: Column) -> Column:
    """0 preferred and short, 1 preferred, 2 short, 3 neither."""
    return F.when((preferred != 0) & (short != 0), 0).when(preferred != 0, 1).when(short != 0, 2).otherwise(3)


def preferred_names(rows: DataFrame) -> DataFrame:
    """(place_id, lang, name): best class wins, then the first row in the file.

    A minimum by (class, line) aggregates on the map side: no group is gathered or sorted.
    """
    own = usable(rows).where(F.col("lang") != POSTCODE)
    return own.groupBy("place_id", "lang").agg(F.min_by("name", F.struct(name_class(F.col("preferred"), F.col("short")), F.col("line"))).alias("name"))


def postcodes(rows: DataFrame) -> DataFrame:
    """(place_id, postcodes) in file order, repeats kept."""
    own = usable(rows).where(F.col("lang") == POSTCODE)
    return own.groupBy("place_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("line", "name"))), lambda x: x["name"]).alias("postcodes"))


def name_maps(names: DataFrame) -> DataFrame:
    """(place_id, alternative_names): one map a place, of as many names as there are languages at most."""
    return names.groupBy("place_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("lang", "name")))).alias("alternative_names"))


def dictionary(rows: DataFrame, value: str, order: str) -> DataFrame:
    """(value, code): codes 0, 1, ... in order of first appearance."""
    first = rows.groupBy(value).agg(F.min(order).alias("first"))
    return first.select(value, (F.row_number().over(Window.orderBy("first")) - 1).cast("bigint").alias("code"))


def languages(rows: DataFrame) -> DataFrame:
    return dictionary(usable(rows).where(F.col("lang") != POSTCODE), "lang", "line")
