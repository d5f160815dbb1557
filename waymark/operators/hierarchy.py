"""A place's country and four administrative parents, by last-write-wins dimensions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.session import materialise, small

#: Rows of the dimensions that are broadcast at most.
BROADCAST_ROWS = 1_000_000


def last_write_wins(rows: DataFrame, key: list[str], value: str, order: str) -> DataFrame:
    """One row a key, with the value of the row that is last in order."""
    return rows.groupBy(*key).agg(F.max_by(value, order).alias(value))


def span_key(level: int) -> list[str]:
    """A parent's key: all fields from the country to its own code, cc2 among them."""
    return ["country_iso2", "cc2", *[f"admin{k}" for k in range(1, level + 1)]]


def span_text(*columns: Column) -> Column:
    """The fields as the file has them, tabs between."""
    return F.concat_ws("\t", *[F.coalesce(c, F.lit("")) for c in columns])


def dimensions(places: DataFrame, with_cc2: bool = True) -> DataFrame:
    """(level, span, parent): the place of each administrative key, level 0 being countries; the file's last wins."""
    rows = None
    for level in range(5):
        key = ["country_iso2"] if level == 0 else [c for c in span_key(level) if with_cc2 or c != "cc2"]
        own = places.where(F.col("feature_code") == ("PCLI" if level == 0 else f"ADM{level}"))
        own = own.select(F.lit(level).alias("level"), span_text(*map(F.col, key)).alias("span"), F.col("id").alias("parent"), "line")
        rows = own if rows is None else rows.unionByName(own)
    return last_write_wins(rows, ["level", "span"], "parent", "line")


def with_parents(places: DataFrame, with_cc2: bool = True) -> DataFrame:
    """places with country_id and admin1_id ... admin4_id, 0 where there is none.

    with_cc2=False joins without the cc2 field, so that places of two countries find their parents.
    All dimensions are one small aggregate, made once; if its counted rows allow, the five joins
    are broadcast and the places are not shuffled at all, else each join shuffles by its key, and
    AQE splits the keys of large countries.
    """
    dims = materialise(dimensions(places, with_cc2))
    rows, out = dims.count(), places
    for level, name in enumerate(("country", "admin1", "admin2", "admin3", "admin4")):
        key = ["country_iso2"] if level == 0 else [c for c in span_key(level) if with_cc2 or c != "cc2"]
        dim = dims.where(F.col("level") == level).select(F.col("span").alias("_span"), F.col("parent").alias(f"{name}_id"))
        out = out.withColumn("_key", span_text(*map(F.col, key)))
        out = out.join(small(dim, rows, BROADCAST_ROWS), F.col("_key") == F.col("_span"), "left").drop("_key", "_span")
    return out.withColumns({f"{p}_id": F.coalesce(f"{p}_id", F.lit(0)) for p in ("country", "admin1", "admin2", "admin3", "admin4")})
