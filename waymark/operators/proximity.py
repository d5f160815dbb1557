"""Nearest places, exact under the planar distance: nearest first, then the larger id."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from waymark.functions.geo import planar_km, reach_degrees


def nearest(places: DataFrame, latitude: float, longitude: float, count: int = 10, max_km: float = 100.0) -> DataFrame:
    """(id, distance) around one point; the box reaches the scan, then a partial top-k in each task."""
    d = reach_degrees(max_km) * (1 + 1e-6) + 1e-6
    lat, lon = F.col("latitude"), F.col("longitude")
    near = places.where(lat.between(latitude - d, latitude + d) & lon.between(longitude - d, longitude + d))
    near = near.select("id", planar_km(lat, lon, F.lit(latitude), F.lit(longitude)).alias("distance"))
    return near.where((F.col("distance") <= F.lit(max_km).cast("float")) & (F.col("id") > 0)).orderBy("distance", F.desc("id")).limit(count)


def nearest_batch(places: DataFrame, points: DataFrame, count: int = 10, max_km: float = 100.0) -> DataFrame:
    """(qid, id, distance, rank) for points(qid, latitude, longitude).

    Cells are as wide as the reach, so a point's partners are in its cell and the eight around:
    an equi-join.  Ranks are limited before the shuffle by point.
    """
    d = reach_degrees(max_km) * (1 + 1e-6) + 1e-6
    cell = lambda c: F.floor(c.cast("double") / d)
    here = places.where("id > 0").select("id", F.col("latitude").alias("plat"), F.col("longitude").alias("plon"), cell(F.col("latitude")).alias("y"), cell(F.col("longitude")).alias("x"))
    steps = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy in (-1, 0, 1) for dx in (-1, 0, 1)])
    asked = points.select("qid", "latitude", "longitude", F.explode(steps).alias("s")).select("qid", "latitude", "longitude", (cell(F.col("latitude")) + F.col("s.dy")).alias("y"), (cell(F.col("longitude")) + F.col("s.dx")).alias("x"))
    both = asked.join(here, ["y", "x"]).select("qid", "id", planar_km(F.col("plat"), F.col("plon"), F.col("latitude").cast("double"), F.col("longitude").cast("double")).alias("distance"))
    rank = F.row_number().over(W.partitionBy("qid").orderBy("distance", F.desc("id")))
    return both.where(F.col("distance") <= F.lit(max_km).cast("float")).withColumn("rank", rank).where(F.col("rank") <= count)
