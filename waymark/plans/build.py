"""From the dumps to the database's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.functions.ranking import ranking
from waymark.operators.altnames import languages, name_maps, postcodes, preferred_names
from waymark.operators.features import loaded
from waymark.operators.hierarchy import with_parents
from waymark.operators.index import THRESHOLD, name_index
from waymark.sources import dumps, store


def denormalise(raw: DataFrame, alt: DataFrame, with_cc2: bool = True) -> DataFrame:
    """Stored places of typed dump rows: filtered, ranked, with parents, names and postcodes."""
    out = with_parents(loaded(raw), with_cc2)
    out = out.join(name_maps(preferred_names(alt)), out["id"] == F.col("place_id"), "left").drop("place_id")
    out = out.join(postcodes(alt), out["id"] == F.col("place_id"), "left").drop("place_id")
    out = out.withColumns({"alternative_names": F.coalesce("alternative_names", F.create_map().cast("map<string,string>")), "postcodes": F.coalesce("postcodes", F.array().cast("array<string>"))})
    out = out.withColumn("ranking", ranking(F.col("population"), F.col("feature_code"), F.size("postcodes") > 0))
    return out.select("id", "name", "latitude", "longitude", "ranking", "elevation", "feature_code", "country_iso2", "country_id", "admin1_id", "admin2_id", "admin3_id", "admin4_id", "timezone", "population", "alternative_names", "postcodes")


def count_loaded(places: DataFrame) -> DataFrame:
    """(loaded, ids): equal if ids are unique."""
    return places.agg(F.count("*").alias("loaded"), F.countDistinct("id").alias("ids"))


def build(spark: SparkSession, folder: str, places_path: str, alt_names_path: str, threshold: int = THRESHOLD, signed_elevation: bool = False, with_cc2: bool = True) -> None:
    alt = dumps.read_alt_names(spark, alt_names_path)
    places = denormalise(dumps.read_places(spark, places_path, signed_elevation=signed_elevation), alt, with_cc2)
    places.write.mode("overwrite").parquet(f"{folder}/_built")
    places = spark.read.parquet(f"{folder}/_built")
    store.write(folder, places, name_index(places, threshold), languages(alt))


def load_or_create(spark: SparkSession, folder: str, places_path: str, alt_names_path: str, **options) -> dict[str, DataFrame]:
    """The database's tables; they are built only if they are not there, and read back always."""
    if not store.exists(spark, folder):
        build(spark, folder, places_path, alt_names_path, **options)
    return store.read(spark, folder)
