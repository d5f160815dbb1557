"""The database: one Parquet table each for places, name index and split prefixes.

The name index is partitioned by tree and sorted by folded name, so a language's search reads its
folders only and a prefix's row groups; places are sorted by id for point lookups; points are
sorted by one-degree cells, so a box reads the row groups around it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

def exists(spark: SparkSession, folder: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/languages/_SUCCESS")
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)


def write(folder: str, places: DataFrame, name_index: DataFrame, languages: DataFrame) -> None:
    """Languages come last: their _SUCCESS marks a whole database."""
    places.repartitionByRange("id").sortWithinPartitions("id").write.mode("overwrite").parquet(f"{folder}/places")
    # '' can't name a folder, so the main tree's is '*'; a range keeps a large tree in many files.
    index = name_index.withColumn("tree", F.when(F.col("tree") == "", "*").otherwise(F.col("tree")))
    cells = places.select("id", "latitude", "longitude").withColumns({"y": F.floor("latitude"), "x": F.floor("longitude")})
    cells.repartitionByRange("y", "x", "id").sortWithinPartitions("y", "x").drop("y", "x").write.mode("overwrite").parquet(f"{folder}/points")
    index.repartitionByRange("tree", "folded", "id").sortWithinPartitions("tree", "folded").write.mode("overwrite").partitionBy("tree").parquet(f"{folder}/name_index")
    languages.write.mode("overwrite").parquet(f"{folder}/languages")


def read(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    index = spark.read.schema("folded string, n int, depth int, id int, ranking float, tree string").parquet(f"{folder}/name_index")
    out = {t: spark.read.parquet(f"{folder}/{t}") for t in ("places", "points", "languages")}
    return out | {"name_index": index.withColumnRenamed("tree", "_t").select(F.when(F.col("_t") == "*", "").otherwise(F.col("_t")).alias("tree"), "folded", "n", "depth", "id", "ranking", F.col("_t").alias("folder"))}
