"""Sessions, tables, and materialisation in the cluster's shared folder."""

from __future__ import annotations

import functools
import os
import shutil
import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What the engine relies on; a cluster's own settings stay where they are set.
SETTINGS = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.adaptive.coalescePartitions.enabled": "true"}


def session(name: str = "waymark", **settings: str) -> SparkSession:
    return SparkSession.builder.appName(name).config(map=SETTINGS | settings).getOrCreate()


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def small(df: DataFrame, rows: int, most: int) -> DataFrame:
    """Marks `df` for broadcast only if its counted rows stay at `most`; else the plan shuffles or AQE decides."""
    return F.broadcast(df) if rows <= most else df


def shared_folder(spark: SparkSession) -> str:
    """This application's own folder below spark.checkpoint.dir, which a cluster shares.

    Only on one machine (a local master, as in tests) a temporary one is made where none is set.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="waymark-"))
    return sc.getCheckpointDir()


def materialise(df: DataFrame) -> DataFrame:
    """Runs `df` once and cuts its lineage with a reliable checkpoint."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once an application, for the functions that run in Python there."""
    sc = spark.sparkContext
    if sc.applicationId not in _shipped:
        here = os.path.dirname(os.path.abspath(__file__))
        to = os.path.join(tempfile.mkdtemp(prefix="waymark-"), "waymark")
        sc.addPyFile(shutil.make_archive(to, "zip", os.path.dirname(here), os.path.basename(here)))
        _shipped.add(sc.applicationId)


def shipped(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @functools.wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    return run
