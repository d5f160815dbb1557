"""Byte-level text hashing in numpy, and the few Spark helpers the operators share.

A word is a maximal run of bytes that are not ASCII white space (0x20, 0x09-0x0D), so words
can be cut in UTF-8 without decoding.  All hashes are 64 bits wide and depend on content only.
"""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Regular expression of a word, for Spark's and DuckDB's engines alike.
WORD = r"[^\x20\x09-\x0D]+"
CHUNK = 1 << 19

# Workers outlive their tasks: large arrays are to go back to the system when they are freed, not
# to stay in allocators' pools beside the JVM's heap.  (-3: M_MMAP_THRESHOLD, -8: M_ARENA_MAX.)
pa.set_memory_pool(pa.system_memory_pool())
try:
    _libc = ctypes.CDLL(None)
    _libc.mallopt(-3, 1 << 20)
    _libc.mallopt(-8, 2)
except (OSError, AttributeError):  # another C library
    pass

_U = np.uint64
_MASK = (1 << 64) - 1
_P = 0x9E3779B97F4A7C15 | 1
_P_INV = pow(_P, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (splitmix64's)."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_TABLE = mix(np.arange(1, 257, dtype=np.uint64) * _U(_P))
_TABLE[_SPACE] = 0
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, CHUNK + 65536), base, np.uint64)
        have[0] = 1
        _powers[base] = have = np.cumprod(have, dtype=np.uint64)
    return have[:n]


def window_hash(values: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive values; equal runs hash alike wherever they stand."""
    n = len(values)
    if n < k:
        return np.empty(0, np.uint64)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(values * _power(_P, n), out=sums[1:])
    return mix((sums[k:] - sums[:-k]) * _power(_P_INV, n - k + 1) + _U(k))


class Words:
    """Words of some documents: hashes, byte spans, and bounds[i]:bounds[i+1] for document i."""

    def __init__(self, texts: list[bytes], lower: bool = False):
        sizes = np.array([len(t) + 1 for t in texts], np.int64)
        self.buf = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        if lower:
            self.buf = _LOWER[self.buf]
        inside = np.zeros(len(self.buf) + 2, np.int8)
        np.logical_not(_SPACE[self.buf], out=inside[1:-1].view(bool))
        edge = np.flatnonzero(inside[1:] != inside[:-1])
        self.start, self.end = edge[::2], edge[1::2]
        sums = np.zeros(len(self.buf) + 1, np.uint64)
        np.cumsum(_TABLE[self.buf] * _power(_P, len(self.buf)), out=sums[1:])
        self.hash = mix((sums[self.end] - sums[self.start]) * _power(_P_INV, len(self.buf))[self.start] + (self.end - self.start).astype(np.uint64))
        self.offsets = np.concatenate([[0], np.cumsum(sizes)])
        self.bounds = np.searchsorted(self.start, self.offsets)


def chunks(texts: list[bytes], size: int = CHUNK) -> Iterator[tuple[int, list[bytes]]]:
    """(index of the first, texts) of runs of about `size` bytes; a longer text makes a run alone."""
    first = held = 0
    for i, t in enumerate(texts):
        if held and held + len(t) > size:
            yield first, texts[first:i]
            first, held = i, 0
        held += len(t) + 1
    if first < len(texts):
        yield first, texts[first:]


def texts_of(column: pa.Array) -> list[bytes]:
    """A string column's values in UTF-8; null counts as empty."""
    return [b if b is not None else b"" for b in column.cast(pa.large_binary()).to_pylist()]


def runs(batches: Iterable[pa.RecordBatch], column: str = "text", size: int = CHUNK) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about `size` bytes of text, or elements of lists, so that a worker holds few of them at once."""
    for x in batches:
        length = pc.list_value_length if pa.types.is_list(x[column].type) else pc.binary_length
        ends = np.cumsum(pc.fill_null(length(x[column]), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 16)
        i = 0
        while i < x.num_rows:
            j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + size, "right")))
            yield x.slice(i, j - i)
            i = j


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def batch(schema: pa.Schema, *columns: object) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


# --- Spark ---------------------------------------------------------------------------------


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Only on one machine (a local master, as in tests) a temporary one is made where none is set.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="waymark-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Runs `df` and cuts its lineage with a reliable checkpoint in the shared folder."""
    shared(df.sparkSession)
    return df.checkpoint(eager=True)


def beside(docs: DataFrame, *needed: str) -> tuple[DataFrame, list[str]]:
    """docs with every column but the needed ones under a name of its own, and all names in order."""
    names = [c if c in needed else f"_beside{i}" for i, c in enumerate(docs.columns)]
    return docs.toDF(*names), names


def stored(df: DataFrame) -> DataFrame:
    """Writes a table into the checkpoint folder (dropped when the application ends) and reads it.

    For tables of many rows: Parquet takes a fraction of a checkpoint's disk.
    """
    spark = df.sparkSession
    sc, jvm = spark.sparkContext, spark._jvm
    path = f"{shared(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(p)
    table = spark.read.schema(df.schema).parquet(path)
    table.stored_at = path
    return table


def discard(*tables: DataFrame) -> None:
    """Deletes stored tables that no plan reads any more."""
    for table in tables:
        p = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table.stored_at)
        p.getFileSystem(table.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def small(df: DataFrame, rows: int, most: int) -> DataFrame:
    """Marks `df` for broadcast only if its counted rows stay below `most`; else Spark shuffles."""
    return F.broadcast(df) if rows <= most else df


#: Rows of one key that a task joins, and salted keys at most.
HOT, HOT_KEYS = 500, 500_000


def hot_join(left: DataFrame, right: DataFrame, keys: list[str], by: str, how: str = "inner") -> DataFrame:
    """left joined with right, which has few rows a key.

    Keys of more than HOT of left's rows (of so many that there are HOT_KEYS of them at most) are
    salted by the column `by`, and right's rows of these keys are repeated for each salt.
    """
    most = HOT
    hot = cut(left.groupBy(*keys).agg(F.count("*").alias("_many")).where(F.col("_many") > most))
    while (found := hot.count()) > HOT_KEYS:
        most *= 2
        hot = hot.where(F.col("_many") > most)
    if not found:
        return left.join(right, keys, how)
    hot = hot.select(*keys, F.ceil(F.col("_many") / most).alias("_salts"))
    salted = left.join(F.broadcast(hot), keys, "left").withColumn("_salt", F.coalesce(F.pmod(F.xxhash64(by), "_salts"), F.lit(0).cast("long"))).drop("_salts")
    spread = right.join(F.broadcast(hot), keys, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("_salts", F.lit(1).cast("long")) - 1))).drop("_salts")
    return salted.join(spread, [*keys, "_salt"], how).drop("_salt")


def clash_free(df: DataFrame, *needed: str) -> DataFrame:
    """Only the needed columns, so that further ones with clashing names do no harm."""
    return df.select(*[df[c] for c in needed])


def components(links: DataFrame, limit: int = 60) -> DataFrame:
    """(id, component) of every id in links(a, b); component is the smallest id it reaches.

    Alternates large-star and small-star rounds: each hangs neighbours on the smallest id seen,
    so a star needs two rounds and a chain a logarithmic number.  Only minima are aggregated,
    no group of neighbours is ever gathered, and lineage is cut after every round.
    """
    edges = cut(links.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct())
    before = None
    for _ in range(limit):
        both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(edges.select("lo", "hi"))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).where("hi <> lo").distinct()
        down = large.groupBy("hi").agg(F.min("lo").alias("m"))
        edges = cut(large.join(down, "hi").select(F.col("lo").alias("x"), "hi", "m").select(F.explode(F.array(F.struct(F.col("x").alias("hi"), F.col("m").alias("lo")), F.struct("hi", F.col("m").alias("lo")))).alias("e")).select("e.hi", "e.lo").where("hi <> lo").distinct())
        # A forest of stars whose centres hang on nothing: every hi has one lo and no lo is a hi.
        now = edges.agg(F.count("*"), F.countDistinct("hi"), F.sum(F.hash("hi", "lo").cast("long"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("hi").alias("id"), F.col("lo").alias("component")).union(edges.select("lo", "lo").distinct())
