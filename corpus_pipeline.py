"""A training corpus from the table of documents, in five stages.

Each stage takes all that the one before kept, as Parquet read again, and returns the columns of
documents; the last returns token ids.  Documents rejected by the quality classifier go, of each
group of near copies (five words, similarity 0.8) one document stays, repeated passages of 50
words are cut out of all but the first document, sources are mixed to their target weights, and
the mix is encoded.

Rows without an id: the classifier judges them as any other; they are nobody's near copy and
neither remove nor lose a passage, as both stages tell documents by their ids; they are mixed and
encoded, with a null id.  Further columns go through all stages but the last, whatever their names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.llm import mixing, ngram_jaccard, piece_bpe, quality_classifier, substring_dedup
from waymark.llm.common import load, shared
from waymark.llm.queries import TOKENIZERS


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier keeps, each row by its own verdict."""
    return quality_classifier.QualityClassifier(docs, load(spark, sf_dir, "labels")).kept(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_jaccard.one_of_each(docs, size=5, num=8, den=10)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return substring_dedup.without_repeats(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return piece_bpe.encode_decode(docs, f"{TOKENIZERS}/piece_bpe_32k.model").select("doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"))


STAGES = [
    ("quality classifier", classify),
    ("n-gram Jaccard join", drop_near_copies),
    ("substring dedup", drop_repeats),
    ("mixing sources to target weights", mix),
    ("SentencePiece encoding and decoding", encode),
]
#: No stage but the mix and the dedup can be stated in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared(spark)}/pipeline-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    docs = load(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{k}")
            docs = spark.read.parquet(f"{folder}/{k}")
    return docs
