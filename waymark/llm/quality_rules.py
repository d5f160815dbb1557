r"""Quality rules with cross-document line frequency, in DataFrame functions only.

Base rules count words, symbols, repeated lines and repeated 5-word windows of a text.  The
method: lines are normalised (A-Z lowered, digits to 0, white space to one space), hashed, and
the distinct documents (distinct texts) of each host that have them are counted; a line in more
than max(MIN_DOCS, SHARE of the host's distinct texts) is boilerplate and removed, and a document
that keeps less than LEFT of its words is rejected as depleted.
Copies of one text count as one document, so copying does not make its lines boilerplate.

Null texts count as empty, a null host is a host; repeated rows are judged one by one.  Counts
are pre-aggregated per task, so a hot line or host is one partial row from each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.llm.common import WORD, clash_free, cut, small

MIN_DOCS, SHARE, MIN_WORDS, LEFT = 5, 0.05, 10, 0.3
WINDOW, REPEATS = 5, 20
BROADCAST_LINES = 500_000
BLANKS = " \t\n\x0b\x0c\r"
UPPER_DIGITS, LOWER_ZEROS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ123456789", "abcdefghijklmnopqrstuvwxyz000000000"


def normalised_lines(text: Column) -> Column:
    """Normalised lines that have a word."""
    plain = F.translate(text, UPPER_DIGITS, LOWER_ZEROS)
    plain = F.regexp_replace(F.regexp_replace(plain, r"[\x20\t\x0B\f\r]+", " "), " ?\n ?", "\n")
    return F.filter(F.split(F.btrim(plain, F.lit(" ")), "\n"), lambda x: x != "")


def _spread(starts: Column) -> Column:
    """Words covered by windows at the given sorted starts."""
    gaps = F.transform(starts, lambda s, i: F.least(F.lit(WINDOW), F.coalesce(F.get(starts, i + 1) - s, F.lit(WINDOW))))
    return F.aggregate(gaps, F.lit(0).cast("long"), lambda a, g: a + g)


def base_counts(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text, source) with a row number and the counts of the base rules."""
    t = F.col("text")
    rows = clash_free(docs, "doc_id", "text", "source").withColumn("text", F.coalesce(t, F.lit("")))
    rows = rows.withColumn("row", F.monotonically_increasing_id()).withColumn("n_words", F.regexp_count(t, F.lit(WORD)).cast("long"))
    rows = rows.withColumn("word_chars", F.length(F.translate(t, BLANKS, "")).cast("long"))
    rows = rows.withColumn("n_symbols", (F.length(t) - F.length(F.translate(t, "#*$%&|<>", ""))).cast("long"))
    rows = rows.withColumn("_lines", F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != ""))
    rows = rows.withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long")).drop("_lines")
    rows = rows.withColumn("_words", F.split(F.btrim(t, F.lit(BLANKS)), r"[\x20\x09-\x0D]+"))
    at = F.when(F.col("n_words") >= WINDOW, F.sequence(F.lit(0), F.col("n_words").cast("int") - WINDOW)).otherwise(F.array().cast("array<int>"))
    rows = rows.withColumn("_grams", F.transform(at, lambda i: F.xxhash64(*[F.get("_words", i + k) for k in range(WINDOW)]))).drop("_words")
    rows = rows.withColumn("_twice", F.size(F.array_distinct("_grams")) < F.size("_grams"))
    pairs = F.array_sort(F.transform("_grams", lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
    rows = rows.withColumn("_sorted", F.when(F.col("_twice"), pairs).otherwise(F.array().cast("array<struct<g:bigint,i:int>>"))).drop("_grams")
    again = F.filter("_sorted", lambda x, k: (F.get("_sorted", k - 1)["g"] == x["g"]) | (F.get("_sorted", k + 1)["g"] == x["g"]))
    rows = rows.withColumn("_starts", F.array_sort(F.transform(again, lambda x: x["i"]))).drop("_sorted")
    return rows.withColumn("n_repeat_words", _spread(F.col("_starts"))).drop("_starts", "_twice")


def quality_rules(docs: DataFrame) -> DataFrame:
    """The base counts of every row, n_line_words (words in boilerplate lines), base_failed and kept."""
    counted = base_counts(docs)
    line = F.explode_outer(F.transform(normalised_lines(F.col("text")), lambda x: F.struct(F.xxhash64(x).alias("line"), (F.regexp_count(x, F.lit(WORD))).alias("words"))))
    stats = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    spread = cut(counted.select("row", "source", F.xxhash64("text").alias("copy"), *stats, line.alias("l")).select("row", "source", "copy", *stats, "l.line", "l.words"))
    hosts = spread.select("source", "copy").distinct().groupBy("source").agg(F.count("*").alias("texts")).withColumnRenamed("source", "host")
    having = spread.where("line is not null").select("source", "line", "copy").distinct().groupBy("source", "line").agg(F.count("*").alias("docs"))
    often = having.where(F.col("docs") > MIN_DOCS).join(hosts, having["source"].eqNullSafe(hosts["host"])).where(F.col("docs") > F.greatest(F.lit(float(MIN_DOCS)), F.lit(SHARE) * F.col("texts")))
    often = cut(often.select(F.col("source").alias("host"), F.col("line").alias("often")))
    marked = spread.join(small(often, often.count(), BROADCAST_LINES), spread["source"].eqNullSafe(F.col("host")) & (F.col("line") == F.col("often")), "left")
    out = marked.groupBy("row").agg(*[F.first(c).alias(c) for c in stats], F.sum(F.when(F.col("often").isNotNull(), F.col("words")).otherwise(0)).cast("long").alias("n_line_words"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEATS * F.col("n_words"))
    left = F.col("n_words") - F.col("n_line_words")
    out = out.withColumn("base_failed", failed).withColumn("kept", ~failed & (left >= LEFT * F.col("n_words")))
    return out.drop("row")
