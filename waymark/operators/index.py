"""The name index: a flat table with the trie's depths instead of a trie.

A trie that splits a leaf at THRESHOLD longer names stores name s at depth D(s): the least k that
is the length of s or whose prefix s[:k] is a proper prefix of fewer than THRESHOLD names.  So
counting prefixes gives all that a search's score needs.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.functions.text import fold
from waymark.operators.features import is_indexed
from waymark.session import materialise

THRESHOLD, MAIN = 4096, ""
#: Languages whose names every search sees.
SHARED = ("", "iata", "icao")
#: Prefix lengths that one pass counts.
LEVELS = 4
BROADCAST_ROWS = 1_000_000


def name_rows(places: DataFrame) -> DataFrame:
    """(tree, name, id, ranking): names, shared languages' names and postcodes in the main tree, others in their language's."""
    own = places.where(is_indexed(F.col("feature_code"))).select("id", "ranking", "name", "alternative_names", "postcodes")
    names = own.select(F.lit(MAIN).alias("tree"), "name", "id", "ranking")
    alt = own.select("id", "ranking", F.explode("alternative_names").alias("lang", "name"))
    main = alt.where(F.col("lang").isin(*SHARED)).select(F.lit(MAIN).alias("tree"), "name", "id", "ranking")
    codes = own.select(F.lit(MAIN).alias("tree"), F.explode("postcodes").alias("name"), "id", "ranking")
    langs = alt.where("lang <> ''").select(F.col("lang").alias("tree"), "name", "id", "ranking")
    return reduce(DataFrame.unionByName, [names, main, codes, langs])


def folded_rows(rows: DataFrame) -> DataFrame:
    folded = rows.select("tree", fold(F.col("name")).alias("folded"), "id", "ranking")
    return folded.withColumn("n", F.length("folded"))


def _prefix_rows(rows: DataFrame, first: int, last: int, *keep: str) -> DataFrame:
    """(tree, *keep, prefix) of each row's proper prefixes of lengths from `first` to `last`."""
    lengths = F.sequence(F.lit(first), F.least(F.col("n") - 1, F.lit(last)))
    return rows.where(F.col("n") > first).select("tree", *keep, F.explode(F.transform(lengths, lambda k: F.substring("folded", F.lit(1), k))).alias("prefix"))


def split_prefixes(entries: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """(tree, prefix, extensions) of prefixes with at least `threshold` longer entries.

    Counted four lengths at a time, and only below prefixes that are split themselves: a pass
    shuffles partial counts of its prefixes, and entries leave as soon as theirs is not split.
    """
    active, first, found = entries.select("tree", "folded", "n"), 0, []
    while True:
        last = first + LEVELS - 1
        counts = _prefix_rows(active, first, last).groupBy("tree", "prefix").agg(F.count("*").alias("extensions")).where(F.col("extensions") >= threshold)
        counts = materialise(counts)
        found.append(counts)
        deep = counts.where(F.length("prefix") == last).select("tree", F.col("prefix").alias("_p"))
        if deep.isEmpty():
            return reduce(DataFrame.unionByName, found)
        active = active.where(F.col("n") > last).withColumn("_p", F.substring("folded", F.lit(1), F.lit(last))).join(deep, ["tree", "_p"], "left_semi").drop("_p")
        first = last + 1


def with_depth(entries: DataFrame, split: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """entries with `depth`: one more than the length of the longest split prefix, 0 if none is split.

    Split prefixes are closed under prefixes.  Their levels are counted; the first ones, `most` rows
    together at most, are broadcast one by one, and entries are not shuffled.  These hold the
    prefixes that most names share.  Names that reach a further level meet all of those in one join.
    """
    levels = split.groupBy(F.length("prefix").alias("k")).agg(F.count("*").alias("held")).orderBy("k").collect()
    out, held = entries.withColumn("depth", F.lit(0)), 0
    for first, level_rows in levels:
        held += level_rows
        if held > most:
            break
        level = split.where(F.length("prefix") == first).select("tree", F.col("prefix").alias("_p"), F.lit(1).alias("_hit"))
        out = out.withColumn("_p", F.substring("folded", F.lit(1), F.lit(first))).join(F.broadcast(level), ["tree", "_p"], "left").drop("_p")
        out = out.withColumn("depth", F.when((F.col("_hit") == 1) & (F.col("n") > first), F.lit(first + 1)).otherwise(F.col("depth"))).drop("_hit")
    if held <= most:
        return out
    names = out.where(F.col("depth") == first).select("tree", "folded", "n").distinct()
    met = _prefix_rows(names, first, levels[-1]["k"], "folded").join(split, ["tree", "prefix"], "left_semi")
    deep = met.groupBy("tree", "folded").agg((F.max(F.length("prefix")) + 1).alias("_deep"))
    return out.join(deep, ["tree", "folded"], "left").withColumn("depth", F.greatest("depth", "_deep")).drop("_deep")


def name_index(places: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    entries = materialise(folded_rows(name_rows(places)))
    return with_depth(entries, split_prefixes(entries, threshold)).select("tree", "folded", "n", "depth", "id", "ranking")
