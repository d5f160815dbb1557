"""Ranked search by exact name or prefix, for one request or for many."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from waymark.functions.text import fold, fold_literal

FACTOR = 1.5
#: Requests of so many characters match whole names only.
EXACT_CHARS = 2


def priority(m, folded_query: Column) -> Column:
    """Score of an index row for a query of m folded characters that starts its name."""
    beyond = F.greatest(F.lit(0), F.col("depth") - m).cast("double")
    part = (F.lit(FACTOR) / (F.pow(F.lit(2.0), beyond) * (F.col("n") - F.col("depth") + 1))).cast("float")
    return F.when(F.col("folded") == folded_query, F.lit(FACTOR).cast("float") + F.col("ranking")).otherwise(part + F.col("ranking"))


def best_of_each(scored: DataFrame, group: list[str] = (), id_: str = "id", by: str = "priority") -> DataFrame:
    return scored.groupBy(*group, id_).agg(F.max(by).alias(by)).where(F.col(by) > 0)


def top_k(scored: DataFrame, k: int, group: list[str] = (), id_: str = "id", by: str = "priority") -> DataFrame:
    """The k best ids by priority, then id; one row an id, with its best priority; both must be positive.

    Without groups this is a partial top-k in each task; with groups, a limit on ranks before
    and after the shuffle, so no group is gathered.
    """
    best = best_of_each(scored.where(F.col(id_) > 0), group, id_, by)
    if not group:
        return best.orderBy(F.desc(by), id_).limit(k)
    rank = F.row_number().over(W.partitionBy(*group).orderBy(F.desc(by), id_))
    return best.withColumn("rank", rank).where(F.col("rank") <= k)


def matches(index: DataFrame, query: str, trees: list[str], exact: bool | None = None) -> DataFrame:
    """(id, priority) of index rows that match one query; both filters reach the Parquet scan."""
    q = fold_literal(query)
    exact = len(query) <= EXACT_CHARS if exact is None else exact
    if "folder" in index.columns:
        index = index.where(F.col("folder").isin([t or "*" for t in trees]))
    rows = index.where(F.col("tree").isin(trees)).where(F.col("folded") == q if exact else F.col("folded").startswith(q))
    return rows.select("id", priority(F.lit(len(q)), F.lit(q)).alias("priority"))


def trees_of(language: str) -> list[str]:
    return sorted({"", language})


def search_ids(index: DataFrame, query: str, language: str, count: int) -> DataFrame:
    """(id, priority): the main tree and the language's, best first."""
    return top_k(matches(index, query, trees_of(language)), count)


def search_batch(index: DataFrame, requests: DataFrame, count: int = 10) -> DataFrame:
    """(qid, id, priority, rank) for requests(qid, name, language).

    Distinct queries are scored once.  Longer ones join on the first three folded characters and
    are compared in full after; exact ones join on the whole name; skewed prefixes are left to
    AQE's skew join, as nothing above the join needs a prefix's rows together.
    """
    asked = requests.select("qid", fold(F.col("name")).alias("q"), (F.length("name") <= EXACT_CHARS).alias("exact"), "language")
    distinct = asked.select("q", "exact", "language").distinct().withColumn("m", F.length("q")).select("*", F.explode(F.array_distinct(F.array(F.lit(""), "language"))).alias("tree"))
    index = index.select("tree", "folded", "n", "depth", "id", "ranking")
    whole = distinct.where("exact").join(index, (distinct["tree"] == index["tree"]) & (F.col("q") == F.col("folded")))
    parts = [whole.select("q", "exact", "language", "id", (F.lit(FACTOR).cast("float") + F.col("ranking")).alias("priority"))]
    for size in (3, 2, 1):
        own = distinct.where("not exact").where(F.col("m") >= 3 if size == 3 else F.col("m") == size).withColumn("p", F.substring("q", 1, size))
        keyed = index.withColumn("p", F.substring("folded", 1, size)).where(F.col("n") >= size)
        both = own.join(keyed, ["tree", "p"]).where(F.col("folded").startswith(F.col("q")))
        parts.append(both.select("q", "exact", "language", "id", priority(F.col("m"), F.col("q")).alias("priority")))
    scored = parts[0]
    for p in parts[1:]:
        scored = scored.unionByName(p)
    best = top_k(scored, count, ["q", "exact", "language"])
    return asked.join(best, ["q", "exact", "language"]).select("qid", "id", "priority", "rank")


def keep_country(hits: DataFrame, country_code: str | None) -> DataFrame:
    return hits.where(F.col("country_iso2") == country_code) if country_code else hits


def keep_area(hits: DataFrame, areas: DataFrame) -> DataFrame:
    """Hits whose country or administrative parent is among areas(area_id)."""
    parents = F.array("admin1_id", "admin2_id", "admin3_id", "admin4_id", "country_id")
    inside = hits.select("id", F.explode(parents).alias("area_id")).join(areas, "area_id", "left_semi").select("id").distinct()
    return hits.join(inside, "id", "left_semi")
