"""Document fingerprints from spot signatures, in DataFrame functions only.

Common words are anchors, and so is a text's start; the content words that follow an anchor up to
the next are a chain, cut after every CHAIN words; each chain is a signature.  A document's fingerprint is the sorted set of its
signatures' 32-bit hashes, in decimal, joined by commas: the set itself, so any two
fingerprints can be compared exactly.  Two sets are compared by Jaccard similarity; the ratio of
their lengths bounds it from above, so pairs below a floor are pruned by length alone, and a join
partitions sets by length.

Words are in lower case, between ASCII's characters that are not alphanumeric, Latin-1 signs,
and general and CJK punctuation.  A text of anchors alone takes them as one chain; a text without
words (or null) has the empty fingerprint, which is like another empty one only.  Equal texts
have equal fingerprints.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from waymark.llm.common import clash_free, small

CHAIN = 3
#: Documents in a bucket of consecutive ids, buckets that are broadcast at most, and (groups of)
#: quantiles that the buckets are cut from: ids far from all others spoil the buckets of one.
BUCKET_ROWS, BROADCAST_BUCKETS = 2000, 1_000_000
GROUPS, QUANTILES = 32, 32 * 32

#: Common words of English, French, German and Spanish.
ANCHORS = """
a an and are as at be by for from in is it of on or that the this to was with
au aux avec dans de des du elle en entre est et il la le les par pas pour que qui sur un une
auch auf das dem den der die ein eine er es für ist mit nicht sich sie und von zu
al como con del el las lo los más no para por se su una y
""".split()


def _with(value: Column, then) -> Column:
    """`then` of a value that is computed once, however often `then` names it."""
    return F.get(F.transform(F.array(value), then), 0)


#: What stands between words.
GAP = r"[\x00-/:-@\[-`{-\u00A9\u00AB-\u00B4\u00B6-\u00B9\u00BB-\u00BF\u2000-\u206F\u3000-\u303F\uFF00-\uFF0F]+"


def _anchors() -> str:
    """Alternatives grouped by their first letter, so that few are tried at a word."""
    by = {}
    for w in sorted(set(ANCHORS)):
        by.setdefault(w[0], []).append(w[1:])
    return "|".join(f"{c}(?:{'|'.join(rest)})" for c, rest in by.items())


def signatures(text: Column) -> Column:
    """Sorted distinct 32-bit hashes of the text's chains."""
    inner = F.btrim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), GAP, "  "))
    # Every word stands between spaces of its own, so each anchor is one match, without any repetition
    # in the pattern that the regular-expression engine would recurse into.
    marked = F.regexp_replace(F.concat(F.lit(" "), inner, F.lit(" ")), f" (?:{_anchors()}) ", "\x01")
    marked = F.regexp_replace(marked, "  ".join([r"([^ \x01]+"] + [r"[^ \x01]+"] * (CHAIN - 1)) + ")  ", "$1\x01")
    chains = F.filter(F.transform(F.split(marked, "\x01+", -1), lambda c: F.btrim(c)), lambda c: c != "")
    hashes = _with(F.transform(chains, lambda c: F.hash(c)), lambda h: F.when((F.size(h) == 0) & (inner != ""), F.array(F.hash(inner))).otherwise(h))
    return F.array_sort(F.array_distinct(hashes))


def fingerprint(sigs: Column) -> Column:
    return F.array_join(sigs.cast("array<string>"), ",")


def likeness(a: Column, b: Column, floor: float = 0.0) -> Column:
    """Jaccard similarity of two signature sets; 0 if their lengths alone keep it below the floor."""
    least, most = F.least(F.size(a), F.size(b)), F.greatest(F.size(a), F.size(b))
    exact = _with(F.size(F.array_intersect(a, b)), lambda common: common / (least + most - common))
    return F.when(most == 0, 1.0).when((least == 0) | (least < F.lit(floor) * most), 0.0).otherwise(exact)


def length_partition(sigs: Column, threshold: float = 0.8) -> Column:
    """Lengths in one partition are within the threshold's ratio; partners are in it or the next."""
    return F.when(F.size(sigs) == 0, -1).otherwise(F.floor(F.log(F.size(sigs).cast("double")) / F.log(F.lit(1 / threshold)))).cast("long")


def similar(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """(a, b, likeness) of fingerprint classes at or above the threshold; a, b: their smallest ids.

    Equal fingerprints are one class.  A set is filed, in its length partition and, as partner,
    in the one before, under the signatures of its prefix in hash order, of which two similar
    sets share one; pairs of one cell are compared once each.
    """
    docs = clash_free(docs, "doc_id", "text").where("doc_id is not null")
    sets = docs.select("doc_id", signatures(F.col("text")).alias("sigs")).where("size(sigs) > 0").groupBy("sigs").agg(F.min("doc_id").alias("doc_id"))
    prefix = F.slice("sigs", 1, F.size("sigs") - F.ceil(F.size("sigs") * threshold).cast("int") + 1)
    filed = sets.withColumn("part", length_partition(F.col("sigs"), threshold)).withColumn("sig", F.explode(prefix))
    left = filed.select(F.col("doc_id").alias("a"), F.col("sigs").alias("x"), "sig", F.explode(F.array("part", F.col("part") + 1)).alias("part"))
    right = filed.select(F.col("doc_id").alias("b"), F.col("sigs").alias("y"), "sig", "part")
    pairs = left.join(right, ["sig", "part"]).where("size(x) < size(y) or size(x) = size(y) and a < b")
    pairs = pairs.withColumn("likeness", likeness(F.col("x"), F.col("y"), threshold)).where(F.col("likeness") >= threshold)
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "likeness").distinct()


def in_order(docs: DataFrame, *columns: str):
    """(rows, window): a lead over the window finds the row with the next id, the first's for the last.

    Null ids come first; rows with one id follow each other in order of the columns.  Ids are cut
    into buckets of about BUCKET_ROWS rows, or as many as keep buckets at BROADCAST_BUCKETS
    (quantiles, then equal steps); each bucket also gets the first row of the bucket after it,
    marked _ghost, so no task orders more than a bucket.
    """
    docs = clash_free(docs, "doc_id", *columns)
    shape = docs.agg(F.count("*").alias("n"), F.percentile_approx("doc_id", [i / QUANTILES for i in range(QUANTILES)], 20_000).alias("q"), F.max("doc_id").alias("top")).first()
    lows = sorted(set(shape["q"] or [0]))
    highs = lows[1:] + [(shape["top"] or 0) + 1]
    pieces = max(1, -(-shape["n"] // len(lows) // max(BUCKET_ROWS, shape["n"] // BROADCAST_BUCKETS)))
    steps = [max(1, -(-(h - lo) // pieces)) for lo, h in zip(lows, highs)]
    # Quantiles stand in groups, so that a row is held against two short lists, not against all.
    groups = [list(range(i, min(i + GROUPS, len(lows)))) for i in range(0, len(lows), GROUPS)]
    longs = lambda values: F.array(*[F.lit(x).cast("long") for x in values])
    below = lambda list_: F.greatest(F.size(F.filter(list_, lambda x: x <= F.col("doc_id"))), F.lit(1))
    placed = docs.withColumn("_g", below(longs([lows[g[0]] for g in groups])))
    of_group = lambda values: F.element_at(F.array(*[longs([values[i] for i in g]) for g in groups]), F.col("_g"))
    placed = placed.withColumn("_r", below(of_group(lows)))
    step = F.greatest(F.floor((F.col("doc_id") - F.element_at(of_group(lows), F.col("_r"))) / F.element_at(of_group(steps), F.col("_r"))), F.lit(0))
    placed = placed.withColumn("_bucket", F.coalesce((F.col("_g") * GROUPS + F.col("_r")) * (1 << 40) + step, F.lit(-1).cast("long"))).drop("_g", "_r")
    firsts = placed.groupBy("_bucket").agg(F.min("doc_id").alias("_first"))
    w = W.orderBy("_bucket")
    last = F.max("_bucket").over(W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    firsts = firsts.select(F.col("_bucket").alias("_own"), "_first", F.coalesce(F.lag("_bucket").over(w), last).alias("_before"))
    ghosts = placed.join(small(firsts, len(lows) * (pieces + 1), BROADCAST_BUCKETS), (F.col("_bucket") == F.col("_own")) & F.col("doc_id").eqNullSafe(F.col("_first")))
    ghosts = ghosts.select("doc_id", *columns, F.col("_before").alias("_bucket"), F.lit(1).alias("_ghost"))
    both = placed.withColumn("_ghost", F.lit(0)).unionByName(ghosts)
    return both, W.partitionBy("_bucket").orderBy("_ghost", F.col("doc_id").asc_nulls_first(), *columns)


def edits(docs: DataFrame) -> DataFrame:
    """Every text, its last quarter replaced by as much of the next document's start, and both's signatures."""
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    both, order = in_order(docs, "text")
    both = both.withColumn("sigs", signatures(F.col("text")))
    rows = both.select("*", F.lead("text").over(order).alias("next_text"), F.lead("sigs").over(order).alias("next_sigs")).where("_ghost = 0")
    rows = rows.withColumn("n_chars", F.length("text").cast("long"))
    quarter = F.floor(F.col("n_chars") / 4).cast("int")
    rows = rows.withColumn("edited", F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - quarter), F.substring("next_text", F.lit(1), quarter)))
    return rows.select("doc_id", "n_chars", "edited", "sigs", "next_sigs").withColumn("edited_sigs", signatures(F.col("edited")))
