"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks.

Each source's documents are laid end to end in shuffled order (by a hash of the id) and cut into
blocks of equal tokens.  Slot i of the schedule takes the van der Corput point of i; the source
whose interval of cumulative target weight holds the point fills the slot with its next block,
starting over after its last one, until its target is reached; its last slot may be cut short.
Any prefix of the schedule has each source near its share.  Slots and documents
are joined by block, and a document is taken as often as slots hold its words.  The mixed rows
come in the order of their first slots, in runs of up to RUN slots and RUN_TOKENS, each in one file.

Sources are weighed 3, 1, 2, repeating, in code-point order, null last; a target never exceeds
`most` times its source's size, and the excess goes to the others by weight.  Null texts and
texts without words have size 0 and are not taken; with no words at all every target is 0.  Rows
that repeat an id are laid one after another.  Other columns go with their rows, whatever their names.  Positions come from sums over (source, bucket of
the hash), then within a bucket, so no task gathers a source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from waymark.llm.common import WORD, beside, clash_free, cut

WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2
#: Slots that the schedule has about, documents in a bucket of the shuffled order, bits of a point.
SLOTS, BUCKET_ROWS, BITS = 1 << 17, 20_000, 30
#: Tokens of a slot at most; slots and tokens that are written together at most.
SLOT_TOKENS, RUN, RUN_TOKENS = 1_000_000, 256, 10_000_000


def sizes(docs: DataFrame) -> DataFrame:
    return clash_free(docs, "doc_id", "text", "source").select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))


def targets(sized: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(source, source_size, target, low, high): one row a source; low, high: its share of [0, 1).

    The caps bind in order of size a weight, so which ones do shows in running sums.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    per = per.withColumn("rank", rank).withColumn("weight", F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), F.pmod("rank", F.lit(len(weights))) + 1))
    per = per.withColumn("cap", F.col("source_size") * most)
    order = W.orderBy(F.col("cap") / F.col("weight"), "rank")
    everything = W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    per = per.withColumn("total", F.sum("source_size").over(everything) * F.lit(share)).withColumn("capped", F.sum("cap").over(order.rowsBetween(W.unboundedPreceding, -1))).withColumn("open", F.sum("weight").over(order.rowsBetween(0, W.unboundedFollowing)))
    per = per.withColumn("level", (F.col("total") - F.coalesce("capped", F.lit(0))) / F.col("open"))
    # The first source, in that order, whose cap is not below the level sets the level of all.
    per = per.withColumn("level", F.min(F.when(F.col("cap") >= F.col("level") * F.col("weight"), F.struct(F.col("cap") / F.col("weight"), F.col("rank"), F.col("level")))).over(everything)["level"])
    per = per.withColumn("target", F.when(F.col("cap") <= F.col("level") * F.col("weight"), F.col("cap").cast("double")).otherwise(F.col("level") * F.col("weight")))
    high = F.sum("target").over(W.orderBy("rank").rowsBetween(W.unboundedPreceding, 0))
    return per.withColumn("high", high).withColumn("low", F.col("high") - F.col("target")).select("source", "source_size", "target", "low", "high")


def van_der_corput(i: Column) -> Column:
    """The radical inverse of i in base 2: its bits behind the point in reversed order."""
    return F.conv(F.reverse(F.lpad(F.conv(i.cast("string"), 10, 2), BITS, "0")), 2, 10).cast("long") / F.lit(float(1 << BITS))


class Mix:
    """`layout`: documents' places on their sources' lines; `slots`: the schedule; `taken()`."""

    def __init__(self, docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST, slots: int = SLOTS):
        sized = cut(sizes(docs).withColumn("key", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))))
        self.sized = sized
        self.goals = cut(targets(sized, weights, share, most))
        rows, wanted = sized.count(), self.goals.agg(F.sum("target")).first()[0] or 0.0
        self.block = max(1, min(SLOT_TOKENS, round(wanted / slots)))
        self.layout = self._laid(sized, max(1, rows // BUCKET_ROWS))
        self.slots = self._schedule(sized.sparkSession, wanted)

    def _laid(self, sized: DataFrame, buckets: int) -> DataFrame:
        # The key's leading 32 bits, scaled, so buckets follow the order of keys.
        bucket = F.floor(F.conv(F.substring("key", 1, 8), 16, 10).cast("long") * buckets / F.lit(float(1 << 32))).cast("long")
        sized = sized.withColumn("bucket", bucket)
        per = sized.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
        before = F.sum("bucket_size").over(W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1))
        per = per.select(F.col("source").alias("s"), F.col("bucket").alias("b"), F.coalesce(before, F.lit(0)).alias("offset"))
        laid = sized.join(per, sized["source"].eqNullSafe(per["s"]) & (sized["bucket"] == per["b"])).drop("s", "b")
        end = F.sum("size").over(W.partitionBy("source", "bucket").orderBy("key", "doc_id", "size").rowsBetween(W.unboundedPreceding, 0))
        laid = laid.withColumn("end", F.col("offset") + end).withColumn("start", F.col("end") - F.col("size"))
        goals = self.goals.select(F.col("source").alias("s"), "source_size", "target")
        return laid.join(goals, laid["source"].eqNullSafe(goals["s"])).select("doc_id", "source", "size", "start", "end", "source_size", "target")

    def _schedule(self, spark: SparkSession, wanted: float) -> DataFrame:
        """(slot, source, rank, from_token, tokens): tokens of a source's line that its slots take in turn.

        Points are drawn for the whole target and once again as much; what few slots a source
        then lacks stand at the end, in order of sources.
        """
        n = max(1, round(wanted / self.block))
        goals = self.goals.where("target >= 1").withColumn("needed", F.ceil(F.round("target") / self.block))
        points = spark.range(2 * n).select(F.col("id").alias("slot"), (van_der_corput(F.col("id")) * F.lit(wanted)).alias("x"))
        # Sources' intervals meet points in cells of the line, so this is an equi-join too.
        cells = 1024
        cell = lambda c: F.least(F.floor(c * cells / F.lit(max(wanted, 1.0))), F.lit(cells - 1))
        spread = goals.withColumn("cell", F.explode(F.sequence(cell(F.col("low")), cell(F.col("high")))))
        owned = points.withColumn("cell", cell(F.col("x"))).join(spread, "cell").where("x >= low and x < high").select("slot", "source", "needed")
        part = F.floor(F.col("slot") / 4096)
        per = owned.withColumn("part", part).groupBy("source", "part").agg(F.count("*").alias("many"))
        ahead = per.select(F.col("source").alias("s"), F.col("part").alias("p"), F.coalesce(F.sum("many").over(W.partitionBy("source").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))
        owned = owned.withColumn("part", part)
        ranked = owned.join(ahead, owned["source"].eqNullSafe(ahead["s"]) & (owned["part"] == ahead["p"])).withColumn("rank", F.col("ahead") + F.row_number().over(W.partitionBy("source", "part").orderBy("slot")) - 1)
        ranked = ranked.where("rank < needed").select("slot", "source", "rank")
        drawn = per.groupBy("source").agg(F.sum("many").alias("drawn")).withColumnRenamed("source", "s")
        short = goals.join(drawn, goals["source"].eqNullSafe(drawn["s"]), "left").where("coalesce(drawn, 0) < needed")
        tail = short.select(F.explode(F.sequence(F.coalesce("drawn", F.lit(0)), F.col("needed") - 1)).alias("rank"), "source").select((F.lit(2 * n) + F.col("rank")).alias("slot"), "source", "rank")
        g = self.goals.select(F.col("source").alias("s"), "source_size", F.round("target").cast("long").alias("goal"))
        whole = ranked.unionByName(tail)
        whole = whole.join(g, whole["source"].eqNullSafe(g["s"])).drop("s")
        # A slot's tokens follow those of the source's slot before it, past the line's end from its start.
        return whole.select("slot", "source", "rank", "source_size", (F.col("rank") * self.block).alias("from_token"), F.least(F.lit(self.block), F.col("goal") - F.col("rank") * self.block).alias("tokens")).where("tokens > 0")

    def stream(self) -> DataFrame:
        """(slot, turn, source, doc_id, start, size, first_word, words): what each slot takes of which document.

        Slots and documents meet in blocks of their source's line, an equi-join whose keys hold a
        block's tokens each, however large the source; a slot that passes the line's end goes on
        in the next turn.
        """
        at = lambda token: F.floor(token / self.block)
        size, first, end = F.col("source_size"), F.col("from_token"), F.col("from_token") + F.col("tokens")
        spans = self.slots.withColumn("turn", F.explode(F.sequence(F.floor(first / size), F.floor((end - 1) / size))))
        spans = spans.select("slot", "turn", F.col("source").alias("s"), (F.greatest(first, F.col("turn") * size) - F.col("turn") * size).alias("lo"), (F.least(end, (F.col("turn") + 1) * size) - F.col("turn") * size).alias("hi"))
        spans = spans.withColumn("cell", F.explode(F.sequence(at(F.col("lo")), at(F.col("hi") - 1))))
        own = self.layout.where("size > 0").select("doc_id", "source", "size", "start", "end")
        own = own.withColumn("block", F.explode(F.sequence(at(F.col("start")), at(F.col("end") - 1))))
        met = own.join(spans, own["source"].eqNullSafe(spans["s"]) & (F.col("block") == F.col("cell")))
        words = F.least("end", "hi") - F.greatest("start", "lo")
        # Two spans that share several blocks count in the first of them.
        met = met.where((words > 0) & (F.col("cell") == F.greatest(at(F.col("start")), at(F.col("lo")))))
        return met.select("slot", "turn", "source", "doc_id", "start", "size", (F.greatest("start", "lo") - F.col("start")).alias("first_word"), words.alias("words"))

    def taken(self) -> DataFrame:
        """The layout with `taken`, its `turns` of the whole document and `part` of one more, and
        `slots`: of each of these, the slot it begins in."""
        per = self.stream().groupBy("source", "doc_id", "start", "turn").agg(F.sum("words").alias("words"), F.min("slot").alias("slot"))
        # A document has as many turns as its source's line is gone through: a bound of its own.
        sums = per.groupBy("source", "doc_id", "start").agg(F.sum("words").alias("taken"), F.array_sort(F.collect_list(F.struct("turn", "slot"))).alias("at"))
        sums = sums.select(F.col("source").alias("s"), F.col("doc_id").alias("d"), F.col("start").alias("b"), "taken", F.transform("at", lambda x: x["slot"]).alias("slots"))
        # Documents of size 0 share their neighbour's start; they are not taken.
        same = self.layout["source"].eqNullSafe(sums["s"]) & self.layout["doc_id"].eqNullSafe(sums["d"]) & (self.layout["start"] == sums["b"]) & (self.layout["size"] > 0)
        out = self.layout.join(sums, same, "left").drop("s", "d", "b").withColumn("taken", F.coalesce("taken", F.lit(0)).cast("long"))
        return out.withColumn("turns", F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size"))).otherwise(0).cast("long")).withColumn("part", F.col("taken") - F.col("turns") * F.col("size"))


def mix_documents(docs: DataFrame, slot: str | None = None, **options) -> DataFrame:
    """docs as the mix takes them, in the schedule's order: whole copies for whole turns, and the first
    words for a part; with the slot that a row begins in as a last column, if it gets a name."""
    columns, kinds = docs.columns, docs.schema
    docs, names = beside(docs, "doc_id", "text", "source", "n_chars")
    mix = Mix(docs, **options)
    run = max(1, min(RUN, RUN_TOKENS // mix.block))
    taken = mix.taken().select(F.col("doc_id").alias("_d"), F.col("size").alias("_s"), "turns", "part", "slots", F.row_number().over(W.partitionBy("doc_id", "size").orderBy("start")).alias("_k"))
    own = docs.withColumn("_size", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long"))
    key = [F.col("doc_id").isNull(), F.coalesce("doc_id", F.lit(0)), F.col("_size")]
    theirs = [F.col("_d").isNull(), F.coalesce("_d", F.lit(0)), F.col("_s")]
    on = [a == b for a, b in zip(key, theirs)]
    if not mix.sized.groupBy("doc_id", "size").count().where("count > 1").isEmpty():
        # Rows that share an id and a size are told apart by their place among themselves.
        own = own.withColumn("_nth", F.row_number().over(W.partitionBy("doc_id", "_size").orderBy("text")))
        on.append(F.col("_nth") == F.col("_k"))
    both = own.join(taken, on)
    first = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(f"({WORD})"), F.lit(1)), F.lit(1), F.col("part").cast("int")), " ")
    # All copies of a document come from its one row, so the join shuffles the texts once.
    out = both.select("*", F.posexplode("slots").alias("_turn", "_slot")).withColumn("_part", F.col("_turn") >= F.col("turns"))
    out = out.withColumn("text", F.when(F.col("_part"), first).otherwise(F.col("text")))
    if "n_chars" in columns:
        out = out.withColumn("n_chars", F.when(F.col("_part"), F.length("text").cast(kinds["n_chars"].dataType)).otherwise(F.col("n_chars")))
    # Runs of slots hold equal tokens, so no task gets more than its share.
    out = out.select(*names, "_slot").repartition(F.floor(F.col("_slot") / run)).sortWithinPartitions("_slot", "doc_id")
    return out.select(*[F.col(n).alias(c) for n, c in zip(names, columns)], *([F.col("_slot").alias(slot)] if slot else []))
