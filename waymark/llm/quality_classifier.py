"""Quality classifier with hierarchical empirical Bayes.

Document evidence: every token counts by its hashed word, its hashed shape (kinds of characters
in a row) and whether it repeats one of the two words before it; each bucket of these has a
naive-Bayes log ratio from the labelled documents' counts, and a document's evidence is the mean over its tokens, brought to log-odds by a
logistic fit on labelled documents that the counts did not use.  Counts come by grouped
aggregation over all labelled documents; what reaches the driver is bounded by BUCKETS and BINS.

Sites: hosts, and paths within hosts, get posterior shares of good documents by grouped
aggregation of the documents' probabilities.  A path is shrunk toward its host, a host toward the
share of all documents, so a site of few documents says little.  How strongly is estimated from the
spread of sites by moments: as if by s2 / t2 documents, with s2 the variance of documents within
sites, and t2 that of sites beyond what s2 explains; sites that spread no more than chance
say nothing.  A document's log-odds move by its path's less those of all; its own probability is
left out of its site's sums, so no evidence counts twice.

Null texts and texts without words carry no evidence: their log-odds are the global ones before
the site's.  A null host or path is a site of its own.  Without labels of both kinds nothing is
rejected.  Repeated rows are classified each; of repeated labels the least quality counts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from waymark.llm.common import _P, _P_INV, Words, _power, batch, chunks, clash_free, cut, hot_join, mix, runs, small, texts_of

_U = np.uint64
BUCKETS, BINS = 1 << 16, 400
#: Labels, or sites, of so many rows are broadcast at most.
BROADCAST_LABELS, BROADCAST_SITES = 2_000_000, 500_000
#: Documents for which a level of sites counts that does not spread.
SAME = 1e12

_CLASS = np.full(256, 5, np.uint64)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58] = 1, 2, 3
#: Each ASCII punctuation mark is a kind of its own.
for _c in b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~":
    _CLASS[_c] = 6 + _c


#: Buckets in all: of words, of shapes, of repeats.
KINDS = (slice(0, BUCKETS), slice(BUCKETS, 2 * BUCKETS), slice(2 * BUCKETS, 2 * BUCKETS + 4))
ALL = 2 * BUCKETS + 4


def tokens(run: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(buckets of each word: three columns, bounds of documents) of a run of texts."""
    w = Words(run)
    kind = _CLASS[w.buf]
    fresh = np.concatenate([[True], kind[1:] != kind[:-1]])
    fresh[w.start] = True
    place = np.cumsum(fresh)
    sums = np.zeros(len(kind) + 1, np.uint64)
    np.cumsum(np.where(fresh, kind * _power(_P, int(place[-1]) + 1)[place], _U(0)), out=sums[1:])
    shape = mix((sums[w.end] - sums[w.start]) * _power(_P_INV, int(place[-1]) + 1)[place[w.start]])
    low = Words(run, lower=True).hash
    again = np.zeros(len(low), np.int64)
    for back in (1, 2):
        again[back:] |= (low[back:] == low[:-back]).astype(np.int64) << (back - 1)
    # What a document's first words would repeat is in the document before.
    firsts = np.unique(w.bounds[:-1])
    again[firsts[firsts < len(low)]] = 0
    again[firsts[firsts + 1 < len(low)] + 1] &= 1
    columns = (low & _U(BUCKETS - 1)).astype(np.int64), (shape & _U(BUCKETS - 1)).astype(np.int64) + BUCKETS, again + 2 * BUCKETS
    return np.stack(columns, 1), w.bounds


def _tallied(batches):
    schema = pa.schema([("bucket", pa.int32()), ("good", pa.int64()), ("bad", pa.int64())])
    total = np.zeros((2, ALL), np.int64)
    for x in runs(batches):
        quality = x["quality"].to_numpy()
        for first, part in chunks(texts_of(x["text"])):
            buckets, bounds = tokens(part)
            bad = np.repeat(quality[first : first + len(part)] == 0, np.diff(bounds))
            for k in (0, 1):
                total[k] += np.bincount(buckets[bad == k].ravel(), minlength=ALL)
    at = np.flatnonzero(total.any(0))
    yield batch(schema, at, total[0, at], total[1, at])


def _evidence(weights: np.ndarray, extra: list[pa.Field]):
    schema = pa.schema([*extra, pa.field("evidence", pa.float64())])

    def run(batches):
        for x in runs(batches):
            out = []
            for _, part in chunks(texts_of(x["text"])):
                buckets, bounds = tokens(part)
                run_ = np.concatenate([[0.0], np.cumsum(weights[buckets].sum(1))])
                n = np.diff(bounds)
                out += [float((run_[b] - run_[a]) / m) if m else None for a, b, m in zip(bounds[:-1], bounds[1:], n)]
            yield pa.RecordBatch.from_arrays([*(x[f.name] for f in extra), pa.array(out, pa.float64())], schema=schema)

    return run


def _logit(p: Column) -> Column:
    return F.log(p) - F.log(1 - p)


class QualityClassifier:
    """Fitted on labels(doc_id, quality); `classify` gives every row's verdict."""

    def __init__(self, docs: DataFrame, labels: DataFrame):
        # Until both kinds are seen, every document is good.
        self.weights, self.slope, self.shift, self.prior = np.zeros(ALL), 0.0, float(np.log(1e6)), 1.0
        labels = clash_free(labels, "doc_id", "quality").where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
        marked = clash_free(docs, "doc_id", "text").join(small(labels, labels.count(), BROADCAST_LABELS), "doc_id")
        fold = F.pmod(F.xxhash64("doc_id"), F.lit(5)) == 0
        tally = marked.where(~fold).mapInArrow(_tallied, "bucket int, good long, bad long").groupBy("bucket").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")).toPandas()
        good, bad = np.zeros(ALL), np.zeros(ALL)
        good[tally["bucket"]], bad[tally["bucket"]] = tally["good"], tally["bad"]
        for half in KINDS:
            # A bucket's ratio is shrunk toward 1 where its counts are few.
            g, b = good[half], bad[half]
            both = (g + b) / max(1.0, g.sum() + b.sum())
            self.weights[half] = np.log((g + 1 + 20 * both) / (g.sum() + len(g) + 20)) - np.log((b + 1 + 20 * both) / (b.sum() + len(b) + 20))
        seen = marked.where(fold).select("quality", "text").mapInArrow(_evidence(self.weights, [pa.field("quality", pa.int32())]), "quality int, evidence double").where("evidence is not null")
        low, high = -8.0, 8.0
        at = F.greatest(F.lit(0), F.least(F.lit(BINS - 1), F.floor((F.col("evidence") - low) / ((high - low) / BINS)))).alias("bin")
        bins = seen.groupBy(at, (F.col("quality") > 0).cast("int").alias("good")).agg(F.count("*").alias("n"), F.avg("evidence").alias("x")).toPandas()
        if bins["good"].nunique() == 2:
            self._fit(bins["x"].to_numpy(float), bins["good"].to_numpy(float), bins["n"].to_numpy(float))

    def _fit(self, x: np.ndarray, y: np.ndarray, n: np.ndarray) -> None:
        """Logistic fit by Newton steps, with a weak pull of the slope toward 0."""
        self.prior = float((y * n).sum() / n.sum())
        design, beta = np.stack([x, np.ones_like(x)], 1), np.array([1.0, 0.0])
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
            step = np.linalg.solve((design * (n * p * (1 - p))[:, None]).T @ design + np.diag([0.01, 1e-6]), design.T @ (n * (y - p)) - np.array([0.01, 0.0]) * beta)
            beta += np.clip(step, -5, 5)
        self.slope, self.shift = map(float, beta)

    def classify(self, docs: DataFrame, host: str = "source", path: str = "lang") -> DataFrame:
        """(doc_id, host, path, evidence, score, kept) of every row; score: the posterior that it is good."""
        return self._judged(docs, host, path, {}).select("doc_id", "host", "path", "evidence", "score", "kept")

    def kept(self, docs: DataFrame, host: str = "source", path: str = "lang") -> DataFrame:
        """The rows of docs that are kept, each by its own verdict, whether ids are null or repeat."""
        beside = {c: c if c in ("doc_id", "text") else f"_{c}" for c in docs.columns}
        return self._judged(docs, host, path, beside).where("kept").select(*[F.col(v).alias(c) for c, v in beside.items()])

    def _judged(self, docs: DataFrame, host: str, path: str, beside: dict[str, str]) -> DataFrame:
        """What `classify` gives, with columns of docs under other names, which go through Python with their rows.

        Rows with their texts are read again for the verdict; only evidence is kept between.
        """
        more = {v: c for c, v in beside.items() if c not in ("doc_id", "text")}
        rows = docs.select("doc_id", F.col(host).cast("string").alias("host"), F.col(path).cast("string").alias("path"), "text", *[F.col(c).alias(v) for v, c in more.items()])
        kinds = [f for f in rows.schema if f.name != "text" or beside]
        seen = rows.mapInArrow(_evidence(self.weights, [pa.field(f.name, to_arrow_type(f.dataType)) for f in kinds]), StructType(kinds).add("evidence", "double"))
        if not beside:
            seen = cut(seen)
        clamp = lambda c: F.least(F.greatest(c, F.lit(1e-6)), F.lit(1 - 1e-6))
        prior = min(max(self.prior, 1e-6), 1 - 1e-6)
        own = F.when(F.col("evidence").isNull(), F.lit(float(np.log(prior / (1 - prior))))).otherwise(F.col("evidence") * self.slope + self.shift)
        seen = seen.withColumn("odds", own).withColumn("p", 1 / (1 + F.exp(-F.col("odds"))))
        # Null hosts and paths are sites too.
        key = lambda c: F.when(F.col(c).isNull(), "").otherwise(F.concat(F.lit("="), c))
        seen = seen.withColumns({"_h": key("host"), "_q": key("path")})
        paths = cut(seen.groupBy("_h", "_q").agg(F.sum("p").alias("good"), F.sum(F.col("p") * F.col("p")).alias("squares"), F.count("*").alias("n")))
        hosts = paths.groupBy("_h").agg(F.sum("good").alias("host_good"), F.sum("squares").alias("host_squares"), F.sum("n").alias("host_n"))
        sites = cut(paths.join(hosts, "_h"))
        world, host_strength, path_strength = self._spread(sites, hosts)
        share = clamp(F.lit(world))
        p, n = F.col("p"), F.col("n")
        sums = sites.select("_h", "_q", "good", "n", "host_good", "host_n")
        out = seen.join(F.broadcast(sums), ["_h", "_q"]) if sums.count() <= BROADCAST_SITES else hot_join(seen, sums, ["_h", "_q"], "doc_id")
        host_share = (F.col("host_good") - p + host_strength * share) / (F.col("host_n") - 1 + host_strength)
        path_share = (F.col("good") - p + path_strength * host_share) / (n - 1 + path_strength)
        odds = F.col("odds") + _logit(clamp(path_share)) - _logit(share)
        return out.withColumn("score", 1 / (1 + F.exp(-odds))).withColumn("kept", F.col("score") >= 0.5)

    @staticmethod
    def _spread(sites: DataFrame, hosts: DataFrame) -> tuple[float, float, float]:
        """The share of all documents, and for how many documents it counts at a host, and the host's at a path."""
        within = lambda good, squares, n: F.sum(F.col(squares) - F.col(good) * F.col(good) / F.col(n))
        between = F.sum(F.col("n") * F.pow(F.col("good") / F.col("n") - F.col("host_good") / F.col("host_n"), 2))
        low = sites.agg(F.count("*").alias("k"), within("good", "squares", "n").alias("within"), between.alias("between"), F.sum(F.col("n") * F.col("n") / F.col("host_n")).alias("own")).first()
        n, good = F.col("host_n"), F.col("host_good")
        high = hosts.agg(F.count("*").alias("k"), F.sum("host_n").alias("n"), F.sum("host_good").alias("good"), within("host_good", "host_squares", "host_n").alias("within"), F.sum(good * good / n).alias("between"), F.sum(n * n).alias("own")).first()
        if not high["n"]:
            return 0.5, SAME, SAME
        total = float(high["n"])
        world = high["good"] / total

        def strength(within: float, free: float, between: float, parts: float, own: float) -> float:
            if free <= 0 or parts <= 0:
                return SAME
            s2 = max(within, 0.0) / free
            t2 = (between - parts * s2) / (total - own) if total > own else 0.0
            return min(SAME, max(s2, 1e-9) / t2) if t2 > 0 else SAME

        return (
            world,
            strength(high["within"], total - high["k"], high["between"] - total * world * world, high["k"] - 1, high["own"] / total),
            strength(low["within"], total - low["k"], low["between"], low["k"] - high["k"], low["own"]),
        )
