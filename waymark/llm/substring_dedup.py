"""Substring dedup by prefix-partitioned suffix trees, cut at the depth of a window.

A suffix of a document's word sequence, cut after `window` words, is a way down the suffix tree
to that depth; a node there with leaves of several documents is a repeat, and runs of such nodes at
consecutive suffixes of one document are its maximal repeats.

1. Candidates.  The least hash among the `gram`-word grams of a suffix's window names it (equal
   windows, equal names; about one name for every 17 words).  Each document's names are
   counted over all documents; suffixes whose name one document alone has cannot repeat and go into no tree.
2. Prefix partition.  A suffix's path is a number whose leading bits hash its first 4 words, the
   next ones its first 8, then 16, then 32.  Suffixes are counted by their first 4 words; a prefix of more than
   GROUP suffixes (or as many as leave MOST_PREFIXES such prefixes) is lengthened, level by level, last to the
   whole window, so groups have the size of a task's memory.
3. Subtrees.  A group sorted by (path, window, document) is its subtree in depth-first order: a node is a run of
   rows with one beginning, and the deep ones, of `window` words, stream by with one
   node's state in memory.  Before, a task joins equal windows of its own documents: all leaves of a node
   but the first document's are marked at once, so however common a passage is, a task sends
   each of its windows on at most once for every HELD suffixes.
4. Removal.  A leaf of a later document than its node's first marks its window's words; marks
   come back as intervals of starts, are gathered per document (bounded by its length) and
   applied to the text.

A document whose words equal those of one with a smaller id is not put into any tree: it is
marked whole if it has a window at all.  Windows are judged on the input.  Null texts have no
words; a row with a null id neither removes nor loses anything; rows of one id do not remove
each other's words (marks carry a tag of the text, so different texts under one id do not mix).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm.common import Words, batch, beside, chunks, clash_free, cut, discard, hot_join, mix, runs, signed, small, stored, texts_of, window_hash

_U = np.uint64
WINDOW, GRAM = 50, 19
#: Bytes of names or intervals that are broadcast at most; beyond, texts are shuffled to them.  Bytes of a
#: row, a name and an interval.
BROADCAST_BYTES, ROW, NAME, INTERVAL = 48 << 20, 48, 8, 40
#: Suffixes that a task joins before it sends them on.
HELD = 1_000_000
#: Marks that a task turns into Python's own objects at once (those of one document at least).
MARKS = 20_000
#: Words of a path's levels and the bits that hash them; suffixes of a group, and longer prefixes at most.
LEVELS, GROUP, MOST_PREFIXES = ((4, 24), (8, 16), (16, 12), (32, 12)), 1 << 14, 500_000


def _least(x: np.ndarray, k: int) -> np.ndarray:
    """Minimum of every k consecutive values."""
    have, out = 1, x
    while have < k:
        step = min(have, k - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out


class Suffixes:
    """Of each document in a run: words, digest, and its suffixes' windows and groups."""

    def __init__(self, run: list[bytes], window: int, gram: int):
        self.words = w = Words(run)
        self.bounds, self.window = w.bounds, window
        self.windows = window_hash(w.hash, window)
        grams = window_hash(w.hash, gram)
        self.groups = _least(grams, window - gram + 1) if len(w.hash) >= window else grams[:0]
        other = mix(w.hash ^ _U(0xC2B2AE3D27D4EB4F))
        self.digests = []
        for a, b in zip(w.bounds[:-1], w.bounds[1:]):
            n = int(b - a)
            self.digests.append((int(window_hash(w.hash[a:b], n)[0]), int(window_hash(other[a:b], n)[0])) if n else (0, 0))

    def paths(self) -> np.ndarray:
        """Of every suffix with a whole window, the hashes of its prefixes behind each other."""
        out = np.zeros(len(self.windows), np.uint64)
        for n, bits in LEVELS:
            # A window shorter than a level is a prefix itself.
            prefix = window_hash(self.words.hash, min(n, self.window))[: len(out)]
            out = (out << _U(bits)) | (prefix >> _U(64 - bits))
        return out

    def span(self, i: int) -> slice:
        a, b = int(self.bounds[i]), int(self.bounds[i + 1])
        return slice(a, max(a, b - self.window + 1))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _tag(digest: tuple[int, int]) -> int:
    return digest[0] & 0x7FFFFFFF


def _named(window: int, gram: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("groups", pa.list_(pa.int64()))])

    def run(batches):
        for x in runs(batches):
            n, d1, d2, groups = [], [], [], []
            for _, part in chunks(texts_of(x["text"])):
                s = Suffixes(part, window, gram)
                n += np.diff(s.bounds).tolist()
                for i, (a, b) in enumerate(s.digests):
                    d1.append(_signed(a))
                    d2.append(_signed(b))
                    groups.append(signed(np.unique(s.groups[s.span(i)])))
            yield batch(schema, x["doc_id"], n, d1, d2, groups)

    return run


def _repeated(batches):
    """Of rows sorted by group, those whose group has a row of another document."""
    schema = pa.schema([("doc_id", pa.int64()), ("group", pa.int64())])
    g, d, open_ = np.empty(0, np.int64), np.empty(0, np.int64), False
    for x in batches:
        g, d = np.concatenate([g, x["group"].to_numpy()]), np.concatenate([d, x["doc_id"].to_numpy()])
        same = g[1:] == g[:-1]
        keep = np.concatenate([[open_], same]) | np.concatenate([same, [False]])
        yield batch(schema, d[:-1][keep[:-1]], g[:-1][keep[:-1]])
        g, d, open_ = g[-1:], d[-1:], bool(keep[-1])
    if open_:
        yield batch(schema, d, g)


_LEAF = pa.schema([("path", pa.int64()), ("window", pa.int64()), ("doc_id", pa.int64()), ("at", pa.int64()), ("last", pa.int64())])


def _intervals(doc: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of consecutive places of one document: (document, first, last)."""
    order = np.lexsort((at, doc))
    doc, at = doc[order], at[order]
    start = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (at[1:] != at[:-1] + 1)])) if len(doc) else np.empty(0, np.intp)
    end = np.append(start[1:], len(doc)) - 1 if len(doc) else start
    return doc[start], at[start], at[end]


def _joined(held: list[tuple]):
    """Leaves of each node's first document, with last = -1; marked intervals of the others."""
    columns = [np.concatenate(c) for c in zip(*held)]
    held.clear()
    order = np.lexsort((columns[2], columns[1], columns[0]))
    for k in range(len(columns)):
        columns[k] = columns[k][order]
    path, window, doc, at = columns
    del columns, order
    node = np.concatenate([[True], (path[1:] != path[:-1]) | (window[1:] != window[:-1])])
    owner = doc[np.maximum.accumulate(np.where(node, np.arange(len(doc)), 0))]
    first, later = np.flatnonzero(doc == owner), doc > owner
    del node, owner
    for i in range(0, len(first), 50_000):
        part = first[i : i + 50_000]
        yield batch(_LEAF, path[part], window[part], doc[part], at[part], np.full(len(part), -1))
    del path, window, first
    doc, start, end = _intervals(doc[later], at[later])
    if len(doc):
        # Marks only travel along; their documents deal them out.
        yield batch(_LEAF, signed(mix(doc.astype(np.uint64))), np.zeros(len(doc), np.int64), doc, start, end)


def _grown(window: int, gram: int):
    def run(batches):
        out, many = [], 0
        for x in runs(batches):
            ids, names = x["doc_id"].to_pylist(), x["groups"]
            for first, part in chunks(texts_of(x["text"])):
                s = Suffixes(part, window, gram)
                paths = signed(s.paths())
                for i in range(len(part)):
                    span = s.span(i)
                    wanted = names[first + i].values.to_numpy()
                    hit = np.flatnonzero(np.isin(signed(s.groups[span]), wanted))
                    if len(hit):
                        out.append((paths[span][hit], signed(s.windows[span])[hit], np.full(len(hit), ids[first + i]), hit + (_tag(s.digests[i]) << 32)))
                        many += len(hit)
            if many >= HELD:
                yield from _joined(out)
                out, many = [], 0
        if many:
            yield from _joined(out)

    return run


def _nodes(batches):
    """Intervals of suffixes that are leaves of a deep node which an earlier document has too."""
    schema = pa.schema([("doc_id", pa.int64()), ("tag", pa.int64()), ("first", pa.int64()), ("last", pa.int64())])
    node, owner = None, 0
    for x in batches:
        g, w, d, at, last = (x[c].to_numpy() for c in ("path", "window", "doc_id", "at", "last"))
        marks = last >= 0
        found = [(d[marks], at[marks], last[marks])]
        g, w, d, at = (c[~marks] for c in (g, w, d, at))
        if len(g):
            new = np.concatenate([[(g[0], w[0]) != node], (g[1:] != g[:-1]) | (w[1:] != w[:-1])])
            lead = np.maximum.accumulate(np.where(new, np.arange(len(g)), -1))
            owners = np.where(lead >= 0, d[lead], owner)
            node, owner = (g[-1], w[-1]), owners[-1]
            late = d > owners
            found.append(_intervals(d[late], at[late]))
        d, first, last = (np.concatenate(c) for c in zip(*found))
        if len(d):
            yield batch(schema, d, first >> 32, first & 0xFFFFFFFF, last & 0xFFFFFFFF)


def _merged(batches):
    """Marks of each document, overlapping and adjacent intervals as one."""
    kind = pa.struct([("tag", pa.int64()), ("first", pa.int64()), ("last", pa.int64())])
    schema = pa.schema([("doc_id", pa.int64()), ("marks", pa.list_(kind))])
    for x in runs(batches, "marks", MARKS):
        out = []
        for marks in x["marks"].to_pylist():
            own = []
            for tag, first, last in sorted((m["tag"], m["first"], m["last"]) for m in marks):
                if own and own[-1]["tag"] == tag and first <= own[-1]["last"] + 1:
                    own[-1]["last"] = max(last, own[-1]["last"])
                else:
                    own.append({"tag": tag, "first": first, "last": last})
            out.append(own)
        yield batch(schema, x["doc_id"], pa.array(out, pa.list_(kind)))


def _few(lists: DataFrame, column: str, each: int) -> DataFrame:
    """lists(doc_id, column), for broadcast if its bytes allow."""
    shape = lists.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.size(column)), F.lit(0)).alias("values")).first()
    return small(lists, ROW * shape["rows"] + each * shape["values"], BROADCAST_BYTES)


def _left(x: pa.RecordBatch, window: int, gram: int):
    """Of each row of x(text, marks): its number of words, and those that stay."""
    marks = x["marks"].to_pylist()
    for first, part in chunks(texts_of(x["text"])):
        words = None
        for i, text in enumerate(part):
            own = text.split()
            n, mine = len(own), marks[first + i] or []
            if mine:
                words = words or Suffixes(part, window, gram)
                tag = _tag(words.digests[i])
                edge = np.zeros(n + 1, np.int64)
                for m in mine:
                    if m["tag"] == tag:
                        edge[m["first"]] += 1
                        edge[m["last"] + window] -= 1
                stay = np.cumsum(edge[:-1]) == 0
                own = [own[k] for k in np.flatnonzero(stay)]
            yield n, own


def _applied(window: int, gram: int):
    def run(batches):
        for x in runs(batches):
            n_words, n_removed, kept = [], [], []
            for n, own in _left(x, window, gram):
                n_words.append(n)
                n_removed.append(n - len(own))
                kept.append(b" ".join(own))
            rest = [x.column(c) for c in x.schema.names if c not in ("marks", "text")]
            names = [c for c in x.schema.names if c not in ("marks", "text")]
            sha = [hashlib.sha256(k).hexdigest() for k in kept]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(sha), pa.array([k.decode() for k in kept])], [*names, "n_words", "n_removed", "kept_sha256", "kept"])

    return run


def _cleaned(window: int, gram: int):
    """Rows with their texts, as they were or without their repeats; a text goes to Python once and comes back once."""

    def run(batches):
        for x in runs(batches):
            kept, n_left = [], []
            for n, own in _left(x, window, gram):
                changed = len(own) < n
                kept.append(b" ".join(own).decode() if changed else None)
                n_left.append(len(own) if changed else None)
            text, left = x["text"], pa.array(n_left, pa.int64())
            if left.null_count < len(left):
                text = pc.if_else(left.is_null(), text, pa.array(kept, text.type))
            columns = {c: text if c == "text" else x.column(c) for c in x.schema.names if c != "marks"}
            yield pa.RecordBatch.from_arrays([*columns.values(), left], [*columns, "_left"])

    return run


class SubstringDedup:
    def __init__(self, window: int = WINDOW, gram: int = GRAM):
        self.window, self.gram = window, gram

    @staticmethod
    def _grouped(leaves: DataFrame) -> DataFrame:
        """leaves with `group`, the shortest prefix of their path that few enough share."""
        most = max(GROUP, leaves.count() // MOST_PREFIXES)
        group, shift, rest = None, 64, leaves.where("last < 0")
        for level, (_, bits) in enumerate(LEVELS):
            shift -= bits
            prefix = F.shiftrightunsigned("path", shift) if shift else F.col("path")
            name = f"long{level}"
            # At most MOST_PREFIXES rows: each stands for more than `most` of the leaves.
            large = cut(rest.groupBy(prefix.alias(name)).agg(F.count("*").alias("n")).where(F.col("n") > most).select(name))
            here = F.xxhash64(F.lit(level), prefix)
            if large.isEmpty():
                return leaves.withColumn("group", here if group is None else group.otherwise(here))
            leaves = leaves.join(F.broadcast(large), prefix == F.col(name), "left")
            rest = rest.join(F.broadcast(large), prefix == F.col(name), "left_semi")
            group = (F if group is None else group).when(F.col(name).isNull(), here)
        return leaves.withColumn("group", group.otherwise(F.xxhash64("path", "window")))

    def marks(self, docs: DataFrame) -> DataFrame:
        """(doc_id, marks): intervals of window starts to remove, of each document that has any."""
        docs = clash_free(docs, "doc_id", "text").where("doc_id is not null")
        named = cut(docs.mapInArrow(_named(self.window, self.gram), "doc_id long, n_words long, d1 long, d2 long, groups array<long>").where(F.col("n_words") >= self.window))
        firsts = named.groupBy("n_words", "d1", "d2").agg(F.min("doc_id").alias("owner"))
        named = hot_join(named, firsts, ["n_words", "d1", "d2"], "doc_id")
        tag = F.col("d1").bitwiseAND(F.lit(0x7FFFFFFF))
        copies = named.where("owner < doc_id").select("doc_id", tag.alias("tag"), F.lit(0).cast("long").alias("first"), (F.col("n_words") - self.window).alias("last"))
        spread = named.where("owner = doc_id").select("doc_id", F.explode("groups").alias("group"))
        shared = spread.repartition("group").sortWithinPartitions("group").mapInArrow(_repeated, "doc_id long, group long")
        wanted = cut(shared.groupBy("doc_id").agg(F.collect_set("group").alias("groups")))
        leaves = stored(docs.join(_few(wanted, "groups", NAME), "doc_id").mapInArrow(_grown(self.window, self.gram), "path long, window long, doc_id long, at long, last long"))
        grouped = self._grouped(leaves).repartition("group").sortWithinPartitions("group", "path", "window", "doc_id")
        found = grouped.mapInArrow(_nodes, "doc_id long, tag long, first long, last long")
        lists = found.union(copies).groupBy("doc_id").agg(F.collect_list(F.struct("tag", "first", "last")).alias("marks"))
        marks = cut(lists.mapInArrow(_merged, "doc_id long, marks array<struct<tag:bigint,first:bigint,last:bigint>>"))
        discard(leaves)
        return marks

    def run(self, docs: DataFrame) -> DataFrame:
        """(doc_id, n_words, n_removed, kept_sha256, kept: words joined by a space) of docs(doc_id, text)."""
        return self._through(clash_free(docs, "doc_id", "text"), _applied, ("marks", "text"), "n_words long, n_removed long, kept_sha256 string, kept string")

    def cleaned(self, docs: DataFrame) -> DataFrame:
        """docs, whose other columns have names of their own, with what is left of their texts; `_left` counts its words where any went."""
        return self._through(docs, _cleaned, ("marks",), "_left long")

    def _through(self, docs: DataFrame, applied, gone: tuple[str, ...], more: str) -> DataFrame:
        """docs with their marks through `applied`, which gives their columns but for `gone`, and more."""
        marks = self.marks(docs)
        both = docs.join(_few(marks, "marks", INTERVAL).withColumnRenamed("doc_id", "_d"), F.col("doc_id") == F.col("_d"), "left").drop("_d")
        kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in both.schema if f.name not in gone)
        return both.mapInArrow(applied(self.window, self.gram), f"{kinds}, {more}")


def without_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs with repeated windows cut out of the texts; those of which nothing is left are dropped."""
    columns, kinds = docs.columns, docs.schema
    docs, names = beside(docs, "doc_id", "text", "n_chars")
    out = SubstringDedup(window).cleaned(docs).where("_left is null or _left > 0")
    if "n_chars" in columns:
        out = out.withColumn("n_chars", F.when(F.col("_left") > 0, F.length("text").cast(kinds["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*[F.col(n).alias(c) for n, c in zip(names, columns)])
