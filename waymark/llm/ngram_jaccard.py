"""N-gram Jaccard join by count vectors in R-trees.

A document's word shingles are hashed into groups; the counts of its groups are a point, and
the overlap of two sets is at most the sum of the coordinates' minima.  One tree over a whole
corpus would make every point visit much of it, so the tree's upper level is a directory that
can be shuffled:

1. Directory.  Two linked sets differ in at most d shingles, d fixed by the threshold and the
   size class, so of d + 1 or more groups at least one holds the same shingles in both.  Each
   set is filed under (class, group, content of the group), once per group; sets that meet
   nowhere are not linked.  A set with so many empty groups that the agreeing ones might all be
   empty is filed under its smallest shingles too (prefix filter), so no pair is lost.  There are
   more groups than d + 1, so linked sets agree in several; each set may leave as many but one
   of its subtrees, and leaves the largest: the smallest one that both share, neither leaves.
   Subtrees that then hold the same documents are one.
2. Families.  Only points, a few bytes each, travel here.  In each subtree the bound of summed
   minima is taken between its smallest document and every other; pairs that it lets through join
   documents to families.  Where a subtree's members still belong to several families, a packed
   R-tree over their points finds those that the bound joins.  Pairs that may be linked are in
   one family.
3. Leaves.  A family's sets meet once, whatever the number of subtrees it shares: an R-tree over
   finer points bounds, and the sets decide.  A search spreads from each document over those
   not reached yet, so a group of near copies takes one comparison each.  A family too large
   for one task is first joined to its smallest document (one comparison each, salted), and what
   then still has several components is dealt out in pairs of blocks.

Nulls, empty texts: an empty set, linked with nothing; a null id: component null.  A text with
fewer words than a shingle is one shingle.  Rows that share a doc_id are one document, linked if
any of its texts is.  Equal sets are collapsed before step 2.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from waymark.llm.common import Words, batch, chunks, clash_free, components, cut, discard, hot_join, mix, runs, signed, small, stored, texts_of, window_hash

_U = np.uint64
#: Least and most coordinates of a point, and shingles a coordinate stands for (random sets of so many
#: have a bound far below any threshold of near copies); members that a block of a subtree holds,
#: shingles that a block of a family holds; rows that are broadcast at most.
LEAST, MOST, EACH, BLOCK, BLOCK_SHINGLES, BROADCAST_ROWS = 32, 4096, 4, 4096, 500_000, 1_000_000
#: One group more than are needed for every so many differences.
SLACK = 4


def shingle_sets(texts: list[bytes], size: int) -> Iterator[np.ndarray]:
    """Each text's sorted distinct shingle hashes."""
    for _, run in chunks(texts):
        words = Words(run, lower=True)
        grams = window_hash(words.hash, size)
        for a, b in zip(words.bounds[:-1], words.bounds[1:]):
            n = int(b - a)
            yield np.unique(grams[a : b - size + 1]) if n >= size else window_hash(words.hash[a:b], n) if n else np.empty(0, np.uint64)


class Classes:
    """Size classes, and for each the groups that let one of them agree."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        self.first = [1]
        while self.first[-1] < 1 << 40:
            self.first.append(self.first[-1] * 3 // 2 + 1)
        self.starts = np.array(self.first)

    def differ(self, both: int) -> int:
        """The most shingles that two linked sets of so many together can differ in."""
        return both * (self.den - self.num) // (self.den + self.num)

    def of(self, n: int) -> list[tuple[int, int, int]]:
        """(class, differences, groups) under which a set of n is filed."""
        c = int(np.searchsorted(self.starts, n, "right")) - 1
        own = [c] + [c + 1] * (n * self.den >= self.num * self.first[c + 1])
        out = []
        for k in own:
            d = self.differ(2 * (self.first[k + 1] - 1))
            if d:
                out.append((k, d, d + 1 + max(1, d // SLACK)))
        return out

    def linked(self, common: int, a: int, b: int) -> bool:
        return self.den * common >= self.num * (a + b - common)

    def signatures(self, s: np.ndarray) -> Iterator[tuple[np.ndarray, int]]:
        """For each class of a set, what it is filed under, and how many of these it may leave."""
        mixed = mix(s + _U(0x5851F42D4C957F2D))
        for c, d, g in self.of(len(s)):
            group = ((s >> _U(32)) * _U(g)) >> _U(32)
            at = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
            out = mix(np.add.reduceat(mixed, at) + mix(group[at] + _U(c << 40)) * _U(3))
            # Of g groups d may differ, and of the others as many are empty as the set has empty ones.
            if len(at) <= d:
                prefix = len(s) - -(-len(s) * self.num // self.den) + 1
                out = np.concatenate([out, mix(mixed[:prefix] ^ _U(0xD1B54A32D192ED03 + c))])
            # 48 bits: a clash only makes one pair more to bound, and shorter keys are shuffled.
            yield out >> _U(16), max(0, len(at) - d - 1)


def _digests(size: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("point", pa.binary())])

    def run(batches):
        for x in runs(batches):
            n, points, d = [], [], np.zeros((x.num_rows, 2), np.uint64)
            for i, s in enumerate(shingle_sets(texts_of(x["text"]), size)):
                n.append(len(s))
                points.append(packed(counts(s)))
                d[i] = mix(s).sum(dtype=np.uint64), mix(s ^ _U(0xA0761D6478BD642F)).sum(dtype=np.uint64)
            yield batch(schema, x["doc_id"], n, signed(d[:, 0].copy()), signed(d[:, 1].copy()), points)

    return run


def _filed(size: int, num: int, den: int):
    """(sig, doc_id, file, spare): `file` is one class of one text, which may leave `spare` of its subtrees."""
    schema = pa.schema([("sig", pa.int64()), ("doc_id", pa.int64()), ("file", pa.int32()), ("spare", pa.int32())])

    def run(batches):
        classes = Classes(num, den)
        for x in runs(batches):
            ids, held, many = x["doc_id"].to_numpy(zero_copy_only=False).astype(np.int64), [], 0
            for i, s in enumerate(shingle_sets(texts_of(x["text"]), size)):
                if not len(s):
                    continue
                own = int(mix(s).sum(dtype=np.uint64) & _U(0x3FFFFFFF))
                for k, (sigs, spare) in enumerate(classes.signatures(s)):
                    held.append((signed(sigs), np.full(len(sigs), ids[i]), np.full(len(sigs), 2 * own + k, np.int64).astype(np.int32), np.full(len(sigs), spare, np.int32)))
                    many += len(sigs)
                if many > 200_000:
                    yield batch(schema, *map(np.concatenate, zip(*held)))
                    held, many = [], 0
            if many:
                yield batch(schema, *map(np.concatenate, zip(*held)))

    return run


def _shared(batches):
    """Of rows sorted by sig, those whose sig has another row."""
    schema = pa.schema([("sig", pa.int64()), ("doc_id", pa.int64()), ("file", pa.int32()), ("spare", pa.int32())])
    last, open_ = None, False
    for x in batches:
        if not x.num_rows:
            continue
        x = x.select(schema.names)
        if last is not None:
            x = pa.Table.from_batches([last, x]).combine_chunks().to_batches()[0]
        sig = x["sig"].to_numpy()
        same = sig[1:] == sig[:-1]
        keep = np.concatenate([[open_], same]) | np.concatenate([same, [False]])
        # The last row waits for the next batch; what it belongs to is known if it continues a run.
        if keep[:-1].any():
            yield batch(schema, *(c.to_numpy()[:-1][keep[:-1]] for c in x.columns))
        last, open_ = x.slice(len(sig) - 1), bool(keep[-1])
    if open_:
        yield batch(schema, *(c.to_numpy() for c in last.columns))


def dims_for(n: int) -> int:
    """Coordinates of a set of n: a power of two."""
    return min(MOST, max(LEAST, 1 << max(0, (n // EACH) - 1).bit_length()))


def counts(s: np.ndarray, dims: int = 0) -> np.ndarray:
    dims = dims or dims_for(len(s))
    return np.bincount((s & _U(dims - 1)).astype(np.intp), minlength=dims)


def packed(point: np.ndarray) -> bytes:
    """A byte a coordinate where that is enough, else four; the first byte tells."""
    wide = bool(point.max() > 255)
    return bytes([wide]) + point.astype(np.int32 if wide else np.uint8).tobytes()


def unpacked(points: list[bytes]) -> np.ndarray:
    """A row a point.  Groups are named by low bits, so adding the halves of a point of more
    coordinates gives it in fewer: all come in those of the least."""
    rows = [np.frombuffer(x, np.int32 if x[0] else np.uint8, offset=1) for x in points]
    dims = min(map(len, rows))
    return np.stack([x.reshape(-1, dims).sum(0, dtype=np.int32) if len(x) > dims else x.astype(np.int32) for x in rows])


def _bounded(num: int, den: int):
    """Of pairs with both points, those whose summed minima let the overlap reach the threshold."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        for x in batches:
            keep = np.zeros(x.num_rows, bool)
            for i, pair in enumerate(zip(x["p"].to_pylist(), x["q"].to_pylist())):
                p, q = unpacked(pair)
                most = int(np.minimum(p, q).sum())
                keep[i] = den * most >= num * (int(p.sum() + q.sum()) - most)
            yield batch(schema, x["a"].to_numpy()[keep], x["b"].to_numpy()[keep])

    return run


class CountTree:
    """A packed R-tree over count vectors; children halve their parent at its widest coordinate."""

    LEAF = 32

    def __init__(self, points: np.ndarray, classes: Classes):
        self.points, self.sizes, self.classes = points, points.sum(1), classes
        self.root = self._pack(np.arange(len(points)))

    def _pack(self, rows: np.ndarray):
        box = self.points[rows]
        head = (box.max(0), int(self.sizes[rows].min()), int(self.sizes[rows].max()))
        if len(rows) <= self.LEAF:
            return head, rows, None
        order = rows[np.argsort(box[:, np.argmax(np.ptp(box, axis=0))], kind="stable")]
        half = len(order) // 2
        return head, None, (self._pack(order[:half]), self._pack(order[half:]))

    def near(self, point: np.ndarray) -> np.ndarray:
        """Rows whose overlap with the point, bounded by summed minima, may reach the threshold."""
        n, c, found, todo = int(point.sum()), self.classes, [], [self.root]
        while todo:
            (most, least_n, most_n), rows, children = todo.pop()
            if c.den * most_n < c.num * n or c.den * n < c.num * least_n:
                continue
            bound = int(np.minimum(point, most).sum())
            if not c.linked(bound, n, max(least_n, bound)):
                continue
            if children:
                todo += children
                continue
            bounds = np.minimum(point, self.points[rows]).sum(1)
            found.append(rows[c.den * bounds >= c.num * (n + self.sizes[rows] - bounds)])
        return np.concatenate(found) if found else np.empty(0, np.intp)


def _common(a: np.ndarray, b: np.ndarray) -> int:
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum()) if len(b) else 0


def _visits(size: int):
    schema = pa.schema([("key", pa.int64()), ("salt", pa.int64()), ("kind", pa.int32()), ("component", pa.int64()), ("doc_id", pa.int64()), ("set", pa.binary())])

    def run(batches):
        for x in runs(batches):
            ids, lists, rows, held = x["doc_id"].to_pylist(), x["visits"].to_pylist(), [], 0
            for i, s in enumerate(shingle_sets(texts_of(x["text"]), size)):
                # A set goes to every block of its family: of a large one, many times what a batch may hold.
                for v in lists[i]:
                    rows.append((v["key"], v["salt"], v["kind"], v["component"], ids[i], s.tobytes()))
                    held += 8 * len(s)
                    if held > 2 << 20:
                        yield batch(schema, *map(list, zip(*rows)))
                        rows, held = [], 0
            if rows:
                yield batch(schema, *map(list, zip(*rows)))

    return run


def _entries(num: int, den: int):
    """Links of rows sorted by (key, salt, kind): those of kind 0 are the entry's own texts."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        classes, at, heads = Classes(num, den), None, []
        for x in batches:
            a, b = [], []
            for key, salt, kind, doc, data in zip(*(x[c].to_pylist() for c in ("key", "salt", "kind", "doc_id", "set"))):
                s = np.frombuffer(data, np.uint64)
                if (key, salt) != at:
                    at, heads = (key, salt), []
                if kind == 0:
                    heads.append((s, counts(s)))
                    continue
                point = counts(s)
                for h, hp in heads:
                    if classes.linked(int(np.minimum(point, hp).sum()), len(h), len(s)) and classes.linked(_common(s, h), len(h), len(s)):
                        a.append(key)
                        b.append(doc)
                        break
            yield batch(schema, a, b)

    return run


def _spanning(labels: np.ndarray, near, linked) -> Iterator[tuple[int, int]]:
    """Linked pairs that join the labels as all linked pairs would.

    near(i): rows that may be linked with row i.  Rows of one label are joined already.  The search
    goes on from every row that it reaches, and looks only at rows that it has not reached.
    """
    order = np.argsort(labels, kind="stable")
    cuts = np.flatnonzero(np.diff(labels[order])) + 1
    group = dict(zip(labels[order[np.concatenate([[0], cuts])]].tolist(), np.split(order, cuts)))
    left, many = np.ones(len(labels), bool), len(labels)
    for seed in list(group):
        if not left[group[seed][0]]:
            continue
        todo = [group[seed]]
        left[group[seed]] = False
        many -= len(group[seed])
        while todo and many:
            for i in todo.pop():
                if not many:
                    break
                found = near(i)
                for j in found[left[found]]:
                    if left[j] and linked(i, j):
                        yield i, j
                        own = group[int(labels[j])]
                        left[own] = False
                        many -= len(own)
                        todo.append(own)


def _pairs(ids: np.ndarray, found: list[tuple[int, int]]) -> pa.Table:
    x, y = (ids[np.array(c, np.intp)] for c in zip(*found)) if found else (ids[:0], ids[:0])
    return pa.table([pa.array(np.minimum(x, y), pa.int64()), pa.array(np.maximum(x, y), pa.int64())], ["a", "b"])


def _subtree(num: int, den: int):
    """Of a subtree's block or two, pairs within the bound that join its members' families."""

    def run(table: pa.Table) -> pa.Table:
        points = unpacked(table["point"].to_pylist())
        tree = CountTree(points, Classes(num, den))
        return _pairs(table["doc_id"].to_numpy(), list(_spanning(table["family"].to_numpy(), lambda i: tree.near(points[i]), lambda i, j: True)))

    return run


def _family(num: int, den: int, every: bool):
    """Of a family's block or two, links that join its components, or every link."""

    def run(table: pa.Table) -> pa.Table:
        classes, ids = Classes(num, den), table["doc_id"].to_numpy()
        sets = [np.frombuffer(x, np.uint64) for x in table["set"].to_pylist()]
        dims = dims_for(int(np.median([len(s) for s in sets])))
        points = np.stack([counts(s, dims).astype(np.int32) for s in sets])
        tree = CountTree(points, classes)
        linked = lambda i, j: classes.linked(_common(sets[i], sets[j]), len(sets[i]), len(sets[j]))
        if every:
            found = [(i, j) for i in range(len(ids)) for j in tree.near(points[i]) if ids[i] < ids[j] and linked(i, j)]
        else:
            found = list(_spanning(table["component"].to_numpy(), lambda i: tree.near(points[i]), linked))
        return _pairs(ids, found)

    return run


class NgramJaccardJoin:
    """The join of a corpus with itself: `nodes`, `links` and `classes()` after `run()`.

    num / den: the least Jaccard similarity of a link.
    """

    def __init__(self, size: int = 5, num: int = 8, den: int = 10):
        self.size, self.num, self.den = size, num, den

    def directory(self, docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        """nodes(doc_id, n, rep) of all rows, points(doc_id, point) of the sets, members(sig, doc_id,
        entry, many) of subtrees with several documents, of which entry is the smallest."""
        docs = clash_free(docs, "doc_id", "text")
        raw = cut(docs.mapInArrow(_digests(self.size), "doc_id long, n long, d1 long, d2 long, point binary"))
        reps = raw.where("n > 0 and doc_id is not null").groupBy("n", "d1", "d2").agg(F.min("doc_id").alias("rep"))
        nodes = cut(hot_join(raw.drop("point"), reps, ["n", "d1", "d2"], "doc_id", "left").select("doc_id", "n", F.when(F.col("doc_id").isNotNull(), F.coalesce("rep", "doc_id")).alias("rep")))
        # A document goes only if all texts under its id are copies of smaller documents'.
        copies = cut(nodes.where("doc_id is not null").groupBy("doc_id").agg(F.bool_and(F.col("rep") < F.col("doc_id")).alias("copy")).where("copy").select("doc_id"))
        own = docs.where("doc_id is not null").join(small(copies, copies.count(), BROADCAST_ROWS), "doc_id", "left_anti")
        filed = own.select("doc_id", "text").mapInArrow(_filed(self.size, self.num, self.den), "sig long, doc_id long, file int, spare int")
        met = stored(filed.repartition("sig").sortWithinPartitions("sig").mapInArrow(_shared, "sig long, doc_id long, file int, spare int"))
        sizes = met.groupBy("sig").agg(F.count("*").alias("rows"))
        largest = W.partitionBy("doc_id", "file").orderBy(F.desc("rows"), "sig")
        stay = stored(hot_join(met, sizes, ["sig"], "doc_id").withColumn("place", F.row_number().over(largest)).where("place > spare").select("sig", "doc_id").distinct())
        # Subtrees of the same documents are one: it is known by its members' least, number and 128 bits of their hashes.
        known = [F.min("doc_id").alias("entry"), F.count("*").alias("many"), *[F.bit_xor(F.xxhash64("doc_id", F.lit(k))).alias(f"h{k}") for k in (0, 1)]]
        entries = stay.groupBy("sig").agg(*known).where("many > 1").groupBy("entry", "many", "h0", "h1").agg(F.min("sig").alias("sig")).drop("h0", "h1")
        members = stored(hot_join(stay, entries, ["sig"], "doc_id"))
        discard(met, stay)
        return nodes, raw.where("n > 0").select("doc_id", "point").distinct(), members

    def _bounded(self, pairs: DataFrame, points: DataFrame) -> DataFrame:
        left = hot_join(cut(pairs), points.select(F.col("doc_id").alias("a"), F.col("point").alias("p")), ["a"], "b")
        return left.join(points.select(F.col("doc_id").alias("b"), F.col("point").alias("q")), "b").mapInArrow(_bounded(self.num, self.den), "a long, b long")

    @staticmethod
    def _cells(rows: DataFrame, key: str) -> DataFrame:
        """rows(key, blocks, ...) dealt out in `cell`s: each pair of a key's blocks is one."""
        own = rows.withColumn("own", F.pmod(F.xxhash64("doc_id", key), "blocks"))
        cell = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda other: F.least(other, F.col("own")) * F.col("blocks") + F.greatest(other, F.col("own")))
        return own.withColumn("cell", F.explode(cell)).drop("own", "blocks")

    def families(self, points: DataFrame, members: DataFrame) -> DataFrame:
        """(doc_id, family) of the documents that the bound joins to others."""
        near = cut(self._bounded(members.where("entry < doc_id").select(F.col("entry").alias("a"), F.col("doc_id").alias("b")).distinct(), points).distinct())
        found = cut(components(near))
        rows = found.count()
        mine = members.join(small(found.withColumnRenamed("id", "doc_id"), rows, BROADCAST_ROWS), "doc_id", "left").select("sig", "doc_id", "entry", "many", F.coalesce("component", "doc_id").alias("family"))
        theirs = mine.join(small(found.withColumnRenamed("id", "entry"), rows, BROADCAST_ROWS), "entry", "left").where(F.coalesce("component", "entry") != F.col("family"))
        open_ = cut(theirs.select("sig").distinct())
        # Two members have been compared already; of more, only pairs with the first.
        rest = mine.where("many > 2").join(small(open_, open_.count(), BROADCAST_ROWS), "sig", "left_semi").select("sig", "doc_id", "family", F.ceil(F.col("many") / BLOCK).alias("blocks"))
        cells = self._cells(rest, "sig").join(points, "doc_id")
        more = cut(cells.groupBy("sig", "cell").applyInArrow(_subtree(self.num, self.den), "a long, b long").distinct())
        if not more.isEmpty():
            found = cut(components(near.union(more)))
        return found.select(F.col("id").alias("doc_id"), F.col("component").alias("family"))

    def _sets(self, text: DataFrame, visits: DataFrame) -> DataFrame:
        """The set of each of visits(doc_id, key, salt, kind, component), from the texts."""
        lists = cut(visits.groupBy("doc_id").agg(F.collect_list(F.struct("key", "salt", "kind", "component")).alias("visits")))
        values = lists.agg(F.sum(F.size("visits"))).first()[0] or 0
        return text.join(small(lists, values, BROADCAST_ROWS), "doc_id").select("doc_id", "visits", "text").mapInArrow(_visits(self.size), "key long, salt long, kind int, component long, doc_id long, set binary")

    def _to_smallest(self, text: DataFrame, members: DataFrame) -> DataFrame:
        """Links of members(family, doc_id) with their family's smallest; each 4096 get a copy of its set."""
        none = F.lit(0).cast("long").alias("component")
        salts = members.groupBy("family").agg(F.ceil(F.count("*") / 4096).alias("salts"))
        partners = members.where("family < doc_id").join(salts, "family").select("doc_id", F.col("family").alias("key"), F.pmod(F.xxhash64("doc_id"), "salts").alias("salt"), F.lit(1).alias("kind"), none)
        heads = salts.select(F.col("family").alias("doc_id"), F.col("family").alias("key"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("kind"), none)
        met = self._sets(text, partners.union(heads)).repartition("key", "salt").sortWithinPartitions("key", "salt", "kind")
        return cut(met.mapInArrow(_entries(self.num, self.den), "a long, b long").distinct())

    def _linked(self, docs: DataFrame, every: bool) -> tuple[DataFrame, DataFrame]:
        """(nodes, links): links of distinct sets, all or as many as join their components."""
        nodes, points, members = self.directory(docs)
        text = clash_free(docs, "doc_id", "text").where("doc_id is not null")
        sizes = nodes.where("rep = doc_id").select("doc_id", "n").distinct()
        own = self.families(cut(points), members).join(sizes, "doc_id")
        own = cut(own)
        discard(members)
        own = cut(own.join(own.groupBy("family").agg(F.ceil(F.sum("n") / BLOCK_SHINGLES).alias("blocks")), "family"))
        first = own.where("false").select(F.col("family").alias("a"), F.col("doc_id").alias("b"))
        large = own.where("blocks > 1")
        own = own.withColumn("component", F.col("doc_id"))
        if not every and not large.isEmpty():
            first = self._to_smallest(text, large.select("family", "doc_id"))
            found = components(first).select(F.col("id").alias("doc_id"), F.col("component").alias("joined"))
            own = own.join(found, "doc_id", "left").withColumn("component", F.coalesce("joined", "doc_id")).drop("joined")
            open_ = own.groupBy("family").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x < y").select("family")
            own = own.join(open_, "family")
        visits = self._cells(own, "family").select("doc_id", F.col("family").alias("key"), F.col("cell").alias("salt"), F.lit(1).alias("kind"), "component")
        links = self._sets(text, visits).groupBy("key", "salt").applyInArrow(_family(self.num, self.den, every), "a long, b long")
        return nodes, cut(links.distinct()).union(first)

    def run(self, docs: DataFrame) -> DataFrame:
        """(doc_id, n_shingles, component_id) of every row of docs(doc_id, text)."""
        nodes, links = self._linked(docs, every=False)
        # Copies take their representative's component; only ids with different texts join some.
        several = nodes.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).where("a < b").drop("b")
        same = nodes.join(several, "doc_id").select("a", F.col("rep").alias("b")).where("a < b")
        found = cut(components(links.union(same))).withColumnRenamed("id", "rep")
        out = hot_join(nodes, found, ["rep"], "doc_id", "left")
        return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "rep").alias("component_id"))

    def links(self, docs: DataFrame) -> DataFrame:
        """All links (a, b), a < b, between the smallest documents of distinct sets."""
        return self._linked(docs, every=True)[1].distinct()


def one_of_each(docs: DataFrame, size: int = 5, num: int = 8, den: int = 10) -> DataFrame:
    """docs without the near copies: of each component the document with the smallest id stays."""
    joined = NgramJaccardJoin(size, num, den).run(docs)
    gone = joined.where("component_id < doc_id").select("doc_id").distinct()
    gone = cut(gone)
    return docs.join(small(gone, gone.count(), BROADCAST_ROWS), "doc_id", "left_anti").select(*docs.columns)
