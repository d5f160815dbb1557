"""LM scoring by the marginal likelihood of subword lattices.

The pieces of an existing vocabulary, with unigram scores, span a lattice over each word (led by
the space mark); a forward recursion in log space sums all segmentations.  The whole word is one
more edge, weighted by its training count less a discount; the discounted mass weighs the
pieces' paths.  A document's probability is the product over its words, then an end token:

    P(word) = max(c - D, 0) / N + D * T / N * M(word),  M: the lattice's marginal, T: known words

Pieces are scored on the training words as types (each word once), by the counts that the
vocabulary's own tokenizer gives, add-one smoothed: what the lattice must explain is new and rare words.
Characters outside the vocabulary are edges of their byte pieces.

Counts are of all training documents and stay distributed: each block of documents (an input
split) sends its distinct words once, a fold over the sorted words adds them up and scores each
distinct word once, and each block gets back the rows of its own words, which its worker holds
(bounded by the split) while the block's texts stream by.  Only the vocabulary's piece counts and
totals reach the driver.

Null texts have the end token alone; rows with a null id are training rows; repeated rows count
each time.  Without training rows every word is scored by pieces alone, all alike.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.llm.common import Words, batch, chunks, clash_free, cut, mix, runs, signed, stored, texts_of

_U = np.uint64
SPACE = "▁"
DISCOUNT = 0.75
#: Distinct words that a worker counts before it sends them on.
HELD_WORDS = 1_000_000


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "utf-8")) % 7 == 2, F.lit(False))


class Lattice:
    """Marginal probability of words (bytes) under unigram piece scores, natural logarithms."""

    def __init__(self, pieces: dict[str, float], byte_scores: list[float]):
        self.bytes = np.array(byte_scores)
        self.longest = max(map(len, pieces))
        hashes, scores = [], []
        by_length: dict[int, list[str]] = {}
        for p in pieces:
            by_length.setdefault(len(p), []).append(p)
        for n, group in by_length.items():
            points = np.frombuffer("".join(group).encode("utf-32-le"), np.uint32).reshape(-1, n)
            h = np.zeros(len(group), np.uint64)
            for k in range(n):
                h = self._grow(h, points[:, k].astype(np.uint64))
            hashes.append(h)
            scores += [pieces[p] for p in group]
        hashes = np.concatenate(hashes)
        # A flat table with one probe more for each clash; a slot's last probe is empty.
        self.bits = 18
        order = np.argsort(hashes >> _U(64 - self.bits), kind="stable")
        hashes, scores = hashes[order], np.array(scores)[order]
        slot = (hashes >> _U(64 - self.bits)).astype(np.int64)
        self.first = np.searchsorted(slot, np.arange((1 << self.bits) + 1))
        self.probes = int(np.diff(self.first).max())
        self.hashes, self.scores = np.append(hashes, _U(0)), np.append(scores, -np.inf)

    @staticmethod
    def _grow(h: np.ndarray, points: np.ndarray) -> np.ndarray:
        """Hash of a string and one more character."""
        return mix(h + points * _U(0x9E3779B97F4A7C15) + _U(1))

    def _look(self, h: np.ndarray) -> np.ndarray:
        slot = (h >> _U(64 - self.bits)).astype(np.int64)
        at, end = self.first[slot], self.first[slot + 1]
        out = np.full(len(h), -np.inf)
        for k in range(self.probes):
            live = at + k < end
            if not live.any():
                break
            here = np.where(live, at + k, len(self.hashes) - 1)
            np.copyto(out, self.scores[here], where=live & (self.hashes[here] == h))
        return out

    def marginal(self, words: list[str]) -> np.ndarray:
        out, lengths = np.empty(len(words)), np.array([len(w) for w in words], np.int64)
        for n in np.unique(lengths):
            rows = np.flatnonzero(lengths == n)
            step = max(1, 2_000_000 // int(n))
            for i in range(0, len(rows), step):
                part = rows[i : i + step]
                points = np.frombuffer("".join([words[k] for k in part]).encode("utf-32-le"), np.uint32).reshape(len(part), n)
                out[part] = self._forward(points)
        return out

    def _forward(self, points: np.ndarray) -> np.ndarray:
        rows, n = points.shape
        alpha = np.full((n + 1, rows), -np.inf)
        alpha[0] = 0
        columns = np.ascontiguousarray(points.T).astype(np.uint64)
        for a in range(n):
            known, h = np.zeros(rows, bool), np.zeros(rows, np.uint64)
            for size in range(1, min(self.longest, n - a) + 1):
                h = self._grow(h, columns[a + size - 1])
                score = self._look(h)
                if size == 1:
                    known = score > -np.inf
                hit = np.flatnonzero(score > -np.inf)
                if len(hit):
                    alpha[a + size, hit] = np.logaddexp(alpha[a + size, hit], alpha[a, hit] + score[hit])
            odd = np.flatnonzero(~known)
            for r in odd:
                spelt = sum(self.bytes[b] for b in chr(points[r, a]).encode("utf-8", "surrogatepass"))
                alpha[a + 1, r] = np.logaddexp(alpha[a + 1, r], alpha[a, r] + spelt)
        return alpha[n]


def _counted(batches):
    """(word, block, n) of each distinct word of a block; n counts training documents' words only."""
    schema = pa.schema([("word", pa.binary()), ("block", pa.int64()), ("n", pa.int64())])

    def out(block, train, held):
        for w in held:
            if w not in train:
                train[w] = 0
        words = list(train)
        for i in range(0, len(words), 100_000):
            part = words[i : i + 100_000]
            yield batch(schema, part, [block] * len(part), [train[w] for w in part])

    block, train, held = None, Counter(), set()
    for x in runs(batches):
        for b, h, t in zip(x["block"].to_pylist(), x["held"].to_pylist(), texts_of(x["text"])):
            if b != block or len(train) + len(held) > HELD_WORDS:
                yield from out(block, train, held)
                block, train, held = b, Counter(), set()
            (held if h else train).update(t.lower().split())
    yield from out(block, train, held)


def _folded(batches):
    """(word, n, blocks) of rows sorted by word."""
    schema = pa.schema([("word", pa.binary()), ("n", pa.int64()), ("blocks", pa.list_(pa.int64()))])
    last, n, blocks = None, 0, set()
    for x in batches:
        words, counts, lists = [], [], []
        for w, b, c in zip(x["word"].to_pylist(), x["block"].to_pylist(), x["n"].to_pylist()):
            if w != last:
                if last is not None:
                    words.append(last)
                    counts.append(n)
                    lists.append(list(blocks))
                last, n, blocks = w, 0, set()
            n += c
            blocks.add(b)
        yield batch(schema, words, counts, lists)
    if last is not None:
        yield batch(schema, [last], [n], [list(blocks)])


def _tokenized(model: bytes):
    schema = pa.schema([("piece", pa.int32()), ("n", pa.int64())])

    def run(batches):
        import sentencepiece

        lib = sentencepiece.SentencePieceProcessor(model_proto=model)
        total = np.zeros(lib.get_piece_size(), np.int64)
        for x in batches:
            words = [w.decode("utf-8", "replace") for w in x["word"].to_pylist()]
            for i in range(0, len(words), 2000):
                total += np.bincount(np.fromiter((t for ids in lib.encode(words[i : i + 2000], num_threads=1) for t in ids), np.int64), minlength=len(total))
        at = np.flatnonzero(total)
        yield batch(schema, at, total[at])

    return run


def _word_hashes(words: list[bytes]) -> np.ndarray:
    """Of words without white space, as Words hashes them."""
    parts = [Words(part).hash for _, part in chunks(words)]
    return np.concatenate(parts) if parts else np.empty(0, np.uint64)


def _scored(lattice: Lattice, total: int, known: int):
    schema = pa.schema([("blocks", pa.list_(pa.int64())), ("hash", pa.int64()), ("n", pa.int64()), ("score", pa.float64())])

    def run(batches):
        spare = np.log(DISCOUNT * known / total) if total and known else 0.0
        for x in batches:
            words, n = x["word"].to_pylist(), x["n"].to_numpy()
            if not words:
                continue
            pieces = lattice.marginal([SPACE + w.decode("utf-8", "replace") for w in words]) + spare
            whole = np.full(len(n), -np.inf)
            if total:
                whole[n > 0] = np.log((n[n > 0] - DISCOUNT) / total)
            yield batch(schema, x["blocks"], signed(_word_hashes(words)), n, np.logaddexp(pieces, whole) / np.log(10))

    return run


def _summed(total: int, known: int, ends: int):
    """Documents' sums, of rows sorted by (block, kind): a block's words, then its documents."""
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])
    base = np.log10(total + known + 1)
    end_base, end_score = np.log10(ends + 1) - base, np.log10(max(ends, 1) / max(total, 1))

    def run(batches):
        block, parts, table = None, [], None
        for x in batches:
            blocks, kinds = x["block"].to_numpy(), x["kind"].to_numpy()
            edge = np.flatnonzero(np.concatenate([[True], (blocks[1:] != blocks[:-1]) | (kinds[1:] != kinds[:-1])])) if len(blocks) else []
            for i, j in zip(edge, [*edge[1:], len(blocks)]):
                if blocks[i] != block:
                    block, parts, table = blocks[i], [], None
                y = x.slice(i, j - i)
                if kinds[i] == 0:
                    parts.append((y["hash"].to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64), y["n"].to_numpy(zero_copy_only=False).astype(np.int64), y["score"].to_numpy(zero_copy_only=False)))
                    continue
                if table is None:
                    h, n, s = (np.concatenate(c) for c in zip(*parts)) if parts else (np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0))
                    order = np.argsort(h)
                    table, parts = (h[order], n[order] > 0, np.log10(n[order] + 1) - base, s[order]), []
                for z in runs([y]):
                    words = Words(texts_of(z["text"]), lower=True)
                    at, spans = np.searchsorted(table[0], words.hash), list(zip(words.bounds[:-1], words.bounds[1:]))
                    known, low, high = (c[at] for c in table[1:])
                    sums = [[c[a:b].sum() for a, b in spans] for c in (known, low, high)]
                    yield batch(schema, z["doc_id"], z["held"], np.diff(words.bounds) + 1, np.array(sums[0], np.int64) + (ends > 0), np.array(sums[1]) + end_base, np.array(sums[2]) + end_score)

    return run


def _blocked(docs: DataFrame) -> DataFrame:
    """docs with `block`, the same for a row whenever the plan runs: its input split, or, if it
    comes from no file, its partition in a checkpoint."""
    if docs.where(F.input_file_name() == "").isEmpty():
        return docs.withColumn("block", F.xxhash64(F.input_file_name(), F.input_file_block_start()))
    return cut(docs).withColumn("block", F.spark_partition_id().cast("long"))


def score_documents(docs: DataFrame, model_path: str, held: Column | None = None) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of docs(doc_id, text)."""
    with open(model_path, "rb") as f:
        model = f.read()
    docs = clash_free(docs, "doc_id", "text").withColumn("held", held_out(F.col("doc_id")) if held is None else held)
    docs = _blocked(docs)
    counted = docs.select("block", "held", "text").mapInArrow(_counted, "word binary, block long, n long")
    words = stored(counted.repartition("word").sortWithinPartitions("word").mapInArrow(_folded, "word binary, n long, blocks array<long>"))
    sums = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count_if(F.col("n") > 0).alias("v")).first()
    ends = docs.where(~F.col("held")).count()
    total, known = sums["n"] + ends, sums["v"] + (ends > 0)
    counts = words.where("n > 0").select("word").mapInArrow(_tokenized(model), "piece int, n long").groupBy("piece").agg(F.sum("n").alias("n")).collect()
    lattice = piece_lattice(model, {r["piece"]: r["n"] for r in counts})
    rows = words.mapInArrow(_scored(lattice, total, sums["v"]), "blocks array<long>, hash long, n long, score double")
    nothing = [F.lit(None).cast(t).alias(c) for c, t in (("doc_id", "long"), ("held", "boolean"), ("text", "string"))]
    table = rows.select(F.explode("blocks").alias("block"), F.lit(0).alias("kind"), "hash", "n", "score", *nothing)
    texts = docs.select("block", F.lit(1).alias("kind"), F.lit(None).cast("long").alias("hash"), F.lit(None).cast("long").alias("n"), F.lit(None).cast("double").alias("score"), "doc_id", "held", "text")
    out = table.unionByName(texts).repartition("block").sortWithinPartitions("block", "kind").mapInArrow(_summed(total, known, ends), "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return out.withColumn("train_tokens", F.lit(total).cast("long"))


def piece_lattice(model: bytes, counts: dict[int, int]) -> Lattice:
    """The vocabulary's pieces with add-one scores of their counts."""
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_proto=model)
    ids = [i for i in range(lib.get_piece_size()) if not (lib.is_control(i) or lib.is_unknown(i) or lib.is_unused(i))]
    total = sum(counts.get(i, 0) + 1 for i in ids)
    score = {i: float(np.log((counts.get(i, 0) + 1) / total)) for i in ids}
    return Lattice({lib.id_to_piece(i): score[i] for i in ids if not lib.is_byte(i)}, [score[lib.piece_to_id(f"<0x{b:02X}>")] for b in range(256)])
