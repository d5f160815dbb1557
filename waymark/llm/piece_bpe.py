"""SentencePiece BPE encoding by vectorised merge rounds over flat numpy symbol arrays.

All unseen segments of a batch stand in one array of symbols.  A round finds each segment's
minimum pair rank (a segmented minimum), merges its leftmost non-overlapping pairs of that rank
at once, compacts the array, and looks up only the pairs that changed; segments without a pair
leave.  The library merges one pair at a time, best score first and leftmost among equals; doing
all pairs of a rank at once gives the same result unless the merged piece starts or ends a piece
of equal or better score, so for such pieces a round merges one pair only.

A segment is a run of the space mark with what follows up to the next one: no piece has a mark
after another character, so no merge crosses that border.  Nor does one cross two characters that
stand side by side in no piece, so segments longer than LONG are cut there too.  What is then still
longer than LONG leaves the rounds, which pass over a whole segment for each rank, for a heap of its
pairs: n log n steps for n characters and about 100 bytes each, whatever the segment.  Null texts are empty and give the end
id alone; other columns than the id and the text are dropped; repeated rows give repeated rows.
"""

from __future__ import annotations

import heapq
import re
from array import array
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from waymark.llm.common import clash_free, runs

SPACE = "▁"
#: Segments in each of a worker's two generations of remembered ones, and characters that one
#: call of `merge` takes.
REMEMBERED, AT_ONCE = 60_000, 1 << 18
#: Characters of a segment that is cut further, or merged by a heap; longer ones are not remembered.
LONG = 512


class PieceBpe:
    def __init__(self, model: bytes):
        import sentencepiece

        self.lib = lib = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = lib.get_piece_size()
        special = {i for i in range(n) if lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i) or lib.is_unused(i)}
        pieces = {lib.id_to_piece(i): i for i in range(n) if i not in special}
        self.bytes = [lib.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.end = lib.eos_id()
        symbols = dict(pieces)
        for c in sorted({c for p in pieces for c in p}):
            symbols.setdefault(c, len(symbols) + n)
        self.width = max(symbols.values()) + 2
        self.none = self.width - 1
        self.n = n
        scores = {p: lib.get_score(i) for p, i in pieces.items()}
        order = {s: k for k, s in enumerate(sorted(set(scores.values()), reverse=True))}
        self.never = len(order)
        keys, merged = [], []
        loose = np.zeros(self.never + 1, bool)
        for p, i in pieces.items():
            for k in range(1, len(p)):
                a, b = symbols.get(p[:k]), symbols.get(p[k:])
                if a is not None and b is not None:
                    keys.append(a * self.width + b)
                    merged.append(i)
                for part in (p[:k], p[k:]):
                    if part in scores and scores[p] >= scores[part]:
                        loose[order[scores[part]]] = True
        self.rank_of = np.full(n, self.never, np.int32)
        for p, i in pieces.items():
            self.rank_of[i] = order[scores[p]]
        self.loose = loose
        self.keys, self.merged = self._table(np.array(keys, np.int64), np.array(merged, np.int64))
        self.ints = list(range(n))
        chars = sorted(c for c in symbols if len(c) == 1)
        self.chars, self.char_ids = np.array([ord(c) for c in chars], np.uint32), np.array([symbols[c] for c in chars], np.int64)
        beside = sorted({(ord(a) << 21) | ord(b) for p in pieces for a, b in zip(p, p[1:])})
        self.beside = np.array(beside, np.int64)
        self.piece_of: dict[int, int] = {}
        apart = "" if any("\n" in p for p in pieces) else "\n"
        if any(SPACE in p.lstrip(SPACE) for p in pieces):
            raise ValueError("a piece has a space mark after another character")
        self.segments = re.compile(f"{SPACE}*[^{SPACE}{apart}]+|{SPACE}+" + f"|{apart}" * bool(apart))
        self.seen: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}

    SLOTS = 18

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.SLOTS)).astype(np.int64)

    def _table(self, keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Open addressing: a key stands in the first free slot from its own on."""
        held, of = np.full((1 << self.SLOTS) + 4096, -1, np.int64), np.full((1 << self.SLOTS) + 4096, -1, np.int64)
        slot = self._slot(keys)
        while len(keys):
            _, first = np.unique(slot, return_index=True)
            first = first[held[slot[first]] < 0]
            held[slot[first]], of[slot[first]] = keys[first], values[first]
            left = np.ones(len(keys), bool)
            left[first] = False
            keys, values, slot = keys[left], values[left], slot[left] + 1
        return held, of

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = left * self.width + right
        at = self._slot(key)
        there = self.keys[at]
        piece = np.where(there == key, self.merged[at], -1)
        todo = np.flatnonzero((there != key) & (there >= 0))
        while len(todo):
            at[todo] += 1
            there = self.keys[at[todo]]
            hit = there == key[todo]
            piece[todo[hit]] = self.merged[at[todo[hit]]]
            todo = todo[~hit & (there >= 0)]
        return piece, np.where(piece >= 0, self.rank_of[piece], self.never)

    def cut(self, segment: str) -> list[str]:
        """The segment between characters that no piece has side by side."""
        points = np.frombuffer(segment.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        pair = (points[:-1] << 21) | points[1:]
        at = np.searchsorted(self.beside, pair)
        at[at == len(self.beside)] = 0
        ends = [*(np.flatnonzero(self.beside[at] != pair) + 1).tolist(), len(segment)]
        return [segment[a:b] for a, b in zip([0, *ends], ends)]

    def long(self, segment: str) -> list[int]:
        """Ids of one segment, by a heap of (rank, place) of its pairs: best rank first, then leftmost."""
        if not self.piece_of:
            there = self.keys >= 0
            self.piece_of = dict(zip(self.keys[there].tolist(), self.merged[there].tolist()))
        points = np.frombuffer(segment.encode("utf-32-le", "surrogatepass"), np.uint32)
        at = np.searchsorted(self.chars, points)
        at[at == len(self.chars)] = 0
        first = np.where(self.chars[at] == points, self.char_ids[at], self.none)
        n, width, piece_of, rank_of = len(points), self.width, self.piece_of, self.rank_of
        _, rank = self._pairs(first[:-1], first[1:])
        where = np.flatnonzero(rank != self.never)
        # A pair's rank and place are one number; a pair that has changed since has another rank.
        heap = (rank[where].astype(np.int64) * n + where).tolist()
        heapq.heapify(heap)
        sym, now = array("q", first.tobytes()), array("q", np.append(rank, self.never).astype(np.int64).tobytes())
        after, before = array("q", range(1, n + 1)), array("q", range(-1, n - 1))
        while heap:
            r, i = divmod(heapq.heappop(heap), n)
            if now[i] != r:
                continue
            j = after[i]
            k = after[j]
            sym[i] = piece_of[sym[i] * width + sym[j]]
            now[j], now[i], after[i] = -1, self.never, k
            if k < n:
                before[k] = i
                piece = piece_of.get(sym[i] * width + sym[k])
                if piece is not None:
                    now[i] = int(rank_of[piece])
                    heapq.heappush(heap, now[i] * n + i)
            h = before[i]
            if h >= 0:
                piece = piece_of.get(sym[h] * width + sym[i])
                now[h] = self.never if piece is None else int(rank_of[piece])
                if piece is not None:
                    heapq.heappush(heap, now[h] * n + h)
        ids, i = [], 0
        while i < n:
            ids += [sym[i]] if sym[i] < self.n else [self.bytes[b] for b in segment[i].encode()]
            i = after[i]
        return ids

    def merge(self, segments: list[str]) -> list[tuple[int, ...]]:
        """Ids of each segment (not empty)."""
        points = np.frombuffer("".join(segments).encode("utf-32-le", "surrogatepass"), np.uint32)
        at = np.searchsorted(self.chars, points)
        at[at == len(self.chars)] = 0
        sym = np.where(self.chars[at] == points, self.char_ids[at], self.none)
        lengths = np.array([len(s) for s in segments])
        seg = np.repeat(np.arange(len(segments), dtype=np.int32), lengths)
        source = np.arange(len(sym), dtype=np.int32)
        out_sym, out_seg, out_source = [], [], []
        piece, rank = self._pairs(sym[:-1], sym[1:])
        piece, rank = np.append(piece, -1), np.append(rank, self.never)
        rank[np.cumsum(lengths) - 1] = self.never
        while len(sym):
            first = np.flatnonzero(np.concatenate([[True], seg[1:] != seg[:-1]]))
            sizes = np.diff(np.append(first, len(seg)))
            least = np.minimum.reduceat(rank, first)
            done = least == self.never
            if done.any():
                gone = np.repeat(done, sizes)
                out_sym.append(sym[gone])
                out_seg.append(seg[gone])
                out_source.append(source[gone])
                stay = ~gone
                sym, seg, source, piece, rank = sym[stay], seg[stay], source[stay], piece[stay], rank[stay]
                sizes, least = sizes[~done], least[~done]
                if not len(sym):
                    break
            hit = np.flatnonzero(rank == np.repeat(least, sizes))
            owner = seg[hit]
            lead = np.concatenate([[True], owner[1:] != owner[:-1]])
            hit = hit[lead | ~self.loose[rank[hit]]]
            run = np.concatenate([[True], hit[1:] != hit[:-1] + 1])
            start = np.flatnonzero(run)
            hit = hit[(np.arange(len(hit)) - np.repeat(start, np.diff(np.append(start, len(hit))))) % 2 == 0]
            sym[hit] = piece[hit]
            rank[hit] = rank[hit + 1]
            stay = np.ones(len(sym), bool)
            stay[hit + 1] = False
            where = hit - np.arange(len(hit))
            sym, seg, source, piece, rank = sym[stay], seg[stay], source[stay], piece[stay], rank[stay]
            beside = np.zeros(len(sym) + 1, bool)
            beside[where] = True
            # The pair before a merged one; -1 is the further place at the end, which is no pair.
            beside[where - 1] = True
            changed = np.flatnonzero(beside[: max(len(sym) - 1, 0)])
            inside = seg[changed] == seg[changed + 1]
            rank[changed[~inside]] = self.never
            changed = changed[inside]
            piece[changed], rank[changed] = self._pairs(sym[changed], sym[changed + 1])
            if len(rank):
                rank[-1] = self.never
        sym, seg, source = np.concatenate(out_sym), np.concatenate(out_seg), np.concatenate(out_source)
        order = np.argsort(source, kind="stable")
        sym, seg, source = sym[order], seg[order], source[order]
        ints, n = self.ints, self.n
        # Tuples, as the collector of cycles passes over those of numbers.
        ids, bounds = tuple([ints[i] if i < n else i for i in sym.tolist()]), np.searchsorted(seg, np.arange(len(segments) + 1)).tolist()
        result = [ids[a:b] for a, b in zip(bounds[:-1], bounds[1:])]
        for k in np.unique(seg[sym >= self.n]).tolist():
            whole = []
            for i in range(bounds[k], bounds[k + 1]):
                whole += [ids[i]] if ids[i] < self.n else [self.bytes[b] for b in chr(points[source[i]]).encode()]
            result[k] = tuple(whole)
        return result

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Ids of each text, the end id last."""
        split = [self.segments.findall(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
        distinct = set().union(*split)
        long = {s for s in distinct if len(s) > LONG}
        if long:
            parts = {s: self.cut(s) for s in long}
            split = [x if long.isdisjoint(x) else [p for s in x for p in parts.get(s, (s,))] for x in split]
            distinct = set().union(*split)
            long = {s for s in distinct if len(s) > LONG}
        if len(self.seen) > REMEMBERED:
            self.seen, self.older = {}, self.seen
        seen, older, new = self.seen, self.older, []
        for s in distinct.difference(seen, long):
            if s in older:
                seen[s] = older[s]
            else:
                new.append(s)
        i = 0
        while i < len(new):
            j, held = i, 0
            while j < len(new) and (j == i or held + len(new[j]) <= AT_ONCE):
                held += len(new[j])
                j += 1
            seen.update(zip(new[i:j], self.merge(new[i:j])))
            i = j
        # Long segments are not remembered, as their ids may be many.
        known = seen.__getitem__
        of = (lambda s: self.long(s) if s in long else seen[s]) if long else known
        return [[*chain.from_iterable(map(known if long.isdisjoint(x) else of, x)), self.end] for x in split]

    def decode(self, ids: list[list[int]]) -> list[str]:
        return [self.lib.decode(x) for x in ids]


def encode_decode(docs: DataFrame, model_path: str, key: str = "doc_id") -> DataFrame:
    """(key, ids, decoded) of every row of docs(key, text); the small model file goes with the code."""
    with open(model_path, "rb") as f:
        model = f.read()
    docs = clash_free(docs, key, "text")
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        bpe = PieceBpe(model)
        for x in runs(batches):
            ids = bpe.encode([t or "" for t in x["text"].to_pylist()])
            yield pa.RecordBatch.from_arrays([x[key], pa.array(ids, pa.list_(pa.int32())), pa.array(bpe.decode(ids), pa.string())], [key, "ids", "decoded"])

    return docs.mapInArrow(run, f"{key} {kind}, ids array<int>, decoded string")
