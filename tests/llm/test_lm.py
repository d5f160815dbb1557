import math
import zlib
from collections import Counter
from functools import cache

import pytest
import sentencepiece

from waymark.llm import lattice_lm
from waymark.llm.queries import TOKENIZERS

from .brute import words

MODEL = f"{TOKENIZERS}/piece_bpe_32k.model"
SF = "/root/testdata/sf0.001"


def model():
    with open(MODEL, "rb") as f:
        return f.read()


def brute(rows):
    """Rows' (held_out, n_tokens, n_known, train_tokens, base, score) by plain recursion."""
    lib = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    held = [i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows]
    texts = [words(t, lower=True) for _, t in rows]
    count = Counter(w for h, t in zip(held, texts) if not h for w in t)
    ends = held.count(False)
    total, known = sum(count.values()) + ends, len(count) + (ends > 0)
    pieces = Counter(p for w in count for p in lib.encode(w))
    ids = [i for i in range(lib.get_piece_size()) if not (lib.is_control(i) or lib.is_unknown(i))]
    mass = sum(pieces[i] + 1 for i in ids)
    score = {lib.id_to_piece(i): (pieces[i] + 1) / mass for i in ids}
    single = {p: s for p, s in score.items() if not lib.is_byte(lib.piece_to_id(p))}

    @cache
    def marginal(w):
        if not w:
            return 1.0
        out = sum(single[w[:k]] * marginal(w[k:]) for k in range(1, min(len(w), 16) + 1) if w[:k] in single)
        if w[0] not in single:
            out += math.prod(score[f"<0x{b:02X}>"] for b in w[0].encode()) * marginal(w[1:])
        return out

    @cache
    def word(w):
        spare = lattice_lm.DISCOUNT * len(count) / total if count else 1.0
        return math.log10(max(count[w] - lattice_lm.DISCOUNT, 0) / max(total, 1) + spare * marginal("▁" + w))

    out = []
    for h, t in zip(held, texts):
        base = sum(math.log10((count[w] + 1) / (total + known + 1)) for w in t) + math.log10((ends + 1) / (total + known + 1))
        end = math.log10(ends / total) if ends else 0.0
        out.append((h, len(t) + 1, sum(count[w] > 0 for w in t) + (ends > 0), total, base, sum(map(word, t)) + end))
    return out


ODD = [(None, "Foo bar"), (500, None), (501, ""), (502, "日本 𝒳y \x00 ﷺ▁a"), (502, "foo FOO É é É"), (503, "a" * 300)]


@pytest.mark.parametrize("from_files", [True, False])
def test_equals_brute_force(spark, from_files, tmp_path):
    rows = [(r["doc_id"], r["text"][:600]) for r in spark.read.parquet(f"{SF}/documents.parquet").limit(60).collect()] + ODD
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, block int, score int").repartition(3)
    if from_files:
        df.write.parquet(str(tmp_path / "docs"))
        df = spark.read.parquet(str(tmp_path / "docs"))
    got = sorted(lattice_lm.score_documents(df, MODEL).collect(), key=lambda r: (str(r["doc_id"]), r["n_tokens"]))
    want = sorted(zip(rows, brute(rows)), key=lambda x: (str(x[0][0]), x[1][1]))
    assert len(got) == len(want)
    for r, ((i, _), w) in zip(got, want):
        assert (r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (i, *w[:4])
        assert r["base_score"] == pytest.approx(w[4], abs=1e-6) and r["score"] == pytest.approx(w[5], abs=1e-6)


def test_small_worker_memory_changes_nothing(spark, monkeypatch):
    batches = [lattice_lm.pa.RecordBatch.from_pydict({"block": [1, 1, 1, 2], "held": [False, True, False, False], "text": ["a b b", "c a", "b d", "a"]})]
    out = [r for x in lattice_lm._counted(iter(batches)) for r in x.to_pylist()]
    monkeypatch.setattr(lattice_lm, "HELD_WORDS", 0)
    split = [r for x in lattice_lm._counted(iter(batches)) for r in x.to_pylist()]
    add = lambda rows: Counter({k: n for k, n in _sums(rows).items()})
    assert add(out) == add(split) and {r["word"] for r in out} == {b"a", b"b", b"c", b"d"}


def _sums(rows):
    out = {}
    for r in rows:
        out[r["word"], r["block"]] = out.get((r["word"], r["block"]), 0) + r["n"]
    return out


def test_no_training_rows(spark):
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    df = spark.createDataFrame([(held, "some words"), (held, None)], "doc_id long, text string")
    got = lattice_lm.score_documents(df, MODEL).collect()
    assert all(r["held_out"] and r["train_tokens"] == 0 and r["n_known"] == 0 and math.isfinite(r["score"]) for r in got)
    assert lattice_lm.score_documents(df.limit(0), MODEL).count() == 0


def test_marginal_sums_to_one_at_most():
    scores = {"a": math.log(0.3), "b": math.log(0.2), "ab": math.log(0.4), "▁": math.log(0.1)}
    lattice = lattice_lm.Lattice(scores, [-50.0] * 256)
    got = dict(zip(["ab", "a", "b", "aab", "bb"], lattice.marginal(["ab", "a", "b", "aab", "bb"])))
    assert got["ab"] == pytest.approx(math.log(0.4 + 0.06)) and got["aab"] == pytest.approx(math.log(0.3 * 0.46)) and got["bb"] == pytest.approx(math.log(0.04))
