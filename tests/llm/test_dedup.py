import hashlib
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from waymark.llm import substring_dedup
from waymark.llm.substring_dedup import SubstringDedup, without_repeats

from .brute import repeats


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "w%d" % rng.randrange(60)
    passages = [[word() for _ in range(rng.choice([49, 50, 51, 80, 120]))] for _ in range(8)]
    rows = []
    for i in range(120):
        w = []
        for _ in range(rng.randint(0, 4)):
            w += rng.choice(passages) if rng.random() < 0.5 else [word() for _ in range(rng.randint(1, 90))]
        rows.append((1000 - 3 * i, "  ".join(w)))
    rows += [(2000, rows[3][1]), (2001, rows[3][1]), (5, None), (6, ""), (None, rows[4][1]), (None, None), (2002, "x " * 300), (2003, "x " * 400)]
    return rows


@pytest.mark.parametrize("seed, held, group", [(1, 1_000_000, 1 << 14), (2, 300, 3), (3, 100, 40)])
def test_equals_brute_force(spark, seed, held, group, monkeypatch):
    monkeypatch.setattr(substring_dedup, "HELD", held)
    monkeypatch.setattr(substring_dedup, "GROUP", group)
    rows = corpus(seed)
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, `group` int, window string")
    got = SubstringDedup().run(df).collect()
    key = lambda x: (str(x[0]), x[1], x[2], x[3])
    have = sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got), key=key)
    want = sorted(((i, n, n - len(k), hashlib.sha256(" ".join(k).encode()).hexdigest()) for i, n, k in repeats(rows, 50)), key=key)
    assert have == want
    assert all(r["kept"] is not None for r in got)


def test_prefixes_are_as_long_as_groups_need(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "GROUP", 10)
    # 30 suffixes share 16 words, 8 of them 32 too; 20 are one window; 5 stand alone.
    paths = [(7 << 24) + (k // 8 << 12) + k for k in range(30)] + [1 << 60] * 20 + [k << 50 for k in range(1, 6)]
    rows = spark.createDataFrame([(p, k if p < 1 << 60 else 9, k, 0, -1) for k, p in enumerate(paths)], "path long, window long, doc_id long, at long, last long")
    got = SubstringDedup._grouped(rows).groupBy("group").count().collect()
    assert sorted(r["count"] for r in got) == [1] * 5 + [6, 8, 8, 8, 20]


def test_same_id_twice_and_empty_table(spark):
    text = " ".join(f"a{i}" for i in range(60))
    df = spark.createDataFrame([(1, text), (1, text), (1, text + " b")], "doc_id long, text string")
    assert [r["n_removed"] for r in SubstringDedup().run(df).collect()] == [0, 0, 0]
    assert SubstringDedup().run(df.limit(0)).count() == 0


def test_stage_keeps_columns_and_clean_texts(spark):
    text = " ".join(f"a{i}" for i in range(60))
    rows = [(1, "en", text, 10), (2, "en", "x\ty " + text + " z", 11), (3, "en", text, 12), (4, "en", "as\tit  is", 13), (5, "en", None, None)]
    out = without_repeats(spark.createDataFrame(rows, "doc_id long, lang string, text string, n_chars long"))
    assert out.columns == ["doc_id", "lang", "text", "n_chars"]
    assert {r["doc_id"]: r["text"] for r in out.collect()} == {1: text, 2: "x y z", 4: "as\tit  is", 5: None}


def test_columns_with_the_operators_names_come_back(spark):
    text = " ".join(f"a{i}" for i in range(60))
    names = ["marks", "n_words", "n_removed", "kept", "kept_sha256", "_d", "_text", "group", "owner"]
    rows = [(i, text, *(-k for k in range(len(names)))) for i in (1, 2)] + [(3, "b c", *[None] * len(names))]
    out = without_repeats(spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"`{n}` int" for n in names)))
    assert out.columns == ["doc_id", "text", *names]
    assert sorted(map(tuple, out.collect())) == [rows[0], rows[2]]


def test_stage_sends_each_text_to_python_once(spark, monkeypatch):
    text = " ".join(f"a{i}" for i in range(60))
    docs = spark.createDataFrame([(1, text, 5), (2, "b " + text, 6), (3, None, None)], "doc_id long, text string, n_chars long")
    seen, real = [], type(docs).mapInArrow
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, f, schema, *a, **k: seen.append((self.dtypes, schema)) or real(self, f, schema, *a, **k))
    out = without_repeats(docs)
    sent, back = seen[-1]
    assert [name for name, kind in sent if kind == "string"] == ["text"] and back.count("string") == 1
    assert sorted(map(tuple, out.collect())) == [(1, text, 5), (2, "b", 1), (3, None, None)]


def test_marks_are_merged_a_few_at_a_time(monkeypatch):
    monkeypatch.setattr(substring_dedup, "MARKS", 200, raising=False)
    rng = random.Random(4)
    marks = [[{"tag": rng.randrange(2), "first": (a := rng.randrange(200)), "last": a + rng.randrange(9)} for _ in range(rng.randrange(60))] for _ in range(50)] + [[]]
    kind = pa.list_(pa.struct([("tag", pa.int64()), ("first", pa.int64()), ("last", pa.int64())]))
    out = list(substring_dedup._merged([pa.RecordBatch.from_arrays([pa.array(range(51), pa.int64()), pa.array(marks, kind)], ["doc_id", "marks"])]))
    assert sum(b.num_rows for b in out) == 51 and all(b.num_rows == 1 or sum(len(marks[i]) + 16 for i in b["doc_id"].to_pylist()) <= 200 for b in out)
    places = lambda own: {(m["tag"], p) for m in own for p in range(m["first"], m["last"] + 1)}
    for b in out:
        for i, own in zip(b["doc_id"].to_pylist(), b["marks"].to_pylist()):
            assert places(own) == places(marks[i]) and sum(m["last"] - m["first"] + 1 for m in own) == len(places(own))


def test_held_suffixes_are_joined_in_little_more_than_their_own_room():
    rng, n = np.random.default_rng(5), 400_000
    held = [tuple(rng.integers(0, 1000, n // 100) for _ in range(4)) for _ in range(100)]
    room = 32 * n
    tracemalloc.start()
    first = sum(int((b["last"].to_numpy() < 0).sum()) for b in substring_dedup._joined(held))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert 0 < first < n and peak < 2 * room, peak / room
