import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from waymark.llm import ngram_jaccard as N
from waymark.llm.ngram_jaccard import NgramJaccardJoin, one_of_each

from .brute import components, jaccard_links

SCHEMA = "doc_id long, text string, source string, sig long, component long"


def corpus(seed, many=700):
    rng = random.Random(seed)
    texts = pq.read_table("/root/testdata/sf0.001/documents.parquet").select(["doc_id", "text"]).to_pylist()
    rows = [(d["doc_id"], d["text"]) for d in texts]
    pool = [t.split() for _, t in rows[:20]]
    for i in range(many):
        w = list(rng.choice(pool))[: rng.choice([4, 9, 12, 20, 40, 80, 200, 500])]
        for _ in range(rng.randint(0, max(1, len(w) // rng.choice([8, 15, 30, 60, 100])))):
            w[rng.randrange(len(w))] = f"x{rng.randrange(1000)}"
        rows.append((10**6 + i, " ".join(w)))
    return rows + [(-1, None), (-2, ""), (-3, " \n"), (-4, "one"), (-5, "One"), (-6, "one two"), (None, "x y z"), (None, None), (5, rows[5][1])]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "s", 1, 2) for i, t in rows], SCHEMA)


@pytest.mark.parametrize("size, num, den", [(3, 90, 100), (5, 8, 10)])
def test_links_and_components(spark, size, num, den):
    rows = corpus(size)
    sets, links = jaccard_links(rows, size, num, den)
    want = components(sorted(sets), links)
    join = NgramJaccardJoin(size, num, den)
    got = join.run(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None
        else:
            assert (r["n_shingles"], r["component_id"]) == (len(sets[r["doc_id"]]), want[r["doc_id"]])
    least = {}
    for i in sorted(sets):
        least.setdefault(sets[i], i)
    pairs = {tuple(sorted((least[sets[a]], least[sets[b]]))) for a, b in links}
    assert {(r["a"], r["b"]) for r in join.links(frame(spark, rows)).collect()} == {p for p in pairs if p[0] != p[1]}


def test_subtrees_in_blocks(spark, monkeypatch):
    rows = corpus(9, 300)
    sets, links = jaccard_links(rows, 3, 90, 100)
    want = components(sorted(sets), links)
    monkeypatch.setattr(N, "BLOCK", 4)
    monkeypatch.setattr(N, "BLOCK_SHINGLES", 500)
    monkeypatch.setattr("waymark.llm.common.HOT", 3)
    least = {}
    for i in sorted(sets):
        least.setdefault(sets[i], i)
    pairs = {tuple(sorted((least[sets[a]], least[sets[b]]))) for a, b in links}
    assert {(r["a"], r["b"]) for r in NgramJaccardJoin(3, 90, 100).links(frame(spark, rows)).collect()} == {p for p in pairs if p[0] != p[1]}
    got = NgramJaccardJoin(3, 90, 100).run(frame(spark, rows)).where("doc_id is not null").collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == want


def test_empty(spark):
    assert NgramJaccardJoin().run(frame(spark, [])).count() == 0


def test_one_of_each_keeps_columns(spark):
    rows = [(1, "a b c d e f g"), (2, "a b c d e f g"), (3, "q r s t u v"), (None, "a b c d e f g"), (4, None)]
    out = one_of_each(frame(spark, rows).withColumn("key", F.lit(7)))
    assert out.columns == ["doc_id", "text", "source", "sig", "component", "key"]
    assert sorted(str(r["doc_id"]) for r in out.collect()) == ["1", "3", "4", "None"]


def test_visits_of_one_document_are_sent_in_parts():
    """A document of a large family is sent to all its blocks, but never held for all of them at once."""
    text, kind = " ".join(f"w{k}" for k in range(3000)), pa.struct([(c, pa.int64()) for c in ("key", "salt", "kind", "component")])
    visits = [{"key": 1, "salt": k, "kind": 1, "component": 7} for k in range(500)]
    x = pa.RecordBatch.from_arrays([pa.array([7]), pa.array([visits], pa.list_(kind)), pa.array([text])], ["doc_id", "visits", "text"])
    out = list(N._visits(5)(iter([x])))
    assert [k for y in out for k in y["salt"].to_pylist()] == list(range(500))
    assert len({s for y in out for s in y["set"].to_pylist()}) == 1
    assert max(y.nbytes for y in out) < 3 << 20
