import sentencepiece

import corpus_pipeline
from waymark.llm.queries import TOKENIZERS

from .brute import components, jaccard_links, repeats, words

SF = "/root/testdata/sf0.01"


def staged(spark, tmp_path, docs):
    out = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, out[-1], SF).write.parquet(str(tmp_path / str(k)))
        out.append(spark.read.parquet(str(tmp_path / str(k))))
    return out


def test_each_stage_equals_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 600")
    tables = staged(spark, tmp_path, docs)
    assert all(t.columns == docs.columns for t in tables[:-1])
    rows = [[r.asDict() for r in t.collect()] for t in tables]
    before, good, single, clean, mixed, ids = rows

    quality = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r["doc_id"] for r in good}
    judged = [r["doc_id"] for r in before if r["doc_id"] in quality]
    assert sum((i in kept) == (quality[i] > 0) for i in judged) >= 0.95 * len(judged)
    assert sum(i in kept for i in judged if quality[i]) >= 0.98 * sum(quality[i] for i in judged)

    sets, links = jaccard_links([(r["doc_id"], r["text"]) for r in good], 5, 8, 10)
    assert {r["doc_id"] for r in single} == {i for i, c in components(sorted(sets), links).items() if i == c}

    want = {}
    for (i, n, left), r in zip(repeats([(r["doc_id"], r["text"]) for r in single], 50), single):
        if len(left) == n:
            want[i] = r["text"]
        elif left:
            want[i] = " ".join(left)
    assert {r["doc_id"]: r["text"] for r in clean} == want
    assert all(r["n_chars"] == len(r["text"]) for r in clean)

    size = {}
    taken = {}
    for table, sums in ((clean, size), (mixed, taken)):
        for r in table:
            sums[r["source"]] = sums.get(r["source"], 0) + len(words(r["text"]))
    assert abs(sum(taken.values()) - 1.5 * sum(size.values())) <= len(size)
    assert all(taken[s] <= 2 * size[s] for s in size)
    source = {r["doc_id"]: r["text"] for r in clean}
    assert all(words(source[r["doc_id"]])[: len(words(r["text"]))] == words(r["text"]) for r in mixed)

    lib = sentencepiece.SentencePieceProcessor(model_file=f"{TOKENIZERS}/piece_bpe_32k.model")
    want = sorted((r["doc_id"], lib.encode(r["text"], add_eos=True)) for r in mixed)
    assert sorted((r["doc_id"], r["ids"]) for r in ids) == want


def test_odd_rows(spark, tmp_path):
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    rows = [(None, None, None, None, None), (-1, None, "en", "src0", 0), (-2, "", None, None, 0), (-3, "one word", "en", "src0", 8), (-3, "one word", "en", "src0", 8)]
    docs = spark.createDataFrame(rows, schema)
    for table in (docs, docs.limit(0)):
        out = staged(spark, tmp_path / str(table.count()), table)
        assert out[-1].count() <= 2 * table.count()


def test_rejected_rows_go_by_their_own_verdict(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 600")
    stage = corpus_pipeline.STAGES[0][1]
    kept = {r["doc_id"] for r in stage(spark, docs, SF).collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert 0 < len(kept) < len(texts)
    # The fit needs ids; the verdicts of copies without ids, or with one id for all, are those of the rows.
    copies = docs.selectExpr("CAST(NULL AS BIGINT) AS doc_id", "text", "lang", "source", "n_chars").union(docs.selectExpr("CAST(-1 AS BIGINT)", "text", "lang", "source", "n_chars"))
    got = [(r["doc_id"], r["text"]) for r in stage(spark, docs.union(copies), SF).collect()]
    of = lambda i: sorted(t for d, t in got if d == i)
    assert 0 < len(of(None)) < len(texts) and of(None) == of(-1) == sorted(t for d, t in got if d is not None and d >= 0)


def test_rows_without_ids_reach_the_end(spark, tmp_path):
    text = "a row without an id is mixed and encoded as any other row of its source is"
    docs = spark.createDataFrame([(None, text, "en", "src0", len(text))] * 2 + [(-1, text, "en", "src0", len(text))], spark.read.parquet(f"{SF}/documents.parquet").schema)
    out = [t.collect() for t in staged(spark, tmp_path, docs)]
    assert [sum(r["doc_id"] is None for r in t) for t in out[:4]] == [2, 2, 2, 2]
    assert any(r["doc_id"] is None for r in out[-1])


def test_columns_with_the_operators_names_reach_the_mix(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 40")
    names = ["size", "turns", "part", "marks", "n_words", "n_removed", "kept", "kept_sha256", "host", "path", "evidence", "score", "component_id", "_d", "n", "rep", "visits"]
    wide = docs.selectExpr("*", *(f"doc_id * 100 + {k} AS `{n}`" for k, n in enumerate(names)))
    out = staged(spark, tmp_path, wide)
    assert all(t.columns == wide.columns for t in out[:-1])
    mixed = out[-2].collect()
    assert mixed and all(r[n] == 100 * r["doc_id"] + k for r in mixed for k, n in enumerate(names))
