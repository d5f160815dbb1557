"""Every query with SQL gives DuckDB's rows."""

import json
import os

import duckdb
import pytest

import __spark_entry__ as entry
from waymark.operators import lookup, search
from waymark.plans import queries as gazetteer

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no fixtures here")


def rows(df):
    df = df[sorted(df.columns)]
    return sorted(tuple("%.9g" % v if isinstance(v, float) else str(v) for v in r) for r in df.itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in os.listdir(SF):
        c.execute(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{t}'")
    return c


def test_entry(spark):
    assert "name" in entry.entry(spark).columns


@pytest.mark.parametrize("name", sorted(gazetteer.QUERIES))
def test_query(spark, duck, name):
    got = gazetteer.QUERIES[name](spark, SF).toPandas()
    if name in gazetteer.SQL:
        want = duck.execute(gazetteer.SQL[name]).fetchdf()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)


@pytest.fixture(scope="module")
def shared_ids(tmp_path_factory):
    """(folder, DuckDB): a county for each nation and remainder, and parts with the ids of every other county."""
    folder, c = tmp_path_factory.mktemp("shared"), duckdb.connect()
    more = {
        "supplier": f"UNION ALL SELECT s.* REPLACE (100 + k AS s_suppkey, k // 4 AS s_nationkey) FROM '{SF}/supplier.parquet' s, range(100) AS r(k) WHERE s_suppkey = 0",
        "part": f"UNION ALL SELECT p.* REPLACE (1000100 + 2 * k + p_partkey % 2 * (k % 3) AS p_partkey) FROM '{SF}/part.parquet' p, range(50) AS r(k) WHERE p_partkey < 2",
    }
    for t in (f.removesuffix(".parquet") for f in os.listdir(SF)):
        c.execute(f"COPY (SELECT * FROM '{SF}/{t}.parquet' {more.get(t, '')}) TO '{folder}/{t}.parquet' (FORMAT parquet)")
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return str(folder), c


def shared(shared_ids, spark, name):
    folder, c = shared_ids
    got, want = gazetteer.QUERIES[name](spark, folder).toPandas(), c.execute(gazetteer.SQL[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    return got, want


def test_localise_shared_ids(spark, shared_ids):
    got, want = shared(shared_ids, spark, "localise")
    assert rows(got) == rows(want) and len(want) > want["id"].nunique()


def test_json_render_shared_ids(spark, shared_ids):
    got, want = shared(shared_ids, spark, "json_render")
    assert rows(got) == rows(want) and len(want) > want["id"].nunique()


def test_json_results_shared_ids(spark, shared_ids):
    """The SQL leaves the order of one id's rows open: here they go by their columns, in every run."""
    got, want = ([json.dumps(r) for r in json.loads(t["json"][0])["results"]] for t in shared(shared_ids, spark, "json_results"))
    assert sorted(got) == sorted(want) and len(got) > 10
    assert [json.loads(r)["id"] for r in got] == [json.loads(r)["id"] for r in want]
    assert [json.loads(r)["name"] for r in got] == [json.loads(r)["name"] for r in want]
    for a, b in zip(map(json.loads, got), map(json.loads, got[1:])):
        assert a["id"] != b["id"] or a.get("admin2", "") <= b.get("admin2", "")


def test_batch_asks_every_part(spark):
    got = {}
    for r in gazetteer.QUERIES["search_batch"](spark, SF).orderBy("qid", "rank").collect():
        got.setdefault(r["qid"], []).append(r["id"])
    index = [r for r in gazetteer.database(spark, SF)["name_index"].collect() if r["tree"] in ("", "en")]
    want = {}
    for p in spark.read.parquet(f"{SF}/part.parquet").collect():
        m = 1 + p["p_partkey"] % 6
        q = p["p_name"][:m].lower()
        if hits := {r["id"] for r in index if (r["folded"] == q if m <= 2 else r["folded"].startswith(q))}:
            want[p["p_partkey"]] = hits
    assert got.keys() == want.keys() and {k % 4 for k in want} == {0, 1, 2, 3}
    assert all(len(ids) == min(5, len(want[k])) and want[k].issuperset(ids) for k, ids in got.items())


def scan(df):
    return next(x for x in df._jdf.queryExecution().executedPlan().toString().splitlines() if "FileScan" in x)


def test_requests_reach_the_stored_tables(spark):
    tables = gazetteer.database(spark, SF)
    names = scan(search.matches(tables["name_index"], "customer", ["", "en"]))
    assert "PartitionFilters: [tree" in names and "StringStartsWith(folded,customer)" in names
    place = scan(lookup.by_ids(tables["places"], [5000007]).select("id", "name"))
    assert "EqualTo(id,5000007)" in place or "In(id, [5000007])" in place
    assert place.endswith("ReadSchema: struct<id:int,name:string>")
