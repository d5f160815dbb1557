import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from waymark import schema
from waymark.functions.text import fold_literal
from waymark.operators import altnames, index, proximity, render, search
from waymark.plans import build
from waymark.plans.service import Gazetteer, LocationNotFound
from waymark.sources import dumps, store
from waymark.streaming.requests import answer_stream

#: id, name, lat, lon, code, country, cc2, a1, a2, population, elevation, dem
ROWS = [
    (1, "Germany", 51, 9, "PCLI", "DE", "", "00", "", 83000000, "", 303),
    (2, "Bavaria", 49, 12, "ADM1", "DE", "", "02", "", 13000000, "", 500),
    (3, "Bavaria again", 49, 12, "ADM1", "DE", "", "02", "", 0, "", 500),
    (4, "Berlin", 52.5, 13.4, "PPLC", "DE", "", "16", "", 3400000, "74", 43),
    (5, "Berlin Mitte", 52.52, 13.4, "PPLX", "DE", "", "16", "", 79000, "", 45),
    (6, "München", 48.1, 11.6, "PPLA", "DE", "", "02", "091", 1260000, "", 524),
    (7, "Munich Airport", 48.35, 11.8, "AIRP", "DE", "", "02", "091", 0, "-5", 453),
    (8, "Grenzdorf", 47.6, 9.5, "PPL", "DE", "DE,CH", "02", "", 900, "", -9999),
    (9, "A stream", 47.6, 9.5, "STM", "DE", "", "02", "", 0, "", 1),
    (10, "France", 46, 2, "PCLI", "FR", "", "00", "", 64000000, "", 1),
    (11, "Berlin", 48, 2, "PPL", "FR", "", "99", "", 10, "", 1),
]
ALT = [
    (4, "de", "Berlin", "1", "", "", ""), (4, "fr", "Berlin-sur-Spree", "", "", "", ""), (4, "fr", "Berline", "1", "", "", ""), (4, "fr", "Berl", "1", "1", "", ""),
    (4, "post", "10115", "", "", "", ""), (4, "post", "10117", "", "", "", ""), (4, "post", "00000", "", "", "", "1"), (1, "de", "Deutschland", "", "", "", ""),
    (6, "en", "Munich", "1", "", "", ""), (6, "en", "Monaco", "", "", "1", ""), (7, "iata", "MUC", "", "", "", ""), (6, "", "Minga", "", "", "", ""), (6, "link", "http://x", "", "", "", ""), (4, "en", "Berlin", "", "", "", ""),
]


def place_lines():
    for i, name, lat, lon, code, country, cc2, a1, a2, people, height, dem in ROWS:
        yield "\t".join(map(str, [i, name, name, "", lat, lon, "X", code, country, cc2, a1, a2, "", "", people, height, dem, "Europe/Berlin", "2020-01-01"]))
    yield "12\tshort row"


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("dumps")
    (d / "places.txt").write_text("\n".join(place_lines()))
    (d / "alt.txt").write_text("\n\n".join("\t".join([str(k), str(a[0]), *a[1:], "", ""]) for k, a in enumerate(ALT)) + "\n")
    return d


@pytest.fixture(scope="module")
def server(spark, folder):
    tables = build.load_or_create(spark, str(folder / "db"), str(folder / "places.txt"), str(folder / "alt.txt"))
    return Gazetteer(tables)


def test_database_is_built_once(spark, folder, server):
    assert store.exists(spark, str(folder / "db"))
    again = build.load_or_create(spark, str(folder / "db"), "nowhere", "nowhere")
    assert again["places"].count() == 10


def test_short_rows_are_set_apart(spark, folder):
    rows = dumps.fields(dumps.lines(spark, str(folder / "places.txt")), schema.PLACE_COLUMNS)
    typed, rejected = dumps.places(rows)
    assert typed.count() == 11 and [r["id"] for r in rejected.collect()] == ["12"]


def test_stored_rows(server):
    got = {r["id"]: r for r in server.places.collect()}
    assert set(got) == {1, 2, 3, 4, 5, 6, 7, 8, 10, 11}
    assert got[6]["admin1_id"] == 3 and got[2]["admin1_id"] == 3, "the last row of a key wins"
    assert got[8]["admin1_id"] == 0, "cc2 is a part of the key"
    assert got[4]["country_id"] == 1 and got[4]["postcodes"] == ["10115", "10117"]
    assert (got[4]["elevation"], got[7]["elevation"], got[8]["elevation"]) == (74.0, 5.0, 9999.0)
    assert got[4]["alternative_names"] == {"de": "Berlin", "fr": "Berl", "en": "Berlin"}
    assert got[4]["ranking"] == pytest.approx(1.4, abs=1e-5)


def test_search(server):
    assert [r["id"] for r in server.search("Berlin").collect()] == [4, 11, 5]
    assert [r["id"] for r in server.search("munich").collect()] == [6, 7]
    assert [r["id"] for r in server.search("MUC").collect()] == [7]
    assert [r["id"] for r in server.search("10115").collect()] == [4]
    assert server.search("Bavaria").count() == 0, "administrative areas are not indexed"
    assert server.search("b").count() == 0 and server.search("be").count() == 0


def test_filters_follow_the_limit(server):
    assert server.search("Berlin", country_code="FR", count=1).count() == 0
    assert [r["id"] for r in server.search("Berlin", country_code="FR", count=1, filter_before_limit=True).collect()] == [11]
    assert [r["id"] for r in server.search("Berlin, Germany").collect()] == [4, 5]
    assert server.search("Berlin, Bavaria").count() == 0 and server.search("Berlin, x").count() == 3


def test_counts_and_ids_are_checked(server):
    for bad in (0, 101, -1):
        with pytest.raises(ValueError, match="between 1 and 100"):
            server.search("Berlin", count=bad)
    with pytest.raises(LocationNotFound, match="not found"):
        server.get(999)


def test_localised_get(server):
    row = server.get(4, "de").first()
    assert (row["name"], row["country"], row["admin1"]) == ("Berlin", "Deutschland", "")
    assert server.get(6, "xx").first()["name"] == "Munich", "an unknown language is English"
    assert server.get(2).first()["name"] == "Bavaria"


def test_json_and_protobuf(server):
    row = server.get(4, "de")
    got = json.loads(render.to_json(row).first()["json"])
    assert list(got) == ["id", "name", "latitude", "longitude", "elevation", "feature_code", "country_code", "timezone", "population", "postcodes", "country_id", "country"]
    body = render.to_protobuf(row, "id").first()["protobuf"]
    assert body == render.encode_message(row.first().asDict()) and body.startswith(b"\x08\x04\x12\x06Berlin\x25")
    answer = json.loads(server.answer(server.search("Berlin").drop("rank")))
    assert [r["id"] for r in answer["results"]] == [4, 11, 5] and "generationtime_ms" in answer
    assert server.answer(server.search("Berlin").drop("rank"), "protobuf")[:1] == b"\x0a"


def test_floats_are_written_as_in_proto3_json(spark):
    want = {47.54729: "47.54729", 10.0: "10.0", -5.5: "-5.5", 0.002: "0.002", 1e-4: "0.0001", -1.2345e-4: "-0.00012345", 1e-5: "1e-05", 1.5e-12: "1.5e-12", 9999999.0: "9999999.0",
            12345678.0: "12345678.0", 1e7: "10000000.0", 16777216.0: "16777216.0", 2e7: "2e+07", -3.5e20: "-3.5e+20", float("inf"): '"Infinity"', float("-inf"): '"-Infinity"'}
    rows = spark.createDataFrame(list(enumerate(want)), "k int, x float").orderBy("k")
    assert [r[0] for r in rows.select(render.float_text(F.col("x"))).collect()] == list(want.values())
    assert rows.limit(1).select(render.float_text(F.lit(float("nan")).cast("float")), render.float_text(F.lit(None).cast("float"))).first()[:] == ('"NaN"', None)


def decoded(data):
    """(field number, wire type, value) of a message, read by the wire format's rules alone."""
    at, out = 0, []

    def varint():
        nonlocal at
        n = shift = 0
        while True:
            b = data[at]
            at += 1
            n |= (b & 127) << shift
            shift += 7
            if b < 128:
                return n

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            value = varint()
        elif kind == 5:
            value, at = np.frombuffer(data, "<f4", 1, at)[0], at + 4
        else:
            assert kind == 2
            n = varint()
            value, at = data[at : at + n], at + n
        out.append((tag >> 3, kind, value))
    assert at == len(data)
    return out


def test_protobuf_read_by_another_decoder(server):
    rows = server.search("Berlin").collect() + server.search("munich").collect()
    kinds = {"str": 2, "int": 0, "float": 5, "list": 2}
    for r in rows:
        want = []
        for c, number in schema.RESPONSE_FIELDS.items():
            v = r[c]
            for x in v if isinstance(v, list) else [v] * bool(v):
                want.append((number, kinds[type(x).__name__], x.encode() if isinstance(x, str) else x))
        assert decoded(render.encode_message(r.asDict())) == want
    body = render.encode_results([r.asDict() for r in rows], 1.5)
    assert [(n, k) for n, k, _ in decoded(body)] == [(1, 2)] * len(rows) + [(2, 5)] and decoded(body)[-1][2] == 1.5


def test_batch_equals_single_searches(spark, server):
    names = ["Berlin", "Mun", "mü", "M", "muc", "10", "101", "Berlin Mitte", "zzz", "É"]
    asked = spark.createDataFrame([(k, n, "en") for k, n in enumerate(names)], "qid int, name string, language string")
    got = {}
    for r in server.search_many(asked, 3).collect():
        got.setdefault(r["qid"], []).append((r["rank"], r["id"]))
    for k, n in enumerate(names):
        want = [r["id"] for r in search.search_ids(server.index, n, "en", 3).collect()]
        assert [i for _, i in sorted(got.get(k, []))] == want, n


def test_stream_of_requests(spark, server, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"qid": 1, "name": "Berlin", "language": "en"}\n{"qid": 2, "name": "munich", "language": "en"}\n')
    asked = spark.readStream.schema("qid int, name string, language string").json(str(tmp_path / "in"))
    q = answer_stream(server.index, asked, str(tmp_path / "out"), str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out")).orderBy("qid", "rank").collect()
    assert [(r["qid"], r["id"]) for r in got] == [(1, 4), (1, 11), (1, 5), (2, 6), (2, 7)]


def _alt(spark, rows):
    return spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "line int, place_id int, lang string, name string, preferred int, short int, colloquial int, historic int")


def test_languages_come_in_order_of_first_use(spark):
    langs = "ja nl pt sk sv tr it link link fa uk bar ko he mr be ka pnb lt ru zh ar mk wkdt".split()
    rows = _alt(spark, [(2760454, x, f"Zugspitze {x}", 0, 0, 0, 0) for x in langs])
    got = [r["lang"] for r in altnames.languages(rows).orderBy("code").collect()]
    assert got == [x for x in langs if x not in ("link", "wkdt")] and len(got) == 21


def test_historic_names_are_not_used(spark):
    rows = [("", "Kolyvan", 0), ("", "Revel'", 0), ("", "Reval", 1), ("de", "Tallinn", 0), ("en", "Tallinn", 0), ("de", "Reval", 1), ("en", "Revel", 1)]
    got = {r["lang"]: r["name"] for r in altnames.preferred_names(_alt(spark, [(588409, a, b, int(a == "de" and not h), 0, 0, h) for a, b, h in rows])).collect()}
    assert got == {"": "Kolyvan", "de": "Tallinn", "en": "Tallinn"}


def test_top_k(spark):
    seen = [(1, 0.5), (2, 0.6), (3, 0.6), (3, 0.7), (3, 0.6), (4, 0.6), (5, 0.6), (6, 0.8), (7, 0.0)]
    rows = spark.createDataFrame(seen, "id int, priority float")
    assert [r["id"] for r in search.top_k(rows, 5).collect()] == [6, 3, 2, 4, 5]
    both = search.top_k(rows.withColumn("q", F.lit(1)), 5, ["q"]).orderBy("rank")
    assert [r["id"] for r in both.collect()] == [6, 3, 2, 4, 5]


def test_nearest(spark):
    rows = spark.createDataFrame([(i, i / 10, i / 10) for i in range(256)], "id int, latitude float, longitude float")
    got = proximity.nearest(rows, 0.72, 0.71, 5, 500.0).collect()
    assert [r["id"] for r in got][:2] == [7, 8]
    assert [r["distance"] for r in got][:2] == pytest.approx([2.486387, 13.3895855], rel=1e-5)
    points = spark.createDataFrame([(i, i / 10 + 0.02, i / 10 + 0.01) for i in range(1, 200)], "qid int, latitude double, longitude double")
    first = proximity.nearest_batch(rows, points, 5, 500.0).where("rank = 1").collect()
    assert len(first) == 199 and all(r["qid"] == r["id"] for r in first)


class Trie:
    """A trie that splits its leaves, for the closed form to be held against."""

    def __init__(self, limit):
        self.limit, self.leaf, self.ends, self.below = limit, [], [], {}

    def add(self, s, i):
        if not s:
            self.ends.append(i)
        elif self.leaf is None:
            self.below.setdefault(s[0], Trie(self.limit)).add(s[1:], i)
        else:
            self.leaf.append((s, i))
            if len(self.leaf) >= self.limit:
                old, self.leaf = self.leaf, None
                for t, j in old:
                    self.add(t, j)

    def scores(self, q, factor=1.5):
        """(id, score without ranking) of names that start with q, from the node where q ends."""
        if q:
            if self.leaf is None:
                return self.below[q[0]].scores(q[1:]) if q[0] in self.below else []
            return [(i, 1.5 if s == q else 1.5 / (len(s) + 1)) for s, i in self.leaf if s.startswith(q)]
        out = [(i, 1.5) for i in self.ends]
        return out + self.deep(1.5)

    def deep(self, factor):
        if self.leaf is not None:
            return [(i, factor / (len(s) + 1)) for s, i in self.leaf]
        out = []
        for t in self.below.values():
            out += [(i, factor / 2) for i in t.ends] + t.deep(factor / 2)
        return out


def test_closed_form_equals_a_trie(spark):
    rng = random.Random(7)
    names = ["".join(rng.choices("abC", k=rng.randint(1, 7))) for _ in range(400)]
    rows = spark.createDataFrame([("", n, i, 0.0) for i, n in enumerate(names, 1)], "tree string, name string, id int, ranking float")
    entries = index.folded_rows(rows)
    split = index.split_prefixes(entries, 8).cache()
    built = index.with_depth(entries, split).cache()
    depths = sorted((r["id"], r["depth"]) for r in built.collect())
    for most in (0, 5, 20):  # no level, the first ones, more of them broadcast
        assert depths == sorted((r["id"], r["depth"]) for r in index.with_depth(entries, split, most).collect())
    assert {(r["id"], r["depth"]) for r in index.with_depth(entries, split.limit(0)).collect()} == {(i, 0) for i, _ in depths}
    trie = Trie(8)
    for i, n in enumerate(names, 1):
        trie.add(fold_literal(n), i)
    for q in ["a", "ab", "abc", "abca", "b", "c", "cccc", "bacab", "x"]:
        want = {}
        for i, s in trie.scores(q):
            want[i] = max(want.get(i, 0), s)
        got = {r["id"]: r["priority"] for r in search.top_k(search.matches(built, q, [""], exact=False), 1000).collect()}
        assert set(got) == set(want) and all(got[i] == pytest.approx(want[i], rel=1e-6) for i in got), q
