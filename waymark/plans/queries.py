"""A query for each operator on the driver's tables, with its SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark import schema
from waymark.functions import geo, numbers, ranking, text
from waymark.operators import altnames, features, hierarchy, index, lookup, proximity, render, search
from waymark.plans import build
from waymark.plans.fixtures import DUCK, THRESHOLD, alt_names, database, duck_hits, duck_priority, raw_places
from waymark.plans.service import Gazetteer
from waymark.session import table
from waymark.sources import dumps

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _service(spark: SparkSession, sf_dir: str) -> Gazetteer:
    return Gazetteer(database(spark, sf_dir))


@query(f"{DUCK} SELECT feature_code, feature_code IN (SELECT feature_code FROM loaded) AS loaded, feature_code NOT IN ('PCL','ADM1','ADM2','ADM3','ADM4','ADM5') AS indexed, count(*) AS places FROM raw GROUP BY ALL")
def feature_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.col("feature_code")
    return raw_places(spark, sf_dir).groupBy("feature_code", features.is_loaded(code).alias("loaded"), features.is_indexed(code).alias("indexed")).agg(F.count("*").alias("places"))


_FIELD = "CASE WHEN c_custkey % 9 = 0 THEN '' WHEN c_custkey % 10 = 0 THEN 'x1' ELSE CAST(CAST(floor(c_acctbal) AS BIGINT) AS STRING) END"


@query(f"""SELECT c_custkey, coalesce(abs(try_cast(x AS INT)), 0) AS as_int32, CASE WHEN instr(x, '-') > 0 THEN 0 ELSE coalesce(try_cast(x AS BIGINT), 0) END AS as_uint32,
  coalesce(abs(try_cast(x AS SMALLINT)), 0) AS as_int16, coalesce(try_cast(x AS TINYINT), 0) AS as_int8, coalesce(try_cast(x AS SMALLINT), 0) AS as_signed FROM (SELECT c_custkey, {_FIELD} AS x FROM customer)""")
def lenient_int_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("x")
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.expr(_FIELD).alias("x"))
    return rows.select("c_custkey", numbers.to_int32(x).alias("as_int32"), numbers.to_uint32(x).alias("as_uint32"), numbers.to_int16(x).alias("as_int16"), numbers.to_int8(x).alias("as_int8"), numbers.to_int16(x, signed=True).alias("as_signed"))


_TSV = "concat_ws(chr(9), CAST({0}key AS STRING), {0}name, '\"quoted', '', 'end')"


@query("SELECT CAST(string_split(t, chr(9))[1] AS INT) AS id, string_split(t, chr(9))[2] AS name, string_split(t, chr(9))[3] AS quoted, string_split(t, chr(9))[4] AS nothing, string_split(t, chr(9))[5] AS last FROM (SELECT " + _TSV.format("r_region").replace("r_regionname", "r_name") + " AS t FROM region UNION ALL SELECT " + _TSV.format("n_nation").replace("n_nationname", "n_name") + " FROM nation)")
def tsv_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = lambda key, name: F.concat_ws("\t", F.col(key).cast("string"), name, F.lit('"quoted'), F.lit(""), F.lit("end")).alias("value")
    lines = table(spark, sf_dir, "region").select(line("r_regionkey", "r_name")).union(table(spark, sf_dir, "nation").select(line("n_nationkey", "n_name")))
    out = dumps.fields(lines, ["id", "name", "quoted", "nothing", "last"])
    return out.withColumn("id", numbers.to_int32(F.col("id")))


@query("SELECT lang, row_number() OVER (ORDER BY min(doc_id)) - 1 AS code FROM documents GROUP BY lang")
def dictionary_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return altnames.dictionary(table(spark, sf_dir, "documents"), "lang", "doc_id")


@query(f"{DUCK} SELECT lang, row_number() OVER (ORDER BY min(line)) - 1 AS code FROM usable WHERE lang <> 'post' GROUP BY lang")
def languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return altnames.languages(alt_names(spark, sf_dir))


@query("SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey FROM orders GROUP BY o_custkey")
def lww_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.struct("o_orderdate", "o_orderkey").alias("line"))
    return hierarchy.last_write_wins(orders, ["o_custkey"], "o_orderkey", "line")


@query(f"{DUCK} SELECT id, country_id, admin1_id, admin2_id, admin3_id, admin4_id FROM places")
def hierarchy_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy.with_parents(features.loaded(raw_places(spark, sf_dir))).select("id", "country_id", "admin1_id", "admin2_id", "admin3_id", "admin4_id")


@query("SELECT concat_ws(chr(9), p_brand, coalesce(p_type, ''), CAST(p_size AS STRING)) AS span, max(p_partkey) AS last_key, count(*) AS parts FROM part GROUP BY 1")
def composite_span_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select(hierarchy.span_text(F.col("p_brand"), F.col("p_type"), F.col("p_size").cast("string")).alias("span"), "p_partkey")
    return rows.groupBy("span").agg(F.max("p_partkey").alias("last_key"), F.count("*").alias("parts"))


@query(f"{DUCK} SELECT place_id, lang, name FROM picked")
def preferred_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return altnames.preferred_names(alt_names(spark, sf_dir))


@query(f"{DUCK} SELECT place_id, array_to_string(postcodes, '|') AS postcodes FROM codes")
def ordered_collect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return altnames.postcodes(alt_names(spark, sf_dir)).withColumn("postcodes", F.array_join("postcodes", "|"))


@query("""SELECT o_orderkey, round(CAST((1::FLOAT / (1::FLOAT + 25::FLOAT * pow(2.718281828459045::FLOAT::DOUBLE, ((-2.0e-5)::FLOAT * floor(o_totalprice)::BIGINT::FLOAT)::DOUBLE)::FLOAT))::FLOAT AS DOUBLE), 6) AS population_rank
  FROM orders WHERE floor(o_totalprice) > 0 UNION ALL SELECT o_orderkey, 0 FROM orders WHERE floor(o_totalprice) <= 0""")
def logistic_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    rank = ranking.population_rank(F.floor("o_totalprice").cast("bigint"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.round(rank.cast("double"), 6).alias("population_rank"))


@query(f"{DUCK} SELECT id, round(CAST(ranking AS DOUBLE), 6) AS ranking FROM places")
def rank_bonus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build.denormalise(raw_places(spark, sf_dir), alt_names(spark, sf_dir)).select("id", F.round(F.col("ranking").cast("double"), 6).alias("ranking"))


@query("SELECT doc_id, lower(strip_accents(text)) AS folded FROM documents")
def fold_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.fold(F.col("text")).alias("folded"))


@query("SELECT event_id, CASE WHEN c THEN trim(string_split(x, ',')[1]) ELSE x END AS name, CASE WHEN c THEN trim(string_split(x, ',')[2]) ELSE '' END AS area FROM (SELECT event_id, x, contains(x, ',') AS c FROM (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN concat(' ', event_type, ' ') ELSE concat(' ', event_type, ' , ', CAST(user_id AS STRING), ' ,z') END AS x FROM events))")
def name_and_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit(" "), "event_type", F.lit(" "))).otherwise(F.concat(F.lit(" "), "event_type", F.lit(" , "), F.col("user_id").cast("string"), F.lit(" ,z")))
    name, area = text.name_and_area(x)
    return table(spark, sf_dir, "events").select("event_id", name.alias("name"), area.alias("area"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '' ELSE CAST(n_chars % 300 AS STRING) END AS elevation, CAST(CASE WHEN doc_id % 3 = 0 THEN doc_id % 500 ELSE n_chars % 300 END AS FLOAT) AS height FROM documents")
def elevation_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    nothing = {c: F.lit("0") for c in schema.PLACE_COLUMNS}
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("line"), "n_chars").select("line", *[v.alias(c) for c, v in nothing.items() if c not in ("elevation", "dem")], F.when(F.col("line") % 3 == 0, "").otherwise((F.col("n_chars") % 300).cast("string")).alias("elevation"), (F.col("line") % 500).cast("string").alias("dem"))
    typed, _ = dumps.places(rows)
    return rows.select("line", F.col("elevation").alias("field")).join(typed.select("line", F.col("elevation").alias("height")), "line").select(F.col("line").alias("doc_id"), F.col("field").alias("elevation"), "height")


@query(f"{DUCK} SELECT count(*) AS loaded, count(DISTINCT id) AS ids FROM loaded")
def count_loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build.count_loaded(features.loaded(raw_places(spark, sf_dir)))


@query(f"{DUCK} SELECT tree, folded, n, id FROM entries")
def name_index_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    places = build.denormalise(raw_places(spark, sf_dir), alt_names(spark, sf_dir))
    return index.folded_rows(index.name_rows(places)).select("tree", "folded", F.col("n").cast("bigint"), "id")


@query(f"{DUCK} SELECT tree, prefix, extensions FROM split")
def split_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.split_prefixes(index.folded_rows(index.name_rows(database(spark, sf_dir)["places"])), THRESHOLD)


@query(f"{DUCK} SELECT tree, folded, CAST(depth AS INT) AS depth, id FROM idx")
def leaf_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.name_index(database(spark, sf_dir)["places"], THRESHOLD).select("tree", "folded", "depth", "id")


def _hits(name: str, asked: str, language: str, count: int) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        best = search.search_ids(database(spark, sf_dir)["name_index"], asked, language, count)
        return best.select("id", F.round(F.col("priority").cast("double"), 6).alias("priority"))

    run.__name__ = name
    query(f"{DUCK}, {duck_hits(asked.lower(), language, count)} SELECT id, round(CAST(priority AS DOUBLE), 6) AS priority FROM hits")(run)


_hits("search_prefix", "red", "en", 20)
_hits("search_topk", "customer#0000", "en", 100)
_hits("search_two_trees", "the", "en", 50)
_hits("search_no_match", "zzzzq", "en", 10)


@query(f"{DUCK}, target AS (SELECT folded AS f FROM idx WHERE tree = '' ORDER BY folded LIMIT 1), hits AS (SELECT id, max(1.5::FLOAT + ranking) AS priority FROM idx, target WHERE tree = '' AND folded = f GROUP BY id) SELECT id, round(CAST(priority AS DOUBLE), 6) AS priority FROM hits ORDER BY priority DESC, id LIMIT 10")
def search_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = database(spark, sf_dir)["name_index"].where("tree = ''")
    first = rows.agg(F.min("folded")).first()[0]
    best = search.top_k(search.matches(rows, first, [""], exact=True), 10)
    return best.select("id", F.round(F.col("priority").cast("double"), 6).alias("priority"))


@query(f"{DUCK}, {duck_hits('customer', 'en', 100)} SELECT p.id, country_iso2 AS country_code FROM hits JOIN places p USING (id) WHERE country_iso2 = 'R1'")
def search_country_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _service(spark, sf_dir).search("Customer", country_code="R1", count=100).select("id", "country_code")




@query(f"{DUCK}, {duck_hits('customer', 'en', 100)}, target AS (SELECT lower(min(r_name)) AS f FROM region), area_hits AS (SELECT id, max({duck_priority('f', 'length(f)')}) AS priority FROM idx, target WHERE tree IN ('', 'en') AND starts_with(folded, f) GROUP BY id ORDER BY priority DESC, id LIMIT 10), areas AS (SELECT p.id AS area_id FROM area_hits JOIN places p USING (id) WHERE feature_code IN ('ADM1','ADM2','ADM3','ADM4','PCLI')) SELECT p.id, country_id FROM hits JOIN places p USING (id) WHERE country_id IN (SELECT area_id FROM areas) OR admin1_id IN (SELECT area_id FROM areas)")
def search_area_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    area = table(spark, sf_dir, "region").agg(F.min("r_name")).first()[0]
    return _service(spark, sf_dir).search(f"Customer, {area}", count=100).select("id", "country_id")


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("qid"), F.expr("substr(p_name, 1, CAST(1 + p_partkey % 6 AS INT))").alias("name"), F.lit("en").alias("language"))


def _answers(spark: SparkSession, sf_dir: str, asked: DataFrame) -> DataFrame:
    out = search.search_batch(database(spark, sf_dir)["name_index"], asked, 5)
    return out.select("qid", "id", "rank", F.round(F.col("priority").cast("double"), 6).alias("priority"))


@query(f"""{DUCK}, asked AS (SELECT p_partkey AS qid, lower(substr(p_name, 1, CAST(1 + p_partkey % 6 AS INT))) AS q, 1 + p_partkey % 6 AS raw FROM part),
scored AS (SELECT qid, id, max({duck_priority('q', 'length(q)')}) AS priority FROM asked JOIN idx ON tree IN ('', 'en') AND CASE WHEN raw <= 2 THEN folded = q ELSE starts_with(folded, q) END GROUP BY qid, id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY priority DESC, id) AS rank FROM scored) SELECT qid, id, CAST(rank AS INT) AS rank, round(CAST(priority AS DOUBLE), 6) AS priority FROM ranked WHERE rank <= 5""")
def search_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _answers(spark, sf_dir, _asked(spark, sf_dir))


_LOCAL = "localised AS (SELECT p.id, coalesce(a.name, p.name) AS local FROM places p LEFT JOIN picked a ON a.place_id = p.id AND a.lang = '{}')"
_PARENTS = "places p JOIN localised s ON s.id = p.id LEFT JOIN localised c ON c.id = p.country_id " + " ".join(f"LEFT JOIN localised a{k} ON a{k}.id = p.admin{k}_id" for k in range(1, 5))


@query(f"{DUCK}, {_LOCAL.format('fr')} SELECT p.id, s.local AS name, p.country_iso2 AS country_code, coalesce(c.local, '') AS country, coalesce(a.local, '') AS admin1, population, CAST(elevation AS DOUBLE) AS elevation, timezone FROM places p JOIN localised s ON s.id = p.id LEFT JOIN localised c ON c.id = p.country_id LEFT JOIN localised a ON a.id = p.admin1_id WHERE p.id = 5000007")
def get_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.get(database(spark, sf_dir)["places"], 5000007, "fr").select("id", "name", "country_code", "country", "admin1", "population", F.col("elevation").cast("double").alias("elevation"), "timezone")


@query(f"{DUCK}, {_LOCAL.format('de')} SELECT p.id, s.local AS name, coalesce(c.local, '') AS country, coalesce(a1.local, '') AS admin1, coalesce(a2.local, '') AS admin2, coalesce(a3.local, '') AS admin3, coalesce(a4.local, '') AS admin4 FROM {_PARENTS}")
def localise(spark: SparkSession, sf_dir: str) -> DataFrame:
    places = database(spark, sf_dir)["places"]
    return lookup.respond(places, places, "de").select("id", "name", "country", "admin1", "admin2", "admin3", "admin4")


def _duck_km(lat: str, lon: str) -> str:
    return f"(sqrt((latitude::DOUBLE - {lat}) * (latitude::DOUBLE - {lat}) + (longitude::DOUBLE - {lon}) * (longitude::DOUBLE - {lon})) / 360.0::DOUBLE * 40030.0::DOUBLE)::FLOAT"


@query(f"{DUCK} SELECT id, round(CAST({_duck_km('47.5', '8.5')} AS DOUBLE), 3) AS distance FROM places WHERE {_duck_km('47.5', '8.5')} <= 1500 ORDER BY {_duck_km('47.5', '8.5')}, id DESC LIMIT 25")
def nearest_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = proximity.nearest(database(spark, sf_dir)["places"], 47.5, 8.5, 25, 1500.0)
    return out.select("id", F.round(F.col("distance").cast("double"), 3).alias("distance"))


@query(f"""WITH points AS (SELECT vec_id AS qid, CAST(embedding[1] * 100 AS DOUBLE) AS qlat, CAST(embedding[2] * 200 AS DOUBLE) AS qlon FROM embeddings), {DUCK.strip().removeprefix('WITH ')},
near AS (SELECT qid, id, {_duck_km('qlat', 'qlon')} AS d FROM points JOIN places ON {_duck_km('qlat', 'qlon')} <= 600),
ranked AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY d, id DESC) AS rank FROM near) SELECT qid, id, CAST(rank AS INT) AS rank, round(CAST(d AS DOUBLE), 3) AS distance FROM ranked WHERE rank <= 3""")
def nearest_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("embedding")
    points = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("qid"), (e[0] * F.lit(100).cast("float")).cast("double").alias("latitude"), (e[1] * F.lit(200).cast("float")).cast("double").alias("longitude"))
    out = proximity.nearest_batch(database(spark, sf_dir)["places"], points, 3, 600.0)
    return out.select("qid", "id", "rank", F.round(F.col("distance").cast("double"), 3).alias("distance"))


@query("SELECT vec_id, round(2 * degrees(asin(0.5::DOUBLE * (vec_id % 3))) + radians(vec_id), 9) AS angle, CAST(ceil(vec_id / 7::DOUBLE) AS BIGINT) AS seventh FROM embeddings WHERE vec_id >= 0")
def degree_helpers(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("vec_id")
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(2 * F.degrees(F.asin(F.lit(0.5) * (v % 3))) + F.radians(v), 9).alias("angle"), geo.ceil_div(v, 7).alias("seventh"))


def _members(rows: str) -> str:
    """(id, json) of places: a member for each field that has not its default, in the order of field numbers."""
    text = {"name": "s.local", "feature_code": "feature_code", "country_code": "country_iso2", "timezone": "timezone", "country": "c.local"} | {f"admin{k}": f"a{k}.local" for k in range(1, 5)}
    out = []
    for c in schema.RESPONSE_FIELDS:
        if c in text:
            out.append(f"CASE WHEN {text[c]} <> '' THEN '\"{c}\":' || to_json({text[c]}) END")
        elif c == "postcodes":
            out.append(f"CASE WHEN len(p.postcodes) > 0 THEN '\"{c}\":' || to_json(p.postcodes) END")
        else:
            out.append(f"CASE WHEN p.{c} <> 0 THEN '\"{c}\":' || p.{c} END")
    return f"{rows} AS (SELECT p.id, '{{' || concat_ws(',', {', '.join(out)}) || '}}' AS json FROM {_PARENTS})"


@query(f"{DUCK}, {_LOCAL.format('en')}, {_members('written')} SELECT id, json FROM written")
def json_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    places = database(spark, sf_dir)["places"]
    return render.to_json(lookup.respond(places, places, "en"), "id")


@query(f"{DUCK}, {_LOCAL.format('en')}, {_members('written')}, {duck_hits('customer', 'en', 10)} SELECT coalesce('{{\"results\":[' || string_agg(json, ',' ORDER BY priority DESC, id) || ']}}', '{{}}') AS json FROM hits JOIN written USING (id)")
def json_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render.results_json(_service(spark, sf_dir).search("Customer", count=10))


@query()
def protobuf_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render.to_protobuf(_service(spark, sf_dir).search("red", count=50), "id")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best places for "red" in English, localised."""
    return _service(spark, sf_dir).search("red", language="en", count=20)
