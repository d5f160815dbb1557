"""A gazetteer made of the driver's tables: the dumps' rows in SQL that Spark and DuckDB both read."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.operators.altnames import languages
from waymark.operators.index import name_index
from waymark.plans.build import denormalise
from waymark.session import materialise, shared_folder, table
from waymark.sources import store

RAW_PLACES = """
SELECT id, name, feature_code, country_iso2, cc2, admin1, admin2, admin3, admin4, population,
  CAST(CAST((id * 37) % 18000 AS DOUBLE) / 100 - 90 AS FLOAT) AS latitude, CAST(CAST((id * 91) % 36000 AS DOUBLE) / 100 - 180 AS FLOAT) AS longitude,
  CAST(id % 900 AS FLOAT) AS elevation, concat('Zone/', country_iso2) AS timezone, CAST(id AS BIGINT) AS line
FROM (
  SELECT CAST(1000000 + r_regionkey AS INT) AS id, r_name AS name, 'PCLI' AS feature_code, concat('R', CAST(r_regionkey AS STRING)) AS country_iso2, '' AS cc2, '' AS admin1, '' AS admin2, '' AS admin3, '' AS admin4, CAST(0 AS BIGINT) AS population FROM region
  UNION ALL
  SELECT CAST(2000000 + n_nationkey AS INT), n_name, 'ADM1', concat('R', CAST(n_regionkey AS STRING)), '', CAST(n_nationkey AS STRING), '', '', '', CAST(0 AS BIGINT) FROM nation
  UNION ALL
  SELECT CAST(6000000 + s_suppkey AS INT), concat(s_name, ' county'), 'ADM2', concat('R', CAST(n_regionkey AS STRING)), '', CAST(s_nationkey AS STRING), CAST(s_suppkey % 4 AS STRING), '', '', CAST(0 AS BIGINT) FROM supplier JOIN nation ON s_nationkey = n_nationkey
  UNION ALL
  SELECT CAST(7000000 + s_suppkey AS INT), concat(s_name, ' district'), 'ADM3', concat('R', CAST(n_regionkey AS STRING)), '', CAST(s_nationkey AS STRING), CAST(s_suppkey % 4 AS STRING), CAST(s_suppkey % 3 AS STRING), '', CAST(0 AS BIGINT) FROM supplier JOIN nation ON s_nationkey = n_nationkey
  UNION ALL
  SELECT CAST(8000000 + s_suppkey AS INT), concat(s_name, ' parish'), 'ADM4', concat('R', CAST(n_regionkey AS STRING)), '', CAST(s_nationkey AS STRING), CAST(s_suppkey % 4 AS STRING), CAST(s_suppkey % 3 AS STRING), CAST(s_suppkey % 2 AS STRING), CAST(0 AS BIGINT) FROM supplier JOIN nation ON s_nationkey = n_nationkey
  UNION ALL
  SELECT CAST(3000000 + c_custkey AS INT), c_name, CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'PPL' WHEN 'BUILDING' THEN 'PPLA' WHEN 'FURNITURE' THEN 'PPLA2' WHEN 'HOUSEHOLD' THEN 'PPLX' ELSE 'STM' END,
    concat('R', CAST(n_regionkey AS STRING)), CASE WHEN c_custkey % 7 = 0 THEN 'X,Y' ELSE '' END, CAST(c_nationkey AS STRING), CAST(c_custkey % 4 AS STRING), CAST(c_custkey % 3 AS STRING), CAST(c_custkey % 2 AS STRING), CAST(floor(abs(c_acctbal) * 100) AS BIGINT)
  FROM customer JOIN nation ON c_nationkey = n_nationkey
  UNION ALL
  SELECT CAST(4000000 + s_suppkey AS INT), s_name, 'AIRP', concat('R', CAST(n_regionkey AS STRING)), '', CAST(s_nationkey AS STRING), CAST(s_suppkey % 5 AS STRING), '', '', CAST(0 AS BIGINT) FROM supplier JOIN nation ON s_nationkey = n_nationkey
  UNION ALL
  SELECT CAST(5000000 + p_partkey AS INT), p_name, CASE p_size % 4 WHEN 0 THEN 'PPL' WHEN 1 THEN 'PPLA3' WHEN 2 THEN 'MT' ELSE 'ISL' END,
    concat('R', CAST(p_partkey % 5 AS STRING)), '', CAST(p_partkey % 25 AS STRING), CAST(p_partkey % 4 AS STRING), CAST(p_partkey % 3 AS STRING), '', CAST(floor(p_retailprice * 100) AS BIGINT) FROM part
) AS dump
"""
ALT_NAMES = """
SELECT CAST(5000001 + doc_id % 200 AS INT) AS place_id,
  CASE WHEN doc_id % 11 = 0 THEN 'post' WHEN doc_id % 13 = 0 THEN '' WHEN doc_id % 17 = 0 THEN 'link' ELSE lang END AS lang,
  substr(text, 1, 24) AS name, CASE WHEN doc_id % 5 = 0 THEN 1 ELSE 0 END AS preferred, CASE WHEN doc_id % 7 = 0 THEN 1 ELSE 0 END AS short,
  CASE WHEN doc_id % 19 = 0 THEN 1 ELSE 0 END AS colloquial, CASE WHEN doc_id % 23 = 0 THEN 1 ELSE 0 END AS historic, doc_id AS line
FROM documents
"""
#: A leaf of the index splits at so many names, so that small fixtures have depths.
THRESHOLD = 64


def rows(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """One of the texts above over the folder's tables."""
    names = [n for n in ("region", "nation", "customer", "supplier", "part", "documents") if f" {n}" in sql]
    return spark.sql(_bound(sql, names), **{n: table(spark, sf_dir, n) for n in names})


def _bound(sql: str, names: list[str]) -> str:
    for n in names:
        for word in ("FROM", "JOIN"):
            sql = sql.replace(f"{word} {n}", f"{word} {{{n}}}")
    return sql


def raw_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(spark, sf_dir, RAW_PLACES)


def alt_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(spark, sf_dir, ALT_NAMES)


_built: dict[tuple[str, str], dict[str, DataFrame]] = {}


def database(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The stored tables that requests read, built once in an application, as a server's are."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _built:
        alt, folder = alt_names(spark, sf_dir), f"{shared_folder(spark)}/gazetteer-{uuid.uuid4().hex}"
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
        places = materialise(denormalise(raw_places(spark, sf_dir), alt))
        store.write(folder, places, name_index(places, THRESHOLD), languages(alt))
        _built[key] = store.read(spark, folder)
    return _built[key]


#: The same database in DuckDB's SQL, common table expressions over those above.
DUCK = f"""
WITH raw AS ({RAW_PLACES}), alts AS ({ALT_NAMES}),
loaded AS (SELECT * FROM raw WHERE feature_code IN ('ADM1','ADM2','ADM3','ADM4','ADM5','PCLI','PPL','PPLA','PPLA2','PPLA3','PPLX','AIRP','MT','ISL')),
usable AS (SELECT * FROM alts WHERE lang NOT IN ('link', 'wkdt', 'fr_1793') AND NOT (colloquial = 1 OR historic = 1)),
picked AS (SELECT place_id, lang, name FROM usable WHERE lang <> 'post'
  QUALIFY row_number() OVER (PARTITION BY place_id, lang ORDER BY CASE WHEN preferred <> 0 AND short <> 0 THEN 0 WHEN preferred <> 0 THEN 1 WHEN short <> 0 THEN 2 ELSE 3 END, line) = 1),
codes AS (SELECT place_id, list(name ORDER BY line) AS postcodes FROM usable WHERE lang = 'post' GROUP BY place_id),
adm1 AS (SELECT country_iso2, cc2, admin1, arg_max(id, line) AS admin1_id FROM loaded WHERE feature_code = 'ADM1' GROUP BY ALL),
adm2 AS (SELECT country_iso2, cc2, admin1, admin2, arg_max(id, line) AS admin2_id FROM loaded WHERE feature_code = 'ADM2' GROUP BY ALL),
adm3 AS (SELECT country_iso2, cc2, admin1, admin2, admin3, arg_max(id, line) AS admin3_id FROM loaded WHERE feature_code = 'ADM3' GROUP BY ALL),
adm4 AS (SELECT country_iso2, cc2, admin1, admin2, admin3, admin4, arg_max(id, line) AS admin4_id FROM loaded WHERE feature_code = 'ADM4' GROUP BY ALL),
pcli AS (SELECT country_iso2, arg_max(id, line) AS country_id FROM loaded WHERE feature_code = 'PCLI' GROUP BY ALL),
places AS (SELECT l.*, coalesce(admin1_id, 0) AS admin1_id, coalesce(admin2_id, 0) AS admin2_id, coalesce(admin3_id, 0) AS admin3_id, coalesce(admin4_id, 0) AS admin4_id, coalesce(country_id, 0) AS country_id, coalesce(postcodes, []) AS postcodes,
    CASE WHEN population <= 0 THEN 0::FLOAT ELSE (1::FLOAT / (1::FLOAT + 25::FLOAT * pow(2.718281828459045::FLOAT::DOUBLE, ((-2.0e-5)::FLOAT * population::FLOAT)::DOUBLE)::FLOAT))::FLOAT END
    + CASE WHEN len(coalesce(postcodes, [])) > 0 THEN 0.1::FLOAT ELSE 0::FLOAT END
    + CASE feature_code WHEN 'PPL' THEN 0.1::FLOAT WHEN 'PPLA' THEN 0.3::FLOAT WHEN 'PPLA2' THEN 0.23::FLOAT WHEN 'PPLA3' THEN 0.2::FLOAT ELSE 0::FLOAT END AS ranking
  FROM loaded l LEFT JOIN adm1 USING (country_iso2, cc2, admin1) LEFT JOIN adm2 USING (country_iso2, cc2, admin1, admin2)
    LEFT JOIN adm3 USING (country_iso2, cc2, admin1, admin2, admin3) LEFT JOIN adm4 USING (country_iso2, cc2, admin1, admin2, admin3, admin4) LEFT JOIN pcli USING (country_iso2) LEFT JOIN codes c ON c.place_id = l.id),
indexed AS (SELECT * FROM places WHERE feature_code NOT IN ('PCL','ADM1','ADM2','ADM3','ADM4','ADM5')),
named AS (
  SELECT '' AS tree, name, id, ranking FROM indexed
  UNION ALL SELECT '', p.name, id, ranking FROM picked p JOIN indexed ON place_id = id WHERE lang IN ('', 'iata', 'icao')
  UNION ALL SELECT '', unnest(postcodes), id, ranking FROM indexed
  UNION ALL SELECT lang, p.name, id, ranking FROM picked p JOIN indexed ON place_id = id WHERE lang <> ''),
entries AS (SELECT row_number() OVER () AS e, tree, lower(strip_accents(name)) AS folded, length(lower(strip_accents(name))) AS n, id, ranking FROM named),
prefixes AS (SELECT e, tree, substr(folded, 1, CAST(k AS INT)) AS prefix FROM entries, unnest(range(0, n)) AS u(k)),
split AS (SELECT tree, prefix, count(*) AS extensions FROM prefixes GROUP BY ALL HAVING count(*) >= {THRESHOLD}),
deep AS (SELECT e, max(length(prefix)) + 1 AS depth FROM prefixes JOIN split USING (tree, prefix) GROUP BY e),
idx AS (SELECT tree, folded, n, coalesce(depth, 0) AS depth, id, ranking FROM entries LEFT JOIN deep USING (e))
"""


def duck_priority(q: str, m: str) -> str:
    return f"CASE WHEN folded = {q} THEN 1.5::FLOAT + ranking ELSE (1.5::DOUBLE / (pow(2, greatest(0, depth - {m})) * (n - depth + 1)))::FLOAT + ranking END"


def duck_hits(query: str, language: str, count: int, name: str = "hits") -> str:
    """A table expression (id, priority): the `count` best of the main tree and a language's."""
    match = f"folded = '{query}'" if len(query) <= 2 else f"starts_with(folded, '{query}')"
    return f"{name} AS (SELECT id, max({duck_priority(f"'{query}'", str(len(query)))}) AS priority FROM idx WHERE tree IN ('', '{language}') AND {match} GROUP BY id ORDER BY priority DESC, id LIMIT {count})"
