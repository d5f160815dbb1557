"""Schemas: explicit, never inferred."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(text: str) -> T.StructType:
    return T._parse_datatype_string(text)


#: Columns of the two dumps, in file order.
PLACE_COLUMNS = ("id name asciiname alternatenames latitude longitude feature_class feature_code country_iso2 cc2 "
    "admin1 admin2 admin3 admin4 population elevation dem timezone modified").split()  # fmt: skip
ALT_NAME_COLUMNS = "alt_id place_id lang name preferred short colloquial historic valid_from valid_to".split()
POSTCODE_COLUMNS = "country postcode place_name admin_name1 admin_code1 admin_name2 admin_code2 admin_name3 admin_code3 latitude longitude accuracy".split()

#: A stored place.  A population is unsigned 32 bits wide, so long here; 0, '' and empty stand for missing.
PLACES = ("id int, name string, latitude float, longitude float, ranking float, elevation float, feature_code string, "
    "country_iso2 string, country_id int, admin1_id int, admin2_id int, admin3_id int, admin4_id int, timezone string, "
    "population bigint, alternative_names map<string,string>, postcodes array<string>")  # fmt: skip

#: One entry a name, tree and place; tree '' is the main one, others are languages.
NAME_INDEX = "tree string, folded string, n int, depth int, id int, ranking float"

#: A response row, in the order of the wire format's field numbers.
RESPONSE_FIELDS = {"id": 1, "name": 2, "latitude": 4, "longitude": 5, "elevation": 7, "feature_code": 8, "country_code": 9, "admin1_id": 10, "admin2_id": 11, "admin3_id": 12, "admin4_id": 13, "timezone": 14, "population": 15, "postcodes": 17, "country_id": 18, "country": 19, "admin1": 20, "admin2": 21, "admin3": 22, "admin4": 23}
RESPONSE = ("id int, name string, latitude float, longitude float, elevation float, feature_code string, country_code string, "
    "admin1_id int, admin2_id int, admin3_id int, admin4_id int, timezone string, population bigint, postcodes array<string>, "
    "country_id int, country string, admin1 string, admin2 string, admin3 string, admin4 string")  # fmt: skip
PARENTS = ("country", "admin1", "admin2", "admin3", "admin4")
