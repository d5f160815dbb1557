"""The two requests, and searches by distance, on a database's tables."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waymark.operators import render
from waymark.operators.features import is_area
from waymark.operators.lookup import by_ids, get, respond
from waymark.operators.proximity import nearest, nearest_batch
from waymark.operators.search import best_of_each, keep_area, keep_country, matches, search_batch, search_ids, trees_of
from waymark.schema import RESPONSE_FIELDS

DEFAULT_COUNT, MOST, AREA_COUNT, DEFAULT_LANGUAGE = 10, 100, 10, "en"


class LocationNotFound(LookupError):
    def __init__(self) -> None:
        super().__init__("Location ID not found.")


def checked_count(count: int | None) -> int:
    count = DEFAULT_COUNT if count is None else count
    if not 1 <= count <= MOST:
        raise ValueError("Parameter count must be between 1 and 100.")
    return count


class Gazetteer:
    """tables: places, name_index and languages, as `load_or_create` returns them."""

    def __init__(self, tables: dict[str, DataFrame]):
        self.places, self.index = tables["places"], tables["name_index"]
        self.points = tables.get("points", self.places)
        self.languages = {r["lang"] for r in tables["languages"].select("lang").collect()}

    def language(self, asked: str | None) -> str:
        return asked if asked in self.languages else DEFAULT_LANGUAGE

    def _rows(self, hits: DataFrame) -> DataFrame:
        """Places of a request's hits, at most its count of rows: they are fetched, so their ids reach the scan."""
        got = hits.collect()
        local = self.places.sparkSession.createDataFrame(got, hits.schema)
        return by_ids(self.places, [r["id"] for r in got]).join(F.broadcast(local), "id")

    def search(self, name: str, language: str | None = None, country_code: str | None = None, count: int | None = None, filter_before_limit: bool = False) -> DataFrame:
        """Response rows with `rank`, best first.

        `name` may be "place, area".  Country and area filter the `count` best, so fewer rows may
        come back; filter_before_limit=True filters first.
        """
        language, count, asked, area = self.language(language), checked_count(count), name, ""
        if "," in name:
            parts = name.split(",")
            asked, area = parts[0].strip(), parts[1].strip()
        if len(name) < 2:
            rows = self._rows(matches(self.index, asked, []).limit(0))
        elif filter_before_limit:
            rows = self.places.join(best_of_each(matches(self.index, asked, trees_of(language))), "id")
        else:
            rows = self._rows(search_ids(self.index, asked, language, count))
        rows = keep_country(rows, country_code)
        if len(area) > 1:
            rows = keep_area(rows, self.areas(area, language))
        if filter_before_limit:
            rows = rows.orderBy(F.desc("priority"), "id").limit(count)
        answer = respond(rows, self.places, language, keep=("priority",), few=True)
        # An answer has at most 100 rows, but for shared ids, so one task ranks them; rows of one id stand in the order of their columns.
        order = Window.orderBy(F.desc("priority"), "id", *[c for c in RESPONSE_FIELDS if c != "id"])
        return answer.withColumn("rank", (F.row_number().over(order) - 1).cast("long")).orderBy("rank").drop("priority")

    def areas(self, area: str, language: str) -> DataFrame:
        """(area_id) of the ten best hits for an area's name that are areas at all."""
        best = search_ids(self.index, area, language, AREA_COUNT)
        return self._rows(best).where(is_area(F.col("feature_code"))).select(F.col("id").alias("area_id"))

    def get(self, id_: int, language: str | None = None) -> DataFrame:
        row = get(self.places, id_, self.language(language))
        if row.isEmpty():
            raise LocationNotFound
        return row

    def proximity(self, latitude: float, longitude: float, count: int | None = None, max_km: float = 100.0, country_code: str | None = None, language: str | None = None) -> DataFrame:
        rows = keep_country(self._rows(nearest(self.points, latitude, longitude, checked_count(count), max_km)), country_code)
        return respond(rows, self.places, self.language(language), keep=("distance",), few=True).orderBy("distance", F.desc("id"))

    def search_many(self, requests: DataFrame, count: int | None = None) -> DataFrame:
        return search_batch(self.index, requests, checked_count(count))

    def proximity_many(self, points: DataFrame, count: int | None = None, max_km: float = 100.0) -> DataFrame:
        return nearest_batch(self.points, points, checked_count(count), max_km)

    def answer(self, rows: DataFrame, format: str = "json") -> str | bytes:
        """A request's rows (at most its count) as one document."""
        began = time.time()
        if format == "json":
            got = [r["json"] for r in render.to_json(rows).collect()]
            body = f'"results":[{",".join(got)}],' if got else ""
            return "{" + body + f'"generationtime_ms":{(time.time() - began) * 1000:.6g}' + "}"
        if format == "protobuf":
            return render.encode_results([r.asDict() for r in rows.collect()], (time.time() - began) * 1000)
        raise ValueError("format must be json or protobuf")
