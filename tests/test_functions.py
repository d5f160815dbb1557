import math
import struct

import pytest
from pyspark.sql import functions as F

from waymark.functions import geo, numbers, ranking, text


def one(spark, expression, **columns):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in columns.items()]).select(expression.alias("x"))
    return row.first()["x"]


def test_fold_strips_marks_then_lowers(spark):
    said = "Rügen caractères spéciaux contrairement à la langue française"
    want = "rugen caracteres speciaux contrairement a la langue francaise"
    assert one(spark, text.fold(F.col("t")), t=said) == want == text.fold_literal(said)
    for s in ("étude", "ŁÓDŹ", "Ørsted", "Straße", "Ångström", "한국", "", "日本"):
        assert one(spark, text.fold(F.col("t")), t=s) == text.fold_literal(s)


@pytest.mark.parametrize("people, want", [(0, 0.0), (10, 0.038468935), (1000, 0.03920805), (10000, 0.046580374), (50000, 0.09806819), (100000, 0.22813433), (200000, 0.6859223), (500000, 0.9988663), (1000000, 1.0), (2000000, 1.0), (10000000, 1.0)])
def test_population_rank_is_exact_in_32_bits(spark, people, want):
    got = one(spark, ranking.population_rank(F.col("p").cast("bigint")), p=people)
    assert struct.pack("<f", got) == struct.pack("<f", want)


def test_bonuses(spark):
    for code, bonus in (("PPL", 0.1), ("PPLC", 0.3), ("PPLA4", 0.18), ("MT", 0.0)):
        got = one(spark, ranking.ranking(F.lit(0).cast("bigint"), F.col("c"), F.lit(True)), c=code)
        assert got == pytest.approx(bonus + 0.1, abs=1e-6)


@pytest.mark.parametrize("field, i32, u32, i16, signed", [("", 0, 0, 0, 0), ("12", 12, 12, 12, 12), ("-5", 5, 0, 5, -5), ("-9999", 9999, 0, 9999, -9999), ("x", 0, 0, 0, 0), ("4000000000", 0, 4000000000, 0, 0), ("-32768", 32768, 0, 0, -32768)])
def test_lenient_integers(spark, field, i32, u32, i16, signed):
    x = F.col("x")
    assert one(spark, numbers.to_int32(x), x=field) == i32
    assert one(spark, numbers.to_uint32(x), x=field) == u32
    assert one(spark, numbers.to_int16(x), x=field) == i16
    assert one(spark, numbers.to_int16(x, signed=True), x=field) == signed


def test_unreadable_floats_are_nan(spark):
    assert math.isnan(one(spark, numbers.to_float(F.col("x")), x="abc"))
    assert one(spark, numbers.to_float(F.col("x")), x="1.5") == 1.5


@pytest.mark.parametrize("asked, name, area", [("Berlin", "Berlin", ""), (" Berlin ", " Berlin ", ""), (" Berlin , Germany ", "Berlin", "Germany"), ("a,b,c", "a", "b"), (",x", "", "x")])
def test_name_and_area(spark, asked, name, area):
    a, b = text.name_and_area(F.col("t"))
    assert (one(spark, a, t=asked), one(spark, b, t=asked)) == (name, area)


def test_box():
    lat, lon = geo.box_half_widths(500, 0.0)
    assert lat == pytest.approx(lon, rel=1e-2) and math.isnan(geo.box_half_widths(500, 90.0)[1])
