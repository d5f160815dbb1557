"""Responses as JSON, in DataFrame functions, and as protocol-buffer bytes.

Both formats leave out fields that have their default: 0, '' or an empty list.
"""

from __future__ import annotations

import struct
from itertools import groupby

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.schema import RESPONSE_FIELDS

_FLOATS = ("latitude", "longitude", "elevation")
_STRINGS = ("name", "feature_code", "country_code", "timezone", "country", "admin1", "admin2", "admin3", "admin4")


def _or_null(name: str) -> Column:
    c = F.col(name)
    if name == "postcodes":
        return F.when(F.size(c) > 0, c)
    if name in _FLOATS:
        # -0.0 has other bits than 0.0 and is written; as text the two differ.
        return F.when(c.cast("string") != "0.0", c)
    return F.nullif(c, F.lit("" if name in _STRINGS else 0))


def float_text(c: Column) -> Column:
    """A 32-bit float as proto3 JSON has it: shortest digits, plain from 1e-4 to 2^24, else with an exponent of two digits at least."""
    s = c.cast("string")
    sign, mantissa = F.when(s.startswith("-"), "-").otherwise(""), F.regexp_replace(F.regexp_extract(s, "^-?([0-9.]+)", 1), r"\.0$", "")
    digits, exponent = F.replace(mantissa, F.lit("."), F.lit("")), F.regexp_extract(s, "E(-?[0-9]+)$", 1).try_cast("int")
    # The JVM goes over to exponents below 1e-3 and from 1e7 on, so plain ones of these are -4 and 7.
    scientific = F.concat(sign, mantissa, F.lit("e"), F.when(exponent < 0, "-").otherwise("+"), F.lpad(F.abs(exponent).cast("string"), 2, "0"))
    plain = F.when(exponent == -4, F.concat(sign, F.lit("0.000"), digits)).when(F.abs(c) <= 1 << 24, F.concat(sign, F.rpad(digits, 8, "0"), F.lit(".0")))
    return F.when(s.rlike("[A-DF-Za-z]"), F.concat(F.lit('"'), s, F.lit('"'))).when(exponent.isNull(), s).when(exponent < -4, scientific).otherwise(F.coalesce(plain, scientific))


def to_json(rows: DataFrame, *keep: str) -> DataFrame:
    """(keep, json): one object a row, keys in the order of field numbers; nulls are left out."""
    members = []
    for floats, names in groupby(RESPONSE_FIELDS, lambda c: c in _FLOATS):
        if floats:
            members += [F.concat(F.lit(f'"{c}":'), float_text(_or_null(c))) for c in names]
        else:
            part = F.to_json(F.struct(*[_or_null(c).alias(c) for c in names]))
            members.append(F.nullif(part.substr(F.lit(2), F.length(part) - 2), F.lit("")))
    return rows.select(*keep, F.concat(F.lit("{"), F.concat_ws(",", *members), F.lit("}")).alias("json"))


def results_json(rows: DataFrame, rank: str = "rank") -> DataFrame:
    """One document for a whole answer: {"results": [...]}, in order of rank; at most a request's count of rows."""
    each = to_json(rows, rank)
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(rank, "json"))), lambda x: x["json"]), ",")
    return each.agg(F.when(F.count("*") > 0, F.concat(F.lit('{"results":['), body, F.lit("]}"))).otherwise("{}").alias("json"))


def _varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def encode_message(row: dict) -> bytes:
    """Wire format of one response row."""
    out = bytearray()
    for name, number in RESPONSE_FIELDS.items():
        v = row[name]
        if v is None:
            continue
        if name in _FLOATS:
            if raw := struct.pack("<f", v).strip(b"\0") and struct.pack("<f", v):
                out += _varint(number << 3 | 5) + raw
        elif name in _STRINGS or name == "postcodes":
            for s in [v] * bool(v) if name in _STRINGS else v:
                b = s.encode()
                out += _varint(number << 3 | 2) + _varint(len(b)) + b
        elif v:
            out += _varint(number << 3) + _varint(v)
    return bytes(out)


def encode_results(rows: list[dict], generationtime_ms: float) -> bytes:
    out = bytearray()
    for r in rows:
        b = encode_message(r)
        out += _varint(1 << 3 | 2) + _varint(len(b)) + b
    return bytes(out) + (_varint(2 << 3 | 5) + struct.pack("<f", generationtime_ms) if generationtime_ms else b"")


def to_protobuf(rows: DataFrame, *keep: str) -> DataFrame:
    """(keep, protobuf): no JVM function writes this format without a further package, so rows pass in Arrow batches."""
    import pyarrow as pa

    rows = rows.select(*keep, *[c for c in RESPONSE_FIELDS if c not in keep])

    def run(batches):
        for x in batches:
            yield pa.RecordBatch.from_arrays([*[x[c] for c in keep], pa.array([encode_message(r) for r in x.to_pylist()], pa.binary())], [*keep, "protobuf"])

    kinds = "".join(f"{c} {rows.schema[c].dataType.simpleString()}, " for c in keep)
    return rows.mapInArrow(run, f"{kinds}protobuf binary")
