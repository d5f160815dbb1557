"""Feature-code filters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Feature codes that are loaded.
LOADED = """
ADM1 ADM2 ADM3 ADM4 ADM5 PCLI PCLD PCLIX PCLS PCLF PCL PPL PPLL PPLC PPLA PPLA2 PPLA3 PPLA4 PPLX PPLS PPLCH PPLG
AMUS AIRP MT MTS PK PKS PAN PANS PASS VALL VALX VALG VALS FLLS DAM PRK GLCR CONT UPLD ISL ISLET ISLF ISLM ISLS ISLT CAPE AIRF AIRB AIRH
""".split()
#: Those that no search finds by name, and those that an area in a request may be.
NOT_INDEXED = "PCL ADM1 ADM2 ADM3 ADM4 ADM5 LTER PRSH TERR ZN ZNB".split()
AREAS = "ADM1 ADM2 ADM3 ADM4 PCLI".split()


def is_loaded(code: Column) -> Column:
    return code.isin(LOADED)


def is_indexed(code: Column) -> Column:
    return ~code.isin(NOT_INDEXED)


def is_area(code: Column) -> Column:
    return code.isin(AREAS)


def loaded(places):
    return places.where(is_loaded(F.col("feature_code")))
