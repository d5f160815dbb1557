"""A place's ranking: logistic in its population, with a bonus for kind and postcodes, in 32-bit floats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bonus by feature code; of any postcode.
BONUS = {"PPL": 0.1, "PPLA": 0.3, "PPLC": 0.3, "PPLA2": 0.23, "PPLA3": 0.2, "PPLA4": 0.18, "PPLA5": 0.15}
POSTCODE_BONUS = 0.1


def population_rank(population: Column) -> Column:
    """1 / (1 + 25 e^(-p / 50000)), 0 without population.  Spark divides floats as doubles, hence the casts."""
    one = lambda x: F.lit(x).cast("float")
    e = F.pow(one(2.718281828459045).cast("double"), (one(-2.0e-5) * population.cast("float")).cast("double")).cast("float")
    return F.when(population <= 0, one(0.0)).otherwise((one(1.0) / (one(1.0) + one(25.0) * e)).cast("float"))


def ranking(population: Column, feature_code: Column, has_postcode: Column) -> Column:
    bonus = F.lit(0.0).cast("float")
    for code, x in BONUS.items():
        bonus = F.when(feature_code == code, F.lit(x).cast("float")).otherwise(bonus)
    return population_rank(population) + F.when(has_postcode, F.lit(POSTCODE_BONUS).cast("float")).otherwise(F.lit(0.0).cast("float")) + bonus
