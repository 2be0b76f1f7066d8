"""Legal constants as dimension tables, and threshold formulas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from hemicycle.functions.frames import rnd

# fixed values: seats of the chamber and bounds per district
TOTAL_SEATS, MIN_SEATS, MAX_SEATS = 155, 3, 8

# fixed values: seats of districts 1..28 by law and by the 2024 census revision
LAW_SEATS = [3, 3, 5, 5, 7, 8, 8, 8, 7, 8, 6, 7, 5, 6, 5, 4, 7, 4, 5, 8, 5, 4, 7, 5, 4, 5, 3, 3]
CENSUS_SEATS = [3, 3, 6, 3, 8, 8, 8, 8, 8, 8, 8, 8, 6, 8, 5, 3, 7, 3, 4, 8, 6, 3, 6, 3, 3, 5, 3, 3]

SMALL_FRAGMENT_SHARE = 0.10


def legal_magnitudes(spark: SparkSession, regime: str = "law") -> DataFrame:
    """(district, magnitude) of the 28 districts; regime is law or census."""
    seats = {"law": LAW_SEATS, "census": CENSUS_SEATS}[regime]
    return spark.createDataFrame(list(enumerate(seats, 1)), "district int, magnitude int")


def magnitude_array(regime: str = "law") -> Column:
    """Same as a literal array, for lookups that need no join."""
    seats = {"law": LAW_SEATS, "census": CENSUS_SEATS}[regime]
    return F.array(*[F.lit(s) for s in seats])


def threshold_columns(magnitude: Column) -> dict[str, Column]:
    """Upper, lower and effective threshold of a district, with a class."""
    upper = F.when(magnitude > 0, rnd(1 / (magnitude + 1), 4)).otherwise(F.lit(1.0))
    lower = F.when(magnitude > 0, 1 / (2 * magnitude)).otherwise(F.lit(1.0))
    effective = rnd(F.sqrt(lower * upper), 4)
    return {
        "t_upper": upper,
        "t_lower": rnd(lower, 4),
        "t_effective": effective,
        "category": F.when(upper <= 0.125, "Bajo").when(upper <= 0.167, "Medio").otherwise("Alto"),
    }


def is_split(fragments: Column) -> Column:
    return fragments > 1


def representation_flags(weight: Column) -> dict[str, Column]:
    return {"over_represented": weight < 1, "under_represented": weight > 1}
