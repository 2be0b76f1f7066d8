"""Population by unit and level: sums, proportional shares and fallbacks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from hemicycle.functions.frames import attach, ratio, rnd
from hemicycle.functions.text import normalize_cut

# fixed values: rural building uses that count as dwellings
DWELLING_USES = ["VIVIENDA", "VIVIENDA COLECTIVA"]


def sum_levels(blocks: DataFrame, levels: Sequence[Sequence[str]], counts: Sequence[str]) -> DataFrame:
    """Sums at several levels in one job; ``level`` counts the level columns.

    ``levels`` are nested column lists, e.g. region; region, commune.
    """
    columns = list(dict.fromkeys(c for level in levels for c in level))
    sets = [[F.col(c) for c in level] for level in levels]
    sums = blocks.groupingSets(sets, *columns).agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in counts], F.grouping_id(*columns).cast("int").alias("_g"))
    depth = len(columns) - F.bit_count("_g")
    return sums.withColumn("level", depth).withColumn("total", sum((F.col(c) for c in counts[1:]), F.col(counts[0]))).drop("_g")


def contract_units(units: DataFrame, level: str, spec: dict[str, str], keep: Sequence[str] = ()) -> DataFrame:
    """Units merged to a coarser level; ``spec`` maps column to aggregate,
    ``keep`` columns take the value of the first unit."""
    aggregates = [getattr(F, fn)(c).alias(c) for c, fn in spec.items()]
    first = [F.min_by(c, "unit_id").alias(c) for c in keep]
    return units.groupBy(level).agg(*aggregates, *first)


def population_summary(units: DataFrame, by: str, value: str) -> DataFrame:
    return units.groupBy(by).agg(
        F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"), rnd(F.avg(value), 1).alias("mean"))


def regional_roll(roll: DataFrame) -> DataFrame:
    """Communes and registered voters per region (code // 1000)."""
    return roll.groupBy(F.floor(F.col("CUT") / 1000).cast("int").alias("region")).agg(
        F.count(F.lit(1)).alias("n_communes"), F.sum("inscritos").alias("registered"))


def proportional_join(units: DataFrame, totals: DataFrame, proxy: str, value: str, strict: bool = False) -> DataFrame:
    """Commune totals spread over units by their share of ``proxy``.

    Rounding is per unit, so the sum may drift; a commune with no proxy gives
    0, a missing total gives 0 or fails when ``strict``.
    """
    sums = units.groupBy("commune").agg(F.sum(proxy).alias("_proxy"))
    base = attach(units, sums, ["commune"]).join(totals.select("commune", F.col(value).alias("_total")), "commune", "left")
    total = F.coalesce("_total", F.raise_error(F.lit("commune without a total")).cast("long") if strict else F.lit(0))
    share = ratio(F.col(proxy), F.col("_proxy"), 0.0) * total
    return base.withColumn(value, rnd(share, 0).cast("long")).drop("_proxy", "_total")


def block_join(units: DataFrame, blocks: DataFrame, strict: bool = False) -> DataFrame:
    """Persons and households of census blocks summed to their units."""
    key = F.concat_ws("_", normalize_cut(F.col("CUT")), F.lpad(F.col("COD_DISTRITO").cast("string"), 3, "0"))
    sums = blocks.groupBy(key.alias("unit_id")).agg(F.sum("n_per").alias("personas"), F.sum("n_hog").alias("hogares"))
    out = units.drop("personas", "hogares").join(sums, "unit_id", "left")
    fill = F.raise_error(F.lit("unit without blocks")).cast("long") if strict else F.lit(0)
    return out.withColumns({c: F.coalesce(c, fill) for c in ("personas", "hogares")})


def combine_urban_rural(units: DataFrame, urban: DataFrame, rural: DataFrame, value: str = "viviendas") -> DataFrame:
    """Sum of two partial tables on (commune, district), joined on the units."""
    keys = ["commune", "district"]
    part = lambda df, name: df.groupBy(*keys).agg(F.sum(value).alias(name))
    both = part(urban, "_u").join(part(rural, "_r"), keys, "full")
    zero = F.lit(0)
    both = both.select(*keys, (F.coalesce("_u", zero) + F.coalesce("_r", zero)).alias(value))
    return units.drop(value).join(both, keys, "left").fillna(0, [value])


def rural_fallback(units: DataFrame, points: DataFrame, value: str = "viviendas") -> DataFrame:
    """Communes without dwellings take rural buildings, spread evenly."""
    sums = units.groupBy("commune").agg(F.sum(value).alias("_sum"), F.count(F.lit(1)).alias("_rows"))
    homes = points.where(F.col("use").isin(DWELLING_USES)).groupBy("commune").agg(F.count(F.lit(1)).alias("_homes"))
    base = attach(attach(units, sums, ["commune"]), homes, ["commune"])
    spread = rnd(F.col("_homes") / F.col("_rows"), 0).cast("long")
    fixed = F.when((F.col("_sum") == 0) & F.col("_homes").isNotNull(), spread).otherwise(F.col(value))
    return base.withColumn(value, fixed).drop("_sum", "_rows", "_homes")


def magnitude_weighted_population(units: DataFrame, legal: DataFrame, magnitudes: DataFrame) -> DataFrame:
    """Population divided by the seat share of each unit's legal district.

    ``legal`` is (commune, district). Units without one take the mean seats.
    """
    placed = units.join(legal.select("commune", F.col("district").alias("legal_district")), "commune", "left")
    named = magnitudes.select(F.col("district").alias("legal_district"), "magnitude")
    present = placed.select("legal_district").distinct().join(named, "legal_district")
    totals = present.agg(F.sum("magnitude").alias("_sum"), F.avg("magnitude").alias("_mean"))
    base = attach(placed.join(named, "legal_district", "left"), totals)
    weight = F.coalesce("magnitude", "_mean") / F.col("_sum")
    return base.withColumn("weighted_population", F.col("population") / weight).drop("_sum", "_mean")


def enrich_population(
    units: DataFrame, source: str, blocks: DataFrame | None = None, census: DataFrame | None = None, roll: DataFrame | None = None
) -> tuple[DataFrame, str]:
    """Population column by source; missing input falls back to dwellings.

    Returns the units and the name of the column to use. ``units`` has
    unit_id, commune and viviendas.
    """
    if source == "blocks" and blocks is not None:
        return block_join(units, blocks), "personas"
    if source == "census" and census is not None:
        persons = proportional_join(units, census, "viviendas", "personas")
        return proportional_join(persons, census, "viviendas", "hogares"), "personas"
    if source == "roll" and roll is not None:
        return proportional_join(units, roll, "viviendas", "inscritos"), "inscritos"
    return units, "viviendas"


def assignment_population(plan: DataFrame, population: DataFrame) -> DataFrame:
    """Persons by district; unit codes are normalised on both sides and
    unknown units count 0. Both have a ``CUT`` column."""
    left = plan.select(normalize_cut(F.col("CUT")).alias("_code"), "district")
    right = population.groupBy(normalize_cut(F.col("CUT")).alias("_code")).agg(F.sum("personas").alias("personas"))
    return left.join(right, "_code", "left").groupBy("district").agg(F.sum(F.coalesce("personas", F.lit(0))).alias("population"))
