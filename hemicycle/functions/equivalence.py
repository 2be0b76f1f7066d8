"""Census units of two countries side by side, level by level."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

# fixed values: level, unit names, code fields and typical sizes
UNITS = [
    (1, "State", "Región", "STATEFP", "COD_REGION", "500k–40M hab", "100k–8M hab"),
    (2, "County", "Provincia", "COUNTYFP", "COD_PROVINCIA", "10k–10M hab", "20k–2M hab"),
    (3, "Municipality / Place", "Comuna", "PLACEFP", "CUT", "1k–8M hab", "1k–500k hab"),
    (4, "Census Tract", "Distrito APC", "TRACTCE", "ID_DIST", "1.2k–8k hab", "200–5k viviendas"),
    (5, "Block Group", "Zona Censal", "BLKGRPCE", "COD_ZONA", "600–3k hab", "50–500 viviendas"),
    (6, "Census Block", "Manzana", "BLOCKCE20", "MANZENT", "0–600 hab", "0–200 viviendas"),
]
STYLES = {
    "full": ["level", "usa_unit", "chl_unit", "usa_code", "chl_code", "usa_size", "chl_size"],
    "compact": ["level", "usa_unit", "chl_unit", "usa_size", "chl_size"],
    "redist": ["level", "usa_unit", "chl_unit", "chl_code"],
}


def unit_equivalence(spark: SparkSession, style: str = "full") -> DataFrame:
    table = spark.createDataFrame(
        UNITS, "level int, usa_unit string, chl_unit string, usa_code string, chl_code string, usa_size string, chl_size string")
    return table.select(*STYLES[style])


def analog(rows: DataFrame, country: str = "country", level: str = "level") -> DataFrame:
    """Add the unit of each row's (country, level) and the other country's."""
    table = unit_equivalence(rows.sparkSession).select(F.col("level").alias(level), "usa_unit", "chl_unit")
    usa = F.upper(country) == "USA"
    return rows.join(table, level, "left").withColumns({
        "unit": F.when(usa, F.col("usa_unit")).otherwise(F.col("chl_unit")),
        "analog_unit": F.when(usa, F.col("chl_unit")).otherwise(F.col("usa_unit")),
    }).drop("usa_unit", "chl_unit")
