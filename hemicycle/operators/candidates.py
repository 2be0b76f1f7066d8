"""Candidate, scrutiny and proclamation tables from raw result rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from hemicycle.functions import text

# fixed values: names of pseudo candidates and of the district's valid total
BLANK, NULL = "VOTOS EN BLANCO", "VOTOS NULOS"
VALID_TOTAL = "Total Sufragios Validamente Emitidos"
PACT_ALIASES = {"candidatura independiente": "independientes fuera de pacto"}

CANDIDATE = "cod_candidato"


def real_candidates(raw: DataFrame) -> DataFrame:
    """Rows of candidates; administrative rows have no candidate code."""
    return raw.where(F.col(CANDIDATE).isNotNull())


def administrative_count(raw: DataFrame) -> DataFrame:
    return raw.agg(F.count_if(F.col(CANDIDATE).isNull()).alias("removed"), F.count(CANDIDATE).alias("kept"))


def is_pseudo(name: Column) -> Column:
    return F.upper(F.trim(name)).isin(BLANK, NULL)


def commune_codes(raw: DataFrame, communes: DataFrame, aliases: bool = True) -> DataFrame:
    """Add the code of the commune by its name; null where unknown.

    ``communes`` is (name, CUT).
    """
    spell = text.resolve_commune_alias if aliases else text.normalize_commune_name
    table = communes.groupBy(text.normalize_commune_name(F.col("name")).alias("_name")).agg(F.min("CUT").alias("CUT"))
    return raw.withColumn("_name", spell(F.col("comuna"))).join(table, "_name", "left").drop("_name")


def unresolved_communes(coded: DataFrame) -> DataFrame:
    return coded.where("CUT IS NULL AND comuna IS NOT NULL").select("comuna").distinct()


def _votes() -> Column:
    return F.coalesce(F.col("votos_preliminares").try_cast("double"), F.lit(0.0))


def import_candidates(raw: DataFrame, communes: DataFrame, election: str = "CL-2025-DIP", office: str = "diputado") -> DataFrame:
    """Canonical candidate rows by commune; null groups are kept."""
    known = commune_codes(real_candidates(raw), communes).where("CUT IS NOT NULL")
    party = F.col("partido")
    named = known.select(
        "CUT", F.col(CANDIDATE).alias("candidate_id"), F.trim("nombre_candidato").alias("candidate_name"),
        F.trim("pacto").alias("list_id"), F.coalesce(text.normalize_party_name(party), F.lit("")).alias("party_id"),
        text.parse_district_id(F.col("distrito")).alias("district"),
        F.coalesce(F.contains(F.upper(party), F.lit("IND")), F.lit(False)).alias("independent"),
        _votes().alias("v"), F.coalesce(F.col("electo_nominado").try_cast("int"), F.lit(0)).alias("e"),
    )
    keys = ["CUT", "candidate_id", "candidate_name", "list_id", "party_id", "district", "independent"]
    return named.groupBy(*keys).agg(
        F.sum("v").cast("long").alias("votes"), (F.max("e") == 1).alias("officially_elected")
    ).withColumn("election_id", F.lit(election)).withColumn("office", F.lit(office))


def import_audit(raw: DataFrame, communes: DataFrame) -> DataFrame:
    """What the import removed, renamed or could not place."""
    coded = commune_codes(raw, communes)
    real, resolved = F.col(CANDIDATE).isNotNull(), F.col("CUT").isNotNull()
    name = text.normalize_commune_name(F.col("comuna"))
    return coded.agg(
        F.count_if(~real).alias("administrative_rows_removed"),
        F.count_if(real & resolved).alias("cut_normalizations"),
        F.count_if(real & resolved & F.col("partido").isNull()).alias("rows_without_party"),
        F.count_distinct(F.when(real & name.isin(list(text.COMMUNE_ALIASES)), name)).alias("commune_aliases_applied"),
        F.count_distinct(F.when(real & ~resolved, F.col("comuna"))).alias("unresolved_communes"),
    )


def import_final_scrutiny(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Votes by (district, full name), and blank and null votes by district.

    ``raw`` is (district, names, first_surname, second_surname, votes).
    """
    votes = F.coalesce(F.col("votes").try_cast("double").cast("long"), F.lit(0))
    rows = raw.withColumn("_v", votes)
    name = text.candidate_full_name(F.col("names"), F.col("first_surname"), F.col("second_surname"))
    real = rows.where(~F.coalesce(is_pseudo(F.col("names")), F.lit(False))).groupBy("district", name.alias("candidate_name")).agg(F.sum("_v").alias("votes_final"))
    label = F.upper(F.trim("names"))
    other = rows.groupBy("district").agg(
        F.coalesce(F.sum(F.when(label == BLANK, F.col("_v"))), F.lit(0)).alias("votes_blank"),
        F.coalesce(F.sum(F.when(label == NULL, F.col("_v"))), F.lit(0)).alias("votes_null"),
    )
    return real, other


def import_results(raw: DataFrame) -> DataFrame:
    """Seats won by (district, list) from the elected flags."""
    elected = raw.where(F.coalesce(F.col("electo_nominado").try_cast("int"), F.lit(0)) == 1)
    one = elected.groupBy(text.parse_district_id(F.col("distrito")).alias("district"), CANDIDATE).agg(F.min(F.trim("pacto")).alias("list_id"))
    return one.groupBy("district", "list_id").agg(F.count(F.lit(1)).alias("seats_won"))


def candidate_counts(roster: DataFrame) -> DataFrame:
    """Registered candidates by (district, party); the cap of a list."""
    party = text.independent_to_party(F.col("party_raw"))
    return roster.groupBy("district", party.alias("party")).agg(F.count_distinct("roster_number").alias("n_candidates"))


def table_totals(rows: DataFrame, geography: Sequence[str], candidates: Sequence[str]) -> DataFrame:
    """Totals row of each district (last one without geography), unpivoted.

    ``rows`` has district, row_number, the geography columns, Nulos, Blancos,
    Total votos and one column per candidate.
    """
    blank = F.lit(True)
    for g in geography:
        blank = blank & F.col(g).isNull()
    kept = ["Nulos", "Blancos", "`Total votos`", *[f"`{c}`" for c in candidates]]
    last = rows.where(blank).groupBy("district").agg(F.max_by(F.struct(*kept), "row_number").alias("t")).select("district", "t.*")
    number = lambda c: F.coalesce(F.col(f"`{c}`").try_cast("double").cast("long"), F.lit(0))
    typed = last.select(
        "district", number("Nulos").alias("votes_null"), number("Blancos").alias("votes_blank"),
        number("Total votos").alias("total_votes"), *[number(c).alias(c) for c in candidates])
    return typed.unpivot(["district", "votes_null", "votes_blank", "total_votes"], [f"`{c}`" for c in candidates], "candidate_name", "votes_final")


def candidates_by_unit(raw: DataFrame, communes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Votes by (commune, candidate), and a reconciliation row per district."""
    coded = commune_codes(raw, communes).withColumn("_v", _votes())
    keys = ["CUT", CANDIDATE, "nombre_candidato", "pacto", "partido"]
    votes = coded.where(F.col(CANDIDATE).isNotNull() & F.col("CUT").isNotNull()).groupBy(*keys).agg(F.sum("_v").cast("long").alias("votos"))
    real = F.col(CANDIDATE).isNotNull()
    total = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("_v"))), F.lit(0.0)).cast("long")
    check = coded.groupBy("distrito").agg(
        total(real).alias("candidate_votes"), total(F.col("nombre_candidato") == VALID_TOTAL).alias("valid_votes"),
        total(real & F.col("CUT").isNull()).alias("votes_without_cut"),
    ).withColumn("difference", F.col("candidate_votes") - F.col("valid_votes"))
    return votes, check


def party_votes_by_unit(raw: DataFrame, communes: DataFrame) -> DataFrame:
    """Votes by (commune, party) of all rows; no party counts as IND."""
    party = text.normalize_commune_name(F.coalesce(F.col("partido"), F.lit("IND")))
    coded = commune_codes(raw, communes, aliases=False).where("CUT IS NOT NULL")
    return coded.groupBy("CUT", party.alias("party")).agg(F.sum(_votes()).cast("long").alias("votes")).where("votes > 0")


def overlay_votes(candidates: DataFrame, final: DataFrame) -> DataFrame:
    """Votes of the second source where it knows the (district, name).

    ``from_first`` marks rows that kept their own votes.
    """
    table = final.groupBy("district", text.normalize_commune_name(F.col("candidate_name")).alias("_name")).agg(F.max("votes_final").alias("_final"))
    out = candidates.withColumn("_name", text.normalize_commune_name(F.col("candidate_name"))).join(table, ["district", "_name"], "left")
    return out.withColumn("from_first", F.col("_final").isNull()).withColumn("votes", F.coalesce("_final", "votes")).drop("_name", "_final")


def match_proclaimed(elected: DataFrame, roster: DataFrame, candidates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Elected names matched to candidates, and the names left over.

    The roster gives each name its number; the candidate of the district
    whose id ends in that number (three digits) is the match, the first by id.
    """
    name = text.normalize_commune_name(F.col("candidate_name")).alias("_name")
    numbers = roster.select("district", name, "roster_number").groupBy("district", "_name").agg(F.max("roster_number").alias("_number"))
    suffix = candidates.groupBy("district", F.pmod("candidate_id", F.lit(1000)).alias("_number")).agg(
        F.min(F.struct("candidate_id", "party_id", "list_id")).alias("_c"))
    named = elected.withColumn("_name", text.normalize_commune_name(F.col("candidate_name")))
    found = named.join(numbers, ["district", "_name"], "left").join(suffix, ["district", "_number"], "left")
    matched = found.where("_c IS NOT NULL").select("district", "_c.candidate_id", "candidate_name", "_c.party_id", "_c.list_id", "votes_final", F.lit(True).alias("officially_elected"))
    return matched, found.where("_c IS NULL").select("district", "candidate_name")


def official_compare(calculated: DataFrame, official: DataFrame) -> DataFrame:
    """Calculated against official seats by (district, pact)."""
    def key(c):
        plain = text.normalize_party_name(c)
        table = F.create_map(*[F.lit(x) for p in PACT_ALIASES.items() for x in p])
        return F.coalesce(F.element_at(table, plain), plain)

    one = calculated.groupBy("district", key(F.col("pact")).alias("pact")).agg(F.sum("seats").alias("calculated")).where("calculated > 0")
    two = official.groupBy("district", key(F.col("pact")).alias("pact")).agg(F.sum("seats").alias("official"))
    both = one.join(two, ["district", "pact"], "full").fillna(0, ["calculated", "official"])
    return both.withColumn("difference", F.col("calculated") - F.col("official"))


