"""Checks of inputs and results, each as rows (check, ok, found)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StringType

from hemicycle.functions import text
from hemicycle.functions.frames import attach
from hemicycle.operators import seats
from hemicycle.operators.candidates import overlay_votes
from hemicycle.session import cut_lineage

# fixed values: expected sizes of the national tables
N_COMMUNES, N_DISTRICTS, N_REGIONS = 346, 28, 16
FALSE_POSITIVE, FALSE_NEGATIVE = "elected (D'Hondt)", "elected (TRICEL)"


def _report(df: DataFrame, checks: dict[str, tuple[Column, Callable[[Column], Column]]]) -> DataFrame:
    """One aggregation; each check is (count found, whether that is fine)."""
    found = df.agg(*[n.cast("long").alias(f"n{i}") for i, (n, _) in enumerate(checks.values())])
    rows = F.array(*[
        F.struct(F.lit(name).alias("check"), ok(F.col(f"n{i}")).alias("ok"), F.col(f"n{i}").alias("found"))
        for i, (name, (_, ok)) in enumerate(checks.items())
    ])
    return found.select(F.inline(rows))


def _none(n: Column) -> Column:
    return n == 0


def _lacking(table: DataFrame, wanted: tuple[str, ...]) -> DataFrame | None:
    """A failed row for each missing column, or None if all are there."""
    missing = [(f"column {c}", False, 1) for c in wanted if c not in table.columns]
    return table.sparkSession.createDataFrame(missing, "check string, ok boolean, found long") if missing else None


def check_population_table(table: DataFrame, n_communes: int = N_COMMUNES) -> DataFrame:
    """``table`` is (CUT, personas) as text; if one is missing, that is all the report says."""
    lacking = _lacking(table, ("CUT", "personas"))
    if lacking is not None:
        return lacking
    number = F.col("CUT").try_cast("double").cast("long")
    code = F.lpad(number.cast("string"), 5, "0")
    region = F.substring(code, 1, 2).try_cast("int")
    odd = number.isNull() | (number > 99999) | (number < 0) | ~F.coalesce(region.between(1, N_REGIONS), F.lit(False))
    distinct = F.count_distinct("CUT")
    return _report(table, {
        "no nulls": (F.count_if(F.col("CUT").isNull()) + F.count_if(F.col("personas").isNull()), _none),
        "valid codes": (F.count_if(F.col("CUT").isNotNull() & odd), _none),
        "expected communes": (distinct, lambda n: n == n_communes),
        "no duplicates": (F.count("CUT") - distinct, _none),
        "positive population": (F.count_if(F.coalesce(F.col("personas").try_cast("double"), F.lit(0.0)) <= 0), _none),
    })


def check_votes_table(table: DataFrame) -> DataFrame:
    """``table`` is (CUT, party, votes) as text; if one is missing, that is all the report says."""
    lacking = _lacking(table, ("CUT", "party", "votes"))
    if lacking is not None:
        return lacking
    nulls = table.agg(sum((F.count_if(F.col(c).isNull()) for c in ("CUT", "party", "votes")), F.lit(0)).alias("_nulls"))
    votes = F.coalesce(F.col("votes").try_cast("double"), F.lit(0.0))
    by_cut = table.groupBy(F.col("CUT").try_cast("double").cast("long").alias("CUT")).agg(F.sum(votes).alias("v"))
    return _report(attach(by_cut, nulls), {
        "no nulls": (F.max("_nulls"), _none),
        "votes in every commune": (F.count_if(F.col("v") <= 0), _none),
        "positive total": (F.sum("v"), lambda n: n > 0),
    })


def check_assignment(table: DataFrame, n_communes: int = N_COMMUNES, n_districts: int = N_DISTRICTS) -> DataFrame:
    """``table`` is (key, district); keys have to be text and districts whole numbers.

    If a column is missing, that is all the report says.
    """
    lacking = _lacking(table, ("key", "district"))
    if lacking is not None:
        return lacking
    district = F.col("district").try_cast("double")
    inside = district.between(1, n_districts)
    present = F.count_distinct(F.when(inside, district))
    text_keys = F.lit(0) if table.schema["key"].dataType == StringType() else F.count("key")
    return _report(table, {
        "text keys": (text_keys, _none),
        "whole districts": (F.count_if(F.col("district").isNotNull() & ~F.coalesce(district == F.floor(district), F.lit(False))), _none),
        "expected keys": (F.count_distinct("key"), lambda n: n == n_communes),
        "districts in range": (F.count_if(~F.coalesce(inside, F.lit(False))), _none),
        "missing districts": (F.lit(n_districts) - present, _none),
    })


def check_pact_coverage(parties: DataFrame, pacts: DataFrame) -> DataFrame:
    """Parties without a pact by exact name, and after normalising."""
    named = parties.select("party").where("party IS NOT NULL").distinct()
    missing = named.join(pacts.select("party").distinct(), "party", "left_anti")
    key = lambda df: df.withColumn("_k", text.normalize_party_name(F.col("party")))
    still = key(missing).join(key(pacts).select("_k").distinct(), "_k", "left_anti").select("party", F.lit(True).alias("_still"))
    return missing.join(still, "party", "left").select("party", F.coalesce("_still", F.lit(False)).alias("missing_normalised"))


def check_units_edges(units: DataFrame, edges: DataFrame) -> DataFrame:
    """Null and repeated ids, loops, repeated edges and unknown ends."""
    ids = units.groupBy("unit_id").agg(F.count(F.lit(1)).alias("_n"))
    nodes = _report(ids, {
        "null ids": (F.coalesce(F.sum(F.when(F.col("unit_id").isNull(), F.col("_n"))), F.lit(0)), _none),
        "repeated ids": (F.coalesce(F.sum(F.when(F.col("unit_id").isNotNull(), F.col("_n") - 1)), F.lit(0)), _none),
    })
    pairs = edges.groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.count(F.lit(1)).alias("_n"))
    links = _report(pairs, {
        "self loops": (F.coalesce(F.sum(F.when(F.col("a") == F.col("b"), F.col("_n"))), F.lit(0)), _none),
        "repeated edges": (F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)), _none),
    })
    ends = edges.select(F.explode(F.array("src", "dst")).alias("unit_id")).distinct()
    unknown = ends.join(ids.where("unit_id IS NOT NULL"), "unit_id", "left_anti")
    return nodes.union(links).union(_report(unknown, {"unknown ends": (F.count(F.lit(1)), _none)}))


def validate_hierarchy(units: DataFrame, fine: str, coarse: str) -> DataFrame:
    """Fine units that lie in more than one coarse unit."""
    return units.groupBy(fine).agg(
        F.count_distinct(coarse).alias("n_coarse"), F.sort_array(F.collect_set(coarse)).alias("coarse")).where("n_coarse > 1")


def result_invariants(results: DataFrame, magnitudes: DataFrame, total: int = 155) -> DataFrame:
    """Violations: wrong district sum, wrong total, seats without votes."""
    by_district = magnitudes.select("district", F.col("magnitude").alias("expected")).join(
        results.groupBy("district").agg(F.sum("seats").alias("seats")), "district", "left"
    ).withColumn("found", F.coalesce("seats", F.lit(0)))
    head = lambda kind: F.lit(kind).alias("problem")
    wrong = by_district.where("found <> expected").select(
        head("district sum"), F.col("district").cast("string").alias("place"), F.col("expected").cast("long").alias("expected"), F.col("found").cast("long").alias("found"))
    overall = results.agg(F.sum("seats").alias("found")).where(F.col("found") != total).select(
        head("total"), F.lit("all").alias("place"), F.lit(total).cast("long").alias("expected"), F.col("found").cast("long"))
    empty = results.groupBy("district", "pact").agg(F.sum("votes").alias("v"), F.sum("seats").alias("s")).where("v <= 0 AND s > 0").select(
        head("seats without votes"), F.concat_ws("/", F.col("district").cast("string"), "pact").alias("place"), F.lit(0).cast("long").alias("expected"), F.col("s").cast("long").alias("found"))
    return wrong.union(overall).union(empty)


def validate_election(
    candidates: DataFrame, proclaimed: DataFrame, magnitudes: DataFrame, pacts: DataFrame,
    final_votes: DataFrame | None = None, roster: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Recomputed election against the proclaimed one: report, discrepancies.

    ``candidates`` is (district, party, list_id, candidate_id,
    candidate_name, votes), ``proclaimed`` the same without votes; ``roster``
    (district, party, n_candidates) turns on the caps.
    """
    key = ["district", "party"]
    person = candidates.groupBy("district", "candidate_id").agg(
        F.min("party").alias("party"), F.min("list_id").alias("list_id"), F.min("candidate_name").alias("candidate_name"), F.sum("votes").alias("votes"))
    person = person.join(magnitudes.select("district"), "district", "left_semi")
    fallback = F.lit(0)
    if final_votes is not None:
        person = overlay_votes(person, final_votes)
        fallback = F.col("from_first").cast("int")
    person = cut_lineage(person)
    votes = seats.attach_pact(seats.sum_votes(person), pacts)
    if roster is not None:
        votes = votes.join(roster.select(*key, F.col("n_candidates").cast("int").alias("cap")), key, "left")
    result = cut_lineage(seats.dhondt_two_level(votes, magnitudes).select(*key, "seats"))
    lists = person.groupBy(*key).agg(F.min("list_id").alias("list_id"))
    covered = person.select("district").distinct()
    proclaimed = cut_lineage(proclaimed)
    known = proclaimed.join(covered, "district", "left_semi")

    official = known.groupBy("district", "list_id").agg(F.count(F.lit(1)).alias("proclaimed_seats"))
    mine = result.join(lists, key).groupBy("district", "list_id").agg(F.sum("seats").alias("calculated_seats"))
    by_list = mine.join(official, ["district", "list_id"], "full").fillna(0, ["calculated_seats", "proclaimed_seats"])
    winners = seats.elect_candidates(person, result.where("seats > 0")).select("district", "candidate_id", "candidate_name", F.lit(True).alias("_c"))
    named = known.groupBy("district", "candidate_id").agg(F.min("candidate_name").alias("_name"), F.lit(True).alias("_p"))
    people = winners.join(named, ["district", "candidate_id"], "full")
    ties = seats.boundary_tie(person, result.where("seats > 0")).where("tie")
    per_party = known.groupBy(*key).agg(F.count(F.lit(1)).alias("_k"))

    wrong_list = by_list.where("calculated_seats <> proclaimed_seats").select(
        F.lit("list_allocation_mismatch").alias("type"), "district", "list_id", "calculated_seats", "proclaimed_seats",
        *[F.lit(None).cast(t).alias(c) for c, t in (("candidate_id", "long"), ("candidate_name", "string"), ("expected", "string"), ("calculated", "string"))])
    missed, extra = F.col("_c").isNull(), F.col("_p").isNull()
    wrong_person = people.where(missed | extra).select(
        F.lit("candidate_mismatch").alias("type"), "district", F.lit(None).cast("string").alias("list_id"),
        F.lit(None).cast("long").alias("calculated_seats"), F.lit(None).cast("long").alias("proclaimed_seats"),
        "candidate_id", F.coalesce("candidate_name", "_name").alias("candidate_name"),
        F.when(missed, FALSE_NEGATIVE).otherwise("not elected").alias("expected"),
        F.when(missed, "not elected").otherwise(FALSE_POSITIVE).alias("calculated"))
    discrepancies = wrong_list.unionByName(wrong_person)

    bad = discrepancies.select("district").union(ties.select("district")).distinct().withColumn("_bad", F.lit(True))
    n = F.count(F.lit(1))
    report = covered.join(bad, "district", "left").agg(F.count_if(F.col("_bad").isNull()).alias("districts_validated"))
    for part in (
        magnitudes.agg(n.alias("districts_total"), F.sum("magnitude").alias("seats_total")),
        result.join(per_party, key, "left").agg(F.sum(F.least("seats", F.coalesce("_k", F.lit(0)))).alias("seats_validated")),
        by_list.agg(F.count_if(F.col("calculated_seats") == F.col("proclaimed_seats")).alias("list_allocations_validated"), n.alias("list_allocations_total")),
        people.agg(F.count_if(F.col("_c") & F.col("_p")).alias("candidate_proclamations")),
        proclaimed.select("district", "candidate_id").distinct().agg(n.alias("candidate_proclamations_total")),
        ties.agg(n.alias("ties")), discrepancies.agg(n.alias("discrepancies")), person.agg(F.sum(fallback).alias("votes_fallback")),
    ):
        report = attach(report, part)
    nothing = (F.col("list_allocations_validated") == 0) & (F.col("candidate_proclamations") == 0) & (F.col("seats_validated") == 0)
    exact = (
        (F.col("districts_validated") == F.col("districts_total")) & (F.col("discrepancies") == 0)
        & (F.col("candidate_proclamations") == F.col("candidate_proclamations_total"))
    )
    something = (F.col("list_allocations_total") > 0) | (F.col("candidate_proclamations_total") > 0)
    status = F.when(nothing & something, "FAIL").when(exact, "EXACT_REPRODUCTION").otherwise("PARTIAL")
    return report.withColumn("status", status), discrepancies


def discrepancies_by_district(discrepancies: DataFrame) -> DataFrame:
    """Counts per district and the people on either side of the mismatch."""
    person = F.col("type") == "candidate_mismatch"
    side = lambda column, label: F.count_if(person & (F.col(column) == label))
    return discrepancies.groupBy("district").agg(
        F.count(F.lit(1)).alias("n"), F.array_join(F.sort_array(F.collect_set("type")), " + ").alias("types"),
        side("calculated", FALSE_POSITIVE).alias("false_positives"), side("expected", FALSE_NEGATIVE).alias("false_negatives"),
    )
