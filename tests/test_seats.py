"""Allocation windows against hand cases and the rules that a result must keep."""

import random

import pytest
from pyspark.sql import functions as F

from hemicycle.functions.rules import CENSUS_SEATS, LAW_SEATS, TOTAL_SEATS
from hemicycle.operators import seats


def broken_rules(won, votes, n, threshold=0.0, caps=None):
    """What a result of a divisor method violates: totals, thresholds, caps, or the order of quotients."""
    clean, caps = {p: max(0, v) for p, v in votes.items()}, caps or {}
    total = sum(clean.values())
    room = {p: min(n, caps.get(p, n)) if total and clean[p] / total >= threshold else 0 for p in clean}
    found = [] if set(won) == set(votes) else ["parties"]
    found += ["total"] if sum(won.values()) != min(n, sum(room.values())) else []
    found += [f"room of {p}" for p in won if not 0 <= won[p] <= room[p]]
    lasts = [(clean[p] / won[p], clean[p], p) for p in won if won[p]]
    nexts = [(clean[p] / (won[p] + 1), clean[p], p) for p in won if won[p] < room[p]]
    found += ["order"] if lasts and nexts and min(lasts) < max(nexts) and min(lasts)[2] != max(nexts)[2] else []
    return found


def result(df, keys=("party",)):
    return {tuple(r[k] for k in keys) if len(keys) > 1 else r[keys[0]]: r.seats for r in df.collect()}


def votes_of(spark, votes):
    return spark.createDataFrame([(1, p, v) for p, v in votes.items()], "district int, party string, votes long")


def test_hand_cases(spark):
    assert result(seats.dhondt(votes_of(spark, {"A": 100, "B": 80, "C": 30}), 3)) == {"A": 2, "B": 1, "C": 0}
    capped = votes_of(spark, {"A": 100, "B": 20, "C": 15}).withColumn("cap", F.when(F.col("party") == "A", 1))
    assert result(seats.dhondt(capped, 3)) == {"A": 1, "B": 1, "C": 1}
    assert result(seats.dhondt(votes_of(spark, {"A": 0, "B": 0}), 3)) == {"A": 0, "B": 0}
    assert result(seats.dhondt(votes_of(spark, {"A": 5, "B": 5}), 0)) == {"A": 0, "B": 0}


def test_two_level_hand_case(spark):
    votes = votes_of(spark, {"PS": 30000, "PPD": 20000, "RN": 40000, "UDI": 25000})
    pacts = spark.createDataFrame([("ps", "L"), ("ppd", "L"), ("RN", "R"), ("Udi", "R")], "party string, pact string")
    out = seats.dhondt_two_level(seats.attach_pact(votes, pacts), 3)
    assert result(out) == {"PS": 1, "PPD": 0, "RN": 1, "UDI": 1}


def test_two_level_caps(spark):
    names = {"Liberal": 60, "PPD": 50, "Radical": 40, "PC": 30, "FA": 20, "DC": 10}
    votes = votes_of(spark, names).withColumn("pact", F.lit("X")).withColumn("cap", F.lit(1))
    won = result(seats.dhondt_two_level(votes, 3))
    assert won == {"Liberal": 1, "PPD": 1, "Radical": 1, "PC": 0, "FA": 0, "DC": 0}


@pytest.mark.parametrize("threshold", [0.0, 0.1, 0.3])
def test_random_against_definition(spark, threshold):
    draw = random.Random(11)
    rows, cases = [], {}
    for d in range(250):
        n = draw.randint(0, 9)
        votes = {f"p{i}": draw.choice([0, -3, 7, 7, 14, 21, draw.randint(0, 60)]) for i in range(draw.randint(1, 7))}
        caps = {p: draw.randint(0, 4) for p in votes if draw.random() < 0.4}
        rows += [(d, p, v, n, caps.get(p)) for p, v in votes.items()]
        cases[d] = (votes, n, threshold, caps)
    df = spark.createDataFrame(rows, "district int, party string, votes long, magnitude int, cap int")
    won = seats.dhondt(df, F.col("magnitude"), threshold=threshold)
    got = {d: {} for d in cases}
    for (d, party), s in result(won, ("district", "party")).items():
        got[d][party] = s
    assert {d: rules for d in cases if (rules := broken_rules(got[d], *cases[d]))} == {}
    assert broken_rules({"a": 2, "b": 1}, {"a": 9, "b": 8}, 3) == [] and broken_rules({"a": 3, "b": 0}, {"a": 9, "b": 8}, 3) == ["order"]


def test_magnitudes_against_definition(spark):
    draw = random.Random(5)
    rows, expected = [], {}
    for plan in range(60):
        n, low, high = draw.randint(1, 9), 2, 6
        pop = [draw.choice([0, 10, 10, 500, draw.randint(0, 900)]) for _ in range(n)]
        won = [low] * n
        for _ in range(30 - n * low):
            free = [i for i in range(n) if won[i] < high]
            if not free:
                break
            won[max(free, key=lambda i: (pop[i] / (won[i] + 1), -i))] += 1
        rows += [(plan, i, p) for i, p in enumerate(pop)]
        expected |= {(plan, i): s for i, s in enumerate(won)}
    df = spark.createDataFrame(rows, "plan_id int, district int, population long")
    out = seats.magnitudes_dhondt(df, ("plan_id",), 30, 2, 6).collect()
    assert {(r.plan_id, r.district): r.magnitude for r in out} == expected


def test_magnitudes_need_enough_seats(spark):
    df = spark.createDataFrame([(1, 5), (2, 5)], "district int, population long")
    with pytest.raises(Exception, match="minimum"):
        seats.magnitudes_dhondt(df, (), 5, 3, 8).collect()


def test_hamilton(spark):
    df = spark.createDataFrame([(1, 900), (2, 100)], "district int, population long")
    out = {r.district: r.magnitude for r in seats.magnitudes_hamilton(df, (), 10, 1, 9).collect()}
    assert out == {1: 8, 2: 2}
    zero = df.withColumn("population", F.lit(0).cast("long"))
    assert {r.magnitude for r in seats.magnitudes_hamilton(zero, (), 10, 1, 9).collect()} == {1}


def test_margin_without_rival(spark):
    row = seats.last_seat_margin(votes_of(spark, {"A": 10}), 2).first()
    assert (row.last_winner, row.first_loser, row.winner_quotient, row.margin) == ("A", None, 5.0, None)


def test_boundary_tie_and_top_k(spark):
    people = spark.createDataFrame(
        [(1, "A", 1, 9), (1, "A", 2, 5), (1, "A", 3, 5), (1, "B", 4, 2)], "district int, party string, candidate_id long, votes long")
    got = spark.createDataFrame([(1, "A", 2), (1, "B", 1)], "district int, party string, seats int")
    assert {r.candidate_id for r in seats.elect_candidates(people, got).collect()} == {1, 2, 4}
    assert {r.party: r.tie for r in seats.boundary_tie(people, got).collect()} == {"A": True, "B": False}


def test_legal_tables():
    assert len(LAW_SEATS) == len(CENSUS_SEATS) == 28
    assert sum(LAW_SEATS) == sum(CENSUS_SEATS) == TOTAL_SEATS
