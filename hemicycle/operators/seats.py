"""Seat allocation as ranking windows.

A divisor method that hands out seats one by one gives the same result as
taking the top quotients of the list ``votes / 1, votes / 2, ...``, so each
allocation is one shuffle on the group, whatever the number of plans.
Groups hold one row per party (callers sum votes first).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from hemicycle.functions.frames import attach, ensure, group_window, ratio, rnd
from hemicycle.functions.rules import MAX_SEATS, MIN_SEATS, TOTAL_SEATS
from hemicycle.functions.text import normalize_party_name


def sum_votes(votes: DataFrame, keys: Sequence[str] = ("district",), extra: Sequence[str] = ()) -> DataFrame:
    """Votes by (keys, party); rows without a party are left out."""
    return (
        votes.where(F.col("party").isNotNull())
        .groupBy(*keys, "party", *extra)
        .agg(F.sum("votes").alias("votes"))
    )


def with_magnitude(votes: DataFrame, magnitudes: DataFrame | int | Column, keys: Sequence[str]) -> DataFrame:
    """Add the seats of each row's district; a missing district has none."""
    if isinstance(magnitudes, int):
        return votes.withColumn("magnitude", F.lit(magnitudes))
    if isinstance(magnitudes, Column):
        return votes.withColumn("magnitude", magnitudes)
    on = [k for k in keys if k in magnitudes.columns]
    joined = votes.join(magnitudes.select(*on, "magnitude"), on, "left")
    return joined.withColumn("magnitude", F.coalesce("magnitude", F.lit(0)))


def _ranked_quotients(votes: DataFrame, keys: Sequence[str], threshold: float, spare: int = 0) -> DataFrame:
    """Votes with one row per quotient that can matter, ranked per group.

    Expects ``magnitude`` and optionally ``cap``. A party outside the top
    ``magnitude`` parties cannot win, so it keeps a single dead row.
    """
    w = group_window(keys)
    v = F.greatest(F.col("votes"), F.lit(0))
    cap = F.coalesce(F.col("cap"), F.col("magnitude")) if "cap" in votes.columns else F.col("magnitude")
    total = F.sum("_v").over(w)
    base = votes.withColumn("_v", v).withColumn("_total", total)
    alive = (
        (F.col("magnitude") > 0) & (F.col("_total") > 0) & (cap > 0)
        & (F.col("_v") / F.col("_total") >= threshold)
    )
    best_first = [F.col("_v").desc(), F.col("party").desc()]
    base = base.withColumn("_alive", F.coalesce(alive, F.lit(False))).withColumn(
        "_place", F.row_number().over(w.orderBy(F.col("_alive").desc(), *best_first))
    )
    depth = F.when(
        F.col("_alive"),
        F.when(F.col("_place") <= F.col("magnitude"), F.least(cap, F.col("magnitude")) + spare).otherwise(1),
    ).otherwise(1)
    rows = base.select("*", F.explode(F.sequence(F.lit(1), depth.cast("int"))).alias("_k"))
    quotient = F.col("_v") / F.col("_k")
    return rows.withColumn("_quotient", quotient).withColumn(
        "_rank",
        F.row_number().over(w.orderBy(F.col("_alive").desc(), quotient.desc(), *best_first, F.col("_k"))),
    )


def dhondt(
    votes: DataFrame,
    magnitudes: DataFrame | int | Column,
    keys: Sequence[str] = ("district",),
    threshold: float = 0.0,
) -> DataFrame:
    """Highest-averages seats per party, with optional ``cap`` column.

    Ties go to more votes, then to the larger name. Every input party is
    returned; with no eligible party nobody gets a seat.
    """
    source = with_magnitude(votes, magnitudes, keys)
    ranked = _ranked_quotients(source, keys, threshold)
    won = F.sum((F.col("_alive") & (F.col("_rank") <= F.col("magnitude"))).cast("int"))
    carried = [c for c in source.columns if c not in (*keys, "party")]
    out = ranked.groupBy(*keys, "party").agg(*[F.first(c).alias(c) for c in carried], won.alias("seats"))
    return out.select(*source.columns, "seats")


def run_plan(
    votes: DataFrame,
    magnitudes: DataFrame | int | Column,
    keys: Sequence[str] = ("district",),
    threshold: float = 0.0,
) -> DataFrame:
    """One-level result of every district that has seats, with percentages."""
    seats = dhondt(votes, magnitudes, keys, threshold).where("magnitude > 0")
    total = F.sum("votes").over(group_window(keys))
    return seats.withColumn("votes_pct", rnd(ratio(F.col("votes"), total, 0.0) * 100, 4)).withColumn(
        "seats_pct", rnd(F.col("seats") / F.col("magnitude") * 100, 4)
    )


def attach_pact(votes: DataFrame, pacts: DataFrame) -> DataFrame:
    """Pact of each party by normalised name; a party without one stands alone."""
    table = (
        pacts.select(normalize_party_name(F.col("party")).alias("_name"), "pact")
        .groupBy("_name")
        .agg(F.min("pact").alias("pact"))
    )
    return (
        votes.drop("pact").withColumn("_name", normalize_party_name(F.col("party")))
        .join(table, "_name", "left")
        .withColumn("pact", F.coalesce("pact", "party"))
        .drop("_name")
    )


def dhondt_two_level(
    votes: DataFrame,
    magnitudes: DataFrame | int | Column,
    keys: Sequence[str] = ("district",),
    threshold: float = 0.0,
) -> DataFrame:
    """Seats to pacts first, then inside each pact to its parties.

    The parties of a pact travel with it as an array, so the votes are read
    once and need no join back. ``district_votes`` sums the positive votes.

    The threshold holds between pacts only. A ``cap`` column (registered
    candidates) limits the second level; a missing cap is the pact's seats.
    """
    keys = list(keys)
    inside = [c for c in votes.columns if c not in (*keys, "pact")]
    positive = F.greatest(F.col("votes"), F.lit(0))
    # the window places a district in one task; every later step keeps to it
    placed = votes.withColumn("_district_votes", F.sum(positive).over(group_window(keys)))
    pacts = placed.groupBy(*keys, F.col("pact").alias("party")).agg(
        F.sum(positive).alias("votes"), F.collect_list(F.struct(*inside, "_district_votes")).alias("_parties")
    )
    won = dhondt(pacts, magnitudes, keys, threshold).select(
        *keys,
        F.col("party").alias("pact"),
        F.col("magnitude").alias("district_magnitude"),
        F.col("seats").alias("pact_seats"),
        F.inline("_parties"),
    )
    out = dhondt(won, F.col("pact_seats"), [*keys, "pact"])
    return out.drop("magnitude").withColumnRenamed("district_magnitude", "magnitude").withColumnRenamed(
        "_district_votes", "district_votes"
    )


def run_plan_two_level(
    votes: DataFrame,
    magnitudes: DataFrame | int | Column,
    keys: Sequence[str] = ("district",),
    threshold: float = 0.0,
    candidates: DataFrame | None = None,
) -> DataFrame:
    """Two-level result with percentages; the vote total counts positive votes.

    ``candidates`` is (district, party, n_candidates) and turns on the caps.
    """
    keys = list(keys)
    merged = votes.groupBy(*keys, "party").agg(F.sum("votes").alias("votes"), F.min("pact").alias("pact"))
    if candidates is not None:
        on = [k for k in keys if k in candidates.columns] + ["party"]
        roster = candidates.select(*on, F.col("n_candidates").cast("int").alias("cap"))
        merged = merged.join(roster, on, "left")
    result = dhondt_two_level(merged, magnitudes, keys, threshold).where("magnitude > 0")
    return (
        result.withColumn("votes_pct", rnd(ratio(F.col("votes"), F.col("district_votes"), 0.0) * 100, 4))
        .withColumn("seats_pct", rnd(F.col("seats") / F.col("magnitude") * 100, 4))
        .withColumn("pact_seats", F.sum("seats").over(group_window([*keys, "pact"])))
        .drop("district_votes")
    )


def national_shares(results: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Vote and seat share of each party over all districts (per plan)."""
    party = results.groupBy(*keys, "party").agg(
        F.sum("votes").alias("votes"), F.sum("seats").alias("seats")
    )
    w = group_window(keys)
    return party.withColumn("vote_share", ratio(F.col("votes"), F.sum("votes").over(w))).withColumn(
        "seat_share", ratio(F.col("seats"), F.sum("seats").over(w))
    )


def magnitudes_dhondt(
    population: DataFrame,
    keys: Sequence[str] = (),
    total: int = TOTAL_SEATS,
    lowest: int = MIN_SEATS,
    highest: int = MAX_SEATS,
) -> DataFrame:
    """Seats per district by population, between ``lowest`` and ``highest``."""
    w = group_window(keys)
    n = F.count(F.lit(1)).over(w)
    checked = population.withColumn(
        "_left", ensure(n * lowest <= total, "total seats below the guaranteed minimum", F.lit(total) - n * lowest)
    )
    steps = checked.select("*", F.explode(F.sequence(F.lit(lowest), F.lit(highest))).alias("_k"))
    extra = F.col("_k") > lowest
    order = w.orderBy(extra.desc(), (F.col("population") / F.col("_k")).desc(), "district", "_k")
    won = extra & (F.row_number().over(order) <= F.col("_left"))
    return (
        steps.withColumn("_won", won.cast("int"))
        .groupBy(*population.columns)
        .agg((F.sum("_won") + lowest).cast("int").alias("magnitude"))
    )


def magnitudes_hamilton(
    population: DataFrame,
    keys: Sequence[str] = (),
    total: int = TOTAL_SEATS,
    lowest: int = MIN_SEATS,
    highest: int = MAX_SEATS,
) -> DataFrame:
    """Largest remainders above the minimum; one pass, ties by district."""
    w = group_window(keys)
    n = F.count(F.lit(1)).over(w)
    people = F.sum("population").over(w)
    room = highest - lowest
    base = population.withColumn("_people", people).withColumn(
        "_left", ensure(n * lowest <= total, "total seats below the guaranteed minimum", F.lit(total) - n * lowest)
    )
    ideal = ratio(F.col("population"), F.col("_people"), 0.0) * F.col("_left")
    base = base.withColumn("_ideal", ideal).withColumn("_add", F.least(F.floor("_ideal"), F.lit(room)))
    base = base.withColumn("_open", F.col("_left") - F.sum("_add").over(w))
    fits = F.col("_add") < room
    order = w.orderBy(fits.desc(), (F.col("_ideal") - F.col("_add")).desc(), "district")
    bonus = (fits & (F.row_number().over(order) <= F.col("_open"))).cast("int")
    seats = F.when(F.col("_people") == 0, F.lit(lowest)).otherwise(lowest + F.col("_add") + bonus)
    return base.withColumn("magnitude", seats.cast("int")).select(*population.columns, "magnitude")


def compare_magnitudes(
    population: DataFrame, current: DataFrame, method: str = "dhondt", **bounds: int
) -> DataFrame:
    """Current against recomputed seats of each district in ``current``."""
    compute = {"dhondt": magnitudes_dhondt, "hamilton": magnitudes_hamilton}[method]
    aligned = current.select("district", F.col("magnitude").alias("current_magnitude")).join(
        population.select("district", "population"), "district", "left"
    )
    aligned = aligned.withColumn("population", F.coalesce("population", F.lit(0)))
    out = compute(aligned, (), **bounds).withColumnRenamed("magnitude", "new_magnitude")
    pop = F.col("population")
    return out.withColumn("delta", F.col("new_magnitude") - F.col("current_magnitude")).withColumns(
        {
            "current_persons_per_seat": rnd(ratio(pop, F.col("current_magnitude")), 0).cast("long"),
            "new_persons_per_seat": rnd(ratio(pop, F.col("new_magnitude")), 0).cast("long"),
        }
    )


def magnitude_change_summary(changes: DataFrame) -> DataFrame:
    """Districts that gain, lose or keep seats, and the largest change."""
    largest = F.max_by(
        F.struct("district", "delta"), F.struct(F.abs("delta"), -F.col("district"))
    )
    return changes.agg(
        F.count_if(F.col("delta") > 0).alias("gaining"),
        F.count_if(F.col("delta") < 0).alias("losing"),
        F.count_if(F.col("delta") == 0).alias("equal"),
        largest.getField("district").alias("largest_district"),
        largest.getField("delta").alias("largest_delta"),
    )


def last_seat_margin(
    votes: DataFrame,
    magnitudes: DataFrame | int | Column,
    keys: Sequence[str] = ("district",),
    threshold: float = 0.0,
) -> DataFrame:
    """Last quotient awarded against the best next quotient of a rival."""
    keys = list(keys)
    source = with_magnitude(votes, magnitudes, keys)
    ranked = _ranked_quotients(source, keys, threshold, spare=1).where("_alive")
    last = F.col("_rank") == F.col("magnitude")
    marked = ranked.withColumn("winner", F.max(F.when(last, F.col("party"))).over(group_window(keys)))
    rival = (F.col("_rank") > F.col("magnitude")) & (F.col("party") != F.col("winner"))
    best_rival = F.struct("_quotient", "_v", "party")
    out = marked.groupBy(*keys).agg(
        F.max("winner").alias("last_winner"),
        F.max(F.when(last, F.col("_quotient"))).alias("_won"),
        F.max(F.when(rival, best_rival)).alias("_rival"),
    )
    won, lost = F.col("_won"), F.col("_rival._quotient")
    return out.select(
        *keys,
        "last_winner",
        F.col("_rival.party").alias("first_loser"),
        rnd(won, 2).alias("winner_quotient"),
        rnd(lost, 2).alias("loser_quotient"),
        rnd(won - lost, 2).alias("margin"),
        F.when(won > 0, rnd((won - lost) / won * 100, 2)).alias("margin_pct"),
    )


def elect_candidates(
    candidates: DataFrame,
    seats: DataFrame,
    keys: Sequence[str] = ("district", "party"),
) -> DataFrame:
    """The most voted candidates of each list; ties to the smaller id.

    Lists without a seat leave before the ranking.
    """
    keys = list(keys)
    place = F.row_number().over(group_window(keys).orderBy(F.col("votes").desc(), "candidate_id"))
    won = seats.select(*keys, "seats").where("seats > 0")
    return candidates.join(won, keys).withColumn("place", place).where("place <= seats")


def boundary_tie(
    candidates: DataFrame,
    seats: DataFrame,
    keys: Sequence[str] = ("district", "party"),
) -> DataFrame:
    """Whether the last elected and the first unelected have equal votes."""
    keys = list(keys)
    w = group_window(keys).orderBy(F.col("votes").desc(), "candidate_id")
    ranked = candidates.join(seats.select(*keys, "seats"), keys).select(*keys, "seats", "votes", F.row_number().over(w).alias("_place"))
    at = lambda place: F.max(F.when(F.col("_place") == place, F.col("votes")))
    both = ranked.where("_place <= seats + 1").groupBy(*keys, "seats").agg(
        at(F.col("seats")).alias("_last"), at(F.col("seats") + 1).alias("_next")
    )
    return both.select(*keys, "seats", F.coalesce(F.col("_last") == F.col("_next"), F.lit(False)).alias("tie"))


def one_against_two_level(votes: DataFrame, magnitudes: DataFrame | int | Column, keys: Sequence[str] = ("district",)) -> DataFrame:
    """Both methods side by side in the district with the most votes."""
    keys = list(keys)
    totals = votes.groupBy(*keys).agg(F.sum("votes").alias("_total"))
    largest = totals.agg(F.max_by(F.struct(*keys), F.struct("_total", *[-F.col(k) for k in keys])).alias("d"))
    best = attach(votes, largest)
    for k in keys:
        best = best.where(F.col(k) == F.col(f"d.{k}"))
    best = best.drop("d")
    one = dhondt(best, magnitudes, keys).select(*keys, "party", F.col("seats").alias("one_level"))
    two = dhondt_two_level(best, magnitudes, keys).select(
        *keys, "party", "pact", "votes", F.col("seats").alias("two_level")
    )
    return two.join(one, [*keys, "party"]).withColumn("delta", F.col("two_level") - F.col("one_level"))


def seat_bonus_table(votes: DataFrame, magnitudes: DataFrame | int | Column, keys: Sequence[str] = ("district",)) -> DataFrame:
    """National vote and seat percentages and bonus by method, per party."""
    parts = []
    for label, result in (
        ("one_level", run_plan(votes.drop("pact"), magnitudes, keys)),
        ("two_level", run_plan_two_level(votes, magnitudes, keys)),
    ):
        bonus = rnd((F.col("seat_share") - F.col("vote_share")) * 100, 4)
        parts.append(
            national_shares(result).select(
                F.lit(label).alias("mode"), "party",
                rnd(F.col("vote_share") * 100, 4).alias("votes_pct"),
                rnd(F.col("seat_share") * 100, 4).alias("seats_pct"),
                bonus.alias("seat_bonus"),
            )
        )
    both = parts[0].unionByName(parts[1])
    pact = votes.groupBy("party").agg(F.min("pact").alias("pact"))
    wide = both.groupBy("party").agg(
        *[
            F.max(F.when(F.col("mode") == m, F.col("seat_bonus"))).alias(f"bonus_{m}")
            for m in ("one_level", "two_level")
        ],
        F.max("votes_pct").alias("votes_pct"),
    )
    return wide.join(pact, "party").withColumn(
        "difference", rnd(F.col("bonus_two_level") - F.col("bonus_one_level"), 4)
    )


def official_input(votes: DataFrame, magnitudes: DataFrame | int | Column, pacts: DataFrame | None = None) -> DataFrame:
    """Two-level result from candidate rows that carry a pact, or from
    party rows whose pact comes from ``pacts``."""
    if pacts is None:
        summed = sum_votes(votes, ("district",), ("pact",))
    else:
        summed = attach_pact(sum_votes(votes, ("district",)), pacts)
    return run_plan_two_level(summed, magnitudes)
