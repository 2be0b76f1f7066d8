"""Checked queries: votes, seats, indices and plan ensembles."""

from __future__ import annotations

from pyspark.sql import functions as F

from hemicycle.checks import bridge as b
from hemicycle.checks.base import R, query
from hemicycle.functions import stats
from hemicycle.functions.frames import rnd
from hemicycle.functions.rules import threshold_columns
from hemicycle.operators import indices, seats
from hemicycle.plans import metrics

DV = "district_votes JOIN magnitudes USING (district)"
SRC = f"src AS (SELECT district, party, votes, magnitude FROM {DV})"
PSRC = "src AS (SELECT district, party, pact, votes, magnitude FROM pact_votes JOIN magnitudes USING (district))"
CAPS = "1 + CAST(regexp_extract(party, '[0-9]+') AS INT) % 3"


def _caps():
    return (1 + F.regexp_extract("party", r"\d+", 0).cast("int") % 3).alias("n_candidates")


def _pact_votes(spark, sf):
    return seats.attach_pact(b.district_votes(spark, sf), b.pacts(spark, sf))


@query("d1_sum_votes", "SELECT district, party, votes FROM district_votes")
def _(spark, sf):
    return seats.sum_votes(b.district_votes(spark, sf))


E1 = f"WITH {SRC}, {b.dhondt_sql('src', 'district')}"


@query("e1_dhondt", E1 + " SELECT district, party, votes, magnitude, seats FROM seats")
def _(spark, sf):
    return seats.dhondt(b.district_votes(spark, sf), b.magnitudes(spark, sf))


@query("e1_dhondt_threshold", f"WITH {SRC}, {b.dhondt_sql('src', 'district', '0.04')} "
       "SELECT district, party, votes, magnitude, seats FROM seats")
def _(spark, sf):
    return seats.dhondt(b.district_votes(spark, sf), b.magnitudes(spark, sf), threshold=0.04)


@query("e1_dhondt_negative", """WITH src AS (SELECT c_nationkey AS district, c_mktsegment AS party,
  CAST(round_even(sum(c_acctbal - 4000), 0) AS BIGINT) AS votes, 5 AS magnitude FROM customer GROUP BY ALL), """
       + b.dhondt_sql("src", "district") + " SELECT district, party, votes, magnitude, seats FROM seats")
def _(spark, sf):
    votes = b.table(spark, sf, "customer").groupBy(
        F.col("c_nationkey").alias("district"), F.col("c_mktsegment").alias("party")
    ).agg(rnd(F.sum(F.col("c_acctbal") - 4000), 0).cast("long").alias("votes"))
    return seats.dhondt(votes, 5)


@query("e2_dhondt_capped", f"WITH src AS (SELECT district, party, votes, {CAPS} AS cap, magnitude FROM {DV}), "
       + b.dhondt_sql("src", "district", cap="cap") + " SELECT district, party, votes, cap, magnitude, seats FROM seats")
def _(spark, sf):
    votes = b.district_votes(spark, sf).withColumn("cap", _caps())
    return seats.dhondt(votes, b.magnitudes(spark, sf))


RUN_PLAN = f"""run_plan AS (SELECT district, party, votes, magnitude, seats,
  {R('1e2 * votes / NULLIF(sum(votes) OVER (PARTITION BY district), 0)', 4)} AS votes_pct,
  {R('1e2 * seats / magnitude', 4)} AS seats_pct FROM seats)"""


@query("e3_run_plan", f"{E1}, {RUN_PLAN} SELECT * FROM run_plan")
def _(spark, sf):
    return seats.run_plan(b.district_votes(spark, sf), b.magnitudes(spark, sf))


@query("e4_dhondt_two_level", f"WITH {PSRC}, {b.two_level_sql('src', 'district')} "
       "SELECT district, party, pact, votes, magnitude, pact_seats, seats, CAST(sum(GREATEST(votes, 0)) OVER (PARTITION BY district) AS BIGINT) AS district_votes FROM seats")
def _(spark, sf):
    return seats.dhondt_two_level(_pact_votes(spark, sf), b.magnitudes(spark, sf))


@query("e4_dhondt_two_level_threshold", f"WITH {PSRC}, {b.two_level_sql('src', 'district', '0.05')} "
       "SELECT district, party, pact, votes, magnitude, pact_seats, seats, CAST(sum(GREATEST(votes, 0)) OVER (PARTITION BY district) AS BIGINT) AS district_votes FROM seats")
def _(spark, sf):
    return seats.dhondt_two_level(_pact_votes(spark, sf), b.magnitudes(spark, sf), threshold=0.05)


CAPPED = PSRC.replace("votes, magnitude", f"votes, {CAPS} AS cap, magnitude")


@query("e5_dhondt_two_level_capped", f"WITH {CAPPED}, {b.two_level_sql('src', 'district', cap='cap')} "
       "SELECT district, party, pact, votes, cap, magnitude, pact_seats, seats, CAST(sum(GREATEST(votes, 0)) OVER (PARTITION BY district) AS BIGINT) AS district_votes FROM seats")
def _(spark, sf):
    votes = _pact_votes(spark, sf).withColumn("cap", _caps())
    return seats.dhondt_two_level(votes, b.magnitudes(spark, sf))


TWO_PLAN = f"""two_plan AS (SELECT district, party, pact, votes, magnitude, seats,
  CAST(sum(seats) OVER (PARTITION BY district, pact) AS BIGINT) AS pact_seats,
  {R('1e2 * votes / NULLIF(sum(GREATEST(votes, 0)) OVER (PARTITION BY district), 0)', 4)} AS votes_pct,
  {R('1e2 * seats / magnitude', 4)} AS seats_pct FROM seats)"""
E6 = f"WITH {PSRC}, {b.two_level_sql('src', 'district')}, {TWO_PLAN}"


@query("e6_run_plan_two_level", f"{E6} SELECT * FROM two_plan")
def _(spark, sf):
    return seats.run_plan_two_level(_pact_votes(spark, sf), b.magnitudes(spark, sf))


@query("e6_run_plan_two_level_roster", f"WITH {CAPPED}, {b.two_level_sql('src', 'district', cap='cap')}, "
       f"{TWO_PLAN.replace('seats,', 'cap, seats,', 1)} SELECT * FROM two_plan")
def _(spark, sf):
    votes = _pact_votes(spark, sf)
    roster = votes.select("district", "party", _caps())
    return seats.run_plan_two_level(votes, b.magnitudes(spark, sf), candidates=roster)


SH = f"{E1}, {b.shares_sql('seats', '')}"


@query("e7_national_shares", f"{SH} SELECT party, votes, seats, {R('vote_share', 9)} AS vote_share, "
       f"{R('seat_share', 9)} AS seat_share FROM shares")
def _(spark, sf):
    out = _shares(spark, sf)
    return out.withColumn("vote_share", rnd("vote_share", 9)).withColumn("seat_share", rnd("seat_share", 9))


def _shares(spark, sf):
    return seats.national_shares(seats.run_plan(b.district_votes(spark, sf), b.magnitudes(spark, sf)))


MAGS = b.magnitude_sql("district_population", "", 155, 3, 8)


@query("e8_magnitudes_dhondt", f"WITH {MAGS} SELECT * FROM mags")
def _(spark, sf):
    return seats.magnitudes_dhondt(b.district_population(spark, sf))


@query("e8_magnitudes_by_plan", f"WITH {b.magnitude_sql('plan_population', 'plan_id', 40, 2, 7)} SELECT * FROM mags")
def _(spark, sf):
    pop = metrics.district_population(b.plans(spark, sf), b.population(spark, sf))
    return seats.magnitudes_dhondt(pop, ("plan_id",), 40, 2, 7)


@query("e9_magnitudes_hamilton", """WITH i AS (SELECT *, 155 - 3 * count(*) OVER () AS rest,
  population / CAST(sum(population) OVER () AS DOUBLE) * (155 - 3 * count(*) OVER ()) AS ideal FROM district_population),
a AS (SELECT *, LEAST(floor(ideal), 5) AS add1 FROM i),
o AS (SELECT *, rest - sum(add1) OVER () AS open1,
  row_number() OVER (ORDER BY add1 < 5 DESC, ideal - add1 DESC, district) AS rn FROM a)
SELECT district, population, CAST(3 + add1 + CASE WHEN add1 < 5 AND rn <= open1 THEN 1 ELSE 0 END AS INT) AS magnitude FROM o""")
def _(spark, sf):
    return seats.magnitudes_hamilton(b.district_population(spark, sf))


E10 = f"""WITH {MAGS}, cmp AS (SELECT m.district, m.magnitude AS current_magnitude, x.population, x.magnitude AS new_magnitude,
  x.magnitude - m.magnitude AS delta,
  CAST(round_even(x.population / CAST(m.magnitude AS DOUBLE), 0) AS BIGINT) AS current_persons_per_seat,
  CAST(round_even(x.population / CAST(x.magnitude AS DOUBLE), 0) AS BIGINT) AS new_persons_per_seat
FROM magnitudes m JOIN mags x USING (district))"""


@query("e10_compare_magnitudes", f"{E10} SELECT * FROM cmp")
def _(spark, sf):
    return seats.compare_magnitudes(b.district_population(spark, sf), b.magnitudes(spark, sf))


@query("e18_magnitude_change_summary", f"""{E10} SELECT count(*) FILTER (delta > 0) AS gaining,
  count(*) FILTER (delta < 0) AS losing, count(*) FILTER (delta = 0) AS equal,
  (SELECT district FROM cmp ORDER BY abs(delta) DESC, district LIMIT 1) AS largest_district,
  (SELECT delta FROM cmp ORDER BY abs(delta) DESC, district LIMIT 1) AS largest_delta FROM cmp""")
def _(spark, sf):
    changes = seats.compare_magnitudes(b.district_population(spark, sf), b.magnitudes(spark, sf))
    return seats.magnitude_change_summary(changes)


@query("e11_last_seat_margin", f"""{E1}, lastq AS (SELECT district, party AS last_winner, v / CAST(k AS DOUBLE) AS wq
  FROM seats_r WHERE rn = magnitude),
nextq AS (SELECT s.district, s.party, s.votes, s.votes / CAST(s.seats + 1 AS DOUBLE) AS q, l.last_winner, l.wq
  FROM seats s JOIN lastq l USING (district) WHERE s.party <> l.last_winner),
best AS (SELECT *, row_number() OVER (PARTITION BY district ORDER BY q DESC, votes DESC, party DESC) AS rn FROM nextq)
SELECT district, last_winner, party AS first_loser, {R('wq', 2)} AS winner_quotient, {R('q', 2)} AS loser_quotient,
  {R('wq - q', 2)} AS margin, {R('(wq - q) / wq * 100', 2)} AS margin_pct FROM best WHERE rn = 1""")
def _(spark, sf):
    return seats.last_seat_margin(b.district_votes(spark, sf), b.magnitudes(spark, sf))


def candidates(spark, sf):
    """Parts as candidates of their brand, by region of the buyer."""
    unit = b.units(spark, sf).select(F.col("unit_id").alias("o_custkey"), F.col("region").alias("district"))
    orders = b.table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    lines = b.table(spark, sf, "lineitem").select("l_orderkey", F.col("l_partkey").alias("candidate_id"), "l_quantity")
    part = b.table(spark, sf, "part").select(F.col("p_partkey").alias("candidate_id"), F.col("p_brand").alias("party"))
    sold = lines.join(orders, "l_orderkey").groupBy("o_custkey", "candidate_id").agg(F.sum("l_quantity").alias("q"))
    votes = sold.join(unit, "o_custkey").groupBy("district", "candidate_id").agg(F.sum("q").cast("long").alias("votes"))
    return votes.join(part, "candidate_id")


b.cte("candidates", """SELECT region AS district, l_partkey AS candidate_id, p_brand AS party, CAST(sum(l_quantity) AS BIGINT) AS votes
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN units ON o_custkey = unit_id
JOIN part ON l_partkey = p_partkey GROUP BY ALL""")
b.cte("list_votes", """SELECT district, party, CAST(sum(votes) AS BIGINT) AS votes, 30 AS magnitude FROM candidates GROUP BY 1, 2""")
LISTS = f"WITH {b.dhondt_sql('list_votes', 'district')}"


def _list_seats(spark, sf):
    return seats.dhondt(seats.sum_votes(candidates(spark, sf)), 30)


@query("e12_elect_candidates", f"""{LISTS}, r AS (SELECT *, row_number() OVER (PARTITION BY district, party
  ORDER BY votes DESC, candidate_id) AS place FROM candidates)
SELECT r.district, r.party, candidate_id, r.votes, place, seats FROM r JOIN seats USING (district, party) WHERE place <= seats""")
def _(spark, sf):
    return seats.elect_candidates(candidates(spark, sf), _list_seats(spark, sf))


@query("e13_boundary_tie", f"""{LISTS}, r AS (SELECT *, row_number() OVER w AS place, lead(votes) OVER w AS nxt FROM candidates
  WINDOW w AS (PARTITION BY district, party ORDER BY votes DESC, candidate_id))
SELECT district, party, seats, COALESCE(bool_or(place = seats AND r.votes = nxt), false) AS tie
FROM r JOIN seats USING (district, party) GROUP BY ALL""")
def _(spark, sf):
    return seats.boundary_tie(candidates(spark, sf), _list_seats(spark, sf))


BEST = "(SELECT district FROM district_votes GROUP BY 1 ORDER BY sum(votes) DESC, district LIMIT 1)"


@query("e14_one_against_two_level", f"""WITH src AS (SELECT district, party, pact, votes, magnitude FROM pact_votes
  JOIN magnitudes USING (district) WHERE district = {BEST}),
{b.dhondt_sql('src', 'district', out='one')}, {b.two_level_sql('src', 'district', out='two')}
SELECT two.district, two.party, two.pact, two.votes, one.seats AS one_level, two.seats AS two_level,
  two.seats - one.seats AS delta FROM one JOIN two USING (district, party)""")
def _(spark, sf):
    return seats.one_against_two_level(_pact_votes(spark, sf), b.magnitudes(spark, sf))


# ---- F16-style metrics, one SQL generator for all configurations ----

def plan_metrics_sql(plan_where: str, fixed: bool, two: bool, tag: str) -> str:
    """CTEs ending in ``<tag>``: one metrics row per plan."""
    mags = (
        f"{tag}_m AS (SELECT p.*, g.magnitude FROM {tag}_pop p LEFT JOIN plan_magnitudes g USING (district))"
        if fixed else b.magnitude_sql(f"{tag}_pop", "plan_id", 44, 3, 8, f"{tag}_m")
    )
    if two:
        src = f"""SELECT v.plan_id, v.district, party, COALESCE(pact, party) AS pact, votes, magnitude
  FROM plan_votes v JOIN {tag}_m USING (plan_id, district) LEFT JOIN type_pacts USING (party)"""
        alloc = b.two_level_sql(f"{tag}_src", "plan_id, district", out=f"{tag}_seats")
    else:
        src = f"SELECT v.plan_id, v.district, party, votes, magnitude FROM plan_votes v JOIN {tag}_m USING (plan_id, district)"
        alloc = b.dhondt_sql(f"{tag}_src", "plan_id, district", out=f"{tag}_seats")
    mode = f"'{'two' if two else 'one'}_level' AS allocation_mode, '{'fixed' if fixed else 'computed'}' AS magnitude_mode"
    return f"""{tag}_pop AS (SELECT * FROM plan_population WHERE {plan_where}), {mags},
{tag}_src AS ({src}), {alloc}, {b.shares_sql(f'{tag}_seats', 'plan_id', f'{tag}_sh')},
{tag}_a AS (SELECT plan_id, {R('sqrt(sum(pow(100 * vote_share - 100 * seat_share, 2)) / 2)', 4)} AS gallagher,
  {R('sum(abs(100 * vote_share - 100 * seat_share)) / 2', 4)} AS loosemore_hanby,
  {R('avg(abs(100 * vote_share - 100 * seat_share))', 4)} AS rae,
  {R('1 / sum(vote_share * vote_share)', 4)} AS enp_votes, {R('1 / sum(seat_share * seat_share)', 4)} AS enp_seats,
  max(seats) AS largest_party_seats, count(*) FILTER (seats > 0) AS parties_with_seats,
  {R('max(abs(100 * seat_share - 100 * vote_share))', 4)} AS seat_bonus_max FROM {tag}_sh GROUP BY 1),
{tag}_w AS (SELECT *, population / CAST(magnitude AS DOUBLE) AS pps,
  population / CAST(magnitude AS DOUBLE) / (sum(population) OVER (PARTITION BY plan_id) / CAST(sum(magnitude) OVER (PARTITION BY plan_id) AS DOUBLE)) AS rel
  FROM {tag}_m),
{tag}_b AS (SELECT plan_id, {R('max(pps)', 0)} AS persons_per_seat_max, {R('min(pps)', 0)} AS persons_per_seat_min,
  {R('max(pps) / min(pps)', 4)} AS persons_per_seat_ratio, {R('max(rel)', 4)} AS relative_weight_max,
  {R('min(rel)', 4)} AS relative_weight_min FROM {tag}_w GROUP BY 1),
{tag} AS (SELECT *, {mode} FROM {tag}_a JOIN {tag}_b USING (plan_id))"""


F16_SQL = plan_metrics_sql("true", False, True, "f16")


@query("f16_plan_electoral_metrics", f"WITH {F16_SQL} SELECT * FROM f16")
def _(spark, sf):
    return metrics.plan_electoral_metrics(
        b.plans(spark, sf), b.unit_votes(spark, sf), b.population(spark, sf),
        pacts=b.type_pacts(spark, sf), total=44,
    )


@query("f16_plan_electoral_metrics_fixed", f"WITH {plan_metrics_sql('true', True, False, 'f16')} SELECT * FROM f16")
def _(spark, sf):
    return metrics.plan_electoral_metrics(
        b.plans(spark, sf), b.unit_votes(spark, sf), b.population(spark, sf), b.plan_magnitudes(spark, sf)
    )


PARTIES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]
BONUS = ", ".join(
    f"max(CASE WHEN party = '{p}' THEN {R('100 * seat_share - 100 * vote_share', 4)} END) AS \"seat_bonus_{p}\"" for p in PARTIES
)
F17_SQL = f"""{plan_metrics_sql('true', True, False, 'f16')}, f17 AS (SELECT plan_id, gallagher, loosemore_hanby, rae, enp_votes,
 enp_seats, parties_with_seats, {', '.join(f'"seat_bonus_{p}"' for p in PARTIES)}, allocation_mode, magnitude_mode
FROM f16 JOIN (SELECT plan_id, {BONUS} FROM f16_sh GROUP BY 1) USING (plan_id))"""


def _ensemble(spark, sf):
    return metrics.electoral_ensemble(
        b.plans(spark, sf), b.unit_votes(spark, sf), b.population(spark, sf),
        b.plan_magnitudes(spark, sf), parties=PARTIES,
    )


@query("f17_electoral_ensemble", f"WITH {F17_SQL} SELECT * FROM f17")
def _(spark, sf):
    return _ensemble(spark, sf)


@query("f17_party_bonus", f"""WITH {plan_metrics_sql('true', True, False, 'f16')}
SELECT plan_id, party, {R('100 * seat_share - 100 * vote_share', 4)} AS seat_bonus FROM f16_sh""")
def _(spark, sf):
    cast = metrics.assign_votes(b.unit_votes(spark, sf), b.plans(spark, sf))
    return metrics.ensemble_seat_bonus(seats.run_plan(cast, b.plan_magnitudes(spark, sf), ("plan_id", "district")))


def stats_sql(value: str) -> str:
    q = lambda p: f"quantile_cont({value}, {p}e0)"
    sd = f"COALESCE(stddev_samp({value}), 0)"
    mean = f"avg({value})"
    return f"""{R(mean, 6)} AS mean, {R(sd, 6)} AS std, {R(f'{mean} - 1.96e0 * {sd} / sqrt(count({value}))', 6)} AS ci95_low,
 {R(f'{mean} + 1.96e0 * {sd} / sqrt(count({value}))', 6)} AS ci95_high, count({value}) AS n,
 {R(q('0.05'), 6)} AS p5, {R(q('0.25'), 6)} AS p25, {R(q('0.5'), 6)} AS median, {R(q('0.75'), 6)} AS p75, {R(q('0.95'), 6)} AS p95"""


F18_METRICS = ["gallagher", "loosemore_hanby", "rae", "enp_votes", "enp_seats", "parties_with_seats", *[f"seat_bonus_{p}" for p in PARTIES]]


@query("f18_ensemble_summary", f"""WITH {F17_SQL}, l AS (UNPIVOT (SELECT {', '.join(f'CAST("{m}" AS DOUBLE) AS "{m}"' for m in F18_METRICS)} FROM f17)
  ON COLUMNS(*) INTO NAME metric VALUE value) SELECT metric, {stats_sql('value')} FROM l GROUP BY 1""")
def _(spark, sf):
    return metrics.ensemble_summary(_ensemble(spark, sf), F18_METRICS)


@query("f19_ensemble_threshold", f"""WITH {b.magnitude_sql('plan_population', 'plan_id', 44, 3, 8)},
 t AS (SELECT district, {R('1 / (magnitude + 1e0)', 4)} AS u FROM mags) SELECT district, {stats_sql('u')} FROM t GROUP BY 1""")
def _(spark, sf):
    pop = metrics.district_population(b.plans(spark, sf), b.population(spark, sf))
    return metrics.ensemble_threshold(seats.magnitudes_dhondt(pop, ("plan_id",), 44))


@query("e15_mode_matrix", "WITH " + ", ".join(
    plan_metrics_sql("plan_id = 0", f, t, f"m{int(f)}{int(t)}") for f in (True, False) for t in (False, True)
) + " SELECT * FROM m10 UNION ALL SELECT * FROM m11 UNION ALL SELECT * FROM m00 UNION ALL SELECT * FROM m01")
def _(spark, sf):
    return _matrix(spark, sf)


def _matrix(spark, sf):
    return metrics.mode_matrix(
        b.plans(spark, sf).where("plan_id = 0"), b.unit_votes(spark, sf), b.population(spark, sf),
        b.plan_magnitudes(spark, sf), b.type_pacts(spark, sf), total=44,
    )


@query("e15_mode_deltas", "WITH " + ", ".join(
    plan_metrics_sql("plan_id = 0", f, t, f"m{int(f)}{int(t)}") for f in (True, False) for t in (False, True)
) + """, al AS (SELECT * FROM m10 UNION ALL SELECT * FROM m11 UNION ALL SELECT * FROM m00 UNION ALL SELECT * FROM m01),
l AS (SELECT allocation_mode, magnitude_mode, unnest(['gallagher', 'enp_seats', 'persons_per_seat_ratio']) AS metric,
  unnest([gallagher, enp_seats, persons_per_seat_ratio]) AS value FROM al)
SELECT allocation_mode, metric, max(value) FILTER (magnitude_mode = 'fixed') AS fixed,
  max(value) FILTER (magnitude_mode = 'computed') AS computed, """
       + R("max(value) FILTER (magnitude_mode = 'fixed') - max(value) FILTER (magnitude_mode = 'computed')", 4)
       + " AS delta FROM l GROUP BY 1, 2")
def _(spark, sf):
    return metrics.mode_deltas(_matrix(spark, sf), ["gallagher", "enp_seats", "persons_per_seat_ratio"])


@query("e16_seat_bonus_table", f"""WITH {PSRC}, {b.dhondt_sql('src', 'district', out='one')}, {b.two_level_sql('src', 'district', out='two')},
{b.shares_sql('one', '', 's1')}, {b.shares_sql('two', '', 's2')}, pa AS (SELECT party, min(pact) AS pact FROM pact_votes GROUP BY 1),
j AS (SELECT s1.party, pact, {R('100 * s1.vote_share', 4)} AS votes_pct, {R('100 * (s1.seat_share - s1.vote_share)', 4)} AS bonus_one_level,
  {R('100 * (s2.seat_share - s2.vote_share)', 4)} AS bonus_two_level FROM s1 JOIN s2 USING (party) JOIN pa USING (party))
SELECT *, {R('bonus_two_level - bonus_one_level', 4)} AS difference FROM j""")
def _(spark, sf):
    return seats.seat_bonus_table(_pact_votes(spark, sf), b.magnitudes(spark, sf))


@query("e17_official_from_parties", f"{E6} SELECT * FROM two_plan")
def _(spark, sf):
    return seats.official_input(b.district_votes(spark, sf), b.magnitudes(spark, sf), b.pacts(spark, sf))


@query("e17_official_from_candidates", f"""WITH src AS (SELECT district, party, 'P' || (CAST(regexp_extract(party, '[0-9]+') AS INT) % 6) AS pact,
  votes, 30 AS magnitude FROM list_votes), {b.two_level_sql('src', 'district')}, {TWO_PLAN} SELECT * FROM two_plan""")
def _(spark, sf):
    own_pact = F.concat(F.lit("P"), (F.regexp_extract("party", r"\d+", 0).cast("int") % 6).cast("string"))
    return seats.official_input(candidates(spark, sf).withColumn("pact", own_pact), 30)


INDICES = {
    "f1_gallagher": ("gallagher", "sqrt(sum(pow(100 * vote_share - 100 * seat_share, 2)) / 2)"),
    "f2_loosemore_hanby": ("loosemore_hanby", "sum(abs(100 * vote_share - 100 * seat_share)) / 2"),
    "f3_rae": ("rae", "avg(abs(100 * vote_share - 100 * seat_share))"),
    "f4_effective_parties": ("enp_seats", "1 / sum(seat_share * seat_share)"),
}
for _name, (_column, _text) in INDICES.items():
    @query(_name, f"{SH} SELECT {R(_text, 6)} AS {_column} FROM shares")
    def _(spark, sf, column=_column):
        return indices.disproportionality(_shares(spark, sf), digits=6).select(column)


@query("f5_proportionality_summary", f"""{SH}, w AS (SELECT {', '.join(f'{R(t, 4)} AS {c}' for c, t in INDICES.values())},
  {R('1 / sum(vote_share * vote_share)', 4)} AS enp_votes FROM shares)
UNPIVOT w ON COLUMNS(*) INTO NAME indicator VALUE value""".replace("UNPIVOT w ON", "SELECT indicator, value FROM (UNPIVOT w ON") + ")")
def _(spark, sf):
    return indices.proportionality_summary(_shares(spark, sf))


@query("f6_seat_bonus", f"{SH} SELECT party, {R('100 * seat_share - 100 * vote_share', 4)} AS seat_bonus FROM shares")
def _(spark, sf):
    return indices.seat_bonus(_shares(spark, sf)).select("party", "seat_bonus")


def _districts(spark, sf):
    return indices.district_table(b.district_population(spark, sf), b.magnitudes(spark, sf))


b.cte("districts", "SELECT district, population, magnitude, population / CAST(magnitude AS DOUBLE) AS x FROM district_population JOIN magnitudes USING (district)")


@query("f7_persons_per_seat", f"SELECT district, population, magnitude, {R('x', 6)} AS persons_per_seat FROM districts")
def _(spark, sf):
    return indices.persons_per_seat(_districts(spark, sf)).withColumn("persons_per_seat", rnd("persons_per_seat", 6))


WEIGHT = "x / (sum(population) OVER () / CAST(sum(magnitude) OVER () AS DOUBLE))"


@query("f8_relative_vote_weight", f"SELECT district, {R(WEIGHT, 6)} AS relative_weight FROM districts")
def _(spark, sf):
    return indices.relative_vote_weight(_districts(spark, sf)).select("district", rnd("relative_weight", 6).alias("relative_weight"))


IDEAL = "sum(population) OVER () * magnitude / CAST(sum(magnitude) OVER () AS DOUBLE)"


@query("f9_weighted_balance", f"""SELECT district, population, magnitude, {R(IDEAL, 6)} AS ideal,
 {R(f'(population - {IDEAL}) / ({IDEAL}) * 100', 6)} AS deviation_pct, {R('x', 6)} AS persons_per_seat, {R(WEIGHT, 6)} AS relative_weight
FROM districts""")
def _(spark, sf):
    units = b.unit_frame(spark, sf)
    plan = units.select("unit_id", F.col("commune").alias("district"))
    out = indices.weighted_balance(units.select("unit_id", "population"), plan, b.magnitudes(spark, sf))
    return out.select("district", "population", "magnitude", *[
        rnd(c, 6).alias(c) for c in ("ideal", "deviation_pct", "persons_per_seat", "relative_weight")])


SNYDER = """sn AS (SELECT sum(abs(m - p)) / 2 AS ss FROM (SELECT magnitude / CAST(sum(magnitude) OVER () AS DOUBLE) AS m,
 population / CAST(sum(population) OVER () AS DOUBLE) AS p FROM districts))"""
GINI = """ps AS (SELECT x, population / CAST(sum(population) OVER () AS DOUBLE) AS p,
 row_number() OVER (ORDER BY x, district) AS rk, count(*) OVER () AS n, avg(x) OVER () AS mean FROM districts),
gw AS (SELECT sum(a.p * b.p * abs(a.x - b.x)) / (2 * (SELECT sum(p * x) FROM ps)) AS gini_weighted FROM ps a, ps b),
gu AS (SELECT GREATEST(2 / (max(n) * max(n) * max(mean)) * sum(rk * x) - (max(n) + 1e0) / max(n), 0) AS gini_unweighted FROM ps)"""
RATIO = f"""SELECT {R('max(x) / min(x)', 4)} AS max_min_ratio, {R('max(x)', 1)} AS max_persons_per_seat,
 (SELECT district FROM districts ORDER BY x DESC, district LIMIT 1) AS max_district, {R('min(x)', 1)} AS min_persons_per_seat,
 (SELECT district FROM districts ORDER BY x, district LIMIT 1) AS min_district,
 {R('sum(population) / CAST(sum(magnitude) AS DOUBLE)', 1)} AS mean_persons_per_seat, {R('stddev_samp(x)', 1)} AS sd_persons_per_seat,
 {R('stddev_samp(x) / (sum(population) / CAST(sum(magnitude) AS DOUBLE))', 4)} AS cv FROM districts"""


@query("f10_samuels_snyder", f"WITH {SNYDER} SELECT {R('ss', 6)} AS samuels_snyder FROM sn")
def _(spark, sf):
    return indices.samuels_snyder(_districts(spark, sf))


@query("f11_gini_persons_per_seat", f"WITH {GINI} SELECT {R('gini_weighted', 6)} AS gini_weighted, {R('gini_unweighted', 6)} AS gini_unweighted FROM gw, gu")
def _(spark, sf):
    return indices.gini(_districts(spark, sf))


@query("f12_max_min_ratio", RATIO)
def _(spark, sf):
    return indices.max_min_ratio(_districts(spark, sf))


@query("f13_malapportionment_summary", f"""WITH {SNYDER}, {GINI}, r AS ({RATIO}),
z AS (SELECT count(*) AS n_districts, CAST(sum(magnitude) AS BIGINT) AS total_seats, CAST(sum(population) AS BIGINT) AS total_population FROM districts)
SELECT 0 AS plan_id, n_districts, total_seats, total_population, {R('ss', 6)} AS samuels_snyder, {R('gini_weighted', 6)} AS gini_weighted,
 {R('gini_unweighted', 6)} AS gini_unweighted, r.* FROM z, sn, gw, gu, r""")
def _(spark, sf):
    return indices.malapportionment_summary(_districts(spark, sf).withColumn("plan_id", F.lit(0)))


COMPARE = f"""{b.magnitude_sql('plan_population', 'plan_id', 44, 3, 8)},
d AS (SELECT *, population / CAST(magnitude AS DOUBLE) AS x FROM mags),
ps AS (SELECT *, population / CAST(sum(population) OVER w AS DOUBLE) AS p, magnitude / CAST(sum(magnitude) OVER w AS DOUBLE) AS m,
  row_number() OVER (PARTITION BY plan_id ORDER BY x, district) AS rk, count(*) OVER w AS n, avg(x) OVER w AS mean FROM d
  WINDOW w AS (PARTITION BY plan_id)),
gw AS (SELECT a.plan_id, sum(a.p * b.p * abs(a.x - b.x)) AS g FROM ps a JOIN ps b ON a.plan_id = b.plan_id GROUP BY 1),
cmp AS (SELECT ps.plan_id, count(*) AS n_districts, CAST(sum(magnitude) AS BIGINT) AS total_seats, CAST(sum(population) AS BIGINT) AS total_population,
 {R('sum(abs(m - p)) / 2', 6)} AS samuels_snyder, {R('max(g) / (2 * sum(p * x))', 6)} AS gini_weighted,
 {R('GREATEST(2 / (max(n) * max(n) * max(mean)) * sum(rk * x) - (max(n) + 1e0) / max(n), 0)', 6)} AS gini_unweighted,
 {R('max(x) / min(x)', 4)} AS max_min_ratio, {R('max(x)', 1)} AS max_persons_per_seat, arg_max(district, (x, -district)) AS max_district,
 {R('min(x)', 1)} AS min_persons_per_seat, arg_min(district, (x, district)) AS min_district,
 {R('sum(population) / CAST(sum(magnitude) AS DOUBLE)', 1)} AS mean_persons_per_seat, {R('stddev_samp(x)', 1)} AS sd_persons_per_seat,
 {R('stddev_samp(x) / (sum(population) / CAST(sum(magnitude) AS DOUBLE))', 4)} AS cv FROM ps JOIN gw USING (plan_id) GROUP BY 1)"""


def _compared(spark, sf):
    return indices.compare_plans(b.plans(spark, sf), b.population(spark, sf), total=44)


@query("f14_compare_plans", f"WITH {COMPARE} SELECT * FROM cmp")
def _(spark, sf):
    return _compared(spark, sf)


@query("f15_international_comparison", f"""WITH {COMPARE}, lit(label, samuels_snyder, gini_weighted, max_min_ratio, cv) AS (VALUES
 {', '.join(f"('{n}', {a}e0, {g}e0, {m}e0, {c}e0)" for n, a, g, m, c in indices.LITERATURE)})
SELECT *, 'benchmark' AS kind FROM lit UNION ALL
SELECT 'plan_' || plan_id, samuels_snyder, gini_weighted, max_min_ratio, cv, 'custom' FROM cmp""")
def _(spark, sf):
    own = _compared(spark, sf).select(
        F.concat(F.lit("plan_"), F.col("plan_id").cast("string")).alias("label"),
        "samuels_snyder", "gini_weighted", "max_min_ratio", "cv",
    )
    return indices.international_comparison(own)


@query("d12_dist_stats", f"SELECT event_type, {stats_sql('value')} FROM events GROUP BY 1")
def _(spark, sf):
    return stats.dist_stats(b.table(spark, sf, "events"), "value", ["event_type"])


@query("f20_ecdf", f"""SELECT event_type, value, n, {R('upto / CAST(size AS DOUBLE)', 9)} AS share FROM (SELECT event_type, value, count(*) AS n,
 sum(count(*)) OVER (PARTITION BY event_type ORDER BY value) AS upto, sum(count(*)) OVER (PARTITION BY event_type) AS size
FROM events GROUP BY 1, 2)""")
def _(spark, sf):
    out = stats.ecdf(b.table(spark, sf, "events"), "value", ["event_type"])
    return out.withColumn("share", rnd("share", 9))


@query("f20_share_at_or_below", f"SELECT event_type, {R('count(*) FILTER (value <= 12.5e0) / CAST(count(value) AS DOUBLE)', 9)} AS share_at_or_below FROM events GROUP BY 1")
def _(spark, sf):
    out = stats.share_at_or_below(b.table(spark, sf, "events"), "value", 12.5, ["event_type"])
    return out.withColumn("share_at_or_below", rnd("share_at_or_below", 9))


@query("f20_histogram", """SELECT event_type, a AS low, b AS high, CAST(LEAST(floor((value - a) / (b - a) * 30), 29) AS BIGINT) AS bin, count(*) AS n
FROM (SELECT *, min(value) OVER w AS a, max(value) OVER w AS b FROM events WINDOW w AS (PARTITION BY event_type)) GROUP BY ALL""")
def _(spark, sf):
    return stats.histogram(b.table(spark, sf, "events"), "value", 30, ["event_type"])


@query("f20_radar", f"""WITH {F17_SQL}, l AS (SELECT plan_id, unnest(['gallagher', 'enp_votes']) AS metric, unnest([gallagher, enp_votes]) AS value FROM f17),
s AS (SELECT *, min(value) OVER w AS a, max(value) OVER w AS b FROM l WINDOW w AS (PARTITION BY metric))
SELECT plan_id, metric, {R("CASE WHEN a = b THEN 0.5 WHEN metric = 'gallagher' THEN 1 - (value - a) / (b - a) ELSE (value - a) / (b - a) END", 6)} AS score FROM s""")
def _(spark, sf):
    out = stats.radar(_ensemble(spark, sf), "plan_id", {"gallagher": "min", "enp_votes": "max"})
    return out.withColumn("score", rnd("score", 6))


@query("b11_threshold_columns", f"""SELECT district, magnitude, {R('1 / (magnitude + 1e0)', 4)} AS t_upper, {R('1 / (2e0 * magnitude)', 4)} AS t_lower,
 {R(f"sqrt(1 / (2e0 * magnitude) * {R('1 / (magnitude + 1e0)', 4)})", 4)} AS t_effective,
 CASE WHEN {R('1 / (magnitude + 1e0)', 4)} <= 0.125 THEN 'Bajo' WHEN {R('1 / (magnitude + 1e0)', 4)} <= 0.167 THEN 'Medio' ELSE 'Alto' END AS category
FROM (WITH {MAGS} SELECT * FROM mags)""")
def _(spark, sf):
    mags = seats.magnitudes_dhondt(b.district_population(spark, sf))
    return mags.select("district", "magnitude", *[c.alias(n) for n, c in threshold_columns(F.col("magnitude")).items()])
