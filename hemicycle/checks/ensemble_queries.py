"""Checked queries: fair shares, scenario comparison, fronts and chains."""

from __future__ import annotations

from pyspark.sql import functions as F

from hemicycle.checks import bridge as b
from hemicycle.checks.base import R, cte, query
from hemicycle.checks.plan_queries import event_stats, rounded
from hemicycle.operators import chains, ensemble, fairshare, pareto, seats

# ---- fair shares ----

FAIR = "fair AS (SELECT party, district, votes, magnitude, votes / CAST(sum(votes) OVER (PARTITION BY district) AS DOUBLE) * magnitude AS fair_share FROM district_votes JOIN magnitudes USING (district))"
ALLOC = f"src AS (SELECT district, party, votes, magnitude FROM district_votes JOIN magnitudes USING (district)), {b.dhondt_sql('src', 'district')}"
GAPS = f"WITH {FAIR}, {ALLOC}, gaps AS (SELECT party, district, seats, fair_share, seats - fair_share AS gap FROM fair JOIN seats USING (party, district))"


def _fair(spark, sf):
    return fairshare.fair_share_district(b.district_votes(spark, sf), b.magnitudes(spark, sf))


def _alloc(spark, sf):
    return seats.dhondt(b.district_votes(spark, sf), b.magnitudes(spark, sf))


@query("q1_votes_matrix", """SELECT district, party, COALESCE(votes, 0) AS value FROM (SELECT DISTINCT district FROM district_votes) d,
(SELECT DISTINCT party FROM district_votes) p LEFT JOIN district_votes v USING (district, party) WHERE true""".replace(
    "d,\n(SELECT DISTINCT party FROM district_votes) p LEFT JOIN", "d CROSS JOIN (SELECT DISTINCT party FROM district_votes) p LEFT JOIN").replace(" WHERE true", ""))
def _(spark, sf):
    return fairshare.matrix(b.district_votes(spark, sf), "votes").select("district", "party", "value")


@query("q1_seats_matrix_wide", f"""WITH {ALLOC} SELECT party, {', '.join(f'CAST(COALESCE(sum(seats) FILTER (district = {d}), 0) AS BIGINT) AS "{d}"' for d in range(25))} FROM seats GROUP BY 1""")
def _(spark, sf):
    return fairshare.pivoted(fairshare.matrix(_alloc(spark, sf), "seats"), range(25))


@query("q2_fair_share_district", f"WITH {FAIR} SELECT party, district, votes, magnitude, {R('fair_share', 6)} AS fair_share FROM fair")
def _(spark, sf):
    return rounded(_fair(spark, sf)).select("party", "district", "votes", "magnitude", "fair_share")


@query("q3_fair_share_biproportional")
def _(spark, sf):
    shares, settled = fairshare.fair_share_biproportional(b.district_votes(spark, sf), b.magnitudes(spark, sf))
    return rounded(shares).withColumn("converged", F.lit(settled))


@query("q3_fair_share_by_plan")
def _(spark, sf):
    from hemicycle.plans.metrics import assign_votes

    votes = assign_votes(b.unit_votes(spark, sf), b.plans(spark, sf))
    return rounded(fairshare.fair_share_biproportional_by_plan(votes, b.plan_magnitudes(spark, sf)))


@query("q4_distances", f"{GAPS} SELECT {R('sum(abs(gap))', 6)} AS l1, {R('sum(abs(gap)) / sum(fair_share)', 6)} AS l1_norm, {R('sqrt(sum(gap * gap))', 6)} AS l2, {R('sqrt(avg(gap * gap))', 6)} AS rmse FROM gaps")
def _(spark, sf):
    return rounded(fairshare.distances(_alloc(spark, sf), _fair(spark, sf)))


DIRECTION = "CASE WHEN seats > fair_share THEN 'sobre' WHEN seats < fair_share THEN 'sub' ELSE 'exacto' END"
TOP = "top AS (SELECT *, row_number() OVER (ORDER BY abs(gap) DESC, party, district) AS rn FROM gaps)"


@query("q5_max_cell_deviation", f"{GAPS}, {TOP} SELECT {R('abs(gap)', 6)} AS max_dev, party, district, CAST(seats AS DOUBLE) AS seats, {R('fair_share', 6)} AS fair_share, {DIRECTION} AS direction FROM top WHERE rn = 1")
def _(spark, sf):
    return rounded(fairshare.max_cell_deviation(_alloc(spark, sf), _fair(spark, sf)))


@query("q6_fair_share_summary", f"""{GAPS}, {TOP} SELECT {R('sum(abs(gap))', 6)} AS l1, {R('sum(abs(gap)) / sum(fair_share)', 6)} AS l1_norm, {R('sqrt(sum(gap * gap))', 6)} AS l2,
 {R('sqrt(avg(gap * gap))', 6)} AS rmse, {R('max(abs(gap))', 6)} AS max_dev, max(party) FILTER (rn = 1) AS max_dev_party, max(district) FILTER (rn = 1) AS max_dev_district,
 max({DIRECTION}) FILTER (rn = 1) AS max_dev_direction, count(*) AS n_cells, count(*) FILTER (gap > 0.01e0) AS n_over, count(*) FILTER (gap < -0.01e0) AS n_under,
 count(*) FILTER (abs(gap) <= 0.01e0) AS n_exact, {R('count(*) FILTER (gap > 0.01e0) / CAST(count(*) AS DOUBLE)', 4)} AS share_over FROM top""")
def _(spark, sf):
    return fairshare.fair_share_summary(_alloc(spark, sf), _fair(spark, sf))


# ---- scenario comparison ----

METRICS = ["max_dev_pct", "pp_mean", "cut_edges", "split_severity"]
MARKS = [("median", 0.5), ("p25", 0.25), ("p75", 0.75)]
cte("scenario_marks", "SELECT scenario, " + ", ".join(
    f"{R(f'quantile_cont({m}, {p}e0)', 4)} AS {m}_{q}" for m in METRICS for q, p in MARKS) + " FROM event_stats GROUP BY 1")
NULLS = ", ".join(f"CAST(NULL AS DOUBLE) AS {m}_{q}" for m in ("split_units", "affected_share") for q, _ in MARKS)
DELTAS = ", ".join(f"{R(f'{m}_median - (SELECT {m}_median FROM scenario_marks WHERE scenario = {chr(39)}click{chr(39)})', 4)} AS delta_{m}_median" for m in METRICS)


def _compared(spark, sf):
    return ensemble.compare_ensembles(event_stats(spark, sf), "click")


@query("i1_compare_ensembles", f"SELECT *, {NULLS}, {DELTAS}, CAST(NULL AS DOUBLE) AS delta_split_units_median, CAST(NULL AS DOUBLE) AS delta_affected_share_median FROM scenario_marks")
def _(spark, sf):
    return _compared(spark, sf)


@query("i2_scenario_delta", f"SELECT scenario, {', '.join(f'{m}_median' for m in METRICS)}, {DELTAS} FROM scenario_marks")
def _(spark, sf):
    table = _compared(spark, sf).select("scenario", *[f"{m}_median" for m in METRICS])
    return ensemble.scenario_delta(table, "click")


WEIGHTS = {"max_dev_pct": 0.5, "pp_mean": 0.3, "cut_edges": 0.2}


def rank_sql(norm: str) -> str:
    up = lambda m: "p" if m == "pp_mean" else "1 - p"
    part = ", ".join(f"{R(f'{w}e0 * COALESCE(max(CASE WHEN metric = {chr(39)}{m}{chr(39)} THEN {up(m)} END), 0)', 4)} AS score_{m}" for m, w in WEIGHTS.items())
    weight = "CASE metric " + " ".join(f"WHEN '{m}' THEN {w}e0" for m, w in WEIGHTS.items()) + " END"
    return f"""WITH l AS (SELECT scenario, unnest({list(WEIGHTS)}) AS metric, unnest([{', '.join(f'{m}_median' for m in WEIGHTS)}]) AS v FROM scenario_marks),
n AS (SELECT scenario, metric, {norm} AS p FROM l WINDOW w AS (PARTITION BY metric)),
s AS (SELECT scenario, {part}, {R(f"sum({weight} * COALESCE(CASE WHEN metric = 'pp_mean' THEN p ELSE 1 - p END, 0))", 4)} AS composite_score FROM n GROUP BY 1)
SELECT scenario, {', '.join(f'score_{m}' for m in WEIGHTS)}, composite_score,
 CAST(floor(rank() OVER (ORDER BY composite_score DESC) + (count(*) OVER (PARTITION BY composite_score) - 1) / 2e0) AS INT) AS rank FROM s"""


def _ranked(spark, sf, kind):
    out = ensemble.rank_scenarios(_compared(spark, sf), WEIGHTS, kind)
    return out.select("scenario", *[f"score_{m}" for m in WEIGHTS], "composite_score", "rank")


@query("i3_rank_scenarios", rank_sql("CASE WHEN abs(max(v) OVER w - min(v) OVER w) < 1e-12 THEN 0.5 ELSE (v - min(v) OVER w) / (max(v) OVER w - min(v) OVER w) END"))
def _(spark, sf):
    return _ranked(spark, sf, "minmax")


@query("i3_rank_scenarios_zscore", rank_sql("""CASE WHEN stddev_samp(v) OVER w < 1e-12 THEN 0.5 ELSE ((v - min(v) OVER w) / stddev_samp(v) OVER w)
 / ((max(v) OVER w - min(v) OVER w) / stddev_samp(v) OVER w + 1e-12) END"""))
def _(spark, sf):
    return _ranked(spark, sf, "zscore")


@query("i3_rank_scenarios_rank", rank_sql("(rank() OVER (PARTITION BY metric ORDER BY v) + (count(*) OVER (PARTITION BY metric, v) - 1) / 2e0) / count(v) OVER w"))
def _(spark, sf):
    return _ranked(spark, sf, "rank")


def dominated(dims: dict[str, str]) -> str:
    no_worse = " AND ".join(f"o.{d} {op}= p.{d}" for d, op in dims.items())
    better = " OR ".join(f"o.{d} {op} p.{d}" for d, op in dims.items())
    return f"EXISTS (SELECT 1 FROM event_stats o WHERE {no_worse} AND ({better}))"


@query("i4_pareto_2d", f"SELECT plan_id, max_dev_pct, pp_mean, NOT {dominated({'max_dev_pct': '<', 'pp_mean': '>'})} AS is_pareto FROM event_stats p")
def _(spark, sf):
    points = event_stats(spark, sf).select("plan_id", "max_dev_pct", "pp_mean")
    return pareto.pareto(points, {"max_dev_pct": True, "pp_mean": False})


@query("i4_pareto_nd", f"SELECT plan_id, max_dev_pct, cut_edges, split_severity, NOT {dominated({'max_dev_pct': '<', 'cut_edges': '<', 'split_severity': '<'})} AS is_pareto FROM event_stats p")
def _(spark, sf):
    points = event_stats(spark, sf).select("plan_id", "max_dev_pct", "cut_edges", "split_severity")
    return pareto.pareto(points, {"max_dev_pct": True, "cut_edges": True, "split_severity": True})


@query("i5_pareto_scenarios", """SELECT scenario, max_dev_pct_median, pp_mean_median, cut_edges_median, NOT EXISTS (SELECT 1 FROM scenario_marks o
 WHERE o.max_dev_pct_median <= p.max_dev_pct_median AND o.pp_mean_median >= p.pp_mean_median AND o.cut_edges_median <= p.cut_edges_median
 AND (o.max_dev_pct_median < p.max_dev_pct_median OR o.pp_mean_median > p.pp_mean_median OR o.cut_edges_median < p.cut_edges_median)) AS is_pareto FROM scenario_marks p""")
def _(spark, sf):
    table = _compared(spark, sf).select("scenario", "max_dev_pct_median", "pp_mean_median", "cut_edges_median")
    return pareto.pareto(table, {"max_dev_pct_median": True, "pp_mean_median": False, "cut_edges_median": True})


@query("i6_split_frequency", """SELECT user_id AS unit, count(*) AS n_scenarios, string_agg(DISTINCT event_type, '; ' ORDER BY event_type) AS scenarios,
 max(event_id) AS population, max(value) AS split_severity_max, min(props) AS name FROM events GROUP BY 1""")
def _(spark, sf):
    e = b.table(spark, sf, "events")
    return ensemble.split_frequency(e.select(
        F.col("user_id").alias("unit"), F.col("props").alias("name"), F.col("event_type").alias("scenario"),
        F.col("event_id").alias("population"), F.col("value").alias("split_severity")))


KS_METRICS = ["max_dev_pct", "cut_edges", "pp_mean"]
KS = f"""WITH l AS (SELECT scenario, unnest({KS_METRICS}) AS metric, unnest([max_dev_pct, CAST(cut_edges AS DOUBLE), pp_mean]) AS v FROM event_stats),
c AS (SELECT metric, scenario, v, count(*) AS n FROM l WHERE v IS NOT NULL GROUP BY ALL),
z AS (SELECT metric, scenario, sum(n) AS size FROM c GROUP BY ALL),
md AS (SELECT metric, scenario, quantile_cont(v, 0.5e0) AS med FROM l WHERE v IS NOT NULL GROUP BY ALL),
p AS (SELECT x.metric, x.scenario AS a, y.scenario AS b, x.size AS na, y.size AS nb FROM z x JOIN z y ON x.metric = y.metric AND x.scenario < y.scenario),
m AS (SELECT p.metric, a, b, na, nb, v, sum(CASE WHEN scenario = a THEN n ELSE 0 END) AS ca, sum(CASE WHEN scenario = b THEN n ELSE 0 END) AS cb
 FROM p JOIN c ON c.metric = p.metric AND (c.scenario = a OR c.scenario = b) GROUP BY ALL),
r AS (SELECT metric, a, b, na, nb, abs(sum(ca) OVER w / CAST(na AS DOUBLE) - sum(cb) OVER w / CAST(nb AS DOUBLE)) AS gap FROM m WINDOW w AS (PARTITION BY metric, a, b ORDER BY v)),
d AS (SELECT metric, a, b, max(gap) AS d FROM r GROUP BY ALL)
SELECT d.metric, a, b, {R('d', 4)} AS ks_stat, {R('x.med', 4)} AS median_a, {R('y.med', 4)} AS median_b, {R('y.med - x.med', 4)} AS median_difference,
 CASE WHEN d < 0.05 THEN 'negligible' WHEN d < 0.1 THEN 'pequeño' WHEN d < 0.2 THEN 'moderado' ELSE 'grande' END AS effect
FROM d JOIN md x ON x.metric = d.metric AND x.scenario = a JOIN md y ON y.metric = d.metric AND y.scenario = b"""


@query("i7_compare_sensitivity", KS)
def _(spark, sf):
    return ensemble.compare_sensitivity(event_stats(spark, sf), KS_METRICS).drop("ks_pvalue", "significant")


@query("i7_compare_sensitivity_p")
def _(spark, sf):
    return ensemble.compare_sensitivity(event_stats(spark, sf), KS_METRICS)


def _ties(source: str, head: str, part: str, comma: str) -> str:
    """Sums over tied values; every row of t equal ones adds its share of the group's term."""
    sums = ", ".join(
        f"sum((t{c} - 1) / 2e0) AS {c}1, sum((t{c} - 1) * (t{c} - 2) * 1e0) AS {c}3, sum((t{c} - 1) * (2 * t{c} + 5) * 1e0) AS {c}5" for c in "ab"
    )
    inner = f"SELECT {head}count(*) OVER (PARTITION BY {comma}a) AS ta, count(*) OVER (PARTITION BY {comma}b) AS tb FROM {source}"
    return f"{sums} FROM ({inner}) GROUP BY ALL"


# areas by power series in logarithms; Kendall exact without ties
_AREA = "list_sum(list_transform(range(0, 300), lambda k: exp(-z * z / 2 + (2 * k + 1) * ln(greatest(z, 1e-300)) - lgamma(2 * k + 2) + k * ln(2) + lgamma(k + 1))))"
_KENDALL = f"""CASE WHEN tau IS NULL THEN NULL WHEN a1 = 0 AND b1 = 0 AND n_common <= 33
 THEN least(1, 2 * (SELECT list_sum(mh.p[1:low + 1]) FROM mh WHERE mh.i = n_common)) WHEN z > 8 THEN 0 ELSE greatest(0, 1 - 2 / sqrt(2 * pi()) * {_AREA}) END"""
_STUDENT = """CASE WHEN df < 1 THEN NULL WHEN c2 <= 0 THEN 0 WHEN df % 2 = 0
 THEN greatest(0, 1 - abs(rho) * list_sum(list_transform(range(0, df // 2), lambda k: exp(lgamma(k + 0.5) - lgamma(k + 1) + k * ln(c2))) ) / sqrt(pi()))
 ELSE greatest(0, 1 - 2 / pi() * (atan2(abs(rho), sqrt(c2)) + COALESCE(abs(rho) * list_sum(list_transform(range(0, (df - 1) // 2), lambda k: exp(lgamma(k + 1) - lgamma(k + 1.5) + (k + 0.5) * ln(c2)))) * sqrt(pi()) / 2, 0))) END"""


def concordance_sql(source: str, keys: str) -> str:
    on = " AND ".join(["x.item < y.item"] + [f"x.{k.strip()} = y.{k.strip()}" for k in keys.split(",") if k])
    head = f"{keys}, " if keys else ""
    xkeys = "".join(f"x.{k.strip()}, " for k in keys.split(",") if k)
    part = f"PARTITION BY {keys}" if keys else ""
    comma = f"{keys}, " if keys else ""
    join = f"JOIN rh USING ({keys})" if keys else ", rh"
    return f"""pr AS (SELECT {xkeys}sign(x.a - y.a) AS sa, sign(x.b - y.b) AS sb FROM {source} x JOIN {source} y ON {on}),
kt AS (SELECT {head}sum(sa * sb) AS tau_n, sum(sa * sb) / sqrt(count(*) FILTER (sa <> 0) * CAST(count(*) FILTER (sb <> 0) AS DOUBLE)) AS tau, count(*) FILTER (sa * sb < 0) AS discordant FROM pr GROUP BY ALL),
rk AS (SELECT {head}rank() OVER ({part} ORDER BY a) + (count(*) OVER (PARTITION BY {comma}a) - 1) / 2e0 AS ra,
 rank() OVER ({part} ORDER BY b) + (count(*) OVER (PARTITION BY {comma}b) - 1) / 2e0 AS rb FROM {source}),
rh AS (SELECT {head}corr(ra, rb) AS rho, count(*) AS n_common FROM rk GROUP BY ALL),
ti AS (SELECT {head}{_ties(source, head, part, comma)}),
mh(i, p) AS (SELECT 1, [1e0] UNION ALL SELECT i + 1, list_transform(range(0, i * (i + 1) // 2 + 1), lambda d: list_sum(p[greatest(d - i + 1, 1):d + 1]) / (i + 1)) FROM mh WHERE i < 33),
pv AS (SELECT *, 1 - rho * rho AS c2, n_common - 2 AS df, abs(tau_n / sqrt(spread)) AS z, least(discordant, n_common * (n_common - 1) // 2 - discordant) AS low
 FROM (SELECT *, (w * (2 * n_common + 5) - a5 - b5) / 18 + 2 * a1 * b1 / w + COALESCE(a3 * b3 / NULLIF(9 * w * (n_common - 2), 0), 0) AS spread
  FROM (SELECT *, CAST(n_common AS DOUBLE) * (n_common - 1) AS w FROM kt {join} {"JOIN ti USING (" + keys + ")" if keys else ", ti"}))),
cc AS (SELECT {head}{R('tau', 4)} AS kendall_tau, {R(_KENDALL, 6)} AS kendall_pval, {R('rho', 4)} AS spearman_rho, {R(_STUDENT, 6)} AS spearman_pval, n_common, discordant, n_common < 5 AS low_power FROM pv)"""


cte("user_scores", """SELECT user_id AS item, CAST(round_even(avg(value), 0) AS BIGINT) AS a, count(*) AS b FROM events GROUP BY 1""")


def _user_scores(spark, sf):
    e = b.table(spark, sf, "events").groupBy(F.col("user_id").alias("item"))
    return e.agg(F.bround(F.avg("value"), 0).cast("long").alias("a"), F.count(F.lit(1)).alias("b"))


@query("i8_ranking_concordance", f"WITH RECURSIVE {concordance_sql('user_scores', '')} SELECT * FROM cc")
def _(spark, sf):
    return ensemble.ranking_concordance(_user_scores(spark, sf))


def sweep(spark, sf):
    """Events as plans of a penalty sweep with five penalties."""
    return event_stats(spark, sf).withColumn("penalty", F.pmod(F.col("cut_edges"), F.lit(5)) / 4)


cte("sweep", "SELECT *, (cut_edges % 5) / 4e0 AS penalty FROM event_stats")


SCENARIOS = {"click": 0.0, "error": 0.25, "purchase": 0.5, "signup": 0.75, "view": 1.0}


@query("i9_sweep", " UNION ALL ".join(f"SELECT max_dev_pct, pp_mean, {v}e0 AS penalty FROM event_stats WHERE scenario = '{k}'" for k, v in SCENARIOS.items()))
def _(spark, sf):
    stats = event_stats(spark, sf)
    return pareto.sweep({v: stats.where(F.col("scenario") == k) for k, v in SCENARIOS.items()}, ["max_dev_pct", "pp_mean", "split_units"])


SWEEP_DOM = dominated({"max_dev_pct": "<", "split_severity": "<"}).replace("event_stats", "sweep")
FRONT = f"tf AS (SELECT *, NOT {SWEEP_DOM} AS is_pareto FROM sweep p)"


def _front(spark, sf):
    return pareto.tradeoff_frontier(sweep(spark, sf), "max_dev_pct", "split_severity")


@query("i10_tradeoff_frontier", f"WITH {FRONT} SELECT plan_id, penalty, max_dev_pct, split_severity, is_pareto FROM tf")
def _(spark, sf):
    return _front(spark, sf).select("plan_id", "penalty", "max_dev_pct", "split_severity", "is_pareto")


@query("i10_frontier_metadata", f"WITH {FRONT} SELECT count(*) AS n_plans, count(*) FILTER (is_pareto) AS n_pareto FROM tf")
def _(spark, sf):
    return pareto.frontier_metadata(_front(spark, sf), "max_dev_pct", "split_severity")


QS = ", ".join(f"{R(f'quantile_cont(v, {p}e0)', 6)} AS p{n}" for n, p in ((5, 0.05), (25, 0.25), (75, 0.75), (95, 0.95)))


@query("i10_penalty_stats", f"""WITH l AS (SELECT penalty, unnest(['max_dev_pct', 'pp_mean']) AS metric, unnest([max_dev_pct, pp_mean]) AS v FROM sweep)
SELECT penalty, metric, count(v) AS count, {R('avg(v)', 6)} AS mean, {R('stddev_samp(v)', 6)} AS std, {QS} FROM l GROUP BY ALL""")
def _(spark, sf):
    return rounded(pareto.penalty_stats(sweep(spark, sf), ["max_dev_pct", "pp_mean"]))


@query("i11_bootstrap_bands")
def _(spark, sf):
    return rounded(pareto.bootstrap_bands(sweep(spark, sf), "max_dev_pct", "split_severity", replicates=200))


KNEE = f"""{FRONT}, f AS (SELECT *, row_number() OVER (ORDER BY max_dev_pct, split_severity, penalty) - 1 AS position FROM tf WHERE is_pareto),
e AS (SELECT min(max_dev_pct) AS xa, max(max_dev_pct) AS xb, min(split_severity) AS ya, max(split_severity) AS yb,
 arg_min(split_severity, position) AS yf, arg_max(split_severity, position) AS yl FROM f),
g AS (SELECT f.*, (max_dev_pct - xa) / (xb - xa) AS sx, (split_severity - ya) / (yb - ya) AS sy, (yf - ya) / (yb - ya) AS y0, (yl - ya) / (yb - ya) AS y1,
 max_dev_pct - lag(max_dev_pct) OVER o AS dx, split_severity - lag(split_severity) OVER o AS dy FROM f, e WINDOW o AS (ORDER BY position)),
h AS (SELECT *, abs((y1 - y0) * sx - sy + y0) / sqrt(1 + (y1 - y0) * (y1 - y0)) AS distance, CASE WHEN dx > 1e-12 THEN -dy / dx END AS rate FROM g),
kd AS (SELECT *, COALESCE(rate < 0.5e0 * (SELECT avg(rate) FROM h WHERE rate > 0), false) AS diminishing FROM h)"""


@query("i12_frontier_distances", f"WITH {KNEE} SELECT penalty, max_dev_pct, split_severity, position, {R('distance', 6)} AS distance, diminishing FROM kd")
def _(spark, sf):
    front = _front(spark, sf).where("is_pareto").select("penalty", "max_dev_pct", "split_severity")
    return rounded(pareto.frontier_distances(front, "max_dev_pct", "split_severity"))


KNEE_ROW = """kn AS (SELECT position AS knee_index, max_dev_pct AS knee_x, split_severity AS knee_y, penalty AS knee_penalty,
 (SELECT min(max_dev_pct) FROM kd WHERE diminishing) AS diminishing_start_x FROM kd ORDER BY distance DESC, position LIMIT 1)"""


def _knee(spark, sf):
    front = _front(spark, sf).where("is_pareto").select("penalty", "max_dev_pct", "split_severity")
    return pareto.knee_point(front, "max_dev_pct", "split_severity")


@query("i12_knee_point", f"WITH {KNEE}, {KNEE_ROW} SELECT * FROM kn")
def _(spark, sf):
    return _knee(spark, sf)


@query("i13_summarize_tradeoff", f"""WITH {KNEE}, {KNEE_ROW}, s AS (SELECT penalty, count(*) AS n_plans, count(*) FILTER (is_pareto) AS n_pareto,
 {R('1e2 * count(*) FILTER (is_pareto) / count(*)', 1)} AS pct_pareto, {R('avg(pp_mean)', 6)} AS pp_mean_mean, {R('stddev_samp(pp_mean)', 6)} AS pp_mean_std,
 {R('quantile_cont(pp_mean, 0.05e0)', 6)} AS pp_mean_p5, {R('quantile_cont(pp_mean, 0.95e0)', 6)} AS pp_mean_p95 FROM tf GROUP BY 1)
SELECT s.*, penalty = (SELECT knee_penalty FROM kn) AS is_knee FROM s""")
def _(spark, sf):
    return pareto.summarize_tradeoff(_front(spark, sf), ["pp_mean"], _knee(spark, sf))


@query("i14_sweep_medians", f"""WITH x AS (SELECT *, CASE WHEN plan_id % 7 = 0 THEN NULL ELSE plan_id % 50 END AS split_units, max_dev_pct - pp_mean AS score FROM sweep),
r AS (SELECT scenario, penalty, arg_max((max_dev_pct, pp_mean), (CASE WHEN split_units IS NULL THEN 0 ELSE 1 END, score, -plan_id)) FILTER (score IS NOT NULL) AS best FROM x GROUP BY ALL)
SELECT scenario, penalty, count(*) AS n_plans, CASE WHEN scenario = 'click' THEN 'reference_plan' ELSE 'ensemble_median' END AS point_type,
 CASE WHEN scenario = 'click' THEN {R('any_value(best)[1]', 4)} ELSE {R('quantile_cont(max_dev_pct, 0.5e0)', 4)} END AS max_dev_pct_median,
 CASE WHEN scenario = 'click' THEN {R('any_value(best)[2]', 4)} ELSE {R('quantile_cont(pp_mean, 0.5e0)', 4)} END AS pp_mean_median
FROM x JOIN r USING (scenario, penalty) GROUP BY scenario, penalty""")
def _(spark, sf):
    stats = sweep(spark, sf).withColumns({
        "split_units": F.when(F.col("plan_id") % 7 != 0, F.col("plan_id") % 50), "score": F.col("max_dev_pct") - F.col("pp_mean")})
    return ensemble.sweep_medians(stats, F.col("scenario") == "click", ["max_dev_pct", "pp_mean"])


WS = {"one": {"max_dev_pct": 0.7, "cut_edges": 0.3}, "two": {"pp_mean": 1.0, "cut_edges": 0.5}, "three": {"max_dev_pct": 0.2, "split_severity": 0.8}}
CHAIN_SCORE = "sc0 AS (SELECT cut_edges % 12 AS chain, " + ", ".join(f"quantile_cont({m}, 0.5e0) AS {m}" for m in METRICS) + " FROM event_stats GROUP BY 1), ws AS (" + " UNION ALL ".join(
    f"SELECT '{n}' AS config, chain, " + " + ".join(f"{w / sum(s.values())}e0 * {m}" for m, w in s.items()) + " AS score FROM sc0" for n, s in WS.items()
) + "), pw AS (SELECT x.config AS config_a, y.config AS config_b, x.chain AS item, x.score AS a, y.score AS b FROM ws x JOIN ws y ON x.chain = y.chain AND x.config < y.config)"


@query("i15_weight_sensitivity", f"WITH RECURSIVE {CHAIN_SCORE}, {concordance_sql('pw', 'config_a, config_b')} SELECT * FROM cc")
def _(spark, sf):
    stats = event_stats(spark, sf).withColumn("chain", F.pmod("cut_edges", F.lit(12)))
    return ensemble.weight_sensitivity(stats, WS)


def _overview(spark, sf):
    e = b.table(spark, sf, "events")
    expected = e.select(F.col("event_type").alias("scenario")).distinct()
    have = event_stats(spark, sf).where("scenario <> 'error'")
    statuses = e.where("event_type = 'error'").groupBy(F.col("event_type").alias("scenario")).agg(
        F.lit("infeasible").alias("status"), F.max("props").alias("reason"))
    return ensemble.scenario_overview(expected, have, statuses)


OVERVIEW = """ov AS (SELECT event_type AS scenario, CASE WHEN event_type = 'error' THEN 'infeasible' ELSE 'ok' END AS status,
 CASE WHEN event_type = 'error' THEN max(props) END AS reason, event_type <> 'error' AS included_in_scoring,
 CASE WHEN event_type = 'error' THEN 0 ELSE count(*) END AS n_plans FROM events GROUP BY 1)"""


@query("i16_scenario_overview", f"WITH {OVERVIEW} SELECT * FROM ov")
def _(spark, sf):
    return _overview(spark, sf)


@query("i16_comparison_completeness", f"""WITH {OVERVIEW} SELECT 'INCOMPLETE' AS comparison_status, count(*) AS expected_scenarios,
 count(*) FILTER (included_in_scoring) AS valid_ensembles, 'error' AS missing_baseline, 'partial' AS ranking_scope FROM ov""")
def _(spark, sf):
    return ensemble.comparison_completeness(_overview(spark, sf), "error")


@query("i17_tolerance_consistency", """WITH l AS (SELECT event_type AS scenario, arg_max(user_id % 3 / 10e0, event_id) AS tolerance FROM events GROUP BY 1)
SELECT count(*) AS scenarios, count(DISTINCT tolerance) AS tolerances, count(DISTINCT tolerance) <= 1 AS consistent,
 string_agg(scenario || '=' || printf('%.4f', tolerance), ', ' ORDER BY scenario) AS detail FROM l""")
def _(spark, sf):
    e = b.table(spark, sf, "events")
    return ensemble.tolerance_consistency(e.select(
        F.col("event_type").alias("scenario"), F.col("event_id").alias("run_id"), (F.col("user_id") % 3 / 10).alias("tolerance")))


@query("i18_rename_smc_metrics", "SELECT event_id AS draw, value AS pp_mean, CASE WHEN (SELECT max(user_id / 1000e0) FROM events) < 1 THEN user_id / 1000e0 * 100 ELSE user_id / 1000e0 END AS max_dev_pct FROM events")
def _(spark, sf):
    e = b.table(spark, sf, "events")
    return ensemble.rename_smc_metrics(e.select(
        F.col("event_id").alias("draw"), F.col("value").alias("polsby_popper"), (F.col("user_id") / 1000).alias("pop_deviation")))


# ---- chains ----

def event_chains(spark, sf):
    """Four chains of two metrics, ordered by time."""
    e = b.table(spark, sf, "events").select((F.col("user_id") % 4).alias("chain"), F.struct("ts", "event_id").alias("step"), "event_id", "value")
    return e.select("chain", "step", F.inline(F.array(
        F.struct(F.lit("value").alias("metric"), F.col("value").alias("value")),
        F.struct(F.lit("trend").alias("metric"), (F.col("event_id") % 700).cast("double").alias("value")))))


cte("event_chains", """SELECT metric, chain, row_number() OVER (PARTITION BY metric, chain ORDER BY ts, event_id) - 1 AS position, value FROM
 (SELECT 'value' AS metric, user_id % 4 AS chain, ts, event_id, value FROM events UNION ALL SELECT 'trend', user_id % 4, ts, event_id, CAST(event_id % 700 AS DOUBLE) FROM events)""")
ACF = """ch AS (SELECT *, value - avg(value) OVER w AS x, count(*) OVER w AS n FROM event_chains WINDOW w AS (PARTITION BY metric, chain)),
vr AS (SELECT metric, chain, sum(x * x) AS v FROM ch GROUP BY ALL),
ac AS (SELECT a.metric, a.chain, a.n, CAST(l AS INT) AS lag, sum(a.x * c.x) / any_value(v) AS acf FROM ch a, range(0, {lags}) t(l), ch c, vr
 WHERE c.metric = a.metric AND c.chain = a.chain AND c.position = a.position + l AND vr.metric = a.metric AND vr.chain = a.chain GROUP BY ALL)"""


@query("k1_acf", f"WITH {ACF.format(lags=51)} SELECT metric, chain, n, lag, {R('acf', 6)} AS acf FROM ac")
def _(spark, sf):
    return rounded(chains.acf(event_chains(spark, sf), 50))


ESS = """fl AS (SELECT metric, chain, min(lag) FILTER (lag >= 1 AND acf < 0.05) AS fl FROM ac GROUP BY ALL),
es AS (SELECT metric, chain, any_value(n) AS n, any_value(n) / GREATEST(1 + 2 * sum(acf) FILTER (lag >= 1 AND lag <= CASE WHEN fl IS NULL THEN 200 WHEN fl > 2 THEN fl - 1 ELSE 1 END), 1) AS ess
 FROM ac JOIN fl USING (metric, chain) WHERE lag <= n // 2 GROUP BY metric, chain)"""


@query("k2_effective_sample_size", f"WITH {ACF.format(lags=201)}, {ESS} SELECT metric, chain, n, {R('ess', 4)} AS ess FROM es")
def _(spark, sf):
    return rounded(chains.effective_sample_size(event_chains(spark, sf)), 4)


RHAT = """ln AS (SELECT metric, min(n) AS n FROM (SELECT metric, chain, count(*) AS n FROM event_chains GROUP BY ALL) GROUP BY 1),
mo AS (SELECT metric, chain, n, avg(value) AS m, var_samp(value) AS v FROM event_chains JOIN ln USING (metric) WHERE position < n GROUP BY ALL),
gr AS (SELECT metric, count(*) AS n_chains, any_value(n) AS n_samples,
 sqrt(((any_value(n) - 1) / CAST(any_value(n) AS DOUBLE) * avg(v) + (count(*) + 1) / CAST(count(*) * any_value(n) AS DOUBLE) * any_value(n) * var_samp(m)) / avg(v)) AS rhat FROM mo GROUP BY 1)"""


@query("k3_gelman_rubin", f"WITH {RHAT} SELECT metric, n_chains, n_samples, {R('rhat', 6)} AS rhat FROM gr")
def _(spark, sf):
    return rounded(chains.gelman_rubin(event_chains(spark, sf)))


@query("k4_mixing_diagnostics", f"""WITH {ACF.format(lags=201)}, {ESS}, {RHAT}
SELECT metric, n_chains, n_samples, {R('rhat', 4)} AS rhat, rhat < 1.1 AS converged, {R('e', 1)} AS ess_mean, {R('a', 4)} AS acf_lag1_mean FROM gr
JOIN (SELECT metric, avg(ess) AS e FROM es GROUP BY 1) USING (metric) JOIN (SELECT metric, avg(acf) AS a FROM ac WHERE lag = 1 GROUP BY 1) USING (metric)""")
def _(spark, sf):
    return chains.mixing_diagnostics(event_chains(spark, sf))


@query("k5_gelman_rubin_evolution", f"""WITH ln AS (SELECT metric, min(n) AS n FROM (SELECT metric, chain, count(*) AS n FROM event_chains GROUP BY ALL) GROUP BY 1),
r AS (SELECT metric, chain, position + 1 AS t, avg(value) OVER w AS m, var_samp(value) OVER w AS v, position FROM event_chains
 WINDOW w AS (PARTITION BY metric, chain ORDER BY position))
SELECT metric, t, {R('sqrt(((t - 1) / CAST(t AS DOUBLE) * avg(v) + 5e0 / (4e0 * t) * t * var_samp(m)) / avg(v))', 6)} AS rhat
FROM r JOIN ln USING (metric) WHERE position < n AND t >= 10 GROUP BY metric, t""")
def _(spark, sf):
    return rounded(chains.gelman_rubin_evolution(event_chains(spark, sf)))


@query("k6_chain_metrics", f"""WITH i AS (SELECT *, avg(population) OVER (PARTITION BY plan_id) AS ideal FROM plan_population),
d AS (SELECT plan_id, max(abs(population - ideal)) / max(ideal) * 100 AS dev FROM i GROUP BY 1), c AS (SELECT plan_id, count(*) FILTER (d1 <> d2) AS cut_edges FROM cuts GROUP BY 1)
SELECT plan_id AS step, cut_edges, {R('dev', 3)} AS max_dev_pct, dev <= 10 AS is_valid FROM d JOIN c USING (plan_id)""")
def _(spark, sf):
    return chains.chain_metrics(b.plans(spark, sf), b.population(spark, sf), b.edges(spark, sf), 0.1)
