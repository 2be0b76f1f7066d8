"""Comparison of plan ensembles between scenarios."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from hemicycle.functions.frames import attach, group_window, ratio, rnd
from hemicycle.functions.ordered import exact_quantiles, row_index, running
from hemicycle.functions.probability import inversions_two_sided, kolmogorov_tail, normal_tail, smirnov_two_sided, student_two_sided
from hemicycle.functions.stats import average_rank, clean, to_long
from hemicycle.session import cut_lineage

# fixed values: standard metrics, their direction and default weights
DIRECTIONS = {
    "max_dev_pct": "min", "pp_mean": "max", "cut_edges": "min",
    "split_units": "min", "split_severity": "min", "affected_share": "min",
}
WEIGHT_SETS = {
    "default": {"max_dev_pct": 0.35, "pp_mean": 0.20, "cut_edges": 0.15,
                "split_units": 0.15, "split_severity": 0.05, "affected_share": 0.10},
    "solo_balance": {"max_dev_pct": 0.80, "pp_mean": 0.10, "cut_edges": 0.05, "split_units": 0.05},
    "solo_compact": {"pp_mean": 0.70, "max_dev_pct": 0.20, "cut_edges": 0.10},
    "equi": {"max_dev_pct": 0.20, "pp_mean": 0.20, "cut_edges": 0.20,
             "split_units": 0.20, "split_severity": 0.10, "affected_share": 0.10},
}
EFFECTS = [(0.05, "negligible"), (0.10, "pequeño"), (0.20, "moderado")]
LARGEST_EFFECT = "grande"
#: values a side, and items, up to which a p-value is exact
EXACT_SAMPLE, EXACT_ITEMS = 10_000, 33


def _present(df: DataFrame, names: Sequence[str]) -> list[str]:
    return [n for n in names if n in df.columns]


def compare_ensembles(stats: DataFrame, baseline: str, metrics: Sequence[str] = tuple(DIRECTIONS)) -> DataFrame:
    """Median and quartiles of every metric per scenario, with deltas."""
    have = _present(stats, metrics)
    long = to_long(stats, ["scenario"], have)
    marks = exact_quantiles(long, ["scenario", "metric"], "value", {"p25": 0.25, "median": 0.5, "p75": 0.75})
    wide = marks.groupBy("scenario").agg(*[
        F.max(F.when(F.col("metric") == m, rnd(q, 4))).alias(f"{m}_{q}") for m in have for q in ("median", "p25", "p75")
    ])
    every = stats.select("scenario").distinct().join(wide, "scenario", "left")
    missing = {f"{m}_{q}": F.lit(None).cast("double") for m in metrics if m not in have for q in ("median", "p25", "p75")}
    return scenario_delta(every.withColumns(missing) if missing else every, baseline)


def scenario_delta(table: DataFrame, baseline: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Difference of each column to the baseline row, 4 digits."""
    columns = list(columns or [c for c in table.columns if c.endswith("_median")])
    base = table.where(F.col("scenario") == baseline).agg(*[F.first(c).alias(f"_base_{c}") for c in columns])
    out = attach(table, base)
    return out.select(*table.columns, *[rnd(F.col(c) - F.col(f"_base_{c}"), 4).alias(f"delta_{c}") for c in columns])


def rank_scenarios(
    table: DataFrame,
    weights: dict[str, float] | None = None,
    normalisation: str = "minmax",
    directions: dict[str, str] | None = None,
) -> DataFrame:
    """Weighted score of the normalised medians and an average rank.

    Scenarios are few, so the windows per metric are small.
    """
    weights = weights or WEIGHT_SETS["default"]
    directions = directions or DIRECTIONS
    used = [m for m, w in weights.items() if w and f"{m}_median" in table.columns]
    long = to_long(table.select("scenario", *[F.col(f"{m}_median").alias(m) for m in used]), ["scenario"], used)
    w, v = group_window(["metric"]), F.col("value")
    low, high = F.min(v).over(w), F.max(v).over(w)
    if normalisation == "minmax":
        norm = F.when(F.abs(high - low) < 1e-12, 0.5).otherwise((v - low) / (high - low))
    elif normalisation == "zscore":
        sd, mean = F.stddev_samp(v).over(w), F.avg(v).over(w)
        z = lambda x: (x - mean) / sd
        norm = F.when(sd < 1e-12, 0.5).otherwise((z(v) - z(low)) / (z(high) - z(low) + 1e-12))
    elif normalisation == "rank":
        norm = F.when(v.isNotNull(), average_rank(v, ["metric"]) / F.count(v).over(w))
    else:
        raise ValueError(f"unknown normalisation {normalisation!r}")
    upward = F.col("metric").isin([m for m in used if directions.get(m, "min") == "max"])
    weight = F.element_at(F.create_map(*[F.lit(x) for m in used for x in (m, float(weights[m]))]), F.col("metric"))
    part = weight * F.coalesce(F.when(upward, norm).otherwise(1 - norm), F.lit(0.0))
    empty = F.count(v).over(w) == 0
    scored = long.withColumn("_part", F.when(~empty, part))
    wide = scored.groupBy("scenario").agg(
        *[rnd(F.max(F.when(F.col("metric") == m, F.col("_part"))), 4).alias(f"score_{m}") for m in used],
        rnd(F.coalesce(F.sum("_part"), F.lit(0.0)), 4).alias("composite_score"),
    )
    place = average_rank(F.col("composite_score"), [], descending=True)
    return table.join(wide, "scenario").withColumn("rank", F.floor(place).cast("int"))


def split_frequency(splits: DataFrame) -> DataFrame:
    """How often and where each commune is split over all scenarios.

    ``splits`` is (unit, name, scenario, population, split_severity).
    """
    return splits.groupBy("unit").agg(
        F.count(F.lit(1)).alias("n_scenarios"),
        F.array_join(F.sort_array(F.collect_set("scenario")), "; ").alias("scenarios"),
        F.max("population").alias("population"), F.max("split_severity").alias("split_severity_max"), F.min("name").alias("name"),
    )


def compare_sensitivity(stats: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov test of all scenario pairs per metric.

    Equal values are counted first; the statistic is the largest gap of two
    running counts, so no scenario has to fit into one task. The p-value is
    exact up to ``EXACT_SAMPLE`` values a side, else the asymptotic series.
    """
    long = to_long(stats, ["scenario"], _present(stats, metrics)).where("value IS NOT NULL")
    counts = long.groupBy("metric", "scenario", "value").agg(F.count(F.lit(1)).alias("_n"))
    sizes = counts.groupBy("metric", "scenario").agg(F.sum("_n").alias("n")).where("n >= 2")
    medians = exact_quantiles(long, ["metric", "scenario"], "value", {"median": 0.5})
    known = sizes.join(medians, ["metric", "scenario"])
    side = lambda s: known.select("metric", F.col("scenario").alias(s), F.col("n").alias(f"n_{s}"), F.col("median").alias(f"median_{s}"))
    pairs = side("a").join(side("b"), "metric").where("a < b")
    keys = ["metric", "a", "b"]
    rows = None
    for own, one, other in (("a", F.col("_n"), F.lit(0)), ("b", F.lit(0), F.col("_n"))):
        met = pairs.select(*keys, F.col(own).alias("scenario")).join(counts, ["metric", "scenario"])
        part = met.select(*keys, "value", one.cast("long").alias("_na"), other.cast("long").alias("_nb"))
        rows = part if rows is None else rows.unionByName(part)
    merged = rows.groupBy(*keys, "value").agg(F.sum("_na").alias("_na"), F.sum("_nb").alias("_nb"))
    scanned = running(merged, keys, ["value"], {"_ca": ("sum", "_na"), "_cb": ("sum", "_nb")})
    gap = F.abs(F.col("_ca") / F.col("n_a") - F.col("_cb") / F.col("n_b"))
    out = attach(scanned, pairs, keys).groupBy(*keys, "n_a", "n_b", "median_a", "median_b").agg(F.max(gap).alias("_d"))
    weight = F.sqrt(F.col("n_a") * F.col("n_b") / (F.col("n_a") + F.col("n_b")))
    series = kolmogorov_tail(weight * F.col("_d"))
    out = cut_lineage(out)
    small = out.where(F.greatest("n_a", "n_b") <= EXACT_SAMPLE).select(*keys, "_d", F.col("n_a").cast("long"), F.col("n_b").cast("long"))
    kinds = ", ".join(f"{k} {t}" for k, t in small.dtypes if k in keys)
    exact = small.repartition(*keys).mapInArrow(_smirnov, f"{kinds}, _p double")
    out = attach(out, exact, keys)
    p = F.coalesce("_p", series)
    effect = F.lit(LARGEST_EFFECT)
    for bound, label in reversed(EFFECTS):
        effect = F.when(F.col("_d") < bound, label).otherwise(effect)
    return out.select(
        *keys, rnd("_d", 4).alias("ks_stat"), rnd(p, 6).alias("ks_pvalue"),
        rnd("median_a", 4).alias("median_a"), rnd("median_b", 4).alias("median_b"),
        rnd(F.col("median_b") - F.col("median_a"), 4).alias("median_difference"),
        (p < 0.05).alias("significant"), effect.alias("effect"),
    )


def _smirnov(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        names = [c for c in batch.schema.names if c not in ("_d", "n_a", "n_b")]
        p = [smirnov_two_sided(*v) for v in zip(*(batch.column(c).to_pylist() for c in ("_d", "n_a", "n_b")), strict=True)]
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(p, pa.float64())], names=[*names, "_p"])


def _mean_ranks(scores: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """Average rank, dense rank and number of ties of each distinct value."""
    counts = scores.groupBy(*keys, column).agg(F.count(F.lit(1)).alias(f"_t_{column}")).withColumn("_one", F.lit(1).cast("long"))
    ranked = running(counts, keys, [column], {"_upto": ("sum", f"_t_{column}"), "_dense": ("sum", "_one")})
    middle = F.col("_upto") - (F.col(f"_t_{column}") - 1) / 2
    return ranked.select(*keys, column, f"_t_{column}", middle.alias(f"_r_{column}"), (F.col("_dense") - 1).alias(f"_d_{column}"))


def ranking_concordance(scores: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Kendall tau-b and Spearman rho between columns ``a`` and ``b``.

    ``scores`` is (keys, item, a, b). Discordant pairs are counted without
    forming pairs: two ranks first differ at one binary digit, so per digit
    and common prefix it is enough to count, in order of ``a``, the ones
    before each zero. Kendall's p is exact without ties and up to
    ``EXACT_ITEMS`` items (or at most one inversion), else normal with ties;
    Spearman's is Student's tail.
    """
    keys = list(keys)
    ranked = scores
    for column in ("a", "b"):
        ranked = ranked.join(_mean_ranks(scores, keys, column), [*keys, column])
    sizes = scores.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    digits = attach(ranked, sizes, keys).withColumn(
        "_level", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.log2(F.col("n"))).cast("int"))))
    )
    digits = digits.select(
        *keys, "_level", F.expr("shiftright(_d_b, _level + 1)").alias("_prefix"),
        (F.expr("shiftright(_d_b, _level)") % 2).cast("long").alias("_bit"), "_d_a", "_d_b", "item",
    )
    scanned = running(digits, [*keys, "_level", "_prefix"], ["_d_a", "_d_b", "item"], {"_ones": ("sum", "_bit")})
    swaps = scanned.where("_bit = 0").groupBy(*keys).agg(F.sum("_ones").alias("discordant"))
    both = scores.groupBy(*keys, "a", "b").agg(F.count(F.lit(1)).alias("_t"))
    pair = lambda c: F.col(c) * (F.col(c) - 1) / 2
    ties = both.groupBy(*keys).agg(F.sum(pair("_t")).alias("_ab"))
    for column in ("a", "b"):
        t = scores.groupBy(*keys, column).agg(F.count(F.lit(1)).alias("_t")).groupBy(*keys).agg(F.sum(pair("_t")).alias(f"_{column}"))
        ties = attach(ties, t, keys)
    for column in ("a", "b"):
        t = F.col("_t")
        tied = scores.groupBy(*keys, column).agg(F.count(F.lit(1)).cast("double").alias("_t")).groupBy(*keys).agg(
            F.sum(t * (t - 1) * (t - 2)).alias(f"_{column}3"), F.sum(t * (t - 1) * (2 * t + 5)).alias(f"_{column}5")
        )
        ties = attach(ties, tied, keys)
    rho = ranked.groupBy(*keys).agg(F.corr("_r_a", "_r_b").alias("_rho"))
    out = attach(attach(attach(sizes, ties, keys), swaps, keys), rho, keys)
    n, all_pairs = F.col("n"), pair("n")
    wrong = F.coalesce("discordant", F.lit(0))
    right = all_pairs - F.col("_a") - F.col("_b") + F.col("_ab") - wrong
    tau = ratio(right - wrong, F.sqrt((all_pairs - F.col("_a")) * (all_pairs - F.col("_b"))))
    out = out.withColumn("_tau", F.when(n >= 2, tau)).withColumn("_rho", F.when(n >= 2, F.col("_rho")))
    whole = n.cast("double") * (n - 1)
    spread = (whole * (2 * n + 5) - F.col("_a5") - F.col("_b5")) / 18 + F.try_divide(2 * F.col("_a") * F.col("_b"), whole) + F.coalesce(
        F.try_divide(F.col("_a3") * F.col("_b3"), 9 * whole * (n - 2)), F.lit(0.0))
    p_normal = 2 * normal_tail(F.try_divide(right - wrong, F.sqrt(spread)))
    exact = (F.col("_a") == 0) & (F.col("_b") == 0) & ((n <= EXACT_ITEMS) | (F.least(wrong, all_pairs - wrong) <= 1))
    p_tau = F.when(F.col("_tau").isNotNull(), F.when(exact, inversions_two_sided(wrong, n)).otherwise(p_normal))
    p_rho = student_two_sided(F.col("_rho"), n - 2)
    return out.select(
        *keys, rnd("_tau", 4).alias("kendall_tau"), rnd(p_tau, 6).alias("kendall_pval"),
        rnd("_rho", 4).alias("spearman_rho"), rnd(p_rho, 6).alias("spearman_pval"),
        n.alias("n_common"), wrong.cast("long").alias("discordant"), (n < 5).alias("low_power"),
    )


def weight_sensitivity(stats: DataFrame, weight_sets: dict[str, dict[str, float]] = WEIGHT_SETS) -> DataFrame:
    """Concordance of chain rankings between every two weight sets.

    ``stats`` is one row per (chain, plan); a chain's score is the weighted
    mean of its metric medians, absent metrics counting 0.
    """
    metrics = _present(stats, sorted({m for s in weight_sets.values() for m in s}))
    medians = exact_quantiles(to_long(stats, ["chain"], metrics), ["chain", "metric"], "value", {"median": 0.5})
    table = F.array(*[
        F.struct(F.lit(name).alias("config"), F.lit(m).alias("m"), F.lit(w / sum(s.values())).alias("w"))
        for name, s in weight_sets.items() for m, w in s.items()
    ])
    weighted = medians.select("chain", "metric", "median", F.inline(table)).where("metric = m")
    scores = weighted.groupBy("config", "chain").agg(F.sum(F.col("w") * F.col("median")).alias("score"))
    one, two = (scores.select(F.col("chain").alias("item"), F.col("config").alias(f"config_{s}"), F.col("score").alias(s)) for s in "ab")
    pairs = one.join(two, "item").where("config_a < config_b")
    return ranking_concordance(pairs, ["config_a", "config_b"])


def sweep_medians(stats: DataFrame, soft: Column, metrics: Sequence[str]) -> DataFrame:
    """One point per configuration of a sweep.

    Soft configurations with scores give the best-scored plan (among plans
    with split counts when there are any), others the ensemble medians.
    """
    have = _present(stats, metrics)
    flagged = stats.withColumn("_soft", soft)
    scored = F.max(F.when(clean("score").isNotNull(), True))
    kinds = flagged.groupBy("scenario", "penalty").agg(
        F.count(F.lit(1)).alias("n_plans"), (F.coalesce(scored, F.lit(False)) & F.bool_or("_soft")).alias("_ref"),
        F.max_by(
            F.struct(*[clean(m).alias(m) for m in have]),
            F.when(clean("score").isNotNull(), F.struct(clean("split_units").isNotNull(), clean("score"), -F.col("plan_id"))),
        ).alias("_best"),
    )
    long = to_long(stats, ["scenario", "penalty"], have)
    medians = exact_quantiles(long, ["scenario", "penalty", "metric"], "value", {"median": 0.5})
    wide = medians.groupBy("scenario", "penalty").agg(
        *[F.max(F.when(F.col("metric") == m, F.col("median"))).alias(f"_m_{m}") for m in have]
    )
    out = attach(kinds, wide, ["scenario", "penalty"])
    return out.select(
        "scenario", "penalty", "n_plans",
        F.when(F.col("_ref"), "reference_plan").otherwise("ensemble_median").alias("point_type"),
        *[rnd(F.when(F.col("_ref"), F.col(f"_best.{m}")).otherwise(F.col(f"_m_{m}")), 4).alias(f"{m}_median") for m in have],
    )


def scenario_overview(expected: DataFrame, stats: DataFrame, statuses: DataFrame) -> DataFrame:
    """Every expected scenario with its plans, or why it has none.

    ``statuses`` is (scenario, status, reason).
    """
    counts = stats.groupBy("scenario").agg(F.count(F.lit(1)).alias("_n"))
    out = expected.select("scenario").join(counts, "scenario", "left").join(statuses, "scenario", "left")
    valid = F.col("_n").isNotNull()
    return out.select(
        "scenario", F.when(valid, "ok").otherwise(F.coalesce("status", F.lit("sin_datos"))).alias("status"),
        F.when(~valid, F.col("reason")).alias("reason"), valid.alias("included_in_scoring"), F.coalesce("_n", F.lit(0)).alias("n_plans"),
    )


def comparison_completeness(overview: DataFrame, baseline: str) -> DataFrame:
    complete = F.bool_and("included_in_scoring")
    missing = F.bool_or((F.col("scenario") == baseline) & ~F.col("included_in_scoring"))
    return overview.agg(
        F.when(complete, "COMPLETE").otherwise("INCOMPLETE").alias("comparison_status"),
        F.count(F.lit(1)).alias("expected_scenarios"), F.count_if("included_in_scoring").alias("valid_ensembles"),
        F.when(missing, F.lit(baseline)).alias("missing_baseline"),
        F.when(complete, "full").otherwise("partial").alias("ranking_scope"),
    )


def tolerance_consistency(manifests: DataFrame) -> DataFrame:
    """Whether the latest runs of the scenarios used one tolerance.

    ``manifests`` is (scenario, run_id, tolerance); run ids sort by time.
    """
    latest = manifests.groupBy("scenario").agg(F.max_by("tolerance", "run_id").alias("tolerance")).where("tolerance IS NOT NULL")
    distinct = F.count_distinct("tolerance")
    detail = F.array_join(F.sort_array(F.collect_list(F.concat_ws("=", "scenario", F.format_string("%.4f", "tolerance")))), ", ")
    return latest.agg(F.count(F.lit(1)).alias("scenarios"), distinct.alias("tolerances"), (distinct <= 1).alias("consistent"), detail.alias("detail"))


def rename_smc_metrics(metrics: DataFrame) -> DataFrame:
    """Sampler output under the standard names, deviation in percent."""
    names = {"polsby_popper": "pp_mean", "pop_deviation": "max_dev_pct"}
    out = metrics.withColumnsRenamed(names)
    if "max_dev_pct" not in out.columns:
        return out
    top = attach(out, out.agg(F.max("max_dev_pct").alias("_top")))
    scale = F.when(F.col("_top") < 1, 100.0).otherwise(1.0)
    return top.withColumn("max_dev_pct", F.col("max_dev_pct") * scale).drop("_top")
