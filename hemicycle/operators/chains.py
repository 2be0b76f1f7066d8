"""Diagnostics of sampler chains: (chain, step, metric, value) in long form."""

from __future__ import annotations

import sys
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

from hemicycle.functions.frames import attach, ratio, rnd
from hemicycle.functions.ordered import row_index, running
from hemicycle.operators.graph import cut_edges
from hemicycle.operators.integrity import max_deviation
from hemicycle.session import cut_lineage

cloudpickle.register_pickle_by_value(sys.modules[__name__])

KEYS = ["metric", "chain"]
_BLOCK = 8192


def numbered(chains: DataFrame) -> DataFrame:
    """Valid values of each chain with their 0-based position."""
    valid = chains.where(F.col("value").isNotNull() & ~F.isnan("value")).select(*KEYS, "step", F.col("value").cast("double").alias("value"))
    return cut_lineage(row_index(valid, KEYS, ["step"], "position"))


def acf(chains: DataFrame, max_lag: int = 50, half: bool = False) -> DataFrame:
    """Autocorrelation by (metric, chain, lag), lag 0 included.

    A chain is cut into blocks of fixed length (of ``max_lag`` if that is more) that also receive the first
    ``max_lag`` values of the next block; products inside blocks add up to the
    whole chain. ``half`` also limits lags to half the chain. Constant chains
    give zeros.
    """
    size = max(_BLOCK, max_lag)
    rows = chains if "position" in chains.columns else numbered(chains)
    sizes = rows.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("_mean"))
    centred = attach(rows, sizes, KEYS).withColumn("x", F.col("value") - F.col("_mean"))
    block = F.floor(F.col("position") / size)
    spill = (F.col("position") % size < max_lag) & (block > 0)
    blocks = F.when(spill, F.array(block, block - 1)).otherwise(F.array(block))
    spread = centred.select(*KEYS, "position", "x", F.explode(blocks).alias("block"))

    def products(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("position")
        x = frame["x"].to_numpy()
        own = int((frame["position"] // size == frame["block"]).sum())
        lags = np.arange(min(max_lag, len(x) - 1) + 1)
        dots = [float(np.dot(x[: min(own, len(x) - k)], x[k : k + own])) for k in lags]
        return pd.DataFrame({"metric": frame["metric"].iloc[0], "chain": frame["chain"].iloc[0], "lag": lags, "dot": dots})

    kinds = dict(rows.dtypes)
    parts = spread.groupBy(*KEYS, "block").applyInPandas(products, f"metric string, chain {kinds['chain']}, lag int, dot double")
    sums = cut_lineage(parts.groupBy(*KEYS, "lag").agg(F.sum("dot").alias("_dot")))
    zero = sums.where("lag = 0").select(*KEYS, F.col("_dot").alias("_var"))
    out = attach(attach(sums, zero, KEYS), sizes.select(*KEYS, "n"), KEYS)
    if half:
        out = out.where(F.col("lag") <= F.floor(F.col("n") / 2))
    return out.select(*KEYS, "n", "lag", ratio(F.col("_dot"), F.col("_var"), 0.0).alias("acf"))


def effective_sample_size(chains: DataFrame, max_lag: int = 200) -> DataFrame:
    """n / (1 + 2 * sum of autocorrelations before the first below 0.05)."""
    rho = acf(chains, max_lag, half=True)
    low = rho.groupBy(*KEYS).agg(F.min(F.when((F.col("lag") >= 1) & (F.col("acf") < 0.05), F.col("lag"))).alias("_first_low"))
    # a chain that never falls so low sums every lag that there is
    last = F.when(F.col("_first_low").isNull(), F.lit(max_lag)).otherwise(F.greatest(F.col("_first_low") - 1, F.lit(1)))
    used = F.col("lag").between(1, last)
    total = F.coalesce(F.sum(F.when(used, F.col("acf"))), F.lit(0.0))
    return attach(rho, low, KEYS).groupBy(*KEYS, "n").agg((F.col("n") / F.greatest(1 + 2 * total, F.lit(1.0))).alias("ess"))


def _rhat(moments: DataFrame, keys: Sequence[str]) -> DataFrame:
    """R-hat from (keys, n, mean, variance) of each chain."""
    k, n = F.count(F.lit(1)), F.first("n")
    between = n * F.var_samp("mean")
    within = F.avg("variance")
    pooled = (n - 1) / n * within + (k + 1) / (k * n) * between
    value = F.when((k >= 2) & (n >= 4) & (within != 0), F.sqrt(pooled / within))
    return moments.groupBy(*keys).agg(k.alias("n_chains"), n.alias("n_samples"), value.alias("rhat"))


def gelman_rubin(chains: DataFrame) -> DataFrame:
    """R-hat per metric over the first n values, n the shortest chain."""
    rows = chains if "position" in chains.columns else numbered(chains)
    lengths = rows.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("_len"))
    shortest = lengths.groupBy("metric").agg(F.min("_len").alias("n"))
    cut = attach(rows, shortest, ["metric"]).where("position < n")
    moments = cut.groupBy(*KEYS, "n").agg(F.avg("value").alias("mean"), F.var_samp("value").alias("variance"))
    return _rhat(moments, ["metric"])


def gelman_rubin_evolution(chains: DataFrame, window: int = 10) -> DataFrame:
    """R-hat over the first t values of every chain, for each t >= window.

    One pass of running sums replaces a new computation per t.
    """
    rows = chains if "position" in chains.columns else numbered(chains)
    lengths = rows.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("_len"))
    shortest = lengths.groupBy("metric").agg(F.min("_len").alias("_n"))
    level = rows.groupBy("metric").agg(F.avg("value").alias("_level"))
    base = attach(attach(rows, shortest, ["metric"]), level, ["metric"]).where("position < _n")
    x = F.col("value") - F.col("_level")
    sums = running(base.select(*KEYS, "position", x.alias("_x"), (x * x).alias("_xx")), KEYS, ["position"],
                   {"_s": ("sum", "_x"), "_q": ("sum", "_xx")})
    t = F.col("position") + 1
    spread = F.greatest(F.lit(0.0), F.col("_q") - F.col("_s") * F.col("_s") / t) / (t - 1)
    moments = sums.where(t >= window).select(*KEYS, t.alias("n"), t.alias("t"), (F.col("_s") / t).alias("mean"), spread.alias("variance"))
    return _rhat(moments, ["metric", "t"]).select("metric", "t", "rhat")


def mixing_diagnostics(chains: DataFrame) -> DataFrame:
    """Chains, length, R-hat, mean sample size and lag-1 correlation."""
    rows = chains if "position" in chains.columns else numbered(chains)
    rhat = gelman_rubin(rows)
    size = effective_sample_size(rows).groupBy("metric").agg(rnd(F.avg("ess"), 1).alias("ess_mean"))
    lag1 = acf(rows, 1).where("lag = 1").groupBy("metric").agg(rnd(F.avg("acf"), 4).alias("acf_lag1_mean"))
    out = attach(attach(rhat, size, ["metric"]), lag1, ["metric"])
    return out.withColumn("converged", F.col("rhat") < 1.1).withColumn("rhat", rnd("rhat", 4))


def chain_metrics(plans: DataFrame, population: DataFrame, edges: DataFrame, tolerance: float, n_districts: int | None = None) -> DataFrame:
    """Cut edges, deviation and validity of every draw of a chain."""
    deviation = max_deviation(plans, population, n_districts).select("plan_id", "max_dev_pct")
    out = attach(deviation, cut_edges(edges, plans), ["plan_id"])
    return out.select(
        F.col("plan_id").alias("step"), F.coalesce("cut_edges", F.lit(0)).alias("cut_edges"), rnd("max_dev_pct", 3).alias("max_dev_pct"),
        (F.col("max_dev_pct") <= tolerance * 100).alias("is_valid"),
    )
