"""Fair shares of seats by party and district, kept as long cells."""

from __future__ import annotations

import sys
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

from hemicycle.functions.frames import attach, ensure, group_window, ratio, rnd
from hemicycle.session import cut_lineage

cloudpickle.register_pickle_by_value(sys.modules[__name__])

CELL = ["party", "district"]


def matrix(rows: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """Sum by (party, district) on the full grid of both, 0 where absent.

    The grid comes from the two small lists of names, one array per key.
    """
    keys = list(keys)
    sums = rows.groupBy(*keys, *CELL).agg(F.sum(value).alias("value"))
    names = sums.groupBy(*keys).agg(F.collect_set("party").alias("_parties"))
    grid = attach(sums.select(*keys, "district").distinct(), names, keys).select(
        *keys, "district", F.explode("_parties").alias("party")
    )
    return grid.join(sums, [*keys, *CELL], "left").fillna(0, ["value"])


def pivoted(cells: DataFrame, districts: Sequence) -> DataFrame:
    """Wide party x district table for output."""
    return cells.groupBy("party").pivot("district", list(districts)).agg(F.sum("value"))


def _checked(votes: DataFrame, magnitudes: DataFrame, keys: Sequence[str]) -> DataFrame:
    on = [k for k in [*keys, "district"] if k in magnitudes.columns]
    both = votes.groupBy(*keys, *CELL).agg(F.sum("votes").alias("votes"), F.min("votes").alias("_low")).join(
        magnitudes.select(*on, "magnitude"), on, "left"
    )
    sound = F.coalesce(F.col("magnitude") > 0, F.lit(False))
    both = both.withColumn("magnitude", ensure(sound, "every district needs a positive magnitude", F.col("magnitude")))
    return both.withColumn("votes", ensure(F.col("_low") >= 0, "negative votes", F.col("votes"))).drop("_low")


def fair_share_district(votes: DataFrame, magnitudes: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Votes over district votes times magnitude."""
    cells = _checked(votes, magnitudes, keys)
    total = F.sum("votes").over(group_window([*keys, "district"]))
    return cells.withColumn("fair_share", ratio(F.col("votes"), total, 0.0) * F.col("magnitude"))


def fair_share_biproportional(
    votes: DataFrame, magnitudes: DataFrame, max_iter: int = 2000, tol: float = 1e-10
) -> tuple[DataFrame, bool]:
    """Shares meeting party quotas and district seats; and whether they do.

    Only one factor per party and per district is carried from step to step;
    the vote cells are scanned, never rewritten. Factors are checkpointed
    each round and one number decides whether to stop.
    """
    cells = cut_lineage(_checked(votes, magnitudes, ()))
    columns = cells.select("district", "magnitude").distinct()
    totals = attach(cells.agg(F.sum("votes").alias("_v")), columns.agg(F.sum("magnitude").alias("_s")))
    quotas = cut_lineage(
        attach(cells.groupBy("party").agg(F.sum("votes").alias("_p")), totals).select(
            "party", (F.col("_p") / F.col("_v") * F.col("_s")).alias("quota"))
    )
    by_district = columns.select("district", "magnitude", F.lit(1.0).alias("c"))
    done = False
    for _ in range(max_iter):
        weighted = cells.join(by_district.select("district", "c"), "district")
        rows = weighted.groupBy("party").agg(F.sum(F.col("votes") * F.col("c")).alias("_sum"))
        by_party = cut_lineage(rows.join(quotas, "party").select("party", "quota", ratio(F.col("quota"), F.col("_sum"), 0.0).alias("r")))
        scaled = cells.join(by_party.select("party", "r"), "party")
        cols = scaled.groupBy("district", "magnitude").agg(F.sum(F.col("votes") * F.col("r")).alias("_sum"))
        by_district = cut_lineage(cols.select("district", "magnitude", ratio(F.col("magnitude"), F.col("_sum"), 0.0).alias("c")))
        fitted = cells.join(by_party, "party").join(by_district.select("district", "c"), "district").withColumn(
            "fair_share", F.col("votes") * F.col("r") * F.col("c")
        )
        # columns were scaled last, so only the party sums can be off
        off = fitted.groupBy("party", "quota").agg(F.abs(F.sum("fair_share") - F.col("quota")).alias("_e"))
        if off.agg(F.max("_e")).first()[0] < tol:
            done = True
            break
    return fitted.select(*CELL, "votes", "magnitude", "fair_share"), done


def fair_share_biproportional_by_plan(
    votes: DataFrame, magnitudes: DataFrame, keys: Sequence[str] = ("plan_id",), max_iter: int = 2000, tol: float = 1e-10
) -> DataFrame:
    """Same for many plans at once, one small matrix per plan.

    Votes are summed to (party, district) cells first, so a group holds as
    many rows as a plan has parties times districts.
    """
    keys = list(keys)
    cells = _checked(votes, magnitudes, keys).withColumn("fair_share", F.lit(0.0)).withColumn("converged", F.lit(False))

    def fit(frame: pd.DataFrame) -> pd.DataFrame:
        party, district = pd.factorize(frame["party"])[0], pd.factorize(frame["district"])[0]
        v = np.zeros((party.max() + 1, district.max() + 1))
        np.add.at(v, (party, district), frame["votes"].to_numpy(float))
        seats = np.zeros(v.shape[1])
        seats[district] = frame["magnitude"]
        quota = v.sum(axis=1) / v.sum() * seats.sum()
        c, settled = np.ones(v.shape[1]), False
        for _ in range(max_iter):
            reach = v @ c
            r = np.divide(quota, reach, out=np.zeros_like(reach), where=reach > 0)
            reach = r @ v
            c = np.divide(seats, reach, out=np.zeros_like(reach), where=reach > 0)
            q = v * r[:, None] * c
            if max(abs(q.sum(axis=1) - quota).max(), abs(q.sum(axis=0) - seats).max()) < tol:
                settled = True
                break
        return frame.assign(fair_share=q[party, district], converged=settled)

    return cells.groupBy(*keys).applyInPandas(fit, cells.schema)


def _gaps(allocation: DataFrame, fair: DataFrame, keys: Sequence[str]) -> DataFrame:
    both = allocation.select(*keys, *CELL, F.col("seats").cast("double").alias("n")).join(
        fair.select(*keys, *CELL, F.col("fair_share").alias("q")), [*keys, *CELL], "full"
    ).fillna(0.0, ["n", "q"])
    return both.withColumn("gap", F.col("n") - F.col("q"))


def distances(allocation: DataFrame, fair: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """L1, L1 over total, L2 and root mean square of the cell gaps."""
    gap, l1 = F.col("gap"), F.sum(F.abs("gap"))
    return _gaps(allocation, fair, keys).groupBy(*keys).agg(
        l1.alias("l1"), ratio(l1, F.sum("q")).alias("l1_norm"),
        F.sqrt(F.sum(gap * gap)).alias("l2"), F.sqrt(F.avg(gap * gap)).alias("rmse"),
    )


def _direction(n, q):
    # fixed values: labels of the direction
    return F.when(n > q, "sobre").when(n < q, "sub").otherwise("exacto")


def _largest_cell():
    """Largest absolute gap; ties to the first party, then district."""
    return F.min(F.struct((-F.abs("gap")).alias("neg"), "party", "district", "n", "q"))


def max_cell_deviation(allocation: DataFrame, fair: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    top = _gaps(allocation, fair, keys).groupBy(*keys).agg(_largest_cell().alias("t"))
    return top.select(
        *keys, (-F.col("t.neg")).alias("max_dev"), "t.party", "t.district",
        F.col("t.n").alias("seats"), F.col("t.q").alias("fair_share"),
        _direction(F.col("t.n"), F.col("t.q")).alias("direction"),
    )


def fair_share_summary(allocation: DataFrame, fair: DataFrame, keys: Sequence[str] = (), band: float = 0.01) -> DataFrame:
    """Distances, largest cell and counts of cells over, under or on share."""
    gap, l1, n = F.col("gap"), F.sum(F.abs("gap")), F.count(F.lit(1))
    out = _gaps(allocation, fair, keys).groupBy(*keys).agg(
        rnd(l1, 6).alias("l1"), rnd(ratio(l1, F.sum("q")), 6).alias("l1_norm"),
        rnd(F.sqrt(F.sum(gap * gap)), 6).alias("l2"), rnd(F.sqrt(F.avg(gap * gap)), 6).alias("rmse"),
        _largest_cell().alias("t"), n.alias("n_cells"),
        F.count_if(gap > band).alias("n_over"), F.count_if(gap < -band).alias("n_under"),
        F.count_if(F.abs(gap) <= band).alias("n_exact"),
    )
    return out.select(
        *keys, "l1", "l1_norm", "l2", "rmse", rnd(-F.col("t.neg"), 6).alias("max_dev"),
        F.col("t.party").alias("max_dev_party"), F.col("t.district").alias("max_dev_district"),
        _direction(F.col("t.n"), F.col("t.q")).alias("max_dev_direction"),
        "n_cells", "n_over", "n_under", "n_exact", rnd(F.col("n_over") / F.col("n_cells"), 4).alias("share_over"),
    )
