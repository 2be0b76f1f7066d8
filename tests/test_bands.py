"""Draws of the bootstrap that cannot lead are left out, and no front changes."""

import random


from hemicycle.operators import pareto


def _front(rows):
    return {p for p in rows if not any(q != p and q[0] <= p[0] and q[1] <= p[1] for q in rows)}


def test_bands_meet_few_draws_and_keep_every_front(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(p / 4, round(x, 2), round(1 / (x + 0.2) + rng.random(), 2)) for p in range(3) for x in [rng.random() for _ in range(400)]]
    rows += rows[:40] + [(0.0, float("nan"), 1.0), (0.25, 1.0, None), (None, 0.0, 0.0), (9.0, -1.0, -1.0)]
    table = spark.createDataFrame(rows, "penalty double, x double, y double")
    whole = pareto._may_lead
    seen = {}

    def spy(placed, drawn, replicates):
        near = whole(placed, drawn, replicates)
        pairs = lambda df: [tuple(r) for r in df.select("replicate", "x", "y").collect()]
        seen.update(all=pairs(drawn(placed)), near=pairs(drawn(near)))
        return near

    monkeypatch.setattr(pareto, "_may_lead", spy)
    bands = {tuple(r) for r in pareto.bootstrap_bands(table, "x", "y", replicates=12, points=7).collect()}
    assert len(seen["near"]) < len(seen["all"]) / 4
    for k in range(1, 13):
        assert _front({p[1:] for p in seen["all"] if p[0] == k}) == _front({p[1:] for p in seen["near"] if p[0] == k})
    monkeypatch.setattr(pareto, "_may_lead", lambda placed, drawn, replicates: placed)
    assert bands == {tuple(r) for r in pareto.bootstrap_bands(table, "x", "y", replicates=12, points=7).collect()}
