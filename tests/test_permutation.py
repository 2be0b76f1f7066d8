"""Permutation inference against loops over the same draws."""

import hashlib
import math

import numpy as np
import pytest

from hemicycle.operators import permutation, spatial


def number(text):
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def digest(text):
    return hashlib.md5(text.encode()).hexdigest()


def picks(n, slots, k):
    """The first places of a shuffle of 0 .. n - 2."""
    places = list(range(n - 1))
    for s in range(slots):
        t = s + number(f"{k}:{s}") % (n - 1 - s)
        places[s], places[t] = places[t], places[s]
    return places[:slots]


@pytest.fixture(scope="module")
def graph():
    rng = np.random.default_rng(12)
    y = {i: int(v) for i, v in zip(range(3, 63), rng.integers(0, 9, 60), strict=True)}
    edges = {(int(min(a, b)), int(max(a, b))) for a, b in rng.integers(3, 58, (110, 2)) if a != b}  # some units have no neighbour
    near = {i: sorted({b for a, b in edges if a == i} | {a for a, b in edges if b == i}) for i in y}
    return y, sorted(edges), near


@pytest.fixture(scope="module")
def tables(spark, graph):
    y, edges, _ = graph
    values = spark.createDataFrame([(i, float(v)) for i, v in y.items()], "unit_id long, value double")
    return values.repartition(3), spark.createDataFrame(edges, "src long, dst long")


@pytest.mark.parametrize("block", [permutation.BLOCK, 64])
def test_global(spark, graph, tables, monkeypatch, block):
    monkeypatch.setattr(permutation, "BLOCK", block)
    y, _, near = graph
    ids = sorted(y)
    mean = sum(y.values()) / len(y)

    def cross(z):
        return sum(z[i] * sum(z[j] for j in near[i]) / len(near[i]) for i in ids if near[i])

    z = {i: y[i] - mean for i in ids}
    seen = cross(z)
    larger = 0
    for k in range(1, 100):
        order = sorted(ids, key=lambda i: (digest(f"{k}:{i}"), i))
        moved = {i: z[ids[r]] for r, i in enumerate(order)}
        larger += cross(moved) >= seen - 1e-9
    row = spatial.moran_global(*tables, permutations=99).first()
    linked = sum(bool(near[i]) for i in ids)
    assert row.moran_i == pytest.approx(len(ids) / linked * seen / sum(v * v for v in z.values()))
    assert row.p_sim == pytest.approx((min(larger, 99 - larger) + 1) / 100)


def test_batches_hold_few_draws(spark, graph, tables, monkeypatch):
    """Values of a few draws are stored at a time, and what the batches find together is the same."""
    whole = spatial.moran_global(*tables, permutations=99).first()
    for name, value in {"BLOCK": 64, "CHUNK": 16, "RUN": 7, "LEAST": 10, "DRAWN": 1}.items():
        monkeypatch.setattr(permutation, name, value)
    made, step = [], permutation._values_of_draws

    def watched(chunks, values, keys, first, last, width):
        made.append(range(first, last))
        return step(chunks, values, keys, first, last, width)

    monkeypatch.setattr(permutation, "_values_of_draws", watched)
    assert spatial.moran_global(*tables, permutations=99).first() == whole
    assert [k for part in made for k in part] == list(range(1, 100)) and max(map(len, made)) == 10
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_digests():
    """Texts of any bytes and of one block or more have their md5 digests, all tails at once."""
    tails = [b"", *(f":{i}".encode() for i in (0, 7, 12345, *range(99_990, 140_000))), b":" + b"x" * 52, b":" + b"x" * 80, ":ñ".encode()]
    made = permutation._Digests(tails)
    for start in (b"", b"1", b"region:4:999", "città:".encode(), b"y" * 51):
        assert [bytes(d) for d in made.of(start)] == [hashlib.md5(start + t).digest() for t in tails]


def test_rows_of_a_draw(spark, graph, tables, monkeypatch):
    """Blocks and chunks widen with the units, so the packed rows of a draw stay few."""
    whole = spatial.moran_global(*tables, permutations=19).first()
    for name, value in {"BLOCK": 64, "CHUNK": 1, "RUN": 8, "PARTS": 4, "WIDEST": 1024}.items():
        monkeypatch.setattr(permutation, name, value, raising=False)
    made, step = [], permutation._values_of_draws

    def watched(chunks, values, *rest):
        met, dealt = step(chunks, values, *rest)
        made.append(dealt.count() / dealt.select("k").distinct().count())
        return met, dealt

    monkeypatch.setattr(permutation, "_values_of_draws", watched)
    found = spatial.moran_global(*tables, permutations=19).first()
    assert found.p_sim == whole.p_sim and found.moran_i == pytest.approx(whole.moran_i)
    assert max(made) <= 4 * 8  # 60 units in 4 chunks of 16 and 8 runs


def test_local(graph, tables):
    y, _, near = graph
    ids = sorted(y)
    mean, most = sum(y.values()) / len(y), max(map(len, near.values()))
    draws = [picks(len(ids), most, k) for k in range(1, 200)]
    assert all(len(set(d)) == most for d in draws)
    want = {}
    for at, i in enumerate(ids):
        if near[i]:
            seen = sum(y[j] for j in near[i])
            sums = [sum(y[ids[r + (r >= at)]] for r in d[: len(near[i])]) for d in draws]
            more = sum(s >= seen for s in sums)
            high = sum((s - seen) * (y[i] - mean) >= 0 for s in sums)
            want[i] = tuple((min(c, 199 - c) + 1) / 200 for c in (high, more))
    got = {r.unit_id: r.p_sim for r in spatial.moran_local(*tables, permutations=199).collect()}
    assert {i: p for i, p in got.items() if p is not None} == pytest.approx({i: w[0] for i, w in want.items()}) and set(got) == set(ids)
    rows = {r.unit_id: r for r in spatial.getis_ord_local(*tables, permutations=199).collect()}
    assert {i: r.p_sim for i, r in rows.items()} == pytest.approx({i: w[1] for i, w in want.items()})
    assert all(r.spot == ("hot" if r.z > 1.96 and r.p_sim < 0.05 else "cold" if r.z < -1.96 and r.p_sim < 0.05 else "none") for r in rows.values())
    assert all(abs(r.p_norm - math.erfc(abs(r.z) / math.sqrt(2)) / 2) < 1e-6 for r in rows.values())


def test_correlogram(graph, tables):
    y, _, near = graph
    ids = sorted(y)
    hops = {i: {i: 0} for i in ids}
    for i in ids:
        front = [i]
        while front:
            front = list({j for u in front for j in near[u]} - set(hops[i]))
            hops[i] |= {j: max(hops[i].values()) + 1 for j in front}
    mean = sum(y.values()) / len(y)
    squares = sum((v - mean) ** 2 for v in y.values())
    got = {r.order: r for r in spatial.spatial_correlogram(*tables, 7, 19).collect()}
    for k in range(1, 8):
        ring = {i: [j for j, d in hops[i].items() if d == k] for i in ids}
        linked = [i for i in ids if ring[i]]
        if not linked:
            assert k not in got
            continue
        cross = sum((y[i] - mean) * sum(y[j] - mean for j in ring[i]) / len(ring[i]) for i in linked)
        assert got[k].moran_i == pytest.approx(len(ids) / len(linked) * cross / squares)
        assert 0 < got[k].p_sim <= 0.55 and got[k].significant == (got[k].p_sim < 0.05)


def test_scopes_share_draws(spark, graph):
    """Constant, null and lonely cases of every scope have a defined row or none."""
    y, edges, _ = graph
    rows = [(i, i % 2 if i < 60 else None, float(v), 1.0, None if i == 5 else float(-v)) for i, v in y.items()]
    units = spark.createDataFrame(rows, "unit_id long, half long, a double, same double, b double")
    found = spatial.local_scopes(units, spark.createDataFrame(edges, "src long, dst long"), {"half": "half", "all": None}, ["a", "same", "b"], 49).collect()
    assert {(r.scope, r.place) for r in found} == {("half", "0"), ("half", "1"), ("all", "all")} and 5 not in {r.unit_id for r in found}
    for r in found:
        assert (r.local_i is None and r.spot == "none" and r.p_moran == pytest.approx(1 / 50)) if r.variable == "same" else r.local_i is not None
    one = {(r.scope, r.place, r.unit_id): r for r in found if r.variable == "a"}
    two = {(r.scope, r.place, r.unit_id): r for r in found if r.variable == "b"}
    assert all(one[k].p_moran == two[k].p_moran and one[k].local_i == pytest.approx(two[k].local_i) for k in one)
    assert spatial.local_scopes(units.limit(0), spark.createDataFrame(edges, "src long, dst long"), {"all": None}, ["a"], 9).collect() == []
