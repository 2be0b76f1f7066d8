"""Files in, canonical tables out; stored runs; scenario rules."""

import json

import numpy as np
import pytest

from hemicycle.operators import candidates, population, quality
from hemicycle.plans import scenarios, table
from hemicycle.sources import store, tables


def test_proportional_join(spark):
    units = spark.createDataFrame([("1", 1, 100), ("2", 1, 100), ("3", 2, 40), ("4", 3, 0)], "unit_id string, commune int, viviendas long")
    totals = spark.createDataFrame([(1, 1000), (2, 2000), (3, 77)], "commune int, personas long")
    got = {r.unit_id: r.personas for r in population.proportional_join(units, totals, "viviendas", "personas").collect()}
    assert got == {"1": 500, "2": 500, "3": 2000, "4": 0}
    with pytest.raises(Exception, match="without a total"):
        population.proportional_join(units, totals.where("commune = 1"), "viviendas", "personas", strict=True).collect()


def test_fallback_source(spark):
    units = spark.createDataFrame([("1", 1, 5)], "unit_id string, commune int, viviendas long")
    assert population.enrich_population(units, "census")[1] == "viviendas"


def test_headers(spark):
    raw = spark.createDataFrame([("1101", "x"), ("n/a", "4")], "CODIGO_COMUNA string, electores string")
    assert [tuple(r) for r in tables.normalise_voter_roll(raw, 2024).collect()] == [(1101, 0, 2024)]
    with pytest.raises(KeyError):
        tables.normalise_voter_roll(raw.drop("electores"))
    with pytest.raises(KeyError):
        tables.normalise_population(raw)


def test_json_map_and_layer(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps({"1101": 2, "13101": 9}))
    got = {r.key: r.value for r in tables.read_json_map(spark, str(tmp_path / "m.json"), pad_keys=True).collect()}
    assert got == {"01101": "2", "13101": "9"}
    square = [[[0, 0], [1, 0], [1, 1], [0, 0]]]
    features = [{"type": "Feature", "properties": {"ID": i, "N": n}, "geometry": {"type": t, "coordinates": c}}
                for i, n, t, c in (("a", "one", "Polygon", square), ("a", "two", "Polygon", square), ("b", "x", "MultiPolygon", [square, square]))]
    (tmp_path / "l.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": features}))
    units, vertices = tables.read_layer(spark, str(tmp_path / "l.geojson"), "KEY", {"ID": "KEY"}, whole_file=True)
    assert {r.unit_id: r.properties["N"] for r in units.collect()} == {"a": "one", "b": "x"}
    assert vertices.where("unit_id = 'b'").select("part").distinct().count() == 2


def test_provenance(spark, tmp_path):
    import hashlib

    (tmp_path / "b.csv").write_text("2")
    (tmp_path / "a.csv").write_text("1")
    rows = tables.file_provenance(spark, str(tmp_path), "e", "x", "1", "*.csv")
    digests = [hashlib.sha256(s.encode()).hexdigest() for s in "12"]
    assert sorted(r.sha256 for r in rows.collect()) == sorted(digests)
    assert tables.combined_hash(rows).first()[0] == hashlib.sha256("|".join(digests).encode()).hexdigest()


def test_provenance_of_long_files(spark, tmp_path, monkeypatch):
    """Files beyond a cell are streamed, whatever their bytes, ends and names are."""
    import hashlib

    monkeypatch.setattr(tables, "CELL", 1000, raising=False)
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", "1000")  # as 2 GB are for real files
    rng = np.random.default_rng(5)
    noise = rng.integers(0, 256, 200_000, np.uint8).tobytes()
    mark = b"\xef\xbb\xbf"
    files = {
        "a.parquet": noise, "b.parquet": noise + b"\n", "sub/c d+%20.parquet": mark + noise, "sub/d.gz": mark + noise + b"\n", "e.bz2": noise, "f.snappy": noise,
        "nodot": noise, "g.zst": b"\n" * 5000, "h.deflate": b"x" * 5000, "i.lz4": b"\r\n" * 3000, "small.gz": b"1", "sub/a.parquet": noise,
    }
    (tmp_path / "sub").mkdir()
    for name, content in files.items():
        (tmp_path / name).write_bytes(content)
    try:
        rows = tables.file_provenance(spark, str(tmp_path), "e", "x", "1")
        got = sorted((r.file_name, r.sha256) for r in rows.collect())
        assert rows.select("modified").where("modified > '2020'").count() == len(files)
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")
    assert got == sorted((name.split("/")[-1], hashlib.sha256(content).hexdigest()) for name, content in files.items())
    assert spark.conf.get("spark.sql.files.openCostInBytes") == "4194304b"


def test_latest_runs_and_statuses(spark, tmp_path):
    for scenario, run, value in (("s1", "run_1_aaaa", 1), ("s1", "run_2_bbbb", 2), ("s2", "run_1_cccc", 3), ("s2", "", 4)):
        folder = tmp_path / scenario / run
        folder.mkdir(parents=True, exist_ok=True)
        (folder / "ensemble_stats.csv").write_text(f"x\n{value}\n")
    (tmp_path / "s3").mkdir()
    (tmp_path / "s3" / "scenario_status.json").write_text(json.dumps({"status": "infeasible", "reason": "r"}))
    got = {r.scenario: r.x for r in store.load_ensembles(spark, str(tmp_path)).collect()}
    assert got == {"s1": 2.0, "s2": 4.0}
    assert {r.scenario: r.x for r in store.load_ensembles(spark, str(tmp_path), run_id="aa-aa").collect()} == {"s1": 1.0}
    assert [tuple(r) for r in store.load_scenario_statuses(spark, str(tmp_path)).collect()] == [("s3", "infeasible", "r")]


def test_ensembles_with_unequal_headers(spark, tmp_path):
    for scenario, content in (("s1", "x,score\n1,a\n2,3\n"), ("s2", "score,x\n5,6\n"), ("s3", "x,extra,score\n7,0.5,\n")):
        (tmp_path / scenario).mkdir()
        (tmp_path / scenario / "ensemble_stats.csv").write_text(content)
    rows = store.load_ensembles(spark, str(tmp_path)).select("scenario", "x", "score", "extra").collect()
    assert sorted(map(tuple, rows)) == [("s1", 1.0, "a", None), ("s1", 2.0, "3", None), ("s2", 6.0, "5", None), ("s3", 7.0, None, 0.5)]
    assert store.load_ensembles(spark, str(tmp_path), ["none"]).collect() == []


def test_checks_of_odd_tables(spark):
    short = spark.createDataFrame([("1",)], "CUT string")
    assert [tuple(r) for r in quality.check_population_table(short).collect()] == [("column personas", False, 1)]
    assert [r.check for r in quality.check_votes_table(short).collect()] == ["column party", "column votes"]
    assert [r.check for r in quality.check_assignment(short).collect()] == ["column key", "column district"]
    odd = spark.createDataFrame([(1, "1"), (2, "2.5"), (3, "x"), (4, None)], "key int, district string")
    found = {r.check: (r.ok, r.found) for r in quality.check_assignment(odd, 4, 2).collect()}
    assert found["text keys"] == (False, 4) and found["whole districts"] == (False, 2) and found["expected keys"] == (True, 4)


def test_plan_store(spark, tmp_path):
    rows = [("r1", "free", 0, d, f"u{u}", (d + u) % 3) for d in range(6) for u in range(5)] + [("r1", "free", 0, 0, None, 1)]
    plans = spark.createDataFrame(rows, "run_id string, scenario string, chain_id int, draw int, unit_id string, district int")
    stats = spark.createDataFrame([(d, float(d), 0.5, d) for d in range(6)], "plan_id int, max_dev_pct double, pp_mean double, cut_edges int")
    manifest = spark.sql("SELECT 'r1' AS run_id, named_struct('name', 'free') AS scenario")
    bundle = store.PlanStore(spark, str(tmp_path / "store"))
    bundle.save(plans, stats, stats, manifest)
    assert bundle.plans().count() == 30 and bundle.scenario_name() == "free"
    assert {r.draw for r in bundle.filter(max_dev=3, max_cut=2).collect()} == {0, 1, 2}
    assert bundle.sample(2, 1).count() == 10 and bundle.sample(99, 1).count() == 30
    plan = bundle.plans().where("run_id = 'r1'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(run_id" in plan


def test_validity_levels(spark):
    stats = spark.createDataFrame([(1, 14.0), (2, 40.0)], "plan_id int, max_dev_pct double")
    rows = table.validity_filter(stats, 0.1).collect()
    assert [(r.plan_id, r.tolerance_used, r.fallback) for r in rows] == [(1, 0.1 * 1.5, True)]
    far = stats.withColumn("max_dev_pct", stats.max_dev_pct * 100)
    assert [(r.tolerance_used, r.fallback) for r in table.validity_filter(far, 0.1).collect()] == [(None, True)] * 2


def test_overlay_and_match(spark):
    people = spark.createDataFrame([(1, 5001, "José Pérez", "p", "l", 10), (1, 5002, "Ana", "p", "l", 5)],
                                   "district int, candidate_id long, candidate_name string, party_id string, list_id string, votes long")
    final = spark.createDataFrame([(1, "JOSE PEREZ", 12)], "district int, candidate_name string, votes_final long")
    got = {r.candidate_id: (r.votes, r.from_first) for r in candidates.overlay_votes(people, final).collect()}
    assert got == {5001: (12, False), 5002: (5, True)}
    roster = spark.createDataFrame([(1, "jose perez", 1)], "district int, candidate_name string, roster_number long")
    elected = spark.createDataFrame([(1, "JOSÉ PÉREZ", 12), (1, "Nobody", 3)], "district int, candidate_name string, votes_final long")
    matched, rest = candidates.match_proclaimed(elected, roster, people)
    assert [r.candidate_id for r in matched.collect()] == [5001] and [r.candidate_name for r in rest.collect()] == ["Nobody"]


def election(spark, elected):
    people = spark.createDataFrame([(1, "a", "L", 1001, "x", 50), (1, "a", "L", 1002, "y", 30), (1, "b", "M", 1003, "z", 20)],
                                   "district int, party string, list_id string, candidate_id long, candidate_name string, votes long")
    mags = spark.createDataFrame([(1, 2)], "district int, magnitude int")
    pacts = spark.createDataFrame([("a", "L"), ("b", "M")], "party string, pact string")
    return quality.validate_election(people, people.where(f"candidate_id IN ({elected})").drop("votes"), mags, pacts)


def test_validation_status(spark):
    report, wrong = election(spark, "1001, 1002")
    assert report.first().status == "EXACT_REPRODUCTION" and wrong.count() == 0
    report, wrong = election(spark, "1001, 1003")
    assert report.first().status == "PARTIAL"
    assert {(r.type, r.candidate_id) for r in wrong.collect()} == {
        ("list_allocation_mismatch", None), ("candidate_mismatch", 1002), ("candidate_mismatch", 1003)}
    by_district = quality.discrepancies_by_district(wrong).first()
    assert (by_district.n, by_district.false_positives, by_district.false_negatives) == (4, 1, 1)


def test_scenarios(spark):
    assert all(not [m for kind, m in scenarios.problems(s) if kind == "error"] for s in scenarios.SCENARIOS.values())
    strict = scenarios.SCENARIOS["apc_strict"]
    assert any("finer" in w for w in scenarios.validate(strict))
    with pytest.raises(ValueError, match="exactly the preserved"):
        scenarios.validate(scenarios.Scenario("x", units=("CUT",), preserve={"COD_REGION": "soft"}))
    with pytest.raises(ValueError, match="tolerance"):
        scenarios.validate(scenarios.Scenario("x", units=("CUT",), pop_tolerance=1.5))
    soft = scenarios.SCENARIOS["comunas_hard_region_soft"]
    assert soft.penalties()["COD_REGION"] == 0.25
    assert scenarios.rules_table(spark).count() == 7
