"""The registry: shape, contract and a few queries end to end."""

import duckdb
import pytest

import __spark_entry__ as driver

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def test_every_oracle_has_a_query():
    assert set(driver.oracle_sql()) <= set(driver.queries())


@pytest.mark.parametrize("name", ["e6_run_plan_two_level", "f17_electoral_ensemble", "p12_multi_level_split_metrics", "g6_dissolve", "i3_rank_scenarios", "a8_write_read_plans"])
def test_against_sql(spark, sf, name):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = driver.queries()[name](spark, sf)
    columns = sorted(df.columns)
    found = sorted(str(tuple(r[c] for c in columns)) for r in df.collect())
    result = db.execute(driver.oracle_sql()[name])
    places = [[d[0] for d in result.description].index(c) for c in columns]
    assert found == sorted(str(tuple(row[i] for i in places)) for row in result.fetchall())


def test_entry(spark):
    assert driver.entry(spark).count() == 8
