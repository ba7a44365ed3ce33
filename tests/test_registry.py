"""The driver contract on the smallest data folder."""

import __spark_entry__ as entry


def test_names_and_oracles():
    names = entry.queries()
    assert set(entry.oracle_sql()) <= set(names) and len(names) > 100


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.columns == ["scan_id", "risk_level", "risk_percent"] and df.count() > 0
