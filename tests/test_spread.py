"""Tables are dealt over tasks in proportion to their size, and queries say the same either way."""

import pytest

from quotelark import catalog
from quotelark.sources import driver_tables
from quotelark.sources.driver_tables import Tables

DIR = "/root/testdata/sf0.001"
QUERIES = ["d7_first_rows", "a18_qualified_rollup", "a7_margin_by_timing", "c11_bucket_analysis", "w11_shrunken_prior_rate", "w6_season_to_date"]


def test_tasks_grow_with_the_table(spark, monkeypatch):
    t = Tables(spark, DIR)
    assert t.parts("lineitem") == int(spark.conf.get("spark.sql.shuffle.partitions"))
    monkeypatch.setattr(Tables, "TASK_BYTES", 10_000)
    assert t.parts("lineitem") > 10
    for rows in (t.quotes(), t.bets(), t.history(), t.history(teams_together=True)):
        assert rows.rdd.getNumPartitions() == t.parts("lineitem")


@pytest.mark.parametrize("name", QUERIES)
def test_dealt_rows_say_the_same(spark, monkeypatch, name):
    told = lambda: sorted(map(str, catalog.QUERIES[name](spark, DIR).collect()))
    want = told()
    monkeypatch.setattr(driver_tables.Tables, "TASK_BYTES", 10_000)
    assert told() == want
