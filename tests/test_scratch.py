"""The folder of scratch tables: named by the session, of this process for a local master, else an error."""

from types import SimpleNamespace

import pytest

from quotelark import scratch


def session(master, where=None):
    return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default=None: where or default), sparkContext=SimpleNamespace(master=master))


def test_shared_dir():
    assert scratch.shared_dir(session("spark://host:7077", "hdfs://shared/")) == "hdfs://shared"
    assert scratch.shared_dir(session("local[2]")) == scratch.shared_dir(session("local"))
    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            scratch.shared_dir(session(master))


def test_cut_and_discard(spark):
    table = scratch.cut(spark.range(5))
    assert table.count() == 5 and table.stored_at.startswith(scratch.shared_dir(spark))
    scratch.discard(table)
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(table.stored_at)
