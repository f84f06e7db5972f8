"""Archives of small files, their packets and resumed days, and what files declare."""

import bz2
import gzip
import io
import os
import tarfile
import time

import duckdb
from pyspark.sql import functions as F

from quotelark import catalog
from quotelark.sources import archives as A

DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
DAY = r"^(?P<day>\d{4}-\d\d-\d\d)/"


def archive(path, members):
    with tarfile.open(path, "w") as tar:
        for name, raw in members:
            info = tarfile.TarInfo(name)
            info.size = len(raw)
            tar.addfile(info, io.BytesIO(raw))
    return str(path)


def test_ten_thousand_small_files(spark, tmp_path):
    members = [(f"2024-01-{1 + k % 20:02d}/1.{k}.bz2", bz2.compress(f'{{"k": {k}}}\n{{"k": {-k}}}\n'.encode())) for k in range(10_000)]
    one = archive(tmp_path / "a.tar", members)
    lines = A.archive_lines(spark, [one], DAY)
    assert lines.rdd.getNumPartitions() == 5
    began = time.time()
    got = lines.groupBy("day").agg(F.count_distinct("member").alias("files"), F.count("*").alias("n"), F.sum(F.get_json_object("line", "$.k").cast("long")).alias("total")).collect()
    assert len(got) == 20 and {(r.files, r.n, r.total) for r in got} == {(500, 1000, 0)}
    assert 10_000 / (time.time() - began) > 100  # files a second
    skipped = A.archive_lines(spark, [one], DAY, [f"2024-01-{d:02d}" for d in range(1, 20)])
    assert skipped.select("day").distinct().collect() == [("2024-01-20",)] and skipped.rdd.getNumPartitions() == 1
    assert A.archive_lines(spark, [one], DAY, [f"2024-01-{d:02d}" for d in range(1, 21)]).count() == 0


def test_broken_empty_and_foreign_members(spark, tmp_path):
    members = [("2024-01-01/a.bz2", bz2.compress(b"x\ny")), ("2024-01-01/b.bz2", b"no bz2"), ("2024-01-01/c.bz2", bz2.compress(b"")), ("2024-01-01/d.gz", gzip.compress(b"z")), ("2024-01-01/e.bz2", bz2.compress(b"\xff")), ("readme.txt", b"hello"), ("2024-01-02/f", b"plain")]
    got = A.archive_lines(spark, [archive(tmp_path / "a.tar", members), archive(tmp_path / "b.tar", members[:1])], DAY).collect()
    assert sorted((r.member[11:], r.line) for r in got if r.error is None) == [("a.bz2", "x"), ("a.bz2", "x"), ("a.bz2", "y"), ("a.bz2", "y"), ("d.gz", "z"), ("f", "plain")]
    assert {r.member[11:]: r.error.split(":")[0] for r in got if r.error} == {"b.bz2": "OSError", "c.bz2": "EMPTY", "e.bz2": "UnicodeDecodeError"}


def test_packed_archives_read_back(spark, tmp_path):
    rows = [(f"w{k % 3}", f"2024-01-{1 + k % 5:02d}/m{k % 7}.bz2", k, f"line {k}") for k in range(200)]
    made = A.pack(spark.createDataFrame(rows, "archive string, member string, number long, line string").repartition(4), f"{tmp_path}/out")
    got = A.archive_lines(spark, made, DAY, files_per_task=3).orderBy("member", "archive", "number").collect()
    assert len(made) == 3 and sorted(r.line for r in got) == sorted(r[3] for r in rows) and all(r.error is None for r in got)
    assert [r.line for r in got if "/w0-" in r.archive and r.member == rows[0][1]] == [r[3] for r in rows if r[:2] == rows[0][:2]]


def test_large_archives_are_packed_and_read_in_parts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(A, "ROWS_PER_ARCHIVE", 50)
    rows = [(f"w{k % 3}", f"2024-01-{1 + k % 5:02d}/m{k % 67}.bz2", k, f"line {k}") for k in range(600)]
    made = A.pack(spark.createDataFrame(rows, "archive string, member string, number long, line string").repartition(4), f"{tmp_path}/out")
    lines = A.archive_lines(spark, made, DAY, ["2024-01-02"], files_per_task=3)
    got = lines.orderBy("member", "archive", "number").collect()
    assert 9 <= len(made) <= 12 and sorted(r.line for r in got) == sorted(r[3] for r in rows if "-02/" not in r[1]) and all(r.error is None for r in got)
    assert len({(r.archive, r.member) for r in got}) == len({r[:2] for r in rows if "-02/" not in r[1]})


def test_days_in_several_files_of_a_week_are_whole(spark, monkeypatch):
    monkeypatch.setattr(A, "ROWS_PER_ARCHIVE", 25)
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{DIR}/events.parquet'")
    want = con.sql(catalog.ORACLE_SQL["k3_archive_days"]).fetchall()
    assert sorted(map(tuple, catalog.QUERIES["k3_archive_days"](spark, DIR).collect())) == sorted(want)


def test_drifting_files_are_named(spark, tmp_path):
    for season, frame in ((2001, "1 as a, 'x' as b"), (2002, "1 as a, 'x' as b, 2 as c"), (2003, "cast('1' as string) as a")):
        spark.sql(f"select {frame}").write.parquet(f"{tmp_path}/season={season}")
    spark.sql("select 1 as a").write.parquet(f"{tmp_path}/season=2002/more")
    found = A.declared_columns(spark, str(tmp_path)).withColumn("season", F.regexp_extract("file", r"season=(\d+)", 1))
    got = {(r.season, r.column): r.status for r in A.schema_drift(found, "season").collect()}
    assert got == {("2002", "b"): "MIXED", ("2002", "c"): "MIXED", ("2003", "a"): "RETYPED", ("2003", "b"): "MISSING"}
    (tmp_path / "csv").mkdir()
    (tmp_path / "csv" / "x.csv").write_text('﻿Date,"Home", Away\n1,2,3\n')
    assert [r.column for r in A.declared_columns(spark, f"{tmp_path}/csv").orderBy("place").collect()] == ["Date", "Home", "Away"]
