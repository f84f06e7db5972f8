"""Tar archives of many small compressed files as a data source, and inventories of what files declare about themselves."""

from __future__ import annotations

import bz2
import gzip
import io
import json
import re
import tarfile
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

LINES = "archive string, member string, day string, size long, number int, line string, error string"


FILES_PER_TASK, BYTES_PER_TASK = 2000, 64 << 20
#: Rows of an archive that pack() makes, about.
ROWS_PER_ARCHIVE = 100_000


def opened(uri: str) -> pa.NativeFile:
    system, path = fs.FileSystem.from_uri(uri)
    return system.open_input_file(path)


@dataclass
class Members(InputPartition):
    """A stretch of one archive that one task reads: the bytes from the first header on, up to the end of the last file."""

    archive: str
    begin: int
    end: int


def unpacked(name: str, raw: bytes) -> bytes:
    return bz2.decompress(raw) if name.endswith(".bz2") else gzip.decompress(raw) if name.endswith(".gz") else raw


def headers(stream: pa.NativeFile, begin: int, end: int | None = None) -> Iterator[tarfile.TarInfo]:
    """The headers of a tar from a member's beginning on; contents are not read and headers not kept."""
    stream.seek(begin)
    with tarfile.open(fileobj=io.BufferedReader(stream, 1 << 16), mode="r:") as tar:
        while (member := tar.next()) is not None and (end is None or member.offset < end):
            tar.members.clear()
            yield member


def packets(archive: str, pattern: re.Pattern, skip: set[str], most_files: int, most_bytes: int) -> Iterator[tuple[str, int, int]]:
    """(archive, begin, end) of stretches that hold enough files for a task. Days to skip make no work."""
    files = size = begin = end = 0
    with opened(archive) as stream:
        for member in headers(stream, 0):
            if wanted(member, pattern, skip) is None:
                continue
            if files and (files >= most_files or size + member.size > most_bytes):
                yield archive, begin, end
                files = size = 0
            begin, end = begin if files else member.offset, member.offset_data + member.size
            files, size = files + 1, size + member.size
    if files:
        yield archive, begin, end


def wanted(member: tarfile.TarInfo, pattern: re.Pattern, skip: set[str]) -> str | None:
    """The day of a member that is to be read."""
    match = pattern.search(member.name) if member.isfile() else None
    return None if match is None or match["day"] in skip else match["day"]


class MembersReader(DataSourceReader):
    def __init__(self, options: dict):
        self.pattern, self.skip = re.compile(options.get("pattern", r"(?P<day>)")), set(json.loads(options.get("skip", "[]")))
        most = int(options.get("filesPerTask", FILES_PER_TASK)), int(options.get("bytesPerTask", BYTES_PER_TASK))
        self.archives, self.most, self.packets = json.loads(options.get("archives", "[]")), most, json.loads(options.get("packets", "null"))

    def partitions(self) -> Sequence[Members]:
        """The packets that archive_lines() found in tasks; without these, archives' headers are read here."""
        found = self.packets if self.packets is not None else [p for a in self.archives for p in packets(a, self.pattern, self.skip, *self.most)]
        return [Members(*p) for p in found] or [Members("", 0, 0)]

    def read(self, partition: Members) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in LINES.split(", ")]
        types = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int32(), pa.string(), pa.string())

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

        if not partition.end:
            return
        rows: list[tuple] = []
        with opened(partition.archive) as stream, opened(partition.archive) as heads:
            for member in headers(heads, partition.begin, partition.end):
                day = wanted(member, self.pattern, self.skip)
                if day is None:
                    continue
                name, at, size = member.name, member.offset_data, member.size
                of = (partition.archive, name, day, size)
                try:
                    lines = unpacked(name, stream.read_at(size, at)).decode("utf-8").splitlines()
                    rows += [(*of, k, line, None) for k, line in enumerate(lines)] or [(*of, None, None, "EMPTY")]
                except (OSError, EOFError, ValueError) as error:
                    rows.append((*of, None, None, f"{type(error).__name__}: {error}"))
                if len(rows) >= 10_000:
                    yield batch(rows)
                    rows = []
        if rows:
            yield batch(rows)


class ArchiveMembers(DataSource):
    """Lines of the files inside tar archives. Options: archives (a JSON list of addresses), pattern (of a member's name, with a group
    `day`), skip (a JSON list of days that are left alone), filesPerTask, bytesPerTask, packets (a JSON list of stretches, instead of
    archives). A file that can't be read gives one row with its
    error, an empty one a row that says so."""

    @classmethod
    def name(cls) -> str:
        return "archive_members"

    def schema(self) -> str:
        return LINES

    def reader(self, schema) -> MembersReader:
        return MembersReader(self.options)


def archive_lines(spark: SparkSession, archives: Sequence[str], pattern: str = r"(?P<day>)", skip: Sequence[str] = (), files_per_task: int = FILES_PER_TASK) -> DataFrame:
    """Lines of the archives' files. Tasks read the headers, an archive each; the driver gets a row for every `files_per_task` files."""
    match, days = re.compile(pattern), set(skip)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [p for uri in batch.column("uri").to_pylist() for p in packets(uri, match, days, files_per_task, BYTES_PER_TASK)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*found)) or [()] * 3, (pa.string(), pa.int64(), pa.int64()))], ["uri", "begin", "end"])

    named = spark.createDataFrame(spark.sparkContext.parallelize([(uri,) for uri in archives], max(len(archives), 1)), "uri string")
    found = sorted((r.uri, r.begin, r.end) for r in named.mapInArrow(run, "uri string, begin long, end long").collect())
    spark.dataSource.register(ArchiveMembers)
    reader = spark.read.format("archive_members").option("packets", json.dumps(found)).option("pattern", pattern)
    return reader.option("skip", json.dumps(list(skip))).load()


def pack(rows: DataFrame, folder: str) -> list[str]:
    """rows (archive, member, number, line) as tar archives of bz2 files below `folder`; their addresses.

    Names are those that committed tasks returned. A member's lines stay together; an archive key makes a file for every
    ROWS_PER_ARCHIVE rows, so no task's work grows with the rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = fs.FileSystem.from_uri(folder)
        system.create_dir(path, recursive=True)
        key = member = tar = out = None  # key: of an archive and its part
        lines: list[str] = []
        made = []

        def close_member() -> None:
            if member is not None:
                text = "\n".join(lines).encode()
                raw = bz2.compress(text, min(9, 1 + len(text) // 100_000))  # blocks no larger than the file: both sides set up whole blocks
                info = tarfile.TarInfo(member)
                info.size = len(raw)
                tar.addfile(info, pa.BufferReader(raw))
                lines.clear()

        def close_archive() -> None:
            if tar is not None:
                tar.close()
                out.close()

        for batch in batches:
            for archive, part, name, line in zip(*(batch.column(c).to_pylist() for c in ("archive", "part", "member", "line"))):
                if (archive, part) != key or name != member:
                    close_member()
                    member = name
                if (archive, part) != key:
                    close_archive()
                    key, made = (archive, part), [*made, f"{archive}-{uuid.uuid4().hex}.tar"]
                    out = system.open_output_stream(f"{path}/{made[-1]}")
                    tar = tarfile.open(fileobj=out, mode="w|")
                lines.append(line)
        close_member()
        close_archive()
        yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}" for name in made], pa.string())], ["uri"])

    sizes = {r.archive: -(-r.n // ROWS_PER_ARCHIVE) for r in rows.groupBy("archive").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a key
    parts = F.broadcast(rows.sparkSession.createDataFrame(list(sizes.items()) or [("", 1)], "archive string, parts long"))
    dealt = rows.join(parts, rows["archive"].eqNullSafe(parts["archive"])).select(rows["archive"], "member", "number", "line", F.pmod(F.xxhash64("member"), "parts").alias("part"))
    tasks = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), sum(sizes.values()))
    dealt = dealt.repartition(tasks, "archive", "part").sortWithinPartitions("archive", "part", "member", "number")
    ordered = dealt.select("archive", "part", "member", "line")
    return sorted(r.uri for r in ordered.mapInArrow(run, "uri string").collect())


def by_key(archives: Sequence[str]) -> dict[str, list[str]]:
    """The addresses that pack() made, by their archive key: what belongs to one key lies in all of its files."""
    of: dict[str, list[str]] = {}
    for uri in archives:
        of.setdefault(uri.rsplit("/", 1)[1].rsplit("-", 1)[0], []).append(uri)
    return of


def declared_columns(spark: SparkSession, path: str) -> DataFrame:
    """(file, place, column, kind) of all files: Parquet footers and the first line of CSV files, read in tasks; no data is read.

    The listing is Spark's own; the kind of a CSV column is null, as a header doesn't tell.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length").where("length > 0")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for uri in frame["path"]:
                with opened(uri) as stream:
                    if uri.endswith(".parquet"):
                        rows += [(uri, k, f.name, str(f.type)) for k, f in enumerate(pq.read_schema(stream))]
                    else:
                        head = b""
                        while b"\n" not in head and (more := stream.read(65536)):
                            head += more
                        rows += [(uri, k, name.strip().strip('"'), None) for k, name in enumerate(head.split(b"\n")[0].decode("utf-8-sig").split(","))]
            yield pd.DataFrame(rows, columns=["file", "place", "column", "kind"])

    spread = files.select("path").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    return spread.mapInPandas(run, "file string, place int, column string, kind string")


def schema_drift(declared: DataFrame, group: str) -> DataFrame:
    """(group, column, kind, status) where a group's files differ from the first group's: ADDED, MISSING or RETYPED columns, and MIXED
    ones, of which a group's own files disagree."""
    first = declared.agg(F.min(group).alias("first"))
    one = declared.groupBy(group, "column").agg(F.count_distinct("file").alias("files"), F.min("kind").alias("kind"), F.max("kind").alias("other"))
    sizes = declared.groupBy(group).agg(F.count_distinct("file").alias("all_files"))
    known = one.crossJoin(F.broadcast(first)).where(F.col(group) == F.col("first")).select("column", F.col("kind").alias("first_kind"))  # columns of one group
    expected = sizes.select(group).crossJoin(F.broadcast(known)).withColumn("expected", F.lit(True))  # groups by the columns of one
    both = expected.join(one, [group, "column"], "full_outer").join(sizes, group)
    status = (
        F.when(F.col("files").isNull(), "MISSING").when((F.col("files") < F.col("all_files")) | ~F.col("kind").eqNullSafe(F.col("other")), "MIXED")
        .when(F.col("expected").isNull(), "ADDED").when(~F.col("kind").eqNullSafe(F.col("first_kind")), "RETYPED")
    )
    return both.select(group, "column", "kind", status.alias("status")).where("status is not null")
