"""Tables inside archives: members of zip files and gzip files of any name, read in bounded pieces by one task each.

A data source opens each file or member where it is read, unpacks it as a stream
and hands Spark batches of rows; nothing of it passes through the driver but the
first bytes of the first member, which name the columns.  Deflated data can't be
split, so the parallelism is that of files and members.
"""

from __future__ import annotations

import csv
import fnmatch
import gzip
import io
import itertools
import json
import re
import zipfile
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StringType, StructField, StructType

#: Rows, and about so many characters, of a batch.
BATCH_ROWS, BATCH_CHARS = 4096, 1 << 20


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` with the scheme of its file system."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    full = at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toString()
    return re.sub("^file:/+", "file:///", full)


def _stream(path: str, member: str | None):
    """The unpacked bytes of a gzip file or of a zip file's member, and what to close after."""
    from pyarrow import fs

    store, at = fs.FileSystem.from_uri(path)
    handle = store.open_input_file(at)
    if member is None:
        return gzip.GzipFile(fileobj=handle), [handle]
    archive = zipfile.ZipFile(handle)
    return archive.open(member), [archive, handle]


def rows_of(path: str, member: str | None, encoding: str, sep: str, header: bool, width: int) -> Iterator[list[str]]:
    """The records of a delimited file, blank ones skipped, short ones filled with ""; too long ones raise ValueError."""
    packed, after = _stream(path, member)
    try:
        reader = csv.reader(io.TextIOWrapper(packed, encoding=encoding, errors="replace", newline=""), delimiter=sep, skipinitialspace=True)
        records = (r for r in reader if r)
        for r in itertools.islice(records, int(header), None):
            if len(r) > width:
                raise ValueError(f"line {reader.line_num} of {member or path} has {len(r)} fields, expected {width}")
            yield r + [""] * (width - len(r))
    finally:
        for x in (packed, *after):
            x.close()


def lines_of(path: str, member: str | None, encoding: str) -> Iterator[list[str]]:
    packed, after = _stream(path, member)
    try:
        for line in io.TextIOWrapper(packed, encoding=encoding, errors="replace", newline="\n"):
            yield [line.rstrip("\r\n")]
    finally:
        for x in (packed, *after):
            x.close()


def _whole(path: str, member: str | None, encoding: str) -> Iterator[list[str]]:
    packed, after = _stream(path, member)
    try:
        yield [packed.read().decode(encoding, "replace")]
    finally:
        for x in (packed, *after):
            x.close()


class Part(InputPartition):
    def __init__(self, path: str, member: str | None):
        self.path, self.member = path, member


class PackedReader(DataSourceReader):
    def __init__(self, options: dict):
        self.files, self.columns = json.loads(options["files"]), json.loads(options["columns"])
        self.mode, self.encoding = options["mode"], options["encoding"]
        self.sep, self.header = options.get("sep", ","), options.get("header", "false") == "true"

    def partitions(self) -> list[Part]:
        return [Part(p, m) for p, m in self.files]

    def read(self, partition: Part):
        import pyarrow as pa

        at = (partition.path, partition.member, self.encoding)
        records = rows_of(*at, self.sep, self.header, len(self.columns)) if self.mode == "rows" else lines_of(*at) if self.mode == "lines" else _whole(*at)
        names = [f"c{k}" for k in range(len(self.columns))]
        held, size = [], 0

        def batch():
            return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*held, strict=True)], names=names)

        for r in records:
            held.append(r)
            size += sum(map(len, r))
            if len(held) >= BATCH_ROWS or size >= BATCH_CHARS:
                yield batch()
                held, size = [], 0
        if held:
            yield batch()


class PackedSource(DataSource):
    """``spark.read.format("packed")`` with the options files, columns, mode (rows, lines or whole), encoding, sep and header."""

    @classmethod
    def name(cls) -> str:
        return "packed"

    def schema(self) -> StructType:
        return StructType([StructField(f"c{k}", StringType()) for k in range(len(json.loads(self.options["columns"])))])

    def reader(self, schema: StructType) -> PackedReader:
        return PackedReader(dict(self.options))


def _load(spark: SparkSession, files: list[tuple[str, str | None]], columns: list[str], mode: str, encoding: str, sep: str = ",", header: bool = False) -> DataFrame:
    spark.dataSource.register(PackedSource)
    made = spark.read.format("packed").options(files=json.dumps(files), columns=json.dumps(columns), mode=mode, encoding=encoding, sep=sep, header=str(header).lower()).load()
    return made.toDF(*columns)


def unpacked_lines(spark: SparkSession, path: str, encoding: str = "utf-8", whole: bool = False) -> DataFrame:
    """value: the lines of a gzip file whatever its name, or its whole text."""
    return _load(spark, [(qualified(spark, path), None)], ["value"], "whole" if whole else "lines", encoding)


def unpacked_rows(spark: SparkSession, path: str, columns: list[str], sep: str, header: bool, encoding: str = "utf-8") -> DataFrame:
    """The records of a delimited gzip file whatever its name, as strings."""
    return _load(spark, [(qualified(spark, path), None)], columns, "rows", encoding, sep, header)


def distinct_names(found: list[str]) -> list[str]:
    """Trimmed column names, repeated ones numbered."""
    seen: dict[str, int] = {}
    out = []
    for x in map(str.strip, found):
        out.append(x if x not in seen else f"{x}.{seen[x]}")
        seen[x] = seen.get(x, 0) + 1
    return out


def _given(first: list[str], columns: list[str], what: str) -> bool:
    """Whether the first record is a header, where the columns are given; another width raises ValueError."""
    if len(first) != len(columns):
        raise ValueError(f"{what} has {len(first)} columns, expected {len(columns)}")
    return first[0].strip().lower() == columns[0].strip().lower()


def read_zip(spark: SparkSession, path: str, members: str = "*.csv", encoding: str = "utf-8", columns: list[str] | None = None, sep: str = ",") -> DataFrame:
    """The delimited members of a zip file (by a pattern of their names), one task each, as one all-string table.

    With ``columns`` the members may lack a header; else each begins with that of the first.
    """
    from pyarrow import fs

    full = qualified(spark, path)
    store, at = fs.FileSystem.from_uri(full)
    if store.get_file_info(at).type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    with store.open_input_file(at) as handle, zipfile.ZipFile(handle) as archive:
        names = [x.filename for x in archive.infolist() if not x.is_dir() and fnmatch.fnmatch(x.filename, members)]
    if not names:
        raise ValueError(f"{path} has no member like {members}")
    heads = {m: next(_first(full, m, encoding, sep), []) for m in names}
    some = {m: h for m, h in heads.items() if h}
    if not some:
        raise ValueError(f"{path} is empty")
    if columns:
        header = {m: _given(h, columns, m) for m, h in some.items()}
        out = list(columns)
    else:
        out = distinct_names(next(iter(some.values())))
        for m, h in some.items():
            if distinct_names(h) != out:
                raise ValueError(f"{m} has other columns than {next(iter(some))}")
        header = dict.fromkeys(some, True)
    parts = [_load(spark, [(full, m) for m in some if header[m] is h], out, "rows", encoding, sep, h) for h in (True, False) if h in header.values()]
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def _first(path: str, member: str | None, encoding: str, sep: str) -> Iterator[list[str]]:
    packed, after = _stream(path, member)
    try:
        yield from itertools.islice((r for r in csv.reader(io.TextIOWrapper(packed, encoding=encoding, errors="replace", newline=""), delimiter=sep, skipinitialspace=True) if r), 1)
    finally:
        for x in (packed, *after):
            x.close()


def read_shards(spark: SparkSession, paths: list[str], columns: list[str], encoding: str = "UTF-8", sep: str = ",") -> DataFrame:
    """Plain delimited files with or without a header, their columns given, as one all-string table; Spark's own reader splits them.

    Missing files are skipped; if all are, FileNotFoundError is raised.
    """
    fs = spark._jvm.org.apache.hadoop.fs.Path
    conf = spark._jsc.hadoopConfiguration()
    there = [p for p in paths if fs(p).getFileSystem(conf).exists(fs(p))]
    if not there:
        raise FileNotFoundError(", ".join(paths))
    wide = StructType([StructField(f"c{k}", StringType()) for k in range(len(columns) + 1)])  # a field too many shows
    headed = {True: [], False: []}
    for p in there:
        head = spark.read.option("encoding", encoding).option("lineSep", "\n").text(p).filter(F.trim("value") != "").limit(1).collect()
        if head:
            headed[_given(next(csv.reader([head[0][0].rstrip("\r")], delimiter=sep, skipinitialspace=True)), columns, p)].append(p)
    options = {"sep": sep, "encoding": encoding, "escape": '"', "ignoreLeadingWhiteSpace": "true", "enforceSchema": "true"}
    parts = [spark.read.schema(wide).options(**options, header=str(h).lower()).csv(headed[h]) for h in (True, False) if headed[h]]
    if not parts:
        raise ValueError(f"{', '.join(there)}: empty")
    made = parts[0] if len(parts) == 1 else parts[0].union(parts[1])
    last = F.col(f"c{len(columns)}")
    cells = [F.coalesce(F.col(f"c{k}"), F.lit("")).alias(c) for k, c in enumerate(columns)]
    cells[0] = F.when(last.isNotNull(), F.raise_error(F.lit(f"a row has more than {len(columns)} fields"))).otherwise(F.coalesce("c0", F.lit(""))).alias(columns[0])
    return made.select(*cells)
