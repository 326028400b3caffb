"""Outputs of a detection: ordered tables written by the executors, and single files that appear whole or not at all, on any file system.

A single file is made of ordered parts, which the executors write into the shared
folder in one job for all tables, and which one task a file then copies together
under a hidden name and renames.  No row passes through the driver.
"""

from __future__ import annotations

import contextlib
import io
import json
import posixpath
import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_path
from .packed import qualified

#: Bytes copied at a time.
PIECE = 4 << 20


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


@contextlib.contextmanager
def _replacing(uri: str):
    """A binary stream whose content replaces the file when it is complete; on an error nothing stays."""
    store, path = _open(uri)
    folder, name = posixpath.split(path)
    store.create_dir(folder, recursive=True)
    part = posixpath.join(folder, f".{name}-{uuid.uuid4().hex}")
    try:
        with store.open_output_stream(part, compression=None) as out:
            yield out
        store.move(part, path)
    except BaseException:
        with contextlib.suppress(OSError):
            store.delete_file(part)
        raise


def write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    with _replacing(qualified(spark, path)) as out:
        out.write(data)


def write_json(spark: SparkSession, path: str, value) -> None:
    write_bytes(spark, path, (json.dumps(value, indent=2, default=str) + "\n").encode())


def _join(folder: str, target: str, header: str) -> int:
    """Copy the parts of a folder, in their order, behind a header line into one file; returns its bytes."""
    from pyarrow import fs

    store, root = _open(folder)
    found = [(int(m[1]), x.path) for x in store.get_file_info(fs.FileSelector(root, allow_not_found=True)) if (m := re.match(r"part-(\d+)", x.base_name))]
    with _replacing(target) as out:
        out.write(header.encode() + b"\n")
        for _, part in sorted(found):
            with store.open_input_stream(part, compression=None) as f:
                while piece := f.read(PIECE):
                    out.write(piece)
        return out.tell()


def _joiner(batches):
    import pyarrow as pa

    for batch in batches:
        yield pa.RecordBatch.from_pydict({"bytes": [_join(*r.values()) for r in batch.to_pylist()]}, schema=pa.schema([("bytes", pa.int64())]))


def write_tables(df: DataFrame, order: list[Column], tables: dict[str, dict[str, Column]], single: bool = True) -> None:
    """Write tab-separated tables with a header, by path the columns of each, with the rows in ``order``.

    ``single`` makes each one file; without it each is a folder of ordered files.
    Tabs and line ends within a cell become a space.
    """
    spark = df.sparkSession
    if not single:
        for path, columns in tables.items():
            places = [f"_order{k}" for k in range(len(order))]
            placed = df.select(*[c.alias(p) for c, p in zip(order, places, strict=True)], *[c.alias(n) for n, c in columns.items()])
            placed.repartitionByRange(*places).sortWithinPartitions(*places).drop(*places).write.mode("overwrite").option("header", True).csv(path, sep="\t")
        return
    cell = lambda c: F.coalesce(F.regexp_replace(c.cast("string"), r"[\t\r\n]+", " "), F.lit(""))
    lines = [F.struct(F.lit(k).alias("table"), F.concat_ws("\t", *map(cell, columns.values())).alias("line")) for k, columns in enumerate(tables.values())]
    places = [f"_{k}" for k in range(len(order))]
    placed = df.select(*[c.alias(p) for c, p in zip(order, places, strict=True)], F.inline(F.array(*lines)))
    parts = f"{shared_path(spark)}/parts-{uuid.uuid4().hex}"
    placed.repartitionByRange(*places).sortWithinPartitions("table", *places).select("table", "line").write.partitionBy("table").text(parts)
    wanted = [(f"{qualified(spark, parts)}/table={k}", qualified(spark, path), "\t".join(columns)) for k, (path, columns) in enumerate(tables.items())]
    if wanted[0][1].startswith("file:") and not spark.sparkContext.master.startswith("local"):
        for x in wanted:  # the driver's own disk, which no task can reach
            _join(*x)
        return
    files = spark.createDataFrame(wanted, "folder string, target string, header string")
    files.repartitionByRange(len(wanted), "folder").mapInArrow(_joiner, "bytes long").count()


def six(col) -> Column:
    """Six decimals as text."""
    return F.format_string("%.6f", col)


def threshold_plot(spark: SparkSession, path: str, scores: list[float], threshold: float) -> bool:
    """The sorted scores and the threshold as a picture; False where the plotting library is missing."""
    try:
        from matplotlib.figure import Figure
    except ImportError:
        return False
    figure = Figure(figsize=(8, 4))
    axes = figure.subplots()
    axes.plot(scores)
    axes.axhline(threshold, linestyle="--")
    axes.set_xlabel("rank")
    axes.set_ylabel("score")
    drawn = io.BytesIO()
    figure.savefig(drawn, format="png")
    write_bytes(spark, path, drawn.getvalue())
    return True
