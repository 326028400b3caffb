"""Helpers shared by the training-data operators."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Lower-cases nothing; turns ASCII punctuation into spaces, for bag-of-words features.
PUNCT_TO_SPACE = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


#: Rows in an Arrow batch: texts are long, and a Python worker holds a batch several times over.
BATCH_ROWS = 1000


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    In local mode a temporary folder is set where it is unset; a cluster must name one.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="vigilog-shared-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` with the scheme of its file system, for readers and writers outside the JVM."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    full = at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toString()
    return re.sub("^file:/+", "file:///", full).rstrip("/")


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Let Arrow batches hold at most ``rows`` rows from now on."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back (cuts lineage, survives executor loss)."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of a few numbers that are broadcast at most.
BROADCAST_ROWS = 1 << 20


def small_side(df: DataFrame) -> DataFrame:
    """``df`` (written, of a few numbers a row) marked for broadcast if it has at most BROADCAST_ROWS rows, else as it is."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_bucket(col, mod: int):
    """crc32 of the value's text form, modulo ``mod``."""
    return F.crc32(col.cast("string").cast("binary")) % mod


def texts(batch, column: str) -> list[bytes]:
    """A text column of an Arrow batch as UTF-8 bytes, null as empty."""
    import pyarrow as pa

    return [b"" if x is None else x for x in batch.column(column).cast(pa.large_binary()).to_pylist()]


def free_name(df: DataFrame, base: str) -> str:
    """``base``, lengthened until no column of ``df`` has that name (in any case)."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base
