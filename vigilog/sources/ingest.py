"""Reading logs as all-string tables, inferring column roles from values, expanding URLs and typing."""

from __future__ import annotations

import csv
import io
import json
import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates
from ..functions.text import is_missing
from ..operators.counts import column_counts
from ..session import materialise
from .packed import distinct_names, unpacked_lines, unpacked_rows

SAMPLE = 1000
PARSE_RATE, URL_RATE = 0.95, 0.70
HEAD_BYTES = 64 << 10
#: A URL column of more distinct parameters keeps them in a map instead of a column each.
MAX_KEYS = 1000

# Boolean tokens and timestamp formats (strptime form and the pattern Spark reads it with).
TRUE, FALSE = {"true", "yes", "t", "y"}, {"false", "no", "f", "n"}
FORMATS = [
    ("%Y-%m-%d %H:%M:%S", "yyyy-M-d H:m:s"), ("%Y-%m-%dT%H:%M:%S", "yyyy-M-d'T'H:m:s"), ("%Y-%m-%dT%H:%M:%S%z", "yyyy-M-d'T'H:m:s[XXX][XX]"), ("%Y-%m-%d %H:%M", "yyyy-M-d H:m"),
    ("%Y-%m-%d", "yyyy-M-d"), ("%Y/%m/%d %H:%M:%S", "yyyy/M/d H:m:s"), ("%d/%m/%Y %H:%M:%S", "d/M/yyyy H:m:s"), ("%m/%d/%Y %H:%M:%S", "M/d/yyyy H:m:s"),
    ("%d-%m-%Y %H:%M:%S", "d-M-yyyy H:m:s"), ("%d %b %Y %H:%M:%S", "d MMM yyyy H:m:s"), ("%Y-%m-%d %H:%M:%S.%f", "yyyy-M-d H:m:s.[SSSSSS][SSSSS][SSSS][SSS][SS][S]"),
    ("%Y-%m-%dT%H:%M:%S.%f", "yyyy-M-d'T'H:m:s.[SSSSSS][SSSSS][SSSS][SSS][SS][S]"), ("%Y-%m-%dT%H:%M:%S.%f%z", "yyyy-M-d'T'H:m:s.[SSSSSS][SSSSS][SSSS][SSS][SS][S][XXX][XX]"),
    ("%Y/%m/%d %H:%M:%S.%f", "yyyy/M/d H:m:s.[SSSSSS][SSSSS][SSSS][SSS][SS][S]"), ("%d/%b/%Y:%H:%M:%S %z", "d/MMM/yyyy:H:m:s XX"), ("%d/%b/%Y:%H:%M:%S", "d/MMM/yyyy:H:m:s"), ("%d.%m.%Y %H:%M:%S", "d.M.yyyy H:m:s"),
]
#: The format of a column of dates of several or of other forms.
MIXED = "mixed"
URL = re.compile(r"^[a-z][a-z0-9+.\-]*://\S+|\?\S*=", re.I)
NUMBER = re.compile(r"^\s*[+-]?(\d+\.?\d*([eE][+-]?\d+)?|\.\d+([eE][+-]?\d+)?|inf|nan)\s*$", re.I)


@dataclass(frozen=True)
class Column:
    name: str
    role: str
    n_unique: int
    n_missing: int
    ratio: float
    examples: tuple = ()
    format: str | None = None
    derived_from: str | None = None
    subtype: str | None = None
    entity: bool = False
    content: bool = False

    def to_dict(self) -> dict:
        return {"name": self.name, "role": self.role, "n_unique": self.n_unique, "n_missing": self.n_missing, "cardinality_ratio": round(self.ratio, 4), "examples": list(self.examples), "derived_from": self.derived_from, "datetime_format": self.format, "numeric_subtype": self.subtype}


@dataclass(frozen=True)
class Schema:
    columns: list[Column] = field(default_factory=list)
    n_rows: int = 0
    primary_timestamp: str | None = None
    row_id: str | None = None

    def with_role(self, role: str) -> list[Column]:
        return [c for c in self.columns if c.role == role]

    def to_dict(self) -> dict:
        return {"n_rows": self.n_rows, "primary_timestamp": self.primary_timestamp, "row_id": self.row_id, "columns": [c.to_dict() for c in self.columns]}

    def describe(self) -> str:
        return "\n".join(f"{c.name}: {c.role} ({c.n_unique} distinct, {c.n_missing} missing, ratio {round(c.ratio, 4)})" for c in self.columns)


def head_of(spark: SparkSession, path: str) -> tuple[bytes, bool]:
    """The first HEAD_BYTES of a file, or of the first file by name of a folder; True if it is gzip by its magic bytes."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(at):
        raise FileNotFoundError(path)
    if fs.getFileStatus(at).isDirectory():
        files = sorted((f for f in fs.listStatus(at) if f.isFile() and not f.getPath().getName().startswith(("_", "."))), key=lambda f: f.getPath().getName())
        if not files:
            return b"", False
        at = files[0].getPath()
    stream = fs.open(at)
    try:
        raw = bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream, min(HEAD_BYTES, fs.getFileStatus(at).getLen())))
    finally:
        stream.close()
    if raw[:2] == b"\x1f\x8b":
        import zlib

        return zlib.decompressobj(wbits=31).decompress(raw), True
    return raw, False


def _sniff(sample: str) -> str:
    """The delimiter of the sample; where none shows, the tab or the comma by their number."""
    try:
        return csv.Sniffer().sniff(sample, ",\t;|").delimiter
    except csv.Error:
        return "\t" if sample.count("\t") > sample.count(",") else ","


def _json_lines(sample: str) -> bool:
    """Two lines or more, of which the first twenty are JSON and two are objects."""
    found = []
    for line in [x for x in sample.splitlines() if x.strip()][:20]:
        try:
            found.append(isinstance(json.loads(line), dict))
        except ValueError:
            return False
    return sum(found) >= 2


def detect_format(path: str, sample: str) -> str:
    """csv, tsv, json or jsonl, by the name and else by the first sign and the delimiter."""
    name = re.sub(r"\.gz$", "", path.lower().rstrip("/"))
    if name.endswith((".jsonl", ".ndjson")):
        return "jsonl"
    if name.endswith((".tsv", ".tab")):
        return "tsv"
    if name.endswith(".csv"):
        return "csv"
    first = sample.lstrip()[:1]
    if name.endswith(".json") or first == "{":
        return "jsonl" if _json_lines(sample) else "json"
    if first == "[":
        return "json"
    return "tsv" if _sniff(sample) == "\t" else "csv"


BAD = "_not_json"


def first_bad_line(lines: DataFrame) -> int | None:
    """The number, from 1 in its file, of the first line that isn't JSON (blank ones are), from lines as (file, block, value).

    The lines of each block are counted where they are read; only the counts meet.
    """
    broken = (F.trim("value") != "") & F.from_json("value", f"{BAD} string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BAD})[BAD].isNotNull()
    placed = lines.select("file", "block", broken.alias("broken")).withColumn("at", F.monotonically_increasing_id())
    per = placed.groupBy("file", "block").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"), F.min(F.when(F.col("broken"), F.col("at"))).alias("hit"))
    found = per.filter("hit is not null").orderBy("file", "block").first()
    if found is None:
        return None
    before = per.filter((F.col("file") == found.file) & (F.col("block") < found.block)).agg(F.sum("n")).first()[0] or 0
    return before + found.hit - found.first + 1


def _read_json(spark: SparkSession, path: str, fmt: str, sample: str, packed: bool) -> DataFrame:
    options = {"mode": "PERMISSIVE", "primitivesAsString": "true", "columnNameOfCorruptRecord": BAD}
    if fmt == "json" and sample.lstrip()[:1] not in ("[", "{"):
        raise ValueError("Unsupported JSON structure; expected an array or object")
    if packed:
        text = unpacked_lines(spark, path, whole=fmt == "json")
        df = spark.read.options(**options).json(text.rdd.map(lambda r: r.value))
    else:
        df = spark.read.options(**options, multiLine=str(fmt == "json").lower()).json(path)
    if BAD in df.columns:
        if fmt == "json":
            raise ValueError(f"{path} is not valid JSON")
        if packed:
            lines = text.select(F.lit("").alias("file"), F.lit(0).cast("long").alias("block"), "value")
        else:
            lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")
        number = first_bad_line(lines)
        if number is not None:
            raise ValueError(f"Line {number} is not valid JSON")
        df = df.drop(BAD)
    names = [c for c in dict.fromkeys(re.findall(r'"((?:[^"\\]|\\.)*)"\s*:', sample)) if c in df.columns]
    df = df.select(*[F.col(f"`{c}`") for c in names + [c for c in df.columns if c not in names]])
    if fmt == "json" and sample.lstrip()[:1] == "{":
        lists = [f.name for f in df.schema.fields if f.dataType.typeName() == "array" and f.dataType.elementType.typeName() == "struct"]
        if lists:
            df = df.select(F.inline(F.col(f"`{lists[0]}`")))
    return _flat(df)


def read_table(spark: SparkSession, path: str) -> tuple[DataFrame, str]:
    """All-string table, missing cells as "", and its format.  Empty files, lines that aren't JSON and JSON that is no table raise ValueError."""
    head, zipped = head_of(spark, path)
    sample = head.decode("utf-8", "replace")
    if not sample.strip():
        raise ValueError(f"{path} is empty")
    fmt = detect_format(path, sample)
    # Spark picks the codec by the name; a misnamed file is unpacked as a stream
    packed = zipped and not path.endswith(".gz")
    if fmt in ("json", "jsonl"):
        return _read_json(spark, path, fmt, sample, packed), fmt
    sep = "\t" if fmt == "tsv" else _sniff(sample)
    try:
        header = csv.Sniffer().has_header(sample)
    except csv.Error:
        header = True
    first = next(r for r in csv.reader(io.StringIO(sample, newline=""), delimiter=sep) if r)
    names = distinct_names(first) if header else [f"col{i}" for i in range(len(first))]
    if packed:
        return unpacked_rows(spark, path, names, sep, header), fmt
    lines = [x for x in sample.splitlines()[:50] if x.strip()]
    quoted_newline = any(x.count('"') % 2 for x in lines[:-1])
    # one column more than there are names: a record of too many fields is an error, not cut
    ddl = ", ".join(f"c{i} string" for i in range(len(names) + 1))
    df = spark.read.schema(ddl).csv(path, sep=sep, header=header, escape='"', multiLine=quoted_newline, enforceSchema=True, encoding="UTF-8")
    cells = [F.coalesce(F.col(f"c{i}"), F.lit("")) for i in range(len(names))]
    cells[0] = F.when(F.col(f"c{len(names)}").isNotNull(), F.raise_error(F.lit(f"{path}: a record has more than {len(names)} fields"))).otherwise(cells[0])
    return df.select(*[c.alias(n) for c, n in zip(cells, names, strict=True)]), fmt


def _flat(df: DataFrame) -> DataFrame:
    """Nested structs as dotted string columns; arrays and maps as their JSON text."""
    out = []

    def walk(col, name, kind):
        if kind.typeName() == "struct":
            for f in kind.fields:
                walk(col[f.name], f"{name}.{f.name}" if name else f.name, f.dataType)
        else:
            text = F.to_json(col) if kind.typeName() in ("array", "map") else col.cast("string")
            out.append(F.coalesce(text, F.lit("")).alias(name))

    for f in df.schema.fields:
        walk(F.col(f"`{f.name}`"), f.name, f.dataType)
    return df.select(*out)


def expand_urls(df: DataFrame, columns: list[str], order: str | None = None, max_keys: int = MAX_KEYS) -> DataFrame:
    """Add ``<c>__path`` and ``<c>__<param>`` for every key seen in any row, by first appearance in ``order``; the last duplicate of a key wins.

    A column of more than ``max_keys`` keys gets one map ``<c>__params`` of all of a row's parameters instead.
    """
    for c in columns:
        query = F.regexp_extract(F.coalesce(c, F.lit("")), r"\?([^#]*)", 1)
        pair = lambda p: F.struct(F.try_url_decode(F.substring_index(p, "=", 1)).alias("k"), F.try_url_decode(F.regexp_extract(p, "=(.*)", 1)).alias("v"))
        pairs = F.transform(F.filter(F.split(query, "&"), lambda p: p.contains("=") | (p != "")), pair)
        df = df.withColumn("_pairs", pairs)
        placed = df.select(F.col(order).alias("_at") if order else F.monotonically_increasing_id().alias("_at"), "_pairs")
        seen = placed.select("_at", F.posexplode("_pairs").alias("pos", "p")).groupBy(F.col("p.k").alias("k")).agg(F.min(F.struct("_at", "pos")).alias("at")).filter("k <> ''")
        found = seen.orderBy("at").limit(max_keys + 1).collect()
        keys = [r.k for r in found] if len(found) <= max_keys else []
        path = F.regexp_extract(F.coalesce(c, F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)?([^?#]*)", 1)
        last = lambda k: F.coalesce(F.get(F.reverse(F.transform(F.filter("_pairs", lambda p: p["k"] == k), lambda p: p["v"])), F.lit(0)), F.lit(""))
        new = [("path", path)] * ("path" not in keys) + [(k, last(k)) for k in keys]
        if len(found) > max_keys:
            own = F.array_distinct(F.filter(F.transform("_pairs", lambda p: p["k"]), lambda k: k != ""))
            new.append(("params", F.map_from_arrays(own, F.transform(own, last))))
        made, taken = [], set(df.columns)
        for name, col in new:
            full, n = f"{c}__{name}", 0
            while full in taken:
                n += 1
                full = f"{c}__{name}_{n}"
            taken.add(full)
            made.append(col.alias(full))
        df = df.select(*[F.col(f"`{x}`") for x in df.columns if x != "_pairs"], *made)
    return df


def _parses(value: str, form: str) -> bool:
    from datetime import datetime

    try:
        datetime.strptime(value.strip(), form)
    except ValueError:
        return False
    return True


def _timestamp_format(values: list[str]) -> str | None:
    """The pattern of the first format that 95 % of the values follow, ``mixed`` if as many are dates of any form."""
    if sum(bool(re.search(r"[^0-9.]", v)) for v in values) < 0.5 * len(values):
        return None
    for form, java in FORMATS:
        if sum(_parses(v, form) for v in values) >= PARSE_RATE * len(values):
            return java
    if sum(dates.parse_one(v) is not None for v in values) >= PARSE_RATE * len(values):
        return MIXED
    return None


def _subtype(values: list[str]) -> str:
    """int if every number of the values is whole."""
    numbers = [float(v) for v in values if NUMBER.match(v)]
    return "int" if all(x % 1 == 0 for x in numbers if abs(x) < float("inf")) else "float"


def role_of(values: list[str], n_unique: int, ratio: float) -> tuple[str, str | None]:
    """Role and timestamp pattern from the first non-missing values and the column's counts."""
    if not values:
        return "text", None
    lower = {v.strip().lower() for v in values}
    if n_unique <= 2 and lower <= TRUE | FALSE:
        return "boolean", None
    if sum(bool(URL.search(v)) for v in values) >= URL_RATE * len(values):
        return "url", None
    if found := _timestamp_format(values):
        return "timestamp", found
    if sum(bool(NUMBER.match(v)) for v in values) >= PARSE_RATE * len(values):
        return "numeric", None
    token = sum(bool(re.match(r"^\S{1,64}$", v)) for v in values) >= 0.9 * len(values)
    if ratio >= 0.95 and token:
        return "identifier", None
    if n_unique <= 50 or ratio <= 0.20:
        return "categorical", None
    return "text", None


def _first(df: DataFrame, n: int, order: str | None) -> DataFrame:
    """The first ``n`` rows by ``order``, a row number that counts from 0 in the first partition."""
    if order is None:
        return df.limit(n)
    near = df.filter(F.col(order) < n)  # all from the first partition, which mostly has as many
    return (near if near.count() == n else df).orderBy(order).limit(n)


def _samples(df: DataFrame, columns: dict, order: str | None = None) -> dict[str, list[str]]:
    """The first SAMPLE non-missing values of each column: from the first rows, and by a job of its own for a column that has fewer there."""
    head = _first(df, 5 * SAMPLE, order).select(*[v.alias(c) for c, v in columns.items()]).collect()
    out = {c: [r[i] for r in head if r[i] is not None][:SAMPLE] for i, c in enumerate(columns)}
    if len(head) == 5 * SAMPLE:
        for c in (c for c, found in out.items() if len(found) < SAMPLE):
            some = df.filter(columns[c].isNotNull())
            out[c] = [r[0] for r in (some.orderBy(order) if order else some).limit(SAMPLE).select(columns[c]).collect()]
    return out


def _map_column(df: DataFrame, name: str, rows: int, derived: str | None) -> Column:
    """A map's entry: its distinct keys and the rows without any."""
    keys = df.select(F.explode(F.map_keys(F.col(f"`{name}`"))).alias("k")).distinct().count()
    empty = df.filter(F.coalesce(F.size(F.col(f"`{name}`")), F.lit(0)) < 1).count()
    return Column(name, "map", keys, empty, keys / max(1, rows - empty), derived_from=derived)


def infer_schema(df: DataFrame, entity: tuple = (), content: tuple = (), timestamp: str | None = None, derived: dict | None = None, order: str | None = None) -> Schema:
    """Roles of an all-string table: the value counts of all columns by one aggregation, and a bounded sample of its first rows by ``order``.  Maps have the role map."""
    maps = [f.name for f in df.schema.fields if f.dataType.typeName() == "map"]
    names = [c for c in df.columns if c not in maps and c != order]
    unknown = {*entity, *content, *([timestamp] if timestamp else [])} - set(names)
    overlap = (set(entity) & set(content)) | ({timestamp} & {*entity, *content})
    if unknown or overlap:
        raise ValueError(f"overrides name unknown or overlapping columns: {sorted(unknown or overlap)}")
    present = {c: F.when(~is_missing(F.col(f"`{c}`")), F.col(f"`{c}`")) for c in names}
    clean = df.select(*[v.alias(c) for c, v in present.items()])
    counts = column_counts(clean, names).groupBy("column").agg(F.count("value").alias("u"), F.coalesce(F.sum(F.when(F.col("value").isNotNull(), F.col("c"))), F.lit(0)).alias("n"), F.sum("c").alias("rows"))
    stats = {r["column"]: r for r in counts.collect()}
    samples = _samples(df, present, order)
    rows = max((r.rows for r in stats.values()), default=0)
    columns = []
    for c in names:
        values, unique, held = samples[c], stats[c].u if c in stats else 0, stats[c].n if c in stats else 0
        ratio = unique / held if held else 0.0
        role, pattern = role_of(values, unique, ratio)
        if c in entity:
            role, pattern = "categorical", None
        if c == timestamp:
            pattern = _timestamp_format(values) if values else None
            if pattern is None:
                raise ValueError(f"{c} does not parse as a timestamp")
            role = "timestamp"
        columns.append(Column(c, role, unique, rows - held, ratio, tuple(values[:5]), pattern, (derived or {}).get(c), _subtype(values) if role == "numeric" else None, c in entity, c in content))
    columns += [_map_column(df, c, rows, (derived or {}).get(c)) for c in maps]
    stamps = [c for c in columns if c.role == "timestamp"]
    primary = timestamp or (min(stamps, key=lambda c: c.n_missing).name if stamps else None)
    ids = sorted((c for c in columns if c.role == "identifier"), key=lambda c: ("id" not in c.name.lower(), -c.ratio))
    return Schema(columns, rows, primary, ids[0].name if ids else None)


def typed(df: DataFrame, schema: Schema, row_number: str | None = None) -> DataFrame:
    """Columns cast by role, and the row number if it is named; what does not parse becomes null."""
    out = [F.col(row_number)] if row_number else []
    for c in schema.columns:
        v = F.col(f"`{c.name}`")
        if c.role == "map":
            out.append(v)
            continue
        v = F.when(~is_missing(v), F.trim(v) if c.role in ("numeric", "timestamp", "boolean") else v)
        if c.role == "timestamp":
            v = dates.parse(v) if c.format == MIXED else F.try_to_timestamp(v, F.lit(c.format))
        elif c.role == "numeric":
            v = F.when(v.rlike(NUMBER.pattern.replace("inf|nan", "(?i)inf|nan")), v).try_cast("double")
        elif c.role == "boolean":
            v = F.when(F.lower(v).isin(*TRUE), True).when(F.lower(v).isin(*FALSE), False)
        out.append(v.alias(c.name))
    return df.select(*out)


def load(source, path: str | DataFrame, expand: bool = True, entity: tuple = (), content: tuple = (), timestamp: str | None = None, row_number: str | None = None) -> tuple[DataFrame, Schema]:
    """Read ``path`` (or take an all-string table), expand URLs, infer and type; ``source`` is the session.

    The source is read once (JSON once more for its fields) and written with its
    row numbers; all further steps read single columns of that table.
    ``row_number`` names a column for these numbers, which rise in the source's order.
    """
    raw = path.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in path.columns]) if isinstance(path, DataFrame) else read_table(source, path)[0]
    order = row_number or "_rid"
    while order in raw.columns and row_number is None:
        order += "_"
    raw = materialise(raw.withColumn(order, F.monotonically_increasing_id()), "raw")
    derived = {}
    if expand:
        before = [c for c in raw.columns if c != order]
        for c in [x.name for x in infer_schema(raw, order=order).with_role("url")]:
            held = set(raw.columns)
            raw = expand_urls(raw, [c], order)
            derived |= {x: c for x in raw.columns if x not in held}
        raw = raw.select(order, *[F.col(f"`{c}`") for c in [*before, *(c for c in raw.columns if c not in before and c != order)]])
    schema = infer_schema(raw, entity, content, timestamp, derived, order)
    return typed(raw, schema, row_number), schema
