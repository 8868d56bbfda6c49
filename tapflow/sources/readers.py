"""Scans (S1-S5): taps from Parquet or CSV with declared types, routes from
CSV with cleaning.

The files of a CSV folder may differ in the order of their columns and in what
other columns they have. The header of every file is read first (one line of
each, on the driver), files of equal headers are one scan with a schema of its
own, and the scans are united by column name. Columns are read as text; a value
that does not fit its type becomes null. A line with fewer or more fields than
its file's header has no certain columns; Spark's parser marks it (PERMISSIVE
with a corrupt-record column), the readers leave it out unless told otherwise,
and ``rejects`` lists it with its text, beside the rows in which a value does
not fit."""

from __future__ import annotations

import csv
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapflow.functions import parse_date, strip, zero_pad
from tapflow.model import ROUTE_DATE_FORMAT, RouteColumns, TapColumns

# The declared columns of the card-data export (physical names).
TAP_SCHEMA = T.StructType([
    T.StructField("ALIGHTING_STOP_STN", T.StringType()),
    T.StructField("BOARDING_STOP_STN", T.StringType()),
    T.StructField("BUS_REG_NUM", T.StringType()),
    T.StructField("Bus_Trip_Num", T.StringType()),
    T.StructField("Direction", T.IntegerType()),
    T.StructField("JOURNEY_ID", T.LongType()),
    T.StructField("Ride_Distance", T.DoubleType()),
    T.StructField("TRAVEL_MODE", T.StringType()),
    T.StructField("Year", T.IntegerType()),
    T.StructField("tap_in_time", T.TimestampType()),
    T.StructField("tap_out_time", T.TimestampType()),
    T.StructField("Srvc_Number", T.StringType()),
    T.StructField("Date", T.DateType()),
])

def read_taps_parquet(spark: SparkSession, path: str, cols: TapColumns = TapColumns()) -> DataFrame:
    """Parquet taps, projected to logical names at the scan (only the
    mapped columns are read; filters on them push into the scan)."""
    return cols.standardise(spark.read.parquet(path))

# Names that the scans use beside the columns of the files.
MALFORMED, FILE = "_malformed_line", "_file"


def csv_headers(spark: SparkSession, path: str) -> dict[tuple[str, ...], list[str]]:
    """The files under ``path`` (a file, folder or pattern) by their header.
    Spark lists the files; the first line that is not blank is read of each,
    through the file system and codec that Spark would use. A file without
    lines has no header and is left out."""
    conf, jvm = spark.sparkContext._jsc.hadoopConfiguration(), spark._jvm
    codecs = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf)

    def header(file: str) -> tuple[str, ...] | None:
        at = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(file))
        stream, codec = at.getFileSystem(conf).open(at), codecs.getCodec(at)
        lines = jvm.java.io.BufferedReader(
            jvm.java.io.InputStreamReader(codec.createInputStream(stream) if codec else stream, "UTF-8"))
        try:
            while (line := lines.readLine()) is not None:
                if line.strip():
                    return tuple(name.strip() for name in next(csv.reader([line.lstrip("\ufeff")])))
        finally:
            lines.close()
        return None

    files = sorted(spark.read.format("text").load(path).inputFiles())
    with ThreadPoolExecutor(16) as pool:
        found: dict[tuple[str, ...], list[str]] = {}
        for file, names in zip(files, pool.map(header, files)):
            if names:
                found.setdefault(names, []).append(file)
    return found


def _unescaped(file: str) -> str:
    """The path of a file URI as Spark's readers take it."""
    from urllib.parse import unquote
    return unquote(file)


def scan_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """All lines of a CSV file or folder as text columns, by name, with
    ``MALFORMED`` (the text of a line whose number of fields is not that of its
    header, else null) and ``FILE``. Raises if a file lacks one of ``columns``;
    of several columns of one name the first is taken."""
    headers = csv_headers(spark, path)
    lacking = [f"{files[0]}{f' and {len(files) - 1} more' if len(files) > 1 else ''}: no column "
               f"{', '.join(sorted(set(columns) - set(names)))}; the header has {', '.join(names)}"
               for names, files in headers.items() if not set(columns) <= set(names)]
    if lacking:
        raise ValueError("; ".join(lacking))
    if not headers:
        raise ValueError(f"{path}: no file with a header")
    parts = []
    for names, files in headers.items():
        schema = T.StructType([T.StructField(f"_{i}", T.StringType()) for i in range(len(names))]
                              + [T.StructField(MALFORMED, T.StringType())])
        rows = (spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE")
                .option("columnNameOfCorruptRecord", MALFORMED)
                # the parser counts the fields of the columns it reads: it must read them all
                .option("columnPruning", False).csv([_unescaped(f) for f in files]))
        parts.append(rows.select(*[F.col(f"_{names.index(c)}").alias(c) for c in columns], MALFORMED,
                                 F.col("_metadata.file_path").alias(FILE)))
    return reduce(DataFrame.unionByName, parts)


def _well_formed(rows: DataFrame, malformed: str) -> DataFrame:
    """``drop`` leaves malformed lines out, ``keep`` takes the fields that
    they have, ``fail`` raises when one is met."""
    if malformed not in ("drop", "keep", "fail"):
        raise ValueError("malformed must be drop, keep or fail")
    if malformed == "drop":
        rows = rows.filter(F.col(MALFORMED).isNull())
    if malformed == "fail":
        rows = rows.filter(F.when(F.col(MALFORMED).isNull(), F.lit(True)).otherwise(
            F.raise_error(F.concat(F.lit("malformed line in "), FILE, F.lit(": "), MALFORMED)).cast("boolean")))
    return rows.drop(MALFORMED, FILE)


def _typed(field: T.StructField, timestamp_format: str | None) -> F.Column:
    text = F.when(F.trim(F.col(f"`{field.name}`")) != "", F.trim(F.col(f"`{field.name}`")))
    if isinstance(field.dataType, T.TimestampType) and timestamp_format:
        return F.try_to_timestamp(text, F.lit(timestamp_format))
    return F.col(f"`{field.name}`") if isinstance(field.dataType, T.StringType) else text.try_cast(field.dataType)


def read_taps_csv(spark: SparkSession, path: str, cols: TapColumns = TapColumns(),
                  schema: T.StructType = TAP_SCHEMA, timestamp_format: str | None = None,
                  malformed: str = "drop") -> DataFrame:
    """CSV taps with headers; columns by name, typed by ``schema``."""
    raw = _well_formed(scan_csv(spark, path, schema.names), malformed)
    return cols.standardise(raw.select(*[_typed(f, timestamp_format).alias(f.name) for f in schema]))


def rejects(spark: SparkSession, path: str, schema: T.StructType = TAP_SCHEMA,
            timestamp_format: str | None = None) -> DataFrame:
    """What the typed columns do not show, as text: rows in which a value does
    not fit its type, with the names of those columns in ``bad_columns``, and
    malformed lines, with their whole text in ``MALFORMED`` and the columns as
    the parser filled them. ``FILE`` tells where."""
    raw = scan_csv(spark, path, schema.names)
    bad = [F.when((F.trim(F.col(f"`{f.name}`")) != "") & _typed(f, timestamp_format).isNull(), F.lit(f.name))
           for f in schema]
    return (raw.withColumn("bad_columns", F.array_compact(F.array(*bad)))
            .filter((F.size("bad_columns") > 0) | F.col(MALFORMED).isNotNull()))


WIDER = ["boolean", "int", "bigint", "double"]  # inferred types that widen to the right, but for boolean


def read_csv_inferred(spark: SparkSession, path: str) -> DataFrame:
    """S3: CSV with an inferred schema (an extra pass over the files; prefer a
    declared schema for large inputs). Files of one header are inferred
    together; a column that the groups infer differently takes the wider
    numeric type, or text as it stands. Columns that some files lack are null
    there; the order of columns is that of the first file."""
    headers = csv_headers(spark, path)
    read = spark.read.option("header", True)
    groups = [(read.option("inferSchema", True).csv([_unescaped(f) for f in files]).schema, files)
              for files in headers.values()]
    types: dict[str, set[str]] = {}
    for schema, _ in groups:
        for f in schema:
            types.setdefault(f.name, set()).add(f.dataType.simpleString())

    def common(found: set[str]) -> str:
        if len(found) == 1:
            return next(iter(found))
        return max(found, key=WIDER.index) if found <= set(WIDER[1:]) else "string"

    parts = [spark.read.option("header", True)
             .schema(T.StructType([T.StructField(f.name, T._parse_datatype_string(common(types[f.name]))) for f in schema]))
             .csv([_unescaped(f) for f in files]) for schema, files in groups]
    if not parts:
        raise ValueError(f"{path}: no file with a header")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def clean_routes(raw: DataFrame, cols: RouteColumns = RouteColumns(),
                 date_format: str = ROUTE_DATE_FORMAT) -> DataFrame:
    """S4 cleaning on text columns: service trimmed (F1), stop code zero
    padded to five characters but never truncated (F2), validity dates
    parsed with ``date_format`` (F3), numbers cast leniently."""
    return raw.select(
        strip(cols.service).alias("service"),
        F.expr(f"try_cast(trim(`{cols.direction}`) as int)").alias("direction"),
        zero_pad(strip(cols.stop)).alias("stop"),
        F.expr(f"try_cast(trim(`{cols.seq}`) as bigint)").alias("seq"),
        F.expr(f"try_cast(trim(`{cols.km}`) as double)").alias("km"),
        parse_date(strip(cols.dt_from), date_format).alias("dt_from"),
        parse_date(strip(cols.dt_to), date_format).alias("dt_to"),
    )


def read_routes_csv(spark: SparkSession, path: str, cols: RouteColumns = RouteColumns(),
                    date_format: str = ROUTE_DATE_FORMAT, malformed: str = "drop") -> DataFrame:
    """Route CSV with headers, columns by name, cleaned."""
    names = [cols.service, cols.direction, cols.stop, cols.seq, cols.km, cols.dt_from, cols.dt_to]
    return clean_routes(_well_formed(scan_csv(spark, path, names), malformed), cols, date_format)
