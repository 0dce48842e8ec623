"""CSV source: NA tokens, type inference, header cleanup, encoding fallback, row order."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.errors import SparkRuntimeException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from limpid.functions.constants import CSV_NULLS, ROW_ID
from limpid.functions.numbers import INTEGER, NUMBER, read_as
from limpid.functions.text import quote, strip
from limpid.operators import scale
from limpid.sources import records


def clean_header(names: list[str]) -> list[str]:
    """Trim names; repeated names get _1, _2, ..."""
    out: list[str] = []
    for name in (n.strip() for n in names):
        n, unique = 0, name
        while unique in out:
            n += 1
            unique = f"{name}_{n}"
        out.append(unique)
    return out


def resolve(spark: SparkSession, data_path: str, filename: str) -> str:
    """`data_path`/`filename` if it exists, else `filename`, else an error.  Globs are allowed."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    for candidate in (f"{data_path.rstrip('/')}/{filename}", filename):
        path = hadoop.Path(candidate)
        found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
        if found:
            return candidate
    raise FileNotFoundError(f"no file at {data_path}/{filename} or {filename}")


def first_csv(spark: SparkSession, data_path: str) -> str | None:
    """Name of the first CSV file of a folder in name order, or None."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    path = hadoop.Path(f"{data_path.rstrip('/')}/*.csv")
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
    names = sorted(s.getPath().getName() for s in found or [])
    return names[0] if names else None


def benchmark_path(spark: SparkSession, folder: str, filename: str) -> str | None:
    """Ground truth for a data set: the same file name, else the first CSV of the folder."""
    try:
        return resolve(spark, folder, filename) if first_csv(spark, folder) else None
    except FileNotFoundError:
        name = first_csv(spark, folder)
        return f"{folder.rstrip('/')}/{name}" if name else None


# Columns that exist only while a file is read.
_BAD = "__record"


class BadRecords(ValueError):
    """Records with more fields than the header."""


@dataclass(frozen=True)
class File:
    """What one pass over the lines tells about a file."""

    path: str
    encoding: str
    broken: bool  # may a quoted field hold a line break?
    head: str  # its first line


def files_of(spark: SparkSession, path: str | list[str], encoding: str = "UTF-8", quote_char: str = '"') -> list[File]:
    """Facts of every file, from one pass over the lines; one row per file is collected.

    A file whose bytes are not valid UTF-8 is latin1; the bytes of its lines decide, so a replacement character in a
    valid file means nothing, and other files keep their encoding.  A line with an odd number of quotes starts or ends a
    field with a line break.
    """
    unicode = encoding.upper() in ("UTF-8", "UTF8")
    lines = spark.read.option("recursiveFileLookup", True).text(path)  # values are the bytes of the file, in any encoding
    quotes = F.octet_length("value") - F.octet_length(F.replace(F.col("value"), F.lit(quote_char), F.lit("")))
    valid = F.is_valid_utf8("value") if unicode else F.lit(True)
    facts = lines.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                         F.monotonically_increasing_id().alias("n"), (quotes % 2 == 1).alias("odd"), valid.alias("valid")) \
        .groupBy("file").agg(F.min_by(F.col("value").cast("binary"), F.struct("block", "n")).alias("head"), F.bool_or("odd").alias("broken"),
                             F.bool_and("valid").alias("valid")).orderBy("file")
    out = []
    for r in facts.collect():
        own = encoding if r["valid"] else "ISO-8859-1"
        out.append(File(r["file"], own, r["broken"], strip_mark(bytes(r["head"]).decode(own))))
    return out


def strip_mark(line: str) -> str:
    """Without a byte order mark and the carriage return of the line end."""
    return line.removeprefix("\ufeff").rstrip("\r")


def _header(spark: SparkSession, path: str, encoding: str, options: dict) -> list[str]:
    """Raw header fields.  Read as data, because the header option renames repeated fields."""
    options = {**options, "header": False, "inferSchema": False}
    first = spark.read.options(**options).option("encoding", encoding).csv(path).first()
    return [v or "" for v in first] if first else []


def read_text_columns(spark: SparkSession, path: str, encoding: str = "UTF-8", bad_records: str = "fail", **options) -> DataFrame:
    """All columns as text under cleaned names, plus the row id.

    The row id is (file, offset of the split in the file, running number), which sorts in file order.  Files are split
    between tasks, also those whose quoted fields hold line breaks (records.read_records; their lines end in \\n or
    \\r\\n).  Only with an escape character other than the quote, or a separator of several characters, such a file is read
    by one task.  Each file is read in its own encoding.  All files must have the same header line.  Records with too
    few fields end in NULLs; records with too many fail the read, unless `bad_records` is "keep": then their first
    fields stay.
    """
    quote_char, sep = options.get("quote", '"'), options.get("sep", ",")
    files = files_of(spark, path, encoding, quote_char)
    heads = {f.head for f in files}
    if len(heads) > 1:
        raise ValueError(f"the files of {path} have different headers: {sorted(heads)[:3]}")
    cuttable = len(sep) == 1 and options.get("escape", quote_char) == quote_char
    first = {**options, "multiLine": True} if files and files[0].broken else options
    names = clean_header(_header(spark, files[0].path, files[0].encoding, first)) if files else []
    fields = [T.StructField(n, T.StringType()) for n in names]
    schema = T.StructType([*fields, T.StructField(_BAD, T.StringType())])
    parsing = {"columnNameOfCorruptRecord": _BAD, "nullValue": "", "emptyValue": "", "escape": '"', **options}
    rid = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                   F.monotonically_increasing_id().alias("row"))

    def read(kind: str, broken: bool) -> DataFrame | None:
        some = [f.path for f in files if f.encoding == kind and f.broken == broken]
        if not some:
            return None
        if broken and cuttable:
            return parse_records(records.read_records(spark, some, kind, sep, quote_char), schema, parsing)
        reader = spark.read.schema(schema).option("header", True).option("enforceSchema", True).option("columnPruning", False).option("encoding", kind)
        return reader.options(**parsing).option("multiLine", broken).csv(some).withColumn(ROW_ID, rid)

    kinds = sorted({f.encoding for f in files})
    parts = [df for df in (read(kind, broken) for kind in kinds for broken in (False, True)) if df is not None]
    if not parts:
        return spark.createDataFrame([], T.StructType(fields)).withColumn(ROW_ID, F.lit(None))
    raw = scale.union_all(parts)
    outside = F.regexp_replace(_BAD, '"[^"]*"', "")
    excess = F.regexp_count(outside, F.lit(re.escape(sep))) >= len(names)
    if bad_records == "keep":
        return raw.drop(_BAD)
    failing = F.raise_error(F.concat(F.lit(f"more fields than the {len(names)} of the header: "), F.left(F.col(_BAD), F.lit(200))))
    checked = F.when(F.col(_BAD).isNotNull() & excess, failing.cast("string")).otherwise(quote(names[0]))
    return raw.withColumn(names[0], checked).drop(_BAD)


def parse_records(rows: DataFrame, schema: T.StructType, parsing: dict) -> DataFrame:
    """The fields of records (file, block, row, text) that follow the header, plus the row id."""
    places = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(schema) - 1)] + [schema[-1]])
    text = F.regexp_replace("text", "\\r$", "")
    options = {k: str(v) for k, v in parsing.items()} | {"multiLine": "true"}
    fields = F.from_csv(text, places.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " "), options)
    rid = F.struct("file", "block", F.col("row").cast("bigint").alias("row")).alias(ROW_ID)
    parsed = rows.where("block > 0 or row > 0").select(fields.alias("f"), rid)
    return parsed.select(*[F.col("f")[p.name].alias(f.name) for p, f in zip(places, schema)], ROW_ID)


def decode_nulls(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Exact NA tokens become NULL; ' None' with a space stays text."""
    names = names or [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    return df.withColumns({c: F.when(quote(c).isin(CSV_NULLS), None).otherwise(quote(c)) for c in names})


def infer_types(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    """The typed table: whole numbers, numbers, booleans, else text; dates stay text.  One scan for all columns."""
    names = names or [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    if not names:
        return df

    v = strip(F.col("v"))
    # Long form: as one wide aggregate the generated code would grow with the columns and stop being compiled.
    long = scale.long_form(df, [(i, quote(c)) for i, c in enumerate(names)], "v")
    whole = F.when(v.rlike(INTEGER), v.try_cast("bigint").isNotNull()).otherwise(False)
    facts = {r["ordinal"]: r for r in long.groupBy("ordinal").agg(
        F.bool_and(whole).alias("whole"), F.bool_and(v.rlike(NUMBER)).alias("number"),
        F.bool_and(v.isin("True", "False", "TRUE", "FALSE", "true", "false")).alias("boolean")).collect()}
    casts = {}
    for i, c in enumerate(names):
        v, found = strip(quote(c)), facts.get(i)
        if found is None:
            casts[c] = F.lit(None).cast("double")
        elif found["whole"]:
            casts[c] = v.try_cast("bigint")
        elif found["number"]:
            casts[c] = v.try_cast("double")
        elif found["boolean"]:
            casts[c] = F.lower(v) == "true"
    return df.withColumns(casts) if casts else df


def load_csv(spark: SparkSession, filename: str, data_path: str = "data/raw", encoding: str = "UTF-8",
             schema: T.StructType | None = None, stage: bool = True, bad_records: str = "fail", **options) -> DataFrame:
    """Read a CSV file with header.

    Types are inferred from all rows unless a schema is given.  Files that are not valid UTF-8 are read
    as latin1, each by its own bytes.  Records with too many fields are an error (BadRecords)
    unless `bad_records` is "keep".  The table is staged once (columnar, typed, with the
    row id frozen), so later passes do not parse text again; `stage=False` keeps it lazy.
    """
    path = resolve(spark, data_path, filename)
    text = read_text_columns(spark, path, encoding, bad_records, **options)
    names = [c for c in text.columns if c != ROW_ID]
    decoded = decode_nulls(text, names)
    try:
        typed = infer_types(decoded, names)
    except SparkRuntimeException as error:
        if error.getCondition() != "USER_RAISED_EXCEPTION":
            raise
        raise BadRecords(error.getMessageParameters()["errorMessage"]) from error
    if schema is not None:
        typed = decoded.withColumns({f.name: read_as(quote(f.name), f.dataType) for f in schema})
    return scale.stage(typed, "csv") if stage else typed


def is_empty(df: DataFrame) -> bool:
    return df.isEmpty()


def missing_columns(df: DataFrame, required: list[str] | None) -> list[str]:
    return [c for c in required or [] if c not in df.columns]


def validate_schema(df: DataFrame, required: list[str] | None = None) -> bool:
    """True if all required columns exist (or none are required)."""
    return not missing_columns(df, required)


def target_column(df: DataFrame) -> str:
    """The default target: the last data column."""
    return [c for c in df.columns if c != ROW_ID][-1]


def safe_name(filename: str) -> str:
    """File name without folder and extension, for report folders."""
    return re.sub(r"\..*$", "", filename.rstrip("/").split("/")[-1])


