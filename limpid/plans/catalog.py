"""Profile, issues and cleaning plan of every CSV file of a folder, whatever their columns.

All files are one table of rows (file, place, fields) and one table of value counts by (file, column), so the number of
jobs does not depend on the number of files or schemas, and a file with most of the rows is spread like any other.
Statistics mean what they mean in operators.profile; the result tables have one more column, `file`.
"""

from __future__ import annotations

import csv as plain_csv
import io
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from limpid.functions import numbers, text
from limpid.functions.constants import CODE_SUFFIXES, CSV_NULLS, DELIMITERS, PLACEHOLDERS, SAMPLE_VALUES, SPLIT_SAMPLE, TOP_VALUES
from limpid.operators import profile as profiling
from limpid.operators import scale
from limpid.plans import issues as issue_rules
from limpid.plans import planner
from limpid.sources import csv, records

FILE = "file"
#: The type names of a profile, by what all values of a column are.
WHOLE, NUMBER, BOOLEAN, OTHER = "int64", "float64", "bool", "object"


@dataclass(frozen=True)
class Catalog:
    """One row per file and column, per file, per finding and per step."""

    columns: DataFrame
    tables: DataFrame
    issues: DataFrame
    steps: DataFrame


# --- rows ----------------------------------------------------------------------------------------

def read_rows(spark: SparkSession, path: str, encoding: str = "UTF-8", sep: str = ",", quote: str = '"') -> tuple[DataFrame, DataFrame]:
    """(rows, schemas) of all files below `path`.

    rows: file, schema, block, row (the place in the file), fields (array of text, NA tokens null).  schemas: schema,
    ordinal, column.  Files with the same header line share a schema; the driver sees every distinct header once.
    Missing fields are null and excess fields are left out.  Every file is read in its own encoding and in parallel,
    quoted line breaks or not."""
    rows, schemas, paths = _numbered_rows(spark, path, encoding, sep, quote)
    return _named(rows, paths), schemas


def _named(df: DataFrame, paths: DataFrame) -> DataFrame:
    """The path of a file instead of its number."""
    return df.withColumnRenamed(FILE, "number").join(F.broadcast(paths), "number").select(FILE, *[c for c in df.columns if c != FILE])


def _numbered_rows(spark: SparkSession, path: str, encoding: str, sep: str, quote: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """read_rows with a number in place of the path, so that no group or join carries paths, and (number, file)."""
    files = csv.files_of(spark, path, encoding, quote)
    parts = []
    for kind, broken in sorted({(f.encoding, f.broken) for f in files}):
        some = [f.path for f in files if (f.encoding, f.broken) == (kind, broken)]
        if broken:
            parts.append(records.read_records(spark, some, kind, sep, quote))
        else:
            plain = spark.read.text(some).select(
                F.col("_metadata.file_path").alias(FILE), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"),
                records.decoded(F.col("value"), kind).alias("text"))
            parts.append(plain.where(F.trim("text") != ""))
    if not parts:
        return (scale.local_table(spark, [], f"{FILE} int, schema int, block bigint, row bigint, fields array<string>"),
                scale.local_table(spark, [], "schema int, ordinal int, column string"), scale.local_table(spark, [], f"number int, {FILE} string"))
    paths = scale.local_table(spark, [(i, f.path) for i, f in enumerate(files)], f"number int, {FILE} string")
    lines = scale.stage(scale.union_all([p.withColumn("text", F.regexp_replace("text", "\r$", "")) for p in parts]), "catalog-lines")
    heads = lines.where("block = 0").groupBy(FILE).agg(F.min_by("text", "row").alias("head"), F.min("row").alias("first"))
    heads = scale.stage(heads.withColumn("head", F.regexp_replace("head", "^\ufeff", "")), "catalog-heads")
    known = [r["head"] for r in heads.select("head").distinct().orderBy("head").collect()]
    names = [csv.clean_header(next(plain_csv.reader(io.StringIO(h, newline=""), delimiter=sep, quotechar=quote), [""])) for h in known]
    number = scale.local_table(spark, [(h, i, len(n)) for i, (h, n) in enumerate(zip(known, names))], "head string, schema int, width int")
    known_files = heads.join(F.broadcast(number), "head").join(F.broadcast(paths), FILE).drop("head")
    placed = _joined(lines, known_files, len(files)).where((F.col("block") > 0) | (F.col("row") > F.col("first")))
    widest = max(map(len, names), default=1)
    options = {"sep": sep, "quote": quote, "escape": quote, "nullValue": "", "emptyValue": "", "multiLine": "true"}
    parsed = F.from_csv("text", ", ".join(f"c{i} string" for i in range(widest)), options)
    fields = F.array(*[F.when(~F.col(f"f.c{i}").isin(CSV_NULLS), F.col(f"f.c{i}")) for i in range(widest)])
    rows = placed.withColumn("f", parsed).select(F.col("number").alias(FILE), "schema", "block", "row", F.slice(fields, F.lit(1), F.col("width")).alias("fields"))
    columns = scale.local_table(spark, [(i, k, c) for i, n in enumerate(names) for k, c in enumerate(n)], "schema int, ordinal int, column string")
    return scale.stage(rows, "catalog-rows"), columns, paths


def _joined(rows: DataFrame, by_file: DataFrame, files: int) -> DataFrame:
    """Rows with what is known of their file: broadcast up to a number of files, else a join that splits large files."""
    return rows.join(F.broadcast(by_file) if files <= scale.BROADCAST_ROWS else by_file, FILE)


def column_types(rows: DataFrame, schemas: DataFrame) -> DataFrame:
    """file, ordinal, column, dtype, filled, rows: one row per file and column.  Types are inferred as for one file."""
    cells = rows.select(FILE, F.posexplode("fields").alias("ordinal", "cell")).where("cell is not null").withColumn("v", text.strip("cell"))
    v = F.col("v")
    whole = F.when(v.rlike(numbers.INTEGER), (F.length(v) <= 18) | v.try_cast("bigint").isNotNull()).otherwise(False)
    facts = cells.groupBy(FILE, "ordinal").agg(
        F.count(F.lit(1)).alias("filled"), F.bool_and(whole).alias("whole"), F.bool_and(v.rlike(numbers.NUMBER)).alias("number"),
        F.bool_and(v.isin("True", "False", "TRUE", "FALSE", "true", "false")).alias("boolean"))
    sizes = rows.groupBy(FILE, "schema").agg(F.count(F.lit(1)).alias("rows"))
    kind = (F.when(F.col("filled").isNull(), NUMBER)  # a column without a value
            .when(F.col("whole"), WHOLE).when(F.col("number"), NUMBER).when(F.col("boolean"), BOOLEAN).otherwise(OTHER))
    return sizes.join(schemas, "schema").join(facts, [FILE, "ordinal"], "left").select(
        FILE, "ordinal", "column", kind.alias("dtype"), F.coalesce("filled", F.lit(0)).cast("bigint").alias("filled"), "rows", "schema")


def typed(value: Column, dtype: Column) -> Column:
    """Text in which equal values of a column's type look equal."""
    v = text.strip(value)
    return (F.when(dtype == WHOLE, v.try_cast("bigint").cast("string"))
            .when(dtype == NUMBER, numbers.plain_text(v.try_cast("double"), T.DoubleType()))
            .when(dtype == BOOLEAN, (F.lower(v) == "true").cast("string")).otherwise(value))


def is_number() -> Column:
    return F.col("dtype").isin(WHOLE, NUMBER)


# --- statistics ----------------------------------------------------------------------------------

KEY = [FILE, "ordinal"]
# Rows from the start of a file that are looked at first for the first values of its columns.
HEAD_ROWS = 10 * SPLIT_SAMPLE


def value_counts(rows: DataFrame, types: DataFrame, files: int) -> DataFrame:
    """file, ordinal, dtype, value, v (double, of numbers), cnt, odd (stands otherwise in the file somewhere).  Text above
    profiling.LONG_TEXT characters stands under its start and digest."""
    of_file = types.groupBy(FILE).agg(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "dtype"))), lambda x: x["dtype"]).alias("dtypes"))
    cells = _joined(rows, of_file, files).select(FILE, F.posexplode(F.arrays_zip("fields", "dtypes")).alias("ordinal", "z")).where("z.fields is not null")
    value = typed(F.col("z.fields"), F.col("z.dtypes"))
    cells = cells.select(*KEY, F.col("z.dtypes").alias("dtype"), value.alias("value"), F.col("z.fields").alias("raw"))
    cells = cells.select(*KEY, "dtype", profiling.short_key(F.col("value")).alias("value"), (~F.col("value").eqNullSafe(F.col("raw"))).alias("odd"))
    counts = cells.groupBy(*KEY, "dtype", "value").agg(F.count(F.lit(1)).alias("cnt"), F.bool_or("odd").alias("odd"))
    return counts.withColumn("v", F.when(is_number(), F.col("value").try_cast("double")))


def distinct_sketches(rows: DataFrame, schemas: DataFrame, bits: int = profiling.SKETCH_BITS) -> DataFrame:
    """file, column, sketch: approximate distinct values of every column of every file (profiling.merge_sketches merges them).
    Values count as their text in the file."""
    cells = rows.select(FILE, "schema", F.posexplode("fields").alias("ordinal", "value")).where("value is not null")
    sketches = cells.groupBy(FILE, "schema", "ordinal").agg(F.hll_sketch_agg("value", bits).alias("sketch"))
    return sketches.join(schemas, ["schema", "ordinal"]).select(FILE, "column", "sketch")


def _moments(freq: DataFrame) -> DataFrame:
    """Counts and numbers of every column, with outliers."""
    cnt, v = F.col("cnt"), F.col("v")
    first = scale.stage(freq.groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("unique_count"), F.min("v").alias("min"), F.max("v").alias("max"), (F.sum(v * cnt) / F.sum(cnt)).alias("mean"),
        F.sum(F.when(v == 0, cnt).otherwise(0)).alias("zeros_count")), "catalog-first")
    group = F.shiftleft(F.col(FILE).cast("bigint"), 32).bitwiseOR(F.col("ordinal").cast("bigint"))
    known = freq.where("v is not null").select(*KEY, "v", "cnt", group.alias("key"))
    quartiles = scale.quantiles_of_counts(known.select(F.col("key").alias("__group"), "v", F.col("cnt").alias("c")), [0.25, 0.5, 0.75])
    file, ordinal = F.shiftright("__group", 32).cast("int"), F.col("__group").bitwiseAND(F.lit(2 ** 32 - 1)).cast("int")
    quartiles = quartiles.select(file.alias(FILE), ordinal.alias("ordinal"), *[F.col("q")[i].alias(n) for i, n in enumerate(("q1", "median", "q3"))])
    means = first.select(*KEY, "mean", "min", "max").where("mean is not null")
    off = v - F.col("mean")
    central = known.join(means, KEY).groupBy(*KEY, "min", "max").agg(F.sum("cnt").alias("n"), F.sum(cnt * off * off).alias("m2"), F.sum(cnt * off * off * off).alias("m3"))
    n = F.col("n").cast("double")
    std = F.when(F.col("n") > 1, F.sqrt(F.col("m2") / (n - 1)))
    skew = (F.when(F.col("n") < 3, None).when((F.col("min") == F.col("max")) | (F.col("m2") == 0), F.lit(0.0))
            .otherwise(F.sqrt(n * (n - 1)) / (n - 2) * (F.col("m3") / n) / F.pow(F.col("m2") / n, F.lit(1.5))))
    shape = central.select(*KEY, std.alias("std"), skew.alias("skewness"))
    stats = scale.stage(first.join(shape, KEY, "left").join(quartiles, KEY, "left"), "catalog-stats")
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    far = F.abs((v - F.col("mean")) / F.when(F.col("std") > 0, F.col("std"))) > 3
    outside = (v < F.col("q1") - reach) | (v > F.col("q3") + reach)
    outliers = known.join(stats.select(*KEY, "mean", "std", "q1", "q3"), KEY).groupBy(*KEY).agg(
        *[F.sum(F.when(test, cnt).otherwise(0)).alias(name) for test, name in ((far, "potential_outliers"), (outside, "iqr_outliers"))])
    return stats.join(outliers, KEY, "left")


def _lists(freq: DataFrame) -> DataFrame:
    """detected_placeholders, top_values and sample_values of every column; at most 35, 10 and 5 entries."""
    def listed(df: DataFrame, rank: Column, entry: Column, name: str) -> DataFrame:
        return df.groupBy(*KEY).agg(F.transform(F.array_sort(F.collect_list(F.struct(rank.alias("rank"), entry.alias("e")))), lambda x: x["e"]).alias(name))

    counted = F.struct(F.col("value").alias("value"), F.col("cnt").cast("bigint").alias("count"))
    tokens = freq.where(F.col("dtype") == OTHER).withColumn("value", text.strip("value")).where(F.col("value").isin(PLACEHOLDERS)).groupBy(*KEY, "value").agg(F.sum("cnt").alias("cnt"))
    order = F.array_position(F.array(*[F.lit(t) for t in PLACEHOLDERS]), F.col("value"))
    own = Window.partitionBy(*KEY)
    top = freq.where(~is_number()).withColumn("rank", F.row_number().over(own.orderBy(F.desc("cnt"), "value"))).where(F.col("rank") <= TOP_VALUES)
    shown = F.when(F.col("dtype") == NUMBER, F.coalesce(F.col("value").try_cast("decimal(38,6)").cast("string"), F.col("value"))).otherwise(F.col("value"))
    marked = freq.withColumn("value", shown).withColumn("mark", profiling.sample_mark(F.col("value")))

    def first(rows: DataFrame) -> DataFrame:
        return rows.withColumn("rank", F.row_number().over(own.orderBy("mark", "value"))).where(F.col("rank") <= SAMPLE_VALUES).select(*KEY, "rank", "value")

    # Only marks that can be among the first are sorted; a column that got too few of them is sampled again in full.
    unique = scale.stage(freq.groupBy(*KEY).agg(F.count(F.lit(1)).alias("unique_count")), "catalog-unique")
    limits = unique.select(*KEY, profiling.mark_limit(F.col("unique_count")).alias("upto"))
    sample = scale.stage(first(marked.join(limits, KEY).where(F.left("mark", F.lit(8)) <= F.col("upto"))), "catalog-samples")
    got = sample.groupBy(*KEY).agg(F.count(F.lit(1)).alias("got"))
    short = unique.join(got, KEY, "left").where(F.coalesce("got", F.lit(0)) < F.least(F.lit(SAMPLE_VALUES), "unique_count")).select(*KEY)
    if not short.isEmpty():
        sample = sample.join(short, KEY, "left_anti").unionByName(first(marked.join(short, KEY)))
    return (listed(sample, F.col("rank"), F.col("value"), "sample_values")
            .join(listed(top, F.col("rank"), counted, "top_values"), KEY, "left").join(listed(tokens, order, counted, "detected_placeholders"), KEY, "left"))


def _splits(rows: DataFrame, types: DataFrame, files: int) -> DataFrame:
    """suggested_delimiter and occurrence_ratio, from the first values of every text column."""
    def firsts(some: DataFrame, wanted: DataFrame) -> DataFrame:
        texts = wanted.groupBy(FILE).agg(F.collect_list("ordinal").alias("texts"))
        cells = _joined(some, texts, files).select(FILE, "block", "row", "fields", F.explode("texts").alias("ordinal"))
        cells = cells.withColumn("value", F.get("fields", F.col("ordinal"))).where("value is not null").drop("fields")
        # The rank limit runs in every task before the shuffle.
        ranked = cells.withColumn("rank", F.row_number().over(Window.partitionBy(*KEY).orderBy("block", "row")))
        return ranked.where(F.col("rank") <= SPLIT_SAMPLE).select(*KEY, "value")

    # The first rows of a file usually hold them all; all columns too sparse for that share one scan of the rows.
    texts = types.where(F.col("dtype") == OTHER).select(*KEY, "filled")
    begins = rows.where("block = 0").groupBy(FILE).agg(F.min("row").alias("begin"))
    head = _joined(rows.where("block = 0"), begins, files).where(F.col("row") < F.col("begin") + HEAD_ROWS)
    first = scale.stage(firsts(head, texts), "catalog-firsts")
    have = first.groupBy(*KEY).agg(F.count(F.lit(1)).alias("have"))
    sparse = scale.stage(texts.join(have, KEY, "left").where(F.coalesce("have", F.lit(0)) < F.least(F.lit(SPLIT_SAMPLE), "filled")).select(*KEY), "catalog-sparse")
    if not sparse.isEmpty():
        first = first.join(sparse, KEY, "left_anti").unionByName(firsts(rows, sparse))
    tries = F.array(*[F.struct(F.lit(p).alias("p"), F.lit(d).alias("delimiter"), text.count_of(F.col("value"), d).alias("n")) for p, d in enumerate(DELIMITERS)])
    measured = first.select(*KEY, F.length("value").alias("len"), F.inline(tries)).groupBy(*KEY, "p", "delimiter").agg(
        F.avg(F.when(F.col("n") > 0, 1.0).otherwise(0.0)).alias("share"), F.avg("len").alias("len"), F.max("n").alias("most"), F.median("n").alias("mid"))
    best = measured.where("share > 0.3 and len < 50 and mid > 0 and mid <= 3 and most <= 5").groupBy(*KEY).agg(F.min_by(F.struct("delimiter", "share"), "p").alias("b"))
    return best.select(*KEY, F.lit(True).alias("splittable"), F.col("b.delimiter").alias("suggested_delimiter"), F.round("b.share", 4).alias("occurrence_ratio"))


def _redundant(rows: DataFrame, types: DataFrame, schemas: DataFrame, files: int) -> DataFrame:
    """redundant_with: text columns every label of which has one code of this number column, by names that go together."""
    names: dict[int, list] = {}
    for r in schemas.orderBy("schema", "ordinal").collect():  # columns of the distinct schemas
        names.setdefault(r["schema"], []).append(r["column"])
    pairs = []
    for schema, own in names.items():
        for i, code in enumerate(own):
            base = next((code[: -len(s)] for s in CODE_SUFFIXES if code.endswith(s)), code)
            pairs += [(schema, i, k) for k, label in enumerate(own) if k != i and base and label.startswith(base)]
    spark = rows.sparkSession
    table = scale.local_table(spark, pairs, "schema int, code int, label int")
    named = types.select(FILE, "schema", "ordinal", "dtype", "column")
    fits = named.where(is_number()).withColumnRenamed("ordinal", "code").drop("column").join(F.broadcast(table), ["schema", "code"]) \
        .join(named.where(F.col("dtype") == OTHER).select(FILE, F.col("ordinal").alias("label"), "column"), [FILE, "label"])
    checks = fits.groupBy(FILE).agg(F.collect_list(F.struct("code", "label", "column")).alias("checks"))
    cells = _joined(rows, checks, files).select(FILE, "fields", F.inline("checks")).select(
        FILE, "code", "label", "column", F.get("fields", "label").alias("said"), text.strip(F.get("fields", "code")).try_cast("double").alias("number"))
    per_label = cells.where("said is not null and number is not null").groupBy(FILE, "code", "label", "column", "said").agg(F.min("number").alias("lo"), F.max("number").alias("hi"))
    holds = per_label.groupBy(FILE, "code", "label", "column").agg(F.bool_and(F.col("lo") == F.col("hi")).alias("ok")).where("ok")
    lists = F.transform(F.array_sort(F.collect_list(F.struct("label", "column"))), lambda x: x["column"])
    return holds.groupBy(FILE, F.col("code").alias("ordinal")).agg(lists.alias("redundant_with"))


def _copies(rows: DataFrame, types: DataFrame, freq: DataFrame, files: int) -> DataFrame:
    """file, duplicate_rows: rows beyond the first of equal ones.

    Rows are counted by a 128-bit digest first; only those whose digest repeats are moved as a whole and compared.  A
    column whose values all stand in the file as `typed` writes them is compared as it is."""
    odd = freq.where("odd").select(*KEY).distinct().withColumn("odd", F.lit(True))
    kind = F.when(F.col("odd"), F.col("dtype")).otherwise(OTHER)
    dtypes = types.join(odd, KEY, "left").groupBy(FILE).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("ordinal", kind.alias("dtype")))), lambda x: x["dtype"]).alias("dtypes"), F.coalesce(F.bool_or("odd"), F.lit(False)).alias("any_odd"))
    dtypes = scale.stage(dtypes, "catalog-odd")
    value = F.when(F.col("any_odd"), F.transform(F.arrays_zip("fields", "dtypes"), lambda z: typed(z["fields"], z["dtypes"]))).otherwise(F.col("fields"))
    typed_rows = _joined(rows, dtypes, files).select(FILE, value.alias("fields")).withColumns({"d1": F.xxhash64("fields"), "d2": F.xxhash64(F.lit(1), F.reverse("fields"))})
    repeated = scale.stage(typed_rows.groupBy(FILE, "d1", "d2").agg(F.count(F.lit(1)).alias("c")).where("c > 1").drop("c"), "catalog-repeated")
    many = repeated.count()
    if not many:
        return scale.local_table(rows.sparkSession, [], f"{FILE} int, duplicate_rows bigint")
    repeated = F.broadcast(repeated) if many <= scale.BROADCAST_ROWS else repeated  # three numbers each
    found = typed_rows.join(repeated, [FILE, "d1", "d2"], "left_semi").groupBy(FILE, "fields").agg(F.count(F.lit(1)).alias("c"))
    return found.groupBy(FILE).agg(F.sum(F.col("c") - 1).alias("duplicate_rows"))


# --- the whole -----------------------------------------------------------------------------------

def profile_folder(spark: SparkSession, path: str, **options) -> Catalog:
    """Profile, issues and plan of every CSV file below a folder (or of a glob).  A file without rows is not listed."""
    rows, schemas, paths = _numbered_rows(spark, path, **{"encoding": "UTF-8", "sep": ",", "quote": '"', **options})
    files = rows.select(FILE).distinct().count()
    types = scale.stage(column_types(rows, schemas), "catalog-types")
    freq = scale.stage(value_counts(rows, types, files), "catalog-counts")
    stats, lists, splits, redundant, copies = scale.in_parallel(
        spark, lambda: scale.stage(_moments(freq), "catalog-moments"), lambda: scale.stage(_lists(freq), "catalog-lists"), lambda: scale.stage(_splits(rows, types, files), "catalog-splits"),
        lambda: scale.stage(_redundant(rows, types, schemas, files), "catalog-redundant"), lambda: scale.stage(_copies(rows, types, freq, files), "catalog-copies"))
    known = types.join(stats, KEY, "left")
    for part in (lists, splits, redundant):
        known = known.join(part, KEY, "left")
    columns = scale.stage(_named(_profile(known), paths), "catalog-columns")
    tables = scale.stage(_health(columns, _named(copies, paths)), "catalog-tables")
    return Catalog(columns, tables, issue_rules.all_issues(columns, tables), planner.validate(planner.plan(columns, tables)))


def _profile(known: DataFrame) -> DataFrame:
    """file and profiling.PROFILE_FIELDS, from what is known of every column."""
    kinds = profiling.PROFILE_FIELDS
    empty = {c: F.coalesce(c, F.array().cast(kinds[c])) for c in ("detected_placeholders", "sample_values", "top_values", "redundant_with")}
    zeros = {c: F.when(is_number(), F.coalesce(c, F.lit(0))) for c in ("potential_outliers", "iqr_outliers", "zeros_count")}
    base = known.withColumns({**empty, **zeros, "unique_count": F.coalesce("unique_count", F.lit(0)), "splittable": F.coalesce("splittable", F.lit(False)),
                              "null_count": F.col("rows") - F.col("filled")})
    counted = base.withColumn("placeholder_count", F.aggregate("detected_placeholders", F.lit(0).cast("bigint"), lambda a, p: a + p["count"])) \
        .withColumn("missing_count", F.col("null_count") + F.col("placeholder_count"))
    rows, unique = F.col("rows"), F.col("unique_count")
    spread = F.coalesce(1 - F.try_divide(unique.cast("double"), rows.cast("double")), F.lit(0.0))
    derived = counted.withColumns({
        "missing_ratio": F.coalesce(F.round(F.try_divide(F.col("missing_count").cast("double"), rows.cast("double")), 4), F.lit(0.0)),
        "is_categorical": ~is_number() & (unique > 0) & (unique < 50), "high_duplication": (spread > 0.99) & (unique > 1), "duplication_ratio": F.round(spread, 4),
        "drop_reasons": profiling.drop_reasons(rows, unique, F.col("missing_count"), F.col("dtype") == OTHER, F.col("column"))})
    return derived.select(FILE, *[F.col(name).cast(kind).alias(name) for name, kind in kinds.items()])


def _health(columns: DataFrame, copies: DataFrame) -> DataFrame:
    """One row per file: profiling.health's facts."""
    facts = profiling.table_facts(columns).join(copies, FILE, "left").withColumn("duplicate_rows", F.coalesce("duplicate_rows", F.lit(0)).cast("bigint"))
    ratio = F.coalesce(F.round(F.try_divide(F.col("duplicate_rows").cast("double"), F.col("rows").cast("double")), 4), F.lit(0.0))
    return facts.withColumn("duplicate_ratio", ratio)
