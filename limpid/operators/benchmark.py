"""Comparison of a cleaned table with a ground-truth table.

Rows are matched by position (default) or by a key.  Positions are dense row numbers built from
range buckets, so matching is one equi-join and no step sees a whole table in one task.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from limpid.functions.numbers import same_cell
from limpid.functions.text import quote
from limpid.operators import scale
from limpid.operators.columns import data


def common_columns(clean: DataFrame, truth: DataFrame) -> list[str]:
    return sorted(set(data(clean).columns) & set(data(truth).columns))


def schema_match(clean: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: column sets as text, precision, recall, F1.  Known from the schemas alone."""
    have, want = set(data(clean).columns), set(data(truth).columns)
    common = have & want
    precision = len(common) / len(have) if have else 0.0
    recall = len(common) / len(want) if want else 0.0
    f1 = 2 * precision * recall / (precision + recall) if common else 0.0

    def text(names: set) -> str:
        return ", ".join(sorted(names))

    return scale.local_table(
        clean.sparkSession, [(text(common), text(want - have), text(have - want), round(precision, 4), round(recall, 4), round(f1, 4))],
        "common_columns string, missing_from_cleaned string, extra_in_cleaned string,"
        " schema_precision double, schema_recall double, schema_f1 double")


def align(clean: DataFrame, truth: DataFrame, clean_order: list[str], truth_order: list[str] | None = None,
          key: list[str] | None = None) -> DataFrame:
    """pos, one struct column "c" of cleaned and "t" of truth values over the common columns.

    By position: row i against row i, up to the shorter table.  By key (unique in both, NULL keys
    meet nothing): every row of either table; one without a partner has a NULL struct on the other
    side and counts as a mismatch in every cell.  pos is then a hash of the key, which keeps no order.
    """
    names = common_columns(clean, truth)
    truth_order = truth_order or clean_order
    cells_c = F.struct(*[quote(c).alias(c) for c in names]).alias("c")
    cells_t = F.struct(*[quote(c).alias(c) for c in names]).alias("t")
    if key:
        _require_unique(clean, key)
        _require_unique(truth, key)
        keys = [quote(k).alias(f"__k{i}") for i, k in enumerate(key)]
        on = [f"__k{i}" for i in range(len(key))]
        joined = clean.select(cells_c, *keys).join(truth.select(cells_t, *keys), on, "full").withColumn("pos", F.xxhash64(*on))
    else:
        left = scale.with_position(clean, clean_order, "__pos")
        right = scale.with_position(truth, truth_order, "__pos")
        joined = (left.select(F.col("__pos").alias("pos"), cells_c)
                  .join(right.select(F.col("__pos").alias("pos"), cells_t), "pos"))
    return joined.select("pos", "c", "t")


def _require_unique(df: DataFrame, key: list[str]) -> None:
    """A repeated key would pair every copy with every copy."""
    complete = df.where(functools.reduce(Column.__and__, [quote(k).isNotNull() for k in key]))
    repeated = complete.groupBy(*scale.columns_of(key)).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    if repeated.take(1):
        raise ValueError(f"key {key} is not unique")


class Comparison:
    """Cell tests over aligned rows."""

    def __init__(self, aligned: DataFrame):
        self.aligned = aligned
        self.types_c = {f.name: f.dataType for f in aligned.schema["c"].dataType}
        self.types_t = {f.name: f.dataType for f in aligned.schema["t"].dataType}
        self.names = list(self.types_c)

    def pair(self, name: str) -> tuple[Column, Column]:
        return F.col("c").getField(name), F.col("t").getField(name)

    def same(self, name: str) -> Column:
        c, t = self.pair(name)
        return F.col("c").isNotNull() & F.col("t").isNotNull() & same_cell(c, self.types_c[name], t, self.types_t[name])

    def sides(self) -> DataFrame:
        """rows, matched, only_clean, only_truth."""
        has_c, has_t = F.col("c").isNotNull(), F.col("t").isNotNull()
        return self.aligned.agg(F.count(F.lit(1)).alias("rows"), F.count_if(has_c & has_t).alias("matched"),
                                F.count_if(~has_t).alias("only_clean"), F.count_if(~has_c).alias("only_truth"))

    def columns(self) -> DataFrame:
        """column, matches, total, both-null state matches, cells with a value on both sides and
        their matches: one row per column, counted once for all reports."""
        return self._counted

    @functools.cached_property
    def _counted(self) -> DataFrame:
        counts = self._counts()
        return scale.local_table(self.aligned.sparkSession, [tuple(r) for r in counts.collect()], counts.schema)  # one row per column

    def _counts(self) -> DataFrame:
        """One aggregate over the aligned rows in long form."""
        flat = []
        for i, name in enumerate(self.names):
            c, t = self.pair(name)
            state = F.col("c").isNotNull() & F.col("t").isNotNull() & (c.isNotNull() == t.isNotNull())
            flat += [F.lit(i), self.same(name), c.isNotNull(), t.isNotNull(), state]
        cells = self.aligned.select(F.stack(F.lit(len(self.names)), *flat).alias("i", "same", "has_c", "has_t", "state"))
        both = F.col("has_c") & F.col("has_t")
        counts = cells.groupBy("i").agg(
            F.count_if("same").alias("matches"), F.count(F.lit(1)).alias("total"),
            F.count_if("state").alias("null_matches"),
            F.count_if(both).alias("valued"), F.count_if(both & F.col("same")).alias("value_matches"))
        names = F.array(*[F.lit(n) for n in self.names])
        return counts.select(F.get(names, F.col("i")).alias("column"), "matches", "total", "null_matches", "valued", "value_matches")

    def row_matches(self) -> DataFrame:
        """rows, matching_rows."""
        every = F.lit(True)
        for name in self.names:
            every = every & self.same(name)
        return self.aligned.agg(F.count(F.lit(1)).alias("rows"), F.count_if(every).alias("matching_rows"))

    def mismatches(self, k: int = 3) -> DataFrame:
        """column, pos, cleaned_value, benchmark_value of the first k mismatches per column (a
        report: the limit is the feature).

        One bounded top-k scan usually holds them all.  The columns that agree in nearly all of its rows share one further
        scan, in which the limit is applied in each task before the shuffle."""
        reach = 400 * k
        early = self._first(self.aligned.orderBy("pos").limit(reach), self.names, k)
        head = early.collect()  # k rows per column
        late = [n for n in self.names if sum(r["column"] == n for r in head) < k]
        if late and not scale.has_more_rows(self.aligned, reach):
            late = []
        found = scale.local_table(self.aligned.sparkSession, [tuple(r) for r in head if r["column"] not in late], early.schema)
        return found.unionByName(self._first(self.aligned, late, k)) if late else found

    def _first(self, aligned: DataFrame, names: list[str], k: int) -> DataFrame:
        """pos, column, cleaned_value, benchmark_value of the first k mismatches of some columns."""
        def text(v: Column) -> Column:
            return F.coalesce(v.cast("string"), F.lit("nan"))

        found = F.filter(F.array(*[F.struct(
            F.lit(n).alias("column"), text(self.pair(n)[0]).alias("cleaned_value"),
            text(self.pair(n)[1]).alias("benchmark_value"), self.same(n).alias("same")) for n in names]),
            lambda x: ~x["same"])
        long = aligned.select("pos", F.inline(found)).drop("same")
        first = Window.partitionBy("column").orderBy("pos")
        return long.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k).drop("rank")


def _percent(part, whole, empty: float = 0.0) -> Column:
    share = F.try_divide(F.col(part).cast("double"), F.col(whole).cast("double"))
    return F.coalesce(F.round(share * 100, 2), F.lit(empty))


def column_accuracy(columns: DataFrame) -> DataFrame:
    """column, accuracy, matches, total, mismatches."""
    return columns.select("column", _percent("matches", "total").alias("accuracy"), "matches", "total",
                          (F.col("total") - F.col("matches")).alias("mismatches"))


def cell_accuracy(columns: DataFrame) -> DataFrame:
    sums = columns.agg(F.sum("matches").alias("matching_cells"), F.sum("total").alias("total_cells"))
    return sums.withColumn("overall_cell_accuracy", _percent("matching_cells", "total_cells"))


def null_accuracy(columns: DataFrame) -> DataFrame:
    sums = columns.agg(F.sum("null_matches").alias("null_matches"), F.sum("total").alias("total_cells"))
    return sums.withColumn("null_handling_accuracy", _percent("null_matches", "total_cells"))


def value_accuracy(columns: DataFrame) -> DataFrame:
    """Over cells with a value on both sides; 100 if there are none."""
    sums = columns.agg(F.sum("value_matches").alias("value_matches"), F.sum("valued").alias("valued_cells"))
    return sums.withColumn("value_match_accuracy", _percent("value_matches", "valued_cells", 100.0))


def row_accuracy(rows: DataFrame) -> DataFrame:
    return rows.withColumn("row_exact_match_rate", _percent("matching_rows", "rows"))


def summary(clean: DataFrame, truth: DataFrame, order: list[str], truth_order: list[str] | None = None,
            key: list[str] | None = None, compare: Comparison | None = None) -> DataFrame:
    """One row with all accuracies, row counts and a one-line summary; `compare` has the aligned rows if they are known."""
    spark = clean.sparkSession
    match = schema_match(clean, truth).first()
    counts = (clean.count(), truth.count())
    if not match["common_columns"]:
        values = (0.0, 0.0, 0.0, 0.0, match["schema_f1"], *counts, 0, counts[0] == counts[1],
                  "The tables share no column.")
        return scale.local_table(spark, [values], _SUMMARY)
    compare = compare or Comparison(scale.stage(align(clean, truth, order, truth_order, key), "aligned"))
    per_column = compare.columns().agg(*[F.sum(c).alias(c) for c in (
        "matches", "total", "null_matches", "valued", "value_matches")])
    cells = per_column.select(
        _percent("matches", "total").alias("cell"), _percent("null_matches", "total").alias("null"),
        _percent("value_matches", "valued", 100.0).alias("value")).first()
    rows = row_accuracy(compare.row_matches()).first()
    text = (f"Agreement: {cells['cell']}% of cells, {rows['row_exact_match_rate']}% of whole rows, "
            f"{cells['value']}% of cells with values on both sides; column names: F1 {match['schema_f1']}")
    values = (cells["cell"], rows["row_exact_match_rate"], cells["null"], cells["value"], match["schema_f1"],
              *counts, rows["rows"], counts[0] == counts[1], text)
    return scale.local_table(spark, [values], _SUMMARY)


_SUMMARY = ("overall_cell_accuracy double, row_exact_match_rate double, null_handling_accuracy double,"
            " value_match_accuracy double, schema_f1 double, cleaned_rows bigint, benchmark_rows bigint,"
            " rows_compared bigint, row_count_match boolean, summary string")
