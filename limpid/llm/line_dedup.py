"""Removal of repeated passages by content-defined line chunks.

Hashes of neighbouring lines choose where chunks begin: of every shortest run of lines over 50 words the line with the
least hash is a boundary, so each copy of a passage has the same boundaries wherever it stands and every passage has
one.  Boundary lines that occur again, byte by byte, are grown to the runs that chose them, and runs that occur before
are removed; the first occurrence stays.  Nothing but DataFrame expressions runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from limpid.llm.common import stage, words_pattern

#: Runs of lines with more words than this are passages.
PASSAGE_WORDS = 50
ADDED = ("n_lines", "removed_lines", "removed")


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, least_words: int = PASSAGE_WORDS) -> DataFrame:
    """`df` with its text cleaned, and n_lines, removed_lines (long) and removed (array of first_line and n_lines,
    lines counted from 0 in the original text, ascending).

    Removed are the passages that repeat: runs of neighbouring lines with more than `least_words` words together that
    occur before, in id order (null first), then by text hash, then in text order.  A line goes if it lies in such a
    run, so no passage of whole lines is missed, of one line or of many.  An occurrence that overlaps the first one in
    the same document is not a repeat.  Words are runs of anything but ASCII white space.  Lines end at a line feed;
    those without words are passed over when runs are compared, and go when a removed run holds lines on both sides.
    A null text has one empty line and becomes empty.  Rows that agree in id and text are one document: what the first
    keeps, all keep.  Input columns named like the added ones are replaced.

    From every line the shortest run over `least_words` words that starts there, and the one that ends there, are taken;
    together they cover every longer one.  A run has at most `least_words` + 1 lines, so the work grows with the lines.
    Boundary lines are shuffled whole, after copies have collapsed in each task; of the runs only digests, and after
    the first join only those whose boundary repeats; texts once, to meet their removed runs.  A frequent boundary or
    run meets its first one in a join by hash, which adaptive execution splits."""
    df = df.drop(*ADDED)
    own = [c for c in df.columns]
    docs = df.withColumn("__text", F.xxhash64(text_col))
    runs = _runs(docs.select(F.col(id_col).alias("__id"), "__text", F.col(text_col).alias("__source")), "__source", least_words)
    boundaries = runs.select(F.explode(_boundaries()).alias("b")).groupBy("b.line", "b.hash").agg(F.count(F.lit(1)).alias("__n")) \
        .where("__n > 1").select("hash").distinct()
    spans = stage(_grown(runs).join(boundaries, F.col("__boundary") == F.col("hash"), "left_semi").drop("__boundary"), "passages-runs")
    repeated = spans.groupBy("__digest").agg(F.min(F.struct("__id", "__text", "__from", "__to")).alias("__first"), F.count(F.lit(1)).alias("__n")) \
        .where("__n > 1").select("__digest", "__first")
    itself = F.col("__id").eqNullSafe(F.col("__first.__id")) & (F.col("__text") == F.col("__first.__text"))
    again = spans.join(repeated, "__digest").where(~(itself & (F.col("__from") <= F.col("__first.__to"))))
    gone = again.groupBy("__id", F.col("__text").alias("__hash")).agg(F.collect_set(F.struct("__from", "__to")).alias("__gone"))
    parts = docs.join(gone, docs[id_col].eqNullSafe(gone["__id"]) & (docs["__text"] == gone["__hash"]), "left") \
        .select(*[docs[c] for c in own], "__gone").withColumn("__lines", _lines(text_col))
    covered = F.flatten(F.transform("__gone", lambda s: F.sequence(s["__from"], s["__to"])))
    parts = parts.withColumn("__kept", F.when(F.col("__gone").isNotNull(), F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), covered)))
    # What lies between two kept lines has been removed.
    edges = F.concat(F.array(F.lit(-1)), F.col("__kept"), F.array(F.size("__lines")))
    gaps = F.filter(F.transform(F.arrays_zip(F.slice(edges, 1, F.size(edges) - 1).alias("a"), F.slice(edges, 2, F.size(edges) - 1).alias("b")),
                                lambda e: F.struct((e["a"] + 1).alias("first_line"), (e["b"] - e["a"] - 1).alias("n_lines"))), lambda s: s["n_lines"] > 0)
    spared = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    cleaned = F.when(F.col("__gone").isNull(), spared).otherwise(F.array_join(F.transform("__kept", lambda i: F.get("__lines", i)), "\n"))
    out = parts.withColumns({"n_lines": F.size("__lines").cast("long"), "__clean": cleaned,
                             "removed": F.coalesce(gaps, F.array().cast("array<struct<first_line:int,n_lines:int>>"))}) \
        .withColumn("removed_lines", F.aggregate("removed", F.lit(0).cast("long"), lambda s, r: s + r["n_lines"]))
    return out.select(*[F.col("__clean").alias(c) if c == text_col else F.col(c) for c in own], *ADDED)


def _lines(text_col: str) -> Column:
    return F.split(F.coalesce(F.col(text_col).cast("string"), F.lit("")), "\n", -1)


def _runs(df: DataFrame, text_col: str, least_words: int) -> DataFrame:
    """(__id, __text, __worded, __runs, __hashes) of the texts with more than `least_words` words: their lines with
    words, the shortest runs over `least_words` words that start or end at a line, and the hashes of the lines.  A run is
    one long, its first line and its number of lines: longs are told apart by a hash set, structs pair by pair."""
    numbered = F.transform(_lines(text_col), lambda line, i: F.struct(
        i.alias("at"), F.regexp_count(line, F.lit(words_pattern())).alias("words"), line.alias("line")))
    worded = df.select("__id", "__text", F.filter(numbered, lambda x: x["words"] > 0).alias("__worded")) \
        .where(F.aggregate("__worded", F.lit(0).cast("long"), lambda n, x: n + x["words"]) > least_words)

    def reach(lines: Column) -> Column:
        """Lines that it takes from the front of `lines` to pass `least_words` words; null if they do not."""
        return F.aggregate(lines, F.struct(F.lit(0).alias("words"), F.lit(0).alias("n")), lambda s, x: F.when(s["words"] > least_words, s).otherwise(
            F.struct((s["words"] + x["words"]).alias("words"), (s["n"] + 1).alias("n"))), lambda s: F.when(s["words"] > least_words, s["n"]))

    def run(first: Column, n: Column) -> Column:
        return F.shiftleft(first.cast("long"), 32) + n

    def ahead(i: Column) -> Column:
        return run(i, reach(F.slice("__worded", i + 1, F.lit(least_words + 1))))

    def behind(i: Column) -> Column:
        start = F.greatest(i - least_words, F.lit(0))
        n = reach(F.reverse(F.slice("__worded", start + 1, i - start + 1)))
        return run(i - n + 1, n)

    places = F.sequence(F.lit(0), F.size("__worded") - 1)
    found = F.filter(F.concat(F.transform(places, ahead), F.transform(places, behind)), lambda r: r.isNotNull())
    return worded.select("__id", "__text", "__worded", F.array_distinct(found).alias("__runs"),
                         F.transform("__worded", lambda x: F.xxhash64(x["line"])).alias("__hashes"))


def _lines_of(run: Column, lines: str) -> Column:
    return F.slice(lines, F.shiftright(run, 32).cast("int") + 1, run.bitwiseAND(F.lit((1 << 32) - 1)).cast("int"))


def _boundaries() -> Column:
    """The boundary lines of a text, each once: of every run the one with the least hash, the first of equal ones."""
    def place(run: Column) -> Column:
        own = _lines_of(run, "__hashes")
        return F.shiftright(run, 32).cast("int") + F.array_position(own, F.array_min(own)).cast("int") - 1

    return F.transform(F.array_distinct(F.transform("__runs", place)), lambda i: F.struct(F.get("__hashes", i).alias("hash"), F.get("__worded", i)["line"].alias("line")))


def _grown(runs: DataFrame) -> DataFrame:
    """(__id, __text, __from, __to, __digest, __boundary), one row per run; __from and __to are lines of the text,
    counted from 0, __boundary is the hash of its boundary line."""
    hashed = runs.withColumn("__digests", F.transform("__worded", lambda x: F.sha2(x["line"], 256)))

    def grown(run: Column) -> Column:
        first, n = F.shiftright(run, 32).cast("int"), run.bitwiseAND(F.lit((1 << 32) - 1)).cast("int")
        return F.struct(F.get("__worded", first)["at"].alias("__from"), F.get("__worded", first + n - 1)["at"].alias("__to"),
                        F.unhex(F.sha2(F.array_join(_lines_of(run, "__digests"), ""), 256)).alias("__digest"), F.array_min(_lines_of(run, "__hashes")).alias("__boundary"))

    # Digests come before the explosion, whose rows would each carry all lines of their text otherwise.
    return hashed.select("__id", "__text", F.explode(F.transform("__runs", grown)).alias("r")).select("__id", "__text", "r.*")
