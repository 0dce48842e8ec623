"""CSV files read by many tasks, in their own encodings, and folders of files."""

import csv as plain_csv
import io
import os

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from limpid.operators import columns, ml, scale
from limpid.operators import profile as profiling
from limpid.plans import catalog, cleaning
from limpid.sources import csv, records

STATES = records.LineStates(",", '"')


def plain_records(lines: list[str]) -> list[str]:
    """Records by a character machine: a quote opens a field only as its first character; after the closing quote all up
    to the separator belongs to the field."""
    out, held, inside = [], [], False
    for line in lines:
        i, at_start = 0, not inside
        if not held and not line.strip():
            continue
        held.append(line)
        while i < len(line):
            if inside:
                if line[i] == '"':
                    if line[i + 1 : i + 2] == '"':
                        i += 1
                    else:
                        inside = False
                        while i + 1 < len(line) and line[i + 1] != ",":
                            i += 1
            elif line[i] == '"' and at_start:
                inside = True
            at_start = not inside and line[i] == ","
            i += 1
        if not inside:
            out.append("\n".join(held))
            held = []
    return out + (["\n".join(held)] if held else [])


def cut(lines: list[str], ends: list[int], batch: int) -> list[str]:
    """The module's records of lines in blocks that end before the given lines."""
    blocks = [sum(e <= i for e in ends) * 10 for i in range(len(lines))]

    def batches():
        for a in range(0, len(lines), batch):
            some = slice(a, a + batch)
            yield pa.RecordBatch.from_arrays([pa.array(["f"] * len(lines[some])), pa.array(blocks[some]), pa.array(lines[some], pa.string())], names=["file", "block", "value"])

    found = [r for b in records.block_ends(STATES, batches()) for r in b.to_pylist()]
    pieces = [r for b in records.cut_records(STATES, records._starts(found), batches()) for r in b.to_pylist()]
    out, owner = {}, None
    for r in sorted(pieces, key=lambda r: (r["block"], r["part"] != records.REST, r["row"])):
        if r["part"] == records.REST:
            out[owner] += "\n" + r["text"]
        else:
            key = (r["block"], r["row"])
            assert key not in out
            out[key] = r["text"]
            owner = key if r["part"] == records.START else owner
    return [out[k] for k in sorted(out)]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text(st.sampled_from('"",ab '), max_size=9), max_size=12), st.lists(st.integers(0, 12), max_size=4), st.integers(1, 5))
def test_records_of_any_text_in_any_blocks(lines, ends, batch):
    assert cut(lines, ends, batch) == plain_records(lines)


def test_long_lines_are_read_in_linear_time():
    line = ",".join(['"' + "x" * 50 + '"'] * 20_000)
    assert STATES.after(line, 0) == 0 and STATES.after(line + ',"open', 0) == 1
    assert STATES.after('x" , y', 1) == 0 and STATES.after("no quote", 1) == 1 and STATES.after('a","b', 1) == 1


@pytest.fixture
def small_splits(spark):
    kept = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    for k, v in kept.items():
        spark.conf.set(k, v)


def test_a_file_with_line_breaks_in_quotes_is_read_by_many_tasks(spark, tmp_path, small_splits):
    rows = [(i, f'say "{i}",\r\nthen\n\n{"long " * (9000 if i == 700 else i % 40)}\n', "," if i % 3 else "") for i in range(2000)]
    out = io.StringIO()
    writer = plain_csv.writer(out, lineterminator="\n")
    writer.writerow(["id", "the\ntext", "end"])
    writer.writerows(rows)
    (tmp_path / "t.csv").write_bytes(out.getvalue().encode())
    df = csv.load_csv(spark, "t.csv", str(tmp_path))
    assert df.columns == ["id", "the\ntext", "end", "_rid"]
    got = df.orderBy("_rid").collect()
    assert [tuple(r)[:3] for r in got] == [(i, t, e or None) for i, t, e in rows]
    size = os.path.getsize(tmp_path / "t.csv")
    # The long field of row 700 spans two blocks that start no record.
    assert len({r["_rid"]["block"] for r in got}) > size / 20000 - 4 > 5


def test_each_file_has_its_own_encoding(spark, tmp_path):
    (tmp_path / "a.csv").write_text("näme,v\ncafé �,1\n", encoding="utf-8")
    (tmp_path / "b.csv").write_text('näme,v\n"über\nß",2\n', encoding="latin-1")
    (tmp_path / "c.csv").write_text("﻿näme,v\nplain,3\n", encoding="utf-8")
    rows = csv.load_csv(spark, "*.csv", str(tmp_path)).orderBy("v").collect()
    assert [(r["näme"], r["v"]) for r in rows] == [("café �", 1), ("über\nß", 2), ("plain", 3)]
    files = csv.files_of(spark, str(tmp_path))
    assert [(f.encoding, f.broken, f.head) for f in files] == [("UTF-8", False, "näme,v"), ("ISO-8859-1", True, "näme,v"), ("UTF-8", False, "näme,v")]


# --- folders -------------------------------------------------------------------------------------

FILES = {
    "numbers.csv": "k_id,k,v,empty\n" + "".join(f"{i % 7},L{i % 7},{i / 4},\n" for i in range(130)) + "3,L3,1e3,\n3,L3,1000.0,\n",
    "texts.csv": 'key,tags,"line\nbreak"\n' + "".join(f'key{i},"a{i}; b{i % 5}","x\n{i % 3}"\n' for i in range(120)) + "?,NA,unknown\n",
    "latin.csv": "größe,w\nein,TRUE\nzwei,False\nein,true\n\nein,TRUE\n",
    "header.csv": "a,b\n",
    "ragged.csv": "a,b\n1\n2,3,4\nunknown,-\n",
    "one.csv": "x\n007\n7\n7.0\n",
}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("folder")
    (path / "deep").mkdir()
    for name, content in FILES.items():
        (path / ("deep" if name == "one.csv" else "") / name).write_bytes(content.encode("latin-1" if name == "latin.csv" else "utf-8"))
    return path


def shown(df, drop=()):
    def plain(v):
        return round(v, 9) if isinstance(v, float) else v
    return sorted((tuple(plain(v) for k, v in r.asDict(recursive=True).items() if k not in drop) for r in df.collect()), key=repr)


def test_a_folder_equals_its_files(spark, folder):
    found = catalog.profile_folder(spark, str(folder))
    for name in FILES:
        if name in ("header.csv", "ragged.csv"):
            continue
        raw = csv.load_csv(spark, name, str(folder / "deep" if name == "one.csv" else folder))
        want = cleaning.analyze(raw, [csv.ROW_ID])
        for got, expected in ((found.columns, want.columns), (found.tables, want.table), (found.issues, want.issues), (found.steps, want.steps)):
            own = got.where(F.col("file").endswith("/" + name)).select(*expected.columns)
            assert shown(own) == shown(expected), (name, expected.columns)


def test_files_without_rows_and_ragged_records(spark, folder):
    rows, _ = catalog.read_rows(spark, f"{folder}/ragged.csv")
    assert [r["fields"] for r in rows.orderBy("row").collect()] == [["1", None], ["2", "3"], ["unknown", "-"]]
    alone = catalog.profile_folder(spark, f"{folder}/header.csv")
    assert alone.columns.count() == alone.tables.count() == 0


def test_sketches_of_files_merge(spark, folder):
    sketches = catalog.distinct_sketches(*catalog.read_rows(spark, str(folder)))
    by_name = {r["column"]: r["unique_count"] for r in profiling.approx_distinct(profiling.merge_sketches(sketches, ["column"])).collect()}
    assert (by_name["k"], by_name["key"], by_name["x"]) == (7, pytest.approx(121, abs=2), 3)


def test_jobs_do_not_depend_on_the_files(spark, tmp_path):
    def jobs(files: int) -> int:
        path = tmp_path / f"n{files}"
        path.mkdir()
        for i in range(files):
            (path / f"{i}.csv").write_text(f"a,b{i % 3}\n" + "".join(f"{j},t{j % 4}\n" for j in range(20 + i)))
        group = f"files-{files}"
        before = spark.sparkContext.statusTracker()
        spark.sparkContext.setJobGroup(group, group)
        found = catalog.profile_folder(spark, str(path))
        assert found.tables.count() == files
        spark.sparkContext._jsc.sc().clearJobGroup()
        return len(before.getJobIdsForGroup(group))

    assert abs(jobs(3) - jobs(24)) <= 2


def test_no_files(spark, tmp_path):
    (tmp_path / "none").mkdir()
    rows, schemas = catalog.read_rows(spark, str(tmp_path / "none"))
    assert rows.count() == schemas.count() == 0
    assert columns.data(scale.local_table(spark, [], "a int")).count() == 0


def test_scores_of_known_models(spark):
    """A target that follows from the features is learned; one that does not is not."""
    df = spark.range(1500).select("id", (F.col("id") * 37 % 101).alias("a"), F.concat(F.lit("g"), F.col("id") % 7).alias("g"))
    rule = df.withColumn("kind", F.when((F.col("a") > 50) & F.col("g").isin("g1", "g2", "g3"), "yes").otherwise("no")).withColumn("y", F.col("a") * 3.0)
    noise = rule.withColumns({"kind": F.when(F.xxhash64("id") % 2 == 0, "yes").otherwise("no"), "y": (F.xxhash64("id", F.lit(1)) % 1000).cast("double")})
    found = {r["metric"]: r for target in ("kind", "y") for r in ml.evaluate(noise, rule, target, ["id"]).collect()}
    assert found["accuracy"]["clean"] > 0.97 and found["f1"]["clean"] > 0.97 and found["r2"]["clean"] > 0.97 and found["rmse"]["clean"] < 15
    assert 0.35 < found["accuracy"]["raw"] < 0.65 and found["r2"]["raw"] < 0.2 and found["rmse"]["raw"] > 200
    assert found["accuracy"]["improvement"] == pytest.approx(100 * (found["accuracy"]["clean"] - found["accuracy"]["raw"]), abs=0.02)


def test_a_feature_named_label(spark):
    df = spark.range(40).select("id", (F.col("id") % 2).alias("label"), F.concat(F.lit("t"), F.col("id") % 2).alias("t"))
    table = ml.features(df, "t", "classification", ["id"])
    assert set(table.columns) == {"__id", "id", "label_feature", "label"} and table.where("label_feature = label").count() == 40


def test_copies_of_a_folder_are_compared_by_value(spark, tmp_path):
    """Numbers and booleans that are written in several ways; a file without copies beside it."""
    (tmp_path / "odd.csv").write_text("a,b,c\n1,1.50,True\n01,1.5,TRUE\n1,1.5,false\n+1,15e-1,true\n2,,x\n".replace(",x", ",false"))
    (tmp_path / "text.csv").write_text("a,b\nx,1.50\nx,1.5 y\nx,1.50\n")
    (tmp_path / "none.csv").write_text("a,b\nx,1\ny,1\n")
    found = catalog.profile_folder(spark, str(tmp_path)).tables
    assert {r["file"].rsplit("/", 1)[1]: r["duplicate_rows"] for r in found.collect()} == {"odd.csv": 2, "text.csv": 1, "none.csv": 0}


def test_a_folder_sorts_only_what_can_be_first(spark, tmp_path, monkeypatch):
    """Values of a column that starts late, and a pool of marks that is too small, give the same lists."""
    rows = "".join(f"{i},{'' if i < 700 else f'p{i} - q'},v{i % 300}\n" for i in range(900))
    (tmp_path / "late.csv").write_text("a,late,b\n" + rows)

    def lists():
        return sorted((r["column"], r["splittable"], r["suggested_delimiter"], r["sample_values"], r["top_values"]) for r in catalog.profile_folder(spark, str(tmp_path)).columns.collect())

    want = lists()
    assert [r[:3] for r in want] == [("a", False, None), ("b", False, None), ("late", True, " - ")]
    for pool, head in ((2, 10), (100_000, 100_000)):
        monkeypatch.setattr(profiling, "SAMPLE_POOL", pool)
        monkeypatch.setattr(catalog, "HEAD_ROWS", head)
        assert lists() == want
