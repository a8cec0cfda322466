"""Stores over the lines are made in one pass, and what looks along tables, rows or pages deals no cell anew."""

import pytest
from pyspark.sql import functions as F

from foliant.functions import text as ft
from foliant.operators import cells as oc
from foliant.queries import documents, fixtures

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name,scans", [("labelled_cells", 1), ("header_zone", 1), ("parsed_tables", 1), ("vacant_label_rows", 1), ("truncated_decimal", 1), ("suspect_suppression", 2)])
def test_lines_are_read_once(spark, name, scans):
    """The lines are scanned once, or once more for the texts of pages; no cell is in an exchange."""
    made = plan(documents.QUERIES[name](spark, SF))
    assert made.count("lineitem.parquet") == scans
    assert not [x for x in made.splitlines() if "Exchange" in x and "col#" in x]


def test_rows_are_those_of_the_sql(spark):
    for made, sql in [
        (fixtures.store(spark, SF), fixtures.STORE), (fixtures.raw_cells(spark, SF), f"select doc_id, page, table_id, row, col, raw from ({fixtures.RAW_CELLS})"),
        (fixtures.raw_cells(spark, SF, rebuilt=True), f"select doc_id, page, table_id, row, col, raw from ({fixtures.REBUILT_CELLS})"),
    ]:
        want = fixtures.over_tables(spark, SF, sql, "lineitem", "part").select(*made.columns)
        assert made.count() == want.count() and made.exceptAll(want).count() == 0


def test_repeated_cells_are_flagged_alike(spark):
    rows = [("d", 1, "t", 1, 1, "4."), ("d", 1, "t", 1, 1, "4."), ("d", 1, "t", 1, 2, "5"), ("d", 1, "t", 2, 1, "9"), ("d", 2, "t2", 1, 1, "9")]
    cells = spark.createDataFrame(rows, "doc_id string, page int, table_id string, row int, col int, value string")
    pages = spark.createDataFrame([("d", 1, "8 7"), ("d", 1, "9.0 of 8"), (None, 1, "3")], "doc_id string, page int, text string")
    got = sorted((r["page"], r["row"], r["col"], r["reason"]) for r in oc.suspects(cells, pages).collect())
    assert got == [(1, 1, 1, "split-number"), (1, 1, 2, "split-number"), (2, 1, 1, "orphan-number")]


def test_short_numbers_parse_as_all_others(spark):
    raws = ["$12.50", "12%", "0.0%", "$0", "$7.00", "5.", "$5.", "£1.0001", "1.00001", "$100", "100.10%", "$3.5%", "007", "$-5", "-0", "€2.20300", "$", "%", "5.0.0"]
    rows = spark.createDataFrame([(x,) for x in raws], "raw string")
    slow = ft.let(ft.strip(F.col("raw")), ft._unmarked)
    got = rows.select("raw", ft.parse_cell(F.col("raw")).alias("p"), slow.alias("s")).where(F.col("raw").rlike("[0-9]") & (F.col("raw") != "-0")).collect()
    assert len(got) > 15 and all(r["p"] == r["s"] for r in got)


def test_each_refused_plan_is_a_row(spark):
    """No plan is counted instead of returned, and none is left out as it has no error."""
    from foliant.queries import derived

    orders = spark.read.parquet(f"{SF}/lineitem.parquet").select("l_orderkey").distinct().count()
    got = derived.compute_errors(spark, SF)
    assert got.count() == got.select("plan_id").distinct().count() == orders


@pytest.mark.parametrize("name,scans", [("label_repair_log", 2), ("plausible_tables", 1), ("split_number", 2)])
def test_each_side_is_made_once(spark, name, scans):
    made = plan(documents.QUERIES[name](spark, SF))
    assert made.count("lineitem.parquet") == scans and "Expand" not in made


def test_numbers_are_read_off_pages_with_pairs_alone(spark, monkeypatch):
    rows = [("d", 1, "t", 1, 1, "12"), ("d", 1, "t", 1, 2, "3.5"), ("d", 2, "t2", 1, 1, "9"), ("d", 2, "t2", 1, 2, "8")]
    cells = spark.createDataFrame(rows, "doc_id string, page int, table_id string, row int, col int, value string")
    pages = spark.createDataFrame([("d", 1, "is 123.5"), ("d", 1, "and 4"), ("d", 2, "is 98"), ("d", 3, "is 12")], "doc_id string, page int, text string")
    asked, whole = [], oc._with_tokens
    monkeypatch.setattr(oc, "_with_tokens", lambda p, *more: asked.append(p.select("page").distinct().count()) or whole(p, *more))
    got = sorted((r["page"], r["row"], r["col"]) for r in oc.split_numbers(cells, pages).collect())
    assert got == [(1, 1, 1), (1, 1, 2)] and asked == [1]


def test_tables_without_filled_cells_count_as_rebuilt(spark):
    kinds = "doc_id string, page int, table_id string, row int, col int, value string"
    full = [("d", 1, t, r, c, "" if c == 0 else "1") for t in ("a", "b", "c") for r in range(3) for c in range(4)]
    again = [("d", 1, "a", 0, 0, None), *[("d", 1, "b", r, c, "x" if c == 0 and r else "1") for r in range(3) for c in range(4)]]
    stored_, rebuilt = spark.createDataFrame(full, kinds), spark.createDataFrame(again, kinds)
    log = {(r["table_id"], r["reason"]) for r in oc.repair_log(stored_, rebuilt).collect()}
    said = lambda n: f"{n} rows without a label"
    assert log == {("a", f"REPAIRED: {said(3)}, now 0"), ("b", f"REPAIRED: {said(3)}, now 1"), ("b", f"INCOMPLETE: {said(1)}"), ("c", f"INCOMPLETE: {said(3)}")}
    kept = {(r["table_id"], r["row"], r["col"]) for r in oc.repaired(stored_, rebuilt).where("table_id = 'c'").collect()}
    assert len(kept) == 12


def test_strip_takes_white_space_off_both_ends(spark):
    texts = ["", " ", "\t a b \r\n", "\x0b\x0cx\x0b", "a", " a ", "\n", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", ft.strip(F.col("t")).alias("s"), F.regexp_replace("t", r"^\s+|\s+$", "").alias("w"))
    assert all(r["s"] == r["w"] for r in rows.collect())


@pytest.mark.parametrize("by", ["table_id", "page"])
def test_tasks_of_lines_have_a_bound(spark, monkeypatch, by):
    """Beyond LINES a task there are more tasks than the session asks for, and cells are still dealt by no other exchange."""
    lines, few = spark.read.parquet(f"{SF}/lineitem.parquet").count(), int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert fixtures.numbered_lines(spark, SF, ["doc_id", by]).rdd.getNumPartitions() <= few
    with fixtures.dealt_by(by):
        before = fixtures.store(spark, SF)
        monkeypatch.setattr(fixtures, "LINES", 100)
        after = fixtures.store(spark, SF)
        assert after.rdd.getNumPartitions() == -(-lines // 100) > few
        assert before.count() == after.count() and before.exceptAll(after).count() == 0
    name = "truncated_decimal" if by == "page" else "ragged_rows"
    made = plan(documents.QUERIES[name](spark, SF))
    assert len([x for x in made.splitlines() if "Exchange hashpartitioning" in x]) - made.count("ENSURE_REQUIREMENTS") == 1 and not [x for x in made.splitlines() if "Exchange" in x and "col#" in x]


def test_sections_are_those_of_the_cells(spark):
    """Repeated cells, gaps, runs of banners, banners below all numbers, numbers above all banners, and keys that are null."""
    rows = [("t", 1, 0, "7"), ("t", 2, 0, "First"), ("t", 3, 2, " part "), ("t", 4, 0, "x"), ("t", 4, 1, "1.5"), ("t", 5, 0, "Same"), ("t", 5, 0, "Same"), ("t", 6, 0, "Next"), ("t", 7, 1, ""), ("t", 8, 0, "Other"), ("t", 9, 1, "8"), ("t", 11, 0, "9"), ("t", 12, 0, "Last")]
    rows += [("u", 1, 1, "3"), (None, 1, 0, "Null"), (None, 2, 0, "4"), ("v", None, 0, "Nowhere"), ("v", 1, 0, "5")]
    cells = spark.createDataFrame([("d", 1, *r, None, None) for r in rows], "doc_id string, page int, table_id string, row int, col int, value string, unit string, header string")
    want = oc.labelled(cells).select("doc_id", "table_id", "row", "section").distinct().collect()
    got = oc.sections(cells).collect()
    assert sorted(map(str, got)) == sorted(map(str, want)) and {r["section"] for r in got} >= {"", "First part", "Other", "Null"}
    made = plan(documents.QUERIES["section_asof"](spark, SF))
    # cells are in no window: they are grouped by row first
    assert not [x for x in made.splitlines() if "Window" in x and "__numeric" in x]


def test_better_tables_are_found_once(spark):
    """Repair reads the judgement of tables back; only the two reads of cells are left in its plan."""
    vacant = [("d", t, r, c, v) for t in ("a", "b") for r in range(3) for c, v in ((2, "1"), (3, "2"), (4, "3"))]
    named = [("d", "a", r, 0, "Corn") for r in range(3)]
    kinds = "doc_id string, table_id string, row int, col int, value string"
    raw, rebuilt = spark.createDataFrame(vacant, kinds), spark.createDataFrame([x for x in vacant if x[1] == "a"] + named, kinds)
    made = oc.repaired(raw, rebuilt)
    assert made._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 2
    assert sorted(map(tuple, made.collect())) == sorted([x for x in vacant if x[1] == "b"] + [x for x in vacant if x[1] == "a"] + named)


def test_numbers_are_told_with_white_space_around_them(spark):
    """Short forms are only taken of texts without a line's end after them."""
    from foliant.functions.text import normalise_number, parse_cell

    cells = ["5\n", "5%\n", " $7.50", "12.50", "€3", "-0", "-4", "N/A ", " Corn \t", "0.0", "(5)", "1,200", None, "", "1e5", "7.00%"]
    rows = spark.createDataFrame([(i, c) for i, c in enumerate(cells)], "i int, raw string")
    got = {r["i"]: (r["v"], r["u"], r["t"]) for r in rows.select("i", parse_cell(F.col("raw")).alias("p"), normalise_number(F.col("raw")).alias("t")).select("i", F.col("p.value").alias("v"), F.col("p.unit").alias("u"), "t").collect()}
    assert [got[i] for i in range(len(cells))] == [
        ("5", None, "5"), ("5", "%", "5"), ("7.5", "USD", "7.5"), ("12.5", None, "12.5"), ("3", "EUR", None), ("0", None, "0"), ("-4", None, "-4"), (None, None, None), ("Corn", None, None),
        ("0", None, "0"), ("-5", None, "-5"), ("1200", None, "1200"), (None, None, None), (None, None, None), ("1e5", None, "1"), ("7", "%", "7"),
    ]
