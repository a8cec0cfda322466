"""The cell store: one row per table cell, its labels, gates, previews and the detectors of damaged cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions.text import NUMBER, NUMBER_PREFIX, cell_terms, collapse, is_canonical, is_furniture, is_year, let, normalise_number, number_digits, parse_cell, strip
from foliant.session import stored

TABLE = ["doc_id", "table_id"]
ROW = [*TABLE, "row"]
#: The same keys for windows: a sort compares the first bytes of its first key, and documents are few beside tables.
IN_TABLE = ["table_id", "doc_id"]
IN_ROW = [*IN_TABLE, "row"]
ALL_ROWS = (Window.unboundedPreceding, Window.unboundedFollowing)
#: Cells and numbers a table must have to be searched; cells shown of a table; preview sizes.
LEAST_CELLS, LEAST_NUMBERS, SHOWN = 6, 4, 40
PREVIEW = {"section": 8, "row_label": 24, "header": 10}
HARVEST, CLIP = 400, 40
#: Numbers in a row that end a table's header.
NUMBERS = 3


def filled(cells: DataFrame) -> DataFrame:
    return cells.where("value is not null and value <> ''")


def is_number() -> Column:
    """Is the value a plain number? One match, as this is asked of every cell."""
    return F.col("value").rlike(rf"^\s*{NUMBER[1:-1]}\s*$")


def latest(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """The row of each key that is last by `order` (ties: any of rows equal in it)."""
    picked = rows.withColumn("__rank", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc(order))))
    return picked.where("__rank = 1").drop("__rank")


def row_labels(cells: DataFrame) -> DataFrame:
    """Leftmost text of each row, clipped to 60 characters; empty where a row has none."""
    text = F.when(~is_number(), F.struct("col", "value"))
    labels = filled(cells).groupBy(*IN_ROW).agg(F.coalesce(F.substring(collapse(F.min(text)["value"]), 1, 60), F.lit("")).alias("row_label"))
    return labels.select(*ROW, "row_label")


def banners(cells: DataFrame) -> DataFrame:
    """Section banners: runs of rows whose only cell is text, merged and placed on the run's last row."""
    single = filled(cells).groupBy(*IN_ROW).agg(F.count("*").alias("n"), F.min("value").alias("value"), F.max(is_number().cast("int")).alias("numeric"))
    single = single.where("n = 1 and numeric = 0")
    run = F.col("row") - F.row_number().over(Window.partitionBy(*IN_TABLE).orderBy("row"))
    parts = F.array_sort(F.collect_list(F.struct("row", "value")))
    merged = single.withColumn("run", run).groupBy(*IN_TABLE, "run").agg(F.max("row").alias("row"), parts.alias("parts"))
    return merged.select(*TABLE, "row", collapse(F.array_join(F.transform("parts", lambda p: p["value"]), " "), 60).alias("section"))


def labelled(cells: DataFrame) -> DataFrame:
    """Numeric cells with row label, and section: the last banner above the row.

    All of it is windows of a table, so that cells are dealt once, and not at all where they already lie by table. A
    banner stands beside its last row's only cell, as that is text; rows below look for the last one.
    """
    text = F.when(~F.col("__numeric"), F.struct("col", "value"))
    rows = filled(cells).withColumn("__numeric", is_number())
    rows = rows.withColumns({"__label": F.min(text).over(Window.partitionBy(*IN_ROW)), "__n": F.count("*").over(Window.partitionBy(*IN_ROW))})
    above = Window.partitionBy(*IN_TABLE).orderBy("row").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("__single", (F.col("__n") == 1) & ~F.col("__numeric")).withColumn("__before", F.sum(F.col("__single").cast("int")).over(above))
    # rows of a run count up with its banners, so their difference names it; all other rows are one group without parts
    rows = rows.withColumn("__run", F.when(F.col("__single"), F.col("row") - F.col("__before")))
    run = Window.partitionBy(*IN_TABLE, "__run").orderBy("row")
    rows = rows.withColumn("__parts", F.collect_list(F.when(F.col("__single"), F.col("value"))).over(run.rowsBetween(*ALL_ROWS)))
    banner = F.when(F.col("__single"), collapse(F.array_join("__parts", " "), 60))
    rows = rows.withColumn("__banner", banner).drop("__parts").withColumn("section", F.coalesce(F.last("__banner", ignorenulls=True).over(above), F.lit("")))
    label = F.coalesce(F.substring(collapse(F.col("__label")["value"]), 1, 60), F.lit(""))
    header = F.substring(F.coalesce(collapse(F.col("header")), F.lit("")), 1, 50)
    return rows.where("__numeric").select(*ROW, "col", "page", "value", "unit", header.alias("header"), label.alias("row_label"), "section")


def sections(cells: DataFrame) -> DataFrame:
    """Rows that hold numbers and the last banner above each, as `labelled` tells them of every cell; windows of rows alone."""
    full = filled(cells).withColumn("__numeric", is_number())
    rows = full.groupBy(*IN_ROW).agg(F.count("*").alias("n"), F.count_if("__numeric").alias("numbers"), F.min("value").alias("value"))
    above, single = Window.partitionBy(*IN_TABLE).orderBy("row"), F.expr("n = 1 and numbers = 0")
    rows = rows.withColumn("run", F.when(single, F.col("row") - F.sum(single.cast("int")).over(above)))
    parts = F.collect_list(F.when(single, F.col("value"))).over(Window.partitionBy(*IN_TABLE, "run").orderBy("row").rowsBetween(*ALL_ROWS))
    rows = rows.withColumn("banner", F.when(single, collapse(F.array_join(parts, " "), 60)))
    section = F.coalesce(F.last("banner", ignorenulls=True).over(above), F.lit(""))
    return rows.withColumn("section", section).where("numbers > 0").select(*ROW, "section")


def retrievable(cells: DataFrame) -> DataFrame:
    """Tables with enough cells and numbers to be worth searching."""
    counted = filled(cells).groupBy(*TABLE).agg(F.count("*").alias("n_cells"), F.count_if(is_number()).alias("n_numbers"))
    return counted.where((F.col("n_cells") >= LEAST_CELLS) & (F.col("n_numbers") >= LEAST_NUMBERS))


def without_suspects(cells: DataFrame, suspects: DataFrame, reason: str = "split-number") -> DataFrame:
    return cells.join(suspects.where(F.col("reason") == reason), [*ROW, "col"], "left_anti")


def most_relevant(cells: DataFrame, score: str, most: int = SHOWN) -> DataFrame:
    """The best cells of each table by score, numbered from 1 in (row, col) order."""
    rank = F.row_number().over(Window.partitionBy(*TABLE).orderBy(F.desc(score), "row", "col"))
    kept = cells.withColumn("__rank", rank).where(F.col("__rank") <= most).drop("__rank")
    return kept.withColumn("cell_id", F.row_number().over(Window.partitionBy(*TABLE).orderBy("row", "col")))


def previews(cells: DataFrame) -> DataFrame:
    """What a table is about: its first sections, row labels and headers in order, without page furniture.

    Only the first HARVEST cells by (row, col) are looked at, which is the feature.
    """
    place = F.row_number().over(Window.partitionBy(*TABLE).orderBy("row", "col"))
    first = labelled(cells).withColumn("place", place).where(F.col("place") <= HARVEST)
    kinds = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.substring(F.col(k), 1, CLIP).alias("text")) for k in PREVIEW]))
    seen = first.select(*TABLE, "place", kinds.alias("x")).select(*TABLE, "place", "x.kind", "x.text").where(~is_furniture(F.col("text")))
    firsts = seen.groupBy(*TABLE, "kind", "text").agg(F.min("place").alias("place"))
    rank = F.row_number().over(Window.partitionBy(*TABLE, "kind").orderBy("place", "text"))
    limit = F.coalesce(*[F.when(F.col("kind") == k, n) for k, n in PREVIEW.items()])
    kept = firsts.withColumn("rank", rank).where(F.col("rank") <= limit)
    text = F.array_sort(F.collect_list(F.struct("rank", "text")))
    out = kept.groupBy(*TABLE).pivot("kind", list(PREVIEW)).agg(F.array_join(F.transform(text, lambda s: s["text"]), "; "))
    return out.select(*TABLE, *[F.coalesce(F.col(k), F.lit("")).alias(k) for k in PREVIEW])


def grid(cells: DataFrame) -> DataFrame:
    """Each table row as one line of its filled cells in column order."""
    parts = F.array_sort(F.collect_list(F.struct("col", collapse(F.col("value"), CLIP).alias("text"))))
    lines = filled(cells).groupBy(*IN_ROW).agg(F.array_join(F.transform(parts, lambda p: p["text"]), " | ").alias("line"))
    return lines.select(*ROW, "line")


def page_tokens(pages: DataFrame) -> DataFrame:
    """Canonical numbers of each page (doc_id, page, text), a row per page with `tokens`, an array without repeats."""
    return _with_tokens(pages)


def _with_tokens(pages: DataFrame, *more: str) -> DataFrame:
    """The numbers of each page, beside the columns `more`, which are a page's."""
    words = F.filter(F.split(F.col("text"), r"\s+"), lambda w: w.rlike("[0-9]"))
    tokens = F.array_distinct(F.filter(F.transform(words, normalise_number), lambda t: t.isNotNull()))
    of_page = pages.select("doc_id", "page", *more, tokens.alias("tokens")).groupBy("doc_id", "page")
    return of_page.agg(F.array_distinct(F.flatten(F.collect_list("tokens"))).alias("tokens"), *[F.first(c).alias(c) for c in more])


def on_page(token: Column) -> Column:
    return F.coalesce(F.array_contains("tokens", token), F.lit(False))


def neighbours(cells: DataFrame) -> DataFrame:
    """Filled cells with the value of the next column, null where that cell is not stored."""
    return _beside(cells).where("__full").drop("__full")


def _beside(cells: DataFrame) -> DataFrame:
    """All cells, whether they are filled, and of those that are the value of the next column."""
    full = cells.withColumn("__full", F.coalesce(F.col("value") != "", F.lit(False)))
    along = Window.partitionBy("page", *IN_ROW, "__full").orderBy("col")
    right = F.lead(F.struct("col", "value")).over(along)
    return full.withColumn("right", F.when(F.col("__full") & (right["col"] == F.col("col") + 1), right["value"]))


def _cut() -> Column:
    """May a value and its `right` be one number that was cut in two?"""
    a, b = number_digits(F.col("value")), number_digits(F.col("right"))
    # branches and not an and, of which Spark makes what its terms share for every cell
    likely = F.when(F.col("right").contains("."), F.col("value").rlike("[0-9]") & F.col("right").rlike("[0-9]"))
    return F.when(likely, (a != "") & b.contains(".") & ~a.contains(".")).otherwise(False)


def _joined() -> Column:
    """Are the two joined among the page's tokens, and the first alone not?"""
    a, b = number_digits(F.col("value")), number_digits(F.col("right"))
    return on_page(normalise_number(F.concat(a, b))) & ~on_page(normalise_number(F.col("value")))


def _split() -> Column:
    """Was one number cut into a value and its `right`?"""
    return F.when(_cut(), _joined()).otherwise(False)


def _truncated() -> Column:
    pointed = strip(F.col("value")).rlike(r"^-?\$?[0-9,]+\.$") & strip(F.col("right")).rlike("^[0-9]")
    return F.coalesce(F.when(F.rtrim(F.col("value"), F.lit(" \t\n\x0b\f\r")).endswith("."), pointed), F.lit(False))


def split_numbers(cells: DataFrame, pages: DataFrame) -> DataFrame:
    """Pairs of cells that one number was cut into: joined they are on the page, the first alone is not.

    Numbers are read off those pages alone that have cells which may be such a pair.
    """
    pairs = neighbours(cells).where(F.col("right").contains(".")).where(_cut())
    of_page = pairs.groupBy("doc_id", "page").agg(F.collect_list(F.struct("table_id", "row", "col", "value", "right")).alias("pairs"))
    met = _with_tokens(pages.join(of_page, ["doc_id", "page"]), "pairs")
    return _both(met.select("doc_id", "page", "tokens", F.inline("pairs")).where(_joined()))


def truncated_decimals(cells: DataFrame) -> DataFrame:
    """Cells that end in a decimal point before a cell that starts with a digit."""
    return _both(neighbours(cells).where(_truncated()))


def _both(pairs: DataFrame) -> DataFrame:
    """Both cells of each pair, as suspects."""
    cols = F.explode(F.array("col", F.col("col") + 1))
    return pairs.select("doc_id", "page", "table_id", "row", cols.alias("col")).distinct().withColumn("reason", F.lit("split-number"))


def judged(cells: DataFrame, pages: DataFrame) -> DataFrame:
    """All cells with the reason why each is suspect, null where none is: what `split_numbers`, `truncated_decimals` and,
    of all others, the search for numbers that are not on their page find.

    Cells meet their page's numbers once, by page, and are otherwise only looked at along their rows.
    """
    met = cells.join(page_tokens(pages), ["doc_id", "page"], "left")
    rows = _beside(met).withColumn("__cut", (F.coalesce(_split(), F.lit(False)) | _truncated()).cast("int"))
    # a pair starts here or one column before; cells of one place share that, filled or not
    place = Window.partitionBy("page", *IN_ROW).orderBy("col").rangeBetween(-1, 0)
    rows = rows.withColumn("__flagged", F.max("__cut").over(place) == 1)
    # canonical numbers are looked for as they stand
    value = F.col("value")
    pure = F.when(value.rlike("[0-9]"), strip(value).rlike(NUMBER_PREFIX + "$"))
    lost = let(normalise_number(value), lambda t: t.isNotNull() & ~on_page(t))
    orphan = F.when(F.col("__full"), F.when(is_canonical(value), ~on_page(value)).when(pure, lost))
    reason = F.when(F.col("__flagged"), "split-number").when(orphan, "orphan-number")
    return rows.withColumn("reason", reason).select(*cells.columns, "reason")


def suspects(cells: DataFrame, pages: DataFrame) -> DataFrame:
    """Places of suspect cells, each flagged one once, and why."""
    order = Window.partitionBy("page", *IN_ROW).orderBy("col")
    found = judged(filled(cells), pages).where("reason is not null").select("doc_id", "page", "table_id", "row", "col", "reason")
    again = F.coalesce(F.lag("col").over(order) == F.col("col"), F.lit(False)) & (F.col("reason") == "split-number")
    return found.withColumn("__again", again).where("not __again").drop("__again")


def header_zone(cells: DataFrame, least: int = NUMBERS) -> DataFrame:
    """First row of each table with at least `least` numbers; above it are headers."""
    rows = filled(cells).groupBy(*ROW).agg(F.count_if(is_number()).alias("n"))
    return rows.where(F.col("n") >= least).groupBy(*TABLE).agg(F.min("row").alias("zone_end"))


def vacant_rows(cells: DataFrame, label_cols: tuple[int, ...] = (0, 1)) -> DataFrame:
    """Rows from the zone's end on that hold numbers but no text in the label columns."""
    return _vacancy(filled(cells), label_cols).where("vacant").select(*ROW)


def _vacancy(cells: DataFrame, label_cols: tuple[int, ...] = (0, 1)) -> DataFrame:
    """Rows of all cells, filled or not, and whether each is one of `vacant_rows`."""
    full = F.coalesce(F.col("value") != "", F.lit(False))
    label = full & F.col("col").isin(*label_cols) & ~is_number()
    rows = cells.groupBy(*ROW).agg(F.count_if(full & is_number()).alias("n"), F.count_if(label).alias("labels"))
    zone = F.min(F.when(F.col("n") >= NUMBERS, F.col("row"))).over(Window.partitionBy(*IN_TABLE))
    return rows.withColumn("zone_end", zone).select(*ROW, F.coalesce(F.expr("row >= zone_end and n > 0 and labels = 0"), F.lit(False)).alias("vacant"))


def _vacant_tables(cells: DataFrame, name: str) -> DataFrame:
    """Every table that has cells, and how many of its rows lost their labels, counted in one pass."""
    return _vacancy(cells).groupBy(*TABLE).agg(F.count_if("vacant").alias(name))


def ragged_rows(cells: DataFrame) -> DataFrame:
    """Rows that are wider or narrower than the table's first row."""
    width = cells.groupBy(*ROW).agg(F.count("*").alias("width"))
    first = F.first("width").over(Window.partitionBy(*IN_TABLE).orderBy("row"))
    return width.withColumn("expected", first).where("width <> expected")


def plausible_tables(cells: DataFrame) -> DataFrame:
    """Tables of three rows, two columns and six filled cells, with digits in three of ten."""
    digits = F.count_if(F.col("value").rlike("[0-9]")) / F.count("*")
    # rows and columns are counted at their first cell, where the table lies
    new = lambda c: F.coalesce(F.lag(c).over(Window.partitionBy(*IN_TABLE).orderBy(c)) != F.col(c), F.col(c).isNotNull())
    seen = filled(cells).withColumn("__row", new("row")).withColumn("__col", new("col"))
    counted = seen.groupBy(*TABLE).agg(F.count_if("__row").alias("n_rows"), F.count_if("__col").alias("n_cols"), F.count("*").alias("n_filled"), F.round(digits, 6).alias("digit_share"))
    return counted.where("n_rows >= 3 and n_cols >= 2 and n_filled >= 6 and digit_share >= 0.30")


def numeric_pages(pages: DataFrame, least: int = 20) -> DataFrame:
    words = F.filter(F.split("text", r"\s+"), lambda w: w.rlike("[0-9]"))
    return pages.select("doc_id", "page", F.size(words).alias("n_numeric")).where(F.col("n_numeric") >= least)


def ingest_summary(pages: DataFrame, cells: DataFrame, chunks: DataFrame, breakages: DataFrame) -> DataFrame:
    """Pages, tables, cells, chunks, breakages, recoveries and repairs per document, and their totals as `TOTAL`."""
    reason = F.col("reason")
    parts = [
        pages.groupBy("doc_id").agg(F.countDistinct("page").alias("pages")),
        cells.groupBy("doc_id").agg(F.countDistinct("table_id").alias("tables"), F.count("*").alias("cells")),
        chunks.groupBy("doc_id").agg(F.count("*").alias("chunks")),
        breakages.groupBy("doc_id").agg(
            F.count("*").alias("breakages"), F.count_if(reason.startswith("RECOVERED:")).alias("recovered"), F.count_if(reason.startswith("REPAIRED:")).alias("repaired")
        ),
    ]
    joined = parts[0]
    for part in parts[1:]:
        joined = joined.join(part, "doc_id", "full_outer")
    names = ["pages", "tables", "cells", "chunks", "breakages", "recovered", "repaired"]
    filled_in = joined.na.fill(0, names)
    total = filled_in.rollup("doc_id").agg(F.grouping("doc_id").alias("g"), *[F.sum(n).alias(n) for n in names])
    return total.select(F.when(F.col("g") == 1, "TOTAL").otherwise(F.col("doc_id")).alias("doc_id"), *names)


def relevant(cells: DataFrame, question: Column, most: int = SHOWN) -> DataFrame:
    """The cells of each table with most terms of a question in their labels, at most `most`, numbered from 1."""
    shared = F.size(F.array_intersect(cell_terms(question), cell_terms(F.concat_ws(" ", "row_label", "header", "section"))))
    return most_relevant(cells.withColumn("relevance", shared), "relevance", most)


def numbered_tables(cells: DataFrame) -> DataFrame:
    """Tables of each document that have cells, numbered from 1 by table_id."""
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy("table_id"))
    return filled(cells).select(*TABLE).distinct().withColumn("table_no", rank)


def preview_texts(cells: DataFrame, documents: DataFrame) -> DataFrame:
    """The text a table is found by: title of its document (or the id), page, sections, row labels and headers."""
    pages = cells.groupBy(*TABLE).agg(F.min("page").alias("page"))
    found = with_titles(previews(cells).join(pages, TABLE), documents)
    text = F.concat(
        "title", F.lit(" (page "), F.col("page").cast("string"), F.lit("). Sections: "), "section", F.lit(". Rows: "), "row_label", F.lit(". Columns: "), "header"
    )
    return found.select(*TABLE, "page", text.alias("preview"))


def with_titles(rows: DataFrame, documents: DataFrame) -> DataFrame:
    """Rows (doc_id) with the title of their document, or its id where there is none."""
    titles = documents.select("doc_id", "title")
    return rows.join(titles, "doc_id", "left").withColumn("title", F.coalesce("title", "doc_id"))


def blank_tables(cells: DataFrame) -> DataFrame:
    """Raw tables without any cell that holds more than white space."""
    has = F.bool_or(F.coalesce(strip(F.col("value")) != "", F.lit(False)))
    return cells.groupBy(*TABLE).agg(has.alias("has")).where(~F.col("has")).select(*TABLE)


def fallback_pages(pages: DataFrame, cells: DataFrame, least: int = 20) -> DataFrame:
    """Pages without a stored table that read as numeric: there tables are sought by their text."""
    return numeric_pages(pages, least).join(cells.select("doc_id", "page").distinct(), ["doc_id", "page"], "left_anti")


def _headed(cells: DataFrame, least: int) -> DataFrame:
    """All cells with `__full`, `__place` in their column and `header`: the filled ones above the first numeric row, joined."""
    full = cells.withColumn("__full", F.coalesce(F.col("value") != "", F.lit(False)))
    n = F.count_if(F.col("__full") & is_number()).over(Window.partitionBy(*IN_ROW))
    zone = F.min(F.when(F.col("__n") >= least, F.col("row"))).over(Window.partitionBy(*IN_TABLE))
    full = full.withColumn("__n", n).withColumn("__above", F.col("__full") & F.coalesce(F.col("row") < zone, F.lit(False)))
    down = Window.partitionBy(*IN_TABLE, "col").orderBy("row")
    parts = F.collect_list(F.when(F.col("__above"), F.struct("row", "value"))).over(down.rowsBetween(*ALL_ROWS))
    full = full.withColumns({"__parts": parts, "__place": F.row_number().over(down)})
    # made once a column, at its first cell
    text = F.when((F.col("__place") == 1) & (F.size("__parts") > 0), collapse(F.array_join(F.transform(F.array_sort("__parts"), lambda p: p["value"]), " ")))
    return full.withColumn("__text", text).drop("__parts").withColumn("header", F.first("__text").over(down.rowsBetween(*ALL_ROWS))).drop("__text", "__n", "__above")


def zone_headers(cells: DataFrame, least: int = NUMBERS) -> DataFrame:
    """Text of the rows above each table's first numeric row, joined column by column."""
    return _headed(cells, least).where("__place = 1 and header is not null").select(*TABLE, "col", "header")


def parsed(raw: DataFrame) -> DataFrame:
    """Raw cells (doc_id, page, table_id, row, col, raw) as cells: value and unit parsed, headers from the header zone."""
    cells = raw.withColumn("p", parse_cell(F.col("raw"))).select("doc_id", "page", *ROW[1:], "col", "p.value", "p.unit")
    return _headed(cells, NUMBERS).select("doc_id", "page", *ROW[1:], "col", "value", "unit", "header")


def repaired(stored_: DataFrame, rebuilt: DataFrame, least: int = 2) -> DataFrame:
    """Cells of each table: rebuilt ones where `least` rows had no label and the rebuilt table has strictly fewer, else stored ones."""
    before = _vacant_tables(stored_, "before").where(F.col("before") >= least)
    chosen = stored(before.join(_vacant_tables(rebuilt, "after"), TABLE).where("after < before").select(*TABLE), "better-tables")
    return stored_.join(chosen, TABLE, "left_anti").unionByName(rebuilt.join(chosen, TABLE, "left_semi"))


def repair_log(stored_: DataFrame, rebuilt: DataFrame, least: int = 2) -> DataFrame:
    """Breakages of label repair: tables that were repaired, and tables that keep rows without a label."""
    before = _vacant_tables(stored_, "before").where(F.col("before") >= least)
    both = before.join(_vacant_tables(rebuilt, "after"), TABLE, "left")
    better = F.coalesce(F.col("after") < F.col("before"), F.lit(False))
    left = F.when(better, F.col("after")).otherwise(F.col("before"))
    reasons = F.array_compact(
        F.array(
            F.when(better, F.concat(F.lit("REPAIRED: "), F.col("before").cast("string"), F.lit(" rows without a label, now "), F.col("after").cast("string"))),
            F.when(left > 0, F.concat(F.lit("INCOMPLETE: "), left.cast("string"), F.lit(" rows without a label"))),
        )
    )
    return both.select(*TABLE, F.explode(reasons).alias("reason"))


def gold_candidates(labelled_: DataFrame, incomplete: DataFrame, least_label: int = 4, most: int = 6) -> DataFrame:
    """Cells worth asking about, the first `most` of each table by (row, col).

    Of tables that are complete and were not found by text alone: cells with a label, with a header or a section, whose
    value is a plain number and no bare year.
    """
    whole = labelled_.join(incomplete.select(*TABLE).distinct(), TABLE, "left_anti").where(~F.contains("table_id", F.lit("_ft")))
    named = (F.length("row_label") >= least_label) & ((F.col("header") != "") | (F.col("section") != ""))
    plain = F.col("value").rlike(r"^-?[0-9]+(\.[0-9]+)?$") & ~(is_year(F.col("value")) & F.coalesce(F.col("unit") == "", F.lit(True)))
    rank = F.row_number().over(Window.partitionBy(*TABLE).orderBy("row", "col"))
    return whole.where(named & plain).withColumn("place", rank).where(F.col("place") <= most)


def training_cells(labelled_: DataFrame, longer: int = 5, least: int = 4) -> DataFrame:
    """Cells with a label of more than `longer` characters and a header or section, of tables that have `least` of them."""
    good = labelled_.where((F.length("row_label") > longer) & ((F.col("header") != "") | (F.col("section") != "")))
    return good.withColumn("n_good", F.count("*").over(Window.partitionBy(*TABLE))).where(F.col("n_good") >= least)
