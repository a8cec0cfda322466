"""Bindings of the driver's tables and of literal rows to the shapes the operators take; the same SQL for both engines."""

from __future__ import annotations

import re
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F



def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def literal(spark: SparkSession, rows: str, columns: str) -> DataFrame:
    return spark.sql(f"select * from (values {rows}) as t({columns})")


def values(rows: str, columns: str) -> str:
    return f"(select * from (values {rows}) as t({columns}))"


#: Cells from lineitem: a table per order, a row per line, six columns.
COLUMNS = [("l_quantity", None), ("l_extendedprice", "USD"), ("l_discount", None), ("l_tax", None), ("l_returnflag", None), ("l_linestatus", None)]
ORDER = "l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate"
_ROWS = f"""
  select 'd' || cast(l_orderkey % 7 as string) as doc_id, l_orderkey % 50 + 1 as page, 't' || cast(l_orderkey as string) as table_id,
    row_number() over (partition by l_orderkey order by {ORDER}) as row, p_name, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus
  from lineitem join part on l_partkey = p_partkey"""
_NUMBERS = " union all ".join(
    f"select doc_id, page, table_id, row, {i + 1} as col, {c} as num, {repr(u) if u else 'cast(null as string)'} as unit, '{c}' as header, p_name as row_label, l_returnflag as section from rows_of"
    for i, (c, u) in enumerate(COLUMNS[:4])
)
#: Numeric cells with labels; num is the value itself, so that nothing depends on how an engine prints a double.
NUMERIC_CELLS = f"with rows_of as ({_ROWS}) {_NUMBERS}"


#: Lines of a task at most: their cells, some nine a line, are sorted there and have to fit into its memory.
LINES = 1 << 17


def numbered_lines(spark: SparkSession, sf_dir: str, by: list[str] = ["doc_id", "table_id"], orders: DataFrame | None = None) -> DataFrame:  # noqa: B006
    """Lines with their part's name and place r in their order: doc_id, page (of fifty), table_id, k and the line's columns.

    A table is an order and so is a page of its own number, k. Rows are dealt by the columns of `by`, of which each order
    is one group; what later groups or windows of tables, or of pages, ask for is there then, and no cell is shuffled.
    Tasks are as many as LINES asks for where the session has fewer, so that they do not grow with the lines and spill.
    Where only the tables of some `orders` (l_orderkey) are asked for, other lines are left behind before they are dealt.
    """
    line, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part").select("p_partkey", "p_name")
    line = line if orders is None else line.join(orders.distinct(), "l_orderkey", "left_semi")
    k = F.col("l_orderkey")
    named = line.join(part, line["l_partkey"] == part["p_partkey"]).withColumns(
        {"doc_id": F.concat(F.lit("d"), (k % 7).cast("string")), "table_id": F.concat(F.lit("t"), k.cast("string")), "k": k}
    )
    named = named.withColumn("page", k) if "page" in by else named
    # orders first, as sorts compare the first bytes of their first key, and documents are few
    by, tasks = by[::-1], -(-table(spark, sf_dir, "lineitem").count() // LINES)
    if tasks > int(spark.conf.get("spark.sql.shuffle.partitions")):
        named = named.repartition(tasks, *by)
    return named.withColumn("r", F.row_number().over(Window.partitionBy(*by).orderBy(*ORDER.split(", "))))


def cells_of(lines: DataFrame, kept: list[str], cells: list[Column]) -> DataFrame:
    """A row for each of `cells`, structs made from a line or null where it has none, beside the columns `kept`."""
    # explode_outer, as the filter that Spark derives from explode would make the structs twice
    return lines.select(*kept, F.explode_outer(F.array(*cells)).alias("c")).where("c is not null").select(*kept, "c.*")


def line_cells(spark: SparkSession, sf_dir: str, columns: list[str] | None = None, orders: DataFrame | None = None) -> DataFrame:
    """The cell store over lineitem, or its cells under `columns` or of `orders`: value is text, as stored; one scan, unpivoted in place."""
    rows = numbered_lines(spark, sf_dir, orders=orders).withColumns({"page": F.col("k") % 50 + 1, "row": F.col("r"), "row_label": F.col("p_name"), "section": F.col("l_returnflag")})
    wanted = [(i + 1, c, u) for i, (c, u) in enumerate(COLUMNS) if columns is None or c in columns]
    cells = [F.struct(F.lit(i).alias("col"), F.col(c).cast("string").alias("value"), F.lit(u).cast("string").alias("unit"), F.lit(c).alias("header")) for i, c, u in wanted]
    found = cells_of(rows, ["doc_id", "page", "table_id", "row", "row_label", "section"], cells)
    return found.select("doc_id", "page", "table_id", "row", "col", "value", "unit", "header", "row_label", "section")


#: Raw tables from lineitem, as an extractor would give them: two header rows, then a row per line with its part's name,
#: price, discount and flag; every fifth table's names are lost. The rebuilt ones have them, but for each tenth table's first.
_RAW_BASE = f"""
  select 'd' || cast(l_orderkey % 7 as string) as doc_id, l_orderkey % 50 + 1 as page, 't' || cast(l_orderkey as string) as table_id, l_orderkey as k,
    row_number() over (partition by l_orderkey order by {ORDER}) + 1 as row, p_name, l_extendedprice, l_quantity, l_tax
  from lineitem join part on l_partkey = p_partkey"""
RAW_CELLS = f"""with rows_of as ({_RAW_BASE}), heads as (select distinct doc_id, page, table_id, k from rows_of)
select doc_id, page, table_id, 0 as row, 1 as col, 'Price' as raw, k from heads union all select doc_id, page, table_id, 0, 2, 'Number', k from heads
union all select doc_id, page, table_id, 0, 3, 'Tax', k from heads union all select doc_id, page, table_id, 1, 1, 'in  dollars', k from heads union all select doc_id, page, table_id, 1, 3, ' ', k from heads
union all select doc_id, page, table_id, row, 0, case when k % 5 = 0 then '' else p_name end, k from rows_of
union all select doc_id, page, table_id, row, 1, '$' || cast(cast(l_extendedprice as decimal(18, 2)) as string), k from rows_of
union all select doc_id, page, table_id, row, 2, cast(cast(l_quantity as int) as string), k from rows_of
union all select doc_id, page, table_id, row, 3, cast(cast(l_tax * 100 as int) as string) || '%', k from rows_of"""
REBUILT_CELLS = RAW_CELLS.replace("case when k % 5 = 0 then '' else p_name end", "case when k % 10 = 0 and row = 2 then '' else p_name end")


def raw_cells(spark: SparkSession, sf_dir: str, rebuilt: bool = False) -> DataFrame:
    """The rows of RAW_CELLS, or of REBUILT_CELLS, in one pass over the lines."""
    k, row = F.col("k"), F.col("r") + 1
    lost = (k % 10 == 0) & (row == 2) if rebuilt else k % 5 == 0
    cell = lambda row, col, raw: F.struct(row.cast("int").alias("row"), F.lit(col).alias("col"), raw.alias("raw"))
    head = lambda row, col, raw: F.when(F.col("r") == 1, cell(F.lit(row), col, F.lit(raw)))
    cells = [
        head(0, 1, "Price"), head(0, 2, "Number"), head(0, 3, "Tax"), head(1, 1, "in  dollars"), head(1, 3, " "),
        cell(row, 0, F.when(lost, "").otherwise(F.col("p_name"))),
        cell(row, 1, F.concat(F.lit("$"), F.col("l_extendedprice").cast("decimal(18, 2)").cast("string"))),
        cell(row, 2, F.col("l_quantity").cast("int").cast("string")),
        cell(row, 3, F.concat((F.col("l_tax") * 100).cast("int").cast("string"), F.lit("%"))),
    ]
    lines = numbered_lines(spark, sf_dir).withColumn("page", k % 50 + 1)
    return cells_of(lines, ["doc_id", "page", "table_id"], cells)


def over_tables(spark: SparkSession, sf_dir: str, sql: str, *names: str) -> DataFrame:
    """SQL over the driver's tables of these names."""
    for n in names:
        sql = re.sub(rf"\b(from|join) {n}\b", rf"\1 {{{n}}}", sql)
    return spark.sql(sql, **{n: table(spark, sf_dir, n) for n in names})


#: A store over all orders, a table and a page each, with banners, gaps, cut numbers, truncations, orphans and near misses: rows of
#: label, price, quantity and discount; of every third order a price is cut in two, of every fourth a quantity ends in a point.
_LINES_OF = f"""
  select 'd' || cast(k % 7 as string) as doc_id, k as page, 't' || cast(k as string) as table_id, k, r, n, p_name, price, quantity, discount, part,
    case when r > 2 then r + 4 else r + 2 end as row
  from (select l_orderkey as k, row_number() over (partition by l_orderkey order by {ORDER}) as r, count(*) over (partition by l_orderkey) as n, p_name, cast(cast(l_extendedprice as decimal(18, 2)) as string) as price,
    cast(cast(l_quantity as int) as string) as quantity, cast(cast(l_discount * 100 as int) as string) as discount, cast(l_partkey as string) as part from lineitem join part on l_partkey = p_partkey) q"""
_NONE = "cast(null as string)"
_STORE = f"""
  select doc_id, page, table_id, 1 as row, 0 as col, 'Parts of the order' as value, {_NONE} as unit, 'Item' as header from lines_of where r = 1
  union all select doc_id, page, table_id, 2, 0, 'by price and quantity', {_NONE}, 'Item' from lines_of where r = 1 and k % 2 = 0
  union all select doc_id, page, table_id, 6, 0, 'Later lines', {_NONE}, 'Item' from lines_of where r = 3
  union all select doc_id, page, table_id, row, 0, case when k % 5 = 0 and r % 2 = 1 then '' else p_name end, {_NONE}, 'Item' from lines_of
  union all select doc_id, page, table_id, row, 1, case when k % 3 = 0 and r = 1 then substring(price, 1, 2) else price end, case when k % 3 = 0 and r = 1 then {_NONE} else 'USD' end, 'Price' from lines_of
  union all select doc_id, page, table_id, row, 2, substring(price, 3, 20), {_NONE}, 'Price' from lines_of where k % 3 = 0 and r = 1
  union all select doc_id, page, table_id, row, 3, case when k % 4 = 1 and r = 2 then quantity || '.' else quantity end, {_NONE}, 'Quantity' from lines_of
  union all select doc_id, page, table_id, row, 4, discount, '%', case when k % 9 = 0 then 'page 3' else 'Discount' end from lines_of
  union all select doc_id, page, table_id, row, 5, case when k % 6 = 1 then {_NONE} else part || '9.25' end, {_NONE}, {_NONE} from lines_of where k % 6 in (1, 2)"""
STORE = f"select * from (with lines_of as ({_LINES_OF}) {_STORE}) stored_cells"
_PAGE = "'Order lists ' || {0}"
PAGE_TEXT = f"select doc_id, page, {_PAGE} as text from (select doc_id, page, r, p_name || ' ' || price || ' ' || quantity || ' ' || discount || '%' as line from ({_LINES_OF}) l) p group by doc_id, page"
STORE_COLUMNS = "doc_id, page, table_id, row, col, value, unit, header"
PAGE_COLUMNS = "doc_id, page, text"


def _printed(spark: SparkSession, sf_dir: str, by: str) -> DataFrame:
    """The lines as the store prints them, dealt by doc_id and `by`: table_id or page."""
    lines = numbered_lines(spark, sf_dir, ["doc_id", by])
    lines = lines if by == "page" else lines.withColumn("page", F.col("k"))
    text = lambda c, kind: F.col(c).cast(kind).cast("string")
    return lines.select(
        "doc_id", "page", "table_id", "k", "r", "p_name", text("l_extendedprice", "decimal(18, 2)").alias("price"), text("l_quantity", "int").alias("quantity"),
        (F.col("l_discount") * 100).cast("int").cast("string").alias("discount"), F.col("l_partkey").cast("string").alias("part"),
    )


_DEALT = ContextVar("dealt", default="table_id")


@contextmanager
def dealt_by(column: str) -> Iterator[None]:
    """Within it, the store is dealt by doc_id and this column, which the next steps go by: table_id or page."""
    token = _DEALT.set(column)
    try:
        yield
    finally:
        _DEALT.reset(token)


def store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of STORE in one pass over the lines."""
    k, r = F.col("k"), F.col("r")
    row = r + F.when(r > 2, 4).otherwise(2)
    none = F.lit(None).cast("string")

    def cell(row, col, value, unit=none, header="Item"):
        header = header if isinstance(header, Column) else F.lit(header)
        return F.struct(row.cast("int").alias("row"), F.lit(col).alias("col"), value.alias("value"), unit.alias("unit"), header.alias("header"))

    cut = (k % 3 == 0) & (r == 1)
    cells = [
        F.when(r == 1, cell(F.lit(1), 0, F.lit("Parts of the order"))),
        F.when((r == 1) & (k % 2 == 0), cell(F.lit(2), 0, F.lit("by price and quantity"))),
        F.when(r == 3, cell(F.lit(6), 0, F.lit("Later lines"))),
        cell(row, 0, F.when((k % 5 == 0) & (r % 2 == 1), "").otherwise(F.col("p_name"))),
        cell(row, 1, F.when(cut, F.substring("price", 1, 2)).otherwise(F.col("price")), F.when(cut, none).otherwise("USD"), "Price"),
        F.when(cut, cell(row, 2, F.substring("price", 3, 20), none, "Price")),
        cell(row, 3, F.when((k % 4 == 1) & (r == 2), F.concat("quantity", F.lit("."))).otherwise(F.col("quantity")), none, "Quantity"),
        cell(row, 4, F.col("discount"), F.lit("%"), F.when(k % 9 == 0, "page 3").otherwise("Discount")),
        F.when((k % 6).isin(1, 2), cell(row, 5, F.when(k % 6 == 2, F.concat("part", F.lit("9.25"))), none, none)),
    ]
    return cells_of(_printed(spark, sf_dir, _DEALT.get()), ["doc_id", "page", "table_id"], cells)


def page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of PAGE_TEXT, dealt by doc_id and page."""
    line = F.concat("p_name", F.lit(" "), "price", F.lit(" "), "quantity", F.lit(" "), "discount", F.lit("%"))
    lines = F.array_sort(F.collect_list(F.struct("r", line.alias("line"))))
    pages = _printed(spark, sf_dir, "page").groupBy("doc_id", "page").agg(lines.alias("lines"))
    return pages.select("doc_id", "page", F.concat(F.lit("Order lists "), F.array_join(F.transform("lines", lambda x: x["line"]), " ")).alias("text"))


STORE_SQL = "(" + STORE.replace("string)", "varchar)") + ")"
PAGES_SQL = "(" + PAGE_TEXT.replace("string)", "varchar)").format("string_agg(line, ' ' order by r)") + ")"
NUMBER = r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$"
#: Views over the small store that several oracles start from.
FILLED = f"""store as {STORE_SQL}, filled as (select *, regexp_matches(trim(value), '{NUMBER}') as numeric from store where value is not null and value <> '')"""
PREFIX = r"^-?\$?\(?-?[0-9,]*\.?[0-9]+\)?%?"


def norm_sql(x: str) -> str:
    """normalise_number in SQL."""
    out = f"regexp_extract(trim({x}), '{PREFIX}')"
    for pattern, to in [
        (r"%+$|,", ""), (r"^\$+", ""), (r"^\(-(.*)\)$", r"+\1"), (r"^\((.*)\)$", r"-\1"), (r"^\+", ""), (r"^(-?)0+([0-9])", r"\1\2"),
        (r"^(-?)\.", r"\g0."), (r"(\.[0-9]*?)0+$", r"\1"), (r"\.$", ""), (r"^-0$", "0"),
    ]:
        out = f"regexp_replace({out}, '{pattern}', '{to.replace('g0', '10')}', 'g')"
    return f"nullif({out}, '')"


def chunk_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.col("source").alias("doc_id"), F.col("doc_id").alias("page"), "text")


#: Windows of 800 characters, 100 shared, over every document as it is.
WINDOWS = """
windows as (
  select source as doc_id, doc_id as page, i as place, source || '_p' || doc_id || '_c' || i as chunk_id, substr(text, i * 700 + 1, 800) as text
  from (select *, unnest(generate_series(0, greatest(0, ceil((length(text) - 800) / 700.0))::int)) as i from documents where trim(text) <> '') s)
"""
#: Packed chunks of every document: no text has an empty line, so each is one paragraph, in windows where it is long.
CHUNKS = r"""
chunks as (
  select source as doc_id, doc_id as page, i as place, source || '_p' || doc_id || '_c' || i as chunk_id, substr(t, i * 700 + 1, 800) as text
  from (select *, unnest(generate_series(0, greatest(0, ceil((length(t) - 800) / 700.0))::int)) as i from (select *, regexp_replace(text, '^\s+|\s+$', '', 'g') as t from documents) where t <> '') s)
"""
SEARCH_STOP = "'the','a','an','and','or','of','in','on','for','to','was','were','is','are','at','by','with','from','that','this','it','as','be','been','has','have','had'"
TOKENS = rf"list_filter(list_transform(regexp_extract_all(lower(text), '[a-z0-9][a-z0-9.,\-]*'), lambda t: rtrim(t, '.,-')), lambda t: length(t) >= 2 and t not in ({SEARCH_STOP}))"
