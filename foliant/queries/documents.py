"""Queries on chunks, pages, cells, labels and detectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliant.functions import text as ft
from foliant.operators import cells as oc
from foliant.operators import chunking
from foliant.queries.fixtures import (
    CHUNKS,
    FILLED,
    NUMERIC_CELLS,
    PAGES_SQL,
    PREFIX,
    RAW_CELLS,
    REBUILT_CELLS,
    STORE_SQL,
    WINDOWS,
    chunk_pages,
    dealt_by,
    line_cells,
    literal,
    norm_sql,
    over_tables,
    page_text,
    raw_cells,
    store,
    table,
    values,
)

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


@query(f"with {WINDOWS} select doc_id, page, chunk_id, text from windows")
def chunk_windows(spark, sf_dir):
    return chunking.chunks(chunk_pages(spark, sf_dir), paragraphs=False)


@query(f"with {CHUNKS} select doc_id, page, chunk_id, text from chunks")
def chunk_pages_packed(spark, sf_dir):
    return chunking.chunks(chunk_pages(spark, sf_dir))


@query(r"""
with recursive paras as (
  select doc_id, row_number() over (partition by doc_id order by k) as k, p from (
    select doc_id, generate_subscripts(ps, 1) as k, unnest(ps) as p from (
      select doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') as ps from documents))),
steps(doc_id, k, cur, done) as (
  select distinct doc_id, 0::bigint, '', []::varchar[] from paras
  union all
  select s.doc_id, p.k,
    case when length(p.p) > 800 then '' when s.cur <> '' and length(s.cur) + length(p.p) + 2 <= 800 then s.cur || chr(10) || chr(10) || p.p else p.p end,
    case when length(p.p) > 800 then list_concat(case when s.cur = '' then []::varchar[] else [s.cur] end, list_transform(generate_series(0, greatest(0, ceil((length(p.p) - 800) / 700.0))::int), lambda i: substr(p.p, i * 700 + 1, 800)))
      when s.cur <> '' and length(s.cur) + length(p.p) + 2 > 800 then [s.cur] else []::varchar[] end
  from steps s join paras p on p.doc_id = s.doc_id and p.k = s.k + 1),
every as (
  select doc_id, k, unnest(done) as text, generate_subscripts(done, 1) as j from steps
  union all select doc_id, 1000000000, cur, 0 from (select *, row_number() over (partition by doc_id order by k desc) as r from steps) where r = 1 and cur <> '')
select source as doc_id, d.doc_id as page, source || '_p' || d.doc_id || '_c' || (row_number() over (partition by d.doc_id order by k, j) - 1) as chunk_id, e.text
from every e join documents d on d.doc_id = e.doc_id""")
def chunk_pack(spark, sf_dir):
    """Every line of the documents taken for a paragraph, packed into chunks."""
    pages = chunk_pages(spark, sf_dir)
    return chunking.chunks(pages.withColumn("text", F.replace("text", F.lit("\n"), F.lit("\n\n"))))


@query(r"""
with s as (select page_id, regexp_replace(html, '<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->', ' ', 'gis') as t from pages),
b as (select page_id, regexp_replace(t, '<[^>]*>', ' ', 'gs') as t from s)
select page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(t, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '\s+', ' ', 'g')) as text from b""")
def page_text_from_html(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", chunking.html_text(F.col("html")).alias("text"))


@query("""
select source as doc_id, doc_id as page, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: regexp_matches(w, '[0-9]')))::int as n_numeric
from documents where len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: regexp_matches(w, '[0-9]'))) >= 3""")
def page_looks_numeric(spark, sf_dir):
    return oc.numeric_pages(chunk_pages(spark, sf_dir), least=3)


_FORMATS = """select l_orderkey, l_linenumber, l_partkey, l_suppkey,
  case l_orderkey % 8 when 0 then {0} when 1 then '$' || {0} when 2 then '(' || {0} || ')' when 3 then {0} || '%' when 4 then {0} || ' r' when 5 then '€' || {1} when 6 then '(' || {1} || ')%' else '0.0000' || cast(l_partkey as {2}) end as raw
  from lineitem"""


@query(f"""with r as ({_FORMATS.format("format('{:,.2f}', l_extendedprice)", "format('{:,.2f}', l_extendedprice * 1000)", "varchar")}),
n as (select *, regexp_replace(cast(cast(regexp_replace(raw, '[^0-9.]', '', 'g') as double) as varchar), '\\.0$', '') as size from r)
select l_orderkey, l_linenumber, l_partkey, l_suppkey, raw, case when l_orderkey % 8 in (2, 6) and size <> '0' then '-' || size else size end as value,
  case l_orderkey % 8 when 1 then 'USD' when 3 then '%' when 5 then 'EUR' when 6 then '%' end as unit from n""")
def parse_cell_prices(spark, sf_dir):
    """Prices of all lines in the forms that tables print them in."""
    rows = over_tables(spark, sf_dir, _FORMATS.format("format_number(l_extendedprice, 2)", "format_number(l_extendedprice * 1000, 2)", "string"), "lineitem")
    return rows.withColumn("p", ft.parse_cell(F.col("raw"))).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "raw", "p.value", "p.unit")


_LABEL = "labels as (select doc_id, table_id, row, coalesce(substr(min_by(value, col) filter (not numeric), 1, 60), '') as row_label from filled group by all)"
_BANNER = """
singles as (select doc_id, table_id, row, min(value) as value from filled group by doc_id, table_id, row having count(*) = 1 and not bool_or(numeric)),
runs as (select *, row - row_number() over (partition by doc_id, table_id order by row) as run from singles),
banners as (select doc_id, table_id, max(row) as row, substr(string_agg(value, ' ' order by row), 1, 60) as section from runs group by doc_id, table_id, run)"""
_SECTION = """
rows_ as (select distinct doc_id, table_id, row from filled),
sections as (
  select r.doc_id, r.table_id, r.row, coalesce(last_value(b.section ignore nulls) over (partition by r.doc_id, r.table_id order by r.row rows between unbounded preceding and 1 preceding), '') as section
  from rows_ r left join banners b using (doc_id, table_id, row))"""
_LABELLED = """labelled as (
  select f.doc_id, f.table_id, f.row, f.col, f.page, f.value, f.unit, substr(coalesce(f.header, ''), 1, 50) as header, l.row_label, s.section
  from filled f join labels l using (doc_id, table_id, row) join sections s using (doc_id, table_id, row) where f.numeric)"""
_ALL = f"with {FILLED}, {_LABEL}, {_BANNER}, {_SECTION}, {_LABELLED}"


@query(f"with {FILLED}, {_LABEL} select * from labels")
def row_label(spark, sf_dir):
    return oc.row_labels(store(spark, sf_dir))


@query(f"with {FILLED}, {_BANNER} select doc_id, table_id, row, section from banners")
def banner_merge(spark, sf_dir):
    return oc.banners(store(spark, sf_dir))


@query(f"{_ALL} select doc_id, table_id, row, section from sections where section <> ''")
def section_asof(spark, sf_dir):
    return oc.sections(store(spark, sf_dir)).where("section <> ''")


ORACLE["section_asof"] = f"{_ALL} select distinct doc_id, table_id, row, section from labelled where section <> ''"


@query(f"{_ALL} select * from labelled")
def labelled_cells(spark, sf_dir):
    return oc.labelled(store(spark, sf_dir))


@query("""
with n as (select l_orderkey, count(*) as rows_ from lineitem group by l_orderkey)
select 'd' || (l_orderkey % 7) as doc_id, 't' || l_orderkey as table_id, rows_ * 6 as n_cells, rows_ * 4 as n_numbers from n where rows_ * 6 >= 6 and rows_ * 4 >= 4""")
def retrievable_tables(spark, sf_dir):
    return oc.retrievable(line_cells(spark, sf_dir))


_WORDS = "list_distinct(list_filter(regexp_extract_all(lower({0}), '[a-z0-9]+'), lambda t: length(t) > 2))"


@query(f"""
with c as ({NUMERIC_CELLS.replace('string', 'varchar')}),
s as (select *, len(list_intersect({_WORDS.format("'Tax on green parts of the R lines: l_tax'")}, {_WORDS.format("row_label || ' ' || header || ' ' || section")})) as relevance from c),
k as (select *, row_number() over (partition by doc_id, table_id order by relevance desc, row, col) as rank from s)
select doc_id, table_id, row, col, relevance, (row_number() over (partition by doc_id, table_id order by row, col))::int as cell_id from k where rank <= 5""")
def cell_relevance_cap(spark, sf_dir):
    cells = line_cells(spark, sf_dir, ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])
    return oc.relevant(cells, F.lit("Tax on green parts of the R lines: l_tax"), 5).select("doc_id", "table_id", "row", "col", "relevance", "cell_id")


_FURNITURE = r"^(quarterly|volume|number *[0-9]*|[0-9]{4} +volume|table +[ivx]+-?[a-z]?\b.*|[a-z]+ +[0-9]{1,2}, +[0-9]{4}|page *[0-9]+|[0-9]+)$"


@query(f"""{_ALL},
placed as (select *, row_number() over (partition by doc_id, table_id order by row, col) as place from labelled),
kinds as (
  select doc_id, table_id, place, 'section' as kind, section as text from placed union all
  select doc_id, table_id, place, 'row_label', row_label from placed union all select doc_id, table_id, place, 'header', header from placed),
seen as (select doc_id, table_id, kind, substr(text, 1, 40) as text, min(place) as place from kinds where length(text) >= 3 and not regexp_matches(text, '{_FURNITURE}', 'i') group by all),
ranked as (select *, row_number() over (partition by doc_id, table_id, kind order by place, text) as rank from seen),
kept as (select * from ranked where rank <= case kind when 'section' then 8 when 'row_label' then 24 else 10 end)
select doc_id, table_id, coalesce(string_agg(text, '; ' order by rank) filter (kind = 'section'), '') as section,
  coalesce(string_agg(text, '; ' order by rank) filter (kind = 'row_label'), '') as row_label, coalesce(string_agg(text, '; ' order by rank) filter (kind = 'header'), '') as header
from kept group by doc_id, table_id""")
def table_previews(spark, sf_dir):
    return oc.previews(store(spark, sf_dir))


@query(f"with {FILLED} select doc_id, table_id, row, string_agg(substr(trim(regexp_replace(value, '\\s+', ' ', 'g')), 1, 40), ' | ' order by col) as line from filled group by all")
def grid_render(spark, sf_dir):
    return oc.grid(store(spark, sf_dir))


_ZONE = """counts as (select doc_id, table_id, row, count(*) filter (numeric) as n, count(*) filter (not numeric and col in (0, 1)) as labels from filled group by all),
zone as (select doc_id, table_id, min(row) as zone_end from counts where n >= 3 group by all)"""


@query(f"with {FILLED}, {_ZONE} select doc_id, table_id, zone_end from zone")
def header_zone(spark, sf_dir):
    return oc.header_zone(store(spark, sf_dir))


@query(f"with {FILLED}, {_ZONE} select doc_id, table_id, row from counts join zone using (doc_id, table_id) where row >= zone_end and n > 0 and labels = 0")
def vacant_label_rows(spark, sf_dir):
    return oc.vacant_rows(store(spark, sf_dir))


_DIGITS = "nullif(regexp_replace(regexp_extract(trim({0}), '" + PREFIX + "'), '[,$]|%+$', '', 'g'), '')"
_TOKEN = f"page_tokens as (select distinct doc_id, page, {norm_sql('w')} as token from (select doc_id, page, unnest(regexp_split_to_array(text, '\\s+')) as w from {PAGES_SQL}))"
_NEXT = f"""adjacent as (
  select *, case when lead(col) over o = col + 1 then lead(value) over o end as next_value from filled window o as (partition by doc_id, page, table_id, row order by col))"""
_SPLIT = f"""cut as (
  select doc_id, page, table_id, row, col, {norm_sql('value')} as first, {_DIGITS.format('value')} as a, {_DIGITS.format('next_value')} as b from adjacent where next_value is not null),
split_ as (
  select c.* from cut c where a <> '' and b like '%.%' and a not like '%.%'
    and exists (select 1 from page_tokens t where t.doc_id = c.doc_id and t.page = c.page and t.token = {norm_sql('c.a || c.b')})
    and not exists (select 1 from page_tokens t where t.doc_id = c.doc_id and t.page = c.page and t.token = c.first)),
split_cells as (select distinct doc_id, page, table_id, row, unnest([col, col + 1]) as col from split_),
trunc_ as (select * from adjacent where regexp_matches(trim(value), '^-?\\$?[0-9,]+\\.$') and regexp_matches(trim(next_value), '^[0-9]')),
trunc_cells as (select distinct doc_id, page, table_id, row, unnest([col, col + 1]) as col from trunc_),
flagged as (select * from split_cells union select * from trunc_cells),
orphans as (
  select doc_id, page, table_id, row, col from filled f
  where regexp_matches(trim(value), '{PREFIX}$') and {norm_sql('value')} is not null
    and not exists (select 1 from flagged g where (g.doc_id, g.page, g.table_id, g.row, g.col) = (f.doc_id, f.page, f.table_id, f.row, f.col))
    and not exists (select 1 from page_tokens t where t.doc_id = f.doc_id and t.page = f.page and t.token = {norm_sql('f.value')}))"""


def _by_page(spark, sf_dir):
    """The store for what meets cells with their page's text."""
    with dealt_by("page"):
        return store(spark, sf_dir)


_DETECT = f"with {FILLED}, {_TOKEN}, {_NEXT}, {_SPLIT}"


@query(f"{_DETECT} select *, 'split-number' as reason from split_cells")
def split_number(spark, sf_dir):
    return oc.split_numbers(_by_page(spark, sf_dir), page_text(spark, sf_dir))


@query(f"{_DETECT} select *, 'split-number' as reason from trunc_cells")
def truncated_decimal(spark, sf_dir):
    return oc.truncated_decimals(_by_page(spark, sf_dir))


@query(f"{_DETECT} select *, 'orphan-number' as reason from orphans")
def orphan_number(spark, sf_dir):
    return oc.suspects(_by_page(spark, sf_dir), page_text(spark, sf_dir)).where("reason = 'orphan-number'")


@query(f"{_DETECT} select s.doc_id, s.page, s.table_id, s.row, s.col, s.value from store s where not exists (select 1 from flagged g where (g.doc_id, g.table_id, g.row, g.col) = (s.doc_id, s.table_id, s.row, s.col))")
def suspect_suppression(spark, sf_dir):
    cells = oc.judged(_by_page(spark, sf_dir), page_text(spark, sf_dir))
    return cells.where("reason is null or reason <> 'split-number'").select("doc_id", "page", "table_id", "row", "col", "value")


@query(f"{_DETECT}, every as (select doc_id, 'split-number' as reason from flagged union all select doc_id, 'orphan-number' from orphans) select doc_id, count(*) filter (reason = 'split-number') as split_number, count(*) filter (reason = 'orphan-number') as orphan_number from every group by doc_id")
def suspect_counts(spark, sf_dir):
    found = oc.suspects(_by_page(spark, sf_dir), page_text(spark, sf_dir))
    counted = found.groupBy("doc_id").pivot("reason", ["split-number", "orphan-number"]).count().na.fill(0)
    return counted.withColumnsRenamed({"split-number": "split_number", "orphan-number": "orphan_number"})


@query(f"""with w as (select doc_id, table_id, row, count(*) as width from {STORE_SQL} group by all),
e as (select *, first_value(width) over (partition by doc_id, table_id order by row) as expected from w) select * from e where width <> expected""")
def ragged_rows(spark, sf_dir):
    return oc.ragged_rows(store(spark, sf_dir))


@query(f"""with {FILLED} select doc_id, table_id, count(distinct row) as n_rows, count(distinct col) as n_cols, count(*) as n_filled,
round(count(*) filter (regexp_matches(value, '[0-9]')) / count(*), 6) as digit_share from filled group by all having n_rows >= 3 and n_cols >= 2 and n_filled >= 6 and digit_share >= 0.3""")
def plausible_tables(spark, sf_dir):
    return oc.plausible_tables(store(spark, sf_dir))


_BREAKS = "('src0', 'RECOVERED: fallback'), ('src0', 'REPAIRED: labels'), ('src1', 'no tables'), ('src1', 'RECOVERED: fallback'), ('src2', 'INCOMPLETE: rows')"


@query(f"""with {CHUNKS}, b as {values(_BREAKS, 'doc_id, reason')},
p as (select source as doc_id, count(distinct doc_id) as pages from documents group by source),
t as (select 'src' || (l_orderkey % 7) as doc_id, count(distinct l_orderkey) as tables, count(*) * 6 as cells from lineitem group by 1),
c as (select doc_id, count(*) as chunks from chunks group by 1),
k as (select doc_id, count(*) as breakages, count(*) filter (reason like 'RECOVERED:%') as recovered, count(*) filter (reason like 'REPAIRED:%') as repaired from b group by 1),
j as (select doc_id, coalesce(pages, 0) as pages, coalesce(tables, 0) as tables, coalesce(cells, 0) as cells, coalesce(chunks, 0) as chunks, coalesce(breakages, 0) as breakages, coalesce(recovered, 0) as recovered, coalesce(repaired, 0) as repaired
  from p full join t using (doc_id) full join c using (doc_id) full join k using (doc_id))
select case when grouping(doc_id) = 1 then 'TOTAL' else doc_id end as doc_id, sum(pages)::bigint as pages, sum(tables)::bigint as tables, sum(cells)::bigint as cells, sum(chunks)::bigint as chunks, sum(breakages)::bigint as breakages, sum(recovered)::bigint as recovered, sum(repaired)::bigint as repaired
from j group by rollup (doc_id)""")
def ingest_summary(spark, sf_dir):
    pages = chunk_pages(spark, sf_dir)
    cells = line_cells(spark, sf_dir).withColumn("doc_id", F.regexp_replace("doc_id", "^d", "src"))
    return oc.ingest_summary(pages, cells, chunking.chunks(pages), literal(spark, _BREAKS, "doc_id, reason"))


@query("select distinct 'd' || (l_orderkey % 7) as doc_id, 't' || l_orderkey as table_id, l_orderkey % 50 + 1 as page from lineitem")
def distinct_tables(spark, sf_dir):
    return line_cells(spark, sf_dir).select("doc_id", "table_id", "page").distinct()


# --- raw tables of an extractor, over all lines ---


def _parsed(spark, sf_dir, rebuilt=False):
    return oc.parsed(raw_cells(spark, sf_dir, rebuilt))


def _plain(sql):
    """Filled raw cells with the number each one is, in SQL of its own."""
    return f"""raw as ({sql.replace('string', 'varchar')}),
filled as (select *, regexp_matches(trim(raw), '^[$]?[0-9.]+%?$') as numeric from raw where trim(raw) <> ''),
counts as (select doc_id, table_id, row, count(*) filter (numeric) as n, count(*) filter (not numeric and col in (0, 1)) as labels from filled group by all),
zone as (select doc_id, table_id, min(row) as zone_end from counts where n >= 3 group by all),
heads as (select f.doc_id, f.table_id, f.col, string_agg(trim(regexp_replace(f.raw, '\\s+', ' ', 'g')), ' ' order by f.row) as header from filled f join zone z using (doc_id, table_id) where f.row < z.zone_end group by all)"""


@query(f"with {_plain(RAW_CELLS)} select * from heads")
def header_concatenation(spark, sf_dir):
    return oc.zone_headers(_parsed(spark, sf_dir).drop("header"))


@query(f"""with {_plain(RAW_CELLS)} select r.doc_id, r.page, r.table_id, r.row, r.col, h.header,
  case when trim(r.raw) <> '' then regexp_replace(regexp_replace(regexp_replace(trim(r.raw), '^[$]|%$', '', 'g'), '^([0-9]+[.][0-9]*?)0+$', '\\1'), '[.]$', '') end as value,
  case when regexp_matches(r.raw, '^[$][0-9]') then 'USD' when regexp_matches(r.raw, '[0-9]%$') then '%' end as unit
from raw r left join heads h using (doc_id, table_id, col)""")
def parsed_tables(spark, sf_dir):
    return _parsed(spark, sf_dir).select("doc_id", "page", "table_id", "row", "col", "header", "value", "unit")


_VACANT = "vacant{0} as (select doc_id, table_id, count(*) as n{0} from counts{0} join zone{0} using (doc_id, table_id) where row >= zone_end and n > 0 and labels = 0 group by all)"
_BOTH = f"""with {_plain(RAW_CELLS)}, {_VACANT.format('')},
""" + _plain(REBUILT_CELLS).replace("raw as", "raw2 as").replace("from raw where", "from raw2 where").replace("filled as", "filled2 as").replace("from filled ", "from filled2 ").replace("from filled f", "from filled2 f").replace("counts as", "counts2 as").replace("from counts ", "from counts2 ").replace("zone as", "zone2 as").replace("join zone z", "join zone2 z").replace("heads as (select f", "heads2 as (select f") + """,
vacant2 as (select doc_id, table_id, count(*) as n2 from counts2 join zone2 using (doc_id, table_id) where row >= zone_end and n > 0 and labels = 0 group by all),
judged as (select doc_id, table_id, v.n, coalesce(n2, 0) as n2 from vacant v left join vacant2 using (doc_id, table_id) where v.n >= 2)"""


@query(f"""{_BOTH}, better as (select doc_id, table_id from judged where n2 < n)
select doc_id, table_id, count(*) as n_cells, count(*) filter (col = 0 and trim(raw) <> '') as n_labels from (
  select * from raw r where not exists (select 1 from better b where b.doc_id = r.doc_id and b.table_id = r.table_id) union all
  select r.* from raw2 r join better b on b.doc_id = r.doc_id and b.table_id = r.table_id) group by all""")
def label_repair(spark, sf_dir):
    """Cells and labels of each table once those without row labels have been replaced by rebuilt ones that are better."""
    done = oc.repaired(_parsed(spark, sf_dir), _parsed(spark, sf_dir, rebuilt=True))
    return done.groupBy("doc_id", "table_id").agg(F.count("*").alias("n_cells"), F.count_if(F.expr("col = 0 and value <> ''")).alias("n_labels"))


@query(f"""{_BOTH} select doc_id, table_id, 'REPAIRED: ' || n || ' rows without a label, now ' || n2 as reason from judged where n2 < n
union all select doc_id, table_id, 'INCOMPLETE: ' || (case when n2 < n then n2 else n end) || ' rows without a label' from judged where (case when n2 < n then n2 else n end) > 0""")
def label_repair_log(spark, sf_dir):
    return oc.repair_log(_parsed(spark, sf_dir), _parsed(spark, sf_dir, rebuilt=True))


@query("""with p as (select source as doc_id, doc_id as page, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: regexp_matches(w, '[0-9]')))::int as n_numeric from documents)
select p.* from p where n_numeric >= 3 and not exists (select 1 from lineitem l where 'src' || (l_orderkey % 7) = p.doc_id and l_orderkey % 50 + 1 = p.page)""")
def fallback_trigger(spark, sf_dir):
    """Pages that read as numeric and have no stored table (three numbers are enough here)."""
    cells = line_cells(spark, sf_dir, ["l_tax"]).withColumn("doc_id", F.regexp_replace("doc_id", "^d", "src"))
    return oc.fallback_pages(chunk_pages(spark, sf_dir), cells, least=3)


@query("select distinct source as doc_id, 't' || doc_id as table_id from documents where doc_id % 3 = 0")
def blank_tables(spark, sf_dir):
    """A table for each document: of every third its cells are white space."""
    words = F.slice(F.split("text", " "), 1, 3)
    rows = table(spark, sf_dir, "documents").select(F.col("source").alias("doc_id"), "doc_id", words.alias("w")).toDF("doc_id", "k", "w")
    cells = rows.select("doc_id", F.concat(F.lit("t"), F.col("k").cast("string")).alias("table_id"), F.explode("w").alias("value"), "k")
    return oc.blank_tables(cells.withColumn("value", F.when(F.col("k") % 3 == 0, " ").otherwise(F.concat(F.lit("x"), "value"))).drop("k"))


_TITLES = "select distinct source as doc_id, case when length(source) % 2 = 0 then 'Report ' || source end as title from documents"


@query(f"with {CHUNKS}, t as ({_TITLES}) select chunk_id, doc_id, coalesce(title, doc_id) as title from chunks left join t using (doc_id)")
def document_titles(spark, sf_dir):
    titles = over_tables(spark, sf_dir, _TITLES, "documents")
    return oc.with_titles(chunking.chunks(chunk_pages(spark, sf_dir)), titles).select("chunk_id", "doc_id", "title")


@query(f"""with c as ({NUMERIC_CELLS.replace('string', 'varchar')}),
k as (select *, row_number() over (partition by doc_id, table_id order by row, col) as place from c where length(row_label) >= 4 and header <> '' and not (regexp_full_match(num::bigint::varchar, '(19|20)[0-9]{{2}}') and unit is null and num = floor(num)) and table_id not like '%7')
select doc_id, table_id, row, col, place::int as place from k where place <= 6""")
def gold_candidates(spark, sf_dir):
    """Cells worth asking about, of tables that no report marks incomplete (here: those whose id ends in 7)."""
    cells = line_cells(spark, sf_dir, ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])
    incomplete = cells.where("table_id like '%7'")
    return oc.gold_candidates(cells, incomplete).select("doc_id", "table_id", "row", "col", "place")


@query(f"""with c as ({NUMERIC_CELLS.replace('string', 'varchar')}), g as (select *, count(*) over (partition by doc_id, table_id) as n_good from c where length(row_label) > 9 and (header <> '' or section <> ''))
select doc_id, table_id, row, col, n_good from g where n_good >= 12""")
def training_cells(spark, sf_dir):
    cells = line_cells(spark, sf_dir, ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])
    return oc.training_cells(cells, longer=9, least=12).select("doc_id", "table_id", "row", "col", "n_good")


@query("select distinct 'd' || (l_orderkey % 7) as doc_id, 't' || l_orderkey as table_id from lineitem order by doc_id, table_id limit 40")
def first_tables(spark, sf_dir):
    """The feature is the limit: a report lists the first tables."""
    return line_cells(spark, sf_dir, ["l_tax"]).select("doc_id", "table_id").distinct().orderBy("doc_id", "table_id").limit(40)


@query("select doc_id, (row_number() over (partition by doc_id order by table_id))::int as table_no, table_id from (select distinct 'd' || (l_orderkey % 7) as doc_id, 't' || l_orderkey as table_id from lineitem)")
def numbered_tables(spark, sf_dir):
    return oc.numbered_tables(line_cells(spark, sf_dir, ["l_tax"])).select("doc_id", "table_no", "table_id")


@query("select d.doc_id, case when d.doc_id % 4 = 0 then 'new' else d.source end as source from documents d union all select doc_id + 1000000000, 'new' from documents where doc_id % 4 = 1")
def upsert_by_key(spark, sf_dir):
    """New rows replace those of their key and are added otherwise."""
    from foliant.sources import store as st

    old = table(spark, sf_dir, "documents").select("doc_id", "source")
    new = old.where("doc_id % 4 = 0").unionByName(old.where("doc_id % 4 = 1").withColumn("doc_id", F.col("doc_id") + 1000000000)).withColumn("source", F.lit("new"))
    return st.upserted(old, new, ["doc_id"])


@query("select '| ' || doc_id || ' | ' || coalesce(replace(lang, '|', '\\|'), '') || ' | ' || source || ' |' as line from documents")
def report_lines(spark, sf_dir):
    from foliant.sources import store as st

    return st.pipe_table(table(spark, sf_dir, "documents"), ["doc_id", "lang", "source"])
