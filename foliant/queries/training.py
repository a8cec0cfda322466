"""Queries on training examples: cell selection drawn from all orders' tables, its checks and records, near copies kept once."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliant.operators import cellexamples
from foliant.queries.fixtures import NUMERIC_CELLS, line_cells
from foliant.session import stored

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


#: Examples asked for; the number is the feature.
TARGET, ROUNDS = 3000, 4


def _pick(what: str, n: int) -> str:
    return f"(('0x' || md5('cells:{what}|' || doc_id || '|' || table_id || '|' || attempt)[1:7])::bigint % {n} + 1)"


def _h(what: str) -> str:
    return f"md5('cells:{what}|' || doc_id || '|' || table_id || '|' || attempt || '|' || row || '|' || col)"


def _listed(values) -> str:
    return "[" + ", ".join(repr(v) for v in values) + "]"


_CELL = "{'page': page, 'row': row, 'col': col, 'value': value, 'unit': unit, 'row_label': row_label, 'header': header, 'section': section}"
_SKELETONS = "map {" + ", ".join(f"'{o}': {_listed(ts)}" for o, ts in cellexamples.TEMPLATES.items()) + "}"
_FITS = "case regime when 'same_row_other_col' then cell.row = t.row when 'same_col_other_row' then cell.col = t.col when 'same_section_other_row' then cell.section = t.section else cell.row_label = t.row_label and cell.section <> t.section end"
_LABELS = "lower({0}.row_label || chr(1) || {0}.header || chr(1) || {0}.section)"
_DIGITS = "length(regexp_replace(x.row_label, '[^0-9]', '', 'g')) / length(x.row_label) > 0.4"
_CUT = "trim(trim({0})[1:{1}])"
_MADE = f"""
numeric_ as ({NUMERIC_CELLS.replace('string', 'varchar')}),
usable as (select *, num::varchar as value from numeric_ where length(row_label) > 5 qualify count(*) over (partition by doc_id, table_id) >= 4),
rows_ as (select *, {_CELL} as cell from usable, (select unnest(range({ROUNDS}))::int as attempt)),
tries as (select distinct doc_id, table_id, attempt, {_listed(cellexamples.OPERATIONS)}[{_pick('operation', 9)}] as operation, {_listed(cellexamples.LIST_SIZES)}[{_pick('size', 3)}] as wanted, {_listed(cellexamples.REGIMES)}[{_pick('regime', 4)}] as regime from rows_),
firsts as (select doc_id, table_id, attempt, arg_min(cell, [{_h('first')}, lpad(row::varchar, 9, '0'), lpad(col::varchar, 9, '0')]) as a from rows_ group by all),
columns_ as (select r.*, operation, a from rows_ r join firsts using (doc_id, table_id, attempt) join tries using (doc_id, table_id, attempt) where r.col = a.col),
found as (
  select doc_id, table_id, attempt, count(*) as n_column, arg_min(cell, [{_h('second')}, lpad(row::varchar, 9, '0')]) filter (cell.row_label <> a.row_label) as b,
    first(cell order by case when operation = 'max' then -num else num end, row, col) as best from columns_ group by all),
aimed as (
  select doc_id, table_id, attempt, operation, wanted, regime, case when operation in ('diff', 'ratio', 'pct_change', 'sum') then [a, b] when operation in ('max', 'min') then [best] else [a] end as targets
  from tries join firsts using (doc_id, table_id, attempt) join found using (doc_id, table_id, attempt)
  where (operation not in ('diff', 'ratio', 'pct_change', 'sum') or b is not null) and (operation not in ('max', 'min') or n_column >= 3)),
clean as (select *, targets[1] as t from aimed where len(list_filter(targets, lambda x: {_DIGITS})) = 0),
pool as (select r.doc_id, r.table_id, r.attempt, r.row, r.col, r.cell, c.t, c.wanted, len(c.targets) as n, case when {_FITS} then 0 else 1 end as first from rows_ r join clean c using (doc_id, table_id, attempt)
  where len(list_filter(c.targets, lambda x: x.row = r.row and x.col = r.col)) = 0),
chosen as (select * from pool qualify row_number() over (partition by doc_id, table_id, attempt order by first, {_h('distract')}, row, col) <= wanted - n),
kept as (select doc_id, table_id, attempt, coalesce(list(cell) filter ({_LABELS.format('cell')} <> {_LABELS.format('t')}), []) as others from chosen group by all),
shown as (select c.*, list_concat(targets, others) as every from clean c join kept using (doc_id, table_id, attempt) where len(targets) + len(others) >= 4),
placed as (
  select doc_id, table_id, attempt, unnest(every) as cell from shown),
numbered as (select *, row_number() over (partition by doc_id, table_id, attempt order by md5('cells:order|' || doc_id || '|' || table_id || '|' || attempt || '|' || cell.row || '|' || cell.col), cell.row, cell.col)::int as id from placed),
lists as (
  select doc_id, table_id, attempt, list({{'id': id, 'value': cell.value, 'unit': cell.unit, 'row_label': {_CUT.format('cell.row_label', 60)}, 'header': cell.header, 'section': cell.section, 'row': cell.row, 'col': cell.col}} order by id) as candidates from numbered group by all),
skeletons as (select *, {_SKELETONS} as sk from shown),
filled_ as (
  select doc_id || '|' || table_id || '|' || attempt as id, doc_id, table_id, attempt, operation, regime, targets, t.page as page,
    replace(replace(replace(replace(replace(sk[operation][('0x' || md5('cells:skeleton|' || doc_id || '|' || table_id || '|' || attempt)[1:7])::bigint % len(sk[operation]) + 1], '{{doc}}', doc_id), '{{row}}', {_CUT.format('t.row_label', 40)}),
      '{{other}}', {_CUT.format('targets[-1].row_label', 40)}), '{{col}}', t.header), '{{sec}}', case when t.section <> '' then ' in ' || t.section else '' end) as question from skeletons),
ready as (
  select f.*, candidates, list_transform(targets, lambda x: list_filter(candidates, lambda c: c.row = x.row and c.col = x.col)[1].id) as answer_cells, list_transform(targets, lambda x: x.value) as answer_values
  from filled_ f join lists using (doc_id, table_id, attempt)),
examples as (select * from ready qualify row_number() over (order by case when attempt < last_ then 0 else 1 end, attempt, md5('cells:keep|' || id), id) <= {TARGET})"""
#: The round in which the target is met: of it those first by the draw are kept, of those before it all.
_EXAMPLES = f"with {_MADE.replace('examples as (', 'totals as (select attempt, sum(count(*)) over (order by attempt) as upto from ready group by attempt), cut as (select coalesce(min(attempt) filter (upto >= ' + str(TARGET) + '), ' + str(ROUNDS) + ') as last_ from totals), examples as (').replace('select * from ready qualify', 'select ready.* from ready, cut qualify')}"


def _examples(spark, sf_dir):
    cells = line_cells(spark, sf_dir, ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])
    return stored(cellexamples.generate(cells, TARGET, most_rounds=ROUNDS), "examples")


_FLAT = "id, operation, regime, question, page, {0} as answer_cells, {1} as answer_values, {2} as candidates"


@query(f"""{_EXAMPLES} select {_FLAT.format("array_to_string(answer_cells, ',')", "array_to_string(answer_values, ',')", "array_to_string(list_transform(candidates, lambda c: c.id || ':' || c.value || ':' || coalesce(c.unit, '') || ':' || c.row_label || ':' || c.header || ':' || c.section), ';')")} from examples""")
def cell_examples(spark, sf_dir):
    """Examples of cell selection: question, answer cells among the candidates shown, their values."""
    c = lambda x: F.concat(x["id"].cast("string"), F.lit(":"), x["value"], F.lit(":"), F.coalesce(x["unit"], F.lit("")), F.lit(":"), x["row_label"], F.lit(":"), x["header"], F.lit(":"), x["section"])
    return _examples(spark, sf_dir).select(
        "id", "operation", "regime", "question", "page", F.array_join(F.transform("answer_cells", lambda i: i.cast("string")), ",").alias("answer_cells"),
        F.array_join("answer_values", ",").alias("answer_values"), F.array_join(F.transform("candidates", c), ";").alias("candidates"),
    )


_N = "(('0x' || md5(id)[1:4])::bigint % 13)"
_TWIN = "list_transform(candidates, lambda c: {'id': c.id, 'value': c.value, 'unit': c.unit, 'row_label': candidates[answer_cells[1]].row_label, 'header': candidates[answer_cells[1]].header, 'section': candidates[answer_cells[1]].section, 'row': c.row, 'col': c.col})"
_DIGITED = "list_transform(candidates, lambda c: {'id': c.id, 'value': c.value, 'unit': c.unit, 'row_label': '8.8 8.4 ' || c.row_label[1:1], 'header': c.header, 'section': c.section, 'row': c.row, 'col': c.col})"
_FAULTY = f"""faulty as (
  select id, doc_id, table_id, case {_N} when 5 then 'max' else operation end as operation, case {_N} when 2 then [99] else answer_cells end as answer_cells,
    case {_N} when 0 then 'Short?' when 1 then question || ' {{row}}' when 3 then question || ' Is it ' || answer_values[1] || '?' when 5 then 'What is the highest entry of them all?' else question end as question,
    case {_N} when 4 then {_TWIN} when 6 then {_DIGITED} else candidates end as candidates from examples)"""


def _faulty(rows):
    """Examples of which some were made faulty, by a hash of their id."""
    n = F.conv(F.substring(F.md5("id"), 1, 4), 16, 10).cast("long") % 13
    target = F.element_at("candidates", F.col("answer_cells")[0])
    alike = lambda c: c.withField("row_label", target["row_label"]).withField("header", target["header"]).withField("section", target["section"])
    digits = lambda c: c.withField("row_label", F.concat(F.lit("8.8 8.4 "), F.substring(c["row_label"], 1, 1)))
    q = F.col("question")
    question = (
        F.when(n == 0, "Short?").when(n == 1, F.concat(q, F.lit(" {row}"))).when(n == 3, F.concat(q, F.lit(" Is it "), F.col("answer_values")[0], F.lit("?")))
        .when(n == 5, "What is the highest entry of them all?").otherwise(q)
    )
    return rows.select(
        "id", "doc_id", "table_id", F.when(n == 5, "max").otherwise(F.col("operation")).alias("operation"), F.when(n == 2, F.array(F.lit(99))).otherwise(F.col("answer_cells")).alias("answer_cells"),
        question.alias("question"), F.when(n == 4, F.transform("candidates", alike)).when(n == 6, F.transform("candidates", digits)).otherwise(F.col("candidates")).alias("candidates"),
    )


_GRAMS = "case when len(t) >= 5 then list_distinct(list_transform(generate_series(1, len(t) - 4), lambda i: array_to_string(t[i:i + 4], ' '))) else [] end"
_TOK = "regexp_extract_all(lower(question), '[a-z0-9.]+')"
_CHECKED = f"""{_EXAMPLES}, {_FAULTY},
eval_cells as (select distinct doc_id, table_id, lower(trim(row_label)) as l, lower(trim(section)) as s from numeric_ where k % 11 = 0 and col = 1),
eval_questions as (select question from examples where {_N} = 12 and attempt = 0),
ga as (select id, len(g) as n, unnest(g) as gram from (select id, {_GRAMS} as g from (select id, {_TOK} as t from faulty))),
gb as (select question, len(g) as n, unnest(g) as gram from (select question, {_GRAMS} as g from (select distinct question, {_TOK} as t from eval_questions))),
near as (select distinct id from (select a.id, count(*) as both_, a.n as na, b.n as nb from ga a join gb b using (gram) group by a.id, b.question, a.n, b.n) where round(both_ / (na + nb - both_), 6) >= 0.6),
aimed_ as (select *, list_filter(candidates, lambda c: list_contains(answer_cells, c.id)) as ts from faulty),
inside as (select distinct a.id from (select id, doc_id, table_id, unnest(ts) as x from aimed_) a join eval_cells e on e.doc_id = a.doc_id and e.table_id = a.table_id and e.l = lower(trim(a.x.row_label)) and e.s = lower(trim(a.x.section))),
judged_ as (
  select id, list_filter([case when length(question) not between 20 and 260 then 'question_length' end, case when regexp_matches(question, '[{{}}]') then 'unfilled_placeholder' end, case when len(ts) = 0 then 'target_missing' end,
    case when len(list_filter(ts, lambda x: {_DIGITS})) > 0 then 'label_mostly_digits' end, case when len(list_filter(ts, lambda x: list_contains({_TOK}, lower(x.value)))) > 0 then 'value_leaked' end,
    case when len(ts) > 0 and len(list_filter(candidates, lambda c: not list_contains(answer_cells, c.id) and {_LABELS.format('c')} = {_LABELS.format('ts[1]')})) > 0 then 'ambiguous' end,
    case when operation in ('max', 'min') and not regexp_matches(lower(question), 'column|for |under |among') then 'superlative_without_column' end,
    case when exists (select 1 from inside i where i.id = aimed_.id) then 'contaminated_cell' end, case when exists (select 1 from near m where m.id = aimed_.id) then 'contaminated_question' end], lambda x: x is not null) as r from aimed_)""".replace("where k % 11 = 0", "where table_id[2:]::bigint % 11 = 0")


def _eval_cells(spark, sf_dir):
    cells = line_cells(spark, sf_dir, ["l_quantity"])
    return cells.where(F.substring("table_id", 2, 20).cast("long") % 11 == 0)


@query(f"{_CHECKED} select id, array_to_string(r, ',') as reasons, len(r) = 0 as passed from judged_")
def cell_example_checks(spark, sf_dir):
    """Every drawn example, some made faulty, against all its rules; what the rules need is found from the examples."""
    made = _examples(spark, sf_dir)
    faulty = stored(_faulty(made), "faulty")
    asked = made.where((F.conv(F.substring(F.md5("id"), 1, 4), 16, 10).cast("long") % 13 == 12) & (F.col("attempt") == 0)).select("id", F.col("question").alias("text"))
    return cellexamples.check_examples(faulty, asked, _eval_cells(spark, sf_dir))


@query(f"""{_EXAMPLES}, lines as (select id, question, operation, answer_cells, unnest(candidates) as c from examples)
select id, 'Question: ' || question || chr(10) || chr(10) || 'Candidate cells:' || chr(10) || string_agg('  [' || c.id || '] ' || c.value || case when c.unit <> '' then ' ' || c.unit else '' end || '  (row: "' || c.row_label || '" | column: "' || c.header || '"' || case when c.section <> '' then ' | section: "' || c.section || '"' else '' end || ')', chr(10) order by c.id)
  || chr(10) || chr(10) || 'Reply with a JSON plan: the operation and the numbers of its cells.' as prompt, '{{"operation":"' || operation || '","cells":[' || array_to_string(answer_cells, ',') || ']}}' as completion from lines group by id, question, operation, answer_cells""")
def cell_training_records(spark, sf_dir):
    return cellexamples.training_records(_examples(spark, sf_dir))


# --- near copies, kept once in order ---

_TOKENS_OF = "regexp_extract_all(lower(text), '[a-z0-9.]+')"


def _greedy_sql(source: str) -> str:
    """The sequential rule by a recursion over the rows that have an earlier close one; all others stay."""
    return f"""with recursive texts as ({source}), sets as (select id, {_GRAMS} as g from (select id, {_TOKENS_OF} as t from texts)),
grams as (select id, len(g) as n, unnest(g) as gram from sets),
pairs as (select a, b from (select x.id as a, y.id as b, x.n as na, y.n as nb, count(*) as both_ from grams x join grams y using (gram) where x.id < y.id group by all) where round(both_ / (na + nb - both_), 6) >= 0.85),
late as (select b, list(a order by a) as before, row_number() over (order by b) as k from pairs group by b),
walk as (
  select 0::bigint as k, []::bigint[] as gone union all
  select l.k, case when len(list_filter(l.before, lambda a: not list_contains(w.gone, a))) > 0 then list_append(w.gone, l.b) else w.gone end from walk w join late l on l.k = w.k + 1),
gone as (select unnest(gone) as id from walk qualify k = max(k) over ()),
of_ as (select b as id, min(a) as of from pairs where a not in (select id from gone) group by b)
select id, id not in (select id from gone) as kept, case when id in (select id from gone) then of end as of from texts left join of_ using (id)"""


@query(_greedy_sql("select doc_id as id, text from documents"))
def greedy_keep(spark, sf_dir):
    """Documents that a pass in order keeps: each unless a kept one before it is within 0.85."""
    from foliant.operators import traindata
    from foliant.queries.fixtures import table

    return traindata.greedy_keep(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"))


@query(_greedy_sql("select conv_id * 100 + turn as id, text from conversations union all select 1000000000 + item_id, text from benchmark union all select 2000000000 + item_id, text || ' and once more' from benchmark where length(text) > 60"))
def greedy_keep_turns(spark, sf_dir):
    """The same over all conversations' turns, and evaluation texts beside longer copies of theirs."""
    from foliant.operators import traindata
    from foliant.queries.fixtures import table

    turns = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), "text")
    items = table(spark, sf_dir, "benchmark")
    longer = items.where(F.length("text") > 60).select((F.lit(2_000_000_000) + F.col("item_id")).alias("id"), F.concat("text", F.lit(" and once more")).alias("text"))
    return traindata.greedy_keep(turns.unionByName(items.select((F.lit(1_000_000_000) + F.col("item_id")).alias("id"), "text")).unionByName(longer))


@query()
def qc_multidoc(spark, sf_dir):
    """Questions over two documents, as they are generated from all chunks, against their rules and a tokenizer's budget."""
    from foliant.operators import traindata
    from foliant.plans.providers import token_counts
    from foliant.queries.evaluation import gen_multidoc

    made = stored(gen_multidoc(spark, sf_dir), "pairs").withColumn("id", F.col("chunk_id")).withColumn("eval_figures", F.array().cast("array<string>"))
    return traindata.check_pairs(traindata.with_tokens(made, token_counts))


@query()
def chat_examples(spark, sf_dir):
    """Questions over two documents that pass their checks, as conversations with what they were made from."""
    from foliant.operators import traindata
    from foliant.plans.providers import token_counts
    from foliant.queries.evaluation import gen_multidoc

    made = stored(gen_multidoc(spark, sf_dir), "pairs").withColumn("id", F.col("chunk_id")).withColumn("eval_figures", F.array().cast("array<string>"))
    passed = traindata.check_pairs(traindata.with_tokens(made, token_counts)).where("passed").select("id")
    return traindata.chat_examples(made.join(passed, "id", "left_semi"))
