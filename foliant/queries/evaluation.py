"""Queries on grading, metrics, training sets and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliant.functions import text as ft
from foliant.operators import chunking, evaluate, reports, traindata
from foliant.operators.evaluate import reason_histogram
from foliant.queries.fixtures import CHUNKS, chunk_pages, literal, over_tables, table, values
from foliant.session import stored

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


# --- grading ---


_NUMBERS = ["8", "252", "8.2", "1.36", "555", "token", "1.5", "and", ""]


@query(f"""with n as (select unnest([{', '.join(repr(n) for n in _NUMBERS)}]) as needle), t as (select doc_id, replace(text, ',', '') as t from documents)
select doc_id, needle, case when needle = '' then false when regexp_full_match(needle, '-?[0-9]+([.][0-9]+)?')
  then regexp_matches(t, '(^|[^0-9.]|(^|[^0-9])[.])' || replace(needle, '.', '[.]') || '($|[^0-9.]|[.]($|[^0-9]))') else contains(t, needle) end as found from t, n""")
def needles_in_documents(spark, sf_dir):
    """Numbers as complete numbers and words as parts, in all documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.explode(F.array(*[F.lit(n) for n in _NUMBERS])).alias("needle"))
    return docs.select("doc_id", "needle", ft.matches_needle(F.col("text"), F.col("needle")).alias("found"))


@query(r"""with n as (select item_id, regexp_extract_all(text, '[A-Za-z]{6,}') as words from benchmark), c as (select d.doc_id, n.item_id, list_filter(n.words, lambda w: not contains(replace(d.text, ',', ''), w)) as gone, len(n.words) as n from documents d join n on d.doc_id % 40 = n.item_id)
select doc_id, item_id, case when n = 0 then 0.0 else round((n - len(gone)) / n, 6) end as credit from c""")
def partial_credit(spark, sf_dir):
    items = table(spark, sf_dir, "benchmark").select("item_id", F.regexp_extract_all("text", F.lit("[A-Za-z]{6,}"), 0).alias("needles"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (F.col("doc_id") % 40).alias("item_id"))
    return docs.join(items, "item_id").select("doc_id", "item_id", F.round(evaluate.partial_credit("text", "needles"), 6).alias("credit"))


def _bench(spark, sf_dir):
    """Bench rows from events: type, latency, memory, and whether the answer and its citation were right."""
    e = table(spark, sf_dir, "events")
    n = F.col("event_id")
    return e.select(
        n.alias("id"),
        F.col("event_type").alias("type"),
        F.col("value").alias("latency_s"),
        (F.col("value") < 100).alias("correct"),
        (n % 3 != 0).alias("citation_ok"),
        (n % 61 / 10).alias("memory_gb"),
        (n % 301).cast("double").alias("swap_mb"),
    )


@query("select case when grouping(event_type) = 1 then 'OVERALL' else event_type end as type, count(*) as n, count(*) filter (value < 100) as n_correct, round(count(*) filter (value < 100) / count(*), 3) as accuracy, count(*) filter (event_id % 3 <> 0) as n_cited, round(count(*) filter (event_id % 3 <> 0) / count(*), 3) as citation_rate from events group by rollup (event_type)")
def accuracy_by_type(spark, sf_dir):
    return evaluate.accuracy_by_type(_bench(spark, sf_dir))


@query("select event_type as type, count(*) as n, round(quantile_cont(value, 0.5), 6) as p50, round(quantile_cont(value, 0.95), 6) as p95, round(avg(value), 6) as mean, round(max(value), 6) as max from events group by event_type")
def latency_percentiles(spark, sf_dir):
    return evaluate.percentiles_by(_bench(spark, sf_dir), "type", "latency_s")


@query("select count(*) as n, count(*) filter (value < 100) as n_correct, round(count(*) filter (event_id % 3 <> 0) / count(*), 3) as citation_rate, round(quantile_cont(value, 0.5), 6) as p50, round(quantile_cont(value, 0.95), 6) as p95, round(avg(value), 6) as mean_s, round(sum(value), 4) as wall_s, round(max(event_id % 61 / 10), 3) as memory_gb, max(event_id % 301)::double as swap_mb from events")
def run_summary(spark, sf_dir):
    return evaluate.run_summary(_bench(spark, sf_dir))


@query("select event_id as id, event_type as type, value as latency_s, value < 100 as correct from events where event_id % 3 <> 0")
def resume_antijoin(spark, sf_dir):
    rows = _bench(spark, sf_dir).select("id", "type", "latency_s", "correct")
    return evaluate.resume(rows, rows.where("id % 3 = 0"))


@query("select event_id as id, event_id % 3 <> 0 as is_new, case when event_id % 3 <> 0 then value end as latency_s from events")
def resume_union(spark, sf_dir):
    """All rows of a resumed run: old ones stay, answered questions are not asked again."""
    rows = _bench(spark, sf_dir).select("id", "latency_s")
    old = rows.where("id % 3 = 0").select("id", F.lit(False).alias("is_new"))
    return evaluate.resumed(old, rows.withColumn("is_new", F.lit(True)))


@query("select user_id, event_id, event_type from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as k from events) where k = 1")
def keep_last_per_id(spark, sf_dir):
    return evaluate.keep_last(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "ts"), "user_id", "ts", "event_id").drop("ts")


@query("select event_type, event_id, round(avg(case when value < 100 then 1.0 else 0.0 end::double) over (partition by event_type order by event_id rows unbounded preceding), 6) as running from events")
def running_accuracy(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("correct", F.col("value") < 100)
    return evaluate.running_accuracy(rows, "event_type", "event_id")


_ARMS = "select case event_id % 3 when 0 then 'base' when 1 then 'tuned' else 'prompted' end as arm, event_type as operation, event_id % 4 = 0 as xdoc, value < 100 as correct, (event_id % 3) / 2.0::double as partial from events"


@query(f"""with r as ({_ARMS}) select arm, case when grouping(operation) = 1 then '*' else operation end as operation, case when grouping(xdoc) = 1 then '*' when xdoc then 'cross' else 'control' end as kind,
count(*) as n, count(*) filter (correct) as n_correct, round(avg(partial), 6) as mean_partial from r group by grouping sets ((arm), (arm, operation), (arm, xdoc))""")
def arm_breakdown_grouping_sets(spark, sf_dir):
    n = F.col("event_id")
    arm = F.when(n % 3 == 0, "base").when(n % 3 == 1, "tuned").otherwise("prompted")
    rows = table(spark, sf_dir, "events").select(arm.alias("arm"), F.col("event_type").alias("operation"), (n % 4 == 0).alias("xdoc"), (F.col("value") < 100).alias("correct"), ((n % 3) / 2.0).alias("partial"))
    return evaluate.arm_breakdown(rows)


@query("""with r as (select event_type as split, event_id % 2 = 0 as base, value < 100 as ok from events),
s as (select coalesce(split, 'OVERALL') as split, count(*) filter (base and ok) as before_correct, count(*) filter (not base and ok) as after_correct, count(*) filter (base) as nb, count(*) filter (not base) as na from r group by rollup (split))
select split, before_correct, after_correct, round(before_correct / nb, 6) as before_accuracy, round(after_correct / na, 6) as after_accuracy, round(after_correct / na - before_correct / nb, 6) as delta from s""")
def regression_delta(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("split"), F.when(F.col("event_id") % 2 == 0, "base").otherwise("tuned").alias("arm"), (F.col("value") < 100).alias("correct"))
    return evaluate.regression_delta(rows, "base", "tuned")


@query(f"with r as ({_ARMS}), v as (select count(*) filter (arm = 'tuned' and correct) / count(*) filter (arm = 'tuned') as t, count(*) filter (arm = 'prompted' and correct) / count(*) filter (arm = 'prompted') as p from r) select round(t, 6) as tuned_accuracy, round(p, 6) as prompted_accuracy, case when p > t then 'prompted beats tuned' when p = t then 'prompted matches tuned' else 'tuned beats prompted' end as verdict from v")
def arm_verdict(spark, sf_dir):
    return evaluate.arm_verdict(over_tables(spark, sf_dir, _ARMS.replace("::double", ""), "events"))


_SET = "select event_id, event_type as operation, case when event_id % 4 = 0 then {0}('d' || {1}, 'd' || {2}, 'd' || {1}) else {0}('d' || {1}) end as docs from events"


@query(f"""with q as ({_SET.format('list_value', 'event_id % 13', '(event_id // 4) % 11')}), e as (select operation, list_distinct(docs) as docs from q), u as (select operation, unnest(docs) as doc from e),
c as (select coalesce(operation, 'OVERALL') as operation, count(*) as n, count(*) filter (len(docs) > 1) as n_cross from e group by rollup (operation)), d as (select coalesce(operation, 'OVERALL') as operation, count(distinct doc) as n_docs from u group by rollup (operation))
select operation, n, n_cross, n - n_cross as n_control, n_docs from c join d using (operation)""")
def eval_composition(spark, sf_dir):
    return evaluate.composition(over_tables(spark, sf_dir, _SET.format("array", "cast(event_id % 13 as string)", "cast((event_id div 4) % 11 as string)"), "events"))


def _judged(spark, sf_dir):
    """Claims from labels: planted where quality is 0, predicted by the length of the text."""
    lab, docs = table(spark, sf_dir, "labels"), table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    said = F.when(F.col("n_chars") > 3000, "contradicted").when(F.col("n_chars") < 300, "unverifiable").otherwise("supported")
    return lab.join(docs, "doc_id").select((F.col("quality") == 0).alias("planted"), F.when(F.col("quality") == 0, "contradicted").otherwise("supported").alias("expected"), said.alias("predicted"))


_JUDGED = "j as (select quality = 0 as planted, case when quality = 0 then 'contradicted' else 'supported' end as expected, case when n_chars > 3000 then 'contradicted' when n_chars < 300 then 'unverifiable' else 'supported' end as predicted from labels join documents using (doc_id))"


@query(f"with {_JUDGED} select expected, count(*) filter (predicted = 'supported') as supported, count(*) filter (predicted = 'contradicted') as contradicted, count(*) filter (predicted = 'unverifiable') as unverifiable from j group by expected")
def confusion_matrix(spark, sf_dir):
    return evaluate.confusion_matrix(_judged(spark, sf_dir))


@query(f"""with {_JUDGED}, c as (select count(*) filter (planted and predicted = 'contradicted') as tp, count(*) filter (not planted and predicted = 'contradicted') as fp, count(*) filter (planted and predicted <> 'contradicted') as fn,
count(*) filter (not planted and predicted <> 'contradicted') as tn, count(*) filter (expected = predicted) as x, count(*) as n from j)
select tp, fp, fn, tn, round(tp / (tp + fp), 6) as precision, round(tp / (tp + fn), 6) as recall, round(2 * tp / (2 * tp + fp + fn), 6) as f1, round(x / n, 6) as exact from c""")
def precision_recall_f1(spark, sf_dir):
    return evaluate.confusion(_judged(spark, sf_dir))


# --- training sets ---


_TOPIC_STOP = "', '".join(ft.TOPIC_STOP)
# A figure is read off each run of digits, points and commas: both engines see the same ones, as runs of several figures do not occur.
_FIGURES = CHUNKS + r""",
c as (select doc_id, page, chunk_id, trim(regexp_replace(text, '\s+', ' ', 'g')) as text from chunks),
runs_ as (select *, regexp_extract_all(text, '[0-9.,]+') as runs, list_transform(regexp_split_to_array(text, '[0-9.,]+'), lambda x: length(x)) as gaps from c where length(text) between 150 and 1200),
f as (select * exclude (placed), placed, list_transform(placed, lambda x: x.figure) as figures from (select *, list_filter(list_transform(range(1, len(runs) + 1), lambda i: {'figure': regexp_extract(runs[i], '^,*([0-9]{1,3}(?:,[0-9]{3})+(?:\.[0-9]+)?|[0-9]+\.[0-9]+|[0-9]{3,})(?:,|$)', 1),
  'at': (list_sum(gaps[1:i]) + coalesce(list_sum(list_transform(runs[1:i - 1], lambda r: length(r))), 0) + length(regexp_extract(runs[i], '^,*')))::int}),
  lambda x: x.figure <> '' and not regexp_full_match(x.figure, '(19|20)[0-9]{2}') and length(regexp_replace(x.figure, '[^0-9]', '', 'g')) >= 3) as placed from runs_))"""
_FACTS = _FIGURES + rf""",
banned as (select figures[1] as figure from f where page % 7 = 0 and len(figures) > 0),
b as (select coalesce(list(figure), []) as bs from banned),
g as (select f.*, list_filter(placed, lambda x: not list_contains(bs, x.figure))[1] as fig from f, b where page % 10 <> 0),
p as (select *, fig.figure as figure, fig.at as place from g where fig is not null),
x as (select *, trim(substr(text, greatest(0, place - 340) + 1, place + 360 - greatest(0, place - 340))) as excerpt, trim(substr(text, greatest(0, place - 140) + 1, place + length(figure) + 140 - greatest(0, place - 140))) as sentence from p),
w as (select *, list_filter(regexp_extract_all(split_part(sentence, figure, 1), '[A-Za-z][A-Za-z\-'']{{2,}}')[-9:], lambda v: not list_contains(['{_TOPIC_STOP}'], lower(v))) as kept from x where regexp_matches(sentence, '[a-z]{{4,}}')),
t as (select *, lower(array_to_string(kept[-4:], ' ')) as topic from w where len(kept) >= 2),
facts as (select *, count(*) over (partition by doc_id) as n_facts from t where length(topic) between 10 and 70 and not contains(doc_id, figure))"""


@query(f"with {_FIGURES} select chunk_id, figures from f")
def figure_candidates(spark, sf_dir):
    """Distinctive figures of the texts that are as long as facts."""
    docs = chunking.chunks(chunk_pages(spark, sf_dir)).select("chunk_id", ft.collapse(F.col("text")).alias("text"))
    return docs.where(F.length("text").between(*traindata.FACT)).select("chunk_id", traindata.figures(F.col("text")).alias("figures"))


def _facts(spark, sf_dir, least=1):
    """Facts of all documents' chunks; every tenth document is an evaluation text, and the first figures of every seventh are."""
    docs = stored(chunking.chunks(chunk_pages(spark, sf_dir)), "chunks")
    evaluated = docs.where(F.length(ft.collapse(F.col("text"))).between(*traindata.FACT) & (F.col("page") % 7 == 0))
    banned = evaluated.select(F.try_element_at(traindata.figures(ft.collapse(F.col("text"))), F.lit(1)).alias("figure")).where("figure is not null")
    return traindata.facts(docs, least, banned, docs.where("page % 10 = 0"))


@query(f"with {_FACTS} select doc_id, page, chunk_id, figure, excerpt, sentence, topic, n_facts from facts")
def fact_mining(spark, sf_dir):
    return _facts(spark, sf_dir).drop("text")


@query()
def gen_multidoc(spark, sf_dir):
    """Questions over two documents from mined facts; each would pass the checks that qc_multidoc makes."""
    return traindata.pair_examples(stored(_facts(spark, sf_dir), "facts"))


@query("""with c as (select 'd' as doc_id, l_orderkey::varchar as table_id, l_returnflag as section, l_linenumber * 1000000 + l_partkey as cell_id from lineitem group by all),
t as (select table_id, min(cell_id) as target_id from c group by table_id), w as (select t.*, min(c.section) as wanted from t join c on c.table_id = t.table_id and c.cell_id = t.target_id group by all),
r as (select c.doc_id, c.table_id, w.target_id, c.cell_id, (row_number() over (partition by c.table_id, w.target_id order by (c.section = w.wanted)::int desc, md5('distract|' || w.target_id || '|' || c.cell_id), c.cell_id))::int as rank from c join w using (table_id) where c.cell_id <> w.target_id)
select * from r where rank <= 3""")
def pick_distractors(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    cells = l.select(F.lit("d").alias("doc_id"), F.col("l_orderkey").cast("string").alias("table_id"), F.col("l_returnflag").alias("section"), (F.col("l_linenumber") * 1000000 + F.col("l_partkey")).alias("cell_id")).distinct()
    first = cells.groupBy("doc_id", "table_id").agg(F.min(F.struct("cell_id", "section")).alias("m")).select("doc_id", "table_id", "m.cell_id", "m.section")
    return traindata.distractors(cells, first, "section", 3)


_LINES = """select l_orderkey * 10 + l_linenumber as id, case l_partkey % 7 when 0 then 'Short?' when 1 then 'What is the {{value}} of the row in the table?' when 2 then 'Which row holds ' || cast(l_linenumber as {0}) || ' in the whole table of prices?' when 3 then 'What is the highest entry of the whole table?' when 4 then 'What is the highest entry in the price column?' else 'What is the number of the line for this part?' end as question,
  case when l_partkey % 7 in (3, 4) then 'max' else 'lookup' end as operation, case when l_suppkey % 5 = 0 then '8.8 8.4 7.7' else 'price of the part' end as label, cast(l_linenumber as {0}) as value, l_suppkey % 11 <> 0 as has_target, l_suppkey % 4 as twins, l_suppkey % 13 = 0 as in_eval, case when l_partkey % 17 = 0 then 0.7 else 0.1 end as eval_jaccard from lineitem"""
_CHECKED = f"""e as ({_LINES.format('varchar')}),
k as (select id, list_filter([case when length(question) not between 20 and 260 then 'question_length' end, case when contains(question, '{{') then 'unfilled_placeholder' end, case when not has_target then 'target_missing' end,
  case when has_target and label <> 'price of the part' then 'label_mostly_digits' end, case when has_target and question like 'Which row holds%' then 'value_leaked' end, case when twins > 0 then 'ambiguous' end,
  case when question = 'What is the highest entry of the whole table?' then 'superlative_without_column' end, case when in_eval then 'contaminated_cell' end, case when eval_jaccard >= 0.6 then 'contaminated_question' end], lambda x: x is not null) as r from e)"""


def _checked(spark, sf_dir):
    return traindata.check_cells(over_tables(spark, sf_dir, _LINES.format("string").replace("{value}", "{{value}}"), "lineitem"))


@query(f"with {_CHECKED} select id, array_to_string(r, ',') as reasons, len(r) = 0 as passed from k")
def qc_cells_lines(spark, sf_dir):
    """Examples made of all lines, checked."""
    return _checked(spark, sf_dir)


@query(f"with {_CHECKED} select r[1] as reason, count(*) as n from k where len(r) > 0 group by 1")
def first_reasons(spark, sf_dir):
    return reason_histogram(_checked(spark, sf_dir))


@query(f"with {_CHECKED}, u as (select unnest(r) as reason from k) select reason, count(*) as n from u group by 1")
def all_reasons(spark, sf_dir):
    return reason_histogram(_checked(spark, sf_dir), first=False)


@query("""with r as (select unnest(list_filter([case when quality = 0 then 'low_quality' end, case when toxic = 1 then 'toxic' end], lambda x: x is not null)) as reason from labels) select reason, count(*) as n from r group by reason""")
def rejection_histogram(spark, sf_dir):
    reasons = F.array_compact(F.array(F.when(F.col("quality") == 0, "low_quality"), F.when(F.col("toxic") == 1, "toxic")))
    return table(spark, sf_dir, "labels").select(F.explode(reasons).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


@query("select conv_id, list({'role': role, 'content': text} order by turn, role, text) as messages from conversations group by conv_id")
def chat_records(spark, sf_dir):
    return traindata.chat_records(table(spark, sf_dir, "conversations"))


_GRAMS = r"list_distinct(list_transform(generate_series(1, len(t) - 4), lambda i: array_to_string(t[i:i + 4], ' ')))"
_TOK = "regexp_extract_all(lower(text), '[a-z0-9.]+')"


def _gram_sql(name: str, src: str) -> str:
    return f"{name} as (select id, len(g) as n, unnest(g) as gram from (select id, case when len(t) >= 5 then {_GRAMS} else [] end as g from (select id, {_TOK} as t from {src})))"


_DOCS, _ITEMS = "(select doc_id as id, text from documents)", "(select item_id as id, text from benchmark)"
_MET = "met as (select a.id as a, b.id as b, count(*) / (a.n + b.n - count(*)) as j from ga a join gb b using (gram) {0} group by a.id, b.id, a.n, b.n)"


@query(f"with {_gram_sql('ga', _DOCS)}, {_gram_sql('gb', _ITEMS)}, {_MET.format('')}, r as (select a, b, round(j, 6) as jaccard from met) select a, min_by(b, [-jaccard, b]) as b, max(jaccard) as jaccard, max(jaccard) >= 0.6 as contaminated from r group by a")
def ngram_contamination(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return traindata.contamination(docs, table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), "text"))


@query(f"with {_gram_sql('ga', _DOCS)}, {_gram_sql('gb', _ITEMS)}, {_MET.format('')} select a, b, round(j, 6) as jaccard from met order by round(j, 6) desc, a, b limit 1")
def most_contaminated(spark, sf_dir):
    """The closest pair of a document and an evaluation item."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return traindata.most_contaminated(docs, table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), "text"))


@query("select text, count(*) as n, max(item_id) as item_id, max(lang) as lang from (select text, item_id, null as lang from benchmark union all select text, null, lang from documents) group by text")
def union_of_sets(spark, sf_dir):
    """Two sets of texts with different columns as one."""
    both = table(spark, sf_dir, "benchmark").unionByName(table(spark, sf_dir, "documents").select("text", "lang"), allowMissingColumns=True)
    return both.groupBy("text").agg(F.count("*").alias("n"), F.max("item_id").alias("item_id"), F.max("lang").alias("lang"))


@query(f"with {_FIGURES} select unnest(figures) as figure from f where page % 2 = 0 intersect select unnest(figures) from f where page % 2 = 1")
def shared_figures(spark, sf_dir):
    """Figures that both halves of the documents have."""
    found = chunking.chunks(chunk_pages(spark, sf_dir)).select("page", ft.collapse(F.col("text")).alias("text")).where(F.length("text").between(*traindata.FACT))
    each = found.select("page", F.explode(traindata.figures(F.col("text"))).alias("figure"))
    return each.where("page % 2 = 0").select("figure").intersect(each.where("page % 2 = 1").select("figure"))


@query("select event_type, user_id from events where event_id % 4 = 0 except all select event_type, user_id from events where event_id % 4 = 1")
def difference_of_sets(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    pick = lambda k: e.where(F.col("event_id") % 4 == k).select("event_type", "user_id")
    return pick(0).exceptAll(pick(1))


@query(f"with {_gram_sql('ga', _DOCS)}, gb as (select * from ga), {_MET.format('where a.id < b.id')}, r as (select a, b, round(j, 6) as jaccard from met where round(j, 6) >= 0.85) select b as id, min_by(a, [-jaccard, a]) as of, max(jaccard) as jaccard from r group by b")
def near_duplicate(spark, sf_dir):
    """Rows within 0.85 of an earlier row; order-free where the greedy rule depends on the order of rows."""
    return traindata.repeated(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"))


@query(f"with {_gram_sql('ga', _ITEMS)}, gb as (select * from ga), {_MET.format('where a.id < b.id')}, c as (select count(*) as n from benchmark) select (n * (n - 1) / 2)::bigint as n_pairs, round(coalesce((select sum(j) from met), 0) / (n * (n - 1) / 2), 9) as mean_jaccard, (select count(*) from met where j >= 0.6) as n_close from c")
def pairwise_jaccard(spark, sf_dir):
    """Mean similarity over all pairs and pairs of 0.6 or more: pairs that share nothing count as 0 without being made."""
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), "text")
    met = traindata.gram_pairs(items).agg(F.sum("jaccard").alias("s"), F.count_if(F.col("jaccard") >= 0.6).alias("n_close"))
    n = items.agg(F.count("*").alias("n")).select((F.col("n") * (F.col("n") - 1) / 2).cast("long").alias("n_pairs"))
    return n.crossJoin(F.broadcast(met)).select("n_pairs", F.round(F.coalesce("s", F.lit(0.0)) / F.col("n_pairs"), 9).alias("mean_jaccard"), "n_close")


@query("""with a as (select 'role' as axis, role as value from conversations union all select 'turn', turn::varchar from conversations), c as (select axis, value, count(*) as n from a group by all),
r as (select *, count(*) over (partition by axis) as n_distinct, (row_number() over (partition by axis order by n desc, value))::int as rank from c) select axis, value, n, n_distinct, rank from r where rank <= 4""")
def diversity_axes(spark, sf_dir):
    return traindata.axes(table(spark, sf_dir, "conversations"), ["role", "turn"])


@query(r"""with t as (select unnest(regexp_extract_all(lower(text), '[a-z][a-z\-'']+')) as t from conversations) select count(*) as tokens, count(distinct t) as types, round(count(distinct t) / count(*), 6) as ratio from t""")
def type_token_ratio(spark, sf_dir):
    return traindata.type_token_ratio(table(spark, sf_dir, "conversations"))


@query("""with r as (select doc_id, row_number() over (order by md5('split|' || doc_id), doc_id) as k, count(*) over () as n from documents) select doc_id, case when k <= greatest(40, floor(n * 0.1)) then 'valid' else 'train' end as part from r""")
def split_90_10(spark, sf_dir):
    return traindata.split(table(spark, sf_dir, "documents"), "doc_id")


# --- reports ---


@query(f"with {CHUNKS}, c as (select distinct doc_id, page from chunks) select doc_id, count(*) as pages from c group by doc_id")
def distinct_pages(spark, sf_dir):
    return chunking.chunks(chunk_pages(spark, sf_dir)).select("doc_id", "page").distinct().groupBy("doc_id").agg(F.count("*").alias("pages"))


