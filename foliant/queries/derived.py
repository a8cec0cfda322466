"""Queries on rows that the given tables are turned into: decisions, grades, reports, logs and runs of each."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliant.functions import text as ft
from foliant.operators import cells as oc
from foliant.operators import chunking, compute, decide, evaluate, reports, verify
from foliant.queries.answers import _CHOSEN, _SHOWN, _TABLES, _numeric_store, _tables
from foliant.queries.fixtures import chunk_pages, norm_sql, over_tables, table
from foliant.session import shared_dir, stored
from foliant.streaming import runs

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


@query("select source as doc_id, doc_id as page, null::varchar as table_id, 'no text: likely a scanned page' as reason from documents where doc_id % 5 = 0 or text is null or trim(text, chr(32) || chr(9) || chr(10) || chr(13)) = ''")
def unread_pages(spark, sf_dir):
    """Every fifth page lost its text."""
    pages = chunk_pages(spark, sf_dir)
    return chunking.unread_pages(pages.withColumn("text", F.when(F.col("page") % 5 == 0, F.when(F.col("page") % 2 == 0, " \n ")).otherwise(F.col("text"))))


@query("select distinct url as stem, trim(regexp_replace(lower(url), '[^a-z0-9_]+', '_', 'g'), '_') as doc_id from pages where url is not null")
def doc_id_slug(spark, sf_dir):
    stems = table(spark, sf_dir, "pages").select(F.col("url").alias("stem")).where("stem is not null").distinct()
    return stems.select("stem", ft.document_slug(F.col("stem")).alias("doc_id"))


_WORD = r"[ \t\n\r]+"


@query(f"with t as (select distinct unnest(regexp_split_to_array(text, '{_WORD}')) as token from documents) select token, {norm_sql('token')} as canonical from t where regexp_matches(token, '[0-9]')")
def normalise_number(spark, sf_dir):
    """Every word of the documents that holds a digit."""
    words = table(spark, sf_dir, "documents").select(F.explode(F.split("text", _WORD)).alias("token")).where(F.col("token").rlike("[0-9]")).distinct()
    return words.select("token", ft.normalise_number(F.col("token")).alias("canonical"))


@query("select doc_id % 50 as doc_id, doc_id as version, source from documents qualify row_number() over (partition by doc_id % 50 order by doc_id desc) = 1")
def upsert_documents(spark, sf_dir):
    """Each document a version of one of fifty, of which the last stays."""
    docs = table(spark, sf_dir, "documents").select((F.col("doc_id") % 50).alias("doc_id"), F.col("doc_id").alias("version"), "source")
    return oc.latest(docs, ["doc_id"], "version")


# --- decisions ---

_ASKED = """select event_id as id, case event_id % 12 when 0 then 'Compare the two on ' || event_type when 1 then 'What was the total change in ' || event_type || '?' when 2 then 'What is the average of ' || event_type || '?' when 3 then 'Why did they state a purpose for ' || event_type || '?'
  when 4 then 'Who made event ' || cast(event_id as {0}) || '?' when 5 then 'Explain the growth of ' || event_type when 6 then 'Describe the total, the average and the maximum' when 7 then 'What percent of loans, and how much higher than before?' when 8 then 'Do both sources AGREE?'
  when 9 then 'What was the purchase rate of user ' || cast(user_id as {0}) when 10 then 'Summarise the reason' else event_type end as question from events"""
_CUES = {name: "[" + ", ".join("'" + c.replace("'", "''") + "'" for c in cues) + "]" for name, cues in (("n", decide.NUMERIC), ("m", decide.MULTI), ("p", decide.PROSE))}
_HITS = ", ".join(f"len(list_filter({c}, lambda c: regexp_matches(lower(question), c))) as {n}" for n, c in _CUES.items())


@query(f"""with q as ({_ASKED.format('varchar')}), h as (select *, {_HITS} from q)
select id, question, case when m > 0 then 'multi-doc' when (n >= 2 and n > p) or (n > 0 and p = 0) then 'numeric' else 'prose' end as path,
  case when m > 0 or (n >= 2 and n > p) then 0.85 when n > 0 and p = 0 then 0.7 when p > 0 and n = 0 then 0.8 else 0.3 end::double as confidence from h""")
def route_rules(spark, sf_dir):
    return decide.route(over_tables(spark, sf_dir, _ASKED.format("string"), "events")).select("id", "question", "path", "confidence")


@query(f"with {_TABLES.format(3)}, {_SHOWN}, {_CHOSEN} select question_id, count(*) as n_cells, max(n_hits)::int as best_hits, bool_or(n_asked = 0 or n_hits >= 2) as supported from hits group by question_id")
def evidence_gate(spark, sf_dir):
    """Is anything that each question was shown about it?"""
    from foliant.operators import qa

    about, found = _tables(spark, sf_dir, qa.TABLES)
    return decide.gate(qa.shown_cells(about, found, _numeric_store(spark, sf_dir, found), 10))


_ROUTED = """select event_id as question_id, case event_id % 3 when 0 then 0.85 when 1 then 0.7 else 0.3 end as route_conf, case when event_id % 4 <> 1 then value end as numeric_value,
  case when event_id % 4 <> 1 then cast(event_id % 10 as double) / 10 end as numeric_conf, cast(event_id % 7 as double) / 7 as prose_conf, event_type as numeric_answer, 'cell ' || event_type as numeric_citations, 'text ' || event_type as prose_answer, 'page' as prose_citations from events"""


@query(f"""with r as ({_ROUTED}), s as (select *, (numeric_value is null or route_conf <= 0.7) and prose_conf > coalesce(numeric_conf, 0) as swap from r)
select question_id, case when swap then 'numeric->prose' else 'numeric' end as path, case when swap then prose_conf else coalesce(numeric_conf, 0) end::double as confidence, case when swap then prose_answer else numeric_answer end as answer,
  case when swap then prose_citations else numeric_citations end as citations, case when not swap then numeric_value end as value from s""")
def path_arbitration(spark, sf_dir):
    """A number or its prose beside it, the whole answer of what is surer."""
    rows = over_tables(spark, sf_dir, _ROUTED, "events")
    return decide.arbitrate(rows.select(*[F.col(c).cast("double") if c.endswith("conf") else F.col(c) for c in rows.columns]))


_FOUND = "select user_id as question_id, event_type as doc_id, case when event_id % 3 = 0 then 'table' else 'prose' end as kind, event_id as pos, event_id % 10 / 10.0 as conf, case when event_id % 2 = 0 then value end as value from events"


@query(f"""with h as ({_FOUND}), b as (select question_id, doc_id, min([(kind <> 'table')::bigint, pos]) as first, arg_min_null(conf, [(kind <> 'table')::bigint, pos]) as conf, arg_min_null(value, [(kind <> 'table')::bigint, pos]) as value from h group by all),
k as (select * from (select *, row_number() over (partition by question_id order by first, doc_id) as rank from b) where rank <= 2)
select question_id, count(*) as n_docs, string_agg(doc_id, ',' order by rank) as docs, round(case when count(*) = 1 then min(conf) * 0.6 else min(conf) end, 6)::double as confidence,
  round(max(value) filter (rank = 1) - max(value) filter (rank = 2), 6) as difference, case when count(*) = 1 then 'single-source' end as note from k group by question_id""")
def multidoc_merge(spark, sf_dir):
    rows = over_tables(spark, sf_dir, _FOUND, "events").withColumn("conf", F.col("conf").cast("double"))
    return decide.merge_documents(rows)


_CLAIMED = """select event_id as claim_id, case event_id % 4 when 0 then 'the rate in 2022 was ' when 1 then 'about ' else 'it came to ' end || cast(cast(value as decimal(18, 2)) as {0}) as text, event_id % 5 as n_evidence,
  event_id % 10 / 10.0 as score, case event_id % 3 when 0 then cast(cast(value as decimal(18, 2)) as double) when 1 then value * 1.5 + 3 end as cell, case event_id % 7 when 0 then 'supported' when 1 then 'contradicted' end as judged from events where value is not null"""


@query(f"""with c as ({_CLAIMED.format('varchar')}), a as (select *, cast(cast(text.regexp_extract('-?[0-9.]+$') as decimal(18, 2)) as double) as x, n_evidence = 0 or score < 0.35 as weak, cell is not null as re from c),
b as (select *, case when abs(x) < 1 and abs(cell) < 1 then abs(x - cell) <= 0.005 else abs(x - cell) <= 0.005 * greatest(abs(x), abs(cell)) end as ok from a)
select claim_id, case when weak then 'unverifiable' when re then case when ok then 'supported' else 'contradicted' end else coalesce(judged, 'unverifiable') end as verdict, not weak and re as recomputed,
  round(case when weak then round(score, 3) when re then case when ok then 0.9 else 0.85 end when judged = 'supported' then least(0.85, score + 0.25) when judged = 'contradicted' then least(0.8, score + 0.2) else score end, 6)::double as confidence from b""")
def claim_verdict(spark, sf_dir):
    """A claim for each event with a value: recomputed, as a reader judged it, or not to be verified."""
    rows = over_tables(spark, sf_dir, _CLAIMED.format("string"), "events").withColumn("score", F.col("score").cast("double"))
    return verify.verdicts(rows)


_KINDS = "case l_orderkey % 6 when 0 then 'missing' when 1 then 'text' when 2 then 'two' when 3 then 'median' when 4 then 'zero' else 'none' end"


_ERRORS = "('missing', 'missing cell'), ('text', 'not a number'), ('two', 'wrong number of cells'), ('median', 'unsupported operation'), ('zero', 'zero denominator'), ('none', 'no cells')"


@query(f"""with k as (select distinct l_orderkey, {_KINDS} as kind from lineitem)
select kind || ':t' || l_orderkey as plan_id, case kind when 'median' then 'median' when 'zero' then 'ratio' when 'none' then 'sum' else 'lookup' end as operation,
  cast(null as double) as value, cast(null as varchar) as unit, cast(null as varchar) as unit_warning, cast(null as varchar) as citations, error from k join (values {_ERRORS}) as e(kind, error) using (kind)""")
def compute_errors(spark, sf_dir):
    """Plans that cannot be computed, one for each order, and how each is refused."""
    line = table(spark, sf_dir, "lineitem").select("l_orderkey").distinct()
    kind = F.expr(_KINDS)
    doc, tab = F.lit("d"), F.concat(F.lit("t"), F.col("l_orderkey").cast("string"))
    cell = lambda r, v: F.struct(F.lit(r).alias("row"), F.lit(1).alias("col"), F.lit(v).alias("value"))
    cells = line.select(doc.alias("doc_id"), F.lit(1).alias("page"), tab.alias("table_id"), F.explode(F.array(cell(1, "5"), cell(2, "n.s."), cell(3, "0"))).alias("c")).select("doc_id", "page", "table_id", "c.*", F.lit(None).cast("string").alias("unit"))
    ref = lambda pos, row: F.struct(F.lit(pos).alias("pos"), F.lit(row).alias("row"))
    none = F.array(F.struct(F.lit(None).cast("int").alias("pos"), F.lit(None).cast("int").alias("row")))
    refs = F.when(kind == "missing", F.array(ref(0, 9))).when(kind == "text", F.array(ref(0, 2))).when(kind == "two", F.array(ref(0, 1), ref(1, 3))).when(kind == "median", F.array(ref(0, 1))).when(kind == "zero", F.array(ref(0, 1), ref(1, 3))).otherwise(none)
    operation = F.when(kind == "median", "median").when(kind == "zero", "ratio").when(kind == "none", "sum").otherwise("lookup")
    plans = line.select(kind.alias("kind"), tab.alias("table_id"), operation.alias("operation"), F.explode(refs).alias("r"))
    plans = plans.select(F.concat_ws(":", "kind", "table_id").alias("plan_id"), "operation", "r.pos", F.when(F.col("r.row").isNotNull(), doc).alias("doc_id"), F.when(F.col("r.row").isNotNull(), F.col("table_id")).alias("table_id"), "r.row", F.when(F.col("r.row").isNotNull(), 1).alias("col"))
    return compute.execute(plans, cells)


# --- grades ---

_ANSWERED = """select event_id as id, case when event_id % 2 = 0 then value end as want, case event_id % 6 when 0 then value * 1.004 when 2 then value * 1.006 end as got, event_type || ' by user ' || cast(user_id as {0}) as answer,
  case when event_id % 3 = 0 then event_type else 'nowhere' end as first, cast(user_id as {0}) as second from events where value is null or value > 0"""


@query(f"""with a as ({_ANSWERED.format('varchar')}), c as (select *, (contains(answer, first))::int as one from a)
select id, case when want is not null then coalesce(abs(got - want) / greatest(abs(want), 1e-9) <= 0.005, false) else one = 1 end as correct, round((one + 1) / 2.0, 6)::double as partial from c""")
def grade_numeric(spark, sf_dir):
    """Answers on events: a number near the wanted one, or all needles there; a user's number always is."""
    rows = over_tables(spark, sf_dir, _ANSWERED.format("string"), "events")
    return evaluate.grade(rows.select("id", "answer", "got", "want", F.array("first", "second").alias("needles")))


@query("""with w as (select l_orderkey as id, list(distinct 'd' || l_suppkey % 5) as wanted, coalesce(list(distinct 'd' || l_partkey % 5) filter (l_linenumber > 1), []) as cited from lineitem group by 1) select id, len(cited) > 0 and list_has_any(wanted, cited) as ok from w""")
def citation_ok(spark, sf_dir):
    name = lambda c: F.concat(F.lit("d"), (F.col(c) % 5).cast("string"))
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_set(name("l_suppkey")).alias("wanted"), F.collect_set(F.when(F.col("l_linenumber") > 1, name("l_partkey"))).alias("cited"))
    return rows.select("id", evaluate.citation_ok(F.col("wanted"), F.col("cited")).alias("ok"))


_FIRST = "regexp_extract({0}, '[A-Za-z]{{6,}}')"


@query(f"""with n as (select count(*) as n from documents), q as (select item_id as id, (item_id * 2) % n as a, (item_id * 2 + item_id % 4) % n as b, item_id % 3 as kind from benchmark, n),
c as (select id, kind, a as doc from q union select id, kind, b from q), t as (select c.*, d.source, replace(d.text, ',', '') as text, {_FIRST.format('d.text')} as word from c left join documents d on d.doc_id = c.doc),
w as (select id, unnest(list_distinct(list_concat(list(word) filter (word <> ''), case when any_value(kind) = 0 then ['qqqqqq'] else [] end, ['a']))) as needle from t group by id),
f as (select t.id, t.doc, t.source, needle, coalesce(contains(text, needle), false) as found from t join w using (id)),
p as (select id, count(distinct source) as n_docs, bool_or(all_) as one from (select id, source, doc, bool_and(found) as all_ from f group by all) group by id),
k as (select id, bool_and(n > 0) as grounded, list_sort(coalesce(list(needle) filter (n = 0), [])) as missing, list_sort(coalesce(list(needle) filter (n > 1), [])) as leaks from (select id, needle, count(*) filter (found) as n from f group by all) group by id)
select id, n_docs >= 2 as cross_, grounded, missing, case when n_docs >= 2 then not one end as both_needed, case when n_docs >= 2 then leaks else [] end as leaks from p join k using (id)""")
def eval_checks_123(spark, sf_dir):
    """Items asked of the pages they cite: can one page answer, is every needle there, does a partner give it away?"""
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    n = docs.agg(F.count("*").alias("n"))
    i = F.col("item_id")
    asked = items.crossJoin(F.broadcast(n)).select(i.alias("id"), (i % 3).alias("kind"), F.explode(F.array_distinct(F.array((i * 2) % F.col("n"), (i * 2 + i % 4) % F.col("n")))).alias("page"))
    cited = asked.join(docs.select(F.col("doc_id").alias("page"), F.col("source").alias("doc_id"), F.regexp_extract("text", "[A-Za-z]{6,}", 0).alias("word")), "page", "left")
    more = F.when(F.max("kind") == 0, F.array(F.lit("qqqqqq"), F.lit("a"))).otherwise(F.array(F.lit("a")))
    questions = cited.groupBy("id").agg(F.collect_list(F.struct("doc_id", "page")).alias("cites"), F.concat(F.collect_set(F.when(F.col("word") != "", F.col("word"))), more).alias("needles"))
    pages = docs.select(F.col("source").alias("doc_id"), F.col("doc_id").alias("page"), "text")
    return evaluate.evidence_structure(questions, pages).withColumnRenamed("cross", "cross_")


_REPLIED = """select event_id as id, substring('ABCDE', cast(event_id % 5 as int) + 1, 1) as c, event_id % 9 as shape from events"""
_SAID = "case shape when 0 then c when 1 then 'The one is ...the object (' || c || ').' when 2 then 'the answer is ' || c when 3 then 'Answer: (' || c || ')' when 4 then 'I would pick ' || c || ' here' when 5 then c || '. because' when 6 then 'A certain thing has ' || c || ' parts' when 7 then 'Nothing to say' else 'Option ' || c end"


@query(f"with r as ({_REPLIED}) select id, {_SAID} as reply, case when shape = 7 then '' else c end as choice from r where not (c = 'A' and shape in (4, 6))")
def extract_choice(spark, sf_dir):
    """Free answers in the shapes models give, one for each event."""
    rows = over_tables(spark, sf_dir, f"select id, c, shape, {_SAID} as reply from ({_REPLIED}) r", "events").where("not (c = 'A' and shape in (4, 6))")
    return rows.select("id", "reply", ft.extract_choice(F.col("reply")).alias("choice"))


# --- reports ---

_MODELS = "select p_partkey as model, p_size as layers, p_size % 4 * 8 + 8 as heads, p_size % 3 + 1 as kv_heads, (p_size % 4 * 8 + 8) * 128 as hidden, p_retailprice * 1e6 as params from part"


@query(f"with m as ({_MODELS}) select model, (2 * layers * kv_heads * (hidden // heads) * 2)::bigint as bytes_per_token from m")
def kv_cache_table(spark, sf_dir):
    """Cache sizes of models made from parts."""
    return reports.kv_cache(over_tables(spark, sf_dir, _MODELS, "part"))


@query(f"with m as ({_MODELS}) select model, precision, round(params * size / 1e9, 6)::double as gb, params * size / 1e9 < 1.5 as fits from m, (values ('FP16', 2.0), ('INT8', 1.0), ('INT4', 0.5)) as p(precision, size)")
def weight_footprint(spark, sf_dir):
    return reports.weight_footprint(over_tables(spark, sf_dir, _MODELS, "part").select("model", "params"), 1.5)


@query(f"with m as ({_MODELS}), b as (select model, 2 * layers * kv_heads * 128 * 2 as bytes from m) select model, context, (bytes * context)::bigint as bytes_per_user, floor((4.5 - 4.0)::double * 1e9 / (bytes * context))::bigint as users from b, (values (1024), (4096)) as c(context)")
def concurrent_users(spark, sf_dir):
    contexts = spark.range(1, 3).select((F.col("id") * F.col("id") * 1024).cast("int").alias("context"))
    return reports.concurrent_users(reports.kv_cache(over_tables(spark, sf_dir, _MODELS, "part")), contexts, 4.5, 4.0)


_LOGGED = """select event_id, case event_id % 4 when 0 then 'Iter ' || cast(event_id as {0}) || ': Val loss ' || cast(cast(value as decimal(18, 3)) as {0}) || ', Val took 80.1s'
  when 1 then 'Iter ' || cast(event_id as {0}) || ': Train loss ' || cast(cast(value as decimal(18, 3)) as {0}) || ', Learning Rate 1.000e-04, It/sec 0.071, Tokens/sec ' || cast(user_id as {0}) || '.5, Trained Tokens 9000, Peak mem 4.70 GB' when 2 then 'loading ' || event_type end as line from events where value >= 0"""


@query("""select event_id::int as iter, case event_id % 4 when 0 then 'val' else 'train' end as kind, cast(cast(value as decimal(18, 3)) as double) as loss, case event_id % 4 when 1 then user_id + 0.5 end::double as tokens_per_s, case event_id % 4 when 1 then 4.7 end::double as peak_gb from events where value >= 0 and event_id % 4 < 2""")
def train_log_parse(spark, sf_dir):
    """A log with a line for each event."""
    return reports.train_log(over_tables(spark, sf_dir, _LOGGED.format("string"), "events").where("line is not null").select("line"))


# --- runs ---


@query("""with g as (select *, case when ts - lag(ts) over w >= interval 30 minute or lag(ts) over w is null then 1 else 0 end as new_ from events window w as (partition by user_id order by ts, event_id)),
s as (select *, sum(new_) over (partition by user_id order by ts, event_id rows unbounded preceding) as k from g)
select user_id, epoch_us(min(ts)) as start, epoch_us(max(ts)) + 1800000000 as end_, count(*) as n, round(sum(value), 4) as total from s group by user_id, k""")
def event_sessions(spark, sf_dir):
    """Sessions of each user that end after half an hour without an event."""
    made = runs.sessions(table(spark, sf_dir, "events"), "ts", "user_id")
    return made.select("user_id", F.unix_micros("start").alias("start"), F.unix_micros("end").alias("end_"), "n", F.round("total", 4).alias("total"))


@query("select event_id, value > 50 as correct from events")
def checkpointed_run(spark, sf_dir):
    """All events graded by a run that stops after some and is started again: each has its result once."""
    import uuid

    events = table(spark, sf_dir, "events").select("event_id", "value")
    base = f"{shared_dir(spark)}/run-{uuid.uuid4().hex}"
    graded = lambda rows: rows.select("event_id", (F.col("value") > 50).alias("correct"))
    for half in (events.where("event_id % 3 = 0"), events.where("event_id % 3 <> 0 or event_id % 2 = 0")):
        half.write.mode("append").parquet(f"{base}/in")
        stream = runs.read_runs(spark, f"{base}/in", "event_id long, value double")
        runs.run_checkpointed(stream, graded, f"{base}/out", f"{base}/mark", "event_id")
    return spark.read.parquet(f"{base}/out").select("event_id", "correct")


@query()
def token_budgets(spark, sf_dir):
    """Tokens of every conversation, by a public tokenizer's vocabulary, beside the budget of a training example."""
    from foliant.operators import traindata
    from foliant.plans.providers import token_counts

    texts = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda t: t["text"]), "\n").alias("text"))
    counted = texts.withColumn("n_tokens", token_counts("text"))
    return counted.select("conv_id", "n_tokens", (F.col("n_tokens") > traindata.BUDGET_TOKENS).alias("over"))
