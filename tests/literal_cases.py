"""Operators on rows written out here, with the results that are expected of them."""

from pyspark.sql import functions as F

from foliant.functions import text as ft
from foliant.operators import cells as oc
from foliant.operators import chunking, compute, decide, evaluate, reports, traindata, verify
from foliant.queries.fixtures import literal, norm_sql, values

QUERIES, ORACLE = {}, {}

#: A small store with banners, labels, gaps, splits, truncations, orphans and near misses.
STORE = """
('a', 1, 't1', 1, 0, 'Household', cast(null as string), 'Item'), ('a', 1, 't1', 2, 0, 'spending by type', null, 'Item'),
('a', 1, 't1', 3, 0, 'Food', null, 'Item'), ('a', 1, 't1', 3, 1, '12.5', null, '2023'), ('a', 1, 't1', 3, 2, '13.1', null, '2024'),
('a', 1, 't1', 3, 3, '5', '%', 'Change'), ('a', 1, 't1', 4, 0, 'Housing costs', null, 'Item'), ('a', 1, 't1', 4, 1, '40', null, '2023'),
('a', 1, 't1', 4, 2, '42.75', null, '2024'), ('a', 1, 't1', 4, 3, '6.9', '%', 'Change'), ('a', 1, 't1', 5, 0, 'Income', null, 'Item'),
('a', 1, 't1', 6, 0, 'Wages', null, 'Item'), ('a', 1, 't1', 6, 1, '980', 'USD', '2023'), ('a', 1, 't1', 6, 2, '1005', 'USD', '2024'),
('a', 1, 't1', 6, 3, '2.6', '%', 'Change'), ('a', 1, 't1', 7, 1, '7', null, '2023'), ('a', 1, 't1', 7, 2, '8', null, '2024'), ('a', 1, 't1', 7, 3, '9', null, 'Change'),
('a', 2, 't2', 1, 0, 'Corn', null, 'Crop'), ('a', 2, 't2', 1, 1, '10', null, 'Yield'), ('a', 2, 't2', 1, 2, '6.2', null, 'Yield'), ('a', 2, 't2', 1, 3, '93', null, 'Area'), ('a', 2, 't2', 1, 4, '5', null, 'Area'),
('a', 2, 't2', 2, 0, 'Asian', null, 'Crop'), ('a', 2, 't2', 2, 1, '18.', null, 'Rate'), ('a', 2, 't2', 2, 2, '4 Asian 3', null, 'Rate'), ('a', 2, 't2', 3, 1, '1.', null, null), ('a', 2, 't2', 3, 2, 'Demand and output', null, null),
('a', 2, 't2', 4, 0, 'Wheat', null, 'Crop'), ('a', 2, 't2', 4, 1, '55', null, 'Yield'), ('a', 2, 't2', 4, 3, '77.7', null, 'Area'), ('a', 2, 't2', 5, 0, '', null, 'Crop'), ('a', 2, 't2', 5, 1, null, null, 'Yield'),
('b', 1, 't1', 1, 0, 'Quarterly', null, 'Volume'), ('b', 1, 't1', 1, 1, '$1,250', null, 'Amount'), ('b', 1, 't1', 2, 0, 'Deposits', null, 'page 3'), ('b', 1, 't1', 2, 1, '(45.0)', null, 'Amount')
"""
STORE_COLUMNS = "doc_id, page, table_id, row, col, value, unit, header"
PAGE_TEXT = """
('a', 1, 'Food 12.5 13.1 5 Housing 40 42.75 6.9 Wages $980 1,005 2.6% 7 8 9'), ('a', 2, 'Corn 106.2 93 5 Asian 18.4 Wheat 55 and 935 areas'), ('b', 1, 'Deposits 1,250 and (45) in all')
"""
PAGE_COLUMNS = "doc_id, page, text"


def store(spark, sf_dir=None):
    return literal(spark, STORE, STORE_COLUMNS)


def page_text(spark, sf_dir=None):
    return literal(spark, PAGE_TEXT, PAGE_COLUMNS)


STORE_SQL, PAGES_SQL = values(STORE, STORE_COLUMNS).replace("string", "varchar"), values(PAGE_TEXT, PAGE_COLUMNS)


def query(sql=None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


_PARAS = "('p', 1, repeat('a', 300) || chr(10) || chr(10) || repeat('b', 300) || chr(10) || ' ' || chr(10) || repeat('c', 300)), ('p', 2, repeat('x', 1700) || chr(10) || chr(10) || 'tail'), ('p', 3, 'one'), ('p', 4, chr(10) || chr(10))"


@query("""
with want(doc_id, page, chunk_id, text) as (values
  ('p', 1, 'p_p1_c0', repeat('a', 300)), ('p', 1, 'p_p1_c1', repeat('b', 300) || chr(10) || ' ' || chr(10) || repeat('c', 300)),
  ('p', 2, 'p_p2_c0', repeat('x', 800)), ('p', 2, 'p_p2_c1', repeat('x', 800)), ('p', 2, 'p_p2_c2', repeat('x', 300)), ('p', 2, 'p_p2_c3', 'tail'), ('p', 3, 'p_p3_c0', 'one'))
select * from want""")
def chunk_pack_literal(spark, sf_dir):
    return chunking.chunks(literal(spark, _PARAS, "doc_id, page, text"))


@query("select 'p' as doc_id, 4 as page, null::varchar as table_id, 'no text: likely a scanned page' as reason")
def unread_pages(spark, sf_dir):
    return chunking.unread_pages(literal(spark, _PARAS, "doc_id, page, text"))


_STEMS = "('GDP 2024-Q1 (2nd).final'), ('__Already_ok__'), ('Ünïcode Name'), ('a--b')"


@query(f"select stem, trim(regexp_replace(lower(stem), '[^a-z0-9_]+', '_', 'g'), '_') as doc_id from {values(_STEMS, 'stem')}")
def doc_id_slug(spark, sf_dir):
    return literal(spark, _STEMS, "stem").select("stem", ft.document_slug(F.col("stem")).alias("doc_id"))


_CELLS = """('106.2 *', '106.2', null), ('45.1 **', '45.1', null), ('1,234 r', '1234', null), ('56.7 p', '56.7', null), ('45%', '45', '%'),
('$1,234', '1234', 'USD'), ('$(5)', '-5', 'USD'), ('($5)', '($5)', null), ('(1,234.5)', '-1234.5', null), ('n/a', null, null), ('—', null, null),
('', null, null), ('18.', '18.', null), ('-$5', '-$5', null), ('(5%)', '(5%)', null), ('(5)%', '-5', '%'), ('  Total  ', 'Total', null), ('€7.50', '7.5', 'EUR'), ('-3', '-3', null), ('.5', '0.5', null), (null, null, null), ('None', null, null),
('12,345,678.5', '12345678.5', null), ('0.0001', '0.0001', null), ('0.00001', '1e-05', null), ('-0.0000120', '-1.2e-05', null), ('00012.50', '12.5', null), ('-0', '0', null), ('(0.00)', '0', null), ('123456789012345', '123456789012345', null)"""


@query(f"select cast(raw as varchar) as raw, cast(value as varchar) as value, cast(unit as varchar) as unit from {values(_CELLS, 'raw, value, unit')}")
def parse_cell(spark, sf_dir):
    rows = literal(spark, _CELLS, "raw, value, unit").withColumn("p", ft.parse_cell(F.col("raw")))
    return rows.select("raw", "p.value", "p.unit")


_TOKENS = "('1,250'), ('$45.00'), ('(45.0)'), ('-7'), ('(-7)'), ('007'), ('0.50'), ('-0'), ('12%'), ('-$5'), ('($5)'), ('abc'), ('224647411220468213'), ('224647411220468214'), ('3rd'), ('106.2*')"


@query(f"select token, {norm_sql('token')} as canonical from {values(_TOKENS, 'token')}")
def normalise_number(spark, sf_dir):
    return literal(spark, _TOKENS, "token").select("token", ft.normalise_number(F.col("token")).alias("canonical"))


_RAW = "('d1', 'old', 1), ('d1', 'new', 2), ('d2', 'only', 1)"


@query(f"select doc_id, title, version from (select *, row_number() over (partition by doc_id order by version desc) as k from {values(_RAW, 'doc_id, title, version')}) where k = 1")
def upsert_documents(spark, sf_dir):
    return oc.latest(literal(spark, _RAW, "doc_id, title, version"), ["doc_id"], "version")


_PLANS = """('p01', 'sum', 0, 'd', 't', 1, 1), ('p01', 'sum', 1, 'd', 't', 1, 2), ('p02', 'diff', 0, 'd', 't', 4, 1), ('p02', 'diff', 1, 'd', 't', 4, 2),
('p03', 'ratio', 0, 'd', 't', 1, 1), ('p03', 'ratio', 1, 'd', 't', 2, 1), ('p04', 'pct_change', 0, 'd', 't', 1, 2), ('p04', 'pct_change', 1, 'd', 't', 1, 1),
('p05', 'lookup', 0, 'd', 't', 9, 9), ('p06', 'lookup', 0, 'd', 't', 3, 1), ('p07', 'lookup', 0, 'd', 't', 3, 2), ('p08', 'lookup', 0, 'd', 't', 1, 1), ('p08', 'lookup', 1, 'd', 't', 1, 2),
('p09', 'median', 0, 'd', 't', 1, 1), ('p10', 'sum', cast(null as int), null, null, null, null), ('p11', 'mean', 0, 'd', 't', 1, 1), ('p11', 'mean', 1, 'd', 't', 2, 2),
('p12', 'sum', 0, 'd', 't', 3, 3), ('p13', 'max', 0, 'd', 't', 3, 3), ('p14', 'ratio', 0, 'd', 't', 1, 1), ('p14', 'ratio', 1, 'd', 't', 2, 2), ('p15', 'lookup', 0, 'd', 't', 3, 4), ('p16', 'min', 0, 'd', 't', 1, 1), ('p16', 'min', 1, 'd', 't', 1, 2)"""


_PLAN_COLUMNS = "plan_id, operation, pos, doc_id, table_id, row, col"


_LITERAL_CELLS = """('d', 1, 't', 1, 1, '10.5', 'USD'), ('d', 1, 't', 1, 2, '4', 'USD'), ('d', 2, 't', 2, 1, '0', 'USD'), ('d', 2, 't', 2, 2, '8', '%'),
('d', 3, 't', 3, 1, cast(null as string), null), ('d', 3, 't', 3, 2, 'n.s.', null), ('d', 3, 't', 3, 3, '7', null), ('d', 3, 't', 3, 4, '1d', null), ('d', 4, 't', 4, 1, '1.80', '%'), ('d', 4, 't', 4, 2, '0.60', '%')"""


_CELL_COLUMNS = "doc_id, page, table_id, row, col, value, unit"


_EXPECTED = """('p01', 'sum', 14.5, 'USD', null, 'd p1 t r1c1 [USD]; d p1 t r1c2 [USD]', null), ('p02', 'diff', 1.2, '%', null, 'd p4 t r4c1 [%]; d p4 t r4c2 [%]', null), ('p03', 'ratio', null, null, null, null, 'zero denominator'),
('p04', 'pct_change', 162.5, 'USD', null, 'd p1 t r1c2 [USD]; d p1 t r1c1 [USD]', null), ('p05', 'lookup', null, null, null, null, 'missing cell'), ('p06', 'lookup', null, null, null, null, 'null cell'),
('p07', 'lookup', null, null, null, null, 'not a number'), ('p08', 'lookup', null, null, null, null, 'wrong number of cells'), ('p09', 'median', null, null, null, null, 'unsupported operation'), ('p10', 'sum', null, null, null, null, 'no cells'),
('p11', 'mean', 9.25, null, 'mixed units', 'd p1 t r1c1 [USD]; d p2 t r2c2 [%]', null), ('p12', 'sum', 7.0, null, 'no units', 'd p3 t r3c3', null), ('p13', 'max', 7.0, null, null, 'd p3 t r3c3', null),
('p14', 'ratio', 1.3125, null, null, 'd p1 t r1c1 [USD]; d p2 t r2c2 [%]', null), ('p15', 'lookup', null, null, null, null, 'not a number'), ('p16', 'min', 4.0, 'USD', null, 'd p1 t r1c1 [USD]; d p1 t r1c2 [USD]', null)"""


@query(f"select plan_id, operation, cast(value as double) as value, cast(unit as varchar) as unit, cast(unit_warning as varchar) as unit_warning, cast(citations as varchar) as citations, cast(error as varchar) as error from {values(_EXPECTED, 'plan_id, operation, value, unit, unit_warning, citations, error')}")
def compute_errors(spark, sf_dir):
    return compute.execute(literal(spark, _PLANS, _PLAN_COLUMNS), literal(spark, _LITERAL_CELLS, _CELL_COLUMNS))


_QUESTIONS = """('r1', 'Compare the two reports on growth', 'multi-doc', 0.85), ('r2', 'What was the total change in exports?', 'numeric', 0.85), ('r3', 'What is the average price?', 'numeric', 0.7),
('r4', 'Why did the board state a purpose?', 'prose', 0.8), ('r5', 'Who chairs the board in 2024?', 'prose', 0.3), ('r6', 'Explain the growth in output', 'prose', 0.3), ('r7', 'Describe the total, the average and the maximum', 'numeric', 0.85),
('r8', 'What percent of loans, and how much higher than before?', 'numeric', 0.85), ('r9', 'Do both sources AGREE?', 'multi-doc', 0.85)"""


@query(f"select id, question, path, cast(confidence as double) as confidence from {values(_QUESTIONS, 'id, question, path, confidence')}")
def route_rules(spark, sf_dir):
    return decide.route(literal(spark, _QUESTIONS, "id, question, p, c").select("id", "question")).select("id", "question", "path", "confidence")


_GATE = """('g1', 'outstanding consumer loans charged-off', 'Charge-offs', 'Outstanding', 'Consumer credit'), ('g1', 'outstanding consumer loans charged-off', 'Deposits', '2024', ''),
('g2', 'corn production in Iowa', 'Wheat exports', '2024', 'Trade'), ('g3', 'what was the rate', 'Anything', '', ''), ('g4', 'housing vacancies', 'Vacancy', 'Housing units', '')"""


_GATED = "('g1', 2, 3, true), ('g2', 1, 0, false), ('g3', 1, 0, true), ('g4', 1, 2, true)"


@query(f"select question_id, n_cells::bigint as n_cells, best_hits, supported from {values(_GATED, 'question_id, n_cells, best_hits, supported')}")
def evidence_gate(spark, sf_dir):
    return decide.gate(literal(spark, _GATE, "question_id, question, row_label, header, section"))


_REPLIES = """('v1', '{"table": 1, "operation": "sum", "cells": [1, 2]}'), ('v2', '{"table": "2", "operation": "lookup", "cells": [{"id": "3"}]}'), ('v3', 'no json here'), ('v4', '{"table": 9, "operation": "sum", "cells": [1]}'),
('v5', '{"table": 1, "operation": "median", "cells": [1]}'), ('v6', '{"table": 1, "operation": "sum", "cells": []}'), ('v7', '{"table": 1, "operation": "sum", "cells": [1, 99]}'), ('v8', '{"table": 1, "operation": "diff", "cells": [{"cell": 2}, {"cell_id": 1}]}'), ('v9', '[1]')"""


_PARSED = """('v1', 1, 'sum', '1,2', null), ('v2', 2, 'lookup', '3', null), ('v3', null, null, null, 'not JSON'), ('v4', 9, 'sum', null, 'unknown table'), ('v5', 1, 'median', null, 'unsupported operation'), ('v6', 1, 'sum', null, 'no cells'), ('v7', 1, 'sum', null, 'unknown cell'), ('v8', 1, 'diff', '2,1', null), ('v9', null, null, null, 'not JSON')"""


@query(f"select reply_id, cast(table_no as int) as table_no, cast(operation as varchar) as operation, cast(cells as varchar) as cells, cast(error as varchar) as error from {values(_PARSED, 'reply_id, table_no, operation, cells, error')}")
def plan_validate(spark, sf_dir):
    shown = literal(spark, "(1, 1), (1, 2), (2, 3)", "table_no, cell_id")
    return decide.validate_plans(literal(spark, _REPLIES, "reply_id, text"), shown, compute.OPERATIONS)


_ARBITER = "('a1', 0.85D, 5.0D, 0.6D, 0.9D), ('a2', 0.7D, 5.0D, 0.6D, 0.9D), ('a3', 0.85D, cast(null as double), cast(null as double), 0.4D), ('a4', 0.7D, 5.0D, 0.8D, 0.5D), ('a5', 0.85D, cast(null as double), cast(null as double), 0.0D)"


@query("select * from (values ('a1', 'numeric', 0.6::double), ('a2', 'numeric->prose', 0.9), ('a3', 'numeric->prose', 0.4), ('a4', 'numeric', 0.8), ('a5', 'numeric', 0.0)) as t(question_id, path, confidence)")
def path_arbitration(spark, sf_dir):
    return decide.arbitrate(literal(spark, _ARBITER, "question_id, route_conf, numeric_value, numeric_conf, prose_conf"))


_HITS = "('m1', 'x', 'prose', 1, 0.8D, cast(null as double)), ('m1', 'y', 'table', 1, 0.6D, 10.0D), ('m1', 'x', 'table', 2, 0.5D, 4.0D), ('m1', 'z', 'prose', 2, 0.9D, null), ('m2', 'x', 'prose', 1, 0.7D, null), ('m3', 'b', 'prose', 2, 0.4D, null), ('m3', 'a', 'prose', 1, 0.6D, 3.0D)"


@query("select question_id, n_docs::bigint as n_docs, docs, confidence, difference, note from (values ('m1', 2, 'y,x', 0.5::double, 6.0::double, null::varchar), ('m2', 1, 'x', 0.42, null, 'single-source'), ('m3', 2, 'a,b', 0.4, null, null)) as t(question_id, n_docs, docs, confidence, difference, note)")
def multidoc_merge(spark, sf_dir):
    return decide.merge_documents(literal(spark, _HITS, "question_id, doc_id, kind, pos, conf, value"))


_CLAIMS = "('c1', 'Household spending on housing costs by type reached 42.75'), ('c2', 'Household spending by type on food was 99'), ('c3', 'Nothing here'), ('c4', 'Household spending type'), ('c5', 'Wages income change rose 2.6 percent')"


@query("""select claim_id, score, doc_id, table_id, row, col, value, unit::varchar as unit, row_label, section from (values
('c1', 5, 'a', 't1', 4, 1, '40', null, 'Housing costs', 'Household spending by type'), ('c2', 4, 'a', 't1', 3, 1, '12.5', null, 'Food', 'Household spending by type'), ('c5', 3, 'a', 't1', 6, 3, '2.6', '%', 'Wages', 'Income')) as t(claim_id, score, doc_id, table_id, row, col, value, unit, row_label, section)""")
def label_overlap_match(spark, sf_dir):
    return verify.match_cells(literal(spark, _CLAIMS, "claim_id, text"), oc.labelled(store(spark)))


_CASES = """('k1', 'poverty rate in 2022 was 11.5', 3, 0.7D, 11.5D, cast(null as string)), ('k2', 'rate was 12', 3, 0.7D, 11.5D, null), ('k3', 'no evidence', 0, cast(null as double), null, null), ('k4', 'weak 5', 2, 0.3D, 5.0D, null),
('k5', 'judged', 2, 0.7D, null, 'supported'), ('k6', 'judged', 2, 0.5D, null, 'contradicted'), ('k7', 'silent', 2, 0.5D, null, null), ('k8', 'in 2022', 2, 0.5D, 2022.0D, null)"""


@query("""select * from (values ('k1', 'supported', 0.9::double, true), ('k2', 'contradicted', 0.85, true), ('k3', 'unverifiable', 0.0, false), ('k4', 'unverifiable', 0.3, false), ('k5', 'supported', 0.85, false), ('k6', 'contradicted', 0.7, false), ('k7', 'unverifiable', 0.5, false), ('k8', 'supported', 0.9, true)) as t(claim_id, verdict, confidence, recomputed)""")
def claim_verdict(spark, sf_dir):
    return verify.verdicts(literal(spark, _CASES, "claim_id, text, n_evidence, score, cell, judged"))


_NEEDLES = """('1.36 percent', '1.3', false), ('rose 1.3 percent', '1.3', true), ('15.2 and 45.1', '5', false), ('about 5 percent', '5', true), ('The rate was 1.3.', '1.3', true), ('text 12,419.3 here', '12419.3', true),
('text', '', false), ('Corn rose', 'Corn', true), ('Corn rose', 'corn', false), ('12', '12', true), ('1.12', '12', false), ('12.0', '12', false)"""


@query(f"select text, needle, found from {values(_NEEDLES, 'text, needle, found')}")
def matches_needle(spark, sf_dir):
    rows = literal(spark, _NEEDLES, "text, needle, f").select("text", "needle")
    return rows.withColumn("found", ft.matches_needle(F.col("text"), F.col("needle")))


_GRADES = """('n1', 'about 12', 12.05D, 12.0D, array('x')), ('n2', 'about 12', 12.07D, 12.0D, array('x')), ('n3', 'none', cast(null as double), 12.0D, array('x')), ('n4', 'zero', 0.0D, 0.0D, array('x')),
('t1', 'GDP rose 1.3 percent in 2024', cast(null as double), cast(null as double), array('1.3', '2024')), ('t2', 'GDP rose 1.36 percent', null, null, array('1.3', 'GDP')), ('t3', 'text', null, null, cast(array() as array<string>))"""


@query("select id, correct, partial::double as partial from (values ('n1', true, 0.0), ('n2', false, 0.0), ('n3', false, 0.0), ('n4', true, 0.0), ('t1', true, 1.0), ('t2', false, 0.5), ('t3', false, 0.0)) as t(id, correct, partial)")
def grade_numeric(spark, sf_dir):
    return evaluate.grade(literal(spark, _GRADES, "id, answer, got, want, needles"))


_CITES = "('a', array('d1', 'd2'), array('d2')), ('b', array('d1'), array('d3', 'd4')), ('c', array('d1'), cast(array() as array<string>)), ('d', array('d1'), array('d1'))"


@query("select * from (values ('a', true), ('b', false), ('c', false), ('d', true)) as t(id, ok)")
def citation_ok(spark, sf_dir):
    return literal(spark, _CITES, "id, wanted, cited").select("id", evaluate.citation_ok(F.col("wanted"), F.col("cited")).alias("ok"))


_PUBLISHED = ", ".join(f"('{e}', '{p}', {str(e == 'contradicted').lower()})" for e, p, n in (("supported", "supported", 7), ("supported", "contradicted", 2), ("contradicted", "supported", 3), ("contradicted", "contradicted", 2), ("unverifiable", "unverifiable", 1)) for _ in range(n))


@query("select 2::bigint as tp, 2::bigint as fp, 4::bigint as fn, 7::bigint as tn, 0.5::double as precision, 0.333333::double as recall, 0.4::double as f1, 0.666667::double as exact")
def verification_golden(spark, sf_dir):
    """The published verdicts: 15 claims, 6 planted errors; the unverifiable one was planted too."""
    rows = literal(spark, _PUBLISHED, "expected, predicted, planted")
    return evaluate.confusion(rows.withColumn("planted", F.col("expected") != "supported"))


_CHECKS = "('x1', 1, '3.17', true), ('x1', 2, '3.17', false), ('x1', 1, '2.4', false), ('x1', 2, '2.4', true), ('x2', 1, '5', true), ('x2', 2, '5', true), ('x3', 1, '7', true), ('x3', 1, '8', false), ('x3', 2, '7', false), ('x3', 2, '8', false)"


@query("select * from (values ('x1', true, true, false), ('x2', false, true, true), ('x3', true, false, false)) as t(id, both_needed, grounded, leaked)")
def eval_checks_123(spark, sf_dir):
    return evaluate.evidence_checks(literal(spark, _CHECKS, "id, page, needle, found"))


_CHOICES = "('C', 'C'), ('...the object (D).', 'D'), ('A certain atom has B electrons', 'B'), ('the answer is C', 'C'), ('Answer: (E)', 'E'), ('I would pick B here', 'B'), ('According to the problem', ''), ('A', 'A'), ('A. because', 'A'), ('', ''), ('Surely 3', '3'), ('Option A', 'A')"


@query(f"select reply, choice from {values(_CHOICES, 'reply, choice')}")
def extract_choice(spark, sf_dir):
    return literal(spark, _CHOICES, "reply, c").select("reply", ft.extract_choice(F.col("reply")).alias("choice"))


_SENTENCES = "('Real consumer spending on durable goods rose 12.5 percent', '12.5', 'real consumer spending durable'), ('It was 12.5', '12.5', cast(null as string)), ('Total outstanding household mortgage debt balances of the nation were 880', '880', 'household mortgage debt balances')"


@query("select sentence, topic from (values ('Real consumer spending on durable goods rose 12.5 percent', 'consumer spending durable goods'), ('It was 12.5', null), ('Total outstanding household mortgage debt balances of the nation were 880', 'mortgage debt balances nation')) as t(sentence, topic)")
def topic_extract(spark, sf_dir):
    return literal(spark, _SENTENCES, "sentence, figure, t").select("sentence", traindata.topic(F.col("sentence"), F.col("figure")).alias("topic"))


_EXAMPLES = """('e1', 'What is the value of wages in 2024 for the row?', 'lookup', 'Wages', '1005', true, 0, false), ('e2', 'Too short', 'lookup', 'Wages', '1005', true, 0, false), ('e3', 'What is {row} in the table of wages?', 'lookup', 'Wages', '1005', true, 0, false),
('e4', 'Which of the cells holds 1005 in the table?', 'lookup', '8.8 8.4 7.7', '1005', true, 2, true), ('e5', 'Which entry is the highest of them all?', 'max', 'Wages', '1005', true, 0, false), ('e6', 'Which column entry is the highest of them?', 'max', 'Wages', '1005', false, 0, false)"""


@query("""select id, reasons, reasons = '' as passed from (values ('e1', ''), ('e2', 'question_length'), ('e3', 'unfilled_placeholder'), ('e4', 'label_mostly_digits,value_leaked,ambiguous,contaminated_cell'), ('e5', 'superlative_without_column'), ('e6', 'target_missing')) as t(id, reasons)""")
def qc_cells(spark, sf_dir):
    return traindata.check_cells(literal(spark, _EXAMPLES, "id, question, operation, label, value, has_target, twins, in_eval"))


_TWO = "'[a_2020 p1] Output rose 12.5 percent.' || chr(10) || chr(10) || '[b_116 p2] Prices fell.'"


_QC = f"""('p1', 'first', {_TWO}, 'q', 'It is 12.5', '12.5', '99.9', array('7')), ('p2', 'negative', {_TWO}, 'q', 'NOT_IN_CONTEXT', '12.5', '99.9', array('7')), ('p3', 'negative', {_TWO}, 'q', 'maybe', '55', '99.9', array('7')),
('p4', 'first', {_TWO}, 'about the reported figure', 'It is 13', '116', '12.5', array('116')), ('p5', 'second', '[a p1] 7.7 here' || chr(10) || chr(10) || '[b p2] 7.7 there', 'q', '7.7', '7.7', '1.1', array('7')), ('p6', 'first', '[a p1] 7.7 ' || repeat('x', 3000), 'q', '7.7', '7.7', '1.1', array('7'))"""


@query("""select id, codes, codes = '' as passed from (values ('p1', ''), ('p2', 'negative_is_false'), ('p3', 'negative_bad_target'), ('p4', 'degenerate_topic,ungrounded_figure,answer_lost_figure,leaked_other_half,contaminated_figure'), ('p5', 'ambiguous_figure'), ('p6', 'target_truncated_to_zero')) as t(id, codes)""")
def qc_multidoc(spark, sf_dir):
    return traindata.check_pairs(literal(spark, _QC, "id, kind, context, question, answer, figure, other_figure, eval_figures"))


_CONFIGS = "('m7', 28, 28, 4, 3584, 7.6D), ('m3', 36, 16, 2, 2048, 3.1D)"


@query("select * from (values ('m7', 57344::bigint), ('m3', 36864::bigint)) as t(model, bytes_per_token)")
def kv_cache_table(spark, sf_dir):
    return reports.kv_cache(literal(spark, _CONFIGS, "model, layers, heads, kv_heads, hidden, params"))


@query("select model, precision, gb::double as gb, gb < 4.5 as fits from (values ('m7', 'FP16', 15.2), ('m7', 'INT8', 7.6), ('m7', 'INT4', 3.8), ('m3', 'FP16', 6.2), ('m3', 'INT8', 3.1), ('m3', 'INT4', 1.55)) as t(model, precision, gb)")
def weight_footprint(spark, sf_dir):
    models = literal(spark, _CONFIGS, "model, layers, heads, kv_heads, hidden, b").select("model", (F.col("b") * 1e9).alias("params"))
    return reports.weight_footprint(models, 4.5)


@query("select model, context, bytes * context as bytes_per_user, floor(0.5e9 / (bytes * context))::bigint as users from (values ('m7', 57344::bigint), ('m3', 36864::bigint)) as t(model, bytes), (values (1024), (4096)) as c(context)")
def concurrent_users(spark, sf_dir):
    cache = reports.kv_cache(literal(spark, _CONFIGS, "model, layers, heads, kv_heads, hidden, params"))
    return reports.concurrent_users(cache, literal(spark, "(1024), (4096)", "context"), 4.5, 4.0)


_LOG = "('Iter 1: Val loss 3.929, Val took 80.1s'), ('Iter 10: Train loss 1.908, Learning Rate 1.000e-04, It/sec 0.071, Tokens/sec 84.3, Trained Tokens 9000, Peak mem 4.70 GB'), ('loading model'), ('Iter 20: Train loss 0.028, Tokens/sec 90, Peak mem 4.7 GB')"


@query("select iter, kind, loss::double as loss, tokens_per_s::double as tokens_per_s, peak_gb::double as peak_gb from (values (1, 'val', 3.929, null, null), (10, 'train', 1.908, 84.3, 4.7), (20, 'train', 0.028, 90.0, 4.7)) as t(iter, kind, loss, tokens_per_s, peak_gb)")
def train_log_parse(spark, sf_dir):
    return reports.train_log(literal(spark, _LOG, "line"))
