"""URL rules indexed by their rarest literal token.

A rule is a host and path prefix, or a pattern; each becomes one regular expression over host and path, with the literal
tokens that any URL it fits must hold. A rule is filed under that one of its tokens which the fewest rules share. The
tokens of a URL fetch candidate rules from the index, and only those run their expressions.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The rules, as (verdict, host and path).
RULES = [
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
]
# Patterns that block where no rule fits, as (literal token, expression over host + path).
PATTERNS = [
    ("spam", r"^[^/]*\bspam\b"),
    ("cheap", r"^[^/]*\bcheap\b"),
    ("casino", r"\bcasino\b"),
    ("pills", r"\bpills\b"),
    ("xxx", r"\bxxx\b"),
]
TOKEN = re.compile(r"[0-9A-Za-z]+")
#: Rules that a table may have.
MOST_RULES = 1_000_000


class Rule(NamedTuple):
    name: str | None
    verdict: str
    length: int
    tokens: tuple[str, ...]
    expression: re.Pattern


def compile_rules(rules=RULES, patterns=PATTERNS) -> dict[str, list[Rule]]:
    """Index from token to rules. Host-and-path rules outrank patterns, the longest first; of equal ones the earlier."""
    made = []
    for verdict, text in rules:
        host, slash, path = text.partition("/")
        # a path may go on after its last token, so only tokens that end inside the rule are sure
        sure = [*TOKEN.findall(host), *(m[0] for m in TOKEN.finditer(path) if m.end() < len(path))]
        made.append(Rule(text, verdict, len(text), tuple(sure), re.compile(rf"(?s)(?:[^/]*\.)?{re.escape(host)}{re.escape(slash + path)}")))
    made += [Rule(None, "block", -1, (token,), re.compile(pattern, re.ASCII)) for token, pattern in patterns]
    common = Counter(t for r in made for t in set(r.tokens))
    index = defaultdict(list)
    for rule in made:
        index[min(rule.tokens, key=lambda t: (common[t], t)) if rule.tokens else ""].append(rule)
    return dict(index)


def candidates(index: dict[str, list[Rule]], host: str, path: str) -> Iterator[Rule]:
    """The rules filed under a token of the URL, the only ones whose expressions run."""
    for token in {"", *TOKEN.findall(host), *TOKEN.findall(path)}:
        yield from index.get(token, ())


def read_rules(spark: SparkSession, path: str) -> tuple[list[tuple[str, str]], list[tuple[str, str]]]:
    """Rules and patterns of a table (verdict, rule, token, pattern): a rule is host and path, a pattern has its literal token.

    A rule table is as large as people keep it, not as the pages are many: more than MOST_RULES are an error.
    """
    rows = spark.read.schema("verdict string, rule string, token string, pattern string").parquet(path).limit(MOST_RULES + 1).collect()
    if len(rows) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    return [(r["verdict"], r["rule"]) for r in rows if r["rule"]], [(r["token"], r["pattern"]) for r in rows if r["pattern"]]


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path; both empty for null or without ://"""
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def judge(index: dict[str, list[Rule]], url: str | None) -> tuple[str, str, str | None, str]:
    """(host, path, rule, verdict): the longest rule that fits; else a pattern's verdict; else allow."""
    host, path = split_url(url)
    best = None
    for rule in candidates(index, host, path):
        # a host's own characters may include none of a path's start, so host and path are matched as one text
        if (best is None or rule.length > best.length) and rule.expression.match(host + path) if rule.name else (best is None and rule.expression.search(host + path)):
            best = rule
    return host, path, best.name if best else None, best.verdict if best else "allow"


def judge_pages(pages: DataFrame, rules=RULES, patterns=PATTERNS) -> DataFrame:
    """page_id, host, path, rule and verdict of every row of `pages` (page_id, url).

    Null and malformed URLs have empty host and path and are allowed. Repeated rows are judged alike, null ids stay
    null, and other columns are ignored.
    """
    shared = pages.sparkSession.sparkContext.broadcast((rules, patterns))
    made: list = []

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        if not made:
            made.append(compile_rules(*shared.value))
        for urls in batches:
            yield pd.DataFrame([judge(made[0], u) for u in urls], columns=["host", "path", "rule", "verdict"], dtype=object)

    found = F.pandas_udf(run, "host string, path string, rule string, verdict string")(F.col("url"))
    return pages.select(F.col("page_id").cast("long").alias("page_id"), found.alias("j")).select("page_id", "j.host", "j.path", "j.rule", "j.verdict")


#: The same judgement in SQL.
_NAMES = ", ".join(f"('{text}', '{verdict}', '{text.partition('/')[0]}', '/{text.partition('/')[2]}')" for verdict, text in RULES)
ORACLE = f"""
with parts as (
  select row_number() over () as n, page_id,
    case when position('://' in url) > 0 then substr(url, position('://' in url) + 3) else '' end as rest
  from pages),
hosts as (select n, page_id, rest, regexp_extract(rest, '^[^/?#]*') as h from parts),
split as (
  select n, page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    regexp_extract(substr(rest, length(h) + 1), '^[^?#]*') as path
  from hosts),
rules(rule, verdict, rule_host, rule_path) as (values {_NAMES}),
fits as (
  select s.n, r.rule, r.verdict, row_number() over (partition by s.n order by length(r.rule) desc) as k
  from split s join rules r
    on (s.host = r.rule_host or ends_with(s.host, '.' || r.rule_host)) and starts_with(s.path, r.rule_path))
select s.page_id, s.host, s.path, f.rule,
  case when f.verdict is not null then f.verdict
    when regexp_matches(s.host || s.path, '{"|".join(p for _, p in PATTERNS)}') then 'block' else 'allow' end as verdict
from split s left join fits f on f.n = s.n and f.k = 1
"""
