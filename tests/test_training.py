"""Examples of cell selection, their checks, and near copies kept once, against loops."""

import random
import re

import pytest
from pyspark.sql import functions as F

from foliant.operators import cellexamples, traindata
from foliant.queries import training

SF = "/root/testdata/sf0.001"


def grams(text):
    t = re.findall(r"[a-z0-9.]+", text.lower())
    return {" ".join(t[i : i + 5]) for i in range(len(t) - 4)}


def similar(a, b):
    return round(len(a & b) / len(a | b), 6) if a and b else 0.0


@pytest.fixture(scope="module")
def texts():
    draw = random.Random(9)
    base = [" ".join(draw.choices("alpha beta gamma delta 1.5 rate of the bank".split(), k=draw.choice([3, 60, 90, 140]))) for _ in range(12)]
    out = list(base)
    for t in base:  # chains of small edits, so that close rows of close rows are apart
        for _ in range(6):
            w = t.split()
            w[draw.randrange(len(w))] = draw.choice(["x", "y", "z"])
            t = " ".join(w)
            out.append(t)
    out += [base[1], base[1].upper(), "", "", out[20], out[20]]
    draw.shuffle(out)
    return [(10 * i, t) for i, t in enumerate(out)] + [(10**6, None)]


@pytest.mark.parametrize("threshold", [0.85, 0.6])
def test_greedy_keep_is_the_pass_in_order(spark, texts, threshold):
    kept, want = [], {}
    for i, t in texts:
        g = grams(t or "")
        of = next((k for k, s in kept if similar(g, s) >= threshold), None)
        if of is None:
            kept.append((i, g))
        want[i] = (of is None, of)
    got = {r["id"]: (r["kept"], r["of"]) for r in traindata.greedy_keep(spark.createDataFrame(texts, "id long, text string"), threshold).collect()}
    assert got == want and sum(not k for k, _ in want.values()) > 10


def test_greedy_keep_of_conversations_and_items(spark):
    turns = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), "text")
    items = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet").select((F.lit(10**9) + F.col("item_id")).alias("id"), "text")
    rows = turns.unionByName(items)
    kept, want = [], {}
    for r in sorted(rows.collect(), key=lambda r: r["id"]):
        g = grams(r["text"] or "")
        want[r["id"]] = not any(similar(g, s) >= 0.85 for s in kept)
        if want[r["id"]]:
            kept.append(g)
    assert {r["id"]: r["kept"] for r in traindata.greedy_keep(rows).collect()} == want


def test_close_between_equals_all_pairs(spark, texts):
    left, right = texts[::2], texts[1::2]
    got = {(r["a"], r["b"]): r["jaccard"] for r in traindata.close_between(*[spark.createDataFrame(x, "id long, text string") for x in (left, right)], 0.5).collect()}
    first = {}
    for i, t in right:
        first.setdefault(frozenset(grams(t or "")), i)
    want = {(i, b): s for i, t in left for g, b in first.items() if (s := similar(grams(t or ""), g)) >= 0.5}
    assert got == want and len(want) > 20


def test_examples_keep_their_rules(spark):
    cells = cellexamples.usable(training.line_cells(spark, SF, ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]))
    by_cell = {(r["table_id"], r["row"], r["col"]): r for r in cells.collect()}
    seen = set()
    for r in cellexamples.generate(cells, 900).collect():
        shown = r["candidates"]
        assert [c["id"] for c in shown] == list(range(1, len(shown) + 1)) and len(shown) >= cellexamples.LEAST_SHOWN
        assert len({(c["row"], c["col"]) for c in shown}) == len(shown)
        assert all(by_cell[r["table_id"], c["row"], c["col"]]["value"] == c["value"] for c in shown)
        targets = [shown[i - 1] for i in r["answer_cells"]]
        assert [t["value"] for t in targets] == r["answer_values"] and "{" not in r["question"]
        if r["operation"] in cellexamples.PAIRED:
            assert targets[0]["col"] == targets[1]["col"] and targets[0]["row_label"] != targets[1]["row_label"]
        if r["operation"] in cellexamples.RANKED:
            column = [float(c["value"]) for (t, _, col), c in by_cell.items() if t == r["table_id"] and col == targets[0]["col"]]
            assert float(targets[0]["value"]) == (max if r["operation"] == "max" else min)(column)
        key = lambda c: (c["row_label"], c["header"], c["section"])
        assert not [c for c in shown if c["id"] not in r["answer_cells"] and key(c) == key(targets[0])]
        seen |= {r["operation"], r["regime"]}
    assert seen == {*cellexamples.OPERATIONS, *cellexamples.REGIMES}


def test_examples_of_few_cells(spark):
    kinds = "doc_id string, page int, table_id string, row int, col int, value string, unit string, header string, row_label string, section string"
    none = spark.createDataFrame([], kinds)
    few = spark.createDataFrame([("d", 1, "t", r, 1, str(r), None, "h", "long label", None) for r in range(4)], kinds)  # twins of each other
    assert cellexamples.generate(none, 10).count() == 0
    assert cellexamples.generate(few, 10, most_rounds=2).count() == 0


def test_every_reason_occurs(spark):
    reasons = {c for r in training.cell_example_checks(spark, SF).collect() for c in r["reasons"].split(",")}
    assert reasons == {
        "", "question_length", "unfilled_placeholder", "target_missing", "label_mostly_digits", "value_leaked", "ambiguous",
        "superlative_without_column", "contaminated_cell", "contaminated_question",
    }


def test_token_counts_are_the_tokenizers(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    from foliant.plans.providers import token_counts

    tokenizer = Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json")))
    texts = [(i, r["text"]) for i, r in enumerate(spark.read.parquet(f"{SF}/conversations.parquet").collect())] + [(10**6, None), (10**6 + 1, ""), (10**6 + 2, "a <|endoftext|> 日本")]
    got = {r["id"]: r["n"] for r in spark.createDataFrame(texts, "id long, t string").select("id", token_counts("t").alias("n")).collect()}
    assert got == {i: len(tokenizer.encode(t or "", add_special_tokens=False).ids) for i, t in texts}


def test_budgets_hold_for_a_tokenizers_counts(spark):
    from foliant.plans.providers import token_counts

    context = "[a p1] " + "Output of 7.7 rose. " * 150  # 3,000 characters, some 1,000 tokens
    kinds = "id string, kind string, context string, question string, answer string, figure string, other_figure string, eval_figures array<string>"
    rows = spark.createDataFrame([("fits", "first", context, "q", "It is 7.7", "7.7", "1.1", []), ("long", "first", context * 3, "q", "It is 7.7", "7.7", "1.1", []), ("cut", "first", context, "q", "7.7 " + "and so on " * 500, "7.7", "1.1", [])], kinds)
    codes = lambda df: {r["id"]: r["codes"] for r in traindata.check_pairs(df).collect()}
    counted = codes(traindata.with_tokens(rows, token_counts))
    assert counted["fits"] == "" and counted["long"] == "target_truncated_to_zero" and counted["cut"] == "target_partly_truncated"
    assert codes(rows)["fits"] == "target_truncated_to_zero"  # by characters, which is too strict


def test_few_tables_give_the_examples_that_all_give(spark, monkeypatch):
    """A round over the tables first by the draw gives the same examples, and no more tables are tried than it takes."""
    from foliant.operators import cellexamples
    from foliant.queries.fixtures import line_cells

    cells = line_cells(spark, "/root/testdata/sf0.001", ["l_quantity", "l_tax"])
    whole, tried = cellexamples.examples, []
    monkeypatch.setattr(cellexamples, "examples", lambda c, *rest: tried.append(c.select("doc_id", "table_id").distinct().count()) or whole(c, *rest))
    got = {}
    for ahead in (2, 10**6):
        monkeypatch.setattr(cellexamples, "AHEAD", ahead)
        got[ahead] = sorted(r["id"] for r in cellexamples.generate(cells, 12).collect())
    assert got[2] == got[10**6] and len(got[2]) == 12 and tried[0] == 24 < tried[-1]


def _texts_of_all_sizes():
    """Texts of 5 to 300 words with some that lack, add or change a share of them, among texts that share passages alone."""
    rng = random.Random(11)
    texts, passage = [], [f"p{i}" for i in range(40)]
    for k in range(60):
        words = [f"w{k}x{i}" for i in range(rng.choice([5, 6, 9, 14, 30, 60, 120, 300]))]
        words[len(words) // 3 : len(words) // 3] = passage if k % 3 == 0 else []
        texts.append(words)
        for _ in range(3):
            cut, more = rng.randrange(len(words) // 4 + 1), rng.randrange(len(words) // 5 + 1)
            texts += [words[cut:], words[: len(words) - cut], words + [f"m{rng.random()}" for _ in range(more)], [*words[:cut], "edit", *words[cut:]]]
    return [(i, " ".join(t)) for i, t in enumerate(texts)] + [(10_000, ""), (10_001, None), (10_002, "two words")]


@pytest.mark.parametrize("threshold", [0.5, 0.85, 1.0])
def test_close_pairs_of_all_sizes(spark, threshold):
    rows = _texts_of_all_sizes()
    words = {k: re.findall("[a-z0-9.]+", (t or "").lower()) for k, t in rows}
    sets = {k: frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) for k, w in words.items()}
    first = {}
    for k, s in sets.items():
        first.setdefault(s, k)
    want = {(first[s], k, 1.0) for k, s in sets.items() if s and first[s] != k}
    heads = sorted((k, s) for s, k in first.items() if s)
    for i, (a, x) in enumerate(heads):
        for b, y in heads[i + 1 :]:
            j = round(len(x & y) / len(x | y), 6)
            if j >= threshold:
                want.add((a, b, j))
    made = spark.createDataFrame(rows, "id long, text string")
    got = [(r["a"], r["b"], r["jaccard"]) for r in traindata.close_pairs(made, threshold).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_texts_that_share_little_end_before_their_grams_are_counted(spark):
    passage = " ".join(f"p{i}" for i in range(12))
    rows = [(k, " ".join(f"w{k}x{i}" for i in range(80)) + " " + passage) for k in range(100)]
    sets = traindata.gram_sets(spark.createDataFrame([*rows, (100, rows[7][1] + " more")], "id long, text string"))
    assert sorted(r["id"] for r in traindata._meeting(sets, 0.85).collect()) == [7, 100]


def test_sets_are_compared_with_equal_ones_once(spark, texts):
    """What tells equal sets apart is made where the first rows are stored, and not again for the further rows."""
    near = traindata.close_pairs(spark.createDataFrame(texts, "id long, text string"), 0.85)
    assert "sha2" not in near._jdf.queryExecution().optimizedPlan().toString()
    assert near.where("jaccard = 1").count() > 3
