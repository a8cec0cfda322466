"""Training examples of cell selection: drawn from labelled cells, with distractors, checked against what may not be used.

All draws are the least md5 of a seed, the attempt and the row, so they hold however rows are dealt.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions.text import collapse, digit_ratio, gram_tokens
from foliant.operators.traindata import CONTAMINATED, LABEL_DIGITS, close_between, draw, fill
from foliant.session import stored

# Operations as often as they are drawn, candidates shown, what distractors share with the target.
OPERATIONS = ["lookup", "lookup", "lookup", "diff", "ratio", "pct_change", "sum", "max", "min"]
PAIRED, RANKED = ["diff", "ratio", "pct_change", "sum"], ["max", "min"]
LIST_SIZES = [10, 20, 40]
REGIMES = ["same_row_other_col", "same_col_other_row", "same_section_other_row", "same_label_other_section"]
LEAST_SHOWN, LEAST_CELLS, LONGER, LEAST_RANKED = 4, 4, 5, 3
QUESTION = (20, 260)
#: Skeletons of questions by operation.
TEMPLATES = {
    "lookup": ["Which value does {doc} give for {row} under {col}{sec}?", "How large is {row} in the column {col}{sec}?", "Find the entry of {row} for {col}{sec}."],
    "diff": ["By how much does {row} exceed {other} under {col}{sec}?", "How far apart are {row} and {other} for {col}{sec}?"],
    "ratio": ["How many times {other} is {row} under {col}{sec}?"],
    "pct_change": ["By what per cent does {row} differ from {other} under {col}{sec}?"],
    "sum": ["What do {row} and {other} come to together under {col}{sec}?"],
    "max": ["Which row has the largest entry in the column {col}?"],
    "min": ["Which row has the smallest entry in the column {col}?"],
}
#: Tables that a round starts with, for each example it still needs.
AHEAD = 4
#: Pieces that a table's cells are ranked in before the best of all pieces are.
PIECES = 64
TABLE = ["doc_id", "table_id"]
CELL = ["page", "row", "col", "value", "unit", "row_label", "header", "section"]


def usable(cells: DataFrame) -> DataFrame:
    """Numeric cells whose row has a label of more than LONGER characters, with a header or section, of tables with LEAST_CELLS of them."""
    named = F.coalesce(F.col("header") != "", F.lit(False)) | F.coalesce(F.col("section") != "", F.lit(False))
    good = cells.where((F.length("row_label") > LONGER) & named & F.col("value").try_cast("double").isNotNull()).select(*TABLE, *CELL)
    many = good.withColumn("__n", F.count("*").over(Window.partitionBy(*TABLE))).where(F.col("__n") >= LEAST_CELLS)
    return many.drop("__n").na.fill("", ["header", "section"])


def _hash(what: str, seed: str, *keys: str) -> Column:
    return F.md5(F.concat_ws("|", F.lit(f"{seed}:{what}"), *[F.col(k).cast("string") for k in keys]))


def _pick(what: str, seed: str, n: int) -> Column:
    return F.conv(F.substring(_hash(what, seed, *TABLE, "attempt"), 1, 7), 16, 10).cast("long") % n


def examples(cells: DataFrame, attempt: int, seed: str = "cells") -> DataFrame:
    """One attempt at an example for each table of usable cells; tables that give no clean one are left out.

    Operation, size of the list, regime and skeleton are drawn. A pair is two rows of one column; max and min take the
    column's extreme (ties: the first by row and column) of three cells at least; all else one cell. Labels that are mostly
    digits, fewer than LEAST_SHOWN candidates, and candidates with the target's own labels are refused. Distractors that
    fit the regime come first; the answer's place among the candidates is drawn.
    """
    ops = F.array(*[F.lit(o) for o in OPERATIONS])
    tries = cells.select(*TABLE).distinct().withColumn("attempt", F.lit(attempt))
    tries = tries.withColumn("operation", F.get(ops, _pick("operation", seed, len(OPERATIONS)).cast("int")))
    tries = tries.withColumn("wanted", F.get(F.array(*[F.lit(n) for n in LIST_SIZES]), _pick("size", seed, len(LIST_SIZES)).cast("int")))
    tries = tries.withColumn("regime", F.get(F.array(*[F.lit(r) for r in REGIMES]), _pick("regime", seed, len(REGIMES)).cast("int")))
    rows = cells.withColumn("attempt", F.lit(attempt)).withColumn("cell", F.struct(*CELL))
    first = rows.groupBy(*TABLE).agg(F.min_by("cell", F.struct(_hash("first", seed, *TABLE, "attempt", "row", "col").alias("h"), "row", "col")).alias("a"))
    drawn = tries.join(first, TABLE)

    # the other cell of a pair, and the extreme of a column, are in the drawn cell's column
    column = rows.select(*TABLE, "row", "col", "cell", "attempt").join(drawn.select(*TABLE, "operation", "a"), TABLE).where("cell.col = a.col")
    other = F.when(F.col("cell.row_label") != F.col("a.row_label"), F.struct(_hash("second", seed, *TABLE, "attempt", "row", "col").alias("h"), "row", "col"))
    size = F.col("cell.value").try_cast("double")
    best = F.struct(F.when(F.col("operation") == "max", -size).otherwise(size).alias("v"), "row", "col")
    found = column.groupBy(*TABLE).agg(F.min_by("cell", other).alias("b"), F.min_by("cell", best).alias("best"), F.count("*").alias("n_column"))
    paired, ranked = F.col("operation").isin(PAIRED), F.col("operation").isin(RANKED)
    aimed = drawn.join(found, TABLE).where((~paired | F.col("b").isNotNull()) & (~ranked | (F.col("n_column") >= LEAST_RANKED)))
    targets = F.when(paired, F.array("a", "b")).when(ranked, F.array("best")).otherwise(F.array("a"))
    aimed = aimed.select(*TABLE, "attempt", "operation", "wanted", "regime", targets.alias("targets"))
    aimed = stored(aimed.where(~F.exists("targets", lambda t: digit_ratio(t["row_label"]) > LABEL_DIGITS)), "targets")

    t = F.col("targets")[0]
    same = lambda n: F.col(f"cell.{n}") == t[n]
    fits = (
        F.when(F.col("regime") == REGIMES[0], same("row")).when(F.col("regime") == REGIMES[1], same("col")).when(F.col("regime") == REGIMES[2], same("section"))
        .otherwise(same("row_label") & ~same("section"))
    )
    pool = rows.select(*TABLE, "row", "col", "cell").join(aimed, TABLE)
    pool = pool.where(~F.exists("targets", lambda x: (x["row"] == F.col("row")) & (x["col"] == F.col("col"))))
    pool = pool.withColumn("first", F.when(fits, 0).otherwise(1)).withColumn("h", _hash("distract", seed, *TABLE, "attempt", "row", "col"))
    pool = pool.withColumn("piece", F.pmod(F.xxhash64("row", "col"), F.lit(PIECES)))
    place = lambda *keys: F.row_number().over(Window.partitionBy(*TABLE, *keys).orderBy("first", "h", "row", "col"))
    fewer = pool.withColumn("place", place("piece")).where(F.col("place") <= F.col("wanted"))
    chosen = fewer.withColumn("place", place()).where(F.col("place") <= F.col("wanted") - F.size("targets"))
    labels = lambda c: F.lower(F.concat_ws("\u0001", c["row_label"], c["header"], c["section"]))
    kept = chosen.groupBy(*TABLE, "attempt").agg(F.collect_list(F.when(labels(F.col("cell")) != labels(t), F.col("cell"))).alias("others"))
    made = aimed.join(kept, [*TABLE, "attempt"])
    made = made.where(F.size("targets") + F.size("others") >= LEAST_SHOWN)
    order = lambda c: F.md5(F.concat_ws("|", F.lit(f"{seed}:order"), *TABLE, F.col("attempt").cast("string"), c["row"].cast("string"), c["col"].cast("string")))
    shown = F.array_sort(F.transform(F.concat("targets", "others"), lambda c: F.struct(order(c).alias("h"), c.alias("cell"))))
    made = made.withColumn("shown", F.transform(shown, lambda s: s["cell"]))
    ids = F.transform("targets", lambda x: F.array_position(F.transform("shown", lambda s: F.struct(s["row"], s["col"])), F.struct(x["row"], x["col"])).cast("int"))
    candidate = lambda c, i: F.struct(
        (i + 1).alias("id"), c["value"].alias("value"), c["unit"].alias("unit"), collapse(c["row_label"], 60).alias("row_label"), collapse(c["header"], 50).alias("header"),
        collapse(c["section"], 50).alias("section"), c["row"].alias("row"), c["col"].alias("col"),
    )
    made = made.withColumn("answer_cells", ids).withColumn("answer_values", F.transform("targets", lambda x: x["value"]))
    which = F.coalesce(*[F.when(F.col("operation") == o, _pick("skeleton", seed, len(ts))) for o, ts in TEMPLATES.items()])
    made = made.withColumn("template_id", F.concat("operation", F.lit("#"), which.cast("string")))
    skeleton = F.coalesce(*[F.when(F.col("template_id") == f"{o}#{i}", F.lit(s)) for o, ts in TEMPLATES.items() for i, s in enumerate(ts)])
    section = F.when(t["section"] != "", F.concat(F.lit(" in "), collapse(t["section"], 40))).otherwise("")
    header = F.when(t["header"] != "", collapse(t["header"], 40)).otherwise("that column")
    question = fill(
        skeleton, doc=F.substring(F.replace("doc_id", F.lit("_"), F.lit(" ")), 1, 40), row=collapse(t["row_label"], 40),
        other=collapse(F.element_at("targets", -1)["row_label"], 40), col=header, sec=section,
    )
    return made.select(
        F.concat_ws("|", *TABLE, F.col("attempt").cast("string")).alias("id"), *TABLE, t["page"].alias("page"), "attempt", "operation", "regime", "template_id",
        question.alias("question"), "answer_cells", "answer_values", F.transform("shown", candidate).alias("candidates"),
    )


def generate(cells: DataFrame, target: int, seed: str = "cells", most_rounds: int = 40) -> DataFrame:
    """`target` examples, or as many as `most_rounds` rounds over all tables give: each round tries every table once more.

    Of the last round those that come first by a draw are kept. The draw is known before an example is made, so a round
    starts with AHEAD times as many tables as it needs, those first by it, and takes more only where they give too few:
    tables after them could not come before what they gave.
    """
    good = usable(cells)
    tables = stored(good.select(*TABLE).distinct(), "usable-tables")
    n_tables, whole = tables.count(), None
    made, rounds = 0, []
    for k in range(most_rounds):
        drawn = tables.withColumn("id", F.concat_ws("|", *TABLE, F.lit(str(k)))).withColumn("d", draw(f"{seed}:keep", "id"))
        asked = AHEAD * (target - made)
        while True:
            if asked >= n_tables:
                whole = some = whole or stored(good, "usable-cells")
            else:
                first = stored(drawn.orderBy("d", "id").limit(asked).select(*TABLE), "first-tables")
                some = stored(good.join(first, TABLE, "left_semi"), "usable-cells")
            one = stored(examples(some, k, seed), "examples")
            n = one.count()
            if made + n >= target or asked >= n_tables:
                break
            asked *= AHEAD
        rounds.append(one)
        made += n
        if made >= target or not n_tables:
            break
    if made > target:
        rank = F.struct(draw(f"{seed}:keep", "id").alias("d"), "id")
        last = rounds[-1].orderBy(rank).limit(target - made + n)
        rounds[-1] = rounds[-1].join(last.select("id"), "id", "left_semi").select(*rounds[-1].columns)
    out = rounds[0]
    for one in rounds[1:]:
        out = out.unionByName(one)
    return out


def check_examples(rows: DataFrame, eval_questions: DataFrame, eval_cells: DataFrame) -> DataFrame:
    """Rejection reasons of examples as `examples` makes them: id, reasons, passed.

    What a reason needs is found here: targets among the candidates, other candidates with the first target's labels,
    targets that evaluation cells (doc_id, table_id, row_label, section) use, and the closest of the evaluation questions
    (id, text) by word 5-grams.
    """
    targets = F.filter("candidates", lambda c: F.array_contains("answer_cells", c["id"]))
    labels = lambda c: F.lower(F.concat_ws("\u0001", c["row_label"], c["header"], c["section"]))
    own = rows.withColumn("targets", targets)
    used = eval_cells.select(*TABLE, F.lower(F.trim(F.coalesce("row_label", F.lit("")))).alias("l"), F.lower(F.trim(F.coalesce("section", F.lit("")))).alias("s")).distinct()
    each = own.select("id", *TABLE, F.explode("targets").alias("t")).select("id", *TABLE, F.lower(F.trim("t.row_label")).alias("l"), F.lower(F.trim("t.section")).alias("s"))
    in_eval = each.join(used, [*TABLE, "l", "s"]).select("id").distinct().withColumn("in_eval", F.lit(True))
    near = close_between(rows.select("id", F.col("question").alias("text")), eval_questions, CONTAMINATED).select(F.col("a").alias("id")).distinct().withColumn("near", F.lit(True))
    t, q = F.try_element_at("targets", F.lit(1)), F.col("question")
    asked = gram_tokens(q)
    twins = F.filter("candidates", lambda c: ~F.array_contains("answer_cells", c["id"]) & (labels(c) == labels(F.col("targets")[0])))
    named = F.size("targets") > 0
    joined = own.join(in_eval, "id", "left").join(near, "id", "left")
    reasons = F.array_compact(
        F.array(
            F.when(~F.length(q).between(*QUESTION), "question_length"),
            F.when(q.rlike("[{}]"), "unfilled_placeholder"),
            F.when(~named, "target_missing"),
            F.when(F.exists("targets", lambda x: digit_ratio(x["row_label"]) > LABEL_DIGITS), "label_mostly_digits"),
            F.when(F.exists("targets", lambda x: (x["value"] != "") & F.array_contains(asked, F.lower(x["value"]))), "value_leaked"),
            F.when(named & t.isNotNull() & (F.size(twins) > 0), "ambiguous"),
            F.when(F.col("operation").isin(RANKED) & ~F.lower(q).rlike("column|for |under |among"), "superlative_without_column"),
            F.when(F.col("in_eval"), "contaminated_cell"),
            F.when(F.col("near"), "contaminated_question"),
        )
    )
    return joined.select("id", F.array_join(reasons, ",").alias("reasons"), (F.size(reasons) == 0).alias("passed"))


def training_records(rows: DataFrame) -> DataFrame:
    """Examples as (id, prompt, completion): the question, the numbered candidates, and the plan as JSON."""
    unit = lambda c: F.when(c["unit"] != "", F.concat(F.lit(" "), c["unit"])).otherwise("")
    section = lambda c: F.when(c["section"] != "", F.concat(F.lit(' | section: "'), c["section"], F.lit('"'))).otherwise("")
    line = lambda c: F.concat(F.lit("  ["), c["id"].cast("string"), F.lit("] "), c["value"], unit(c), F.lit('  (row: "'), c["row_label"], F.lit('" | column: "'), c["header"], F.lit('"'), section(c), F.lit(")"))
    lines = F.array_join(F.transform(F.array_sort("candidates"), line), "\n")
    prompt = F.concat(F.lit("Question: "), "question", F.lit("\n\nCandidate cells:\n"), lines, F.lit("\n\nReply with a JSON plan: the operation and the numbers of its cells."))
    plan = F.to_json(F.struct("operation", F.col("answer_cells").alias("cells")))
    return rows.select("id", prompt.alias("prompt"), plan.alias("completion"))
