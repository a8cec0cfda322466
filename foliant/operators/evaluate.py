"""Grading of answers and metrics over runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions.text import matches_needle
from foliant.operators.order import running

TOLERANCE = 0.005


def missing(text: str, needles: str) -> Column:
    return F.filter(needles, lambda n: ~matches_needle(F.col(text), n))


def partial_credit(text: str, needles: str) -> Column:
    n = F.size(needles)
    return F.when(n <= 0, F.lit(0.0)).otherwise((n - F.size(missing(text, needles))) / n)


def grade(answers: DataFrame) -> DataFrame:
    """Grades answers (id, answer, got, want, needles): numbers within 0.5 % of the wanted one, else all needles there."""
    near = F.coalesce(F.abs(F.col("got") - F.col("want")) / F.greatest(F.abs("want"), F.lit(1e-9)) <= TOLERANCE, F.lit(False))
    text = (F.size("needles") > 0) & (F.size(missing("answer", "needles")) == 0)
    return answers.select("id", F.when(F.col("want").isNotNull(), near).otherwise(F.coalesce(text, F.lit(False))).alias("correct"), F.round(partial_credit("answer", "needles"), 6).alias("partial"))


def citation_ok(wanted: Column, cited: Column) -> Column:
    """At least one wanted document is cited; nothing cited is never right."""
    return F.coalesce(F.arrays_overlap(wanted, cited), F.lit(False)) & (F.size(cited) > 0)


def accuracy_by_type(rows: DataFrame) -> DataFrame:
    """n, correct and accuracy per type, and over all types as OVERALL; citations too where rows have `citation_ok`."""
    cited = [F.count_if("citation_ok").alias("n_cited")] if "citation_ok" in rows.columns else []
    out = rows.rollup("type").agg(F.grouping("type").alias("g"), F.count("*").alias("n"), F.count_if("correct").alias("n_correct"), *cited)
    kind = F.when(F.col("g") == 1, "OVERALL").otherwise(F.col("type"))
    rate = ["n_cited", F.round(F.try_divide("n_cited", "n"), 3).alias("citation_rate")] if cited else []
    return out.select(kind.alias("type"), "n", "n_correct", F.round(F.try_divide("n_correct", "n"), 3).alias("accuracy"), *rate)


def run_summary(rows: DataFrame) -> DataFrame:
    """One row of counts, rates, exact interpolated latency percentiles, mean and sum, most memory and swap."""
    measured = rows.agg(
        F.count("*").alias("n"),
        F.count_if("correct").alias("n_correct"),
        F.round(F.try_divide(F.count_if("citation_ok"), F.count("*")), 3).alias("citation_rate"),
        F.round(F.avg("latency_s"), 6).alias("mean_s"),
        F.round(F.sum("latency_s"), 4).alias("wall_s"),
        F.round(F.max("memory_gb"), 3).alias("memory_gb"),
        F.round(F.max("swap_mb"), 1).alias("swap_mb"),
    )
    cuts = percentiles(rows.withColumn("__all", F.lit(1)), "__all", "latency_s", {"p50": 0.5, "p95": 0.95})
    return measured.crossJoin(F.broadcast(cuts.drop("__all")))


def percentiles(rows: DataFrame, key: str, value: str, shares: dict[str, float]) -> DataFrame:
    """Exact percentiles of each key by linear interpolation between ranks, a column for each of `shares`; nulls count not.

    Equal values are counted first and counts added up in ranges, so that no task holds the values of a key.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("__c"))
    summed = running(counts, [key], [value], {"__c": "__upto"})
    total = counts.groupBy(key).agg(F.sum("__c").alias("__n"))
    placed = summed.join(total, summed[key].eqNullSafe(total[key])).select(summed[key], value, "__c", "__upto", "__n")

    def at(rank: Column) -> Column:
        return F.max(F.when((rank < F.col("__upto")) & (rank >= F.col("__upto") - F.col("__c")), F.col(value)))

    out = []
    for name, share in shares.items():
        place = (F.col("__n") - 1) * F.lit(share)
        low, high = at(F.floor(place)), at(F.ceil(place))
        out.append(F.round(low + (high - low) * F.max(place - F.floor(place)), 6).alias(name))
    return placed.groupBy(key).agg(*out)


def percentiles_by(rows: DataFrame, key: str, value: str) -> DataFrame:
    plain = rows.groupBy(key).agg(F.count("*").alias("n"), F.round(F.avg(value), 6).alias("mean"), F.round(F.max(value), 6).alias("max"))
    cuts = percentiles(rows, key, value, {"p50": 0.5, "p95": 0.95})
    return plain.join(cuts, plain[key].eqNullSafe(cuts[key]), "left").select(plain[key], "n", "p50", "p95", "mean", "max")


def resume(questions: DataFrame, done: DataFrame, key: str = "id") -> DataFrame:
    """Questions that have no row yet."""
    return questions.join(done.select(key).distinct(), key, "left_anti")


def resumed(done: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """All rows of a resumed run: those that were there, and new ones of other questions."""
    return done.unionByName(resume(new, done, key), allowMissingColumns=True)


def keep_last(rows: DataFrame, key: str, *order: str) -> DataFrame:
    ranked = rows.withColumn("__rank", F.row_number().over(Window.partitionBy(key).orderBy(*[F.desc(o) for o in order])))
    return ranked.where("__rank = 1").drop("__rank")


def arm_breakdown(rows: DataFrame) -> DataFrame:
    """Correct, n and mean partial credit per arm: in all, by operation, and by cross-document or control."""
    sets = [["arm"], ["arm", "operation"], ["arm", "xdoc"]]
    by = rows.groupingSets(sets, "arm", "operation", "xdoc").agg(
        F.grouping("operation").alias("g_operation"),
        F.grouping("xdoc").alias("g_xdoc"),
        F.count("*").alias("n"),
        F.count_if("correct").alias("n_correct"),
        F.round(F.avg("partial"), 6).alias("mean_partial"),
    )
    kind = F.when(F.col("g_xdoc") == 1, "*").when(F.col("xdoc"), "cross").otherwise("control")
    return by.select("arm", F.when(F.col("g_operation") == 1, "*").otherwise(F.col("operation")).alias("operation"), kind.alias("kind"), "n", "n_correct", "mean_partial")


def arm_verdict(rows: DataFrame, tuned: str = "tuned", prompted: str = "prompted") -> DataFrame:
    """One row: accuracy of the two arms, and which is better."""
    share = lambda a: F.try_divide(F.count_if((F.col("arm") == a) & F.col("correct")), F.count_if(F.col("arm") == a))
    both = rows.agg(share(tuned).alias("t"), share(prompted).alias("p"))
    verdict = F.when(F.col("p") > F.col("t"), "prompted beats tuned").when(F.col("p") == F.col("t"), "prompted matches tuned").when(F.col("p") < F.col("t"), "tuned beats prompted")
    return both.select(F.round("t", 6).alias("tuned_accuracy"), F.round("p", 6).alias("prompted_accuracy"), verdict.alias("verdict"))


def composition(questions: DataFrame) -> DataFrame:
    """Questions (operation, docs array) per operation and in all as OVERALL: cross-document ones, controls, documents used."""
    each = questions.select("operation", F.array_distinct("docs").alias("docs")).withColumn("cross", F.size("docs") > 1)
    counted = each.rollup("operation").agg(F.grouping("operation").alias("g"), F.count("*").alias("n"), F.count_if("cross").alias("n_cross"))
    used = each.select("operation", F.explode("docs").alias("doc")).rollup("operation").agg(F.grouping("operation").alias("g"), F.countDistinct("doc").alias("n_docs"))
    name = lambda t: t.withColumn("operation", F.when(F.col("g") == 1, "OVERALL").otherwise(F.col("operation"))).drop("g")
    joined = name(counted).join(name(used), "operation", "left")
    return joined.select("operation", "n", "n_cross", (F.col("n") - F.col("n_cross")).alias("n_control"), F.coalesce("n_docs", F.lit(0)).alias("n_docs"))


def reason_histogram(checked: DataFrame, codes: str = "reasons", first: bool = True) -> DataFrame:
    """How often examples were rejected for each reason (comma-separated `codes`), their first one or all of them."""
    listed = F.filter(F.split(codes, ","), lambda c: c != "")
    return checked.select(F.explode(F.slice(listed, 1, 1) if first else listed).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


def regression_delta(rows: DataFrame, before: str, after: str) -> DataFrame:
    """Accuracy of both arms per split and OVERALL, and the difference."""
    counts = [f(F.when(F.col("arm") == a, c)) for a in (before, after) for f, c in ((F.count_if, F.col("correct")), (F.count, F.lit(1)))]
    by = rows.rollup("split").agg(F.grouping("split").alias("g"), *[c.alias(n) for c, n in zip(counts, ("bc", "bn", "ac", "an"), strict=True)])
    first, second = F.try_divide("bc", "bn"), F.try_divide("ac", "an")
    return by.select(
        F.when(F.col("g") == 1, "OVERALL").otherwise(F.col("split")).alias("split"),
        F.col("bc").alias("before_correct"),
        F.col("ac").alias("after_correct"),
        F.round(first, 6).alias("before_accuracy"),
        F.round(second, 6).alias("after_accuracy"),
        F.round(second - first, 6).alias("delta"),
    )


def confusion(rows: DataFrame) -> DataFrame:
    """Counts with a planted error as positive and contradicted as predicted positive, and the rates they give."""
    positive, said = F.col("planted"), F.col("predicted") == "contradicted"
    counts = rows.agg(
        F.count_if(positive & said).alias("tp"),
        F.count_if(~positive & said).alias("fp"),
        F.count_if(positive & ~said).alias("fn"),
        F.count_if(~positive & ~said).alias("tn"),
        F.count_if(F.col("expected") == F.col("predicted")).alias("n_exact"),
        F.count("*").alias("n"),
    )
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    precision, recall = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return counts.select(
        "tp", "fp", "fn", "tn",
        F.round(precision, 6).alias("precision"),
        F.round(recall, 6).alias("recall"),
        F.round(ratio(2 * precision * recall, precision + recall), 6).alias("f1"),
        F.round(ratio(F.col("n_exact"), F.col("n")), 6).alias("exact"),
    )


VERDICTS = ["supported", "contradicted", "unverifiable"]


def confusion_matrix(rows: DataFrame) -> DataFrame:
    return rows.groupBy("expected").pivot("predicted", VERDICTS).count().na.fill(0, VERDICTS)


def evidence_checks(cited: DataFrame) -> DataFrame:
    """Structure of multi-document questions from (id, page, needle, found), a row per cited page and needle.

    both_needed: no single page has all needles; grounded: the pages together have all; leaked: a needle is on two.
    """
    per_page = cited.groupBy("id", "page").agg(F.bool_and("found").alias("all_here"))
    per_needle = cited.groupBy("id", "needle").agg(F.bool_or("found").alias("somewhere"), F.count_if("found").alias("pages"))
    a = per_page.groupBy("id").agg((~F.bool_or("all_here")).alias("both_needed"))
    b = per_needle.groupBy("id").agg(F.bool_and("somewhere").alias("grounded"), F.bool_or(F.col("pages") > 1).alias("leaked"))
    return a.join(b, "id")


def running_accuracy(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Share of correct rows so far, per key by `order`, whose values name a row."""
    each = rows.select(key, order, F.col("correct").cast("long").alias("__ok"), F.lit(1).cast("long").alias("__one"))
    summed = running(each, [key], [order], {"__ok": "__oks", "__one": "__ones"})
    return summed.select(key, order, F.round(F.col("__oks") / F.col("__ones"), 6).alias("running"))


def evidence_structure(questions: DataFrame, pages: DataFrame) -> DataFrame:
    """Structure of questions (id, cites: array of doc_id and page, needles) against the pages they cite (doc_id, page, text).

    grounded: each needle is on some cited page; a page that is missing has none. Questions on two documents or more
    (cross) are checked for two more: both_needed, that no page has all needles, and leaks, the needles that pages of
    two citations hold. Questions without needles or citations are grounded by nothing.
    """
    cited = questions.select("id", F.explode_outer(F.array_distinct("cites")).alias("c")).select("id", "c.doc_id", "c.page")
    read = cited.join(pages.select("doc_id", "page", "text"), ["doc_id", "page"], "left")
    asked = read.join(questions.select("id", F.explode_outer(F.array_distinct("needles")).alias("needle")), "id")
    found = asked.withColumn("found", F.coalesce(matches_needle(F.col("text"), F.col("needle")), F.lit(False)))
    per_page = found.groupBy("id", "doc_id", "page").agg(F.bool_and("found").alias("all_here"))
    per_needle = found.groupBy("id", "needle").agg(F.count_if("found").alias("n"))
    a = per_page.groupBy("id").agg(F.countDistinct("doc_id").alias("n_docs"), F.bool_or("all_here").alias("one_page"))
    missing_ = F.array_sort(F.collect_set(F.when(F.col("n") == 0, F.col("needle"))))
    b = per_needle.groupBy("id").agg(F.bool_and(F.col("n") > 0).alias("grounded"), missing_.alias("missing"), F.array_sort(F.collect_set(F.when(F.col("n") > 1, F.col("needle")))).alias("leaks"))
    cross = F.col("n_docs") >= 2
    return a.join(b, "id").select(
        "id", cross.alias("cross"), F.coalesce("grounded", F.lit(False)).alias("grounded"), "missing", F.when(cross, ~F.col("one_page")).alias("both_needed"),
        F.when(cross, F.col("leaks")).otherwise(F.array().cast("array<string>")).alias("leaks"),
    )
