import itertools

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from foliant.functions import text as ft
from foliant.operators import chunking, compute, layout, traindata
from foliant.plans.providers import HashEmbedder, first_json


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'double'}" for k, v in values.items()))
    return row.select(column.alias("x")).first()["x"]


def test_long_numbers_do_not_meet_by_rounding(spark):
    a, b = one(spark, ft.normalise_number(F.col("t")), t="224647411220468213"), one(spark, ft.normalise_number(F.col("t")), t="224647411220468214")
    assert a != b


def test_normalise_number_is_idempotent(spark):
    tokens = ["1,250", "$45.00", "(45.0)", "(-7)", "007", "0.50", "-0", "12%", ".5"]
    rows = spark.createDataFrame([(t,) for t in tokens], "t string").withColumn("a", ft.normalise_number(F.col("t")))
    assert rows.where(F.col("a") != ft.normalise_number(F.col("a"))).count() == 0


def test_numbers_agree_is_symmetric(spark):
    values = [0.0, 0.5, 0.505, 0.51, 1.0, 1.004, 1.006, 100.0, 100.4, -1.0]
    rows = spark.createDataFrame(list(itertools.product(values, values)), "a double, b double")
    assert rows.where(ft.numbers_agree(F.col("a"), F.col("b")) != ft.numbers_agree(F.col("b"), F.col("a"))).count() == 0


def test_null_numbers_agree_with_nothing(spark):
    assert spark.sql("select cast(null as double) a, 1D b").select(ft.numbers_agree(F.col("a"), F.col("b"))).first()[0] is False


def test_windows_rejoin_to_the_text(spark):
    texts = ["x" * n for n in (1, 799, 800, 801, 1500, 1501, 3000)] + ["".join(map(str, range(900)))]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chunking.windows(F.col("t")).alias("w")).collect()
    for r in rows:
        assert r["w"][0] + "".join(w[100:] for w in r["w"][1:]) == r["t"]
        assert max(map(len, r["w"])) <= 800


def test_html_text(spark):
    html = "<p>A &amp; B<script>x<y</script><!-- no --> <b>C&lt;D</b>"
    assert one(spark, chunking.html_text(F.col("h")), h=html) == "A & B C<D"


@settings(max_examples=30, deadline=None)
@given(st.text())
def test_first_json_returns_an_object_or_nothing(text):
    import json

    found = first_json(text)
    assert found is None or isinstance(json.loads(found), dict)


def test_first_json_tiers():
    assert first_json('```json\n{"a": 1}\n```') == '{"a": 1}'
    assert first_json('so {"a": "}"} it is') == '{"a": "}"}'
    assert first_json("{broken") is None and first_json(None) is None


def test_embedder_is_unit_length():
    import numpy as np

    assert np.allclose(np.linalg.norm(HashEmbedder(8)(["a b", "c"]), axis=1), 1, atol=1e-5)


def test_rows_cluster_by_anchor(spark):
    words = spark.createDataFrame([("d", 1, t, 0.0, str(i)) for i, t in enumerate([10.0, 12.0, 13.0, 14.0, 20.0])], "doc_id string, page int, top double, x0 double, text string")
    lines = {r["text"]: r["line"] for r in layout.cluster_rows(words).collect()}
    assert lines == {"0": 0, "1": 0, "2": 0, "3": 1, "4": 2}


def test_column_of(spark):
    rows = spark.createDataFrame([(5.0, [1.0, 5.0, 9.0]), (0.5, [1.0, 5.0]), (99.0, [1.0])], "c double, b array<double>")
    assert [r[0] for r in rows.select(layout.column_of("c", "b")).collect()] == [2, 0, 1]


def test_compute_does_not_depend_on_partitions(spark):
    cells = spark.sql("select 'd' doc_id, 1 page, 't' table_id, cast(id as int) row, 1 col, cast(id as string) value, 'USD' unit from range(50)")
    plans = spark.sql("select 'p' plan_id, 'sum' operation, cast(id as int) pos, 'd' doc_id, 't' table_id, cast(id as int) row, 1 col from range(50)")
    a = compute.execute(plans.repartition(7), cells.repartition(5)).collect()
    assert a == compute.execute(plans, cells).collect() and a[0]["value"] == 1225


def test_contamination_threshold(spark):
    train = spark.createDataFrame([(1, "what was the total value of all exports in the year"), (2, "nothing alike at all in this one here")], "id int, text string")
    evaluation = spark.createDataFrame([(9, "what was the total value of all exports in that year")], "id int, text string")
    rows = {r["a"]: r for r in traindata.contamination(train, evaluation).collect()}
    assert set(rows) == {1} and not rows[1]["contaminated"] and rows[1]["jaccard"] == round(5 / 9, 6)
    assert traindata.contamination(train, train).where("contaminated").count() == 2
