import pytest
from pyspark.sql import functions as F

from sedgewren.operators import choices


@pytest.mark.parametrize(
    ("preferred", "configured", "able", "expected"),
    [(None, None, False, "local"), (None, None, True, "remote"), ("local", "remote", True, "local"), (None, "remote", False, "remote"), (None, "odd", True, "remote"), ("odd", "remote", False, "local")],
)
def test_resolve(preferred, configured, able, expected):
    assert choices.resolve(preferred, configured, ("local", "remote"), able) == expected


def test_vector_leg():
    assert choices.vector_leg(512, 512) == choices.VectorLeg(True)
    assert "512d" in choices.vector_leg(512, 256).notice and not choices.vector_leg(512, 256).usable
    assert "boom" in choices.vector_leg(512, 512, "boom").notice


def test_arbitrate_and_labels(spark):
    rows = spark.createDataFrame([(1, ["x", "b", "a", "c", "d"], ["p"]), (2, ["x"], ["p"]), (3, None, ["p"])], "id int, llm array<string>, picked array<string>")
    slugs = F.array(*map(F.lit, "abcd"))
    found = rows.select("id", choices.arbitrate(F.col("llm"), F.col("picked"), slugs).alias("t")).orderBy("id").collect()
    assert [r["t"] for r in found] == [["b", "a", "c"], ["p"], ["p"]]
    shown = spark.createDataFrame([("ok", "Site", "a.com"), ("odd", "A.com", "a.com"), (None, None, "a.com")], "s string, n string, d string")
    got = shown.select(choices.status_label(F.col("s")).alias("s"), choices.detail_label(F.col("n"), F.col("d")).alias("d")).collect()
    assert [tuple(r) for r in got] == [("archived", "Site · a.com"), ("odd", "a.com"), (None, "a.com")]


def test_classifier_is_asked_in_batches(spark):
    def fake(batch):
        assert len(batch) <= 12
        return {i: [f"n{len(t)}"] for i, t in batch if i != "3"}

    rows = spark.range(30).select(F.col("id").cast("int").alias("k"), F.when(F.col("id") != 5, F.lit("ab")).alias("text"))
    found = {r["k"]: r["topics"] for r in choices.classify(rows, "k", "text", fake).collect()}
    assert len(found) == 30 and found[3] is None and found[5] == ["n0"] and found[0] == ["n2"]
