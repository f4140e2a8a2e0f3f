import pytest
from pyspark.sql import functions as F

from sedgewren.functions import text as T
from sedgewren.functions import urls as U


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def test_tokenize_keeps_compounds_and_parts(spark):
    assert value(spark, T.tokenize(F.lit("Tide-driven mills and salt pans"))) == ["tide-driven", "tide", "driven", "mills", "salt", "pans"]


@pytest.mark.parametrize(
    ("word", "stem"),
    [("embeddings", "embedd"), ("embedding", "embedd"), ("kubernetes", "kubernet"), ("caches", "cach"), ("policies", "policy"), ("classes", "class"), ("string", "string"), ("indeed", "inde"), ("series", "sery")],
)
def test_stem(spark, word, stem):
    assert value(spark, T.stem(F.lit(word))) == stem


@pytest.mark.parametrize(
    ("raw", "canonical"),
    [
        ("HTTPS://www.Harbour.example/Log/2024/?page=3&utm_medium=mail#top", "https://harbour.example/Log/2024?page=3"),
        ("harbour.example/quay", "https://harbour.example/quay"),
        ("mailto:crew@harbour.example", None),
        ("  ", None),
        ("http://quay.example:80/", "http://quay.example/"),
    ],
)
def test_canonical_url(spark, raw, canonical):
    assert value(spark, U.canonical_url(F.lit(raw))) == canonical
    if canonical:
        assert value(spark, U.canonical_url(F.lit(canonical))) == canonical


def test_titles_and_keys(spark):
    assert value(spark, U.title_from_url(F.lit("https://harbour.example/guides/mooring_at-night.html"))) == "Mooring At Night"
    assert value(spark, U.title_from_url(F.lit("https://harbour.example/90817"))) == "harbour.example"
    assert value(spark, U.url_key(F.lit("https://example.com/x"))) == "4701cd48f5015b44"
    assert value(spark, T.fnv1a(F.lit("w:rust"))) == 3738731506


def test_truncate_backs_up_to_a_space(spark):
    assert value(spark, T.truncate(F.lit("aaa bbb ccc ddd"), 9)) == "aaa bbb…"
    assert value(spark, T.truncate(F.lit("short"), 9)) == "short"


def test_token_edges(spark):
    texts = {"--aa-- .bb. cc-dd- - .. ee.-ff": ["aa", "bb", "cc-dd", "cc", "dd", "ee.-ff", "ee.", "ff"], "": [], "the -the- x the-end": ["the-end", "end"], "a" + "-" * 20000 + "b gg": ["gg"], ".-gg-.hh.": ["gg-.hh", "gg", ".hh"]}
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.tokenize(F.col("t")).alias("k")).collect()
    assert {r["t"]: r["k"] for r in rows} == texts
