import pyarrow.parquet as pq
from pyspark.sql import functions as F

from sedgewren.functions import text as T
from sedgewren.operators import analysis, html, keyword, search, snippets, topics, vectors

TEXTS = [
    "Planting, planted: WELL-known 're-entry' -lead- trail.. e.g. c++ c# .net", "See https://a.example/x?y and HTTP://B.example/é z here", "", None, "  ", "İnoran Kelvin straße cafés naïve",
    "classes parties series glasses boxes ring singing sing seemingly markedly red exceeded used bus buss ies a-b--c -- - a", "x" * 31 + " " + "y" * 32 + " 'quoted' tab\there\x0bthere\x1fand wide\u0085next", "httpss://not http:/no https://",
]
DOCS = "id long, t string"


def rows(spark, texts=TEXTS):
    return spark.createDataFrame(list(enumerate(texts)), DOCS)


def test_batched_analysis_equals_the_expressions(spark):
    docs, t = rows(spark), F.col("t")
    plain = docs.select("id", T.tokenize(t).alias("k"), T.terms(t).alias("s")).collect()
    assert sorted(map(tuple, analysis.tokens(docs, "id", t).collect())) == sorted((r["id"], i + 1, x) for r in plain for i, x in enumerate(r["k"] or ()))
    assert {r["id"]: r["terms"] for r in analysis.joined_terms(docs, "id", t).collect()} == {r["id"]: None if r["s"] is None else " ".join(r["s"]) for r in plain}
    assert sorted(map(tuple, analysis.bigrams(docs, "id", t).collect())) == sorted((r["id"], i + 1, a, b) for r in plain for i, (a, b) in enumerate(zip(r["s"] or (), (r["s"] or ())[1:])))
    assert sorted(map(tuple, analysis.term_counts(docs, "id", t).collect())) == sorted((r["id"], x, r["s"].count(x)) for r in plain for x in set(r["s"] or ()))
    counted = analysis.hit_counts(docs, ("id",), [t, F.lit("rings")], ["ring", "sing", "well-known"]).collect()
    assert {r["id"]: (r["hits0"], r["hits1"]) for r in counted} == {r["id"]: (sum(x in ("ring", "sing", "well-known") for x in r["s"] or ()), 1) for r in plain}


def test_forgotten_words_are_found_again(monkeypatch):
    texts = [t.encode() for t in TEXTS if t]
    whole = [analysis.Words().of(t) for t in texts]
    monkeypatch.setattr(analysis, "MOST_WORDS", 3)
    words = analysis.Words()
    assert [words.of(t) for t in texts] == whole and len(words) + len(words.older) <= 6


def test_analysis_and_index_need_no_shuffle(spark, tmp_path):
    docs, t = rows(spark), F.col("t")
    found = [keyword.postings(docs, "id", {"search_text": t}), vectors.local_embed(docs, "id", t), analysis.term_counts(docs, "id", t)]
    assert not any("Exchange" in df._jdf.queryExecution().executedPlan().toString() for df in found)
    entries = docs.select(F.col("id").alias("doc_id"), *[F.lit(None).cast("string").alias(c) for c in ("url", "title", "description", "domain", "site_name", "excerpt")], F.array().cast("array<string>").alias("topics"), t.alias("search_text"), F.col("id").alias("saved_at"))
    search.write_search_index(entries.repartition(3), str(tmp_path))
    files = sorted((tmp_path / "postings").glob("*.parquet"))
    assert files and all((k := pq.read_table(f).column("bucket").to_pylist()) == sorted(k) for f in files)
    index = search.open_search_index(spark, str(tmp_path))
    sizes = keyword.lengths(docs, "id", t)
    assert index.facts.first()["n"] == len(TEXTS) and index.facts.first()["avg_len"] == sizes.agg(F.avg("len")).first()[0]
    assert index.postings.where("term is null").count() == 0


def test_rows_that_share_an_id_are_summed_up(spark):
    docs = spark.createDataFrame([(1, "ring rings"), (1, "rings red-hot"), (None, "ring"), (None, "ring")], DOCS)
    assert {(r["doc_id"], r["term"]): r["tf"] for r in keyword.postings(docs, "id", {"search_text": F.col("t")}).collect()} == {(1, "ring"): 300, (1, "red-hot"): 100, (1, "red"): 100, (1, "hot"): 100, (1, "~red-ho"): 35, (None, "ring"): 200}
    for key in (1, None):
        own = vectors.local_embed(docs, "id", F.col("t")).where(F.col("doc_id").eqNullSafe(F.lit(key).cast("long"))).collect()
        assert abs(sum(r["weight"] ** 2 for r in own) - 1) < 1e-9 and len({r["bucket"] for r in own}) == len(own)
    taxonomy = spark.createDataFrame([("a", 0, "ring", 1), ("b", 1, "redhot", 1), ("c", 2, "red-hot", 1)], "slug string, ord int, keyword string, weight int")
    scores = {(r["doc_id"], r["slug"]): r["score"] for r in topics.topic_scores(docs, "id", F.col("t"), taxonomy).collect()}
    assert scores == {(1, "a"): 1.0, (1, "c"): 0.477, (None, "a"): 1.0}


def test_features_by_their_definition(spark):
    text = "singing sing a-b parties"
    terms = analysis.Words().of(text.encode())
    items = [("w:" + t, 20) for t in terms] + [(f"b:{a}_{b}", 12) for a, b in zip(terms, terms[1:])] + [("c:" + t[i : i + 4], 5) for t in terms if len(t) >= 5 for i in range(len(t) - 3)]
    hashed = {r["f"]: r["h"] for r in spark.createDataFrame(items, "f string, x long").select("f", T.fnv1a(F.col("f")).alias("h")).collect()}
    sums: dict[int, int] = {}
    for f, x in items:
        sums[hashed[f] % 512] = sums.get(hashed[f] % 512, 0) + (-x if hashed[f] >= 1 << 31 else x)
    found = vectors.feature_sums([[], terms, []], 512)
    assert {k: x for k, x in enumerate(found[1].tolist()) if x} == {k: x for k, x in sums.items() if x} and not found[0].any() and not found[2].any()
    assert vectors.feature_sums([[]], 512).sum() == 0


def test_highlights_look_at_whole_words(spark):
    text = "+ring a+ring RINGS '#ring- string ringé Kings kings"
    docs = rows(spark, [text])
    assert docs.select(snippets.highlight_words(F.col("t"), ["ring", "king"])).first()[0] == ["ring", "RINGS", "Kings", "kings"]
    runs = docs.select(snippets.highlight_runs(F.col("t"), ["ring", "king"])).first()[0]
    assert "".join(r["text"] for r in runs) == text and [r["text"] for r in runs if r["match"]] == ["ring", "RINGS", "Kings", "kings"]


def test_truncation_of_a_beginning_equals_that_of_the_whole(spark):
    texts = ["word " * 40, " " * 100 + "late words come after a long blank", "a" * 100, "ab " + " " * 60 + "cd", "short", None, " ".join("xy" * 30)]
    found = [r[0] for r in rows(spark, texts).orderBy("id").select(T.truncate(F.col("t"), 20)).collect()]
    assert found == ["word word word word…", "late words come…", "a" * 20 + "…", "ab cd", "short", None, " ".join("xy" * 5)[:19] + "…"]


def test_pages_reach_workers_in_small_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(1 << 30))
    pages = spark.range(3).select(F.col("id").alias("page_id"), F.lit("<p>A paragraph that is long enough</p>").alias("html"))
    assert {r["text"] for r in html.extract_articles(pages, "page_id", "html").collect()} == {"A paragraph that is long enough"}
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) <= 2 << 20 and int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 2000
