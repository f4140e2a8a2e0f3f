import math

from pyspark.sql import functions as F

from sedgewren.operators import html, keyword, library, robots, topics, vectors
from sedgewren.plans import catalog

PAGE = """<html><head><title>Site title</title><meta property="og:title" content=" Real  title "><meta name="description" content="About it">
<script>var x = "</p>";</script></head><body><nav><p>Navigation that is certainly long enough</p></nav>
<article><h1>A heading that is long enough</h1><p>First paragraph, long enough to count &amp; be kept.<p>Second paragraph, long enough to count too.</article><footer>Feet</footer>"""


def test_extract_handles_open_paragraphs_and_furniture():
    found = html.extract(PAGE)
    assert found["title"] == "Real title" and found["description"] == "About it"
    assert found["text"].split("\n\n") == ["A heading that is long enough", "First paragraph, long enough to count & be kept.", "Second paragraph, long enough to count too."]
    assert html.extract(None)["text"] == "" and html.extract("<title>T</title>")["title"] == "T"
    assert len(html.extract("<body><p>" + "word " * 500)["text"]) > 200 and len(html.extract("<body><p>" + "word " * 500, 200)["text"]) <= 200


def test_robots_by_host(spark):
    quiet = "Sitemap: https://q/s.xml\n# none\nUser-Agent: crowbot\nUSER-AGENT: *\nDisallow: /vault # closed\r\nAllow: /vault/lobby\nDisallow: /*.zip$\nDisallow:\nCrawl-delay: 1.5\n\nUser-agent: gullbot\nDisallow: /\n"
    named = "User-agent: *\nDisallow: /\nUser-agent: wren\nDisallow: /nest(1)\nDisallow: /*?\nnonsense\nUser-agent: wrenbot\nCrawl-delay: 9\nAllow: /nest(1)/open\nDisallow: /a\\Eb"
    files = spark.createDataFrame([("quiet", 200, quiet), ("named", 204, named), ("down", 503, None), ("gone", 404, quiet), ("never", None, None), ("bare", 200, "")], "host string, status int, body string")
    rules = robots.robots_rules(files, "wrenbot").cache()
    held = {r["host"]: (sorted((x["pattern"], x["allow"]) for x in r["rules"]), r["delay_ms"]) for r in rules.collect()}
    assert held["quiet"] == ([("/*.zip$", False), ("/vault", False), ("/vault/lobby", True)], 1500)
    assert held["named"] == ([("/*?", False), ("/a\\Eb", False), ("/nest(1)", False), ("/nest(1)/open", True)], 9000)
    assert held["down"] == ([("/", False)], None) and held["gone"] == held["never"] == held["bare"] == ([], None)
    paths = {("quiet", "/vault/x"): False, ("quiet", "/vault/lobby/y"): True, ("quiet", "/b/c.zip"): False, ("quiet", "/b/c.zip.html"): True, ("named", "/nest(1)/a"): False, ("named", "/nest(1)/open"): True, ("named", "/nest1"): True, ("named", "/z?q=1"): False, ("named", "/a\\Eb"): False, ("down", "/"): False, ("gone", "/vault"): True}
    asked = spark.createDataFrame(list(paths), "host string, path string").join(rules, "host")
    assert {(r["host"], r["path"]): r["ok"] for r in asked.select("host", "path", robots.allowed(F.col("path"), F.col("rules")).alias("ok")).collect()} == paths
    gaps = rules.select("host", robots.polite_gap(750, F.col("delay_ms")).alias("gap"))
    assert {r["host"]: r["gap"] for r in gaps.collect()} == {"quiet": 1500, "named": 5000, "down": 750, "gone": 750, "never": 750, "bare": 750}


def test_bm25_against_plain_python(spark):
    docs = spark.createDataFrame([(1, "rust rust error"), (2, "python error error error"), (3, "nothing here")], "doc_id long, text string")
    index, sizes = keyword.postings(docs, "doc_id", {"search_text": F.col("text")}), keyword.lengths(docs, "doc_id", F.col("text"))
    found = {r["doc_id"]: r["score"] for r in keyword.bm25(index, sizes, keyword.query_keys(spark, ["rust"])).collect()}
    average = (3 + 4 + 1) / 3
    expected = math.log(1 + 2.5 / 1.5) * 2 * 2.4 / (2 + 1.4 * (0.25 + 0.75 * 3 / average))
    assert found == {1: found[1]} and abs(found[1] - expected) < 1e-12


def test_embedding_is_unit_and_empty_text_has_none(spark):
    docs = spark.createDataFrame([(1, "error budget error handling"), (2, "")], "doc_id long, text string")
    rows = vectors.local_embed(docs, "doc_id", F.col("text")).collect()
    assert {r["doc_id"] for r in rows} == {1} and abs(sum(r["weight"] ** 2 for r in rows) - 1) < 1e-9


def test_topics(spark):
    taxonomy = spark.createDataFrame([("a", 0, "rust", 3), ("b", 1, "machine-learn", 2)], "slug string, ord int, keyword string, weight int")
    docs = spark.createDataFrame([(1, "rust rust"), (2, "machinelearn"), (3, "none")], "doc_id long, text string")
    scores = topics.topic_scores(docs, "doc_id", F.col("text"), taxonomy)
    assert {(r["doc_id"], r["slug"], r["score"]) for r in scores.collect()} == {(1, "a", 1.0), (2, "b", 1.0)}
    picks = topics.pick_topics(docs.select("doc_id"), scores).collect()
    assert {(r["doc_id"], r["slug"]) for r in picks} == {(1, "a"), (2, "b"), (3, "misc")}


def test_chase_and_queue(spark):
    starts = spark.createDataFrame([(1,), (2,), (9,)], "id long")
    links = spark.createDataFrame([(1, 2), (2, 3)], "src long, dst long")
    assert {tuple(r) for r in library.chase(starts, "id", links, 4).collect()} == {(1, 3, 2), (2, 3, 1), (9, 9, 0)}
    wanted, known = spark.createDataFrame([(1,), (2,), (3,)], "id long"), spark.createDataFrame([(1, "ok"), (2, "timeout")], "id long, status string")
    assert {r["id"] for r in library.crawl_queue(wanted, known, "id", F.col("status") == "timeout").collect()} == {2, 3}


def test_catalog_is_consistent():
    assert set(catalog.oracle_sql()) <= set(catalog.queries()) and len(catalog.queries()) > 50
