import json

import pytest
from pyspark.sql import functions as F

from sedgewren.operators import keyword, library, robots, search, snippets, topics, vectors
from sedgewren.sources import exports, records

FIELDS = "doc_id long, url string, title string, description string, domain string, site_name string, topics array<string>, excerpt string, body string, saved_at long"
ROWS = [
    (1, "https://a.example/1", "Harbour gardens", "Planting by the quay", "a.example", "A", ["green-space"], "Gardens need water and gardeners.", "Gardens need water and gardeners.", 30),
    (2, "https://b.example/2", "Night trains", None, "b.example", "B", ["rail"], "A harbour line and its gardens.", "A harbour line and its gardens. Harbour again.", 20),
    (3, "https://c.example/3", "", "", None, None, None, None, None, 10),
    (4, "https://d.example/4", "Ferries", "Boats across", "d.example", "D", ["harbour-life", "rail"], "Boats.", "Boats.", 40),
    (5, "https://e.example/5", "Harbour gardens", "Planting by the quay", "a.example", "A", ["green-space"], "Gardens need water and gardeners.", "Gardens need water and gardeners.", 5),
]


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    rows = spark.createDataFrame(ROWS, FIELDS).withColumn("search_text", search.full_text(*map(F.col, ("title", "description", "site_name", "domain", "body", "topics"))))
    folder = str(tmp_path_factory.mktemp("index"))
    assert not search.complete(spark, folder)
    search.write_search_index(rows, folder, buckets=3)
    assert search.complete(spark, folder)
    return search.open_search_index(spark, folder)


def test_stored_postings_equal_those_made_at_once(spark, index):
    sizes = keyword.lengths(index.entries, "doc_id", F.col("search_text"))
    whole = keyword.postings(index.entries, "doc_id", search.fields()).join(sizes, "doc_id").select("doc_id", "term", "tf", "len")
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, index.postings.select("doc_id", "term", "tf", "len").collect()))
    words = search.query_terms(spark, "Harbour gardens, gardens")
    assert words == ["harbour", "garden"]
    plain = keyword.bm25(whole.drop("len"), sizes, keyword.query_keys(spark, words))
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, search.keyword_scores(index, words).collect()))


def test_candidates_with_fewer_texts_read_are_the_same(spark, index):
    words = search.query_terms(spark, "harbour gardens")
    full = search.boosted(index, search.keyword_scores(index, words), "harbour gardens").orderBy(F.desc("score"), "doc_id")
    for most in (1, 2, 3, 60):
        found = search.keyword_candidates(index, "harbour gardens", words, most=most)
        assert [tuple(r) for r in found.collect()] == [tuple(r) for r in full.limit(most).collect()]
    assert {r["doc_id"] for r in search.keyword_candidates(index, "harbour gardens", words, "rail").collect()} == {2, 4}


def test_search(index):
    found = search.search(index, " harbour gardens ").collect()
    assert [r["doc_id"] for r in found][:2] == [1, 5] and {r["total"] for r in found} == {len(found)} and found[0]["mode"] == "hybrid"
    assert found[0]["snippet"] == "Harbour gardens — Planting by the quay" and found[0]["matched_in"] == "title"
    by_id = {r["doc_id"]: r for r in found}
    assert by_id[2]["matched_in"] == "page" and by_id[4]["matched_in"] == "topic" and 3 not in by_id
    assert by_id[4]["snippet"] == "Boats across"
    # a topic's word has weight 2 beside its own in the text: 3 in the short entry 4, against 2 in entry 2
    assert [r["doc_id"] for r in search.search(index, "harbour", "rail", 1, ("rail",)).collect()] == [4]
    assert search.search(index, "harbour", "unknown", 30, ("rail",)).count() == search.search(index, "harbour").count()
    assert search.search(index, "zzyzx the").count() == 0


def test_blank_queries_give_the_newest(index):
    found = search.search(index, "  ", None, 2).collect()
    assert [(r["doc_id"], r["total"], r["score"], r["mode"]) for r in found] == [(4, 5, 0.0, "recent"), (1, 5, 0.0, "recent")]
    assert [r["doc_id"] for r in search.newest(index.entries, "rail").collect()] == [4, 2]
    assert search.entry(index.entries, 3).count() == 1 and search.entry(index.entries, 99).count() == 0
    assert search.suggestions(index, "h").count() == 0 and search.suggestions(index, "harbour").count() > 0
    assert search.search_page(index, "harbour " * 100).count() > 0


def test_endpoint(index):
    assert [search.clamp(x) for x in (None, "x", 0, "nan", "3", -4, 51, 7.9)] == [8, 8, 8, 8, 3, 1, 50, 7]
    rows = search.search_endpoint(index, "harbour", None, "2").toJSON().collect()
    assert len(rows) == 2 and json.loads(rows[0])["score"] == round(json.loads(rows[0])["score"], 4)


def test_empty_index(spark, tmp_path):
    none = spark.createDataFrame([], FIELDS + ", search_text string")
    search.write_search_index(none, str(tmp_path))
    index = search.open_search_index(spark, str(tmp_path))
    assert search.search(index, "harbour").count() == 0 and search.search(index, "").count() == 0


def test_highlight_runs_join_to_the_text(spark):
    texts = ["Gardens, gardening: a GARDEN!", "nothing", "", None, "﷐ 1 ﷐1garden﷐2 x", "garden"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, t string").select("id", "t", snippets.highlight_runs(F.col("t"), ["garden"]).alias("r"), snippets.highlight_runs(F.col("t"), []).alias("n"))
    found = {r["id"]: r for r in rows.collect()}
    assert all("".join(x["text"] for x in r["r"]) == (r["t"] or "") == "".join(x["text"] for x in r["n"]) for r in found.values())
    assert [(x["text"], x["match"]) for x in found[0]["r"]] == [("Gardens", True), (", ", False), ("gardening", True), (": a ", False), ("GARDEN", True), ("!", False)]
    assert [x["match"] for x in found[1]["r"]] == [False] and found[2]["r"] == found[3]["r"] == [] and [x["match"] for x in found[5]["r"]] == [True]


def test_snippets(spark):
    words = [f"w{i:02}" for i in range(100)]
    words[70] = "gardens"
    texts = [" ".join(words), "  short  text ", "", None]
    found = {r["doc_id"]: r["snippet"] for r in snippets.snippets(spark.createDataFrame(list(enumerate(texts)), "id int, t string"), "id", "t", ["garden"]).collect()}
    begin = next(s for s in range(0, 61, 3) if s <= 70 < s + 40)
    assert found[0] == "…" + " ".join(words[begin : begin + 40]) + "…" and found[1] == "short text" and found[2] == found[3] == ""


def test_resolved_links(spark):
    answers = [("a", "b", 301, None), ("b", None, 404, None), ("c", "d", 302, None), ("d", "c", 302, None), ("e", None, 200, None), ("f", None, 410, None), ("g", None, None, "refused"), ("h", "gone", 301, None)]
    answers += [(f"r{n}", f"r{n + 1}", 302, None) for n in range(6)]
    starts = spark.createDataFrame([(x,) for x in ("a", "c", "e", "f", "g", "h", "r0", "unknown", "a")], "short string")
    found = {r["short"]: (r["url"], r["status"], r["error"]) for r in library.resolve_links(starts, "short", spark.createDataFrame(answers, "url string, location string, http_status int, error string")).collect()}
    assert found == {
        "a": ("b", "resolved", None), "c": (None, "loop", "Redirect loop"), "e": (None, "error", "Shortener did not redirect"), "f": (None, "dead", "HTTP 410"),
        "g": (None, "error", "refused"), "h": (None, "error", "No answer"), "r0": ("r4", "resolved", None), "unknown": (None, "error", "No answer"),
    }


def test_schedule_over_several_parts_of_a_host(spark):
    ids = [3, 1, robots.PART_IDS + 5, 5 * robots.PART_IDS, 2, None]
    rows = spark.createDataFrame([("a", i) for i in ids] + [(None, 9), (None, 4)], "host string, id long")
    found = {(r["host"], r["id"]): r["start_ms"] for r in robots.schedule(rows, "host", "id", 10).collect()}
    order = [None, *sorted(i for i in ids if i is not None)]
    assert found == {("a", i): 10 * k for k, i in enumerate(order)} | {(None, 4): 0, (None, 9): 10}


def test_related_over_many_blocks_equals_one(spark, monkeypatch):
    rows = spark.range(60).select("id", F.transform(F.sequence(F.lit(0), F.lit(5)), lambda i: (F.xxhash64(F.col("id") % 50, i) % 100).cast("double")).alias("v"))
    key = lambda df: sorted((r["id"], r["rank"], r["neighbour"], round(r["score"], 9)) for r in df.collect())
    one = key(vectors.related(rows, "id", "v", blocks=1))
    assert one and one == key(vectors.related(rows, "id", "v", blocks=7))
    monkeypatch.setattr(vectors, "BLOCK_ROWS", 16)
    assert one == key(vectors.related(rows, "id", "v"))


def test_report(spark):
    made = [{"id": "1", "text": "see https://t.co/x"}, {"id": "2", "text": " "}, {"id": "3", "text": "at https://www.example.com/a?utm_source=x and https://example.com/a", "author_handle": "Ann", "created_at": "2024-01-02T03:04:05Z"}, {"id": "4", "text": "note", "author_handle": "ann"}]
    rows = spark.createDataFrame([(k, json.dumps(m)) for k, m in enumerate(made)], "pos int, raw string").select("pos", F.try_parse_json("raw").alias("r"))
    report = records.quality_report(records.normalise(rows, "r", "pos"), skipped=2)
    facts = report.first().asDict()
    assert facts == {"records": 4, "authors": 2, "undated": 3, "unknown_authors": 2, "empty_text": 1, "short_only": 1, "no_links": 2, "links": 1, "domains": 1, "short_links": 1, "rejected": 2}
    warned = {r["kind"]: r["message"] for r in records.report_warnings(report).collect()}
    assert set(warned) == set(records.WARNINGS) and warned["undated"] == "3 records (75%) have no usable date"
    assert records.meets(report, 4) and not records.meets(report, 5)
    empty = records.quality_report(records.normalise(rows.where("false"), "r", "pos"))
    assert empty.first()["records"] == 0 and records.report_warnings(empty).count() == 0


def test_small_parts(spark, tmp_path):
    one = spark.createDataFrame([("rail", "https://a.example/x/y.pdf?z"), ("odd", "https://a.example")], "slug string, url string")
    found = one.select(topics.topic_label(F.col("slug"), {"rail": "Trains"}).alias("label"), robots.unread_title(F.col("url")).alias("title")).collect()
    assert [tuple(r) for r in found] == [("Trains", "y.pdf"), ("odd", None)]
    folder = tmp_path / "parts"
    assert exports.assemble(spark, str(folder), if_complete=True).ok
    folder.mkdir()
    (folder / "manifest.json").write_text(json.dumps({"parts": [{"file": "a.json", "n": 1, "bytes": 12, "lines": 1}, {"file": "b.json", "n": 1, "bytes": 12, "lines": 1}]}))
    (folder / "a.json").write_text('[{"id":"1"}]')
    assert exports.assemble(spark, str(folder), if_complete=True).ok and not exports.assemble(spark, str(folder)).ok
    (folder / "a.json").write_text("[]")
    assert not exports.assemble(spark, str(folder), if_complete=True).ok
    with pytest.raises(ValueError, match="nope"):
        exports.require(exports.ExportRead(False, "missing", "nope"))
    with pytest.warns(UserWarning, match="3 entries"):
        assert exports.require(exports.ExportRead(True, records=one, skipped=3)) is one
