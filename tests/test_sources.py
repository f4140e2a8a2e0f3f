import json

import pytest
from pyspark.sql import functions as F

from sedgewren.sources import exports, records
from sedgewren.streaming import incremental

NESTED = {
    "rest_id": "5520817",
    "core": {"name": "Mira Holt", "screen_name": "@mholt"},
    "legacy": {"full_text": "tide tables for sailors https://t.co/q9z", "created_at": "Sat Feb 29 06:30:05 +0000 2020"},
    "entities": {"urls": [{"url": "https://t.co/q9z", "expanded_url": "https://harbour.example/tides?utm_source=mail"}]},
}
FLAT = {"id": 42, "text": " flat ", "author_username": "bo", "author_name": "Bo", "post_url": "https://x.com/bo/status/42", "created_at": "2026-03-04T05:06:07Z", "external_urls": ["https://example.com/a", None, 3]}
ODD = {"id": "7", "text": None, "author": "who", "created_at": "no date", "external_urls": "x", "media": [{"media_url_https": "https://m.example/1"}, {"type": "video"}], "tags": ["t", " ", 5], "metrics": {"likes": 1}}


def rows_of(spark, found):
    rows = spark.createDataFrame(list(enumerate(json.dumps(x) for x in found)), "pos int, raw string")
    return rows.select("pos", F.try_parse_json("raw").alias("record"))


def test_records_of_several_forms(spark):
    got = {r["id"]: r for r in records.normalise(rows_of(spark, [NESTED, FLAT, ODD, {"text": "no id"}, None, 5, FLAT | {"text": "later"}]), "record", "pos").collect()}
    assert set(got) == {"5520817", "42", "7"}
    a = got["5520817"]
    assert (a["author_handle"], a["author_name"], a["url"]) == ("mholt", "Mira Holt", "https://x.com/mholt/status/5520817")
    assert a["external_urls"] == ["https://harbour.example/tides"] and a["short_urls"] == ["https://t.co/q9z"]
    assert a["created_at"].isoformat() == "2020-02-29T06:30:05"
    b = got["42"]
    assert b["text"] == "flat" and b["external_urls"] == ["https://example.com/a"] and b["created_at"].isoformat() == "2026-03-04T05:06:07"
    c = got["7"]
    assert (c["text"], c["author_handle"], c["author_name"], c["created_at"].year) == ("", "unknown", "unknown", 1970)
    assert c["external_urls"] == [] and c["topics"] == ["t", "5"] and [tuple(m) for m in c["media"]] == [("photo", "https://m.example/1")]
    assert json.loads(c["metrics"]) == {"likes": 1}


@pytest.mark.parametrize("text", ["undefined", "tbd", "  ", "{}", "too short", '{"items": [{"id": "cut off in the middle of a rec'])
def test_broken_exports(spark, tmp_path, text):
    path = tmp_path / "e.json"
    path.write_text(text)
    found = exports.read_export(spark, str(path))
    assert not found.ok and found.reason == "invalid_json"


def test_export_outcomes(spark, tmp_path):
    path = tmp_path / "e.json"

    def read(x):
        path.write_text(json.dumps(x))
        return exports.read_export(spark, str(path), holders=("$.saved", *exports.CONTAINERS), counts=("$.saved_count", *exports.COUNTS))

    assert exports.read_export(spark, str(tmp_path / "none.json")).reason == "missing"
    for shape in ([FLAT], {"saved": [FLAT]}, {"data": [FLAT]}, {"items": [FLAT], "count": 1}):
        assert read(shape).records.count() == 1
    assert exports.read_export(spark, str(path), holders=("$.other",)).reason == "no_records"
    assert read("a string that is certainly long enough").reason == "wrong_shape"
    empty = read({"data": [{"title": "a"}, {"title": "b"}, {"size": 3}, {"colour": "red"}]})
    assert empty.reason == "no_records" and "4 entries" in empty.message
    assert read({"saved_count": 31, "saved": [FLAT]}).reason == "truncated"
    good = read({"total": 3, "items": [FLAT, NESTED, {"shape": "round"}, None, FLAT]})
    assert good.ok and good.skipped == 2 and good.declared == 3
    assert [r["id"] for r in records.newest_first(good.records).collect()] == ["42", "5520817"]


def write_parts(folder, parts, **manifest):
    folder.mkdir(exist_ok=True)
    entries = []
    for name, found in parts.items():
        text = json.dumps(found, indent=1) + "\n"
        (folder / name).write_text(text)
        entries.append({"file": name, "n": len(found), "bytes": len(text.encode()), "lines": text.count("\n")})
    (folder / "manifest.json").write_text(json.dumps({"parts": entries} | manifest))


def test_parts(spark, tmp_path):
    folder = tmp_path / "parts"
    assert "No manifest" in exports.assemble(spark, str(folder)).message
    parts = {"a.json": [{"id": "1", "k": "é"}, {"id": "2"}, {"x": 1}], "b.json": [{"post_id": "3"}, {"id": "1", "k": "later"}, {"x": 1}]}
    write_parts(folder, parts, count=5, last_id="3")
    found = exports.assemble(spark, str(folder))
    assert found.ok and found.count == 5 and found.duplicates == 1
    assert json.loads(found.records.where("id = '1'").first()["record"])["k"] == "é"
    exports.write_assembled(found, str(tmp_path / "out"), "s", "o")
    assert spark.read.text(str(tmp_path / "out/records")).count() == 5
    assert exports.assemble(spark, str(folder), minimum=6).ok is False
    write_parts(folder, parts, count=5, last_id="99")
    assert "99" in exports.assemble(spark, str(folder)).message
    write_parts(folder, parts, count=5)
    (folder / "b.json").write_text((folder / "b.json").read_text()[:-1])
    assert exports.assemble(spark, str(folder)).ok
    (folder / "b.json").write_text("[]")
    assert "b.json" in exports.assemble(spark, str(folder)).broken
    (folder / "b.json").unlink()
    assert exports.assemble(spark, str(folder)).missing == ["b.json"]


def test_crawl_folder(spark, tmp_path):
    good = {"key": "k", "url": "https://example.com/a", "status": "ok", "fetched_at": "t", "duration_ms": 5}
    for name, x in {"1.json": good | {"title": "old"}, "2.json": good | {"title": "new"}, "3.json": {"url": 1}, "index.json": {}, "4.json": good | {"status": "odd"}}.items():
        (tmp_path / name).write_text(json.dumps(x))
    (tmp_path / "5.json").write_text("{")
    kept, invalid = exports.read_crawl(spark, str(tmp_path))
    assert [(r["key"], r["title"]) for r in kept.collect()] == [("k", "new")]
    assert {r["file"] for r in invalid.collect()} == {"3.json", "4.json", "5.json"}
    assert exports.read_crawl(spark, str(tmp_path / "none"))[0].count() == 0


def test_index_files_and_guard(spark, tmp_path):
    links, vectors, meta = exports.empty_index(spark, "hashed")
    vectors = vectors.unionAll(spark.createDataFrame([("a", [0.123456, -0.000005])], "id string, vector array<double>"))
    exports.write_index(links, vectors, meta, str(tmp_path))
    assert spark.read.parquet(str(tmp_path / "vectors")).first()["vector"] == [0.12346, 0.0]
    assert exports.read_links(spark, str(tmp_path / "short")).count() == 0
    ok, missing, broken = exports.ExportRead(True), exports.ExportRead(False, "missing"), exports.ExportRead(False, "truncated")
    assert [exports.build_action(True, e) for e in (ok, missing, broken)] == ["use", "use", "use_stale"]
    assert [exports.build_action(False, e) for e in (ok, missing, broken)] == ["rebuild", "stub", "fail"]


def test_streams_equal_batches(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1), ("a", 70), ("b", 2), ("a", 5)], "k string, s int").select("k", F.timestamp_seconds("s").alias("ts"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = incremental.stream_rows(spark, str(tmp_path / "in"), "k string, ts timestamp")
    for name, df, mode in (("runs", incremental.running_saves(stream, "k", "ts"), "complete"), ("wins", incremental.windowed_counts(stream, "ts", "k", "1 minute", "1 minute"), "complete"), ("firsts", incremental.first_seen(stream, "k", "ts", "1 hour"), "append")):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        assert q.awaitTermination(60)
    assert {(r["k"], r["saves"]) for r in spark.table("runs").collect()} == {("a", 3), ("b", 1)}
    assert {(r["k"], r["start"].minute, r["n"]) for r in spark.table("wins").collect()} == {("a", 0, 2), ("a", 1, 1), ("b", 0, 1)}
    assert {r["k"] for r in spark.table("firsts").collect()} == {"a", "b"}
