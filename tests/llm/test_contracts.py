"""The registered queries: columns, folds, thresholds and whole tables."""

import zlib
from pathlib import Path

import pytest

from sedgewren.llm import registry

SMALL = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SMALL).exists(), reason="the given tables are not there")

COLUMNS = {
    "op1_quality_cnn": {"doc_id", "held_out", "score", "predicted"},
    "op2_pii": {"doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"},
    "op3_fingerprints": {"doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"},
    "op4_ngram_join": {"doc_id", "n_shingles", "component_id"},
    "op5_language_id": {"doc_id", "held_out", "lang_pred", "score"},
    "op6_warc": {"page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"},
    "op7_toxicity": {"doc_id", "held_out", "score", "predicted"},
    "op8_packing": {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"},
    "op9_bpe": {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"},
    "op10_quality_rules": {"doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"},
}
FOLDS = {"op1_quality_cnn": (5, 0, 0.3), "op5_language_id": (4, 2, None), "op7_toxicity": (3, 1, 0.7)}


@pytest.mark.parametrize("name", COLUMNS)
def test_contract(spark, name):
    found = registry.queries()[name](spark, SMALL)
    assert COLUMNS[name] <= set(found.columns)
    rows = found.collect()
    key, whole = ("page_id", "pages") if name == "op6_warc" else ("doc_id", "documents")
    ids = [r[key] for r in spark.read.parquet(f"{SMALL}/{whole}.parquet").select(key).collect()]
    assert sorted({r[key] for r in rows}) == sorted(ids)
    if name != "op8_packing":
        assert len(rows) == len(ids)
    if name in FOLDS:
        n, rest, threshold = FOLDS[name]
        for r in rows:
            assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % n == rest) and 0 <= r["score"] <= 1
            assert threshold is None or r["predicted"] == int(r["score"] >= threshold)


def test_packing_contract(spark):
    rows = registry.queries()["op8_packing"](spark, SMALL).collect()
    places: dict[int, list] = {}
    pieces: dict[int, list] = {}
    for r in rows:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        pieces.setdefault(r["doc_id"], []).append((r["start"], r["length"], r["doc_tokens"]))
    for found in places.values():
        found.sort()
        assert [o for o, _ in found] == [sum(n for _, n in found[:k]) for k in range(len(found))] and sum(n for _, n in found) <= 1024
    for found in pieces.values():
        found.sort()
        assert [s for s, _, _ in found] == [sum(n for _, n, _ in found[:k]) for k in range(len(found))] and sum(n for _, n, _ in found) == found[0][2]
