import hashlib
import io
import json
import random
import re
import time
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sedgewren.llm import bpe, byte_cnn, fingerprints, jaccard_join, language_id, packing, pii, quality_rules, toxicity, warc
from sedgewren.llm.components import connected_components
from sedgewren.llm.shingles import Shingler
from sedgewren.session import Scratch

WORD_BPE = "/opt/tokenizers/word_bpe_49k.json"
BYTE_BPE = "/opt/tokenizers/byte_bpe_50k.json"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, token long"
ODD = [None, "", "   ", "a", "word " * 3000, "x" * 30000, "Ünï 漢字 😀", "same text here", "same text here"]


def odd_docs(spark, rows=ODD):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 0.5, 1) for i, t in enumerate(rows)], SCHEMA)


# --- quality rules


def test_quality_rules_by_hand(spark):
    good = "\n".join(f"Plain{i} prose{i} of{i} line{i} ends{i} well{i} enough{i}." for i in range(12))
    nav = "\n".join("Home | About | Contact | News | More" for _ in range(3)) + "\n" + good
    bad = "\n".join(f"Home{i} | About{i} | Contact{i} | News{i} | More{i} | Most{i} | Last{i}" for i in range(12))
    rows = {r["doc_id"]: r for r in quality_rules.apply_rules(odd_docs(spark, [good, nav, bad, None, "a b c a b c"])).collect()}
    assert rows[0]["kept"] and rows[0]["clean_text"] == good and rows[0]["n_lines_lost"] == 0
    assert rows[1]["kept"] and rows[1]["clean_text"] == good and rows[1]["n_dup_lines"] == 2
    assert not rows[2]["kept"] and not rows[2]["base_failed"]
    assert rows[3]["base_failed"] and rows[3]["n_words"] == 0 and rows[3]["clean_text"] == ""
    assert rows[4]["n_repeat_words"] == 6
    assert {r["doc_id"] for r in quality_rules.keep_clean(odd_docs(spark, [good, nav, bad, None]), keep=("lang",)).collect()} == {0, 1}


def test_quality_rules_odd_and_empty(spark):
    found = quality_rules.apply_rules(odd_docs(spark)).collect()
    assert len(found) == len(ODD) and quality_rules.apply_rules(odd_docs(spark).limit(0)).count() == 0


# --- language


def test_language_id(spark):
    rows = [("the house and the garden of the king " * 5, "en"), ("der hund und die katze sind im haus " * 5, "de")] * 6 + [(None, None), ("123 !", "en")]
    docs = spark.createDataFrame([(i, t, lang, "s", 0) for i, (t, lang) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long")
    found = {r["doc_id"]: r for r in language_id.identify(docs, language_id.learn_contract(docs)).collect()}
    assert all(found[i]["lang_pred"] == rows[i][1] for i in range(12))
    assert found[12]["lang_pred"] == found[13]["lang_pred"] == "und" and found[12]["score"] == 0
    empty = language_id.learn_contract(docs.limit(0))
    assert language_id.identify(docs, empty).where("lang_pred <> 'und'").count() == 0
    kept = language_id.keep_identified(docs, language_id.learn_contract(docs), 0.0).count()
    assert kept == 12 and language_id.identify(docs.limit(0), empty).count() == 0
    shouted = spark.createDataFrame([(0, "the house and the garden of the king", "en", "s", 0), (1, "zzq zzq zzq zzq zzq zzq", "en", "s", 0)], docs.schema)
    assert [x["doc_id"] for x in language_id.keep_identified(shouted, language_id.learn_contract(docs)).collect()] == [0]


def test_out_of_place_by_hand():
    profiles = language_id.Profiles.of({"x": [97, 98], "y": [98]}, length=10)
    own = language_id.ranked(*language_id.grams("a"), 10).tolist()
    far = sum(abs(r - [97, 98].index(c)) if c in (97, 98) else 10 for r, c in enumerate(own))
    assert profiles.predict("a") == ("x", pytest.approx(1 - far / (10 * len(own))))


# --- classifiers


def test_byte_cnn_learns_and_covers_whole_texts(spark):
    r = random.Random(1)
    plain = lambda: " ".join(r.choice(["ab", "cde", "fghi"]) for _ in range(r.randint(20, 600)))
    noise = lambda: plain() + " ###$$$%%%" + r.choice(["", " " + plain()])
    rows = [(plain(), 1) for _ in range(150)] + [(noise(), 0) for _ in range(150)]
    net = byte_cnn.fit(rows)
    tests = [(plain(), 1) for _ in range(30)] + [(plain() + " " + noise(), 0) for _ in range(30)]
    assert np.mean((net.scores([t for t, _ in tests]) >= 0.5) == [y for _, y in tests]) > 0.9
    found = byte_cnn.score(odd_docs(spark), net).collect()
    assert len(found) == len(ODD) and all(0 <= x["score"] <= 1 for x in found)
    assert byte_cnn.fit([]).scores(["x"])[0] == 0.5


def test_byte_cnn_pieces_equal_one_pass(monkeypatch):
    net, tokens = byte_cnn.Net.fresh(1), byte_cnn.tokens_of("some text " * 300)
    whole = net.pooled(tokens)
    monkeypatch.setattr(byte_cnn, "PIECE", 64)
    assert np.allclose(net.pooled(tokens), whole, atol=1e-5)


def test_toxicity(spark):
    r = random.Random(2)
    plain = lambda: " ".join(r.choice(["sun", "tree", "river", "stone", "walk"]) for _ in range(40))
    rows = [(plain(), 0) for _ in range(90)] + [(plain() + " you are a zorgle " + plain(), 1) for _ in range(30)]
    r.shuffle(rows)
    model = toxicity.fit(rows)
    assert model.scores([plain(), plain() + " zorgle you", plain() + " 1d10t you m0ron"], {}).round(1).tolist()[:2] == [0.0, 1.0]
    found = toxicity.score(odd_docs(spark), model).collect()
    assert len(found) == len(ODD) and all(0 <= x["score"] <= 1 for x in found)
    assert toxicity.fit([]).scores(["x"], {})[0] == 0


def test_calibration_keeps_the_share_of_all_labelled_rows(spark, tmp_path, monkeypatch):
    r = random.Random(4)
    word = lambda: r.choice(["sun", "tree", "river", "stone", "walk"])
    ys = [int(i % 10 == 0) for i in range(1500)]
    texts = [" ".join(word() for _ in range(20)) for _ in ys]  # no text tells its label: scores are the share
    odd_docs(spark, texts).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(list(enumerate(ys)), "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    monkeypatch.setattr(toxicity, "PER_CLASS", 60)
    found = toxicity.op7_toxicity(spark, str(tmp_path)).collect()
    assert len(found) == len(ys) and np.mean([x["score"] for x in found]) < 0.2
    assert sum(x["predicted"] for x in found) < len(ys) / 20


def test_isotonic_rises():
    xs, ys = toxicity.isotonic(np.array([1.0, 2, 3, 4]), np.array([0.0, 1, 0, 1]), np.ones(4))
    assert (np.diff(ys) >= 0).all() and (np.diff(xs) >= 0).all()


# --- personal data


def brute_spans(text):
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 16 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0:
            out.append(("card", m.start(), m.end()))
    return out + [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


def test_base_spans_match_the_patterns():
    r = random.Random(3)
    parts = ["a.b@c.de", "x@y", "@@", "1.2.3.4", "1.2.3.4.5.6.7.8", "999.1.1.1", "4111 1111 1111 1111", "4111111111111111", "+1 (555) 123-4567", "+", "12", " ", "-", ".", "word", "@z.com", "é"]
    for _ in range(3000):
        text = "".join(r.choice(parts) for _ in range(r.randint(1, 12)))
        assert pii.base_spans(text) == brute_spans(text), text


def test_crf_adds_written_out_data_and_keeps_base(spark):
    model = pii.fit(pii.variants())
    base, spans = pii.find("mail john.doe [at] example [dot] com or a@b.org, call (555) 123-4567", model)
    assert [k for k, _, _ in spans] == ["email", "email", "phone"] and set(base) <= set(spans)
    assert pii.mask("a@b.org!", [("email", 0, 7)]) == "[EMAIL]!"
    assert pii.find("on 2024-01-15 we saw 3 of 12", model)[1] == []
    found = {r["doc_id"]: r for r in pii.detect(odd_docs(spark), model).collect()}
    assert len(found) == len(ODD) and found[0]["base_sha256"] == hashlib.sha256(b"").hexdigest()


def test_crf_viterbi_is_the_best_of_all_segmentations():
    model, zone = pii.fit(pii.variants(n=10)), "tel 555-123-4567 a@b.org"
    ends, segments = pii.lattice(zone)
    best = 0.0

    def search(j, score):
        nonlocal best
        best = max(best, score)
        for e in range(j, len(ends)):
            for i, _, on in segments.get(e, ()):
                if i >= j:
                    search(e + 1, score + float(model.weights[on].sum()))

    search(0, 0.0)
    got = 0.0
    for kind, a, b in model.decode(zone):
        got += float(model.weights[pii.span_features(kind, zone, a, b)].sum())
    assert got == pytest.approx(best)


def test_whole_entities_are_candidates_and_found():
    def candidates(zone):
        ends, segments = pii.lattice(zone)
        return {(kind, ends[i - 1] if i else 0, ends[j]) for j, found in segments.items() for i, kind, _ in found}

    for zone, gold in pii.variants():
        assert set(gold) <= candidates(zone), zone
    model = pii.fit(pii.variants())
    for kind, s in [
        ("ip", "2001:0db8:85a3:0000:0000:8a2e:0370:7334"), ("ip", "1a2b:3c4d:5e6f:7a8b:9c0d:1e2f:3a4b:5c6d"),
        ("email", "jane.doe [at] mail.example [dot] com"), ("email", "jane.doe [at] example [dot] co [dot] uk"),
    ]:
        text = f"write to {s} now"
        assert (kind, 9, 9 + len(s)) in candidates(text), s
        assert pii.find(text, model)[1] == [(kind, 9, 9 + len(s))], s
    assert (max(b - a for _, a, b in candidates("call " + "1 " * 400)) <= 37) and "dead:beef:cafe:babe" in {"call dead:beef:cafe:babe 1"[a:b] for _, a, b in candidates("call dead:beef:cafe:babe 1")}


def test_spans_cost_by_their_number():
    model, took = pii.fit(pii.variants(n=10)), {}
    for n in (5_000, 50_000):
        text = " ".join(f"user{i}@mail{i}.example.com" for i in range(n))
        began = time.time()
        base, spans = pii.find(text, model)
        took[n] = time.time() - began
        assert len(base) == n and set(base) <= set(spans)
    assert took[50_000] < 25 * took[5_000]


def test_added_spans_overlap_no_base_span():
    model, r = pii.fit(pii.variants()), random.Random(21)
    parts = [z for z, _ in pii.variants(seed=5, n=8)]
    for _ in range(40):
        base, spans = pii.find(" ".join(r.choice(parts) for _ in range(12)), model)
        added = [s for s in spans if s not in base]
        assert all(b <= x or y <= a for k, (_, a, b) in enumerate(added) for _, x, y in base + added[:k])


def test_written_triggers_make_zones_in_any_case():
    for text in ("Jane [AT] Example [DOT] com", "jane [ at ] example.com", "jane (At ) example.com", "JANE AT EXAMPLE DOT COM"):
        assert pii._TRIGGER.search(text) and pii.zones(text) == [(0, len(text))], text


# --- fingerprints


def test_neighbours_by_brute_force(spark):
    r = random.Random(4)
    texts = [" ".join(r.choice("abcdefgh") * 3 for _ in range(r.randint(0, 80))) for _ in range(40)] + [None, "same", "same"]
    docs = spark.createDataFrame([(3 * i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, bucket int")
    found = {x["doc_id"]: x for x in fingerprints.compare_neighbours(docs).collect()}
    order, shingler = sorted(range(len(texts)), reverse=True), Shingler(5)
    assert len(found) == len(texts)
    for k, i in enumerate(order):
        own, after = texts[i] or "", texts[order[(k + 1) % len(order)]] or ""
        changed = own[: len(own) - len(own) // 3] + after[: len(own) // 3]
        row = found[3 * i]
        assert row["edited_sha256"] == hashlib.sha256(changed.encode()).hexdigest() and row["n_chars"] == len(own)
        assert row["fingerprint"] == fingerprints.encode(fingerprints.sketch(own, shingler))
        assert row["near_next"] == fingerprints.likeness(fingerprints.sketch(own, shingler), fingerprints.sketch(after, shingler))


def test_sketches_merge_and_estimate_containment():
    r = random.Random(5)
    words = [str(r.randrange(10**6)) for _ in range(8000)]
    shingler = Shingler(5)
    whole, part = (fingerprints.sketch(" ".join(w), shingler) for w in (words, words[:800]))
    assert fingerprints.containment(part, whole) > 0.99 and abs(fingerprints.likeness(part, whole) - 0.1) < 0.03
    halves = [fingerprints.sketch(" ".join(w), shingler)[2] for w in (words[:4004], words[4000:])]
    assert np.array_equal(fingerprints.merge(*halves), whole[2])
    assert fingerprints.decode(fingerprints.encode(part))[:2] == part[:2]


# --- Jaccard join


def brute_components(texts, n, percent):
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append(set(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else {tuple(w)} if w else set())
    label = list(range(len(texts)))
    for i, x in enumerate(sets):
        for j in range(i):
            if x and sets[j] and 100 * len(x & sets[j]) >= percent * len(x | sets[j]):
                a, b = sorted((label[i], label[j]))
                label = [a if c == b else c for c in label]
    return [(len(s), c) for s, c in zip(sets, label, strict=True)]


def edited_groups(seed, groups, copies):
    """Texts of groups of near copies with shared tails, and odd ones."""
    r = random.Random(seed)
    texts = [None, "", " ", "one", "ONE", "two words"]
    for _ in range(groups):
        base = [r.choice("abcdefghijklmnop") * r.randint(1, 3) for _ in range(r.randint(10, 90))]
        for _ in range(copies):
            copy = list(base)
            for _ in range(r.randint(0, 5)):
                copy[r.randrange(len(copy))] = str(r.randrange(50))
            texts.append(" ".join(copy) + (" common tail of many words in all texts" if r.random() < 0.4 else ""))
    return texts


#: Sizes at which every way through the join is taken: pairs of buckets, cells, one or several centres, dealt and cut buckets.
WAYS = [
    jaccard_join.Limits(), jaccard_join.Limits(bucket=2), jaccard_join.Limits(bucket=2, cell=4), jaccard_join.Limits(bucket=3, cell=4, depth=1),
    jaccard_join.Limits(bucket=2, cell=8, split=5), jaccard_join.Limits(bucket=2, rows=16, cell=4), jaccard_join.Limits(bucket=4, cell=4, tokens=300, depth=0),
]


@pytest.mark.parametrize(("way", "n", "percent"), [(0, 3, 90), (0, 5, 80), (0, 3, 50), (1, 5, 80), (2, 3, 90), (2, 3, 10), (3, 3, 50), (4, 5, 80), (5, 3, 90), (6, 5, 80)])
def test_components_by_brute_force(spark, way, n, percent):
    texts = edited_groups(6, 6, 24)
    found = jaccard_join.similarity_components(odd_docs(spark, texts).repartition(3), n, percent, limits=WAYS[way])
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in found.collect()}
    assert [got[i] for i in range(len(texts))] == brute_components(texts, n, percent)


def test_centres_turn_links_into_differences():
    r, percent = random.Random(11), 80
    for _ in range(400):
        x, y, c = (np.unique(np.array([r.randrange(40) for _ in range(r.randint(1, 40))], np.uint64)) for _ in range(3))
        dx, dy = np.setxor1d(x, c), np.setxor1d(y, c)
        own = [(100 + percent) * len(d) - (100 - percent) * len(s) for d, s in ((dx, x), (dy, y))]
        assert jaccard_join.linked(x, y, percent) == (2 * (100 + percent) * len(np.intersect1d(dx, dy)) >= sum(own))


def test_rows_that_cannot_pair_leave_a_bucket():
    r = np.random.default_rng(12)
    for _ in range(300):
        n = int(r.integers(1, 12))
        own, slack, linked = r.integers(-5, 6, n), r.integers(-5, 6, n), r.random(n) < 0.4
        want = [any(i != j and slack[i] >= own[j] and slack[j] >= own[i] and not (linked[i] and linked[j]) for j in range(n)) for i in range(n)]
        got = jaccard_join.could_pair(own, slack, linked).tolist()
        assert all(g or not w for g, w in zip(got, want)) and got == want


def test_a_group_of_near_copies_gives_few_rows(spark):
    """Rows of pairs grow with the group, not with its square, though none of its pairs link through a bucket."""
    base = [f"w{i}" for i in range(100)]
    made = {}
    for m in (200, 800):
        r = random.Random(13)
        texts = [" ".join(base)] + [" ".join(f"x{i}-{k}" if k in cut else w for k, w in enumerate(base)) for i in range(m) for cut in [set(r.sample(range(100), 4))]]
        docs, limits = odd_docs(spark, texts).select("doc_id", "text"), jaccard_join.Limits(cell=16)
        with Scratch(spark) as keep:
            facts = keep(jaccard_join.summarise(docs, 3), "t")
            heavy = spark.sparkContext.broadcast(jaccard_join.heavy_tokens(facts))
            met = keep(jaccard_join.meet(jaccard_join.prefix_rows(docs, heavy, 3, 80, limits), 80, limits), "t")
            classes = facts.where("class is not null").select("class", "n", F.col("doc_id").alias("rep"), "hash")
            sets = keep(jaccard_join.set_table(docs, classes, 3), "t")
            found = jaccard_join.families(met.where("kind = 0"), classes, keep)
            assert found.count() <= m + 1
            near = keep(jaccard_join.meet(jaccard_join.difference_rows(found, sets, heavy, 80, limits), 80, limits), "t")
            made[m] = met.where("kind > 0").count() + near.count()
        apart = sum(not jaccard_join.linked(Shingler(3).hashes(texts[0]), Shingler(3).hashes(t), 80) for t in texts)
        assert jaccard_join.similarity_components(odd_docs(spark, texts), 3, 80, limits=limits).select("component_id").distinct().count() == apart + 1
    assert made[800] < 6 * made[200]


def worker(monkeypatch, frame, make):
    """What make(frame) runs in a worker: a function from record batches to record batches."""
    found = []
    monkeypatch.setattr(type(frame), "mapInArrow", lambda self, run, schema: found.append(run) or self)
    make(frame)
    monkeypatch.undo()
    return found[-1]


def test_workers_hand_on_bounded_batches(spark, monkeypatch):
    # op4_ngram_join, pipeline: a batch is held outside the heap too, so its size must not follow the input's
    texts = [" ".join(f"{k // 2}-{i}" for i in range(5000)) + f" {k}" for k in range(40)]
    run = worker(monkeypatch, spark.createDataFrame([], "doc_id long, text string"), lambda docs: jaccard_join.summarise(docs, 3))
    batch = pa.RecordBatch.from_arrays([pa.array(range(40)), pa.array(range(40)), pa.array(texts)], names=["doc_id", "hash", "text"])
    out = list(run(iter([batch])))
    assert sum(x.num_rows for x in out) == 40 + 20 * 4998 and {n for x in out for n in x.column(5).to_pylist()} == {None, 2}
    assert max(x.num_rows for x in out) <= 1 << 15

    keys, sets, n = 5000, 8, 10  # every two sets of a key may link
    key, own, left = np.repeat(np.arange(keys), sets) * 2, 2 * 90 * n, n
    meta = np.full(len(key), own << (jaccard_join.LEFT_BITS + 3) | left << 3)
    rows = pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.tile(np.arange(sets), keys) + key * sets), pa.array(meta), pa.nulls(len(key), pa.int64())], names=["key", "class", "meta", "root"])
    run = worker(monkeypatch, spark.createDataFrame([], jaccard_join.ROWS), lambda rows: jaccard_join.meet(rows, 90, jaccard_join.Limits()))
    out = list(run(iter([rows])))
    assert sum(x.num_rows for x in out) == keys * sets * (sets - 1) // 2
    assert max(x.num_rows for x in out) <= 1 << 15


def test_the_join_reads_files_in_turn(spark):
    spark.conf.unset("parquet.hadoop.vectored.io.enabled")
    jaccard_join.similarity_components(odd_docs(spark).limit(0))
    assert spark.conf.get("parquet.hadoop.vectored.io.enabled") == "false"


def test_counting_and_cells_need_little_room():
    # op4_ngram_join, pipeline: workers share an executor's memory with its heap
    rng = np.random.default_rng(7)
    sets = [np.unique(rng.integers(0, 1 << 63, 20_000).astype(np.uint64)) for _ in range(50)]
    sets[1] = np.unique(np.concatenate([sets[0][:-9], sets[1][:9]]))
    tracemalloc.start()
    try:
        edges = list(jaccard_join.cell_edges(list(range(50)), [0] * 50, sets, 90))
        cell_bytes = tracemalloc.get_traced_memory()[1]
        x = np.concatenate(sets)
        tracemalloc.reset_peak()
        tokens, counts = jaccard_join.repeated(x)
        count_bytes = tracemalloc.get_traced_memory()[1] - x.nbytes
    finally:
        tracemalloc.stop()
    want, n = np.unique(np.concatenate(sets), return_counts=True)
    assert edges == [(1, 0)] and cell_bytes < 3.5 * x.nbytes
    assert tokens.tolist() == want[n > 1].tolist() and counts.tolist() == n[n > 1].tolist() and count_bytes < x.nbytes


def test_rows_without_an_id_link_others_and_keep_one_goes_by_row(spark):
    words = [f"w{i}" for i in range(200)]
    changed = lambda *at: " ".join("x" if i in at else w for i, w in enumerate(words))
    rows = [(1, changed()), (None, changed(10)), (3, changed(10, 100)), (4, "other text"), (4, changed(1)), (4, changed(1)), (None, "lone"), (None, "lone"), (None, None), (7, ""), (7, "")]
    docs = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, component long")
    assert not jaccard_join.linked(*(Shingler(5).hashes(rows[i][1]) for i in (0, 2)), 94)
    found = sorted((x["doc_id"] or 0, x["n_shingles"], x["component_id"]) for x in jaccard_join.similarity_components(docs, 5, 94).collect() if x["n_shingles"] > 1)
    assert found == [(0, 196, 1), (1, 196, 1), (3, 196, 1), (4, 196, 1), (4, 196, 1)]
    kept = sorted(((x["doc_id"] or 0, x["text"] or "") for x in jaccard_join.keep_one(docs, 5, 94).collect()))
    assert kept == sorted([(1, changed()), (4, "other text"), (0, "lone"), (0, ""), (7, ""), (7, "")])


def test_connected_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 90), (7, 7)], "a long, b long")
    found = {r["node"]: r["label"] for r in connected_components(edges).collect()}
    assert found == {i: 1 for i in range(1, 41)} | {90: 90, 100: 90}


def test_connected_components_of_shuffled_chains(spark):
    ids = list(range(1, 401))
    random.Random(5).shuffle(ids)
    ends = [1, *range(3, 201), 2]  # the smallest ids at both ends
    edges = spark.createDataFrame(list(zip(ids, ids[1:])) + [(1000 + a, 1000 + b) for a, b in zip(ends, ends[1:])], "a long, b long")
    found = {r["node"]: r["label"] for r in connected_components(edges).collect()}
    assert found == {i: 1 for i in ids} | {1000 + i: 1001 for i in ends}


def test_empty_table_joins(spark):
    assert jaccard_join.similarity_components(odd_docs(spark).limit(0)).count() == 0


# --- WARC


def test_archive_round_trip(spark):
    pages = spark.createDataFrame([(i, f"http://h/{i}", t) for i, t in enumerate([None, "", "<p>é</p>", "<p>é</p>", "x" * 50000, "y"])], "page_id long, url string, html string")
    folder = warc.shared_path(spark, "test")
    found = {r["page_id"]: r for r in warc.read_archives(warc.materialize(warc.write_archives(pages, folder), "t")).collect()}
    assert found[0]["record_type"] == "revisit" and found[0]["refers_to"] == 1 and found[1]["record_type"] == "response"
    assert found[2]["refers_to"] == 3 and bytes(found[3]["payload"]).decode() == "<p>é</p>" and found[2]["payload"] is None
    assert found[4]["payload_bytes"] == 50000 and found[2]["payload_digest"] == warc.digest_of("<p>é</p>".encode())
    assert warc.read_archives(warc.materialize(warc.write_archives(pages.limit(0), folder), "t")).count() == 0


def test_archive_of_repeated_ids_keeps_each_payload(spark):
    rows = [(5, "A"), (5, "B"), (9, "A"), (8, "B"), (5, "C"), (None, "A")]
    pages = spark.createDataFrame([(i, "http://h", t) for i, t in rows], "page_id long, url string, html string")
    found = warc.read_archives(warc.materialize(warc.write_archives(pages, warc.shared_path(spark, "repeated")), "t")).collect()
    digest = {warc.digest_of(t.encode()): t for t in "ABC"}
    got = sorted(((x["page_id"] or 0, digest[x["payload_digest"]], x["refers_to"] or 0, x["payload"] and bytes(x["payload"]).decode()) for x in found), key=lambda x: x[:2])
    assert got == [(0, "A", 0, "A"), (5, "A", 9, None), (5, "B", 8, None), (5, "C", 0, "C"), (8, "B", 0, "B"), (9, "A", 0, "A")]


def test_archive_format():
    records = [warc.record(i, "http://h", b"payload %d " % i * 40, warc.digest_of(b""), None, "response") for i in range(900)]
    out = io.BytesIO()
    n, size = warc.write_archive(iter(records), out)
    raw = out.getvalue()
    assert n == 900 and size == len(raw) and raw[:4] == b"\x5d\x2a\x4d\x18"
    assert list(warc.read_archive(io.BytesIO(raw))) == records


# --- packing


def test_packer_places_every_id_once():
    r = random.Random(8)
    docs = {i: np.arange(n, dtype=np.uint32) for i, n in enumerate([1, 1024, 2048, 1025, *(r.randint(1, 3000) for _ in range(400))])}
    packer = packing.Packer()
    sequences = [s for i, ids in docs.items() for s in packer.add(i, ids)] + list(packer.finish())
    seen = {i: [] for i in docs}
    for tier, pieces in sequences:
        assert sum(map(len, pieces)) <= tier
        for p in pieces:
            seen[p.doc].append((p.start, len(p), p.ids))
    for i, ids in docs.items():
        parts = sorted(seen[i], key=lambda x: x[0])
        assert np.array_equal(np.concatenate([x[2] for x in parts]), ids) and [x[0] for x in parts] == np.cumsum([0, *(x[1] for x in parts)]).tolist()[:-1]
    assert sum(1 for t, p in sequences if sum(map(len, p)) not in (64, 128, 256, 512, 1024)) <= 1


def test_packer_packs_every_tier():
    r = random.Random(12)
    docs = [np.arange(r.choice([r.randint(513, 1024), r.randint(257, 512), r.randint(129, 256), r.randint(65, 128), *(r.randint(1, 64) for _ in range(30))]), dtype=np.uint32) for _ in range(20_000)]
    packer, closed = packing.Packer(), []
    for i, ids in enumerate(docs):
        closed += packer.add(i, ids)
        assert sum(map(len, packer.tiers)) <= packing.POOL
    found = {t: [p for tier, p in closed if tier == t] for t in packing.SIZES}
    assert all(len(x) > 20 for x in found.values()), {t: len(x) for t, x in found.items()}
    for t, windows in found.items():
        assert all(sum(map(len, pieces)) == t and t // 2 < len(pieces[0]) or t == 64 for pieces in windows)


def test_pack_matches_the_tokenizer(spark):
    tokenizers = pytest.importorskip("tokenizers")
    reference = tokenizers.Tokenizer.from_file(BYTE_BPE)
    texts = [*ODD, " " * 1_000_000 + "a", "x" * 300_000, "#" * 300_000, " \n\t\u3000" * 100_000 + "b  c", "a\x85b\xa0 c\u2028\u2028d \x1c e"]
    rows = packing.pack(odd_docs(spark, texts), BYTE_BPE).collect()
    assert packing.pack(odd_docs(spark).limit(0), BYTE_BPE).count() == 0
    for i, t in enumerate(texts):
        ids = np.array([*reference.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        mine = sorted((r for r in rows if r["doc_id"] == i), key=lambda r: r["start"])
        assert sum(r["length"] for r in mine) == len(ids) == mine[0]["doc_tokens"]
        assert all(r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) for r in mine)


# --- BPE


def test_encoder_equals_the_library():
    tokenizers = pytest.importorskip("tokenizers")
    reference, mine = tokenizers.Tokenizer.from_file(WORD_BPE), bpe.Encoder(WORD_BPE)
    decoder, r = bpe.Decoder(mine.merges), random.Random(9)
    texts = [t for t in ODD if t] + ["İstanbul ΣΑΣ ÉÑ é", "it's we'll 'S", "<|endoftext|>a<|startoftext|>", "x\x85y\xa0z", "".join(r.choice("aeinrth") for _ in range(9000)), "ab" * 3000]
    for t in texts:
        ids = reference.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(mine.encode(t), "<u4").tolist() == ids, t[:40]
        assert bpe.decoded_digest(decoder, mine.encode(t)) == hashlib.sha256(reference.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert mine.encode(None) == mine.encode("") == b""


def test_transducer_equals_merging_at_any_chunk():
    merges = bpe.Merges(WORD_BPE)
    lookahead, r = merges.sufficient_lookahead(), random.Random(10)
    for _ in range(300):
        word = merges.spelled("".join(r.choice("aeinrthsoul") for _ in range(r.choice([1, 3, 9, 30, 300]))).encode())
        for chunk in (1, 7, 1000):
            machine, out = bpe.Transducer(merges, lookahead), []
            for at in range(0, len(word), chunk):
                out += machine.feed(word[at : at + chunk])
                assert len(machine.held) <= machine.most
            assert out + machine.finish() == merges.apply(word), word


def test_transducer_equals_merging_for_random_lists(tmp_path):
    r, lists, refused = random.Random(14), 0, 0
    while lists < 150:
        letters, rules = "abc", []
        tokens = [c + end for c in letters for end in ("", "</w>")]
        for _ in range(r.randint(1, 14)):
            left, right = r.choice([t for t in tokens if not t.endswith("</w>")]), r.choice(tokens)
            if left + right not in tokens:
                tokens.append(left + right)
                rules.append(f"{left} {right}")
        alphabet = [c + end for c in bpe.byte_alphabet() for end in ("", "</w>")]
        vocab = {t: i for i, t in enumerate([*alphabet, *(t for t in tokens if t not in alphabet)])}
        path = tmp_path / f"{lists}.json"
        path.write_text(json.dumps({"model": {"vocab": vocab, "merges": rules, "end_of_word_suffix": "</w>"}, "added_tokens": []}))
        merges = bpe.Merges(str(path))
        lists += 1
        for _ in range(40):
            word = merges.spelled("".join(r.choice(letters) for _ in range(r.randint(1, 40))).encode())
            machine = bpe.Transducer(merges, merges.sufficient_lookahead())
            assert [t for c in word for t in machine.feed(c)] + machine.finish() == merges.apply(word), (rules, word)
        path.write_text(json.dumps({"model": {"vocab": vocab | {"zz": 10**6}, "merges": [*rules, "z z", "z z"], "end_of_word_suffix": "</w>"}, "added_tokens": []}))
        with pytest.raises(ValueError):
            bpe.Merges(str(path))


def test_tokens_of_usual_words_leave_early_and_endless_words_take_constant_memory():
    mine, r = bpe.Encoder(WORD_BPE), random.Random(15)
    mine.encode(" ".join("".join(r.choice(["the", "tion", "an", "er", "ou"]) for _ in range(6)) for _ in range(500)))
    assert mine.transducer.early > 500
    machine, most = bpe.Transducer(mine.merges, mine.lookahead), 0
    for _ in range(20_000):
        machine.feed(r.choice("aeinrth"))
        most = max(most, len(machine.held))
    assert most < 64


def test_text_decoder_keeps_split_characters():
    mine = bpe.Encoder(WORD_BPE)
    decoder = bpe.Decoder(mine.merges, joined=False)
    ids = np.frombuffer(mine.encode("日本語 😀 ok"), "<u4").tolist()
    assert "".join(decoder.feed([i]) for i in ids) + decoder.finish() == "日本語 😀 ok "
