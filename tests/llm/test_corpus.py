"""Classifiers, mixing, near-duplicates, media, licenses, search and the pipeline."""

import hashlib
import json
import re
import zlib
from collections import Counter
from fractions import Fraction
from re import _constants, _parser

import numpy as np
import oracle
import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from siftstone.llm import ann, bpe, common, golay, licenses, media, mixing, quality, queries, simhash, toxicity

SMALL, SF = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
ROWS = [(5, None, None, 1.0), (1, "", "s0", 2.0), (3, "one two three four", "s1", 3.0), (3, "one two three four", "s1", 3.0), (None, "w " * 4000, "s0", 4.0), (7, "five words stand here now", "s1", 5.0)]
EDGE = "doc_id long, text string, source string, score double"


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame(ROWS, EDGE)


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}


def held(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


@pytest.mark.parametrize(("query", "label", "least"), [("op1_attention_mil", "quality", 0.97), ("op6_weak_supervision", "toxic", 0.94)])
def test_classifiers_hold_out_and_generalise(spark, query, label, least):
    out = queries.queries()[query](spark, SF)
    limit = {"quality": 0.3, "toxic": 0.5}[label]
    rows = {r.doc_id: r for r in out.collect()}
    assert all(r.held_out == held(i) and 0 <= r.score <= 1 and r.predicted == int(r.score >= limit) for i, r in rows.items())
    labels = [(r.doc_id, r[label]) for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if held(r.doc_id)]
    assert np.mean([rows[i].predicted == y for i, y in labels]) >= least


def test_labels_of_held_out_rows_and_other_columns_do_not_matter(spark):
    d, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    turned = labels.withColumn("quality", F.when(common.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    other = d.withColumns({"lang": F.lit("xx"), "source": F.lit("y")})
    a, b = (sorted((r.doc_id, r.score) for r in quality.quality_scores(x, y).collect()) for x, y in ((d, labels), (other, turned)))
    assert a == b


def test_classifiers_without_labels(spark, edge):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    one = spark.createDataFrame([(3, 1, 1), (7, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    assert {r.score for r in quality.quality_scores(edge, none).collect()} == {1.0}
    assert {r.score for r in toxicity.toxicity_scores(edge, none).collect()} == {0.0}
    assert quality.quality_scores(edge, one).count() == toxicity.toxicity_scores(edge, one).count() == len(ROWS)
    assert quality.quality_scores(edge.limit(0), one).count() == 0


def test_attention_finds_the_passage_that_decides():
    rng = np.random.default_rng(0)
    bags, labels = [], []
    for _ in range(300):
        bag = rng.normal(0, 0.2, (rng.integers(1, 6), quality.N_FEATURES)).astype(np.float32)
        bad = rng.random() < 0.4
        if bad:
            bag[rng.integers(len(bag)), 3] += 3
        bags.append(bag)
        labels.append(not bad)
    model = quality.AttentionMIL.fit(bags, np.array(labels, float))
    x, bag = np.concatenate(bags).astype(float), np.repeat(np.arange(300), [len(b) for b in bags])
    assert np.mean((model._forward(x, bag, 300)[-1] > 0.5) == np.array(labels)) > 0.95


def simulated(n, rates, prior=0.2, seed=1):
    rng = np.random.default_rng(seed)
    y = rng.random(n) < prior
    return y, np.stack([rng.random(n) < np.where(y, r1, r0) for r1, r0 in rates], axis=1)


def test_label_model_finds_accuracies_without_labels():
    rates = [(0.8, 0.03), (0.6, 0.02), (0.5, 0.1), (0.7, 0.05), (0.3, 0.01), (0.4, 0.2), (0.1, 0.1)]
    y, hits = simulated(20000, rates)
    model = toxicity.LabelModel(hits, 0.2)
    assert np.allclose(model.rate1, [a for a, _ in rates], atol=0.06) and np.allclose(model.rate0, [b for _, b in rates], atol=0.03)
    assert np.allclose(model.accuracy, [0.2 * a + 0.8 * (1 - b) for a, b in rates], atol=0.03)
    # the posterior equals the one of the model's own rates, computed document by document
    logit = np.log(model.prior / (1 - model.prior)) + sum(np.where(hits[:, k], np.log(model.rate1[k] / model.rate0[k]), np.log((1 - model.rate1[k]) / (1 - model.rate0[k]))) / model.discount[k] for k in range(len(rates)))
    assert np.allclose(model.posterior(hits), 1 / (1 + np.exp(-logit)))
    assert np.mean((model.fitted > 0.5) == y) > 0.93


def test_label_model_counts_copies_of_a_voter_once():
    y, hits = simulated(20000, [(0.8, 0.05), (0.7, 0.1), (0.6, 0.05), (0.5, 0.02), (0.7, 0.04), (0.6, 0.1), (0.4, 0.2)])
    model = toxicity.LabelModel(np.c_[hits, hits[:, 6], hits[:, 6]], 0.2)
    assert min(model.discount[6:]) > 2.5 > 1.6 > max(model.discount[:6])
    assert model.correlation[6, 7] > 0.9 > 0.3 > model.correlation[:6, :6][~np.eye(6, dtype=bool)].max()
    # a voter that may not vote on some documents is judged by the others
    votes = np.ones(hits.shape, bool)
    votes[:10000, 0] = False
    masked = toxicity.LabelModel(np.where(votes, hits, y[:, None]), 0.2, votes)
    assert abs(masked.rate1[0] - 0.8) < 0.08


@pytest.mark.parametrize(
    ("text", "voters"),
    [
        ("You are such an idiot", {"insults", "german", "french", "insult_and_address"}),
        ("du bist ein Trottel", {"german", "insult_and_address"}),
        ("tu es une ordure", {"french", "insult_and_address"}),
        ("eres un payaso", {"spanish", "insult_and_address"}),
        ("what an 1d10t, a m*ron", {"spelled"}),
        ("shut up", {"silence"}),
        ("I will find and kill you", {"threats", "threat_frame"}),
        ("no no no no no", {"again"}),
        ("ha!!!!!!!!!!", {"shouting"}),
        ("a quiet text of 10 words, 3 * 4 = 12", set()),
        ("", set()),
    ],
)
def test_voters_that_stand_without_labels(text, voters):
    got = {name for name, hit in zip(toxicity.FIXED, toxicity.fixed_votes(text, toxicity.terms_of(text)), strict=True) if hit}
    assert got == voters


def test_toxicity_equals_brute_force(spark):
    """Terms, mined voters, votes and scores, computed document by document in plain Python."""
    d, labels = (common.read(spark, SF, t) for t in ("documents", "labels"))
    model = toxicity.train(d, labels)
    texts = {r.doc_id: r.text for r in d.collect()}
    y = {r.doc_id: r.toxic for r in labels.collect() if r.doc_id in texts and not held(r.doc_id)}
    fold = {r.doc_id: r.f for r in d.select("doc_id", F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(toxicity.FOLDS)).alias("f")).collect()}
    terms = {i: toxicity.terms_of(texts[i]) for i in y}
    for k, pair in enumerate(toxicity._PAIRS):
        inside = [i for i in y if fold[i] in pair]
        toxic = [i for i in inside if y[i]]
        table = {}
        for i in inside:
            for t in terms[i]:
                c, n = table.get(t, (0, 0))
                table[t] = c + y[i], n + 1 - y[i]
        for kind in (0, 1):
            want = toxicity.chosen_terms([(t, c, n) for t, (c, n) in table.items() if t.endswith("-") == bool(kind)], len(toxic), len(inside) - len(toxic))
            assert want == sorted(t for t, v in model.voters.items() if len(toxicity.FIXED) + 2 * k + kind in v)
    order = sorted(y)
    votes = np.stack([model.votes(texts[i], terms[i]) for i in order])
    allowed = np.ones(votes.shape, bool)
    for k, pair in enumerate(toxicity._PAIRS):
        allowed[[fold[i] in pair for i in order], len(toxicity.FIXED) + 2 * k : len(toxicity.FIXED) + 2 * k + 2] = False
    again = toxicity.LabelModel(votes, np.mean(list(y.values())), allowed, toxicity.ABSTAINS)
    assert np.allclose(again.fitted, model.label_model.fitted)
    for i in order[:50]:
        logit = model.bias + sum(model.weights[model.number[t]] for t in terms[i] if t in model.number) + model.weights[len(model.number) :][model.votes(texts[i], terms[i])].sum()
        assert abs(model.score([texts[i]])[0] - 1 / (1 + np.exp(-np.clip(logit, -30, 30)))) < 1e-12


def test_attention_equals_brute_force(spark):
    """The forward pass, passage by passage, on the documents; and the gradient step's direction by differences."""
    d, labels = (common.read(spark, SMALL, t) for t in ("documents", "labels"))
    model = quality.train(d, labels)
    w = model.weights
    got = {r.doc_id: r.score for r in quality.quality_scores(d, labels).collect()}
    for r in d.collect():
        hidden, logits = [], []
        for p in quality.passages(r.text.encode()):
            z = (quality.encode([p])[0][0].astype(np.float64) - w["mean"]) / w["scale"]
            h = np.tanh(z @ w["E"] + w["e"])
            hidden.append(h)
            logits.append(sum(w["v"][j] * np.tanh(h @ w["V"][:, j]) / (1 + np.exp(-(h @ w["U"][:, j]))) for j in range(quality.ATTENTION)))
        a = np.exp(np.array(logits) - max(logits))
        score = 1 / (1 + np.exp(-(np.average(hidden, axis=0, weights=a) @ w["w"] + w["c"])))
        assert abs(score - got[r.doc_id]) < 1e-9


def test_classifiers_of_long_texts_and_repeated_rows(spark):
    labels = spark.createDataFrame([(k, int(k % 3 > 0), int(k % 3 == 0)) for k in range(60)], "doc_id long, quality int, toxic int")
    rows = [(k, "you idiot scum trash " * 5 if k % 3 == 0 else f"calm words number {k}, read slowly. " * 4, k) for k in range(60)]
    rows += [(7, "calm words again", 1), (7, "calm words again", 1), (500, "x" * 300_000, 1), (501, "idiot " * 50_000, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score int")  # a column that the result has as well
    for f in (quality.quality_scores, toxicity.toxicity_scores):
        out = f(docs, labels.unionByName(labels)).collect()
        assert len(out) == len(rows) and all(0 <= r.score <= 1 for r in out) and len({r.score for r in out if r.doc_id == 7}) <= 2


def test_mixing_equals_sql_and_fills_targets(spark):
    con = oracle.connect(SF)
    assert oracle.compare(queries.op5_mixing(spark, SF), mixing.SQL, con) == ""
    rows = mixing.mix(spark.read.parquet(f"{SF}/documents.parquet")).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "source"), "doc_id")
    for r in rows.groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("g"), F.max(F.col("taken") - 3 * F.col("size")).alias("over")).collect():
        assert abs(r.t - r.g) <= 0.5 and r.over <= 0


def test_water_fill():
    assert mixing.water_fill([10, 100, 0], [5, 2, 1]) == [(30, 1), (160, 2), (0, 1)] or sum(a / b for a, b in mixing.water_fill([10, 100, 0], [5, 2, 1])) == 110
    assert mixing.water_fill([0, 0], [5, 2]) == [(0, 7), (0, 7)]
    assert mixing.water_fill([], []) == []


def test_mixing_edge_rows(spark, edge):
    rows = mixing.mix(edge).collect()
    assert len(rows) == len(ROWS) and {r.doc_id: r.size for r in rows}[None] == 4000 and all(r.taken <= 3 * r.size for r in rows)
    assert mixing.mix(edge.limit(0)).count() == 0
    mixed = mixing.mixture(edge)
    assert mixed.columns == edge.columns and {tuple(r) for r in mixed.collect()} <= set(ROWS)


def brute_fingerprint(text):
    w = text.encode().lower().split()
    shingles = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def closure(ids, linked):
    label = dict(zip(range(len(ids)), ids, strict=True))
    while True:
        new = {a: min(label[b] for b in range(len(ids)) if linked[a][b]) for a in label}
        if new == label:
            return [label[k] for k in range(len(ids))]
        label = new


def test_simhash_equals_brute_force(spark, docs):
    rows = sorted(queries.op9_simhash(spark, SMALL).collect())
    ids = sorted(docs)
    fp = [brute_fingerprint(docs[i]) for i in ids]
    label = closure(ids, [[(a ^ b).bit_count() <= 2 for b in fp] for a in fp])
    assert [(r.doc_id, r.fingerprint, r.component_id) for r in rows] == [(i, f"{f:016x}", c) for i, f, c in zip(ids, fp, label, strict=True)]


def test_simhash_links_of_a_crowd(spark):
    rng = np.random.default_rng(0)
    base = int(rng.integers(0, 2**62))
    fp = {int(x) for x in rng.integers(0, 2**63, 100)}
    for _ in range(400):
        fp.add(base ^ sum(1 << int(b) for b in set(rng.integers(0, 64, rng.integers(0, 6)))))
    bits = np.array(sorted(fp), np.uint64)
    u = bits.view(np.int64)
    got = {r.node: r.component for r in simhash.connected_components(simhash.link_classes(spark.createDataFrame([(int(x),) for x in u], "fp long"))).collect()}
    want = closure(u.tolist(), (np.bitwise_count(bits[:, None] ^ bits[None, :]) <= 2).tolist())
    assert [got.get(int(x), int(x)) for x in u] == want


def test_simhash_edge_rows(spark, edge):
    rows = {(r.doc_id, r.fingerprint, r.component_id) for r in simhash.simhash_components(edge).collect()}
    assert {(5, "0" * 16, 1), (1, "0" * 16, 1)} <= rows and len(rows) == 5
    assert simhash.simhash_components(edge.limit(0)).count() == 0


def test_golay_words_at_two_bits_share_a_key():
    assert (np.bincount(golay.decode_table()) == 2048).all()
    rng = np.random.default_rng(2)
    for _ in range(300):
        a = int(rng.integers(0, 1 << 23))
        b = a ^ (1 << int(rng.integers(23))) ^ (1 << int(rng.integers(23)))
        at, key = golay.keys(np.array([a, b]))
        assert set(key[at == 0]) & set(key[at == 1])


def test_media_round_trip_and_query(spark, docs):
    rows = {r.doc_id: r for r in queries.op8_mpeg_audio(spark, SMALL).collect()}
    for i, text in docs.items():
        raw = text.encode()
        payload = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        r = rows[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        stored = media.write_mpeg(media.padded(raw))
        assert (r.media_bytes, r.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest())
        assert json.loads(r.feature)["crc_ok"] == len(payload) // 576


@pytest.mark.parametrize("payload", [b"\xff" * 576, b"\0" * 1152, bytes(range(256)) * 9, b"\xff\xf2\x80\xc0" * 288])
def test_media_any_bytes_tags_and_foreign_bytes(payload):
    data = media.write_mpeg(payload)
    s = media.read_mpeg(data)
    assert media.payload_of(data, s) == payload and s.table["frames"] == len(s.offsets) and s.samples == 576 * len(s.offsets)
    cut = int(s.offsets[-1])
    dirty = media.read_mpeg(data[:cut] + b"\xff\xffjunk" + data[cut:] + b"TAG" + b"name".ljust(125, b"\0"))
    assert len(dirty.offsets) == len(s.offsets) and dirty.skipped == 6 and dirty.tags["v1"] == "name"
    broken = bytearray(data)
    broken[int(s.offsets[0]) + 8] ^= 1
    assert media.read_mpeg(bytes(broken)).crc_ok == s.crc_ok - 1


def mpeg_frames(b1, b2, b3, n):
    """n frames of zeros with one header; the right checksum where the header asks for one."""
    h = media.header(b1, b2, b3)
    frame = bytearray(bytes([255, b1, b2, b3]).ljust(h.length, b"\0"))
    if not b1 & 1:
        checked = np.frombuffer(bytes(frame[2:4] + frame[6 : 6 + h.side]), np.uint8)
        frame[4:6] = int(media.crc16(checked[None])[0]).to_bytes(2, "big")
    return h, bytes(frame) * n


@pytest.mark.parametrize(
    ("b1", "b2", "b3", "version", "layer", "rate", "channels", "bitrate", "samples", "length"),
    [
        (0xFB, 0x90, 0x00, "1", 3, 44100, 2, 128, 1152, 417),
        (0xFA, 0x92, 0x40, "1", 3, 44100, 2, 128, 1152, 418),
        (0xFB, 0xE4, 0xC0, "1", 3, 48000, 1, 320, 1152, 960),
        (0xF3, 0x80, 0x00, "2", 3, 22050, 2, 64, 576, 208),
        (0xE3, 0x40, 0xC0, "2.5", 3, 11025, 1, 32, 576, 208),
        (0xFD, 0xA4, 0x00, "1", 2, 48000, 2, 192, 1152, 576),
        (0xFF, 0x98, 0x00, "1", 1, 32000, 2, 288, 384, 432),
    ],
)
def test_media_reads_other_kinds(b1, b2, b3, version, layer, rate, channels, bitrate, samples, length):
    _, data = mpeg_frames(b1, b2, b3, 20)
    s = media.read_mpeg(b"junk" + data)
    assert (s.version, s.layer, s.rate, s.channels, s.samples, s.skipped, len(s.offsets)) == (version, layer, rate, channels, 20 * samples, 4, 20)
    assert set(s.bitrates) == {bitrate} and s.offsets.tolist() == [4 + k * length for k in range(20)]
    assert s.crc_ok == (20 if layer == 3 and not b1 & 1 else 0)
    assert media.duration_us(s) == 20 * samples * 10**6 // rate


def test_media_tables_delay_and_tags():
    h, body = mpeg_frames(0xFB, 0x90, 0x00, 10)
    first = bytes([255, 0xFB, 0x90, 0x00])
    lame = b"LAME3.100".ljust(21, b"\0") + (576 << 12 | 1000).to_bytes(3, "big")
    xing = first + bytes(h.side) + b"Info" + (15).to_bytes(4, "big") + (10).to_bytes(4, "big") + (4170).to_bytes(4, "big") + bytes(100) + bytes(4) + lame
    s = media.read_mpeg(xing.ljust(h.length, b"\0") + body)
    assert (s.table["frames"], s.delay, s.padding, s.heard, s.table["encoder"]) == (10, 576, 1000, 11520 - 1576, "LAME3.100") and len(s.offsets) == 10
    assert media.duration_us(s) == (11520 - 1576) * 10**6 // 44100
    vbri = first + bytes(32) + b"VBRI" + bytes([0, 1, 2, 0, 0, 50]) + (4170).to_bytes(4, "big") + (10).to_bytes(4, "big") + bytes([0, 2, 0, 3, 0, 2, 0, 5, 0, 100, 1, 0])
    s = media.read_mpeg(vbri.ljust(h.length, b"\0") + body)
    assert (s.table["frames"], s.table["bytes"], s.table["toc"], s.delay, len(s.offsets)) == (10, 4170, [300, 768], 512, 10)
    # tags: version 2.4 has sizes of seven bits a byte, 2.2 short names
    text = b"\x03" + b"t" * 200
    four = b"TIT2" + media._syncsafe(len(text)) + b"\0\0" + text + b"TPE1" + media._syncsafe(5) + b"\0\0" + b"\x01\xff\xfeA\0"
    two = b"TT2" + (4).to_bytes(3, "big") + b"\0abc"
    for version, tag, want in ((4, four, {"TIT2": "t" * 200, "TPE1": "A"}), (2, two, {"TT2": "abc"})):
        s = media.read_mpeg(b"ID3" + bytes([version, 0, 0]) + media._syncsafe(len(tag)) + tag + body)
        assert s.tags == want and len(s.offsets) == 10 and s.skipped == 0
    for data in (b"", b"\xff" * 50, b"ID3", b"ID3\x04\0\0\0\0\0\x7f", xing[:30]):
        assert len(media.read_mpeg(data).offsets) == 0


def test_media_long_text_and_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "long text " * 40_000, "x")], "doc_id long, text string, feature string")
    r = media.media_digests(docs).first()
    assert (r.n_bytes, r.payload_bytes) == (400_000, 576 * 695) and json.loads(r.feature)["crc_ok"] == 695


def test_media_edge_rows(spark, edge):
    rows = media.media_digests(edge).collect()
    assert len(rows) == len(ROWS) and {r.payload_bytes for r in rows if r.doc_id in (1, 5)} == {576}
    assert media.media_digests(edge.limit(0)).count() == 0
    first = media.media_table(edge.filter("doc_id = 3")).first()
    assert first.duration_us == 36000 and len(first.seek_offsets) == 1


def test_licenses_base_equals_brute_force(spark, docs):
    rows = {r.doc_id: r for r in queries.op10_license_rules(spark, SMALL).collect()}
    for i, text in docs.items():
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
        found = [(k, label) for k in range(len(w)) for p, label in licenses.BASE if w[k : k + len(p.split())] == p.split()]
        r = rows[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(w), len(found), min((k for k, _ in found), default=None), max((k for k, _ in found), default=None))
        assert r.base_labels == ",".join(sorted({x for _, x in found})) and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1


@pytest.mark.parametrize(
    ("text", "labels"),
    [
        ("Licensed under the Apache License, Version 2.0", "apache-2.0,licensed-under"),
        ("GNU Lesser General Public License v2.1", "gpl,lgpl-2.1"),
        ("CC BY-NC-SA 4.0", "cc-by,cc-by-nc-sa-4.0"),
        ("SPDX-License-Identifier: BSD-3-Clause", "bsd-3-clause"),
        ("Permission is hereby granted, free of charge, to any person obtaining a copy", "mit"),
        ("All rights reserved. all RIGHTS reserved", "reserved"),
        ("submit a limited permit", ""),
        ("licensed under GPL", "gpl"),
        ("the LGPL or the MPL", "lgpl,mpl"),
        ("", ""),
    ],
)
def test_license_rules(text, labels):
    assert licenses.scan_text(text.encode())[5] == labels


def spelled(parsed):
    """Texts of a parsed pattern: all branches, optional parts absent and present, the first letter of a class."""
    out = [""]
    for op, arg in parsed:
        if op is _constants.LITERAL:
            parts = [chr(arg)]
        elif op is _constants.IN:
            parts = ["x" if arg[0][0] is _constants.NEGATE else chr(arg[0][1] if arg[0][0] is _constants.LITERAL else arg[0][1][0])]
        elif op is _constants.NOT_LITERAL:
            parts = ["x"]
        elif op is _constants.SUBPATTERN:
            parts = spelled(arg[3])
        elif op is _constants.BRANCH:
            parts = [t for branch in arg[1] for t in spelled(branch)]
        elif op is _constants.MAX_REPEAT:
            parts = ([""] if arg[0] == 0 else []) + spelled(arg[2])
        elif op in (_constants.ASSERT, _constants.ASSERT_NOT):
            parts = [""]
        else:
            raise ValueError(op)
        out = [a + b for a in out for b in parts]
    return out


def test_license_rules_imply_their_keywords():
    for rule in licenses.rules():
        texts = [t.encode("latin-1") for t in spelled(_parser.parse(rule.pattern.pattern))]
        assert any(rule.pattern.search(t) for t in texts), rule
        assert all(rule.keyword in t for t in texts if rule.pattern.search(t)), rule
    assert licenses.scan_text(b"All rights are reserved.")[5] == "reserved"
    assert licenses.scan_text(b"Historical Permission Notice and Disclaimer")[5] == "hpnd"


def test_license_detections_equal_brute_force(spark, docs):
    """All rules on all texts without the keywords' gate; suppression by comparing all with all."""
    order = {r: k for k, r in enumerate(licenses.rules())}
    some = [b"cc by cc by sa 4 0", b"x" * 200_000 + b" mit license", b"gpl " * 20_000, *(t.encode() for t in list(docs.values())[:80])]
    for text in some:
        form = licenses.words_form(text)[1]
        found = sorted({(m.start(), m.end(), r) for r in licenses.rules() for m in r.pattern.finditer(form)}, key=lambda d: (d[0], d[1], order[d[2]])) if len(text) < 50_000 else None
        if found is None:
            assert licenses.scan_text(text)[0] == len(form.split())
            continue
        kept = licenses.detections(form)
        for d in found:
            # what stays has no kept one of higher priority around it, and what goes has one, or one of its own priority
            around = [o for o in kept if o[0] <= d[0] and d[1] <= o[1] and o != d and o[2].priority <= d[2].priority]
            assert (d in kept) or around, d
            assert not (d in kept and any(o[2].priority < d[2].priority for o in around)), d
        miss = np.prod([1 - min(r.weight, 0.95) for _, _, r in kept]) * 0.5 ** len(licenses.base_places(form))
        assert abs(licenses.scan_text(text)[6] - (1 - miss)) < 1e-9


def test_license_edge_rows(spark, edge):
    rows = {r.doc_id: r for r in licenses.scan(edge.withColumn("labels", F.lit("mine"))).collect()}
    assert (rows[1].n_words, rows[1].labels, rows[1].score, rows[1].first_word) == (0, "", 0.0, None)


def test_license_rules_are_gated_and_nested_ones_go(spark, edge):
    assert len(licenses.rules()) > 300
    form = licenses.words_form(b"gnu general public license version 3 gnu general public license")[1]
    found = licenses.detections(form)
    assert [(r.label, a) for a, _, r in found] == [("gpl-3", 0), ("gpl", 37)]
    assert licenses.scan(edge).count() == len(ROWS) and licenses.scan(edge.limit(0)).count() == 0


def test_search_recall_and_scores(spark):
    p = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").toPandas()
    x, ids = np.array(p.embedding.tolist(), np.float64), p.vec_id.to_numpy()
    n = np.sqrt((x * x).sum(1))
    got = queries.op2_cross_polytope(spark, "/root/testdata/sf0.1").toPandas()
    hits = total = 0
    for q in np.flatnonzero(ids % 50 == 0):
        s = (x * x[q]).sum(1) / (n * n[q])
        s[q] = -9
        best = ids[np.lexsort((ids, -s))[:5]]
        mine = got[got.query_id == ids[q]].sort_values("rank")
        assert mine["rank"].tolist() == [1, 2, 3, 4, 5] and np.allclose(mine.score, [s[ids.tolist().index(v)] for v in mine.vec_id], rtol=0, atol=1e-15)
        hits, total = hits + len(set(mine.vec_id) & set(best)), total + 5
    assert hits / total >= 0.95


def test_search_edge_rows(spark, monkeypatch):
    rows = [(0, [1.0, 0.0]), (50, [1.0, 1.0]), (1, [0.0, 1.0]), (2, None), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]), (5, [1.0, 0.0]), (6, [None, 1.0]), (100, [1.0, 2.0, 3.0]), (7, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = [(r.query_id, r.rank, r.vec_id, round(r.score, 6)) for r in ann.nearest(df).orderBy("query_id", "rank").collect()]
    h = round(2**-0.5, 6)
    assert got == [(0, 1, 5, 1.0), (0, 2, 50, h), (0, 3, 1, 0.0), (50, 1, 0, h), (50, 2, 1, h), (50, 3, 5, h)]
    assert ann.nearest(df.limit(0)).count() == 0
    # blocks of few rows give the same, copies go by their ids
    monkeypatch.setattr(ann, "INDEX_BLOCK", 3)
    monkeypatch.setattr(ann, "QUERY_BLOCK", 1)
    copies = spark.createDataFrame([(k, [1.0, 2.0, 3.0, 4.0]) for k in range(101)], "vec_id long, embedding array<float>")
    assert {(r.query_id, r.vec_id) for r in ann.nearest(copies).collect()} == {(0, k) for k in range(1, 6)} | {(50, k) for k in range(5)} | {(100, k) for k in range(5)}
    some = spark.createDataFrame([(int(k), [float(x) for x in v]) for k, v in enumerate(np.random.default_rng(3).normal(size=(120, 6)))], "vec_id long, embedding array<double>")
    want = brute_force_neighbours(some)
    assert [(r.query_id, r["rank"], r.vec_id) for r in ann.nearest(some).orderBy("query_id", "rank").collect()] == want


def test_search_tiny_vectors_repeated_ids_and_clashing_columns(spark):
    rows = [(0, [1e-200, 2e-200]), (1, [3e200, 6e200]), (2, [2.0, 1.0]), (3, [-1.0, 5e-324]), (3, [1.0, 2.0]), (3, [1.0, 2.0]), (4, [1.0, 0.0])]
    df = spark.createDataFrame([(i, v, 7, 8.0) for i, v in rows], "vec_id long, embedding array<double>, rank int, score double")
    got = [(r.query_id, r.rank, r.vec_id, round(r.score, 6)) for r in ann.nearest(df).orderBy("rank").collect()]
    assert got == [(0, 1, 1, 1.0), (0, 2, 3, 1.0), (0, 3, 2, 0.8), (0, 4, 4, round(5**-0.5, 6))]


def brute_force_neighbours(df, every=50, k=5):
    rows = sorted((r.vec_id, np.array(r.embedding, np.float64)) for r in df.collect())
    x, ids = np.stack([v for _, v in rows]), np.array([i for i, _ in rows])
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    out = []
    for q in np.flatnonzero(ids % every == 0):
        s = unit @ unit[q]
        s[q] = -9
        out += [(int(ids[q]), n + 1, int(ids[c])) for n, c in enumerate(np.lexsort((ids, -s))[:k])]
    return out


def test_search_of_clusters_with_two_rotations(spark, monkeypatch):
    """Clustered vectors: few probes do, one rotation or two."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(150, 32))
    x = centres[rng.integers(0, 150, 3000)] + 0.15 * rng.normal(size=(3000, 32))
    df = spark.createDataFrame([(int(k), [float(c) for c in v]) for k, v in enumerate(x)], "vec_id long, embedding array<float>")
    want = set(brute_force_neighbours(df))
    want = {(q, v) for q, _, v in want}
    for rows in (4096, 10):
        monkeypatch.setattr(ann, "BUCKET_ROWS", rows)
        got = {(r.query_id, r.vec_id) for r in ann.nearest(df).collect()}
        assert len(got) == len(want) and len(got & want) >= 0.95 * len(want)


def jaccard_groups(texts):
    sets = {i: set(simhash.shingle_hashes(simhash.words_of((t or "").encode()), 5).tolist()) for i, t in texts.items()}
    ids = sorted(sets)
    near = [[a == b or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) for b in ids] for a in ids]
    return dict(zip(ids, closure(ids, near), strict=True))


def test_near_dedup_keeps_one_of_each_group(spark, docs):
    df = spark.read.parquet(f"{SMALL}/documents.parquet")
    base = docs[min(docs, key=lambda i: abs(len(docs[i]) - 1500))].split()
    near = [(1000 + k, " ".join(w if j % 60 != k else f"other{k}" for j, w in enumerate(base)), "en", "s", 1) for k in range(12)]
    more = df.unionByName(spark.createDataFrame(near, df.schema))
    kept = {r.doc_id for r in simhash.near_dedup(more).collect()}
    groups = jaccard_groups({r.doc_id: r.text for r in more.collect()})
    assert kept == set(groups.values())


def common_anchors():
    """15 words whose 3-word shingles have so low hashes that a text with them has its five anchors there."""
    rng, best = np.random.default_rng(1), [(2**64, None)] * simhash.SEGMENTS
    for a, b, c in rng.integers(0, 10**6, (40000, 3)):
        words = [b"h%d" % a, b"h%d" % b, b"h%d" % c]
        h = simhash.shingle_hashes(words, 3)
        for k in range(simhash.SEGMENTS):
            best[k] = min(best[k], (int(simhash._mixed(h, k)[0]), words))
    return [w.decode() for _, words in best for w in words]


def same_words(pairs, seed):
    """Texts of the same words in any order, each with one copy in which two neighbours are exchanged."""
    rng, head = np.random.default_rng(seed), common_anchors()
    out = []
    for _ in range(pairs):
        w = [f"v{k}" for k in rng.permutation(90)]
        at = int(rng.integers(20, 70))
        out += [" ".join(head + w), " ".join(head + w[:at] + [w[at + 1], w[at]] + w[at + 2 :])]
    return out


def test_near_dedup_of_crowded_buckets_equals_brute_force(spark, monkeypatch):
    texts = dict(enumerate(same_words(150, 2)))
    groups = jaccard_groups(texts)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert len(set(groups.values())) == 150
    assert {r.doc_id for r in simhash.near_dedup(df).collect()} == set(groups.values())
    # the same with groups split by their rarest shingles, and in blocks
    monkeypatch.setattr(simhash, "BLOCK_WORDS", 10_000)
    assert {r.doc_id for r in simhash.near_dedup(df).collect()} == set(groups.values())


def test_near_dedup_of_a_split_crowd_equals_brute_force(spark, monkeypatch):
    texts = dict(enumerate(edited_copies(300, 5) + same_words(40, 6)))
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    monkeypatch.setattr(simhash, "BLOCK_TEXTS", 20)
    monkeypatch.setattr(simhash, "BROADCAST_ROWS", 10)
    assert {r.doc_id for r in simhash.near_dedup(df).collect()} == set(jaccard_groups(texts).values())


def test_near_dedup_of_a_large_crowd_loses_no_link(spark):
    texts = edited_copies(6000, 7)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = {r.doc_id for r in simhash.near_dedup(df).collect()}
    assert kept == set(brute_force_groups(texts).values())


def edited_copies(n, seed):
    """Copies of one text with 0 to 12 words changed: some similar to each other, some to none."""
    rng, base = np.random.default_rng(seed), [f"b{k}" for k in range(120)]
    return [" ".join(f"e{rng.integers(3)}-{k}" if k in at else w for k, w in enumerate(base)) for at in (set(rng.integers(0, 120, rng.integers(0, 13)).tolist()) for _ in range(n))]


def near_texts(texts):
    """(shingle sets, the texts at a similarity of 0.8 of each), by comparing all with all."""
    sets = [np.unique(simhash.shingle_hashes(simhash.words_of(t.encode()), simhash.SHINGLE)) for t in texts]
    _, token = np.unique(np.concatenate(sets), return_inverse=True)
    size = np.array([len(s) for s in sets], np.int32)
    start = np.r_[0, np.cumsum(size)]
    full = np.flatnonzero(size)
    has = np.zeros(token.max() + 1, np.int16)
    near = {}
    for x in range(len(sets)):
        has[token[start[x] : start[x + 1]]] = 1
        both = np.zeros(len(sets), np.int32)
        both[full] = np.add.reduceat(has[token], start[full])
        has[token[start[x] : start[x + 1]]] = 0
        near[x] = {x, *np.flatnonzero(both >= 0.8 * (size + size[x] - both) - 1e-9).tolist()}
    return sets, near


def brute_force_groups(texts):
    return reached(near_texts(texts)[1])


@pytest.mark.parametrize("texts", [edited_copies(2500, 3), same_words(1250, 4), ["", " ", "a b c", "  ", "a b c d e f"]], ids=["edited copies", "same words", "short"])
def test_crossing_links_equal_brute_force(texts):
    sets, near = near_texts(texts)
    table = simhash.pa.table({"home": [True] * len(sets), "component": [f"{k:04}" for k in range(len(sets))], "shingles": [s.tobytes() for s in sets]})
    links = simhash._crossing_links(table)
    found = {k: {k} for k in range(len(sets))}
    for u, v in zip(links["u"].to_pylist(), links["v"].to_pylist(), strict=True):
        found[int(u)].add(int(v))
        found[int(v)].add(int(u))
    assert reached(found) == reached(near)


@pytest.mark.parametrize("texts", [edited_copies(600, 8), same_words(200, 9), ["", " ", "a b c", "  ", "a b c d e f", "a b c d e f g", "x " * 50]], ids=["edited copies", "same words", "short"])
def test_first_hashes_lose_no_similar_pair(texts):
    sets, near = near_texts(texts)
    sets = [np.unique(s) for s in sets]
    first = [simhash.first_hashes(s) for s in sets]
    for x in range(len(sets)):
        for y in range(x):
            bound = simhash.at_most(first[x], len(sets[x]), first[y], len(sets[y]))
            assert bound >= len(np.intersect1d(sets[x], sets[y]))
            if x % 20:
                break
    n = len(sets)
    table = simhash.pa.table({"k": simhash.pa.array([0] * n, "int32"), "anchor": [1] * n, "node": [str(k) for k in range(n)], "component": [str(k // 2) for k in range(n)], "size": [len(s) for s in sets], "first": [f.tobytes() for f in first]})
    kept = set(map(int, simhash._may_link(table)["node"].to_pylist()))
    assert kept >= {x for x in near for y in near[x] if x // 2 != y // 2}


def reached(near):
    """The least number that each one reaches."""
    out = {}
    for k in sorted(near):
        todo = [] if k in out else [k]
        while todo:
            x = todo.pop()
            if x not in out:
                out[x] = k
                todo.extend(near[x])
    return out


def test_near_dedup_edge_rows(spark, edge):
    out = simhash.near_dedup(edge)
    assert out.columns == edge.columns
    assert sorted((r.doc_id is None, r.doc_id) for r in out.collect()) == [(False, 1), (False, 3), (False, 7), (True, None)]
    assert simhash.near_dedup(edge.limit(0)).count() == 0


def mixed_by_hand(rows):
    """How often the mix takes each row (doc_id, text, source): plain Python, by fractions and sorted lists."""
    size = {r: len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for r in rows}
    sources = sorted({r[2] for r in rows}, key=lambda s: (s is None, s or ""))
    total = {s: sum(n for r, n in size.items() if r[2] == s) for s in sources}
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sources)}
    target, free = {}, set(sources)
    while free:
        rest = Fraction(sum(total.values())) - sum(target.values())
        share = {s: rest * weight[s] / sum(weight[t] for t in free) for s in free}
        full = {s for s in free if share[s] > 3 * total[s]}
        target |= {s: Fraction(3 * total[s]) for s in full} if full else share
        free = free - full if full else set()
    times = {}
    for s in sources:
        words = int(target[s] + Fraction(1, 2))
        whole = min(3, words // total[s]) if total[s] else 0
        left = words - whole * total[s]
        key = lambda r: hashlib.md5(f"42:{'' if r[0] is None else r[0]}:{hashlib.md5((r[1] or '').encode()).hexdigest()}".encode()).hexdigest()
        for r in sorted((r for r in rows if r[2] == s), key=key):
            part = min(size[r], left)
            left -= part
            times[r] = whole + (part > 0 and 2 * part >= size[r])
    return times


def test_mixture_equals_brute_force(spark):
    rows = [(r.doc_id, r.text, r.source) for r in common.read(spark, SMALL, "documents").collect()] + [(9001, None, "src0"), (9002, "a b", None), (9003, "", None), (9004, "word " * 30_000, "src3")]
    df = spark.createDataFrame([(*r, "kept", 5) for r in rows], "doc_id long, text string, source string, size string, taken int")
    got = Counter((r.doc_id, r.text, r.source) for r in mixing.mixture(df).collect())
    assert got == Counter({r: n for r, n in mixed_by_hand(rows).items() if n})


def test_pipeline_equals_brute_force(spark):
    """Every stage in plain Python on the models that training gives: scores, shingle sets, fractions, the tokenizer's library."""
    d, labels = common.read(spark, SMALL, "documents"), common.read(spark, SMALL, "labels")
    rows = d.collect()
    good = quality.train(d, labels)
    rows = [r for r in rows if good.score([(r.text or "").encode()])[0] >= quality.THRESHOLD]
    toxic = toxicity.train(spark.createDataFrame(rows, d.schema), labels)
    rows = [r for r in rows if toxic.score([r.text or ""])[0] < toxicity.THRESHOLD]
    keep = set(jaccard_groups({r.doc_id: r.text for r in rows}).values())
    times = mixed_by_hand([(r.doc_id, r.text, r.source) for r in rows if r.doc_id in keep])
    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = Counter()
    for (doc_id, text, _), n in times.items():
        ids = library.encode_ordinary(text or "")
        want[doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()] += n
    got = Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, SMALL).collect())
    assert got == +want


def test_pipeline_stages_take_effect(spark):
    docs = common.read(spark, SF, "documents")
    labels = {r.doc_id: r for r in common.read(spark, SF, "labels").collect()}
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs.count()
        out = common.stored(stage(spark, docs, SF), "stage")
        if k < 4:
            assert out.columns == docs.columns
        if k < 3:
            assert 0 < out.count() < before
        kept = {r.doc_id for r in out.select("doc_id").distinct().collect()}
        if k == 0:
            assert np.mean([(i in kept) == (labels[i].quality == 1) for i in labels]) > 0.97
        if k == 1:
            assert np.mean([labels[i].toxic == 0 for i in labels if i in kept]) > 0.95
        if k == 4:
            assert out.count() == before and out.filter("not round_trip").isEmpty()
        docs = out
    assert corpus_pipeline.run(spark, SF).count() == docs.count()
