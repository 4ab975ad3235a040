"""Order-dependent and numeric operators against plain Python."""

import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siftstone.functions import text as tx
from siftstone.functions import vectors as vec
from siftstone.operators import cluster, dedup, match, ranking, rules, snapshot
from siftstone.operators.graph import connected_components
from siftstone.plans import fingerprints, runner, scalars, snapshots, streams, vectors
from siftstone.sources import sinks, tables

SF = "/root/testdata/sf0.001"


def components(edges):
    label = {x: x for e in edges for x in e}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            m = min(label[a], label[b])
            changed |= label[a] != m or label[b] != m
            label[a] = label[b] = m
    return label


def test_components_of_chains_stars_and_loops(spark):
    rng = np.random.default_rng(3)
    edges = [(k, k + 1) for k in range(0, 60)] + [(100, k) for k in range(101, 160)] + [tuple(map(int, e)) for e in rng.integers(200, 300, (80, 2))]
    edges = [e for e in edges if e[0] != e[1]]
    df = spark.createDataFrame(edges + [(7, 7), (None, 3)], "u long, v long")
    assert {r.node: r.component for r in connected_components(df).collect()} == components(edges)
    assert connected_components(df.limit(0)).count() == 0


def hashes_near(n, seed):
    """64-bit hashes in groups that differ in few bits, as signed integers; some equal."""
    rng = np.random.default_rng(seed)
    base = rng.integers(-(2**63), 2**63 - 1, 12)
    flips = [sum(1 << int(b) for b in set(rng.integers(0, 64, rng.integers(0, 5)))) for _ in range(n)]
    return [(int(base[k % 12]) & (2**64 - 1)) ^ f for k, f in enumerate(flips)]


def signed(x):
    return x - 2**64 if x >= 2**63 else x


@pytest.mark.parametrize("radius", [1, 3])
def test_hamming_pairs_equal_brute_force(spark, radius):
    words = hashes_near(100, 1)
    df = spark.createDataFrame([(k, signed(w), k % 2) for k, w in enumerate(words)], "id long, hash long, side int")
    got = sorted((r.a, r.b, r.dist) for r in dedup.hamming_pairs(df, radius, ["side"]).collect())
    want = [(a, b, (words[a] ^ words[b]).bit_count()) for a in range(len(words)) for b in range(a + 1, len(words)) if a % 2 == b % 2 and (words[a] ^ words[b]).bit_count() <= radius]
    assert got == sorted(want)


def test_crowds_of_equal_rows_are_one_class(spark):
    """10,000 equal rows are one row of the pair join, so no pair of them is made."""
    rows = [(k, [1.0, 0.0] if k < 10_000 else [0.0, 1.0]) for k in range(10_003)]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    members, classes = match.vector_classes(df)
    pairs = match.vector_pairs(classes, 0.5)
    assert pairs.count() == 0 and sorted(r.n for r in classes.collect()) == [3, 10_000]
    found = cluster.dbscan(classes.select("id", "n"), pairs, 3)
    assert {r.id: r.cluster for r in found.collect()} == {0: 0, 10_000: 1}
    assert members.count() == 10_003
    hashed = spark.createDataFrame([(k, 5 if k < 10_000 else 5 << k % 50) for k in range(10_010)], "id long, hash long").withColumn("scope", F.lit("x"))
    members, classes = dedup.hash_classes(hashed, ["scope"])
    assert classes.count() <= 11 and dedup.hamming_pairs(classes, 3, ["scope"]).count() <= 55
    assert {r["class"] for r in members.filter("id < 10000").collect()} == {0}


def test_many_targets_are_met_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(8)
    v, t = rng.normal(size=(60, 6)), rng.normal(size=(45, 6))
    t[7] = t[3]
    rows = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "id long, v array<double>")
    targets = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(t)], "tid long, t array<double>")
    few = {r.id: (r.tid, round(r.dist, 9), round(r.margin, 9)) for r in match.top_two(rows, targets).collect()}
    near = {r.id: r.tid for r in match.nearest(rows, targets, 0.9).collect()}
    monkeypatch.setattr(match, "TARGETS", 5)
    monkeypatch.setattr(match, "BLOCK", 16)
    assert {r.id: (r.tid, round(r.dist, 9), round(r.margin, 9)) for r in match.top_two(rows, targets).collect()} == few
    assert {r.id: r.tid for r in match.nearest(rows, targets, 0.9).collect()} == near
    assert match.nearest(rows, targets.limit(0), 0.9).count() == 0


def test_labels_spread_until_nothing_is_assigned(spark):
    angle = lambda a: [float(np.cos(np.radians(a))), float(np.sin(np.radians(a)))]
    known = spark.createDataFrame([(k, 1, angle(k)) for k in range(5)] + [(10 + k, 2, angle(180 + k)) for k in range(5)] + [(20, 3, angle(90))], "id long, label int, v array<double>")
    rows = spark.createDataFrame([(100 + k, angle(10 + 8 * k)) for k in range(9)], "id long, v array<double>")
    got = {r.id: (r.label, r["pass"]) for r in match.propagate(rows, known, 0.15, 0.05).collect()}
    assert got and {label for label, _ in got.values()} == {1} and max(p for _, p in got.values()) > 1
    assert match.propagate(rows.limit(0), known, 0.15, 0.05).count() == 0


def test_global_index_of_more_rows_than_spark_samples(spark):
    """Ranges come from a sample: 2 million rows in random order, each numbered once."""
    n = 2_000_000
    df = spark.range(0, n, 1, 16).select(F.pmod(F.xxhash64("id"), F.lit(1 << 40)).alias("x"), "id")
    out = ranking.global_index(df, [F.asc("x"), F.asc("id")], "i")
    row = out.agg(F.count("*").alias("n"), F.min("i").alias("lo"), F.max("i").alias("hi"), F.sum("i").alias("s"), F.sum(F.col("i") * F.col("i") % 1_000_003).alias("q")).first()
    assert (row.n, row.lo, row.hi, row.s) == (n, 0, n - 1, n * (n - 1) // 2) and row.q == sum(k * k % 1_000_003 for k in range(n))
    pairs = out.select("x", "i").sample(0.001, 1).orderBy("i").collect()
    assert [r.x for r in pairs] == sorted(r.x for r in pairs)


def test_group_index_of_hot_and_null_groups(spark):
    rows = [(None if k % 5 == 0 else "hot" if k % 5 < 4 else f"g{k}", k * 7919 % 1000, k) for k in range(1000)]
    df = spark.createDataFrame(rows, "g string, x long, id long")
    got = {r.id: r.i for r in ranking.group_index(df, ["g"], [F.asc("x"), F.asc("id")], "i").collect()}
    want = {}
    for g in {r[0] for r in rows}:
        want |= {i: n for n, (_, i) in enumerate(sorted((x, i) for h, x, i in rows if h == g))}
    assert got == want


def test_vector_pairs_over_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(match, "BLOCK", 20)
    v = np.random.default_rng(2).normal(size=(70, 8))
    v[5] = 0
    df = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "id long, v array<double>")
    got = {(r.a, r.b) for r in match.vector_pairs(df, 0.4).collect()}
    n = np.linalg.norm(v, axis=1)
    u = v / np.where(n > 0, n, 1)[:, None]
    want = {(a, b) for a in range(70) for b in range(a + 1, 70) if 1 - u[a] @ u[b] <= 0.4}
    assert got == want


@pytest.mark.parametrize("k", [2, 3])
def test_dbscan_core_border_noise(spark, k):
    x = [0.0, 0.1, 0.2, 1.0, 1.1, 5.0, 9.0, 9.1, 9.2, 9.25, 9.4]
    near = {(a, b) for a in range(len(x)) for b in range(a + 1, len(x)) if abs(x[a] - x[b]) <= 0.15}
    pairs = spark.createDataFrame(sorted(near), "a long, b long")
    ids = spark.createDataFrame([(i, 1) for i in range(len(x))], "id long, n long")
    got = {r.id: r.cluster for r in cluster.dbscan(ids, pairs, k).collect()}
    neighbours = {i: {j for j in range(len(x)) if (min(i, j), max(i, j)) in near} for i in range(len(x))}
    core = [i for i in neighbours if len(neighbours[i]) + 1 >= k]
    label = {i: -1 for i in neighbours}
    number = 0
    for i in core:
        if label[i] < 0:
            todo = [i]
            while todo:
                p = todo.pop()
                if label[p] < 0:
                    label[p] = number
                    todo += [q for q in neighbours[p] if q in core]
            number += 1
    for i in neighbours:
        if i not in core:
            label[i] = min((label[j] for j in neighbours[i] if j in core), default=-1)
    assert got == label


def test_centroid_merge_and_cliques(spark):
    cents = spark.createDataFrame([(0, [1.0, 0.0], 3), (1, [0.98, 0.199], 1), (2, [0.0, 1.0], 2)], "cluster int, centroid array<double>, n long")
    assert {r.cluster: r.merged for r in cluster.merge_centroids(cents, 0.42).collect()} == {0: 0, 1: 0, 2: 2}
    angles = [0, 20, 40, 60]
    members = spark.createDataFrame([(7, k, [float(np.cos(np.radians(a))), float(np.sin(np.radians(a)))]) for k, a in enumerate(angles)], "component long, id long, v array<double>")
    assert [r.clique for r in cluster.clique_split(members, 0.07).orderBy("id").collect()] == [0, 0, 1, 1]
    assert cluster.recluster(members, 0.5, 2).groupBy("part").count().agg(F.max("count")).first()[0] <= 2


def test_leaders_keep_the_first_of_equal_distance(spark):
    df = spark.createDataFrame([("x", 1, 0.9, 0), ("x", 2, 0.8, 3), ("x", 3, 0.7, 1), ("x", 4, 0.6, None)], "b string, id long, score double, hash long")
    got = {r.id: (r.keeper, r.dist) for r in dedup.leader_dedup(df, "b", 1).collect()}
    assert got == {1: (1, 0), 2: (2, 0), 3: (1, 1), 4: (4, 0)}


def test_rename_pairs_one_to_one_and_circles(spark):
    before = spark.createDataFrame([("a", 1, 5, "t"), ("b", 1, 5, "t"), ("c", 2, 6, "t")], "path string, entity long, size long, mtime string")
    after = spark.createDataFrame([("x", 1, 5, "t"), ("c", 2, 7, "t")], "path string, entity long, size long, mtime string")
    got = sorted((r.path, r.status) for r in snapshot.diff(before, after).collect())
    assert got == [("a", "renamed"), ("b", "missing"), ("c", "extra"), ("c", "size_changed")]
    steps = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d")], "a string, b string")
    assert {r.a: r.b for r in snapshot.chain_ends(steps).collect()} == {"a": "d", "b": "d", "c": "d"}
    with pytest.raises(RuntimeError):
        snapshot.chain_ends(spark.createDataFrame([("a", "b"), ("b", "a")], "a string, b string"), max_rounds=3)


def test_restore_marks_what_an_earlier_target_restored(spark):
    t = spark.createDataFrame([("e", 1, "d1", "l1"), ("e", 2, "d1", "l1"), ("e", 3, "d2", "l1"), ("f", 4, "d1", "l1")], "entity string, id long, digest string, look string")
    assert [r.status for r in snapshot.sequential_restore(t).orderBy("id").collect()] == ["restored", "already_present", "duplicate_target_skipped", "restored"]


@settings(max_examples=25, deadline=None)
@given(st.lists(st.booleans(), min_size=64, max_size=64))
def test_bits_pack_first_bit_highest(spark, bits):
    want = int("".join("01"[b] for b in bits), 2)
    got = spark.createDataFrame([(bits,)], "b array<boolean>").select(vec.pack_bits(F.col("b"))).first()[0]
    assert got & (2**64 - 1) == want


def test_zero_vectors_are_far_and_stay_zero(spark):
    df = spark.createDataFrame([([0.0, 0.0], [1.0, 0.0])], "a array<double>, b array<double>")
    row = df.select(vec.cosine_distance(F.col("a"), F.col("b")).alias("d"), *[vec.normalise(F.col("a"), g).alias(g) for g in ("floor", "keep", "one")]).first()
    assert row.d == 1.0 and row.floor == row.keep == row.one == [0.0, 0.0]


def test_boxes_suppress_by_area(spark):
    df = spark.createDataFrame([([(0.0, 0.0, 10.0, 10.0), (1.0, 1.0, 10.0, 10.0), (20.0, 20.0, 22.0, 22.0)],)], "b array<struct<x1:double,y1:double,x2:double,y2:double>>")
    assert [tuple(b) for b in df.select(vec.suppress_boxes(F.col("b"))).first()[0]] == [(0.0, 0.0, 10.0, 10.0), (20.0, 20.0, 22.0, 22.0)]


def test_labels_rules_and_names(spark):
    rows = [("", False), ("unknown", False), ("__junk__", False), ("person_003", False), ("Ann", True), (None, False)]
    df = spark.createDataFrame(rows, "label string, want boolean")
    assert all(r.got == r.want for r in df.select("want", tx.real_label(F.col("label")).alias("got")).collect())
    one = spark.createDataFrame([(1, 5)], "a int, b int")
    labels = rules.cascade([(F.col("a") == 2, "alone")], [(F.col("a") == 1, "z"), (F.col("b") == 5, "a"), (F.col("b") == 6, "no")], "plain", {"both": ["z", "a"]})
    assert one.select(labels).first()[0] == ["a", "both", "z"]
    assert one.select(tx.numbered(F.lit("p"), F.lit(12345))).first()[0] == "p_12345"


def test_stride_sample_rounds_halves_to_even(spark):
    df = spark.range(0, 11).select(F.col("id").alias("x"))
    got = sorted(r.x for r in ranking.stride_sample(df, "x", 5).collect())
    assert got == sorted({round(i * 10 / 4) for i in range(5)})
    assert ranking.stride_sample(df, "x", 0).count() == 11


def test_tolerant_readers(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"seq":1,"op":"move","status":"moved"}\n\n{broken\n')
    rows = tables.jsonl_log(spark, str(tmp_path / "a.jsonl")).collect()
    assert [(r.seq, r.status) for r in rows] == [(1, "moved")]
    (tmp_path / "b.csv").write_text("id,n\n1,5\n2,\n")
    assert [r.n for r in tables.csv_rows(spark, str(tmp_path / "b.csv"), ["id", "n"]).orderBy("id").collect()] == ["5", None]
    assert tables.file_listing(spark, str(tmp_path), "*.csv").count() == 1


def test_steps_resume_after_a_failure(spark, tmp_path):
    calls, fail = [], [True]

    def second(_):
        if fail[0]:
            raise ValueError("once")
        calls.append("b")

    steps = [("a", lambda s: calls.append("a"), None), ("b", second, None), ("c", lambda s: calls.append("c"), lambda s: False)]
    r = runner.StepRunner(spark, str(tmp_path / "state"))
    with pytest.raises(ValueError):
        r.run(steps)
    fail[0] = False
    assert r.run(steps) == {"a": "done before", "b": "ran", "c": "skipped"} and calls == ["a", "b"]
    assert r.done() == {}


def test_manifest_blocks_what_lost_entries(spark, tmp_path):
    rows = [("a", 1, 5, "t"), ("b", 1, 6, "t")]
    kind = "path string, entity long, size long, mtime string"
    full, less = spark.createDataFrame(rows, kind), spark.createDataFrame(rows[:1], kind)
    m = runner.Manifest(spark, str(tmp_path / "m"))
    assert m.init(full) == 0 and m.promote(full) == 1 and m.versions() == [0, 1]
    with pytest.raises(ValueError):
        m.promote(less)
    assert [tuple(r) for r in m.restore_plan(less).collect()] == [("b", "planned")] and m.status().first()["bytes"] == 11


def test_preflight_and_replace(spark, tmp_path):
    path = str(tmp_path / "t")
    sinks.replace_table(spark.range(3).toDF("x"), path, "1")
    backup = sinks.replace_table(spark.range(5).toDF("x"), path, "2")
    assert spark.read.parquet(path).count() == 5 and spark.read.parquet(backup).count() == 3
    assert [c for _, c, _ in runner.preflight(spark, [path, path + "none"], 0, 2000)] == ["unreadable_input", "little_memory"]
    assert runner.partitions_for(1000, 2600) == 11


def test_stream_windows_of_many_shuffled_files_equal_batch(spark, tmp_path):
    src = spark.read.parquet(f"{SF}/events.parquet")
    src.repartition(60, F.xxhash64("event_id")).write.parquet(f"{tmp_path}/events.parquet")
    e = src.withColumn("at", F.col("ts").cast("timestamp"))
    days = {(r.event_type, str(r.day), r.n) for r in e.groupBy("event_type", F.to_date("at").alias("day")).agg(F.count("*").alias("n")).collect()}
    got = streams.stream_tumbling(spark, str(tmp_path)).collect()
    assert {(r.event_type, r.day, r.n) for r in got} == days and len(got) == len(days)
    sessions = []
    for r in e.groupBy("user_id").agg(F.sort_array(F.collect_list("at")).alias("at")).collect():
        for k, at in enumerate(r["at"]):
            if k and (at - r["at"][k - 1]).total_seconds() <= 3600:
                sessions[-1][2] += 1
            else:
                sessions.append([r.user_id, at.strftime("%Y-%m-%d %H:%M:%S"), 1])
    assert sorted(map(tuple, streams.stream_sessions(spark, str(tmp_path)).collect())) == sorted(map(tuple, sessions))


def test_leaders_and_restores_of_tables_equal_brute_force(spark):
    got = {r.id: (r.keeper, r.dist) for r in fingerprints.leader_dedup(spark, SF).collect()}
    vectors = sorted((r.label, -float(r.vec_id * 37 % 101), r.vec_id, np.array(r.embedding, np.float64)) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect())
    keepers, want = {}, {}
    for label, _, i, v in vectors:
        rest = np.sort(v[1:])
        bits = v > (rest[(len(rest) - 1) // 2] + rest[len(rest) // 2]) / 2
        near = [(int((bits != other).sum()), n) for n, (_, other) in enumerate(keepers.setdefault(label, [])) if (bits != other).sum() <= 20]
        if near:
            want[i] = (keepers[label][min(near)[1]][0], min(near)[0])
        else:
            keepers[label].append((i, bits))
            want[i] = (i, 0)
    assert got == want
    digests, looks, status = {}, {}, {}
    for r in sorted(spark.read.parquet(f"{SF}/documents.parquet").collect(), key=lambda r: r.doc_id):
        d, look = digests.setdefault(r.lang, set()), looks.setdefault(r.lang, set())
        key = re.sub(r"[ \t\n\x0b\f\r]+", " ", r.text.strip(" ")).lower()
        status[r.doc_id] = "already_present" if r.text in d else "duplicate_target_skipped" if key in look else "restored"
        if status[r.doc_id] == "restored":
            d.add(r.text), look.add(key)
    assert {r.id: r.status for r in snapshots.restore_status_seq(spark, SF).collect()} == status


def test_boxes_of_tables_equal_brute_force(spark):
    boxes = {}
    for r in spark.read.parquet(f"{SF}/part.parquet").collect():
        x = float(r.p_size * 3)
        boxes.setdefault(r.p_brand, []).append((x, x, x + 10 + r.p_partkey % 13, x + 12))
    area = lambda b: (b[2] - b[0]) * (b[3] - b[1])
    want = {}
    for brand, all_ in boxes.items():
        kept = []
        for b in sorted(all_, key=lambda b: (-area(b), b)):
            inter = [max(0.0, min(b[2], k[2]) - max(b[0], k[0])) * max(0.0, min(b[3], k[3]) - max(b[1], k[1])) for k in kept]
            if all(i / (area(b) + area(k) - i) < 0.35 for i, k in zip(inter, kept, strict=True)):
                kept.append(b)
        want[brand] = (len(all_), len(kept))
    assert {r.p_brand: (r.n, r.kept) for r in scalars.nms_boxes(spark, SF).collect()} == want


def test_merges_cliques_and_splits_of_tables_equal_brute_force(spark):
    rows = sorted((r.vec_id, np.array(r.embedding, np.float64)) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect())
    unit = {i: v / np.linalg.norm(v) for i, v in rows}
    # centroids of id % 20 merge, the nearest two first
    sums = {c: sum(v for i, v in rows if i % 20 == c) / sum(i % 20 == c for i, _ in rows) for c in range(20)}
    sums = {c: v / np.linalg.norm(v) * sum(i % 20 == c for i, _ in rows) for c, v in sums.items()}
    owner = {c: c for c in sums}
    while len(sums) > 1:
        u = {c: v / np.linalg.norm(v) for c, v in sums.items()}
        d, a, b = min((1 - u[a] @ u[b], a, b) for a in u for b in u if a < b)
        if d >= 0.75:
            break
        sums[a] = sums[a] + sums.pop(b)
        owner = {c: a if o == b else o for c, o in owner.items()}
    assert {r.cluster: r.merged for r in vectors.centroid_merge(spark, SF).collect()} == owner
    # components at 0.6, then greedy cliques in order of id, and parts of four rows at most
    edges = [(a, b) for a in unit for b in unit if a < b and 1 - unit[a] @ unit[b] <= vectors.EPS]
    label = components(edges)
    groups = {}
    for i in sorted(label):
        groups.setdefault(label[i], []).append(i)
    want = {}
    for some in groups.values():
        cliques = []
        for i in some:
            fit = next((c for c in cliques if all(1 - unit[i] @ unit[j] <= vectors.EPS for j in c)), None)
            if fit is None:
                cliques.append(fit := [])
            fit.append(i)
        want |= {i: n for n, c in enumerate(cliques) for i in c}
    assert {r.id: r.clique for r in vectors.clique_split(spark, SF).collect()} == want
    parts = {}
    for r in vectors.recluster_oversize(spark, SF).collect():
        parts.setdefault((r.component, r.part), set()).add(r.id)

    def split(some, eps, level):
        if len(some) <= 4:
            return [set(some)]
        if level >= 8 or eps <= 0.012 * 1.05:
            return [set(some[k : k + 4]) for k in range(0, len(some), 4)]
        eps = max(0.012, eps * 0.62)
        inner = components([(a, b) for a in some for b in some if a <= b and 1 - unit[a] @ unit[b] <= eps])
        return [p for c in sorted(set(inner.values())) for p in split([i for i in some if inner[i] == c], eps, level + 1)]

    assert sorted(map(sorted, parts.values())) == sorted(sorted(p) for some in groups.values() for p in split(some, vectors.EPS, 0))


def test_layers_of_duplicates(spark):
    """Exact before same content before near; near rows are never moved, and a status or shape apart keeps rows apart."""
    rows = [
        (1, "s", "safe", 9, "a", "A", 0, 1.0), (2, "s", "safe", 8, "a", "A", 0, 1.0), (3, "s", "possible", 8, "a", "A", 0, 1.0), (4, "s", "safe", 7, "b", "A", 255 << 8, 1.0),
        (5, "s", "safe", 7, "c", "C", 99, 1.0), (6, "s", "safe", 9, "d", "C", 99, 1.0),
        (7, "s", "safe", 5, "e", "E", 1 << 40, 1.0), (8, "s", "safe", 6, "f", "F", (1 << 40) + 1, 1.05), (9, "s", "safe", 6, "g", "G", (1 << 40) + 1, 1.2), (10, "t", "safe", 6, "h", "H", 1 << 40, 1.0),
    ]
    df = spark.createDataFrame(rows, "id long, scope string, status string, size int, sha string, content string, hash long, aspect double")
    got = sorted(tuple(r) for r in dedup.layers(df, ["scope", "status"], [-F.col("size"), F.col("id")], 3, 0.08).collect())
    assert got == [
        (1, "exact_file", 100, "keep", 1, 1, None), (1, "exact_file", 100, "move", 1, 2, None),
        (2, "same_content", 100, "keep", 6, 6, None), (2, "same_content", 100, "move", 6, 5, None),
        (3, "similar", 94, "keep", 8, 8, 1), (3, "similar", 94, "review", 8, 7, 1),
    ]
    assert dedup.layers(df.limit(0), ["scope", "status"], [F.col("id")], 3, 0.08).count() == 0


def test_groups_beyond_one_task_are_refused(spark, monkeypatch):
    monkeypatch.setattr(cluster, "MERGED", 1)
    cents = spark.createDataFrame([(0, [1.0], 1), (1, [1.0], 1)], "cluster int, centroid array<double>, n long")
    with pytest.raises(ValueError):
        cluster.merge_centroids(cents, 0.5)


def test_actions_have_aliases_and_lists():
    actions = runner.Registry()
    actions.add("a", lambda s: None, ("x",))
    actions.add("l", ["a", "l"])
    assert actions.plan("x") == ["a"]
    for key, error in (("none", KeyError), ("l", ValueError)):
        with pytest.raises(error):
            actions.plan(key)
    with pytest.raises(ValueError):
        actions.add("x", lambda s: None)
