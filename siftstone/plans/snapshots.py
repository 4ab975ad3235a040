"""Queries on snapshots, guards, ledgers and incremental state."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftstone.catalog import query
from siftstone.functions import text as tx
from siftstone.operators import snapshot
from siftstone.sources.tables import table
from siftstone.streaming.micro import work_dir

_SNAP = """
WITH before AS (SELECT 'o/' || o_orderkey AS path, o_custkey AS entity, round(o_totalprice, 0)::BIGINT AS size, epoch_us(o_orderdate) AS mtime FROM orders WHERE o_orderkey % 10 <> 0),
after AS (SELECT 'o/' || CASE WHEN o_orderkey % 13 = 0 THEN 'moved/' ELSE '' END || o_orderkey AS path, o_custkey AS entity, round(o_totalprice, 0)::BIGINT + CASE WHEN o_orderkey % 17 = 0 THEN 1 ELSE 0 END AS size, epoch_us(o_orderdate) AS mtime FROM orders WHERE o_orderkey % 11 <> 0)
"""


def _snapshots(spark, d):
    o = table(spark, d, "orders")
    key = F.col("o_orderkey")
    size = F.round("o_totalprice", 0).cast("long")
    rest = [F.col("o_custkey").alias("entity"), F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("mtime")]
    before = o.filter(key % 10 != 0).select(F.concat(F.lit("o/"), key.cast("string")).alias("path"), size.alias("size"), *rest)
    moved = F.concat(F.lit("o/"), F.when(key % 13 == 0, "moved/").otherwise(""), key.cast("string"))
    after = o.filter(key % 11 != 0).select(moved.alias("path"), (size + F.when(key % 17 == 0, 1).otherwise(0)).alias("size"), *rest)
    return before, after


@query(
    _SNAP
    + """, j AS (SELECT coalesce(b.path, a.path) AS path, b.path AS bp, a.path AS ap, b.size AS bs, a.size AS s, coalesce(b.entity, a.entity) AS entity, b.entity AS be, b.mtime AS bm, a.entity AS ae, a.mtime AS am FROM before b FULL JOIN after a ON a.path = b.path),
m AS (SELECT *, row_number() OVER (PARTITION BY be, bs, bm ORDER BY path) AS rn FROM j WHERE ap IS NULL), x AS (SELECT *, row_number() OVER (PARTITION BY ae, s, am ORDER BY path) AS rn FROM j WHERE bp IS NULL OR s <> bs),
r AS (SELECT m.path AS old_path, x.path AS new_path FROM m JOIN x ON m.be = x.ae AND m.bs = x.s AND m.bm = x.am AND m.rn = x.rn)
SELECT path, CASE WHEN ap IS NULL THEN CASE WHEN path IN (SELECT old_path FROM r) THEN 'renamed' ELSE 'missing' END WHEN s <> bs THEN 'size_changed' ELSE 'matched' END AS status FROM j WHERE bp IS NOT NULL
UNION ALL SELECT path, 'extra' FROM x WHERE path NOT IN (SELECT new_path FROM r)"""
)
def snapshot_diff(spark, d):
    """Missing, changed, renamed, matched and extra entries."""
    return snapshot.diff(*_snapshots(spark, d))


@query(
    _SNAP
    + """, lost AS (SELECT b.* FROM before b WHERE b.path NOT IN (SELECT path FROM after)),
c AS (SELECT l.path, a.path AS cand, 1000 - CASE WHEN a.entity = l.entity THEN 200 ELSE 0 END - CASE WHEN a.mtime = l.mtime THEN 100 ELSE 0 END AS score FROM lost l JOIN after a ON a.size = l.size),
k AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY score, lower(cand)) AS rn FROM c)
SELECT path, cand, score FROM k WHERE rn = 1"""
)
def restore_candidates(spark, d):
    """The best-scored candidate for each lost entry."""
    before, after = _snapshots(spark, d)
    lost = before.join(after.select("path"), "path", "left_anti")
    score = 1000 - F.when(F.col("entity") == F.col("e2"), 200).otherwise(0) - F.when(F.col("mtime") == F.col("m2"), 100).otherwise(0)
    found = lost.join(after.select(F.col("path").alias("cand"), "size", F.col("entity").alias("e2"), F.col("mtime").alias("m2")), "size").withColumn("score", score)
    return found.groupBy("path").agg(F.min_by(F.struct("cand", "score"), F.struct("score", F.lower("cand"))).alias("m")).select("path", "m.cand", "m.score")


_MONTHS = "m AS (SELECT o_custkey AS entity, strftime(o_orderdate, '%Y-%m') AS run, count(*) AS n FROM orders GROUP BY ALL)"


def _monthly(spark, d):
    return table(spark, d, "orders").groupBy(F.col("o_custkey").alias("entity"), F.date_format("o_orderdate", "yyyy-MM").alias("run")).agg(F.count(F.lit(1)).alias("n"))


@query("WITH " + _MONTHS + ", f AS (SELECT *, max(n) OVER (PARTITION BY entity ORDER BY run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS floor FROM m) SELECT entity, run, n, floor FROM f WHERE n < floor")
def guard_violations(spark, d):
    """Counts that fall below the most seen so far."""
    return snapshot.with_floor(_monthly(spark, d), "entity", "run", "n").filter("n < floor")


@query("WITH c AS (SELECT user_id, ts::DATE AS day, count(*) AS n FROM events GROUP BY ALL) SELECT user_id, strftime(day, '%Y-%m-%d') AS day, n, max(n) OVER (PARTITION BY user_id ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS floor FROM c")
def guard_floor(spark, d):
    """The running floor itself."""
    counts = table(spark, d, "events").groupBy("user_id", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return snapshot.with_floor(counts, "user_id", "day", "n")


@query("WITH b AS (SELECT l_returnflag AS k, count(*) AS n FROM lineitem WHERE l_linenumber <= 3 GROUP BY 1), a AS (SELECT l_returnflag AS k, count(*) AS n FROM lineitem WHERE l_linenumber <= 4 GROUP BY 1) SELECT coalesce(a.k, b.k) AS metric, coalesce(a.n, 0) - coalesce(b.n, 0) AS delta FROM a FULL JOIN b ON a.k = b.k")
def snapshot_delta(spark, d):
    """After minus before, by metric."""
    rows = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("metric"))
    both = rows.agg(F.count_if(F.col("l_linenumber") <= 4).alias("a"), F.count_if(F.col("l_linenumber") <= 3).alias("b"))
    return both.filter("a > 0 or b > 0").select("metric", (F.col("a") - F.col("b")).alias("delta"))


_LEDGER = "WITH l AS (SELECT event_id AS seq, user_id, event_type, 'p' || (event_id % 97) AS src, 'p' || (event_id % 97 + 100) AS dst, CASE WHEN event_type = 'purchase' THEN 'moved' WHEN event_type = 'view' THEN 'planned' ELSE 'failed' END AS status, props FROM events)"


def _ledger(spark, d):
    e = table(spark, d, "events")
    status = F.when(F.col("event_type") == "purchase", "moved").when(F.col("event_type") == "view", "planned").otherwise("failed")
    place = (F.col("event_id") % 97).cast("int")
    return e.select(F.col("event_id").alias("seq"), "user_id", F.concat(F.lit("p"), place.cast("string")).alias("src"), F.concat(F.lit("p"), (place + 100).cast("string")).alias("dst"), status.alias("status"), "props")


@query(_LEDGER + " SELECT src, arg_max(status, seq) AS status, arg_max(dst, seq) AS dst, max(seq) AS seq, count(*) FILTER (status = 'moved') AS moves FROM l GROUP BY src")
def ledger_replay(spark, d):
    """The latest state of each path, from an append-only log."""
    return snapshot.latest_state(_ledger(spark, d), "src", "seq", ["status", "dst"], F.count_if(F.col("status") == "moved").alias("moves"))


@query(_LEDGER + ", m AS (SELECT src, dst, user_id % 3 AS file, seq FROM l WHERE status = 'moved'), w AS (SELECT src, arg_max(dst || ':' || file, -file * 1000000000 + seq) AS mapped FROM m GROUP BY src), p AS (SELECT DISTINCT src FROM l) SELECT p.src, coalesce(w.mapped, p.src) AS now FROM p LEFT JOIN w USING (src)")
def ledger_relink(spark, d):
    """Each path as the log left it; of several files the oldest (read last) wins, in a file the last line."""
    log = _ledger(spark, d)
    file = F.col("user_id") % 3
    moved = log.filter("status = 'moved'").groupBy("src").agg(F.max_by(F.concat_ws(":", "dst", file.cast("string")), F.struct(-file, "seq")).alias("mapped"))
    return log.select("src").distinct().join(moved, "src", "left").select("src", F.coalesce("mapped", "src").alias("now"))


@query("""
WITH RECURSIVE s AS (SELECT p_partkey AS a, p_partkey + 7 AS b FROM part WHERE p_partkey % 5 <> 0),
w(a, b, n) AS (SELECT a, b, 1 FROM s UNION ALL SELECT w.a, s.b, n + 1 FROM w JOIN s ON s.a = w.b)
SELECT a AS source, max(b) AS final FROM w GROUP BY a
""")
def rename_closure(spark, d):
    """Where a chain of renames ends, by doubling the steps until nothing moves."""
    steps = table(spark, d, "part").filter("p_partkey % 5 <> 0").select(F.col("p_partkey").alias("a"), (F.col("p_partkey") + 7).alias("b"))
    return snapshot.chain_ends(steps).select(F.col("a").alias("source"), F.col("b").alias("final"))


@query("WITH k AS (SELECT l_orderkey || '|' || l_linenumber AS key, l_linestatus FROM lineitem) SELECT key FROM k WHERE key NOT IN (SELECT key FROM k WHERE l_linestatus = 'F')")
def checkpoint_anti(spark, d):
    """Items without a completed key."""
    k = table(spark, d, "lineitem").select(F.concat_ws("|", "l_orderkey", "l_linenumber").alias("key"), "l_linestatus")
    return k.join(k.filter("l_linestatus = 'F'").select("key"), "key", "left_anti").select("key")


_SESSION = "r AS (SELECT doc_id AS id, CASE WHEN doc_id % 9 = 0 THEN -1 ELSE doc_id % 50 END AS cluster FROM documents), n AS (SELECT DISTINCT cluster, CASE WHEN cluster % 4 = 0 OR cluster = -1 THEN 'person_' || lpad(cluster::VARCHAR, 3, '0') ELSE 'name' || cluster % 7 END AS name FROM r)"


@query("WITH " + _SESSION + " SELECT id, cluster, name FROM r JOIN n USING (cluster) WHERE cluster <> -1 AND starts_with(name, 'person_')")
def session_remainder(spark, d):
    """A session is saved, read again, and what its named clusters leave is saved in its place."""
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 9 == 0, F.lit(-1)).otherwise(F.col("doc_id") % 50).cast("long").alias("cluster"))
    c = F.col("cluster")
    names = rows.select("cluster").distinct().withColumn("name", F.when((c % 4 == 0) | (c == -1), tx.numbered(F.lit("person"), c)).otherwise(F.concat(F.lit("name"), (c % 7).cast("string"))))
    place = work_dir(spark)
    snapshot.save_session(rows, names, f"{place}/begun")
    snapshot.save_session(*snapshot.remainder(*snapshot.load_session(spark, f"{place}/begun")), f"{place}/left")
    left, called = snapshot.load_session(spark, f"{place}/left")
    return left.join(called, "cluster").select("id", "cluster", "name")


@query("""
WITH r AS (SELECT doc_id AS id, md5(text) AS hash FROM documents), c AS (SELECT DISTINCT hash, CASE WHEN hash < '2' THEN '' ELSE 'v' || hash[1:4] END AS value FROM r WHERE hash < '8'),
k AS (SELECT r.*, c.value AS known, ('0x' || hash[9:12])::BIGINT % 7 AS m FROM r LEFT JOIN c USING (hash))
SELECT id, hash, nullif(coalesce(known, CASE WHEN m IN (0, 1, 2, 3) THEN 'c' || hash[1:4] END), '') AS value,
CASE WHEN known = '' THEN 'known_unknown' WHEN known IS NOT NULL THEN 'hit' WHEN m <= 3 THEN 'called' WHEN m = 4 THEN 'failed' WHEN m = 5 THEN 'fatal' ELSE 'unknown' END AS outcome FROM k
""")
def memo_by_hash(spark, d):
    """A costly call's answers by content hash: known ones, known unknowns, retries and fatal errors.

    The call is a stand-in: by its hash a content answers at attempt 0 to 3, never, with a fatal error, or with nothing.
    """
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.md5("text").alias("hash"))
    h = F.col("hash")
    cache = rows.filter(h < "8").select("hash").distinct().withColumn("value", F.when(h < "2", "").otherwise(F.concat(F.lit("v"), F.substring(h, 1, 4))))
    m = F.conv(F.substring(h, 9, 4), 16, 10).cast("long") % 7

    def attempt(k):
        error = F.when(m == 5, "fatal").when((m == 4) | ((m <= 3) & (m > k)), "busy")
        value = F.when(m == 6, "").when(m <= 3, F.concat(F.lit("c"), F.substring(h, 1, 4)))
        return F.struct(value.alias("value"), error.alias("error"))

    return snapshot.cache_aside(rows, cache, attempt)


@query("""
WITH h AS (SELECT doc_id, lang, n_chars FROM documents), old AS (SELECT doc_id, lang, n_chars + CASE WHEN doc_id % 9 = 0 THEN 1 ELSE 0 END AS n_chars FROM h WHERE doc_id % 2 = 0), fresh AS (SELECT * FROM h WHERE lang = 'de'),
kept AS (SELECT o.* FROM old o JOIN h USING (doc_id, n_chars) WHERE o.lang <> 'de')
SELECT doc_id, lang, 'kept' AS origin FROM kept UNION ALL SELECT doc_id, lang, 'fresh' FROM fresh
""")
def cache_merge(spark, d):
    """Existing rows stay where their signature is current; one entity is replaced as a whole."""
    h = table(spark, d, "documents").select("doc_id", "lang", "n_chars")
    old = h.filter("doc_id % 2 = 0").withColumn("n_chars", F.col("n_chars") + F.when(F.col("doc_id") % 9 == 0, 1).otherwise(0))
    kept = old.filter("lang <> 'de'").join(h.select("doc_id", "n_chars"), ["doc_id", "n_chars"], "left_semi").select("doc_id", "lang", F.lit("kept").alias("origin"))
    return kept.unionByName(h.filter("lang = 'de'").select("doc_id", "lang", F.lit("fresh").alias("origin")))


@query(_SNAP + ", s AS (SELECT count(*) FILTER (a.path IS NULL) AS missing, count(*) FILTER (a.path IS NOT NULL AND a.size <> b.size) AS changed FROM before b LEFT JOIN after a USING (path)) SELECT missing, changed, CASE WHEN missing + changed = 0 THEN 'promote' ELSE 'block' END AS verdict FROM s")
def promote_manifest(spark, d):
    """A snapshot is promoted only if nothing is missing or changed."""
    before, after = _snapshots(spark, d)
    return snapshot.verdict(before, after)


@query("""
WITH p1 AS (SELECT source, doc_id // 1000 AS p, sha256(string_agg(doc_id || ':' || n_chars, chr(10) ORDER BY doc_id)) AS sig FROM documents GROUP BY ALL), s1 AS (SELECT source, sha256(string_agg(sig, chr(10) ORDER BY p)) AS sig FROM p1 GROUP BY 1),
p2 AS (SELECT source, doc_id // 1000 AS p, sha256(string_agg(doc_id || ':' || (n_chars + CASE WHEN source = 'src3' AND doc_id % 100 = 3 THEN 1 ELSE 0 END), chr(10) ORDER BY doc_id)) AS sig FROM documents WHERE source <> 'src5' GROUP BY ALL), s2 AS (SELECT source, sha256(string_agg(sig, chr(10) ORDER BY p)) AS sig FROM p2 GROUP BY 1)
SELECT s1.source, CASE WHEN s2.sig IS NULL THEN 'new' WHEN s1.sig = s2.sig THEN 'skip' ELSE 'rebuild' END AS step FROM s1 LEFT JOIN s2 USING (source)
""")
def incremental_rebuild_set(spark, d):
    """Entities whose content signature changed since the stored state."""
    docs = table(spark, d, "documents")
    bump = F.when((F.col("source") == "src3") & (F.col("doc_id") % 100 == 3), 1).otherwise(0)
    now = snapshot.content_signature(docs, "source", "doc_id", F.col("n_chars"))
    state = snapshot.content_signature(docs.filter("source <> 'src5'"), "source", "doc_id", F.col("n_chars") + bump).withColumnRenamed("sig", "old")
    step = F.when(F.col("old").isNull(), "new").when(F.col("sig") == F.col("old"), "skip").otherwise("rebuild")
    return now.join(state.select("source", "old"), "source", "left").select("source", step.alias("step"))


@query("WITH p AS (SELECT source, doc_id // 1000 AS p, sha256(string_agg(doc_id || ':' || n_chars, chr(10) ORDER BY doc_id)) AS sig, count(*) AS n, sum(n_chars)::BIGINT AS total, max(n_chars) AS largest FROM documents GROUP BY ALL) SELECT source, sha256(string_agg(sig, chr(10) ORDER BY p)) AS sig, sum(n)::BIGINT AS n, sum(total)::BIGINT AS total, max(largest) AS largest FROM p GROUP BY 1")
def content_signature(spark, d):
    """One hash over an entity's ordered members, with count, total and maximum."""
    return snapshot.content_signature(table(spark, d, "documents"), "source", "doc_id", F.col("n_chars"), F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("total"), F.max("n_chars").alias("largest"))


@query()
def restore_status_seq(spark, d):
    """Targets in order; what one restores, the next ones find there."""
    t = table(spark, d, "documents").select(F.col("lang").alias("entity"), F.col("doc_id").alias("id"), F.md5("text").alias("digest"), F.md5(tx.match_key(F.col("text"))).alias("look"))
    return snapshot.sequential_restore(t)
