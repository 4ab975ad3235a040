"""Queries on duplicates, fingerprints and signatures of documents."""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from siftstone.catalog import query
from siftstone.functions import text as tx
from siftstone.functions import vectors as vec
from siftstone.operators import dedup
from siftstone.operators.graph import checkpointed, connected_components
from siftstone.sources.tables import table

_STATUS = "s AS (SELECT doc_id, CASE WHEN max(toxic) = 1 THEN 'possible' ELSE 'safe' END AS status FROM labels GROUP BY 1)"
_EXACT = (
    "WITH "
    + _STATUS
    + """, h AS (SELECT doc_id AS id, {scope} AS scope, coalesce(status, 'safe') AS status, n_chars, sha256(text) AS hash FROM documents LEFT JOIN s USING (doc_id)),
g AS (SELECT *, count(*) OVER (PARTITION BY scope, status, hash) AS n, first_value(id) OVER (PARTITION BY scope, status, hash ORDER BY n_chars DESC, id) AS keeper FROM h)
SELECT scope, status, hash, id, keeper, n, 'exact_file' AS kind, 100 AS confidence, CASE WHEN id = keeper THEN 'keep' ELSE 'move' END AS action FROM g WHERE n > 1
"""
)


def _with_status(spark, d, *columns):
    """Documents (id, status, columns): the status comes from the labels, safe without one."""
    lab = table(spark, d, "labels").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    docs = table(spark, d, "documents").select("doc_id", F.col("doc_id").alias("id"), *columns)
    return docs.join(lab, "doc_id", "left").withColumn("status", F.when(F.col("toxic") == 1, "possible").otherwise("safe")).drop("doc_id", "toxic")


def _hashed(spark, d, scope):
    return _with_status(spark, d, scope.alias("scope"), "n_chars", F.sha2("text", 256).alias("hash"))


def _by_size():
    return [-F.col("n_chars"), F.col("id")]


@query(_EXACT.format(scope="lang"))
def dedup_exact_scoped(spark, d):
    """Exact duplicates within a scope and a status."""
    return dedup.duplicate_groups(_hashed(spark, d, F.col("lang")), ["scope", "status", "hash"], _by_size(), "exact_file", 100)


@query(_EXACT.format(scope="'__global__'"))
def dedup_exact_global(spark, d):
    """The same over all scopes."""
    return dedup.duplicate_groups(_hashed(spark, d, F.lit("__global__")), ["scope", "status", "hash"], _by_size(), "exact_file", 100)


@query("""
WITH h AS (SELECT doc_id AS id, source, lang, n_chars, sha256(text) AS hash FROM documents),
g AS (SELECT *, count(*) OVER (PARTITION BY hash) AS n, first_value(id) OVER (PARTITION BY hash ORDER BY CASE WHEN source IN ('src1', 'src2') THEN 1 ELSE 0 END, length(source), source, id) AS keeper FROM h)
SELECT hash, id, keeper, n, 'exact_file' AS kind, 100 AS confidence, CASE WHEN id = keeper THEN 'keep' ELSE 'already_linked' END AS action FROM g WHERE n > 1
""")
def dedup_keeper_actions(spark, d):
    """A keeper by penalties, depth and path instead of size."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "source", F.sha2("text", 256).alias("hash"))
    rank = [F.when(F.col("source").isin("src1", "src2"), 1).otherwise(0), F.length("source"), F.col("source"), F.col("id")]
    return dedup.duplicate_groups(docs, ["hash"], rank, "exact_file", 100, other="already_linked")


@query(
    "WITH "
    + _STATUS
    + """, h AS (SELECT doc_id AS id, lang AS scope, coalesce(status, 'safe') AS status, n_chars, sha256(text) AS sha, sha256(lower(regexp_replace(trim(text), '\\s+', ' ', 'g'))) AS hash FROM documents LEFT JOIN s USING (doc_id)),
e AS (SELECT *, count(*) OVER (PARTITION BY scope, status, sha) AS ne FROM h),
g AS (SELECT *, count(*) OVER (PARTITION BY scope, status, hash) AS n, first_value(id) OVER (PARTITION BY scope, status, hash ORDER BY n_chars DESC, id) AS keeper FROM e WHERE ne = 1)
SELECT scope, status, hash, id, keeper, n, 'same_content' AS kind, 100 AS confidence, CASE WHEN id = keeper THEN 'keep' ELSE 'move' END AS action FROM g WHERE n > 1
"""
)
def dedup_canonical_layer(spark, d):
    """Rows whose whole texts are equal but for case and white space, without members of exact groups."""
    docs = _with_status(spark, d, F.col("lang").alias("scope"), "n_chars", F.sha2("text", 256).alias("sha"), F.sha2(tx.match_key(F.col("text")), 256).alias("hash"))
    single = docs.groupBy("scope", "status", "sha").agg(F.count(F.lit(1)).alias("ne")).filter("ne = 1")
    rest = docs.join(single, ["scope", "status", "sha"], "left_semi")
    return dedup.duplicate_groups(rest, ["scope", "status", "hash"], _by_size(), "same_content", 100)


@query("""
WITH h AS (SELECT md5(text) AS hash, doc_id AS id, CASE WHEN source = 'src1' THEN 1 ELSE 0 END AS review, CASE WHEN source = 'src2' THEN 1 ELSE 0 END AS duplicate, CASE WHEN lang = 'de' THEN 1 ELSE 0 END AS blurred, n_chars AS pixels, doc_id % 3 AS links, CASE WHEN source IN ('src3', 'src4') THEN 1 ELSE 0 END AS inbox, length(source) AS depth, source || '/' || doc_id AS path FROM documents)
SELECT hash, count(*) AS n, first(id ORDER BY review, duplicate, blurred, pixels DESC, path, id) AS by_review, first(id ORDER BY duplicate, blurred, links DESC, path, id) AS by_links, first(id ORDER BY inbox, depth, path, id) AS by_place, first(id ORDER BY duplicate, blurred, path, id) AS by_penalty, first(id ORDER BY depth, path, pixels DESC, id) AS by_depth FROM h GROUP BY hash HAVING count(*) > 1
""")
def keeper_orders(spark, d):
    """The keeper of each group of equal texts under each of the five orders."""
    flag = lambda c: F.when(c, 1).otherwise(0)
    source = F.col("source")
    rows = table(spark, d, "documents").select(
        F.md5("text").alias("hash"),
        F.col("doc_id").alias("id"),
        flag(source == "src1").alias("review"),
        flag(source == "src2").alias("duplicate"),
        flag(F.col("lang") == "de").alias("blurred"),
        F.col("n_chars").alias("pixels"),
        (F.col("doc_id") % 3).alias("links"),
        flag(source.isin("src3", "src4")).alias("inbox"),
        F.length("source").alias("depth"),
        F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("path"),
    )
    return dedup.keepers(rows, ["hash"])


#: Tokens whose bits a worker keeps at most.
TOKENS = 200_000


def _simhashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, scope, hash) of rows (id, scope, text); texts without tokens have none. A token's bits are the first 64 of its md5."""
    at: dict[str, int] = {}
    bits = np.zeros((TOKENS, 64), np.float32)  # sums of whole numbers below 2**24 are exact; larger ones are taken in doubles
    for batch in batches:
        ids, out = [], []
        for k, text in enumerate(batch.column("text")):
            counts = Counter(text.as_py().split(" "))
            counts.pop("", None)
            if not counts:
                continue
            n, sums, tokens = sum(counts.values()), np.zeros(64), list(counts)
            for start in range(0, len(tokens), TOKENS // 2):
                some = tokens[start : start + TOKENS // 2]
                new = [t for t in some if t not in at]
                if len(at) + len(new) > TOKENS:
                    at.clear()
                    new = some
                if new:
                    digests = b"".join(hashlib.md5(t.encode()).digest()[:8] for t in new)
                    bits[len(at) : len(at) + len(new)] = np.unpackbits(np.frombuffer(digests, np.uint8)).reshape(-1, 64)
                    at.update(zip(new, range(len(at), len(at) + len(new)), strict=True))
                weights = np.fromiter((counts[t] for t in some), np.float32 if n < 1 << 24 else np.float64, len(some))
                sums += weights @ bits[[at[t] for t in some]]
            ids.append(k)
            out.append(2 * sums > n)
        hashes = np.packbits(np.array(out, bool).reshape(-1, 64), axis=1).view(">i8").ravel().astype(np.int64)
        kept = batch.take(pa.array(ids, pa.int64()))
        yield pa.RecordBatch.from_arrays([kept.column("id"), kept.column("scope"), pa.array(hashes)], ["id", "scope", "hash"])


def token_simhash(docs):
    """(id, scope, hash): a 64-bit SimHash of space-separated tokens, weighted by their counts.

    Each text is hashed where it is read. Rows of one id and scope count as one text; only such texts are shuffled.
    """
    texts = docs.select(F.col("doc_id").alias("id"), F.col("lang").alias("scope"), F.lower("text").alias("text")).filter("text is not null")
    kind = dict(texts.dtypes)
    schema = f"id {kind['id']}, scope string, hash long"
    again = checkpointed(texts.groupBy("id", "scope").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select(F.col("id").alias("_id"), F.col("scope").alias("_scope")))
    if again.isEmpty():
        return texts.mapInArrow(_simhashes, schema)
    same = F.col("id").eqNullSafe(F.col("_id")) & F.col("scope").eqNullSafe(F.col("_scope"))
    merged = texts.join(again, same, "left_semi").groupBy("id", "scope").agg(F.array_join(F.collect_list("text"), " ").alias("text"))
    return texts.join(again, same, "left_anti").unionByName(merged).mapInArrow(_simhashes, schema)


def _stored_simhash(spark, d):
    """The hashes, written once: both sides of the pair join read them."""
    return checkpointed(token_simhash(table(spark, d, "documents")))


_SIMHASH = """
WITH tokens AS (SELECT doc_id AS id, lang AS scope, unnest(string_split(lower(text), ' ')) AS t FROM documents),
counts AS (SELECT id, scope, t, count(*) AS tf, ('0x' || substring(md5(t), 1, 8))::BIGINT AS w0, ('0x' || substring(md5(t), 9, 8))::BIGINT AS w1 FROM tokens WHERE t <> '' GROUP BY ALL),
bits AS (SELECT id, scope, b, sum(tf * (2 * ((w0 >> b) & 1) - 1)) AS s0, sum(tf * (2 * ((w1 >> b) & 1) - 1)) AS s1 FROM counts, (SELECT unnest(range(32))::INT AS b) GROUP BY ALL),
fp AS (SELECT id, scope, sum(CASE WHEN s0 > 0 THEN 1::BIGINT << b ELSE 0 END)::BIGINT AS hi, sum(CASE WHEN s1 > 0 THEN 1::BIGINT << b ELSE 0 END)::BIGINT AS lo FROM bits GROUP BY ALL),
pairs AS (SELECT x.id AS a, y.id AS b, bit_count(xor(x.hi, y.hi)) + bit_count(xor(x.lo, y.lo)) AS dist FROM fp x JOIN fp y ON x.scope = y.scope AND x.id < y.id)
"""


@query(_SIMHASH + "SELECT a, b, dist::BIGINT AS dist FROM pairs WHERE dist <= 3")
def near_pairs_hamming(spark, d):
    """Pairs within 3 bits, by pairs of five segments. Copies meet as one class; all their pairs are in the result."""
    return dedup.all_hamming_pairs(_stored_simhash(spark, d), 3, ["scope"]).withColumn("dist", F.col("dist").cast("long"))


@query(
    _SIMHASH.replace("WITH ", "WITH RECURSIVE ", 1).replace("pairs AS (SELECT x.id AS a, y.id AS b,", "near0 AS (SELECT x.id AS a, y.id AS b,")
    + ", "
    + _STATUS
    + """, d AS (SELECT doc_id AS id, lang AS scope, coalesce(status, 'safe') AS status, n_chars, sha256(text) AS sha, sha256(lower(regexp_replace(trim(text), '\\s+', ' ', 'g'))) AS content, n_chars / len(string_split(text, ' ')) AS aspect FROM documents LEFT JOIN s USING (doc_id)),
e AS (SELECT *, count(*) OVER (PARTITION BY scope, status, sha) AS ne, first_value(id) OVER (PARTITION BY scope, status, sha ORDER BY n_chars DESC, id) AS ke FROM d),
c AS (SELECT *, count(*) OVER (PARTITION BY scope, status, content) AS nc, first_value(id) OVER (PARTITION BY scope, status, content ORDER BY n_chars DESC, id) AS kc FROM e WHERE ne = 1),
r AS (SELECT * FROM c WHERE nc = 1),
pairs AS (SELECT a, b, dist, abs(x.aspect - y.aspect) <= 0.08 AS fits FROM near0 JOIN r x ON x.id = a JOIN r y ON y.id = b WHERE dist <= 3 AND x.status = y.status),
l AS (SELECT a, b FROM pairs WHERE fits),
walk(node, seen) AS (SELECT a, a FROM l UNION SELECT b, b FROM l UNION SELECT w.node, CASE WHEN l.a = w.seen THEN l.b ELSE l.a END FROM walk w JOIN l ON l.a = w.seen OR l.b = w.seen),
comp AS (SELECT node AS id, min(seen) AS component FROM walk GROUP BY node),
least AS (SELECT x.component, min(dist) AS dist FROM pairs JOIN comp x ON x.id = a JOIN comp y ON y.id = b WHERE x.component = y.component GROUP BY 1),
n AS (SELECT r.id, component, dist, first_value(r.id) OVER (PARTITION BY component ORDER BY n_chars DESC, r.id) AS kn FROM r JOIN comp ON comp.id = r.id JOIN least USING (component)),
u AS (SELECT 0 AS layer, scope || '|' || status || '|' || sha AS grp, 'exact_file' AS kind, 100 AS confidence, ke AS keeper, id, NULL::INT AS dist, 'move' AS other FROM e WHERE ne > 1
UNION ALL SELECT 1, scope || '|' || status || '|' || content, 'same_content', 100, kc, id, NULL, 'move' FROM c WHERE nc > 1 UNION ALL SELECT 2, component::VARCHAR, 'similar', greatest(70, 98 - 4 * dist)::INT, kn, id, dist::INT, 'review' FROM n),
g AS (SELECT *, min(id) OVER (PARTITION BY layer, grp) AS first FROM u)
SELECT dense_rank() OVER (ORDER BY layer, first, grp) AS group_id, kind, confidence, CASE WHEN id = keeper THEN 'keep' ELSE other END AS action, keeper, id, dist FROM g"""
)
def dedup_layered(spark, d):
    """Exact, same content and similar in one report, each without what stands above it."""
    docs = _with_status(spark, d, F.col("lang").alias("scope"), "n_chars", F.sha2("text", 256).alias("sha"), F.sha2(tx.match_key(F.col("text")), 256).alias("content"), (F.col("n_chars") / F.size(F.split("text", " "))).alias("aspect"))
    hashes = token_simhash(table(spark, d, "documents")).select("id", "hash")
    return dedup.layers(docs.join(hashes, "id", "left").withColumn("hash", F.coalesce("hash", F.lit(0).cast("long"))), ["scope", "status"], _by_size(), 3, 0.08)


@query(
    _SIMHASH.replace("WITH ", "WITH RECURSIVE ", 1)
    + """, e AS (SELECT a, b, dist FROM pairs WHERE dist <= 3),
walk(node, seen) AS (SELECT a, a FROM e UNION SELECT b, b FROM e UNION SELECT w.node, CASE WHEN e.a = w.seen THEN e.b ELSE e.a END FROM walk w JOIN e ON e.a = w.seen OR e.b = w.seen),
c AS (SELECT node, min(seen) AS component FROM walk GROUP BY node),
m AS (SELECT c.component, min(e.dist) AS d FROM e JOIN c ON c.node = e.a GROUP BY c.component)
SELECT node AS id, component, greatest(70, 98 - 4 * d)::INT AS confidence FROM c JOIN m USING (component)"""
)
def near_components(spark, d):
    """Components of near pairs; the confidence comes from a group's least distance.

    Rows of one hash are a class, so a crowd of copies is one row of the pair join.
    """
    members, classes = dedup.hash_classes(_stored_simhash(spark, d), ["scope"])
    pairs = checkpointed(dedup.hamming_pairs(classes, 3, ["scope"]))
    linked = connected_components(pairs.select(F.col("a").alias("u"), F.col("b").alias("v"))).withColumnRenamed("node", "id")
    named = classes.join(linked, "id", "left").filter("component is not null or n > 1").select(F.col("id").alias("class"), "n", F.coalesce("component", "id").alias("component"))
    named = checkpointed(named)
    near = pairs.join(named.select(F.col("class").alias("a"), "component"), "a").select("component", "dist").unionByName(named.filter("n > 1").select("component", F.lit(0).alias("dist")))
    least = near.groupBy("component").agg(F.min("dist").alias("d"))
    tiers = named.join(least, "component").select("class", "component", F.greatest(F.lit(70), 98 - 4 * F.col("d")).cast("int").alias("confidence"))
    return members.join(tiers, "class").select("id", "component", "confidence")


@query("""
WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
m AS (SELECT vec_id, v, list_sort(v[2:])[32] AS med FROM e),
b AS (SELECT vec_id, i, CASE WHEN v[i] > med THEN 1 ELSE 0 END AS bit FROM m, (SELECT unnest(range(1, 65)) AS i))
SELECT vec_id, printf('%08x', sum(CASE WHEN i <= 32 THEN bit::BIGINT << (32 - i)::INT ELSE 0 END)::BIGINT) || printf('%08x', sum(CASE WHEN i > 32 THEN bit::BIGINT << (64 - i)::INT ELSE 0 END)::BIGINT) AS hash FROM b GROUP BY vec_id
""")
def sign_hash(spark, d):
    """V5 V6: 64 bits of a vector against its median, packed first bit highest."""
    packed = vec.pack_bits(vec.sign_bits(vec.doubles(F.col("embedding"))))
    return table(spark, d, "embeddings").select("vec_id", F.lower(F.lpad(F.hex(packed), 16, "0")).alias("hash"))


@query()
def leader_dedup(spark, d):
    """Greedy leaders by score within a label."""
    rows = table(spark, d, "embeddings").select(F.col("label"), F.col("vec_id").alias("id"), F.pmod(F.col("vec_id") * 37, F.lit(101)).cast("double").alias("score"), vec.pack_bits(vec.sign_bits(vec.doubles(F.col("embedding")))).alias("hash"))
    return dedup.leader_dedup(rows, "label", 20)


_INTAKE = """
WITH h AS (SELECT doc_id, lang, sha256(text) AS hash FROM documents), r AS (SELECT DISTINCT lang, hash FROM h WHERE doc_id % 2 = 0)
SELECT doc_id, lang, hash FROM h WHERE doc_id % 2 = 1 AND (lang, hash) {word} (SELECT lang, hash FROM r)
"""


def _intake(spark, d, how):
    hashed = table(spark, d, "documents").select("doc_id", "lang", F.sha2("text", 256).alias("hash"))
    known = hashed.filter("doc_id % 2 = 0").select("lang", "hash").distinct()
    return hashed.filter("doc_id % 2 = 1").join(known, ["lang", "hash"], how).select("doc_id", "lang", "hash")


@query(_INTAKE.format(word="NOT IN"))
def intake_dedupe_kept(spark, d):
    """Incoming rows whose content no reference row of their status has."""
    return _intake(spark, d, "left_anti")


@query(_INTAKE.format(word="IN"))
def intake_dedupe_dropped(spark, d):
    """Incoming duplicates."""
    return _intake(spark, d, "left_semi")


@query("""
WITH now AS (SELECT doc_id, n_chars AS size, md5(text) AS sig FROM documents),
old AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN n_chars + 1 ELSE n_chars END AS size, md5(text) AS sig FROM documents WHERE doc_id % 5 <> 0)
SELECT n.doc_id, CASE WHEN o.doc_id IS NULL THEN 'new' WHEN n.size = o.size AND n.sig = o.sig THEN 'hit' ELSE 'changed' END AS state FROM now n LEFT JOIN old o USING (doc_id)
""")
def cache_hit_miss(spark, d):
    """Rows by what a store has of them."""
    now = table(spark, d, "documents").select("doc_id", F.col("n_chars").alias("size"), F.md5("text").alias("sig"))
    old = now.filter("doc_id % 5 <> 0").select("doc_id", F.when(F.col("doc_id") % 7 == 0, F.col("size") + 1).otherwise(F.col("size")).alias("old_size"), F.col("sig").alias("old_sig"))
    same = (F.col("size") == F.col("old_size")) & (F.col("sig") == F.col("old_sig"))
    return now.join(old, "doc_id", "left").select("doc_id", F.when(F.col("old_sig").isNull(), "new").when(same, "hit").otherwise("changed").alias("state"))


@query("""
WITH now AS (SELECT doc_id, n_chars AS size, sha256(text) AS hash FROM documents),
old AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN n_chars + 1 ELSE n_chars END AS size, 'stored' || doc_id AS hash FROM documents WHERE doc_id % 5 <> 0)
SELECT n.doc_id, coalesce(o.hash, n.hash) AS hash, o.hash IS NOT NULL AS from_store FROM now n LEFT JOIN old o ON n.doc_id = o.doc_id AND n.size = o.size
""")
def fingerprint_cache_through(spark, d):
    """Stored fingerprints where the signature holds; only the rest is hashed."""
    now = table(spark, d, "documents").select("doc_id", F.col("n_chars").alias("size"), "text")
    old = now.filter("doc_id % 5 <> 0").select("doc_id", F.when(F.col("doc_id") % 7 == 0, F.col("size") + 1).otherwise(F.col("size")).alias("size"), F.concat(F.lit("stored"), F.col("doc_id").cast("string")).alias("stored"))
    hits = now.select("doc_id", "size").join(old, ["doc_id", "size"]).select("doc_id", F.col("stored").alias("hash"), F.lit(True).alias("from_store"))
    misses = now.join(old.select("doc_id", "size"), ["doc_id", "size"], "left_anti").select("doc_id", F.sha2("text", 256).alias("hash"), F.lit(False).alias("from_store"))
    return hits.unionByName(misses)


@query("""
SELECT sha256(text) AS hash, min(lower(source || '/' || doc_id)) AS path, count(*) AS n FROM documents GROUP BY 1 HAVING bool_and(source IN ('src1', 'src2', 'src3', 'src4'))
""")
def generated_only(spark, d):
    """Contents all of whose copies stand in generated places, with the least path."""
    place = F.lower(F.concat_ws("/", "source", F.col("doc_id").cast("string")))
    groups = table(spark, d, "documents").groupBy(F.sha2("text", 256).alias("hash")).agg(F.bool_and(F.col("source").isin("src1", "src2", "src3", "src4")).alias("all_generated"), F.min(place).alias("path"), F.count(F.lit(1)).alias("n"))
    return groups.filter("all_generated").select("hash", "path", "n")


@query("""
WITH h AS (SELECT doc_id, n_chars, sha1(text) AS hash FROM documents), a AS (SELECT * FROM h WHERE doc_id % 3 = 0), b AS (SELECT * FROM h WHERE doc_id % 3 <> 0)
SELECT b.doc_id AS doc_id, min(a.doc_id) AS match FROM b JOIN a ON a.n_chars = b.n_chars AND a.hash = b.hash GROUP BY b.doc_id
""")
def size_blocked_hash_join(spark, d):
    """Contents are hashed only where the other side has a row of the same size."""
    docs = table(spark, d, "documents").select("doc_id", "n_chars", "text")
    left, right = docs.filter("doc_id % 3 <> 0"), docs.filter("doc_id % 3 = 0")
    hashed = lambda x, y, name: x.join(y.select("n_chars").distinct(), "n_chars", "left_semi").select(F.col("doc_id").alias(name), "n_chars", F.sha1("text").alias("hash"))
    return hashed(left, right, "doc_id").join(hashed(right, left, "match"), ["n_chars", "hash"]).groupBy("doc_id").agg(F.min("match").alias("match"))


@query("""
WITH h AS (SELECT doc_id, n_chars, sha1(text) AS hash FROM documents), live AS (SELECT * FROM h WHERE doc_id % 4 = 0)
SELECT h.doc_id, CASE WHEN h.doc_id IN (SELECT doc_id + 1 FROM live) THEN 'covered_by_key' WHEN h.hash IN (SELECT hash FROM live) THEN 'covered_by_hash' ELSE 'would_recover' END AS status FROM h WHERE doc_id % 4 <> 0
""")
def coverage_two_key(spark, d):
    """Covered by one key, else by the other, else not; two joins instead of one with OR."""
    h = table(spark, d, "documents").select("doc_id", F.sha1("text").alias("hash"))
    live = h.filter("doc_id % 4 = 0")
    by_key = live.select((F.col("doc_id") + 1).alias("doc_id"), F.lit(True).alias("k"))
    by_hash = live.select("hash", F.lit(True).alias("c")).distinct()
    out = h.filter("doc_id % 4 <> 0").join(by_key, "doc_id", "left").join(by_hash, "hash", "left")
    return out.select("doc_id", F.when(F.col("k"), "covered_by_key").when(F.col("c"), "covered_by_hash").otherwise("would_recover").alias("status"))


@query("""
WITH h AS (SELECT doc_id, lang, n_chars, md5(text) AS sig FROM documents), old AS (SELECT * FROM h WHERE doc_id % 2 = 0), new AS (SELECT * FROM h WHERE doc_id % 2 = 1)
SELECT DISTINCT n.doc_id AS new_id, o.doc_id AS old_id, n.lang FROM new n JOIN old o ON n.sig = o.sig AND n.n_chars = o.n_chars AND lower(n.lang) = lower(o.lang)
""")
def relink_signature(spark, d):
    """Rows relinked to stored ones by content and agreeing labels."""
    h = table(spark, d, "documents").select("doc_id", F.lower("lang").alias("lang"), "n_chars", F.md5("text").alias("sig"))
    return h.filter("doc_id % 2 = 1").withColumnRenamed("doc_id", "new_id").join(h.filter("doc_id % 2 = 0").withColumnRenamed("doc_id", "old_id"), ["sig", "n_chars", "lang"]).select("new_id", "old_id", "lang").distinct()


@query("""
WITH h AS (SELECT doc_id, lang, source, n_chars, md5(text) AS sig FROM documents),
m AS (SELECT t.doc_id, c.doc_id AS cand, (c.lang = t.lang) AS same FROM h t JOIN h c ON c.sig = t.sig WHERE t.doc_id % 2 = 0 AND c.doc_id % 2 = 1),
f AS (SELECT *, bool_or(same) OVER (PARTITION BY doc_id) AS any_same FROM m)
SELECT doc_id, cand, same FROM f WHERE same OR NOT any_same
""")
def label_restricted_join(spark, d):
    """Matches with an agreeing label only, or all of a row that has none."""
    h = table(spark, d, "documents").select("doc_id", "lang", F.md5("text").alias("sig"))
    m = h.filter("doc_id % 2 = 0").join(h.filter("doc_id % 2 = 1").select(F.col("doc_id").alias("cand"), F.col("lang").alias("cand_lang"), "sig"), "sig").withColumn("same", F.col("lang") == F.col("cand_lang"))
    some = m.groupBy("doc_id").agg(F.bool_or("same").alias("any_same"))
    return m.join(some, "doc_id").filter("same or not any_same").select("doc_id", "cand", "same")


@query("""
WITH lab AS (SELECT DISTINCT l.doc_id, l.quality AS label, md5(d.text) AS sig FROM labels l JOIN documents d USING (doc_id)),
live AS (SELECT doc_id, md5(text) AS sig FROM documents WHERE doc_id % 3 <> 0),
best AS (SELECT sig, min(doc_id) AS src FROM live GROUP BY sig)
SELECT lab.doc_id, label, CASE WHEN lab.doc_id IN (SELECT doc_id FROM live) THEN 'already_present' WHEN best.src IS NOT NULL THEN 'recover' ELSE 'missing' END AS status,
  CASE WHEN lab.doc_id NOT IN (SELECT doc_id FROM live) THEN best.src END AS src FROM lab LEFT JOIN best USING (sig)
""")
def labelled_recovery(spark, d):
    """Labelled rows that are there, can be had from an equal one, or are lost."""
    docs = table(spark, d, "documents").select("doc_id", F.md5("text").alias("sig"))
    lab = table(spark, d, "labels").select("doc_id", F.col("quality").alias("label")).join(docs, "doc_id").distinct()
    live = docs.filter("doc_id % 3 <> 0")
    best = live.groupBy("sig").agg(F.min("doc_id").alias("src"))
    there = live.select("doc_id", F.lit(True).alias("there"))
    out = lab.join(there, "doc_id", "left").join(best, "sig", "left")
    return out.select("doc_id", "label", F.when(F.col("there"), "already_present").when(F.col("src").isNotNull(), "recover").otherwise("missing").alias("status"), F.when(F.col("there").isNull(), F.col("src")).alias("src"))
