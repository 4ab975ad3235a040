"""Queries on embedding vectors: centroids, matches, clusters."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftstone.catalog import query
from siftstone.functions import text as tx
from siftstone.functions import vectors as vec
from siftstone.operators import cluster, match, ranking
from siftstone.operators.graph import checkpointed, connected_components, small
from siftstone.sources.tables import table

EPS = 0.60
_DOT = "list_dot_product({a}, {b})"
_V = "e AS (SELECT vec_id AS id, label, embedding::DOUBLE[] AS v, 1.0 + vec_id % 5 AS w FROM embeddings)"
_CENT = "x AS (SELECT {g} AS g, i, sum({w} * v[i]) / sum({w}) AS m FROM {f}, (SELECT unnest(range(1, 65)) AS i) WHERE {where} GROUP BY ALL), c AS (SELECT g, list(m / nrm ORDER BY i) AS c FROM (SELECT *, sqrt(sum(m * m) OVER (PARTITION BY g)) AS nrm FROM x) GROUP BY g)"
_PAIRS = "p AS (SELECT a.id AS a, b.id AS b, 1 - " + _DOT.format(a="a.v", b="b.v") + " / sqrt(" + _DOT.format(a="a.v", b="a.v") + " * " + _DOT.format(a="b.v", b="b.v") + ") AS dist FROM e a JOIN e b ON a.id < b.id)"


def _rows(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label", vec.doubles(F.col("embedding")).alias("v"))


def _cent(df, weight=None):
    return match.centroids(df, "label", "v", weight)


@query("WITH " + _V + ", " + _CENT.format(g="label", w="1.0", f="e", where="true") + " SELECT g AS label, i AS pos, round(c[i], 6) AS x FROM c, (SELECT unnest(range(1, 65)) AS i)")
def centroids_mean(spark, d):
    """Unit mean vector of each label."""
    return _cent(_rows(spark, d)).select("label", F.posexplode("centroid").alias("p", "c")).select("label", (F.col("p") + 1).cast("long").alias("pos"), F.round("c", 6).alias("x"))


@query("WITH " + _V + ", " + _CENT.format(g="label", w="w", f="e", where="true") + " SELECT g AS label, i AS pos, round(c[i], 6) AS x FROM c, (SELECT unnest(range(1, 65)) AS i)")
def centroids_weighted(spark, d):
    """A10: the same weighted by quality."""
    return _cent(_rows(spark, d), 1.0 + F.col("id") % 5).select("label", F.posexplode("centroid").alias("p", "c")).select("label", (F.col("p") + 1).cast("long").alias("pos"), F.round("c", 6).alias("x"))


@query("WITH " + _V + ", r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY id) AS k FROM e), f AS (SELECT * FROM r WHERE k <= 30 AND label IN (SELECT label FROM r WHERE k <= 30 GROUP BY 1 HAVING count(*) >= 5)), " + _CENT.format(g="label", w="1.0", f="f", where="true") + " SELECT g AS label, i AS pos, round(c[i], 6) AS x FROM c, (SELECT unnest(range(1, 65)) AS i)")
def centroids_capped(spark, d):
    """Means of the first 30 rows of each label that has five or more."""
    cent = match.centroids(_rows(spark, d), "label", "v", least=5, first=("id", 30))
    return cent.select("label", F.posexplode("centroid").alias("p", "c")).select("label", (F.col("p") + 1).cast("long").alias("pos"), F.round("c", 6).alias("x"))


@query("SELECT vec_id AS id, CASE vec_id % 9 WHEN 0 THEN 'ann' WHEN 1 THEN 'cara' WHEN 2 THEN 'cara' WHEN 3 THEN 'dora' WHEN 4 THEN 'cara' ELSE 'n' || vec_id % 9 END AS name FROM embeddings")
def cluster_commands(spark, d):
    """Names after a session's commands: clusters merged and renamed, one after another."""
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.concat(F.lit("n"), (F.col("vec_id") % 9).cast("string")).alias("name"))
    return cluster.commanded(rows, "name", [("rename", "n0", "ann"), ("merge", "n1", "n2"), ("rename", "n2", "cara"), ("rename", "n3", "dora"), ("merge", "n4", "n1")])


@query("""
WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), m AS (SELECT u * 8 + w AS k, x * 8 + y AS n, sqrt(CASE u WHEN 0 THEN 1 ELSE 2 END / 8.0) * cos(pi() * (2 * x + 1) * u / 16) * sqrt(CASE w WHEN 0 THEN 1 ELSE 2 END / 8.0) * cos(pi() * (2 * y + 1) * w / 16) AS c FROM range(8) a(u), range(8) b(w), range(8) p(x), range(8) q(y)),
t AS (SELECT vec_id, k, sum(v[n + 1] * c) AS s FROM e, m GROUP BY ALL), h AS (SELECT *, median(s) FILTER (k > 0) OVER (PARTITION BY vec_id) AS med FROM t)
SELECT vec_id, printf('%08x', sum(CASE WHEN k < 32 AND s > med THEN 1::BIGINT << (31 - k)::INT ELSE 0 END)::BIGINT) || printf('%08x', sum(CASE WHEN k >= 32 AND s > med THEN 1::BIGINT << (63 - k)::INT ELSE 0 END)::BIGINT) AS hash FROM h GROUP BY 1
""")
def dct_hash(spark, d):
    """V6 V5: 64 bits of a vector's 8 x 8 cosine transform against the median of all but the first coefficient."""
    weights = F.broadcast(spark.createDataFrame(vec.cosine_transform(8), "k int, pos int, c double"))  # 4,096 rows
    each = _rows(spark, d).select(F.col("id").alias("vec_id"), F.posexplode("v").alias("pos", "x")).join(weights, "pos")
    sums = each.groupBy("vec_id", "k").agg(F.sum(F.col("x") * F.col("c")).alias("s"))
    coefficients = F.transform(F.array_sort(F.collect_list(F.struct("k", "s"))), lambda p: p["s"])
    rows = sums.groupBy("vec_id").agg(coefficients.alias("t"))
    return rows.select("vec_id", F.lower(F.lpad(F.hex(vec.pack_bits(vec.sign_bits(F.col("t")))), 16, "0")).alias("hash"))


_FIT = "WITH " + _V + ", " + _CENT.format(g="label", w="1.0", f="e", where="id % 2 = 0")
_DIST = ", q AS (SELECT e.id, c.g AS tid, 1 - " + _DOT.format(a="e.v", b="c.c") + " / sqrt(" + _DOT.format(a="e.v", b="e.v") + ") AS dist FROM e JOIN c ON true WHERE id % 2 = 1)"


def _split(spark, d):
    rows = _rows(spark, d)
    fit = _cent(rows.filter("id % 2 = 0")).select(F.col("label").alias("tid"), F.col("centroid").alias("t"))
    return rows.filter("id % 2 = 1").select("id", "v"), fit


@query(_FIT + _DIST + " SELECT id, arg_min(tid, dist) AS tid, round(min(dist), 6) AS dist FROM q GROUP BY id HAVING min(dist) <= 0.8")
def nearest_centroid(spark, d):
    """The nearest centroid within a limit."""
    rows, fit = _split(spark, d)
    return match.nearest(rows, fit, 0.8).withColumn("dist", F.round("dist", 6))


@query("WITH " + _V + ", q AS (SELECT r.id, a.id AS anchor, a.label, 1 - " + _DOT.format(a="r.v", b="a.v") + " / sqrt(" + _DOT.format(a="r.v", b="r.v") + " * " + _DOT.format(a="a.v", b="a.v") + ") AS dist FROM e r JOIN e a ON a.id % 10 = 0 WHERE r.id % 10 <> 0) SELECT id, arg_min(anchor, dist) AS anchor, arg_min(label, dist) AS label, round(min(dist), 6) AS dist FROM q GROUP BY id HAVING min(dist) <= 0.75")
def nearest_anchor(spark, d):
    """The nearest labelled row, whose cluster is taken over."""
    rows = _rows(spark, d)
    anchors = rows.filter("id % 10 = 0").select(F.col("id").alias("tid"), F.col("v").alias("t"))
    best = match.nearest(rows.filter("id % 10 <> 0").select("id", "v"), anchors, 0.75)
    return best.join(rows.select(F.col("id").alias("tid"), "label"), "tid").select("id", F.col("tid").alias("anchor"), "label", F.round("dist", 6).alias("dist"))


_TOP2 = _FIT + _DIST + ", t AS (SELECT id, tid, dist, lead(dist) OVER (PARTITION BY id ORDER BY dist, tid) - dist AS margin, row_number() OVER (PARTITION BY id ORDER BY dist, tid) AS rn FROM q)"


@query(_TOP2 + " SELECT CASE WHEN dist > 0.8 THEN 'low_sim' WHEN margin < 0.05 THEN 'low_margin' ELSE 'assigned' END AS outcome, count(*) AS n, round(avg(margin), 6) AS margin FROM t WHERE rn = 1 GROUP BY 1")
def match_margin_top2(spark, d):
    """A match must be near, and nearer than the second by a margin."""
    two = match.top_two(*_split(spark, d))
    outcome = F.when(F.col("dist") > 0.8, "low_sim").when(F.col("margin") < 0.05, "low_margin").otherwise("assigned")
    return two.groupBy(outcome.alias("outcome")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("margin"), 6).alias("margin"))


@query(_TOP2 + ", k AS (SELECT id, tid, dist FROM t WHERE rn = 1 AND dist <= 0.8 AND margin >= 0.05) SELECT min(id) AS id, tid FROM k GROUP BY tid")
def match_use_once(spark, d):
    """Each name is used once, by the first that asks."""
    two = match.top_two(*_split(spark, d)).filter("dist <= 0.8 and margin >= 0.05")
    return match.use_once(two.select(F.col("id").alias("cid"), F.col("tid").alias("name"))).select(F.col("cid").alias("id"), F.col("name").alias("tid"))


def _propagation_sql(passes):
    """The passes one after another; one that assigns nothing is followed by others that assign nothing."""
    out = ["WITH " + _V + ", k0 AS (SELECT id, label, v FROM e WHERE id % 2 = 0), r0 AS (SELECT id, v FROM e WHERE id % 2 = 1)"]
    for k in range(1, passes + 1):
        p = k - 1
        cent = _CENT.format(g="label", w="1.0", f=f"k{p}", where=f"label IN (SELECT label FROM k{p} GROUP BY 1 HAVING count(*) >= 5)")
        out.append(cent.replace("x AS", f"x{k} AS").replace("FROM x)", f"FROM x{k})").replace(", c AS", f", c{k} AS"))
        out.append(f"q{k} AS (SELECT r.id, c.g AS tid, 1 - " + _DOT.format(a="r.v", b="c.c") + " / sqrt(" + _DOT.format(a="r.v", b="r.v") + f") AS dist FROM r{p} r JOIN c{k} c ON true)")
        out.append(f"t{k} AS (SELECT id, tid, dist, lead(dist) OVER (PARTITION BY id ORDER BY dist, tid) - dist AS margin, row_number() OVER (PARTITION BY id ORDER BY dist, tid) AS rn FROM q{k})")
        out.append(f"a{k} AS (SELECT id, tid AS label, {k} AS pass FROM t{k} WHERE rn = 1 AND dist <= 0.8 AND margin >= 0.05)")
        out.append(f"k{k} AS (SELECT * FROM k{p} UNION ALL SELECT r.id, a.label, r.v FROM r{p} r JOIN a{k} a ON a.id = r.id)")
        out.append(f"r{k} AS (SELECT * FROM r{p} WHERE id NOT IN (SELECT id FROM a{k}))")
    return ", ".join(out) + " " + " UNION ALL ".join(f"SELECT id, label, pass FROM a{k}" for k in range(1, passes + 1))


@query(_propagation_sql(5))
def label_propagation(spark, d):
    """Passes until nothing is assigned, five at most; what one assigns moves the centroids of the next."""
    rows = _rows(spark, d)
    return match.propagate(rows.filter("id % 2 = 1").select("id", "v"), rows.filter("id % 2 = 0").select("id", "label", "v"), 0.8, 0.05)


@query("WITH " + _V + ", " + _CENT.format(g="label", w="1.0", f="e", where="true") + ", p AS (SELECT a.g AS a, b.g AS b, 1 - " + _DOT.format(a="a.c", b="b.c") + " AS dist FROM c a JOIN c b ON a.g < b.g) SELECT a, b, round(dist, 6) AS dist FROM p WHERE dist > 0.66 AND dist <= 0.9")
def close_pairs(spark, d):
    """Pairs of centroids in a band of distances."""
    cent = _cent(_rows(spark, d)).select(F.col("label").cast("long").alias("id"), F.col("centroid").alias("v"))
    return match.vector_pairs(cent, 0.9).filter("dist > 0.66").select(F.col("a").cast("int").alias("a"), F.col("b").cast("int").alias("b"), F.round("dist", 6).alias("dist"))


_NEAR = "WITH RECURSIVE " + _V + ", " + _PAIRS + f", n AS (SELECT a, b FROM p WHERE dist <= {EPS})"
_DBSCAN = (
    _NEAR
    + ", b AS (SELECT a AS id, b AS o FROM n UNION ALL SELECT b, a FROM n), core AS (SELECT id FROM b GROUP BY id HAVING count(*) + 1 >= {k}), cc AS (SELECT id, o FROM b WHERE id IN (SELECT id FROM core) AND o IN (SELECT id FROM core)), walk(node, seen) AS (SELECT id, id FROM core UNION SELECT w.node, cc.o FROM walk w JOIN cc ON cc.id = w.seen), comp AS (SELECT node AS id, min(seen) AS c FROM walk GROUP BY node), num AS (SELECT id, (dense_rank() OVER (ORDER BY c) - 1)::INT AS cluster FROM comp), br AS (SELECT b.id, min(num.cluster) AS cluster FROM b JOIN num ON num.id = b.o WHERE b.id NOT IN (SELECT id FROM core) GROUP BY b.id) SELECT e.id, coalesce(num.cluster, br.cluster, -1) AS cluster FROM e LEFT JOIN num USING (id) LEFT JOIN br USING (id)"
)


def _near(spark, d):
    members, classes = match.vector_classes(_rows(spark, d))
    return members, classes, checkpointed(match.vector_pairs(classes, EPS))


def _dbscan(spark, d, k):
    members, classes, pairs = _near(spark, d)
    found = cluster.dbscan(classes.select("id", "n"), pairs, k).withColumnRenamed("id", "class")
    return members.join(found, "class").select("id", "cluster")


@query(_DBSCAN.replace("{k}", "2"))
def dbscan_k2(spark, d):
    """Two neighbours make a cluster."""
    return _dbscan(spark, d, 2)


@query(_DBSCAN.replace("{k}", "3"))
def dbscan_k3(spark, d):
    """Core and border rows."""
    return _dbscan(spark, d, 3)


@query()
def centroid_merge(spark, d):
    """The nearest centroids merge until none are near."""
    cent = match.centroids(_rows(spark, d).withColumn("cluster", (F.col("id") % 20).cast("int")), "cluster", "v")
    return cluster.merge_centroids(cent, 0.75)


def _members(spark, d):
    """(members, pairs, classes): rows (id, label, v, component) of all groups of two or more near rows; what links their classes."""
    members, classes, pairs = _near(spark, d)
    comp = connected_components(pairs.select(F.col("a").alias("u"), F.col("b").alias("v"))).withColumnRenamed("node", "class")
    # equal rows are a group of their own where no other row is near
    both = classes.select(F.col("id").alias("class"), "n").join(comp, "class", "left").filter("component is not null or n > 1")
    named = checkpointed(both.select("class", "n", F.coalesce("component", "class").alias("component")))
    rows = _rows(spark, d).join(members.join(named.select("class", "component"), "class").select("id", "component"), "id")
    return rows, pairs, named


_WALK = _NEAR + ", b AS (SELECT a AS id, b AS o FROM n UNION ALL SELECT b, a FROM n), walk(node, seen) AS (SELECT id, id FROM b UNION SELECT w.node, b.o FROM walk w JOIN b ON b.id = w.seen), comp AS (SELECT node AS id, min(seen) AS component FROM walk GROUP BY node)"


@query()
def clique_split(spark, d):
    """Components parted into groups that are near all with all."""
    rows, pairs, _ = _members(spark, d)
    return cluster.clique_split(rows, EPS, pairs)


@query()
def recluster_oversize(spark, d):
    """Groups that are too large split at smaller distances."""
    rows, pairs, _ = _members(spark, d)
    return cluster.recluster(rows, EPS, 4, links=pairs)


@query(_WALK + ", s AS (SELECT component, count(*) AS n, min(id) AS first FROM comp GROUP BY 1 HAVING count(*) >= 2) SELECT component, n, 'person_' || lpad(row_number() OVER (ORDER BY n DESC, first)::VARCHAR, greatest(3, length(row_number() OVER (ORDER BY n DESC, first)::VARCHAR))::INT, '0') AS name FROM s")
def cluster_names(spark, d):
    """Placeholder names, the largest cluster first."""
    sizes = _members(spark, d)[0].groupBy("component").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first")).filter("n >= 2")
    numbered = ranking.global_index(sizes, [F.desc("n"), F.asc("first")], "i")
    return numbered.select("component", "n", tx.numbered(F.lit("person"), F.col("i") + 1).alias("name"))


_STATS = _WALK + ", g AS (SELECT c.component, count(*) AS pairs, avg(p.dist) AS mean, min(p.dist) AS least FROM p JOIN comp c ON c.id = p.a JOIN comp f ON f.id = p.b WHERE c.component = f.component GROUP BY 1)"


def _stats(spark, d):
    """Pairs, mean and least distance of each group, without its pairs.

    The cosines of all ordered pairs sum to the squared length of the sum of unit vectors, less their own;
    the least distance is among the links, or that of equal rows.
    """
    rows, pairs, named = _members(spark, d)
    unit = vec.normalise(F.col("v"), "one")
    each = rows.select("component", F.posexplode(unit).alias("pos", "x")).groupBy("component", "pos").agg(F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("own"), F.count(F.lit(1)).alias("n"))
    sums = each.groupBy("component").agg(F.sum(F.col("s") * F.col("s")).alias("all"), F.sum("own").alias("own"), F.max("n").alias("n"))
    least = pairs.join(named.select(F.col("class").alias("a"), "component"), "a").select("component", "dist").unionByName(named.filter("n > 1").select("component", F.lit(0.0).alias("dist")))
    least = least.groupBy("component").agg(F.min("dist").alias("least"))
    count = F.col("n") * (F.col("n") - 1)
    return sums.join(least, "component").select("component", (count / 2).cast("long").alias("pairs"), (1 - (F.col("all") - F.col("own")) / count).alias("mean"), "least")


@query(_STATS + " SELECT component, pairs, round(mean, 6) AS mean, round(least, 6) AS least FROM g")
def group_pair_stats(spark, d):
    """Mean and least distance of the pairs of a group."""
    return _stats(spark, d).select("component", "pairs", F.round("mean", 6).alias("mean"), F.round("least", 6).alias("least"))


@query(_STATS + " SELECT component, CASE WHEN mean <= 0.56 AND least <= 0.55 THEN 'high' WHEN mean <= 0.6 THEN 'medium' ELSE 'low' END AS confidence FROM g")
def group_confidence(spark, d):
    """C11: tiers of confidence from a group's distances."""
    tier = F.when((F.col("mean") <= 0.56) & (F.col("least") <= 0.55), "high").when(F.col("mean") <= 0.6, "medium").otherwise("low")
    return _stats(spark, d).select("component", tier.alias("confidence"))


@query("WITH " + _V + ", " + _PAIRS + ", q AS (SELECT p.*, abs(a.id % 7 - b.id % 7) AS h FROM p JOIN e a ON a.id = p.a JOIN e b ON b.id = p.b WHERE a.label = b.label AND dist <= 0.75) SELECT a, b, round(dist, 6) AS dist FROM q WHERE h <= 3 AND dist <= CASE WHEN h <= 1 THEN 0.75 ELSE 0.68 END")
def composite_pairs(spark, d):
    """A pair's limit on one measure depends on another."""
    rows = _rows(spark, d)
    near = match.vector_pairs(rows, 0.75, ["label"]).withColumn("h", F.abs(F.col("a") % 7 - F.col("b") % 7))
    return near.filter((F.col("h") <= 3) & (F.col("dist") <= F.when(F.col("h") <= 1, 0.75).otherwise(0.68))).select("a", "b", F.round("dist", 6).alias("dist"))


@query("""
WITH RECURSIVE m AS (SELECT DISTINCT vec_id % 60 AS c, 'L' || (vec_id % 60 // 7) AS label FROM embeddings),
l AS (SELECT label, min(c) AS keep FROM m GROUP BY label), b AS (SELECT c AS id, keep AS o FROM m JOIN l USING (label) UNION SELECT keep, c FROM m JOIN l USING (label)),
w(node, seen) AS (SELECT id, id FROM b UNION SELECT w.node, b.o FROM w JOIN b ON b.id = w.seen)
SELECT node AS cluster, min(seen) AS merged FROM w GROUP BY node
""")
def merge_prior_labels(spark, d):
    """Clusters that share a prior label become one, under the least number."""
    m = table(spark, d, "embeddings").select((F.col("vec_id") % 60).alias("c"), F.concat(F.lit("L"), F.floor(F.col("vec_id") % 60 / 7).cast("string")).alias("label")).distinct()
    keep = m.groupBy("label").agg(F.min("c").alias("keep"))
    edges = m.join(keep, "label").select(F.col("c").alias("u"), F.col("keep").alias("v"))
    comp = connected_components(edges).select(F.col("node").alias("cluster"), F.col("component").alias("merged"))
    return comp.unionByName(m.select(F.col("c").alias("cluster")).distinct().join(comp, "cluster", "left_anti").select("cluster", F.col("cluster").alias("merged")))


@query("WITH " + _V + ", f AS (SELECT id % 20 AS k, * FROM e), " + _CENT.format(g="k", w="1.0", f="f", where="true") + ", q AS (SELECT u.g AS cluster, a.g AS anchor, 1 - " + _DOT.format(a="u.c", b="a.c") + " AS dist FROM c u JOIN c a ON a.g < 8 WHERE u.g >= 8) SELECT cluster, arg_min(anchor, dist) AS anchor, round(min(dist), 6) AS dist FROM q GROUP BY cluster HAVING min(dist) <= 0.8")
def anchor_cluster_merge(spark, d):
    """Unlabelled clusters go to the nearest labelled one, centroids as they were."""
    cent = match.centroids(_rows(spark, d).withColumn("k", F.col("id") % 20), "k", "v")
    labelled = cent.filter("k < 8").select(F.col("k").alias("tid"), F.col("centroid").alias("t"))
    return match.nearest(cent.filter("k >= 8").select(F.col("k").alias("id"), F.col("centroid").alias("v")), labelled, 0.8).select(F.col("id").alias("cluster"), F.col("tid").alias("anchor"), F.round("dist", 6).alias("dist"))


@query("""
WITH g AS (SELECT vec_id AS id, 'G' || label || CASE vec_id % 3 WHEN 0 THEN '_upper_body' WHEN 1 THEN '_head_and_shoulders' ELSE '_other' END AS name FROM embeddings),
k AS (SELECT id, regexp_replace(name, '_(upper_body|head_and_shoulders)$', '_person') AS stem FROM g),
r AS (SELECT id, stem, count(*) OVER (PARTITION BY stem) AS n, (row_number() OVER (PARTITION BY stem ORDER BY id) - 1) // 12 AS chunk FROM k)
SELECT stem, chunk, count(*) AS n, min(id) AS first FROM r WHERE n >= 3 GROUP BY ALL
""")
def merge_by_label_stem(spark, d):
    """Groups under one stem become one, in chunks of bounded size."""
    kind = F.when(F.col("vec_id") % 3 == 0, "_upper_body").when(F.col("vec_id") % 3 == 1, "_head_and_shoulders").otherwise("_other")
    named = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.regexp_replace(F.concat(F.lit("G"), F.col("label").cast("string"), kind), "_(upper_body|head_and_shoulders)$", "_person").alias("stem"))
    big = named.groupBy("stem").agg(F.count(F.lit(1)).alias("c")).filter("c >= 3").select("stem")
    numbered = ranking.group_index(named.join(big, "stem"), ["stem"], [F.asc("id")], "i")
    return numbered.withColumn("chunk", F.floor(F.col("i") / 12)).groupBy("stem", "chunk").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))


@query(_WALK + ", s AS (SELECT id, component, ((id * 37) % 100) / 100.0 AS score FROM comp), v AS (SELECT *, sum(CASE WHEN score >= 0.5 THEN 1 ELSE 0 END) OVER (PARTITION BY component) - CASE WHEN score >= 0.5 THEN 1 ELSE 0 END AS votes FROM s) SELECT id, component, votes::BIGINT AS votes FROM v WHERE votes > 0")
def neighbour_vote(spark, d):
    """How many others of its group score high."""
    high = F.when(F.pmod(F.col("id") * 37, F.lit(100)) / 100 >= 0.5, 1).otherwise(0)
    rows = _members(spark, d)[0].select("id", "component", high.alias("high"))
    sums = rows.groupBy("component").agg(F.sum("high").alias("s"))
    return rows.join(sums, "component").select("id", "component", (F.col("s") - F.col("high")).alias("votes")).filter("votes > 0")


@query("WITH " + _V + ", q AS (SELECT id, list_concat(list_transform(v[1:32], lambda x: x * 0.92), list_transform(v[33:64], lambda x: x * 0.08)) AS u FROM e) SELECT id, round(u[1] / sqrt(" + _DOT.format(a="u", b="u") + "), 6) AS first, round(u[64] / sqrt(" + _DOT.format(a="u", b="u") + "), 6) AS last FROM q")
def weighted_concat(spark, d):
    """V7: parts of a vector by weight, as a unit vector."""
    v = F.col("v")
    joined = vec.concat_weighted((F.slice(v, 1, 32), 0.92), (F.slice(v, 33, 32), 0.08))
    return _rows(spark, d).select("id", joined.alias("u")).select("id", F.round(F.col("u")[0], 6).alias("first"), F.round(F.col("u")[63], 6).alias("last"))


@query("SELECT vec_id AS id, (label = 1 AND q >= 0.55 AND s >= 70 AND b >= 40) AS passed FROM (SELECT vec_id, label, (vec_id % 20) / 20.0 AS q, vec_id % 200 AS s, vec_id % 90 AS b, embedding FROM embeddings) WHERE embedding IS NOT NULL")
def quality_gate(spark, d):
    """F1: the gate of score, size, sharpness and a present vector."""
    gate = (F.col("label") == 1) & (F.col("vec_id") % 20 / 20 >= 0.55) & (F.col("vec_id") % 200 >= 70) & (F.col("vec_id") % 90 >= 40)
    return table(spark, d, "embeddings").filter("embedding is not null").select(F.col("vec_id").alias("id"), gate.alias("passed"))


@query("WITH " + _V + ", q AS (SELECT id, unnest(v) AS x FROM e) SELECT id, least(7, greatest(0, floor((x + 0.4) / 0.1)))::INT AS bin, count(*) AS n FROM q GROUP BY ALL")
def histogram_vector(spark, d):
    """V8: a histogram of a vector's components."""
    bins = F.least(F.lit(7), F.greatest(F.lit(0), F.floor((F.col("x") + 0.4) / 0.1))).cast("int")
    return _rows(spark, d).select("id", F.explode("v").alias("x")).groupBy("id", bins.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@query("WITH " + _V + ", " + _CENT.format(g="label", w="1.0", f="e", where="true") + " SELECT a.g AS a, b.g AS b, round(" + _DOT.format(a="a.c", b="b.c") + ", 6) AS similarity FROM c a JOIN c b ON a.g <= b.g")
def similarity_matrix(spark, d):
    """V2: the similarities of all centroids, a small dimension."""
    cent = _cent(_rows(spark, d))
    a = cent.select(F.col("label").alias("a"), F.col("centroid").alias("va"))
    b = cent.select(F.col("label").alias("b"), F.col("centroid").alias("vb"))
    return a.join(small(b), F.col("a") <= F.col("b")).select("a", "b", F.round(vec.dot(F.col("va"), F.col("vb")), 6).alias("similarity"))
