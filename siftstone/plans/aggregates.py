"""Queries that count, rank, number and page."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from siftstone.catalog import query
from siftstone.functions import text as tx
from siftstone.operators import ranking
from siftstone.sources.tables import table


@query("SELECT c.c_custkey AS entity, count(o.o_orderkey) AS n FROM customer c LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus = 'F') o ON o.o_custkey = c.c_custkey GROUP BY 1")
def entity_counts_with_zero(spark, d):
    """A1: every known entity appears, also with none."""
    counts = table(spark, d, "orders").filter("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("entity")).agg(F.count(F.lit(1)).alias("n"))
    return table(spark, d, "customer").select(F.col("c_custkey").alias("entity")).join(counts, "entity", "left").select("entity", F.coalesce("n", F.lit(0)).alias("n"))


@query("SELECT event_type, count(*) AS total, count(*) FILTER (value > 100) AS high, count(*) FILTER (value <= 10) AS low, count(*) FILTER (user_id % 2 = 0) AS even, round(sum(CASE WHEN value > 100 THEN value ELSE 0 END), 4) AS high_sum FROM events GROUP BY 1")
def multi_counter(spark, d):
    """A2: many counters in one pass."""
    v = F.col("value")
    return table(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("total"), F.count_if(v > 100).alias("high"), F.count_if(v <= 10).alias("low"), F.count_if(F.col("user_id") % 2 == 0).alias("even"), F.round(F.sum(F.when(v > 100, v).otherwise(0.0)), 4).alias("high_sum"))


@query("SELECT d.lang, count(*) AS total, count(l.doc_id) AS cached, count(*) - count(l.doc_id) AS missing, CASE WHEN count(*) = 0 THEN 1.0 ELSE round(count(l.doc_id) / count(*), 6) END AS coverage, CASE WHEN count(l.doc_id) / count(*) < 0.4 THEN 2 ELSE 0 END AS code FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id) GROUP BY 1")
def coverage_ratio(spark, d):
    """The share of entries that a store covers."""
    known = table(spark, d, "labels").select("doc_id", F.lit(1).alias("k")).distinct()
    rows = table(spark, d, "documents").select("doc_id", "lang").join(known, "doc_id", "left").groupBy("lang").agg(F.count(F.lit(1)).alias("total"), F.count("k").alias("cached"))
    share = F.when(F.col("total") == 0, 1.0).otherwise(F.col("cached") / F.col("total"))
    return rows.select("lang", "total", "cached", (F.col("total") - F.col("cached")).alias("missing"), F.round(share, 6).alias("coverage"), F.when(share < 0.4, 2).otherwise(0).alias("code"))


@query("""
WITH c AS (SELECT user_id, event_type, count(*) AS n, min(event_id) AS first FROM events GROUP BY ALL), t AS (SELECT user_id, string_agg(event_type || '=' || n, ',' ORDER BY n DESC, first) AS top FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, first) AS rn FROM c) WHERE rn <= 3 GROUP BY 1),
s AS (SELECT user_id, count(*) AS rows, count(DISTINCT event_type) AS types, round(avg(value), 4) AS mean FROM events GROUP BY 1)
SELECT user_id, rows, types, mean, top FROM s JOIN t USING (user_id)
""")
def triage_clusters(spark, d):
    """Size, distinct values, mean and most common values of each group."""
    e = table(spark, d, "events")
    s = e.groupBy("user_id").agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("event_type").alias("types"), F.round(F.avg("value"), 4).alias("mean"))
    return s.join(ranking.most_common(e, "user_id", "event_type", "event_id", 3), "user_id")


@query("""
WITH c AS (SELECT user_id, event_type, count(*) AS n, min(event_id) AS first FROM events GROUP BY ALL)
SELECT user_id, arg_max(event_type, (n, -first)) AS first_mode, arg_max(event_type, (n, event_type)) AS last_mode FROM c GROUP BY 1
""")
def mode_ties(spark, d):
    """The most common value; ties to the first seen, or to the greatest name."""
    c = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first"))
    return c.groupBy("user_id").agg(F.max_by("event_type", F.struct("n", -F.col("first"))).alias("first_mode"), F.max_by("event_type", F.struct("n", "event_type")).alias("last_mode"))


@query("WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) SELECT user_id, round(max(n) / sum(n), 6) AS dominance FROM c GROUP BY 1")
def dominance_ratio(spark, d):
    """The share of the most common value."""
    c = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    return c.groupBy("user_id").agg(F.round(F.max("n") / F.sum("n"), 6).alias("dominance"))


@query("""
WITH r AS (SELECT lang, n_chars AS x, row_number() OVER (PARTITION BY lang ORDER BY n_chars) - 1 AS k, count(*) OVER (PARTITION BY lang) AS n FROM documents)
SELECT lang, max(x) FILTER (k = n // 10) AS p10, max(x) FILTER (k = n // 4) AS p25, max(x) FILTER (k = n // 2) AS p50, max(x) FILTER (k = 3 * n // 4) AS p75, max(x) FILTER (k = 9 * n // 10) AS p90, round(count(*) FILTER (x < 1000) / count(*), 6) AS below_1000 FROM r GROUP BY 1
""")
def nearest_rank_percentiles(spark, d):
    """Values at ranks n/10, n/4, ... of each group, and the share below a limit."""
    return ranking.rank_percentiles(table(spark, d, "documents").select("lang", F.col("n_chars").alias("x")), "lang", "x", {"p10": (1, 10), "p25": (1, 4), "p50": (1, 2), "p75": (3, 4), "p90": (9, 10)}, F.round(F.count_if(F.col("x") < 1000) / F.count(F.lit(1)), 6).alias("below_1000"))


@query("""
WITH m AS (SELECT l_returnflag AS k, median(l_quantity) AS q, median(l_discount) AS dis, median(l_tax) AS t FROM lineitem GROUP BY 1)
SELECT k, round(q, 6) AS q, round(dis, 6) AS dis, CASE WHEN q > 25 THEN 'large' ELSE 'small' END || '_' || CASE WHEN dis >= 0.05 THEN 'cheap' ELSE 'dear' END || '_' || CASE WHEN t < 0.04 THEN 'light' ELSE 'heavy' END AS label FROM m
""")
def median_labels(spark, d):
    """Interpolated medians, and labels composed of their buckets."""
    m = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("k")).agg(F.median("l_quantity").alias("q"), F.median("l_discount").alias("dis"), F.median("l_tax").alias("t"))
    label = F.concat_ws("_", F.when(F.col("q") > 25, "large").otherwise("small"), F.when(F.col("dis") >= 0.05, "cheap").otherwise("dear"), F.when(F.col("t") < 0.04, "light").otherwise("heavy"))
    return m.select("k", F.round("q", 6).alias("q"), F.round("dis", 6).alias("dis"), label.alias("label"))


@query("SELECT source, lang, count(*) AS files, sum(n_chars)::BIGINT AS bytes, max(n_chars) AS largest FROM documents GROUP BY ALL")
def sizes_counts(spark, d):
    """Files and bytes by place."""
    return table(spark, d, "documents").groupBy("source", "lang").agg(F.count(F.lit(1)).alias("files"), F.sum("n_chars").alias("bytes"), F.max("n_chars").alias("largest"))


@query("WITH g AS (SELECT user_id, count(*) AS size FROM events GROUP BY 1) SELECT size, count(*) AS groups FROM g GROUP BY 1")
def histogram_sizes(spark, d):
    """How many groups have each size."""
    return table(spark, d, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("size")).groupBy("size").agg(F.count(F.lit(1)).alias("groups"))


@query("SELECT 'customer' AS metric, count(*) AS n FROM customer UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'labels', count(*) FROM labels UNION ALL SELECT 'live_labels', count(*) FROM labels WHERE doc_id IN (SELECT doc_id FROM documents)")
def store_counts(spark, d):
    """Entries of each store, and live ones."""
    names = ("customer", "orders", "labels")
    frames = [(n, table(spark, d, n)) for n in names] + [("live_labels", table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id"), "doc_id", "left_semi"))]
    out = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("metric"), "n") for n, df in frames]
    result = out[0]
    for df in out[1:]:
        result = result.unionByName(df)
    return result


_PATHS = "p AS (SELECT page_id, string_split(regexp_replace(url, '^[a-z]+://', ''), '/') AS parts FROM pages)"


def _parts(spark, d):
    return table(spark, d, "pages").select("page_id", "url", tx.path_parts(F.col("url")).alias("parts"))


@query("WITH " + _PATHS + " SELECT parts[1] AS host, count(*) AS total, count(*) FILTER (len(parts) > 2) AS deep, count(*) FILTER (parts[2] LIKE 'a%' OR parts[2] LIKE 'p%') AS prefixed FROM p GROUP BY 1")
def prefix_counts(spark, d):
    """Counts by leading parts of a path."""
    second = F.get("parts", F.lit(1))
    return _parts(spark, d).groupBy(F.get("parts", F.lit(0)).alias("host")).agg(F.count(F.lit(1)).alias("total"), F.count_if(F.size("parts") > 2).alias("deep"), F.count_if(second.startswith("a") | second.startswith("p")).alias("prefixed"))


@query("WITH r AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey, l_returnflag ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS rn FROM lineitem) SELECT l_suppkey, l_returnflag, l_orderkey, l_linenumber, CASE WHEN l_discount < 0.05 THEN 'sharp' ELSE 'blurred' END AS bucket FROM r WHERE rn = 1")
def best_per_label_item(spark, d):
    """The best row of each pair, then its bucket."""
    best = F.max_by(F.struct("l_orderkey", "l_linenumber", "l_discount"), F.struct("l_extendedprice", -F.col("l_orderkey"), -F.col("l_linenumber"))).alias("b")
    rows = table(spark, d, "lineitem").groupBy("l_suppkey", "l_returnflag").agg(best)
    return rows.select("l_suppkey", "l_returnflag", "b.l_orderkey", "b.l_linenumber", F.when(F.col("b.l_discount") < 0.05, "sharp").otherwise("blurred").alias("bucket"))


@query("SELECT label, arg_max(vec_id, (vec_id * 37) % 101 * 1000000 - vec_id) AS best FROM embeddings GROUP BY 1")
def argmax_row(spark, d):
    """T4: the row of the greatest value, the first of equal ones."""
    return table(spark, d, "embeddings").groupBy("label").agg(F.max_by("vec_id", F.struct(F.pmod(F.col("vec_id") * 37, F.lit(101)), -F.col("vec_id"))).alias("best"))


@query("SELECT doc_id, n_chars, score FROM (SELECT doc_id, n_chars, (doc_id * 37) % 100 / 100.0 AS score FROM documents) WHERE score >= 0.62 ORDER BY score DESC, n_chars DESC, doc_id LIMIT 50")
def topk_ranked(spark, d):
    """The 50 best of all."""
    score = F.pmod(F.col("doc_id") * 37, F.lit(100)) / 100
    return table(spark, d, "documents").select("doc_id", "n_chars", score.alias("score")).filter("score >= 0.62").orderBy(F.desc("score"), F.desc("n_chars"), "doc_id").limit(50)


@query("WITH u AS (SELECT lang, md5(text) AS k, n_chars, doc_id, row_number() OVER (PARTITION BY lang, md5(text) ORDER BY doc_id) AS c FROM documents), r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS rank FROM u WHERE c = 1) SELECT lang, doc_id, rank FROM r WHERE rank <= 5")
def topn_per_group(spark, d):
    """The best five of each group, of equal contents one."""
    one = table(spark, d, "documents").groupBy("lang", F.md5("text").alias("k")).agg(F.min_by(F.struct("doc_id", "n_chars"), "doc_id").alias("m")).select("lang", "m.doc_id", "m.n_chars")
    order = Window.partitionBy("lang").orderBy(F.desc("n_chars"), "doc_id")
    return one.withColumn("rank", F.row_number().over(order)).filter("rank <= 5").select("lang", "doc_id", F.col("rank").cast("long").alias("rank"))


@query("WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) - 1 AS i FROM documents WHERE lang = 'de') SELECT doc_id, i // 30 + 1 AS page, i % 30 // 5 AS line, i % 5 AS col FROM r")
def paged_layout(spark, d):
    """Pages of 30 tiles in lines of five."""
    docs = table(spark, d, "documents").filter("lang = 'de'").select("doc_id", "n_chars")
    i = ranking.global_index(docs, [F.desc("n_chars"), F.asc("doc_id")], "i")
    return i.select("doc_id", (F.floor(F.col("i") / 30) + 1).alias("page"), F.floor(F.col("i") % 30 / 5).alias("line"), (F.col("i") % 5).alias("col"))


@query("WITH r AS (SELECT p_partkey, p_brand, p_size, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS k FROM part), m AS (SELECT p_brand, max(p_size) AS base FROM part GROUP BY 1) SELECT p_partkey, r.p_brand || '_' || lpad((base + k)::VARCHAR, greatest(3, length((base + k)::VARCHAR))::INT, '0') AS name FROM r JOIN m ON m.p_brand = r.p_brand")
def numbered_names(spark, d):
    """Numbering goes on from the highest index in use."""
    part = table(spark, d, "part")
    base = part.groupBy("p_brand").agg(F.max("p_size").alias("base"))
    rows = ranking.group_index(part.select("p_partkey", "p_brand"), ["p_brand"], [F.asc("p_partkey")], "i").withColumn("k", F.col("i") + 1)
    return rows.join(base, "p_brand").select("p_partkey", tx.numbered(F.col("p_brand"), F.col("base") + F.col("k")).alias("name"))


@query("WITH r AS (SELECT p_partkey, lower(p_brand) || '/' || p_size AS dest, row_number() OVER (PARTITION BY lower(p_brand) || '/' || p_size ORDER BY p_partkey) AS rn FROM part) SELECT p_partkey, dest || CASE WHEN rn > 1 THEN '__' || rn ELSE '' END || '.jpg' AS dest FROM r")
def collision_suffix(spark, d):
    """Equal destinations get a number."""
    return ranking.collision_suffix(table(spark, d, "part").select("p_partkey", F.concat_ws("/", F.lower("p_brand"), F.col("p_size").cast("string")).alias("dest")), "dest", "p_partkey", ".jpg")


@query("WITH r AS (SELECT doc_id, CASE WHEN n_chars > 2000 THEN 'high' WHEN n_chars > 1000 THEN 'medium' ELSE 'low' END AS confidence FROM documents) SELECT doc_id, confidence, row_number() OVER (PARTITION BY confidence ORDER BY doc_id) AS k FROM r")
def counters_per_confidence(spark, d):
    """A running number for each confidence."""
    tier = F.when(F.col("n_chars") > 2000, "high").when(F.col("n_chars") > 1000, "medium").otherwise("low")
    rows = table(spark, d, "documents").select("doc_id", tier.alias("confidence"))
    return ranking.group_index(rows, ["confidence"], [F.asc("doc_id")], "i").select("doc_id", "confidence", (F.col("i") + 1).alias("k"))


@query("WITH r AS (SELECT doc_id, source, (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) // 12 AS chunk FROM documents), c AS (SELECT *, count(*) OVER (PARTITION BY source, chunk) AS n FROM r) SELECT doc_id, source, chunk FROM c WHERE n >= 3")
def chunk_fixed(spark, d):
    """Chunks of 12; those of under three go."""
    rows = ranking.group_index(table(spark, d, "documents").select("doc_id", "source"), ["source"], [F.asc("doc_id")], "i")
    rows = rows.select("doc_id", "source", F.floor(F.col("i") / 12).alias("chunk"))
    return rows.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("source", "chunk"))).filter("n >= 3").drop("n")


@query("WITH c AS (SELECT doc_id FROM documents) SELECT (SELECT count(*) FROM (SELECT doc_id FROM c ORDER BY doc_id LIMIT 100)) AS taken, greatest(0, (SELECT count(*) FROM c) - 100) AS deferred")
def cap_and_defer(spark, d):
    """So many items a run; the rest is counted as deferred."""
    c = table(spark, d, "documents").agg(F.count(F.lit(1)).alias("n"))
    return c.select(F.least("n", F.lit(100)).alias("taken"), F.greatest(F.lit(0), F.col("n") - 100).alias("deferred"))


@query("""
WITH s AS (SELECT lang, doc_id, n_chars % 7 AS attr, (doc_id * 53) % 1000 AS score FROM documents), g AS (SELECT lang, count(*) AS n FROM s GROUP BY 1 ORDER BY n DESC, lang LIMIT 3),
r AS (SELECT s.*, row_number() OVER (PARTITION BY lang ORDER BY score DESC, doc_id) AS rn FROM s JOIN g USING (lang)),
st AS (SELECT lang, doc_id, attr FROM r WHERE rn = 1), alt AS (SELECT lang, doc_id, rn FROM r WHERE rn BETWEEN 2 AND 6),
m AS (SELECT r.lang, r.doc_id, row_number() OVER (PARTITION BY r.lang ORDER BY r.rn) AS k FROM r JOIN st ON st.lang = r.lang AND st.attr = r.attr WHERE r.rn > 6)
SELECT lang, doc_id, 'start' AS role, 1 AS place FROM st UNION ALL SELECT lang, doc_id, 'alternate', rn - 1 FROM alt UNION ALL SELECT lang, doc_id, 'matched', k FROM m WHERE k <= 12
""")
def pack_builder(spark, d):
    """T5: of the largest groups a start, alternates, and rows that match it and are not used yet."""
    s = table(spark, d, "documents").select("lang", "doc_id", (F.col("n_chars") % 7).alias("attr"), F.pmod(F.col("doc_id") * 53, F.lit(1000)).alias("score"))
    top = s.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(3).select("lang")
    r = ranking.group_index(s.join(F.broadcast(top), "lang"), ["lang"], [F.desc("score"), F.asc("doc_id")], "i").withColumn("rn", F.col("i") + 1)
    start = r.filter("rn = 1").select("lang", F.col("attr").alias("a"))
    # twelve of each group at most: Spark cuts the window's input to them before its shuffle
    matched = r.filter("rn > 6").join(F.broadcast(start), "lang").filter("attr = a").withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy("rn"))).filter("place <= 12")
    rest = r.filter("rn <= 6").select("lang", "doc_id", F.when(F.col("rn") == 1, "start").otherwise("alternate").alias("role"), F.greatest(F.lit(1), F.col("rn") - 1).alias("place"))
    return rest.unionByName(matched.select("lang", "doc_id", F.lit("matched").alias("role"), "place")).withColumn("place", F.col("place").cast("long"))


@query("""
WITH a AS (SELECT doc_id, 1 AS l, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS r FROM documents), b AS (SELECT doc_id, 2 AS l, row_number() OVER (ORDER BY (doc_id * 37) % 101 DESC, doc_id) AS r FROM documents),
u AS (SELECT * FROM a WHERE r <= 20 UNION ALL SELECT * FROM b WHERE r <= 20), f AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY l, r) AS k FROM u)
SELECT doc_id, l AS list, r AS rank FROM f WHERE k = 1
""")
def concat_topk_distinct(spark, d):
    """Lists of best rows one behind another, each row where it comes first."""
    docs = table(spark, d, "documents").select("doc_id", "n_chars")
    one = ranking.best(docs, [F.desc("n_chars"), F.asc("doc_id")], 20).withColumn("list", F.lit(1))
    two = ranking.best(docs, [F.desc(F.pmod(F.col("doc_id") * 37, F.lit(101))), F.asc("doc_id")], 20).withColumn("list", F.lit(2))
    return one.unionByName(two).groupBy("doc_id").agg(F.min(F.struct("list", "rank")).alias("m")).select("doc_id", "m.list", "m.rank")


@query("WITH r AS (SELECT event_id, user_id, event_type, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS k FROM events) SELECT event_id, user_id, event_type FROM r WHERE k = 1")
def distinct_keep_first(spark, d):
    """U4: one row of each key, the first."""
    return table(spark, d, "events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("event_id"))


@query("SELECT user_id, event_type, count(*) AS n, count(*) - 1 AS excess FROM events GROUP BY ALL HAVING count(*) > 1")
def duplicate_keys(spark, d):
    """Keys that occur more than once."""
    n = F.count(F.lit(1))
    return table(spark, d, "events").groupBy("user_id", "event_type").agg(n.alias("n"), (n - 1).alias("excess")).filter("n > 1")


@query("SELECT doc_id, quality FROM labels WHERE doc_id IN (SELECT doc_id FROM documents WHERE lang = 'en')")
def prune_stale(spark, d):
    """Entries whose key is still live."""
    return table(spark, d, "labels").join(table(spark, d, "documents").filter("lang = 'en'").select("doc_id"), "doc_id", "left_semi").select("doc_id", "quality")


@query("SELECT 'unlabelled' AS kind, count(*) AS n FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT 'orphan', count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents) UNION ALL SELECT 'both', count(*) FROM (SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels)")
def coverage_orphans(spark, d):
    """Differences and intersection of key sets."""
    docs, labels = (table(spark, d, t).select("doc_id").distinct() for t in ("documents", "labels"))
    count = lambda df, kind: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), "n")
    return count(docs.join(labels, "doc_id", "left_anti"), "unlabelled").unionByName(count(labels.join(docs, "doc_id", "left_anti"), "orphan")).unionByName(count(docs.intersect(labels), "both"))


@query("WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i, count(*) OVER () AS n FROM documents), k AS (SELECT DISTINCT round_even(j * (SELECT max(n) - 1 FROM r) / 49.0, 0)::BIGINT AS i FROM (SELECT unnest(range(50)) AS j)) SELECT doc_id FROM r JOIN k USING (i)")
def stride_sample(spark, d):
    """Evenly spaced rows; halves round to the even index."""
    return ranking.stride_sample(table(spark, d, "documents").select("doc_id"), "doc_id", 50)


@query("SELECT doc_id FROM documents ORDER BY md5('42:' || doc_id), doc_id LIMIT 100")
def seeded_sample(spark, d):
    """A seeded random sample, if there are more rows than asked for."""
    docs = table(spark, d, "documents").select("doc_id")
    return docs.orderBy(F.md5(F.concat(F.lit("42:"), F.col("doc_id").cast("string"))), "doc_id").limit(100)
