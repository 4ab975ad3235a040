"""Queries on scores, rules, names and other functions of single rows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from siftstone.catalog import query
from siftstone.functions import text as tx
from siftstone.functions import vectors as vec
from siftstone.operators import rules
from siftstone.sources.tables import table


def _lines(spark, d):
    return table(spark, d, "lineitem")


_LINES = "l AS (SELECT * FROM lineitem)"


@query("WITH " + _LINES + " SELECT l_orderkey, l_linenumber, round(exp((ln(greatest(0, least(1, (l_discount * 8 - 0.1) / 0.6)) + 1e-3) + ln(greatest(0, least(1, (l_quantity - 5) / 40)) + 1e-3) + ln(greatest(0, least(1, ln(1 + l_extendedprice) / ln(1 + 60000.0))) + 1e-3) + ln(greatest(0, least(1, l_tax * 12.0)) + 1e-3)) / 4), 6) AS score FROM l")
def quality_score_geo(spark, d):
    """M1: geometric mean of clamped terms."""
    c = rules.clamp
    score = rules.geometric_mean(c((F.col("l_discount") * 8 - 0.1) / 0.6), c((F.col("l_quantity") - 5) / 40), c(F.log1p("l_extendedprice") / F.log1p(F.lit(60000.0))), c(F.col("l_tax") * 12.0))
    return _lines(spark, d).select("l_orderkey", "l_linenumber", F.round(score, 6).alias("score"))


@query("WITH " + _LINES + " SELECT l_orderkey, l_linenumber, round(0.4 * least(1, ln(1 + l_quantity) / ln(51.0)) + 0.3 * least(1, l_extendedprice / 60000) + 0.2 * least(1, l_discount * 10) + 0.1 * (1 - abs(l_tax - 0.04) / 0.04), 6) AS score FROM l")
def quality_weighted(spark, d):
    """M2: a weighted sum of terms."""
    cap = lambda x: F.least(F.lit(1.0), x)
    score = rules.weighted_sum([(cap(F.log1p("l_quantity") / F.ln(F.lit(51.0))), 0.4), (cap(F.col("l_extendedprice") / 60000), 0.3), (cap(F.col("l_discount") * 10), 0.2), (1 - F.abs(F.col("l_tax") - 0.04) / 0.04, 0.1)])
    return _lines(spark, d).select("l_orderkey", "l_linenumber", rules.rounded(score, 6).alias("score"))


@query("WITH " + _LINES + " SELECT l_orderkey, l_linenumber, round(CASE WHEN l_quantity >= 10 THEN greatest(0, least(1, least(0.5, l_quantity * 0.02) + least(0.4, l_discount * 5) - CASE WHEN l_returnflag = 'R' THEN 0.3 ELSE 0 END - CASE WHEN l_tax > 0.06 THEN 0.15 ELSE 0 END)) ELSE 0 END, 6) AS score FROM l")
def score_points(spark, d):
    """M3: points with caps and penalties behind a gate."""
    score = rules.points(F.col("l_quantity") >= 10, [(F.col("l_quantity"), 0.02, 0.5), (F.col("l_discount"), 5.0, 0.4)], [(F.col("l_returnflag") == "R", 0.3), (F.col("l_tax") > 0.06, 0.15)])
    return _lines(spark, d).select("l_orderkey", "l_linenumber", F.round(score, 6).alias("score"))


@query("""
WITH e AS (SELECT user_id, event_id, value, value - lag(value) OVER w AS d1 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)), f AS (SELECT user_id, d1 - lag(d1) OVER (PARTITION BY user_id ORDER BY event_id) AS d2, value FROM e)
SELECT user_id, round(var_pop(d2), 3) AS sharpness, round(avg(value), 4) AS brightness, round(stddev_pop(value), 4) AS contrast FROM f GROUP BY 1
""")
def second_diff_variance(spark, d):
    """M4: variance of second differences, mean and deviation of a series."""
    w = Window.partitionBy("user_id").orderBy("event_id")
    e = table(spark, d, "events").select("user_id", "event_id", "value", (F.col("value") - F.lag("value").over(w)).alias("d1"))
    f = e.withColumn("d2", F.col("d1") - F.lag("d1").over(w))
    return f.groupBy("user_id").agg(F.round(F.var_pop("d2"), 3).alias("sharpness"), F.round(F.avg("value"), 4).alias("brightness"), F.round(F.stddev_pop("value"), 4).alias("contrast"))


@query("SELECT p_partkey, CASE WHEN p_size / 25.0 > 1.2 THEN 'landscape' WHEN p_size / 25.0 < 0.82 THEN 'portrait' ELSE 'square' END AS shape, CASE WHEN p_retailprice >= 1500 AND p_size >= 20 THEN 'high' WHEN p_retailprice >= 1200 THEN 'medium' ELSE 'low' END AS quality, CASE WHEN p_size % 36 < 6 THEN 'red' WHEN p_size % 36 < 18 THEN 'green' ELSE 'blue' END AS hue FROM part")
def buckets(spark, d):
    """M5: buckets of shape, quality and hue."""
    ratio = F.col("p_size") / 25.0
    hue = F.col("p_size") % 36
    return table(spark, d, "part").select(
        "p_partkey",
        rules.first_of([(ratio > 1.2, "landscape"), (ratio < 0.82, "portrait")], "square").alias("shape"),
        rules.first_of([((F.col("p_retailprice") >= 1500) & (F.col("p_size") >= 20), "high"), (F.col("p_retailprice") >= 1200, "medium")], "low").alias("quality"),
        rules.first_of([(hue < 6, "red"), (hue < 18, "green")], "blue").alias("hue"),
    )


@query("SELECT doc_id, CASE WHEN b < 1024 THEN 'B' WHEN b < 1048576 THEN 'KB' ELSE 'MB' END AS unit, round(CASE WHEN b < 1024 THEN b ELSE CASE WHEN b < 1048576 THEN b / 1024 ELSE b / 1048576 END END, 3) AS size FROM (SELECT doc_id, n_chars * 37 AS b FROM documents)")
def human_size(spark, d):
    """M6: a size in the greatest unit below it; the figure stays a number."""
    b = F.col("n_chars") * 37
    unit = rules.first_of([(b < 1024, "B"), (b < 1048576, "KB")], "MB")
    return table(spark, d, "documents").select("doc_id", unit.alias("unit"), F.round(b / F.when(unit == "B", 1.0).when(unit == "KB", 1024.0).otherwise(1048576.0), 3).alias("size"))


@query("""
WITH s AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity < 3 THEN ['low_resolution'] ELSE list_filter([CASE WHEN l_discount >= 0.08 THEN 'cheap' END, CASE WHEN l_tax <= 0.01 THEN 'light' END, CASE WHEN l_extendedprice > 50000 THEN 'large' END, CASE WHEN l_discount >= 0.08 AND l_extendedprice > 50000 THEN 'best_candidate' END], lambda x: x IS NOT NULL) END AS labels FROM lineitem)
SELECT l_orderkey, l_linenumber, unnest(CASE WHEN len(labels) = 0 THEN ['plain'] ELSE labels END) AS label FROM s
""")
def rule_labels_multi(spark, d):
    """Exclusive, accumulating, derived and fallback labels."""
    labels = rules.cascade([(F.col("l_quantity") < 3, "low_resolution")], [(F.col("l_discount") >= 0.08, "cheap"), (F.col("l_tax") <= 0.01, "light"), (F.col("l_extendedprice") > 50000, "large")], "plain", {"best_candidate": ["cheap", "large"]})
    return _lines(spark, d).select("l_orderkey", "l_linenumber", F.explode(labels).alias("label"))


_DET = "WITH t AS (SELECT * FROM (VALUES ('view', 0.45), ('purchase', 0.7), ('error', 0.2)) t(class, threshold)), r AS (SELECT user_id, event_type AS class, value / 200 AS score FROM events)"


def _detections(spark, d):
    return table(spark, d, "events").select("event_id", "user_id", F.col("event_type").alias("class"), (F.col("value") / 200).alias("score"))


@query(_DET + ", b AS (SELECT user_id, arg_max(class, (score, class)) AS class, max(score) AS score FROM r JOIN t USING (class) GROUP BY 1) SELECT user_id, class, round(score, 6) AS score, CASE WHEN score >= greatest(0.45, threshold) THEN 'possible' ELSE 'uncertain' END AS verdict FROM b JOIN t USING (class)")
def detections_classified(spark, d):
    """The best-scored listed class, against its threshold."""
    limits = spark.createDataFrame([("view", 0.45), ("purchase", 0.7), ("error", 0.2)], "class string, threshold double")
    return rules.classify_detections(_detections(spark, d), "user_id", limits, 0.45).withColumn("score", F.round("score", 6))


@query("SELECT user_id, string_agg(event_type || ':' || (value * 1000)::BIGINT, ';' ORDER BY event_id) AS detections FROM events GROUP BY 1")
def detections_string(spark, d):
    """A list of detections as delimited text, in thousandths."""
    item = F.concat_ws(":", "class", F.round(F.col("score") * 200 * 1000).cast("long").cast("string"))
    items = F.array_sort(F.collect_list(F.struct("event_id", item.alias("s"))))
    return _detections(spark, d).groupBy("user_id").agg(F.array_join(F.transform(items, lambda x: x["s"]), ";").alias("detections"))


@query("""
WITH t AS (SELECT doc_id AS source, 'quality' AS category, CASE WHEN quality = 1 THEN 'good' ELSE 'bad' END AS label, (doc_id % 10) / 10.0 AS confidence FROM labels UNION ALL SELECT doc_id, 'toxic', CASE WHEN toxic = 1 THEN 'toxic' ELSE 'clean' END, ((doc_id + 3) % 10) / 10.0 FROM labels UNION ALL SELECT doc_id, 'quality', 'second', 0.5 FROM labels WHERE doc_id % 2 = 0),
b AS (SELECT source, category, arg_max(label, (confidence, label)) AS label, max(confidence) AS confidence FROM t GROUP BY ALL)
SELECT d.doc_id AS source, q.label AS quality_label, q.confidence::DOUBLE AS quality_confidence, x.label AS toxic_label, x.confidence::DOUBLE AS toxic_confidence FROM (SELECT DISTINCT doc_id FROM labels) d LEFT JOIN b q ON q.source = d.doc_id AND q.category = 'quality' LEFT JOIN b x ON x.source = d.doc_id AND x.category = 'toxic'
""")
def tags_best_pivot(spark, d):
    """Tags as a long table, the best of each category as columns."""
    lab = table(spark, d, "labels")
    tag = lambda cat, label, conf: lab.select(F.col("doc_id").alias("source"), F.lit(cat).alias("category"), label.alias("label"), conf.cast("double").alias("confidence"))
    tags = tag("quality", F.when(F.col("quality") == 1, "good").otherwise("bad"), F.col("doc_id") % 10 / 10)
    tags = tags.unionByName(tag("toxic", F.when(F.col("toxic") == 1, "toxic").otherwise("clean"), (F.col("doc_id") + 3) % 10 / 10))
    tags = tags.unionByName(tag("quality", F.lit("second"), F.lit(0.5)).filter("source % 2 = 0"))
    return rules.best_tags(tags, ["quality", "toxic"])


@query("SELECT p_partkey, lower(regexp_replace(trim(p_type), '\\s+', ' ', 'g')) AS key, coalesce(nullif(regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(p_name), '[^A-Za-z0-9._ -]+', '_', 'g'), '\\s+', '_', 'g'), '_+', '_', 'g'), '^[._]+|[._]+$', '', 'g')[1:80], ''), 'person') AS name FROM part")
def sanitize_names(spark, d):
    """Names fit for files, and keys for matching."""
    return table(spark, d, "part").select("p_partkey", tx.match_key(F.col("p_type")).alias("key"), tx.safe_name(F.col("p_name")).alias("name"))


_ODD = "n AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_name || '/' || p_size WHEN 1 THEN ' ' || p_name || ': \\ *' WHEN 2 THEN '._-' || p_type || '?' ELSE '   ' END AS name FROM part)"


@query("WITH " + _ODD + """
SELECT p_partkey, regexp_replace(trim(name), '[/\\\\:*?"<>|]', '_', 'g') AS plain,
coalesce(nullif(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(name), '\\s+', '_', 'g'), '[^A-Za-z0-9._-]+', '_', 'g'), '_+', '_', 'g'), '^[._-]+|[._-]+$', '', 'g')[1:64], '[._-]+$', '', 'g'), ''), 'image') AS part,
coalesce(nullif(regexp_replace(trim(name), '[/:]', '_', 'g'), ''), 'unnamed') AS folder FROM n
""")
def sanitize_rules(spark, d):
    """The other three sets of rules for names: plain, part of a name, folder."""
    k = F.col("p_partkey") % 4
    name = F.when(k == 0, F.concat_ws("/", "p_name", F.col("p_size").cast("string"))).when(k == 1, F.concat(F.lit(" "), "p_name", F.lit(": \\ *"))).when(k == 2, F.concat(F.lit("._-"), "p_type", F.lit("?"))).otherwise("   ")
    return table(spark, d, "part").select("p_partkey", tx.plain_name(name).alias("plain"), tx.name_part(name).alias("part"), tx.folder_name(name).alias("folder"))


@query("SELECT p_partkey, regexp_extract(p_brand, '(?i)^brand#?(\\d+)$', 1) AS idx, regexp_matches(p_brand, '(?i)^brand') AS ours, coalesce(TRY_CAST(nullif(regexp_extract(p_brand, '(\\d+)', 1), '') AS INT), 0) AS n FROM part")
def token_extract(spark, d):
    """Indexes and tokens by regular expression."""
    b = F.col("p_brand")
    return table(spark, d, "part").select("p_partkey", F.regexp_extract(b, r"(?i)^brand#?(\d+)$", 1).alias("idx"), b.rlike("(?i)^brand").alias("ours"), F.coalesce(F.nullif(F.regexp_extract(b, r"(\d+)", 1), F.lit("")).try_cast("int"), F.lit(0)).alias("n"))


@query("SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host, regexp_extract(url, '^[a-z]+://[^/]+([^?#]*)', 1) AS path, list_last(string_split(regexp_extract(url, '^[a-z]+://[^/]+([^?#]*)', 1), '/')) AS name FROM pages")
def url_parts(spark, d):
    """Parts of a path."""
    path = F.regexp_extract("url", "^[a-z]+://[^/]+([^?#]*)", 1)
    return table(spark, d, "pages").select("page_id", F.parse_url("url", F.lit("HOST")).alias("host"), path.alias("path"), F.element_at(F.split(path, "/"), -1).alias("name"))


@query("SELECT n_nationkey, lower(regexp_replace(trim('  ' || n_name || '   x'), '\\s+', ' ', 'g')) AS key FROM nation")
def normal_key(spark, d):
    """R2: white space squeezed, lower case."""
    return table(spark, d, "nation").select("n_nationkey", tx.match_key(F.concat(F.lit("  "), "n_name", F.lit("   x"))).alias("key"))


@query("SELECT doc_id, contains(t, ' license ') AS license, contains(t, ' the ') OR contains(t, ' and ') AS english, contains(t, ' der ') OR contains(t, ' und ') AS german FROM (SELECT doc_id, ' ' || lower(text) || ' ' AS t FROM documents)")
def keyword_flags(spark, d):
    """Flags by keywords in padded text."""
    t = F.concat(F.lit(" "), F.lower("text"), F.lit(" "))
    has = lambda *words: F.exists(F.array(*[F.lit(f" {w} ") for w in words]), lambda w: F.col("t").contains(w))
    return table(spark, d, "documents").select("doc_id", t.alias("t")).select("doc_id", has("license").alias("license"), has("the", "and").alias("english"), has("der", "und").alias("german"))


@query("SELECT event_id, strftime(ts, '%Y%m%d_%H%M%S') AS run_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS iso FROM events")
def run_ids(spark, d):
    """Run ids and ISO times."""
    return table(spark, d, "events").select("event_id", F.date_format("ts", "yyyyMMdd_HHmmss").alias("run_id"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("iso"))


@query("SELECT event_id, 'p/' || user_id AS source_path, event_type AS op, json_extract_string(props, '$.k') AS extra_k FROM events")
def event_struct(spark, d):
    """Nested event structs with a free map of further fields."""
    e = table(spark, d, "events")
    event = F.struct(F.struct(F.concat(F.lit("p/"), F.col("user_id").cast("string")).alias("path")).alias("source"), F.col("event_type").alias("op"), F.from_json("props", "map<string,string>").alias("extra"))
    return e.select("event_id", event.alias("e")).select("event_id", F.col("e.source.path").alias("source_path"), F.col("e.op").alias("op"), F.col("e.extra")["k"].alias("extra_k"))


@query("SELECT page_id, base64(url::BLOB) AS b64, url_encode(url) AS quoted FROM pages")
def encode_payload(spark, d):
    """base64 in one line and URL quoting."""
    return table(spark, d, "pages").select("page_id", tx.base64_line(F.col("url").cast("binary")).alias("b64"), tx.url_quoted(F.col("url")).alias("quoted"))


@query("SELECT p_partkey, greatest(0, p_size - 12)::INT AS x1, greatest(0, p_size - 3)::INT AS y1, least(60, p_size + 12)::INT AS x2, least(45, p_size + 21)::INT AS y2 FROM part")
def pad_box(spark, d):
    """A square around a box, padded and clamped to the image."""
    s = F.col("p_size")
    return table(spark, d, "part").select("p_partkey", F.greatest(F.lit(0), s - 12).alias("x1"), F.greatest(F.lit(0), s - 3).alias("y1"), F.least(F.lit(60), s + 12).alias("x2"), F.least(F.lit(45), s + 21).alias("y2"))


@query("""
WITH k AS (SELECT p_partkey, (p_size % 11 - 5) / 10.0 AS off, p_size % 7 - 3 AS dy, 5 + p_size % 5 AS dx FROM part)
SELECT p_partkey, round(greatest(0, least(1, 1 - 4 * abs(off))), 6) AS yaw, round(degrees(atan2(dy, dx)), 6) AS roll, CASE WHEN off < -0.34 THEN 'left' WHEN off < -0.18 THEN 'half_left' WHEN off > 0.34 THEN 'right' WHEN off > 0.18 THEN 'half_right' ELSE 'front' END AS angle FROM k
""")
def keypoint_geometry(spark, d):
    """Yaw, roll and angle from key points."""
    k = table(spark, d, "part").select("p_partkey", ((F.col("p_size") % 11 - 5) / 10.0).alias("off"), (F.col("p_size") % 7 - 3).cast("double").alias("dy"), (5 + F.col("p_size") % 5).cast("double").alias("dx"))
    o = F.col("off")
    angle = rules.first_of([(o < -0.34, "left"), (o < -0.18, "half_left"), (o > 0.34, "right"), (o > 0.18, "half_right")], "front")
    return k.select("p_partkey", F.round(rules.clamp(1 - 4 * F.abs(o)), 6).alias("yaw"), F.round(F.degrees(F.atan2("dy", "dx")), 6).alias("roll"), angle.alias("angle"))


@query()
def nms_boxes(spark, d):
    """V9: overlapping boxes give way to larger ones."""
    x = (F.col("p_size") * 3).cast("double")
    box = F.struct(x.alias("x1"), x.alias("y1"), (x + 10 + F.col("p_partkey") % 13).alias("x2"), (x + 12).alias("y2"))
    boxes = table(spark, d, "part").groupBy("p_brand").agg(F.collect_list(box).alias("boxes"))
    return boxes.select("p_brand", F.size("boxes").alias("n"), F.size(vec.suppress_boxes(F.col("boxes"))).alias("kept"))


@query("SELECT vec_id, (name <> '' AND name <> 'unknown' AND name <> '__junk__' AND NOT starts_with(name, 'person_')) AS is_real FROM (SELECT vec_id, CASE vec_id % 6 WHEN 0 THEN '' WHEN 1 THEN 'unknown' WHEN 2 THEN '__junk__' WHEN 3 THEN 'person_007' ELSE 'n' || label END AS name FROM embeddings)")
def real_labels(spark, d):
    """labels that a person gave."""
    k = F.col("vec_id") % 6
    name = F.when(k == 0, "").when(k == 1, "unknown").when(k == 2, "__junk__").when(k == 3, "person_007").otherwise(F.concat(F.lit("n"), F.col("label").cast("string")))
    return table(spark, d, "embeddings").select("vec_id", tx.real_label(name).alias("is_real"))


@query("WITH r AS (SELECT vec_id, label, count(*) OVER (PARTITION BY label, vec_id % 13) AS n, vec_id % 3 = 0 AS auto FROM embeddings) SELECT vec_id, CASE WHEN auto AND n < 5 THEN '__junk__' ELSE 'c' || label END AS label FROM r")
def mark_junk_small(spark, d):
    """unlabelled rows of small clusters are junk; real labels stay."""
    e = table(spark, d, "embeddings").select("vec_id", "label", (F.col("vec_id") % 13).alias("c"))
    sizes = e.groupBy("label", "c").agg(F.count(F.lit(1)).alias("n"))
    junk = (F.col("vec_id") % 3 == 0) & (F.col("n") < 5)
    return e.join(sizes, ["label", "c"]).select("vec_id", F.when(junk, "__junk__").otherwise(F.concat(F.lit("c"), F.col("label").cast("string"))).alias("label"))


@query("SELECT d.doc_id, coalesce(CASE WHEN d.doc_id % 11 = 0 THEN 'manual' END, CASE WHEN l.toxic = 1 THEN 'possible' END, CASE WHEN d.n_chars > 5000 THEN 'cached' END, 'fresh') AS status FROM documents d LEFT JOIN labels l USING (doc_id)")
def override_precedence(spark, d):
    """manual before existing before cached before fresh."""
    rows = table(spark, d, "documents").select("doc_id", "n_chars").join(table(spark, d, "labels").select("doc_id", "toxic"), "doc_id", "left")
    return rows.select("doc_id", F.coalesce(F.when(F.col("doc_id") % 11 == 0, "manual"), F.when(F.col("toxic") == 1, "possible"), F.when(F.col("n_chars") > 5000, "cached"), F.lit("fresh")).alias("status"))


@query("SELECT doc_id, min(origin) AS origin FROM (SELECT doc_id, 'a_cache' AS origin FROM labels WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id, 'b_state' FROM labels WHERE doc_id % 3 = 0) GROUP BY 1")
def label_sources_union(spark, d):
    """finished labels, and those in progress for new rows only."""
    lab = table(spark, d, "labels").select("doc_id").distinct()
    done = lab.filter("doc_id % 2 = 0").withColumn("origin", F.lit("a_cache"))
    return done.unionByName(lab.filter("doc_id % 3 = 0").join(done.select("doc_id"), "doc_id", "left_anti").withColumn("origin", F.lit("b_state")))


@query("WITH " + _LINES + " SELECT l_orderkey, l_linenumber, round(l_extendedprice / 7, 3) AS price, round(l_tax / 3, 3) AS tax FROM l")
def report_numbers(spark, d):
    """Figures of a report, rounded but still numbers."""
    return _lines(spark, d).select("l_orderkey", "l_linenumber", F.round(F.col("l_extendedprice") / 7, 3).alias("price"), F.round(F.col("l_tax") / 3, 3).alias("tax"))


@query("SELECT event_id AS id, event_id % 7 <> 0 AS ok, CASE WHEN event_id % 7 <> 0 THEN TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) END AS value, CASE WHEN event_id % 7 = 0 THEN 'JSONDecodeError' END AS error FROM events")
def batch_inference(spark, d):
    """A model per task on whole batches; rows of a failed batch are tried alone."""
    from siftstone.operators.inference import infer

    def load():
        import json

        return lambda texts: [float(json.loads(t)["k"]) for t in texts]

    raw = F.when(F.col("event_id") % 7 == 0, "{broken").otherwise(F.col("props"))
    return infer(table(spark, d, "events").select("event_id", raw.alias("raw")), "event_id", "raw", load)
