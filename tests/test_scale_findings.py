"""Queries against their SQL on rows that the given small tables lack, and on groups that one task could not take."""

import math

import duckdb
import numpy as np
import oracle

from siftstone import catalog
from siftstone.operators import cluster, match
from siftstone.plans import fingerprints


def differs(spark, tmp_path, name, table, df):
    """What the query and its SQL make differently of one table."""
    df.write.parquet(str(tmp_path / f"{table}.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{tmp_path}/{table}.parquet/*.parquet')")
    return oracle.compare(catalog.queries()[name](spark, str(tmp_path)), catalog.oracle_sql()[name], con)


def test_payloads_of_long_and_odd_urls(spark, tmp_path):
    urls = ["http://a.example/" + "x" * n for n in (0, 39, 40, 41, 200)] + ["a~b*c d+e(f)!'%7E%/g", "", None]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    assert differs(spark, tmp_path, "encode_payload", "pages", pages) == ""


def test_scores_round_as_their_sql(spark, tmp_path):
    """Scores that end in a half at the seventh digit, of all prices of a range."""
    rows = spark.range(20_000).selectExpr("id l_orderkey", "1 l_linenumber", "50.0D l_quantity", "(90000 + id) / 100.0D l_extendedprice", "(id % 11) / 100.0D l_discount", "(id % 9) / 100.0D l_tax")
    odd = spark.sql("SELECT -1L l_orderkey, 1 l_linenumber, CAST(NULL AS DOUBLE) l_quantity, 1D l_extendedprice, 0D l_discount, 0D l_tax UNION ALL SELECT -2, 1, 1D, -1e9, -3D, 2D UNION ALL SELECT -3, 1, 1D, -1e306, 0D, 0D")
    rows.unionByName(odd).write.parquet(str(tmp_path / "lineitem.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM read_parquet('{tmp_path}/lineitem.parquet/*.parquet')")
    want = dict(con.execute("SELECT l_orderkey, score FROM (" + catalog.oracle_sql()["quality_weighted"] + ")").fetchall())
    assert {r.l_orderkey: r.score for r in catalog.queries()["quality_weighted"](spark, str(tmp_path)).collect()} == want


def test_renames_of_over_999_rows_of_a_brand(spark, tmp_path):
    part = spark.range(3000).selectExpr("id * 7 p_partkey", "CASE WHEN id % 3 = 0 THEN 'a' WHEN id % 1000 = 1 THEN NULL ELSE 'b' END p_brand")
    assert differs(spark, tmp_path, "rename_two_phase", "part", part) == ""


def circle(n, step):
    return [[math.cos(math.radians(step * k)), math.sin(math.radians(step * k))] for k in range(n)]


def near(a, b, limit):
    return 1 - sum(x * y for x, y in zip(a, b, strict=True)) <= limit


def test_groups_of_over_20000_rows_are_parted(spark):
    """A component of 20,500 rows of 50 vectors in a ring, and one of two zero vectors, which are near nothing."""
    at = circle(50, 7.2)
    ids = [k * 7919 % 20_507 for k in range(20_500)]
    rows = [(7, i, at[i % 50]) for i in ids] + [(9, 30_001, [0.0, 0.0]), (9, 30_002, [0.0, 0.0])]
    members = spark.createDataFrame(rows, "component long, id long, v array<double>")
    cliques, want = [], {30_001: 0, 30_002: 1}
    for i in sorted(ids):
        fit = next((n for n, c in enumerate(cliques) if all(near(at[i % 50], at[j], 0.02) for j in c)), None)
        if fit is None:
            fit = len(cliques)
            cliques.append(set())
        cliques[fit].add(i % 50)
        want[i] = fit
    assert {r.id: r.clique for r in cluster.clique_split(members, 0.02).collect()} == want
    # 0.02 links neighbours at 7.2 degrees (0.0079) and 0.0124 too; 0.0077 does not, so parts of 300 rows are chunks of one vector's
    parts, want = {}, {frozenset((30_001, 30_002))}
    for r in cluster.recluster(members, 0.02, 300, floor=0.001).collect():
        parts.setdefault((r.component, r.part), set()).add(r.id)
    for k in range(50):
        some = sorted(i for i in ids if i % 50 == k)
        want |= {frozenset(some[n : n + 300]) for n in range(0, len(some), 300)}
    assert set(map(frozenset, parts.values())) == want and {p for c, p in parts if c == 7} == set(range(len(want) - 1))


def test_nearest_of_hundreds_takes_no_row_a_pair(spark):
    """300 targets, 40 of them copies, one without a vector and two with a part of one; ties go to the least, and odd rows have no match."""
    rng = np.random.default_rng(4)
    t = rng.normal(size=(300, 16))
    t[100:140] = t[90]
    v = np.concatenate([rng.normal(size=(500, 16)), t[90:91] * np.arange(1, 11)[:, None]])
    targets = [(k, x.tolist()) for k, x in enumerate(t)] + [(-1, None), (-2, [None] * 16), (-3, [math.nan] * 16)]
    rows = [(k, x.tolist()) for k, x in enumerate(v)] + [(600, [0.0] * 16), (601, None), (602, [math.nan] * 16)]
    out = match.nearest(spark.createDataFrame(rows, "id long, v array<double>"), spark.createDataFrame(targets, "tid long, t array<double>"), 0.75)
    assert "NestedLoopJoin" not in out._jdf.queryExecution().toString()
    unit = lambda x: x / np.linalg.norm(x, axis=1)[:, None]
    dist = np.round(1 - unit(v) @ unit(t).T, 12)
    want = {k: int(d.argmin()) for k, d in enumerate(dist) if d.min() <= 0.75}
    assert {r.id: r.tid for r in out.collect()} == want and want[505] == 90
    two = match.top_two(spark.createDataFrame(rows[500:510], "id long, v array<double>"), spark.createDataFrame(targets[:300], "tid long, t array<double>"))
    assert {(r.tid, r.margin) for r in two.collect()} == {(90, 0.0)}


def test_near_pairs_of_copies_and_repeated_ids(spark, tmp_path):
    """1,200 copies of a text, near ones, ids that come twice in one language or in two, and texts without tokens; no token is shuffled."""
    words = [f"W{k % 97}x{k}" for k in range(400)]
    rows = [(k, " ".join(words), "de") for k in range(1200)] + [(2000 + k, " ".join(words + [f"z{k}"]), "de" if k % 2 else None) for k in range(40)]
    rows += [(5, "more words", "de"), (5, " ".join(words), "en"), (6, "  ", "en"), (7, None, "en"), (8, "", "de"), (3000, "\tÄb  c\n", "en"), (3001, "\täB c\n ", "en"), (3002, " ".join(words), "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert differs(spark, tmp_path, "near_pairs_hamming", "documents", docs) == ""
    out = fingerprints.token_simhash(spark.createDataFrame(rows[:9], docs.schema))
    assert "Generate" not in out._jdf.queryExecution().toString()
