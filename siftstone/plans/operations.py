"""Queries on writing and running: atomic tables, resumable steps, manifests, preflight checks, actions."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftstone.catalog import query
from siftstone.plans import runner
from siftstone.sources import sinks
from siftstone.sources.tables import table
from siftstone.streaming.micro import work_dir


@query("SELECT 'backup' AS which, doc_id, n_chars FROM documents WHERE lang = 'en' UNION ALL SELECT 'now', doc_id, n_chars + 1 FROM documents WHERE lang <> 'de'")
def replaced_table(spark, d):
    """K1 K2: a table is replaced as a whole; readers see the new one, and the old one is its backup."""
    docs = table(spark, d, "documents").select("doc_id", "lang", "n_chars")
    place = f"{work_dir(spark)}/report"
    sinks.replace_table(docs.filter("lang = 'en'").select("doc_id", "n_chars"), place, "r1")
    backup = sinks.replace_table(docs.filter("lang <> 'de'").select("doc_id", (F.col("n_chars") + 1).alias("n_chars")), place, "r2")
    read = lambda path, name: spark.read.parquet(path).select(F.lit(name).alias("which"), "doc_id", "n_chars")
    return read(backup, "backup").unionByName(read(place, "now"))


@query("SELECT * FROM (VALUES (1, 'scan', 'ran'), (1, 'hash', 'stopped'), (2, 'scan', 'done before'), (2, 'hash', 'ran'), (2, 'publish', 'skipped'), (2, 'report', 'ran')) v(run, step, outcome)")
def resumed_steps(spark, d):
    """A run that breaks off is taken up where it stopped; steps without need are skipped."""
    place = work_dir(spark)
    broken = [True]

    def hashes(session):
        if broken:
            broken.clear()
            raise RuntimeError("lost")
        table(session, d, "documents").select("doc_id", F.sha2("text", 256).alias("hash")).write.parquet(f"{place}/hashes")

    steps = [
        ("scan", lambda session: table(session, d, "documents").select("doc_id").write.parquet(f"{place}/scan"), None),
        ("hash", hashes, None),
        ("publish", lambda session: None, lambda session: table(session, d, "documents").isEmpty()),
        ("report", lambda session: session.read.parquet(f"{place}/hashes").groupBy("hash").count().write.parquet(f"{place}/report"), None),
    ]
    run = runner.StepRunner(spark, f"{place}/state")
    out = []
    try:
        run.run(steps)
    except RuntimeError:
        out += [(1, name, "ran") for name in run.done()] + [(1, "hash", "stopped")]
    out += [(2, name, outcome) for name, outcome in run.run(steps).items()]
    return spark.createDataFrame(out, "run int, step string, outcome string")


_ENTRIES = "SELECT 'd/' || doc_id AS path, lang AS entity, n_chars AS size, 0::BIGINT AS mtime FROM documents"


@query("WITH e AS (" + _ENTRIES + ") SELECT entity, count(*) AS n, sum(size)::BIGINT AS bytes, count(*) FILTER (path LIKE '%7') AS lost FROM e GROUP BY 1")
def manifest_status(spark, d):
    """A manifest is begun, refuses entries that lack some, and tells what is there and what is to be restored."""
    entries = table(spark, d, "documents").select(F.concat(F.lit("d/"), F.col("doc_id").cast("string")).alias("path"), F.col("lang").alias("entity"), F.col("n_chars").alias("size"), F.lit(0).cast("long").alias("mtime"))
    manifest = runner.Manifest(spark, f"{work_dir(spark)}/manifest")
    manifest.init(entries)
    fewer = entries.filter(~F.col("path").endswith("7"))
    lost = manifest.restore_plan(fewer).join(entries, "path").groupBy("entity").agg(F.count(F.lit(1)).alias("lost"))
    return manifest.status().join(lost, "entity", "left").select("entity", "n", "bytes", F.coalesce("lost", F.lit(0)).alias("lost"))


@query("SELECT * FROM (VALUES ('error', 'unreadable_input', 'no_such_table'), ('warning', 'little_memory', '2000 MB')) v(severity, code, detail)")
def preflight_findings(spark, d):
    """Q5: what stands against a run: an input that cannot be read, little memory."""
    found = runner.preflight(spark, [f"{d}/documents.parquet", f"{d}/no_such_table.parquet"], 0.0, 2000.0)
    return spark.createDataFrame([(s, c, x.rsplit("/", 1)[-1].removesuffix(".parquet")) for s, c, x in found], "severity string, code string, detail string")


@query("SELECT * FROM (VALUES ('daily', 0, 'scan'), ('daily', 1, 'hash'), ('daily', 2, 'report'), ('all', 0, 'scan'), ('all', 1, 'hash'), ('all', 2, 'report'), ('all', 3, 'prune'), ('s', 0, 'scan')) v(key, place, step)")
def action_steps(spark, d):
    """P5: the steps that names, aliases and lists of actions stand for."""
    actions = runner.Registry()
    for name, aliases in (("scan", ("s",)), ("hash", ()), ("report", ("r",)), ("prune", ())):
        actions.add(name, lambda session: None, aliases)
    actions.add("daily", ["scan", "hash", "r"])
    actions.add("everything", ["daily", "prune"], ("all",))
    return spark.createDataFrame([(key, k, step) for key in ("daily", "all", "s") for k, step in enumerate(actions.plan(key))], "key string, place int, step string")
