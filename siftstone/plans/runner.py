"""Steps in order, resumable, behind guards."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftstone.operators import snapshot


class StepRunner:
    """Runs named steps in order and records each one done, so that a later run skips it.

    A step is (name, function(spark), needed(spark) or None): without need it counts as skipped. The
    record is one small JSON row in a folder that Spark writes; it is cleared when all are done.
    `guard`, if given, runs before and after every step and raises to stop the run.
    """

    def __init__(self, spark: SparkSession, state: str, guard: Callable[[], None] | None = None):
        self.spark, self.state, self.guard = spark, state, guard

    def done(self) -> dict[str, str]:
        try:
            rows = self.spark.read.text(self.state).collect()
        except AnalysisException:
            return {}
        return json.loads(rows[0][0]) if rows else {}

    def _record(self, done: dict[str, str]) -> None:
        self.spark.createDataFrame([(json.dumps(done),)], "value string").coalesce(1).write.mode("overwrite").text(self.state)

    def run(self, steps: list[tuple[str, Callable, Callable | None]]) -> dict[str, str]:
        """What became of each step: ran, skipped, or done before."""
        done, out = self.done(), {}
        for name, step, needed in steps:
            if name in done:
                out[name] = "done before"
                continue
            if self.guard:
                self.guard()
            if needed is not None and not needed(self.spark):
                out[name] = "skipped"
            else:
                step(self.spark)
                out[name] = "ran"
            if self.guard:
                self.guard()
            done[name] = out[name]
            self._record(done)
        self._record({})
        return out


class Manifest:
    """Versions of a snapshot (path, entity, size, mtime) under a root: init, validate, promote, status, restore plan."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def versions(self) -> list[int]:
        try:
            return sorted(r[0] for r in self.spark.read.parquet(self.root).select("v").distinct().collect())
        except AnalysisException:
            return []

    def current(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/v={self.versions()[-1]}")

    def init(self, entries: DataFrame) -> int:
        if self.versions():
            raise ValueError("there is a manifest already")
        return self._write(entries)

    def _write(self, entries: DataFrame) -> int:
        v = (self.versions() or [-1])[-1] + 1
        entries.write.mode("error").parquet(f"{self.root}/v={v}")
        return v

    def validate(self, entries: DataFrame) -> DataFrame:
        return snapshot.verdict(self.current(), entries)

    def promote(self, entries: DataFrame) -> int:
        """A new version, unless something is missing or changed; earlier versions stay."""
        if self.validate(entries).first()["verdict"] != "promote":
            raise ValueError("entries are missing or changed")
        return self._write(entries)

    def status(self) -> DataFrame:
        """Entries and bytes of each entity in the current version."""
        return self.current().groupBy("entity").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"))

    def restore_plan(self, entries: DataFrame) -> DataFrame:
        """What is missing, as planned actions."""
        missing = snapshot.diff(self.current(), entries).filter("status = 'missing'")
        return missing.select("path", F.lit("planned").alias("status"))


class Registry:
    """Named actions with aliases; an action is a step (name, function, needed) or a list of other actions' names."""

    def __init__(self):
        self.steps: dict[str, tuple[Callable, Callable | None]] = {}
        self.lists: dict[str, list[str]] = {}
        self.aliases: dict[str, str] = {}

    def add(self, name: str, action: Callable | list[str], aliases: tuple[str, ...] = (), needed: Callable | None = None) -> None:
        for key in (name, *aliases):
            if key in self.aliases:
                raise ValueError(f"{key} is taken")
            self.aliases[key] = name
        if isinstance(action, list):
            self.lists[name] = action
        else:
            self.steps[name] = (action, needed)

    def plan(self, key: str, above: tuple[str, ...] = ()) -> list[str]:
        """The steps that a name or alias stands for, in order, lists resolved."""
        name = self.aliases.get(key)
        if name is None:
            raise KeyError(f"no action {key}")
        if name in above:
            raise ValueError(f"{name} contains itself")
        return [name] if name in self.steps else [s for part in self.lists[name] for s in self.plan(part, (*above, name))]

    def run(self, key: str, runner: StepRunner) -> dict[str, str]:
        return runner.run([(name, *self.steps[name]) for name in dict.fromkeys(self.plan(key))])


def preflight(spark: SparkSession, needed: list[str], least_gb: float, memory_mb: float, path: str = ".") -> list[tuple[str, str, str]]:
    """(severity, code, detail) of checks before a run: inputs that can be read, space on disk, memory."""
    import shutil

    found = []
    for p in needed:
        try:
            spark.read.parquet(p).schema  # noqa: B018
        except AnalysisException:
            found.append(("error", "unreadable_input", p))
    free = shutil.disk_usage(path).free / 1e9
    if free < least_gb:
        found.append(("error", "low_disk", f"{free:.0f} GB"))
    if memory_mb < 1200:
        found.append(("error", "low_memory", f"{memory_mb:.0f} MB"))
    elif memory_mb < 3500:
        found.append(("warning", "little_memory", f"{memory_mb:.0f} MB"))
    return found


def partitions_for(memory_mb: float, input_mb: float, share: float = 0.25) -> int:
    """Shuffle partitions so that one fits in a share of a task's memory."""
    return max(1, -(-int(input_mb) // max(1, int(memory_mb * share))))
