"""A registry of named DataFrame jobs, and a record of their runs."""

from __future__ import annotations

import importlib
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

RECORD = "job string, status string, dry_run boolean, error string, rows long"


@dataclass(frozen=True)
class Job:
    """What makes a table, where it is written (nowhere without a path), and what it follows."""

    name: str
    make: Callable[[SparkSession], DataFrame]
    path: str | None = None
    priority: int = 50
    triggers: tuple[str, ...] = ()


def loaded(name: str, place: str) -> Job:
    """A job from ``module:function``."""
    module, _, function = place.partition(":")
    return Job(name, getattr(importlib.import_module(module), function))


@dataclass
class Registry:
    """Jobs by name; ``records`` has one row a run: completed, planned (a dry run) or failed, with the error and the rows written."""

    jobs: dict[str, Job] = field(default_factory=dict)
    kept: list[tuple[str, str, bool, str | None, int | None]] = field(default_factory=list)

    def add(self, job: Job) -> Registry:
        self.jobs[job.name] = job
        return self

    def names(self, event: str | None = None) -> list[str]:
        """Jobs by priority, then name; with an event those that it triggers."""
        wanted = [j for j in self.jobs.values() if event is None or event in j.triggers]
        return [j.name for j in sorted(wanted, key=lambda j: (j.priority, j.name))]

    def run(self, spark: SparkSession, name: str, dry_run: bool = False) -> DataFrame | None:
        """The job's table, written if it has a path; a dry run only analyses the plan. A failure is recorded."""
        job, error, made, rows = self.jobs[name], None, None, None
        try:
            made = job.make(spark)
            if dry_run:
                made.schema
            elif job.path:
                made.write.mode("overwrite").parquet(job.path)
                rows = spark.read.schema(made.schema).parquet(job.path).count()
        except Exception as raised:  # any job may fail in any way; the others go on
            error = type(raised).__name__
        self.kept.append((name, "failed" if error else "planned" if dry_run else "completed", dry_run, error, rows))
        return made

    def records(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.kept, RECORD)
