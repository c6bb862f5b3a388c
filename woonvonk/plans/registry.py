"""Where the registered queries are kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Job = Callable[[SparkSession, str], DataFrame]

JOBS: dict[str, Job] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Job], Job]:
    """Register a job under ``name``, with the SQL that must give the same rows."""

    def add(job: Job) -> Job:
        if name in JOBS:
            raise ValueError(f"query registered twice: {name}")
        JOBS[name] = job
        if sql is not None:
            SQL[name] = sql
        return job

    return add
