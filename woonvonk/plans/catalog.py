"""All registered queries."""

from __future__ import annotations

import importlib

from woonvonk.plans.registry import JOBS, SQL, Job

MODULES = ["history_queries", "normalize_queries", "score_queries", "report_queries", "engine_queries", "register_queries", "source_queries", "page_queries", "stream_queries"]

for _name in MODULES:
    importlib.import_module(f"woonvonk.plans.{_name}")


def jobs() -> dict[str, Job]:
    return dict(JOBS)


def sql() -> dict[str, str]:
    return dict(SQL)
