"""Reading stored tables, appending to them, and run logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from woonvonk.functions.casts import clamped, text_or_null


def table_scan(
    df: DataFrame, filters: dict | None = None, order_column: str = "created_at", tiebreak: str = "id", ascending: bool = False, limit: int | None = None
) -> DataFrame:
    """Equality filters, newest first; all rows unless ``limit`` is given."""
    for name, wanted in (filters or {}).items():
        df = df.where(F.col(name) == wanted)
    by = F.col(order_column).asc() if ascending else F.col(order_column).desc()
    ordered = df.orderBy(by, tiebreak)
    return ordered if limit is None else ordered.limit(max(1, int(limit)))


def append_snapshots(changes: DataFrame, path: str) -> None:
    """Append changed snapshots, laid out by month so that time ranges prune.

    The rebalance keeps files of one month together, splits large months and joins small ones.
    """
    monthly = changes.withColumn("observed_month", F.date_format("observed_at", "yyyy-MM"))
    monthly.hint("rebalance", "observed_month").write.mode("append").partitionBy("observed_month").parquet(path)


def clean_enrichments(items: DataFrame) -> DataFrame:
    """Items with a key and a property, confidence within 0..100."""
    named = items.where(text_or_null("enrichment_key").isNotNull() & F.col("property_id").isNotNull())
    return named.withColumn(
        "confidence_score", F.coalesce(clamped(F.col("confidence_score").cast("int"), 0, 100), F.lit(0))
    )


def append_enrichments(items: DataFrame, path: str) -> None:
    clean_enrichments(items).write.mode("append").parquet(path)


def close_runs(runs: DataFrame, results: DataFrame) -> DataFrame:
    """Open runs with the outcome of those that ended: status, counters of at least 0, error."""
    counters = {c: F.greatest(F.coalesce(c, F.lit(0)), F.lit(0)).cast("bigint") for c in ("items_found", "items_new", "items_changed")}
    ended = results.select(
        "run_id",
        F.col("status").alias("_status"),
        F.col("completed_at").alias("_completed_at"),
        "error_message",
        *[c.alias(n) for n, c in counters.items()],
    )
    joined = runs.join(ended, "run_id", "left")
    return (
        joined.withColumn("status", F.coalesce("_status", "status"))
        .withColumn("completed_at", F.coalesce("_completed_at", "completed_at"))
        .drop("_status", "_completed_at")
    )


def mark_reviewed(candidates: DataFrame, reviews: DataFrame) -> DataFrame:
    """Candidates with the newest review of each (``candidate_id``, ``review_status``, ``reviewed_at``)."""
    newest = reviews.groupBy("candidate_id").agg(
        F.max_by("review_status", "reviewed_at").alias("_status"), F.max("reviewed_at").alias("reviewed_at")
    )
    return (
        candidates.join(newest, "candidate_id", "left")
        .withColumn("review_status", F.coalesce("_status", "review_status"))
        .drop("_status")
    )
