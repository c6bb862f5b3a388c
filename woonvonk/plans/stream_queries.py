"""Streaming queries: observations land in two steps and each stream is restarted for the second one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from woonvonk.operators import history
from woonvonk.plans.registry import query
from woonvonk.plans.views import r2, view, with_views
from woonvonk.session import scratch_path
from woonvonk.streaming import jobs

SPLIT = "2024-01-15 00:00:00"


def _observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "observations").withColumn("observed_at", F.col("observed_at").cast("timestamp"))


def _land(parts: list[DataFrame], landing: str, run: Callable[[], object]) -> None:
    """Land each part and run the stream over what is new."""
    for k, part in enumerate(parts):
        jobs.land(part, landing, k)
        run().awaitTermination()


def _halves(spark, sf_dir) -> list[DataFrame]:
    rows = _observations(spark, sf_dir)
    split = F.lit(SPLIT).cast("timestamp")
    return [rows.where(F.col("observed_at") < split), rows.where(F.col("observed_at") >= split)]


def _mixed(spark, sf_dir) -> list[DataFrame]:
    """Two landings whose times overlap: every third row, mostly old ones, comes with the second."""
    rows = _observations(spark, sf_dir)
    late = (F.col("seq") % 3 == 1) | (F.col("observed_at") >= F.lit(SPLIT).cast("timestamp"))
    return [rows.where(~late), rows.where(late)]


def _paths(spark) -> tuple[str, str, str]:
    base = scratch_path(spark, "stream")
    return f"{base}/landing", f"{base}/table", f"{base}/checkpoint"


def _table(spark, sf_dir, build: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Run ``build`` as a stream over both landings and read the table it wrote."""
    landing, out, mark = _paths(spark)
    _land(_halves(spark, sf_dir), landing, lambda: jobs.write_table(build(jobs.read_observations(spark, landing)), out, mark))
    return spark.read.parquet(out)


def _partials(spark, sf_dir, build: Callable[[DataFrame], DataFrame]) -> str:
    """Run ``build`` per micro-batch over both landings; where its parts are."""
    landing, out, mark = _paths(spark)
    _land(_mixed(spark, sf_dir), landing, lambda: jobs.partial_counts(jobs.read_observations(spark, landing), build, out, mark))
    return out


@query(
    "stream_ingest",
    with_views("observations", "SELECT cast(time_bucket(INTERVAL '15 minutes', observed_at) as varchar) AS scan_started_at, count(*) AS observation_count, sum(asking_price) AS price_sum FROM observations GROUP BY 1"),
)
def stream_ingest(spark, sf_dir):
    table = _table(spark, sf_dir, jobs.stream_ingest)
    return table.groupBy(F.col("scan_started_at").cast("string").alias("scan_started_at")).agg(
        F.count(F.lit(1)).alias("observation_count"), F.sum("asking_price").alias("price_sum")
    )


@query(
    "stream_only_new",
    with_views(
        "observations",
        """SELECT listing_id, seq, cast(observed_at as varchar) AS observed_at, asking_price FROM observations
        QUALIFY row_number() OVER (PARTITION BY listing_id ORDER BY observed_at, seq) = 1""",
    ),
)
def stream_only_new(spark, sf_dir):
    """The later half lands first, so nearly every listing is corrected by the second landing."""
    landing, out, mark = _paths(spark)
    _land(_halves(spark, sf_dir)[::-1], landing, lambda: jobs.only_new(jobs.read_observations(spark, landing), out, mark))
    return jobs.first_seen(spark, out).select("listing_id", "seq", F.col("observed_at").cast("string").alias("observed_at"), "asking_price")


@query(
    "stream_change_detection",
    with_views(
        "observations",
        """WITH looked AS (SELECT *, row_number() OVER w AS rn, lag(asking_price) OVER w AS old_price, lag(listing_status) OVER w AS old_status FROM observations WINDOW w AS (PARTITION BY listing_id ORDER BY observed_at, seq))
        SELECT listing_id, seq, CASE WHEN rn = 1 THEN 'new_listing' WHEN old_status <> 'active' AND listing_status = 'active' THEN 'relisting_signal' WHEN old_price IS DISTINCT FROM asking_price THEN 'asking_price_change' ELSE 'listing_status_change' END AS change_type
        FROM looked WHERE rn = 1 OR old_price IS DISTINCT FROM asking_price OR old_status IS DISTINCT FROM listing_status""",
    ),
)
def stream_change_detection(spark, sf_dir):
    landing, out, mark = _paths(spark)
    _land(_mixed(spark, sf_dir), landing, lambda: jobs.change_detection(jobs.read_observations(spark, landing), out, mark))
    return jobs.detected_changes(spark, out).select("listing_id", "seq", "change_type")


@query(
    "stream_upsert_current",
    with_views(
        "observations",
        """SELECT listing_id, seq, asking_price, listing_status, cast(min(observed_at) OVER (PARTITION BY listing_id) as varchar) AS first_seen_at FROM observations QUALIFY row_number() OVER (PARTITION BY listing_id ORDER BY observed_at DESC, seq DESC) = 1""",
    ),
)
def stream_upsert_current(spark, sf_dir):
    landing, out, mark = _paths(spark)
    _land(_halves(spark, sf_dir), landing, lambda: jobs.upsert_current(jobs.read_observations(spark, landing), out, mark))
    current = jobs.current_state(spark, out)
    return current.select("listing_id", "seq", "asking_price", "listing_status", F.col("first_seen_at").cast("string").alias("first_seen_at"))


@query(
    "stream_price_stats",
    with_views(
        "observations",
        """WITH w AS (SELECT time_bucket(INTERVAL '15 minutes', observed_at) AS s, source_id, count(*) AS observation_count, count(CASE WHEN listing_status = 'sold' THEN 1 END) AS sold_count, sum(asking_price) AS price_sum FROM observations GROUP BY 1, 2)
        SELECT cast(s as varchar) AS window_start, source_id, observation_count, sold_count, price_sum FROM w""",
    ),
)
def stream_price_stats(spark, sf_dir):
    table = jobs.price_stats(spark, _partials(spark, sf_dir, lambda rows: jobs.panes(rows, "15 minutes")), "15 minutes")
    return table.select(F.col("window_start").cast("string").alias("window_start"), "source_id", "observation_count", "sold_count", "price_sum")


@query(
    "stream_price_stats_sliding",
    with_views(
        "observations",
        """WITH w AS (SELECT time_bucket(INTERVAL '1 hour', observed_at) - to_hours(k) AS s, source_id, asking_price FROM observations, range(24) AS r(k)),
        g AS (SELECT s, source_id, count(*) AS observation_count, sum(asking_price) AS price_sum FROM w GROUP BY 1, 2)
        SELECT cast(s as varchar) AS window_start, source_id, observation_count, price_sum FROM g""",
    ),
)
def stream_price_stats_sliding(spark, sf_dir):
    table = jobs.price_stats(spark, _partials(spark, sf_dir, lambda rows: jobs.panes(rows, "1 hour")), "24 hours", "1 hour")
    return table.select(F.col("window_start").cast("string").alias("window_start"), "source_id", "observation_count", "price_sum")


@query(
    "stream_market_sessions",
    with_views(
        "observations",
        """WITH g AS (SELECT *, CASE WHEN observed_at > lag(observed_at) OVER w + INTERVAL '6 hours' THEN 1 WHEN lag(observed_at) OVER w IS NULL THEN 1 ELSE 0 END AS fresh FROM observations WINDOW w AS (PARTITION BY listing_id ORDER BY observed_at, seq)),
        n AS (SELECT *, sum(fresh) OVER (PARTITION BY listing_id ORDER BY observed_at, seq) AS no FROM g),
        s AS (SELECT listing_id, no, min(observed_at) AS a, max(observed_at) + INTERVAL '6 hours' AS b, count(*) AS observation_count FROM n GROUP BY 1, 2)
        SELECT listing_id, cast(a as varchar) AS session_start, observation_count FROM s""",
    ),
)
def stream_market_sessions(spark, sf_dir):
    table = jobs.market_sessions(spark, _partials(spark, sf_dir, lambda rows: jobs.spell_cells(rows, "6 hours")), "6 hours")
    return table.select("listing_id", F.col("session_start").cast("string").alias("session_start"), "observation_count")


@query(
    "stream_static_scoring",
    with_views(
        "observations",
        f"""WITH b AS (SELECT source_id, {r2('avg(asking_price)')} AS avg_price FROM observations GROUP BY source_id)
        SELECT o.seq, b.avg_price, {r2('(o.asking_price - b.avg_price) / b.avg_price * 100e0')} AS difference_pct FROM observations o JOIN b ON b.source_id = o.source_id""",
    ),
)
def stream_static_scoring(spark, sf_dir):
    means = _observations(spark, sf_dir).groupBy("source_id").agg(F.round(F.avg("asking_price"), 2).alias("avg_price"))
    table = _table(spark, sf_dir, lambda s: jobs.static_scoring(s, means))
    return table.select("seq", "avg_price", "difference_pct")


@query(
    "late_observation_policy",
    with_views(
        "observations",
        f"""WITH held AS (SELECT *, observed_at < timestamp '{SPLIT}' AND seq % 40 = 0 AS withheld FROM observations),
        line AS (SELECT max(observed_at) AS t FROM held WHERE observed_at < timestamp '{SPLIT}' AND NOT withheld)
        SELECT listing_id, count(CASE WHEN withheld AND observed_at < (SELECT t FROM line) - INTERVAL '7 days' THEN 1 END) AS late_count, count(*) AS snapshot_count FROM held GROUP BY listing_id""",
    ),
)
def late_observation_policy(spark, sf_dir):
    rows = _observations(spark, sf_dir)
    early = F.col("observed_at") < F.lit(SPLIT).cast("timestamp")
    withheld = early & (F.col("seq") % 40 == 0)
    landing, out, mark = _paths(spark)
    _land(
        [rows.where(early & ~withheld), rows.where(~early | withheld)],
        landing,
        lambda: jobs.keep_landed(jobs.read_observations(spark, landing, landings=True), out, mark),
    )
    stored = jobs.with_late(spark, out, F.expr("INTERVAL 7 DAYS"))
    late = stored.groupBy("listing_id").agg(F.count_if("is_late").alias("late_count"))
    repaired = history.listing_history(stored, ["observed_at", "seq", "asking_price", "listing_status"])
    return late.join(repaired.select("listing_id", "snapshot_count"), "listing_id")
