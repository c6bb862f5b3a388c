"""Streams of listing observations: new listings, changes, current state, counts, spells, late rows.

Every job takes a streaming DataFrame with ``listing_id``, ``source_id``, ``observed_at`` (timestamp), ``seq``,
``asking_price`` and ``listing_status``. Checkpoints belong in the shared folder.

No result depends on how what has landed is cut into micro-batches, or on the order of its files: each micro-batch is
reduced to something that can be united with what other micro-batches wrote (counts of a pane, the ends of a cell of a
time line, the first row of a listing, the newest time of a landing), and stored under the batch number, so that a batch
that runs again replaces its own files. Work grows with the micro-batch: of what is stored a job reads only the parts
that the batch touches, and readers unite the parts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from woonvonk.functions import finance
from woonvonk.operators.history import change_type
from woonvonk.operators.skew import HOT_ROWS, first_per_key, with_previous
from woonvonk.session import broadcast_if_small

OBSERVATION_SCHEMA = (
    "listing_id bigint, source_id int, observed_at timestamp, seq bigint, asking_price double, listing_status string"
)
# Fixed value: minutes between two scans.
SCAN_MINUTES = 15


# What one micro-batch may read; a backlog is worked off in several.
MAX_BYTES = 1 << 30
# Parts that tables of listings are dealt into by hash.
BUCKETS = 16


def read_observations(spark: SparkSession, path: str, max_bytes: int | None = None, landings: bool = False) -> DataFrame:
    """Stream of observation files landed under ``path/landing=n``, at most ``max_bytes`` (MAX_BYTES) at a time.

    ``landings`` adds the number of the landing a row came with.
    """
    reader = spark.readStream.schema(f"{OBSERVATION_SCHEMA}, landing int").option("maxBytesPerTrigger", max_bytes or MAX_BYTES)
    rows = reader.parquet(path)
    return rows if landings else rows.drop("landing")


def land(rows: DataFrame, path: str, landing: int) -> None:
    """Add files to a landing."""
    names = [x.split()[0] for x in OBSERVATION_SCHEMA.split(", ")]
    rows.select(*names).write.mode("append").parquet(f"{path}/landing={landing}")


def bucket_of(key: str) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")


def put(rows: DataFrame, path: str, batch_id: int, parts: list[str]) -> None:
    """Store what a micro-batch adds to a table; a batch that runs again replaces its own files."""
    rows.write.mode("overwrite").partitionBy(*parts).parquet(f"{path}/batch={batch_id}")


def stored(spark: SparkSession, path: str, schema: str, before: int | None = None) -> DataFrame:
    """A table of ``put``: all of it, or what batches before number ``before`` have added."""
    if before == 0:
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(f"{schema}, batch int").parquet(path)
    return (rows if before is None else rows.where(F.col("batch") < before)).drop("batch")


def values_of(rows: DataFrame, column: Column) -> list:
    """Distinct values of a column that has few, such as days or buckets; they prune the parts that are read."""
    return [r[0] for r in rows.select(column).distinct().collect()]


def write_table(stream: DataFrame, path: str, checkpoint: str, every: str | None = None, mode: str = "append"):
    """Write a stream as a table: on a clock with ``every``, otherwise once over what has landed."""
    writer = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def each_batch(stream: DataFrame, work: Callable[[DataFrame, int], None], checkpoint: str, every: str | None = None):
    writer = stream.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def stream_ingest(stream: DataFrame) -> DataFrame:
    """Usable observations with the minute of the scan they belong to."""
    scan = F.window("observed_at", f"{SCAN_MINUTES} minutes")["start"]
    return stream.where(F.col("listing_id").isNotNull() & F.col("observed_at").isNotNull()).withColumn("scan_started_at", scan)


FIRST_SCHEMA = f"{OBSERVATION_SCHEMA}, corrects boolean, bucket int"


def only_new(stream: DataFrame, path: str, checkpoint: str, every: str | None = None):
    """The first observation of each listing; an earlier one that arrives later corrects it.

    A micro-batch is reduced to one row per listing and meets the buckets of its own listings only. What is written
    are listings never seen before, and with ``corrects`` earlier rows of known ones; ``first_seen`` reads the table.
    Rows without a time come after all others of their listing.
    """

    def work(batch: DataFrame, batch_id: int) -> None:
        rows = batch.where(F.col("listing_id").isNotNull())
        order = [F.col("observed_at").asc_nulls_last(), F.col("seq"), F.col("asking_price"), F.col("listing_status")]
        fresh = first_per_key(rows, ["listing_id"], order).withColumn("bucket", bucket_of("listing_id")).persist()
        kept = stored(batch.sparkSession, path, FIRST_SCHEMA, batch_id).where(F.col("bucket").isin(values_of(fresh, F.col("bucket"))))
        known = kept.groupBy("listing_id").agg(F.min(_position()).alias("known"))
        met = fresh.join(known, "listing_id", "left").where(F.col("known").isNull() | (_position() < F.col("known")))
        put(met.withColumn("corrects", F.col("known").isNotNull()).drop("known"), path, batch_id, ["bucket"])
        fresh.unpersist()

    return each_batch(stream, work, checkpoint, every)


def _position() -> Column:
    """Place in a listing's time line, rows without a time last."""
    at = F.coalesce("observed_at", F.lit("9999-12-31").cast("timestamp")).alias("at")
    return F.struct(at, "seq", "asking_price", "listing_status")


def first_seen(spark: SparkSession, path: str) -> DataFrame:
    """One row per listing: its first observation, corrections applied."""
    rows = stored(spark, path, FIRST_SCHEMA)
    first = rows.groupBy("listing_id").agg(F.min_by(F.struct("source_id", *OBSERVED), _position()).alias("r"))
    return first.select("listing_id", "r.*")


OBSERVED = ["observed_at", "seq", "asking_price", "listing_status"]
_ROW = "observed_at timestamp, seq bigint, asking_price double, listing_status string"
_END = f"struct<{', '.join(x.replace(' ', ':', 1) for x in _ROW.split(', '))}>"
ROW_SCHEMA = f"listing_id bigint, {_ROW}, day date"
CELL_SCHEMA = f"listing_id bigint, day date, first {_END}, last {_END}, bucket int"
LOG_SCHEMA = f"listing_id bigint, {_ROW}, change_type string, sign int, bucket int"


def change_detection(stream: DataFrame, path: str, checkpoint: str, every: str | None = None, hot_rows: int = HOT_ROWS):
    """Observations that differ from the one before in their listing's time line, with the kind of change.

    A row may come at any time and lie anywhere in the time line. Each listing's line is kept in cells of a day: the rows
    by day, and for each cell its first and last row. A micro-batch touches the cells its rows fall in. Those are read
    again with the nearest row before and after each, which the ends of the neighbouring cells give; rows whose
    predecessor is another one now get their change withdrawn (sign -1) and added anew (sign 1). So a late row costs
    its own cell and two rows, wherever it lies; a listing that holds most rows of a batch is spread by the look-back.

    ``detected_changes`` reads the result. Rows without listing are left out; rows without a time come first in their line.
    """

    def work(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        day = F.coalesce(F.to_date("observed_at"), F.lit("0001-01-01").cast("date"))
        new = batch.where(F.col("listing_id").isNotNull()).select("listing_id", *OBSERVED, day.alias("day")).persist()
        end = F.struct(*OBSERVED)
        own = new.groupBy("listing_id", "day").agg(F.min(end).alias("first"), F.max(end).alias("last"))
        own = own.withColumn("bucket", bucket_of("listing_id")).persist()
        days, buckets = values_of(own, F.col("day").cast("string")), values_of(own, F.col("bucket"))

        # the cells of the listings touched, as they were
        kept = stored(spark, f"{path}/cells", CELL_SCHEMA, batch_id).where(F.col("bucket").isin(buckets))
        kept = kept.join(own.select("listing_id").distinct(), "listing_id", "left_semi")
        kept = kept.groupBy("listing_id", "day").agg(F.min("first").alias("first"), F.max("last").alias("last"))
        cells = kept.join(own.select("listing_id", "day", F.lit(True).alias("touched")), ["listing_id", "day"], "full")
        # at most one row per listing and day
        line = Window.partitionBy("listing_id").orderBy("day")
        touched = F.coalesce("touched", F.lit(False))
        cells = cells.select(
            "listing_id", "day", "first", "last", touched.alias("touched"),
            F.lag(touched, 1, False).over(line).alias("follows"), F.lead(touched, 1, False).over(line).alias("leads"),
        ).persist()
        near = cells.where(~F.col("touched"))
        single = F.col("first") == F.col("last")
        judged = near.where("follows").select("listing_id", "first.*", F.lit(True).alias("judged"))
        context = near.where(F.col("leads") & ~(F.col("follows") & single)).select("listing_id", "last.*", F.lit(False).alias("judged"))
        again = cells.where(F.col("touched") & F.col("first").isNotNull()).select("listing_id", "day")
        read = stored(spark, f"{path}/rows", ROW_SCHEMA, batch_id).where(F.col("day").cast("string").isin(days))
        read = read.join(again, ["listing_id", "day"], "left_semi").select("listing_id", *OBSERVED, F.lit(True).alias("judged"))
        before = read.unionByName(judged).unionByName(context).withColumn("is_new", F.lit(False))
        rows = before.unionByName(new.drop("day").withColumns({"judged": F.lit(True), "is_new": F.lit(True)}))

        value = F.struct("asking_price", "listing_status")
        looked = with_previous(
            rows, "listing_id", "observed_at", [*OBSERVED, "is_new"],
            previous={"now": value}, previous_filled={"was": F.when(~F.col("is_new"), value)}, hot_rows=hot_rows,
        ).where("judged")
        looked = looked.withColumns({"added": _change("now"), "gone": F.when(~F.col("is_new"), _change("was"))})
        moved = looked.where(~F.col("added").eqNullSafe(F.col("gone")))
        entry = lambda kind, sign: F.struct(F.col(kind).alias("change_type"), F.lit(sign).alias("sign"))
        log = moved.select("listing_id", *OBSERVED, F.inline(F.array(entry("added", 1), entry("gone", -1)))).where("change_type IS NOT NULL")
        put(log.withColumn("bucket", bucket_of("listing_id")), f"{path}/changes", batch_id, ["bucket"])
        put(own, f"{path}/cells", batch_id, ["bucket"])
        put(new, f"{path}/rows", batch_id, ["day"])
        for held in (new, own, cells):
            held.unpersist()

    return each_batch(stream, work, checkpoint, every)


def _change(old: str) -> Column:
    """The change of a row against the values ``old`` before it; NULL where nothing changed."""
    before = F.col(old)
    same = before["asking_price"].eqNullSafe(F.col("asking_price")) & before["listing_status"].eqNullSafe(F.col("listing_status"))
    return F.when(before.isNull() | ~same, change_type(before.isNull(), before, "asking_price", "listing_status", None))


def detected_changes(spark: SparkSession, path: str) -> DataFrame:
    """(listing_id, observation, change_type): the changes that have not been withdrawn."""
    log = stored(spark, f"{path}/changes", LOG_SCHEMA)
    return log.groupBy("listing_id", *OBSERVED, "change_type").agg(F.sum("sign").alias("n")).where("n > 0").drop("n")


def upsert_current(stream: DataFrame, path: str, checkpoint: str, every: str | None = None):
    """Keep the newest observation of each listing.

    A micro-batch is reduced to one row per listing and written under its batch number, so running it again
    replaces the same files. ``current_state`` reads the newest row over all batches; ``compact`` folds them.
    """

    def work(batch: DataFrame, batch_id: int) -> None:
        newest_rows(batch).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return each_batch(stream, work, checkpoint, every)


def newest_rows(rows: DataFrame) -> DataFrame:
    columns = [c for c in rows.columns if c not in ("listing_id", "batch_id", "first_seen_at")]
    first = F.min("first_seen_at" if "first_seen_at" in rows.columns else "observed_at").alias("first_seen_at")
    newest = F.max_by(F.struct(*columns), F.struct("observed_at", "seq")).alias("r")
    return rows.groupBy("listing_id").agg(newest, first).select("listing_id", "r.*", "first_seen_at")


def current_state(spark: SparkSession, path: str) -> DataFrame:
    return newest_rows(spark.read.parquet(path).drop("batch_id"))


def compact(spark: SparkSession, path: str, target: str) -> None:
    """Fold all batches into one table at a new place."""
    current_state(spark, path).write.mode("overwrite").parquet(target)


# Prices are added up as decimals, so that sums are the same in any order.
_MONEY = "decimal(38,4)"
PANE_SCHEMA = f"pane timestamp, source_id int, observation_count bigint, sold_count bigint, price_sum {_MONEY}, newest timestamp"
PANE_KEYS = ["pane", "source_id"]
SPELL_SCHEMA = "listing_id bigint, cell timestamp, first timestamp, last timestamp, observation_count bigint"
SPELL_KEYS = ["listing_id", "cell"]
# How the parts of batches are united.
UNITED = {
    "observation_count": F.sum, "sold_count": F.sum, "price_sum": F.sum, "newest": F.max, "first": F.min, "last": F.max,
}


def partial_counts(stream: DataFrame, build: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, every: str | None = None):
    """Store ``build`` of every micro-batch, an aggregate that can be united with those of other batches."""

    def work(batch: DataFrame, batch_id: int) -> None:
        build(batch).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return each_batch(stream, work, checkpoint, every)


def united(spark: SparkSession, path: str, schema: str, keys: list[str]) -> DataFrame:
    """The parts of all batches as one row per key."""
    rows = stored(spark, path, schema)
    return rows.groupBy(*keys).agg(*[UNITED[c](c).cast(t).alias(c) for c, t in rows.dtypes if c not in keys])


def fold(spark: SparkSession, path: str, schema: str, keys: list[str], target: str) -> None:
    """Unite all batches into one part of a table at a new place; its stream goes on there from a later batch."""
    united(spark, path, schema, keys).write.mode("overwrite").parquet(f"{target}/batch=-1")


def panes(rows: DataFrame, width: str) -> DataFrame:
    """Counts, prices and the newest time per source and pane of ``width``."""
    pane = F.window("observed_at", width)["start"].alias("pane")
    return rows.where(F.col("observed_at").isNotNull()).groupBy(pane, "source_id").agg(
        F.count(F.lit(1)).alias("observation_count"),
        F.count_if(F.col("listing_status") == "sold").alias("sold_count"),
        F.sum(F.col("asking_price").cast("decimal(28,4)")).cast(_MONEY).alias("price_sum"),
        F.max("observed_at").alias("newest"),
    )


def price_stats(spark: SparkSession, path: str, size: str, slide: str | None = None, closed_after: str | None = None) -> DataFrame:
    """Counts and price totals per source and time window, from panes as wide as ``slide`` (or ``size``).

    A window that slides is put together from its panes, so rows are counted once however much windows overlap. Every
    window that has rows is there, open ones included; with ``closed_after`` only those that ended at least that long
    before the newest row.
    """
    whole = united(spark, path, PANE_SCHEMA, PANE_KEYS)
    window = F.window("pane", size, slide) if slide else F.window("pane", size)
    stats = whole.groupBy(window.alias("w"), "source_id").agg(*[F.sum(c).alias(c) for c in ("observation_count", "sold_count", "price_sum")])
    stats = stats.select(
        F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "source_id", "observation_count", "sold_count",
        F.col("price_sum").cast("double").alias("price_sum"),
    )
    if closed_after is None:
        return stats
    line = stored(spark, path, PANE_SCHEMA).agg(F.max("newest")).scalar() - F.expr(f"INTERVAL {closed_after}")
    return stats.where(F.col("window_end") <= line)


def spell_cells(rows: DataFrame, gap: str) -> DataFrame:
    """First and last time and count per listing and cell of the width ``gap``; rows of one cell belong to one spell."""
    cell = F.window("observed_at", gap)["start"].alias("cell")
    usable = rows.where(F.col("listing_id").isNotNull() & F.col("observed_at").isNotNull())
    return usable.groupBy("listing_id", cell).agg(
        F.min("observed_at").alias("first"), F.max("observed_at").alias("last"), F.count(F.lit(1)).alias("observation_count")
    )


def market_sessions(spark: SparkSession, path: str, gap: str) -> DataFrame:
    """Spells on the market: observations of a listing with no pause longer than ``gap``.

    A spell goes on from one cell to the next when the pause between their ends is no longer. A listing has at most
    one row per cell here, however many observations it has.
    """
    pause = F.expr(f"INTERVAL {gap}")
    line = Window.partitionBy("listing_id").orderBy("cell")
    cells = united(spark, path, SPELL_SCHEMA, SPELL_KEYS)
    fresh = F.coalesce(F.col("first") > F.lag("last").over(line) + pause, F.lit(True))
    numbered = cells.withColumn("fresh", fresh.cast("int")).withColumn("no", F.sum("fresh").over(line))
    return numbered.groupBy("listing_id", "no").agg(
        F.min("first").alias("session_start"), (F.max("last") + pause).alias("session_end"), F.sum("observation_count").alias("observation_count")
    ).drop("no")


def static_scoring(stream: DataFrame, benchmarks: DataFrame) -> DataFrame:
    """Observations against the benchmark of their source (``source_id``, ``avg_price``)."""
    delta = F.round(finance.ratio(F.col("asking_price") - F.col("avg_price"), "avg_price") * 100.0, 2)
    return stream.join(benchmarks, "source_id", "left").withColumn("difference_pct", delta)


def keep_landed(stream: DataFrame, path: str, checkpoint: str, every: str | None = None):
    """Store all rows of a stream with ``landing``, and the newest time of each landing as far as a batch knows it."""

    def work(batch: DataFrame, batch_id: int) -> None:
        newest = batch.groupBy("landing").agg(F.max("observed_at").alias("newest"))
        newest.write.mode("overwrite").parquet(f"{path}/newest/batch={batch_id}")
        batch.write.mode("overwrite").parquet(f"{path}/rows/batch={batch_id}")

    return each_batch(stream, work, checkpoint, every)


def with_late(spark: SparkSession, path: str, delay: Column) -> DataFrame:
    """All rows that ``keep_landed`` has stored, with ``is_late``.

    A row is late when it is older than the newest row of all earlier landings, less the delay. The line belongs to the
    landing, not to the micro-batch, so a landing may come in many batches, or many landings in one. Late rows are repaired by
    building the history of their listings from the table.
    """
    newest = stored(spark, f"{path}/newest", "landing int, newest timestamp").groupBy("landing").agg(F.max("newest").alias("newest"))
    # one row per landing
    lines = newest.select("landing", F.max("newest").over(Window.orderBy("landing").rowsBetween(Window.unboundedPreceding, -1)).alias("line"))
    rows = stored(spark, f"{path}/rows", f"{OBSERVATION_SCHEMA}, landing int")
    late = F.coalesce(F.col("observed_at") < F.col("line") - delay, F.lit(False))
    return rows.join(broadcast_if_small(lines), "landing", "left").withColumn("is_late", late).drop("line")
