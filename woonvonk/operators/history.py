"""Snapshot history: changes, price path, time on the market, relisting."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from woonvonk.functions.casts import strip, to_double, to_int
from woonvonk.functions.text import normalize_status
from woonvonk.operators.skew import HOT_ROWS, first_per_key, hot_keys, null_safe_join, top_n_per_key, with_previous
from woonvonk.session import broadcast_if_small

# Statuses that end a spell, and how far back a relisting counts.
OFF_MARKET = ["withdrawn", "sold"]
RELIST_WINDOW_DAYS = 180
PRICE_TOLERANCE = 0.009


def content_hash(columns: list[str]) -> Column:
    """Fingerprint of the columns that make a snapshot differ."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


def change_type(is_first: Column, old: Column, price: str, status: str, description: str | None) -> Column:
    """What changed between the snapshot before (struct ``old``) and this one."""
    kind = (
        F.when(is_first, "new_listing")
        .when(
            (F.coalesce(old[status], F.lit("")) != "") & (old[status] != "active") & (F.col(status) == "active"),
            "relisting_signal",
        )
        .when(~old[price].eqNullSafe(F.col(price)), "asking_price_change")
        .when(~old[status].eqNullSafe(F.col(status)), "listing_status_change")
    )
    if description is not None:
        kind = kind.when(~old[description].eqNullSafe(F.col(description)), "description_change")
    return kind.otherwise("content_change")


def snapshot_changes(
    snapshots: DataFrame,
    order: list[str],
    content: list[str],
    key: str = "listing_id",
    ts: str = "observed_at",
    description: str | None = None,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Keep the snapshots that differ from the one before, with the kind of change.

    Dropping runs of equal snapshots first or comparing with the direct predecessor is the same thing,
    so one look-back is enough.
    """
    compared = list(dict.fromkeys([*content, "asking_price", "listing_status", *([description] if description else [])]))
    looked = with_previous(snapshots, key, ts, order, previous={"_old": F.struct(*compared)}, hot_rows=hot_rows)
    same = [F.col(f"_old.{c}").eqNullSafe(F.col(c)) for c in content]
    differs = ~reduce(lambda a, b: a & b, same)
    kept = looked.where((F.col("row_no") == 1) | differs)
    kind = change_type(F.col("row_no") == 1, F.col("_old"), "asking_price", "listing_status", description)
    return kept.withColumns({"content_hash": content_hash(content), "change_type": kind}).drop("_old", "row_no", "row_count")


def with_previous_price(
    snapshots: DataFrame, order: list[str], key: str = "listing_id", ts: str = "observed_at", hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Add ``previous_price``: the last price known before this snapshot."""
    looked = with_previous(
        snapshots, key, ts, order, previous_filled={"previous_price": F.col("asking_price")}, hot_rows=hot_rows
    )
    return looked.drop("row_count")


def price_change_counts(snapshots: DataFrame, order: list[str], key: str = "listing_id", hot_rows: int = HOT_ROWS) -> DataFrame:
    """Changes of the price against the last known one (rises count too) and drops alone."""
    priced = with_previous_price(snapshots, order, key, hot_rows=hot_rows)
    moved = F.col("asking_price") != F.col("previous_price")
    fell = F.col("asking_price") < F.col("previous_price")
    return priced.groupBy(key).agg(
        F.count_if(moved).alias("price_change_count"), F.count_if(fell).alias("reduction_count")
    )


def listing_history(
    snapshots: DataFrame, order: list[str], key: str = "listing_id", hot_rows: int = HOT_ROWS, listings: DataFrame | None = None
) -> DataFrame:
    """One row per listing: first and last day, first and last price, reduction, frequency, relisting.

    Everything but the count of changes is a mergeable aggregate, so a listing with very many snapshots costs one
    partial result per task. With ``listings`` (key, listing_status, original_asking_price, current_asking_price,
    first_seen_date, latest_seen_date) every listing has a row: its own status wins over the last snapshot's and stands in
    for snapshots without one, and its prices and days are taken where no dated snapshot has any. A listing without
    snapshots has status and zero changes only. Without ``listings`` there is a row per listing with a dated snapshot.
    """
    seen = F.col("observed_at").isNotNull()
    rows = snapshots.withColumn("_price", F.when(seen, F.col("asking_price"))).withColumn(
        "_given", F.nullif(strip("listing_status"), F.lit(""))
    )
    looked = with_previous(rows, key, "observed_at", order, previous_filled={"previous_price": F.col("_price")}, hot_rows=hot_rows)
    position = F.when(seen, F.struct(*order))
    with_price = F.when(F.col("_price").isNotNull(), position)
    day = F.when(seen, F.to_date("observed_at"))
    status = normalize_status("_given")
    rolled = looked.groupBy(key).agg(
        F.min(day).alias("_first"),
        F.max(day).alias("_latest"),
        F.min_by("_price", with_price).alias("_original"),
        F.max_by("_price", with_price).alias("_current"),
        F.count_if(F.col("_price") != F.col("previous_price")).alias("price_change_count"),
        F.count_if(seen).alias("snapshot_count"),
        F.max_by(F.struct(F.col("_given").alias("s")), position).alias("_last"),
        F.max(F.when(F.col("_given").isNotNull() & status.isin(OFF_MARKET), day)).alias("_off"),
        F.max(F.when(F.col("_given").isNull(), day)).alias("_open"),
    )
    if listings is None:
        named = ["_l_status", "_l_original", "_l_current", "_l_first", "_l_latest"]
        kinds = ["string", "double", "double", "date", "date"]
        both = rolled.where("snapshot_count > 0").select("*", *[F.lit(None).cast(k).alias(n) for n, k in zip(named, kinds)])
    else:
        given = listings.select(
            key,
            F.nullif(strip("listing_status"), F.lit("")).alias("_l_status"),
            to_double("original_asking_price").alias("_l_original"),
            to_double("current_asking_price").alias("_l_current"),
            F.to_date("first_seen_date").alias("_l_first"),
            F.to_date("latest_seen_date").alias("_l_latest"),
        )
        # listings without key have no snapshots and the other way round, so NULLs need not meet
        both = given.join(rolled, key, "full")
    known = F.col("snapshot_count").isNotNull()
    fallback = F.coalesce("_l_status", F.lit("active"))
    last = F.when(F.col("snapshot_count") > 0, normalize_status(F.coalesce(F.col("_last.s"), fallback)))
    both = both.select(
        key,
        F.when(known, F.coalesce("_first", "_l_first")).alias("first_seen_date"),
        F.when(known, F.coalesce("_latest", "_l_latest")).alias("latest_seen_date"),
        F.when(known, F.coalesce("_original", "_l_original")).alias("original_asking_price"),
        F.when(known, F.coalesce("_current", "_l_current")).alias("current_asking_price"),
        F.coalesce("price_change_count", F.lit(0)).cast("bigint").alias("price_change_count"),
        F.coalesce("snapshot_count", F.lit(0)).cast("bigint").alias("snapshot_count"),
        F.when(known, F.coalesce(F.when(F.col("_l_status").isNotNull(), normalize_status("_l_status")), last, F.lit("active")))
        .otherwise(normalize_status(F.coalesce("_l_status", F.lit("unknown"))))
        .alias("listing_status"),
        last.alias("_last_status"),
        F.greatest("_off", F.when(normalize_status(fallback).isin(OFF_MARKET), F.col("_open"))).alias("_last_off"),
        "_latest",
    )
    days = F.datediff("latest_seen_date", "first_seen_date")
    days = F.when(days >= 0, days)
    drop = F.greatest(F.lit(0.0), F.col("original_asking_price") - F.col("current_asking_price"))
    both_prices = F.col("original_asking_price").isNotNull() & F.col("current_asking_price").isNotNull()
    relisted = F.coalesce(
        (F.col("_last_status") == "active") & (F.datediff("_latest", "_last_off") <= RELIST_WINDOW_DAYS), F.lit(False)
    )
    return both.select(
        key,
        "first_seen_date",
        "latest_seen_date",
        days.alias("days_on_market"),
        "original_asking_price",
        "current_asking_price",
        F.round(F.when(both_prices, drop), 2).alias("total_price_reduction"),
        F.when(
            both_prices & (F.col("original_asking_price") > 0),
            F.round(drop / F.nullif("original_asking_price", F.lit(0.0)) * 100.0, 2),
        ).alias("total_price_reduction_percentage"),
        "price_change_count",
        F.when(days.isNotNull(), F.round(F.col("price_change_count") / F.greatest(days, F.lit(1)) * 30.0, 2)).alias("reduction_frequency"),
        "listing_status",
        relisted.alias("recently_relisted"),
        F.when(relisted, F.col("_latest")).alias("relisted_date"),
        "snapshot_count",
    )


def price_reductions(snapshots: DataFrame, order: list[str], key: str = "listing_id", hot_rows: int = HOT_ROWS) -> DataFrame:
    """Snapshots whose price is below the last known one."""
    priced = with_previous_price(snapshots, order, key, hot_rows=hot_rows)
    amount = F.round(F.col("previous_price") - F.col("asking_price"), 2)
    return priced.where(F.col("asking_price") < F.col("previous_price")).select(
        key,
        "observed_at",
        *[c for c in order if c not in ("observed_at", "asking_price")],
        F.col("previous_price").alias("old_price"),
        F.col("asking_price").alias("new_price"),
        amount.alias("reduction_amount"),
        F.coalesce(F.when(F.col("previous_price") > 0, F.round(amount / F.nullif("previous_price", F.lit(0.0)) * 100, 2)), F.lit(0.0)).alias(
            "reduction_percentage"
        ),
    )


def price_points(snapshots: DataFrame, order: list[str], key: str = "listing_id", hot_rows: int = HOT_ROWS) -> DataFrame:
    """Numbered price points per listing, one row each: a listing may have any number of them."""
    dated = snapshots.where(F.col("observed_at").isNotNull())
    numbered = with_previous(dated, key, "observed_at", order, hot_rows=hot_rows)
    return numbered.select(
        key,
        F.col("row_no").alias("point_no"),
        F.to_date("observed_at").alias("observed_date"),
        "asking_price",
        normalize_status("listing_status").alias("listing_status"),
        F.lit("listing_snapshots").alias("source"),
    )


def previous_prices(
    snapshots: DataFrame, current: DataFrame, order: list[str], key: str = "listing_id", hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Earlier asking prices of a listing: positive, without the last one and without prices equal to
    the current price (``current``: key, current_price); repeats in a row are shown once."""
    positive = null_safe_join(snapshots.where(F.col("asking_price") > 0), current, [key], "left")
    positive = positive.withColumn("price", F.round("asking_price", 2)).drop("asking_price").withColumnRenamed("price", "asking_price")
    hot = hot_keys(positive, key, hot_rows)
    differs = F.col("current_price").isNull() | (F.abs(F.col("asking_price") - F.col("current_price")) > PRICE_TOLERANCE)
    # the last price that counts before each row; rows equal to the current price are looked through
    counted = F.when(differs, F.col("asking_price"))
    looked = with_previous(positive, key, "observed_at", order, previous_filled={"_before": counted}, hot=hot)
    changed = F.col("_before").isNull() | (F.abs(F.col("_before") - F.col("asking_price")) > PRICE_TOLERANCE)
    kept = looked.where((F.col("row_no") < F.col("row_count")) & differs & changed).select(*positive.columns)
    # kept rows are still dealt and sorted by key, so the numbering adds no shuffle
    return with_previous(kept, key, "observed_at", order, hot=hot).select(
        key, F.col("row_no").alias("step_no"), "observed_at", F.col("asking_price").alias("price")
    )


def price_history(
    snapshots: DataFrame, current: DataFrame, order: list[str], shown: int, key: str = "listing_id", hot_rows: int = HOT_ROWS
) -> DataFrame:
    """One row per listing with snapshots: ``reduction_count`` as in ``price_change_counts``, the day of its oldest
    snapshot (``oldest``) and the newest ``shown`` of its ``previous_prices`` as an array, oldest first (``earlier``).

    Snapshots are dealt and sorted once, and all windows use that order. Listings above ``hot_rows`` go through the
    functions named, which spread one listing over tasks. A NULL key is no listing.
    """
    keyed = snapshots.where(F.col(key).isNotNull())
    hot = hot_keys(keyed, key, hot_rows)
    if hot.isEmpty():
        return _sorted_price_history(keyed, current, order, shown, key)
    few = broadcast_if_small(hot)
    ordinary, large = keyed.join(few, key, "left_anti"), keyed.join(few, key, "left_semi")
    counts = price_change_counts(large, order, key, hot_rows).select(key, "reduction_count")
    oldest = large.groupBy(key).agg(F.to_date(F.min("observed_at")).alias("oldest"))
    steps = previous_prices(large, current, order, key, hot_rows)
    newest = top_n_per_key(steps, [key], [F.col("step_no").desc()], shown)
    listed = newest.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("step_no", "price"))).alias("steps"))
    joined = counts.join(oldest, key, "left").join(listed, key, "left")
    earlier = F.coalesce(F.col("steps.price"), F.array().cast("array<double>")).alias("earlier")
    spread = joined.select(key, "reduction_count", "oldest", earlier)
    return _sorted_price_history(ordinary, current, order, shown, key).unionByName(spread)


def _sorted_price_history(snapshots: DataFrame, current: DataFrame, order: list[str], shown: int, key: str) -> DataFrame:
    """``price_history`` of listings whose snapshots fit one task each."""
    line = Window.partitionBy(key).orderBy(*order)
    back = line.rowsBetween(Window.unboundedPreceding, -1)
    upto = line.rowsBetween(Window.unboundedPreceding, 0)
    whole = line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # dealt by listing like the snapshots, a task's current prices are looked up without sorting for it
    priced = snapshots.select(key, *order).join(current.select(key, "current_price").hint("shuffle_hash"), key, "left")
    price = F.when(F.col("asking_price") > 0, F.round("asking_price", 2))
    differs = F.col("current_price").isNull() | (F.abs(price - F.col("current_price")) > PRICE_TOLERANCE)
    valued = priced.select(key, *order, price.alias("_price"), F.when(differs, price).alias("_counted"))
    looked = valued.select(
        "*",
        F.last("asking_price", ignorenulls=True).over(back).alias("_known"),
        F.last("_counted", ignorenulls=True).over(back).alias("_before"),
        F.count("_price").over(upto).alias("_no"),
        F.count("_price").over(whole).alias("_prices"),
        F.count(F.lit(1)).over(upto).alias("_row"),
        F.count(F.lit(1)).over(whole).alias("_rows"),
        F.min("observed_at").over(whole).alias("_oldest"),
    )
    changed = F.col("_before").isNull() | (F.abs(F.col("_before") - F.col("_counted")) > PRICE_TOLERANCE)
    kept = F.when(F.col("_counted").isNotNull() & (F.col("_no") < F.col("_prices")) & changed, F.col("_counted"))
    fell = F.when(F.col("asking_price") < F.col("_known"), 1)
    marked = looked.select(
        key, *order, "_oldest", (F.col("_row") == F.col("_rows")).alias("_last"), kept.alias("_step"), fell.alias("_fell")
    )
    numbered = marked.select(
        "*",
        F.count("_step").over(upto).alias("_no"),
        F.count("_step").over(whole).alias("_steps"),
        F.count("_fell").over(whole).alias("reduction_count"),
    )
    newest = F.when(F.col("_steps") - F.col("_no") < shown, F.col("_step")).alias("_step")
    bounded = numbered.select(key, *order, "_oldest", "_last", "reduction_count", newest).where(F.col("_last") | F.col("_step").isNotNull())
    listed = bounded.withColumn("earlier", F.collect_list("_step").over(whole))
    return listed.where("_last").select(key, "reduction_count", F.to_date("_oldest").alias("oldest"), "earlier")


def relisting(snapshots: DataFrame, order: list[str], key: str = "listing_id", window_days: int = RELIST_WINDOW_DAYS) -> DataFrame:
    """Back on the market soon after being sold or withdrawn."""
    status = normalize_status("listing_status")
    position = F.struct(*order)
    rolled = snapshots.where(F.col("observed_at").isNotNull()).groupBy(key).agg(
        F.max_by(status, position).alias("latest_status"),
        F.to_date(F.max("observed_at")).alias("latest_date"),
        F.max(F.when(status.isin(OFF_MARKET), F.to_date("observed_at"))).alias("off_market_date"),
    )
    back = (F.col("latest_status") == "active") & F.coalesce(
        F.datediff("latest_date", "off_market_date") <= window_days, F.lit(False)
    )
    return rolled.withColumn("recently_relisted", back).withColumn(
        "relisted_date", F.when(back, F.col("latest_date"))
    )


def reduction_totals(reductions: DataFrame, key: str = "listing_id") -> DataFrame:
    return reductions.groupBy(key).agg(
        F.count(F.lit(1)).alias("reduction_count"),
        F.round(F.sum("reduction_amount"), 2).alias("total_reduction_amount"),
    )


def derived_reductions(listings: DataFrame, counts: DataFrame, key: str = "listing_id") -> DataFrame:
    """Given count of reductions when it is not negative, otherwise the drops between snapshots."""
    explicit = to_int("price_reduction_count")
    return listings.join(counts.select(key, "reduction_count"), key, "left").withColumn(
        "derived_reduction_count",
        F.coalesce(F.when(explicit >= 0, explicit).cast("bigint"), F.col("reduction_count"), F.lit(0).cast("bigint")),
    )


def derived_days(listings: DataFrame, snapshots: DataFrame, reference: Column, key: str = "listing_id") -> DataFrame:
    """Given days, else days since ``listed_since``, else days since the oldest snapshot."""
    oldest = snapshots.groupBy(key).agg(F.to_date(F.min("observed_at")).alias("_oldest"))
    since_listed = F.datediff(reference, F.col("listed_since"))
    since_seen = F.datediff(reference, F.col("_oldest"))
    return (
        listings.join(oldest, key, "left")
        .withColumn(
            "derived_days_on_market",
            F.coalesce(
                to_int("days_on_market"), F.when(since_listed >= 0, since_listed), F.when(since_seen >= 0, since_seen)
            ),
        )
        .drop("_oldest")
    )


def market_days(events: DataFrame, key: str) -> DataFrame:
    """First and last event per key and the days between."""
    rolled = events.groupBy(key).agg(
        F.to_date(F.min("observed_at")).alias("listed_since"), F.to_date(F.max("observed_at")).alias("latest_event_date")
    )
    return rolled.withColumn("days_on_market", F.datediff("latest_event_date", "listed_since"))


def last_sale(sales: DataFrame, key: str, order: list[Column]) -> DataFrame:
    return first_per_key(sales, [key], order)


def current_flag(records: DataFrame, key: str, order: list[str], name: str = "is_current") -> DataFrame:
    """Mark the newest record of each key; older ones keep their row with the flag off."""
    position = F.struct(*order)
    newest = records.groupBy(key).agg(F.max(position).alias("_newest"))
    return (
        records.withColumn("_pos", position)
        .join(newest, key)
        .withColumn(name, F.col("_pos") == F.col("_newest"))
        .drop("_pos", "_newest")
    )
