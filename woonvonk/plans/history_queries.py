"""Queries over snapshot history."""

from __future__ import annotations

from pyspark.sql import functions as F

from woonvonk.functions import finance
from woonvonk.operators import history
from woonvonk.plans.registry import query
from woonvonk.plans.views import REFERENCE_DATE, r2, view, with_views

ORDER = ["observed_at", "snapshot_seq", "asking_price", "listing_status", "surface_m2"]
ORDER_SQL = "observed_at, snapshot_seq, asking_price NULLS FIRST, listing_status, surface_m2"
CONTENT = ["asking_price", "listing_status", "surface_m2"]

NUMBERED = f"""
WITH numbered AS (
  SELECT *, row_number() OVER (PARTITION BY listing_id ORDER BY {ORDER_SQL}) AS rn,
    last_value(asking_price IGNORE NULLS) OVER (PARTITION BY listing_id ORDER BY {ORDER_SQL}
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_price
  FROM snapshots)
"""


CHANGES_SQL = with_views(
        "snapshots",
        f"""
        WITH looked AS (
          SELECT *, row_number() OVER w AS rn, lag(asking_price) OVER w AS old_price,
            lag(listing_status) OVER w AS old_status, lag(surface_m2) OVER w AS old_area
          FROM snapshots WINDOW w AS (PARTITION BY listing_id ORDER BY {ORDER_SQL}))
        SELECT listing_id, snapshot_seq, asking_price, listing_status,
          CASE WHEN rn = 1 THEN 'new_listing'
            WHEN old_status <> 'active' AND listing_status = 'active' THEN 'relisting_signal'
            WHEN old_price IS DISTINCT FROM asking_price THEN 'asking_price_change'
            WHEN old_status IS DISTINCT FROM listing_status THEN 'listing_status_change'
            ELSE 'content_change' END AS change_type
        FROM looked
        WHERE rn = 1 OR old_price IS DISTINCT FROM asking_price OR old_status IS DISTINCT FROM listing_status
          OR old_area IS DISTINCT FROM surface_m2""",
    )


@query("snapshot_changes", CHANGES_SQL)
def snapshot_changes(spark, sf_dir):
    return history.snapshot_changes(view(spark, sf_dir, "snapshots"), ORDER, CONTENT).select(
        "listing_id", "snapshot_seq", "asking_price", "listing_status", "change_type"
    )


@query("snapshot_changes_hot", CHANGES_SQL)
def snapshot_changes_hot(spark, sf_dir):
    """Every listing on the path for hot ones."""
    return history.snapshot_changes(view(spark, sf_dir, "snapshots"), ORDER, CONTENT, hot_rows=0).select(
        "listing_id", "snapshot_seq", "asking_price", "listing_status", "change_type"
    )


@query(
    "price_change_count",
    with_views(
        "snapshots",
        NUMBERED
        + """
        SELECT listing_id, count(CASE WHEN asking_price <> prev_price THEN 1 END) AS price_change_count,
          count(CASE WHEN asking_price < prev_price THEN 1 END) AS reduction_count
        FROM numbered GROUP BY listing_id""",
    ),
)
def price_change_count(spark, sf_dir):
    return history.price_change_counts(view(spark, sf_dir, "snapshots"), ORDER)


HISTORY_SQL = (
    NUMBERED
    + f"""
    , rolled AS (
      SELECT listing_id, cast(min(observed_at) as date) AS first_day, cast(max(observed_at) as date) AS last_day,
        arg_min(asking_price, rn) FILTER (asking_price IS NOT NULL) AS first_price,
        arg_max(asking_price, rn) FILTER (asking_price IS NOT NULL) AS last_price,
        count(CASE WHEN asking_price <> prev_price THEN 1 END) AS price_change_count, count(*) AS snapshot_count,
        arg_max(listing_status, rn) AS listing_status,
        max(CASE WHEN listing_status IN ('withdrawn', 'sold') THEN cast(observed_at as date) END) AS off_day
      FROM numbered GROUP BY listing_id)
    SELECT listing_id, cast(first_day as varchar) AS first_seen_date, cast(last_day as varchar) AS latest_seen_date,
      cast(last_day - first_day as int) AS days_on_market, first_price AS original_asking_price,
      last_price AS current_asking_price, {r2('greatest(0, first_price - last_price)')} AS total_price_reduction,
      {r2('greatest(0, first_price - last_price) / nullif(first_price, 0) * 100.0')} AS total_price_reduction_percentage,
      price_change_count, {r2('cast(price_change_count as double) / greatest(last_day - first_day, 1) * 30.0')} AS reduction_frequency,
      listing_status, listing_status = 'active' AND coalesce(last_day - off_day <= 180, false) AS recently_relisted,
      CASE WHEN listing_status = 'active' AND coalesce(last_day - off_day <= 180, false) THEN cast(last_day as varchar) END AS relisted_date,
      snapshot_count
    FROM rolled"""
)


def _dates_as_text(df, *columns):
    return df.withColumns({c: F.col(c).cast("string") for c in columns})


@query("listing_history", with_views("snapshots", HISTORY_SQL))
def listing_history(spark, sf_dir):
    built = history.listing_history(view(spark, sf_dir, "snapshots"), ORDER)
    return _dates_as_text(built, "first_seen_date", "latest_seen_date", "relisted_date")


GIVEN = """
  SELECT listing_id, CASE listing_id % 5 WHEN 0 THEN 'sold' WHEN 1 THEN 'active' WHEN 2 THEN '' ELSE NULL END AS listing_status,
    CASE WHEN listing_id % 3 = 0 THEN NULL ELSE asking_price END AS original_asking_price,
    CASE WHEN listing_id % 4 = 0 THEN NULL ELSE asking_price * 0.75 END AS current_asking_price,
    cast('2000-03-04' as date) AS first_seen_date, cast('2000-05-06' as date) AS latest_seen_date
  FROM listings
  UNION ALL
  SELECT listing_id + 1000000000, CASE listing_id % 3 WHEN 0 THEN 'sold' WHEN 1 THEN '' ELSE NULL END, asking_price, NULL, NULL, NULL
  FROM listings WHERE listing_id % 4 = 1"""
# Listings that have snapshots may have no day, price or status in some or all of them; the listings added above have none.
WATCHED = """
  SELECT listing_id, CASE WHEN listing_id % 10 = 7 OR snapshot_seq % 13 = 0 THEN NULL ELSE observed_at END AS observed_at,
    snapshot_seq, CASE WHEN listing_id % 10 = 6 THEN NULL ELSE asking_price END AS asking_price,
    CASE WHEN snapshot_seq % 5 = 0 THEN NULL ELSE listing_status END AS listing_status, surface_m2
  FROM snapshots"""
WITH_LISTINGS_SQL = with_views(
    "listings snapshots",
    f"""
    WITH given AS ({GIVEN}), watched AS ({WATCHED}),
    numbered AS (
      SELECT w.*, coalesce(w.listing_status, nullif(g.listing_status, ''), 'active') AS status,
        row_number() OVER (PARTITION BY w.listing_id ORDER BY {ORDER_SQL.replace("listing_status", "w.listing_status NULLS FIRST")}) AS rn,
        last_value(asking_price IGNORE NULLS) OVER (PARTITION BY w.listing_id
          ORDER BY {ORDER_SQL.replace("listing_status", "w.listing_status NULLS FIRST")}
          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_price
      FROM watched w LEFT JOIN given g ON g.listing_id = w.listing_id WHERE observed_at IS NOT NULL),
    rolled AS (
      SELECT listing_id, cast(min(observed_at) as date) AS a, cast(max(observed_at) as date) AS b,
        arg_min(asking_price, rn) FILTER (asking_price IS NOT NULL) AS p, arg_max(asking_price, rn) FILTER (asking_price IS NOT NULL) AS q,
        count(CASE WHEN asking_price <> prev_price THEN 1 END) AS changes, count(*) AS n, arg_max(status, rn) AS last_status,
        max(CASE WHEN status IN ('withdrawn', 'sold') THEN cast(observed_at as date) END) AS off_day
      FROM numbered GROUP BY listing_id),
    filled AS (
      SELECT g.listing_id, any_snapshot.listing_id IS NOT NULL AS known, nullif(g.listing_status, '') AS given_status, last_status,
        coalesce(a, g.first_seen_date) AS a, coalesce(b, g.latest_seen_date) AS b, coalesce(p, g.original_asking_price) AS p,
        coalesce(q, g.current_asking_price) AS q, coalesce(changes, 0) AS changes, coalesce(n, 0) AS n, b AS seen_b, off_day
      FROM given g LEFT JOIN rolled r ON r.listing_id = g.listing_id
      LEFT JOIN (SELECT DISTINCT listing_id FROM watched) any_snapshot ON any_snapshot.listing_id = g.listing_id)
    SELECT listing_id, CASE WHEN known THEN cast(a as varchar) END AS first_seen_date,
      CASE WHEN known THEN cast(b as varchar) END AS latest_seen_date, CASE WHEN known THEN cast(b - a as int) END AS days_on_market,
      CASE WHEN known THEN p END AS original_asking_price, CASE WHEN known THEN q END AS current_asking_price,
      CASE WHEN known AND p IS NOT NULL AND q IS NOT NULL THEN {r2('greatest(0, p - q)')} END AS total_price_reduction,
      CASE WHEN known AND p > 0 AND q IS NOT NULL THEN {r2('greatest(0, p - q) / p * 100.0')} END AS total_price_reduction_percentage,
      changes AS price_change_count,
      CASE WHEN known THEN {r2('cast(changes as double) / greatest(b - a, 1) * 30.0')} END AS reduction_frequency,
      coalesce(given_status, CASE WHEN n > 0 THEN last_status END, 'active') AS listing_status,
      n > 0 AND last_status = 'active' AND coalesce(seen_b - off_day <= 180, false) AS recently_relisted,
      CASE WHEN n > 0 AND last_status = 'active' AND coalesce(seen_b - off_day <= 180, false) THEN cast(seen_b as varchar) END AS relisted_date,
      n AS snapshot_count
    FROM filled""",
)


@query("listing_history_with_listings", WITH_LISTINGS_SQL)
def listing_history_with_listings(spark, sf_dir):
    given = spark.sql(GIVEN.replace("FROM listings", "FROM {listings}"), listings=view(spark, sf_dir, "listings"))
    watched = spark.sql(WATCHED.replace("FROM snapshots", "FROM {snapshots}"), snapshots=view(spark, sf_dir, "snapshots"))
    built = history.listing_history(watched, ORDER, listings=given)
    return _dates_as_text(built, "first_seen_date", "latest_seen_date", "relisted_date")


@query(
    "price_reductions",
    with_views(
        "snapshots",
        NUMBERED
        + f"""
        SELECT listing_id, snapshot_seq, cast(observed_at as varchar) AS observed_at, prev_price AS old_price,
          asking_price AS new_price, {r2('prev_price - asking_price')} AS reduction_amount,
          {r2('(prev_price - asking_price) / prev_price * 100')} AS reduction_percentage
        FROM numbered WHERE asking_price < prev_price""",
    ),
)
def price_reductions(spark, sf_dir):
    found = history.price_reductions(view(spark, sf_dir, "snapshots"), ORDER)
    return _dates_as_text(found.drop("listing_status", "surface_m2"), "observed_at")


@query(
    "relisting",
    with_views(
        "snapshots",
        f"""
        WITH numbered AS (
          SELECT *, row_number() OVER (PARTITION BY listing_id ORDER BY {ORDER_SQL}) AS rn FROM snapshots),
        rolled AS (
          SELECT listing_id, arg_max(listing_status, rn) AS latest_status, cast(max(observed_at) as date) AS latest_date,
            max(CASE WHEN listing_status IN ('withdrawn', 'sold') THEN cast(observed_at as date) END) AS off_market_date
          FROM numbered GROUP BY listing_id)
        SELECT listing_id, latest_status, cast(latest_date as varchar) AS latest_date,
          cast(off_market_date as varchar) AS off_market_date,
          latest_status = 'active' AND coalesce(latest_date - off_market_date <= 180, false) AS recently_relisted,
          CASE WHEN latest_status = 'active' AND coalesce(latest_date - off_market_date <= 180, false)
            THEN cast(latest_date as varchar) END AS relisted_date
        FROM rolled""",
    ),
)
def relisting(spark, sf_dir):
    found = history.relisting(view(spark, sf_dir, "snapshots"), ORDER)
    return _dates_as_text(found, "latest_date", "off_market_date", "relisted_date")


@query(
    "price_history_array",
    with_views(
        "snapshots",
        f"""
        SELECT listing_id, row_number() OVER (PARTITION BY listing_id ORDER BY {ORDER_SQL}) AS point_no,
          cast(cast(observed_at as date) as varchar) AS observed_date, asking_price, listing_status,
          'listing_snapshots' AS source
        FROM snapshots""",
    ),
)
def price_history_array(spark, sf_dir):
    return _dates_as_text(history.price_points(view(spark, sf_dir, "snapshots"), ORDER), "observed_date")


@query(
    "price_reduction_totals",
    with_views(
        "snapshots",
        NUMBERED
        + """
        SELECT listing_id, count(*) AS reduction_count, sum(prev_price - asking_price) AS total_reduction_amount
        FROM numbered WHERE asking_price < prev_price GROUP BY listing_id""",
    ),
)
def price_reduction_totals(spark, sf_dir):
    return history.reduction_totals(history.price_reductions(view(spark, sf_dir, "snapshots"), ORDER))


@query(
    "previous_prices",
    with_views(
        "listings snapshots",
        f"""
        WITH positive AS (
          SELECT *, row_number() OVER (PARTITION BY listing_id ORDER BY {ORDER_SQL}) AS rn,
            count(*) OVER (PARTITION BY listing_id) AS n
          FROM snapshots WHERE asking_price > 0),
        earlier AS (
          SELECT p.listing_id, p.observed_at, p.asking_price AS price, p.rn FROM positive p
          LEFT JOIN listings l ON l.listing_id = p.listing_id
          WHERE p.rn < p.n AND (l.latest_woz_value IS NULL
            OR abs(p.asking_price - floor(l.latest_woz_value / 50000) * 5000) > 0.009)),
        looked AS (SELECT *, lag(price) OVER (PARTITION BY listing_id ORDER BY rn) AS before FROM earlier)
        SELECT listing_id, row_number() OVER (PARTITION BY listing_id ORDER BY rn) AS step_no,
          cast(observed_at as varchar) AS observed_at, price
        FROM looked WHERE before IS NULL OR abs(before - price) > 0.009""",
    ),
)
def previous_prices(spark, sf_dir):
    current = view(spark, sf_dir, "listings").select(
        "listing_id", (F.floor(F.col("latest_woz_value") / 50000) * 5000).cast("double").alias("current_price")
    )
    found = history.previous_prices(view(spark, sf_dir, "snapshots"), current, ORDER)
    return _dates_as_text(found, "observed_at")


@query(
    "derived_reductions",
    with_views(
        "listings snapshots",
        NUMBERED
        + """
        , counts AS (
          SELECT listing_id, count(CASE WHEN asking_price < prev_price THEN 1 END) AS reduction_count
          FROM numbered GROUP BY listing_id)
        SELECT l.listing_id,
          coalesce(CASE WHEN l.price_reduction_count > 0 THEN cast(l.price_reduction_count as bigint) END,
            c.reduction_count, 0) AS derived_reduction_count
        FROM listings l LEFT JOIN counts c ON c.listing_id = l.listing_id""",
    ),
)
def derived_reductions(spark, sf_dir):
    counts = history.price_change_counts(view(spark, sf_dir, "snapshots"), ORDER)
    listings = view(spark, sf_dir, "listings").withColumn(
        "price_reduction_count", F.nullif("price_reduction_count", F.lit(0))
    )
    return history.derived_reductions(listings, counts).select("listing_id", "derived_reduction_count")


@query(
    "derived_days_on_market",
    with_views(
        "listings snapshots",
        f"""
        WITH oldest AS (SELECT listing_id, cast(min(observed_at) as date) AS day FROM snapshots GROUP BY listing_id)
        SELECT l.listing_id, coalesce(l.days_on_market,
          CASE WHEN l.listing_id % 10 = 0 THEN cast(date '{REFERENCE_DATE}' - (date '2001-01-01' + cast(l.listing_id % 300 as int)) as int) END,
          CASE WHEN date '{REFERENCE_DATE}' >= o.day THEN cast(date '{REFERENCE_DATE}' - o.day as int) END) AS derived_days_on_market
        FROM listings l LEFT JOIN oldest o ON o.listing_id = l.listing_id
        WHERE l.listing_id % 10 <> 0 OR date '2001-01-01' + cast(l.listing_id % 300 as int) <= date '{REFERENCE_DATE}'
        UNION ALL
        SELECT l.listing_id, coalesce(l.days_on_market,
          CASE WHEN date '{REFERENCE_DATE}' >= o.day THEN cast(date '{REFERENCE_DATE}' - o.day as int) END)
        FROM listings l LEFT JOIN oldest o ON o.listing_id = l.listing_id
        WHERE l.listing_id % 10 = 0 AND date '2001-01-01' + cast(l.listing_id % 300 as int) > date '{REFERENCE_DATE}'""",
    ),
)
def derived_days_on_market(spark, sf_dir):
    since = F.date_add(F.lit("2001-01-01").cast("date"), (F.col("listing_id") % 300).cast("int"))
    listings = view(spark, sf_dir, "listings").withColumn("listed_since", F.when(F.col("listing_id") % 10 == 0, since))
    found = history.derived_days(listings, view(spark, sf_dir, "snapshots"), F.lit(REFERENCE_DATE).cast("date"))
    return found.select("listing_id", "derived_days_on_market")


@query(
    "market_days",
    with_views(
        "snapshots",
        """
        SELECT listing_id, cast(cast(min(observed_at) as date) as varchar) AS listed_since,
          cast(cast(max(observed_at) as date) as varchar) AS latest_event_date,
          cast(cast(max(observed_at) as date) - cast(min(observed_at) as date) as int) AS days_on_market
        FROM snapshots GROUP BY listing_id""",
    ),
)
def market_days(spark, sf_dir):
    return _dates_as_text(
        history.market_days(view(spark, sf_dir, "snapshots"), "listing_id"), "listed_since", "latest_event_date"
    )


def newest_sale():
    return [F.col("sale_date").desc(), F.col("sale_id").desc()]


@query(
    "last_sale",
    with_views(
        "sales",
        """
        SELECT property_id, sale_id, cast(sale_date as varchar) AS sale_date, price, transaction_type FROM sales
        QUALIFY row_number() OVER (PARTITION BY property_id ORDER BY sale_date DESC, sale_id DESC) = 1""",
    ),
)
def last_sale(spark, sf_dir):
    return _dates_as_text(history.last_sale(view(spark, sf_dir, "sales"), "property_id", newest_sale()), "sale_date")


@query(
    "price_vs_last_sale",
    with_views(
        "listings sales",
        f"""
        WITH priced AS (
          SELECT * FROM sales WHERE price IS NOT NULL
          QUALIFY row_number() OVER (PARTITION BY property_id ORDER BY sale_date DESC, sale_id DESC) = 1)
        SELECT l.listing_id, p.price AS last_sale_price,
          CASE WHEN l.asking_price > 0 AND p.price > 0 THEN {r2('l.asking_price - p.price')} END AS change_amount,
          CASE WHEN l.asking_price > 0 AND p.price > 0 THEN {r2('(l.asking_price - p.price) / p.price * 100')} END AS change_percentage
        FROM listings l LEFT JOIN priced p ON p.property_id = l.listing_id""",
    ),
)
def price_vs_last_sale(spark, sf_dir):
    priced = history.last_sale(view(spark, sf_dir, "sales").where("price is not null"), "property_id", newest_sale())
    joined = view(spark, sf_dir, "listings").join(
        priced.select(F.col("property_id").alias("listing_id"), F.col("price").alias("last_sale_price")),
        "listing_id",
        "left",
    )
    change = finance.change_since_sale("asking_price", "last_sale_price")
    return joined.select(
        "listing_id",
        "last_sale_price",
        change["amount"].alias("change_amount"),
        change["percentage"].alias("change_percentage"),
    )


@query(
    "current_energy_label",
    with_views(
        "sales",
        """
        SELECT property_id, sale_id AS label_id, row_number() OVER (PARTITION BY property_id
          ORDER BY sale_date DESC, sale_id DESC) = 1 AS is_current
        FROM sales""",
    ),
)
def current_energy_label(spark, sf_dir):
    labels = view(spark, sf_dir, "sales").select(
        "property_id", F.col("sale_id").alias("label_id"), F.col("sale_date").alias("registered_on")
    )
    flagged = history.current_flag(labels, "property_id", ["registered_on", "label_id"])
    return flagged.select("property_id", "label_id", "is_current")
