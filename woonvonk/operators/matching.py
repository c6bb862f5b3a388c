"""Entity resolution, keyed upserts and set differences over listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from woonvonk.functions.casts import strip, text_or_null
from woonvonk.functions.text import address_components, normalize_source_url, normalize_url
from woonvonk.operators.skew import first_per_key, top_n_per_key
from woonvonk.session import broadcast_if_small

# Match tiers, best first, with their confidence.
TIERS = [
    (1, "source_external_listing_id", 1.0),
    (2, "normalized_source_url", 0.98),
    (3, "postcode_house_number", 0.95),
    (4, "normalized_address", 0.9),
    (5, "address_surface_fallback", 0.75),
]
AREA_TOLERANCE = 1.0


def _tier_keys(strict_address: bool) -> Column:
    """The keys of a listing, one per tier that applies; blank keys are left out."""
    parts = F.col("_address")
    tiers = [
        (1, F.when(
            text_or_null("external_listing_id").isNotNull() & F.col("source_name").isNotNull(),
            F.concat_ws("|", "source_name", "external_listing_id"),
        )),
        (2, F.nullif(normalize_url("source_url"), F.lit(""))),
        (3, F.when(
            parts["postcode"].isNotNull() & parts["house_number"].isNotNull(),
            F.concat_ws("|", parts["postcode"], parts["house_number"], F.coalesce(parts["addition"], F.lit(""))),
        )),
    ]
    if strict_address:
        tiers.append((4, F.nullif(parts["normalized_address"], F.lit(""))))
    return F.filter(
        F.array(*[F.struct(F.lit(t).alias("tier"), k.alias("key")) for t, k in tiers]), lambda x: x["key"].isNotNull()
    )


def match_listings(
    incoming: DataFrame, existing: DataFrame, existing_order: list[str], strict_address: bool = True
) -> DataFrame:
    """Best existing listing for each incoming one: the first tier that hits, then the first row.

    Both sides have ``source_name``, ``external_listing_id``, ``source_url``, ``address`` and
    ``surface_m2``; ``incoming`` has a unique ``record_id``, ``existing`` a ``listing_id``.

    All tiers are one equi-join on (tier, key). The existing side is first reduced to one row per key
    with map-side minima, so no pair is ever produced beyond one per incoming row and tier, however many
    copies share an address. With ``strict_address=False`` an equal address alone does not match; the
    living areas must then lie within one square metre (tier 5).
    """
    order = F.struct(*existing_order, "listing_id")
    known = existing.withColumn("_address", address_components("address")).withColumn("_order", order)
    arriving = incoming.withColumn("_address", address_components("address"))
    first_known = (
        known.select("_order", F.explode(_tier_keys(strict_address)).alias("t"))
        .groupBy("t.tier", "t.key")
        .agg(F.min("_order").alias("_order"))
    )
    hits = (
        arriving.select("record_id", F.explode(_tier_keys(strict_address)).alias("t"))
        .select("record_id", "t.*")
        .join(first_known, ["tier", "key"])
        .select("record_id", "tier", "_order")
    )
    if not strict_address:
        hits = hits.unionByName(_area_hits(arriving, known))
    best = hits.groupBy("record_id").agg(F.min(F.struct("tier", "_order")).alias("_best"))
    names = F.create_map(*[F.lit(x) for t, n, _ in TIERS for x in (t, n)])
    trust = F.create_map(*[F.lit(x) for t, _, c in TIERS for x in (t, c)])
    return incoming.join(best, "record_id", "left").select(
        *incoming.columns,
        F.col("_best._order.listing_id").alias("matched_listing_id"),
        F.coalesce(F.try_element_at(names, F.col("_best.tier")), F.lit("none")).alias("match_method"),
        F.coalesce(F.try_element_at(trust, F.col("_best.tier")), F.lit(0.0)).alias("confidence"),
    )


def _area_hits(arriving: DataFrame, known: DataFrame) -> DataFrame:
    """Equal address and areas at most one square metre apart.

    Known rows are reduced to one per (address, area). An incoming row looks into its own one-metre bucket
    and the two beside it, so it meets at most the distinct areas of three buckets.
    """

    def keyed(df: DataFrame) -> DataFrame:
        return df.where(F.col("surface_m2").isNotNull() & (F.col("_address.normalized_address") != "")).withColumn(
            "_key", F.col("_address.normalized_address")
        )

    areas = (
        keyed(known)
        .groupBy("_key", F.col("surface_m2").alias("_area"))
        .agg(F.min("_order").alias("_order"))
        .withColumn("_bucket", F.floor("_area"))
    )
    looking = keyed(arriving).select(
        "record_id", "_key", "surface_m2", F.explode(F.sequence(F.floor("surface_m2") - 1, F.floor("surface_m2") + 1)).alias("_bucket")
    )
    return (
        looking.join(areas, ["_key", "_bucket"])
        .where(F.abs(F.col("surface_m2") - F.col("_area")) <= AREA_TOLERANCE)
        .select("record_id", F.lit(5).alias("tier"), "_order")
    )


def only_new(matched: DataFrame) -> DataFrame:
    """Records that match no existing listing."""
    return matched.where(F.col("matched_listing_id").isNull())


def upsert(current: DataFrame, incoming: DataFrame, key: Column, order: list[str], keep_first: list[str] = ()) -> DataFrame:
    """Insert or overwrite by natural key.

    The last incoming row per key wins and overwrites every column, NULLs included; columns in
    ``keep_first`` keep the stored value. Incoming rows with a NULL key are ignored; stored ones stay and take no part in
    the join, where they would all meet in one task.
    """
    latest = first_per_key(
        incoming.withColumn("_key", key).where(F.col("_key").isNotNull()),
        ["_key"],
        [F.col(c).desc_nulls_last() for c in order],
    )
    stored = current.withColumn("_key", key)
    keyless = stored.where(F.col("_key").isNull()).select(*current.columns)
    stored = stored.where(F.col("_key").isNotNull())
    arrivals = latest.withColumn("_present", F.lit(True))
    joined = stored.alias("o").join(arrivals.alias("n"), "_key", "full_outer")
    arrived = F.col("n._present").isNotNull()
    columns = [
        (F.coalesce(F.col(f"o.{c}"), F.col(f"n.{c}")) if c in keep_first else F.when(arrived, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}"))).alias(c)
        for c in current.columns
    ]
    return joined.select(*columns).union(keyless)


def upsert_listings(current: DataFrame, incoming: DataFrame, order: list[str]) -> DataFrame:
    """Listings by normalised URL; the day first seen and the id of a stored listing stay."""
    key = F.nullif(normalize_source_url("source_url"), F.lit(""))
    return upsert(current, incoming, key, order, keep_first=["listing_id", "first_seen_at"])


def two_miss_inactive(listings: DataFrame, sightings: DataFrame, runs: DataFrame) -> DataFrame:
    """Listings absent from the current and from the previous completed run of their source.

    ``runs``: source_id, run_id, started_at, status. ``sightings``: source_id, run_id, listing_id (one row
    per sighting; repeats are fine). Gives per listing ``evaluated`` (absent now) and ``mark_inactive``.
    Nothing happens for sources without a previous run, or one that saw nothing.
    """
    recent = broadcast_if_small(latest_two_runs(runs))
    seen = sightings.join(recent, ["source_id", "run_id"]).select("source_id", "listing_id", "run_rank")
    flags = seen.groupBy("source_id", "listing_id").agg(
        F.bool_or(F.col("run_rank") == 1).alias("_now"), F.bool_or(F.col("run_rank") == 2).alias("_before")
    )
    usable = broadcast_if_small(seen.where("run_rank = 2").select("source_id").distinct())
    judged = listings.join(usable, "source_id", "left_semi").join(flags, ["source_id", "listing_id"], "left")
    absent = ~F.coalesce("_now", F.lit(False))
    return judged.select(
        "source_id",
        "listing_id",
        absent.alias("evaluated"),
        (absent & ~F.coalesce("_before", F.lit(False))).alias("mark_inactive"),
    ).where("evaluated")


def latest_two_runs(runs: DataFrame) -> DataFrame:
    """Current (1) and previous (2) completed run of each source."""
    done = runs.where(F.lower("status") == "completed")
    return top_n_per_key(
        done, ["source_id"], [F.col("started_at").desc(), F.col("run_id").desc()], 2, "run_rank"
    ).select("source_id", "run_id", "run_rank")


def missing_ids(listings: DataFrame, *seen: DataFrame) -> DataFrame:
    """Ids in none of the given sets."""
    left = listings.select("listing_id").distinct()
    for ids in seen:
        left = left.join(ids.select("listing_id"), "listing_id", "left_anti")
    return left


def keep_first(df: DataFrame, order: list[str], address: str = "address", city: str = "city") -> DataFrame:
    """One row per listing: keyed by id, else URL, else address and city; the first in order stays."""
    place = F.concat_ws("::", F.lower(strip(F.coalesce(address, F.lit("")))), F.lower(strip(F.coalesce(city, F.lit("")))))
    key = F.coalesce(text_or_null("listing_id"), text_or_null("source_url"), place)
    return first_per_key(df.withColumn("_key", key), ["_key"], [F.col(c) for c in order]).drop("_key")


def union_sources(frames: list[DataFrame], order: list[str]) -> DataFrame:
    """All records of several sources, each listing once (first source first)."""
    tagged = [f.withColumn("source_order", F.lit(i)) for i, f in enumerate(frames)]
    merged = tagged[0]
    for frame in tagged[1:]:
        merged = merged.unionByName(frame, allowMissingColumns=True)
    return keep_first(merged, ["source_order", *order])


def merge_permits(history: DataFrame, active: DataFrame, keys: list[str]) -> DataFrame:
    """Past and active permits as one list: equal entries once, a past one dropped when it is active.

    Grouping treats NULL keys as equal, so one pass with map-side maxima does the work.
    """
    rows = history.select(*keys, F.lit(False).alias("is_active")).unionByName(
        active.select(*keys, F.lit(True).alias("is_active"))
    )
    return rows.groupBy(*keys).agg(F.bool_or("is_active").alias("is_active"))


def merge_places(*lists: DataFrame) -> DataFrame:
    """Places of several lists (columns ``place``, ``place_order``), each once whatever its case."""
    merged = None
    for i, places in enumerate(lists):
        part = places.select(strip("place").alias("place"), "place_order", F.lit(i).alias("list_no"))
        merged = part if merged is None else merged.unionByName(part)
    named = merged.where(F.col("place") != "").withColumn("_key", F.lower("place"))
    return first_per_key(named, ["_key"], [F.col("list_no"), F.col("place_order"), F.col("place")]).select(
        "place", "list_no", "place_order"
    )
