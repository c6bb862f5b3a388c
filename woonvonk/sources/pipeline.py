"""Ingesting a batch of records: match, upsert, snapshot if changed, rank."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from woonvonk.functions.text import normalize_source_url
from woonvonk.operators import columns, history, matching, scoring
from woonvonk.operators.skew import first_per_key

CONTENT = ["asking_price", "listing_status", "surface_m2"]


def ingest_batch(records: DataFrame, stored: DataFrame, snapshots: DataFrame, only_new: bool = False) -> dict[str, DataFrame]:
    """Outcome of a batch as tables.

    ``records``: record_id, source_name, external_listing_id, source_url, title, address, city, asking_price, surface_m2,
    property_type, description, listing_status. ``stored``: the listings as they are (listing_id and the same
    columns). ``snapshots``: listing_id, observed_at, snapshot_seq and the content columns. Two records for the
    same listing are settled by the upsert: the later one wins.

    Gives ``matches``; ``listings`` after the batch; ``changes`` (listings whose newest snapshot differs, with the kind).
    Ranking takes ``listings`` (``scoring.rank_pipeline``).
    """
    matches = matching.match_listings(records, stored, [])
    taken = matching.only_new(matches) if only_new else matches
    fresh_id = F.sha2(normalize_source_url("source_url"), 256)
    identified = taken.withColumn("listing_key", F.coalesce(F.col("matched_listing_id").cast("string"), fresh_id))
    arriving = first_per_key(identified, ["listing_key"], [F.col("record_id").desc()])
    latest = first_per_key(snapshots, ["listing_id"], [F.col("observed_at").desc(), F.col("snapshot_seq").desc()])
    old = latest.select(F.col("listing_id").cast("string").alias("listing_key"), F.struct(*CONTENT).alias("_old"))
    compared = arriving.join(old, "listing_key", "left")
    first = F.col("_old").isNull()
    same = ~first
    for c in CONTENT:
        same = same & F.col(f"_old.{c}").eqNullSafe(F.col(c))
    kind = F.when(same, "unchanged").otherwise(history.change_type(first, F.col("_old"), "asking_price", "listing_status", None))
    settled = compared.withColumn("change_type", kind).drop("_old")
    kept = [c for c in stored.columns if c != "listing_id"]
    untouched = stored.withColumn("listing_key", F.col("listing_id").cast("string")).join(settled.select("listing_key"), "listing_key", "left_anti")
    return {
        "matches": matches,
        "listings": untouched.select("listing_key", *kept).unionByName(settled.select("listing_key", *kept)),
        "changes": settled.where(F.col("change_type") != "unchanged"),
    }


def refresh_metadata(stored: DataFrame, extracted: DataFrame, source_name: str, key: str = "listing_id") -> DataFrame:
    """Stored listings with what their pages say now; what changed is listed in ``changed_fields``."""
    texts, figures = ["title", "address", "city", "property_type"], ["asking_price", "surface_m2"]
    news = extracted.select(key, *[F.col(c).alias(f"new_{c}") for c in [*texts, *figures]])
    return columns.merge_refresh(stored.join(news, key, "left"), texts, figures, source_name)


def rank(listings: DataFrame) -> DataFrame:
    return scoring.rank_pipeline(listings)
