"""The deal list: candidates with listing, price history and scores in one job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from woonvonk.functions import bands, finance
from woonvonk.operators import history, reports, scoring
from woonvonk.operators.skew import HOT_ROWS

NAMES = {
    "plaats": "city", "vraagprijs": "asking_price", "woonoppervlak": "surface_m2", "perceel": "plot_size_m2", "slaapkamers": "bedrooms",
    "energielabel": "energy_label", "bouwjaar": "construction_year",
}


def deal_rows(
    candidates: DataFrame,
    listings: DataFrame,
    sources: DataFrame,
    snapshots: DataFrame,
    order: list[str],
    reference: Column,
    shown_prices: int,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Scored deal rows. The candidates given are the peer set for city averages and percentiles.

    What depends on the listing alone is worked out once per listing, which counts as often as it has candidates, and
    then joined to them. Earlier prices are shown for the newest ``shown_prices`` steps; counts and days cover the
    whole history.
    """
    given = candidates.where(F.col("listing_id").isNotNull())
    peers = given.groupBy("listing_id").agg(F.count(F.lit(1)).alias("_peers"))
    fields = [c.alias(NAMES.get(n, n)) for n, c in reports.listing_fields().items()]
    listed = reports.candidates_with_listing(peers, listings, sources).select("listing_id", "_peers", *fields)
    placed = scoring.with_city_peers(listed, weight="_peers")
    current = listings.select("listing_id", F.col("asking_price").alias("current_price"))
    past = history.price_history(snapshots, current, order, shown_prices, hot_rows=hot_rows)
    since = F.datediff(reference, F.col("oldest"))
    woz = finance.woz_difference("asking_price", "latest_woz_value")
    built = placed.join(past, "listing_id", "left").withColumns(
        {
            "vorige_vraagprijzen": F.coalesce(bands.price_path(F.col("earlier")), F.lit("Onbekend")),
            "price_reduction_count": F.coalesce(F.col("price_reduction_count"), F.col("reduction_count").cast("int"), F.lit(0)),
            "days_on_market": F.coalesce(F.col("days_on_market"), F.when(since >= 0, since)),
            "asking_price_minus_woz_value": woz["difference_eur"],
            "asking_price_vs_woz_percentage": woz["difference_pct"],
        }
    )
    known = scoring.with_potentials(built).drop("_peers", "earlier", "oldest", "reduction_count")
    own = given.select("candidate_id", "listing_id", "investment_score", F.col("hidden_value_score").alias("deal_score"), "detected_at")
    return scoring.with_overall_score(own.join(known, "listing_id"))
