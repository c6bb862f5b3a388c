"""Key-value enrichments: one property to many items, and back to columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from woonvonk.functions import finance
from woonvonk.functions.casts import clamped, let, text_or_null
from woonvonk.functions.text import last_comma_part, postcode_token
from woonvonk.operators.columns import is_monument

# Item keys, in order, and the confidences and defaults of the looked-up ones.
PUBLIC_KEYS = [
    "bag_id", "bag_address_id", "bag_verblijfsobject_id", "bag_nummeraanduiding_id", "bag_pand_id", "bag_building_year",
    "bag_usage_purpose", "bag_status", "bag_official_floor_area_m2", "bag_coordinates", "bag_postcode", "bag_municipality",
    "bag_retrieval_date", "bag_source", "bag_confidence_score", "bag_quality_flags", "funda_living_area_m2",
    "living_area_difference_m2", "living_area_difference_percentage", "calculation_area_m2", "calculation_area_source",
    "asking_price_per_m2", "woz_value_per_m2", "woz_object_number", "latest_woz_value", "woz_valuation_year",
    "woz_historical_values",
]
ALWAYS_FINE = ["bag_quality_flags"]
DISTANCES = {
    "distance_to_city_center": 2.6, "distance_to_station": 1.4, "distance_to_supermarket": 0.7, "distance_to_highway": 3.8,
}
DISTANCE_CONFIDENCE = 45
KNOWN_MUNICIPALITY, NO_MUNICIPALITY = 80, 20
KNOWN_POSTCODE, NO_POSTCODE = 85, 10
STREET_CONFIDENCE, NEIGHBOURHOOD_CONFIDENCE = 30, 28
MONUMENT_CONFIDENCE, NO_MONUMENT_CONFIDENCE = 55, 15
LAND_CONFIDENCE = 5
NOT_IMPLEMENTED = "Not yet implemented"


def item(key: str, value: Column, confidence: Column | int, source: str, success: Column | bool = True, error: Column | None = None) -> Column:
    """One enrichment item."""

    def lit(x):
        return x if isinstance(x, Column) else F.lit(x)

    return F.struct(
        F.lit(key).alias("enrichment_key"),
        value.cast("string").alias("value"),
        F.lit(source).alias("source"),
        F.coalesce(clamped(lit(confidence).cast("int"), 0, 100), F.lit(0)).alias("confidence_score"),
        F.coalesce(lit(success), F.lit(False)).alias("success"),
        (error if error is not None else F.lit(None)).cast("string").alias("error_message"),
    )


def _have(df: DataFrame, name: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None)


def looked_up_items(df: DataFrame) -> list[Column]:
    """The twelve items beside the register: place, distances, local prices, monument, placeholders.

    Distances are literals unless a column of that name is given.
    """
    place = F.concat_ws(", ", text_or_null("address"), text_or_null("city"))
    municipality = F.coalesce(text_or_null(_have(df, "municipality")), last_comma_part(place))
    postcode = F.coalesce(text_or_null(_have(df, "postal_code")), postcode_token(place))
    monument = is_monument(F.coalesce(_have(df, "raw_text"), F.lit("")), F.coalesce("description", F.lit("")))
    distances = [
        item(k, F.coalesce(_have(df, k).cast("double"), F.lit(km)), DISTANCE_CONFIDENCE, "mock_geospatial_estimate")
        for k, km in DISTANCES.items()
    ]
    return [
        item("municipality", municipality, F.when(municipality.isNotNull(), KNOWN_MUNICIPALITY).otherwise(NO_MUNICIPALITY), "property_model_or_address"),
        item("postal_code", postcode, F.when(postcode.isNotNull(), KNOWN_POSTCODE).otherwise(NO_POSTCODE), "property_model_or_address"),
        *distances,
        item(
            "neighborhood_m2_price_average",
            finance.local_price_estimate("asking_price", "surface_m2", finance.NEIGHBOURHOOD_FACTOR),
            NEIGHBOURHOOD_CONFIDENCE, "mock_neighborhood_price_estimate",
        ),
        item(
            "street_m2_price_average",
            finance.local_price_estimate("asking_price", "surface_m2", finance.STREET_FACTOR),
            STREET_CONFIDENCE, "mock_street_price_estimate",
        ),
        item(
            "monument_status", F.when(monument, "monument").otherwise("unknown"),
            F.when(monument, MONUMENT_CONFIDENCE).otherwise(NO_MONUMENT_CONFIDENCE), "listing_text_indicator",
        ),
        item("land_registry_information", F.lit("Placeholder until Kadaster integration exists"), LAND_CONFIDENCE, "placeholder_land_registry"),
        item("permit_information", F.lit(NOT_IMPLEMENTED), 0, "placeholder"),
        item("zoning", F.lit(NOT_IMPLEMENTED), 0, "placeholder"),
    ]


def public_items(df: DataFrame, confidence: str = "confidence_score") -> list[Column]:
    """The 27 register items; one without a value is marked as not successful and leaves the others alone."""
    trust = _have(df, confidence)
    out = []
    for key in PUBLIC_KEYS:
        value = _have(df, key)
        if dict(df.dtypes).get(key, "").startswith(("array", "struct", "map")):
            value = F.to_json(key)
        fine = F.lit(True) if key in ALWAYS_FINE else F.coalesce(value.cast("string"), F.lit("")) != ""
        out.append(item(key, value, trust, "public_registers", fine))
    return out


LOOKED_UP_KEYS = [
    "municipality", "postal_code", *DISTANCES, "neighborhood_m2_price_average", "street_m2_price_average", "monument_status",
    "land_registry_information", "permit_information", "zoning",
]


def fan_out(df: DataFrame, key: str, keys: list[str] | None = None) -> DataFrame:
    """All 39 items per property, or those that ``keys`` asks for; no shuffle.

    The outer form keeps Spark from building the items a second time to filter empty arrays.
    """
    named = zip([*PUBLIC_KEYS, *LOOKED_UP_KEYS], [*public_items(df), *looked_up_items(df)])
    wanted = [
        F.struct(F.lit(no).alias("item_no"), built.alias("i"))
        for no, (name, built) in enumerate(named)
        if keys is None or name in keys
    ]
    return df.select(key, F.explode_outer(F.array(*wanted)).alias("e")).select(key, "e.item_no", "e.i.*")


def pivot(items: DataFrame, key: str, keys: list[str], order: str = "item_no") -> DataFrame:
    """Items back to one row per property: the newest item of each key.

    Both steps are mergeable: the newest value per property and key, then a map with at most one entry per key, so
    that a row is compared with its own key's newest and not with every key's.
    """
    newest = items.where(F.col("enrichment_key").isin(keys)).groupBy(key, "enrichment_key").agg(F.max_by("value", order).alias("value"))
    held = newest.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("enrichment_key", "value"))).alias("_held"))

    def value(name: str) -> Column:
        return F.try_element_at("_held", F.lit(name))

    # with a ``let`` among them the columns become short methods instead of one that the JVM doesn't compile
    first, *others = keys
    return held.select(key, let(value(first), lambda v: v).alias(first), *[value(k).alias(k) for k in others])


# Names that stand in for each other; the first that has a value counts.
ALIASES = {
    "bag_building_year": ["bag_building_year", "construction_year_bag"],
    "construction_year_bag": ["construction_year_bag", "bag_building_year"],
    "bag_usage_purpose": ["bag_usage_purpose", "usage_purpose"],
    "usage_purpose": ["usage_purpose", "bag_usage_purpose"],
    "bag_status": ["bag_status", "status"],
    "status": ["status", "bag_status"],
    "bag_official_floor_area_m2": ["bag_official_floor_area_m2", "official_floor_area_m2"],
    "official_floor_area_m2": ["official_floor_area_m2", "bag_official_floor_area_m2"],
    "bag_retrieval_date": ["bag_retrieval_date", "retrieval_date"],
    "retrieval_date": ["retrieval_date", "bag_retrieval_date"],
    "bag_source": ["bag_source", "source"],
    "source": ["source", "bag_source"],
    "bag_confidence_score": ["bag_confidence_score", "confidence_score"],
    "confidence_score": ["confidence_score", "bag_confidence_score"],
    "bag_quality_flags": ["bag_quality_flags", "quality_flags"],
    "quality_flags": ["quality_flags", "bag_quality_flags"],
}
# The parts of an item that holds both kinds of coordinates.
COORDINATES = {"bag_coordinates_rd": "$.rd", "bag_coordinates_ll": "$.ll"}


def with_aliases(df: DataFrame) -> DataFrame:
    """Fill each name from the first of its aliases that has a value, and take coordinates apart."""
    out = {}
    for name, options in ALIASES.items():
        present = [o for o in options if o in df.columns]
        if present and present != [name]:
            out[name] = F.coalesce(*[F.nullif(F.col(o).cast("string"), F.lit("")) for o in present])
    if "bag_coordinates" in df.columns:
        out |= {name: F.get_json_object("bag_coordinates", path) for name, path in COORDINATES.items()}
    return df.withColumns(out)


def group_stats(items: DataFrame, key: str) -> DataFrame:
    """Items, failures and state per property."""
    failed = F.count_if(~F.col("success"))
    return items.groupBy(key).agg(
        F.count(F.lit(1)).alias("item_count"), failed.alias("error_count"), failed.alias("warning_count")
    ).withColumn("status", F.when(F.col("error_count") == 0, "completed").otherwise("completed_with_errors"))
