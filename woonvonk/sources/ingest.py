"""Listings from files and feeds: CSV, JSON, URL lists, feed documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from woonvonk.functions.casts import strip, text_or_null, to_double, to_int
from woonvonk.functions.text import normalize_url, url_authority, url_scheme

# Required fields, canonical columns, feed wrappers and the fall-back names of feed fields.
REQUIRED = ["source_name", "source_url"]
TEXT_COLUMNS = ["source_name", "external_listing_id", "source_url", "title", "address", "city", "property_type", "description", "listing_status"]
NUMBER_COLUMNS = ["asking_price", "surface_m2"]
FEED_WRAPPERS = ["items", "results", "listings", "data"]
FEED_FIELDS = {
    "external_listing_id": ["external_listing_id", "external_id", "id", "listing_id"],
    "source_url": ["source_url", "url", "link", "listing_url"],
    "title": ["title", "name", "headline"],
    "address": ["address", "street", "location"],
    "city": ["city", "town", "municipality"],
    "asking_price": ["asking_price", "price", "vraagprijs"],
    "surface_m2": ["surface_m2", "area_m2", "living_area", "size"],
    "property_type": ["property_type", "type", "category"],
    "listing_status": ["listing_status", "status"],
    "status": ["status", "listing_status"],
    "listed_since": ["listed_since", "listed_at", "publish_date", "date_listed"],
    "description": ["description", "summary", "body"],
    "image_urls": ["image_urls", "images", "photos"],
}

RAW_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in [*TEXT_COLUMNS, *NUMBER_COLUMNS]])


def check_required(df: DataFrame, label: str, required: list[str] = REQUIRED) -> DataFrame:
    """Add ``warning``: the required fields a record lacks, NULL when it is complete."""
    absent = F.array_sort(F.array_compact(F.array(*[F.when(text_or_null(c).isNull(), F.lit(c)) for c in required])))
    number = F.col("record_no").cast("string") if "record_no" in df.columns else F.lit("?")
    message = F.concat(F.lit(f"{label} "), number, F.lit(": missing required fields: "), F.array_join(absent, ", "))
    return df.withColumn("warning", F.when(F.size(absent) > 0, message))


def canonical(df: DataFrame, default_source: str = "manual_import") -> DataFrame:
    """Typed listing columns; blanks are NULL, a missing status is active."""

    def have(name: str) -> Column:
        return F.col(name) if name in df.columns else F.lit(None).cast("string")

    texts = {c: text_or_null(have(c)) for c in TEXT_COLUMNS}
    texts["source_name"] = F.coalesce(texts["source_name"], F.lit(default_source))
    texts["listing_status"] = F.coalesce(texts["listing_status"], F.lit("active"))
    numbers = {c: to_double(have(c)) for c in NUMBER_COLUMNS}
    extra = [c for c in ("record_no", "warning", "raw_payload") if c in df.columns]
    return df.select(*extra, *[c.alias(n) for n, c in {**texts, **numbers}.items()])


def accepted(df: DataFrame) -> DataFrame:
    return df.where(F.col("warning").isNull()).drop("warning")


def rejected(df: DataFrame) -> DataFrame:
    return df.where(F.col("warning").isNotNull()).select("record_no", "warning")


def read_csv(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """CSV with a header: names and values trimmed, records checked; unknown columns are ignored.

    ``record_no`` comes from a ``record_no`` column of the file when there is one: a distributed read has
    no line numbers.
    """
    raw = spark.read.csv(path, header=True, multiLine=multi_line, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    named = raw.toDF(*[c.strip() for c in raw.columns])
    complete = named.withColumns({c: F.lit(None).cast("string") for c in REQUIRED if c not in named.columns})
    return canonical(check_required(complete, "Row"))


def read_json(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """JSON objects (one per line, or whole documents with ``multi_line``); records that are no objects
    are dropped, incomplete ones get a warning."""
    schema = T.StructType([T.StructField("record_no", T.LongType()), *RAW_SCHEMA.fields, T.StructField("_broken", T.StringType())])
    raw = spark.read.json(path, schema=schema, multiLine=multi_line, mode="PERMISSIVE", columnNameOfCorruptRecord="_broken")
    return canonical(check_required(raw.where(F.col("_broken").isNull()).drop("_broken"), "Item"))


def read_urls(lines: DataFrame, source_name: str = "manual_url") -> DataFrame:
    """One URL per line (columns ``line_no``, ``value``); blank lines are skipped, bad ones get a warning."""
    url = strip("value")
    fine = url_scheme(url).isin("http", "https") & (url_authority(url) != "")
    message = F.concat(F.lit("Line "), F.col("line_no").cast("string"), F.lit(": invalid URL '"), url, F.lit("'."))
    return lines.where(url != "").select(
        F.col("line_no").alias("record_no"),
        F.lit(source_name).alias("source_name"),
        url.alias("source_url"),
        F.when(~F.coalesce(fine, F.lit(False)), message).alias("warning"),
    )


def feed_items(documents: DataFrame, body: str = "body") -> DataFrame:
    """Items of feed documents: the root array, or the first array among the known wrappers.

    Each item is a map from its field names to JSON text, so that presence of a field can be told from a
    field that is null.
    """
    trimmed = strip(body)
    wrapped = [F.from_json(F.get_json_object(body, f"$.{w}"), "array<string>") for w in FEED_WRAPPERS]
    texts = F.when(trimmed.startswith("["), F.from_json(trimmed, "array<string>")).otherwise(F.coalesce(*wrapped))
    rows = documents.select("*", F.posexplode(texts).alias("item_no", "_text")).where(F.col("_text").startswith("{"))
    return rows.withColumn("item", F.from_json("_text", "map<string,string>")).drop("_text")


def first_present(item: str | Column, names: list[str]) -> Column:
    """Value of the first name the item has, even when that value is null."""
    source = F.col(item) if isinstance(item, str) else item
    out = F.when(F.map_contains_key(source, names[0]), F.try_element_at(source, F.lit(names[0])))
    for name in names[1:]:
        out = out.when(F.map_contains_key(source, name), F.try_element_at(source, F.lit(name)))
    return out


def map_feed_items(items: DataFrame, mapping: dict[str, str | list[str]] | None = None, source_name: str = "generic_feed") -> DataFrame:
    """Feed fields to listing fields: the configured names first, then the usual ones."""
    mapping = mapping or {}
    columns = {}
    for field, usual in FEED_FIELDS.items():
        given = mapping.get(field, [])
        names = [given] if isinstance(given, str) else list(given)
        columns[field] = first_present("item", [*names, *usual])
    return items.select(
        *[c for c in items.columns if c not in ("item", "body")],
        F.lit(source_name).alias("source_name"),
        *[c.alias(n) for n, c in columns.items()],
    )


def normalize_records(records: DataFrame, default_source: str) -> DataFrame:
    """Canonical listing per record, or an error; a bad record never fails the batch.

    The URL may come as ``source_url``, ``url`` or ``link``; the id as ``external_listing_id`` or
    ``listing_id``; the area as ``surface_m2`` or ``living_area``.
    """

    def have(*names: str) -> Column:
        return F.coalesce(*[text_or_null(n) for n in names if n in records.columns], F.lit(None).cast("string"))

    url = have("source_url", "url", "link")
    price = to_double(have("asking_price"))
    area = to_double(have("surface_m2", "living_area"))
    given = have("external_listing_id", "listing_id")
    listing = F.struct(
        F.coalesce(have("source_name"), F.lit(default_source)).alias("source_name"),
        F.coalesce(given, F.nullif(normalize_url(url), F.lit(""))).alias("external_listing_id"),
        url.alias("source_url"),
        have("title").alias("title"),
        have("address").alias("address"),
        have("city").alias("city"),
        price.alias("asking_price"),
        area.alias("surface_m2"),
        have("property_type").alias("property_type"),
        have("description").alias("description"),
        F.coalesce(have("listing_status", "status"), F.lit("active")).alias("listing_status"),
    )
    return records.select(
        *[c for c in ("record_no",) if c in records.columns],
        url.isNotNull().alias("success"),
        F.when(url.isNull(), "ValueError: Missing required source_url").alias("error"),
        F.when(url.isNotNull(), listing).alias("listing"),
        F.to_json(F.struct(*records.columns)).alias("raw_payload"),
    )


# Columns of the wide property row beside the listing's own, with their types.
PROPERTY_TEXTS = [
    "country", "asking_price_text", "postal_code", "municipality", "bag_id", "bag_nummeraanduiding_id", "bag_pand_id",
    "bag_usage_purpose", "bag_postcode", "bag_municipality", "listing_history_source", "broker", "source_timestamp",
    "current_use", "zoning", "energy_label",
]
PROPERTY_INTS = ["bag_building_year", "woz_object_number", "woz_valuation_year", "days_on_market", "bedrooms", "construction_year"]
PROPERTY_NUMBERS = [
    "bag_official_floor_area_m2", "latest_woz_value", "neighborhood_m2_price_average", "street_m2_price_average",
    "original_asking_price", "current_asking_price", "total_price_reduction_amount", "total_price_reduction_percentage",
    "plot_size_m2", "price_per_m2", "annual_rent",
]


def to_property(listings: DataFrame, payload: str = "raw_payload") -> DataFrame:
    """Wide property row: listing columns over the JSON payload, with defaults."""

    def raw(name: str) -> Column:
        return F.nullif(strip(F.get_json_object(payload, f"$.{name}")), F.lit(""))

    photos = F.from_json(F.coalesce(F.get_json_object(payload, "$.photos"), F.get_json_object(payload, "$.image_urls")), "array<string>")
    return listings.withColumns(
        {
            **{n: raw(n) for n in PROPERTY_TEXTS},
            **{n: to_int(raw(n)) for n in PROPERTY_INTS},
            **{n: to_double(raw(n)) for n in PROPERTY_NUMBERS},
            "asking_price_status": F.when(F.col("asking_price").isNotNull(), "known").otherwise("unknown"),
            "price_reduction_count": F.coalesce(to_int(raw("price_reduction_count")), F.lit(0)),
            "listing_history_confidence": F.coalesce(raw("listing_history_confidence"), F.lit("unknown")),
            "photos": F.coalesce(F.filter(F.transform(photos, lambda p: strip(p)), lambda p: p != ""), F.array().cast("array<string>")),
            "raw_text": F.coalesce(raw("raw_text"), "description"),
        }
    )
