"""Nested documents: scan reports, analyses and typed records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from woonvonk.functions.casts import code_or, let, strip, text_or_null, to_double, to_int
from woonvonk.functions.numbers import with_inferred_price
from woonvonk.operators.columns import TRANSACTION_TYPES
from woonvonk.operators.skew import with_previous

# --- scan reports ------------------------------------------------------------------------------

SCAN_SCHEMA = (
    "source string, run_id string, data_origin string, started_at string, completed_at string, status string, "
    "summary struct<listings_found:bigint,listings_imported:bigint,fully_imported:bigint,partially_imported:bigint,"
    "listings_failed:bigint,average_import_time_seconds:double>, "
    "properties array<struct<record_index:bigint,import_status:string,missing_fields:array<string>,"
    "property:struct<listing_id:string,address:string,city:string,asking_price:double,current_asking_price:double,"
    "surface_m2:double,energy_label:string,latest_woz_value:double,woz_value:double,source_name:string>>>"
)


def write_scan_reports(reports: DataFrame, path: str) -> None:
    """One JSON document per run, in a folder per source."""
    reports.hint("rebalance", "source").write.mode("append").partitionBy("source").json(path)


def read_scan_runs(spark: SparkSession, path: str) -> DataFrame:
    """Scan reports with the file they come from and its time."""
    return spark.read.json(path, schema=SCAN_SCHEMA).select(
        "*",
        F.col("_metadata.file_modification_time").alias("file_time"),
        F.col("_metadata.file_name").alias("file_name"),
    )


def newest_report(reports: DataFrame, *, by: list[str] | None = None) -> DataFrame:
    """Newest report by file time and name (and run id, as one file may hold several)."""
    newest = F.max_by(F.struct(*[c for c in reports.columns if c not in (by or [])]), F.struct("file_time", "file_name", "run_id"))
    grouped = reports.groupBy(*by) if by else reports.groupBy()
    return grouped.agg(newest.alias("r")).select(*(by or []), "r.*")


def report_properties(reports: DataFrame) -> DataFrame:
    """Property rows of scan reports; rows without an id are left out."""
    price = F.coalesce("p.property.asking_price", "p.property.current_asking_price")
    woz = F.coalesce("p.property.latest_woz_value", "p.property.woz_value")
    rows = reports.select("source", "run_id", F.explode("properties").alias("p")).select(
        "source",
        "run_id",
        F.col("p.property.listing_id").alias("listing_id"),
        F.col("p.import_status").alias("import_status"),
        F.size("p.missing_fields").alias("missing_count"),
        F.col("p.property.address").alias("address"),
        F.col("p.property.city").alias("city"),
        price.alias("asking_price"),
        woz.alias("woz_value"),
        F.col("p.property.surface_m2").alias("surface_m2"),
    )
    return rows.where(text_or_null("listing_id").isNotNull())


def scan_payload(df: DataFrame) -> DataFrame:
    """Report columns of a property with their stand-ins, dates as text."""

    def have(*names: str) -> Column:
        return F.coalesce(*[F.col(n) for n in names if n in df.columns], F.lit(None))

    return df.withColumns(
        {
            "asking_price_status": F.coalesce(have("asking_price_status"), F.lit("unknown")),
            "construction_year_bag": have("construction_year_bag", "bag_building_year"),
            "usage_purpose": have("usage_purpose", "bag_usage_purpose"),
            "official_floor_area_m2": have("official_floor_area_m2", "bag_official_floor_area_m2"),
            "retrieval_date": have("retrieval_date", "bag_retrieval_date"),
            "source": have("source", "bag_source"),
            "confidence_score": have("confidence_score", "bag_confidence_score"),
            "listing_status": F.coalesce(have("listing_status"), F.lit("unknown")),
            "price_reduction_count": F.coalesce(have("price_reduction_count"), F.lit(0)),
            "listing_history_confidence": F.coalesce(have("listing_history_confidence"), F.lit("unknown")),
            **{n: F.date_format(n, "yyyy-MM-dd") for n, t in df.dtypes if t == "date"},
        }
    )


# --- analysis documents -------------------------------------------------------------------------

TRANSACTION = "struct<transaction_date:string,transaction_type:string,transaction_price:double,price_status:string,buyer_type:string,seller_type:string,source:string,confidence:string>"
PERMIT = "struct<reference_number:string,application_date:string,decision_date:string,permit_type:string,description:string,status:string,affects_investment_case:boolean>"
# What an analysis says about them besides: fields that the typed records below don't declare.
ANALYSED_TRANSACTION = TRANSACTION[:-1] + ",source_url:string,notes:string>"
ANALYSED_PERMIT = PERMIT[:-1] + ",authority:string,source:string,source_url:string,confidence:string,investment_relevance:string,notes:string>"
# Columns of the property table that are taken from an analysis as they are, by type.
PROPERTY_TEXTS = ["source_url", "title", "address", "city", "country", "listing_history_source", "property_type", "current_use", "zoning", "description"]
PROPERTY_NUMBERS = [
    "original_asking_price", "current_asking_price", "total_price_reduction_amount", "total_price_reduction_percentage", "surface_m2",
    "price_per_m2", "annual_rent",
]
PROPERTY_DATES = ["listed_since", "last_price_reduction_date"]
ANALYSIS_LISTS = ["data_quality_warnings", "strengths", "risks", "missing_information", "assumptions", "next_actions"]
_DATA = [
    *PROPERTY_TEXTS, *PROPERTY_NUMBERS, *PROPERTY_DATES, "asking_price", "asking_price_status", "asking_price_text", "days_on_market",
    "listing_status", "price_reduction_count", "listing_history_confidence", "energy_label",
]
# Numbers are read as text, so that one that is none is missing and the fields beside it stay.
ANALYSIS_SCHEMA = (
    "property_summary string, investment_score string, analysis_confidence_score string, "
    "score_breakdown map<string,string>, data_quality_warnings array<string>, strengths array<string>, risks array<string>, "
    "missing_information array<string>, assumptions array<string>, recommendation string, next_actions array<string>, "
    f"extracted_data struct<{','.join(f'{name}:string' for name in _DATA)},"
    f"previous_transactions:array<{ANALYSED_TRANSACTION}>,permits_last_10_years:array<{ANALYSED_PERMIT}>,active_permits:array<{ANALYSED_PERMIT}>>"
)

# Keys an analysis must have, score parts, and code sets.
REQUIRED_KEYS = [
    "analysis_confidence_score", "assumptions", "data_quality_warnings", "extracted_data", "investment_score",
    "missing_information", "next_actions", "property_summary", "recommendation", "risks", "score_breakdown", "strengths",
]
SCORE_PARTS = ["location", "price", "yield", "transformation", "risk", "marketability", "negotiation_position", "permit_risk"]
PRICE_STATUSES = ["known", "on_request", "from_price", "range", "auction", "unknown"]
PERMIT_STATUSES = ["pending", "granted", "rejected", "withdrawn", "revoked", "lapsed", "outside_scope", "unknown"]


def validate_analyses(documents: DataFrame, body: str = "body", source_text: str = "source_text") -> DataFrame:
    """Parsed analyses with ``error`` (NULL when fine) and the price fields repaired from the source text."""
    absent = F.array_except(F.array(*[F.lit(k) for k in REQUIRED_KEYS]), "_keys")
    # A row that is laid out by a generator is parsed once; plain columns would be copied, parse by parse, into every
    # use of a part and into filters on ``error``.
    read = F.struct(F.from_json(body, ANALYSIS_SCHEMA).alias("doc"), F.json_object_keys(body).alias("_keys"))
    parsed = with_inferred_price(documents.select("*", F.inline_outer(F.array(read))), source_text).withColumn("_absent", absent)

    def whole(value: Column) -> Column:
        return F.coalesce(value.rlike(r"^-?\d+$"), F.lit(False))

    bad_part = [F.when(~whole(F.try_element_at("doc.score_breakdown", F.lit(p))), F.lit(p)) for p in SCORE_PARTS]
    first_bad = F.coalesce(*bad_part)
    error = (
        F.when(F.col("_keys").isNull(), "no JSON object")
        .when(F.size("_absent") > 0, F.concat(F.lit("missing fields: "), F.array_join("_absent", ", ")))
        .when(~whole(F.col("doc.investment_score")), "investment_score is not an integer")
        .when(F.col("doc.score_breakdown").isNull(), "score_breakdown is not an object")
        .when(first_bad.isNotNull(), F.concat(F.lit("score_breakdown."), first_bad, F.lit(" is not an integer")))
        .when(~whole(F.col("doc.analysis_confidence_score")), "analysis_confidence_score is not an integer")
        .when(F.col("doc.data_quality_warnings").isNull(), "data_quality_warnings is not a list")
    )
    present = F.json_object_keys(F.get_json_object(body, "$.extracted_data"))
    price_given = F.coalesce(F.array_contains(present, "asking_price"), F.lit(False))
    status_given = F.coalesce(F.array_contains(present, "asking_price_status"), F.lit(False))
    return parsed.withColumns(
        {
            "error": error,
            "asking_price": F.when(price_given, F.col("doc.extracted_data.asking_price").try_cast("double")).otherwise(F.col("asking_price")),
            "asking_price_status": F.when(
                status_given, code_or("doc.extracted_data.asking_price_status", PRICE_STATUSES)
            ).otherwise(F.col("asking_price_status")),
            "asking_price_text": F.coalesce(F.nullif("doc.extracted_data.asking_price_text", F.lit("")), F.col("asking_price_text")),
        }
    ).drop("_keys", "_absent")


def explode_analyses(valid: DataFrame, key: str, distinct_permits: bool = False) -> dict[str, DataFrame]:
    """Property, analysis, transactions, permits and energy labels of parsed analyses (column ``doc``), as they are stored.

    With ``distinct_permits`` a document gives each permit once, see ``_distinct_permits``.
    """
    data = "doc.extracted_data"

    def filled(name: str) -> Column:
        return F.coalesce(F.nullif(F.col(name), F.lit("")), F.lit("unknown"))

    def day(name: str) -> Column:
        return F.try_to_date(name, "yyyy-MM-dd")

    given = F.concat(
        F.transform(F.coalesce(f"{data}.permits_last_10_years", F.array()), lambda p: F.struct(F.lit(False).alias("is_active"), p.alias("p"))),
        F.transform(F.coalesce(f"{data}.active_permits", F.array()), lambda p: F.struct(F.lit(True).alias("is_active"), p.alias("p"))),
    )
    permits = valid.select(key, F.explode(_distinct_permits(given) if distinct_permits else given).alias("x")).select(key, "x.is_active", "x.p.*")
    properties = {
        **{c: F.col(f"{data}.{c}") for c in PROPERTY_TEXTS},
        **{c: to_double(f"{data}.{c}") for c in PROPERTY_NUMBERS},
        **{c: day(f"{data}.{c}") for c in PROPERTY_DATES},
        **{c: F.col(c) for c in ("asking_price", "asking_price_status", "asking_price_text")},
        "days_on_market": to_int(f"{data}.days_on_market"),
        "listing_status": filled(f"{data}.listing_status"),
        "price_reduction_count": F.coalesce(to_int(f"{data}.price_reduction_count"), F.lit(0)),
        "listing_history_confidence": filled(f"{data}.listing_history_confidence"),
    }
    parts = F.struct(*[F.try_element_at("doc.score_breakdown", F.lit(p)).try_cast("int").alias(p) for p in SCORE_PARTS])
    analyses = {
        "property_summary": F.col("doc.property_summary"),
        "investment_score": F.col("doc.investment_score").try_cast("int"),
        "score_breakdown": F.to_json(parts),
        "analysis_confidence_score": F.col("doc.analysis_confidence_score").try_cast("int"),
        **{c: F.to_json(F.coalesce(f"doc.{c}", F.array().cast("array<string>"))) for c in ANALYSIS_LISTS},
        "recommendation": F.col("doc.recommendation"),
    }
    return {
        "properties": valid.select(key, *[c.alias(n) for n, c in properties.items()]),
        "analyses": valid.select(key, *[c.alias(n) for n, c in analyses.items()]),
        "transactions": valid.select(key, F.explode(f"{data}.previous_transactions").alias("t")).select(key, "t.*").withColumns(
            {
                "transaction_date": day("transaction_date"),
                "transaction_type": code_or("transaction_type", TRANSACTION_TYPES),
                "price_status": filled("price_status"),
                "confidence": filled("confidence"),
            }
        ),
        "permits": permits.withColumns(
            {
                "application_date": day("application_date"),
                "decision_date": day("decision_date"),
                "status": code_or("status", PERMIT_STATUSES),
                "confidence": filled("confidence"),
                "affects_investment_case": F.coalesce("affects_investment_case", F.lit(False)),
            }
        ),
        "energy_labels": valid.where(text_or_null(f"{data}.energy_label").isNotNull()).select(
            key,
            strip(f"{data}.energy_label").alias("label"),
            F.col(f"{data}.energy_label").alias("raw_value"),
            F.col(f"{data}.listing_history_source").alias("source"),
            F.lit(True).alias("is_current"),
        ),
    }


def _distinct_permits(given: Column) -> Column:
    """One permit per reference, application date, type and description: the first active one, or else the first."""

    def named(x: Column, i: Column) -> Column:
        same = F.struct(*[x["p"][c].alias(c) for c in ("reference_number", "application_date", "permit_type", "description")])
        return F.struct(same.alias("same"), (~x["is_active"]).alias("past"), i.alias("no"), x["is_active"].alias("is_active"), x["p"].alias("p"))

    # Sorted, a permit is the first of its kind when the one before is another.
    return let(
        F.sort_array(F.transform(given, named)),
        lambda s: F.filter(s, lambda x, i: (i == 0) | ~x["same"].eqNullSafe(F.get(s, i - 1)["same"])),
    )


def current_labels(stored: DataFrame, arriving: DataFrame, key: str) -> DataFrame:
    """Energy labels stored before and those that arrive; an arriving label retires the ones of its property.

    One label of a property is current at most. Documents carry no time: of several labels that arrive at once for a
    property, the last by label, text and source is current.
    """
    both = stored.withColumn("_arrived", F.lit(0)).unionByName(arriving.withColumn("_arrived", F.lit(1)))
    numbered = with_previous(both, key, "_arrived", ["_arrived", "is_current", "label", "raw_value", "source"])
    last = F.col("row_no") == F.col("row_count")
    return numbered.withColumn("is_current", F.col("is_current") & last).drop("_arrived", "row_no", "row_count")


def analysis_view(properties: DataFrame, analyses: DataFrame, key: str) -> DataFrame:
    """Property and analysis as one nested document with defaults."""
    joined = properties.join(analyses, key, "left")
    empty = F.array().cast("array<string>")
    return joined.select(
        key,
        F.struct(
            "property_summary",
            F.struct(
                "source_url", "title", "address", "city", "asking_price",
                F.coalesce("asking_price_status", F.lit("unknown")).alias("asking_price_status"),
                F.coalesce("listing_status", F.lit("unknown")).alias("listing_status"),
                F.coalesce("price_reduction_count", F.lit(0)).alias("price_reduction_count"),
            ).alias("extracted_data"),
            F.coalesce("investment_score", F.lit(0)).alias("investment_score"),
            F.coalesce("strengths", empty).alias("strengths"),
            F.coalesce("risks", empty).alias("risks"),
            "recommendation",
        ).alias("document"),
    )


# --- typed records ------------------------------------------------------------------------------

# Record kinds with their declared columns; dates come as text and are checked.
RECORD_SCHEMAS = {
    "transaction": TRANSACTION,
    "permit": PERMIT,
    "comparable": "struct<address:string,distance_meters:double,living_area_m2:double,asking_price:double,sold_price:double,sold_date:string,price_per_m2:double>",
    "history": "struct<event_date:string,status:string,price:double,source:string>",
}


def typed_records(documents: DataFrame, kind: str, body: str = "body") -> DataFrame:
    """JSON records in their declared columns; bad dates are NULL, non-objects become empty records."""
    parsed = documents.withColumn("record", F.from_json(body, RECORD_SCHEMAS[kind]))
    fields = parsed.schema["record"].dataType.names
    dates = [f for f in fields if f.endswith("_date")]
    columns = [(F.try_to_date(F.substring(f"record.{f}", 1, 10), "yyyy-MM-dd") if f in dates else F.col(f"record.{f}")).alias(f) for f in fields]
    return parsed.select(*[c for c in documents.columns if c != body], *columns)


def to_documents(records: DataFrame, keys: list[str]) -> DataFrame:
    """Typed records back to JSON, dates in ISO form."""
    fields = [c for c in records.columns if c not in keys]
    return records.select(*keys, F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("body"))
