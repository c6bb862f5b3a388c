"""Queries that read and write files and documents made from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from woonvonk.operators import history
from woonvonk.plans.registry import query
from woonvonk.plans.report_queries import MATCH_SQL, _existing, _incoming
from woonvonk.plans.views import read, view, with_views
from woonvonk.session import scratch_path
from woonvonk.sources import documents, ingest, pages, pipeline, tables

# A listing file with gaps: every ninth row lacks its source, every eleventh its URL.
FILE_ROWS = """
  SELECT listing_id AS record_no, CASE WHEN listing_id % 9 = 0 THEN '' ELSE concat(' portal', cast(source_id as varchar(20)), ' ') END AS source_name,
    external_listing_id, CASE WHEN listing_id % 11 = 0 THEN NULL ELSE source_url END AS source_url, title, address, city,
    CASE WHEN listing_id % 7 = 0 THEN 'op aanvraag' ELSE cast(cast(asking_price as decimal(12, 2)) as varchar(20)) END AS asking_price,
    cast(cast(surface_m2 as int) as varchar(20)) AS surface_m2, property_type
  FROM listings"""

WARNING_SQL = """CASE WHEN listing_id % 9 = 0 AND listing_id % 11 = 0 THEN concat('{label} ', cast(listing_id as varchar), ': missing required fields: source_name, source_url')
  WHEN listing_id % 9 = 0 THEN concat('{label} ', cast(listing_id as varchar), ': missing required fields: source_name')
  WHEN listing_id % 11 = 0 THEN concat('{label} ', cast(listing_id as varchar), ': missing required fields: source_url') END AS warning"""


def _file_rows(spark, sf_dir):
    body = FILE_ROWS.replace("varchar(20)", "string").replace("FROM listings", "FROM {listings}")
    return spark.sql(body, listings=view(spark, sf_dir, "listings"))


def _ingest_sql(label: str, status: str = "'active'") -> str:
    return with_views(
        "listings",
        f"""SELECT listing_id AS record_no, {WARNING_SQL.format(label=label)}, CASE WHEN listing_id % 9 = 0 THEN 'manual_import' ELSE concat('portal', cast(source_id as varchar)) END AS source_name,
        CASE WHEN listing_id % 11 = 0 THEN NULL ELSE source_url END AS source_url, address, city, CASE WHEN listing_id % 7 = 0 THEN NULL ELSE cast(cast(asking_price as decimal(12, 2)) as double) END AS asking_price, surface_m2, {status} AS listing_status FROM listings""",
    )


INGEST_COLUMNS = ["record_no", "warning", "source_name", "source_url", "address", "city", "asking_price", "surface_m2", "listing_status"]


@query("ingest_csv", _ingest_sql("Row"))
def ingest_csv(spark, sf_dir):
    path = scratch_path(spark, "listings-csv")
    _file_rows(spark, sf_dir).write.csv(path, header=True)
    return ingest.read_csv(spark, path).select(*INGEST_COLUMNS).withColumn("record_no", F.col("record_no").cast("bigint"))


@query("ingest_json", _ingest_sql("Item"))
def ingest_json(spark, sf_dir):
    path = scratch_path(spark, "listings-json")
    _file_rows(spark, sf_dir).write.json(path)
    return ingest.read_json(spark, path).select(*INGEST_COLUMNS)


@query(
    "ingest_urls",
    """SELECT page_id AS record_no, 'manual_url' AS source_name, CASE page_id % 5 WHEN 0 THEN replace(url, 'http', 'ftp') WHEN 1 THEN 'geen url' ELSE url END AS source_url,
    CASE page_id % 5 WHEN 0 THEN concat('Line ', cast(page_id as varchar), ': invalid URL ''', replace(url, 'http', 'ftp'), '''.') WHEN 1 THEN concat('Line ', cast(page_id as varchar), ': invalid URL ''geen url''.') END AS warning
    FROM pages WHERE page_id % 5 <> 4""",
)
def ingest_urls(spark, sf_dir):
    pages = read(spark, sf_dir, "pages")
    case = F.col("page_id") % 5
    value = (
        F.when(case == 0, F.replace("url", F.lit("http"), F.lit("ftp"))).when(case == 1, " geen url ").when(case == 4, "  ").otherwise(F.col("url"))
    )
    return ingest.read_urls(pages.select(F.col("page_id").alias("line_no"), value.alias("value")))


# Feed documents: one per source and hundred listings, wrapped in different ways.
FEED_ITEM = """to_json(named_struct('id', external_listing_id, 'link', source_url, 'price', asking_price, 'vraagprijs', 1, 'naam', title, 'town', city, 'description', CAST(NULL AS string)), map('ignoreNullFields', 'false'))"""


def _feed(spark, sf_dir):
    items = view(spark, sf_dir, "listings").selectExpr("listing_id", "source_id", "listing_id div 2500 AS part", f"{FEED_ITEM} AS item")
    # A document holds the items of one source out of at most 2500 listings in a row.
    grouped = items.groupBy("source_id", "part").agg(F.array_join(F.array_sort(F.collect_list("item")), ",").alias("body"))
    names = ["items", "results", "listings", "data"]
    wrapped = F.lit(None).cast("string")
    for i, n in enumerate(names):
        wrapped = F.when(F.col("source_id") % 5 == i, F.concat(F.lit(f'{{"{n}": ['), "body", F.lit("]}"))).otherwise(wrapped)
    body = F.when(F.col("source_id") % 5 == 4, F.concat(F.lit("["), "body", F.lit("]"))).otherwise(wrapped)
    return grouped.select("source_id", "part", body.alias("body"))


@query("ingest_feed", with_views("listings", "SELECT source_id, count(*) AS item_count, count(asking_price) AS priced_count FROM listings GROUP BY source_id"))
def ingest_feed(spark, sf_dir):
    items = ingest.feed_items(_feed(spark, sf_dir))
    return items.groupBy("source_id").agg(
        F.count(F.lit(1)).alias("item_count"), F.count(F.try_element_at("item", F.lit("price"))).alias("priced_count")
    )


@query(
    "feed_field_mapping",
    with_views(
        "listings",
        "SELECT external_listing_id, source_url, title, city, asking_price, CAST(NULL AS varchar) AS description FROM listings",
    ),
)
def feed_field_mapping(spark, sf_dir):
    mapped = ingest.map_feed_items(ingest.feed_items(_feed(spark, sf_dir)), {"title": ["kop", "naam"]})
    return mapped.select(
        "external_listing_id", "source_url", "title", "city", F.col("asking_price").cast("double").alias("asking_price"), "description"
    )


@query(
    "normalize_records",
    with_views(
        "listings",
        """SELECT listing_id AS record_no, listing_id % 11 <> 0 AS success, CASE WHEN listing_id % 11 = 0 THEN 'ValueError: Missing required source_url' END AS error,
        CASE WHEN listing_id % 11 <> 0 THEN external_listing_id END AS external_listing_id, CASE WHEN listing_id % 11 <> 0 THEN CASE WHEN listing_id % 9 = 0 THEN 'feed' ELSE concat('portal', cast(source_id as varchar)) END END AS source_name,
        CASE WHEN listing_id % 11 <> 0 AND listing_id % 7 <> 0 THEN cast(cast(asking_price as decimal(12, 2)) as double) END AS asking_price, CASE WHEN listing_id % 11 <> 0 THEN 'active' END AS listing_status FROM listings""",
    ),
)
def normalize_records(spark, sf_dir):
    records = ingest.normalize_records(_file_rows(spark, sf_dir).withColumnRenamed("source_url", "link"), "feed")
    return records.select(
        "record_no", "success", "error", "listing.external_listing_id", "listing.source_name", "listing.asking_price", "listing.listing_status"
    )


@query(
    "listing_to_property",
    with_views(
        "listings",
        """SELECT listing_id, CASE WHEN asking_price IS NULL THEN 'unknown' ELSE 'known' END AS asking_price_status, CASE WHEN listing_id % 4 = 0 THEN NULL ELSE bedrooms END AS bedrooms, plot_size_m2, energy_label,
        price_reduction_count, 'unknown' AS listing_history_confidence, CASE WHEN listing_id % 2 = 0 THEN 2 ELSE 0 END AS photo_count, description AS raw_text FROM listings""",
    ),
)
def listing_to_property(spark, sf_dir):
    payload = F.to_json(
        F.struct(
            F.when(F.col("listing_id") % 4 == 0, F.lit("veel")).otherwise(F.col("bedrooms").cast("string")).alias("bedrooms"),
            "plot_size_m2",
            "energy_label",
            "price_reduction_count",
            F.when(F.col("listing_id") % 2 == 0, F.array(F.lit("a.jpg"), F.lit(" "), F.lit(" b.jpg"))).alias("image_urls"),
        )
    )
    rows = view(spark, sf_dir, "listings").select("listing_id", "asking_price", "description", payload.alias("raw_payload"))
    return ingest.to_property(rows).select(
        "listing_id", "asking_price_status", "bedrooms", "plot_size_m2", "energy_label", "price_reduction_count", "listing_history_confidence",
        F.size("photos").alias("photo_count"), "raw_text",
    )


# --- scan reports -------------------------------------------------------------------------------


def _reports(spark, sf_dir):
    """A scan report per source with the listings of that source, in parts of at most 2500 listings."""
    item = F.struct(
        F.col("listing_id").alias("record_index"),
        F.when(F.col("surface_m2").isNull(), "partially_imported").otherwise("fully_imported").alias("import_status"),
        F.array_compact(F.array(F.when(F.col("surface_m2").isNull(), "surface_m2"), F.when(F.col("bedrooms").isNull(), "bedrooms"))).alias("missing_fields"),
        F.struct(
            F.when(F.col("listing_id") % 21 != 0, F.col("listing_id").cast("string")).alias("listing_id"),
            "address", "city", F.when(F.col("listing_id") % 2 == 0, F.col("asking_price")).alias("asking_price"),
            F.col("asking_price").alias("current_asking_price"), "surface_m2", "energy_label", "latest_woz_value",
        ).alias("property"),
    )
    listings = view(spark, sf_dir, "listings").withColumn("part", F.expr("listing_id div 2500"))
    grouped = listings.groupBy("source_id", "part").agg(
        F.count(F.lit(1)).alias("found"), F.count("surface_m2").alias("full"), F.array_sort(F.collect_list(item)).alias("properties")
    )
    return grouped.select(
        F.concat(F.lit("portal"), F.col("source_id").cast("string")).alias("source"),
        F.concat_ws("-", "source_id", "part").alias("run_id"),
        F.lit("completed").alias("status"),
        F.struct(
            F.col("found").alias("listings_found"), F.col("found").alias("listings_imported"), F.col("full").alias("fully_imported"),
            (F.col("found") - F.col("full")).alias("partially_imported"), F.lit(0).cast("bigint").alias("listings_failed"),
        ).alias("summary"),
        "properties",
    )


RUN_SQL = """WITH r AS (SELECT concat('portal', cast(source_id as varchar)) AS source, concat(cast(source_id as varchar), '-', cast(listing_id // 2500 as varchar)) AS run_id, count(*) AS listings_found, count(surface_m2) AS fully_imported
  FROM listings GROUP BY source_id, listing_id // 2500)"""


@query("write_scan_report", with_views("listings", f"{RUN_SQL} SELECT source, run_id, 'completed' AS status, listings_found, fully_imported FROM r"))
def write_scan_report(spark, sf_dir):
    path = scratch_path(spark, "scan-runs")
    documents.write_scan_reports(_reports(spark, sf_dir), path)
    runs = documents.read_scan_runs(spark, path)
    return runs.select("source", "run_id", "status", "summary.listings_found", "summary.fully_imported")


@query(
    "read_scan_runs",
    with_views(
        "listings",
        """SELECT concat('portal', cast(source_id as varchar)) AS source, cast(listing_id as varchar) AS listing_id, CASE WHEN surface_m2 IS NULL THEN 'partially_imported' ELSE 'fully_imported' END AS import_status,
        CASE WHEN surface_m2 IS NULL THEN 1 ELSE 0 END + CASE WHEN bedrooms IS NULL THEN 1 ELSE 0 END AS missing_count, asking_price, latest_woz_value AS woz_value FROM listings WHERE listing_id % 21 <> 0""",
    ),
)
def read_scan_runs(spark, sf_dir):
    path = scratch_path(spark, "scan-runs")
    documents.write_scan_reports(_reports(spark, sf_dir), path)
    rows = documents.report_properties(documents.read_scan_runs(spark, path))
    return rows.select("source", "listing_id", "import_status", "missing_count", "asking_price", "woz_value")


@query(
    "scan_payload_projection",
    with_views(
        "listings",
        """SELECT listing_id, CASE WHEN listing_id % 3 = 0 THEN 1900 ELSE construction_year END AS construction_year_bag, 'unknown' AS listing_status, price_reduction_count, 'unknown' AS listing_history_confidence,
        cast(date '2001-01-01' + cast(listing_id % 300 as int) as varchar) AS listed_since FROM listings""",
    ),
)
def scan_payload_projection(spark, sf_dir):
    rows = view(spark, sf_dir, "listings").withColumns(
        {
            "construction_year_bag": F.when(F.col("listing_id") % 3 == 0, 1900),
            "bag_building_year": F.col("construction_year"),
            "listed_since": F.date_add(F.lit("2001-01-01").cast("date"), (F.col("listing_id") % 300).cast("int")),
        }
    )
    return documents.scan_payload(rows).select(
        "listing_id", "construction_year_bag", "listing_status", "price_reduction_count", "listing_history_confidence", "listed_since"
    )


@query(
    "append_snapshots",
    with_views("snapshots", "SELECT strftime(observed_at, '%Y-%m') AS observed_month, count(*) AS snapshot_count, sum(asking_price) AS price_sum FROM snapshots GROUP BY 1"),
)
def append_snapshots(spark, sf_dir):
    path = scratch_path(spark, "snapshots")
    rows = view(spark, sf_dir, "snapshots")
    tables.append_snapshots(rows.where("snapshot_seq % 2 = 0"), path)
    tables.append_snapshots(rows.where("snapshot_seq % 2 = 1"), path)
    return spark.read.parquet(path).groupBy(F.date_format("observed_at", "yyyy-MM").alias("observed_month")).agg(
        F.count(F.lit(1)).alias("snapshot_count"), F.sum("asking_price").alias("price_sum")
    )


@query(
    "scan_run_log",
    with_views(
        "runs",
        """SELECT run_id, CASE WHEN items_found % 4 = 0 THEN 'running' WHEN items_found % 4 = 1 THEN 'failed' ELSE 'completed' END AS status,
        CASE WHEN items_found % 4 = 0 THEN NULL ELSE greatest(0, items_new - 15) END AS items_new, CASE WHEN items_found % 4 = 1 THEN 'timeout' END AS error_message FROM runs""",
    ),
)
def scan_run_log(spark, sf_dir):
    runs = view(spark, sf_dir, "runs")
    opened = runs.select("run_id", "source_id", "started_at", F.lit("running").alias("status"), F.lit(None).cast("timestamp_ntz").alias("completed_at"))
    failed = F.col("items_found") % 4 == 1
    ended = runs.where("items_found % 4 <> 0").select(
        "run_id", F.when(failed, "failed").otherwise("completed").alias("status"), "completed_at",
        "items_found", (F.col("items_new") - 15).alias("items_new"), "items_changed", F.when(failed, "timeout").alias("error_message"),
    )
    return tables.close_runs(opened, ended).select("run_id", "status", "items_new", "error_message")


@query(
    "mark_candidate_reviewed",
    with_views("candidates", "SELECT candidate_id, CASE candidate_id % 3 WHEN 0 THEN 'rejected' WHEN 1 THEN 'reviewed' ELSE 'new' END AS review_status FROM candidates"),
)
def mark_candidate_reviewed(spark, sf_dir):
    rows = view(spark, sf_dir, "candidates")
    first = rows.where("candidate_id % 3 < 2").select("candidate_id", F.lit("reviewed").alias("review_status"), F.lit(1).alias("reviewed_at"))
    second = rows.where("candidate_id % 3 = 0").select("candidate_id", F.lit("rejected").alias("review_status"), F.lit(2).alias("reviewed_at"))
    stored = rows.withColumn("review_status", F.lit("new"))
    return tables.mark_reviewed(stored, first.unionByName(second)).select("candidate_id", "review_status")


# --- manual ingest chain ------------------------------------------------------------------------


@query(
    "manual_ingest",
    with_views(
        "listings",
        f"""WITH {MATCH_SQL}, fresh AS (SELECT coalesce(cast(matched_listing_id as varchar), sha256(regexp_replace(lower(trim(source_url)), '/+$', ''))) AS listing_key, matched_listing_id, record_id, asking_price, surface_m2 FROM matched
          QUALIFY row_number() OVER (PARTITION BY coalesce(matched_listing_id, 1000000000 + record_id) ORDER BY record_id DESC) = 1)
        SELECT f.record_id, f.listing_key, CASE WHEN matched_listing_id IS NULL THEN 'new_listing' WHEN l.asking_price IS DISTINCT FROM f.asking_price THEN 'asking_price_change' ELSE 'content_change' END AS change_type
          FROM fresh f LEFT JOIN listings l ON l.listing_id = f.matched_listing_id
          WHERE matched_listing_id IS NULL OR l.asking_price IS DISTINCT FROM f.asking_price OR l.surface_m2 IS DISTINCT FROM f.surface_m2""",
    ),
)
def manual_ingest(spark, sf_dir):
    records = _incoming(spark, sf_dir).withColumn("listing_status", F.lit("active"))
    stored = _existing(spark, sf_dir).withColumn("listing_status", F.lit("active"))
    # The stored state is also the newest snapshot.
    snapshots = stored.select(
        "listing_id", F.lit(1).alias("observed_at"), F.lit(1).alias("snapshot_seq"), "asking_price", "listing_status", "surface_m2"
    )
    shared = [c for c in stored.columns if c in records.columns]
    batch = pipeline.ingest_batch(records, stored.select("listing_id", *shared), snapshots)
    return batch["changes"].select("record_id", "listing_key", "change_type")


@query(
    "manual_ingest_listings",
    with_views(
        "listings",
        f"""WITH {MATCH_SQL} SELECT (SELECT count(*) FROM listings) + (SELECT count(*) FROM matched WHERE matched_listing_id IS NULL) AS listing_count,
        (SELECT count(*) FROM matched WHERE matched_listing_id IS NULL) AS new_count""",
    ),
)
def manual_ingest_listings(spark, sf_dir):
    records = _incoming(spark, sf_dir)
    stored = _existing(spark, sf_dir)
    shared = [c for c in stored.columns if c in records.columns]
    status = F.lit("active")
    snapshots = stored.select(
        "listing_id", F.lit(1).alias("observed_at"), F.lit(1).alias("snapshot_seq"), "asking_price", status.alias("listing_status"), "surface_m2"
    )
    batch = pipeline.ingest_batch(
        records.withColumn("listing_status", status), stored.select("listing_id", *shared).withColumn("listing_status", status), snapshots
    )
    return batch["listings"].agg(
        F.count(F.lit(1)).alias("listing_count"), F.count_if(F.length("listing_key") == 64).alias("new_count")
    )


@query(
    "refresh_listing_metadata",
    with_views(
        "listings portal_pages",
        """SELECT l.listing_id, CASE WHEN p.kind = 0 THEN cast(p.price as double) WHEN p.kind = 3 THEN cast(replace(p.price_nl, '.', '') as double) ELSE l.asking_price END AS asking_price, coalesce(l.city, CASE WHEN p.kind = 2 THEN l.title ELSE 'Onbekend' END) AS city_if_data
        FROM listings l LEFT JOIN portal_pages p ON p.page_id = l.listing_id""",
    ),
)
def refresh_listing_metadata(spark, sf_dir):
    records = pages.merge_extractions(view(spark, sf_dir, "portal_pages").select("page_id", "url", "html"))
    found = records.select(F.col("page_id").alias("listing_id"), "title", "address", "city", "property_type", "asking_price", "surface_m2")
    stored = view(spark, sf_dir, "listings")
    # "Onbekend" on a page counts as missing, so a listing without a city stays without one.
    merged = pipeline.refresh_metadata(stored, found, "portal")
    return merged.select("listing_id", "asking_price", F.coalesce("city", F.lit("Onbekend")).alias("city_if_data"))


@query(
    "upsert_previous_snapshot",
    with_views(
        "listings snapshots",
        """WITH latest AS (SELECT * FROM snapshots QUALIFY row_number() OVER (PARTITION BY listing_id ORDER BY observed_at DESC, snapshot_seq DESC) = 1)
        SELECT l.listing_id, s.snapshot_seq AS previous_seq, CASE WHEN s.listing_id IS NULL THEN 'new_listing' WHEN s.listing_status <> 'active' THEN 'relisting_signal' WHEN s.asking_price IS DISTINCT FROM l.asking_price THEN 'asking_price_change' ELSE 'content_change' END AS change_type
        FROM listings l LEFT JOIN latest s ON s.listing_id = l.listing_id""",
    ),
)
def upsert_previous_snapshot(spark, sf_dir):
    from woonvonk.operators.skew import first_per_key

    latest = first_per_key(view(spark, sf_dir, "snapshots"), ["listing_id"], [F.col("observed_at").desc(), F.col("snapshot_seq").desc()])
    stored = latest.select("listing_id", "snapshot_seq", F.struct("asking_price", "listing_status").alias("_old"))
    arriving = view(spark, sf_dir, "listings").withColumn("listing_status", F.lit("active")).join(stored, "listing_id", "left")
    kind = history.change_type(F.col("_old").isNull(), F.col("_old"), "asking_price", "listing_status", None)
    return arriving.select("listing_id", F.col("snapshot_seq").alias("previous_seq"), kind.alias("change_type"))


# --- analysis documents -------------------------------------------------------------------------


def _analysis_documents(spark, sf_dir):
    """An analysis document per listing, every tenth one broken in one of several ways."""
    n = F.col("listing_id")
    transaction = F.struct(
        F.lit("2000-05-01").alias("transaction_date"),
        F.when(n % 2 == 0, "sale").otherwise("gift").alias("transaction_type"),
        F.col("latest_woz_value").alias("transaction_price"),
    )
    permit = F.struct(
        F.concat(F.lit("REF-"), (n % 50).cast("string")).alias("reference_number"),
        F.when(n % 3 == 0, "geen datum").otherwise("1999-03-02").alias("application_date"),
        F.when(n % 4 == 0, "granted").otherwise("in behandeling").alias("status"),
    )
    data = F.struct(
        "source_url", "title", "address", "city", "energy_label",
        F.when(n % 5 == 0, F.lit("unknown")).otherwise(F.col("asking_price").cast("string")).alias("asking_price"),
        F.when(n % 7 == 0, "raar").otherwise("known").alias("asking_price_status"),
        F.array(transaction).alias("previous_transactions"),
        F.when(n % 2 == 0, F.array(permit)).alias("permits_last_10_years"),
        F.when(n % 3 == 0, F.array(permit)).alias("active_permits"),
    )
    scores = F.to_json(F.create_map(*[x for p in documents.SCORE_PARTS for x in (F.lit(p), F.when((n % 40 == 10) & F.lit(p == "risk"), F.lit("hoog")).otherwise((n % 10).cast("string")))]))
    # JSON numbers rather than strings.
    scores = F.regexp_replace(scores, r'"(\d+)"', "$1")
    empty = '"data_quality_warnings": [], "strengths": [], "risks": [], "missing_information": [], "assumptions": [], "next_actions": [], "recommendation": "koop", '
    body = F.concat(
        F.lit('{"property_summary": null, '),
        F.when(n % 40 == 20, F.regexp_replace(F.lit(empty), '"strengths": \\[\\], "risks": \\[\\], ', "")).otherwise(F.lit(empty)),
        F.lit('"investment_score": '), F.when(n % 40 == 30, F.lit('"hoog"')).otherwise((n % 101).cast("string")),
        F.lit(', "analysis_confidence_score": 60, "score_breakdown": '), scores,
        F.lit(', "extracted_data": '), F.to_json(data), F.lit("}"),
    )
    broken = F.when(n % 40 == 0, F.lit("geen json")).otherwise(body)
    prices = view(spark, sf_dir, "raw_fields").select(F.col("row_id").alias("listing_id"), F.col("price_text").alias("source_text"))
    # Shuffled by hint: a few megabytes of file are millions of rows, which the driver can't hold to send them to every
    # task. Bodies are made after the join, so that they aren't shuffled.
    priced = view(spark, sf_dir, "listings").join(prices.hint("merge"), "listing_id")
    return priced.select("listing_id", broken.alias("body"), "source_text")


ERROR_SQL = """CASE listing_id % 40 WHEN 0 THEN 'no JSON object' WHEN 20 THEN 'missing fields: risks, strengths' WHEN 30 THEN 'investment_score is not an integer' WHEN 10 THEN 'score_breakdown.risk is not an integer' END"""


@query(
    "analysis_validation",
    with_views(
        "listings",
        f"""SELECT listing_id, {ERROR_SQL} AS error, CASE WHEN listing_id % 40 <> 0 AND listing_id % 5 <> 0 THEN asking_price END AS given_price, CASE WHEN listing_id % 40 <> 0 THEN CASE WHEN listing_id % 7 = 0 THEN 'unknown' ELSE 'known' END END AS given_status
        FROM listings""",
    ),
)
def analysis_validation(spark, sf_dir):
    checked = documents.validate_analyses(_analysis_documents(spark, sf_dir))
    parsed = F.col("listing_id") % 40 != 0
    given = F.col("doc.extracted_data.asking_price").isNotNull()
    return checked.select(
        "listing_id", "error", F.when(parsed & given, F.col("asking_price")).alias("given_price"), F.when(parsed, F.col("asking_price_status")).alias("given_status")
    )


def _valid(spark, sf_dir):
    return documents.validate_analyses(_analysis_documents(spark, sf_dir)).where("error is null")


VALID_SQL = f"good AS (SELECT * FROM listings WHERE {ERROR_SQL} IS NULL)"


# Columns of the five tables, each once: those of the same name hold the same kind of value.
_BY_TYPE = {
    "varchar": "source_url title address city country listing_history_source property_type current_use zoning description asking_price_status asking_price_text listing_status "
    "listing_history_confidence property_summary score_breakdown data_quality_warnings strengths risks missing_information assumptions next_actions recommendation transaction_type "
    "price_status buyer_type seller_type source confidence notes reference_number permit_type status authority investment_relevance label raw_value",
    "double": "original_asking_price current_asking_price total_price_reduction_amount total_price_reduction_percentage surface_m2 price_per_m2 annual_rent asking_price transaction_price",
    "date": "listed_since last_price_reduction_date transaction_date application_date decision_date",
    "int": "days_on_market price_reduction_count investment_score analysis_confidence_score",
    "boolean": "is_active affects_investment_case is_current",
}
TABLE_COLUMNS = {c: kind for kind, names in _BY_TYPE.items() for c in names.split()}


def _table_rows_sql(name: str, body: str, row_count: str = "cast(NULL as bigint)", listing_id: str = "listing_id", **values: str) -> str:
    """Rows of a table in the columns of all five; a value is given by its SQL."""
    columns = {c: values.get(c, f"cast(NULL as {kind})") for c, kind in TABLE_COLUMNS.items()}
    return f"SELECT '{name}' AS table_name, {row_count} AS row_count, {listing_id} AS listing_id, {', '.join(f'{v} AS {c}' for c, v in columns.items())} FROM {body}"


UNKNOWN = "'unknown'"
EMPTY = "'[]'"
GIVEN_PERMIT = {
    "reference_number": "concat('REF-', cast(listing_id % 50 as varchar))", "application_date": "CASE WHEN listing_id % 3 <> 0 THEN DATE '1999-03-02' END",
    "status": "CASE WHEN listing_id % 4 = 0 THEN 'granted' ELSE 'unknown' END", "confidence": UNKNOWN, "affects_investment_case": "false",
}
# A permit that is listed both among those of ten years and as active is stored as active.
TABLES_SQL = {
    "properties": _table_rows_sql(
        "properties", "good", **{c: c for c in ("source_url", "title", "city")}, address="CASE WHEN title IS NOT NULL THEN address END",
        asking_price="CASE WHEN listing_id % 5 = 0 THEN NULL WHEN asking_price IS NOT NULL THEN asking_price WHEN listing_id % 10 = 1 THEN cast(200500 + listing_id % 700 * 1000 as double) END",
        asking_price_status="CASE WHEN listing_id % 7 = 0 THEN 'unknown' ELSE 'known' END", asking_price_text="CASE WHEN listing_id % 10 IN (0, 1, 2, 4, 5, 8) THEN price_text END",
        listing_status=UNKNOWN, price_reduction_count="cast(0 as int)", listing_history_confidence=UNKNOWN,
    ),
    "analyses": _table_rows_sql(
        "analyses", "good", investment_score="cast(listing_id % 101 as int)", analysis_confidence_score="cast(60 as int)", recommendation="'koop'", **{c: EMPTY for c in documents.ANALYSIS_LISTS},
        score_breakdown="concat('{', " + ", ',', ".join(f"'\"{p}\":', cast(listing_id % 10 as varchar)" for p in documents.SCORE_PARTS) + ", '}')",
    ),
    "transactions": _table_rows_sql(
        "transactions", "good", transaction_date="DATE '2000-05-01'", transaction_type="CASE WHEN listing_id % 2 = 0 THEN 'sale' ELSE 'unknown' END", transaction_price="latest_woz_value",
        price_status=UNKNOWN, confidence=UNKNOWN,
    ),
    "permits": _table_rows_sql("permits", "good WHERE listing_id % 2 = 0 OR listing_id % 3 = 0", is_active="listing_id % 3 = 0", **GIVEN_PERMIT),
    "energy_labels": _table_rows_sql(
        "energy_labels",
        """(SELECT *, row_number() OVER (PARTITION BY listing_id ORDER BY arrived DESC, label DESC) = 1 AS is_last FROM (
          SELECT listing_id, 0 AS arrived, 'G' AS label, 'register' AS source FROM listings WHERE listing_id % 3 = 0 UNION ALL SELECT listing_id, 1, energy_label, NULL FROM good WHERE energy_label IS NOT NULL) x) y""",
        label="label", raw_value="label", source="source", is_current="is_last",
    ),
}


def _stored_labels(spark, sf_dir):
    """Labels stored before the analyses: every third listing has one."""
    listings = view(spark, sf_dir, "listings").where("listing_id % 3 = 0")
    return listings.select("listing_id", F.lit("G").alias("label"), F.lit("G").alias("raw_value"), F.lit("register").alias("source"), F.lit(True).alias("is_current"))


@query(
    "explode_analysis",
    with_views(
        "listings raw_fields",
        f"""WITH good AS (SELECT l.*, r.price_text FROM listings l JOIN raw_fields r ON r.row_id = l.listing_id WHERE {ERROR_SQL} IS NULL),
        {", ".join(f"t_{n} AS ({body})" for n, body in TABLES_SQL.items())}
        {" UNION ALL ".join(f"SELECT * FROM t_{n} UNION ALL {_table_rows_sql(n, f't_{n}', 'count(*)', 'cast(NULL as bigint)')}" for n in TABLES_SQL)}""",
    ),
)
def explode_analysis(spark, sf_dir):
    """All rows of the five tables, and a row with the number of rows for each table."""
    from functools import partial, reduce

    from pyspark.sql import DataFrame

    from woonvonk.operators.benchmarks import table_counts
    from woonvonk.session import scratch_path

    # parsed once for all five tables, each of which reads the parts it needs
    path = scratch_path(spark, "analyses")
    _valid(spark, sf_dir).select("listing_id", "doc", "asking_price", "asking_price_status", "asking_price_text").write.parquet(path)
    stored = documents.explode_analyses(spark.read.parquet(path), "listing_id", distinct_permits=True)
    stored["energy_labels"] = documents.current_labels(_stored_labels(spark, sf_dir), stored["energy_labels"], "listing_id")
    rows = [t.withColumn("table_name", F.lit(n)) for n, t in stored.items()]
    united = reduce(partial(DataFrame.unionByName, allowMissingColumns=True), rows, table_counts(stored))
    return united.select("table_name", "row_count", "listing_id", *TABLE_COLUMNS)


@query(
    "explode_analysis_permits",
    with_views(
        "listings",
        f"""WITH {VALID_SQL}, p AS (SELECT listing_id, false AS is_active FROM good WHERE listing_id % 2 = 0 UNION ALL SELECT listing_id, true FROM good WHERE listing_id % 3 = 0)
        SELECT listing_id, is_active, concat('REF-', cast(listing_id % 50 as varchar)) AS reference_number, CASE WHEN listing_id % 3 = 0 THEN NULL ELSE '1999-03-02' END AS application_date, CASE WHEN listing_id % 4 = 0 THEN 'granted' ELSE 'unknown' END AS status FROM p""",
    ),
)
def explode_analysis_permits(spark, sf_dir):
    permits = documents.explode_analyses(_valid(spark, sf_dir), "listing_id")["permits"]
    return permits.select("listing_id", "is_active", "reference_number", F.col("application_date").cast("string").alias("application_date"), "status")


@query(
    "analysis_view",
    with_views(
        "listings candidates",
        """WITH a AS (SELECT * FROM candidates QUALIFY row_number() OVER (PARTITION BY listing_id ORDER BY candidate_id DESC) = 1)
        SELECT l.listing_id, l.asking_price_status, coalesce(a.investment_score, 0) AS investment_score, 0 AS strength_count, 'unknown' AS listing_status FROM listings l LEFT JOIN a ON a.listing_id = l.listing_id""",
    ),
)
def analysis_view(spark, sf_dir):
    from woonvonk.operators.skew import first_per_key

    latest = first_per_key(view(spark, sf_dir, "candidates"), ["listing_id"], [F.col("candidate_id").desc()])
    none = F.lit(None).cast("string")
    analyses = latest.select(
        "listing_id", "investment_score", none.alias("property_summary"), none.alias("recommendation"),
        F.lit(None).cast("array<string>").alias("strengths"), F.lit(None).cast("array<string>").alias("risks"),
    )
    built = documents.analysis_view(view(spark, sf_dir, "listings").withColumn("listing_status", none), analyses, "listing_id")
    return built.select(
        "listing_id",
        "document.extracted_data.asking_price_status",
        "document.investment_score",
        F.size("document.strengths").alias("strength_count"),
        "document.extracted_data.listing_status",
    )


@query(
    "typed_records",
    with_views(
        "sales",
        """SELECT sale_id, CASE WHEN sale_id % 5 = 0 THEN NULL WHEN sale_id % 7 = 0 THEN NULL ELSE cast(sale_date as varchar) END AS transaction_date, CASE WHEN sale_id % 7 = 0 THEN NULL ELSE transaction_type END AS transaction_type,
        CASE WHEN sale_id % 7 = 0 THEN NULL ELSE price END AS transaction_price FROM sales""",
    ),
)
def typed_records(spark, sf_dir):
    sales = view(spark, sf_dir, "sales")
    typed = sales.select(
        "sale_id",
        F.when(F.col("sale_id") % 5 == 0, "onbekend").otherwise(F.col("sale_date").cast("string")).alias("transaction_date"),
        "transaction_type",
        F.col("price").alias("transaction_price"),
    )
    bodies = documents.to_documents(typed, ["sale_id"]).withColumn(
        "body", F.when(F.col("sale_id") % 7 == 0, F.lit('"los"')).otherwise(F.col("body"))
    )
    records = documents.typed_records(bodies, "transaction")
    return records.select("sale_id", F.col("transaction_date").cast("string").alias("transaction_date"), "transaction_type", "transaction_price")
