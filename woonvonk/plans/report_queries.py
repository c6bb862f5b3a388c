"""Queries for matching, upserts, filters, joined rows, sorts and run counters."""

from __future__ import annotations

from pyspark.sql import functions as F

from woonvonk.operators import benchmarks, deals, matching, reports
from woonvonk.operators.benchmarks import city_key
from woonvonk.plans.history_queries import ORDER, ORDER_SQL
from woonvonk.plans.normalize_queries import HOUSE, POSTCODE, _norm_text, _norm_url
from woonvonk.plans.registry import query
from woonvonk.plans.views import mean, r2, read, view, with_views

# Incoming records: every listing again, disturbed so that each tier, and none of them, is needed.
INCOMING = """
  SELECT listing_id AS record_id, concat('portal', cast(source_id as {text}), '.example') AS source_name,
    CASE WHEN listing_id % 15 = 0 THEN external_listing_id ELSE NULL END AS external_listing_id,
    CASE WHEN listing_id % 15 = 3 THEN concat(replace(source_url, 'https://', 'HTTPS://'), '?utm=1') ELSE concat('https://new.example/', cast(listing_id as {text})) END AS source_url,
    CASE WHEN listing_id % 15 = 6 THEN upper(address) WHEN listing_id % 15 = 9 THEN concat('  ', replace(address, ', ', ' . '), ' ') WHEN listing_id % 15 = 12 THEN NULL
      ELSE concat('elders ', cast(listing_id as {text})) END AS address,
    surface_m2, asking_price, city
  FROM listings"""


def _keys_sql(id: str, t: str) -> str:
    return f"""
  SELECT {id}, 1 AS tier, concat_ws('|', source_name, external_listing_id) AS key FROM {t} WHERE external_listing_id IS NOT NULL
  UNION ALL SELECT {id}, 2, {_norm_url('source_url')} FROM {t} WHERE {_norm_url('source_url')} <> ''
  UNION ALL SELECT {id}, 3, concat(regexp_extract(address, '{POSTCODE}', 1), upper(regexp_extract(address, '{POSTCODE}', 2)), '|',
      regexp_extract({_norm_text('address')}, '{HOUSE}', 1), '|', regexp_extract({_norm_text('address')}, '{HOUSE}', 2)) FROM {t}
    WHERE regexp_matches(address, '{POSTCODE}') AND regexp_matches({_norm_text('address')}, '{HOUSE}')
  UNION ALL SELECT {id}, 4, {_norm_text('address')} FROM {t} WHERE {_norm_text('address')} <> ''"""


MATCH_SQL = f"""
incoming AS ({INCOMING.format(text='varchar')}),
existing AS (SELECT l.*, concat('portal', cast(source_id as varchar), '.example') AS source_name FROM listings l),
ik AS ({_keys_sql('record_id', 'incoming')}),
ek AS ({_keys_sql('listing_id', 'existing')}),
best AS (SELECT ik.record_id, min((ik.tier, ek.listing_id)) AS b FROM ik JOIN ek ON ek.tier = ik.tier AND ek.key = ik.key GROUP BY ik.record_id),
matched AS (SELECT i.*, b[2] AS matched_listing_id, b[1] AS tier FROM incoming i LEFT JOIN best ON best.record_id = i.record_id)"""


def _incoming(spark, sf_dir):
    return spark.sql(INCOMING.format(text="string").replace("FROM listings", "FROM {listings}"), listings=view(spark, sf_dir, "listings"))


def _existing(spark, sf_dir):
    name = F.concat(F.lit("portal"), F.col("source_id").cast("string"), F.lit(".example"))
    return view(spark, sf_dir, "listings").withColumn("source_name", name)


def _matched(spark, sf_dir, **options):
    return matching.match_listings(_incoming(spark, sf_dir), _existing(spark, sf_dir), [], **options)


METHOD_SQL = """CASE tier WHEN 1 THEN 'source_external_listing_id' WHEN 2 THEN 'normalized_source_url' WHEN 3 THEN 'postcode_house_number' WHEN 4 THEN 'normalized_address' ELSE 'none' END AS match_method,
  CASE tier WHEN 1 THEN 1e0 WHEN 2 THEN 0.98e0 WHEN 3 THEN 0.95e0 WHEN 4 THEN 0.9e0 ELSE 0e0 END AS confidence"""


@query("match_listings", with_views("listings", f"WITH {MATCH_SQL} SELECT record_id, matched_listing_id, {METHOD_SQL} FROM matched"))
def match_listings(spark, sf_dir):
    return _matched(spark, sf_dir).select("record_id", "matched_listing_id", "match_method", "confidence")


@query(
    "match_listings_by_area",
    with_views(
        "listings",
        f"""WITH {MATCH_SQL},
        loose AS (SELECT ik.record_id, min((ik.tier, ek.listing_id)) AS b FROM ik JOIN ek ON ek.tier = ik.tier AND ek.key = ik.key WHERE ik.tier < 4 GROUP BY ik.record_id),
        area AS (SELECT i.record_id, min(e.listing_id) AS listing_id FROM incoming i JOIN existing e ON {_norm_text('e.address')} = {_norm_text('i.address')}
          WHERE {_norm_text('i.address')} <> '' AND abs(e.surface_m2 - i.surface_m2) <= 1 GROUP BY i.record_id)
        SELECT i.record_id, coalesce(b[2], area.listing_id) AS matched_listing_id,
          CASE WHEN b IS NULL AND area.listing_id IS NOT NULL THEN 'address_surface_fallback' ELSE CASE b[1] WHEN 1 THEN 'source_external_listing_id' WHEN 2 THEN 'normalized_source_url' WHEN 3 THEN 'postcode_house_number' ELSE 'none' END END AS match_method
        FROM incoming i LEFT JOIN loose ON loose.record_id = i.record_id LEFT JOIN area ON area.record_id = i.record_id""",
    ),
)
def match_listings_by_area(spark, sf_dir):
    return _matched(spark, sf_dir, strict_address=False).select("record_id", "matched_listing_id", "match_method")


@query("only_new", with_views("listings", f"WITH {MATCH_SQL} SELECT record_id, source_url FROM matched WHERE matched_listing_id IS NULL"))
def only_new(spark, sf_dir):
    return matching.only_new(_matched(spark, sf_dir)).select("record_id", "source_url")


@query(
    "upsert_by_key",
    with_views(
        "listings",
        """WITH stored AS (SELECT listing_id, source_url, asking_price, city, 'start' AS first_seen_at FROM listings WHERE listing_id % 4 <> 0),
        arriving AS (SELECT listing_id + 1000000 * k AS listing_id, upper(source_url) AS source_url, CASE WHEN listing_id % 6 = 0 THEN NULL ELSE asking_price + k END AS asking_price, city, 'now' AS first_seen_at, k AS seq
          FROM listings, (VALUES (1), (2)) AS v(k) WHERE listing_id % 2 = 0),
        latest AS (SELECT *, regexp_replace(lower(source_url), '/+$', '') AS u FROM arriving WHERE seq = 2),
        known AS (SELECT *, regexp_replace(lower(source_url), '/+$', '') AS u FROM stored)
        SELECT coalesce(s.listing_id, n.listing_id) AS listing_id, CASE WHEN n.u IS NULL THEN s.source_url ELSE n.source_url END AS source_url,
          CASE WHEN n.u IS NULL THEN s.asking_price ELSE n.asking_price END AS asking_price, coalesce(s.first_seen_at, n.first_seen_at) AS first_seen_at
        FROM known s FULL OUTER JOIN latest n ON n.u = s.u""",
    ),
)
def upsert_by_key(spark, sf_dir):
    listings = view(spark, sf_dir, "listings")
    stored = listings.where("listing_id % 4 <> 0").select(
        "listing_id", "source_url", "asking_price", "city", F.lit("start").alias("first_seen_at")
    )
    arriving = (
        listings.where("listing_id % 2 = 0")
        .withColumn("seq", F.explode(F.array(F.lit(1), F.lit(2))))
        .select(
            (F.col("listing_id") + F.lit(1000000) * F.col("seq")).alias("listing_id"),
            F.upper("source_url").alias("source_url"),
            F.when(F.col("listing_id") % 6 != 0, F.col("asking_price") + F.col("seq")).alias("asking_price"),
            "city",
            F.lit("now").alias("first_seen_at"),
            "seq",
        )
    )
    return matching.upsert_listings(stored, arriving, ["seq"]).drop("city")


TWO_MISS_SQL = """
recent AS (SELECT source_id, run_id, row_number() OVER (PARTITION BY source_id ORDER BY started_at DESC, run_id DESC) AS rk FROM runs WHERE status = 'completed' QUALIFY rk <= 2),
seen AS (SELECT DISTINCT o.source_id, o.listing_id, r.rk FROM observations o JOIN recent r ON r.run_id = concat(cast(o.source_id as varchar), '-', cast(cast(o.observed_at as date) as varchar))),
known AS (SELECT DISTINCT source_id, listing_id FROM observations)"""


def _sightings(spark, sf_dir):
    run = F.concat_ws("-", F.col("source_id").cast("string"), F.to_date("observed_at").cast("string"))
    return view(spark, sf_dir, "observations").withColumn("run_id", run)


@query(
    "two_miss_inactive",
    with_views(
        "runs observations",
        f"""WITH {TWO_MISS_SQL}
        SELECT k.source_id, k.listing_id, true AS evaluated, b.listing_id IS NULL AS mark_inactive FROM known k
        LEFT JOIN (SELECT * FROM seen WHERE rk = 1) n ON n.source_id = k.source_id AND n.listing_id = k.listing_id
        LEFT JOIN (SELECT * FROM seen WHERE rk = 2) b ON b.source_id = k.source_id AND b.listing_id = k.listing_id
        WHERE n.listing_id IS NULL AND k.source_id IN (SELECT source_id FROM seen WHERE rk = 2)""",
    ),
)
def two_miss_inactive(spark, sf_dir):
    sightings = _sightings(spark, sf_dir)
    listings = sightings.select("source_id", "listing_id").distinct()
    return matching.two_miss_inactive(listings, sightings, view(spark, sf_dir, "runs"))


@query(
    "previous_completed_run",
    with_views(
        "runs",
        """SELECT source_id, run_id, cast(row_number() OVER (PARTITION BY source_id ORDER BY started_at DESC, run_id DESC) as int) AS run_rank FROM runs WHERE status = 'completed'
        QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY started_at DESC, run_id DESC) <= 2""",
    ),
)
def previous_completed_run(spark, sf_dir):
    return matching.latest_two_runs(view(spark, sf_dir, "runs"))


@query(
    "missing_ids",
    with_views(
        "runs observations",
        f"WITH {TWO_MISS_SQL} SELECT DISTINCT listing_id FROM known WHERE listing_id NOT IN (SELECT listing_id FROM seen WHERE rk = 1) AND listing_id NOT IN (SELECT listing_id FROM seen WHERE rk = 2)",
    ),
)
def missing_ids(spark, sf_dir):
    sightings = _sightings(spark, sf_dir)
    seen = sightings.join(matching.latest_two_runs(view(spark, sf_dir, "runs")), ["source_id", "run_id"])
    return matching.missing_ids(sightings, seen.where("run_rank = 1"), seen.where("run_rank = 2"))


@query(
    "dedupe_keep_first",
    with_views(
        "snapshots",
        """WITH s AS (SELECT *, CASE WHEN snapshot_seq % 3 <> 0 THEN cast(listing_id as varchar) END AS id, CASE WHEN snapshot_seq % 6 = 3 THEN concat('https://p.example/', cast(listing_id as varchar)) END AS url,
          concat('Laan ', cast(listing_id % 50 as varchar)) AS address, concat('Plaats ', cast(listing_id % 4 as varchar)) AS city FROM snapshots)
        SELECT listing_id, snapshot_seq FROM s QUALIFY row_number() OVER (PARTITION BY coalesce(id, url, lower(concat(address, '::', city))) ORDER BY observed_at, snapshot_seq) = 1""",
    ),
)
def dedupe_keep_first(spark, sf_dir):
    """Two in three rows have an id, some of the rest a URL, all an address and a city."""
    rows = view(spark, sf_dir, "snapshots").withColumn("seen_id", F.col("listing_id"))
    number, seq = F.col("seen_id"), F.col("snapshot_seq")
    keyed = rows.withColumns(
        {
            "listing_id": F.when(seq % 3 != 0, number.cast("string")),
            "source_url": F.when(seq % 6 == 3, F.concat(F.lit("https://p.example/"), number.cast("string"))),
            "address": F.concat(F.lit(" LAAN "), (number % 50).cast("string")),
            "city": F.concat(F.lit("plaats "), (number % 4).cast("string")),
        }
    )
    return matching.keep_first(keyed, ["observed_at", "snapshot_seq"]).select(F.col("seen_id").alias("listing_id"), "snapshot_seq")


@query(
    "union_sources",
    with_views(
        "listings",
        """WITH u AS (SELECT 0 AS source_order, source_url, address, city, listing_id AS seq FROM listings WHERE listing_id % 2 = 0
          UNION ALL SELECT 1, CASE WHEN listing_id % 6 = 0 THEN NULL ELSE source_url END, upper(address), city, listing_id FROM listings WHERE listing_id % 3 = 0 OR listing_id % 2 = 1)
        SELECT source_order, seq FROM u QUALIFY row_number() OVER (PARTITION BY coalesce(source_url, concat(lower(trim(address)), '::', lower(coalesce(city, '')))) ORDER BY source_order, seq) = 1""",
    ),
)
def union_sources(spark, sf_dir):
    rows = view(spark, sf_dir, "listings").select(
        F.lit("").alias("listing_id"), "source_url", "address", "city", F.col("listing_id").alias("seq")
    )
    second = rows.where("seq % 3 = 0 OR seq % 2 = 1").select(
        F.when(F.col("seq") % 6 != 0, F.col("source_url")).alias("source_url"),
        F.upper("address").alias("address"),
        "city",
        "seq",
    )
    return matching.union_sources([rows.where("seq % 2 = 0"), second], ["seq"]).select("source_order", "seq")


@query(
    "permits_union_dedupe",
    with_views(
        "permits",
        """WITH h AS (SELECT property_id, CASE WHEN permit_id % 7 = 0 THEN NULL ELSE reference_number END AS reference_number, permit_type, application_date FROM permits WHERE status <> 'pending' OR permit_id % 2 = 0),
        a AS (SELECT property_id, CASE WHEN permit_id % 7 = 0 THEN NULL ELSE reference_number END AS reference_number, permit_type, application_date FROM permits WHERE status = 'pending'),
        u AS (SELECT *, false AS is_active FROM h UNION SELECT *, true FROM a)
        SELECT property_id, reference_number, permit_type, cast(application_date as varchar) AS application_date, is_active FROM u
        WHERE is_active OR NOT EXISTS (SELECT 1 FROM a WHERE a.property_id = u.property_id AND a.reference_number IS NOT DISTINCT FROM u.reference_number AND a.permit_type = u.permit_type AND a.application_date = u.application_date)""",
    ),
)
def permits_union_dedupe(spark, sf_dir):
    permits = view(spark, sf_dir, "permits").withColumn(
        "reference_number", F.when(F.col("permit_id") % 7 != 0, F.col("reference_number"))
    )
    keys = ["property_id", "reference_number", "permit_type", "application_date"]
    history = permits.where("status <> 'pending' or permit_id % 2 = 0")
    merged = matching.merge_permits(history, permits.where("status = 'pending'"), keys)
    return merged.withColumn("application_date", F.col("application_date").cast("string"))


@query(
    "warning_union",
    with_views(
        "listings",
        """SELECT listing_id, concat_ws('|', CASE WHEN listing_id % 2 = 0 THEN 'geen foto' END, CASE WHEN listing_id % 3 = 0 THEN 'geen prijs' END,
        CASE WHEN listing_id % 2 <> 0 AND listing_id % 5 = 0 THEN 'geen foto' END) AS warnings FROM listings""",
    ),
)
def warning_union(spark, sf_dir):
    n = F.col("listing_id")

    def when(condition, text):
        return F.array_compact(F.array(F.when(condition, F.lit(text))))

    merged = reports.ordered_union(when(n % 2 == 0, "geen foto"), when(n % 3 == 0, "geen prijs"), when(n % 5 == 0, "geen foto"))
    return view(spark, sf_dir, "listings").select("listing_id", F.array_join(merged, "|").alias("warnings"))


def _places(spark, sf_dir):
    return view(spark, sf_dir, "listings").select(F.col("city").alias("place"), F.col("listing_id").alias("place_order"))


@query(
    "merge_places",
    with_views(
        "listings",
        """WITH u AS (SELECT 0 AS list_no, city AS place, listing_id AS place_order FROM listings WHERE listing_id % 2 = 0 AND city IS NOT NULL
          UNION ALL SELECT 1, upper(city), listing_id FROM listings WHERE city IS NOT NULL UNION ALL SELECT 1, concat('Dorp ', cast(listing_id % 50 as varchar)), listing_id FROM listings)
        SELECT place, cast(list_no as int) AS list_no, place_order FROM u QUALIFY row_number() OVER (PARTITION BY lower(place) ORDER BY list_no, place_order, place) = 1""",
    ),
)
def merge_places(spark, sf_dir):
    places = _places(spark, sf_dir)
    village = F.concat(F.lit("Dorp "), (F.col("place_order") % 50).cast("string"))
    second = places.withColumn("place", F.upper("place")).unionByName(places.withColumn("place", village))
    return matching.merge_places(places.where("place_order % 2 = 0"), second)


@query(
    "place_list",
    with_views("listings", "WITH p AS (SELECT min(trim(city)) AS place, lower(trim(city)) AS k FROM listings WHERE trim(city) <> '' GROUP BY lower(trim(city))) SELECT place, strip_accents(k) AS sort_key FROM p ORDER BY 2, 1"),
)
def place_list(spark, sf_dir):
    return reports.place_list(_places(spark, sf_dir))


@query(
    "selection_summary",
    with_views(
        "listings",
        """WITH c AS (SELECT source_id, city FROM listings WHERE city IS NOT NULL GROUP BY source_id, city),
        n AS (SELECT source_id, city, row_number() OVER (PARTITION BY source_id ORDER BY city) AS rn, count(*) OVER (PARTITION BY source_id) AS n FROM c)
        SELECT source_id, concat(cast(max(n) as varchar), ' gemeenten geselecteerd: ', string_agg(city, ', ' ORDER BY city) FILTER (rn <= 5),
          CASE WHEN max(n) > 5 THEN concat(' en nog ', cast(max(n) - 5 as varchar), ' gemeenten') ELSE '' END) AS summary FROM n GROUP BY source_id""",
    ),
)
def selection_summary(spark, sf_dir):
    cities = view(spark, sf_dir, "listings").where("city is not null").select("source_id", "city").distinct()
    return reports.selection_summaries(cities, "source_id", "city")


@query(
    "places_in_use",
    with_views(
        "listings",
        """WITH p AS (SELECT city AS place, min(listing_id) AS place_order FROM listings WHERE city IS NOT NULL GROUP BY city
          UNION ALL SELECT concat('Dorp ', listing_id % 50), max(listing_id) + 1000000 FROM listings GROUP BY 1)
        SELECT * FROM p WHERE place IN (SELECT trim(city) FROM listings WHERE trim(city) <> '') ORDER BY place_order""",
    ),
)
def places_in_use(spark, sf_dir):
    """The reference list also has villages that no listing lies in."""
    listings = view(spark, sf_dir, "listings")
    towns = listings.where("city is not null").groupBy(F.col("city").alias("place")).agg(F.min("listing_id").alias("place_order"))
    village = F.concat(F.lit("Dorp "), (F.col("listing_id") % 50).cast("string")).alias("place")
    villages = listings.groupBy(village).agg((F.max("listing_id") + 1_000_000).alias("place_order"))
    return reports.places_in_use(towns.union(villages), listings)


# --- filters ------------------------------------------------------------------------------------


def _candidates(spark, sf_dir):
    return reports.candidates_with_listing(
        view(spark, sf_dir, "candidates"), view(spark, sf_dir, "listings"), view(spark, sf_dir, "sources")
    )


JOINED_SQL = "joined AS (SELECT c.*, l.* EXCLUDE (listing_id), s.source_name FROM candidates c LEFT JOIN listings l ON l.listing_id = c.listing_id LEFT JOIN sources s ON s.source_id = l.source_id)"


@query(
    "candidates_with_listing",
    with_views("candidates listings sources", f"WITH {JOINED_SQL} SELECT candidate_id, listing_id, priority, address, city, asking_price, source_id, source_name FROM joined"),
)
def candidates_with_listing(spark, sf_dir):
    return _candidates(spark, sf_dir).select(
        "candidate_id", "listing_id", "priority", "address", "city", "asking_price", "source_id", "source_name"
    )


@query(
    "filter_candidates",
    with_views("candidates listings sources", f"WITH {JOINED_SQL} SELECT candidate_id, hidden_value_score, city FROM joined WHERE (hidden_value_score IS NULL OR hidden_value_score >= 40) AND city = 'Brand#13' AND priority = 'high'"),
)
def filter_candidates(spark, sf_dir):
    kept = reports.filter_candidates(_candidates(spark, sf_dir), minimum_score=40, city="Brand#13", priority="high")
    return kept.select("candidate_id", "hidden_value_score", "city")


@query(
    "filter_rows",
    with_views(
        "candidates listings sources",
        f"WITH {JOINED_SQL} SELECT candidate_id FROM joined WHERE asking_price >= 200000 AND asking_price <= 600000 AND surface_m2 >= 60 AND upper(trim(energy_label)) = 'A+' AND hidden_value_score >= 10",
    ),
)
def filter_rows(spark, sf_dir):
    rows = _candidates(spark, sf_dir).withColumn("opportunity_score", F.col("hidden_value_score"))
    kept = reports.filter_rows(rows, min_price=200000, max_price=600000, min_area=60, label="a+ ", min_score=10)
    return kept.select("candidate_id")


@query(
    "filter_dashboard",
    with_views(
        "candidates listings sources",
        f"WITH {JOINED_SQL} SELECT candidate_id, city FROM joined WHERE trim(city) = 'Brand#21' AND asking_price >= 100000 AND asking_price <= 500000 AND surface_m2 >= 40",
    ),
)
def filter_dashboard(spark, sf_dir):
    kept = reports.filter_rows(_candidates(spark, sf_dir), place="Brand#21", min_price=100000, max_price=500000, min_area=40)
    return kept.select("candidate_id", "city")


@query(
    "filter_properties",
    with_views(
        "candidates listings sources",
        f"WITH {JOINED_SQL} SELECT candidate_id, investment_score, asking_price FROM joined WHERE investment_score >= 50 AND (asking_price IS NULL OR asking_price <= 300000) AND (contains(lower(title), 'widget') OR contains(lower(address), 'widget'))",
    ),
)
def filter_properties(spark, sf_dir):
    kept = reports.filter_properties(_candidates(spark, sf_dir), min_score=50, max_price=300000, words=" Widget ")
    return kept.select("candidate_id", "investment_score", "asking_price")


@query(
    "filter_exact_address",
    with_views(
        "listings",
        "SELECT listing_id, address FROM listings WHERE regexp_matches(lower(trim(regexp_replace(address, '\\s+', ' ', 'g'))), '^(small|red|hot) (widget|bolt) 2, 1001 ab$')",
    ),
)
def filter_exact_address(spark, sf_dir):
    """Listing 1 is at one of these addresses at every size."""
    listings = view(spark, sf_dir, "listings")
    sought = [f" {a.upper()}  {b} 2, 1001 AB" for a in ("small", "red", "hot") for b in ("widget", "bolt")]
    found = reports.filter_exact_address(listings, sought[0])
    for address in sought[1:]:
        found = found.union(reports.filter_exact_address(listings, address))
    return found.select("listing_id", "address")


@query(
    "within_scan_window",
    with_views("candidates", "SELECT candidate_id, cast(detected_at as varchar) AS detected_at FROM candidates WHERE detected_at >= timestamp '1997-01-01' AND detected_at <= timestamp '1999-06-30'"),
)
def within_scan_window(spark, sf_dir):
    start, end = (F.lit(d).cast("timestamp_ntz") for d in ("1997-01-01 00:00:00", "1999-06-30 00:00:00"))
    kept = reports.within_scan_window(view(spark, sf_dir, "candidates"), start, end)
    return kept.select("candidate_id", F.col("detected_at").cast("string").alias("detected_at"))


@query(
    "filter_municipality",
    with_views("listings", "SELECT listing_id FROM listings WHERE trim(regexp_replace(lower(city), '[^a-z0-9]+', '-', 'g'), '-') = 'brand-13'"),
)
def filter_municipality(spark, sf_dir):
    return reports.filter_municipality(view(spark, sf_dir, "listings"), "brand-13").select("listing_id")


@query("source_selection", with_views("sources", "SELECT source_id, source_name, source_type FROM sources WHERE is_enabled"))
def source_selection(spark, sf_dir):
    return reports.source_selection(view(spark, sf_dir, "sources"), ["source_id"]).select("source_id", "source_name", "source_type")


@query(
    "permits_by_status",
    with_views(
        "permits",
        """SELECT CASE status WHEN 'pending' THEN 'active' ELSE status END AS status_group, permit_id FROM permits WHERE status IN ('pending', 'granted', 'rejected', 'withdrawn')""",
    ),
)
def permits_by_status(spark, sf_dir):
    permits = view(spark, sf_dir, "permits")
    parts = [
        reports.permits_by_status(permits, g).select(F.lit(g).alias("status_group"), "permit_id") for g in reports.PERMIT_GROUPS
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@query(
    "permits_last_10y",
    with_views("permits", "SELECT permit_id, cast(application_date as varchar) AS application_date FROM permits WHERE application_date >= date '2008-08-01' - INTERVAL 10 YEAR"),
)
def permits_last_10y(spark, sf_dir):
    kept = reports.permits_last_years(view(spark, sf_dir, "permits"), F.lit("2008-08-01").cast("date"))
    return kept.select("permit_id", F.col("application_date").cast("string").alias("application_date"))


@query(
    "permit_status_counts",
    with_views(
        "permits",
        """SELECT property_id, count(*) AS total_records, count(CASE WHEN status = 'pending' THEN 1 END) AS pending_count, count(CASE WHEN status = 'granted' THEN 1 END) AS granted_count,
          count(CASE WHEN status = 'rejected' THEN 1 END) AS rejected_count, count(CASE WHEN status = 'withdrawn' THEN 1 END) AS withdrawn_count,
          count(CASE WHEN status NOT IN ('pending', 'granted', 'rejected', 'withdrawn') THEN 1 END) AS other_count, count(CASE WHEN affects_investment_case THEN 1 END) AS affecting_investment_case,
          cast(bool_or(status = 'pending') as int) + cast(bool_or(status = 'rejected') as int) AS warning_count FROM permits GROUP BY property_id""",
    ),
)
def permit_status_counts(spark, sf_dir):
    return reports.permit_summary(view(spark, sf_dir, "permits")).withColumn("warning_count", F.size("warnings")).drop("warnings")


# --- joined rows --------------------------------------------------------------------------------


@query(
    "properties_with_latest_analysis",
    with_views(
        "listings candidates",
        """WITH latest AS (SELECT * FROM candidates QUALIFY row_number() OVER (PARTITION BY listing_id ORDER BY detected_at DESC, candidate_id DESC) = 1)
        SELECT l.listing_id, c.candidate_id AS analysis_id, c.investment_score, coalesce(cast(c.detected_at as varchar), '1990-01-01 00:00:00') AS created_at FROM listings l LEFT JOIN latest c ON c.listing_id = l.listing_id""",
    ),
)
def properties_with_latest_analysis(spark, sf_dir):
    analyses = view(spark, sf_dir, "candidates").select(
        "listing_id", F.col("candidate_id").alias("analysis_id"), "investment_score", F.col("detected_at").alias("created_at")
    )
    properties = view(spark, sf_dir, "listings").select(
        "listing_id", F.lit("1990-01-01 00:00:00").cast("timestamp_ntz").alias("created_at")
    )
    joined = reports.with_latest_analysis(properties, analyses, "listing_id", ["created_at", "analysis_id"])
    return joined.select("listing_id", "analysis_id", "investment_score", F.col("created_at").cast("string").alias("created_at"))


@query(
    "latest_per_key",
    with_views("candidates", "SELECT listing_id, candidate_id FROM candidates QUALIFY row_number() OVER (PARTITION BY listing_id ORDER BY detected_at DESC, candidate_id DESC) = 1"),
)
def latest_per_key(spark, sf_dir):
    from woonvonk.operators.skew import first_per_key

    newest = [F.col("detected_at").desc(), F.col("candidate_id").desc()]
    return first_per_key(view(spark, sf_dir, "candidates"), ["listing_id"], newest).select("listing_id", "candidate_id")


@query(
    "source_health",
    with_views(
        "sources runs",
        """WITH latest AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY started_at DESC, run_id DESC) = 1)
        SELECT s.source_id, s.source_name, r.status AS latest_scan_status, cast(r.started_at as varchar) AS latest_scan_started_at FROM sources s LEFT JOIN latest r ON r.source_id = s.source_id""",
    ),
)
def source_health(spark, sf_dir):
    health = reports.source_health(view(spark, sf_dir, "sources"), view(spark, sf_dir, "runs"))
    return health.select(
        "source_id", "source_name", "latest_scan_status", F.col("latest_scan_started_at").cast("string").alias("latest_scan_started_at")
    )


@query("recent_runs", with_views("runs", "SELECT run_id, items_found FROM runs ORDER BY started_at DESC, run_id LIMIT 20"))
def recent_runs(spark, sf_dir):
    return reports.recent_runs(view(spark, sf_dir, "runs")).select("run_id", "items_found")


@query(
    "listing_detail",
    with_views(
        "listings sources snapshots candidates",
        """WITH ranked AS (SELECT *, row_number() OVER (PARTITION BY listing_id ORDER BY observed_at DESC, snapshot_seq DESC) AS rn FROM snapshots),
        arrays AS (SELECT listing_id, cast(count(*) as int) AS snapshot_count, max(CASE WHEN rn = 1 THEN listing_status END) AS latest_status, sum(asking_price) AS price_sum FROM ranked WHERE rn <= 50 GROUP BY listing_id),
        c AS (SELECT * FROM candidates QUALIFY row_number() OVER (PARTITION BY listing_id ORDER BY detected_at DESC, candidate_id DESC) = 1)
        SELECT l.listing_id, s.source_name, coalesce(a.snapshot_count, 0) AS snapshot_count, a.latest_status, a.price_sum, c.candidate_id FROM listings l
        LEFT JOIN sources s ON s.source_id = l.source_id LEFT JOIN arrays a ON a.listing_id = l.listing_id LEFT JOIN c ON c.listing_id = l.listing_id""",
    ),
)
def listing_detail(spark, sf_dir):
    detail = reports.listing_detail(
        view(spark, sf_dir, "listings"),
        view(spark, sf_dir, "sources"),
        view(spark, sf_dir, "snapshots"),
        view(spark, sf_dir, "candidates"),
        ["observed_at", "snapshot_seq"],
        n=50,
    )
    prices = F.filter(F.col("snapshots.asking_price"), lambda p: p.isNotNull())
    total = F.aggregate(prices, F.lit(0.0), lambda a, p: a + p)
    return detail.select(
        "listing_id",
        "source_name",
        F.coalesce(F.size("snapshots"), F.lit(0)).alias("snapshot_count"),
        F.col("latest_snapshot.listing_status").alias("latest_status"),
        F.when(F.size(prices) > 0, total).alias("price_sum"),
        "candidate_id",
    )


@query(
    "latest_scan_metrics",
    with_views("runs", "SELECT run_id, items_found, items_new, items_changed FROM runs ORDER BY started_at DESC, run_id DESC LIMIT 1"),
)
def latest_scan_metrics(spark, sf_dir):
    return reports.latest_run_metrics(view(spark, sf_dir, "runs"))


@query(
    "latest_completed_run",
    with_views("runs", "SELECT source_id, run_id, status, items_found FROM runs WHERE status = 'completed' QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY started_at DESC, run_id DESC) = 1"),
)
def latest_completed_run(spark, sf_dir):
    runs = view(spark, sf_dir, "runs").withColumn("completed_at", F.when(F.col("status") == "completed", F.col("completed_at")))
    return reports.latest_completed_run(runs, ["source_id"]).select("source_id", "run_id", "status", "items_found")


@query(
    "address_lookup_joins",
    with_views(
        "listings",
        """WITH d AS (SELECT lower(trim(address)) AS k, count(*) AS developments FROM listings WHERE listing_id % 2 = 0 GROUP BY 1),
        n AS (SELECT lower(trim(address)) AS k, max(plot_size_m2) AS news_weight FROM listings WHERE listing_id % 3 = 0 GROUP BY 1)
        SELECT l.listing_id, d.developments, n.news_weight, concat_ws('|', CASE WHEN d.k IS NULL THEN 'No area developments found for this address.' END,
          CASE WHEN n.k IS NULL THEN 'No local news found for this address.' END) AS warnings
        FROM listings l LEFT JOIN d ON d.k = lower(trim(l.address)) LEFT JOIN n ON n.k = lower(trim(l.address))""",
    ),
)
def address_lookup_joins(spark, sf_dir):
    from woonvonk.functions.text import address_key

    listings = view(spark, sf_dir, "listings")
    keyed = listings.withColumn("address_key", address_key("address"))
    tables = {
        "area developments": keyed.where("listing_id % 2 = 0").groupBy("address_key").agg(F.count(F.lit(1)).alias("developments")),
        "local news": keyed.where("listing_id % 3 = 0").groupBy("address_key").agg(F.max("plot_size_m2").alias("news_weight")),
    }
    found = reports.address_lookup(listings, tables)
    return found.select("listing_id", "developments", "news_weight", F.array_join("warnings", "|").alias("warnings"))


ROWS_SQL = "rows AS (SELECT candidate_id, listing_id, coalesce(address, 'Onbekend') AS adres, coalesce(city, 'Onbekend') AS plaats, asking_price AS vraagprijs, surface_m2 AS woonoppervlak, coalesce(energy_label, 'Onbekend') AS energielabel, coalesce(permit_history_count, 0) AS permit_history_count, hidden_value_score AS opportunity_score, coalesce(source_name, 'Onbekend') AS bron, detected_at FROM joined)"


@query(
    "build_rows",
    with_views("candidates listings sources", f"WITH {JOINED_SQL}, {ROWS_SQL} SELECT * EXCLUDE (detected_at) FROM rows"),
)
def build_rows(spark, sf_dir):
    return reports.build_rows(_candidates(spark, sf_dir)).select(
        "candidate_id", "listing_id", "adres", "plaats", "vraagprijs", "woonoppervlak", "energielabel", "permit_history_count", "opportunity_score", "bron"
    )


@query(
    "build_scan_rows",
    with_views(
        "listings sources",
        """SELECT l.listing_id, coalesce(l.city, 'Onbekend') AS plaats, l.asking_price AS vraagprijs, CASE WHEN l.price_reduction_count > 0 THEN 1 ELSE 0 END AS has_reduction, s.source_name AS bron FROM listings l LEFT JOIN sources s ON s.source_id = l.source_id""",
    ),
)
def build_scan_rows(spark, sf_dir):
    listings = view(spark, sf_dir, "listings").join(view(spark, sf_dir, "sources").select("source_id", "source_name"), "source_id", "left")
    empty = {n: F.lit(None).cast("int") for n in ("candidate_id", "investment_score", "hidden_value_score")}
    rows = reports.build_rows(listings.withColumns({**empty, "detected_at": F.lit(None).cast("timestamp_ntz")}))
    return rows.select("listing_id", "plaats", "vraagprijs", F.when(F.col("price_reduction_count") > 0, 1).otherwise(0).alias("has_reduction"), "bron")


# --- sorts and limits ---------------------------------------------------------------------------


@query(
    "sort_deal_rows",
    with_views("candidates listings sources", f"WITH {JOINED_SQL}, {ROWS_SQL} SELECT candidate_id, opportunity_score, vraagprijs FROM rows ORDER BY opportunity_score DESC NULLS LAST, candidate_id"),
)
def sort_deal_rows(spark, sf_dir):
    rows = reports.build_rows(_candidates(spark, sf_dir)).select("candidate_id", "opportunity_score", "vraagprijs")
    return reports.sort_by(rows, reports.SORT_CHOICES, "Hoogste opportunity score", "candidate_id")


@query(
    "sort_candidates",
    with_views("candidates listings sources", f"WITH {JOINED_SQL} SELECT candidate_id, asking_price FROM joined ORDER BY asking_price ASC NULLS LAST, candidate_id LIMIT 200"),
)
def sort_candidates(spark, sf_dir):
    rows = _candidates(spark, sf_dir).select("candidate_id", "asking_price")
    return reports.sort_by(rows, reports.CANDIDATE_SORTS, "asking_price_asc", "candidate_id", limit=200)


@query(
    "sort_properties",
    with_views("candidates listings sources", f"WITH {JOINED_SQL} SELECT candidate_id, investment_score FROM joined ORDER BY asking_price DESC NULLS LAST, candidate_id LIMIT 100"),
)
def sort_properties(spark, sf_dir):
    rows = _candidates(spark, sf_dir)
    return reports.sort_by(rows, reports.PROPERTY_SORTS, "Hoogste vraagprijs", "candidate_id", limit=100).select("candidate_id", "investment_score")


@query(
    "table_scan",
    with_views("candidates", "SELECT candidate_id, listing_id FROM candidates WHERE priority = 'urgent' AND investment_score = 49 ORDER BY detected_at DESC, candidate_id LIMIT 100"),
)
def table_scan(spark, sf_dir):
    from woonvonk.sources.tables import table_scan as scan

    filters = {"priority": "urgent", "investment_score": 49}
    rows = scan(view(spark, sf_dir, "candidates"), filters, order_column="detected_at", tiebreak="candidate_id", limit=100)
    return rows.select("candidate_id", "listing_id")


@query(
    "top_properties",
    with_views("candidates", "SELECT candidate_id, investment_score FROM candidates ORDER BY investment_score DESC NULLS LAST, candidate_id LIMIT 5"),
)
def top_properties(spark, sf_dir):
    rows = view(spark, sf_dir, "candidates")
    return reports.sort_by(rows, reports.PROPERTY_SORTS, "Hoogste score", "candidate_id", limit=5).select("candidate_id", "investment_score")


def _comps(spark, sf_dir):
    subjects = view(spark, sf_dir, "listings").withColumnRenamed("listing_id", "subject_id")
    return benchmarks.comparables(view(spark, sf_dir, "comps"), subjects)


@query("sort_comparables", with_views("comps", "SELECT comp_id, distance_meters FROM comps ORDER BY distance_meters DESC NULLS FIRST, comp_id"))
def sort_comparables(spark, sf_dir):
    return reports.sort_comparables(view(spark, sf_dir, "comps"), "onbekend", True, "comp_id").select("comp_id", "distance_meters")


@query(
    "comparables_table",
    with_views(
        "listings comps",
        f"""SELECT c.subject_id, c.comp_id, c.address, c.distance_meters, c.living_area_m2, {r2('c.asking_price', 0)} AS asking_price, {r2('c.sold_price', 0)} AS sold_price, cast(c.sold_date as varchar) AS sold_date,
        {r2('coalesce(c.sold_price, c.asking_price) / nullif(c.living_area_m2, 0)')} AS price_per_m2 FROM comps c""",
    ),
)
def comparables_table(spark, sf_dir):
    return reports.comparables_table(_comps(spark, sf_dir)).drop("difference_with_subject_pct")


# --- run counters -------------------------------------------------------------------------------

ITEMS_SQL = """items AS (SELECT user_id % 5 AS source_id, CASE WHEN event_type = 'error' THEN 'failed' WHEN event_type = 'view' THEN 'partially_imported' ELSE 'fully_imported' END AS import_status,
  cast(event_id % 700 as double) / 1000e0 AS import_seconds FROM events),
summary AS (SELECT source_id, count(*) AS listings_found, count(CASE WHEN import_status = 'fully_imported' THEN 1 END) AS fully_imported, count(CASE WHEN import_status = 'partially_imported' THEN 1 END) AS partially_imported,
  count(CASE WHEN import_status = 'failed' THEN 1 END) AS listings_failed, {avg} AS average_import_seconds FROM items GROUP BY source_id)""".format(
    avg=r2(mean("CASE WHEN import_status <> 'failed' THEN import_seconds END", 3), 3)
)


def _items(spark, sf_dir):
    return read(spark, sf_dir, "events").selectExpr(
        "user_id % 5 AS source_id",
        "CASE WHEN event_type = 'error' THEN 'failed' WHEN event_type = 'view' THEN 'partially_imported' ELSE 'fully_imported' END AS import_status",
        "cast(event_id % 700 as double) / 1000 AS import_seconds",
    )


@query("scan_summary", f"WITH {ITEMS_SQL} SELECT * FROM summary")
def scan_summary(spark, sf_dir):
    return reports.scan_summary(_items(spark, sf_dir), ["source_id"])


@query(
    "scan_overview",
    f"WITH {ITEMS_SQL} SELECT cast(sum(listings_found) as bigint) AS listings_found, cast(sum(fully_imported) as bigint) AS fully_imported, cast(sum(partially_imported) as bigint) AS partially_imported, cast(sum(listings_failed) as bigint) AS listings_failed, {r2('sum(average_import_seconds * (fully_imported + partially_imported)) / sum(fully_imported + partially_imported)', 3)} AS average_import_seconds FROM summary",
)
def scan_overview(spark, sf_dir):
    return reports.scan_overview(reports.scan_summary(_items(spark, sf_dir), ["source_id"]))


@query(
    "scan_cycle_totals",
    with_views(
        "runs",
        """SELECT count(CASE WHEN status = 'completed' THEN 1 END) AS sources_ok, count(CASE WHEN status <> 'completed' THEN 1 END) AS sources_failed, cast(sum(items_found) as bigint) AS items_found,
        cast(sum(items_new) as bigint) AS items_new, cast(sum(items_changed) as bigint) AS items_changed, bool_or(status = 'completed') AS cycle_ok FROM runs""",
    ),
)
def scan_cycle_totals(spark, sf_dir):
    return reports.cycle_totals(view(spark, sf_dir, "runs"))


@query(
    "ingest_counters",
    """WITH r AS (SELECT user_id % 5 AS source_id, event_type <> 'error' AS success, event_id % 7 = 0 AS skipped, CASE event_id % 4 WHEN 0 THEN 'new_listing' WHEN 1 THEN 'unchanged' ELSE 'asking_price_change' END AS change_type FROM events)
    SELECT source_id, greatest(count(*), 2500) AS found, count(CASE WHEN success AND NOT skipped THEN 1 END) AS imported, count(CASE WHEN NOT success THEN 1 END) AS failed, count(CASE WHEN success AND skipped THEN 1 END) AS duplicates_skipped,
      count(CASE WHEN success AND NOT skipped AND change_type = 'new_listing' THEN 1 END) AS new, count(CASE WHEN success AND NOT skipped AND change_type = 'asking_price_change' THEN 1 END) AS changed FROM r GROUP BY source_id""",
)
def ingest_counters(spark, sf_dir):
    results = read(spark, sf_dir, "events").selectExpr(
        "user_id % 5 AS source_id",
        "event_type <> 'error' AS success",
        "event_id % 7 = 0 AS skipped_existing",
        "CASE event_id % 4 WHEN 0 THEN 'new_listing' WHEN 1 THEN 'unchanged' ELSE 'asking_price_change' END AS change_type",
        "cast(2500 as bigint) AS reported_found",
    )
    return reports.ingest_counters(results, ["source_id"])


@query(
    "scan_report_by_city",
    with_views(
        "listings",
        """WITH c AS (SELECT lower(trim(coalesce(city, 'Onbekend'))) AS city, count(*) AS found, count(surface_m2) AS imported, count(CASE WHEN listing_id % 10 = 0 AND surface_m2 IS NOT NULL THEN 1 END) AS new,
          count(CASE WHEN listing_id % 10 = 1 AND surface_m2 IS NOT NULL THEN 1 END) AS changed, count(CASE WHEN surface_m2 IS NULL THEN 1 END) AS failed, count(CASE WHEN price_reduction_count > 0 THEN 1 END) AS reductions FROM listings GROUP BY 1)
        SELECT city, cast(grouping(city) as int) AS is_total, cast(sum(found) as bigint) AS found, cast(sum(imported) as bigint) AS imported, cast(sum(new) as bigint) AS new, cast(sum(changed) as bigint) AS changed, cast(sum(failed) as bigint) AS failed,
          cast(sum(reductions) as bigint) AS reductions, cast(greatest(0, sum(imported) - sum(new) - sum(changed)) as bigint) AS unchanged FROM c GROUP BY ROLLUP (city)""",
    ),
)
def scan_report_by_city(spark, sf_dir):
    ok = F.col("surface_m2").isNotNull()
    rows = view(spark, sf_dir, "listings").select(
        city_key().alias("city"),
        F.lit(1).cast("bigint").alias("found"),
        ok.cast("bigint").alias("imported"),
        (ok & (F.col("listing_id") % 10 == 0)).cast("bigint").alias("new"),
        (ok & (F.col("listing_id") % 10 == 1)).cast("bigint").alias("changed"),
        (~ok).cast("bigint").alias("failed"),
        (F.col("price_reduction_count") > 0).cast("bigint").alias("reductions"),
    )
    return reports.scan_report_by_city(rows)




# --- whole pages --------------------------------------------------------------------------------


@query(
    "property_detail",
    with_views(
        "listings candidates sales permits",
        """WITH a AS (SELECT * FROM candidates QUALIFY row_number() OVER (PARTITION BY listing_id ORDER BY detected_at DESC, candidate_id DESC) = 1),
        t AS (SELECT property_id, count(*) AS n, arg_max(sale_id, (sale_date, sale_id)) AS newest FROM sales GROUP BY 1), p AS (SELECT property_id, count(*) AS n FROM permits GROUP BY 1)
        SELECT l.listing_id AS property_id, a.candidate_id AS analysis_id, a.investment_score, cast(least(200, coalesce(t.n, 0)) as int) AS transaction_count, t.newest AS newest_sale, cast(least(200, coalesce(p.n, 0)) as int) AS permit_count, cast(least(50, coalesce(t.n, 0)) as int) AS label_count
        FROM listings l LEFT JOIN a ON a.listing_id = l.listing_id LEFT JOIN t ON t.property_id = l.listing_id LEFT JOIN p ON p.property_id = l.listing_id""",
    ),
)
def property_detail(spark, sf_dir):
    sales = view(spark, sf_dir, "sales")
    analyses = view(spark, sf_dir, "candidates").select(
        F.col("listing_id").alias("property_id"), F.col("candidate_id").alias("analysis_id"), "investment_score", F.col("detected_at").alias("created_at")
    )
    labels = sales.select("property_id", F.col("sale_date").alias("registered_on"), F.col("sale_id").alias("label_id"))
    properties = view(spark, sf_dir, "listings").select(F.col("listing_id").alias("property_id"))
    detail = reports.property_detail(properties, analyses, sales, view(spark, sf_dir, "permits"), labels, "property_id", 200, 200, 50)

    def size(name):
        return F.coalesce(F.size(name), F.lit(0))

    return detail.select(
        "property_id", "analysis_id", "investment_score", size("transactions").alias("transaction_count"),
        F.get("transactions", F.lit(0))["sale_id"].alias("newest_sale"), size("permits").alias("permit_count"), size("energy_labels").alias("label_count"),
    )


@query(
    "dashboard_result",
    with_views(
        "runs sources observations",
        f"""WITH r AS (SELECT * FROM runs ORDER BY started_at DESC, run_id DESC LIMIT 1),
        c AS (SELECT seq % 100 AS s, seq % 90 AS h FROM observations, r WHERE observed_at >= r.started_at AND observed_at <= r.completed_at)
        SELECT run_id, cast(completed_at as varchar) AS scan_timestamp, source_name AS source_names, items_found, items_new, items_changed, (SELECT count(*) FROM c) AS property_count,
          {r2('(SELECT avg(s) FROM c)')} AS average_investment_score, {r2('(SELECT avg(h) FROM c)')} AS average_opportunity_score FROM r JOIN sources ON sources.source_id = r.source_id""",
    ),
)
def dashboard_result(spark, sf_dir):
    found = view(spark, sf_dir, "observations").select(
        F.col("observed_at").alias("detected_at"), (F.col("seq") % 100).alias("investment_score"), (F.col("seq") % 90).alias("hidden_value_score")
    )
    head = reports.dashboard_result(view(spark, sf_dir, "runs"), view(spark, sf_dir, "sources"), found)
    return head.withColumns(
        {"scan_timestamp": F.col("scan_timestamp").cast("string"), "source_names": F.array_join("source_names", ",")}
    )


@query(
    "deal_rows",
    with_views(
        "candidates listings sources snapshots",
        f"""WITH {JOINED_SQL},
        numbered AS (SELECT *, row_number() OVER w AS rn, last_value(asking_price IGNORE NULLS) OVER (PARTITION BY listing_id ORDER BY {ORDER_SQL} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_price FROM snapshots WINDOW w AS (PARTITION BY listing_id ORDER BY {ORDER_SQL})),
        counts AS (SELECT listing_id, count(CASE WHEN asking_price < prev_price THEN 1 END) AS drops, cast(min(observed_at) as date) AS oldest FROM numbered GROUP BY listing_id),
        positive AS (SELECT listing_id, asking_price, row_number() OVER (PARTITION BY listing_id ORDER BY rn) AS rn, count(*) OVER (PARTITION BY listing_id) AS n FROM numbered WHERE asking_price > 0),
        earlier AS (SELECT p.*, lag(p.asking_price) OVER (PARTITION BY p.listing_id ORDER BY p.rn) AS before FROM positive p LEFT JOIN listings l ON l.listing_id = p.listing_id WHERE p.rn < p.n AND (l.asking_price IS NULL OR abs(p.asking_price - l.asking_price) > 0.009)),
        steps AS (SELECT *, row_number() OVER (PARTITION BY listing_id ORDER BY rn DESC) AS back FROM earlier WHERE before IS NULL OR before <> asking_price),
        paths AS (SELECT listing_id, string_agg(concat('€ ', replace(format('{{:,}}', cast(asking_price as bigint)), ',', '.')), ' -> ' ORDER BY rn) AS path FROM steps WHERE back <= 25 GROUP BY listing_id),
        base AS (SELECT j.*, {r2('asking_price / nullif(surface_m2, 0)')} AS ppm2, lower(trim(coalesce(city, 'Onbekend'))) AS city_key FROM joined j),
        bench AS (SELECT city_key, {mean('ppm2')} AS avg_ppm2 FROM base GROUP BY city_key)
        SELECT b.candidate_id, b.listing_id, coalesce(p.path, 'Onbekend') AS vorige_vraagprijzen, coalesce(b.price_reduction_count, cast(c.drops as int), 0) AS price_reduction_count,
          coalesce(b.days_on_market, CASE WHEN date '2001-08-01' >= c.oldest THEN cast(date '2001-08-01' - c.oldest as int) END) AS days_on_market, b.hidden_value_score AS deal_score, b.investment_score,
          {r2('b.asking_price - b.latest_woz_value')} AS asking_price_minus_woz_value, {r2('avg_ppm2')} AS city_avg_price_per_m2, {r2('(ppm2 - avg_ppm2) / avg_ppm2 * 100e0')} AS difference_vs_city_avg_pct
        FROM base b JOIN bench n ON n.city_key = b.city_key LEFT JOIN counts c ON c.listing_id = b.listing_id LEFT JOIN paths p ON p.listing_id = b.listing_id""",
    ),
)
def deal_rows(spark, sf_dir):
    rows = deals.deal_rows(
        view(spark, sf_dir, "candidates"), view(spark, sf_dir, "listings"), view(spark, sf_dir, "sources"), view(spark, sf_dir, "snapshots"),
        ORDER, F.lit("2001-08-01").cast("date"), shown_prices=25,
    )
    return rows.select(
        "candidate_id", "listing_id", "vorige_vraagprijzen", "price_reduction_count", "days_on_market", "deal_score", "investment_score",
        "asking_price_minus_woz_value", "city_avg_price_per_m2", "difference_vs_city_avg_pct",
    )
