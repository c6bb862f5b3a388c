"""Filters, sorts and joined rows of the reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from woonvonk.functions.casts import strip, text_or_null
from woonvonk.functions.text import address_key, municipality_slug, strip_accents
from woonvonk.operators.benchmarks import exact_mean
from woonvonk.operators.skew import first_per_key, top_n_per_key
from woonvonk.session import broadcast_if_small


def _all(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


# --- filters -----------------------------------------------------------------------------------


def filter_candidates(df: DataFrame, minimum_score=None, city=None, source_id=None, priority=None) -> DataFrame:
    """A missing score passes the minimum; the rest are equalities."""
    rules = []
    if minimum_score is not None:
        rules.append(F.col("hidden_value_score").isNull() | (F.col("hidden_value_score") >= minimum_score))
    for name, wanted in (("city", city), ("source_id", source_id), ("priority", priority)):
        if wanted is not None:
            rules.append(F.col(name) == wanted)
    return df.where(_all(rules))


def filter_rows(df: DataFrame, place=None, min_price=None, max_price=None, min_area=None, label=None, min_score=None) -> DataFrame:
    """Rows without a value fail every bound that is set."""
    rules = []
    if place:
        rules.append(strip("city") == place.strip())
    if min_price is not None:
        rules.append(F.col("asking_price") >= min_price)
    if max_price is not None:
        rules.append(F.col("asking_price") <= max_price)
    if min_area is not None:
        rules.append(F.col("surface_m2") >= min_area)
    if label:
        rules.append(F.upper(strip("energy_label")) == label.strip().upper())
    if min_score is not None:
        rules.append(F.col("opportunity_score") >= min_score)
    return df.where(_all(rules))


def filter_properties(df: DataFrame, city=None, min_score=None, max_price=None, words=None) -> DataFrame:
    """A missing score fails, a missing price passes; words are looked up in title and address."""
    rules = []
    if city:
        rules.append(F.col("city") == city)
    if min_score is not None:
        rules.append(F.col("investment_score") >= min_score)
    if max_price is not None:
        rules.append(F.col("asking_price").isNull() | (F.col("asking_price") <= max_price))
    if words:
        needle = words.strip().lower()
        rules.append(
            F.lower(F.coalesce("title", F.lit(""))).contains(needle)
            | F.lower(F.coalesce("address", F.lit(""))).contains(needle)
        )
    return df.where(_all(rules))


def filter_exact_address(df: DataFrame, address: str) -> DataFrame:
    return df.where(address_key("address") == address_key(F.lit(address)))


def within_scan_window(df: DataFrame, start: Column, end: Column) -> DataFrame:
    """Detected between start and end; a missing bound or time is open."""
    seen = F.col("detected_at")
    return df.where(F.coalesce(seen >= start, F.lit(True)) & F.coalesce(seen <= end, F.lit(True)))


def filter_municipality(df: DataFrame, slug: str, city: str = "city") -> DataFrame:
    return df.where(municipality_slug(city) == slug) if slug else df


def source_selection(sources: DataFrame, order: list[str], types=("portal", "broker")) -> DataFrame:
    """Enabled sources of the given kinds, each name once whatever its case."""
    wanted = sources.where(F.col("is_enabled") & F.col("source_type").isin(list(types))).withColumn(
        "_key", F.lower(strip("source_name"))
    )
    return first_per_key(wanted, ["_key"], [F.col(c) for c in order]).drop("_key")


# Permit states by meaning.
PERMIT_GROUPS = {
    "active": ["pending"],
    "granted": ["granted"],
    "rejected": ["rejected"],
    "withdrawn": ["withdrawn"],
}
PERMIT_YEARS = 10


def permits_by_status(permits: DataFrame, group: str) -> DataFrame:
    return permits.where(F.col("status").isin(PERMIT_GROUPS[group]))


def permits_last_years(permits: DataFrame, reference: Column, years: int = PERMIT_YEARS) -> DataFrame:
    return permits.where(F.col("application_date") >= F.add_months(reference, -12 * years))


def permit_summary(permits: DataFrame, key: str = "property_id") -> DataFrame:
    """Counts per state, permits that matter for the case, and the warnings they give."""
    known = list(PERMIT_GROUPS.values())
    named = [s for group in known for s in group]
    rolled = permits.groupBy(key).agg(
        F.count(F.lit(1)).alias("total_records"),
        *[F.count_if(F.col("status") == s).alias(f"{s}_count") for s in named],
        F.count_if(~F.coalesce(F.col("status").isin(named), F.lit(False))).alias("other_count"),
        F.count_if("affects_investment_case").alias("affecting_investment_case"),
    )
    warnings = F.array_compact(
        F.array(
            F.when(F.col("pending_count") > 0, "Pending permits indicate uncertainty until official decision is published."),
            F.when(F.col("rejected_count") > 0, "Rejected permits are an important risk signal but not automatically deal-breaking."),
        )
    )
    return rolled.withColumn("warnings", warnings)


# --- joined rows -------------------------------------------------------------------------------


def candidates_with_listing(candidates: DataFrame, listings: DataFrame, sources: DataFrame) -> DataFrame:
    """Candidate with its listing and source; candidates without a listing stay."""
    named = broadcast_if_small(sources.select("source_id", "source_name"))
    placed = listings.join(named, "source_id", "left")
    return candidates.join(placed.drop("investment_score"), "listing_id", "left")


def with_latest_analysis(properties: DataFrame, analyses: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Properties with their newest analysis; its time replaces the property's."""
    latest = first_per_key(analyses, [key], [F.col(c).desc() for c in order]).select(
        key, "analysis_id", "investment_score", F.col("created_at").alias("_analysed_at")
    )
    joined = properties.join(latest, key, "left")
    return joined.withColumn("created_at", F.coalesce("_analysed_at", "created_at")).drop("_analysed_at")


def source_health(sources: DataFrame, runs: DataFrame) -> DataFrame:
    """Sources with the state of their newest run."""
    latest = first_per_key(runs, ["source_id"], [F.col("started_at").desc(), F.col("run_id").desc()]).select(
        "source_id",
        F.col("status").alias("latest_scan_status"),
        F.col("started_at").alias("latest_scan_started_at"),
        F.col("completed_at").alias("latest_scan_completed_at"),
    )
    return sources.join(latest, "source_id", "left")


def recent_runs(runs: DataFrame, n: int = 20) -> DataFrame:
    return runs.orderBy(F.col("started_at").desc(), "run_id").limit(n)


def listing_detail(listings: DataFrame, sources: DataFrame, snapshots: DataFrame, candidates: DataFrame, order: list[str], n: int) -> DataFrame:
    """Listing with source, its newest ``n`` snapshots as an array, the newest of them and its candidate.

    The array is bounded: rows beyond the newest ``n`` never reach the shuffle.
    """
    newest = top_n_per_key(snapshots, ["listing_id"], [F.col(c).desc() for c in order], n, "snapshot_no")
    arrays = newest.groupBy("listing_id").agg(
        F.array_sort(F.collect_list(F.struct("snapshot_no", "observed_at", "asking_price", "listing_status"))).alias("snapshots")
    )
    candidate = first_per_key(candidates, ["listing_id"], [F.col("detected_at").desc(), F.col("candidate_id").desc()]).select(
        "listing_id", "candidate_id", "priority"
    )
    return (
        listings.join(broadcast_if_small(sources.select("source_id", "source_name")), "source_id", "left")
        .join(arrays, "listing_id", "left")
        .join(candidate, "listing_id", "left")
        .withColumn("latest_snapshot", F.get("snapshots", F.lit(0)))
    )


def latest_run_metrics(runs: DataFrame) -> DataFrame:
    """Found, new and changed of the newest run."""
    newest = F.struct("started_at", "run_id")
    picked = F.struct("run_id", "items_found", "items_new", "items_changed")
    return runs.agg(F.max_by(picked, newest).alias("r")).select("r.*")


# Run states that count as done.
DONE_STATES = ["completed", "success", "succeeded", "ok"]


def latest_completed_run(runs: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Newest run that is done, or that has an end time; over all or per group."""
    done = runs.where(F.lower("status").isin(DONE_STATES) | F.col("completed_at").isNotNull())
    columns = [c for c in runs.columns if c not in (by or [])]
    newest = F.max_by(F.struct(*columns), F.struct("started_at", "run_id")).alias("r")
    grouped = done.groupBy(*by).agg(newest) if by else done.agg(newest)
    return grouped.select(*(by or []), "r.*")


def address_lookup(properties: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """Look up address-keyed tables (``address_key`` plus values); what is not found gives a warning."""
    out = properties.withColumn("address_key", address_key("address"))
    warnings = []
    for name, table in tables.items():
        out = out.join(table.withColumn(f"_{name}", F.lit(True)), "address_key", "left")
        warnings.append(F.when(F.col(f"_{name}").isNull(), F.lit(f"No {name} found for this address.")))
    return out.withColumn("warnings", F.array_compact(F.array(*warnings))).drop(*[f"_{n}" for n in tables])


def ordered_union(*arrays: Column) -> Column:
    """Items of several arrays, each once, in order of first appearance."""
    return F.array_distinct(F.flatten(F.array(*arrays)))


def places_in_use(places: DataFrame, rows: DataFrame) -> DataFrame:
    """Reference places that occur in the rows, in reference order."""
    used = rows.select(strip("city").alias("place")).where(F.col("place") != "")
    return places.join(used, "place", "left_semi").orderBy("place_order")


def listing_fields() -> dict[str, Column]:
    """What a report row takes from the listing and its source, defaults filled in."""
    return {
        "adres": F.coalesce(text_or_null("address"), F.lit("Onbekend")),
        "plaats": F.coalesce(text_or_null("city"), F.lit("Onbekend")),
        "vraagprijs": F.col("asking_price"),
        "asking_price_status": F.coalesce("asking_price_status", F.lit("unknown")),
        "woonoppervlak": F.col("surface_m2"),
        "perceel": F.col("plot_size_m2"),
        "slaapkamers": F.col("bedrooms"),
        "energielabel": F.coalesce(text_or_null("energy_label"), F.lit("Onbekend")),
        "bouwjaar": F.col("construction_year"),
        "permit_history_count": F.coalesce("permit_history_count", F.lit(0)),
        "days_on_market": F.col("days_on_market"),
        "price_reduction_count": F.col("price_reduction_count"),
        "bron": F.coalesce(text_or_null("source_name"), F.lit("Onbekend")),
        "source_url": F.coalesce("source_url", F.lit("")),
        "neighborhood_m2_price_average": F.col("neighborhood_m2_price_average"),
        "latest_woz_value": F.col("latest_woz_value"),
    }


def build_rows(candidates: DataFrame) -> DataFrame:
    """Flat report row per candidate with its listing, defaults filled in."""
    return candidates.select(
        "candidate_id",
        "listing_id",
        *[c.alias(n) for n, c in listing_fields().items()],
        "investment_score",
        F.col("hidden_value_score").alias("opportunity_score"),
        "detected_at",
    ).where(F.col("listing_id").isNotNull())


# --- sorts and limits --------------------------------------------------------------------------

# Sort choices of the report.
SORT_CHOICES = {
    "Hoogste deal score": ("deal_score", True),
    "Hoogste investment score": ("investment_score", True),
    "Hoogste opportunity score": ("opportunity_score", True),
    "Hoogste split potential": ("split_potential", True),
    "Hoogste vertical extension potential": ("vertical_extension_potential", True),
    "Hoogste rental potential": ("rental_potential", True),
    "Hoogste renovation potential": ("renovation_potential", True),
    "Laagste vraagprijs": ("vraagprijs", False),
    "Hoogste vraagprijs": ("vraagprijs", True),
    "Nieuwste": ("detected_at", True),
}
CANDIDATE_SORTS = {
    "score_desc": ("hidden_value_score", True),
    "asking_price_asc": ("asking_price", False),
    "asking_price_desc": ("asking_price", True),
    "detected_at_desc": ("detected_at", True),
}
PROPERTY_SORTS = {
    "Hoogste score": ("investment_score", True),
    "Nieuwste eerst": ("created_at", True),
    "Laagste vraagprijs": ("asking_price", False),
    "Hoogste vraagprijs": ("asking_price", True),
}


def sort_by(df: DataFrame, choices: dict, choice: str, tiebreak: str, limit: int | None = None) -> DataFrame:
    """Sort by a named choice, NULL last, ties by id; with a limit it is a distributed top-k."""
    column, descending = choices[choice]
    by = F.col(column).desc_nulls_last() if descending else F.col(column).asc_nulls_last()
    ordered = df.orderBy(by, tiebreak)
    return ordered.limit(limit) if limit else ordered


COMPARABLE_SORTS = [
    "address", "distance_meters", "living_area_m2", "asking_price", "sold_price", "sold_date", "price_per_m2",
    "difference_with_subject_pct",
]


def sort_comparables(comps: DataFrame, key: str, descending: bool, tiebreak: str) -> DataFrame:
    """Missing numbers count as infinite and missing dates as the first day, in either direction."""
    column = key if key in COMPARABLE_SORTS else "distance_meters"
    missing_high = column not in ("address", "sold_date")
    if descending:
        by = F.col(column).desc_nulls_first() if missing_high else F.col(column).desc_nulls_last()
    else:
        by = F.col(column).asc_nulls_last() if missing_high else F.col(column).asc_nulls_first()
    return comps.orderBy(by, tiebreak)


def comparables_table(comps: DataFrame) -> DataFrame:
    """Display columns of comparables."""
    return comps.select(
        "subject_id",
        "comp_id",
        F.coalesce(text_or_null("address"), F.lit("Onbekend")).alias("address"),
        F.round("distance_meters", 1).alias("distance_meters"),
        F.round("living_area_m2", 1).alias("living_area_m2"),
        F.round("asking_price", 0).alias("asking_price"),
        F.round("sold_price", 0).alias("sold_price"),
        F.col("sold_date").cast("string").alias("sold_date"),
        F.round("price_per_m2", 2).alias("price_per_m2"),
        F.round("difference_with_subject_pct", 2).alias("difference_with_subject_pct"),
    )


def place_list(places: DataFrame, place: str = "place") -> DataFrame:
    """Places once whatever their case, sorted without regard to accents."""
    name = strip(place)
    named = places.select(name.alias("place")).where(F.col("place") != "").withColumn("_key", F.lower("place"))
    kept = first_per_key(named, ["_key"], [F.col("place")])
    return kept.withColumn("sort_key", strip_accents(F.col("_key"))).orderBy("sort_key", "place").select("place", "sort_key")


SHOWN_PLACES = 5


def selection_summary(places: Column, n: int = SHOWN_PLACES) -> Column:
    """``7 gemeenten geselecteerd: a, b … en nog 2 gemeenten``."""
    count = F.size(places)
    head = F.concat(count.cast("string"), F.lit(" gemeenten geselecteerd"))
    shown = F.concat(head, F.lit(": "), F.array_join(F.slice(places, 1, n), ", "))
    rest = F.concat(shown, F.lit(" en nog "), (count - n).cast("string"), F.lit(" gemeenten"))
    return F.when(count == 0, head).when(count > n, rest).otherwise(shown)


def selection_summaries(places: DataFrame, key: str, place: str, n: int = SHOWN_PLACES) -> DataFrame:
    """``selection_summary`` per key of distinct (key, place): places are counted, and only the first ``n`` are gathered."""
    counts = places.groupBy(key).agg(F.count(place).alias("_count"))
    first = top_n_per_key(places.where(F.col(place).isNotNull()), [key], [F.col(place)], n, "_no")
    named = first.groupBy(key).agg(F.sort_array(F.collect_list(place)).alias("_first"))
    joined = counts.join(named, key, "left")
    head = F.concat(F.col("_count").cast("string"), F.lit(" gemeenten geselecteerd"))
    shown = F.concat(head, F.lit(": "), F.array_join("_first", ", "))
    rest = F.concat(shown, F.lit(" en nog "), (F.col("_count") - n).cast("string"), F.lit(" gemeenten"))
    summary = F.when(F.col("_count") == 0, head).when(F.col("_count") > n, rest).otherwise(shown)
    return joined.select(key, summary.alias("summary"))


# --- run counters ------------------------------------------------------------------------------


def scan_summary(items: DataFrame, by: list[str]) -> DataFrame:
    """Per run: full, partial and failed imports and the mean import time."""
    ok = F.col("import_status").isin("fully_imported", "partially_imported")
    timed = items.withColumn("_seconds", F.when(ok, F.col("import_seconds")))
    return timed.groupBy(*by).agg(
        F.count(F.lit(1)).alias("listings_found"),
        F.count_if(F.col("import_status") == "fully_imported").alias("fully_imported"),
        F.count_if(F.col("import_status") == "partially_imported").alias("partially_imported"),
        F.count_if(~F.coalesce(ok, F.lit(False))).alias("listings_failed"),
        F.coalesce(F.round(exact_mean("_seconds", 3), 3), F.lit(0.0)).alias("average_import_seconds"),
    )


def scan_overview(summaries: DataFrame) -> DataFrame:
    """All runs together; import time weighted by imported listings."""
    imported = F.col("fully_imported") + F.col("partially_imported")
    return summaries.agg(
        F.sum("listings_found").alias("listings_found"),
        F.sum("fully_imported").alias("fully_imported"),
        F.sum("partially_imported").alias("partially_imported"),
        F.sum("listings_failed").alias("listings_failed"),
        F.coalesce(
            F.round(F.try_divide(F.sum(F.col("average_import_seconds") * imported), F.sum(imported)), 3), F.lit(0.0)
        ).alias("average_import_seconds"),
    )


def cycle_totals(runs: DataFrame) -> DataFrame:
    """Totals of one cycle over all sources; fine when any source is."""
    ok = F.col("status") == "completed"
    return runs.agg(
        F.count_if(ok).alias("sources_ok"),
        F.count_if(~ok).alias("sources_failed"),
        F.coalesce(F.sum("items_found"), F.lit(0)).alias("items_found"),
        F.coalesce(F.sum("items_new"), F.lit(0)).alias("items_new"),
        F.coalesce(F.sum("items_changed"), F.lit(0)).alias("items_changed"),
        F.bool_or(ok).alias("cycle_ok"),
    )


def ingest_counters(results: DataFrame, by: list[str]) -> DataFrame:
    """Counters over ingest results (``success``, ``skipped_existing``, ``change_type``, ``reported_found``)."""
    kept = F.col("success") & ~F.col("skipped_existing")
    return results.groupBy(*by).agg(
        F.greatest(F.count(F.lit(1)), F.max("reported_found")).alias("found"),
        F.count_if(kept).alias("imported"),
        F.count_if(~F.col("success")).alias("failed"),
        F.count_if(F.col("success") & F.col("skipped_existing")).alias("duplicates_skipped"),
        F.count_if(kept & (F.col("change_type") == "new_listing")).alias("new"),
        F.count_if(kept & ~F.col("change_type").isin("new_listing", "unchanged")).alias("changed"),
    )


def scan_report_by_city(results: DataFrame) -> DataFrame:
    """Per city and in total: found, imported, new, changed, unchanged, failed, with reductions."""
    rolled = results.rollup("city").agg(
        F.grouping("city").cast("int").alias("is_total"),
        F.sum("found").alias("found"),
        F.sum("imported").alias("imported"),
        F.sum("new").alias("new"),
        F.sum("changed").alias("changed"),
        F.sum("failed").alias("failed"),
        F.sum("reductions").alias("reductions"),
    )
    unchanged = F.greatest(F.lit(0), F.col("imported") - F.col("new") - F.col("changed"))
    return rolled.withColumn("unchanged", unchanged)


# --- assembled details and whole pages ---------------------------------------------------------

def newest_children(rows: DataFrame, key: str, order: list[str], n: int, name: str, columns: list[str]) -> DataFrame:
    """Newest ``n`` child rows per key as an array; older ones never reach the shuffle."""
    newest = top_n_per_key(rows, [key], [F.col(c).desc() for c in order], n, "_no")
    return newest.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_no", *columns))).alias(name))


def property_detail(
    properties: DataFrame, analyses: DataFrame, transactions: DataFrame, permits: DataFrame, labels: DataFrame, key: str,
    n_transactions: int, n_permits: int, n_labels: int,
) -> DataFrame:
    """Property with its newest analysis and as many of its newest transactions, permits and labels as are asked for."""
    latest = first_per_key(analyses, [key], [F.col("created_at").desc(), F.col("analysis_id").desc()])
    return (
        properties.join(latest.select(key, "analysis_id", "investment_score"), key, "left")
        .join(newest_children(transactions, key, ["sale_date", "sale_id"], n_transactions, "transactions", ["sale_id", "sale_date", "price"]), key, "left")
        .join(newest_children(permits, key, ["application_date", "permit_id"], n_permits, "permits", ["permit_id", "status"]), key, "left")
        .join(newest_children(labels, key, ["registered_on", "label_id"], n_labels, "energy_labels", ["label_id"]), key, "left")
    )


def dashboard_result(runs: DataFrame, sources: DataFrame, candidates: DataFrame) -> DataFrame:
    """Head row of the dashboard: newest completed run, its source, counters and average scores of the
    candidates that were detected while it ran."""
    head = latest_completed_run(runs).select("source_id", "run_id", "started_at", "completed_at", "items_found", "items_new", "items_changed")
    named = head.join(sources.select("source_id", "source_name"), "source_id", "left")
    window = head.select(F.struct("started_at", "completed_at").alias("w")).scalar()
    seen = candidates.withColumn("_w", window)
    shown = within_scan_window(seen, F.col("_w.started_at"), F.col("_w.completed_at"))
    scores = shown.agg(
        F.struct(
            F.count(F.lit(1)).alias("rows"),
            F.coalesce(F.round(F.avg("investment_score"), 2), F.lit(0.0)).alias("investment"),
            F.coalesce(F.round(F.avg("hidden_value_score"), 2), F.lit(0.0)).alias("opportunity"),
        ).alias("s")
    ).scalar()
    return named.withColumn("_s", scores).select(
        "run_id",
        F.coalesce("completed_at", "started_at").alias("scan_timestamp"),
        F.array_distinct(F.array_compact(F.array("source_name"))).alias("source_names"),
        "items_found",
        "items_new",
        "items_changed",
        F.col("_s.rows").alias("property_count"),
        F.col("_s.investment").alias("average_investment_score"),
        F.col("_s.opportunity").alias("average_opportunity_score"),
    )
