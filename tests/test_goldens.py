"""Small inputs with known answers."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from woonvonk.functions import bands, casts, dates, finance, numbers, text
from woonvonk.operators import enrichment, history, investment, opportunity, register, reports, scoring
from woonvonk.operators.benchmarks import leave_one_out

ORDER = ["observed_at", "snapshot_seq"]


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def snapshots(spark, rows):
    data = [(1, dt.datetime(2024, m, d), i, price, status) for i, (m, d, price, status) in enumerate(rows)]
    return spark.createDataFrame(
        data, "listing_id bigint, observed_at timestamp, snapshot_seq int, asking_price double, listing_status string"
    )


def test_history_of_two_drops(spark):
    rows = snapshots(spark, [(1, 1, 100000.0, "active"), (1, 11, 95000.0, "active"), (1, 21, 90000.0, "active")])
    h = history.listing_history(rows, ORDER).first()
    assert (h.days_on_market, h.total_price_reduction, h.total_price_reduction_percentage) == (20, 10000.0, 10.0)
    assert (h.price_change_count, h.snapshot_count, h.reduction_frequency) == (2, 3, 3.0)
    assert [r.point_no for r in history.price_points(rows, ORDER).orderBy("point_no").collect()] == [1, 2, 3]


def test_relisted_after_withdrawal(spark):
    rows = snapshots(spark, [(2, 1, 100000.0, "withdrawn"), (2, 18, 100000.0, "active")])
    h = history.listing_history(rows, ORDER).first()
    assert h.recently_relisted and h.relisted_date == dt.date(2024, 2, 18)
    old = snapshots(spark, [(1, 1, 1.0, "sold"), (12, 1, 1.0, "active")])
    assert not history.relisting(old, ORDER).first().recently_relisted


def test_missing_prices_are_skipped(spark):
    rows = snapshots(spark, [(1, 1, 10.0, "active"), (1, 2, None, "active"), (1, 3, 10.0, "active"), (1, 4, 8.0, "active")])
    counts = history.price_change_counts(rows, ORDER).first()
    assert (counts.price_change_count, counts.reduction_count) == (1, 1)
    found = history.price_reductions(rows, ORDER).collect()
    assert [(r.old_price, r.new_price, r.reduction_percentage) for r in found] == [(10.0, 8.0, 20.0)]


def test_change_kinds(spark):
    rows = snapshots(
        spark,
        [(1, 1, 10.0, "active"), (1, 2, 10.0, "active"), (1, 3, 9.0, "active"), (1, 4, 9.0, "sold"), (1, 5, 9.0, "active")],
    )
    kinds = history.snapshot_changes(rows, ORDER, ["asking_price", "listing_status"]).orderBy("snapshot_seq").collect()
    assert [(r.snapshot_seq, r.change_type) for r in kinds] == [
        (0, "new_listing"), (2, "asking_price_change"), (3, "listing_status_change"), (4, "relisting_signal"),
    ]


def test_previous_prices(spark):
    rows = snapshots(spark, [(1, d, p, "active") for d, p in enumerate([300.0, 300.0, 0.0, 280.0, 300.0, 250.0], 1)])
    current = spark.createDataFrame([(1, 280.0)], "listing_id bigint, current_price double")
    got = history.previous_prices(rows, current, ORDER).orderBy("step_no").collect()
    assert [r.price for r in got] == [300.0]


def test_urls_and_addresses(spark):
    row = one(
        spark,
        text.normalize_url(F.lit("HTTPS://EXAMPLE.COM/Listing/3/")).alias("url"),
        text.normalize_url(F.lit("geen url")).alias("none"),
        text.address_components(F.lit("Prinsengracht 123-A, 1015 cj Amsterdam")).alias("a"),
        text.source_domain(F.lit("https://user@www.portaal.co.nl:8080/x")).alias("domain"),
        text.register_address(F.lit("Kerkstraat 12 B"), F.lit("1017GC")).alias("r"),
    )
    assert row.url == "https://example.com/Listing/3" and row.none == ""
    assert (row.a.postcode, row.a.house_number, row.a.addition) == ("1015CJ", "123", "-a")
    assert row.domain == "co.nl"
    assert (row.r.street_name, row.r.house_number, row.r.house_letter) == ("Kerkstraat", 12, "B")


def test_numbers_and_dates(spark):
    row = one(
        spark,
        *[numbers.parse_number_eu(F.lit(x)).alias(f"eu{i}") for i, x in enumerate(["1.234.567,8", "1,234.5", "12,5", "450.000"])],
        numbers.parse_number_nl(F.lit("450000.00")).alias("nl"),
        numbers.parse_price(F.lit("Vanaf € 250.000")).alias("p"),
        dates.parse_date(F.lit("sinds 3 maart 2021")).alias("d"),
        dates.parse_date(F.lit("31 februari 2021")).alias("bad"),
        casts.to_int(F.lit("-3.7")).alias("i"),
        casts.clamp_score(F.lit(20.5)).alias("half"),
        text.normalize_identifier(F.lit("00363")).alias("id"),
        text.normalize_identifier(F.lit("000")).alias("zero"),
    )
    assert [row.eu0, row.eu1, row.eu2, row.eu3] == [1234567.8, 1234.5, 12.5, 450000.0]
    assert row.nl == 45000000.0 and (row.p.amount, row.p.status) == (250000.0, "from_price")
    assert row.d == dt.date(2021, 3, 3) and row.bad is None and row.i == -3 and row.half == 20
    assert (row.id, row.zero) == ("363", "0")


def test_money(spark):
    row = one(
        spark,
        finance.woz_difference(F.lit(500000.0), F.lit(400000.0)).alias("w"),
        finance.woz_difference(F.lit(500000.0), F.lit(0.0)).alias("w0"),
        finance.price_per_m2(F.lit(300000.0), F.lit(100.0), F.lit("on_request")).alias("hidden"),
        finance.discount_ratio(F.lit(3000.0), F.lit(4000.0)).alias("discount"),
        finance.max_purchase_price(F.lit(12000.0), F.lit(6.0), F.lit(0.0), F.lit(0.0)).alias("ceiling"),
        finance.yield_pct(F.lit(None).cast("double"), F.lit(0.065)).alias("y"),
    )
    assert tuple(row.w) == (100000.0, 25.0) and tuple(row.w0) == (None, None)
    assert row.hidden is None and row.discount == 0.25 and row.ceiling == 200000.0 and abs(row.y - 6.5) < 1e-9


def test_recommendation_bands(spark):
    got = spark.createDataFrame([(90,), (75,), (60,), (45,), (10,)], "s int").select(bands.stars("s").alias("x")).collect()
    assert [r.x.count("★") for r in got] == [5, 4, 3, 2, 1]


def listing(**given):
    base = dict(
        listing_id=1, title="Titel", address="Straat 1", city="Utrecht", asking_price=300000.0, surface_m2=100.0, property_type="Appartement",
        description="Mooi", price_per_m2=3000.0, days_on_market=120, price_reduction_count=2, investment_score=82, yield_pct=None,
    )
    return {**base, **given}


RANK_SCHEMA = (
    "listing_id bigint, title string, address string, city string, asking_price double, surface_m2 double, property_type string, "
    "description string, price_per_m2 double, days_on_market int, price_reduction_count int, investment_score int, yield_pct double"
)


def test_rank_listing_golden(spark):
    ranked = scoring.rank_listing(spark.createDataFrame([listing()], RANK_SCHEMA)).first()
    assert (ranked.candidate_score, ranked.priority) == (99, "urgent") and ranked.missing_data == []
    empty = {k: None for k in listing() if k != "listing_id"}
    bare = scoring.rank_listing(spark.createDataFrame([listing(**empty)], RANK_SCHEMA)).first()
    assert bare.candidate_score == 0 and len(bare.missing_data) == 7


DEAL_SCHEMA = (
    "listing_id bigint, city string, asking_price double, surface_m2 double, plot_size_m2 double, bedrooms int, energy_label string, "
    "construction_year int, days_on_market int, price_reduction_count int, neighborhood_m2_price_average double, "
    "permit_history_count int, investment_score int"
)


def test_deal_rows_keep_given_score_and_find_discount(spark):
    rows = [
        (1, "Utrecht", 300000.0, 100.0, None, 3, "A", 1990, 10, 0, 4000.0, 1, 130),
        (2, "utrecht ", 500000.0, 100.0, None, 3, "A", 1990, 10, 0, None, 1, None),
        (3, None, None, None, None, None, None, None, None, None, None, None, None),
    ]
    got = {r.listing_id: r for r in scoring.score_deal_rows(spark.createDataFrame(rows, DEAL_SCHEMA)).collect()}
    assert (got[1].price_per_m2, got[1].discount_percentage, got[1].market_discount_score) == (3000.0, 25.0, 25)
    assert got[1].is_market_discount_highlight and got[1].investment_score == 100
    assert got[1].city_avg_price_per_m2 == 4000.0 and got[1].difference_vs_city_avg_pct == -25.0
    assert (got[1].price_per_m2_percentile, got[2].price_per_m2_percentile) == (50.0, 0.0)
    assert got[3].price_per_m2 is None and got[3].investment_score == 0 and got[3].investment_recommendation == "★ Avoid"


PROPERTY_SCHEMA = (
    "listing_id bigint, source_url string, asking_price double, surface_m2 double, plot_size_m2 double, bedrooms int, energy_label string, "
    "construction_year int, property_type string, latest_woz_value double, neighborhood_m2_price_average double, description string, raw_text string"
)


def test_investment_neutral_without_data(spark):
    rows = spark.createDataFrame([(1, *[None] * 12)], PROPERTY_SCHEMA)
    got = investment.evaluate(rows, 2026).first()
    assert (got.overall_score, got.attractiveness) == (50, "Medium")
    assert "could not be calculated" in got.explanation


def test_leave_one_out(spark):
    rows = spark.createDataFrame([(1, 3600.0), (2, 4000.0), (3, 5000.0), (4, None)], "id int, price_per_m2 double")
    got = {r.id: (r.peer_average, r.peer_average_size) for r in leave_one_out(rows).collect()}
    assert got[1] == (4500.0, 3) and got[4] == (4200.0, 3)


def test_type_words_first_hit_wins(spark):
    rows = [(i, None, None, None, None, None, None, None, t, None, None, None, None) for i, t in enumerate(["Halfvrijstaand", "semi-detached", "Hoekwoning", "Loft"])]
    got = investment.evaluate(spark.createDataFrame(rows, PROPERTY_SCHEMA), 2026).orderBy("listing_id").collect()
    assert [r.property_type_score for r in got] == [92, 92, 80, 65]


def test_opportunities(spark):
    rows = [
        (1, None, 400000.0, 200.0, 700.0, 6, "g", 1930, "Vrijstaande woning", None, None, "Kluswoning met plat dak", "twee ingangen"),
        (2, None, 400000.0, 40.0, None, 1, "a", 2015, "Studio", None, None, None, None),
    ]
    rated = investment.evaluate(spark.createDataFrame(rows, PROPERTY_SCHEMA), 2026)
    got = {r.listing_id: r for r in opportunity.detect(opportunity.with_signals(rated)).collect()}
    kinds = [f.opportunity_type for f in got[1].findings]
    assert kinds[0] == "Possible Split Opportunity" and got[1].findings[0].confidence == 100
    assert got[1].opportunity_score == 100 and [f.confidence for f in got[1].findings] == sorted((f.confidence for f in got[1].findings), reverse=True)
    assert got[2].findings == [] and got[2].opportunity_score == 0 and "No clear opportunity" in got[2].summary


def test_register_prefers_same_letter_and_homes(spark):
    props = spark.createDataFrame([(1, "Dorpsstraat 7A", "1234 AB", "Utrecht", None, None)], "property_id int, address string, postal_code string, city string, preferred_address_id string, preferred_object_id string")
    schema = "property_id int, doc_no int, doc_type string, doc_postcode string, doc_number int, doc_letter string, doc_addition string, doc_street string, doc_city string, usage_purpose string, official_area double, address_id string, object_id string, relevance double"
    docs = [
        (1, 1, "adres", "1234AB", 7, "B", "", "Dorpsstraat", "Utrecht", "woonfunctie", 90.0, "0001", "2001", 9.0),
        (1, 2, "adres", "1234AB", 7, "A", "", "Dorpsstraat", "Utrecht", "woonfunctie", 82.0, "0002", "2002", 8.0),
        (1, 3, "adres", "1234AB", 7, "A", "", "Dorpsstraat", "Utrecht", "winkelfunctie", 70.0, "0003", "2003", 9.0),
    ]
    got = register.match_records(props, spark.createDataFrame(docs, schema)).first()
    assert (got.object_id, got.official_area, got.record_count, got.confidence_score) == ("2002", 82.0, 3, 95)
    assert got.quality_flags == ["multiple_possible_bag_matches"]
    none = register.match_records(props, spark.createDataFrame([], schema)).first()
    assert none.object_id is None and "bag_match_not_found" in none.quality_flags and none.confidence_score == 0


def test_area_metrics(spark):
    schema = "surface_m2 double, official_area double, usage_purpose string, confidence_score int, asking_price double, latest_woz_value double, quality_flags array<string>"
    rows = [(96.0, 100.0, "woonfunctie", 98, 750000.0, 650000.0, []), (96.0, 100.0, "woonfunctie", 45, 600000.0, None, ["x"]), (80.0, 100.0, "woonfunctie", 98, None, None, [])]
    got = register.area_metrics(spark.createDataFrame(rows, schema)).collect()
    assert (got[0].asking_price_per_m2, got[0].woz_value_per_m2, got[0].calculation_area_source) == (7500.0, 6500.0, "BAG")
    assert (got[1].asking_price_per_m2, got[1].calculation_area_source) == (6250.0, "Funda")
    assert got[2].quality_flags == ["funda_bag_area_difference_gt_10_pct"]


def test_enrichment_items(spark):
    rows = spark.createDataFrame([(1, "1234AB Straat 1", "Utrecht", None, 100.0, "Rijksmonument", "77")], "property_id int, address string, city string, asking_price double, surface_m2 double, description string, bag_id string")
    items = enrichment.fan_out(rows, "property_id")
    got = {r.enrichment_key: r for r in items.collect()}
    assert len(got) == 39 and got["bag_id"].success and not got["bag_pand_id"].success
    assert got["postal_code"].value == "1234 AB" and got["municipality"].value == "Utrecht"
    assert got["monument_status"].value == "monument" and got["street_m2_price_average"].value == "427500.0"
    wide = enrichment.pivot(items, "property_id", ["bag_id", "municipality"]).first()
    assert (wide.bag_id, wide.municipality) == ("77", "Utrecht")


def test_id_candidates(spark):
    got = one(
        spark,
        register.id_candidates(F.lit(None).cast("string"), F.lit("adr-12-034")).alias("a"),
        register.id_candidates(F.lit("x1"), F.lit("y2")).alias("b"),
        register.id_candidates(F.lit(""), F.lit(None).cast("string")).alias("c"),
    )
    assert (got.a, got.b, got.c) == (["034", "12"], ["x1", "y2"], [])


def test_filters_treat_missing_values_differently(spark):
    rows = spark.createDataFrame(
        [(1, None, None, "a", "b"), (2, 50, 10.0, "a", "b"), (3, 10, 99.0, "a", "b")],
        "id int, hidden_value_score int, asking_price double, title string, address string",
    )
    assert [r.id for r in reports.filter_candidates(rows, minimum_score=40).orderBy("id").collect()] == [1, 2]
    scored = rows.withColumnRenamed("hidden_value_score", "investment_score")
    assert [r.id for r in reports.filter_properties(scored, max_price=50).orderBy("id").collect()] == [1, 2]
    assert [r.id for r in reports.filter_rows(rows, max_price=50).collect()] == [2]
