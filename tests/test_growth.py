"""What keeps cost in proportion to the input: rows over all cores, each page, document and score read once."""

from __future__ import annotations

import re

import pytest

from woonvonk.plans import catalog
from woonvonk.plans.views import view

SF = "/root/testdata/sf0.001"


def plan(spark, name):
    return catalog.jobs()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()


@pytest.fixture(autouse=True)
def whole_plans(spark):
    before = spark.conf.get("spark.sql.debug.maxToStringFields"), spark.conf.get("spark.sql.maxPlanStringLength")
    spark.conf.set("spark.sql.debug.maxToStringFields", "100000")
    spark.conf.set("spark.sql.maxPlanStringLength", "200000000")
    yield
    spark.conf.set("spark.sql.debug.maxToStringFields", before[0])
    spark.conf.set("spark.sql.maxPlanStringLength", before[1])


@pytest.mark.parametrize("name", ["listings", "portal_pages", "card_pages"])
def test_listings_are_dealt_over_the_cores(spark, name):
    assert view(spark, SF, name).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_html_fallback_picks_a_page_once(spark):
    assert plan(spark, "extract_html_fallback").count("Relation [") == 1


def test_analysis_permits_parse_a_document_once(spark):
    assert plan(spark, "explode_analysis_permits").count("from_json(") <= 1


def test_jsonld_reads_a_path_once(spark):
    assert plan(spark, "extract_jsonld").count("get_json_object(") <= 16


def test_analysis_tables_parse_a_document_once_each(spark):
    assert plan(spark, "explode_analysis").count("from_json(") <= 5


def test_analysis_tables_share_one_parse(spark):
    assert plan(spark, "explode_analysis").count("from_json(") == 0  # it reads the documents parsed before


@pytest.mark.parametrize("name", ["factor_contributions", "weighted_score"])
def test_factor_rows_make_no_texts(spark, name):
    text = plan(spark, name)
    assert "format_string(" not in text and "array_sort(" not in text


def test_cards_are_searched_once(spark):
    assert plan(spark, "listing_cards").count("regexp_extract_all(html") + plan(spark, "listing_cards").count("size(transform(") <= 1


def test_merged_pages_decode_each_text_once(spark):
    # one table of character references per step that decodes: share tags, picked elements, postcode, lines, title
    text = plan(spark, "merge_extractions")
    assert text.count("CounterClockwiseContourIntegral") <= 10
    assert text.count("regexp_extract_all(html") <= 2


def test_both_batches_of_enrichments_come_from_one_matching(spark, monkeypatch):
    from woonvonk.sources import tables

    batches = []
    real = tables.append_enrichments
    monkeypatch.setattr(tables, "append_enrichments", lambda items, path: batches.append(items.inputFiles()) or real(items, path))
    found = catalog.jobs()["append_enrichments"](spark, SF)
    assert batches == [[], []] and found.count() == 39


def test_groups_of_ordinary_size_are_ranked_by_one_window(spark):
    from woonvonk.operators.skew import value_ranks

    df = spark.range(200).selectExpr("id % 20 AS k", "cast(id AS double) AS v")
    ranks = value_ranks(df, ["k"], "v", window_rows=50)  # more values than that in all, ten in a group
    assert "percentile_approx" not in ranks._jdf.queryExecution().optimizedPlan().toString()
    mixed = df.union(spark.range(300).selectExpr("NULL AS k", "cast(id % 60 AS double) AS v"))
    small, plain = (sorted(map(repr, value_ranks(mixed, ["k"], "v", window_rows=w).collect())) for w in (50, 10**6))
    assert small == plain


def test_valuation_reads_no_subjects_for_its_medians(spark):
    assert plan(spark, "comps_valuation").count("Join ") == 1


@pytest.mark.parametrize("name", ["enrichment_group_stats", "enrichment_pivot", "opportunity_rules", "opportunity_missing_data", "opportunity_rollup"])
def test_generated_methods_are_short_enough_for_the_jvm_to_compile(spark, name):
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        planned = catalog.jobs()[name](spark, SF)._jdf.queryExecution().executedPlan()
        code = getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package").codegenString(planned)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    assert max(map(int, re.findall(r"maxMethodCodeSize:(\d+)", code))) <= 8000


def test_pivot_looks_at_one_key_per_row(spark):
    assert plan(spark, "enrichment_pivot").count("max_by(") <= 4  # 42 when every key had its own


def test_tidy_records_read_like_untidy_ones(spark):
    from pyspark.sql import functions as F

    from woonvonk.functions.text import LOOSE_POSTCODE, compact_postcode, normalize_identifier, squash
    from woonvonk.operators import register

    odd = [None, "", " ", "a  b", " a", "b ", "Dorps Straat", "a\tb", "caf\u00e9\u00a0x", "1234 ab", "1234 AB ", "1234\tab", "01234 abc", "0012", "000", "12\n", "-12", "a1"]
    df = spark.createDataFrame([(v,) for v in odd], "v string")
    pairs = [
        (register._text("v"), F.coalesce(F.lower(squash("v")), F.lit(""))),
        (register._postcode("v"), compact_postcode("v", LOOSE_POSTCODE)),
        (register._identifier("v"), normalize_identifier("v")),
    ]
    for fast, plain in pairs:
        assert df.where(~fast.eqNullSafe(plain)).count() == 0


def test_deal_rows_look_at_snapshots_once(spark):
    text = plan(spark, "deal_rows")
    assert text.count("Relation [l_") == 1  # three when counts, steps and the oldest day had a pass each
    assert text.index("Join Inner") < text.index("array_join(")  # prices are put into words per listing, not per candidate


def test_listing_counts_as_often_as_it_has_candidates(spark):
    from pyspark.sql import functions as F

    from woonvonk.operators import deals, reports, scoring
    from woonvonk.plans.history_queries import ORDER

    listings, sources, snapshots = (view(spark, SF, n) for n in ("listings", "sources", "snapshots"))
    named = view(spark, SF, "candidates").withColumn("listing_id", F.expr("CASE WHEN candidate_id % 7 = 0 THEN 3 WHEN candidate_id % 11 = 0 THEN -5 WHEN candidate_id % 13 <> 0 THEN listing_id END"))
    odd = named.withColumn("investment_score", F.expr("CASE WHEN candidate_id % 5 > 0 THEN investment_score * 2 - 40 END"))
    got = deals.deal_rows(odd, listings, sources, snapshots.where("false"), ORDER, F.lit("2001-08-01").cast("date"), 25)
    rows = reports.build_rows(reports.candidates_with_listing(odd, listings, sources)).withColumnsRenamed({**deals.NAMES, "opportunity_score": "deal_score"})
    rows = rows.withColumn("price_reduction_count", F.coalesce("price_reduction_count", F.lit(0)))
    expected = scoring.score_deal_rows(rows)
    shared = sorted(expected.columns)
    assert set(shared) <= set(got.columns)
    old, new = (sorted(map(repr, df.select(shared).collect())) for df in (expected, got))
    assert old == new and any("listing_id=-5" in r for r in old) and len(old) == odd.where("listing_id IS NOT NULL").count()


@pytest.fixture
def parts(spark, tmp_path):
    """A folder with a table of parts: one comes twice, one has no key, one nothing but its key."""
    rows = [(k, f"part {k}", f"Brand#{k % 5}", "ECONOMY", 1 + k % 50, 900.0 + k) for k in range(1, 121)]
    rows += [(7, "part 7", "Brand#2", "ECONOMY", 8, 907.0), (None, "no key", "Brand#1", "SMALL", 4, 900.0), (500, None, None, None, None, None)]
    shape = "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double"
    spark.createDataFrame(rows, shape).coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    return str(tmp_path)


def test_source_texts_are_not_sent_to_every_task(spark, parts):
    found = catalog.jobs()["analysis_validation"](spark, parts)
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    ids = [r.listing_id for r in found.collect()]
    assert sorted(ids) == sorted([*range(1, 121), 7, 7, 7, 500])  # a key that comes twice meets its two texts


def test_analysis_gives_the_rows_of_its_five_tables(spark, parts):
    from collections import Counter

    found = catalog.jobs()["explode_analysis"](spark, parts).collect()
    rows = [r for r in found if r.row_count is None]
    counts = {r.table_name: r.row_count for r in found if r.row_count is not None}
    assert counts == Counter(r.table_name for r in rows) and len(counts) == 5
    permits = Counter((r.listing_id, r.is_active) for r in rows if r.table_name == "permits")
    assert permits[6, True] == 1 and permits[6, False] == 0 and permits[2, False] == 1 and permits[7, False] == 0
    labels = {(r.label, r.is_current) for r in rows if r.table_name == "energy_labels" and r.listing_id == 3}
    assert labels == {("G", False), ("C", True)}
    assert [r.title for r in rows if r.table_name == "properties" and r.listing_id == 7] == ["part 7"] * 4
