"""Files, feeds, documents and pages."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from woonvonk.sources import documents, ingest, pages


def test_csv_rows_without_source_are_rejected(spark, tmp_path):
    path = tmp_path / "listings.csv"
    path.write_text("record_no, source_name ,source_url,city,asking_price,extra\n2, portal , https://a.example/1 ,Utrecht,250000,x\n3,,,Breda,,y\n")
    df = ingest.read_csv(spark, str(path))
    good = ingest.accepted(df).first()
    assert (good.source_name, good.source_url, good.asking_price, good.listing_status) == ("portal", "https://a.example/1", 250000.0, "active")
    assert ingest.rejected(df).first().warning == "Row 3: missing required fields: source_name, source_url"


def test_json_documents(spark, tmp_path):
    path = tmp_path / "listings.json"
    path.write_text(json.dumps([{"record_no": 1, "source_name": "a", "source_url": "https://a.example/1", "asking_price": 5}, {"record_no": 2, "title": "x"}]))
    rows = ingest.read_json(spark, str(path), multi_line=True).orderBy("record_no").collect()
    assert rows[0].asking_price == 5.0 and rows[0].warning is None
    assert rows[1].warning == "Item 2: missing required fields: source_name, source_url"


def test_feed_choice_is_by_presence(spark):
    bodies = [('{"results": [{"kop": null, "title": "t", "price": 7}], "data": [{"id": 1}]}',), ('[{"name": "n"}, 3]',), ('{"x": 1}',)]
    items = ingest.feed_items(spark.createDataFrame(bodies, "body string"))
    got = ingest.map_feed_items(items, {"title": "kop"}).select("title", "asking_price").collect()
    assert sorted(map(tuple, got), key=str) == [("n", None), (None, "7")]


def test_one_bad_record_does_not_fail_the_batch(spark):
    rows = spark.createDataFrame([(1, None, "12"), (2, "https://a.example/x/", "abc")], "record_no int, url string, asking_price string")
    got = ingest.normalize_records(rows, "feed").orderBy("record_no").collect()
    assert not got[0].success and got[0].listing is None and "source_url" in got[0].error
    assert got[1].listing.external_listing_id == "https://a.example/x" and got[1].listing.asking_price is None


PAGE = """<html><head><title>Kerkstraat 5 | Makelaar</title>
<script type="application/ld+json">{"broken": </script>
<script type="application/ld+json">[{"@type": "WebSite", "name": "Site"}, {"@graph": [{"@type": "House", "name": "Kerkstraat 5",
 "address": {"streetAddress": "Kerkstraat 5", "postalCode": "1017gc", "addressLocality": "Amsterdam"}, "offers": [{"price": "450.000"}], "floorSize": {"value": 84}}]}]</script>
<meta property="og:image" content="https://img.example/1.jpg"></head>
<body><div class="object-price"><div>€ 1</div><div>nul</div> ton</div><dl><dt>Aantal slaapkamers</dt><dd>3</dd><dt>Bouwjaar</dt><dd>1931</dd></dl>
<a rel="next" href="?page=2">Volgende</a><a href="../detail/koop/huis-12345/#x">x</a></body></html>"""


def test_page_extraction(spark):
    df = spark.createDataFrame([(1, "https://m.example/aanbod/kerkstraat-5", PAGE)], "page_id int, url string, html string")
    got = pages.merge_extractions(df).first()
    assert (got.title, got.address, got.asking_price, got.surface_m2) == ("Kerkstraat 5", "Kerkstraat 5, 1017 GC, Amsterdam", 450000.0, 84.0)
    assert got.extraction_method == "json_ld" and got.warnings == ["Malformed JSON-LD block ignored."]
    assert got.images == ["https://img.example/1.jpg"]
    picked = pages.with_picked(df).first()
    assert picked.picked_price == "€ 1 nul ton"
    record = pages.portal_record(df).first()
    assert (record.bedrooms, record.construction_year, record.asking_price_status) == (3, 1931, "known")
    assert df.select(pages.next_page("html", "url").alias("n")).first().n == "https://m.example/aanbod/kerkstraat-5?page=2"


def test_page_without_anything(spark):
    df = spark.createDataFrame([(1, "https://m.example/", ""), (2, "https://m.example/", None)], "page_id int, url string, html string")
    got = pages.merge_extractions(df).collect()
    assert [r.success for r in got] == [False, False]
    assert all(r.extraction_method == "none" and "No useful metadata could be extracted." in (r.warnings or []) for r in got if r.page_id == 1)


def test_analysis_documents(spark):
    good = {k: [] for k in documents.REQUIRED_KEYS}
    good |= {
        "investment_score": 70, "analysis_confidence_score": 50, "property_summary": None, "recommendation": "koop",
        "score_breakdown": {p: 5 for p in documents.SCORE_PARTS}, "extracted_data": {"asking_price_status": "raar"},
    }
    bad = dict(good, investment_score="hoog")
    rows = [(1, json.dumps(good), "Vraagprijs € 350.000 k.k."), (2, json.dumps(bad), ""), (3, "[1]", ""), (4, json.dumps({"risks": []}), "")]
    got = {r.id: r for r in documents.validate_analyses(spark.createDataFrame(rows, "id int, body string, source_text string")).collect()}
    assert got[1].error is None and got[1].asking_price == 350000.0 and got[1].asking_price_status == "unknown"
    assert got[2].error == "investment_score is not an integer" and got[3].error == "no JSON object"
    assert got[4].error.startswith("missing fields: analysis_confidence_score, assumptions")


def _parsed(spark, *extracted):
    """Valid analyses with the given extracted data, one per id."""
    body = {k: [] for k in documents.REQUIRED_KEYS} | {"investment_score": 70, "analysis_confidence_score": 50, "property_summary": "kort", "recommendation": "koop", "risks": ["vocht"]}
    body |= {"score_breakdown": {p: 5 for p in documents.SCORE_PARTS}}
    rows = [(i, json.dumps(body | {"extracted_data": data}), "") for i, data in extracted]
    return documents.validate_analyses(spark.createDataFrame(rows, "id int, body string, source_text string")).where("error is null")


def test_analysis_tables_have_all_that_a_document_says(spark):
    sale = {"transaction_date": "2000-05-01", "transaction_type": "sale", "transaction_price": 5.5, "source_url": "https://a.example", "notes": "n"}
    permit = {"reference_number": "R", "status": "granted", "authority": "Breda", "investment_relevance": "hoog"}
    data = {"country": "NL", "surface_m2": 84, "days_on_market": "veel", "listed_since": "2001-02-03", "previous_transactions": [sale], "active_permits": [permit]}
    found = {n: t.first() for n, t in documents.explode_analyses(_parsed(spark, (1, data)), "id").items()}
    home, analysis = found["properties"], found["analyses"]
    assert (home.country, home.surface_m2, home.days_on_market, str(home.listed_since)) == ("NL", 84.0, None, "2001-02-03")
    assert (home.listing_status, home.price_reduction_count, home.listing_history_confidence) == ("unknown", 0, "unknown")
    assert (analysis.property_summary, analysis.analysis_confidence_score, analysis.risks, analysis.strengths) == ("kort", 50, '["vocht"]', "[]")
    assert json.loads(analysis.score_breakdown) == {p: 5 for p in documents.SCORE_PARTS}
    assert (found["transactions"].price_status, found["transactions"].source_url, found["transactions"].notes) == ("unknown", "https://a.example", "n")
    assert (found["permits"].authority, found["permits"].confidence, found["permits"].affects_investment_case) == ("Breda", "unknown", False)
    assert found["energy_labels"] is None


def test_analysis_gives_a_permit_once(spark):
    def permit(no, status, day="1999-03-02"):
        return {"reference_number": no, "application_date": day, "status": status}

    data = {
        "permits_last_10_years": [permit("A", "granted"), permit("A", "pending"), permit("B", "granted"), permit(None, "lapsed", None), permit("A", "granted", "geen datum"), None],
        "active_permits": [permit("B", "pending"), permit("B", "granted"), permit("C", "pending")],
    }
    parsed = _parsed(spark, (1, data), (2, {"active_permits": [permit("A", "pending")]}), (3, {}))
    once = documents.explode_analyses(parsed, "id", distinct_permits=True)["permits"].collect()
    got = sorted((r.id, str(r.reference_number), str(r.application_date), r.status, r.is_active) for r in once)
    assert got == [
        (1, "A", "1999-03-02", "granted", False), (1, "A", "None", "granted", False), (1, "B", "1999-03-02", "pending", True), (1, "C", "1999-03-02", "pending", True),
        (1, "None", "None", "lapsed", False), (2, "A", "1999-03-02", "pending", True),
    ]
    assert documents.explode_analyses(parsed, "id")["permits"].count() == 10


def test_arriving_label_retires_the_stored_ones(spark):
    shape = "id int, label string, raw_value string, source string, is_current boolean"
    stored = spark.createDataFrame([(1, "G", "G", "r", True), (1, "H", "H", "r", False), (2, "F", "F", "r", True), (2, "Z", "Z", "r", False), (3, "E", "E", "r", False), (5, "D", "D", "r", False)], shape)
    arriving = documents.explode_analyses(_parsed(spark, (1, {"energy_label": "A"}), (1, {"energy_label": "B"}), (3, {"energy_label": " C "}), (4, {"energy_label": "A"}), (4, {"energy_label": "A"}), (2, {"energy_label": " "})), "id")
    got = documents.current_labels(stored, arriving["energy_labels"], "id").collect()
    assert sorted((r.id, r.raw_value) for r in got if r.is_current) == [(1, "B"), (2, "F"), (3, " C "), (4, "A")]
    assert len(got) == 11 and {r.label for r in got if r.id == 3} == {"E", "C"}


def test_newest_report(spark, tmp_path):
    path = str(tmp_path / "runs")
    shape = "source string, run_id string, status string, properties array<struct<record_index:bigint,property:struct<listing_id:string>>>"
    for run in ("1", "2"):
        documents.write_scan_reports(spark.createDataFrame([("a", run, "completed", [(1, ("x",)), (2, (None,))])], shape), path)
    reports = documents.read_scan_runs(spark, path)
    assert documents.newest_report(reports).first().run_id in ("1", "2") and reports.count() == 2
    assert documents.report_properties(reports).count() == 2
    assert reports.where(F.col("source") == "a").count() == 2
