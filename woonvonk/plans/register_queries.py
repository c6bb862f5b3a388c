"""Queries for register matching and enrichments."""

from __future__ import annotations

from pyspark.sql import functions as F

from woonvonk.operators import enrichment, register
from woonvonk.plans.registry import query
from woonvonk.plans.views import r2, view, with_views
from woonvonk.sources import tables

# Landed records: what the address search gave for each property, with some parts blurred.
DOCS = """
  SELECT d.property_id, d.doc_no, CASE WHEN d.doc_no % 6 = 0 THEN 'weg' ELSE 'adres' END AS doc_type,
    CASE WHEN d.doc_no % 5 = 0 THEN '9999 ZZ' ELSE concat(cast(1000 + d.property_id % 9000 as varchar(20)), ' AB') END AS doc_postcode,
    cast(CASE WHEN d.doc_no % 3 = 1 THEN 1 ELSE 1 + d.property_id % 200 END as int) AS doc_number,
    d.house_letter AS doc_letter, '' AS doc_addition,
    CASE WHEN d.doc_no % 2 = 0 THEN 'Small Widget' ELSE 'cold widget' END AS doc_street,
    'Brand#13' AS doc_city, d.usage_purpose, CASE WHEN d.doc_no % 13 = 0 THEN 0e0 ELSE d.official_area END AS official_area,
    concat('0', cast(d.doc_no * 100 + 7 as varchar(20))) AS address_id, cast(d.doc_no * 100 + 9 as varchar(20)) AS object_id,
    cast(d.doc_no % 10 as double) / 4e0 AS relevance, cast(1950 + d.doc_no % 70 as int) AS official_year
  FROM register_docs d"""

PROPS = """
  SELECT listing_id AS property_id, address, cast(NULL as varchar(20)) AS postal_code, city, surface_m2, asking_price, latest_woz_value AS own_woz, description,
    CASE WHEN listing_id % 4 = 0 THEN concat('0', cast((listing_id % 100) * 100 + 7 as varchar(20))) ELSE '' END AS preferred_address_id,
    CASE WHEN listing_id % 4 = 1 THEN concat('00', cast((listing_id % 100) * 100 + 9 as varchar(20))) ELSE NULL END AS preferred_object_id
  FROM listings"""


def _sql(spark, sf_dir, text, *names):
    body = text.replace("varchar(20)", "string")
    for n in names:
        body = body.replace(f"FROM {n}", "FROM {" + n + "}")
    return spark.sql(body, **{n: view(spark, sf_dir, n) for n in names})


def _docs(spark, sf_dir):
    return _sql(spark, sf_dir, DOCS, "register_docs")


def _props(spark, sf_dir):
    return _sql(spark, sf_dir, PROPS, "listings")


# The addresses are "<words> <number>[-A], <digits> AB": street, number and letter follow directly.
SCORE_SQL = f"""
docs AS ({DOCS.replace('varchar(20)', 'varchar')}),
props AS (SELECT *, regexp_extract(address, '^(.*?) \\d', 1) AS street, cast(regexp_extract(address, '\\b(\\d+)', 1) as int) AS number, CASE WHEN contains(address, '-A,') THEN 'A' ELSE '' END AS letter,
    concat(regexp_extract(address, '(\\d{{4}}) AB$', 1), 'AB') AS postcode FROM ({PROPS.replace('varchar(20)', 'varchar')})),
pairs AS (SELECT p.*, d.* EXCLUDE (property_id),
    doc_type = 'adres' AS is_address, replace(doc_postcode, ' ', '') = postcode_found AS postcode_ok, doc_number = number AS number_ok FROM (SELECT *, compact AS postcode_found FROM (SELECT *, {{pc}} AS compact FROM props)) p JOIN docs d ON d.property_id = p.property_id),
scored AS (SELECT *, CASE WHEN is_address THEN 35 ELSE 0 END + CASE WHEN postcode_ok THEN 20 ELSE 0 END + CASE WHEN number_ok THEN 15 ELSE 0 END
    + CASE WHEN letter = '' THEN 0 WHEN doc_letter = letter THEN 14 WHEN doc_letter <> '' THEN -10 ELSE 0 END
    + CASE WHEN lower(street) = lower(doc_street) THEN 10 ELSE 0 END + CASE WHEN lower(city) = 'brand#13' THEN 8 ELSE 0 END
    + CASE WHEN usage_purpose = 'woonfunctie' THEN 22 ELSE -12 END + CASE WHEN official_area <> 0 THEN 8 ELSE 0 END
    + CASE WHEN preferred_address_id <> '' AND ltrim(preferred_address_id, '0') = ltrim(address_id, '0') THEN 10 ELSE 0 END
    + CASE WHEN preferred_object_id IS NOT NULL AND ltrim(preferred_object_id, '0') = ltrim(object_id, '0') THEN 12 ELSE 0 END
    + cast(round_even(relevance, 0) as int) AS match_score FROM pairs),
best AS (SELECT *, count(*) OVER (PARTITION BY property_id) AS record_count FROM scored QUALIFY row_number() OVER (PARTITION BY property_id ORDER BY match_score DESC, doc_no) = 1),
conf AS (SELECT p.property_id, p.surface_m2, p.asking_price, p.own_woz, b.doc_no, b.match_score, b.usage_purpose, b.official_area, b.address_id, b.object_id, b.official_year, coalesce(b.record_count, 0) AS record_count,
    greatest(0, least(100, CASE WHEN b.doc_no IS NULL THEN 0 ELSE 60 END + CASE WHEN b.postcode_ok THEN 15 ELSE 0 END + CASE WHEN b.number_ok THEN 10 ELSE 0 END
      + CASE WHEN p.letter <> '' AND b.doc_letter = p.letter THEN 5 ELSE 0 END + CASE WHEN b.usage_purpose = 'woonfunctie' THEN 10 ELSE 0 END - CASE WHEN b.record_count > 1 THEN 5 ELSE 0 END)) AS confidence_score
  FROM props p LEFT JOIN best b ON b.property_id = p.property_id),
flagged AS (SELECT *, concat_ws(',', CASE WHEN doc_no IS NULL THEN 'bag_match_not_found' END, CASE WHEN record_count > 1 THEN 'multiple_possible_bag_matches' END,
    CASE WHEN usage_purpose = 'kantoorfunctie' THEN 'non_residential_usage_purpose' END, CASE WHEN coalesce(official_area, 0) = 0 THEN 'missing_official_area' END,
    CASE WHEN confidence_score < 70 THEN 'low_confidence_match' END) AS quality_flags FROM conf)""".replace(
    "{pc}", "CASE WHEN regexp_matches(address, '\\d{4}\\s*[A-Za-z]{2}') THEN concat(regexp_extract(address, '(\\d{4})\\s*([A-Za-z]{2})', 1), upper(regexp_extract(address, '(\\d{4})\\s*([A-Za-z]{2})', 2))) END"
)


def _matched(spark, sf_dir):
    return register.match_records(_props(spark, sf_dir), _docs(spark, sf_dir))


@query(
    "register_match",
    with_views("listings register_docs", f"WITH {SCORE_SQL} SELECT property_id, doc_no, match_score, record_count FROM conf"),
)
def register_match(spark, sf_dir):
    return _matched(spark, sf_dir).select("property_id", "doc_no", "match_score", "record_count")


@query(
    "register_best_address",
    with_views(
        "listings register_docs",
        f"""WITH {SCORE_SQL}, a AS (SELECT *, CASE WHEN is_address THEN 40 ELSE 0 END + CASE WHEN postcode_ok THEN 30 ELSE 0 END + CASE WHEN number_ok THEN 15 ELSE 0 END + CASE WHEN letter <> '' AND doc_letter = letter THEN 8 ELSE 0 END
          + CASE WHEN lower(street) = lower(doc_street) THEN 14 ELSE 0 END + CASE WHEN usage_purpose = 'woonfunctie' THEN 8 ELSE 0 END + CASE WHEN lower(city) = 'brand#13' THEN 8 ELSE 0 END AS address_score FROM pairs)
        SELECT property_id, doc_no, address_score FROM a QUALIFY row_number() OVER (PARTITION BY property_id ORDER BY address_score DESC, relevance DESC, doc_no) = 1""",
    ),
)
def register_best_address(spark, sf_dir):
    return register.best_address(_props(spark, sf_dir), _docs(spark, sf_dir)).select("property_id", "doc_no", "address_score")


@query(
    "register_confidence",
    with_views("listings register_docs", f"WITH {SCORE_SQL} SELECT property_id, confidence_score, quality_flags FROM flagged"),
)
def register_confidence(spark, sf_dir):
    return _matched(spark, sf_dir).select("property_id", "confidence_score", F.array_join("quality_flags", ",").alias("quality_flags"))


VALUES = """
  SELECT concat('0', cast(l_partkey * 10 + 7 as varchar(20))) AS address_id, l_partkey AS woz_object_number, cast(l_shipdate as date) AS valuation_date,
    CASE WHEN l_partkey % 17 = 0 THEN NULL ELSE cast(floor(l_extendedprice) as double) END AS value, l_orderkey * 10 + l_linenumber AS seq FROM lineitem"""


def _tax_input(spark, sf_dir):
    from woonvonk.plans.views import read

    listings = view(spark, sf_dir, "listings")
    # every fifth property has an id that the tax register doesn't know
    last = F.when(F.col("listing_id") % 5 == 0, 8).otherwise(7)
    number = F.concat(F.lit("0"), (F.col("listing_id") * 10 + last).cast("string"))
    case = F.col("listing_id") % 3
    properties = listings.select(
        F.col("listing_id").alias("property_id"),
        F.when(case == 0, number).alias("address_id"),
        F.when(case == 1, F.concat(F.lit("adr-x9-"), number)).when(case == 2, "").alias("identification"),
    )
    values = spark.sql(VALUES.replace("varchar(20)", "string").replace("FROM lineitem", "FROM {lineitem}"), lineitem=read(spark, sf_dir, "lineitem"))
    # One value per day: the last entry of the day counts.
    daily = values.groupBy("address_id", "woz_object_number", "valuation_date").agg(F.max_by("value", "seq").alias("value"))
    return properties, daily


TAX_SQL = f"""
v0 AS ({VALUES.replace('varchar(20)', 'varchar')}),
v AS (SELECT address_id, woz_object_number, valuation_date, value FROM v0 QUALIFY row_number() OVER (PARTITION BY address_id, valuation_date ORDER BY (value IS NULL), seq DESC) = 1),
w AS (SELECT woz_object_number AS id, arg_max(value, valuation_date) AS latest, year(max(valuation_date)) AS y, year(min(valuation_date)) AS y0, count(value) AS n FROM v GROUP BY 1),
tax AS (SELECT l.listing_id AS property_id, w.id AS woz_object_number, w.latest AS latest_woz_value, cast(w.y as int) AS woz_valuation_year, cast(w.y0 as int) AS first_valuation_year, w.n AS value_count,
  CASE WHEN w.latest IS NOT NULL THEN 98 WHEN w.id IS NOT NULL THEN 65 WHEN l.listing_id % 3 <> 2 THEN 5 ELSE 10 END AS woz_confidence
  FROM listings l LEFT JOIN w ON w.id = l.listing_id AND l.listing_id % 3 <> 2 AND l.listing_id % 5 <> 0)"""


@query("woz_match", with_views("listings", f"WITH {TAX_SQL} SELECT * FROM tax"))
def woz_match(spark, sf_dir):
    properties, values = _tax_input(spark, sf_dir)
    return register.tax_values(properties, values).drop("address_id", "identification", "candidate_id")


@query(
    "register_snapshot",
    with_views(
        "listings register_docs",
        f"""WITH {SCORE_SQL}, {TAX_SQL.strip()} SELECT f.property_id, address_id AS bag_address_id, object_id AS bag_id, coalesce(official_year, cast(1900 + f.property_id % 100 as int)) AS bag_building_year,
        coalesce(nullif(official_area, 0), 75e0) AS bag_official_floor_area_m2, usage_purpose AS bag_usage_purpose, t.woz_object_number, t.latest_woz_value, t.woz_valuation_year,
        least(confidence_score, t.woz_confidence) AS confidence_score, CASE WHEN record_count = 0 THEN 'bag_match_not_found,low_confidence_match' ELSE quality_flags END AS quality_flags
        FROM flagged f LEFT JOIN tax t ON t.property_id = f.property_id""",
    ),
)
def register_snapshot(spark, sf_dir):
    properties, values = _tax_input(spark, sf_dir)
    taxed = register.tax_values(properties, values).withColumns(
        {"tax_building_year": (1900 + F.col("property_id") % 100).cast("int"), "tax_area": F.lit(75.0)}
    )
    built = register.register_snapshot(_matched(spark, sf_dir), taxed)
    return built.withColumn("quality_flags", F.array_join("quality_flags", ","))


AREA_SQL = f"""
sized AS (SELECT *, CASE WHEN usage_purpose = 'woonfunctie' AND confidence_score >= 70 AND official_area <> 0 THEN official_area ELSE surface_m2 END AS area,
    CASE WHEN usage_purpose = 'woonfunctie' AND confidence_score >= 70 AND official_area <> 0 THEN 'BAG' ELSE 'Funda' END AS area_source,
    {r2('nullif(surface_m2, 0) - nullif(official_area, 0)')} AS diff FROM flagged),
measured AS (SELECT *, {r2('diff / nullif(official_area, 0) * 100e0')} AS diff_pct FROM sized)"""


def _measured(spark, sf_dir):
    return register.area_metrics(_matched(spark, sf_dir).withColumnRenamed("own_woz", "latest_woz_value"))


@query(
    "area_price_metrics",
    with_views(
        "listings register_docs",
        f"""WITH {SCORE_SQL}, {AREA_SQL} SELECT property_id, area AS calculation_area_m2, area_source AS calculation_area_source, diff AS living_area_difference_m2, diff_pct AS living_area_difference_percentage,
        {r2('asking_price / nullif(area, 0)')} AS asking_price_per_m2, {r2('own_woz / nullif(area, 0)')} AS woz_value_per_m2,
        CASE WHEN abs(diff_pct) > 10 THEN concat_ws(',', nullif(quality_flags, ''), 'funda_bag_area_difference_gt_10_pct') ELSE quality_flags END AS quality_flags FROM measured""",
    ),
)
def area_price_metrics(spark, sf_dir):
    return _measured(spark, sf_dir).select(
        "property_id", "calculation_area_m2", "calculation_area_source", "living_area_difference_m2", "living_area_difference_percentage",
        "asking_price_per_m2", "woz_value_per_m2", F.array_join("quality_flags", ",").alias("quality_flags"),
    )


# --- enrichments --------------------------------------------------------------------------------

# What the register says beside the match itself, by record number.
STATUS = "CASE WHEN doc_no % 7 = 0 THEN '' ELSE 'In gebruik' END"
PLACE = "CASE WHEN doc_no % 4 = 0 THEN NULL ELSE 'Brand#13' END"


def _whole(spark, sf_dir):
    """One row per property with a column per public item."""
    properties, values = _tax_input(spark, sf_dir)
    taxed = register.tax_values(properties, values).drop("address_id", "identification", "candidate_id", "woz_confidence")
    measured = register.area_metrics(_matched(spark, sf_dir).join(taxed, "property_id", "left"))
    known = F.col("doc_no").isNotNull()
    grid = [(F.col("doc_no") * step).cast("string") for step in (10, 20)]
    span = F.struct(F.col("first_valuation_year").alias("first_year"), F.col("value_count").alias("values"))
    return measured.withColumns(
        {
            "bag_id": F.col("object_id"),
            "bag_address_id": F.col("address_id"),
            "bag_verblijfsobject_id": F.col("object_id"),
            "bag_nummeraanduiding_id": F.col("address_id"),
            "bag_pand_id": F.when(F.col("doc_no") % 3 == 0, F.concat(F.lit("P"), F.col("doc_no").cast("string"))),
            "bag_building_year": F.col("official_year"),
            "bag_usage_purpose": F.col("usage_purpose"),
            "bag_status": F.expr(STATUS),
            "bag_official_floor_area_m2": F.col("official_area"),
            "bag_coordinates": F.when(known & (F.col("doc_no") % 5 > 0), F.struct(F.concat_ws(" ", *grid).alias("rd"))),
            "bag_postcode": F.col("doc_postcode"),
            "bag_municipality": F.when(known, F.expr(PLACE)),
            "bag_retrieval_date": F.when(known, F.lit("2001-08-01")),
            "bag_source": F.when(known, F.lit("landed register")),
            "bag_confidence_score": F.col("confidence_score"),
            "bag_quality_flags": F.col("quality_flags"),
            "funda_living_area_m2": F.col("surface_m2"),
            "woz_historical_values": F.when(F.col("value_count") > 0, span),
        }
    )


def _items(spark, sf_dir):
    return enrichment.fan_out(_whole(spark, sf_dir), "property_id")


def _local_price(factor: float) -> str:
    base = f"coalesce(nullif(asking_price, 0), surface_m2 * {enrichment.finance.FALLBACK_PRICE_PER_M2}e0)"
    return r2(f"nullif({base}, 0) * {factor}e0")


# Key, value, whether the value is a number, and confidence where it isn't that of the match.
ITEMS = [
    ("bag_id", "object_id", False, None), ("bag_address_id", "address_id", False, None),
    ("bag_verblijfsobject_id", "object_id", False, None), ("bag_nummeraanduiding_id", "address_id", False, None),
    ("bag_pand_id", "CASE WHEN doc_no % 3 = 0 THEN concat('P', doc_no) END", False, None),
    ("bag_building_year", "official_year", True, None), ("bag_usage_purpose", "usage_purpose", False, None),
    ("bag_status", f"CASE WHEN doc_no IS NOT NULL THEN {STATUS} ELSE 'In gebruik' END", False, None),
    ("bag_official_floor_area_m2", "official_area", True, None),
    ("bag_coordinates", """CASE WHEN doc_no % 5 > 0 THEN concat('{"rd":"', doc_no * 10, ' ', doc_no * 20, '"}') END""", False, None),
    ("bag_postcode", "doc_postcode", False, None), ("bag_municipality", f"CASE WHEN doc_no IS NOT NULL THEN {PLACE} END", False, None),
    ("bag_retrieval_date", "CASE WHEN doc_no IS NOT NULL THEN '2001-08-01' END", False, None),
    ("bag_source", "CASE WHEN doc_no IS NOT NULL THEN 'landed register' END", False, None),
    ("bag_confidence_score", "confidence_score", True, None), ("bag_quality_flags", "flags", False, None),
    ("funda_living_area_m2", "surface_m2", True, None), ("living_area_difference_m2", "diff", True, None),
    ("living_area_difference_percentage", "diff_pct", True, None), ("calculation_area_m2", "area", True, None),
    ("calculation_area_source", "area_source", False, None),
    ("asking_price_per_m2", r2("asking_price / nullif(area, 0)"), True, None), ("woz_value_per_m2", r2("latest_woz_value / nullif(area, 0)"), True, None),
    ("woz_object_number", "woz_object_number", True, None), ("latest_woz_value", "latest_woz_value", True, None),
    ("woz_valuation_year", "woz_valuation_year", True, None),
    ("woz_historical_values", """CASE WHEN value_count > 0 THEN concat('{"first_year":', first_valuation_year, ',"values":', value_count, '}') END""", False, None),
    ("municipality", "town", False, "CASE WHEN town IS NULL THEN 20 ELSE 80 END"),
    ("postal_code", "NULL", False, "10"), ("distance_to_city_center", "2.6e0", True, "45"), ("distance_to_station", "1.4e0", True, "45"),
    ("distance_to_supermarket", "0.7e0", True, "45"), ("distance_to_highway", "3.8e0", True, "45"),
    ("neighborhood_m2_price_average", _local_price(enrichment.finance.NEIGHBOURHOOD_FACTOR), True, "28"),
    ("street_m2_price_average", _local_price(enrichment.finance.STREET_FACTOR), True, "30"),
    ("monument_status", "'unknown'", False, "15"), ("land_registry_information", "'Placeholder until Kadaster integration exists'", False, "5"),
    ("permit_information", "'Not yet implemented'", False, "0"), ("zoning", "'Not yet implemented'", False, "0"),
]
NUMBERS = [key for key, _, number, _ in ITEMS if number]


def _item_sql(key: str, value: str, number: bool, confidence: str | None) -> str:
    """A public item without a value, or with a blank one, isn't a success; looked-up items always are."""
    text, count = ("NULL", f"cast({value} as double)") if number else (f"cast({value} as varchar)", "NULL")
    fine = "true" if confidence or key == "bag_quality_flags" else f"coalesce(cast({value} as varchar), '') <> ''"
    return (
        f"SELECT property_id, '{key}' AS enrichment_key, cast({text} as varchar) AS value, cast({count} as double) AS number, {fine} AS success,"
        f" cast({confidence or 'confidence_score'} as int) AS confidence_score FROM whole"
    )


ITEM_SQL = f"""{SCORE_SQL}, {AREA_SQL}, {TAX_SQL.strip()},
whole AS (SELECT m.*, t.* EXCLUDE (property_id, woz_confidence), b.doc_postcode,
    CASE WHEN q = '' THEN '[]' ELSE concat('["', replace(q, ',', '","'), '"]') END AS flags,
    trim(regexp_extract(concat_ws(', ', b.address, b.city), '([^,]+)$', 1)) AS town
  FROM (SELECT *, CASE WHEN abs(diff_pct) > 10 THEN concat_ws(',', nullif(quality_flags, ''), 'funda_bag_area_difference_gt_10_pct') ELSE quality_flags END AS q FROM measured) m
  JOIN tax t ON t.property_id = m.property_id
  JOIN (SELECT p.property_id, p.address, p.city, best.doc_postcode FROM props p LEFT JOIN best ON best.property_id = p.property_id) b ON b.property_id = m.property_id),
items AS ({" UNION ALL ".join(_item_sql(*i) for i in ITEMS)})"""


@query("enrichment_fanout", with_views("listings register_docs", f"WITH {ITEM_SQL} SELECT * FROM items"))
def enrichment_fanout(spark, sf_dir):
    """All 39 items; numbers are compared as numbers, because engines print them differently."""
    number = F.col("enrichment_key").isin(NUMBERS)
    return _items(spark, sf_dir).select(
        "property_id", "enrichment_key", F.when(~number, F.col("value")).alias("value"),
        F.when(number, F.col("value").cast("double")).alias("number"), "success", "confidence_score",
    )


# Names a property's columns go by beside the items' own.
EXTRA = {
    "construction_year_bag": "bag_building_year", "usage_purpose": "bag_usage_purpose", "status": "bag_status",
    "official_floor_area_m2": "bag_official_floor_area_m2", "retrieval_date": "bag_retrieval_date", "source": "bag_source",
    "confidence_score": "bag_confidence_score", "quality_flags": "bag_quality_flags",
}
_PIVOTED = {key: f"max(CASE WHEN enrichment_key = '{key}' THEN {'number' if number else 'value'} END)" for key, _, number, _ in ITEMS}
_PIVOTED |= {name: _PIVOTED[key] if key in NUMBERS else f"nullif({_PIVOTED[key]}, '')" for name, key in EXTRA.items()}
_PIVOTED |= {
    "bag_coordinates_rd": "nullif(regexp_extract(max(CASE WHEN enrichment_key = 'bag_coordinates' THEN value END), '\"rd\":\"([^\"]*)\"', 1), '')",
    "bag_coordinates_ll": "cast(NULL as varchar)",
}


@query(
    "enrichment_pivot",
    with_views(
        "listings register_docs",
        f"WITH {ITEM_SQL} SELECT property_id, {', '.join(f'{sql} AS {name}' for name, sql in _PIVOTED.items())} FROM items GROUP BY property_id",
    ),
)
def enrichment_pivot(spark, sf_dir):
    """All keys as columns, with the names that stand in for each other filled."""
    wide = enrichment.with_aliases(enrichment.pivot(_items(spark, sf_dir), "property_id", [key for key, *_ in ITEMS]))
    numbers = {*NUMBERS, *[name for name, key in EXTRA.items() if key in NUMBERS]}
    return wide.select(*[F.col(c).cast("double") if c in numbers else F.col(c) for c in wide.columns])


@query(
    "enrichment_group_stats",
    with_views(
        "listings register_docs",
        f"WITH {ITEM_SQL} SELECT property_id, count(*) AS item_count, count(CASE WHEN NOT success THEN 1 END) AS error_count FROM items GROUP BY property_id",
    ),
)
def enrichment_group_stats(spark, sf_dir):
    return enrichment.group_stats(_items(spark, sf_dir), "property_id").select("property_id", "item_count", "error_count")


@query(
    "append_enrichments",
    with_views("listings register_docs", f"WITH {ITEM_SQL} SELECT enrichment_key, count(*) AS item_count, count(CASE WHEN success THEN 1 END) AS fine_count FROM items GROUP BY enrichment_key"),
)
def append_enrichments(spark, sf_dir):
    from woonvonk.session import materialise, scratch_path

    path = scratch_path(spark, "enrichments")
    # matched once for both batches: one row per property, which is little beside the records it is made of
    kept = materialise(_whole(spark, sf_dir))
    items = enrichment.fan_out(kept, "property_id")
    tables.append_enrichments(items.where("property_id % 2 = 0"), path)
    tables.append_enrichments(items.where("property_id % 2 = 1"), path)
    return spark.read.parquet(path).groupBy("enrichment_key").agg(
        F.count(F.lit(1)).alias("item_count"), F.count_if("success").alias("fine_count")
    )
