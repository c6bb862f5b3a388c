"""Queries over web pages: the given pages and portal pages made from the listings."""

from __future__ import annotations

from pyspark.sql import functions as F

from woonvonk.plans.registry import query
from woonvonk.plans.views import r2, read, view, with_views
from woonvonk.sources import pages


# The references that occur in the pages, the ampersand last.
SIGNS = [
    ("nbsp", " "), ("euro", "€"), ("#8364", "€"), ("#233", "é"), ("sup2", "²"), ("copy", "©"), ("middot", "·"), ("ndash", "–"),
    ("quot", '"'), ("#39", "''"), ("lt", "<"), ("gt", ">"), ("eacute", "é"), ("uuml", "ü"), ("amp", "&"),
]


def _strip(html: str) -> str:
    """Visible text in the checking engine."""
    out = html
    for pattern in ("<!--.*?-->", "<script\\b[^>]*>.*?</script\\s*>", "<style\\b[^>]*>.*?</style\\s*>", "<noscript\\b[^>]*>.*?</noscript\\s*>"):
        out = f"regexp_replace({out}, '(?is){pattern}', ' ', 'g')"
    out = f"regexp_replace({out}, '(?s)<[^>]*>', ' ', 'g')"
    for name, sign in SIGNS:
        out = f"regexp_replace({out}, '&{name}(;|\\b)', '{sign}', 'g')"
    return f"trim(regexp_replace({out}, '[\\s\\x{{A0}}]+', ' ', 'g'))"


VISIBLE = _strip("html")


@query("visible_text", f"SELECT page_id, md5({VISIBLE}) AS text_hash, cast(length({VISIBLE}) as int) AS text_length FROM pages")
def visible_text(spark, sf_dir):
    shown = pages.visible_text("html")
    return read(spark, sf_dir, "pages").select("page_id", F.md5(shown.cast("binary")).alias("text_hash"), F.length(shown).alias("text_length"))


@query(
    "extract_links",
    r"""WITH h AS (SELECT page_id, url, regexp_replace(trim(unnest(regexp_extract_all(html, '(?is)<a\b[^>]*\bhref\s*=\s*["'']([^"'']*)["'']', 1))), '#.*$', '') AS href FROM pages),
    r AS (SELECT page_id, CASE WHEN href = '' OR regexp_matches(href, '(?i)^(mailto|javascript|tel|data):') THEN NULL WHEN regexp_matches(href, '(?i)^https?://') THEN href
        WHEN starts_with(href, '/') THEN concat(regexp_extract(lower(url), '^(https?://[^/?#]+)', 1), href)
        ELSE concat(regexp_extract(lower(url), '^(https?://[^/?#]+)', 1), regexp_replace(regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1), '[^/]*$', ''), href) END AS link FROM h)
    SELECT DISTINCT page_id, link FROM r WHERE link IS NOT NULL""",
)
def extract_links(spark, sf_dir):
    return pages.extract_links(read(spark, sf_dir, "pages"))


@query(
    "extract_listing_links",
    with_views("portal_pages", "SELECT page_id, concat(regexp_extract(url, '^(https://[^/]+)', 1), '/detail/koop/object-', cast(10001 + page_id as varchar), '/?a=1') AS link FROM portal_pages"),
)
def extract_listing_links(spark, sf_dir):
    return pages.extract_links(view(spark, sf_dir, "portal_pages"), path_pattern="/detail/.*", host_pattern=r"^portal\d+\.example$").where(
        F.col("link").rlike("/(koop|huur)/")
    )


@query(
    "html_titles",
    f"""SELECT page_id, nullif({_strip("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")}, '') AS title, nullif({_strip("regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1)")}, '') AS heading FROM pages""",
)
def html_titles(spark, sf_dir):
    return read(spark, sf_dir, "pages").select(
        "page_id", pages.element_text("html", "title").alias("title"), pages.element_text("html", "h1").alias("heading")
    )


@query(
    "extract_jsonld",
    with_views(
        "portal_pages",
        """SELECT page_id, CASE WHEN kind = 0 THEN concat(title, ' te koop') END AS title, CASE WHEN kind = 0 THEN concat(street, ', ', postcode, ', ', city) END AS address,
        CASE WHEN kind = 0 THEN cast(price as double) END AS asking_price, CASE WHEN kind = 0 THEN cast(area as double) END AS surface_m2, CASE WHEN kind = 2 THEN 1 ELSE 0 END AS warning_count FROM portal_pages""",
    ),
)
def extract_jsonld(spark, sf_dir):
    return pages.extract_jsonld(view(spark, sf_dir, "portal_pages").select("page_id", "url", "html")).select(
        "page_id", "ld.title", "ld.address", "ld.asking_price", "ld.surface_m2", F.size("ld_warnings").alias("warning_count")
    )


@query(
    "extract_open_graph",
    with_views(
        "portal_pages",
        """SELECT page_id, CASE WHEN kind = 2 THEN street END AS title, CASE WHEN kind = 2 THEN concat('Deel ', title) END AS description, CASE WHEN kind = 2 THEN 1 ELSE 0 END AS image_count,
        CASE WHEN kind = 2 THEN concat('https://m.example/x/', cast(page_id as varchar)) ELSE url END AS canonical_url FROM portal_pages""",
    ),
)
def extract_open_graph(spark, sf_dir):
    return pages.extract_open_graph(view(spark, sf_dir, "portal_pages").select("page_id", "url", "html")).select(
        "page_id", F.col("og_title").alias("title"), F.col("og_description").alias("description"), F.size("og_images").alias("image_count"), "canonical_url"
    )


@query(
    "extract_html_fallback",
    with_views(
        "portal_pages",
        """SELECT page_id, CASE WHEN kind IN (1, 3) THEN street ELSE title END AS heading, CASE WHEN kind = 3 THEN concat(street, ' , ', postcode, ' ', city) END AS picked_address,
        CASE WHEN kind = 3 THEN cast(replace(price_nl, '.', '') as double) END AS asking_price, CASE WHEN kind IN (1, 3) THEN cast(area as double) END AS surface_m2, CASE WHEN kind = 3 THEN 'Ruime woning met tuin .' END AS description FROM portal_pages""",
    ),
)
def extract_html_fallback(spark, sf_dir):
    base = view(spark, sf_dir, "portal_pages").select("page_id", "url", "html", "kind")
    return pages.extract_html_fallback(base, keep=("picked_address",)).select(
        "page_id", F.col("page_heading").alias("heading"), "picked_address", F.col("page_asking_price").alias("asking_price"), F.col("page_surface_m2").alias("surface_m2"), F.col("page_description").alias("description")
    )


@query(
    "merge_extractions",
    with_views(
        "portal_pages",
        """SELECT page_id, CASE kind WHEN 0 THEN 'json_ld' WHEN 2 THEN 'open_graph' ELSE 'html_fallback' END AS extraction_method, CASE kind WHEN 0 THEN 0.9e0 WHEN 2 THEN 0.7e0 ELSE 0.5e0 END AS confidence,
        CASE kind WHEN 0 THEN cast(price as double) WHEN 3 THEN cast(replace(price_nl, '.', '') as double) END AS asking_price, CASE kind WHEN 0 THEN 3 WHEN 2 THEN 1 ELSE 0 END AS image_count, true AS success, CASE kind WHEN 2 THEN 1 ELSE 0 END AS warning_count,
        CASE kind WHEN 0 THEN 'Mooie woning' WHEN 2 THEN concat('Deel ', title) WHEN 3 THEN 'Ruime woning met tuin .' END AS description FROM portal_pages""",
    ),
)
def merge_extractions(spark, sf_dir):
    return pages.merge_extractions(view(spark, sf_dir, "portal_pages").select("page_id", "url", "html")).select(
        "page_id", "extraction_method", "confidence", "asking_price", F.size("images").alias("image_count"), "success",
        F.size("warnings").alias("warning_count"), "description",
    )


@query("html_listing_records")
def html_listing_records(spark, sf_dir):
    """The whole extraction over the given pages (rules of thumb on free pages: no SQL counterpart)."""
    return pages.merge_extractions(read(spark, sf_dir, "pages")).select(
        "page_id", "title", "address", "city", "asking_price", "surface_m2", "extraction_method", "confidence", "success"
    )


@query(
    "details_map",
    with_views(
        "portal_pages",
        """SELECT page_id, CASE WHEN kind = 1 THEN 11 ELSE 0 END AS pair_count, CASE WHEN kind = 1 THEN concat('€ ', price_nl, ' k.k.') END AS price_text, CASE WHEN kind = 1 THEN concat(area, ' m²') END AS area_text,
        CASE WHEN kind = 1 THEN '3 maart 2001' END AS since_text FROM portal_pages""",
    ),
)
def details_map(spark, sf_dir):
    found = view(spark, sf_dir, "portal_pages").select("page_id", pages.details("html").alias("d"))
    d = F.col("d")
    return found.select(
        "page_id",
        F.size("d").alias("pair_count"),
        pages.detail(d, pages.LABELS["price"]).alias("price_text"),
        pages.detail(d, pages.LABELS["area"]).alias("area_text"),
        pages.detail(d, pages.LABELS["since"]).alias("since_text"),
    )


PORTAL_SQL = f"""rec AS (SELECT page_id, cast(10000 + page_id as varchar) AS listing_id, CASE kind WHEN 0 THEN title WHEN 1 THEN street WHEN 2 THEN street END AS title,
    CASE kind WHEN 0 THEN concat(street, ' ', postcode, ' ', city) WHEN 1 THEN concat(street, ' ', postcode) END AS address,
    CASE kind WHEN 0 THEN cast(price as double) WHEN 1 THEN cast(replace(price_nl, '.', '') as double) END AS asking_price, CASE WHEN kind IN (0, 1) THEN 'known' END AS asking_price_status,
    CASE WHEN kind IN (0, 1) THEN cast(area as double) END AS living_area, CASE kind WHEN 0 THEN '2001-02-03' WHEN 1 THEN '2001-03-03' END AS listed_since,
    CASE WHEN kind = 1 THEN 1975 END AS construction_year, CASE kind WHEN 0 THEN 2 WHEN 1 THEN 2 WHEN 2 THEN 1 ELSE 0 END AS photo_count, CASE kind WHEN 0 THEN 'medium' WHEN 1 THEN 'high' ELSE 'unknown' END AS listing_history_confidence,
    CASE WHEN kind = 1 THEN {r2("(cast(replace(price_nl_high, '.', '') as double) - cast(replace(price_nl, '.', '') as double)) / cast(replace(price_nl_high, '.', '') as double) * 100")} END AS total_price_reduction_percentage FROM portal_pages)"""


@query("portal_record", with_views("portal_pages", f"WITH {PORTAL_SQL} SELECT * FROM rec"))
def portal_record(spark, sf_dir):
    records = pages.portal_record(view(spark, sf_dir, "portal_pages").select("page_id", "url", "html"))
    return records.select(
        "page_id", "listing_id", "title", "address", "asking_price", "asking_price_status", "living_area",
        F.col("listed_since").cast("string").alias("listed_since"), "construction_year", F.size("photos").alias("photo_count"),
        "listing_history_confidence", "total_price_reduction_percentage",
    )


@query(
    "image_list",
    with_views(
        "portal_pages",
        """SELECT page_id, CASE kind WHEN 0 THEN concat(regexp_extract(url, '^(https://[^/]+)', 1), '/foto/a.jpg|https://img.example/b.jpg') WHEN 1 THEN concat(regexp_extract(url, '^(https://[^/]+)', 1), '/foto/1.jpg|', regexp_extract(url, '^(https://[^/]+)', 1), '/foto/2.jpg')
        WHEN 2 THEN 'https://img.example/og.jpg' ELSE '' END AS photos FROM portal_pages""",
    ),
)
def image_list(spark, sf_dir):
    return pages.images(view(spark, sf_dir, "portal_pages").select("page_id", "url", "html")).select(
        "page_id", F.array_join("photos", "|").alias("photos")
    )


@query(
    "extraction_report",
    with_views(
        "portal_pages",
        """SELECT regexp_extract(url, '^https://([^/]+)', 1) AS host, count(*) AS imported_listings, count(*) AS listings_with_missing_fields, count(CASE WHEN kind >= 2 THEN 1 END) AS without_price,
          cast(sum(CASE kind WHEN 0 THEN 4 WHEN 1 THEN 2 WHEN 2 THEN 11 ELSE 13 END) as bigint) AS missing_field_count FROM portal_pages GROUP BY 1""",
    ),
)
def extraction_report(spark, sf_dir):
    from woonvonk.functions.text import url_host

    records = pages.portal_record(view(spark, sf_dir, "portal_pages").select("page_id", "url", "html")).withColumn("host", url_host("url"))
    return pages.extraction_report(records, ["host"])


@query(
    "generic_record",
    f"""WITH t AS (SELECT page_id, {VISIBLE} AS txt, nullif({_strip("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")}, '') AS title FROM pages),
    w AS (SELECT *, cast(len(list_filter(string_split(txt, ' '), lambda x: x <> '')) as int) AS word_count FROM t)
    SELECT page_id, title, word_count, word_count >= 35 AND title IS NOT NULL AS success, CASE WHEN word_count >= 35 AND title IS NOT NULL THEN 0.70e0 ELSE 0.25e0 END AS confidence, md5(txt) AS text_md5 FROM w""",
)
def generic_record(spark, sf_dir):
    records = pages.generic_record(read(spark, sf_dir, "pages"), ["portal.example"], ["business.example"])
    return records.select("page_id", "title", "word_count", "success", "confidence", F.md5(F.col("raw_text").cast("binary")).alias("text_md5"))


@query(
    "generic_record_hosts",
    with_views(
        "portal_pages",
        f"""SELECT page_id, CASE WHEN regexp_matches(url, 'portal1?2\\.') THEN 'portal' WHEN regexp_matches(url, 'portal1?3\\.') THEN 'business' ELSE 'other' END AS host_kind, len(list_filter(string_split({VISIBLE}, ' '), lambda x: x <> '')) >= 35 AS success,
        CASE WHEN kind = 0 THEN cast(price as double) END AS asking_price, CASE WHEN kind = 0 THEN 'known' WHEN kind = 2 THEN 'unknown' ELSE 'unknown' END AS price_status FROM (SELECT * FROM portal_pages)""",
    ),
)
def generic_record_hosts(spark, sf_dir):
    base = view(spark, sf_dir, "portal_pages").select("page_id", "url", "html")
    records = pages.generic_record(base, ["portal2.example", "portal12.example"], ["portal3.example", "portal13.example"])
    return records.select("page_id", "host_kind", "success", "asking_price", "price_status")


@query(
    "listing_cards",
    with_views(
        "card_pages",
        """SELECT page_id, concat('https://klus.example/pand/', cast(page_id as varchar)) AS source_url, city, (100 + page_id % 900) * 1000 + 500e0 AS asking_price, concat('https://img.example/', cast(page_id as varchar), '.jpg') AS image_url, 'Woonhuis' AS property_type FROM card_pages""",
    ),
)
def listing_cards(spark, sf_dir):
    return pages.listing_cards(view(spark, sf_dir, "card_pages")).select(
        "page_id", "source_url", "city", "asking_price", "image_url", "property_type"
    )


@query(
    "city_overview",
    with_views(
        "card_pages",
        """SELECT page_id, 'Breda' AS municipality, 'Noord-Brabant' AS province, cast(1 + page_id % 30 as int) AS listing_count FROM card_pages UNION ALL SELECT page_id, 'Den Haag', NULL, cast(1 + page_id % 20 as int) FROM card_pages
        UNION ALL SELECT page_id, 'Bergen Op Zoom', NULL, NULL FROM card_pages""",
    ),
)
def city_overview(spark, sf_dir):
    return pages.city_links(view(spark, sf_dir, "card_pages")).select("page_id", "municipality", "province", "listing_count")


@query(
    "works_portal_record",
    with_views(
        "works_pages",
        """SELECT page_id, concat('pand::', cast(page_id as varchar)) AS external_listing_id, concat('Straat ', cast(1 + page_id % 90 as varchar)) AS address, 'Breda' AS city, 'Utrecht' AS province,
        CASE WHEN page_id % 3 = 0 THEN 100000e0 + page_id ELSE (100 + page_id % 900) * 1000e0 END AS asking_price, coalesce(surface_m2, 0) AS living_area, 1250e0 AS plot_size, bedrooms, CASE WHEN construction_year >= 1900 THEN construction_year END AS construction_year,
        concat('2001-05-0', cast(1 + page_id % 9 as varchar)) AS listed_since, CASE WHEN page_id % 2 = 0 THEN lower(property_type) ELSE 'kluswoning' END AS property_type, CASE WHEN page_id % 2 = 0 THEN 0 ELSE 1 END AS missing_count FROM works_pages""",
    ),
)
def works_portal_record(spark, sf_dir):
    records = pages.works_record(view(spark, sf_dir, "works_pages").select("page_id", "url", "html"))
    return records.select(
        "page_id", "external_listing_id", "address", "city", "province", "asking_price", "living_area", "plot_size", "bedrooms", "construction_year",
        F.col("listed_since").cast("string").alias("listed_since"), "property_type", F.size("missing_fields").alias("missing_count"),
    )
