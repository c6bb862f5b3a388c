"""Listing-shaped views over the given tables, in SQL that Spark and the checking engine both run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from woonvonk.session import spread

# The day on which "today" is set in every query.
REFERENCE_DATE = "2001-08-01"

VIEWS: dict[str, tuple[str, str]] = {}


def _view(name: str, table: str, select: str) -> None:
    VIEWS[name] = (table, select)


_view(
    "listings",
    "part",
    """
    SELECT p_partkey AS listing_id,
      cast(p_partkey % 25 as int) AS source_id,
      concat('ext-', cast(p_partkey as varchar(20))) AS external_listing_id,
      concat('https://', CASE WHEN p_partkey % 3 = 0 THEN 'WWW.' ELSE '' END, 'portal',
        cast(p_partkey % 25 as varchar(20)), '.example/detail/koop/object-',
        cast(10000 + p_partkey as varchar(20)), CASE WHEN p_partkey % 2 = 0 THEN '/' ELSE '' END) AS source_url,
      p_name AS title,
      concat(p_name, ' ', cast(1 + p_partkey % 200 as varchar(20)),
        CASE WHEN p_partkey % 9 = 0 THEN '-A' ELSE '' END, ', ',
        cast(1000 + p_partkey % 9000 as varchar(20)), ' AB') AS address,
      CASE WHEN p_partkey % 29 = 0 THEN NULL ELSE p_brand END AS city,
      CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE p_retailprice * (250 + (p_partkey * 37) % 500) END AS asking_price,
      CASE WHEN p_partkey % 13 = 0 THEN NULL ELSE cast(p_size * 4 as double) END AS surface_m2,
      CASE WHEN p_partkey % 17 = 0 THEN NULL ELSE cast(p_size * (1 + p_partkey % 12) as double) END AS plot_size_m2,
      CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE cast(p_partkey % 8 as int) END AS bedrooms,
      CASE p_partkey % 10 WHEN 0 THEN 'A++' WHEN 1 THEN 'A' WHEN 2 THEN 'B' WHEN 3 THEN 'C' WHEN 4 THEN 'D'
        WHEN 5 THEN 'E' WHEN 6 THEN 'F' WHEN 7 THEN 'G' WHEN 8 THEN 'a+' ELSE NULL END AS energy_label,
      CASE WHEN p_partkey % 19 = 0 THEN NULL ELSE cast(1900 + p_partkey % 125 as int) END AS construction_year,
      CASE p_type WHEN 'ECONOMY' THEN 'Appartement' WHEN 'SMALL' THEN 'Studio' WHEN 'MEDIUM' THEN 'Tussenwoning'
        WHEN 'PROMO' THEN 'Vrijstaande woning' WHEN 'STANDARD' THEN '2-onder-1-kap' ELSE 'Villa' END AS property_type,
      CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE cast(p_partkey % 200 as int) END AS days_on_market,
      cast(p_partkey % 4 as int) AS price_reduction_count,
      CASE WHEN p_partkey % 23 = 0 THEN NULL ELSE cast(2500 + p_partkey % 4000 as double) END
        AS neighborhood_m2_price_average,
      CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_retailprice * 400 END AS latest_woz_value,
      cast(p_partkey % 7 as int) AS permit_history_count,
      CASE WHEN p_partkey % 6 = 0 THEN 'Plat dak en twee ingangen' WHEN p_partkey % 6 = 1
        THEN 'Kluswoning te renoveren' ELSE '' END AS description,
      CASE p_partkey % 4 WHEN 0 THEN 'known' WHEN 1 THEN 'known' WHEN 2 THEN 'from_price' ELSE 'on_request' END
        AS asking_price_status,
      CASE WHEN p_partkey % 8 = 0 THEN NULL ELSE cast(6000 + (p_partkey * 53) % 30000 as double) END AS annual_rent
    FROM part""",
)

_view(
    "snapshots",
    "lineitem",
    """
    SELECT l_partkey AS listing_id, l_shipdate AS observed_at,
      l_orderkey * 10 + l_linenumber AS snapshot_seq,
      CASE WHEN l_suppkey % 10 = 0 THEN NULL ELSE cast(floor(l_extendedprice / 5000) * 5000 as double) END AS asking_price,
      CASE l_returnflag WHEN 'A' THEN 'active' WHEN 'N' THEN 'active'
        ELSE CASE WHEN l_linestatus = 'F' THEN 'withdrawn' ELSE 'under_offer' END END AS listing_status,
      l_quantity AS surface_m2
    FROM lineitem""",
)

_view(
    "permits",
    "orders",
    """
    SELECT o_orderkey AS permit_id, o_custkey AS property_id, cast(o_orderdate as date) AS application_date,
      o_orderpriority AS permit_type,
      CASE o_orderstatus WHEN 'F' THEN 'granted' WHEN 'O' THEN 'pending'
        ELSE CASE WHEN o_orderkey % 4 = 0 THEN 'rejected' WHEN o_orderkey % 4 = 1 THEN 'lapsed'
        ELSE 'withdrawn' END END AS status,
      concat('REF-', cast(o_orderkey % 5000 as varchar(20))) AS reference_number,
      o_orderkey % 3 = 0 AS affects_investment_case
    FROM orders""",
)

_view(
    "candidates",
    "orders",
    """
    SELECT o_orderkey AS candidate_id, o_custkey AS listing_id, o_orderdate AS detected_at,
      CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE cast(o_orderkey % 101 as int) END AS hidden_value_score,
      cast((o_orderkey * 7) % 101 as int) AS investment_score,
      CASE substring(o_orderpriority, 1, 1) WHEN '1' THEN 'urgent' WHEN '2' THEN 'high' WHEN '3' THEN 'medium'
        ELSE 'low' END AS priority
    FROM orders""",
)

_view(
    "sources",
    "nation",
    """
    SELECT n_nationkey AS source_id, concat('portal', cast(n_nationkey as varchar(20)), '.example') AS source_name,
      n_name AS display_name, n_regionkey % 2 = 0 AS is_enabled,
      CASE WHEN n_regionkey = 1 THEN 'broker' ELSE 'portal' END AS source_type
    FROM nation""",
)

_view(
    "observations",
    "events",
    """
    SELECT user_id AS listing_id, cast(user_id % 5 as int) AS source_id, ts AS observed_at, event_id AS seq,
      cast(floor(value) as double) AS asking_price,
      CASE event_type WHEN 'purchase' THEN 'sold' WHEN 'error' THEN 'withdrawn' ELSE 'active' END AS listing_status
    FROM events""",
)

_view(
    "register_docs",
    "lineitem",
    """
    SELECT l_partkey AS property_id, l_suppkey AS doc_no,
      max(l_quantity) * cast(4 as double) AS official_area,
      CASE WHEN l_suppkey % 3 = 0 THEN 'kantoorfunctie' ELSE 'woonfunctie' END AS usage_purpose,
      CASE WHEN l_suppkey % 4 = 0 THEN 'A' ELSE '' END AS house_letter
    FROM lineitem GROUP BY l_partkey, l_suppkey""",
)

_view(
    "sales",
    "lineitem",
    """
    SELECT l_partkey AS property_id, l_orderkey * 10 + l_linenumber AS sale_id, cast(l_shipdate as date) AS sale_date,
      CASE WHEN l_suppkey % 10 = 3 THEN NULL ELSE l_extendedprice * 10 END AS price,
      CASE l_returnflag WHEN 'A' THEN 'sale' WHEN 'N' THEN 'auction_sale' ELSE 'gift' END AS transaction_type
    FROM lineitem""",
)

_view(
    "comps",
    "lineitem",
    """
    SELECT l_partkey AS subject_id, l_orderkey * 10 + l_linenumber AS comp_id,
      concat('Straat ', cast(l_suppkey as varchar(20))) AS address,
      CASE WHEN l_suppkey % 7 = 0 THEN NULL ELSE cast((l_orderkey * 13) % 2000 as double) END AS distance_meters,
      l_quantity * 4 AS living_area_m2,
      CASE WHEN l_suppkey % 5 = 0 THEN NULL ELSE l_extendedprice * 10 END AS sold_price,
      l_extendedprice * 11 AS asking_price,
      CASE WHEN l_suppkey % 11 = 0 THEN NULL ELSE cast(l_shipdate as date) END AS sold_date
    FROM lineitem""",
)

# Scan runs: one per source and day of observations; every ninth run failed.
_view(
    "runs",
    "events",
    """
    SELECT cast(user_id % 5 as int) AS source_id, cast(ts as date) AS run_date,
      concat(cast(user_id % 5 as varchar(20)), '-', cast(cast(ts as date) as varchar(20))) AS run_id,
      min(ts) AS started_at, max(ts) AS completed_at, count(*) AS items_found,
      count(CASE WHEN event_type = 'signup' THEN 1 END) AS items_new,
      count(CASE WHEN event_type = 'click' THEN 1 END) AS items_changed,
      CASE WHEN (extract(day from cast(ts as date)) + user_id % 5) % 9 = 0 THEN 'failed' ELSE 'completed' END AS status
    FROM events
    GROUP BY user_id % 5, cast(ts as date)""",
)

# Free-text fields in the many shapes in which sources write them.
_view(
    "raw_fields",
    "part",
    """
    SELECT p_partkey AS row_id,
      CASE p_partkey % 10
        WHEN 0 THEN concat('€ ', cast(1 + p_partkey % 9 as varchar(20)), '.', cast(100 + p_partkey % 900 as varchar(20)), '.000 k.k.')
        WHEN 1 THEN concat('Vanaf € ', cast(200 + p_partkey % 700 as varchar(20)), '.500')
        WHEN 2 THEN 'Prijs op aanvraag'
        WHEN 3 THEN concat(cast(200000 + p_partkey as varchar(20)), ',50 euro')
        WHEN 4 THEN concat('€ ', cast(200 + p_partkey % 100 as varchar(20)), '.000 - € 400.000')
        WHEN 5 THEN concat('Veiling ', cast(150000 + p_partkey as varchar(20)))
        WHEN 6 THEN concat(cast(1 + p_partkey % 9 as varchar(20)), ',', cast(100 + p_partkey % 900 as varchar(20)), '.75')
        WHEN 7 THEN ''
        WHEN 8 THEN 'POA'
        ELSE 'nader te bepalen' END AS price_text,
      CASE p_partkey % 6
        WHEN 0 THEN concat(cast(50 + p_partkey % 200 as varchar(20)), ' m²')
        WHEN 1 THEN concat('4 kamers, ', cast(60 + p_partkey % 90 as varchar(20)), ',5 m2 wonen')
        WHEN 2 THEN concat('circa ', cast(1 + p_partkey % 3 as varchar(20)), '.', cast(100 + p_partkey % 800 as varchar(20)), ' M2')
        WHEN 3 THEN cast(p_partkey % 300 as varchar(20))
        WHEN 4 THEN '' ELSE 'onbekend' END AS area_text,
      CASE p_partkey % 8
        WHEN 0 THEN concat('2024-0', cast(1 + p_partkey % 9 as varchar(20)), '-1', cast(p_partkey % 10 as varchar(20)))
        WHEN 1 THEN concat('1', cast(p_partkey % 10 as varchar(20)), '-0', cast(1 + p_partkey % 9 as varchar(20)), '-2023')
        WHEN 2 THEN concat(cast(1 + p_partkey % 28 as varchar(20)), ' maart ', cast(2000 + p_partkey % 25 as varchar(20)))
        WHEN 3 THEN concat('sinds ', cast(1 + p_partkey % 28 as varchar(20)), ' oktober 2022')
        WHEN 4 THEN concat('31 februari ', cast(2000 + p_partkey % 25 as varchar(20)))
        WHEN 5 THEN concat('2021/1', cast(p_partkey % 3 as varchar(20)), '/0', cast(1 + p_partkey % 9 as varchar(20)))
        WHEN 6 THEN concat('2 augustus ', cast(2000 + p_partkey % 25 as varchar(20)))
        ELSE 'vandaag' END AS date_text,
      CASE p_partkey % 5 WHEN 0 THEN 'Energielabel a++' WHEN 1 THEN ' c ' WHEN 2 THEN 'n.n.b.' WHEN 3 THEN '' ELSE 'klasse G (zeer slecht)' END AS label_text,
      CASE p_partkey % 5 WHEN 0 THEN '''s-Hertogenbosch' WHEN 1 THEN 'Súdwest-Fryslân' WHEN 2 THEN 'Bergen & Dal'
        WHEN 3 THEN concat('Nuenen  Wijk ', cast(p_partkey as varchar(20))) ELSE 'Köln/Zuid' END AS place_text,
      concat('https://m.example/aanbod/', CASE p_partkey % 4 WHEN 0 THEN 'burgemeester-van-de-poll-' WHEN 1 THEN 'laan-van-meerdervoort-' WHEN 2 THEN 'dorpsstraat-' ELSE 'woning' END,
        CASE WHEN p_partkey % 4 = 3 THEN '' ELSE cast(1 + p_partkey % 150 as varchar(20)) END, CASE p_partkey % 4 WHEN 1 THEN 'a-2' ELSE '' END) AS slug_url,
      concat('POINT(', cast(100000 + p_partkey as varchar(20)), '.5', cast(p_partkey % 10 as varchar(20)), '25 ', cast(400000 + p_partkey as varchar(20)), '.125)') AS point_text,
      CASE p_partkey % 4 WHEN 0 THEN concat('00', cast(363010 + p_partkey as varchar(20))) WHEN 1 THEN concat('NL.', cast(p_partkey as varchar(20))) WHEN 2 THEN 'Geen ID' ELSE '0000' END AS identifier_text,
      CASE p_partkey % 9 WHEN 0 THEN '12' WHEN 1 THEN ' 3.9 ' WHEN 2 THEN '-3.7' WHEN 3 THEN 'abc' WHEN 4 THEN '' WHEN 5 THEN 'NaN' WHEN 6 THEN '1e3' WHEN 7 THEN NULL ELSE '7 kamers' END AS number_text,
      CASE p_partkey % 7 WHEN 0 THEN 'Ja' WHEN 1 THEN 'off' WHEN 2 THEN '1' WHEN 3 THEN '0' WHEN 4 THEN 'misschien' WHEN 5 THEN NULL ELSE ' TRUE ' END AS flag_text,
      CASE p_partkey % 8 WHEN 0 THEN 'under offer' WHEN 1 THEN 'Sold' WHEN 2 THEN 'lapsed' WHEN 3 THEN '' WHEN 4 THEN NULL WHEN 5 THEN 'auction' WHEN 6 THEN 'sold_subject_to_contract' ELSE 'Reserved' END AS status_text
    FROM part""",
)


# Portal pages made from the listings, in four kinds: structured data, detail list, broken structured data
# with share tags, and plain classes.
_view(
    "portal_pages",
    "part",
    f"""
    SELECT listing_id AS page_id, concat('https://portal', cast(source_id as varchar(20)), '.example/detail/koop/object-', cast(10000 + listing_id as varchar(20)), '/') AS url,
      listing_id % 4 AS kind, title, price, price_nl, price_nl_high, area, city, street, postcode,
      concat('<!DOCTYPE html><html><head><title>', title, ' | Portaal</title>',
        CASE listing_id % 4
          WHEN 0 THEN concat('<script type="application/ld+json">{{"@context":"x","@graph":[{{"@type":"WebPage"}},{{"@type":"Residence","name":"', title, ' te koop","description":"Mooie woning","address":{{"streetAddress":"', street, '","postalCode":"', postcode, '","addressLocality":"', city, '"}},"offers":{{"price":', price, ',"priceCurrency":"EUR"}},"floorSize":{{"value":"', area, ' m2"}},"numberOfBedrooms":', beds, ',"image":["/foto/a.jpg","data:image/png;base64,xx","https://img.example/b.jpg"],"datePosted":"2001-02-03"}}]}}</script>')
          WHEN 2 THEN concat('<script type="application/ld+json">{{"name": "kapot", </script><meta property="og:title" content="', street, '"><meta content="Deel ', title, '" property="og:description"><meta property="og:image" content="https://img.example/og.jpg"><link rel="canonical" href="https://m.example/x/', cast(listing_id as varchar(20)), '">')
          ELSE '' END,
        '</head><body><script>var x = "<p>weg</p>";</script><nav><a href="/">Home</a><a href="/detail/koop/object-', cast(10001 + listing_id as varchar(20)), '/?a=1#foto">Volgende</a><a href="mailto:x@example">Mail</a></nav>',
        CASE listing_id % 4
          WHEN 1 THEN concat('<h1>', street, '</h1><dl><dt>Vraagprijs</dt><dd>&euro; ', price_nl, ' k.k.</dd><dt>Adres</dt><dd>', street, ' ', postcode, '</dd><dt>Plaats</dt><dd>', city, '</dd><dt>Woonoppervlakte:</dt><dd><span>', area, '</span> m&sup2;</dd><dt>Aantal slaapkamers</dt><dd>', beds, ' kamers</dd><dt>Energielabel</dt><dd>Klasse ', label, '</dd><dt>Aangeboden sinds</dt><dd>3 maart 2001</dd><dt>Oorspronkelijke vraagprijs</dt><dd>&euro; ', price_nl_high, '</dd><dt>Soort woonhuis</dt><dd>', kind_text, '</dd><dt>Bouwjaar</dt><dd>1975</dd><dt>Makelaar</dt><dd>Janssen</dd></dl><img src="/foto/1.jpg"><img data-src="/foto/2.jpg"><img src="data:abc">')
          WHEN 3 THEN concat('<div class="page"><div class="breadcrumb">Home</div><h2 class="single__title">', street, '</h2><div class="object-address"><div>', street, '</div>, ', postcode, ' ', city, '</div><span class="vraagprijs">&euro; ', price_nl, '</span><div class="specs"><div>Woonoppervlakte ', area, ' m&sup2;</div></div><div class="omschrijving">Ruime woning met <b>tuin</b>.</div></div>')
          ELSE concat('<h1>', title, '</h1><p>Vrij uitzicht</p>') END,
        '</body></html>') AS html
    FROM (
      SELECT listing_id, source_id, title, coalesce(city, 'Onbekend') AS city, concat('Straat ', cast(1 + listing_id % 200 as varchar(20))) AS street,
        concat(cast(1000 + listing_id % 9000 as varchar(20)), ' AB') AS postcode,
        cast(cast(floor(coalesce(asking_price, 250000)) as bigint) as varchar(20)) AS price,
        concat(cast(100 + listing_id % 900 as varchar(20)), '.', cast(100 + listing_id % 800 as varchar(20))) AS price_nl,
        concat('1.', cast(100 + listing_id % 900 as varchar(20)), '.000') AS price_nl_high,
        cast(cast(coalesce(surface_m2, 75) as int) as varchar(20)) AS area, cast(coalesce(bedrooms, 3) as varchar(20)) AS beds, coalesce(energy_label, 'C') AS label, property_type AS kind_text
      FROM ({VIEWS["listings"][1].strip()}) base) fields""",
)

# Overview pages of a second portal: cards and links per city.
_view(
    "card_pages",
    "part",
    f"""
    SELECT listing_id AS page_id, 'https://klus.example/zoeken' AS url, source_id, asking_price, city,
      concat('<div class="grid">', '<a href="/pand/', cast(listing_id as varchar(20)), '"><div class="listing-card"><strong class="mobile-title">', coalesce(city, ''), '</strong><span class="min-h-40p">', title,
        '</span><img class="listing-thumb" src="//img.example/', cast(listing_id as varchar(20)), '.jpg" alt="Woonhuis, 3 kamers in X"><div class="kvg-metrics-row"><span class="kvg-metric"><span class="v">4</span></span><span class="kvg-metric"><span class="v">', cast(coalesce(cast(surface_m2 as int), 0) as varchar(20)),
        ' m²</span></span><span class="kvg-metric"><span class="v">', cast(coalesce(cast(plot_size_m2 as int), 0) as varchar(20)), ' m²</span></span></div><span class="kvg-price-now">€ ', cast(100 + listing_id % 900 as varchar(20)), '.500</span></div></a>',
        '<a href="/info/', cast(listing_id as varchar(20)), '"><div class="listing-card"><strong class="mobile-title">Elders</strong></div></a></div>',
        '<ul><li><a href="/kluswoning-breda">', cast(1 + listing_id % 30 as varchar(20)), ' kluswoningen Breda Noord-Brabant</a></li><li><a href="/kluswoning-den-haag">Den Haag ', cast(1 + listing_id % 20 as varchar(20)), '</a></li><li><a href="/kluswoning-bergen-op-zoom"></a></li></ul>') AS html
    FROM ({VIEWS["listings"][1].strip()}) base""",
)


# Detail pages of the second portal.
_view(
    "works_pages",
    "part",
    f"""
    SELECT listing_id AS page_id, concat('https://klus.example/pand/', cast(listing_id as varchar(20))) AS url, surface_m2, bedrooms, asking_price, construction_year, property_type,
      concat('<html><head><script type="application/ld+json">{{"@type":"RealEstateListing","datePublished":"2001-05-0', cast(1 + listing_id % 9 as varchar(20)), 'T08:00:00Z","address":{{"postalCode":"1234 AB","addressRegion":"Utrecht"}},"offers":{{"price":"', cast(100000 + listing_id as varchar(20)), '"}},"image":["//img.example/a.jpg"]}}</script></head><body><h1>Straat ', cast(1 + listing_id % 90 as varchar(20)), ' Breda kluswoning te koop</h1>',
        CASE WHEN listing_id % 2 = 0 THEN concat('<p class="kz-intro">Deze ', lower(property_type), ' in Breda is ruim.</p>') ELSE '' END,
        CASE WHEN listing_id % 3 = 0 THEN '' ELSE concat('<span class="kvg-price-now">€ ', cast(100 + listing_id % 900 as varchar(20)), '.000</span>') END,
        '<div class="grid"><div><span>Leefruimte</span> ', cast(coalesce(cast(surface_m2 as int), 0) as varchar(20)), ' m²</div><div>Perceel <b>1.250</b> m²</div>',
        CASE WHEN bedrooms IS NULL THEN '' ELSE concat('<div>', cast(bedrooms as varchar(20)), ' slaapkamers</div>') END, '<div>Gebouwd in ', cast(coalesce(construction_year, 1899) as varchar(20)), '</div></div></body></html>') AS html
    FROM ({VIEWS["listings"][1].strip()}) base""",
)


# Millions of rows in a few megabytes, which Spark reads as one or a few tasks: the short rows are dealt over the cores
# before pages, documents and scores are made of them.
COMPACT = ["part"]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view of this module over the tables in ``sf_dir``."""
    table, select = VIEWS[name]
    rows = read(spark, sf_dir, table)
    if table in COMPACT:
        rows = spread(rows, per_core=3)
    body = select.replace("varchar(20)", "string").replace("{", "{{").replace("}", "}}").strip()
    return spark.sql(body.replace(f"FROM {table}", "FROM {" + table + "}"), **{table: rows})


def with_views(names: str, body: str) -> str:
    """SQL text with the named views in front of ``body``; a leading ``WITH`` in it is merged."""
    parts = [f"{n} AS ({VIEWS[n][1].strip()})" for n in names.split()]
    body = body.strip()
    if not parts:
        return body
    if body[:5].upper() == "WITH ":
        return f"WITH {', '.join(parts)}, {body[5:]}"
    return f"WITH {', '.join(parts)} {body}"


def r2(expression: str, decimals: int = 2) -> str:
    """Half-up rounding on the shortest decimal form of a double, as Spark rounds."""
    return f"cast(round(cast(cast(cast({expression} as double) as varchar) as decimal(38, 14)), {decimals}) as double)"


def mean(expression: str, decimals: int = 2) -> str:
    """Mean of values with that many decimals, the same whatever the order of the rows."""
    return f"(cast(sum(cast({expression} as decimal(18, {decimals}))) as double) / nullif(count({expression}), 0))"
