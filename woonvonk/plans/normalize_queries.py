"""Queries that normalise columns: URLs, addresses, numbers, dates, texts, labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from woonvonk.functions import bands, casts, dates, finance, numbers, text
from woonvonk.operators import columns
from woonvonk.plans.registry import query
from woonvonk.plans.views import r2, read, view, with_views

URL = r"^([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#]+)([^?#]*)"


def _part(column: str, group: int) -> str:
    return f"regexp_extract(trim({column}), '{URL}', {group})"


def _norm_url(column: str) -> str:
    return (
        f"CASE WHEN {_part(column, 2)} = '' THEN '' ELSE concat(lower({_part(column, 1)}), '://', "
        f"lower({_part(column, 2)}), regexp_replace({_part(column, 3)}, '/+$', '')) END"
    )


def _norm_text(column: str) -> str:
    return (
        f"coalesce(regexp_replace(regexp_replace(lower(trim({column})), '\\s+', ' ', 'g'), '[^a-z0-9\\s-]', '', 'g'), '')"
    )


def _squash(column: str) -> str:
    return f"trim(regexp_replace({column}, '\\s+', ' ', 'g'))"


def _nn(e: str) -> str:
    return f"nullif({e}, '')"


@query("normalize_url", with_views("listings", f"SELECT listing_id, {_norm_url('source_url')} AS url FROM listings"))
def normalize_url(spark, sf_dir):
    return view(spark, sf_dir, "listings").select("listing_id", text.normalize_url("source_url").alias("url"))


@query(
    "normalize_page_url",
    f"""SELECT page_id, {_norm_url('url')} AS url, lower({_part('url', 2)}) AS host,
      nullif(replace(regexp_replace({_part('url', 3)}, '^/+|/+$', '', 'g'), '/', '::'), '') AS path_id FROM pages""",
)
def normalize_page_url(spark, sf_dir):
    return read(spark, sf_dir, "pages").select(
        "page_id",
        text.normalize_url("url").alias("url"),
        text.url_host("url").alias("host"),
        text.path_identifier("url").alias("path_id"),
    )


@query(
    "normalize_source_url",
    with_views("listings", "SELECT listing_id, regexp_replace(lower(trim(source_url)), '/+$', '') AS url FROM listings"),
)
def normalize_source_url(spark, sf_dir):
    return view(spark, sf_dir, "listings").select("listing_id", text.normalize_source_url("source_url").alias("url"))


@query(
    "stable_identity",
    with_views(
        "listings",
        f"""SELECT listing_id, coalesce(CASE WHEN listing_id % 2 = 0 THEN external_listing_id END, {_nn(_norm_url('source_url'))}) AS identity,
          {_norm_url('source_url')} AS url FROM listings""",
    ),
)
def stable_identity(spark, sf_dir):
    listings = view(spark, sf_dir, "listings").withColumn(
        "external_listing_id", F.when(F.col("listing_id") % 2 == 0, F.col("external_listing_id")).otherwise(" ")
    )
    return columns.stable_identity(listings).select("listing_id", "identity", "url")


@query("normalize_text", with_views("listings", f"SELECT listing_id, {_norm_text('address')} AS address_text FROM listings"))
def normalize_text(spark, sf_dir):
    return view(spark, sf_dir, "listings").select("listing_id", text.normalize_text("address").alias("address_text"))


POSTCODE = r"\b([1-9][0-9]{3})\s*([A-Za-z]{2})\b"
HOUSE = r"\b(\d+)([A-Za-z0-9\-]*)\b"


@query(
    "address_components",
    with_views(
        "listings",
        f"""SELECT listing_id, {_norm_text('address')} AS normalized_address,
          nullif(concat(regexp_extract(address, '{POSTCODE}', 1), upper(regexp_extract(address, '{POSTCODE}', 2))), '') AS postcode,
          {_nn(f"regexp_extract({_norm_text('address')}, '{HOUSE}', 1)")} AS house_number,
          {_nn(f"regexp_extract({_norm_text('address')}, '{HOUSE}', 2)")} AS addition FROM listings""",
    ),
)
def address_components(spark, sf_dir):
    return view(spark, sf_dir, "listings").select("listing_id", text.address_components("address").alias("a")).select(
        "listing_id", "a.*"
    )


REGISTER = r"^(.*?)\b(\d{1,5})(?:\s*[-/]?\s*([A-Za-z]))?(?:\s*[-/]?\s*([A-Za-z0-9]{1,6}))?\b"


@query(
    "address_components_register",
    with_views(
        "listings",
        f"""WITH cut AS (SELECT listing_id, address, regexp_extract(address, '{REGISTER}', 1) AS street,
            regexp_extract(address, '{REGISTER}', 2) AS number, upper(regexp_extract(address, '{REGISTER}', 3)) AS letter,
            upper(regexp_extract(address, '{REGISTER}', 4)) AS addition FROM listings)
        SELECT listing_id, nullif(concat(regexp_extract(address, '(\\d{{4}})\\s*([A-Za-z]{{2}})', 1),
            upper(regexp_extract(address, '(\\d{{4}})\\s*([A-Za-z]{{2}})', 2))), '') AS postcode,
          try_cast(number as int) AS house_number, letter AS house_letter,
          CASE WHEN addition = letter THEN '' ELSE addition END AS house_number_addition, trim(street, ' ,') AS street_name
        FROM cut""",
    ),
)
def address_components_register(spark, sf_dir):
    parsed = text.register_address("address", F.lit(None).cast("string"))
    return view(spark, sf_dir, "listings").select("listing_id", parsed.alias("a")).select("listing_id", "a.*")


@query(
    "normalize_postcode",
    with_views(
        "listings",
        r"""SELECT listing_id,
          nullif(concat(regexp_extract(address, '(\d{4})\s*([A-Za-z]{2})', 1), upper(regexp_extract(address, '(\d{4})\s*([A-Za-z]{2})', 2))), '') AS compact,
          CASE WHEN regexp_matches(address, '\b\d{4}\s?[A-Za-z]{2}\b') THEN concat(regexp_extract(address, '\b(\d{4})\s?([A-Za-z]{2})\b', 1), ' ',
            upper(regexp_extract(address, '\b(\d{4})\s?([A-Za-z]{2})\b', 2))) END AS spaced,
          CASE WHEN regexp_matches(replace(upper(replace(address, ' AB', 'AB')), '-', ' '), '(^|\s)\d{4}[A-Z]{2}(\s|$)')
            THEN concat(regexp_extract(upper(replace(address, ' AB', 'AB')), '(\d{4})([A-Z]{2})$', 1), ' AB') END AS token
        FROM listings""",
    ),
)
def normalize_postcode(spark, sf_dir):
    glued = F.regexp_replace("address", " AB", "AB")
    return view(spark, sf_dir, "listings").select(
        "listing_id",
        text.compact_postcode("address", text.LOOSE_POSTCODE).alias("compact"),
        text.spaced_postcode("address").alias("spaced"),
        text.postcode_token(glued).alias("token"),
    )


@query(
    "normalize_address_key",
    with_views("listings", f"SELECT listing_id, nullif(lower({_squash('address')}), '') AS address_key FROM listings"),
)
def normalize_address_key(spark, sf_dir):
    return view(spark, sf_dir, "listings").select("listing_id", text.address_key("address").alias("address_key"))


def _nl_number(matched: str) -> str:
    return f"try_cast(trim(replace(regexp_replace({matched}, '[. ]', '', 'g'), ',', '.')) as double)"


LOOSE = r"([0-9][0-9.,\s]*)"
EU = r"([-+]?\d[\d.,]*)"


@query(
    "parse_number_eu",
    with_views(
        "raw_fields",
        f"""WITH tokens AS (SELECT row_id, regexp_extract(lower(trim(price_text)), '{EU}', 1) AS t FROM raw_fields)
        SELECT row_id, try_cast(CASE
          WHEN regexp_full_match(t, '\\d{{1,3}}(\\.\\d{{3}})+(,\\d+)?') THEN replace(replace(t, '.', ''), ',', '.')
          WHEN contains(t, ',') AND contains(t, '.') AND instr(reverse(t), ',') < instr(reverse(t), '.') THEN replace(replace(t, '.', ''), ',', '.')
          WHEN contains(t, ',') AND contains(t, '.') THEN replace(t, ',', '')
          WHEN contains(t, ',') THEN replace(t, ',', '.') ELSE t END as double) AS number
        FROM tokens""",
    ),
)
def parse_number_eu(spark, sf_dir):
    return view(spark, sf_dir, "raw_fields").select("row_id", numbers.parse_number_eu("price_text").alias("number"))


@query(
    "parse_number_nl",
    with_views("raw_fields", f"SELECT row_id, {_nl_number(f'''regexp_extract(price_text, '{LOOSE}', 1)''')} AS number FROM raw_fields"),
)
def parse_number_nl(spark, sf_dir):
    return view(spark, sf_dir, "raw_fields").select("row_id", numbers.parse_number_nl("price_text").alias("number"))


@query(
    "parse_price_status",
    with_views(
        "raw_fields",
        f"""WITH cut AS (SELECT row_id, price_text, lower(trim(price_text)) AS t,
            {_nl_number(f'''regexp_extract(price_text, '{LOOSE}', 1)''')} AS n FROM raw_fields),
        s AS (SELECT *, CASE WHEN price_text = '' THEN NULL WHEN t = 'poa' OR contains(t, 'op aanvraag') THEN 'on_request'
            WHEN contains(t, 'vanaf') THEN 'from_price' WHEN contains(t, 'veiling') THEN 'auction'
            WHEN contains(price_text, ' - ') OR contains(t, 'tot') THEN 'range' WHEN n IS NOT NULL THEN 'known'
            ELSE 'unknown' END AS status FROM cut)
        SELECT row_id, CASE WHEN status IN ('from_price', 'auction', 'known') THEN n END AS amount, status FROM s""",
    ),
)
def parse_price_status(spark, sf_dir):
    return view(spark, sf_dir, "raw_fields").select("row_id", numbers.parse_price("price_text").alias("p")).select(
        "row_id", "p.*"
    )


@query(
    "infer_price_from_text",
    f"""WITH cut AS (SELECT doc_id, trim(text) AS t, lower(trim(text)) AS l,
        {_nl_number("regexp_extract(trim(text), '€\\s*([0-9][0-9.,\\s]*)', 1)")} AS n FROM documents),
    s AS (SELECT *, CASE WHEN t = '' THEN 'unknown'
        WHEN regexp_matches(l, '\\bprijs\\s+op\\s+aanvraag\\b|\\bpoa\\b|\\bop\\s+aanvraag\\b|\\bprijs\\s+te\\s+bespreken\\b|\\bn\\.v\\.t\\.?\\b') THEN 'on_request'
        WHEN regexp_matches(l, '\\b(vanaf|starting from)\\b') THEN 'from_price'
        WHEN regexp_matches(l, '\\b(veiling|auction)\\b') THEN 'auction'
        WHEN regexp_matches(l, '\\b(tot|t/m|tot en met)\\b') OR contains(t, ' - ') THEN 'range'
        WHEN n IS NOT NULL THEN 'known' ELSE 'unknown' END AS status FROM cut)
    SELECT doc_id, CASE WHEN status IN ('from_price', 'auction', 'known') THEN n END AS asking_price,
      status AS asking_price_status, CASE WHEN status <> 'unknown' THEN length(t) END AS text_length FROM s""",
)
def infer_price_from_text(spark, sf_dir):
    found = numbers.with_inferred_price(read(spark, sf_dir, "documents").select("doc_id", "text"), "text")
    return found.select(
        "doc_id", "asking_price", "asking_price_status", F.length("asking_price_text").cast("bigint").alias("text_length")
    )


@query(
    "infer_price_fields",
    with_views(
        "raw_fields",
        f"""WITH cut AS (SELECT row_id, trim(price_text) AS t, lower(trim(price_text)) AS l,
            {_nl_number("regexp_extract(trim(price_text), '€\\s*([0-9][0-9.,\\s]*)', 1)")} AS n FROM raw_fields),
        s AS (SELECT *, CASE WHEN t = '' THEN 'unknown'
            WHEN regexp_matches(l, '\\bpoa\\b|\\bop\\s+aanvraag\\b') THEN 'on_request'
            WHEN regexp_matches(l, '\\bvanaf\\b') THEN 'from_price' WHEN regexp_matches(l, '\\bveiling\\b') THEN 'auction'
            WHEN contains(t, ' - ') THEN 'range' WHEN n IS NOT NULL THEN 'known' ELSE 'unknown' END AS status FROM cut)
        SELECT row_id, CASE WHEN status IN ('from_price', 'auction', 'known') THEN n END AS asking_price,
          status AS asking_price_status, CASE WHEN status <> 'unknown' THEN t END AS asking_price_text FROM s""",
    ),
)
def infer_price_fields(spark, sf_dir):
    found = numbers.with_inferred_price(view(spark, sf_dir, "raw_fields").select("row_id", "price_text"), "price_text")
    return found.select("row_id", "asking_price", "asking_price_status", "asking_price_text")


@query(
    "parse_area",
    with_views(
        "raw_fields",
        f"""WITH cut AS (SELECT row_id, area_text, regexp_extract(lower(area_text), '([0-9][0-9.,\\s]*)\\s*(m2|m²)', 1) AS u FROM raw_fields)
        SELECT row_id, CASE WHEN u <> '' THEN {_nl_number('u')}
          ELSE {_nl_number(f"regexp_extract(area_text, '{LOOSE}', 1)")} END AS area_m2 FROM cut""",
    ),
)
def parse_area(spark, sf_dir):
    return view(spark, sf_dir, "raw_fields").select("row_id", numbers.parse_area("area_text").alias("area_m2"))


@query(
    "normalize_energy_label",
    with_views(
        "raw_fields",
        r"""SELECT row_id, coalesce(nullif(regexp_extract(upper(label_text), '\b([A-G](?:\+{1,3})?)', 1), ''), nullif(trim(label_text), '')) AS label FROM raw_fields""",
    ),
)
def normalize_energy_label(spark, sf_dir):
    return view(spark, sf_dir, "raw_fields").select("row_id", text.energy_label("label_text").alias("label"))


@query(
    "parse_date_multi",
    with_views(
        "raw_fields",
        r"""WITH months(name, no) AS (VALUES ('maart', 3), ('oktober', 10), ('februari', 2), ('augustus', 8)),
        cut AS (SELECT row_id, trim(date_text) AS t, regexp_extract(lower(date_text), '(\d{1,2})\s+([a-z]+)\s+(\d{4})', 1) AS d,
          regexp_extract(lower(date_text), '(\d{1,2})\s+([a-z]+)\s+(\d{4})', 2) AS m,
          regexp_extract(lower(date_text), '(\d{1,2})\s+([a-z]+)\s+(\d{4})', 3) AS y FROM raw_fields)
        SELECT row_id, cast(cast(coalesce(try_strptime(t, '%Y-%m-%d'), try_strptime(t, '%d-%m-%Y'), try_strptime(t, '%d/%m/%Y'),
          try_strptime(t, '%Y/%m/%d'), try_strptime(concat(y, '-', cast(no as varchar), '-', d), '%Y-%m-%d')) as date) as varchar) AS parsed
        FROM cut LEFT JOIN months ON name = m""",
    ),
)
def parse_date_multi(spark, sf_dir):
    return view(spark, sf_dir, "raw_fields").select("row_id", dates.parse_date("date_text").cast("string").alias("parsed"))


@query(
    "slugify_place",
    with_views(
        "raw_fields",
        r"""SELECT row_id,
          trim(regexp_replace(regexp_replace(replace(strip_accents(lower(trim(place_text))), '''', ''), '[^a-z0-9\-\s]', ' ', 'g'), '[\s\-]+', '-', 'g'), '-') AS area_slug,
          trim(regexp_replace(replace(lower(strip_accents(place_text)), '&', ' en '), '[^a-z0-9]+', '-', 'g'), '-') AS municipality_slug
        FROM raw_fields""",
    ),
)
def slugify_place(spark, sf_dir):
    return view(spark, sf_dir, "raw_fields").select(
        "row_id",
        text.place_slug("place_text").alias("area_slug"),
        text.municipality_slug("place_text").alias("municipality_slug"),
    )


@query(
    "slug_to_title",
    with_views(
        "raw_fields",
        r"""WITH cut AS (SELECT row_id, regexp_extract(slug_url, '([^/]+)$', 1) AS slug FROM raw_fields),
        parts AS (SELECT *, regexp_extract(slug, '^(.+?)-(\d+[a-z]?)(?:-(\d+[a-z]?))?$', 1) AS street,
          upper(regexp_extract(slug, '^(.+?)-(\d+[a-z]?)(?:-(\d+[a-z]?))?$', 2)) AS number,
          upper(regexp_extract(slug, '^(.+?)-(\d+[a-z]?)(?:-(\d+[a-z]?))?$', 3)) AS suffix FROM cut),
        named AS (SELECT *, CASE street WHEN 'burgemeester-van-de-poll' THEN 'Burgemeester van de Poll'
          WHEN 'laan-van-meerdervoort' THEN 'Laan van Meerdervoort' WHEN 'dorpsstraat' THEN 'Dorpsstraat' END AS shown FROM parts)
        SELECT row_id, CASE WHEN slug <> 'woning' THEN concat(shown, ' ', number) END AS title,
          CASE WHEN slug <> 'woning' THEN concat(shown, ' ', number, CASE WHEN suffix <> '' THEN concat('-', suffix) ELSE '' END) END AS address
        FROM named""",
    ),
)
def slug_to_title(spark, sf_dir):
    return view(spark, sf_dir, "raw_fields").select("row_id", text.slug_title("slug_url").alias("s")).select("row_id", "s.*")


@query(
    "external_id_from_url",
    with_views(
        "listings",
        r"""SELECT listing_id, nullif(regexp_extract(source_url, 'object-(\d{4,})', 1), '') AS external_id,
          regexp_replace(regexp_replace(source_url, '^https://[^/]+/|/$', '', 'g'), '/', '::', 'g') AS path_id FROM listings""",
    ),
)
def external_id_from_url(spark, sf_dir):
    return view(spark, sf_dir, "listings").select(
        "listing_id",
        text.digits_in_url("source_url").alias("external_id"),
        text.path_identifier("source_url").alias("path_id"),
    )


@query(
    "city_from_address",
    with_views(
        "listings",
        r"""WITH full_text AS (SELECT listing_id, concat(address, ' ', coalesce(replace(city, '#', 'stad'), 'NL')) AS a FROM listings)
        SELECT listing_id, nullif(trim(regexp_replace(trim(regexp_replace(regexp_extract(a, '(\S+ \S+)$', 1), '\b\d{4}\s?[A-Za-z]{2}\b', '')), '\bNL\b', '')), '') AS tail_city,
          regexp_extract(a, ', (.*)$', 1) AS comma_city,
          nullif(trim(regexp_extract(a, '\b\d{4}\s?[A-Za-z]{2}\s+([A-Za-z][A-Za-z\-\s]{1,60})\b', 1)), '') AS postcode_city FROM full_text""",
    ),
)
def city_from_address(spark, sf_dir):
    full = F.concat("address", F.lit(" "), F.coalesce(F.regexp_replace("city", "#", "stad"), F.lit("NL")))
    return view(spark, sf_dir, "listings").select("listing_id", full.alias("a")).select(
        "listing_id",
        text.city_from_tail("a").alias("tail_city"),
        text.last_comma_part("a").alias("comma_city"),
        text.city_after_postcode("a").alias("postcode_city"),
    )


@query(
    "first_non_empty",
    with_views(
        "listings",
        """SELECT listing_id, coalesce(CASE WHEN listing_id % 3 = 0 THEN NULL ELSE nullif(energy_label, '') END,
            CASE WHEN listing_id % 3 <> 1 THEN cast(bedrooms as varchar) END, nullif(city, ''), 'geen') AS picked FROM listings""",
    ),
)
def first_non_empty(spark, sf_dir):
    payload = F.to_json(F.struct(F.when(F.col("listing_id") % 3 != 1, F.col("bedrooms")).alias("bedrooms"), "city"))
    rows = view(spark, sf_dir, "listings").select(
        "listing_id",
        F.when(F.col("listing_id") % 3 != 0, F.col("energy_label")).alias("energy_label"),
        F.lit("").alias("bedrooms"),
        payload.alias("raw_payload"),
    )
    picked = columns.pick(rows, "raw_payload", ["energy_label", "bedrooms", "city"])
    return rows.select("listing_id", F.coalesce(picked, F.lit("geen")).alias("picked"))


STATUS_SQL = """CASE WHEN lower(trim(coalesce(status_text, ''))) IN ('sold_subject_to_contract', 'under contract', 'under offer', 'under_offer') THEN 'under_offer'
  WHEN lower(trim(status_text)) IN ('sold', 'auction') THEN 'sold' WHEN lower(trim(status_text)) IN ('withdrawn', 'revoked', 'lapsed') THEN 'withdrawn'
  WHEN lower(trim(coalesce(status_text, ''))) IN ('', 'unknown', 'active') THEN 'active' ELSE lower(trim(status_text)) END"""


@query("normalize_status", with_views("raw_fields", f"SELECT row_id, {STATUS_SQL} AS status FROM raw_fields"))
def normalize_status(spark, sf_dir):
    return view(spark, sf_dir, "raw_fields").select("row_id", text.normalize_status("status_text").alias("status"))


@query(
    "coerce_enums",
    with_views(
        "sales permits",
        """SELECT 'transaction' AS kind, sale_id AS record_id, CASE WHEN transaction_type IN ('sale', 'auction_sale', 'transfer', 'merger_or_split') THEN transaction_type ELSE 'unknown' END AS code FROM sales
        UNION ALL SELECT 'permit', permit_id, CASE WHEN permit_type IN ('1-URGENT', '2-HIGH') THEN permit_type ELSE 'unknown' END FROM permits
        UNION ALL SELECT 'development', permit_id, CASE WHEN status IN ('granted', 'pending') THEN status ELSE 'other' END FROM permits""",
    ),
)
def coerce_enums(spark, sf_dir):
    sales, permits = view(spark, sf_dir, "sales"), view(spark, sf_dir, "permits")
    return (
        sales.select(F.lit("transaction").alias("kind"), F.col("sale_id").alias("record_id"), columns.transaction_type("transaction_type").alias("code"))
        .union(permits.select(F.lit("permit"), "permit_id", casts.code_or("permit_type", ["1-URGENT", "2-HIGH"])))
        .union(permits.select(F.lit("development"), "permit_id", casts.code_or("status", ["granted", "pending"], "other")))
    )


@query(
    "source_domain",
    with_views(
        "listings",
        r"""SELECT listing_id, concat(regexp_extract(lower(source_url), '://(www\.)?(portal\d+)\.example', 2), '.example') AS domain,
          CASE WHEN source_id = 3 THEN 'Portaal Drie' ELSE concat('portal', cast(source_id as varchar), '.example') END AS display_name FROM listings""",
    ),
)
def source_domain(spark, sf_dir):
    domain = text.source_domain("source_url")
    return view(spark, sf_dir, "listings").select(
        "listing_id", domain.alias("domain"), columns.display_name(domain, {"portal3.example": "Portaal Drie"}).alias("display_name")
    )


@query(
    "validate_url",
    with_views(
        "listings",
        """WITH urls AS (SELECT listing_id, CASE listing_id % 6 WHEN 0 THEN source_url WHEN 1 THEN 'ftp://files.example/x'
            WHEN 2 THEN 'http://localhost:8080/a' WHEN 3 THEN concat('http://192.168.1.', cast(listing_id % 250 as varchar), '/a')
            WHEN 4 THEN 'https://printer.local/login' ELSE concat('https://portal.example/inloggen?id=', cast(listing_id as varchar)) END AS u FROM listings)
        SELECT listing_id, CASE WHEN listing_id % 6 = 1 THEN 'Only http/https URLs are allowed.' WHEN listing_id % 6 IN (2, 4) THEN 'Local/private hosts are not allowed.'
          WHEN listing_id % 6 = 3 THEN 'Local/private IP addresses are not allowed.' END AS problem,
          contains(lower(u), '/login') OR contains(lower(u), 'signin') OR contains(lower(u), 'inloggen') OR contains(lower(u), 'auth') AS login_wall FROM urls""",
    ),
)
def validate_url(spark, sf_dir):
    urls = view(spark, sf_dir, "listings").selectExpr(
        "listing_id",
        """CASE listing_id % 6 WHEN 0 THEN source_url WHEN 1 THEN 'ftp://files.example/x'
        WHEN 2 THEN 'http://localhost:8080/a' WHEN 3 THEN concat('http://192.168.1.', cast(listing_id % 250 as string), '/a')
        WHEN 4 THEN 'https://printer.local/login' ELSE concat('https://portal.example/inloggen?id=', cast(listing_id as string)) END AS u""",
    )
    return urls.select("listing_id", text.url_problem("u").alias("problem"), text.is_login_wall("u").alias("login_wall"))


COMPLETENESS_SQL = """
WITH flags AS (SELECT listing_id, concat_ws(',',
    CASE WHEN asking_price IS NULL AND asking_price_status IN ('unknown', '') THEN 'asking_price' END,
    CASE WHEN surface_m2 IS NULL THEN 'surface_m2' END, CASE WHEN plot_size_m2 IS NULL THEN 'plot_size_m2' END,
    CASE WHEN bedrooms IS NULL THEN 'bedrooms' END, CASE WHEN energy_label IS NULL THEN 'energy_label' END,
    CASE WHEN construction_year IS NULL THEN 'construction_year' END, 'listed_since',
    CASE WHEN listing_id % 2 = 0 THEN 'broker' END) AS missing_fields
  FROM (SELECT * REPLACE (CASE WHEN listing_id % 4 = 3 THEN 'unknown' ELSE asking_price_status END AS asking_price_status) FROM listings))
SELECT listing_id, missing_fields, CASE WHEN missing_fields = '' THEN 'fully_imported' ELSE 'partially_imported' END AS import_status FROM flags"""


@query("completeness", with_views("listings", COMPLETENESS_SQL))
def completeness(spark, sf_dir):
    rows = view(spark, sf_dir, "listings").withColumns(
        {
            "listed_since": F.lit(None).cast("string"),
            "broker": F.when(F.col("listing_id") % 2 == 0, F.lit("")).otherwise("Makelaar X"),
            "asking_price_status": F.when(F.col("listing_id") % 4 == 3, "unknown").otherwise(F.col("asking_price_status")),
        }
    )
    checked = columns.completeness(rows)
    return checked.select("listing_id", F.array_join("missing_fields", ",").alias("missing_fields"), "import_status")


@query(
    "text_quality_pick",
    with_views(
        "listings",
        r"""WITH scored AS (SELECT listing_id, title, address,
            90 + CASE WHEN regexp_matches(title, '\b\d+[A-Za-z]?\b') THEN 1 ELSE 0 END + CASE WHEN length(title) > 20 THEN 1 ELSE 0 END AS title_score,
            88 + 2 + 1 + CASE WHEN length(address) > 20 THEN 1 ELSE 0 END AS address_score FROM listings)
        SELECT listing_id, CASE WHEN title_score >= address_score THEN title ELSE address END AS picked,
          3 + 2 + 1 + 1 AS address_quality, len(string_split(title, ' ')) + CASE WHEN length(title) > 20 THEN 1 ELSE 0 END AS title_quality,
          regexp_replace(address, '\s*,\s*\d{4}\s?[A-Za-z]{2}$', '') AS short_title FROM scored""",
    ),
)
def text_quality_pick(spark, sf_dir):
    listings = view(spark, sf_dir, "listings")
    with_city = F.concat("address", F.lit(" Stad"))
    return listings.select(
        "listing_id",
        text.best_text([(F.col("title"), 90), (F.col("address"), 88)]).alias("picked"),
        text.address_quality("address").alias("address_quality"),
        text.title_quality("title").cast("bigint").alias("title_quality"),
        text.clean_title(with_city).alias("short_title"),
    )


@query(
    "compose_address",
    with_views(
        "listings",
        r"""SELECT listing_id, regexp_replace(address, ', \d{4} AB$', '') AS street,
          concat(regexp_replace(address, ', \d{4} AB$', ''), ', ', regexp_extract(address, '(\d{4} AB)$', 1), CASE WHEN city IS NULL THEN '' ELSE concat(', ', city) END) AS composed,
          CASE WHEN listing_id % 5 = 0 THEN coalesce(city, 'Onbekend') WHEN city IS NULL THEN address ELSE concat(address, ', ', city) END AS with_city FROM listings""",
    ),
)
def compose_address(spark, sf_dir):
    listings = view(spark, sf_dir, "listings")
    street = text.street_part("address")
    return listings.select(
        "listing_id",
        street.alias("street"),
        text.compose_address(street, F.col("address"), F.col("city")).alias("composed"),
        text.address_with_city(F.when(F.col("listing_id") % 5 != 0, F.col("address")), "city").alias("with_city"),
    )


@query(
    "normalize_identifier",
    with_views(
        "raw_fields",
        """SELECT row_id, CASE WHEN regexp_replace(identifier_text, '[^0-9]', '', 'g') = '' THEN lower(trim(identifier_text))
          ELSE coalesce(nullif(ltrim(regexp_replace(identifier_text, '[^0-9]', '', 'g'), '0'), ''), '0') END AS identifier FROM raw_fields""",
    ),
)
def normalize_identifier(spark, sf_dir):
    return view(spark, sf_dir, "raw_fields").select("row_id", text.normalize_identifier("identifier_text").alias("identifier"))


@query(
    "parse_point",
    with_views(
        "raw_fields",
        r"""WITH cut AS (SELECT row_id, try_cast(regexp_extract(point_text, 'POINT\((\S+) (\S+)\)', 1) as decimal(20, 8)) AS a,
          try_cast(regexp_extract(point_text, 'POINT\((\S+) (\S+)\)', 2) as decimal(20, 8)) AS b FROM raw_fields)
        SELECT row_id, cast(round(a, 3) as double) AS x, cast(round(b, 3) as double) AS y, cast(round(a, 6) as double) AS longitude, cast(round(b, 6) as double) AS latitude FROM cut""",
    ),
)
def parse_point(spark, sf_dir):
    return view(spark, sf_dir, "raw_fields").select(
        "row_id",
        text.point("point_text", ("x", "y"), 3).alias("rd"),
        text.point("point_text", ("longitude", "latitude"), 6).alias("ll"),
    ).select("row_id", "rd.*", "ll.*")


@query(
    "merge_text_preference",
    with_views(
        "listings",
        """SELECT listing_id, CASE WHEN listing_id % 4 IN (0, 1) AND city IS NOT NULL THEN city WHEN listing_id % 4 = 2 THEN 'Oud' WHEN listing_id % 4 = 3 AND city IS NOT NULL THEN city
            ELSE CASE listing_id % 4 WHEN 0 THEN 'N.v.t.' WHEN 1 THEN NULL WHEN 3 THEN 'Janssen Makelaars' END END AS merged FROM listings""",
    ),
)
def merge_text_preference(spark, sf_dir):
    rows = view(spark, sf_dir, "listings").selectExpr(
        "listing_id",
        "city AS extracted",
        "CASE listing_id % 4 WHEN 0 THEN 'N.v.t.' WHEN 2 THEN 'Oud' WHEN 3 THEN 'Janssen Makelaars' END AS existing",
    )
    generic = text.is_generic_title("existing", F.lit("portal"))
    return rows.select("listing_id", text.prefer_text("existing", "extracted", generic).alias("merged"))


@query(
    "metadata_refresh_merge",
    with_views(
        "listings",
        """SELECT listing_id, CASE WHEN listing_id % 3 = 0 THEN title ELSE 'Listing X' END AS title,
          CASE WHEN listing_id % 5 = 0 THEN coalesce(asking_price, 1000.0) ELSE asking_price END AS asking_price,
          concat_ws(',', CASE WHEN listing_id % 3 = 0 THEN 'title' END,
            CASE WHEN listing_id % 7 = 0 AND city IS NOT NULL THEN 'city' END,
            CASE WHEN listing_id % 5 = 0 AND asking_price IS NULL THEN 'asking_price' END) AS changed_fields FROM listings""",
    ),
)
def metadata_refresh_merge(spark, sf_dir):
    stored = view(spark, sf_dir, "listings").withColumns(
        {
            "new_title": F.when(F.col("listing_id") % 3 == 0, F.col("title")).otherwise(" unknown "),
            "title": F.when(F.col("listing_id") % 3 == 0, F.lit("Makelaars")).otherwise("Listing X"),
            "new_city": F.col("city"),
            "city": F.when(F.col("listing_id") % 7 == 0, F.lit(None)).otherwise(F.col("city")),
            "new_asking_price": F.when(F.col("listing_id") % 5 == 0, F.coalesce("asking_price", F.lit(1000.0))),
        }
    )
    merged = columns.merge_refresh(stored, texts=["title", "city"], numbers=["asking_price"], source_name="portal")
    return merged.select("listing_id", "title", "asking_price", F.array_join("changed_fields", ",").alias("changed_fields"))


@query(
    "listing_history_text",
    with_views(
        "listings",
        """SELECT listing_id, CASE WHEN listing_id % 3 = 0 THEN concat('status=active, ', cast(cast(round_even((listing_id % 40) / 2e0, 0) as int) as varchar), '% prijsdaling')
          WHEN days_on_market IS NOT NULL THEN concat('status=active, ', cast(days_on_market as varchar), ' dagen') ELSE 'status=active' END AS history_text,
          CASE WHEN listing_id % 3 = 0 THEN concat('status=active, ', cast(cast(floor((listing_id % 40) / 2e0) as int) as varchar), '% prijsdaling')
          WHEN days_on_market IS NOT NULL THEN concat('status=active, ', cast(days_on_market as varchar), ' dagen') ELSE 'status=active' END AS batch_text FROM listings""",
    ),
)
def listing_history_text(spark, sf_dir):
    drop = F.when(F.col("listing_id") % 3 == 0, (F.col("listing_id") % 40) / 2.0)
    rows = view(spark, sf_dir, "listings")
    return rows.select(
        "listing_id",
        columns.history_text(F.lit("active"), drop, F.col("days_on_market")).alias("history_text"),
        columns.history_text(F.lit("active"), drop, F.col("days_on_market"), truncate=True).alias("batch_text"),
    )


def _euro_sql(e: str) -> str:
    return f"coalesce(concat('€ ', replace(format('{{:,}}', cast(round_even({e}, 0) as bigint)), ',', '.')), 'Onbekend')"


@query(
    "format_labels",
    with_views(
        "listings",
        f"""SELECT listing_id, CASE WHEN asking_price IS NULL THEN 'Onbekend' ELSE {_euro_sql('asking_price')} END AS price_label,
          concat(replace(printf('%.1f', cast(round(cast((listing_id % 97) / 4e0 + 0.1e0 as decimal(38, 12)), 1) as double)), '.', ','), '%') AS pct_label,
          CASE WHEN asking_price IS NULL THEN 'Onbekend' ELSE concat({_euro_sql('asking_price')}, ' -> ', {_euro_sql('asking_price + 1000')}) END AS path_label,
          CASE asking_price_status WHEN 'known' THEN CASE WHEN asking_price IS NULL THEN 'Onbekend' ELSE {_euro_sql('asking_price')} END
            WHEN 'on_request' THEN 'Prijs op aanvraag' ELSE CASE WHEN asking_price IS NULL THEN 'Vanaf …' ELSE concat('Vanaf ', {_euro_sql('asking_price')}) END END AS asking_label,
          CASE listing_id % 3 WHEN 0 THEN 'LOPEND' WHEN 1 THEN 'VERLEEND' ELSE 'LAPSED' END AS permit_label FROM listings""",
    ),
)
def format_labels(spark, sf_dir):
    rows = view(spark, sf_dir, "listings")
    permit = F.when(F.col("listing_id") % 3 == 0, "pending").when(F.col("listing_id") % 3 == 1, "granted").otherwise("lapsed")
    prices = F.array_compact(F.array("asking_price", F.col("asking_price") + 1000))
    return rows.select(
        "listing_id",
        bands.euro("asking_price").alias("price_label"),
        bands.percentage((F.col("listing_id") % 97) / 4.0 + 0.1).alias("pct_label"),
        bands.price_path(prices).alias("path_label"),
        bands.asking_price_text("asking_price_status", "asking_price", F.lit(None).cast("string")).alias("asking_label"),
        bands.permit_label(permit).alias("permit_label"),
    )


@query(
    "provenance_columns",
    with_views(
        "listings",
        """SELECT listing_id, 'woz' AS source, '2001-08-01' AS retrieved_at, 'unknown' AS confidence, cast(latest_woz_value as varchar) AS raw_value,
          cast(floor(latest_woz_value) as bigint) AS normalized_value FROM listings""",
    ),
)
def provenance_columns(spark, sf_dir):
    rows = view(spark, sf_dir, "listings")
    record = columns.provenance(
        F.lit("woz"), F.lit(REFERENCE), F.lit("zeker"), F.col("latest_woz_value"), F.floor("latest_woz_value")
    )
    return rows.select("listing_id", record.alias("p")).select("listing_id", "p.*")


REFERENCE = "2001-08-01"

# Dictionaries of frequent words in the given texts.
WORDS = {"english": ["the and", "with that", "from"], "german": ["der ", "die ", "und "], "dutch": ["plat dak", "renovatie"]}


@query(
    "keyword_flags",
    """WITH t AS (SELECT doc_id, lower(text) AS l FROM documents)
    SELECT doc_id, contains(l, 'the and') OR contains(l, 'with that') OR contains(l, 'from') AS has_english,
      contains(l, 'der ') OR contains(l, 'die ') OR contains(l, 'und ') AS has_german,
      contains(l, 'plat dak') OR contains(l, 'renovatie') AS has_dutch,
      concat_ws(',', CASE WHEN contains(l, 'der ') THEN 'der ' END, CASE WHEN contains(l, 'die ') THEN 'die ' END, CASE WHEN contains(l, 'und ') THEN 'und ' END) AS german_terms
    FROM t""",
)
def keyword_flags(spark, sf_dir):
    flagged = columns.keyword_flags(read(spark, sf_dir, "documents"), "text", WORDS)
    return flagged.select(
        "doc_id", "has_english", "has_german", "has_dutch", F.array_join("german_terms", ",").alias("german_terms")
    )


@query(
    "is_enough_text",
    r"""WITH w AS (SELECT doc_id, cast(len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) as int) AS words FROM documents)
    SELECT doc_id, words, words >= 40 AS enough_for_analysis, words >= 35 AS enough_for_import FROM w""",
)
def is_enough_text(spark, sf_dir):
    return columns.enough_text(read(spark, sf_dir, "documents"), "text").select(
        "doc_id", "words", "enough_for_analysis", "enough_for_import"
    )


@query(
    "safe_casts",
    with_views(
        "raw_fields",
        r"""SELECT row_id, CASE WHEN isnan(try_cast(trim(number_text) as double)) THEN NULL ELSE try_cast(trim(number_text) as double) END AS as_double,
          cast(trunc(CASE WHEN isnan(try_cast(trim(number_text) as double)) THEN NULL ELSE try_cast(trim(number_text) as double) END) as int) AS as_int,
          nullif(trim(number_text), '') AS as_text, try_cast(regexp_extract(number_text, '(\d{1,4})', 1) as int) AS first_digits FROM raw_fields""",
    ),
)
def safe_casts(spark, sf_dir):
    return view(spark, sf_dir, "raw_fields").select(
        "row_id",
        casts.to_double("number_text").alias("as_double"),
        casts.to_int("number_text").alias("as_int"),
        casts.text_or_null("number_text").alias("as_text"),
        casts.first_digits("number_text").alias("first_digits"),
    )


@query(
    "to_string_array",
    with_views(
        "raw_fields",
        """SELECT row_id, concat_ws('|', nullif(trim(number_text), ''), nullif(trim(flag_text), ''), nullif(trim(label_text), '')) AS items,
          CASE WHEN trim(label_text) = '' THEN 0 ELSE 1 END AS single_items FROM raw_fields""",
    ),
)
def to_string_array(spark, sf_dir):
    return view(spark, sf_dir, "raw_fields").select(
        "row_id",
        F.array_join(casts.to_string_array(F.array("number_text", "flag_text", "label_text")), "|").alias("items"),
        F.size(casts.to_string_array(F.array("label_text"))).alias("single_items"),
    )


@query(
    "parse_bool",
    with_views(
        "raw_fields",
        """SELECT row_id, CASE WHEN lower(trim(flag_text)) IN ('1', 'true', 'yes', 'ja', 'enabled', 'on') THEN true
          WHEN lower(trim(flag_text)) IN ('0', 'false', 'no', 'nee', 'disabled', 'off') THEN false ELSE true END AS flag FROM raw_fields""",
    ),
)
def parse_bool(spark, sf_dir):
    return view(spark, sf_dir, "raw_fields").select("row_id", casts.to_bool("flag_text", True).alias("flag"))


@query(
    "normalize_type",
    with_views(
        "listings",
        f"""SELECT listing_id, replace(replace(lower({_squash('property_type')}), '_', ' '), '-', ' ') AS type_text,
          regexp_replace(lower({_squash('property_type')}), '[^a-z0-9\\s]', '', 'g') AS type_key FROM listings""",
    ),
)
def normalize_type(spark, sf_dir):
    return view(spark, sf_dir, "listings").select(
        "listing_id", text.normalize_type("property_type").alias("type_text"), text.label_key("property_type").alias("type_key")
    )


@query(
    "estimate_local_prices",
    with_views(
        "listings",
        f"""WITH hoods AS (SELECT regexp_extract(address, '(\\d{{4}}) AB$', 1) AS hood, avg(asking_price / nullif(surface_m2, 0)) AS hood_ppm2 FROM listings GROUP BY 1)
        SELECT l.listing_id, {r2('coalesce(nullif(asking_price, 0), surface_m2 * 4500) * 0.95e0')} AS street_estimate,
          {r2('coalesce(nullif(asking_price, 0), surface_m2 * 4500) * 0.88e0')} AS neighbourhood_estimate,
          {r2('h.hood_ppm2', 4)} AS neighbourhood_ppm2
        FROM listings l LEFT JOIN hoods h ON h.hood = regexp_extract(l.address, '(\\d{{4}}) AB$', 1)""",
    ),
)
def estimate_local_prices(spark, sf_dir):
    rows = columns.local_prices(view(spark, sf_dir, "listings"))
    return rows.select("listing_id", "street_estimate", "neighbourhood_estimate", F.round("neighbourhood_ppm2", 4).alias("neighbourhood_ppm2"))
