"""URLs, addresses, postcodes, slugs and labels as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from woonvonk.functions.casts import col, let, rx, strip, text_or_null

# Patterns.
URL_PARTS = r"^([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#]+)([^?#]*)"
POSTCODE = rx(r"\b([1-9][0-9]{3})\s*([A-Za-z]{2})\b")
LOOSE_POSTCODE = rx(r"(\d{4})\s*([A-Za-z]{2})")
SPACED_POSTCODE = rx(r"\b(\d{4})\s?([A-Za-z]{2})\b")
HOUSE_NUMBER = r"\b(\d+)([A-Za-z0-9\-]*)\b"
REGISTER_NUMBER = rx(r"^(.*?)\b(\d{1,5})(?:\s*[-/]?\s*([A-Za-z]))?(?:\s*[-/]?\s*([A-Za-z0-9]{1,6}))?\b")
ENERGY_LABEL = r"\b([A-G](?:\+{1,3})?)"
PRIVATE_HOST = (
    r"^(localhost|127\.\d+\.\d+\.\d+|10\.\d+\.\d+\.\d+|192\.168\.\d+\.\d+|169\.254\.\d+\.\d+"
    r"|172\.(1[6-9]|2\d|3[01])\.\d+\.\d+|0\.\d+\.\d+\.\d+|22[4-9]\.\d+\.\d+\.\d+|2[3-5]\d\.\d+\.\d+\.\d+)$"
)
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝ"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUY"
LOWER_PARTICLES = ["de", "den", "der", "het", "van", "von", "en", "op", "te", "ter", "ten"]
MISSING_WORDS = ["", "unknown", "onbekend", "n.v.t.", "nvt", "none", "null"]
GENERIC_TITLES = ["makelaar", "makelaars", "broker listing", "listing"]
LOGIN_MARKS = ["/login", "signin", "inloggen", "auth"]
TITLE_WORDS = [
    "te koop", "winkelpand", "kantoor", "bedrijfspand", "bedrijfsruimte", "horeca", "woning", "appartement",
]


def squash(value: str | Column) -> Column:
    """Trim and collapse runs of white space."""
    return strip(F.regexp_replace(col(value), rx(r"\s+"), " "))


def url_scheme(value: str | Column) -> Column:
    return F.lower(F.regexp_extract(strip(col(value)), URL_PARTS, 1))


def url_authority(value: str | Column) -> Column:
    return F.lower(F.regexp_extract(strip(col(value)), URL_PARTS, 2))


def url_path(value: str | Column) -> Column:
    return F.regexp_extract(strip(col(value)), URL_PARTS, 3)


def url_host(value: str | Column) -> Column:
    """Host without user info and port."""
    return F.regexp_replace(F.regexp_replace(url_authority(value), r"^.*@", ""), r":\d*$", "")


def normalize_url(value: str | Column) -> Column:
    """Lower scheme and host, keep the case of the path, drop query, fragment and closing slashes."""
    joined = F.concat(
        url_scheme(value), F.lit("://"), url_authority(value), F.regexp_replace(url_path(value), r"/+$", "")
    )
    return F.coalesce(F.when(url_authority(value) != "", joined), F.lit(""))


def normalize_source_url(value: str | Column) -> Column:
    """Whole URL lower-cased without closing slashes; the query stays."""
    return F.coalesce(F.regexp_replace(F.lower(strip(col(value))), r"/+$", ""), F.lit(""))


def stable_url(value: str | Column) -> Column:
    return F.nullif(normalize_url(value), F.lit(""))


def normalize_text(value: str | Column) -> Column:
    """Lower, single-spaced, only ``a-z 0-9 -`` kept."""
    spaced = F.regexp_replace(F.lower(strip(col(value))), rx(r"\s+"), " ")
    return F.coalesce(F.regexp_replace(spaced, rx(r"[^a-z0-9\s-]"), ""), F.lit(""))


def compact_postcode(value: str | Column, pattern: str = POSTCODE) -> Column:
    """``1234AB``."""
    digits = F.regexp_extract(col(value), pattern, 1)
    letters = F.upper(F.regexp_extract(col(value), pattern, 2))
    return F.nullif(F.concat(digits, letters), F.lit(""))


def spaced_postcode(value: str | Column) -> Column:
    """``1234 AB``."""
    digits = F.regexp_extract(col(value), SPACED_POSTCODE, 1)
    letters = F.upper(F.regexp_extract(col(value), SPACED_POSTCODE, 2))
    return F.when(digits != "", F.concat_ws(" ", digits, letters))


def postcode_token(value: str | Column) -> Column:
    """First blank-separated token that is exactly four digits and two letters."""
    tokens = F.filter(
        F.split(F.upper(F.translate(col(value), "-", " ")), rx(r"\s+")), lambda t: t.rlike(r"^\d{4}[A-Z]{2}$")
    )
    token = F.get(tokens, F.lit(0))
    return F.when(token.isNotNull(), F.concat_ws(" ", F.substring(token, 1, 4), F.substring(token, 5, 2)))


def address_components(value: str | Column) -> Column:
    clean = normalize_text(value)
    return F.struct(
        clean.alias("normalized_address"),
        compact_postcode(value).alias("postcode"),
        F.nullif(F.regexp_extract(clean, HOUSE_NUMBER, 1), F.lit("")).alias("house_number"),
        F.nullif(F.regexp_extract(clean, HOUSE_NUMBER, 2), F.lit("")).alias("addition"),
    )


def register_address(address: str | Column, postal_code: str | Column) -> Column:
    """Street, number, letter and addition as the public register writes them."""
    text = F.coalesce(col(address), F.lit(""))
    letter = F.upper(F.regexp_extract(text, REGISTER_NUMBER, 3))
    addition = F.upper(F.regexp_extract(text, REGISTER_NUMBER, 4))
    before = F.regexp_replace(F.regexp_extract(text, REGISTER_NUMBER, 1), r"^[ ,]+|[ ,]+$", "")
    return F.struct(
        compact_postcode(F.coalesce(text_or_null(postal_code), text), LOOSE_POSTCODE).alias("postcode"),
        F.regexp_extract(text, REGISTER_NUMBER, 2).try_cast("int").alias("house_number"),
        letter.alias("house_letter"),
        F.when(addition == letter, "").otherwise(addition).alias("house_number_addition"),
        F.coalesce(F.nullif(before, F.lit("")), strip(text)).alias("street_name"),
    )


def address_key(value: str | Column) -> Column:
    """Lookup key: lower, single-spaced, NULL when blank."""
    return F.nullif(F.lower(squash(value)), F.lit(""))


def normalize_type(value: str | Column) -> Column:
    return F.coalesce(F.translate(F.lower(squash(value)), "_-", "  "), F.lit(""))


def label_key(value: str | Column) -> Column:
    return F.coalesce(F.regexp_replace(F.lower(squash(value)), rx(r"[^a-z0-9\s]"), ""), F.lit(""))


def energy_label(value: str | Column) -> Column:
    """Label class found in the text, otherwise the trimmed text itself."""
    found = F.regexp_extract(F.upper(col(value)), ENERGY_LABEL, 1)
    return F.coalesce(F.nullif(found, F.lit("")), text_or_null(value))


def strip_accents(value: Column) -> Column:
    return F.translate(value, ACCENTED, PLAIN)


def place_slug(value: str | Column) -> Column:
    plain = F.translate(strip_accents(F.lower(strip(col(value)))), "'", "")
    dashed = F.regexp_replace(F.regexp_replace(plain, rx(r"[^a-z0-9\-\s]"), " "), rx(r"[\s\-]+"), "-")
    return F.coalesce(F.regexp_replace(dashed, r"^-+|-+$", ""), F.lit(""))


def municipality_slug(value: str | Column) -> Column:
    plain = F.replace(F.lower(strip_accents(col(value))), F.lit("&"), F.lit(" en "))
    return F.coalesce(F.regexp_replace(F.regexp_replace(plain, r"[^a-z0-9]+", "-"), r"^-+|-+$", ""), F.lit(""))


def last_segment(url: str | Column) -> Column:
    return F.element_at(F.split(F.regexp_replace(url_path(url), r"^/+|/+$", ""), "/"), -1)


def title_words(value: Column) -> Column:
    """Capitalised words, particles after the first word in lower case."""
    words = F.filter(F.split(value, rx(r"\s+")), lambda w: w != "")
    cased = F.transform(
        words,
        lambda w, i: F.when((i > 0) & F.lower(w).isin(LOWER_PARTICLES), F.lower(w)).otherwise(
            F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substr(w, F.lit(2))))
        ),
    )
    return F.array_join(cased, " ")


# Last path segments that carry no address.
EMPTY_SLUGS = ["", "woning", "object", "aanbod", "listing"]
SLUG_ADDRESS = r"^(.+?)-(\d+[a-z]?)(?:-(\d+[a-z]?))?$"


def slug_title(url: str | Column) -> Column:
    """Title and address spelled out by the last path segment."""

    def spelled(slug: Column, usable: Column) -> Column:
        street = title_words(F.translate(F.regexp_extract(slug, SLUG_ADDRESS, 1), "-", " "))
        number = F.upper(F.regexp_extract(slug, SLUG_ADDRESS, 2))
        suffix = F.upper(F.regexp_extract(slug, SLUG_ADDRESS, 3))
        plain = title_words(F.translate(slug, "-", " "))
        base = F.when(slug.rlike(SLUG_ADDRESS), F.concat_ws(" ", street, number)).otherwise(plain)

        def named(base: Column) -> Column:
            return F.struct(
                F.when(usable, base).alias("title"),
                F.when(usable, F.when(suffix != "", F.concat_ws("-", base, suffix)).otherwise(base)).alias("address"),
            )

        return let(base, named)

    return let(
        F.lower(strip(last_segment(url))),
        lambda last: let(F.replace(last, F.lit("--"), F.lit("-")), lambda slug: spelled(slug, ~last.isin(EMPTY_SLUGS))),
    )


def digits_in_url(url: str | Column) -> Column:
    """Digits of the last path segment that has at least four of them."""
    segments = F.filter(F.split(url_path(url), "/"), lambda s: s.rlike(r"\d{4,}"))
    return F.nullif(F.regexp_extract(F.get(F.reverse(segments), F.lit(0)), r"(\d{4,})", 1), F.lit(""))


def path_identifier(url: str | Column) -> Column:
    path = F.regexp_replace(url_path(url), r"^/+|/+$", "")
    return F.nullif(F.replace(path, F.lit("/"), F.lit("::")), F.lit(""))


def city_from_tail(address: str | Column) -> Column:
    """Last two words of an address without the postcode and country code."""
    words = F.filter(F.split(strip(col(address)), rx(r"\s+")), lambda w: w != "")
    tail = F.array_join(F.slice(words, F.greatest(F.size(words) - 1, F.lit(1)), F.lit(2)), " ")
    no_code = strip(F.regexp_replace(tail, rx(r"\b\d{4}\s?[A-Za-z]{2}\b"), ""))
    return F.nullif(strip(F.regexp_replace(no_code, r"\bNL\b", "")), F.lit(""))


def city_after_postcode(text: str | Column) -> Column:
    """Words after a postcode; without one, the last comma part when it is only words."""
    after = F.regexp_extract(col(text), rx(r"\b\d{4}\s?[A-Za-z]{2}\s+([A-Za-z][A-Za-z\-\s]{1,60})\b"), 1)
    chunks = F.filter(
        F.transform(F.split(col(text), ","), lambda c: F.regexp_replace(c, r"^[ ,.\-]+|[ ,.\-]+$", "")),
        lambda c: c != "",
    )
    tail = squash(F.get(chunks, F.size(chunks) - 1))
    return F.coalesce(
        F.nullif(strip(after), F.lit("")), F.when(tail.rlike(r"^[\p{L}\-]+( [\p{L}\-]+)*$"), tail)
    )


def last_comma_part(address: str | Column) -> Column:
    parts = F.filter(F.transform(F.split(col(address), ","), lambda p: strip(p)), lambda p: p != "")
    return F.get(parts, F.size(parts) - 1)


def source_domain(value: str | Column) -> Column:
    """Last two labels of the host, or of the bare text when it is no URL."""
    text = F.lower(strip(col(value)))
    host = F.when(text.contains("://"), F.regexp_extract(text, r"://([^/?#]*)", 1)).otherwise(text)
    host = F.regexp_replace(F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r":.*$", ""), r"^www\.", "")
    labels = F.filter(F.split(host, r"\."), lambda p: p != "")
    short = F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), F.lit(2)), ".")
    return F.coalesce(F.when(F.size(labels) >= 2, short).otherwise(host), F.lit(""))


def url_problem(value: str | Column) -> Column:
    """Reason why a URL must not be read, NULL when it is fine."""
    host = url_host(value)
    return (
        F.when(~F.coalesce(url_scheme(value).isin("http", "https"), F.lit(False)), "Only http/https URLs are allowed.")
        .when(host == "", "URL hostname is missing.")
        .when((host == "localhost") | host.endswith(".local"), "Local/private hosts are not allowed.")
        .when(host.rlike(PRIVATE_HOST), "Local/private IP addresses are not allowed.")
    )


def is_login_wall(value: str | Column) -> Column:
    return contains_any(F.lower(F.coalesce(col(value), F.lit(""))), LOGIN_MARKS)


def contains_any(text: Column, terms: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(t) for t in terms])


def matched_terms(text: Column, terms: list[str]) -> Column:
    """Terms that occur in the text, in dictionary order."""
    return F.filter(F.array(*[F.lit(t) for t in terms]), lambda t: F.contains(text, t))


def normalize_identifier(value: str | Column) -> Column:
    """Digits without leading zeros; text without digits in lower case."""
    text = strip(F.coalesce(col(value).cast("string"), F.lit("")))
    digits = F.regexp_replace(text, r"[^0-9]", "")
    short = F.coalesce(F.nullif(F.ltrim(digits, F.lit("0")), F.lit("")), F.lit("0"))
    return F.when(digits != "", short).otherwise(F.lower(text))


def point(value: str | Column, names: tuple[str, str], decimals: int) -> Column:
    """``POINT(x y)`` as a struct of two rounded numbers."""
    pattern = rx(r"POINT\(\s*(-?[0-9.]+)\s+(-?[0-9.]+)\s*\)")
    first = F.regexp_extract(col(value), pattern, 1).try_cast("double")
    second = F.regexp_extract(col(value), pattern, 2).try_cast("double")
    return F.when(
        first.isNotNull() & second.isNotNull(),
        F.struct(F.round(first, decimals).alias(names[0]), F.round(second, decimals).alias(names[1])),
    )


def is_missing_text(value: str | Column) -> Column:
    return F.coalesce(F.lower(squash(value)), F.lit("")).isin(MISSING_WORDS)


def is_generic_title(value: str | Column, source_name: str | Column) -> Column:
    title = F.coalesce(F.lower(squash(value)), F.lit(""))
    return (
        (title == "")
        | (title == F.lower(squash(source_name)))
        | title.isin(GENERIC_TITLES)
        | (title.endswith(" makelaars") & (F.size(F.split(title, " ")) <= 3))
    )


def prefer_text(existing: str | Column, extracted: str | Column, replace_existing: Column | None = None) -> Column:
    """Keep the existing text unless it is missing (or generic) and the new one is usable."""
    take_new = is_missing_text(existing)
    if replace_existing is not None:
        take_new = take_new | replace_existing
    return F.when(~is_missing_text(extracted) & take_new, col(extracted)).otherwise(col(existing))


def has_postcode(text: Column) -> Column:
    return text.rlike(rx(r"\b\d{4}\s?[A-Za-z]{2}\b"))


def address_quality(value: str | Column) -> Column:
    """Additive score of how much a text looks like a full address."""

    def rated(text: Column) -> Column:
        score = (
            F.when(has_postcode(text), 3).otherwise(0)
            + F.when(text.rlike(r"\b\d+[A-Za-z]?(?:-\d+[A-Za-z]?)?\b"), 2).otherwise(0)
            + F.when(text.contains(","), 1).otherwise(0)
            + F.when(F.size(F.split(text, " ")) >= 3, 1).otherwise(0)
        )
        return F.when(text == "", -1000).otherwise(score)

    return let(F.coalesce(squash(value), F.lit("")), rated)


def _text_bonus(text: Column) -> Column:
    return (
        F.when(contains_any(F.lower(text), TITLE_WORDS), 5).otherwise(0)
        + F.when(has_postcode(text), 2).otherwise(0)
        + F.when(text.rlike(r"\b\d+[A-Za-z]?\b"), 1).otherwise(0)
        + F.when(F.length(text) > 20, 1).otherwise(0)
    )


def title_quality(value: str | Column) -> Column:
    return let(
        F.coalesce(squash(value), F.lit("")),
        lambda text: F.when(text == "", -1000).otherwise(F.size(F.split(text, " ")) + _text_bonus(text)),
    )


def best_text(candidates: list[tuple[Column, int]]) -> Column:
    """Best-scoring candidate; the first one wins a tie."""
    weights = F.array(*[F.lit(weight) for _, weight in candidates])

    def scored(text: Column, i: Column) -> Column:
        score = F.get(weights, i) + _text_bonus(text)
        return F.when(F.coalesce(text, F.lit("")) != "", F.struct(score.alias("score"), (-i).alias("rank"), text.alias("text")))

    texts = F.array(*[squash(value) for value, _ in candidates])
    return F.array_max(F.array_compact(F.transform(texts, scored)))["text"]


def clean_title(value: str | Column) -> Column:
    """Drop a trailing postcode-and-city part."""
    text = squash(value)
    for pattern in (
        rx(r"\s*,\s*\d{4}\s?[A-Za-z]{2}\s+[A-Za-z][A-Za-z\-\s]{1,60}$"),
        rx(r"\s+\d{4}\s?[A-Za-z]{2}\s+[A-Za-z][A-Za-z\-\s]{1,60}$"),
        rx(r"[,\s\-]+$"),
    ):
        text = F.regexp_replace(text, pattern, "")
    return F.nullif(text, F.lit(""))


def clean_address(value: str | Column) -> Column:
    text = F.regexp_replace(squash(value), rx(r"\b(\d{4})\s?([A-Za-z]{2})\b"), "$1 $2")
    upper = F.when(
        has_postcode(text),
        F.regexp_replace(text, r"\b\d{4} [A-Za-z]{2}\b", F.coalesce(spaced_postcode(text), F.lit(""))),
    ).otherwise(text)
    return F.nullif(F.regexp_replace(upper, rx(r"[,\s\-]+$"), ""), F.lit(""))


def street_part(address: str | Column) -> Column:
    text = squash(address)
    before = F.regexp_extract(text, rx(r"^(.*?)\b\d{4}\s?[A-Za-z]{2}\b"), 1)
    return F.coalesce(F.nullif(F.regexp_replace(before, r"[, ]+$", ""), F.lit("")), F.nullif(text, F.lit("")))


def compose_address(street: Column, postal_code: Column, city: Column) -> Column:
    parts = F.concat_ws(
        ", ",
        F.nullif(squash(street), F.lit("")),
        spaced_postcode(postal_code),
        F.nullif(squash(city), F.lit("")),
    )
    return F.nullif(parts, F.lit(""))


def address_with_city(address: str | Column, city: str | Column) -> Column:
    """Address with the city added unless it is already in it; ``Onbekend`` when both are missing."""
    a, c = text_or_null(address), text_or_null(city)
    return F.coalesce(
        F.when(a.isNotNull() & c.isNotNull() & ~F.contains(F.lower(a), F.lower(c)), F.concat_ws(", ", a, c)),
        a,
        c,
        F.lit("Onbekend"),
    )


# Status words and what they mean.
UNDER_OFFER_WORDS = ["sold_subject_to_contract", "under contract", "under offer", "under_offer"]
SOLD_WORDS = ["sold", "auction"]
WITHDRAWN_WORDS = ["withdrawn", "revoked", "lapsed"]


def normalize_status(value: str | Column) -> Column:
    text = F.coalesce(F.lower(squash(value)), F.lit(""))
    return (
        F.when(text.isin(UNDER_OFFER_WORDS), "under_offer")
        .when(text.isin(SOLD_WORDS), "sold")
        .when(text.isin(WITHDRAWN_WORDS), "withdrawn")
        .when(text.isin("", "unknown", "active"), "active")
        .otherwise(text)
    )


def word_count(value: str | Column) -> Column:
    return F.size(F.filter(F.split(col(value), rx(r"\s+")), lambda w: w != ""))
