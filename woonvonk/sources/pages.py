"""Landed web pages to listing records.

Tags, attributes, structured data, detail lists and the elements that selectors choose are column expressions over the
page text, so a page is read where it lies: no shuffle, no Python. A step that is used more than once within one
expression is bound by ``let``, because Spark works an expression out again at every use.
"""

from __future__ import annotations

import json
import re
from html.entities import html5

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from woonvonk.functions import dates, finance, numbers, text
from woonvonk.functions.casts import col, first_digits, let, strip
from woonvonk.functions.text import squash
from woonvonk.operators.columns import any_of
from woonvonk.session import spread

# A character reference; names (some old ones need no semicolon) and the codes that old pages mean as windows-1252
# come from the standard tables.
REFERENCE = r"&(#[0-9]{1,7};?|#[xX][0-9a-fA-F]{1,6};?|[A-Za-z][A-Za-z0-9]*;?)"
OLD_CODES = {str(code): bytes([code]).decode("cp1252", "replace") for code in range(0x80, 0xA0)}
NOISE = r"(?is)<!--.*?-->|<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>|<noscript\b[^>]*>.*?</noscript\s*>"
TAG = r"(?s)<[^>]*>"
LD_JSON = r"""(?is)<script\b[^>]*type=["']application/ld\+json["'][^>]*>(.*?)</script\s*>"""


def unescape(text_: Column) -> Column:
    """Character references as characters, once each; unknown names stay as they are."""
    return let(text_, lambda value: F.when(value.contains("&"), _unescaped(value)).otherwise(value))


def _unescaped(value: Column) -> Column:
    named = F.from_json(F.lit(json.dumps(html5)), "map<string,string>")
    old = F.from_json(F.lit(json.dumps(OLD_CODES)), "map<string,string>")

    def sign(name: Column) -> Column:
        hexadecimal = name.rlike("^#[xX]")
        digits = F.regexp_extract(name, "^#[xX]?([0-9a-fA-F]+)", 1)
        code = F.when(hexadecimal, F.conv(digits, 16, 10)).when(name.startswith("#"), F.conv(digits, 10, 10))
        number = code.cast("int")
        whole = (number > 0) & (number <= 0x10FFFF) & ~number.between(0xD800, 0xDFFF)
        numeric = F.coalesce(old[code], F.when(whole, F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")), F.lit("\ufffd"))
        return F.when(code.isNotNull(), numeric).otherwise(F.coalesce(named[name], F.concat(F.lit("&"), name)))

    between = F.split(value, REFERENCE, -1)
    signs = F.transform(F.regexp_extract_all(value, F.lit(REFERENCE), F.lit(1)), sign)
    decoded = F.array_join(F.zip_with(between, signs, lambda x, y: F.concat(x, F.coalesce(y, F.lit("")))), "")
    return F.when(value.rlike(REFERENCE), decoded).otherwise(value)


def inner_text(fragment: Column) -> Column:
    """Text of a fragment of HTML, single-spaced."""
    return squash(unescape(F.regexp_replace(fragment, TAG, " ")))


def visible_text(html: str | Column) -> Column:
    """Text of a page without scripts, styles and comments."""
    return F.nullif(_spaced_text(html), F.lit(""))


def _spaced_text(html: str | Column) -> Column:
    return inner_text(F.regexp_replace(col(html), NOISE, " "))


def text_lines(html: str | Column) -> Column:
    """The pieces of text between tags, in order."""
    pieces = F.split(F.regexp_replace(col(html), NOISE, "<x>"), TAG)
    return F.filter(F.transform(pieces, lambda p: squash(unescape(p))), lambda p: p != "")


def element_text(html: str | Column, tag: str) -> Column:
    """Text of the first element with that name (for elements that do not nest)."""
    inner = F.regexp_extract(F.regexp_replace(col(html), NOISE, ""), rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}\s*>", 1)
    return F.nullif(inner_text(inner), F.lit(""))


def attribute(tag_text: Column, name: str) -> Column:
    value = F.regexp_extract(tag_text, rf'(?is)\b{name}\s*=\s*"([^"]*)"', 1)
    other = F.regexp_extract(tag_text, rf"(?is)\b{name}\s*=\s*'([^']*)'", 1)
    return F.nullif(squash(unescape(F.coalesce(F.nullif(value, F.lit("")), other))), F.lit(""))


META = r"(?is)<meta\b[^>]*>"


def meta_content(html: str | Column, key: str) -> Column:
    """Content of a meta tag, by property first, then by name."""
    return let(F.regexp_extract_all(col(html), F.lit(META), F.lit(0)), lambda tags: tag_content(tags, key))


def tag_content(tags: str | Column, key: str) -> Column:
    """The same out of a page's meta tags, which are far shorter to look through than the page."""

    def of(kind: str) -> Column:
        return F.get(F.filter(col(tags), lambda t: t.rlike(rf"""(?is)\b{kind}=["']{key}["']""")), F.lit(0))

    # the second tag in line counts where the first one has no content
    found = F.filter(F.transform(F.array(of("property"), of("name")), lambda t: attribute(t, "content")), lambda v: v.isNotNull())
    return F.get(found, F.lit(0))


def meta_tags(html: str | Column) -> Column:
    """All meta tags of a page with their property, name and content, to be kept in a column and asked by ``meta_value``."""
    tags = F.regexp_extract_all(col(html), F.lit(META), F.lit(0))
    key = lambda tag, name: F.regexp_extract(tag, rf"""(?is)\b{name}=["']([^"']*)["']""", 1)
    return F.transform(
        tags, lambda t: F.struct(key(t, "property").alias("property"), key(t, "name").alias("name"), attribute(t, "content").alias("content"))
    )


def meta_value(tags: str | Column, key: str) -> Column:
    """Content of the first meta tag with that property, else of the first with that name."""

    def by(kind: str) -> Column:
        return F.get(F.filter(col(tags), lambda t: F.lower(t[kind]) == key), F.lit(0))["content"]

    return F.coalesce(by("property"), by("name"))


def link_href(html: str | Column, rel: str) -> Column:
    return attribute(F.regexp_extract(col(html), rf"""(?is)<link\b[^>]*\brel=["']{rel}["'][^>]*>""", 0), "href")


# --- structured data ---------------------------------------------------------------------------


def ld_blocks(html: str | Column) -> Column:
    """Raw structured-data blocks of a page."""
    return F.filter(F.transform(F.regexp_extract_all(col(html), F.lit(LD_JSON), F.lit(1)), lambda b: strip(b)), lambda b: b != "")


def ld_warnings(blocks: Column) -> Column:
    broken = F.filter(blocks, lambda b: F.try_parse_json(b).isNull())
    return F.transform(broken, lambda b: F.lit("Malformed JSON-LD block ignored."))


def ld_nodes(blocks: Column) -> Column:
    """Objects of the blocks as JSON texts: list items and each object followed by its graph."""

    none = F.array().cast("array<string>")

    def with_graph(node: Column) -> Column:
        graph = F.from_json(F.get_json_object(node, "$['@graph']"), "array<string>")
        return F.concat(F.array(node), F.coalesce(graph, none))

    def items(block: Column) -> Column:
        listed = F.coalesce(F.from_json(block, "array<string>"), none)
        objects = F.when(F.startswith(block, F.lit("[")), listed).otherwise(F.array(block))
        return F.flatten(F.transform(objects, with_graph))

    sound = F.filter(blocks, lambda b: F.try_parse_json(b).isNotNull())
    return F.filter(F.flatten(F.transform(sound, items)), lambda n: F.startswith(n, F.lit("{")))


def node_value(node: Column, *paths: str) -> Column:
    return F.coalesce(*[let(F.get_json_object(node, p), lambda v: F.nullif(v, F.lit(""))) for p in paths])


# Members of structured data that records are made of.
MEMBERS = [
    "@type", "name", "headline", "description", "address", "offers", "price", "image", "floorSize", "livingArea", "lotSize", "plotArea",
    "propertyType", "additionalType", "numberOfBedrooms", "numberOfRooms", "energyLabel", "yearBuilt", "constructionYear",
    "datePosted", "datePublished", "dateCreated",
]


def parsed_nodes(nodes: Column) -> Column:
    """Nodes with their MEMBERS as texts: each is read once, whatever many fields are taken from it."""
    return F.transform(nodes, lambda n: F.from_json(n, ", ".join(f"`{m}` string" for m in MEMBERS)))


def _member(node: Column, path: str) -> Column:
    """The value at a path of a parsed node; what lies deeper is read from the member's own short text."""
    head, rest = re.match(r"\$(?:\.|\[')([\w@]+)(?:'\])?(.*)$", path).groups()
    value = node[head]
    return F.nullif(F.get_json_object(value, "$" + rest) if rest else value, F.lit(""))


def first_value(nodes: Column, *paths: str) -> Column:
    """First non-empty value over ``parsed_nodes``; per node the paths in order."""
    values = F.transform(nodes, lambda n: F.coalesce(*[_member(n, p) for p in paths]))
    return F.get(F.filter(values, lambda v: v.isNotNull()), F.lit(0))


def node_fields(node: Column) -> Column:
    """Listing fields of one node; each path is read once."""
    paths = {
        "title": ["$.name", "$.headline"], "street": ["$.address.streetAddress"], "postal_code": ["$.address.postalCode"],
        "city": ["$.address.addressLocality"], "price": ["$.offers.price", "$.offers[0].price"], "area": ["$.floorSize.value", "$.floorSize"],
        "kind": ["$['@type']"], "description": ["$.description"],
    }

    def fields(raw: Column) -> Column:
        image = raw["image"]
        images = F.when(F.startswith(image, F.lit("[")), F.from_json(image, "array<string>")).when(image.isNotNull(), F.array(image))
        return F.struct(
            raw["title"].alias("title"),
            text.compose_address(raw["street"], raw["postal_code"], raw["city"]).alias("address"),
            raw["postal_code"].alias("postal_code"),
            raw["city"].alias("city"),
            numbers.parse_number_eu(raw["price"]).alias("asking_price"),
            numbers.parse_number_eu(raw["area"]).alias("surface_m2"),
            raw["kind"].alias("property_type"),
            raw["description"].alias("description"),
            F.coalesce(images, F.array().cast("array<string>")).alias("images"),
        )

    return let(F.struct(*[node_value(node, *p).alias(n) for n, p in paths.items()], F.get_json_object(node, "$.image").alias("image")), fields)


CORE_FIELDS = ["title", "address", "city", "asking_price", "surface_m2", "description"]


def best_node(nodes: Column) -> Column:
    """Fields of the node that fills most core fields; the first one wins a tie."""

    def scored(node: Column, i: Column) -> Column:
        def rated(fields: Column) -> Column:
            score = sum((F.when(fields[f].isNotNull(), 1).otherwise(0) for f in CORE_FIELDS), F.lit(0))
            return F.struct(score.alias("score"), (-i).alias("place"), fields.alias("fields"))

        return let(node_fields(node), rated)

    return let(F.array_max(F.transform(nodes, scored)), lambda best: F.when(best["score"] > 0, best["fields"]))


def extract_jsonld(pages: DataFrame) -> DataFrame:
    """Add ``ld`` (fields of the best node) and ``ld_warnings``."""
    return (
        pages.withColumn("_blocks", ld_blocks("html"))
        .withColumns({"ld": best_node(ld_nodes(F.col("_blocks"))), "ld_warnings": ld_warnings(F.col("_blocks"))})
        .drop("_blocks")
    )


def extract_open_graph(pages: DataFrame) -> DataFrame:
    """Add ``og_title``, ``og_description``, ``og_images`` and ``canonical_url``.

    Plain columns rather than a struct: Spark would work a struct's fields out again at every use.
    """
    return (
        pages.withColumn("_tags", F.regexp_extract_all("html", F.lit(META), F.lit(0)))
        .withColumns(
            {
                "og_title": tag_content("_tags", "og:title"),
                "og_description": tag_content("_tags", "og:description"),
                "og_images": F.array_compact(F.array(tag_content("_tags", "og:image"))),
                "canonical_url": F.coalesce(link_href("html", "canonical"), F.col("url")),
            }
        )
        .drop("_tags")
    )


# --- elements by class or attribute --------------------------------------------------------------

# Where each field is looked for, in order.
SELECTORS = {
    "heading": ["h3.single__title", ".single__title", "h1", "h2", "h3"],
    "address": [
        "[itemprop='streetAddress']", "address", ".address", ".adres", ".street-address", "[class*='address']",
        "[class*='adres']", "[class*='street']", "[class*='location']",
    ],
    "city": ["[itemprop='addressLocality']", ".city", "[class*='plaats']", "[class*='city']"],
    "price": ["[itemprop='price']", ".price", "[class*='price']", "[class*='vraagprijs']", "[class*='asking']", "[class*='koopsom']"],
    "surface": [
        "[itemprop='floorSize']", ".surface", "[class*='oppervlakte']", "[class*='surface']", "[class*='m2']",
        "[class*='woonoppervlakte']", "[class*='gebruiksoppervlakte']",
    ],
    "description": ["[itemprop='description']", ".description", "[class*='omschrijving']", "article p", ".summary", "[class*='intro']"],
    "breadcrumb": ["nav.breadcrumb", ".breadcrumb", "[class*='breadcrumb']"],
}
SIMPLE = re.compile(r"^([a-z0-9]*)(?:\.([\w-]+))?(?:\[(\w+)(\*?)='([^']*)'\])?$")
VOID_TAGS = ["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"]
SILENT = r"(?is)<!--.*?-->|<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>"


def _from_hit(html: Column, selector: str) -> Column:
    """The page from the first start tag on that the selector chooses; '' when there is none."""
    tag, name, attribute_, part, value = SIMPLE.match(selector).groups()
    held = ""
    if name:
        held = rf"""(?=[^>]*\s(?i:class)\s*=\s*(?:"(?:[^"]*\s)?{name}(?:\s[^"]*)?"|'(?:[^']*\s)?{name}(?:\s[^']*)?'|{name}[\s>]))"""
    elif attribute_:
        some, other, bare = ('[^"]*', "[^']*", rf"[^\s>\"']*{value}") if part else ("", "", rf"{value}[\s>]")
        held = rf"""(?=[^>]*\s(?i:{attribute_})\s*=\s*(?:"{some}{value}{some}"|'{other}{value}{other}'|{bare}))"""
    start = rf"(?s)(<(?i:{tag})(?=[/>\s]){held}.*)" if tag else rf"(?s)(<[a-zA-Z]{held}.*)"
    found = F.regexp_extract(html, start, 1)
    # most words don't occur at all, which costs less to see than a pattern to try
    return F.when(html.contains(value or name), found).otherwise("") if value or name else found


def _until_closed(rest: Column) -> Column:
    """What an element without end tag of its own holds: up to an end tag of something that was open around it."""
    pieces = F.split(rest, r"(?=<[a-zA-Z/])")
    empty = F.struct(F.array().cast("array<string>").alias("open"), F.lit(0).alias("n"), F.lit(False).alias("over"))

    def step(seen: Column, piece: Column) -> Column:
        def one(tag: Column) -> Column:
            # how many elements an end tag leaves open; none of its name open inside means that it is from outside
            place = F.size(seen["open"]) - F.array_position(F.reverse(seen["open"]), F.lower(F.substr(tag, F.lit(2))))
            ends, inside = tag.startswith("/"), F.array_contains(seen["open"], F.lower(F.substr(tag, F.lit(2))))
            left = (
                F.when((seen["n"] == 0) | (tag == "") | F.lower(tag).isin(VOID_TAGS), seen["open"])
                .when(ends & inside, F.slice(seen["open"], F.lit(1), place.cast("int")))
                .when(ends, seen["open"])
                .otherwise(F.array_append(seen["open"], F.lower(tag)))
            )
            over = ends & ~inside & (seen["n"] > 0)
            return F.struct(left.alias("open"), (seen["n"] + F.when(over, 0).otherwise(1)).alias("n"), over.alias("over"))

        return F.when(seen["over"], seen).otherwise(let(F.regexp_extract(piece, "^<(/?[a-zA-Z][a-zA-Z0-9-]*)", 1), one))

    return let(pieces, lambda x: F.array_join(F.slice(x, F.lit(1), F.aggregate(x, empty, step)["n"]), ""))


def _inside(rest: Column) -> Column:
    """What the element that ``rest`` starts with holds; elements of its own name inside it open and close in between."""

    def cut(tag: Column) -> Column:
        pattern = F.concat(F.lit("(?i)(?=</?"), tag, F.lit(r"[\s/>])"))
        none = F.struct(F.lit(0).alias("open"), F.lit(0).alias("n"))

        def step(seen: Column, piece: Column) -> Column:
            on = F.struct((seen["open"] + F.when(piece.startswith("</"), -1).otherwise(1)).alias("open"), (seen["n"] + 1).alias("n"))
            return F.when((seen["n"] > 0) & (seen["open"] == 0), seen).otherwise(on)

        def nested(parts: Column) -> Column:
            held = lambda x: F.when(x["open"] == 0, F.array_join(F.slice(parts, F.lit(1), x["n"] - 1), "")).otherwise(_until_closed(rest))
            return let(F.aggregate(parts, none, step), held)

        def inner(two: Column) -> Column:
            # the common case: the next tag of this name is the one that closes it, and the rest need not be looked through
            return F.when(F.get(two, F.lit(1)).startswith("</"), F.get(two, F.lit(0))).otherwise(let(F.split(rest, pattern), nested))

        return F.when(tag.isin(VOID_TAGS), "").otherwise(let(F.split(rest, pattern, 2), inner))

    return let(F.lower(F.regexp_extract(rest, "^<([a-zA-Z][a-zA-Z0-9-]*)", 1)), cut)


def with_picked(pages: DataFrame) -> DataFrame:
    """Add ``picked_<field>``: the text of the first selector whose element has any, NULL when there is none.

    A selector is a tag, a class or an attribute, or "a b" for the first b inside the first a. All hits of a page are one
    array (of an array per field), so that the plan holds the steps from hit to text once and not per selector.
    """
    every = list(dict.fromkeys(s for options in SELECTORS.values() for s in options))
    outer = list(dict.fromkeys(s.split()[0] for s in every if " " in s))
    held = lambda rest: F.when(rest != "", F.regexp_replace(_inside(rest), "^<[^>]*>", "")).otherwise("")
    bare = pages.withColumn("_bare", F.regexp_replace("html", SILENT, " "))
    bare = bare.withColumn("_outer", F.transform(F.array(*[_from_hit(F.col("_bare"), s) for s in outer]), held))

    def hit(selector: str) -> Column:
        *around, last = selector.split()
        return _from_hit(F.get("_outer", F.lit(outer.index(around[0]))) if around else F.col("_bare"), last)

    text_of = lambda rest: F.when(rest != "", let(inner_text(_inside(rest)), lambda t: F.when(t != "", t)))
    # the text of a hit is made only where those before it gave none
    first = lambda hits: F.aggregate(hits, F.lit(None).cast("string"), lambda seen, rest: F.coalesce(seen, text_of(rest)))
    found = bare.withColumn("_hits", F.array(*[F.array(*[hit(s) for s in options]) for options in SELECTORS.values()]))
    found = found.withColumn("_hits", F.transform("_hits", first))
    picked = {f"picked_{f}": F.get("_hits", F.lit(i)) for i, f in enumerate(SELECTORS)}
    return found.withColumns(picked).drop("_bare", "_outer", "_hits")


def looks_like_address(line: Column) -> Column:
    short = F.size(F.split(line, " ")) <= 12
    numbered = line.rlike(r"\b\d+[A-Za-z]?(?:-\d+[A-Za-z]?)?\b") & line.rlike(r"\b[A-Z][a-z]+\b")
    return short & (text.has_postcode(line) | numbered)


# Words that mark the living area.
AREA_WORDS = ["woonoppervlakte", "gebruiksoppervlakte wonen", "gebruiksoppervlakte", "m² wonen", "m2 wonen", "oppervlakte"]


def best_line(lines: Column, score) -> Column:
    """Line with the highest score (NULL scores are out); the first one wins a tie."""
    rated = F.transform(
        lines, lambda x, i: let(score(x), lambda s: F.when(s.isNotNull(), F.struct(s.alias("score"), (-i).alias("place"), x.alias("line"))))
    )
    return F.array_max(F.array_compact(rated))["line"]


def area_score(line: Column) -> Column:
    lowered = F.lower(line)
    named = text.contains_any(lowered, AREA_WORDS)
    usable = line.rlike(r"\d") & (F.size(F.split(line, " ")) <= 12) & named
    unit = lowered.rlike(r"\b\d+(?:[.,]\d+)?\s?(?:m2|m²|sqm)")
    return F.when(usable, F.lit(5) + F.when(unit, 3).otherwise(0))


def labelled_lines(lines: Column) -> Column:
    """A label of the area together with the line after it, where the label's own line has no digit."""
    after = F.slice(lines, 2, F.greatest(F.size(lines), F.lit(1)))
    label = lambda x: text.contains_any(F.lower(x), AREA_WORDS) & ~x.rlike("[0-9]")
    return F.array_compact(F.zip_with(lines, after, lambda x, y: F.when(label(x) & y.rlike("[0-9]"), F.concat_ws(" ", x, y))))


def extract_html_fallback(pages: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Add ``page_<field>``: title, heading, address, price, area and description by rules of thumb.

    ``keep`` names ``picked_<field>`` columns that stay, so that nobody has to pick them a second time.
    """
    picked = with_picked(pages).withColumns(
        {
            "_all_lines": text_lines("html"),
            "_slug": text.slug_title("url"),
            "_doc_title": element_text("html", "title"),
        }
    )
    picked = picked.withColumns(
        {
            "_lines": F.filter("_all_lines", lambda x: x.rlike("[0-9]")),
            "_area_lines": F.concat(labelled_lines(F.col("_all_lines")), F.filter("_all_lines", lambda x: x.rlike("[0-9]"))),
        }
    ).drop("_all_lines")
    heading = F.col("picked_heading")
    # Addresses and areas have a digit, which leaves few lines to look at.
    address_line = best_line(F.col("_lines"), lambda x: F.when(looks_like_address(x), text.address_quality(x)))
    address = F.coalesce("picked_address", F.when(looks_like_address(heading), heading), address_line, F.col("_slug.address"))
    based = picked.withColumn("_address", address).withColumn(
        "_postal_code", F.coalesce(text.spaced_postcode(F.coalesce("_address", heading)), let(_spaced_text("html"), text.spaced_postcode))
    )
    city = F.coalesce("picked_city", text.city_after_postcode(F.coalesce(heading, "_address", "picked_breadcrumb")), text.city_after_postcode("_address"))
    placed = based.withColumn("_city", city)
    full = F.when(
        F.col("_address").isNotNull() & F.col("_postal_code").isNotNull() & F.col("_city").isNotNull(),
        text.compose_address(text.street_part("_address"), F.col("_postal_code"), F.col("_city")),
    )
    surface = F.coalesce(best_line(F.col("_area_lines"), area_score), F.when(F.col("picked_surface").rlike(r"\d"), F.col("picked_surface")))
    title = F.coalesce("_doc_title", heading, F.col("_slug.title"))
    return placed.withColumns(
        {
            "page_title": F.coalesce(text.clean_title(title), title),
            "page_heading": heading,
            "page_address": F.coalesce(full, "_address"),
            "page_postal_code": F.col("_postal_code"),
            "page_city": F.col("_city"),
            "page_asking_price": numbers.parse_number_eu("picked_price"),
            "page_surface_m2": numbers.parse_number_eu(surface),
            "page_description": F.col("picked_description"),
        }
    ).drop("_lines", "_area_lines", "_slug", "_doc_title", "_address", "_postal_code", "_city", *[c for c in map("picked_{}".format, SELECTORS) if c not in keep])


# Methods with their confidence, best first.
METHODS = [("ld.", "json_ld", 0.9), ("og_", "open_graph", 0.7), ("page_", "html_fallback", 0.5)]
MERGED = {
    "title": ["ld.", "og_", "page_"], "address": ["ld.", "page_"], "postal_code": ["ld.", "page_"], "city": ["ld.", "page_"],
    "asking_price": ["ld.", "page_"], "surface_m2": ["ld.", "page_"], "property_type": ["ld."], "description": ["ld.", "og_", "page_"],
}


def merge_extractions(pages: DataFrame) -> DataFrame:
    """One record per page out of structured data, share tags and the page itself, in that order.

    The first of the three that gives anything names the method and the confidence.
    """
    full = extract_html_fallback(extract_open_graph(extract_jsonld(spread(pages))))
    values = {f: F.coalesce(*[F.col(f"{s}{f}") for s in sources]) for f, sources in MERGED.items()}
    listed = F.coalesce("ld.images", F.array().cast("array<string>"))
    gave = {s: any_of([F.col(f"{s}{f}").isNotNull() for f, sources in MERGED.items() if s in sources]) for s, _, _ in METHODS}
    gave["ld."] = gave["ld."] | (F.size(listed) > 0)
    gave["og_"] = gave["og_"] | (F.size("og_images") > 0)
    method, trust = F.lit("none"), F.lit(0.0)
    for s, name, confidence in reversed(METHODS):
        method = F.when(gave[s], name).otherwise(method)
        trust = F.when(gave[s], confidence).otherwise(trust)
    merged = full.withColumns(
        {
            **values,
            "images": F.array_distinct(F.concat(listed, "og_images")),
            "extraction_method": method,
            "confidence": trust,
            "_best_title": text.best_text(
                [(values["title"], 90), (F.col("ld.title"), 85), (F.col("og_title"), 80), (F.col("page_heading"), 88), (F.col("page_title"), 76)]
            ),
        }
    ).withColumn("_clean_title", text.clean_title("_best_title"))
    better = text.title_quality("_clean_title") > text.title_quality("title")
    titled = merged.withColumn("title", F.when(better, F.col("_clean_title")).otherwise(F.col("title")))
    filled = [F.col(c).isNotNull() for c in ("title", "address", "city", "asking_price", "surface_m2", "description")]
    none = F.array(F.lit("No useful metadata could be extracted."))
    judged = titled.withColumn("success", any_of([*filled, F.size("images") > 0]))
    return judged.withColumn(
        "warnings", F.when(F.col("success"), F.col("ld_warnings")).otherwise(F.concat("ld_warnings", none))
    ).drop("_best_title", "_clean_title")


# --- detail lists, links, images -----------------------------------------------------------------

DETAIL_PAIR = r"(?is)<dt\b[^>]*>(.*?)</dt\s*>\s*<dd\b[^>]*>(.*?)</dd\s*>"


def details(html: str | Column) -> Column:
    """Label-value pairs of definition lists, in order."""
    labels = F.regexp_extract_all(col(html), F.lit(DETAIL_PAIR), F.lit(1))
    values = F.regexp_extract_all(col(html), F.lit(DETAIL_PAIR), F.lit(2))
    pairs = F.zip_with(labels, values, lambda k, v: F.struct(text.label_key(inner_text(k)).alias("label"), inner_text(v).alias("value")))
    return F.filter(pairs, lambda p: (p["label"] != "") & (p["value"] != ""))


def detail(pairs: Column, labels: list[str]) -> Column:
    """Value under the first exact label, else under the first label that contains one of them."""

    def exact(label: str) -> Column:
        hits = F.filter(pairs, lambda p: p["label"] == label)
        return F.when(F.size(hits) > 0, F.get(hits, F.size(hits) - 1)["value"])

    part = F.get(F.filter(pairs, lambda p: text.contains_any(p["label"], labels)), F.lit(0))["value"]
    return F.coalesce(*[exact(label) for label in labels], part)


def resolve(base: str | Column, href: Column) -> Column:
    """Absolute address of a link without its fragment; NULL for links that are not pages."""
    link = strip(href)
    root = F.regexp_extract(col(base), r"^\s*([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]+)", 1)
    folder = F.regexp_extract(col(base), r"^\s*([A-Za-z][A-Za-z0-9+.\-]*://[^?#]*/)[^/?#]*", 1)
    whole = (
        F.when(link.rlike(r"(?i)^(#|$|mailto:|javascript:|tel:|data:)"), F.lit(None))
        .when(link.rlike(r"(?i)^https?://"), link)
        .when(link.startswith("//"), F.concat(F.regexp_extract(root, r"^[^:]+:", 0), link))
        .when(link.startswith("/"), F.concat(F.lower(root), link))
        .when(link.startswith("?"), F.concat(F.lower(root), text.url_path(base), link))
        .when(F.length(folder) > F.length(root) + 1, F.concat(folder, link))
        .otherwise(F.concat(F.lower(root), F.lit("/"), link))
    )
    return F.regexp_replace(whole, r"#.*$", "")


HREF = r"""(?is)<a\b[^>]*\bhref\s*=\s*["']([^"']*)["']"""


def extract_links(pages: DataFrame, path_pattern: str | None = None, host_pattern: str | None = None) -> DataFrame:
    """Distinct links per page, resolved; optionally only listing addresses."""
    hrefs = pages.select("page_id", "url", F.explode(F.regexp_extract_all("html", F.lit(HREF), F.lit(1))).alias("href"))
    links = hrefs.select("page_id", resolve("url", unescape(F.col("href"))).alias("link")).where(F.col("link").isNotNull())
    if path_pattern:
        links = links.where(F.lower(text.url_path("link")).rlike(path_pattern))
    if host_pattern:
        links = links.where(text.url_host("link").rlike(host_pattern))
    return links.distinct()


def next_page(html: str | Column, base: str | Column) -> Column:
    """Link to the following page."""
    rel = attribute(F.regexp_extract(col(html), r"""(?is)<a\b[^>]*\brel=["']next["'][^>]*>""", 0), "href")
    label = attribute(F.regexp_extract(col(html), r"""(?is)<a\b[^>]*\baria-label=["'][^"']*(?:volgende|next)[^"']*["'][^>]*>""", 0), "href")
    return resolve(base, F.coalesce(rel, label))


def images(pages: DataFrame, nodes: str | None = None, meta: str | None = None) -> DataFrame:
    """Add ``photos``: share image, page images and structured-data images, resolved, each once.

    ``nodes`` and ``meta`` name columns of the page's nodes and meta tags where they are there already.
    """
    tags = F.regexp_extract_all("html", F.lit(r"(?is)(<img\b[^>]*>)"), F.lit(1))
    sources = F.transform(tags, lambda t: F.coalesce(attribute(t, "src"), attribute(t, "data-src")))
    own = F.col(nodes) if nodes else ld_nodes(ld_blocks("html"))
    listed = F.flatten(F.transform(own, lambda n: node_fields(n)["images"]))
    shared = meta_value(meta, "og:image") if meta else meta_content("html", "og:image")
    every = F.concat(F.array(shared), sources, listed)
    kept = F.filter(every, lambda u: u.isNotNull() & ~F.startswith(u, F.lit("data:")))
    return pages.withColumn("photos", F.array_distinct(F.transform(kept, lambda u: resolve("url", u))))


# --- portal records -----------------------------------------------------------------------------

# Labels under which a portal lists each field.
LABELS = {
    "price": ["vraagprijs", "asking price", "koopprijs"],
    "address": ["adres", "address"],
    "city": ["plaats", "city"],
    "area": ["woonoppervlakte", "living area", "gebruiksoppervlakte wonen", "oppervlakte"],
    "plot": ["perceeloppervlakte", "plot size", "perceel", "grondoppervlakte"],
    "type": ["soort woonhuis", "soort woning", "woningtype", "property type"],
    "bedrooms": ["slaapkamers", "aantal slaapkamers", "bedrooms", "aantal kamers"],
    "label": ["energielabel", "energie label", "energy label"],
    "year": ["bouwjaar", "construction year"],
    "broker": ["makelaar", "aanbieder", "broker"],
    "since": ["sinds", "aangeboden sinds", "te koop sinds", "listed since", "placed since", "publicatiedatum"],
    "changes": ["prijswijzigingen", "aantal prijswijzigingen", "prijsverlagingen", "price changes", "price reductions"],
    "original": ["oorspronkelijke vraagprijs", "originele vraagprijs", "original asking price", "eerste vraagprijs"],
    "description": ["omschrijving", "description"],
}
RECORD_FIELDS = [
    "title", "description", "address", "city", "asking_price", "living_area", "plot_size", "property_type", "bedrooms",
    "energy_label", "construction_year", "broker", "listed_since",
]


def history_confidence(listed_since, reductions, original) -> Column:
    """How well the price history of a page is known."""
    dated = col(listed_since).isNotNull()
    cut = F.coalesce(col(reductions) > 0, F.lit(False)) | col(original).isNotNull()
    return F.when(dated & cut, "high").when(dated | cut, "medium").otherwise("unknown")


def portal_record(pages: DataFrame) -> DataFrame:
    """Listing record of a portal page: share tags and headings, structured data, then the detail list."""
    read = spread(pages).withColumns({"_nodes": ld_nodes(ld_blocks("html")), "_meta": meta_tags("html")})
    read = images(read, "_nodes", "_meta").withColumns({"_n": parsed_nodes(F.col("_nodes")), "_d": details("html")}).drop("_nodes")
    n, d = F.col("_n"), F.col("_d")

    def listed(field: str) -> Column:
        return detail(d, LABELS[field])

    street = first_value(n, "$.address.streetAddress")
    whole = F.nullif(
        F.concat_ws(" ", street, first_value(n, "$.address.postalCode"), first_value(n, "$.address.addressLocality")), F.lit("")
    )
    price_text = F.coalesce(first_value(n, "$.price", "$.offers.price", "$.offers[0].price"), listed("price"), meta_value("_meta", "product:price:amount"))
    address = F.coalesce(whole, listed("address"))
    staged = read.withColumn("_price_text", price_text).withColumns(
        {
            "title": F.coalesce(meta_value("_meta", "og:title"), element_text("html", "h1"), first_value(n, "$.name", "$.headline")),
            "description": F.coalesce(meta_value("_meta", "og:description"), meta_value("_meta", "description"), listed("description"), first_value(n, "$.description")),
            "address": address,
            "city": F.coalesce(first_value(n, "$.address.addressLocality"), text.city_from_tail(address), listed("city")),
            "asking_price": numbers.parse_price("_price_text")["amount"],
            "asking_price_status": numbers.parse_price("_price_text")["status"],
            "living_area": numbers.parse_area(F.coalesce(first_value(n, "$.floorSize.value", "$.floorSize", "$.livingArea"), listed("area"))),
            "plot_size": numbers.parse_area(F.coalesce(first_value(n, "$.lotSize.value", "$.lotSize", "$.plotArea"), listed("plot"))),
            "property_type": F.coalesce(first_value(n, "$.propertyType", "$.additionalType", "$['@type']"), listed("type")),
            "bedrooms": first_digits(F.coalesce(listed("bedrooms"), first_value(n, "$.numberOfBedrooms", "$.numberOfRooms"))),
            "energy_label": text.energy_label(F.coalesce(listed("label"), first_value(n, "$.energyLabel"))),
            "construction_year": first_digits(F.coalesce(listed("year"), first_value(n, "$.yearBuilt", "$.constructionYear"))),
            "broker": F.coalesce(listed("broker"), meta_value("_meta", "author")),
            "listed_since": F.coalesce(dates.parse_date(listed("since")), dates.parse_date(first_value(n, "$.datePosted", "$.datePublished"))),
            "price_reduction_count": F.coalesce(first_digits(listed("changes")), F.lit(0)),
            "original_asking_price": numbers.parse_number_nl(listed("original")),
            "listing_id": text.digits_in_url("url"),
        }
    )
    drop = finance.price_reduction("original_asking_price", "asking_price")
    return staged.withColumns(
        {
            "total_price_reduction_amount": drop["amount"],
            "total_price_reduction_percentage": drop["percentage"],
            "listing_history_confidence": history_confidence("listed_since", "price_reduction_count", "original_asking_price"),
            "price_per_m2": finance.price_per_m2("asking_price", "living_area"),
            "missing_fields": F.array_compact(F.array(*[F.when(F.col(f).isNull(), F.lit(f)) for f in RECORD_FIELDS])),
        }
    ).drop("_n", "_d", "_meta", "_price_text")


# Success rule and confidences of the generic record, by kind of host.
MIN_WORDS = 35
CONFIDENCES = {"portal": (0.75, 0.35), "business": (0.72, 0.32), "other": (0.70, 0.25)}


def generic_record(pages: DataFrame, portal_hosts: list[str], business_hosts: list[str]) -> DataFrame:
    """Any public page: title, address, price, areas, features, images and whether it says enough.

    Hosts are told apart by suffix. ``raw_text`` is the whole visible text, and all list items of some length are features.
    """
    nodes = F.col("_nodes")
    items = F.transform(F.regexp_extract_all("html", F.lit(r"(?is)<li\b[^>]*>(.*?)</li\s*>"), F.lit(1)), inner_text)
    host = text.url_host("url")

    def suffix(hosts: list[str]) -> Column:
        out = F.lit(False)
        for h in hosts:
            out = out | host.endswith(h)
        return out

    kind = F.when(suffix(portal_hosts), "portal").when(suffix(business_hosts), "business").otherwise("other")
    address = F.nullif(
        F.concat_ws(
            " ",
            first_value(nodes, "$.address.streetAddress"), first_value(nodes, "$.address.postalCode"),
            first_value(nodes, "$.address.addressLocality"), first_value(nodes, "$.address.addressCountry"),
        ),
        F.lit(""),
    )
    description = F.coalesce(meta_value("_meta", "og:description"), meta_value("_meta", "description"))
    given = F.coalesce(first_value(nodes, "$.price", "$.offers.price", "$.offers[0].price"), meta_value("_meta", "product:price:amount"))
    kept = spread(pages).withColumns({"_nodes": parsed_nodes(ld_nodes(ld_blocks("html"))), "_meta": meta_tags("html")})
    read = kept.withColumns(
        {
            "host_kind": kind,
            "title": F.coalesce(meta_value("_meta", "og:title"), element_text("html", "title")),
            "address": address,
            "description": description,
            "_text": visible_text("html"),
            "_price_text": F.coalesce(given, description),
            "living_area": numbers.parse_area(first_value(nodes, "$.floorSize.value", "$.floorSize", "$.livingArea")),
            "features": F.filter(items, lambda x: F.length(x) >= 8),
        }
    ).withColumn("word_count", F.coalesce(text.word_count("_text"), F.lit(0)))
    success = (F.col("word_count") >= MIN_WORDS) & (F.col("title").isNotNull() | F.col("address").isNotNull())
    staged = read.withColumn("success", success)
    trust = F.lit(0.0)
    for name, (yes, no) in CONFIDENCES.items():
        trust = F.when(F.col("host_kind") == name, F.when(F.col("success"), yes).otherwise(no)).otherwise(trust)
    query = F.concat(F.coalesce(F.nullif(squash(F.coalesce("address", "title")), F.lit("")), F.lit("bedrijfspand te koop")), F.lit(" makelaar te koop"))
    return staged.withColumns(
        {
            "confidence": trust,
            "asking_price": numbers.parse_price("_price_text")["amount"],
            "price_status": F.coalesce(numbers.parse_price("_price_text")["status"], F.lit("unknown")),
            "raw_text": F.coalesce("_text", F.lit("")),
            "broker_search_query": F.when(~F.col("success") & (F.col("host_kind") != "other"), query),
        }
    ).drop("_text", "_price_text", "_nodes", "_meta")


# --- cards of a second portal ---------------------------------------------------------------------

CARD = r"""(?is)(<a\b[^>]*href=["'][^"']+["'][^>]*>\s*<div[^>]*class=["'][^"']*\blisting-card\b[^"']*["'].*?</a>)"""
# Provinces at the end of city labels.
PROVINCES = [
    "Drenthe", "Flevoland", "Friesland", "Gelderland", "Groningen", "Limburg", "Noord-Brabant", "Noord-Holland", "Overijssel",
    "Utrecht", "Zeeland", "Zuid-Holland",
]
CARD_PATHS = r"^(https?://[^/]+)?/(pand|koop)/"


def _by_class(fragment: Column, tag: str, name: str) -> Column:
    inner = F.regexp_extract(fragment, rf"""(?is)<{tag}\b[^>]*class=["'][^"']*{name}[^"']*["'][^>]*>(.*?)</{tag}\s*>""", 1)
    return F.nullif(inner_text(inner), F.lit(""))


def listing_cards(pages: DataFrame) -> DataFrame:
    """One row per card of an overview page that leads to a listing."""
    found = F.transform(
        F.regexp_extract_all("html", F.lit(CARD), F.lit(1)),
        lambda c: F.struct(F.regexp_extract(c, r"""(?is)^<a\b[^>]*href=["']([^"']*)["']""", 1).alias("href"), c.alias("card")),
    )
    # the outer form: otherwise Spark searches a page a second time to see whether it has any card
    cards = pages.select("page_id", "url", F.posexplode_outer(found).alias("card_no", "x")).where(F.col("x.href").rlike(CARD_PATHS))
    card = F.col("x.card")
    metrics = F.transform(F.regexp_extract_all(card, F.lit(r"""(?is)<span class=["']v["']>(.*?)</span>"""), F.lit(1)), inner_text)
    thumb = F.regexp_extract(card, r"""(?is)<img\b[^>]*class=["'][^"']*listing-thumb[^"']*["'][^>]*>""", 0)
    head = strip(F.regexp_replace(attribute(thumb, "alt"), r" in .*$", ""))
    kind = F.when(head.contains(","), strip(F.regexp_extract(head, r"^([^,]*),", 1))).when(
        F.lower(head).endswith(" kluswoning te koop"), "kluswoning"
    )
    city, address = _by_class(card, "strong", "mobile-title"), _by_class(card, "span", "min-h-40p")
    return cards.select(
        "page_id",
        "card_no",
        resolve("url", F.col("x.href")).alias("source_url"),
        F.nullif(F.concat_ws(" ", address, city), F.lit("")).alias("title"),
        address.alias("address"),
        city.alias("city"),
        numbers.parse_number_nl(_by_class(card, "span", "kvg-price-now")).alias("asking_price"),
        numbers.parse_number_nl(F.get(metrics, F.lit(1))).alias("living_area"),
        numbers.parse_number_nl(F.get(metrics, F.lit(2))).alias("plot_area"),
        resolve("url", attribute(thumb, "src")).alias("image_url"),
        kind.alias("property_type"),
    )


CITY_LINK = r"""(?is)<a\b[^>]*href=["']([^"']*/kluswoning-[^"']*)["'][^>]*>(.*?)</a>"""


def city_links(pages: DataFrame) -> DataFrame:
    """Links to city pages with municipality, province and number of listings out of their label."""
    hrefs = F.regexp_extract_all("html", F.lit(CITY_LINK), F.lit(1))
    labels = F.regexp_extract_all("html", F.lit(CITY_LINK), F.lit(2))
    rows = pages.select("page_id", F.explode(F.arrays_zip(hrefs.alias("href"), labels.alias("label"))).alias("x")).select(
        "page_id", F.col("x.href").alias("href"), inner_text(F.col("x.label")).alias("label")
    )
    ends = r" (" + "|".join(PROVINCES) + r")$"
    province = F.nullif(F.regexp_extract("label", ends, 1), F.lit(""))
    rest = strip(F.regexp_replace("label", ends, ""))
    counted = r"(?i)^(\d+)\s+kluswoning(?:en)?\s+(.*)$"
    tail = r"^(.*?)(?:\s+(\d+))?$"
    front = rest.rlike(counted)
    slug = strip(F.regexp_replace(F.translate(F.regexp_extract("href", r"([^/]*)$", 1), "-", " "), r"(?i)\bkluswoning\b", ""))
    words = F.array_join(F.transform(F.split(slug, r"\s+"), lambda w: F.when(w.isin("en", "van", "de", "den", "der", "het"), w).otherwise(F.initcap(w))), " ")
    name = F.when(front, F.regexp_extract(rest, counted, 2)).otherwise(
        strip(F.regexp_replace(F.regexp_extract(rest, tail, 1), r"kluswoning(en)?", ""))
    )
    count = F.when(front, F.regexp_extract(rest, counted, 1)).otherwise(F.regexp_extract(rest, tail, 2))
    return rows.select(
        "page_id",
        "href",
        F.coalesce(F.nullif(name, F.lit("")), words).alias("municipality"),
        province.alias("province"),
        count.try_cast("int").alias("listing_count"),
    )


def extraction_report(records: DataFrame, by: list[str]) -> DataFrame:
    """How complete the records of each group are."""
    short = F.size("missing_fields") > 0
    return records.groupBy(*by).agg(
        F.count_if(F.col("url").isNotNull()).alias("imported_listings"),
        F.count_if(short).alias("listings_with_missing_fields"),
        F.sum(F.size("missing_fields")).alias("missing_field_count"),
        F.count_if(F.col("asking_price").isNull()).alias("without_price"),
    )



# --- detail pages of the second portal -------------------------------------------------------------

# How this portal names a home and labels its measures.
TITLE_PARTS = r"^(.*?)\s+([A-Z][A-Za-zÀ-ÿ' -]+)\s+kluswoning te koop$"
INTRO_TYPE = r"(?i)^Deze\s+([a-zA-ZÀ-ÿ0-9\- ]+?)\s+in\s"
LEAF_DIV = r"(?is)<div\b[^>]*>([^<]*(?:<(?!/?div\b)[^>]*>[^<]*)*)</div>"
MEASURES = {"living_area": ["leefruimte", "woonoppervlakte"], "plot_size": ["perceel"], "bedrooms": ["slaapkamer"], "built": ["gebouwd in"]}
WORKS_FIELDS = ["title", "address", "city", "asking_price", "living_area", "plot_size", "property_type", "description"]


def works_record(pages: DataFrame) -> DataFrame:
    """Listing record of a detail page of the second portal: headings, measures in boxes, structured data."""
    nodes = ld_nodes(ld_blocks("html"))
    listing = F.filter(nodes, lambda n: F.lower(F.get_json_object(n, "$['@type']")) == "realestatelisting")
    boxes = F.transform(F.regexp_extract_all("html", F.lit(LEAF_DIV), F.lit(1)), inner_text)
    read = images(spread(pages)).withColumns({"_n": parsed_nodes(listing), "_all": parsed_nodes(nodes), "_boxes": boxes})

    def box(name: str) -> Column:
        return F.get(F.filter("_boxes", lambda b: text.contains_any(F.lower(b), MEASURES[name])), F.lit(0))

    n = F.col("_n")
    heading = F.coalesce(element_text("html", "h1"), meta_content("html", "og:title"), element_text("html", "title"))
    intro = F.nullif(inner_text(F.regexp_extract("html", r"""(?is)<p\b[^>]*class=["'][^"']*kz-intro[^"']*["'][^>]*>(.*?)</p>""", 1)), F.lit(""))
    whole = F.concat_ws(", ", first_value(n, "$.address.streetAddress"), first_value(n, "$.address.postalCode"), first_value(n, "$.address.addressLocality"))
    staged = read.withColumns({"title": heading, "_intro": intro})
    canonical = F.coalesce(meta_content("html", "og:url"), link_href("html", "canonical"), F.col("url"))
    filled = staged.withColumns(
        {
            "canonical_url": canonical,
            "address": F.coalesce(F.nullif(F.regexp_extract("title", TITLE_PARTS, 1), F.lit("")), F.nullif(whole, F.lit(""))),
            "city": F.coalesce(F.nullif(F.regexp_extract("title", TITLE_PARTS, 2), F.lit("")), first_value(n, "$.address.addressLocality")),
            "province": first_value(n, "$.address.addressRegion"),
            "postal_code": first_value(n, "$.address.postalCode"),
            "asking_price": F.coalesce(
                numbers.parse_price(_by_class(F.col("html"), "span", "kvg-price-now"))["amount"], first_value(n, "$.offers.price").try_cast("double")
            ),
            "living_area": numbers.parse_number_nl(box("living_area")),
            "plot_size": numbers.parse_number_nl(box("plot_size")),
            "bedrooms": numbers.parse_number_nl(box("bedrooms")).try_cast("int"),
            "construction_year": F.regexp_extract(box("built"), r"\b((?:19|20)\d{2})\b", 1).try_cast("int"),
            "listed_since": dates.zulu_date(F.coalesce(first_value(F.col("_all"), "$.datePublished", "$.dateCreated"), meta_content("html", "article:published_time"))),
            "property_type": F.coalesce(
                F.nullif(F.regexp_extract("_intro", INTRO_TYPE, 1), F.lit("")),
                F.when(F.lower("title").contains("kluswoning"), "kluswoning"),
                first_value(n, "$.additionalType", "$.propertyType", "$['@type']"),
                F.lit("kluswoning"),
            ),
            "description": F.coalesce("_intro", meta_content("html", "og:description"), meta_content("html", "description")),
        }
    )
    return filled.withColumns(
        {
            "external_listing_id": text.path_identifier("canonical_url"),
            "asking_price_status": F.when(F.col("asking_price").isNotNull(), "known").otherwise("unknown"),
            "listing_status": F.lit("active"),
            "missing_fields": F.array_compact(F.array(*[F.when(F.col(f).isNull(), F.lit(f)) for f in WORKS_FIELDS])),
        }
    ).drop("_n", "_all", "_boxes", "_intro")
