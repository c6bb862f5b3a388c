"""Page shapes that the made-up portal pages do not have, and white space as Python takes it."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from woonvonk.functions import casts, numbers, text
from woonvonk.operators import matching
from woonvonk.sources import pages

NBSP = chr(0xA0)


def one(spark, html, url="https://a.example/koop/x-1"):
    return pages.extract_html_fallback(spark.createDataFrame([(1, url, html)], "page_id int, url string, html string")).first()


@pytest.mark.parametrize(
    "html, area",
    [
        ("<div><span>Woonoppervlakte</span> <span>120 m²</span></div>", 120.0),
        ("<div class='table__row'><div>Gebruiksoppervlakte wonen</div><div>156 m²</div></div>", 156.0),
        ("<dl><dt>Oppervlakte</dt><dd>88,5&nbsp;m&sup2;</dd></dl>", 88.5),
        ("<p>Woonoppervlakte 97 m2</p>", 97.0),
        ("<p>Perceel 97 m2</p>", None),
    ],
)
def test_area_of_labelled_rows(spark, html, area):
    assert one(spark, html).page_surface_m2 == area


def test_description_inside_an_article(spark):
    assert one(spark, "<article><h1>Huis</h1><p>Ruim huis met tuin.</p></article>").page_description == "Ruim huis met tuin."


def test_character_references(spark):
    shown = "caf&eacute; &#8364; 250.000 &#x20ac;1 &ndash; &uuml; &#233;&#128; &amp;lt; &copy 2 &nosuch; &#0;"
    df = spark.createDataFrame([(shown,), ("plain & text",)], "html string")
    got = [r[0] for r in df.select(pages.visible_text("html")).collect()]
    assert got == ["café € 250.000 €1 – ü é€ &lt; © 2 &nosuch; �", "plain & text"]


def test_price_after_a_reference(spark):
    row = one(spark, "<div class='price'>&#8364;&nbsp;250.000 k.k.</div>")
    assert row.page_asking_price == 250000.0


def test_whole_text_and_all_features(spark):
    html = "<ul>" + "".join(f"<li>kenmerk nummer {i}</li>" for i in range(40)) + "</ul><p>" + "woord " * 9000 + "</p>"
    df = spark.createDataFrame([(1, "https://a.example/x", html)], "page_id int, url string, html string")
    row = pages.generic_record(df, [], []).first()
    assert len(row.features) == 40 and len(row.raw_text) > 50_000 and row.raw_text.endswith("woord")


def test_white_space_is_pythons(spark):
    every = "".join(map(chr, [*range(9, 14), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
    assert every.strip() == "" and set(casts.BLANKS) == set(every)
    df = spark.createDataFrame([(f"{every}a{every}b{every}",)], "v string")
    row = df.select(casts.strip("v").alias("s"), text.squash("v").alias("q")).first()
    assert row.s == f"a{every}b" and row.q == "a b"
    df = spark.createDataFrame([(f"€{NBSP}250.000", f"\thttps://A.example/x\n", f"Dorpsstraat{NBSP}12")], "p string, u string, a string")
    row = df.select(
        numbers.infer_price_status("p").alias("status"), numbers.euro_amount("p").alias("amount"),
        text.normalize_source_url("u").alias("url"), text.normalize_text("a").alias("address"),
    ).first()
    assert tuple(row) == ("known", 250000.0, "https://a.example/x", "dorpsstraat 12")


def test_upsert_keeps_stored_rows_without_key(spark):
    current = spark.createDataFrame([(1, None, "a"), (2, None, "b"), (3, "k", "c")], "id int, key string, v string")
    incoming = spark.createDataFrame([(4, None, "x"), (5, "k", "y"), (6, "n", "z")], "id int, key string, v string")
    got = matching.upsert(current, incoming, F.col("key"), ["id"], keep_first=["id"]).collect()
    assert sorted(map(tuple, got), key=repr) == sorted([(1, None, "a"), (2, None, "b"), (3, "k", "y"), (6, "n", "z")], key=repr)


@pytest.mark.parametrize(
    "html, field, shown",
    [
        ("<div class='price'>a<div>b</div>c</div>d", "price", "a b c"),
        ("<DIV CLASS='x price y'>1 <br> 2</DIV>", "price", "1 2"),
        ("<p class=intro>one<p>two</p>", "description", "one two"),  # never closed, so it goes on
        ("<div><section class='my-address'>s1 <p>s2</div> no", "address", "s1 s2"),  # closed by what is around it
        ("<section class='my-address'><section>s1</section> tail</section> no", "address", "s1 tail"),
        ("<h1></h1><h2>H2</h2>", "heading", "H2"),
        ("<h1>o</h1><h3 class='single__title'>T</h3>", "heading", "T"),
        ("<script><h1>no</h1></script><h1>caf&eacute;&nbsp;x</h1>", "heading", "café x"),
        ("<img class='price'><span class='asking-price'>5</span>", "price", "5"),
        ("<article><div><p>in</p></div></article><p>out</p>", "description", "in"),
        ("<p>out</p>", "description", None),
        ('<div itemprop="price" content="3">3 <b>k.k.</b></div>', "price", "3 k.k."),
        ("<nav class='breadcrumb'><a>x</a> &gt; <a>y</a></nav>", "breadcrumb", "x > y"),
        ("<div class='city'>unclosed <b>x", "city", "unclosed x"),
        ("<div class='pricey'>1</div>", "price", "1"),
        ("<div class='cityhall-x'><p class='city'>Zwolle</p></div>", "city", "Zwolle"),
        (None, "city", None),
    ],
)
def test_elements_that_selectors_choose(spark, html, field, shown):
    df = spark.createDataFrame([(1, html)], "page_id int, html string")
    assert pages.with_picked(df).first()[f"picked_{field}"] == shown


def test_structured_data_is_read_once_per_node(spark):
    """Members that are objects, lists or numbers are read as get_json_object reads them."""
    node = '{"@type": "House", "name": "N", "price": 250000.50, "offers": [{"price": 3.10}], "floorSize": {"value": "88,5 m2"}, "address": "plain"}'
    df = spark.createDataFrame([(node,), ("{}",), ('{"address": {"streetAddress": "S 1"}, "floorSize": 70}',)], "n string")
    nodes = pages.parsed_nodes(F.array("n"))
    for path in ("$['@type']", "$.name", "$.price", "$.offers.price", "$.offers[0].price", "$.floorSize.value", "$.floorSize", "$.address.streetAddress"):
        once = df.select(pages.first_value(nodes, path).alias("v"), pages.node_value(F.col("n"), path).alias("w")).collect()
        assert [r.v for r in once] == [r.w for r in once], path
