"""Scores to bands, and display texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from woonvonk.functions.casts import col, strip


def ladder(value: Column, steps: list[tuple[float, object]], otherwise, at_most: bool = False) -> Column:
    """First step whose bound the value reaches (``>=``, or ``<=`` with ``at_most``)."""
    out = None
    for bound, result in steps:
        hit = value <= bound if at_most else value >= bound
        out = F.when(hit, result) if out is None else out.when(hit, result)
    return out.otherwise(otherwise)


# Cut-offs of every band.
RANK_PRIORITY = [(85, "urgent"), (70, "high"), (45, "medium")]
PIPELINE_PRIORITY = [(90, "urgent"), (75, "high"), (55, "medium")]
BATCH_PRIORITY = [(80, "high"), (60, "medium")]
DEAL_RATING = [(85, "A+"), (70, "A"), (55, "B"), (40, "C")]
OVERALL_RATING = [(90, "A+"), (80, "A"), (70, "B"), (60, "C"), (50, "D")]
CATEGORY_RATING = [(85, "A+"), (75, "A"), (65, "B"), (50, "C")]
STARS = [(85, "★★★★★ Exceptional"), (70, "★★★★ Strong Buy"), (55, "★★★ Consider"), (40, "★★ Weak")]
RETURN_SCORE = [(10.0, 20), (8.0, 17), (6.0, 14), (4.5, 10)]
LABEL_SCORES = {
    "A++++": 100.0, "A+++": 98.0, "A++": 96.0, "A+": 94.0, "A": 92.0, "B": 82.0,
    "C": 70.0, "D": 55.0, "E": 40.0, "F": 25.0, "G": 10.0,
}


def priority(score, steps=RANK_PRIORITY) -> Column:
    return ladder(col(score), steps, "low")


def deal_rating(score) -> Column:
    return F.when(col(score).isNull(), "Onbekend").otherwise(ladder(col(score), DEAL_RATING, "D"))


def deal_summary(rating: Column) -> Column:
    return (
        F.when(rating.isin("A+", "A"), "Sterke deal").when(rating.isin("C", "D"), "Zwakke deal").otherwise("Nader onderzoeken")
    )


def overall_rating(score) -> Column:
    return ladder(col(score), OVERALL_RATING, "F")


def category_rating(score) -> Column:
    return ladder(col(score), CATEGORY_RATING, "D")


def stars(score) -> Column:
    return F.when(col(score).isNull(), "★ Avoid").otherwise(ladder(col(score), STARS, "★ Avoid"))


def return_score(gross_yield_pct) -> Column:
    value = col(gross_yield_pct)
    return F.when(value.isNull() | (value <= 0), 0).otherwise(ladder(value, RETURN_SCORE, 5))


def label_score(label) -> Column:
    """Energy label as 10..100; any other label that starts with A counts as A."""
    text = F.coalesce(F.upper(strip(col(label))), F.lit(""))
    out = F.when(F.lit(False), F.lit(0.0))
    for name, score in LABEL_SCORES.items():
        out = out.when(text == name, score)
    return out.when(text.startswith("A"), 92.0).otherwise(50.0)


def euro(value) -> Column:
    """``€ 1.234.567``."""
    whole = F.format_number(F.bround(col(value)).cast("bigint"), 0)
    return F.coalesce(F.concat(F.lit("€ "), F.translate(whole, ",", ".")), F.lit("Onbekend"))


def percentage(value, decimals: int = 1) -> Column:
    """``12,5%``."""
    text = F.format_string(f"%.{decimals}f", col(value))
    return F.when(col(value).isNull(), "Onbekend").otherwise(F.concat(F.translate(text, ".", ","), F.lit("%")))


def euro_per_m2(price, area) -> Column:
    usable = col(price).isNotNull() & (col(area) > 0)
    text = F.concat(euro(F.try_divide(col(price), col(area))), F.lit(" per m²"))
    return F.when(usable, text).otherwise("Onbekend")


def price_path(prices: Column) -> Column:
    """``€ 1 -> € 2``."""
    text = F.array_join(F.transform(prices, euro), " -> ")
    return F.when(F.size(prices) > 0, text).otherwise("Onbekend")


# Display names of permit states.
PERMIT_LABELS = {
    "pending": "LOPEND", "rejected": "GEWEIGERD", "withdrawn": "INGETROKKEN", "granted": "VERLEEND",
}


def permit_label(status) -> Column:
    """Dutch display name; other codes are shown in capitals."""
    names = F.create_map(*[F.lit(x) for pair in PERMIT_LABELS.items() for x in pair])
    code = F.coalesce(F.nullif(col(status), F.lit("")), F.lit("unknown"))
    return F.coalesce(F.try_element_at(names, code), F.upper(code))


def asking_price_text(status, price, text) -> Column:
    shown = F.nullif(col(text), F.lit(""))
    return (
        F.when(col(status) == "known", euro(price))
        .when(col(status) == "on_request", "Prijs op aanvraag")
        .when(col(status) == "from_price", F.when(col(price).isNull(), "Vanaf …").otherwise(F.concat(F.lit("Vanaf "), euro(price))))
        .when(col(status) == "range", F.coalesce(shown, F.lit("Prijsrange onbekend")))
        .when(col(status) == "auction", F.concat(F.lit("Veiling"), F.coalesce(F.concat(F.lit(": "), shown), F.lit(""))))
        .otherwise("Onbekend")
    )
