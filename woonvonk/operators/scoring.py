"""Rule scores of listings against their peers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from woonvonk.functions import bands, finance
from woonvonk.functions.casts import clamp_score, clamped, col, strip, to_int
from woonvonk.operators.benchmarks import city_benchmarks, city_key, with_city_measures, with_ppm2
from woonvonk.session import broadcast_if_small

# Label groups.
GOOD_LABELS = ["A", "A+", "A++", "A+++", "A++++", "B"]
FAIR_LABELS = [*GOOD_LABELS, "C"]
POOR_LABELS = ["D", "E", "F", "G"]


def points(condition: Column, amount: int) -> Column:
    """``amount`` when the condition holds; NULL counts as no."""
    return F.when(condition, amount).otherwise(0)


def step_points(value: Column, steps: list[tuple[float, int]]) -> Column:
    """Points of the first bound reached (``>=``)."""
    return bands.ladder(value, steps, 0)


def total(*parts: Column) -> Column:
    return reduce(lambda a, b: a + b, parts)


def upper_label(label: str) -> Column:
    return F.coalesce(F.upper(strip(label)), F.lit(""))


# --- ranking of one listing -------------------------------------------------------------------

# Bounds, points and reason codes of the ranking.
PRICE_STEPS = [(350000, 20, "lower_asking_price"), (600000, 12, "mid_asking_price")]
PPM2_STEPS = [(3500, 18, "competitive_price_per_m2"), (5000, 10, "reasonable_price_per_m2")]
YIELD_STEPS = [
    (10.0, 25, "yield_signal_strong"), (8.0, 21, "yield_signal_good"), (6.0, 16, "yield_signal_moderate"),
    (4.5, 10, "yield_signal_weak"),
]
TRACKED_FIELDS = ["title", "address", "city", "asking_price", "surface_m2", "property_type", "description"]


def _outcome(score, reason=None, missing=None) -> Column:
    return F.struct(
        F.lit(score).cast("int").alias("points") if not isinstance(score, Column) else score.cast("int").alias("points"),
        F.lit(reason).cast("string").alias("reason"),
        F.lit(missing).cast("string").alias("missing"),
    )


def _at_most(value: Column, steps, last, missing: str) -> Column:
    out = F.when(value.isNull(), _outcome(0, None, missing))
    for bound, amount, reason in steps:
        out = out.when(value <= bound, _outcome(amount, reason))
    return out.otherwise(_outcome(*last))


def rank_outcomes() -> list[Column]:
    """The ranking rules in order; each gives points, a reason code or a missing-data code."""
    days, cuts = F.col("days_on_market"), F.col("price_reduction_count")
    investment = clamped(F.col("investment_score").cast("double"), 0.0, 100.0)
    yields = F.col("yield_pct")
    kind = F.lower("property_type")
    by_yield = F.when(yields.isNull(), _outcome(0, None, "investment_score_missing"))
    for bound, amount, reason in YIELD_STEPS:
        by_yield = by_yield.when(yields >= bound, _outcome(amount, reason))
    by_yield = by_yield.when(yields > 0, _outcome(5, "yield_signal_low")).otherwise(_outcome(0, "yield_signal_none"))
    filled = total(*[points(F.col(f).isNotNull() & (F.col(f).cast("string") != ""), 1) for f in TRACKED_FIELDS])
    return [
        _at_most(F.col("asking_price"), PRICE_STEPS, (4, "higher_asking_price"), "asking_price_missing"),
        _at_most(F.col("price_per_m2"), PPM2_STEPS, (3, "high_price_per_m2"), "price_per_m2_missing"),
        F.when(days.isNull(), _outcome(0, None, "days_on_market_missing"))
        .when(days >= 120, _outcome(12, "long_time_on_market"))
        .when(days >= 45, _outcome(7, "moderate_time_on_market"))
        .otherwise(_outcome(0)),
        F.when(cuts > 0, _outcome(clamped(cuts.cast("int") * 4, 0, 12), "price_reduction_signal")).otherwise(
            _outcome(0, None, "price_reduction_data_missing")
        ),
        F.when(investment.isNotNull(), _outcome(F.bround(investment / 100.0 * 25.0), "investment_score_used")).otherwise(
            by_yield
        ),
        F.when(F.coalesce(kind, F.lit("")) == "", _outcome(0, None, "property_type_missing"))
        .when(kind.contains("appartement") | kind.contains("woning"), _outcome(6, "known_property_type"))
        .otherwise(_outcome(3, "other_property_type")),
        F.when(F.coalesce(F.col("city"), F.lit("")) != "", _outcome(5, "city_present")).otherwise(
            _outcome(0, None, "city_missing")
        ),
        _outcome(F.floor(filled / float(len(TRACKED_FIELDS)) * 10.0), "data_completeness"),
    ]


def rank_listing(df: DataFrame, priority_steps=bands.RANK_PRIORITY) -> DataFrame:
    """Add ``candidate_score``, ``priority``, ``reason_codes`` and ``missing_data``.

    Needs ``price_per_m2``, ``days_on_market``, ``price_reduction_count``, ``investment_score`` and
    ``yield_pct`` next to the listing columns.
    """
    rated = df.withColumn("_o", F.array(*rank_outcomes()))
    score = F.aggregate("_o", F.lit(0), lambda acc, o: acc + o["points"])
    return rated.withColumns(
        {
            "candidate_score": F.greatest(F.lit(0), F.least(F.lit(100), score)),
            "reason_codes": F.array_compact(F.col("_o.reason")),
            "missing_data": F.array_sort(F.array_distinct(F.array_compact(F.col("_o.missing")))),
        }
    ).withColumn("priority", bands.priority("candidate_score", priority_steps)).drop("_o")


# --- quick scores against the city ------------------------------------------------------------


def quick_investment_score(area: str = "surface_m2") -> Column:
    """Six yes/no rules; expects the benchmarks of the city on the row."""
    return total(
        points(F.col("price_per_m2") < F.col("avg_price_per_m2"), 25),
        points(F.col(area) > 100, 20),
        points(upper_label("energy_label").isin(GOOD_LABELS), 15),
        points(F.col("construction_year") > 1995, 15),
        points(F.col("asking_price") < F.col("median_asking_price"), 15),
        points(F.col("plot_size_m2") > 150, 10),
    )


def quick_opportunity_score(investment: str = "investment_score") -> Column:
    """Quick score, cheapness against the city, completeness and upside."""
    cheaper = finance.ratio(F.col("avg_price_per_m2") - F.col("price_per_m2"), "avg_price_per_m2")
    cheapness = F.when(F.col("avg_price_per_m2") > 0, clamped(cheaper * 100.0 * 0.4, 0.0, 20.0))
    numeric = ["surface_m2", "construction_year", "plot_size_m2", "bedrooms", "price_per_m2"]
    filled = total(*[points(F.col(c) != 0, 1) for c in numeric], points(upper_label("energy_label") != "", 1))
    upside = total(
        points(F.col("price_reduction_count") > 0, 8),
        points(F.col("construction_year") < 1990, 4),
        points(upper_label("energy_label").isin(POOR_LABELS), 3),
    )
    raw = (
        F.col(investment) * 0.55 + F.coalesce(cheapness, F.lit(0.0)) + filled / 6.0 * 20.0 + upside.cast("double")
    )
    return clamp_score(raw)


def rank_pipeline(listings: DataFrame) -> DataFrame:
    """One scored candidate per listing: city benchmarks, both quick scores, reasons, priority.

    Listings without a city are held against the whole table.
    """
    ppm2 = F.coalesce(
        "price_per_m2" if "price_per_m2" in listings.columns else F.lit(None).cast("double"),
        F.round(finance.ratio(F.nullif("asking_price", F.lit(0.0)), "surface_m2"), 2),
    )
    city = F.lower(strip("city"))
    base = listings.withColumns(
        {"price_per_m2": ppm2, "city_key": F.nullif(city, F.lit("")), "yield_pct": F.lit(None).cast("double")}
    )
    per_city = city_benchmarks(base.where(F.col("city_key").isNotNull())).select(
        "city_key",
        F.round("avg_price_per_m2", 2).alias("_city_avg"),
        F.round("median_asking_price", 2).alias("_city_median"),
    )
    overall = base.withColumn("city_key", F.lit("*"))
    whole = city_benchmarks(overall).select(
        F.struct(
            F.round("avg_price_per_m2", 2).alias("avg"), F.round("median_asking_price", 2).alias("median")
        ).alias("b")
    )
    joined = base.join(broadcast_if_small(per_city), "city_key", "left").withColumn("_whole", whole.scalar())
    no_city = F.col("city_key").isNull()
    placed = joined.withColumns(
        {
            "avg_price_per_m2": F.when(no_city, F.col("_whole.avg")).otherwise(F.col("_city_avg")),
            "median_asking_price": F.when(no_city, F.col("_whole.median")).otherwise(F.col("_city_median")),
        }
    ).drop("_whole", "_city_avg", "_city_median")
    scored = placed.withColumn("investment_score", quick_investment_score()).withColumn(
        "opportunity_score", quick_opportunity_score()
    )
    ranked = rank_listing(scored)
    return ranked.withColumn("candidate_score", F.col("opportunity_score")).withColumn(
        "priority", bands.priority("opportunity_score", bands.PIPELINE_PRIORITY)
    )


# --- whole-table scoring with city peers -------------------------------------------------------


def split_potential() -> Column:
    label, diff = upper_label("energy_label"), F.col("difference_vs_city_avg_pct")
    return total(
        F.lit(20),
        step_points(F.col("surface_m2"), [(140, 30), (110, 20), (90, 10)]),
        step_points(F.col("bedrooms"), [(4, 20), (3, 10)]),
        points(F.col("plot_size_m2") > 180, 10),
        points(label.isin(GOOD_LABELS), 5),
        points(F.col("days_on_market") > 60, 10),
        F.when(diff <= -10, 15).when(diff < 0, 8).otherwise(0),
    )


def vertical_potential() -> Column:
    year, plot = F.col("construction_year"), F.col("plot_size_m2")
    ratio = F.when(F.col("surface_m2") > 0, plot / F.nullif("surface_m2", F.lit(0.0)))
    return total(
        F.lit(15),
        step_points(ratio, [(2.0, 35), (1.5, 25), (1.2, 15)]),
        F.when(year < 1980, 15).when(year < 2000, 8).otherwise(0),
        F.when(plot > 200, 20).when(plot > 150, 12).otherwise(0),
        points(F.col("difference_vs_city_avg_pct") < 0, 10),
    )


def rental_potential() -> Column:
    diff, area, beds = F.col("difference_vs_city_avg_pct"), F.col("surface_m2"), F.col("bedrooms")
    return total(
        F.lit(20),
        F.when(diff <= -15, 25).when(diff < 0, 15).otherwise(0),
        F.when(area.between(50, 120), 15).when(area <= 150, 8).otherwise(0),
        F.when(beds >= 2, 15).when(beds == 1, 8).otherwise(0),
        points(upper_label("energy_label").isin(FAIR_LABELS), 10),
        points(F.col("days_on_market") > 45, 10),
    )


def renovation_potential() -> Column:
    year, label = F.col("construction_year"), upper_label("energy_label")
    cuts = F.coalesce(to_int("price_reduction_count"), F.lit(0))
    return total(
        F.lit(10),
        F.when(year < 1980, 30).when(year < 1995, 20).otherwise(0),
        F.when(label.isin(POOR_LABELS), 25).when(label == "C", 10).otherwise(0),
        F.when(cuts > 0, F.least(F.lit(10), cuts * 5)).otherwise(0),
        points(F.col("difference_vs_city_avg_pct") <= -8, 15),
        points(F.col("days_on_market") > 60, 10),
    )


# Weights of the opportunity and overall scores.
OPPORTUNITY_WEIGHTS = {
    "market_discount": 0.20, "days_on_market": 0.10, "price_reductions": 0.10, "building_size": 0.10,
    "split_potential": 0.15, "top_up_potential": 0.10, "energy_label": 0.10, "permit_history": 0.05,
    "investment_score": 0.10,
}
OVERALL_WEIGHTS = {
    "investment_score": 0.35, "opportunity_score": 0.25, "split_potential": 0.15, "rental_potential": 0.15,
    "renovation_potential": 0.10,
}


def _share(value: str, full: float) -> Column:
    return F.coalesce(clamped(F.col(value) / full * 100.0, 0.0, 100.0), F.lit(0.0))


def opportunity_components() -> dict[str, Column]:
    """The nine parts of the opportunity score, each 0..100."""
    return {
        "market_discount": F.coalesce(F.col("market_discount_score").cast("double"), F.lit(0.0)),
        "days_on_market": _share("days_on_market", 180.0),
        "price_reductions": _share("price_reduction_count", 4.0),
        "building_size": F.coalesce(
            clamped((F.col("surface_m2") - 60.0) / 120.0 * 100.0, 0.0, 100.0), F.lit(0.0)
        ),
        "split_potential": F.col("split_potential").cast("double"),
        "top_up_potential": F.col("vertical_extension_potential").cast("double"),
        "energy_label": bands.label_score("energy_label"),
        "permit_history": _share("permit_history_count", 6.0),
        "investment_score": F.col("investment_score").cast("double"),
    }


def with_market_discount(df: DataFrame, market: str = "neighborhood_m2_price_average") -> DataFrame:
    """Discount against the neighbourhood price per m², its score and the highlight flag."""
    return df.withColumn("_discount", finance.discount_ratio("price_per_m2", F.nullif(market, F.lit(0.0)))).withColumns(
        {
            "discount_percentage": F.round(F.col("_discount") * 100.0, 2),
            "market_discount_score": finance.market_discount_score(F.col("_discount")),
            "is_market_discount_highlight": finance.is_highlight(F.col("_discount")),
        }
    ).drop("_discount")


def score_deal_rows(rows: DataFrame) -> DataFrame:
    """Score every row against the rows of its city.

    The rows given are the peer set. City averages, medians and the share of cheaper rows come from one table of distinct
    values per city that is joined back.
    """
    return with_overall_score(with_potentials(with_city_peers(rows)))


def with_city_peers(rows: DataFrame, weight: str | None = None) -> DataFrame:
    """Price per m² of every row and where it stands in its city. A row counts ``weight`` times."""
    base = with_ppm2(rows).withColumn("city_key", city_key())
    placed = with_market_discount(with_city_measures(base, "price_per_m2_percentile", weight=weight))
    return placed.withColumns(
        {
            "city_avg_price_per_m2": F.round("avg_price_per_m2", 2),
            "difference_vs_city_avg_pct": F.round(
                finance.ratio(F.col("price_per_m2") - F.col("avg_price_per_m2"), "avg_price_per_m2") * 100.0, 2
            ),
        }
    )


def with_potentials(placed: DataFrame) -> DataFrame:
    """The potentials and the score of a row for which none is given; expects the columns of ``with_city_peers``."""
    return placed.withColumns(
        {
            "_quick_score": quick_investment_score(),
            "split_potential": F.least(split_potential(), F.lit(100)),
            "vertical_extension_potential": F.least(vertical_potential(), F.lit(100)),
            "rental_potential": F.least(rental_potential(), F.lit(100)),
            "renovation_potential": F.least(renovation_potential(), F.lit(100)),
        }
    )


def with_overall_score(rows: DataFrame) -> DataFrame:
    """Opportunity and overall score of rows with potentials. A given ``investment_score`` is kept within 0..100."""
    own = F.col("_quick_score")
    if "investment_score" in rows.columns:
        given = F.col("investment_score")
        whole = dict(rows.dtypes)["investment_score"] in ("tinyint", "smallint", "int")
        own = F.coalesce(clamped(given.cast("int") if whole else to_int(given), 0, 100), own)
    parts = rows.withColumn("investment_score", own).drop("_quick_score").withColumn(
        "opportunity_components", F.struct(*[c.alias(n) for n, c in opportunity_components().items()])
    )
    weighted = total(*[F.col(f"opportunity_components.{n}") * w for n, w in OPPORTUNITY_WEIGHTS.items()])
    scored = parts.withColumn("opportunity_score", clamp_score(weighted))
    overall = total(*[F.col(n).cast("double") * w for n, w in OVERALL_WEIGHTS.items()])
    return scored.withColumn("overall_investment_score", clamp_score(overall)).withColumn(
        "investment_recommendation", bands.stars("overall_investment_score")
    )


# --- category scores and cards -----------------------------------------------------------------

# The score card's constants and the deduction for an unknown price.
CARD_LOCATION, CARD_DEVELOPMENT, CARD_VALUATION, CARD_RISK = 17, 12, 18, 10
UNKNOWN_PRICE_DEDUCTION = 5


def category_scores() -> dict[str, Column]:
    """Six categories of 0..20; needs ``discount_pct``, ``difference_pct``, ``advice``, ``gross_yield``."""
    city = F.lower(strip(F.coalesce("city", F.lit(""))))
    area, diff = F.col("surface_m2"), F.col("difference_pct")
    discount = F.col("discount_pct")
    return {
        "location": total(F.lit(14), points(~city.isin("", "onbekend"), 3), points(area >= 60, 2)),
        "valuation": F.when(discount.isNull(), 8).otherwise(
            bands.ladder(discount, [(12, 19), (9, 17), (6, 15), (3, 12), (0, 10)], 7)
        ),
        "rental": bands.return_score("gross_yield"),
        "transformation": F.when(area.isNull(), 8).otherwise(bands.ladder(area, [(120, 16), (90, 14), (70, 12)], 9)),
        "momentum": F.when(diff.isNull(), 10).otherwise(
            bands.ladder(diff, [(0, 18), (2, 15), (5, 12), (8, 9)], 6, at_most=True)
        ),
        "risk": F.when(F.col("advice") == "Green", 17)
        .when(F.col("advice") == "Orange", 12)
        .when(F.col("advice") == "Red", 7)
        .otherwise(11),
    }


def six_category_score(df: DataFrame) -> DataFrame:
    parts = category_scores()
    scored = df.withColumns({f"{n}_score": c for n, c in parts.items()})
    points_sum = total(*[F.col(f"{n}_score") for n in parts])
    return scored.withColumn("category_total", clamp_score(points_sum / 120.0 * 100.0)).withColumn(
        "category_rating", bands.category_rating("category_total")
    )


def score_card(return_points: Column) -> Column:
    return return_points + F.lit(CARD_LOCATION + CARD_DEVELOPMENT + CARD_VALUATION + CARD_RISK)


def display_score(score: Column, price_status: Column) -> Column:
    """Shown score: five points less when the price is not known."""
    known = F.coalesce(price_status, F.lit("unknown")) == "known"
    return F.when(known, score).otherwise(F.greatest(F.lit(0), score - UNKNOWN_PRICE_DEDUCTION))


# Verdict texts.
SUMMARY_TEXTS = {
    "A+": "Excellent investment opportunity. Attractive valuation with strong upside potential.",
    "A": "Excellent investment opportunity. Attractive valuation with strong upside potential.",
    "B": "Interesting investment. Further due diligence is recommended.",
    "C": "Average investment opportunity. Returns depend on execution.",
    "D": "Weak investment opportunity. Current asking price appears unattractive compared to expected return.",
    "F": "Avoid. The investment fundamentals are currently too weak.",
}
NEXT_STEP_TEXTS = {
    "Green": "Valideer direct markthuur, onderhoud en transactiereferenties om een biedingsstrategie te bepalen.",
    "Orange": "Controleer huurpotentie, renovatiekosten en vergelijkbare verkopen voordat je een bod overweegt.",
    "Red": "Heronderhandel de prijs of wacht op betere fundamentals voordat je verdergaat.",
}
NO_YIELD_STEP = "Verzamel eerst huurgegevens en marktvergelijkingen voor een betrouwbare onderbouwing."
LAST_STEP = "Werk de deal verder uit met aanvullende huur- en marktdata."
NO_STRENGTHS = "Beperkte sterke signalen beschikbaar in de huidige listingdata."
NO_WEAKNESSES = "Onvoldoende waardedata beschikbaar om duidelijke zwaktes te onderbouwen."
GREEN_STRENGTH = "asking price ligt op of onder de placeholder aankoopgrens"


def _lookup(texts: dict[str, str], key: Column, default) -> Column:
    pairs = F.create_map(*[F.lit(x) for pair in texts.items() for x in pair])
    return F.coalesce(F.try_element_at(pairs, key), default)


def verdict_texts(score: str, rating: str, gross_yield: str, advice: str, difference: str, ppm2_text: str, discount: str) -> dict[str, Column]:
    """Summary, strengths, weaknesses and next step in words."""
    strengths = F.concat_ws(
        ", ",
        F.concat(F.lit("Investment score "), col(score).cast("string"), F.lit("/100")),
        F.when(col(gross_yield).isNotNull(), F.concat(F.lit("gross yield "), bands.percentage(gross_yield))),
        F.when(col(advice) == "Green", GREEN_STRENGTH),
    )
    weaknesses = F.concat_ws(
        ", ",
        F.when(
            col(difference) > 0,
            F.concat(F.lit("vraagprijs ligt "), bands.percentage(difference), F.lit(" boven de placeholder aankoopgrens")),
        ),
        F.when(col(ppm2_text) != "Onbekend", F.concat(F.lit("prijsniveau is "), col(ppm2_text))),
        F.when(col(discount).isNotNull(), F.concat(F.lit("placeholder discount is -"), bands.percentage(discount))),
    )
    fallback = F.when(col(gross_yield).isNull(), NO_YIELD_STEP).otherwise(LAST_STEP)
    return {
        "summary_text": _lookup(SUMMARY_TEXTS, col(rating), F.lit(SUMMARY_TEXTS["B"])),
        "strengths_text": F.coalesce(F.nullif(strengths, F.lit("")), F.lit(NO_STRENGTHS)),
        "weaknesses_text": F.coalesce(F.nullif(weaknesses, F.lit("")), F.lit(NO_WEAKNESSES)),
        "next_step_text": _lookup(NEXT_STEP_TEXTS, col(advice), fallback),
    }
