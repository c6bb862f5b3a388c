"""Factor scores of a property against a portfolio.

A factor is a function that gives a score ``Column``; new factors are added to the list. All factors are
columns of one row, so weighting and ranking them needs no shuffle.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from woonvonk.functions import bands, finance
from woonvonk.functions.casts import clamp_score
from woonvonk.functions.text import normalize_type, source_domain, squash
from woonvonk.operators.benchmarks import exact_mean, leave_one_out
from woonvonk.operators.scoring import total
from woonvonk.session import broadcast_if_small

# Neutral score, label bounds and the ladders of the factors.
NEUTRAL = 50
HIGH_FROM, MEDIUM_FROM = 70, 45
PEER_LADDER = [(0.8, 95), (0.9, 85), (1.0, 75), (1.1, 55), (1.2, 35)]
WOZ_LADDER = [(0.75, 95), (0.85, 85), (1.0, 75), (1.1, 55), (1.25, 35)]
AREA_LADDER = [(220, 78), (160, 84), (120, 90), (90, 85), (70, 75), (50, 60), (35, 45)]
PLOT_RATIO_LADDER = [(3.0, 92), (1.5, 85), (1.0, 70), (0.5, 55)]
LABEL_SCORES = {
    "a+++": 100, "a++": 98, "a+": 96, "a": 92, "b": 82, "c": 70, "d": 55, "e": 40, "f": 25, "g": 10,
}
AGE_LADDER = [(5, 95), (15, 88), (30, 80), (50, 65), (75, 50)]
BEDROOM_SCORES = {1: 45, 2: 70, 3: 82, 4: 90, 5: 88, 6: 84}
TYPE_SCORES = [
    ("vrijstaand", 92), ("detached", 92), ("villa", 88), ("woonboerderij", 84), ("farmhouse", 84),
    ("2 onder 1 kap", 86), ("halfvrijstaand", 86), ("semidetached", 86), ("hoekwoning", 80),
    ("end of terrace", 80), ("tussenwoning", 78), ("rijtjeshuis", 78), ("terraced", 78), ("penthouse", 80),
    ("maisonette", 74), ("appartement", 72), ("apartment", 72), ("studio", 60),
]
OTHER_TYPE = 65
YEAR_LADDER_END = 35


@dataclass(frozen=True)
class Factor:
    """A scored aspect: NULL from ``score`` means no data, which counts as neutral."""

    key: str
    label: str
    weight: float
    score: Callable[[], Column]
    value: Callable[[], Column]
    benchmark: Callable[[], Column]
    missing: str


def _two(value: str) -> Column:
    return F.format_string("%.2f", F.col(value))


def _lookup(pairs, key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in pairs for x in pair]), key)


def _peer_ratio(benchmark: str) -> Column:
    return finance.ratio("ppm2", benchmark)


def _against_peers() -> Column:
    usable = (F.col("surface_m2") != 0) & (F.col("asking_price") != 0)
    ratio = F.when(usable, _peer_ratio("peer_average"))
    return F.when(ratio.isNotNull(), bands.ladder(ratio, PEER_LADDER, 20, at_most=True))


def _against_woz() -> Column:
    ratio = finance.ratio("asking_price", "latest_woz_value")
    return F.when(ratio.isNotNull(), bands.ladder(ratio, WOZ_LADDER, 20, at_most=True))


def _area() -> Column:
    area = F.col("surface_m2")
    return F.when(area.isNotNull(), bands.ladder(area, AREA_LADDER, 30))


def _plot() -> Column:
    plot = F.col("plot_size_m2")
    ratio = finance.ratio("plot_size_m2", "surface_m2")
    base = F.when(ratio.isNotNull(), bands.ladder(ratio, PLOT_RATIO_LADDER, 35)).otherwise(
        F.when(plot >= 100, 60).otherwise(NEUTRAL)
    )
    shifted = F.when(plot >= 500, F.least(F.lit(100), base + 5)).when(plot < 50, F.greatest(F.lit(0), base - 5)).otherwise(base)
    return F.when(plot.isNotNull(), shifted)


def _label() -> Column:
    return _lookup(LABEL_SCORES.items(), F.lower(squash("energy_label")))


def _age() -> Column:
    age = F.col("building_age")
    return F.when(age.isNotNull(), bands.ladder(age, AGE_LADDER, YEAR_LADDER_END, at_most=True))


def _bedrooms() -> Column:
    rooms = F.col("bedrooms")
    return F.when(rooms != 0, F.coalesce(_lookup(BEDROOM_SCORES.items(), rooms.cast("int")), F.lit(78)))


def _kind() -> Column:
    kind = normalize_type("property_type")
    out = F.when(kind == "", F.lit(None).cast("int"))
    for word, score in TYPE_SCORES:
        out = out.when(kind.contains(word), score)
    return out.otherwise(OTHER_TYPE)


def _against_neighbourhood() -> Column:
    ratio = _peer_ratio("neighbourhood_ppm2")
    return F.when(ratio.isNotNull(), bands.ladder(ratio, PEER_LADDER, 20, at_most=True))


def default_factors() -> list[Factor]:
    def fixed(text: str) -> Callable[[], Column]:
        return lambda: F.lit(text)

    return [
        Factor("asking_price_vs_portfolio_average", "Asking price vs portfolio average", 15.0, _against_peers,
               lambda: _two("ppm2"), lambda: _two("peer_average"), "Insufficient benchmark data or missing price/surface information."),
        Factor("asking_price_vs_woz", "Asking price vs WOZ", 15.0, _against_woz,
               lambda: _two("asking_price"), lambda: _two("latest_woz_value"), "Missing asking price or WOZ value."),
        Factor("living_area", "Living area", 10.0, _area,
               lambda: F.format_string("%.2f", F.round("surface_m2", 1)), fixed("Market-size preference"), "Missing living area."),
        Factor("plot_size", "Plot size", 10.0, _plot,
               lambda: F.format_string("%.1f", F.col("plot_size_m2")),
               lambda: F.coalesce(F.concat(F.lit("ratio "), F.format_string("%.2f", F.nullif(F.coalesce(finance.ratio("plot_size_m2", "surface_m2"), F.lit(-1.0)), F.lit(-1.0)))), F.lit("no area ratio")),
               "Missing plot size."),
        Factor("energy_label", "Energy label", 15.0, _label,
               lambda: F.col("energy_label"), fixed("Higher is better"), "Missing or unknown energy label."),
        Factor("building_age", "Building age", 15.0, _age,
               lambda: F.col("building_age").cast("string"),
               lambda: F.concat(F.lit("Built in "), F.col("building_year").cast("string")), "Missing building year."),
        Factor("bedrooms", "Bedrooms", 10.0, _bedrooms,
               lambda: F.col("bedrooms").cast("string"),
               fixed("3-5 bedrooms typically balance liquidity and rental demand"), "Missing bedroom count."),
        Factor("property_type", "Property type", 10.0, _kind,
               lambda: F.col("property_type"), fixed("Type-specific liquidity and demand assumptions"), "Missing property type."),
        Factor("price_per_m2", "Price per m²", 15.0, _against_neighbourhood,
               lambda: _two("ppm2"), lambda: _two("neighbourhood_ppm2"), "Missing price per m² or portfolio benchmark."),
    ]


def property_ppm2(df: DataFrame) -> Column:
    """Given price per m² first, then price over the calculation area, then over the living area."""

    def have(name: str) -> Column:
        return F.col(name).cast("double") if name in df.columns else F.lit(None).cast("double")

    return F.coalesce(
        F.round(have("asking_price_per_m2"), 2),
        F.round(have("price_per_m2"), 2),
        F.round(F.try_divide(F.col("asking_price"), have("calculation_area_m2")), 2),
        F.round(F.try_divide(F.col("asking_price"), F.col("surface_m2")), 2),
    )


def _optional(df: DataFrame, name: str, dtype: str) -> Column:
    return F.col(name).cast(dtype) if name in df.columns else F.lit(None).cast(dtype)


def with_measures(df: DataFrame, reference_year: int) -> DataFrame:
    """Columns the factors look at, apart from the peer average."""
    year = F.coalesce(
        F.nullif(_optional(df, "construction_year_bag", "int"), F.lit(0)),
        F.nullif(_optional(df, "bag_building_year", "int"), F.lit(0)),
        F.nullif(F.col("construction_year"), F.lit(0)),
    )
    return df.withColumns(
        {
            "ppm2": property_ppm2(df),
            "building_year": year,
            "building_age": F.when(year.isNotNull(), F.greatest(F.lit(0), F.lit(reference_year) - year)),
        }
    )


def with_peers(df: DataFrame, portfolio: DataFrame | None = None) -> DataFrame:
    """Average price per m² of the peers: of everybody else, or of a given portfolio (own row included)."""
    if portfolio is None:
        return leave_one_out(df, "ppm2", "peer_average")
    rolled = portfolio.agg(
        F.struct(F.round(exact_mean("ppm2"), 2).alias("average"), F.count(F.lit(1)).alias("size")).alias("p")
    ).scalar()
    return df.withColumn("_p", rolled).select(
        *df.columns, F.col("_p.average").alias("peer_average"), F.col("_p.size").alias("peer_average_size")
    )


def effective_weights(df: DataFrame, profiles: DataFrame | None, factors: list[Factor]) -> DataFrame:
    """Weights and label bounds of the row's source.

    ``profiles`` holds one row per source domain: ``domain``, ``weights`` (map factor to weight) and
    ``thresholds`` (map with ``medium`` and ``low``). What a profile does not name keeps its default.
    """
    if profiles is not None:
        keyed = df.withColumn("domain", source_domain("source_url"))
        df = keyed.join(broadcast_if_small(profiles.select("domain", "weights", "thresholds")), "domain", "left")

    def setting(column: str, name: str, default, dtype: str) -> Column:
        if profiles is None:
            return F.lit(default).cast(dtype)
        return F.coalesce(F.try_element_at(column, F.lit(name)).cast(dtype), F.lit(default).cast(dtype))

    out = df.withColumns(
        {
            **{f"w_{f.key}": setting("weights", f.key, f.weight, "double") for f in factors},
            "high_from": setting("thresholds", "medium", HIGH_FROM, "int"),
            "medium_from": setting("thresholds", "low", MEDIUM_FROM, "int"),
        }
    )
    return out.drop("weights", "thresholds") if profiles is not None else out


def contribution(score: Column, weight: Column) -> Column:
    return F.round((score.cast("double") - float(NEUTRAL)) / float(NEUTRAL) * weight, 2)


def factor_line(f: Column) -> Column:
    extra = F.when(f["benchmark"] != "", F.concat(F.lit(" (benchmark "), f["benchmark"], F.lit(")"))).otherwise("")
    shown = F.coalesce(F.nullif(f["value"], F.lit("")), f["note"])
    return F.concat(f["label"], F.lit(": "), shown, extra, F.lit(" ["), f["score"].cast("string"), F.lit("/100]"))


def evaluate(
    df: DataFrame,
    reference_year: int,
    portfolio: DataFrame | None = None,
    profiles: DataFrame | None = None,
    factors: list[Factor] | None = None,
) -> DataFrame:
    """Score every property: factor scores, overall score, label, strongest factors, explanation."""
    factors = factors or default_factors()
    measured = with_measures(df, reference_year)
    if portfolio is not None:
        portfolio = portfolio.withColumn("ppm2", property_ppm2(portfolio))
    peers = with_peers(measured, portfolio)
    local = F.round(_optional(df, "neighborhood_m2_price_average", "double"), 2)
    based = effective_weights(peers.withColumn("neighbourhood_ppm2", F.coalesce(local, "peer_average")), profiles, factors)
    scored = based.withColumns({f"raw_{f.key}": f.score() for f in factors}).withColumns(
        {f"{f.key}_score": F.coalesce(f"raw_{f.key}", F.lit(NEUTRAL)) for f in factors}
    )
    weights = {f.key: F.greatest(F.lit(0.0), F.col(f"w_{f.key}")) for f in factors}
    weight_sum = total(*weights.values())
    weighted = total(*[F.col(f"{k}_score") * w for k, w in weights.items()])
    overall = F.coalesce(clamp_score(F.try_divide(weighted, weight_sum)), F.lit(0))
    details = F.array(
        *[
            F.struct(
                (-contribution(F.col(f"{f.key}_score"), F.col(f"w_{f.key}"))).alias("drag"),
                F.lit(i).alias("place"),
                F.lit(f.key).alias("key"),
                F.lit(f.label).alias("label"),
                F.col(f"{f.key}_score").alias("score"),
                F.when(F.col(f"raw_{f.key}").isNotNull(), F.coalesce(f.value(), F.lit(""))).otherwise("").alias("value"),
                F.when(F.col(f"raw_{f.key}").isNotNull(), F.coalesce(f.benchmark(), F.lit(""))).otherwise("").alias("benchmark"),
                F.lit(f.missing).alias("note"),
            )
            for i, f in enumerate(factors)
        ]
    )
    rated = scored.withColumns({"overall_score": overall, "factors": F.array_sort(details)})
    rising = F.array_sort(
        F.transform("factors", lambda f: F.struct((-f["drag"]).alias("gain"), f["place"].alias("place"), f.alias("f")))
    )
    ranked = rated.withColumn("_weakest", F.transform(rising, lambda x: x["f"]))
    labelled = ranked.withColumn(
        "attractiveness",
        F.when(F.col("overall_score") >= F.col("high_from"), "High")
        .when(F.col("overall_score") >= F.col("medium_from"), "Medium")
        .otherwise("Low"),
    )
    return labelled.withColumns(
        {
            "top_positive": F.transform(F.slice("factors", 1, 5), factor_line),
            "top_negative": F.transform(F.slice("_weakest", 1, 5), factor_line),
            "positive_keys": F.col("factors.key"),
            "negative_keys": F.col("_weakest.key"),
            "explanation": _explanation(),
        }
    ).drop("_weakest", *[f"raw_{f.key}" for f in factors])


def _explanation() -> Column:
    delta = F.round(finance.ratio(F.col("ppm2") - F.col("peer_average"), "peer_average") * 100.0, 2)
    price = (
        F.when(F.col("ppm2").isNull(), "Price per m² could not be calculated because asking price or living area is missing.")
        .when(
            F.col("peer_average").isNull(),
            F.format_string("Price per m² is %.2f; no portfolio benchmark is available yet.", "ppm2"),
        )
        .otherwise(
            F.format_string(
                "Price per m² is %.2f, which is %.2f%% versus the portfolio average of %.2f.", "ppm2", delta, "peer_average"
            )
        )
    )
    best, worst = F.get("factors", F.lit(0)), F.get("_weakest", F.lit(0))
    return F.concat_ws(
        " ",
        F.concat(F.lit("Overall investment score: "), F.col("overall_score").cast("string"), F.lit("/100 ("), F.col("attractiveness"), F.lit(").")),
        price,
        F.when(best["drag"] < 0, F.concat(F.lit("Best driver: "), best["label"], F.lit("."))),
        F.when(worst["drag"] > 0, F.concat(F.lit("Main drag: "), worst["label"], F.lit("."))),
    )


def factor_table(evaluated: DataFrame, key: str) -> DataFrame:
    """Long form: one row per property and factor.

    Made of the score and weight columns: the sorted ``factors`` hold texts that nobody asks for here. The outer form
    keeps Spark from working the scores out a second time to filter empty arrays.
    """
    names = [c.removesuffix("_score") for c in evaluated.columns if c.endswith("_score") and f"w_{c.removesuffix('_score')}" in evaluated.columns]
    rows = F.array(*[F.struct(F.lit(n).alias("factor"), F.col(f"{n}_score").alias("score"), F.col(f"w_{n}").alias("weight")) for n in names])
    return evaluated.select(key, F.inline_outer(rows)).select(key, "factor", "score", contribution(F.col("score"), F.col("weight")).alias("contribution"))


def weighted_score(factor_rows: DataFrame, key: str) -> DataFrame:
    """Weighted mean over a long factor table (``score``, ``weight``); negative weights count as none."""
    weight = F.greatest(F.lit(0.0), F.col("weight"))
    mean = F.try_divide(F.sum(F.col("score") * weight), F.sum(weight))
    return factor_rows.groupBy(key).agg(F.coalesce(clamp_score(mean), F.lit(0)).alias("overall_score"))
