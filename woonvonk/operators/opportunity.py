"""Signals of a property and the opportunities they point to.

A rule is a function that gives evidence columns; new rules are added to the list.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from woonvonk.functions.casts import let, strip
from woonvonk.functions import bands, finance
from woonvonk.functions.text import contains_any, matched_terms, normalize_type, squash
from woonvonk.operators import investment

# Word lists of the signals and the types each rule looks for.
ENTRANCE_TERMS = [
    "multiple entrances", "multiple entrance", "two entrances", "2 entrances", "twee ingangen", "twee entrees",
    "eigen entree", "separate entrance", "separate entrances", "private entrance", "aparte entree",
]
FLAT_ROOF_TERMS = ["plat dak", "flat roof", "dakopbouw", "dakterras", "roof terrace"]
ROOF_CLUES = ["dakopbouw", "dakterras", "plat dak", "roof terrace"]
RENOVATION_TERMS = [
    "kluswoning", "opknapper", "opknap", "renovatie", "te moderniseren", "te renoveren", "sloop", "shell",
]
DETACHED_TERMS = ["vrijstaand", "detached", "villa", "woonboerderij"]
SEMI_TERMS = ["2 onder 1 kap", "2 onder een kap", "halfvrijstaand", "semi", "semidetached"]
SPLIT_TYPES = ["huis", "woning", "villa", "semi", "halfvrijstaand", "detached", "maisonette"]
ROOF_TYPES = ["huis", "woning", "appartement", "portiekflat", "galerijflat", "penthouse"]
RENTAL_TYPES = ["appartement", "huis", "woning", "maisonette", "portiekflat", "galerijflat"]
MIN_CONFIDENCE = 35
FLIP_WORKS_FROM = 20
BREADTH_BONUS = 5


def with_signals(df: DataFrame, raw_text: str = "raw_text", description: str = "description") -> DataFrame:
    """Add the signals; needs ``ppm2``, ``peer_average`` and the listing columns."""
    raw = F.coalesce(F.lower(squash(raw_text)), F.lit(""))
    combined = strip(F.concat_ws(" ", raw, F.coalesce(F.lower(squash(description)), F.lit(""))))
    kind = normalize_type("property_type")
    area = F.coalesce(
        F.nullif(F.col("calculation_area_m2"), F.lit(0.0)) if "calculation_area_m2" in df.columns else F.lit(None).cast("double"),
        F.col("surface_m2"),
    )
    both = (F.col("plot_size_m2") > 0) & (area > 0)
    texted = combined != ""
    return df.withColumns(
        {
            "living_area": area,
            "outdoor_m2": F.when(both, F.round(F.greatest(F.lit(0.0), F.col("plot_size_m2") - area), 2)),
            "outdoor_ratio": F.when(both, F.round(finance.ratio("plot_size_m2", area), 2)),
            "ppm2_delta_pct": F.round(finance.ratio(F.col("ppm2") - F.col("peer_average"), "peer_average") * 100.0, 2),
            "label_key": F.coalesce(F.lower(squash("energy_label")), F.lit("")),
            "type_key": kind,
            "has_entrances": F.when(texted, contains_any(combined, ENTRANCE_TERMS)),
            "has_flat_roof": F.when(texted, contains_any(combined, FLAT_ROOF_TERMS)),
            "has_roof_clue": contains_any(raw, ROOF_CLUES),
            "is_detached": contains_any(kind, DETACHED_TERMS),
            "is_semi": contains_any(kind, SEMI_TERMS),
            "renovation_terms": matched_terms(combined, RENOVATION_TERMS),
        }
    )


def _item(points, note=None, missing=None) -> Column:
    def text(x):
        return (x if isinstance(x, Column) else F.lit(x)).cast("string")

    return F.struct(F.lit(points).cast("int").alias("points"), text(note).alias("note"), text(missing).alias("missing"))


def evidence(steps: list[tuple[Column, int, object]], absent: Column | None = None, missing: str | None = None) -> Column:
    """First step that holds gives points and a note; without data the missing name is kept."""
    out = F.when(absent, _item(0, None, missing)) if absent is not None else F.when(F.lit(False), _item(0))
    for condition, points, note in steps:
        out = out.when(condition, _item(points, note))
    return out.otherwise(_item(0))


def _whole(value: str | Column) -> Column:
    """A number without decimals, halves to even."""
    return F.bround(value, 0).cast("bigint").cast("string")


def _m2(text: str, value: str) -> Column:
    return F.concat(F.lit(f"{text} ("), _whole(value), F.lit(" m²)"))


def _of_type(types: list[str]) -> Column:
    return evidence([(contains_any(F.col("type_key"), types), 8, None)])


def _label_absent() -> Column:
    return F.col("label_key") == ""


def split_evidence() -> list[Column]:
    area, rooms = F.col("living_area"), F.col("bedrooms")
    count = F.concat(rooms.cast("string"), F.lit(" bedrooms"))
    return [
        evidence(
            [(area >= 180, 35, _m2("large living area", "living_area")), (area >= 140, 28, _m2("large living area", "living_area")),
             (area >= 110, 18, _m2("moderate living area", "living_area"))],
            area.isNull(), "living area",
        ),
        evidence([(rooms >= 5, 30, count), (rooms >= 4, 24, count), (rooms >= 3, 12, count)], rooms.isNull(), "many bedrooms"),
        evidence(
            [(F.col("has_entrances"), 30, "multiple entrances referenced in listing text")],
            F.col("has_entrances").isNull(), "multiple entrances",
        ),
        _of_type(SPLIT_TYPES),
    ]


def extension_evidence() -> list[Column]:
    plot, rest = F.col("plot_size_m2"), F.col("outdoor_m2")
    return [
        evidence(
            [(plot >= 600, 35, _m2("large plot", "plot_size_m2")), (plot >= 350, 26, _m2("large plot", "plot_size_m2")),
             (plot >= 200, 16, _m2("usable plot", "plot_size_m2"))],
            plot.isNull(), "plot size",
        ),
        evidence(
            [(F.col("is_detached"), 18, "detached property type"), (F.col("is_semi"), 14, "semi-detached property type")],
            ~F.col("is_detached") & ~F.col("is_semi"), "detached or semi-detached type",
        ),
        evidence(
            [(rest >= 200, 26, _m2("substantial remaining outdoor space", "outdoor_m2")),
             (rest >= 100, 16, _m2("remaining outdoor space", "outdoor_m2")), (rest >= 50, 8, None)],
            rest.isNull(), "remaining outdoor space",
        ),
        evidence([(F.col("outdoor_ratio") >= 2.0, 10, None)]),
    ]


def rooftop_evidence() -> list[Column]:
    year = F.col("building_year")
    return [
        evidence(
            [(F.col("has_flat_roof"), 40, "flat roof referenced in listing text")], F.col("has_flat_roof").isNull(), "flat roof"
        ),
        evidence(
            [(year.between(1950, 2005), 18, F.concat(F.lit("construction year "), year.cast("string"))), (year < 1950, 8, None)],
            year.isNull(), "construction year",
        ),
        _of_type(ROOF_TYPES),
        evidence([(F.col("has_roof_clue"), 12, "roof-related clue in listing text")]),
    ]


def renovation_evidence() -> list[Column]:
    year, label, delta = F.col("building_year"), F.col("label_key"), F.col("ppm2_delta_pct")
    shown = F.upper(label)
    terms = F.concat(F.lit("renovation-related wording ("), F.array_join(F.slice("renovation_terms", 1, 2), ", "), F.lit(")"))
    return [
        evidence(
            [(year <= 1940, 32, F.concat(F.lit("old construction year "), year.cast("string"))),
             (year <= 1970, 24, F.concat(F.lit("older construction year "), year.cast("string"))), (year <= 1985, 14, None)],
            year.isNull(), "construction year",
        ),
        evidence(
            [(label.isin("g", "f", "e"), 30, F.concat(F.lit("poor energy label "), shown)),
             (label == "d", 18, F.concat(F.lit("moderate energy label "), shown))],
            _label_absent(), "energy label",
        ),
        evidence(
            [(delta <= -15, 28, F.concat(F.lit("price per m² "), _whole(F.abs(delta)), F.lit("% below benchmark"))), (delta <= -5, 14, None)],
            F.col("ppm2").isNull(), "price per m²",
        ),
        evidence([(F.size("renovation_terms") > 0, 18, terms)]),
    ]


def rental_evidence() -> list[Column]:
    rooms, delta = F.col("bedrooms"), F.col("ppm2_delta_pct")
    count = F.concat(rooms.cast("string"), F.lit(" bedrooms"))
    return [
        evidence([(rooms >= 5, 30, count), (rooms == 4, 22, count), (rooms == 3, 12, count)], rooms.isNull(), "bedrooms"),
        evidence(
            [(delta <= -10, 34, "attractive price per m²"), (delta <= -5, 18, None)], F.col("ppm2").isNull(), "price per m²"
        ),
        _of_type(RENTAL_TYPES),
    ]


def flip_evidence() -> list[Column]:
    year, label, delta = F.col("building_year"), F.col("label_key"), F.col("ppm2_delta_pct")
    worded = F.size("renovation_terms") > 0
    works = (
        F.when(year <= 1965, 22).when(year <= 1980, 14).otherwise(0)
        + F.when(label.isin("g", "f", "e"), 22).when(label == "d", 12).otherwise(0)
        + F.when(worded, 20).otherwise(0)
    )
    return [
        evidence(
            [(delta <= -15, 36, "below-average price per m²"), (delta <= -8, 24, "slightly below-average price per m²")],
            F.col("ppm2").isNull(), "price per m²",
        ),
        # worked out once; a step of this kind also makes Spark split the code of all evidence into methods that the JVM compiles
        let(
            works,
            lambda points: F.struct(
                F.when(points >= FLIP_WORKS_FROM, points).otherwise(0).alias("points"),
                F.when(worded, "renovation cues in the listing text").alias("note"),
                F.when(year.isNull(), "construction year").alias("missing"),
            ),
        ),
        evidence([], _label_absent(), "energy label"),
        _of_type(RENTAL_TYPES),
    ]


@dataclass(frozen=True)
class Rule:
    opportunity: str
    subject: str
    evidence: Callable[[], list[Column]]


def default_rules() -> list[Rule]:
    return [
        Rule("Possible Split Opportunity", "Split", split_evidence),
        Rule("Possible Extension Opportunity", "Extension", extension_evidence),
        Rule("Possible Rooftop Extension", "Rooftop extension", rooftop_evidence),
        Rule("Renovation Opportunity", "Renovation", renovation_evidence),
        Rule("Rental Opportunity", "Rental", rental_evidence),
        Rule("Flip Opportunity", "Flip", flip_evidence),
    ]


def _finding(place: int, rule: Rule, items: Column) -> Column:
    confidence = F.least(F.lit(100), F.aggregate(items, F.lit(0), lambda a, i: a + i["points"]))
    notes = F.array_compact(F.transform(items, lambda i: i["note"]))
    weak = F.lit(f"{rule.subject} potential is only weakly supported by the current data.")
    text = F.concat(F.lit(f"{rule.subject} potential suggested by "), F.array_join(notes, ", "))
    return F.struct(
        (-confidence).alias("rank"),
        F.lit(place).alias("place"),
        F.lit(rule.opportunity).alias("opportunity_type"),
        confidence.alias("confidence"),
        F.when(F.size(notes) > 0, text).otherwise(weak).alias("explanation"),
        F.array_compact(F.transform(items, lambda i: i["missing"])).alias("missing_data"),
    )


def detect(df: DataFrame, rules: list[Rule] | None = None, min_confidence: int = MIN_CONFIDENCE) -> DataFrame:
    """Add ``findings`` (best first, rule order breaks ties), ``opportunity_score`` and ``summary``.

    Needs the signals and ``overall_score``.
    """
    rules = rules or default_rules()
    gathered = df.withColumns({f"_e{i}": F.array(*r.evidence()) for i, r in enumerate(rules)})
    candidates = F.array(*[_finding(i, r, F.col(f"_e{i}")) for i, r in enumerate(rules)])
    found = gathered.withColumn("_all", candidates).withColumn(
        "findings", F.array_sort(F.filter("_all", lambda f: f["confidence"] >= min_confidence))
    )
    count = F.size("findings")
    best = F.get("findings", F.lit(0))
    score = F.when(count == 0, 0).otherwise(F.least(F.lit(100), best["confidence"] + BREADTH_BONUS * (count - 1)))
    head = F.concat(F.lit("Investment score "), F.col("overall_score").cast("string"), F.lit("/100. "))
    none = F.lit("No clear opportunity pattern was detected with the current data.")
    some = F.concat(
        F.lit("Top signal: "), best["opportunity_type"], F.lit(" ("), best["confidence"].cast("string"), F.lit("/100). Detected: "),
        F.array_join(F.slice(F.col("findings.opportunity_type"), 1, 3), ", "), F.lit("."),
    )
    return found.withColumns(
        {"opportunity_score": score, "summary": F.concat(head, F.when(count == 0, none).otherwise(some))}
    ).drop("_all", *[f"_e{i}" for i in range(len(rules))])


def finding_table(detected: DataFrame, key: str) -> DataFrame:
    """Long form: one row per property and finding, numbered from the strongest.

    The outer form plus a filter on its output keeps Spark from evaluating all rules a second time just to
    filter empty arrays before exploding.
    """
    return detected.select(key, F.posexplode_outer("findings").alias("pos", "f")).where(F.col("pos").isNotNull()).select(
        key, (F.col("pos") + 1).alias("finding_no"), "f.opportunity_type", "f.confidence", "f.explanation", "f.missing_data"
    )


def rollup(findings: DataFrame, key: str) -> DataFrame:
    """Opportunity score from a long table of findings."""
    return findings.groupBy(key).agg(
        F.least(F.lit(100), F.max("confidence") + BREADTH_BONUS * (F.count(F.lit(1)).cast("int") - 1)).alias("opportunity_score")
    )


def end_to_end(new_listings: DataFrame, portfolio: DataFrame, reference_year: int, key: str, top_n: int) -> DataFrame:
    """New listings against the whole portfolio (themselves included): investment, opportunities, priority,
    and the ``top_n`` best."""
    scored = investment.evaluate(new_listings, reference_year, portfolio=portfolio)
    found = detect(with_signals(scored.withColumn("raw_text", F.col("description"))))
    rated = found.withColumn("priority", bands.priority("opportunity_score", bands.BATCH_PRIORITY))
    return rated.orderBy(F.col("opportunity_score").desc(), key).limit(top_n)
