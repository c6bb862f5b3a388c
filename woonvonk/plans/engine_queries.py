"""Queries of the investment and opportunity engines."""

from __future__ import annotations

from pyspark.sql import functions as F

from woonvonk.operators import investment, opportunity
from woonvonk.plans.registry import query
from woonvonk.plans.views import mean, r2, view, with_views

YEAR = 2026

KINDS = investment.TYPE_SCORES
TYPE_SQL = " ".join(f"WHEN contains(kind, '{w}') THEN {s}" for w, s in KINDS)


def _ladder(value: str, steps, last, op: str) -> str:
    return "CASE " + " ".join(f"WHEN {value} {op} {b} THEN {s}" for b, s in steps) + f" ELSE {last} END"


def _measures(peer: str) -> str:
    return f"""
m AS (SELECT *, {r2('asking_price / nullif(surface_m2, 0)')} AS ppm2, construction_year AS building_year, {YEAR} - construction_year AS age,
    replace(replace(lower(trim(property_type)), '_', ' '), '-', ' ') AS kind, regexp_extract(lower(source_url), '(portal\\d+)\\.', 1) AS portal FROM listings),
t AS (SELECT cast(sum(cast(ppm2 as decimal(18, 2))) as double) AS total, count(ppm2) AS filled, count(*) AS n, {mean('ppm2')} AS mean FROM m),
p AS (SELECT m.*, {peer} AS peer FROM m, t),
q AS (SELECT *, coalesce(neighborhood_m2_price_average, peer) AS hood FROM p)"""


LEAVE_ONE_OUT = r2("(total - coalesce(ppm2, 0)) / nullif(filled - CASE WHEN ppm2 IS NULL THEN 0 ELSE 1 END, 0)")
WHOLE = r2("mean")

FACTORS_SQL = f"""
f AS (SELECT *,
    CASE WHEN ppm2 IS NOT NULL AND peer IS NOT NULL THEN {_ladder('ppm2 / peer', investment.PEER_LADDER, 20, '<=')} END AS f0,
    CASE WHEN asking_price IS NOT NULL AND latest_woz_value <> 0 THEN {_ladder('asking_price / latest_woz_value', investment.WOZ_LADDER, 20, '<=')} END AS f1,
    CASE WHEN surface_m2 IS NOT NULL THEN {_ladder('surface_m2', investment.AREA_LADDER, 30, '>=')} END AS f2,
    CASE WHEN plot_size_m2 IS NOT NULL THEN
      CASE WHEN plot_size_m2 >= 500 THEN least(100, 5 + CASE WHEN surface_m2 IS NULL THEN 60 ELSE {_ladder('plot_size_m2 / surface_m2', investment.PLOT_RATIO_LADDER, 35, '>=')} END)
        WHEN plot_size_m2 < 50 THEN -5 + CASE WHEN surface_m2 IS NULL THEN 50 ELSE {_ladder('plot_size_m2 / surface_m2', investment.PLOT_RATIO_LADDER, 35, '>=')} END
        ELSE CASE WHEN surface_m2 IS NULL THEN CASE WHEN plot_size_m2 >= 100 THEN 60 ELSE 50 END ELSE {_ladder('plot_size_m2 / surface_m2', investment.PLOT_RATIO_LADDER, 35, '>=')} END END END AS f3,
    CASE lower(trim(energy_label)) WHEN 'a+++' THEN 100 WHEN 'a++' THEN 98 WHEN 'a+' THEN 96 WHEN 'a' THEN 92 WHEN 'b' THEN 82 WHEN 'c' THEN 70 WHEN 'd' THEN 55 WHEN 'e' THEN 40 WHEN 'f' THEN 25 WHEN 'g' THEN 10 END AS f4,
    CASE WHEN age IS NOT NULL THEN {_ladder('age', investment.AGE_LADDER, 35, '<=')} END AS f5,
    CASE WHEN bedrooms <> 0 THEN CASE bedrooms WHEN 1 THEN 45 WHEN 2 THEN 70 WHEN 3 THEN 82 WHEN 4 THEN 90 WHEN 5 THEN 88 WHEN 6 THEN 84 ELSE 78 END END AS f6,
    CASE {TYPE_SQL} ELSE 65 END AS f7,
    CASE WHEN ppm2 IS NOT NULL AND hood IS NOT NULL THEN {_ladder('ppm2 / hood', investment.PEER_LADDER, 20, '<=')} END AS f8
  FROM q)"""

KEYS = [
    "asking_price_vs_portfolio_average", "asking_price_vs_woz", "living_area", "plot_size", "energy_label",
    "building_age", "bedrooms", "property_type", "price_per_m2",
]
LABELS = [
    "Asking price vs portfolio average", "Asking price vs WOZ", "Living area", "Plot size", "Energy label", "Building age",
    "Bedrooms", "Property type", "Price per m²",
]
WEIGHTS = [15, 15, 10, 10, 15, 15, 10, 10, 15]


def _scores(weights: list[str]) -> str:
    top = " + ".join(f"coalesce(f{i}, 50) * {w}" for i, w in enumerate(weights))
    bottom = " + ".join(weights)
    long = " UNION ALL ".join(
        f"SELECT listing_id, {i} AS place, '{KEYS[i]}' AS key, '{LABELS[i]}' AS label, coalesce(f{i}, 50) AS score, {w} AS weight FROM f" for i, w in enumerate(weights)
    )
    return f"""
o AS (SELECT *, cast(round_even(({top}) / ({bottom}), 0) as int) AS overall FROM f),
long AS ({long}),
c AS (SELECT *, {r2('(score - 50e0) / 50e0 * weight')} AS contribution FROM long)"""


def _plain(weights=None) -> str:
    return f"{_measures(LEAVE_ONE_OUT)}, {FACTORS_SQL}, {_scores([f'{w}e0' for w in (weights or WEIGHTS)])}"


def _profile_weights() -> list[str]:
    out = [f"{w}e0" for w in WEIGHTS]
    out[4] = "CASE WHEN portal = 'portal3' THEN 40e0 WHEN portal = 'portal7' THEN 0e0 ELSE 15e0 END"
    out[6] = "CASE WHEN portal = 'portal3' THEN 0e0 WHEN portal = 'portal7' THEN -5e0 ELSE 10e0 END"
    return out


def _evaluated(spark, sf_dir, **options):
    return investment.evaluate(view(spark, sf_dir, "listings"), YEAR, **options)


@query(
    "investment_engine",
    with_views(
        "listings",
        f"""WITH {_plain()} SELECT listing_id, ppm2, peer AS peer_average, {', '.join(f'coalesce(f{i}, 50) AS {k}_score' for i, k in enumerate(KEYS))}, overall AS overall_score,
        CASE WHEN overall >= 70 THEN 'High' WHEN overall >= 45 THEN 'Medium' ELSE 'Low' END AS attractiveness FROM o""",
    ),
)
def investment_engine(spark, sf_dir):
    return _evaluated(spark, sf_dir).select(
        "listing_id", "ppm2", "peer_average", *[f"{k}_score" for k in KEYS], "overall_score", "attractiveness"
    )


@query(
    "portfolio_pairs",
    with_views("listings", f"WITH {_measures(LEAVE_ONE_OUT)} SELECT listing_id, ppm2, peer AS peer_average, (SELECT count(*) FROM listings) - 1 AS peer_average_size FROM p"),
)
def portfolio_pairs(spark, sf_dir):
    measured = investment.with_measures(view(spark, sf_dir, "listings"), YEAR)
    return investment.with_peers(measured).select("listing_id", "ppm2", "peer_average", "peer_average_size")


def _profiles(spark, sf_dir):
    """Profiles of two of the sources, taken from the source table."""
    sources = view(spark, sf_dir, "sources").where("source_id in (3, 7)")
    seven = F.col("source_id") == 7
    return sources.select(
        F.col("source_name").alias("domain"),
        F.create_map(
            F.lit("energy_label"), F.when(seven, 0.0).otherwise(40.0), F.lit("bedrooms"), F.when(seven, -5.0).otherwise(0.0)
        ).alias("weights"),
        F.create_map(F.lit("medium"), F.when(seven, 80).otherwise(60)).alias("thresholds"),
    )


def _weights_profiled() -> str:
    guarded = [w if "CASE" not in w else w.replace("-5e0", "0e0") for w in _profile_weights()]
    return f"{_measures(LEAVE_ONE_OUT)}, {FACTORS_SQL}, {_scores(guarded)}".replace("AS weight FROM f", "AS weight FROM f")


@query(
    "source_profiles",
    with_views(
        "listings",
        f"""WITH {_weights_profiled()} SELECT listing_id, overall AS overall_score,
        CASE WHEN overall >= CASE portal WHEN 'portal7' THEN 80 WHEN 'portal3' THEN 60 ELSE 70 END THEN 'High' WHEN overall >= 45 THEN 'Medium' ELSE 'Low' END AS attractiveness,
        {_profile_weights()[4]} AS energy_weight FROM o""",
    ),
)
def source_profiles(spark, sf_dir):
    rated = _evaluated(spark, sf_dir, profiles=_profiles(spark, sf_dir))
    return rated.select("listing_id", "overall_score", "attractiveness", F.col("w_energy_label").alias("energy_weight"))


@query(
    "attractiveness",
    with_views(
        "listings",
        f"""WITH {_plain()}, best AS (SELECT listing_id, arg_min(label, (-contribution, place)) AS best_label, max(contribution) AS best_c, arg_min(label, (contribution, place)) AS worst_label, min(contribution) AS worst_c FROM c GROUP BY listing_id),
        d AS (SELECT o.*, {r2('(ppm2 - peer) / peer * 100e0')} AS delta, best.* EXCLUDE (listing_id) FROM o JOIN best ON best.listing_id = o.listing_id)
        SELECT listing_id, concat_ws(' ', concat('Overall investment score: ', cast(overall as varchar), '/100 (', CASE WHEN overall >= 70 THEN 'High' WHEN overall >= 45 THEN 'Medium' ELSE 'Low' END, ').'),
          CASE WHEN ppm2 IS NULL THEN 'Price per m² could not be calculated because asking price or living area is missing.'
            ELSE concat('Price per m² is ', printf('%.2f', ppm2), ', which is ', printf('%.2f', delta), '% versus the portfolio average of ', printf('%.2f', peer), '.') END,
          CASE WHEN best_c > 0 THEN concat('Best driver: ', best_label, '.') END, CASE WHEN worst_c < 0 THEN concat('Main drag: ', worst_label, '.') END) AS explanation FROM d""",
    ),
)
def attractiveness(spark, sf_dir):
    return _evaluated(spark, sf_dir).select("listing_id", "explanation")


@query(
    "top_factors",
    with_views(
        "listings",
        f"""WITH {_plain()}, up AS (SELECT *, row_number() OVER (PARTITION BY listing_id ORDER BY contribution DESC, place) AS u, row_number() OVER (PARTITION BY listing_id ORDER BY contribution, place) AS d FROM c)
        SELECT listing_id, string_agg(key, ',' ORDER BY u) FILTER (u <= 5) AS positive_keys, string_agg(key, ',' ORDER BY d) FILTER (d <= 5) AS negative_keys FROM up GROUP BY listing_id""",
    ),
)
def top_factors(spark, sf_dir):
    return _evaluated(spark, sf_dir).select(
        "listing_id",
        F.array_join(F.slice("positive_keys", 1, 5), ",").alias("positive_keys"),
        F.array_join(F.slice("negative_keys", 1, 5), ",").alias("negative_keys"),
    )


@query(
    "factor_contributions",
    with_views("listings", f"WITH {_plain()} SELECT listing_id, key AS factor, score, contribution FROM c"),
)
def factor_contributions(spark, sf_dir):
    return investment.factor_table(_evaluated(spark, sf_dir), "listing_id")


@query("weighted_score", with_views("listings", f"WITH {_plain()} SELECT listing_id, overall AS overall_score FROM o"))
def weighted_score(spark, sf_dir):
    factors = investment.factor_table(_evaluated(spark, sf_dir), "listing_id")
    weights = F.create_map(*[F.lit(x) for f in investment.default_factors() for x in (f.key, f.weight)])
    return investment.weighted_score(factors.withColumn("weight", F.element_at(weights, F.col("factor"))), "listing_id")


# --- opportunities ------------------------------------------------------------------------------

SIGNALS_SQL = f"""
s AS (SELECT *, {r2('greatest(0, plot_size_m2 - surface_m2)')} AS outdoor, {r2('plot_size_m2 / surface_m2')} AS ratio, {r2('(ppm2 - peer) / peer * 100e0')} AS delta,
    lower(trim(coalesce(energy_label, ''))) AS label, lower(description) AS txt,
    contains(kind, 'vrijstaand') OR contains(kind, 'villa') AS detached, contains(kind, '2 onder 1 kap') AS semi_type FROM o)"""

HOUSE_TYPES = "(contains(kind, 'woning') OR contains(kind, 'villa'))"
HOME_TYPES = "(contains(kind, 'woning') OR contains(kind, 'appartement'))"
RULES_SQL = f"""
r AS (SELECT *,
    CASE WHEN surface_m2 >= 180 THEN 35 WHEN surface_m2 >= 140 THEN 28 WHEN surface_m2 >= 110 THEN 18 ELSE 0 END + CASE WHEN bedrooms >= 5 THEN 30 WHEN bedrooms >= 4 THEN 24 WHEN bedrooms >= 3 THEN 12 ELSE 0 END
      + CASE WHEN contains(txt, 'twee ingangen') THEN 30 ELSE 0 END + CASE WHEN {HOUSE_TYPES} THEN 8 ELSE 0 END AS r0,
    CASE WHEN plot_size_m2 >= 600 THEN 35 WHEN plot_size_m2 >= 350 THEN 26 WHEN plot_size_m2 >= 200 THEN 16 ELSE 0 END + CASE WHEN detached THEN 18 WHEN semi_type THEN 14 ELSE 0 END
      + CASE WHEN outdoor >= 200 THEN 26 WHEN outdoor >= 100 THEN 16 WHEN outdoor >= 50 THEN 8 ELSE 0 END + CASE WHEN ratio >= 2 THEN 10 ELSE 0 END AS r1,
    CASE WHEN contains(txt, 'plat dak') THEN 52 ELSE 0 END + CASE WHEN building_year BETWEEN 1950 AND 2005 THEN 18 WHEN building_year < 1950 THEN 8 ELSE 0 END + CASE WHEN {HOME_TYPES} THEN 8 ELSE 0 END AS r2,
    CASE WHEN building_year <= 1940 THEN 32 WHEN building_year <= 1970 THEN 24 WHEN building_year <= 1985 THEN 14 ELSE 0 END + CASE WHEN label IN ('g', 'f', 'e') THEN 30 WHEN label = 'd' THEN 18 ELSE 0 END
      + CASE WHEN delta <= -15 THEN 28 WHEN delta <= -5 THEN 14 ELSE 0 END + CASE WHEN contains(txt, 'kluswoning') THEN 18 ELSE 0 END AS r3,
    CASE WHEN bedrooms >= 5 THEN 30 WHEN bedrooms = 4 THEN 22 WHEN bedrooms = 3 THEN 12 ELSE 0 END + CASE WHEN delta <= -10 THEN 34 WHEN delta <= -5 THEN 18 ELSE 0 END + CASE WHEN {HOME_TYPES} THEN 8 ELSE 0 END AS r4,
    CASE WHEN building_year <= 1965 THEN 22 WHEN building_year <= 1980 THEN 14 ELSE 0 END + CASE WHEN label IN ('g', 'f', 'e') THEN 22 WHEN label = 'd' THEN 12 ELSE 0 END + CASE WHEN contains(txt, 'kluswoning') THEN 20 ELSE 0 END AS works,
    CASE WHEN delta <= -15 THEN 36 WHEN delta <= -8 THEN 24 ELSE 0 END + CASE WHEN {HOME_TYPES} THEN 8 ELSE 0 END AS r5a
  FROM s),
findings AS (
  SELECT listing_id, overall, 0 AS place, 'Possible Split Opportunity' AS opportunity_type, least(100, r0) AS confidence FROM r WHERE r0 >= 35
  UNION ALL SELECT listing_id, overall, 1, 'Possible Extension Opportunity', least(100, r1) FROM r WHERE r1 >= 35
  UNION ALL SELECT listing_id, overall, 2, 'Possible Rooftop Extension', least(100, r2) FROM r WHERE r2 >= 35
  UNION ALL SELECT listing_id, overall, 3, 'Renovation Opportunity', least(100, r3) FROM r WHERE r3 >= 35
  UNION ALL SELECT listing_id, overall, 4, 'Rental Opportunity', least(100, r4) FROM r WHERE r4 >= 35
  UNION ALL SELECT listing_id, overall, 5, 'Flip Opportunity', least(100, r5a + CASE WHEN works >= 20 THEN works ELSE 0 END) FROM r WHERE r5a + CASE WHEN works >= 20 THEN works ELSE 0 END >= 35),
numbered AS (SELECT *, row_number() OVER (PARTITION BY listing_id ORDER BY confidence DESC, place) AS no FROM findings),
rolled AS (SELECT listing_id, max(confidence) AS top, count(*) AS n, string_agg(opportunity_type, ', ' ORDER BY no) FILTER (no <= 3) AS names, arg_min(opportunity_type, no) AS best FROM numbered GROUP BY listing_id)"""


def _signalled(spark, sf_dir, **options):
    rated = _evaluated(spark, sf_dir, **options)
    return opportunity.with_signals(rated.withColumn("raw_text", F.col("description")))


@query(
    "opportunity_signals",
    with_views(
        "listings",
        f"""WITH {_plain()}, {SIGNALS_SQL} SELECT listing_id, surface_m2 AS living_area, CASE WHEN plot_size_m2 > 0 AND surface_m2 > 0 THEN outdoor END AS outdoor_m2, ratio AS outdoor_ratio, delta AS ppm2_delta_pct, label AS label_key, kind AS type_key,
        CASE WHEN txt <> '' THEN contains(txt, 'twee ingangen') END AS has_entrances, CASE WHEN txt <> '' THEN contains(txt, 'plat dak') END AS has_flat_roof, detached AS is_detached, semi_type AS is_semi,
        CASE WHEN contains(txt, 'kluswoning') THEN 'kluswoning,te renoveren' ELSE '' END AS renovation_terms FROM s""",
    ),
)
def opportunity_signals(spark, sf_dir):
    return _signalled(spark, sf_dir).select(
        "listing_id", "living_area", "outdoor_m2", "outdoor_ratio", "ppm2_delta_pct", "label_key", "type_key", "has_entrances",
        "has_flat_roof", "is_detached", "is_semi", F.array_join("renovation_terms", ",").alias("renovation_terms"),
    )


def _detected(spark, sf_dir):
    return opportunity.detect(_signalled(spark, sf_dir))


@query(
    "opportunity_rules",
    with_views("listings", f"WITH {_plain()}, {SIGNALS_SQL}, {RULES_SQL} SELECT listing_id, cast(no as int) AS finding_no, opportunity_type, confidence FROM numbered"),
)
def opportunity_rules(spark, sf_dir):
    return opportunity.finding_table(_detected(spark, sf_dir), "listing_id").drop("explanation", "missing_data")


@query(
    "sort_findings",
    with_views("listings", f"WITH {_plain()}, {SIGNALS_SQL}, {RULES_SQL} SELECT o.listing_id, coalesce(string_agg(concat(opportunity_type, '=', cast(confidence as varchar)), '|' ORDER BY no) FILTER (numbered.listing_id IS NOT NULL), '') AS findings FROM o LEFT JOIN numbered ON numbered.listing_id = o.listing_id GROUP BY o.listing_id"),
)
def sort_findings(spark, sf_dir):
    shown = F.transform("findings", lambda f: F.concat(f["opportunity_type"], F.lit("="), f["confidence"].cast("string")))
    return _detected(spark, sf_dir).select("listing_id", F.array_join(shown, "|").alias("findings"))


def _explained(subject: str, notes: list[str], missing: list[tuple[str, str]]) -> str:
    """Columns for what speaks for an opportunity, and which data it would need."""
    named = ", ".join(f"CASE WHEN {when} THEN '{name}' END" for when, name in missing)
    return f"""CASE WHEN coalesce({', '.join(notes)}) IS NOT NULL THEN concat('{subject} potential suggested by ', concat_ws(', ', {', '.join(notes)}))
        ELSE '{subject} potential is only weakly supported by the current data.' END AS explanation, concat_ws('|', {named}) AS missing_data"""


def _whole(value: str) -> str:
    return f"cast(cast(round_even({value}, 0) as bigint) as varchar)"


def _m2(note: str, value: str) -> str:
    return f"concat('{note} (', {_whole(value)}, ' m²)')"


_OUTDOOR = "CASE WHEN plot_size_m2 > 0 AND surface_m2 > 0 THEN outdoor END"
_NO_PRICE, _NO_YEAR, _NO_LABEL = ("ppm2 IS NULL", "price per m²"), ("building_year IS NULL", "construction year"), ("label = ''", "energy label")
EXPLAINED = {
    "Possible Split Opportunity": ("r0", _explained(
        "Split",
        [f"CASE WHEN surface_m2 >= 140 THEN {_m2('large living area', 'surface_m2')} WHEN surface_m2 >= 110 THEN {_m2('moderate living area', 'surface_m2')} END",
         "CASE WHEN bedrooms >= 3 THEN concat(bedrooms, ' bedrooms') END",
         "CASE WHEN contains(txt, 'twee ingangen') THEN 'multiple entrances referenced in listing text' END"],
        [("surface_m2 IS NULL", "living area"), ("bedrooms IS NULL", "many bedrooms"), ("txt = ''", "multiple entrances")],
    )),
    "Possible Extension Opportunity": ("r1", _explained(
        "Extension",
        [f"CASE WHEN plot_size_m2 >= 350 THEN {_m2('large plot', 'plot_size_m2')} WHEN plot_size_m2 >= 200 THEN {_m2('usable plot', 'plot_size_m2')} END",
         "CASE WHEN detached THEN 'detached property type' WHEN semi_type THEN 'semi-detached property type' END",
         f"CASE WHEN {_OUTDOOR} >= 200 THEN {_m2('substantial remaining outdoor space', 'outdoor')} WHEN {_OUTDOOR} >= 100 THEN {_m2('remaining outdoor space', 'outdoor')} END"],
        [("plot_size_m2 IS NULL", "plot size"), ("NOT detached AND NOT semi_type", "detached or semi-detached type"), (f"({_OUTDOOR}) IS NULL", "remaining outdoor space")],
    )),
    "Possible Rooftop Extension": ("r2", _explained(
        "Rooftop extension",
        ["CASE WHEN contains(txt, 'plat dak') THEN 'flat roof referenced in listing text' END",
         "CASE WHEN building_year BETWEEN 1950 AND 2005 THEN concat('construction year ', building_year) END",
         "CASE WHEN contains(txt, 'plat dak') THEN 'roof-related clue in listing text' END"],
        [("txt = ''", "flat roof"), _NO_YEAR],
    )),
    "Renovation Opportunity": ("r3", _explained(
        "Renovation",
        ["CASE WHEN building_year <= 1940 THEN concat('old construction year ', building_year) WHEN building_year <= 1970 THEN concat('older construction year ', building_year) END",
         "CASE WHEN label IN ('g', 'f', 'e') THEN concat('poor energy label ', upper(label)) WHEN label = 'd' THEN 'moderate energy label D' END",
         f"CASE WHEN delta <= -15 THEN concat('price per m² ', {_whole('abs(delta)')}, '% below benchmark') END",
         "CASE WHEN contains(txt, 'kluswoning') THEN 'renovation-related wording (kluswoning, te renoveren)' END"],
        [_NO_YEAR, _NO_LABEL, _NO_PRICE],
    )),
    "Rental Opportunity": ("r4", _explained(
        "Rental",
        ["CASE WHEN bedrooms >= 3 THEN concat(bedrooms, ' bedrooms') END", "CASE WHEN delta <= -10 THEN 'attractive price per m²' END"],
        [("bedrooms IS NULL", "bedrooms"), _NO_PRICE],
    )),
    "Flip Opportunity": ("r5a + CASE WHEN works >= 20 THEN works ELSE 0 END", _explained(
        "Flip",
        ["CASE WHEN delta <= -15 THEN 'below-average price per m²' WHEN delta <= -8 THEN 'slightly below-average price per m²' END",
         "CASE WHEN contains(txt, 'kluswoning') THEN 'renovation cues in the listing text' END"],
        [_NO_PRICE, _NO_YEAR, _NO_LABEL],
    )),
}
EXPLAINED_SQL = " UNION ALL ".join(
    f"SELECT listing_id, '{name}' AS opportunity_type, {texts} FROM r WHERE {score} >= 35" for name, (score, texts) in EXPLAINED.items()
)


@query("opportunity_missing_data", with_views("listings", f"WITH {_plain()}, {SIGNALS_SQL}, {RULES_SQL} {EXPLAINED_SQL}"))
def opportunity_missing_data(spark, sf_dir):
    """What speaks for each finding of all six kinds, and which data would tell more."""
    found = opportunity.finding_table(_detected(spark, sf_dir), "listing_id")
    return found.select("listing_id", "opportunity_type", "explanation", F.array_join("missing_data", "|").alias("missing_data"))


@query(
    "opportunity_rollup",
    with_views("listings", f"WITH {_plain()}, {SIGNALS_SQL}, {RULES_SQL} SELECT listing_id, cast(least(100, top + 5 * (n - 1)) as int) AS opportunity_score FROM rolled"),
)
def opportunity_rollup(spark, sf_dir):
    return opportunity.rollup(opportunity.finding_table(_detected(spark, sf_dir), "listing_id"), "listing_id")


@query(
    "opportunity_summary",
    with_views(
        "listings",
        f"""WITH {_plain()}, {SIGNALS_SQL}, {RULES_SQL} SELECT o.listing_id, CASE WHEN n IS NULL THEN 0 ELSE cast(least(100, top + 5 * (n - 1)) as int) END AS opportunity_score, concat('Investment score ', cast(o.overall as varchar), '/100. ',
        CASE WHEN n IS NULL THEN 'No clear opportunity pattern was detected with the current data.' ELSE concat('Top signal: ', best, ' (', cast(top as varchar), '/100). Detected: ', names, '.') END) AS summary
        FROM o LEFT JOIN rolled ON rolled.listing_id = o.listing_id""",
    ),
)
def opportunity_summary(spark, sf_dir):
    return _detected(spark, sf_dir).select("listing_id", "opportunity_score", "summary")


@query(
    "end_to_end_rows",
    with_views(
        "listings",
        f"""WITH {_measures(WHOLE)}, {FACTORS_SQL}, {_scores([f'{w}e0' for w in WEIGHTS])}, {SIGNALS_SQL}, {RULES_SQL}
        SELECT o.listing_id, o.overall AS overall_score, CASE WHEN n IS NULL THEN 0 ELSE cast(least(100, top + 5 * (n - 1)) as int) END AS opportunity_score,
          CASE WHEN CASE WHEN n IS NULL THEN 0 ELSE least(100, top + 5 * (n - 1)) END >= 80 THEN 'high' WHEN CASE WHEN n IS NULL THEN 0 ELSE least(100, top + 5 * (n - 1)) END >= 60 THEN 'medium' ELSE 'low' END AS priority
        FROM o LEFT JOIN rolled ON rolled.listing_id = o.listing_id ORDER BY opportunity_score DESC, o.listing_id LIMIT 10""",
    ),
)
def end_to_end_rows(spark, sf_dir):
    listings = view(spark, sf_dir, "listings")
    best = opportunity.end_to_end(listings, listings, YEAR, "listing_id", 10)
    return best.select("listing_id", "overall_score", "opportunity_score", "priority")
