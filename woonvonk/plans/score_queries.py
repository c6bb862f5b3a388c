"""Queries over peer groups and rule scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from woonvonk.functions import bands, finance
from woonvonk.operators import benchmarks, scoring
from woonvonk.plans.registry import query
from woonvonk.plans.views import mean, r2, read, view, with_views

# Listings with price per m², city group, benchmarks and the quick investment score.
BASE_SQL = f"""
base AS (
  SELECT *, {r2('asking_price / nullif(surface_m2, 0)')} AS ppm2, lower(trim(coalesce(nullif(trim(city), ''), 'Onbekend'))) AS city_key
  FROM listings),
bench AS (SELECT city_key, {mean('ppm2')} AS avg_ppm2, median(asking_price) AS median_price, count(*) AS listing_count,
  count(asking_price) AS priced_count FROM base GROUP BY city_key)"""

K2_SQL = """(CASE WHEN ppm2 < avg_ppm2 THEN 25 ELSE 0 END + CASE WHEN surface_m2 > 100 THEN 20 ELSE 0 END
  + CASE WHEN upper(trim(energy_label)) IN ('A', 'A+', 'A++', 'A+++', 'A++++', 'B') THEN 15 ELSE 0 END
  + CASE WHEN construction_year > 1995 THEN 15 ELSE 0 END + CASE WHEN asking_price < median_price THEN 15 ELSE 0 END
  + CASE WHEN plot_size_m2 > 150 THEN 10 ELSE 0 END)"""

SCORED_SQL = (
    BASE_SQL
    + f""",
ranked AS (SELECT city_key AS ck, listing_id AS lid, 100e0 - cume_dist() OVER (PARTITION BY city_key ORDER BY ppm2) * 100e0 AS pct FROM base WHERE ppm2 IS NOT NULL),
joined AS (
  SELECT b.*, n.avg_ppm2, n.median_price, r.pct, upper(trim(coalesce(energy_label, ''))) AS label,
    (neighborhood_m2_price_average - ppm2) / neighborhood_m2_price_average AS discount,
    {r2('(ppm2 - avg_ppm2) / avg_ppm2 * 100e0')} AS diff, coalesce(price_reduction_count, 0) AS cuts
  FROM base b JOIN bench n ON n.city_key = b.city_key LEFT JOIN ranked r ON r.lid = b.listing_id),
potentials AS (
  SELECT *, {K2_SQL} AS inv,
    least(100, 20 + CASE WHEN surface_m2 >= 140 THEN 30 WHEN surface_m2 >= 110 THEN 20 WHEN surface_m2 >= 90 THEN 10 ELSE 0 END
      + CASE WHEN bedrooms >= 4 THEN 20 WHEN bedrooms >= 3 THEN 10 ELSE 0 END + CASE WHEN plot_size_m2 > 180 THEN 10 ELSE 0 END
      + CASE WHEN label IN ('A', 'A+', 'A++', 'A+++', 'A++++', 'B') THEN 5 ELSE 0 END + CASE WHEN days_on_market > 60 THEN 10 ELSE 0 END
      + CASE WHEN diff <= -10 THEN 15 WHEN diff < 0 THEN 8 ELSE 0 END) AS split,
    least(100, 15 + CASE WHEN plot_size_m2 / surface_m2 >= 2 THEN 35 WHEN plot_size_m2 / surface_m2 >= 1.5e0 THEN 25 WHEN plot_size_m2 / surface_m2 >= 1.2e0 THEN 15 ELSE 0 END
      + CASE WHEN construction_year < 1980 THEN 15 WHEN construction_year < 2000 THEN 8 ELSE 0 END
      + CASE WHEN plot_size_m2 > 200 THEN 20 WHEN plot_size_m2 > 150 THEN 12 ELSE 0 END + CASE WHEN diff < 0 THEN 10 ELSE 0 END) AS vertical,
    least(100, 20 + CASE WHEN diff <= -15 THEN 25 WHEN diff < 0 THEN 15 ELSE 0 END
      + CASE WHEN surface_m2 BETWEEN 50 AND 120 THEN 15 WHEN surface_m2 <= 150 THEN 8 ELSE 0 END
      + CASE WHEN bedrooms >= 2 THEN 15 WHEN bedrooms = 1 THEN 8 ELSE 0 END
      + CASE WHEN label IN ('A', 'A+', 'A++', 'A+++', 'A++++', 'B', 'C') THEN 10 ELSE 0 END + CASE WHEN days_on_market > 45 THEN 10 ELSE 0 END) AS rental,
    least(100, 10 + CASE WHEN construction_year < 1980 THEN 30 WHEN construction_year < 1995 THEN 20 ELSE 0 END
      + CASE WHEN label IN ('D', 'E', 'F', 'G') THEN 25 WHEN label = 'C' THEN 10 ELSE 0 END + least(10, cuts * 5)
      + CASE WHEN diff <= -8 THEN 15 ELSE 0 END + CASE WHEN days_on_market > 60 THEN 10 ELSE 0 END) AS renovation,
    CASE WHEN discount IS NOT NULL THEN greatest(0, least(100, cast(round_even(discount * 100e0, 0) as int))) END AS market_score,
    CASE label WHEN 'A++++' THEN 100e0 WHEN 'A+++' THEN 98e0 WHEN 'A++' THEN 96e0 WHEN 'A+' THEN 94e0 WHEN 'A' THEN 92e0 WHEN 'B' THEN 82e0
      WHEN 'C' THEN 70e0 WHEN 'D' THEN 55e0 WHEN 'E' THEN 40e0 WHEN 'F' THEN 25e0 WHEN 'G' THEN 10e0 ELSE CASE WHEN label LIKE 'A%' THEN 92e0 ELSE 50e0 END END AS label_points
  FROM joined),
parts AS (
  SELECT *, coalesce(market_score, 0) * 1e0 AS c1, coalesce(least(100e0, greatest(0e0, days_on_market / 180e0 * 100e0)), 0) AS c2,
    least(100e0, greatest(0e0, cuts / 4e0 * 100e0)) AS c3, coalesce(least(100e0, greatest(0e0, (surface_m2 - 60e0) / 120e0 * 100e0)), 0) AS c4,
    coalesce(least(100e0, greatest(0e0, permit_history_count / 6e0 * 100e0)), 0) AS c8
  FROM potentials),
opp AS (
  SELECT *, greatest(0, least(100, cast(round_even(c1 * 0.20e0 + c2 * 0.10e0 + c3 * 0.10e0 + c4 * 0.10e0 + split * 0.15e0 + vertical * 0.10e0
      + label_points * 0.10e0 + c8 * 0.05e0 + inv * 0.10e0, 0) as int))) AS opportunity FROM parts),
overall AS (
  SELECT *, greatest(0, least(100, cast(round_even(inv * 0.35e0 + opportunity * 0.25e0 + split * 0.15e0 + rental * 0.15e0 + renovation * 0.10e0, 0) as int))) AS overall_score FROM opp)"""
)

STARS_SQL = """CASE WHEN overall_score >= 85 THEN '★★★★★ Exceptional' WHEN overall_score >= 70 THEN '★★★★ Strong Buy'
  WHEN overall_score >= 55 THEN '★★★ Consider' WHEN overall_score >= 40 THEN '★★ Weak' ELSE '★ Avoid' END"""


def scored(spark, sf_dir):
    return scoring.score_deal_rows(view(spark, sf_dir, "listings"))


@query(
    "score_deal_rows",
    with_views(
        "listings",
        f"""WITH {SCORED_SQL}
        SELECT listing_id, city_key, ppm2 AS price_per_m2, {r2('avg_ppm2')} AS city_avg_price_per_m2, diff AS difference_vs_city_avg_pct,
          {r2('discount * 100e0')} AS discount_percentage, market_score AS market_discount_score, coalesce(discount >= 0.25e0, false) AS is_market_discount_highlight,
          round(pct, 6) AS price_per_m2_percentile, inv AS investment_score, split AS split_potential, vertical AS vertical_extension_potential,
          rental AS rental_potential, renovation AS renovation_potential, opportunity AS opportunity_score,
          overall_score AS overall_investment_score, {STARS_SQL} AS investment_recommendation FROM overall""",
    ),
)
def score_deal_rows(spark, sf_dir):
    return scored(spark, sf_dir).select(
        "listing_id",
        "city_key",
        "price_per_m2",
        "city_avg_price_per_m2",
        "difference_vs_city_avg_pct",
        "discount_percentage",
        "market_discount_score",
        "is_market_discount_highlight",
        F.round("price_per_m2_percentile", 6).alias("price_per_m2_percentile"),
        "investment_score",
        "split_potential",
        "vertical_extension_potential",
        "rental_potential",
        "renovation_potential",
        "opportunity_score",
        "overall_investment_score",
        "investment_recommendation",
    )


@query(
    "top_deals",
    with_views(
        "listings",
        f"""WITH {SCORED_SQL}
        SELECT listing_id, city_key, opportunity AS opportunity_score, overall_score AS overall_investment_score, {STARS_SQL} AS investment_recommendation
        FROM overall ORDER BY opportunity DESC, listing_id LIMIT 20""",
    ),
)
def top_deals(spark, sf_dir):
    return (
        scored(spark, sf_dir)
        .select("listing_id", "city_key", "opportunity_score", "overall_investment_score", "investment_recommendation")
        .orderBy(F.col("opportunity_score").desc(), "listing_id")
        .limit(20)
    )


@query(
    "potential_scores",
    with_views(
        "listings",
        f"""WITH {SCORED_SQL} SELECT listing_id, split AS split_potential, vertical AS vertical_extension_potential, rental AS rental_potential,
        renovation AS renovation_potential FROM overall""",
    ),
)
def potential_scores(spark, sf_dir):
    return scored(spark, sf_dir).select(
        "listing_id", "split_potential", "vertical_extension_potential", "rental_potential", "renovation_potential"
    )


@query(
    "opportunity_weighted",
    with_views(
        "listings",
        f"""WITH {SCORED_SQL} SELECT listing_id, c1 AS market_discount, {r2('c2')} AS days_on_market, c3 AS price_reductions, {r2('c4')} AS building_size,
        cast(split as double) AS split_potential, cast(vertical as double) AS top_up_potential, label_points AS energy_label, {r2('c8')} AS permit_history, cast(inv as double) AS investment_score,
        opportunity AS opportunity_score FROM overall""",
    ),
)
def opportunity_weighted(spark, sf_dir):
    parts = scoring.OPPORTUNITY_WEIGHTS
    return scored(spark, sf_dir).select(
        "listing_id",
        *[F.round(f"opportunity_components.{n}", 2).alias(n) for n in parts],
        "opportunity_score",
    )


@query(
    "overall_score",
    with_views(
        "listings",
        f"WITH {SCORED_SQL} SELECT listing_id, overall_score AS overall_investment_score, {STARS_SQL} AS investment_recommendation FROM overall",
    ),
)
def overall_score(spark, sf_dir):
    return scored(spark, sf_dir).select("listing_id", "overall_investment_score", "investment_recommendation")


@query(
    "city_benchmarks",
    with_views(
        "listings",
        f"""WITH {BASE_SQL} SELECT city_key, {r2('avg_ppm2')} AS avg_price_per_m2, {r2('median_price')} AS median_asking_price, listing_count, priced_count FROM bench""",
    ),
)
def city_benchmarks(spark, sf_dir):
    base = benchmarks.with_ppm2(view(spark, sf_dir, "listings")).withColumn("city_key", benchmarks.city_key())
    return benchmarks.city_benchmarks(base).select(
        "city_key",
        F.round("avg_price_per_m2", 2).alias("avg_price_per_m2"),
        F.round("median_asking_price", 2).alias("median_asking_price"),
        "listing_count",
        "priced_count",
    )


@query(
    "city_benchmark_join",
    with_views(
        "listings",
        f"""WITH {BASE_SQL} SELECT b.listing_id, {r2('n.avg_ppm2')} AS avg_price_per_m2, {r2('n.median_price')} AS median_asking_price FROM base b JOIN bench n ON n.city_key = b.city_key""",
    ),
)
def city_benchmark_join(spark, sf_dir):
    base = benchmarks.with_ppm2(view(spark, sf_dir, "listings")).withColumn("city_key", benchmarks.city_key())
    return benchmarks.join_city_benchmarks(base).select(
        "listing_id",
        F.round("avg_price_per_m2", 2).alias("avg_price_per_m2"),
        F.round("median_asking_price", 2).alias("median_asking_price"),
    )


@query(
    "portfolio_benchmarks",
    with_views(
        "listings",
        f"""WITH {BASE_SQL} SELECT {r2(mean('ppm2'))} AS average_price_per_m2, {r2('median(ppm2)')} AS median_price_per_m2, count(*) AS sample_size FROM base""",
    ),
)
def portfolio_benchmarks(spark, sf_dir):
    return benchmarks.portfolio_benchmarks(benchmarks.with_ppm2(view(spark, sf_dir, "listings")))


@query(
    "leave_one_out_benchmark",
    with_views(
        "listings",
        f"""WITH {BASE_SQL}, t AS (SELECT cast(sum(cast(ppm2 as decimal(18, 2))) as double) AS total, count(ppm2) AS filled, count(*) AS n FROM base)
        SELECT listing_id, {r2('(total - coalesce(ppm2, 0)) / nullif(filled - CASE WHEN ppm2 IS NULL THEN 0 ELSE 1 END, 0)')} AS peer_average, n - 1 AS peer_average_size
        FROM base, t""",
    ),
)
def leave_one_out_benchmark(spark, sf_dir):
    base = benchmarks.with_ppm2(view(spark, sf_dir, "listings"))
    return benchmarks.leave_one_out(base).select("listing_id", "peer_average", "peer_average_size")


@query(
    "price_percentile_in_city",
    with_views(
        "listings",
        f"""WITH {BASE_SQL}, ranked AS (SELECT listing_id AS lid, 100e0 - cume_dist() OVER (PARTITION BY city_key ORDER BY ppm2) * 100e0 AS pct FROM base WHERE ppm2 IS NOT NULL)
        SELECT listing_id, city_key, ppm2 AS price_per_m2, round(pct, 6) AS percentile FROM base LEFT JOIN ranked ON lid = listing_id""",
    ),
)
def price_percentile_in_city(spark, sf_dir):
    base = benchmarks.with_ppm2(view(spark, sf_dir, "listings")).withColumn("city_key", benchmarks.city_key())
    ranked = benchmarks.with_percentile(base, "city_key", "price_per_m2", "percentile")
    return ranked.select("listing_id", "city_key", "price_per_m2", F.round("percentile", 6).alias("percentile"))


@query(
    "top_n_per_city",
    with_views(
        "listings",
        f"""WITH {SCORED_SQL} SELECT listing_id, city_key, opportunity AS opportunity_score,
        cast(row_number() OVER (PARTITION BY city_key ORDER BY opportunity DESC, listing_id) as int) AS rank_no FROM overall
        QUALIFY row_number() OVER (PARTITION BY city_key ORDER BY opportunity DESC, listing_id) <= 20""",
    ),
)
def top_n_per_city(spark, sf_dir):
    return benchmarks.top_per_city(scored(spark, sf_dir), "opportunity_score", "listing_id").select(
        "listing_id", "city_key", "opportunity_score", "rank_no"
    )


@query(
    "investment_score_quick",
    with_views(
        "listings",
        f"WITH {BASE_SQL} SELECT listing_id, {K2_SQL} AS investment_score FROM base b JOIN bench n ON n.city_key = b.city_key",
    ),
)
def investment_score_quick(spark, sf_dir):
    base = benchmarks.with_ppm2(view(spark, sf_dir, "listings")).withColumn("city_key", benchmarks.city_key())
    return benchmarks.join_city_benchmarks(base).select(
        "listing_id", scoring.quick_investment_score().alias("investment_score")
    )


PIPELINE_SQL = f"""
base AS (SELECT *, {r2('nullif(asking_price, 0) / nullif(surface_m2, 0)')} AS ppm2, lower(trim(city)) AS city_key FROM listings),
bench AS (SELECT city_key, {r2(mean('ppm2'))} AS avg_ppm2, {r2('median(asking_price)')} AS median_price FROM base WHERE city_key IS NOT NULL GROUP BY city_key
  UNION ALL SELECT NULL, {r2(mean('ppm2'))}, {r2('median(asking_price)')} FROM base),
joined AS (SELECT b.*, n.avg_ppm2, n.median_price FROM base b JOIN bench n ON n.city_key IS NOT DISTINCT FROM b.city_key),
inv AS (SELECT *, {K2_SQL} AS investment_score FROM joined),
opp AS (SELECT *, greatest(0, least(100, cast(round_even(investment_score * 0.55e0
    + coalesce(least(20e0, greatest(0e0, (avg_ppm2 - ppm2) / avg_ppm2 * 100e0 * 0.4e0)), 0)
    + (CASE WHEN surface_m2 <> 0 THEN 1 ELSE 0 END + CASE WHEN construction_year <> 0 THEN 1 ELSE 0 END + CASE WHEN plot_size_m2 <> 0 THEN 1 ELSE 0 END
      + CASE WHEN bedrooms <> 0 THEN 1 ELSE 0 END + CASE WHEN ppm2 <> 0 THEN 1 ELSE 0 END + CASE WHEN energy_label IS NOT NULL THEN 1 ELSE 0 END) / 6e0 * 20e0
    + (CASE WHEN price_reduction_count > 0 THEN 8 ELSE 0 END + CASE WHEN construction_year < 1990 THEN 4 ELSE 0 END
      + CASE WHEN upper(energy_label) IN ('D', 'E', 'F', 'G') THEN 3 ELSE 0 END), 0) as int))) AS opportunity_score FROM inv)"""

RANK_SQL = """
rules AS (SELECT *,
    CASE WHEN asking_price IS NULL THEN 0 WHEN asking_price <= 350000 THEN 20 WHEN asking_price <= 600000 THEN 12 ELSE 4 END AS p1,
    CASE WHEN ppm2 IS NULL THEN 0 WHEN ppm2 <= 3500 THEN 18 WHEN ppm2 <= 5000 THEN 10 ELSE 3 END AS p2,
    CASE WHEN days_on_market >= 120 THEN 12 WHEN days_on_market >= 45 THEN 7 ELSE 0 END AS p3,
    CASE WHEN price_reduction_count > 0 THEN least(12, price_reduction_count * 4) ELSE 0 END AS p4,
    CASE WHEN property_type IS NULL THEN 0 WHEN contains(lower(property_type), 'appartement') OR contains(lower(property_type), 'woning') THEN 6 ELSE 3 END AS p6,
    CASE WHEN city IS NULL THEN 0 ELSE 5 END AS p7,
    cast(floor((3 + CASE WHEN city IS NULL THEN 0 ELSE 1 END + CASE WHEN asking_price IS NULL THEN 0 ELSE 1 END
      + CASE WHEN surface_m2 IS NULL THEN 0 ELSE 1 END + CASE WHEN description = '' THEN 0 ELSE 1 END) / 7e0 * 10e0) as int) AS p8,
    concat_ws(',', CASE WHEN asking_price IS NULL THEN NULL WHEN asking_price <= 350000 THEN 'lower_asking_price' WHEN asking_price <= 600000 THEN 'mid_asking_price' ELSE 'higher_asking_price' END,
      CASE WHEN ppm2 IS NULL THEN NULL WHEN ppm2 <= 3500 THEN 'competitive_price_per_m2' WHEN ppm2 <= 5000 THEN 'reasonable_price_per_m2' ELSE 'high_price_per_m2' END,
      CASE WHEN days_on_market >= 120 THEN 'long_time_on_market' WHEN days_on_market >= 45 THEN 'moderate_time_on_market' END,
      CASE WHEN price_reduction_count > 0 THEN 'price_reduction_signal' END, money_reason,
      CASE WHEN contains(lower(property_type), 'appartement') OR contains(lower(property_type), 'woning') THEN 'known_property_type' ELSE 'other_property_type' END,
      CASE WHEN city IS NOT NULL THEN 'city_present' END, 'data_completeness') AS reason_codes,
    concat_ws(',', CASE WHEN asking_price IS NULL THEN 'asking_price_missing' END, CASE WHEN city IS NULL THEN 'city_missing' END,
      CASE WHEN days_on_market IS NULL THEN 'days_on_market_missing' END, CASE WHEN money_reason IS NULL THEN 'investment_score_missing' END,
      CASE WHEN ppm2 IS NULL THEN 'price_per_m2_missing' END, CASE WHEN price_reduction_count = 0 THEN 'price_reduction_data_missing' END) AS missing_data
  FROM money)"""


@query(
    "rank_listing",
    with_views(
        "listings",
        f"""WITH money AS (
          SELECT *, CASE WHEN score IS NOT NULL THEN cast(round_even(score / 100e0 * 25e0, 0) as int) WHEN pct >= 10 THEN 25 WHEN pct >= 8 THEN 21 WHEN pct >= 6 THEN 16 WHEN pct >= 4.5e0 THEN 10
              WHEN pct > 0 THEN 5 ELSE 0 END AS p5,
            CASE WHEN score IS NOT NULL THEN 'investment_score_used' WHEN pct >= 10 THEN 'yield_signal_strong' WHEN pct >= 8 THEN 'yield_signal_good' WHEN pct >= 6 THEN 'yield_signal_moderate'
              WHEN pct >= 4.5e0 THEN 'yield_signal_weak' WHEN pct > 0 THEN 'yield_signal_low' WHEN pct IS NOT NULL THEN 'yield_signal_none' END AS money_reason
          FROM (SELECT *, {r2('asking_price / nullif(surface_m2, 0)')} AS ppm2, CASE WHEN listing_id % 3 = 0 THEN cast(listing_id % 140 as int) - 20 END AS raw_score,
              CASE WHEN listing_id % 3 = 0 THEN greatest(0, least(100, cast(listing_id % 140 as int) - 20)) END AS score,
              {r2('annual_rent / asking_price * 100')} AS pct FROM listings)), {RANK_SQL}
        SELECT listing_id, greatest(0, least(100, p1 + p2 + p3 + p4 + p5 + p6 + p7 + p8)) AS candidate_score,
          CASE WHEN p1 + p2 + p3 + p4 + p5 + p6 + p7 + p8 >= 85 THEN 'urgent' WHEN p1 + p2 + p3 + p4 + p5 + p6 + p7 + p8 >= 70 THEN 'high'
            WHEN p1 + p2 + p3 + p4 + p5 + p6 + p7 + p8 >= 45 THEN 'medium' ELSE 'low' END AS priority, reason_codes, missing_data FROM rules""",
    ),
)
def rank_listing(spark, sf_dir):
    rows = benchmarks.with_ppm2(view(spark, sf_dir, "listings")).withColumns(
        {
            "investment_score": F.when(F.col("listing_id") % 3 == 0, (F.col("listing_id") % 140).cast("int") - 20),
            "yield_pct": finance.gross_yield("annual_rent", "asking_price"),
        }
    )
    return _ranked(scoring.rank_listing(rows), "candidate_score")


def _ranked(df, *scores):
    return df.select(
        "listing_id",
        *scores,
        "priority",
        F.array_join("reason_codes", ",").alias("reason_codes"),
        F.array_join("missing_data", ",").alias("missing_data"),
    )


@query(
    "rank_pipeline",
    with_views(
        "listings",
        f"""WITH {PIPELINE_SQL}, money AS (SELECT *, 'investment_score_used' AS money_reason FROM opp), {RANK_SQL}
        SELECT listing_id, opportunity_score AS candidate_score, investment_score, opportunity_score,
          CASE WHEN opportunity_score >= 90 THEN 'urgent' WHEN opportunity_score >= 75 THEN 'high' WHEN opportunity_score >= 55 THEN 'medium' ELSE 'low' END AS priority,
          reason_codes, missing_data FROM rules""",
    ),
)
def rank_pipeline(spark, sf_dir):
    ranked = scoring.rank_pipeline(view(spark, sf_dir, "listings"))
    return _ranked(ranked, "candidate_score", "investment_score", "opportunity_score")


@query(
    "opportunity_score_quick",
    with_views("listings", f"WITH {PIPELINE_SQL} SELECT listing_id, investment_score, opportunity_score FROM opp"),
)
def opportunity_score_quick(spark, sf_dir):
    return scoring.rank_pipeline(view(spark, sf_dir, "listings")).select("listing_id", "investment_score", "opportunity_score")


@query(
    "market_discount",
    with_views(
        "listings",
        f"""WITH d AS (SELECT listing_id, {r2('asking_price / nullif(surface_m2, 0)')} AS ppm2, neighborhood_m2_price_average AS n FROM listings),
        r AS (SELECT *, (n - ppm2) / n AS ratio FROM d)
        SELECT listing_id, {r2('ratio * 100e0')} AS discount_percentage,
          CASE WHEN ratio IS NOT NULL THEN greatest(0, least(100, cast(round_even(ratio * 100e0, 0) as int))) END AS market_discount_score,
          coalesce(ratio >= 0.25e0, false) AS is_market_discount_highlight FROM r""",
    ),
)
def market_discount(spark, sf_dir):
    rows = scoring.with_market_discount(benchmarks.with_ppm2(view(spark, sf_dir, "listings")))
    return rows.select("listing_id", "discount_percentage", "market_discount_score", "is_market_discount_highlight")


@query(
    "market_highlight",
    with_views(
        "listings",
        f"""SELECT listing_id FROM listings WHERE (neighborhood_m2_price_average - {r2('asking_price / nullif(surface_m2, 0)')}) / neighborhood_m2_price_average >= 0.25e0""",
    ),
)
def market_highlight(spark, sf_dir):
    rows = scoring.with_market_discount(benchmarks.with_ppm2(view(spark, sf_dir, "listings")))
    return rows.where("is_market_discount_highlight").select("listing_id")


VALUATION_SQL = f"""
v AS (SELECT *, CASE WHEN asking_price > 0 THEN asking_price END AS p, {r2('annual_rent / nullif(asking_price, 0) * 100')} AS gy FROM listings),
w AS (SELECT *, p * 1.10e0 AS market_value, p * 0.92e0 AS ceiling FROM v),
x AS (SELECT *, (market_value - p) / market_value * 100e0 AS discount_pct, (p - ceiling) / p * 100e0 AS difference_pct FROM w),
y AS (SELECT *, CASE WHEN difference_pct IS NULL THEN 'Onbekend' WHEN difference_pct <= 0 THEN 'Green' WHEN difference_pct <= 5 THEN 'Orange' ELSE 'Red' END AS advice FROM x)"""


@query(
    "placeholder_valuation",
    with_views(
        "listings",
        f"""WITH {VALUATION_SQL} SELECT listing_id, round(market_value, 4) AS market_value, round(discount_pct, 6) AS discount_pct, round(ceiling, 4) AS max_purchase_price,
        round(p - ceiling, 4) AS difference_eur, round(difference_pct, 6) AS difference_pct, advice FROM y""",
    ),
)
def placeholder_valuation(spark, sf_dir):
    rows = view(spark, sf_dir, "listings").select("listing_id", finance.placeholder_valuation("asking_price").alias("v"))
    return rows.select(
        "listing_id",
        *[F.round(f"v.{c}", 4).alias(c) for c in ("market_value", "max_purchase_price", "difference_eur")],
        *[F.round(f"v.{c}", 6).alias(c) for c in ("discount_pct", "difference_pct")],
        "v.advice",
    )


CATEGORY_SQL = (
    VALUATION_SQL
    + """,
cat AS (SELECT *, 14 + CASE WHEN lower(trim(coalesce(city, ''))) IN ('', 'onbekend') THEN 0 ELSE 3 END + CASE WHEN surface_m2 >= 60 THEN 2 ELSE 0 END AS location_score,
    CASE WHEN discount_pct IS NULL THEN 8 WHEN discount_pct >= 12 THEN 19 WHEN discount_pct >= 9 THEN 17 WHEN discount_pct >= 6 THEN 15 WHEN discount_pct >= 3 THEN 12 WHEN discount_pct >= 0 THEN 10 ELSE 7 END AS valuation_score,
    CASE WHEN gy IS NULL OR gy <= 0 THEN 0 WHEN gy >= 10 THEN 20 WHEN gy >= 8 THEN 17 WHEN gy >= 6 THEN 14 WHEN gy >= 4.5e0 THEN 10 ELSE 5 END AS rental_score,
    CASE WHEN surface_m2 IS NULL THEN 8 WHEN surface_m2 >= 120 THEN 16 WHEN surface_m2 >= 90 THEN 14 WHEN surface_m2 >= 70 THEN 12 ELSE 9 END AS transformation_score,
    CASE WHEN difference_pct IS NULL THEN 10 WHEN difference_pct <= 0 THEN 18 WHEN difference_pct <= 2 THEN 15 WHEN difference_pct <= 5 THEN 12 WHEN difference_pct <= 8 THEN 9 ELSE 6 END AS momentum_score,
    CASE advice WHEN 'Green' THEN 17 WHEN 'Orange' THEN 12 WHEN 'Red' THEN 7 ELSE 11 END AS risk_score FROM y),
tot AS (SELECT *, cast(round_even((location_score + valuation_score + rental_score + transformation_score + momentum_score + risk_score) / 120e0 * 100e0, 0) as int) AS category_total FROM cat)"""
)


def _valued(spark, sf_dir):
    rows = view(spark, sf_dir, "listings").withColumns(
        {"_v": finance.placeholder_valuation("asking_price"), "gross_yield": finance.gross_yield("annual_rent", "asking_price")}
    )
    return rows.select("*", "_v.discount_pct", "_v.difference_pct", "_v.advice").drop("_v")


@query(
    "six_category_score",
    with_views(
        "listings",
        f"""WITH {CATEGORY_SQL} SELECT listing_id, location_score, valuation_score, rental_score, transformation_score, momentum_score, risk_score, category_total,
        CASE WHEN category_total >= 85 THEN 'A+' WHEN category_total >= 75 THEN 'A' WHEN category_total >= 65 THEN 'B' WHEN category_total >= 50 THEN 'C' ELSE 'D' END AS category_rating FROM tot""",
    ),
)
def six_category_score(spark, sf_dir):
    rows = scoring.six_category_score(_valued(spark, sf_dir))
    return rows.select("listing_id", *[f"{n}_score" for n in scoring.category_scores()], "category_total", "category_rating")


@query(
    "score_bands",
    with_views(
        "candidates",
        """SELECT candidate_id, CASE WHEN hidden_value_score IS NULL THEN 'Onbekend' WHEN hidden_value_score >= 85 THEN 'A+' WHEN hidden_value_score >= 70 THEN 'A' WHEN hidden_value_score >= 55 THEN 'B' WHEN hidden_value_score >= 40 THEN 'C' ELSE 'D' END AS deal_rating,
          CASE WHEN hidden_value_score >= 70 THEN 'Sterke deal' WHEN hidden_value_score < 55 THEN 'Zwakke deal' ELSE 'Nader onderzoeken' END AS deal_summary,
          CASE WHEN investment_score >= 90 THEN 'A+' WHEN investment_score >= 80 THEN 'A' WHEN investment_score >= 70 THEN 'B' WHEN investment_score >= 60 THEN 'C' WHEN investment_score >= 50 THEN 'D' ELSE 'F' END AS overall_rating,
          CASE WHEN investment_score >= 85 THEN 'urgent' WHEN investment_score >= 70 THEN 'high' WHEN investment_score >= 45 THEN 'medium' ELSE 'low' END AS rank_priority,
          CASE WHEN investment_score >= 90 THEN 'urgent' WHEN investment_score >= 75 THEN 'high' WHEN investment_score >= 55 THEN 'medium' ELSE 'low' END AS pipeline_priority,
          CASE WHEN investment_score >= 80 THEN 'high' WHEN investment_score >= 60 THEN 'medium' ELSE 'low' END AS batch_priority FROM candidates""",
    ),
)
def score_bands(spark, sf_dir):
    rating = bands.deal_rating("hidden_value_score")
    return view(spark, sf_dir, "candidates").select(
        "candidate_id",
        rating.alias("deal_rating"),
        bands.deal_summary(rating).alias("deal_summary"),
        bands.overall_rating("investment_score").alias("overall_rating"),
        bands.priority("investment_score").alias("rank_priority"),
        bands.priority("investment_score", bands.PIPELINE_PRIORITY).alias("pipeline_priority"),
        bands.priority("investment_score", bands.BATCH_PRIORITY).alias("batch_priority"),
    )


@query(
    "score_card",
    with_views(
        "listings",
        f"""WITH {CATEGORY_SQL} SELECT listing_id, rental_score + 57 AS card_score,
        CASE WHEN asking_price_status = 'known' THEN cast(listing_id % 101 as int) ELSE greatest(0, cast(listing_id % 101 as int) - 5) END AS shown_score FROM tot""",
    ),
)
def score_card(spark, sf_dir):
    rows = _valued(spark, sf_dir)
    shown = scoring.display_score((F.col("listing_id") % 101).cast("int"), F.col("asking_price_status"))
    return rows.select(
        "listing_id", scoring.score_card(bands.return_score("gross_yield")).alias("card_score"), shown.alias("shown_score")
    )


def _pct_sql(e):
    return f"concat(replace(printf('%.1f', {r2(e, 1)}), '.', ','), '%')"


@query(
    "verdict_texts",
    with_views(
        "listings",
        f"""WITH {CATEGORY_SQL}, s AS (SELECT *, rental_score + 57 AS card, asking_price / nullif(surface_m2, 0) AS ppm2_raw FROM tot),
        r AS (SELECT *, CASE WHEN card >= 90 THEN 'A+' WHEN card >= 80 THEN 'A' WHEN card >= 70 THEN 'B' WHEN card >= 60 THEN 'C' WHEN card >= 50 THEN 'D' ELSE 'F' END AS rating FROM s)
        SELECT listing_id, CASE rating WHEN 'A+' THEN 'Excellent' WHEN 'A' THEN 'Excellent' WHEN 'B' THEN 'Interesting' WHEN 'C' THEN 'Average' WHEN 'D' THEN 'Weak' ELSE 'Avoid.' END AS summary_word,
          concat_ws(', ', concat('Investment score ', cast(card as varchar), '/100'), CASE WHEN gy IS NOT NULL THEN concat('gross yield ', {_pct_sql('gy')}) END,
            CASE WHEN advice = 'Green' THEN 'asking price ligt op of onder de placeholder aankoopgrens' END) AS strengths_text,
          coalesce(nullif(concat_ws(', ', CASE WHEN difference_pct > 0 THEN concat('vraagprijs ligt ', {_pct_sql('difference_pct')}, ' boven de placeholder aankoopgrens') END,
            CASE WHEN ppm2_raw IS NOT NULL THEN concat('prijsniveau is € ', replace(format('{{:,}}', cast(round_even(ppm2_raw, 0) as bigint)), ',', '.'), ' per m²') END,
            CASE WHEN discount_pct IS NOT NULL THEN concat('placeholder discount is -', {_pct_sql('discount_pct')}) END), ''),
            'Onvoldoende waardedata beschikbaar om duidelijke zwaktes te onderbouwen.') AS weaknesses_text,
          CASE advice WHEN 'Red' THEN 'Heronderhandel' WHEN 'Orange' THEN 'Controleer' WHEN 'Green' THEN 'Valideer' ELSE CASE WHEN gy IS NULL THEN 'Verzamel' ELSE 'Werk' END END AS next_word FROM r""",
    ),
)
def verdict_texts(spark, sf_dir):
    rows = _valued(spark, sf_dir).withColumns(
        {
            "card": scoring.score_card(bands.return_score("gross_yield")),
            "ppm2_text": bands.euro_per_m2("asking_price", "surface_m2"),
        }
    )
    rated = rows.withColumn("rating", bands.overall_rating("card"))
    texts = scoring.verdict_texts("card", "rating", "gross_yield", "advice", "difference_pct", "ppm2_text", "discount_pct")
    return rated.withColumns(texts).select(
        "listing_id",
        F.get(F.split("summary_text", " "), F.lit(0)).alias("summary_word"),
        "strengths_text",
        "weaknesses_text",
        F.get(F.split("next_step_text", " "), F.lit(0)).alias("next_word"),
    )


@query(
    "finance_metrics",
    with_views(
        "listings",
        f"""WITH f AS (SELECT *, asking_price_status IN ('on_request', 'unknown') AS unpriced FROM listings),
        g AS (SELECT *, CASE WHEN NOT unpriced AND asking_price > 0 THEN {r2('asking_price * (10.4e0 / 100e0)')} END AS acquisition_costs,
          CASE WHEN NOT unpriced AND asking_price > 0 THEN {r2('asking_price * (70e0 / 100e0)')} END AS financing_amount FROM f),
        h AS (SELECT *, CASE WHEN NOT unpriced AND asking_price > 0 THEN {r2('asking_price + coalesce(acquisition_costs, 0) + plot_renovation')} END AS total_investment,
          {r2('financing_amount * (4.2e0 / 100e0)')} AS annual_interest FROM (SELECT *, coalesce(plot_size_m2 * 10, 0) AS plot_renovation FROM g)),
        i AS (SELECT *, (annual_rent / (6e0 / 100e0) - plot_renovation) / (1e0 + 10.4e0 / 100e0) AS ceiling FROM h)
        SELECT listing_id, CASE WHEN NOT unpriced THEN {r2('asking_price / nullif(surface_m2, 0)')} END AS price_per_m2,
          CASE WHEN NOT unpriced THEN {r2('annual_rent / nullif(asking_price, 0) * 100')} END AS gross_yield, acquisition_costs, total_investment, financing_amount, annual_interest,
          {r2('annual_rent - annual_interest')} AS annual_cashflow, {r2('total_investment * (6e0 / 100e0)')} AS required_rent,
          CASE WHEN ceiling > 0 THEN {r2('ceiling')} END AS max_purchase_price FROM i""",
    ),
)
def finance_metrics(spark, sf_dir):
    status = "asking_price_status"
    rows = view(spark, sf_dir, "listings").withColumns(
        {
            "renovation": F.coalesce(F.col("plot_size_m2") * 10, F.lit(0.0)),
            "acquisition_costs": finance.acquisition_costs("asking_price", F.lit(10.4), status),
            "financing_amount": finance.financing_amount("asking_price", F.lit(70.0), status),
        }
    )
    built = rows.withColumns(
        {
            "price_per_m2": finance.price_per_m2("asking_price", "surface_m2", status),
            "gross_yield": finance.gross_yield("annual_rent", "asking_price", status),
            "total_investment": finance.total_investment("asking_price", "acquisition_costs", "renovation", status),
            "annual_interest": finance.annual_interest("financing_amount", F.lit(4.2)),
        }
    ).withColumns(
        {
            "annual_cashflow": finance.annual_cashflow("annual_rent", "annual_interest"),
            "required_rent": finance.required_rent("total_investment", F.lit(6.0)),
            "max_purchase_price": finance.max_purchase_price("annual_rent", F.lit(6.0), F.lit(10.4), F.col("renovation")),
        }
    )
    return built.select(
        "listing_id", "price_per_m2", "gross_yield", "acquisition_costs", "total_investment", "financing_amount",
        "annual_interest", "annual_cashflow", "required_rent", "max_purchase_price",
    )


def _finance_single(name, column):
    """One measure of the finance table as a query of its own, on the same rows."""
    from woonvonk.plans.registry import SQL

    @query(name, f"SELECT listing_id, {column} FROM ({SQL['finance_metrics']})")
    def job(spark, sf_dir):
        return finance_metrics(spark, sf_dir).select("listing_id", column)


for _name, _column in {
    "price_per_m2": "price_per_m2", "gross_yield": "gross_yield", "acquisition_costs": "acquisition_costs",
    "total_investment": "total_investment", "financing_amount": "financing_amount", "annual_interest": "annual_interest",
    "annual_cashflow": "annual_cashflow", "required_rent": "required_rent", "max_purchase_price": "max_purchase_price",
}.items():
    _finance_single(_name, _column)


@query(
    "price_reduction",
    with_views(
        "sales",
        f"""WITH p AS (SELECT sale_id, price AS o, price * (0.8e0 + cast(sale_id % 40 as double) / 100e0) AS c FROM sales)
        SELECT sale_id, CASE WHEN c > 0 AND c < o THEN {r2('o - c')} END AS amount, CASE WHEN c > 0 AND c < o THEN {r2('(o - c) / o * 100')} END AS percentage FROM p""",
    ),
)
def price_reduction(spark, sf_dir):
    current = F.col("price") * (0.8 + (F.col("sale_id") % 40).cast("double") / 100.0)
    rows = view(spark, sf_dir, "sales").withColumn("current_price", current)
    drop = finance.price_reduction("price", "current_price")
    return rows.select("sale_id", drop["amount"].alias("amount"), drop["percentage"].alias("percentage"))


@query(
    "price_change_since_sale",
    with_views(
        "listings",
        f"""SELECT listing_id, CASE WHEN asking_price > 0 AND latest_woz_value > 0 THEN {r2('asking_price - latest_woz_value')} END AS amount,
        CASE WHEN asking_price > 0 AND latest_woz_value > 0 THEN {r2('(asking_price - latest_woz_value) / latest_woz_value * 100')} END AS percentage FROM listings""",
    ),
)
def price_change_since_sale(spark, sf_dir):
    change = finance.change_since_sale("asking_price", "latest_woz_value")
    return view(spark, sf_dir, "listings").select(
        "listing_id", change["amount"].alias("amount"), change["percentage"].alias("percentage")
    )


@query(
    "discount_pct",
    with_views(
        "listings",
        f"""SELECT listing_id, {r2('(neighborhood_m2_price_average - asking_price / nullif(surface_m2, 0)) / neighborhood_m2_price_average * 100')} AS discount_pct FROM listings""",
    ),
)
def discount_pct(spark, sf_dir):
    ppm2 = finance.ratio("asking_price", "surface_m2")
    return view(spark, sf_dir, "listings").select(
        "listing_id", finance.discount_pct(ppm2, "neighborhood_m2_price_average").alias("discount_pct")
    )


@query(
    "woz_metrics",
    with_views(
        "listings",
        f"""SELECT listing_id, {r2('asking_price - latest_woz_value')} AS difference_eur, {r2('(asking_price - latest_woz_value) / latest_woz_value * 100e0')} AS difference_pct FROM listings""",
    ),
)
def woz_metrics(spark, sf_dir):
    return view(spark, sf_dir, "listings").select(
        "listing_id", finance.woz_difference("asking_price", "latest_woz_value").alias("w")
    ).select("listing_id", "w.*")


@query(
    "gross_yield_pick",
    with_views(
        "listings",
        """WITH y AS (SELECT listing_id, coalesce(CASE WHEN listing_id % 4 = 0 THEN (listing_id % 90) / 1000e0 END, CASE WHEN listing_id % 4 = 1 THEN (listing_id % 120) / 10e0 END,
            CASE WHEN listing_id % 4 = 2 THEN 1e0 END) AS v FROM listings)
        SELECT listing_id, round(CASE WHEN v > 0 AND v <= 1 THEN v * 100e0 ELSE v END, 6) AS yield_pct FROM y""",
    ),
)
def gross_yield_pick(spark, sf_dir):
    case = F.col("listing_id") % 4
    picked = finance.yield_pct(
        F.when(case == 0, (F.col("listing_id") % 90) / 1000.0),
        F.when(case == 1, (F.col("listing_id") % 120) / 10.0),
        F.when(case == 2, F.lit(1.0)),
    )
    return view(spark, sf_dir, "listings").select("listing_id", F.round(picked, 6).alias("yield_pct"))


@query(
    "reduction_from_original",
    with_views(
        "listings",
        f"""WITH o AS (SELECT listing_id, asking_price AS c, latest_woz_value * 1.3e0 AS o, price_reduction_count AS n, listing_id % 3 = 0 AS dated FROM listings)
        SELECT listing_id, CASE WHEN o > c THEN {r2('o - c')} END AS amount, CASE WHEN o > c THEN {r2('(o - c) / o * 100e0')} END AS percentage,
          CASE WHEN dated AND (n > 0 OR o IS NOT NULL) THEN 'high' WHEN dated OR n > 0 OR o IS NOT NULL THEN 'medium' ELSE 'unknown' END AS history_confidence FROM o""",
    ),
)
def reduction_from_original(spark, sf_dir):
    rows = view(spark, sf_dir, "listings").withColumns(
        {
            "original": F.col("latest_woz_value") * 1.3,
            "listed_since": F.when(F.col("listing_id") % 3 == 0, F.lit("2001-01-01").cast("date")),
        }
    )
    return finance_reduction(rows)


def finance_reduction(rows):
    from woonvonk.sources.pages import history_confidence

    drop = finance.price_reduction("original", "asking_price")
    return rows.select(
        "listing_id",
        drop["amount"].alias("amount"),
        drop["percentage"].alias("percentage"),
        history_confidence("listed_since", "price_reduction_count", "original").alias("history_confidence"),
    )


# --- comparables and summaries ------------------------------------------------------------------


def _comps(spark, sf_dir):
    subjects = view(spark, sf_dir, "listings").withColumnRenamed("listing_id", "subject_id")
    return benchmarks.comparables(view(spark, sf_dir, "comps"), subjects), subjects


COMPS_SQL = f"""
s AS (SELECT listing_id, asking_price AS subject_price, surface_m2 AS subject_area, {r2('asking_price / nullif(surface_m2, 0)')} AS subject_ppm2 FROM listings),
c AS (SELECT comps.*, coalesce(sold_price, asking_price) AS reference_price, {r2('coalesce(sold_price, asking_price) / nullif(living_area_m2, 0)')} AS price_per_m2 FROM comps)"""


@query(
    "comparables",
    with_views(
        "listings comps",
        f"""WITH {COMPS_SQL} SELECT subject_id, comp_id, reference_price, price_per_m2, {r2('(price_per_m2 - subject_ppm2) / subject_ppm2 * 100e0')} AS difference_with_subject_pct
        FROM c LEFT JOIN s ON s.listing_id = c.subject_id""",
    ),
)
def comparables(spark, sf_dir):
    comps, _ = _comps(spark, sf_dir)
    return comps.select("subject_id", "comp_id", "reference_price", "price_per_m2", "difference_with_subject_pct")


@query(
    "comps_summary",
    with_views(
        "listings comps",
        f"""WITH {COMPS_SQL} SELECT subject_id, {r2(mean('price_per_m2'))} AS average_price_per_m2, arg_min(comp_id, (price_per_m2, comp_id)) AS lowest_comparable,
        arg_max(comp_id, (price_per_m2, comp_id)) AS highest_comparable, min(price_per_m2) AS lowest_price_per_m2, max(price_per_m2) AS highest_price_per_m2,
        {r2('median(price_per_m2)')} AS median_price_per_m2 FROM c WHERE price_per_m2 IS NOT NULL GROUP BY subject_id""",
    ),
)
def comps_summary(spark, sf_dir):
    comps, _ = _comps(spark, sf_dir)
    return benchmarks.comps_summary(comps).withColumn("median_price_per_m2", F.round("median_price_per_m2", 2))


@query(
    "comps_valuation",
    with_views(
        "listings comps",
        f"""WITH {COMPS_SQL}, m AS (SELECT subject_id, {r2('median(price_per_m2)')} AS median_ppm2 FROM c WHERE price_per_m2 IS NOT NULL GROUP BY subject_id),
        v AS (SELECT s.*, {r2('median_ppm2 * nullif(subject_area, 0)', 0)} AS estimated_value FROM s LEFT JOIN m ON m.subject_id = s.listing_id)
        SELECT listing_id AS subject_id, estimated_value, {r2('estimated_value * 0.95e0', 0)} AS suggested_bid, {r2('(estimated_value - subject_price) / subject_price * 100e0')} AS margin_pct FROM v""",
    ),
)
def comps_valuation(spark, sf_dir):
    subjects = view(spark, sf_dir, "listings").withColumnRenamed("listing_id", "subject_id")
    medians = benchmarks.comps_medians(benchmarks.priced_comps(view(spark, sf_dir, "comps")))
    summary = medians.withColumn("median_price_per_m2", F.round("median_price_per_m2", 2))
    return benchmarks.comps_valuation(summary, subjects).select("subject_id", "estimated_value", "suggested_bid", "margin_pct")


@query(
    "average_scores",
    with_views(
        "candidates",
        f"SELECT {r2('avg(investment_score)')} AS average_investment_score, {r2('avg(hidden_value_score)')} AS average_hidden_value_score FROM candidates",
    ),
)
def average_scores(spark, sf_dir):
    return benchmarks.average_scores(view(spark, sf_dir, "candidates"), ["investment_score", "hidden_value_score"])


@query(
    "filter_bounds",
    with_views("listings", "SELECT min(asking_price) AS min_price, max(asking_price) AS max_price, min(surface_m2) AS min_area FROM listings"),
)
def filter_bounds(spark, sf_dir):
    return benchmarks.filter_bounds(view(spark, sf_dir, "listings"))


@query("distinct_cities", with_views("listings", "SELECT DISTINCT trim(city) AS city FROM listings WHERE trim(city) <> '' ORDER BY 1"))
def distinct_cities(spark, sf_dir):
    return benchmarks.distinct_cities(view(spark, sf_dir, "listings"))


@query(
    "geo_distinct_counts",
    with_views(
        "listings",
        """SELECT count(DISTINCT city) AS cities_found, count(DISTINCT coalesce(CASE WHEN listing_id % 2 = 0 THEN 'Gemeente ' || city END, city)) AS municipalities_found,
        count(DISTINCT nullif(CASE WHEN listing_id % 4 = 0 THEN ' ' ELSE concat('P', cast(listing_id % 12 as varchar)) END, ' ')) AS provinces_found FROM listings""",
    ),
)
def geo_distinct_counts(spark, sf_dir):
    rows = view(spark, sf_dir, "listings").withColumns(
        {
            "municipality": F.when(F.col("listing_id") % 2 == 0, F.concat(F.lit("Gemeente "), "city")).otherwise(""),
            "province": F.when(F.col("listing_id") % 4 == 0, " ").otherwise(F.concat(F.lit("P"), (F.col("listing_id") % 12).cast("string"))),
        }
    )
    return benchmarks.geo_counts(rows)


@query(
    "confidence_rollup",
    with_views(
        "register_docs",
        """SELECT property_id, CASE WHEN max(CASE WHEN doc_no % 5 = 0 THEN 3 WHEN doc_no % 5 = 1 THEN 2 WHEN doc_no % 5 = 2 THEN 1 ELSE 0 END) = 3 THEN 'high'
          WHEN max(CASE WHEN doc_no % 5 = 1 THEN 2 WHEN doc_no % 5 = 2 THEN 1 ELSE 0 END) = 2 THEN 'medium' WHEN max(CASE WHEN doc_no % 5 = 2 THEN 1 ELSE 0 END) = 1 THEN 'low' ELSE 'unknown' END AS confidence,
          least(cast(max(official_area) as int), cast(min(doc_no) as int)) AS lower_score FROM register_docs GROUP BY property_id""",
    ),
)
def confidence_rollup(spark, sf_dir):
    level = F.element_at(
        F.array(*[F.lit(x) for x in ("high", "medium", "low", "onzeker", "unknown")]), (F.col("doc_no") % 5 + 1).cast("int")
    )
    rows = view(spark, sf_dir, "register_docs").withColumn("level", level)
    return rows.groupBy("property_id").agg(
        benchmarks.best_confidence("level").alias("confidence"),
        F.least(F.max("official_area").cast("int"), F.min("doc_no").cast("int")).alias("lower_score"),
    )


@query(
    "dashboard_table_counts",
    with_views(
        "listings candidates sales permits",
        """SELECT 'properties' AS table_name, count(*) AS row_count FROM listings UNION ALL SELECT 'analyses', count(*) FROM candidates
        UNION ALL SELECT 'transactions', count(*) FROM sales UNION ALL SELECT 'permits', count(*) FROM permits""",
    ),
)
def dashboard_table_counts(spark, sf_dir):
    names = {"properties": "listings", "analyses": "candidates", "transactions": "sales", "permits": "permits"}
    return benchmarks.table_counts({n: view(spark, sf_dir, v) for n, v in names.items()})


@query(
    "dashboard_statistics",
    with_views(
        "listings candidates sales permits",
        f"""SELECT (SELECT count(*) FROM listings) AS total_properties, (SELECT count(*) FROM candidates) AS total_analyses, (SELECT count(*) FROM sales) AS total_transactions,
        (SELECT count(*) FROM permits) AS total_permits, {r2('avg(investment_score)')} AS average_investment_score, max(investment_score) AS highest_investment_score FROM candidates""",
    ),
)
def dashboard_statistics(spark, sf_dir):
    def rows(name):
        return view(spark, sf_dir, name).agg(F.count(F.lit(1))).scalar()

    scores = view(spark, sf_dir, "candidates").agg(
        F.coalesce(F.round(F.avg("investment_score"), 2), F.lit(0.0)).alias("average_investment_score"),
        F.coalesce(F.max("investment_score"), F.lit(0)).alias("highest_investment_score"),
    )
    return scores.select(
        rows("listings").alias("total_properties"),
        rows("candidates").alias("total_analyses"),
        rows("sales").alias("total_transactions"),
        rows("permits").alias("total_permits"),
        "*",
    )


@query(
    "city_counts_sorted",
    with_views("listings", "SELECT coalesce(nullif(trim(city), ''), 'Onbekend') AS city, count(*) AS listing_count FROM listings GROUP BY 1 ORDER BY 2 DESC, 1"),
)
def city_counts_sorted(spark, sf_dir):
    return benchmarks.city_counts(view(spark, sf_dir, "listings")).orderBy(F.desc("listing_count"), "city")


@query(
    "rows_with_reductions",
    with_views("listings", "SELECT lower(coalesce(city, 'Onbekend')) AS city_key, count(CASE WHEN price_reduction_count > 0 THEN 1 END) AS reduced_count FROM listings GROUP BY 1"),
)
def rows_with_reductions(spark, sf_dir):
    rows = view(spark, sf_dir, "listings")
    return rows.groupBy(benchmarks.city_key().alias("city_key")).agg(
        F.count_if(F.col("price_reduction_count") > 0).alias("reduced_count")
    )
