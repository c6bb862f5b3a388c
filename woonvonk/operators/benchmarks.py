"""Peer-group measures: city and portfolio benchmarks, ranks, counts and averages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from woonvonk.functions.casts import strip
from woonvonk.functions import finance
from woonvonk.operators.skew import measure_counts, medians_from_ranks, percentile_from_top, ranks_of, top_n_per_key, value_ranks
from woonvonk.session import broadcast_if_small


def city_key(city: str = "city") -> Column:
    """Lower-cased city; missing cities form one group."""
    return F.lower(strip(F.coalesce(F.nullif(strip(city), F.lit("")), F.lit("Onbekend"))))


def exact_sum(value: str, decimals: int = 2) -> Column:
    """Sum of values with that many decimals, the same whatever the order of the rows."""
    return F.sum(F.col(value).cast(f"decimal(20,{decimals})")).cast("double")


def exact_mean(value: str, decimals: int = 2) -> Column:
    return F.try_divide(exact_sum(value, decimals), F.count(value))


def with_ppm2(df: DataFrame, name: str = "price_per_m2", area: str = "surface_m2") -> DataFrame:
    """Price per m², NULL without price or area."""
    return df.withColumn(name, F.round(finance.ratio("asking_price", area), 2))


def city_benchmarks(df: DataFrame, key: str = "city_key") -> DataFrame:
    """Per city the average price per m² and the exact median price; expects ``price_per_m2``."""
    averages = df.groupBy(key).agg(
        exact_mean("price_per_m2").alias("avg_price_per_m2"),
        F.count(F.lit(1)).alias("listing_count"),
        F.count("asking_price").alias("priced_count"),
    )
    medians = medians_from_ranks(value_ranks(df, [key], "asking_price"), [key], "asking_price", "median_asking_price")
    return averages.join(medians, key, "left")


def join_city_benchmarks(df: DataFrame, key: str = "city_key") -> DataFrame:
    """Add the benchmarks of the row's city. Cities are few, so after a count check they are sent to
    every task and the listings are not shuffled."""
    return df.join(broadcast_if_small(city_benchmarks(df, key)), key, "left")


def with_city_measures(df: DataFrame, percentile: str, key: str = "city_key", weight: str | None = None) -> DataFrame:
    """The benchmarks of the row's city and, as ``percentile``, the share of its rows with a higher price per m².

    Averages, medians and ranks all come from one table of distinct values with counts, so the listings are read once
    before they are joined back; expects ``price_per_m2``. A row counts ``weight`` times.
    """
    counts = measure_counts(df, [key], ["asking_price", "price_per_m2"], weight)
    of = lambda measure, x: F.sum(F.when(F.col("measure") == measure, x))
    total = of("price_per_m2", F.col("value").cast("decimal(20,2)") * F.col("n").cast("decimal(18,0)")).cast("double")
    averages = counts.groupBy(key).agg(
        F.try_divide(total, of("price_per_m2", F.col("n"))).alias("avg_price_per_m2"),
        of("rows", F.col("n")).alias("listing_count"),
        F.coalesce(of("asking_price", F.col("n")), F.lit(0)).alias("priced_count"),
    )
    ranks = ranks_of(counts.where(F.col("measure") != "rows"), [key, "measure"], "value")
    medians = medians_from_ranks(ranks.where("measure = 'asking_price'"), [key], "value", "median_asking_price")
    shares = ranks.where("measure = 'price_per_m2'").select(key, F.col("value").alias("price_per_m2"), percentile_from_top().alias(percentile))
    joined = df.join(broadcast_if_small(averages.join(medians, key, "left")), key, "left")
    return joined.join(broadcast_if_small(shares), [key, "price_per_m2"], "left")


def with_percentile(df: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """Add ``100 - 100 * share of rows at or below`` within the group; NULL stays NULL."""
    ranks = value_ranks(df, [key], value).withColumn(name, percentile_from_top()).select(key, value, name)
    return df.join(broadcast_if_small(ranks), [key, value], "left")


def portfolio_benchmarks(df: DataFrame, fallback: float | None = None) -> DataFrame:
    """One row: average and median price per m², and how many rows there are."""
    everything = df.withColumn("_all", F.lit(1))
    averages = everything.groupBy("_all").agg(
        exact_mean("price_per_m2").alias("average"), F.count(F.lit(1)).alias("sample_size")
    )
    medians = medians_from_ranks(
        value_ranks(everything, ["_all"], "price_per_m2"), ["_all"], "price_per_m2", "median"
    )
    return averages.join(medians, "_all", "left").select(
        F.round(F.coalesce("average", F.lit(fallback).cast("double")), 2).alias("average_price_per_m2"),
        F.round(F.coalesce("median", F.lit(fallback).cast("double")), 2).alias("median_price_per_m2"),
        "sample_size",
    )


def leave_one_out(df: DataFrame, value: str = "price_per_m2", name: str = "peer_average") -> DataFrame:
    """Average of everybody else's value (two decimals): the total without the own share. The total is one row."""
    totals = df.agg(
        F.struct(exact_sum(value).alias("total"), F.count(value).alias("filled"), F.count(F.lit(1)).alias("rows")).alias("t")
    ).scalar()
    own = F.coalesce(F.col(value), F.lit(0.0))
    others = F.col("_t.filled") - F.when(F.col(value).isNotNull(), 1).otherwise(0)
    return (
        df.withColumn("_t", totals)
        .withColumns(
            {
                name: F.round(F.try_divide(F.col("_t.total") - own, others), 2),
                f"{name}_size": F.col("_t.rows") - 1,
            }
        )
        .drop("_t")
    )


def top_per_city(df: DataFrame, score: str, tiebreak: str, n: int = 20, key: str = "city_key") -> DataFrame:
    return top_n_per_key(df, [key], [F.col(score).desc_nulls_last(), F.col(tiebreak)], n)


def average_scores(df: DataFrame, columns: list[str]) -> DataFrame:
    """Mean of the given scores, two decimals, 0 when there is none."""
    return df.agg(*[F.coalesce(F.round(F.avg(c), 2), F.lit(0.0)).alias(f"average_{c}") for c in columns])


def city_counts(df: DataFrame, city: str = "city") -> DataFrame:
    name = F.coalesce(F.nullif(strip(city), F.lit("")), F.lit("Onbekend"))
    return df.groupBy(name.alias("city")).agg(F.count(F.lit(1)).alias("listing_count"))


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Row count per table, one row per table."""
    parts = [t.agg(F.lit(n).alias("table_name"), F.count(F.lit(1)).alias("row_count")) for n, t in tables.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def comparables(comps: DataFrame, subjects: DataFrame) -> DataFrame:
    """Comparables with their price per m² and the difference with their subject.

    ``comps`` are landed per subject (``subject_id``); ``subjects`` has ``subject_id``, ``asking_price``
    and ``surface_m2``. The reference price is the sold price, else the asking price.
    """
    prices = subjects.select("subject_id", finance.price_per_m2("asking_price", "surface_m2").alias("subject_ppm2"))
    return (
        priced_comps(comps)
        .join(prices, "subject_id", "left")
        .withColumn(
            "difference_with_subject_pct",
            F.round(finance.ratio(F.col("price_per_m2") - F.col("subject_ppm2"), "subject_ppm2") * 100.0, 2),
        )
    )


def priced_comps(comps: DataFrame) -> DataFrame:
    """Comparables with reference price and price per m², which need no subject."""
    reference = F.coalesce("sold_price", "asking_price")
    ppm2 = finance.price_per_m2(reference, "living_area_m2")
    given = F.coalesce("price_per_m2", ppm2) if "price_per_m2" in comps.columns else ppm2
    return comps.withColumns({"reference_price": reference, "price_per_m2": given})


def comps_summary(comps: DataFrame, key: str = "subject_id", order: str = "comp_id") -> DataFrame:
    """Average, median, cheapest and dearest comparable per subject."""
    priced = comps.where(F.col("price_per_m2").isNotNull())
    low = F.struct(F.col("price_per_m2"), F.col(order))
    high = F.struct(F.col("price_per_m2"), F.col(order))
    rolled = priced.groupBy(key).agg(
        F.round(exact_mean("price_per_m2"), 2).alias("average_price_per_m2"),
        F.min(low)[order].alias("lowest_comparable"),
        F.max(high)[order].alias("highest_comparable"),
        F.min("price_per_m2").alias("lowest_price_per_m2"),
        F.max("price_per_m2").alias("highest_price_per_m2"),
    )
    return rolled.join(comps_medians(comps, key), key, "left")


def comps_medians(comps: DataFrame, key: str = "subject_id") -> DataFrame:
    """Median price per m² of each subject that has a priced comparable."""
    return medians_from_ranks(value_ranks(comps, [key], "price_per_m2"), [key], "price_per_m2", "median_price_per_m2")


# Bid as a share of the value.
BID_FACTOR = 0.95


def comps_valuation(summary: DataFrame, subjects: DataFrame, key: str = "subject_id") -> DataFrame:
    """Value, bid and margin of a subject from the median of its comparables."""
    joined = subjects.join(summary.select(key, "median_price_per_m2"), key, "left")
    value = F.round(F.col("median_price_per_m2") * F.nullif("surface_m2", F.lit(0.0)), 0)
    bid = F.round(F.col("estimated_value") * BID_FACTOR, 0)
    margin = F.round(
        finance.ratio(F.col("estimated_value") - F.col("asking_price"), "asking_price") * 100.0, 2
    )
    return joined.withColumn("estimated_value", value).withColumns({"suggested_bid": bid, "margin_pct": margin})


def filter_bounds(df: DataFrame) -> DataFrame:
    """Slider bounds of a report: lowest and highest price, lowest area; 0 when there is none."""
    return df.agg(
        F.coalesce(F.min("asking_price"), F.lit(0.0)).alias("min_price"),
        F.coalesce(F.max("asking_price"), F.lit(0.0)).alias("max_price"),
        F.coalesce(F.min("surface_m2"), F.lit(0.0)).alias("min_area"),
    )


def distinct_cities(df: DataFrame, city: str = "city") -> DataFrame:
    name = strip(city)
    return df.select(name.alias("city")).where(F.col("city") != "").distinct().orderBy("city")


def geo_counts(df: DataFrame) -> DataFrame:
    """Distinct cities, municipalities (falling back to the city) and provinces."""

    def filled(name: str) -> Column:
        return F.nullif(strip(name), F.lit(""))

    return df.agg(
        F.countDistinct(filled("city")).alias("cities_found"),
        F.countDistinct(F.coalesce(filled("municipality"), filled("city"))).alias("municipalities_found"),
        F.countDistinct(filled("province")).alias("provinces_found"),
    )


def best_confidence(label: str | Column) -> Column:
    """Aggregate: the best of high, medium, low and unknown."""
    c = F.col(label) if isinstance(label, str) else label
    rank = F.when(c == "high", 3).when(c == "medium", 2).when(c == "low", 1).otherwise(0)
    return F.element_at(F.array(*[F.lit(x) for x in ("unknown", "low", "medium", "high")]), F.max(rank) + 1)

