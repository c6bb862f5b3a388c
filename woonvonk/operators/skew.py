"""Building blocks that stay balanced when one key holds a large share of all rows.

Nothing here drops, caps or samples rows: slices and sketches only decide which task handles a
row, never whether it counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from woonvonk.session import broadcast_if_small, materialise

# A listing with more rows than this is spread over tasks by ranges of its time line.
HOT_ROWS = 1_000_000
# Number of value ranges a group is cut into for ranks and medians.
RANK_SLICES = 64
# Distinct values up to this many are ranked with plain windows: they fit one task even in one group.
WINDOW_ROWS = 1_000_000


def first_per_key(df: DataFrame, keys: list, order: list) -> DataFrame:
    """Best row per key. Spark trims every map task to one row per key before the shuffle."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(window)).where("_rn = 1").drop("_rn")


def top_n_per_key(df: DataFrame, keys: list, order: list, n: int, rank: str = "rank_no") -> DataFrame:
    """First ``n`` rows per key, trimmed per map task before the shuffle."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= n)


def value_ranks(df: DataFrame, keys: list[str], value: str, window_rows: int = WINDOW_ROWS) -> DataFrame:
    """Per group and distinct value: how many rows have it (``n``), how many are at or below
    (``upto``) and how many values the group has (``total``). NULL values do not count.

    Rows are first collapsed to distinct values with map-side counts; that table is computed once. A group of at most
    ``window_rows`` values is one window. A larger one is cut at approximate percentiles of its values, counted per
    range, and the ranges are chained through a table of at most ``RANK_SLICES`` rows per group. The counts are exact
    wherever the cuts lie.
    """
    counts = materialise(
        df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    )
    return ranks_of(counts, keys, value, window_rows)


def measure_counts(df: DataFrame, keys: list[str], values: list[str], weight: str | None = None) -> DataFrame:
    """(keys, measure, value, n): how many rows of a group have each value of several columns, in one pass over the rows.

    NULL values have no row; the measure ``rows`` with value NULL counts all rows of the group. A row counts ``weight``
    times. Computed once.
    """
    named = [F.struct(F.lit("rows").alias("measure"), F.lit(None).cast("double").alias("value"))]
    named += [F.struct(F.lit(v).alias("measure"), F.col(v).cast("double").alias("value")) for v in values]
    times = (F.col(weight) if weight else F.lit(1)).cast("bigint").alias("_times")
    long = df.select(*keys, times, F.inline(F.array(*named))).where((F.col("measure") == "rows") | F.col("value").isNotNull())
    return materialise(long.groupBy(*keys, "measure", "value").agg(F.sum("_times").alias("n")))


def ranks_of(counts: DataFrame, keys: list[str], value: str, window_rows: int = WINDOW_ROWS) -> DataFrame:
    """``value_ranks`` from a computed table of distinct values with counts ``n``."""

    def windowed(rows: DataFrame) -> DataFrame:
        group = Window.partitionBy(*keys)
        upto = F.sum("n").over(group.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
        return rows.select(*keys, value, "n", upto.alias("upto"), F.sum("n").over(group).alias("total"))

    if counts.limit(window_rows + 1).count() <= window_rows:
        return windowed(counts)
    sizes = counts.groupBy(*keys).agg(F.count(F.lit(1)).alias("_values"))
    large = materialise(sizes.where(F.col("_values") > window_rows).select(*keys))
    if large.isEmpty():
        return windowed(counts)
    marked = null_safe_join(counts, broadcast_if_small(large.withColumn("_large", F.lit(True))), keys, "left")
    small = windowed(marked.where(F.col("_large").isNull()).drop("_large"))
    return small.unionByName(_sliced_ranks(marked.where("_large").drop("_large"), keys, value))


def _sliced_ranks(counts: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Ranks of groups with more values than a task should hold."""
    steps = [F.lit(i / RANK_SLICES) for i in range(1, RANK_SLICES)]
    cuts = counts.groupBy(*keys).agg(
        F.array_distinct(F.percentile_approx(value, F.array(*steps), F.lit(2000))).alias("cuts")
    )
    placed = null_safe_join(counts, cuts, keys).withColumn(
        "slice_no", F.size(F.filter("cuts", lambda c: c < F.col(value)))
    ).drop("cuts")
    totals = placed.groupBy(*keys, "slice_no").agg(F.sum("n").alias("slice_n"))
    chain = Window.partitionBy(*keys).orderBy("slice_no")
    before = totals.select(
        *keys,
        "slice_no",
        F.coalesce(
            F.sum("slice_n").over(chain.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
        ).alias("before_n"),
        F.sum("slice_n").over(Window.partitionBy(*keys)).alias("total"),
    )
    running = Window.partitionBy(*keys, "slice_no").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    within = placed.withColumn("within", F.sum("n").over(running))
    return null_safe_join(within, before, [*keys, "slice_no"]).select(
        *keys, value, "n", (F.col("before_n") + F.col("within")).alias("upto"), "total"
    )


def medians_from_ranks(ranks: DataFrame, keys: list[str], value: str, alias: str = "median") -> DataFrame:
    """Exact median per group; an even count gives the mean of the middle two."""
    low, high = F.expr("(total - 1) div 2"), F.expr("total div 2")
    start = F.col("upto") - F.col("n")

    def at(position: Column) -> Column:
        return F.max(F.when((start <= position) & (position < F.col("upto")), F.col(value)))

    return ranks.groupBy(*keys).agg(((at(low) + at(high)) / 2.0).alias(alias))


def group_median(df: DataFrame, keys: list[str], value: str, alias: str = "median") -> DataFrame:
    return medians_from_ranks(value_ranks(df, keys, value), keys, value, alias)


def percentile_from_top() -> Column:
    """Over ``value_ranks``: ``100 - 100 * (rows at or below) / rows``, between 0 and 100."""
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100.0 - F.col("upto") / F.col("total") * 100.0))


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join in which NULL keys meet, as they do in groups and windows. Keys appear once, from the left."""
    named = right.select(*[F.col(k).alias(f"_k_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    same = [left[k].eqNullSafe(named[f"_k_{k}"]) for k in keys]
    return left.join(named, same, how).drop(*[f"_k_{k}" for k in keys])


def hot_keys(df: DataFrame, key: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Keys with more than ``hot_rows`` rows, counted map-side first."""
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("_rows"))
    return materialise(counts.where(F.col("_rows") > hot_rows).select(key))


def with_previous(
    df: DataFrame,
    key: str,
    ts: str,
    order: list[str],
    previous: dict[str, Column] | None = None,
    previous_filled: dict[str, Column] | None = None,
    hot_rows: int = HOT_ROWS,
    hot: DataFrame | None = None,
) -> DataFrame:
    """Look back along each key's time line, and tell its length.

    ``previous`` gives the value of the row before, ``previous_filled`` the last non-NULL value before the row;
    ``row_no`` is the 1-based position and ``row_count`` the number of rows of the key. ``order`` must be a total
    order that starts with the time ``ts``; NULLs come first, and NULL is a key like any other. Rows per key are
    counted first (or ``hot``, the keys found before, is given). Ordinary keys are one window partition. The rows of
    keys above ``hot_rows`` are dealt by range of (key, order), so that even one instant is spread over tasks, and what
    the ranges before end with is carried over through a summary with one row per key and range.
    """
    previous = previous or {}
    filled = previous_filled or {}
    values = {**previous, **filled}
    valued = df.select("*", *[c.alias(f"_v_{name}") for name, c in values.items()])
    hot = hot_keys(df, key, hot_rows) if hot is None else hot
    names = [*df.columns, "row_no", "row_count", *values]

    def plain(rows: DataFrame) -> DataFrame:
        window = Window.partitionBy(key).orderBy(*order)
        back = window.rowsBetween(Window.unboundedPreceding, -1)
        return rows.select(
            *df.columns,
            F.row_number().over(window).cast("bigint").alias("row_no"),
            F.count(F.lit(1)).over(Window.partitionBy(key)).alias("row_count"),
            *[F.lag(f"_v_{n}").over(window).alias(n) for n in previous],
            *[F.last(f"_v_{n}", ignorenulls=True).over(back).alias(n) for n in filled],
        )

    if hot.isEmpty():
        return plain(valued)
    marked = null_safe_join(valued, broadcast_if_small(hot.withColumn("_hot", F.lit(True))), [key], "left")
    ordinary = plain(marked.where(F.col("_hot").isNull()).drop("_hot"))
    dealt = marked.where("_hot").drop("_hot").repartitionByRange(key, *order)
    sliced = materialise(dealt.withColumn("_slice", F.spark_partition_id()))
    window = Window.partitionBy(key, "_slice").orderBy(*order)
    back = window.rowsBetween(Window.unboundedPreceding, -1)
    position = F.struct(*order)
    summary = sliced.groupBy(key, "_slice").agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.max_by(F.struct(f"_v_{n}"), position).alias(f"_e_{n}") for n in previous],
        *[
            F.max_by(F.struct(f"_v_{n}"), F.when(F.col(f"_v_{n}").isNotNull(), position)).alias(f"_e_{n}")
            for n in filled
        ],
    )
    chain = Window.partitionBy(key).orderBy("_slice")
    before = chain.rowsBetween(Window.unboundedPreceding, -1)
    carried = summary.select(
        key,
        "_slice",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
        F.sum("_n").over(Window.partitionBy(key)).alias("row_count"),
        *[F.lag(f"_e_{n}").over(chain).alias(f"_c_{n}") for n in previous],
        *[F.last(f"_e_{n}", ignorenulls=True).over(before).alias(f"_c_{n}") for n in filled],
    )
    looked = sliced.withColumns(
        {
            "_rn": F.row_number().over(window),
            **{f"_l_{n}": F.lag(f"_v_{n}").over(window) for n in previous},
            **{f"_l_{n}": F.last(f"_v_{n}", ignorenulls=True).over(back) for n in filled},
        }
    )
    looked = null_safe_join(looked, carried, [key, "_slice"], "left")
    result = {"row_no": (F.col("_rn") + F.col("_before")).cast("bigint")}
    for n in previous:
        carry = F.col(f"_c_{n}")[f"_v_{n}"]
        result[n] = F.when(F.col("_rn") == 1, carry).otherwise(F.col(f"_l_{n}"))
    for n in filled:
        result[n] = F.coalesce(F.col(f"_l_{n}"), F.col(f"_c_{n}")[f"_v_{n}"])
    split = looked.select(*df.columns, "row_count", *[c.alias(n) for n, c in result.items()])
    return ordinary.select(*names).union(split.select(*names))
