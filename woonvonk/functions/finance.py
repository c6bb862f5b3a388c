"""Money columns: NULL-safe, two decimals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from woonvonk.functions.casts import clamp_score, col

# Price statuses for which nothing can be computed.
UNPRICED = ["on_request", "unknown"]


def priced(status: str | Column | None) -> Column:
    if status is None:
        return F.lit(True)
    return ~F.coalesce(col(status).isin(UNPRICED), F.lit(False))


def ratio(top: str | Column, bottom: str | Column) -> Column:
    return F.try_divide(col(top), col(bottom))


def price_per_m2(price, area, status=None) -> Column:
    return F.when(priced(status), F.round(ratio(price, area), 2))


def gross_yield(annual_rent, price, status=None) -> Column:
    return F.when(priced(status), F.round(ratio(annual_rent, price) * 100, 2))


def price_reduction(original, current) -> Column:
    """Amount and percentage when the price went down."""
    o, c = col(original), col(current)
    return F.when(
        (c > 0) & (c < o),
        F.struct(F.round(o - c, 2).alias("amount"), F.round(ratio(o - c, o) * 100, 2).alias("percentage")),
    )


def change_since_sale(current, previous) -> Column:
    c, p = col(current), col(previous)
    return F.when(
        (c > 0) & (p > 0),
        F.struct(F.round(c - p, 2).alias("amount"), F.round(ratio(c - p, p) * 100, 2).alias("percentage")),
    )


def discount_pct(object_ppm2, market_ppm2) -> Column:
    o, m = col(object_ppm2), col(market_ppm2)
    return F.when(o != 0, F.round(ratio(m - o, m) * 100, 2))


def share_of(amount, percentage) -> Column:
    return F.round(col(amount) * (col(percentage) / 100.0), 2)


def acquisition_costs(price, percentage, status=None) -> Column:
    return F.when(priced(status) & (col(price) > 0) & (col(percentage) >= 0), share_of(price, percentage))


def total_investment(price, costs, renovation, status=None) -> Column:
    extra = F.coalesce(col(costs), F.lit(0.0))
    works = F.coalesce(col(renovation), F.lit(0.0))
    usable = priced(status) & (col(price) > 0) & (extra >= 0) & (works >= 0)
    return F.when(usable, F.round(col(price) + extra + works, 2))


def financing_amount(price, ltv, status=None) -> Column:
    return F.when(priced(status) & (col(price) > 0) & (col(ltv) >= 0), share_of(price, ltv))


def annual_interest(financing, rate) -> Column:
    return F.when((col(financing) >= 0) & (col(rate) >= 0), share_of(financing, rate))


def annual_cashflow(rent, interest) -> Column:
    return F.round(col(rent) - col(interest), 2)


def required_rent(investment, target_yield) -> Column:
    return F.when((col(investment) > 0) & (col(target_yield) > 0), share_of(investment, target_yield))


def max_purchase_price(rent, target_yield, cost_pct, renovation) -> Column:
    usable = (col(rent) > 0) & (col(target_yield) > 0) & (col(cost_pct) >= 0) & (col(renovation) >= 0)
    price = (col(rent) / (F.nullif(col(target_yield), F.lit(0)) / 100.0) - col(renovation)) / (
        1.0 + col(cost_pct) / 100.0
    )
    return F.when(usable & (price > 0), F.round(price, 2))


def woz_difference(price, woz) -> Column:
    """Asking price against the tax value."""
    p, w = col(price), col(woz)
    return F.struct(
        F.when(w != 0, F.round(p - w, 2)).alias("difference_eur"),
        F.round(ratio(p - w, w) * 100.0, 2).alias("difference_pct"),
    )


def discount_ratio(asking_ppm2, market_ppm2) -> Column:
    return ratio(col(market_ppm2) - col(asking_ppm2), market_ppm2)


def market_discount_score(discount: Column) -> Column:
    return clamp_score(discount * 100.0)


# The discount from which a row is highlighted, and placeholder valuation factors.
HIGHLIGHT_DISCOUNT = 0.25
MARKET_FACTOR = 1.10
PURCHASE_FACTOR = 0.92
STREET_FACTOR = 0.95
NEIGHBOURHOOD_FACTOR = 0.88
FALLBACK_PRICE_PER_M2 = 4500.0


def is_highlight(discount: Column) -> Column:
    return F.coalesce(discount >= HIGHLIGHT_DISCOUNT, F.lit(False))


def placeholder_valuation(price) -> Column:
    p = F.when(col(price) > 0, col(price))
    market = p * MARKET_FACTOR
    ceiling = p * PURCHASE_FACTOR
    difference_pct = ratio(p - ceiling, p) * 100.0
    return F.struct(
        market.alias("market_value"),
        (ratio(market - p, market) * 100.0).alias("discount_pct"),
        ceiling.alias("max_purchase_price"),
        (p - ceiling).alias("difference_eur"),
        difference_pct.alias("difference_pct"),
        advice(difference_pct).alias("advice"),
    )


def advice(difference_pct: Column) -> Column:
    return (
        F.when(difference_pct.isNull(), "Onbekend")
        .when(difference_pct <= 0, "Green")
        .when(difference_pct <= 5, "Orange")
        .otherwise("Red")
    )


def yield_pct(*candidates) -> Column:
    """First yield given; ratios in (0, 1] are turned into percentages."""
    value = F.coalesce(*[col(c) for c in candidates])
    return F.when((value > 0) & (value <= 1), value * 100.0).otherwise(value)


def local_price_estimate(price, area, factor: float) -> Column:
    base = F.coalesce(F.nullif(col(price), F.lit(0.0)), col(area) * FALLBACK_PRICE_PER_M2)
    return F.round(F.nullif(base, F.lit(0.0)) * factor, 2)
