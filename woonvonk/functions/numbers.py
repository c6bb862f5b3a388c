"""Numbers, prices and areas out of free text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from woonvonk.functions.casts import col, let, rx, strip, text_or_null
from woonvonk.functions.text import contains_any

# Patterns.
NUMBER_TOKEN = r"([-+]?\d[\d.,]*)"
LOOSE_NUMBER = rx(r"([0-9][0-9.,\s]*)")
THOUSANDS = r"^\d{1,3}(\.\d{3})+(,\d+)?$"
EURO_NUMBER = rx(r"€\s*([0-9][0-9.,\s]*)")


def parse_number_eu(value: str | Column) -> Column:
    """First numeric token; the later of comma and point is the decimal mark."""
    return let(F.regexp_extract(F.lower(strip(col(value))), NUMBER_TOKEN, 1), _token_number)


def _token_number(token: Column) -> Column:
    commas, points = token.contains(","), token.contains(".")
    comma_last = F.instr(F.reverse(token), ",") < F.instr(F.reverse(token), ".")
    dutch = F.translate(F.translate(token, ".", ""), ",", ".")
    cleaned = (
        F.when(token.rlike(THOUSANDS), dutch)
        .when(commas & points & comma_last, dutch)
        .when(commas & points, F.translate(token, ",", ""))
        .when(commas, F.translate(token, ",", "."))
        .otherwise(token)
    )
    return cleaned.try_cast("double")


def _dutch_number(matched: Column) -> Column:
    text = F.translate(F.regexp_replace(matched, rx(r"[.\s]"), ""), ",", ".")
    return strip(text).try_cast("double")


def parse_number_nl(value: str | Column) -> Column:
    """Points and blanks are grouping, the comma is decimal (``450000.00`` reads as 45000000)."""
    return _dutch_number(F.regexp_extract(col(value), LOOSE_NUMBER, 1))


def parse_area(value: str | Column) -> Column:
    """Number before ``m2``/``m²``, otherwise the first number."""
    before_unit = F.regexp_extract(F.lower(col(value)), LOOSE_NUMBER + rx(r"\s*(m2|m²)"), 1)
    return F.when(before_unit != "", _dutch_number(before_unit)).otherwise(parse_number_nl(value))


def parse_price(value: str | Column) -> Column:
    """Amount and status of a price text."""
    lowered = F.lower(strip(col(value)))
    amount = parse_number_nl(value)
    status = (
        F.when(text_or_null(value).isNull() & (F.coalesce(col(value), F.lit("")) == ""), None)
        .when((lowered == "poa") | lowered.contains("op aanvraag"), "on_request")
        .when(lowered.contains("vanaf"), "from_price")
        .when(lowered.contains("veiling"), "auction")
        .when(col(value).contains(" - ") | lowered.contains("tot"), "range")
        .when(amount.isNotNull(), "known")
        .otherwise("unknown")
    )
    return F.struct(
        F.when(status.isin("from_price", "auction", "known"), amount).alias("amount"), status.alias("status")
    )


def infer_price_status(text: str | Column) -> Column:
    """Price status of running text. Each pattern is tried only where one of its words occurs."""
    plain = strip(col(text))
    return _price_status(plain, F.lower(plain), euro_amount(text))


def _price_status(plain: Column, lowered: Column, amount: Column) -> Column:

    def found(words: list[str], pattern: str) -> Column:
        return contains_any(lowered, words) & lowered.rlike(pattern)

    return (
        F.when(F.coalesce(plain, F.lit("")) == "", "unknown")
        .when(
            found(
                ["aanvraag", "poa", "bespreken", "n.v.t"],
                rx(r"\bprijs\s+op\s+aanvraag\b|\bpoa\b|\bop\s+aanvraag\b|\bprijs\s+te\s+bespreken\b|\bn\.v\.t\.?\b"),
            ),
            "on_request",
        )
        .when(found(["vanaf", "starting from"], r"\b(vanaf|starting from)\b"), "from_price")
        .when(found(["veiling", "auction"], r"\b(veiling|auction)\b"), "auction")
        .when(found(["tot", "t/m"], r"\b(tot|t/m|tot en met)\b") | plain.contains(" - "), "range")
        .when(amount.isNotNull(), "known")
        .otherwise("unknown")
    )


def euro_amount(text: str | Column) -> Column:
    """Number right after the first euro sign that has one."""
    return F.when(col(text).contains("€"), _dutch_number(F.regexp_extract(col(text), EURO_NUMBER, 1)))


def with_inferred_price(df: DataFrame, text: str) -> DataFrame:
    """Add ``asking_price``, ``asking_price_status`` and ``asking_price_text`` read from running text.

    What several steps need is kept in columns, so that a text is stripped, lowered and searched for an amount once.
    """
    kept = df.withColumns({"_plain": strip(col(text)), "_amount": euro_amount(text)}).withColumn("_lowered", F.lower("_plain"))
    status = kept.withColumn("asking_price_status", _price_status(F.col("_plain"), F.col("_lowered"), F.col("_amount")))
    known = F.col("asking_price_status")
    return status.withColumns(
        {
            "asking_price": F.when(known.isin("from_price", "auction", "known"), F.col("_amount")),
            "asking_price_text": F.when(known != "unknown", F.col("_plain")),
        }
    ).drop("_plain", "_amount", "_lowered")
