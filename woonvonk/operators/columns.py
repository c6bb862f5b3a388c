"""Whole-table column jobs: identity, fall-back picks, completeness, merges, flags."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from woonvonk.functions import finance, text
from woonvonk.functions.casts import code_or, col, strip, text_or_null
from woonvonk.session import broadcast_if_small

# Fields that make a record complete, code sets, and word counts that make a text usable.
COMPLETENESS_FIELDS = [
    "asking_price", "surface_m2", "plot_size_m2", "bedrooms", "energy_label", "construction_year",
    "listed_since", "price_reduction_count", "broker",
]
TRANSACTION_TYPES = ["sale", "auction_sale", "transfer", "merger_or_split"]
CONFIDENCES = ["high", "medium", "low"]
ANALYSIS_WORDS = 40
IMPORT_WORDS = 35
MONUMENT_TERMS = ["monument", "rijksmonument", "gemeentelijk monument", "beschermd stads- of dorpsgezicht"]


def stable_identity(listings: DataFrame) -> DataFrame:
    """External id when given, otherwise the normalised URL."""
    url = text.normalize_url("source_url")
    return listings.withColumns(
        {"url": url, "identity": F.coalesce(text_or_null("external_listing_id"), F.nullif(url, F.lit("")))}
    )


def pick(df: DataFrame, payload: str, keys: list[str]) -> Column:
    """First filled value over the keys: for each key the column, then the JSON payload."""
    options = []
    for key in keys:
        if key in df.columns:
            options.append(F.nullif(F.col(key).cast("string"), F.lit("")))
        options.append(F.nullif(F.get_json_object(payload, f"$.{key}"), F.lit("")))
    return F.coalesce(*options)


def transaction_type(value: str | Column) -> Column:
    return code_or(value, TRANSACTION_TYPES)


def display_name(name: Column, aliases: dict[str, str]) -> Column:
    """Shown name of a source; ``aliases`` maps known names, blanks are ``Onbekend``."""
    pairs = F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair])
    return F.coalesce(F.try_element_at(pairs, F.lower(name)), text_or_null(name), F.lit("Onbekend"))


def _is_empty(df: DataFrame, name: str) -> Column:
    dtype = dict(df.dtypes)[name]
    blank = F.col(name).isNull()
    if dtype == "string":
        return blank | (strip(F.col(name)) == "")
    if dtype.startswith(("array", "map")):
        return blank | (F.size(name) == 0)
    return blank


def missing_fields(df: DataFrame, fields: list[str]) -> Column:
    """Names of the fields without a value, in the given order."""
    return F.array_compact(F.array(*[F.when(_is_empty(df, f), F.lit(f)) for f in fields]))


def completeness(df: DataFrame, fields: list[str] = COMPLETENESS_FIELDS) -> DataFrame:
    """Missing fields and import status; a missing price counts only when its status is unknown too."""
    status = F.coalesce(F.lower(strip("asking_price_status")), F.lit("unknown"))
    unpriced = F.col("asking_price").isNull() & status.isin("unknown", "")
    flags = [F.when(unpriced if f == "asking_price" else _is_empty(df, f), F.lit(f)) for f in fields]
    return df.withColumn("missing_fields", F.array_compact(F.array(*flags))).withColumn(
        "import_status", F.when(F.size("missing_fields") == 0, "fully_imported").otherwise("partially_imported")
    )


def merge_refresh(df: DataFrame, texts: list[str], numbers: list[str], source_name: str) -> DataFrame:
    """Merge ``new_<column>`` into ``<column>`` and list the columns that changed.

    A new number wins; a text is replaced only when the stored one is missing, or a generic title.
    """
    merged = {}
    for name in texts:
        generic = text.is_generic_title(name, F.lit(source_name)) if name == "title" else None
        merged[name] = text.prefer_text(name, f"new_{name}", generic)
    for name in numbers:
        merged[name] = F.coalesce(f"new_{name}", name)
    changed = [F.when(~F.col(n).eqNullSafe(c), F.lit(n)) for n, c in merged.items()]
    return df.withColumns({**merged, "changed_fields": F.array_compact(F.array(*changed))}).drop(
        *[f"new_{n}" for n in merged]
    )


def history_text(status: Column, drop_pct: Column, days: Column, truncate: bool = False) -> Column:
    """``status=…, N% prijsdaling`` or ``status=…, N dagen``."""
    whole = (F.floor(drop_pct) if truncate else F.bround(drop_pct)).cast("int").cast("string")
    head = F.concat(F.lit("status="), F.coalesce(status, F.lit("unknown")))
    return (
        F.when(drop_pct.isNotNull(), F.concat(head, F.lit(", "), whole, F.lit("% prijsdaling")))
        .when(days.isNotNull(), F.concat(head, F.lit(", "), days.cast("string"), F.lit(" dagen")))
        .otherwise(head)
    )


def provenance(source: Column, retrieved_at: Column, confidence: Column, raw: Column, value: Column) -> Column:
    """Where a datum comes from and how sure it is."""
    return F.struct(
        source.alias("source"),
        retrieved_at.alias("retrieved_at"),
        code_or(confidence, CONFIDENCES).alias("confidence"),
        raw.cast("string").alias("raw_value"),
        value.alias("normalized_value"),
    )


def keyword_flags(df: DataFrame, column: str, dictionaries: dict[str, list[str]]) -> DataFrame:
    """Per dictionary a flag ``has_<name>`` and the matched terms ``<name>_terms``, over the whole text."""
    lowered = F.lower(F.coalesce(col(column), F.lit("")))
    found = {f"{name}_terms": text.matched_terms(lowered, terms) for name, terms in dictionaries.items()}
    return df.withColumns(found).withColumns({f"has_{name}": F.size(f"{name}_terms") > 0 for name in dictionaries})


def is_monument(*texts: str | Column) -> Column:
    return text.contains_any(F.lower(F.concat_ws(" ", *[col(t) for t in texts])), MONUMENT_TERMS)


def enough_text(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn("words", text.word_count(column)).withColumns(
        {"enough_for_analysis": F.col("words") >= ANALYSIS_WORDS, "enough_for_import": F.col("words") >= IMPORT_WORDS}
    )


def local_prices(listings: DataFrame) -> DataFrame:
    """Fixed-factor estimates, next to the mean price per m² of the four-digit postcode area."""
    hood = F.substring(text.compact_postcode("address", text.LOOSE_POSTCODE), 1, 4)
    placed = listings.withColumn("_hood", hood)
    means = placed.groupBy("_hood").agg(
        F.avg(finance.ratio("asking_price", "surface_m2")).alias("neighbourhood_ppm2")
    )
    return (
        placed.join(broadcast_if_small(means), "_hood", "left")
        .withColumns(
            {
                "street_estimate": finance.local_price_estimate("asking_price", "surface_m2", finance.STREET_FACTOR),
                "neighbourhood_estimate": finance.local_price_estimate(
                    "asking_price", "surface_m2", finance.NEIGHBOURHOOD_FACTOR
                ),
            }
        )
        .drop("_hood")
    )


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)
