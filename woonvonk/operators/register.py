"""Matching properties with landed address and tax-register records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from woonvonk.functions import finance
from woonvonk.functions.casts import clamp_score, let, strip, text_or_null
from woonvonk.functions.text import LOOSE_POSTCODE, compact_postcode, normalize_identifier, register_address, squash
from woonvonk.operators.scoring import points, total
from woonvonk.operators.skew import first_per_key

# Flags and confidences.
NOT_FOUND_FLAGS = ["bag_match_not_found", "low_confidence_match"]
LOW_CONFIDENCE = 70
AREA_GAP_PCT = 10.0
AREA_GAP_FLAG = "funda_bag_area_difference_gt_10_pct"
WOZ_WITH_VALUE, WOZ_WITHOUT_VALUE, WOZ_NO_RECORD, WOZ_NO_CANDIDATE = 98, 65, 5, 10


def _tidy(name: str) -> Column:
    """Nothing to strip or squash: seen in far less time than a pattern takes to rewrite the text."""
    value = F.col(name)
    edges = value.startswith(" ") | value.endswith(" ")
    return ~(edges | value.contains("  ") | value.rlike("[^ -~]"))


def _text(name: str) -> Column:
    return F.coalesce(F.lower(F.when(_tidy(name), F.col(name)).otherwise(squash(name))), F.lit(""))


def _code(name: str) -> Column:
    return F.when(F.col(name) == "", "").otherwise(F.upper(strip(F.coalesce(name, F.lit("")))))


def _postcode(name: str) -> Column:
    value = F.col(name)
    plain = F.concat(F.substring(value, 1, 4), F.upper(F.substring(value, 6, 2)))
    return F.when(value.rlike(r"^[0-9]{4} [A-Za-z]{2}\z"), plain).otherwise(compact_postcode(name, LOOSE_POSTCODE))


def _identifier(name: str) -> Column:
    value = F.col(name).cast("string")
    plain = F.ltrim(value, F.lit("0"))
    return F.when(value.rlike(r"^0*[1-9][0-9]*\z"), plain).otherwise(normalize_identifier(name))


def _same(expected: Column, found: Column) -> Column:
    return (F.coalesce(expected, F.lit("")) != "") & (expected == found)


def _agreement(expected: Column, found: Column, gain: int, loss: int) -> Column:
    """Gain when equal, loss when the record says something else, nothing when either is silent."""
    return F.when(F.coalesce(expected, F.lit("")) == "", 0).when(expected == found, gain).when(found != "", -loss).otherwise(0)


def with_expected(properties: DataFrame) -> DataFrame:
    """Address parts that the records should agree with (column ``want``)."""
    return properties.withColumn("want", register_address("address", "postal_code"))


def _prepared_properties(properties: DataFrame) -> DataFrame:
    """Everything the scores compare on the property side, worked out once per property."""

    def known_id(name: str) -> Column:
        if name not in properties.columns:
            return F.lit(None).cast("string")
        return F.when(F.coalesce(strip(name), F.lit("")) != "", normalize_identifier(name))

    return with_expected(properties).withColumns(
        {
            "_w_street": F.nullif(F.lower(squash(F.col("want.street_name"))), F.lit("")),
            "_w_city": F.nullif(_text("city"), F.lit("")),
            "_w_address_id": known_id("preferred_address_id"),
            "_w_object_id": known_id("preferred_object_id"),
        }
    )


def _prepared_records(records: DataFrame) -> DataFrame:
    """The same on the record side, once per record.

    Spark splits the code of a list of columns with a ``let`` in it into short methods. Without, it makes one method of
    the list and what lies around it, which is too long for the JVM to compile.
    """
    return records.withColumns(
        {
            "_r_type": _text("doc_type"),
            "_r_postcode": _postcode("doc_postcode"),
            "_r_letter": _code("doc_letter"),
            "_r_addition": _code("doc_addition"),
            "_r_street": _text("doc_street"),
            "_r_city": _text("doc_city"),
            "_r_address_id": _identifier("address_id"),
            "_r_object_id": _identifier("object_id"),
            "_r_home": let(text_or_null("usage_purpose"), lambda usage: F.when(usage.isNotNull(), residential(usage))),
        }
    )


def residential(usage: Column) -> Column:
    return F.coalesce(F.lower(usage).contains("woon"), F.lit(False))


def candidate_score() -> Column:
    """Additive agreement of a record with a property, over the prepared columns of both.

    Record columns: doc_type, doc_postcode, doc_number, doc_letter, doc_addition, doc_street, doc_city,
    usage_purpose, official_area, address_id, object_id, relevance; the property's tax record may give
    preferred_address_id and preferred_object_id.
    """
    return total(
        points(F.col("_r_type") == "adres", 35),
        points(F.col("want.postcode") == F.col("_r_postcode"), 20),
        points(F.col("want.house_number") == F.col("doc_number"), 15),
        _agreement(F.col("want.house_letter"), F.col("_r_letter"), 14, 10),
        _agreement(F.col("want.house_number_addition"), F.col("_r_addition"), 14, 10),
        points(F.col("_w_street") == F.col("_r_street"), 10),
        points(F.col("_w_city") == F.col("_r_city"), 8),
        F.when(F.col("_r_home"), 22).when(~F.col("_r_home"), -12).otherwise(0),
        points(F.col("official_area") != 0, 8),
        points(F.col("_w_address_id") == F.col("_r_address_id"), 10),
        points(F.col("_w_object_id") == F.col("_r_object_id"), 12),
        F.coalesce(F.bround("relevance").cast("int"), F.lit(0)),
    )


def address_score() -> Column:
    """Agreement when only the address records are known (ties go to the higher relevance)."""
    return total(
        points(F.col("_r_type") == "adres", 40),
        points(F.col("want.postcode") == F.upper(F.translate("doc_postcode", " ", "")), 30),
        points(F.col("want.house_number") == F.col("doc_number"), 15),
        points(_same(F.col("want.house_letter"), F.col("_r_letter")), 8),
        points(_same(F.col("want.house_number_addition"), F.col("_r_addition")), 8),
        points(F.col("_w_street") == F.col("_r_street"), 14),
        points(F.col("_r_home"), 8),
        points(F.col("_w_city") == F.col("_r_city"), 8),
    )


def match_records(properties: DataFrame, records: DataFrame, key: str = "property_id", order: str = "doc_no") -> DataFrame:
    """Best record of each property, with its score, the number of records, confidence and flags.

    Records are landed per property, so this is an equi-join on the property; the winner is a mergeable
    maximum and the number of records a count, so no group is collected. Properties without a record stay.
    """
    pairs = _prepared_properties(properties).join(_prepared_records(records), key)
    doc_columns = [c for c in records.columns if c != key]
    scored = pairs.withColumn("match_score", candidate_score())
    best = scored.groupBy(key).agg(
        F.max_by(F.struct("match_score", *doc_columns), F.struct("match_score", -F.col(order))).alias("_best"),
        F.count(F.lit(1)).alias("record_count"),
    )
    chosen = with_expected(properties).join(best, key, "left").select(
        *properties.columns, "want", "_best.*", F.coalesce("record_count", F.lit(0)).alias("record_count")
    )
    return chosen.withColumn("confidence_score", confidence(order)).withColumn("quality_flags", quality_flags(order)).drop("want")


def best_address(properties: DataFrame, records: DataFrame, key: str = "property_id", order: str = "doc_no") -> DataFrame:
    scored = _prepared_properties(properties).join(_prepared_records(records), key).withColumn("address_score", address_score())
    best = first_per_key(
        scored, [key], [F.col("address_score").desc(), F.coalesce("relevance", F.lit(0.0)).desc(), F.col(order)]
    )
    return best.select(*properties.columns, *[c for c in records.columns if c != key], "address_score")


def confidence(found: str = "doc_no") -> Column:
    """0..100: how sure the match is; ``found`` is NULL when there is none."""
    any_record = F.col(found).isNotNull()
    raw = total(
        points(any_record, 30),
        points(F.col("object_id").isNotNull(), 30),
        points(F.col("want.postcode") == compact_postcode("doc_postcode", LOOSE_POSTCODE), 15),
        points(F.col("want.house_number") == F.col("doc_number"), 10),
        points(_same(F.col("want.house_letter"), _code("doc_letter")), 5),
        points(_same(F.col("want.house_number_addition"), _code("doc_addition")), 5),
        points(residential(F.col("usage_purpose")), 10),
        F.when(F.col("record_count") > 1, -5).otherwise(0),
    )
    return clamp_score(raw.cast("double"))


def quality_flags(found: str = "doc_no") -> Column:
    usage = text_or_null("usage_purpose")
    return F.array_compact(
        F.array(
            F.when(F.col(found).isNull(), "bag_match_not_found"),
            F.when(F.col("record_count") > 1, "multiple_possible_bag_matches"),
            F.when(usage.isNotNull() & ~residential(usage), "non_residential_usage_purpose"),
            F.when(F.coalesce("official_area", F.lit(0.0)) == 0, "missing_official_area"),
            F.when(F.col("confidence_score") < LOW_CONFIDENCE, "low_confidence_match"),
        )
    )


def id_candidates(address_id: Column, identification: Column) -> Column:
    """Ids to try in the tax register, in order: digits with a leading zero, other digits, else the rest."""
    parts = F.transform(F.split(F.coalesce(identification, F.lit("")), "-"), lambda p: strip(p))
    every = F.array_distinct(F.filter(F.concat(F.array(strip(F.coalesce(address_id, F.lit("")))), parts), lambda p: p != ""))
    digits = F.filter(every, lambda p: p.rlike(r"^\d+$"))
    leading = F.filter(digits, lambda p: p.startswith("0"))
    ordered = F.concat(leading, F.filter(digits, lambda p: ~p.startswith("0")))
    return F.when(F.size(ordered) > 0, ordered).otherwise(every)


def tax_values(properties: DataFrame, values: DataFrame, key: str = "property_id") -> DataFrame:
    """Tax value per property from ``values`` (address_id, woz_object_number, valuation_date, value).

    The first candidate id that has a record counts; its newest value is the latest, and history is kept
    as first year, last year and number of values (one row per value is in ``values`` itself).
    """
    # Candidates are a short list per property; each becomes a row for the equi-join.
    tried = properties.select(
        key, F.posexplode(id_candidates(F.col("address_id"), F.col("identification"))).alias("pos", "candidate_id")
    )
    rolled = values.groupBy("address_id").agg(
        F.max("woz_object_number").alias("woz_object_number"),
        F.max_by("value", "valuation_date").alias("latest_woz_value"),
        F.year(F.max("valuation_date")).alias("woz_valuation_year"),
        F.year(F.min("valuation_date")).alias("first_valuation_year"),
        F.count("value").alias("value_count"),
    )
    hits = tried.join(rolled.withColumnRenamed("address_id", "candidate_id"), "candidate_id")
    chosen = hits.groupBy(key).agg(
        F.min_by(
            F.struct("candidate_id", "woz_object_number", "latest_woz_value", "woz_valuation_year", "first_valuation_year", "value_count"),
            "pos",
        ).alias("w")
    )
    had = F.size(id_candidates(F.col("address_id"), F.col("identification"))) > 0
    joined = properties.join(chosen, key, "left").withColumn("_had", had)
    trust = (
        F.when(F.col("w.latest_woz_value").isNotNull(), WOZ_WITH_VALUE)
        .when(F.col("w.candidate_id").isNotNull(), WOZ_WITHOUT_VALUE)
        .when(F.col("_had"), WOZ_NO_RECORD)
        .otherwise(WOZ_NO_CANDIDATE)
    )
    return joined.withColumn("woz_confidence", trust).select(*properties.columns, "w.*", "woz_confidence")


def register_snapshot(matched: DataFrame, taxed: DataFrame, key: str = "property_id") -> DataFrame:
    """Address match and tax value as one row per property: the official value first, the tax register's
    as fallback; a missing side gives NULLs and flags."""
    tax = taxed.select(key, "woz_object_number", "latest_woz_value", "woz_valuation_year", "woz_confidence", "tax_building_year", "tax_area")
    joined = matched.join(tax, key, "left")
    return joined.select(
        key,
        F.col("address_id").alias("bag_address_id"),
        F.col("object_id").alias("bag_id"),
        F.coalesce(F.nullif("official_year", F.lit(0)), "tax_building_year").alias("bag_building_year"),
        F.coalesce(F.nullif("official_area", F.lit(0.0)), "tax_area").alias("bag_official_floor_area_m2"),
        text_or_null("usage_purpose").alias("bag_usage_purpose"),
        "woz_object_number",
        "latest_woz_value",
        "woz_valuation_year",
        F.least("confidence_score", F.coalesce("woz_confidence", F.lit(0))).alias("confidence_score"),
        F.when(F.col("record_count") == 0, F.array(*[F.lit(f) for f in NOT_FOUND_FLAGS])).otherwise(F.col("quality_flags")).alias("quality_flags"),
    )


def area_metrics(df: DataFrame) -> DataFrame:
    """Which area counts, how far the two areas differ, and prices per m².

    Needs ``surface_m2``, ``official_area``, ``usage_purpose``, ``confidence_score``, ``asking_price``,
    ``latest_woz_value`` and ``quality_flags``.
    """
    official = F.nullif("official_area", F.lit(0.0))
    use = residential(F.col("usage_purpose")) & (F.col("confidence_score") >= LOW_CONFIDENCE) & official.isNotNull()
    sized = df.withColumns(
        {
            "calculation_area_m2": F.when(use, official).otherwise(F.col("surface_m2")),
            "calculation_area_source": F.when(F.coalesce(use, F.lit(False)), "BAG").otherwise("Funda"),
            "living_area_difference_m2": F.round(F.nullif("surface_m2", F.lit(0.0)) - official, 2),
        }
    ).withColumn(
        "living_area_difference_percentage",
        F.round(finance.ratio("living_area_difference_m2", official) * 100.0, 2),
    )
    gap = F.abs("living_area_difference_percentage") > AREA_GAP_PCT
    return sized.withColumns(
        {
            "asking_price_per_m2": F.round(finance.ratio("asking_price", "calculation_area_m2"), 2),
            "woz_value_per_m2": F.round(finance.ratio("latest_woz_value", "calculation_area_m2"), 2),
            "quality_flags": F.when(gap, F.array_union("quality_flags", F.array(F.lit(AREA_GAP_FLAG)))).otherwise(
                F.col("quality_flags")
            ),
        }
    )
