"""Quality rules as a bitmask ledger: measure once, judge by versioned policies.

``ledger`` evaluates every rule once per row and stores the measurements and one bit per failed rule. A policy is a
mask over those bits, so a new policy, or the effect of leaving a rule out, needs no second look at the texts.
Only built-in column functions are used; every row is worked on alone, so there is no shuffle.

Null texts have no words. Repeated rows are judged each. Other columns of the input are kept; a measurement replaces
an input column of the same name.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from woonvonk.llm.common import table

SPACES = " \t\n\x0b\f\r"
WORD_BREAK = "[\\x20\\x09-\\x0D]+"
SYMBOLS = "#*$%&|<>"
WINDOW = 5

MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_exclamations", "n_stutters"]

# In bit order; never reorder, only append, so that stored ledgers stay readable.
RULES: dict[str, str] = {
    "few_words": "n_words < 10",
    "repeated_windows": "100 * n_repeat_words > 20 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "shouting": "10 * n_upper > 3 * n_letters",
    "exclamations": "10 * n_exclamations > n_words",
    "repeated_lines": "2 * n_dup_lines > n_lines",
    "stutter": "10 * n_stutters > 3 * n_words",
    "word_length": "word_chars > 20 * n_words OR word_chars < 2 * n_words",
}

POLICIES: dict[str, list[str]] = {
    "base": ["few_words", "repeated_windows"],
    "v1": ["few_words", "repeated_windows", "symbols"],
    "v2": list(RULES),
}


def staged(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``value`` as a column that later steps read instead of working it out again (a one-element explode)."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with all measurements, as longs."""
    keep = [c for c in docs.columns if c not in MEASURES]
    body = docs.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("__t"))
    t = F.col("__t")
    removed = lambda chars: F.length(t) - F.length(F.translate(t, chars, ""))
    lines = F.filter(F.split(t, "\n"), lambda x: F.length(F.btrim(x, F.lit(SPACES))) > 0)
    body = staged(body, "__lines", lines)
    body = body.select(
        *keep,
        "__t",
        (F.length(t) - removed(SPACES)).cast("long").alias("word_chars"),
        removed(SYMBOLS).cast("long").alias("n_symbols"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        F.size("__lines").cast("long").alias("n_lines"),
        F.regexp_count(t, F.lit("\\p{Lu}")).cast("long").alias("n_upper"),
        F.regexp_count(t, F.lit("\\p{L}")).cast("long").alias("n_letters"),
        removed("!").cast("long").alias("n_exclamations"),
    )
    done = [*keep, "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_upper", "n_letters", "n_exclamations"]
    trimmed = F.btrim(t, F.lit(SPACES))
    body = staged(body, "__w", F.when(F.length(trimmed) == 0, F.array().cast("array<string>")).otherwise(F.split(trimmed, WORD_BREAK)))
    w = F.col("__w")
    windows = F.when(
        F.size(w) >= WINDOW,
        F.transform(F.sequence(F.lit(0), F.size(w) - WINDOW), lambda i: F.xxhash64(*[w[i + k] for k in range(WINDOW)])),
    ).otherwise(F.array().cast("array<bigint>"))
    stutters = F.size(F.filter(F.zip_with(w, F.slice(w, 2, F.greatest(F.size(w), F.lit(1))), lambda a, b: a == b), lambda x: x))
    body = staged(
        body.select(*done, F.size(w).cast("long").alias("n_words"), stutters.cast("long").alias("n_stutters"), "__w"), "__h", windows
    ).drop("__w")
    done += ["n_words", "n_stutters"]
    h = F.col("__h")
    # (hash, place) sorted, so equal windows stand next to each other; most texts have none and skip it
    ordered = F.when(
        F.size(F.array_distinct(h)) < F.size(h),
        F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))),
    ).otherwise(F.array().cast("array<struct<h:bigint,i:int>>"))
    body = staged(body, "__s", ordered).drop("__h")
    s = F.col("__s")
    after = lambda x: F.slice(x, 2, F.greatest(F.size(x), F.lit(1)))
    twice = F.flatten(
        F.zip_with(s, after(s), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])).otherwise(F.array().cast("array<int>")))
    )
    body = staged(body, "__p", F.sort_array(F.array_distinct(twice))).drop("__s")
    p = F.col("__p")
    covered = F.aggregate(
        F.zip_with(p, after(p), lambda a, b: F.least(F.lit(WINDOW), F.coalesce(b - a, F.lit(WINDOW)))),
        F.lit(0).cast("long"),
        lambda total, x: total + x,
    )
    return body.select(*done, covered.alias("n_repeat_words"))


def ledger(docs: DataFrame, text: str = "text", rules: Mapping[str, str] = RULES) -> DataFrame:
    """Measurements and ``failed_bits``: bit k is set where the k-th rule rejects the row."""
    bits = [F.when(F.expr(rule), F.lit(1 << k)).otherwise(F.lit(0)).cast("long") for k, rule in enumerate(rules.values())]
    total = bits[0]
    for bit in bits[1:]:
        total = total.bitwiseOR(bit)
    return measure(docs, text).withColumn("failed_bits", total)


def mask(policy: str, rules: Mapping[str, str] = RULES, policies: Mapping[str, list[str]] = POLICIES) -> int:
    names = list(rules)
    return sum(1 << names.index(name) for name in policies[policy])


def judged(rows: DataFrame, policy: str) -> Column:
    """Whether a ledger row passes a policy."""
    return F.col("failed_bits").bitwiseAND(F.lit(mask(policy))) == 0


def ablation(rows: DataFrame, policy: str) -> DataFrame:
    """Per rule of a policy: rows it rejects, and rows that only it rejects (they come back when it is left out).

    Rows are first counted per pattern of bits, on the map side; at most 2^rules patterns are left.
    """
    m, names = mask(policy), list(RULES)
    patterns = rows.groupBy(F.col("failed_bits").bitwiseAND(F.lit(m)).alias("bits")).agg(F.count("*").alias("n"))
    per_rule = [
        F.struct(F.lit(r).alias("rule"), F.lit(1 << names.index(r)).cast("long").alias("bit")) for r in POLICIES[policy]
    ]
    return (
        patterns.select("bits", "n", F.explode(F.array(*per_rule)).alias("r"))
        .where(F.col("bits").bitwiseAND(F.col("r.bit")) != 0)
        .groupBy(F.col("r.rule").alias("rule"))
        .agg(
            F.sum("n").alias("n_failed"),
            F.sum(F.when(F.col("bits") == F.col("r.bit"), F.col("n")).otherwise(0)).alias("n_only"),
            F.bit_or("bits").alias("fails_with"),
        )
    )


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ledger(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (~judged(rows, "base")).alias("base_failed"),
        judged(rows, "v2").alias("kept"),
        "failed_bits",
    )


OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM documents),
wins AS (
  SELECT doc_id, unnest(range(1, greatest(len(ws) - 3, 1))) AS i,
    unnest(list_transform(range(1, greatest(len(ws) - 3, 1)), lambda j: ws[j:j + 4])) AS win FROM d),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS n FROM wins) WHERE n > 1),
rep AS (
  SELECT doc_id, sum(least(5, coalesce(nxt - i, 5))) AS n
  FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM twice) GROUP BY doc_id),
m AS (
  SELECT d.doc_id, len(ws) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
    len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, len(ls) AS n_lines,
    length(regexp_replace(t, '[^\p{Lu}]', '', 'g')) AS n_upper, length(regexp_replace(t, '[^\p{L}]', '', 'g')) AS n_letters,
    length(regexp_replace(t, '[^!]', '', 'g')) AS n_exclamations,
    len(list_filter(range(2, len(ws) + 1), lambda j: ws[j] = ws[j - 1])) AS n_stutters
  FROM d LEFT JOIN rep ON rep.doc_id = d.doc_id),
f AS (
  SELECT *, cast(
    (n_words < 10)::int * 1 + (100 * n_repeat_words > 20 * n_words)::int * 2 + (10 * n_symbols > n_words)::int * 4
    + (10 * n_upper > 3 * n_letters)::int * 8 + (10 * n_exclamations > n_words)::int * 16
    + (2 * n_dup_lines > n_lines)::int * 32 + (10 * n_stutters > 3 * n_words)::int * 64
    + (word_chars > 20 * n_words OR word_chars < 2 * n_words)::int * 128 AS bigint) AS failed_bits FROM m)
SELECT doc_id, cast(n_words AS bigint) AS n_words, cast(word_chars AS bigint) AS word_chars,
  cast(n_symbols AS bigint) AS n_symbols, cast(n_dup_lines AS bigint) AS n_dup_lines,
  cast(n_repeat_words AS bigint) AS n_repeat_words,
  n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, failed_bits = 0 AS kept, failed_bits
FROM f"""
