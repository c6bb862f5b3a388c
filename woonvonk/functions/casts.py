"""Lenient casts: blank means missing, a bad value means missing, NaN means missing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(value: str | Column) -> Column:
    return F.col(value) if isinstance(value, str) else value


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


# What Python's ``str.strip`` and ``\\s`` take as white space.
BLANKS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
BLANK_CLASS = "\\t-\\r\\x1C-\\x20\\x85\\xA0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000"


def strip(value: str | Column) -> Column:
    """Without white space at both ends, as Python has it: tabs, line ends and no-break blanks too."""
    return F.btrim(col(value), F.lit(BLANKS))


def rx(pattern: str) -> str:
    """A pattern whose ``\\s`` covers the white space that Python's does."""
    out, inside, k = [], False, 0
    while k < len(pattern):
        two = pattern[k : k + 2]
        if two == "\\s":
            out.append(BLANK_CLASS if inside else f"[{BLANK_CLASS}]")
        elif two[0] == "\\":
            out.append(two)
        else:
            inside = two[0] == "[" or (inside and two[0] != "]")
            out.append(two[0])
            k -= 1
        k += 2
    return "".join(out)


def text_or_null(value: str | Column) -> Column:
    """Trimmed text, NULL when blank."""
    return F.nullif(strip(col(value).cast("string")), F.lit(""))


def to_double(value: str | Column) -> Column:
    number = strip(col(value).cast("string")).try_cast("double")
    return F.when(F.isnan(number), F.lit(None)).otherwise(number)


def to_int(value: str | Column) -> Column:
    """Truncates toward zero; text such as ``'3.7'`` gives 3."""
    return to_double(value).try_cast("int")


def first_digits(value: str | Column) -> Column:
    """First run of one to four digits in any text."""
    return F.regexp_extract(col(value).cast("string"), r"(\d{1,4})", 1).try_cast("int")


def clamp_score(value: Column) -> Column:
    """Half-even rounding to an integer in 0..100; NULL stays NULL."""
    whole = F.bround(value).cast("int")
    return F.when(whole < 0, 0).when(whole > 100, 100).otherwise(whole)


def clamped(value: Column, low: float, high: float) -> Column:
    """Within the bounds; NULL stays NULL (``least`` and ``greatest`` would skip it)."""
    return F.when(value < low, low).when(value > high, high).otherwise(value)


def non_zero(value: str | Column) -> Column:
    """NULL for 0, for fall-through chains that treat 0 as absent."""
    return F.nullif(col(value), F.lit(0))


# Words read as true and as false.
TRUE_WORDS = ["1", "true", "yes", "ja", "enabled", "on"]
FALSE_WORDS = ["0", "false", "no", "nee", "disabled", "off"]


def to_bool(value: str | Column, default: bool) -> Column:
    word = F.lower(strip(col(value).cast("string")))
    number = word.try_cast("double")
    return (
        F.when(word.isin(TRUE_WORDS), True)
        .when(word.isin(FALSE_WORDS), False)
        .when(number.isNotNull(), number != 0)
        .otherwise(F.lit(default))
    )


def to_string_array(value: str | Column) -> Column:
    """Trimmed, non-blank items of an array; a scalar becomes a one-element array."""
    items = col(value)
    return F.filter(F.transform(items, lambda x: strip(x.cast("string"))), lambda x: x != "")


def first_filled(*candidates: str | Column) -> Column:
    """First candidate that is neither NULL nor blank, as text."""
    return F.coalesce(*[F.when(col(c).cast("string") != "", col(c).cast("string")) for c in candidates])


def code_or(value: str | Column, allowed: list[str], fallback: str = "unknown") -> Column:
    """Keep a code of the allowed set, otherwise the fallback."""
    return F.when(col(value).isin(allowed), col(value)).otherwise(F.lit(fallback))
