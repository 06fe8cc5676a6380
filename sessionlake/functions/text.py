"""Scalar text functions as Column expressions; all stay on the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import rules as R

SPACES = R.java(r"\s+")
NEVER = r"\A(?!)"


def matches(text: Column, pattern: str) -> Column:
    return text.rlike(R.java(pattern))


def redact(text: Column) -> Column:
    """All redaction rules in their fixed order.

    A rule whose hints the text lacks gets a pattern that fails at once; markers never add a hint that matters, as
    they follow an underscore and the rules begin at a word."""
    low, out = F.lower(text), text
    for (pattern, marker), hints in zip(R.REDACTIONS, R.REDACTION_HINTS, strict=True):
        may = F.contains(low, F.lit(hints[0]))
        for h in hints[1:]:
            may = may | F.contains(low, F.lit(h))
        out = F.regexp_replace(out, F.when(may, F.lit(R.java(pattern))).otherwise(F.lit(NEVER)), F.lit(marker))
    return out


def trim(text: Column) -> Column:
    return F.regexp_replace(text, rf"\A{SPACES}|{SPACES}\z", "")


def snippet(text: Column, length: int = 220) -> Column:
    clean = F.array(trim(F.regexp_replace(redact(text), SPACES, " ")))
    # inside transform the text is made once, however often it is named
    return F.transform(clean, lambda c: F.when(F.length(c) > length, F.concat(F.substring(c, 1, length - 1), F.lit("…"))).otherwise(c))[0]


def terms(text: Column, n: int = 12) -> Column:
    stop = F.array(*map(F.lit, R.STOP_WORDS))
    found = F.regexp_extract_all(F.lower(text), F.lit("[a-z][a-z0-9_-]{3,}"), F.lit(0))
    return F.slice(F.array_distinct(F.filter(found, lambda x: ~F.array_contains(stop, x))), 1, n)


def named(text: Column, table: list) -> Column:
    """Names of the patterns that match, in the table's order."""
    return F.array_compact(F.array(*(F.when(matches(text, row[-1]), F.lit(row[0])) for row in table)))


def categories(text: Column) -> Column:
    return named(text, R.PROBLEM_CATEGORIES)


def signals(text: Column) -> Column:
    return named(text, R.SIGNALS)


def signal(text: Column) -> Column:
    """success, failure or unknown."""
    good, bad = matches(text, R.SUCCESS), matches(text, R.FAILURE)
    return F.when(matches(text, R.STRONG_SUCCESS), "success").when(bad & ~good, "failure").when(good & ~bad, "success").otherwise("unknown")


def pointer(conversation: Column, turn: Column) -> Column:
    return F.concat(F.lit(f"{R.POINTER_SCHEME}://conversation/"), conversation, F.lit("/turn/"), turn.cast("string"))


def half_up(value: Column, places: int = 4) -> Column:
    """Rounding half towards plus infinity."""
    k = 10.0**places
    return F.floor(value * k + 0.5) / k


def wilson(hits: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """95 % score interval of a share; null without observations."""
    n = F.when(n > 0, n.cast("double"))
    p = hits / n
    mid, low = p + z * z / (2 * n), 1 + z * z / n
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    return (mid - half) / low, (mid + half) / low


def domain(value: Column) -> Column:
    """Null and blank domains count as coding."""
    return F.lower(F.coalesce(F.nullif(F.trim(value), F.lit("")), F.lit("coding")))
