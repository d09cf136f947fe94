"""Column expressions shared by the reports. All are built-in functions, safe under ANSI mode."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def bucketize(rules: Iterable[tuple[Column, str]], otherwise: str | None) -> Column:
    """The label of the first predicate that holds."""
    out = None
    for predicate, label in rules:
        out = F.when(predicate, F.lit(label)) if out is None else out.when(predicate, F.lit(label))
    return out.otherwise(F.lit(otherwise))


def at_least(c: Column | str, steps: Iterable[tuple[float, str]], otherwise: str | None) -> Column:
    """Labels by descending lower bounds."""
    return bucketize([(_col(c) >= low, label) for low, label in steps], otherwise)


def above(c: Column | str, steps: Iterable[tuple[float, str]], otherwise: str | None) -> Column:
    """Labels by descending exclusive lower bounds."""
    return bucketize([(_col(c) > low, label) for low, label in steps], otherwise)


def pct_change(now: Column | str, before: Column | str, digits: int = 1) -> Column:
    """Percent change, or null where there is nothing or zero to compare with."""
    now, before = _col(now), _col(before)
    return F.round(F.try_divide((now - before) * F.lit(100.0), before), digits)


def ratio(a: Column | str, b: Column | str) -> Column:
    """a / b, or null where b is zero."""
    return F.try_divide(_col(a).cast("double"), _col(b).cast("double"))


def count_text(c: Column | str) -> Column:
    """The number in a text such as '1,234 views', or null."""
    return F.regexp_replace(_col(c), "[^0-9]", "").try_cast("bigint")


def duration_seconds(c: Column | str) -> Column:
    """Seconds of 'm:s' or 'h:m:s', and 0 for any other text."""
    c = _col(c)
    part = lambda i: F.get(F.split(c, ":"), F.lit(i)).try_cast("bigint")
    return F.when(c.rlike(r"^\d+:\d+:\d+$"), part(0) * 3600 + part(1) * 60 + part(2)).when(c.rlike(r"^\d+:\d+$"), part(0) * 60 + part(1)).otherwise(F.lit(0).cast("bigint"))


def ellipsis(c: Column | str, most: int = 100) -> Column:
    """Texts over ``most`` characters cut, with three dots at the end."""
    c = _col(c)
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most - 3), F.lit("..."))).otherwise(c)


def clean_title(c: Column | str, most: int = 100) -> Column:
    """Printable ASCII alone, trimmed, cut, with single spaces."""
    return F.regexp_replace(ellipsis(F.trim(F.regexp_replace(_col(c), r"[^\x20-\x7E]", "")), most), r"\s+", " ")


def clean_tags(c: Column | str, blank: str = "uncategorized", empty: str = "unknown", strip_quotes: bool = False) -> Column:
    """Pipe-separated text as a list that is never empty."""
    c = _col(c)
    text = F.regexp_replace(c, '"', "") if strip_quotes else c
    parts = F.filter(F.split(F.regexp_replace(F.trim(text), r"\|+", "|"), r"\|"), lambda x: F.trim(x) != "")
    return F.when(c.isNull() | (F.trim(c) == ""), F.array(F.lit(blank))).when(F.size(parts) == 0, F.array(F.lit(empty))).otherwise(parts)


def any_of(words: Iterable[str], word_boundary: bool = False) -> str:
    """A pattern of alternatives, inside words unless boundaries are asked for."""
    body = "|".join(words)
    return rf"\b(?:{body})\b" if word_boundary else f"(?:{body})"


def lexicon_tags(c: Column | str, lexicon: Mapping[str, Iterable[str]], word_boundary: bool = False) -> Column:
    """The labels whose words occur in the lower-cased text."""
    low = F.lower(_col(c))
    return F.array_compact(F.array(*[F.when(low.rlike(any_of(words, word_boundary)), F.lit(label)) for label, words in lexicon.items()]))


def adjacent_pairs(c: Column | str) -> Column:
    """Structs (first, second) of neighbours in a list; none for shorter lists."""
    c = _col(c)
    n = F.coalesce(F.size(c), F.lit(0))
    return F.transform(F.slice(c, 1, F.greatest(n - 1, F.lit(0))), lambda x, i: F.struct(x.alias("first"), F.get(c, i + 1).alias("second")))


def description_bucket(c: Column | str) -> Column:
    """Length classes of descriptions; null is in the longest, as unknown."""
    return length_bucket(F.length(_col(c)))


def length_bucket(n: Column) -> Column:
    """``description_bucket`` by the length."""
    steps = ((100, "Very Short"), (300, "Short"), (1000, "Medium"), (2000, "Long"))
    return bucketize([(n == 0, "No Description"), *((n < most, label) for most, label in steps)], "Very Long")
