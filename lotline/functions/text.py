"""Identifier, address, year and display-text expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from lotline.functions.values import text_of, trim_all, truthy

# Fixed value: the earliest construction year that is accepted.
FIRST_VALID_YEAR = 1600


def _without_decimal_tail(text: Column) -> Column:
    return F.when(F.endswith(text, F.lit(".0")), F.substring(text, F.lit(1), F.length(text) - 2)).otherwise(text)


def normalize_id(value: Column, kind: str = "string") -> Column:
    """Join key: trimmed, one trailing ``.0`` dropped, upper case; NULL becomes ``''``.

    Not idempotent: ``1.0.0`` becomes ``1.0``.
    """
    return F.upper(_without_decimal_tail(trim_all(F.coalesce(text_of(value, kind), F.lit("")))))


def street_number(address: Column) -> Column:
    """Leading house number as DOUBLE; infinity when there is none, so that it sorts last."""
    digits = F.regexp_extract(trim_all(address), "^[0-9]+", 0)
    return F.coalesce(digits.try_cast("double"), F.lit(float("inf")))


def parse_year(value: Column, kind: str = "string") -> Column:
    """Year read leniently out of text; NULL when no leading number is left.

    Everything except digits and hyphens is deleted first, so ``c.1890`` is 1890 and
    ``1890.5`` is 18905.
    """
    text = _without_decimal_tail(trim_all(F.coalesce(text_of(value, kind), F.lit(""))))
    kept = F.regexp_replace(text, "[^0-9-]", "")
    return F.regexp_extract(kept, "^-?[0-9]+", 0).try_cast("bigint")


def year_of(value: Column, kind: str = "string") -> Column:
    """Parsed year of a present value; a falsy one has none."""
    return F.when(truthy(value, kind), parse_year(value, kind))


def is_valid_year(year: Column, as_of_year: int) -> Column:
    """Never NULL."""
    return F.coalesce(year.between(FIRST_VALID_YEAR, as_of_year), F.lit(False))


# Characters that display text may not contain, and their HTML entities.
HTML_ENTITIES = [
    ("&", "&amp;"),
    ("<", "&lt;"),
    (">", "&gt;"),
    ("'", "&#39;"),
    ('"', "&quot;"),
]


def escape_html(text: Column) -> Column:
    """``&`` has to come first: the other entities contain it."""
    for char, entity in HTML_ENTITIES:
        text = F.replace(text, F.lit(char), F.lit(entity))
    return text


def display_value(value: Column, kind: str = "string") -> Column:
    """Escaped text, or ``Unknown`` for null, blank and non-finite values."""
    text = text_of(value, kind)
    shown = trim_all(text) != ""
    if kind == "number":
        as_double = value.cast("double")
        shown = ~F.isnan(as_double) & (F.abs(as_double) != F.lit(float("inf")))
    return F.when(shown, escape_html(text)).otherwise("Unknown")
