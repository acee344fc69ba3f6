"""Column helpers for loosely typed values.

Property bags hold strings, numbers, booleans and nulls side by side. The helpers
below say what counts as "present" and how a value reads as text. ``kind`` names the
static type of a column: ``string``, ``number`` or ``boolean``. Values of property bags are read
with :mod:`lotline.operators.bags`.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

# The characters that count as white space at the ends of a value.
WHITE_SPACE = (
    "\t\n\u000b\f\r \u00a0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000\ufeff"
)


def trim_all(text: Column) -> Column:
    """Strip every kind of Unicode white space, not only U+0020."""
    return F.trim(text, F.lit(WHITE_SPACE))


def bag_value(bag: Column, key: str) -> Column:
    """The value under exactly ``key`` (case-sensitive) in a VARIANT object, as VARIANT."""
    quoted = key.replace("\\", "\\\\").replace('"', '\\"')
    return F.try_variant_get(bag, f'$["{quoted}"]', "variant")


def bag_has(keys: Column, key: str) -> Column:
    """Whether ``key`` is among the object's own keys, even with a null value."""
    return F.array_contains(keys, F.lit(key))


def number_text(number: Column) -> Column:
    """Plain text of a number: no trailing ``.0`` and no exponent."""
    as_double = number.cast("double")
    plain = as_double.cast("string").try_cast("decimal(38,18)").cast("string")
    return F.when(
        (as_double == F.floor(as_double)) & (F.abs(as_double) < F.lit(1e15)),
        as_double.cast("bigint").cast("string"),
    ).otherwise(F.coalesce(F.regexp_replace(plain, "0+$", ""), as_double.cast("string")))


def text_of(value: Column, kind: str = "string") -> Column:
    """How a value reads when it is turned into text; NULL stays NULL."""
    if kind == "string":
        return value
    if kind == "number":
        return number_text(value)
    return value.cast("string")


def truthy(value: Column, kind: str = "string") -> Column:
    """False for null, ``''``, 0, NaN and false; true for anything else. Never NULL."""
    if kind == "string":
        test = value != ""
    elif kind == "number":
        test = (value != 0) & ~F.isnan(value.cast("double"))
    else:
        test = value
    return F.coalesce(test, F.lit(False))


def truthy_coalesce(*values: Column, kind: str = "string") -> Column:
    """First truthy value; when there is none, the *last* value, whatever it is."""
    *head, last = values
    return reduce(lambda rest, v: F.when(truthy(v, kind), v).otherwise(rest), reversed(head), last)


def truthy_text(*values: Column, kind: str = "string") -> Column:
    """Text of the first truthy value, NULL when there is none."""
    return F.coalesce(*[F.when(truthy(v, kind), text_of(v, kind)) for v in values])
