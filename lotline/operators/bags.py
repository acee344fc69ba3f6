"""Reading values out of property bags.

A bag is a VARIANT object whose values may have any JSON type. :func:`read_bag` takes what is needed
of it apart in steps that are columns of their own, so each value is read once per row.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from lotline.functions.values import bag_value, number_text

NUMBER = "number"
OBJECT = "object"


@dataclass(frozen=True)
class BagValue:
    """Columns that describe one value of a bag.

    ``kind``    ``string``, ``boolean``, ``number`` or ``object`` (arrays too); NULL when the value
                is null or its key absent
    ``text``    how it reads as text
    ``truthy``  false for null, ``''``, 0 and false; never NULL
    """

    kind: Column
    text: Column
    truthy: Column


def read_bag(df: DataFrame, keys: list[str], bag: str = "properties") -> tuple[DataFrame, dict[str, BagValue]]:
    """``df`` with helper columns, and the values of the given keys (case-sensitive)."""
    names = {key: f"_bag{i}" for i, key in enumerate(dict.fromkeys(keys))}
    values = df.withColumns({f"{n}_value": bag_value(F.col(bag), key) for key, n in names.items()})
    typed = values.withColumns({f"{n}_type": F.schema_of_variant(f"{n}_value") for n in names.values()})
    read = typed.withColumns({f"{n}_raw": _raw(F.col(f"{n}_type"), F.col(f"{n}_value")) for n in names.values()})
    # Numbers have a step of their own: written out at each use they make code too long to be compiled.
    numbered = read.drop(*[f"{n}_value" for n in names.values()]).withColumns(
        {f"{n}_number": _float(F.col(f"{n}_type"), F.col(f"{n}_raw")) for n in names.values()}
    )
    described = numbered.withColumns(
        {f"{n}_kind": _kind(F.col(f"{n}_type")) for n in names.values()}
        | {f"{n}_text": _text(F.col(f"{n}_number"), F.col(f"{n}_raw")) for n in names.values()}
    ).drop(*[f"{n}_{part}" for n in names.values() for part in ("type", "raw", "number")])
    return described, {
        key: BagValue(F.col(f"{n}_kind"), F.col(f"{n}_text"), _truthy(F.col(f"{n}_kind"), F.col(f"{n}_text")))
        for key, n in names.items()
    }


def _raw(type_name: Column, value: Column) -> Column:
    # Whole numbers come out of a VARIANT as they are; its cast to text sets up a conversion for every value.
    return F.when(type_name == "BIGINT", value.try_cast("bigint").cast("string")).otherwise(value.try_cast("string"))


def _kind(type_name: Column) -> Column:
    return (
        F.when(type_name == "STRING", "string")
        .when(type_name == "BOOLEAN", "boolean")
        .when(type_name.rlike("^(ARRAY|OBJECT)"), OBJECT)
        .when(type_name != "VOID", NUMBER)
    )


def _float(type_name: Column, raw: Column) -> Column:
    return F.when(type_name.isin("DOUBLE", "FLOAT"), raw.try_cast("double"))


def _text(number: Column, raw: Column) -> Column:
    # Only floating-point numbers are written in another way.
    return F.when(number.isNotNull(), number_text(number)).otherwise(raw)


def _truthy(kind: Column, text: Column) -> Column:
    falsy = (text == "") | ((kind == "boolean") & (text == "false")) | ((kind == NUMBER) & text.isin("0", "-0"))
    return F.when(kind == OBJECT, True).otherwise(F.coalesce(kind.isNotNull() & ~falsy, F.lit(False)))


def first_truthy(*values: BagValue) -> Column:
    """Text of the first truthy value, NULL when there is none."""
    return F.coalesce(*[F.when(v.truthy, v.text) for v in values])


def first_truthy_or_last(*values: BagValue) -> Column:
    """Text of the first truthy value; without one that of the last, whatever it is."""
    *head, last = values
    return F.coalesce(*[F.when(v.truthy, v.text) for v in head], last.text)


def first_present(*values: BagValue) -> BagValue:
    """The first value that is not null; its ``truthy`` is not meant to be used."""
    *head, last = values
    kind, text = last.kind, last.text
    for v in reversed(head):
        kind = F.when(v.kind.isNotNull(), v.kind).otherwise(kind)
        text = F.when(v.kind.isNotNull(), v.text).otherwise(text)
    return BagValue(kind, text, F.lit(None))
