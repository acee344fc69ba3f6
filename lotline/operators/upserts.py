"""Applying a log of feature changes to a feature table.

Features are ``(id, geometry STRING, properties)``. ``id`` may have any type that can be a key, and
``properties`` is an open bag: a VARIANT object, or a map from names to texts, variants or any other type.
Members keep their types; nothing goes through text. Changes are rows

    ord, op, id, geometry, properties, remove_properties ARRAY<STRING>, remove_all_properties

with ``op`` one of ``remove_all``, ``remove``, ``add`` and ``update``. They take effect in that
order whatever their place in the log; of several adds or updates of one id the last counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DataType, MapType, VariantType


def change_schema(id: str = "bigint", properties: str = "map<string,string>") -> str:
    """The schema of a change log for a type of ids and of property bags."""
    return (
        f"ord bigint, op string, id {id}, geometry string, properties {properties}, "
        "remove_properties array<string>, remove_all_properties boolean"
    )


CHANGE_SCHEMA = change_schema()


def _last(op: str, *columns: str) -> Column:
    """The last change of one kind, NULL when there is none."""
    return F.max_by(F.struct(*columns), F.when(F.col("op") == op, F.col("ord"))).alias(op)


def _as_map(kind: DataType) -> str:
    """The type of map that bags of a type are edited as."""
    if isinstance(kind, VariantType):
        return "map<string,variant>"
    if not isinstance(kind, MapType):
        raise ValueError(f"Properties are a VARIANT or a map, not {kind.simpleString()}")
    return kind.simpleString()


def _edited(properties: Column, kind: str) -> Column:
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array()).cast(kind)
    dropped = F.coalesce(F.col("update.remove_properties"), F.array().cast("array<string>"))
    added = F.coalesce(F.col("update.properties"), empty)
    # A later map wins, but map_concat refuses equal keys: drop those that are set anyway.
    kept = F.map_filter(
        F.coalesce(properties, empty),
        lambda k, _: ~F.array_contains(dropped, k) & ~F.map_contains_key(added, k),
    )
    return F.when(F.coalesce("update.remove_all_properties", F.lit(False)), empty).otherwise(F.map_concat(kept, added))


def apply_feature_diff(base: DataFrame, changes: DataFrame) -> DataFrame:
    """The feature table after the changes, with the types of ``base``; one shuffle of each side on the id.

    Ids of ``base`` are unique. The log is combined per id before it is shuffled, so an id that is
    changed very often does no harm.
    """
    kind = base.schema["properties"].dataType
    as_map = _as_map(kind)
    per_id = (
        changes.filter("op <> 'remove_all' and id is not null")
        .withColumn("properties", F.col("properties").cast(as_map))
        .groupBy(F.col("id").cast(base.schema["id"].dataType).alias("id"))
        .agg(
            F.bool_or(F.col("op") == "remove").alias("removed"),
            _last("add", "geometry", "properties"),
            _last("update", "geometry", "properties", "remove_properties", "remove_all_properties"),
        )
    )
    cleared = changes.filter("op = 'remove_all'").agg(F.count(F.lit(1))).scalar() > 0
    bag = F.col("properties").cast(as_map).alias("properties")
    stored = base.select("id", F.struct("geometry", bag).alias("old")).filter(~cleared)
    survives = F.col("old").isNotNull() & ~F.coalesce("removed", F.lit(False))
    changed = F.when(F.col("update").isNull(), F.col("now.properties")).otherwise(_edited(F.col("now.properties"), as_map))
    return (
        stored.join(per_id, "id", "full")
        .withColumn("now", F.coalesce("add", F.when(survives, F.col("old"))))
        .filter("now is not null")
        .select(
            "id",
            F.coalesce("update.geometry", "now.geometry").alias("geometry"),
            (F.to_variant_object(changed) if isinstance(kind, VariantType) else changed).alias("properties"),
        )
    )
