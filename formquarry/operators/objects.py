"""Attributes and reference types of owner objects.

Each header is decoded once, in Arrow batches to typed rows; everything after that is relational. NULL, broken and
unknown headers give one row with an error code in ``decode_objects`` and no attributes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formquarry.decoders import owner
from formquarry.functions import domain as D
from formquarry.operators.dedup import keep_first
from formquarry.session import arrow_function

_ATTRIBUTE = "struct<section_ord:int,section_uuid:string,section_name:string,section_synonym:string,attr_ord:int,uuid:string,name:string,type:string,synonym:string>"
_DECODED = f"struct<error:string,warnings:array<string>,rows:array<{_ATTRIBUTE}>,identity:array<string>>"


def _decode(text: str | None, wrapped: bool) -> dict:
    found = owner.decode(text, wrapped)
    rows = [{"attr_ord": i, **a._asdict()} for i, a in enumerate(found.attributes)]
    for n, s in enumerate(found.sections):
        section = {"section_ord": n, "section_uuid": s.uuid, "section_name": s.name, "section_synonym": s.synonym}
        rows += [section | {"attr_ord": i, **c._asdict()} for i, c in enumerate(s.columns)] or [section]
    return {"error": found.error, "warnings": found.warnings, "rows": rows, "identity": owner.identity(text, wrapped)}


def decode_objects(objects: DataFrame, text: str, wrapped: bool = True) -> DataFrame:
    """``objects`` with a column ``decoded``: error code, warnings, attribute rows, identity UUIDs."""

    def decode(text: str | None) -> dict:
        return _decode(text, wrapped)

    return objects.withColumn("decoded", arrow_function(decode, _DECODED)(F.col(text)))


def object_attributes(decoded: DataFrame, key: list[str]) -> DataFrame:
    """One row per attribute, with its section if it is a column (NULL at the top level); sections without columns have no row."""
    return decoded.select(*key, F.inline("decoded.rows")).where("uuid IS NOT NULL")


def attribute_names(attributes: DataFrame, key: list[str]) -> DataFrame:
    """(key, names map<uuid, name>): top-level attributes before columns, the first of a UUID counts.

    A map has the attributes of one object, which its own header bounds.
    """
    known = attributes.where("uuid != '' AND name != ''").select(*key, "uuid", "name", F.coalesce("section_ord", F.lit(-1)).alias("s"), "attr_ord")
    first = keep_first(known, [*key, "uuid"], ["s", "attr_ord"])
    return first.groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct("uuid", "name"))).alias("names"))


def reference_types(decoded: DataFrame, order: list[str], keys: list[str] | None = None) -> DataFrame:
    """(keys..., uuid, type_name) of the identity blocks of types that have references; per key and UUID the first by ``order`` counts."""
    keys = keys or []
    prefixes = F.create_map(*[F.lit(x) for pair in D.REFERENCE_TYPE_PREFIXES.items() for x in pair])
    typed = decoded.withColumn("prefix", F.try_element_at(prefixes, F.col("object_type"))).where("prefix IS NOT NULL")
    rows = typed.select(*keys, *order, F.concat_ws(".", "prefix", "object_name").alias("type_name"), F.explode("decoded.identity").alias("uuid"))
    return keep_first(rows, [*keys, "uuid"], order).select(*keys, "uuid", "type_name")


def reference_conflicts(decoded: DataFrame, order: list[str], keys: list[str] | None = None) -> DataFrame:
    """(keys..., uuid, kept, skipped): UUIDs that several types claim."""
    keys = keys or []
    prefixes = F.create_map(*[F.lit(x) for pair in D.REFERENCE_TYPE_PREFIXES.items() for x in pair])
    typed = decoded.withColumn("prefix", F.try_element_at(prefixes, F.col("object_type"))).where("prefix IS NOT NULL")
    rows = typed.select(*keys, F.concat_ws(".", "prefix", "object_name").alias("skipped"), F.explode("decoded.identity").alias("uuid")).distinct()
    kept = reference_types(decoded, order, keys).select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("uuid").alias("__uuid"), F.col("type_name").alias("kept"))
    same = F.col("uuid") == F.col("__uuid")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return rows.join(kept, same).where("skipped != kept").select(*keys, "uuid", "kept", "skipped")


def resolve_types(attributes: DataFrame, types: DataFrame, keys: list[str] | None = None, column: str = "type") -> DataFrame:
    """``attributes`` with ``Ref#<uuid>`` replaced by the type's name where one is known; all else stays as it is.

    ``types`` has (keys..., uuid, type_name), a UUID once; empty names are no names.
    """
    keys = keys or []
    uuid = F.when(F.col(column).startswith(D.REFERENCE_MARK), F.lower(F.substring(column, len(D.REFERENCE_MARK) + 1, 1 << 20)))
    named = types.where("coalesce(type_name, '') != ''").select(*keys, F.lower("uuid").alias("__uuid"), F.col("type_name").alias("__name"))
    joined = attributes.withColumn("__uuid", uuid).join(named, [*keys, "__uuid"], "left")
    return joined.withColumn(column, F.coalesce("__name", column)).select(*attributes.columns)
