"""Bindings: data paths resolved to attributes of the owner object.

Two segments name a top-level attribute, three a section and its column, anything else is not
resolved; the first segment plays no part. Names compare trimmed and ignoring case; the first
attribute of a name counts. NULL paths and NULL names are not resolved.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formquarry.operators.dedup import keep_first


def name_key(column: Column) -> Column:
    return F.lower(F.trim(column))


def resolve_paths(paths: DataFrame, attributes: DataFrame, owner: list[str], path: str = "data_path", order: str = "attr_ord") -> DataFrame:
    """``paths`` with attribute_name, value_type, synonym and resolved.

    ``attributes`` has the owner columns, section_name, name, type, synonym and the order. One
    attribute per name is picked before the join, so no path meets several.
    """
    parts = F.split(path, "[.]", -1)
    size = F.size(parts)
    section = F.when(size == 3, name_key(parts[1])).when(size == 2, "")
    attribute = F.when(size.isin(2, 3), name_key(F.try_element_at(parts, F.lit(-1))))
    named = attributes.select(*owner, F.coalesce(name_key(F.col("section_name")), F.lit("")).alias("__section"), name_key(F.col("name")).alias("__name"), F.col(order).alias("__ord"), F.col("type").alias("value_type"), "synonym")
    first = keep_first(named.where("__name IS NOT NULL"), [*owner, "__section", "__name"], ["__ord"]).withColumn("__hit", F.lit(True)).drop("__ord")
    joined = paths.withColumn("__section", section).withColumn("__name", attribute).join(first, [*owner, "__section", "__name"], "left")
    last = F.coalesce(F.try_element_at(parts, F.lit(-1)), F.col(path))
    return joined.select(*[F.col(f"`{c}`") for c in paths.columns], last.alias("attribute_name"), "value_type", "synonym", F.coalesce("__hit", F.lit(False)).alias("resolved"))


def unique_probe(mentions: DataFrame, attributes: DataFrame, owner: list[str], key: list[str], name: str = "element_name") -> DataFrame:
    """(key, attribute_name, candidates): the one attribute that an element's UUIDs name.

    ``mentions`` has (owner, key, element name, uuid). Several distinct names are ambiguous unless
    one of them is the element's own; ``candidates`` counts distinct names.
    """
    known = attributes.where("uuid IS NOT NULL AND uuid != ''").select(*owner, "uuid", F.col("name").alias("__attribute")).distinct()
    hits = mentions.join(known, [*owner, "uuid"])
    own = F.bool_or(F.col("__attribute").eqNullSafe(F.col(name)))
    low, high = F.min("__attribute"), F.max("__attribute")
    grouped = hits.groupBy(*owner, *key, name).agg(low.alias("__low"), high.alias("__high"), own.alias("__own"), F.count_distinct("__attribute").alias("candidates"))
    only = F.when(F.col("__low") == F.col("__high"), F.col("__low")).when(F.col("__own"), F.col(name))
    return grouped.select(*owner, *key, name, only.alias("attribute_name"), "candidates")
