"""Composite keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def composite_key(*parts: Column | str, separator: str = "/") -> Column:
    """The parts joined as they are; NULL parts are kept as empty ones."""
    return F.concat_ws(separator, *[F.coalesce(F.col(p) if isinstance(p, str) else p, F.lit("")) for p in parts])


def is_common_form(path: Column | str) -> Column:
    """True for a form without an owner object: ``CommonForm`` is a segment of its path; NULL gives false."""
    path = F.col(path) if isinstance(path, str) else path
    return F.coalesce(F.array_contains(F.split(path, "[\\\\/]"), "CommonForm"), F.lit(False))


def owner_of_path(path: Column | str) -> Column:
    """STRUCT<object_type, object_name> of an owner's metadata file: the folder two above it, and the one above it; empty where there is none."""
    path = F.col(path) if isinstance(path, str) else path
    parts = F.split(path, "[\\\\/]")
    at = lambda n: F.coalesce(F.try_element_at(parts, F.lit(n)), F.lit(""))
    return F.struct(at(-3).alias("object_type"), at(-2).alias("object_name"))


def artifact(name: Column | str, unpacked_root: Column | str) -> Column:
    """STRUCT of a form's artifact as it stands before extraction: its folder, nothing extracted, no warnings."""
    name, root = (F.col(c) if isinstance(c, str) else c for c in (name, unpacked_root))
    return F.struct(name.alias("form_name"), F.concat_ws("/", root, name).alias("unpacked_root"), F.lit(False).alias("extraction_ok"), F.lit(False).alias("elem_index_ok"), F.lit(False).alias("skd_extracted"), F.array().cast("array<string>").alias("warnings"))
