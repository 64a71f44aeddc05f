"""Drift of a dump against a saved baseline.

Both sides are united and grouped by form key once; that decides every kind of change. Added and removed look at forms with
a code module; structure changes also at forms that only have an element file. Keys are made of the
four ids and paths are compared relative to the dump's root, so a baseline survives a move.

Defined results: a missing baseline reports all forms with code as added; NULL hashes on the baseline
side fall back to a difference in time of more than a second; NULL structure hashes never differ;
of repeated keys the last by path counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formquarry.functions.keys import composite_key

#: Times of one file may differ by so many seconds.
TOLERANCE_S = 1.0
_READ = ("object_type", "object_name", "container_name", "form_name", "bsl_path", "bsl_mtime", "bsl_sha256", "elem_sha256")
KINDS = ("added", "removed", "modified", "structure_modified", "stale_extractions")


def drift(baseline: DataFrame, current: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by..., form_key, kind) with a kind of KINDS but the last, which ``stale`` finds."""
    columns = [*(by or []), *_READ]
    return drift_of_sides(baseline.select(*columns, F.lit(False).alias("is_new")).unionByName(current.select(*columns, F.lit(True).alias("is_new"))), by)


def drift_of_sides(sides: DataFrame, by: list[str] | None = None) -> DataFrame:
    """As ``drift``, from one table of both sides told apart by ``is_new``."""
    by = by or []
    key = composite_key("object_type", "object_name", "container_name", "form_name")
    path = F.coalesce("bsl_path", F.lit(""))
    row = F.struct(path.alias("path"), (path != "").alias("code"), "bsl_mtime", "bsl_sha256", "elem_sha256")
    rows = sides.select(*by, key.alias("form_key"), F.when(F.col("is_new"), row).alias("c"), F.when(~F.col("is_new"), row).alias("b"))
    both = rows.groupBy(*by, "form_key").agg(F.max("b").alias("b"), F.max("c").alias("c"))
    code_b, code_c = (F.coalesce(f"{s}.code", F.lit(False)) for s in ("b", "c"))
    moved = F.abs(F.col("c.bsl_mtime") - F.col("b.bsl_mtime")) > TOLERANCE_S
    modified = code_b & code_c & F.coalesce(F.when(F.col("b.bsl_sha256").isNotNull(), ~F.col("c.bsl_sha256").eqNullSafe(F.col("b.bsl_sha256"))).otherwise(moved), F.lit(False))
    structure = F.coalesce(F.col("c.elem_sha256") != F.col("b.elem_sha256"), F.lit(False))
    tests = {"added": code_c & ~code_b, "removed": code_b & ~code_c, "modified": modified, "structure_modified": structure}
    kinds = F.array_compact(F.array(*[F.when(test, kind) for kind, test in tests.items()]))
    return both.select(*by, "form_key", F.explode(kinds).alias("kind"))


def stale(baseline: DataFrame, files: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by..., form_key, kind='stale_extractions'): forms whose recorded code file is not among ``files`` (by..., path)."""
    by = by or []
    known = baseline.where(F.coalesce("bsl_path", F.lit("")) != "").select(*by, composite_key("object_type", "object_name", "container_name", "form_name").alias("form_key"), F.col("bsl_path").alias("path"))
    return known.join(files.select(*by, "path").distinct(), [*by, "path"], "left_anti").select(*by, "form_key", F.lit("stale_extractions").alias("kind")).distinct()


def drift_report(changes: DataFrame, by: list[str] | None = None, every: DataFrame | None = None) -> DataFrame:
    """Wide form: one sorted list per kind and whether anything changed; one row per dump (or one in all).

    ``every``: the dumps (by...) that are to have a report even if nothing changed.
    """
    by = by or []
    lists = [F.array_sort(F.collect_list(F.when(F.col("kind") == k, F.col("form_key")))).alias(k) for k in KINDS]
    wide = changes.groupBy(*by).agg(*lists)
    if every is not None:
        empty = F.array().cast("array<string>")
        wide = every.select(*by).distinct().join(wide, by, "left").withColumns({k: F.coalesce(k, empty) for k in KINDS})
    return wide.select(*by, (sum(F.size(k) for k in KINDS) > 0).alias("has_drift"), *KINDS, F.current_timestamp().alias("checked_at"))
