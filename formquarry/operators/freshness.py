"""Freshness of unpacked forms: an index of entries by form name, the last delivery of each counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formquarry.operators.dedup import keep_last


def is_stale(bin_mtime: Column, unpacked_mtime: Column) -> Column:
    """The binary is newer than what was unpacked of it; never unpacked (NULL) is stale, unknown binaries are not."""
    return F.coalesce(bin_mtime > F.coalesce(unpacked_mtime, F.lit(float("-inf"))), F.lit(False))


def current_entries(feed: DataFrame) -> DataFrame:
    """The last delivered entry of each form, ties by the record number."""
    return keep_last(feed.where("form_name IS NOT NULL"), ["form_name"], ["delivered_at", "rec_id"])


def stale_forms(entries: DataFrame) -> DataFrame:
    """(form_name) of stale entries, sorted."""
    return entries.where(is_stale(F.col("bin_mtime"), F.col("unpacked_mtime"))).select("form_name").orderBy("form_name")


def entries_of_artifacts(artifacts: DataFrame, bins: DataFrame) -> DataFrame:
    """Index entries of the artifacts whose binary is known: (form_name, bin_path, unpacked_root, bin_mtime, unpacked_mtime, extraction_ok, warnings)."""
    return artifacts.join(bins.select("form_name", "bin_path", "bin_mtime"), "form_name").select("form_name", "bin_path", "unpacked_root", "bin_mtime", "unpacked_mtime", "extraction_ok", "warnings")


def checked_artifacts(artifacts: DataFrame) -> DataFrame:
    """Artifacts, made to fail where an extraction failed without saying why."""
    broken = ~F.col("extraction_ok") & (F.size(F.coalesce("warnings", F.array())) == 0)
    said = F.when(broken, F.raise_error(F.lit("a failed extraction needs a warning"))).otherwise(F.col("warnings"))
    return artifacts.withColumn("warnings", said)
