"""What changed between consecutive full snapshots.

Each row of a snapshot is tagged twice: as the new side of its own snapshot and as the old side of
the next one. One aggregation by (partition, later snapshot, key) then has both sides' row hashes
and classifies; picking the row that counts among repeated ones happens in the same aggregation.
That is the only shuffle of the table: the list of existing snapshots, a few rows per partition,
is broadcast behind a count of its rows (beyond BROADCAST_STEPS the join with it shuffles), and
what is shuffled of a value is its head and a 64-bit digest.

Defined results: rows without partition or snapshot number are in no snapshot and are left out; NULL
parts of a key are empty; among repeated rows of a key the latest version counts, at equal
versions the greatest hashes (by their first HEAD characters, then by digest), NULL lowest; the
first snapshot reports nothing; a snapshot number may be missing, the next existing one follows;
extra columns are never read. A difference is missed only where the digests of two values collide.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from formquarry.functions.keys import composite_key
from formquarry.session import bounded, stored

#: The snapshots of all partitions are broadcast up to so many (some 50 bytes each).
BROADCAST_STEPS = 500_000
#: So many characters order the values of repeated rows.
HEAD = 8


def snapshot_steps(df: DataFrame, partition: str, snapshot: str) -> DataFrame:
    """(part, snap, next, first): the existing snapshots, each with the one that follows it, stored."""
    order = W.partitionBy("part").orderBy("snap")
    existing = df.select(F.col(partition).alias("part"), F.col(snapshot).alias("snap")).dropna().distinct()
    return stored(existing.select("part", "snap", F.lead("snap").over(order).alias("next"), F.lag("snap").over(order).isNull().alias("first")), "steps")


def snapshot_changes(df: DataFrame, partition: str, snapshot: str, key: Column, version: Column, hashes: Sequence[Column]) -> DataFrame:
    """(partition, snapshot, row_key, change_kind in added/removed/changed) against the preceding existing snapshot."""
    # Of each value its head, which orders it, and its digest, which tells it from others; NULL stays NULL and never differs.
    parts = [c for i, h in enumerate(hashes) for c in (F.substring(h, 1, HEAD).alias(f"t{i}"), F.when(h.isNotNull(), F.xxhash64(h)).alias(f"h{i}"))]
    rows = df.select(F.col(partition).alias("part"), F.col(snapshot).alias("snap"), key.alias("row_key"), F.struct(version.alias("version"), *parts).alias("row"))
    rows = rows.dropna(subset=["part", "snap"])
    none = F.lit(None).cast(rows.schema["row"].dataType)
    sides = F.array(
        F.struct(F.when(~F.col("first"), F.col("snap")).alias("at"), F.col("row").alias("new"), none.alias("old")),
        F.struct(F.col("next").alias("at"), none.alias("new"), F.col("row").alias("old")),
    )
    steps = bounded(snapshot_steps(df, partition, snapshot), BROADCAST_STEPS)
    tagged = rows.join(steps, ["part", "snap"]).select("part", "row_key", F.inline(F.filter(sides, lambda s: s["at"].isNotNull())))
    both = tagged.groupBy("part", "at", "row_key").agg(F.max("new").alias("new"), F.max("old").alias("old"))
    differs = F.lit(False)
    for i in range(len(hashes)):
        differs = differs | F.coalesce(F.col(f"new.h{i}") != F.col(f"old.h{i}"), F.lit(False))
    kind = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(differs, "changed")
    return both.select(F.col("part").alias(partition), F.col("at").alias(snapshot), "row_key", kind.alias("change_kind")).where("change_kind IS NOT NULL")


def form_changes(form_scans: DataFrame) -> DataFrame:
    """Forms added, removed or changed from each snapshot of a dump to the next: ``p4_found``."""
    key = composite_key("object_type", "object_name", "container_name", "form_name")
    changes = snapshot_changes(form_scans, "dump_id", "snapshot_no", key, F.col("loaded_at"), [F.lower("bsl_sha256"), F.lower("elem_sha256")])
    return changes.withColumnRenamed("row_key", "form_key")


def report_check(changes: DataFrame, drift_reports: DataFrame) -> DataFrame:
    """Per reported snapshot and kind: changes claimed and found, only claimed, only found.

    Only snapshots with a report are compared; a NULL list claims nothing; repeated claims count once.
    """
    kinds = F.array(*[F.struct(F.lit(k).alias("change_kind"), F.col(k).alias("keys")) for k in ("added", "removed")])
    claims = drift_reports.select("dump_id", "snapshot_no", F.inline(kinds)).select("dump_id", "snapshot_no", "change_kind", F.explode("keys").alias("form_key"), F.lit(True).alias("claimed"))
    reported = drift_reports.select("dump_id", "snapshot_no").distinct()
    found = changes.where(F.col("change_kind").isin("added", "removed")).join(reported, ["dump_id", "snapshot_no"], "left_semi")
    rows = found.select("dump_id", "snapshot_no", "change_kind", "form_key", F.lit(False).alias("claimed")).unionByName(claims)
    keys = rows.groupBy("dump_id", "snapshot_no", "change_kind", "form_key").agg(F.max("claimed").alias("claimed"), F.max(~F.col("claimed")).alias("found"))
    count = lambda c: F.count_if(c)
    return keys.groupBy("dump_id", "snapshot_no", "change_kind").agg(
        count(F.col("claimed") & F.col("found")).alias("confirmed"), count(F.col("claimed") & ~F.col("found")).alias("only_claimed"), count(~F.col("claimed") & F.col("found")).alias("only_found")
    )
