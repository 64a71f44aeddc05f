"""Routing of a lookup text to forms, and upserts into the index it uses."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The confidence of each tier.
CONFIDENCE = {1: 1.0, 2: 0.9, 3: 0.4}


def route(index: DataFrame, query: str | None) -> DataFrame:
    """The forms of the best tier with their confidence; an empty query and one without match give no rows.

    Tiers: form name equal (1.0); object name equal ignoring case (0.9); object type contains the
    query ignoring case (0.4). All rows of the best tier are returned. The best tier is found by a
    global aggregation of one number, so no row moves for it.
    """
    text = (query or "").strip()
    low = text.lower()
    tier = F.when(F.col("form_name") == text, 1).when(F.lower("object_name") == low, 2).when(F.contains(F.lower("object_type"), F.lit(low)), 3)
    hits = index.withColumn("__tier", tier if text else F.lit(None).cast("int")).where("__tier IS NOT NULL")
    best = hits.agg(F.min("__tier").alias("__best"))
    confidence = F.when(F.col("__tier") == 1, CONFIDENCE[1]).when(F.col("__tier") == 2, CONFIDENCE[2]).otherwise(CONFIDENCE[3])
    return hits.join(F.broadcast(best), F.col("__tier") == F.col("__best")).withColumn("confidence", confidence).drop("__tier", "__best")


def upsert(base: DataFrame, changes: DataFrame, key: Sequence[str]) -> DataFrame:
    """``base`` with rows of ``changes`` put in place of those of the same key (NULLs are equal), or added.

    Columns that only one side has are kept and filled with NULL. Each side should have a key once.
    """
    sides = base.withColumn("__rank", F.lit(1)).unionByName(changes.withColumn("__rank", F.lit(0)), allowMissingColumns=True)
    columns = [c for c in sides.columns if c != "__rank"]
    best = sides.groupBy(*key).agg(F.min_by(F.struct(*columns), "__rank").alias("row"))
    return best.select("row.*")
