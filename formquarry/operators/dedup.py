"""Order-dependent deduplication: the first or the last row of a key, by an explicit order.

NULL keys are equal to each other. Ties in the order are settled by all other columns that sort.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def keep_first(df: DataFrame, key: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """The first row of each key; a map-side aggregation, so a hot key costs one row per task."""
    return _keep(df, key, order, F.min)


def keep_last(df: DataFrame, key: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    return _keep(df, key, order, F.max)


def _keep(df: DataFrame, key: Sequence[str], order: Sequence[str | Column], best) -> DataFrame:
    columns = [F.col(o) if isinstance(o, str) else o for o in order]
    ranked = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(columns)], F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))
    return df.groupBy(*key).agg(best(ranked).alias("best")).select("best.row.*")


def priority_merge(df: DataFrame, key: Sequence[str], rank: str, values: Sequence[str], empty: Sequence[str] = ("",)) -> DataFrame:
    """Per key each value from the best ranked row that has one; NULL and the ``empty`` texts are no values."""
    known = [F.when(F.col(v).isNotNull() & ~F.col(v).isin(*empty), F.struct(F.col(rank).alias("r"), F.col(v).alias("v"))) for v in values]
    return df.groupBy(*key).agg(*[F.min(k).getField("v").alias(v) for k, v in zip(known, values)], F.array_sort(F.collect_set(rank)).alias("merged_ranks"))
