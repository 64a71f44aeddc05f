"""Changes of a stream of entries against the state of all earlier ones.

The latest version of each key is kept in Spark's state store, so a batch touches only the keys that it
has; the changes of a batch are written under its number, so a batch that is run again overwrites the
same path.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StringType, StructType


def _plain(value: Any) -> Any:
    """A cell of a pandas frame as Spark's state takes it."""
    if value is None or value is pd.NaT or (isinstance(value, float) and value != value):
        return None
    return value.to_pydatetime() if isinstance(value, pd.Timestamp) else value.item() if hasattr(value, "item") else value


def _sortable(row: Sequence[Any]) -> list[tuple[bool, Any]]:
    """NULLs sort lowest."""
    return [(v is not None, 0 if v is None else v) for v in row]


def keyed_changes(stream: DataFrame, key: Sequence[str], version: Sequence[str], hashes: Sequence[Column]) -> DataFrame:
    """(key..., change_kind in added/changed) of a stream, in update mode.

    Late entries are harmless: only a version greater than the one in the state changes it. Entries without
    any version are left out; of a batch's entries of a key the greatest (version, hashes) counts.
    """
    names = [f"h{i}" for i in range(len(hashes))]
    rows = stream.select(*key, *version, *[h.alias(n) for h, n in zip(hashes, names)])
    state = StructType([f for f in rows.schema.fields if f.name not in key])
    width, fields = len(version), [*version, *names]
    out = StructType([f for f in rows.schema.fields if f.name in key]).add("change_kind", StringType())

    def judge(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen = (tuple(map(_plain, row)) for frame in frames for row in frame[fields].itertuples(index=False))
        new = max((row for row in seen if any(v is not None for v in row[:width])), key=_sortable, default=None)
        was = tuple(state.get) if state.exists else None
        if new is None or (was is not None and _sortable(new[:width]) <= _sortable(was[:width])):
            return
        state.update(new)
        differs = was is not None and any(a is not None and b is not None and a != b for a, b in zip(new[width:], was[width:]))
        if was is None or differs:
            yield pd.DataFrame([[*group, "added" if was is None else "changed"]], columns=[*key, "change_kind"])

    return rows.groupBy(*key).applyInPandasWithState(judge, out, state, "update", GroupStateTimeout.NoTimeout)


def stream_changes(stream: DataFrame, key: Sequence[str], version: Sequence[str], hashes: Sequence[Column], folder: str, checkpoint: str) -> StreamingQuery:
    """Start writing (key, change_kind, batch) to ``folder``/changes, a folder per batch."""

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{folder}/changes/{number}")

    changes = keyed_changes(stream, key, version, hashes)
    return changes.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def deliveries_per_window(stream: DataFrame, time: str, window: str = "1 day", late: str = "7 days", by: Sequence[str] = ()) -> DataFrame:
    """(window start, by..., deliveries): counts by event time; entries later than ``late`` are left out."""
    timed = stream.withColumn("__time", F.col(time).cast("timestamp")).withWatermark("__time", late)
    counts = timed.groupBy(F.window("__time", window), *by).agg(F.count("*").alias("deliveries"))
    return counts.select(F.col("window.start").alias("window_start"), *by, "deliveries")
