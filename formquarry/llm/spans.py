"""Long exact spans shared between documents, by winnowed anchors that are extended both ways.

Every window of ``length`` code points has one anchor: the least hash among its k-grams. Windows in a
row that share an anchor form a segment: the anchor with all the text it has to be extended over, to
the left and to the right. Documents meet on the anchor's hash. Where the whole segment is equal in
two documents, all its windows are shared; otherwise the segments of the anchor are extended window
by window, one representative per distinct segment. Groups are only ever reduced to their least and
greatest document id, so copies cost one row each and no pair of documents is ever formed.

Defined results: NULL, empty and shorter texts share nothing; a text that repeats a passage only in
itself shares nothing; repeated rows are one document; overlapping or touching shared windows make
one span; positions count code points from zero; empty tables give no rows; extra columns are never
read. Hashes have 64 bits over random code-point values for anchors and segments (always used as a
pair) and two times 64 bits for windows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from formquarry.session import bounded, stored

#: Shared anchors are broadcast up to so many (8 bytes each); beyond, the join shuffles.
BROADCAST_ANCHORS = 1_000_000
#: Places where texts are cut for the extension are broadcast up to so many (some 100 bytes each).
BROADCAST_PLACES = 500_000
_CHUNK = 1 << 19
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the input moves every bit of the result."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    """base**i modulo 2**64 by doubling."""
    out = np.ones(n, np.uint64)
    have, step = 1, base
    while have < n:
        take = min(have, n - have)
        out[have : have + take] = out[:take] * np.uint64(step)
        have, step = have * 2, step * step & _MASK
    return out


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Position of the leftmost least value in each window of ``width`` values."""
    low, at, have = values, np.arange(len(values)), 1
    while have < width:
        step = min(have, width - have)
        left = low[:-step] <= low[step:]
        low, at, have = np.where(left, low[:-step], low[step:]), np.where(left, at[:-step], at[step:]), have + step
    return at


class Winnower:
    """Segments of texts; keeps the tables of powers between batches."""

    def __init__(self, length: int, gram: int) -> None:
        if not 1 <= gram <= length:
            raise ValueError("the k-gram must fit into the window")
        self.length, self.gram = length, gram
        size = 2 * _CHUNK + 2 * length
        self.up, self.down = _powers(_BASE, size), _powers(pow(_BASE, -1, 1 << 64), size)

    def segments(self, codes: np.ndarray, piece_of: np.ndarray) -> tuple[np.ndarray, ...]:
        """(first start, number of starts, anchor hash, segment hash); ``piece_of``: which text each code point belongs to."""
        length, gram, n = self.length, self.gram, len(codes)
        if n < length:
            return (np.empty(0, np.int64),) * 2 + (np.empty(0, np.uint64),) * 2
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_mix(codes.astype(np.uint64) + np.uint64(_BASE)) * self.up[:n], out=sums[1:])
        grams = _mix((sums[gram:] - sums[:-gram]) * self.down[: n - gram + 1])
        at = _sliding_min(grams, length - gram + 1)
        starts = np.flatnonzero(piece_of[: n - length + 1] == piece_of[length - 1 :])
        if not len(starts):
            return (np.empty(0, np.int64),) * 2 + (np.empty(0, np.uint64),) * 2
        anchor = at[starts]
        new = np.flatnonzero(np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (starts[1:] != starts[:-1] + 1))))
        first = starts[new]
        count = np.diff(np.concatenate((new, [len(starts)])))
        mid = anchor[new]
        whole = (sums[first + count + length - 1] - sums[first]) * self.down[first]
        shape = ((mid - first) * length * 2 + count).astype(np.uint64)
        return first, count, grams[mid], _mix(whole + _mix(shape + np.uint64(1)))

    def batches(self, source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Arrow batches (doc_id, start, n, anchor, segment) of batches (doc_id, text)."""
        for batch in source:
            ids, texts = batch.column(0), batch.column(1)
            pieces: list[tuple[int, int, np.ndarray]] = []
            held = 0
            for row in range(batch.num_rows):
                text = texts[row].as_py()
                if text is None or len(text) < self.length:
                    continue
                codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
                for begin in range(0, len(codes) - self.length + 1, _CHUNK):
                    piece = codes[begin : begin + _CHUNK + self.length - 1]
                    pieces.append((row, begin, piece))
                    held += len(piece)
                    if held >= _CHUNK:
                        yield from self._flush(ids, pieces)
                        pieces, held = [], 0
            yield from self._flush(ids, pieces)

    def _flush(self, ids: pa.Array, pieces: list[tuple[int, int, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        if not pieces:
            return
        lengths = np.array([len(p[2]) for p in pieces])
        offsets = np.concatenate(([0], np.cumsum(lengths)[:-1]))
        piece_of = np.repeat(np.arange(len(pieces)), lengths)
        first, count, anchor, segment = self.segments(np.concatenate([p[2] for p in pieces]), piece_of)
        piece = piece_of[first] if len(first) else np.empty(0, np.int64)
        begins, rows = np.array([p[1] for p in pieces]), np.array([p[0] for p in pieces])
        yield pa.RecordBatch.from_arrays(
            [
                ids.take(pa.array(rows[piece])),
                pa.array((first - offsets[piece] + begins[piece]).astype(np.int64)),
                pa.array(count.astype(np.int32)),
                pa.array(anchor.view(np.int64)),
                pa.array(segment.view(np.int64)),
            ],
            names=["doc_id", "start", "n", "anchor", "segment"],
        )


def segments(docs: DataFrame, length: int, gram: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, start, n, anchor, segment): n windows begin at start, start + 1, ... and share the anchor."""

    def run(source):
        yield from Winnower(length, gram).batches(source)

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).where(F.length("text") >= length).mapInArrow(run, f"doc_id {kind}, start long, n int, anchor long, segment long")


def shared_spans(docs: DataFrame, length: int = 100, gram: int = 50, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, span_start, span_chars): the maximal shared runs of each document: ``p8_found``.

    Anchors of a single document drop out first, which leaves the segments near shared text; only
    those take part in the extension.
    """
    all_seeds = stored(segments(docs, length, gram, doc_id, text), "segments")
    met = all_seeds.groupBy("anchor").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low != high").select("anchor")
    seeds = stored(all_seeds.join(bounded(stored(met, "anchors"), BROADCAST_ANCHORS), "anchor", "left_semi"), "seeds")
    groups = seeds.groupBy("anchor", "segment").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
    groups = stored(groups, "groups")
    several = groups.groupBy("anchor").agg(F.count("*").alias("kinds")).where("kinds > 1").select("anchor")
    extended = _extend(docs, seeds, groups.join(several, "anchor", "left_semi"), length, doc_id, text)
    whole = groups.where("low != high").select("anchor", "segment", F.lit(0).alias("lo"), F.lit(length).alias("hi"))
    hits = seeds.join(whole.unionByName(extended), ["anchor", "segment"])
    last = F.when(F.col("hi") == length, F.col("n") - 1).otherwise(F.col("hi"))
    intervals = hits.select("doc_id", (F.col("start") + F.col("lo")).alias("begin"), (F.col("start") + last + length).alias("end"))
    return merge_intervals(intervals)


def _extend(docs: DataFrame, seeds: DataFrame, groups: DataFrame, length: int, doc_id: str, text: str) -> DataFrame:
    """(anchor, segment, lo, hi): the runs of windows (offsets in the segment) that another document has, for segments not equal as a whole.

    The window in a segment and its anchor fix each other, so equal windows always meet under one anchor.
    """
    standing = seeds.join(groups.select("anchor", "segment", F.col("low").alias("doc_id"), "low", "high"), ["anchor", "segment", "doc_id"])
    one = stored(standing.groupBy("anchor", "segment", "doc_id", "low", "high", "n").agg(F.min("start").alias("start")), "standing")
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    # The places to cut go to the texts, or, where they are too many, only texts with such a place move.
    places = bounded(one, BROADCAST_PLACES)
    if places is one:
        texts = texts.join(bounded(stored(one.select("doc_id").distinct(), "cut_ids"), BROADCAST_ANCHORS), "doc_id", "left_semi")
    cut = F.substring("text", F.col("start").cast("int") + 1, F.col("n") + length - 1)
    pieces = texts.join(places, "doc_id").select("anchor", "segment", "low", "high", "n", cut.alias("piece"))
    each = pieces.select("anchor", "segment", "low", "high", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("at"), "piece")
    window = F.substring("piece", F.col("at") + 1, F.lit(length))
    hashed = each.select("anchor", "segment", "low", "high", "at", F.xxhash64(window).alias("w1"), F.xxhash64(F.lit(1), window).alias("w2"))
    shared = hashed.groupBy("anchor", "w1", "w2").agg(F.min("low").alias("w_low"), F.max("high").alias("w_high")).where("w_low != w_high").select("anchor", "w1", "w2")
    there = hashed.where("low = high").join(shared, ["anchor", "w1", "w2"], "left_semi").select("anchor", "segment", "at").distinct()
    order = W.partitionBy("anchor", "segment").orderBy("at")
    runs = there.withColumn("run", F.col("at") - F.row_number().over(order))
    return runs.groupBy("anchor", "segment", "run").agg(F.min("at").alias("lo"), F.max("at").alias("hi")).drop("run")


def merge_intervals(intervals: DataFrame) -> DataFrame:
    """(doc_id, span_start, span_chars): overlapping and touching [begin, end) of each document made one."""
    order = W.partitionBy("doc_id").orderBy("begin", "end")
    before = F.max("end").over(order.rowsBetween(W.unboundedPreceding, -1))
    opened = intervals.withColumn("opens", F.coalesce((F.col("begin") > before).cast("long"), F.lit(1).cast("long")))
    numbered = opened.withColumn("span", F.sum("opens").over(order.rowsBetween(W.unboundedPreceding, 0)))
    merged = numbered.groupBy("doc_id", "span").agg(F.min("begin").alias("span_start"), F.max("end").alias("end"))
    return merged.select("doc_id", "span_start", (F.col("end") - F.col("span_start")).alias("span_chars"))


def shared_amounts(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """(doc_id, chars, shared_chars, shared_share) of every document, zero for those that share nothing."""
    totals = spans.groupBy("doc_id").agg(F.sum("span_chars").alias("shared_chars"))
    chars = docs.select("doc_id", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("chars"))
    shared = F.coalesce("shared_chars", F.lit(0)).cast("long")
    return chars.join(totals, "doc_id", "left").select("doc_id", "chars", shared.alias("shared_chars"), F.coalesce(F.try_divide(shared, F.col("chars")), F.lit(0.0)).alias("shared_share"))
