"""Mixing sources to target weights, in tokens of a public tokenizer.

The corpus to build is as large as all documents of the listed sources. Each source is given its
share of it; what a source cannot fill, as it may use no document more than ``max_repeats`` times, goes
to the others in proportion to their targets. Within a source every document is expected a number of
times: the whole part is allocated for certain, the rest by Pareto order sampling: documents are
ranked by random odds over inclusion odds and taken from the top until the source's tokens are
full. Ranks are compared through a histogram per source, so only the one bin that holds the cut
is ever sorted.

Defined results: sources compare trimmed and ignoring case; documents without source or with one that
is not listed take no part; NULL and empty texts have no tokens and are not drawn; a listed source
without documents gets nothing and is reported; NULL or negative shares count as 0, NULL or negative
repeats as 0; of a source listed several times the greatest share counts; the draw depends on the
seed and the document id only; empty tables give an empty corpus; extra columns are never read.
"""

from __future__ import annotations

import importlib.util
import os
from collections.abc import Iterator

import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from formquarry.session import stored

#: The folder of the public tokenizers' files.
TOKENIZERS = "/opt/tokenizers"
#: Listed sources are driver-side metadata; more than this are refused.
MAX_SOURCES = 10_000
_BINS = 4096


def _counter(path: str, pattern: str):
    """A function text -> number of tokens for a rank file, loaded once per Python worker."""
    import base64

    import tiktoken

    loaded = tiktoken.__dict__.setdefault("_formquarry_loaded", {})
    if (path, pattern) not in loaded:
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        loaded[path, pattern] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    encode = loaded[path, pattern].encode_ordinary
    return lambda text: len(encode(text))


def split_pattern(path: str) -> str:
    """How the tokenizers of the folder that a rank file lies in split texts, as that folder's module states it."""
    spec = importlib.util.spec_from_file_location("tokenizer_files", f"{os.path.dirname(path)}/__init__.py")
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    return module.PATTERN


def token_count(column: str, path: str) -> Column:
    """Number of tokens of a text by a rank file, which is sent to the executors; NULL counts 0."""
    pattern, name = split_pattern(path), os.path.basename(path)
    SparkSession.active().sparkContext.addFile(path)

    @F.pandas_udf("long")
    def count(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tokens = _counter(SparkFiles.get(name), pattern)
        for batch in texts:
            yield pd.Series([tokens(t) if t else 0 for t in batch], dtype="int64")

    return count.asNondeterministic()(column)


def source_key(column: str) -> Column:
    return F.lower(F.trim(column))


def sized_documents(docs: DataFrame, tokenizer: str, weight: str | None = None) -> DataFrame:
    """(doc_id, source, tokens, weight) of the documents that can be drawn, stored."""
    w = F.lit(1.0) if weight is None else F.greatest(F.coalesce(F.col(weight).cast("double"), F.lit(0.0)), F.lit(0.0))
    sized = docs.select("doc_id", source_key("source").alias("source"), token_count("text", tokenizer).alias("tokens"), w.alias("weight"))
    return stored(sized.where("source IS NOT NULL AND tokens > 0"), "sized")


def allocate(available: dict[str, int], targets: dict[str, tuple[float, int]]) -> dict[str, float]:
    """Tokens of each source: shares of the total, capped at available * repeats, the rest spread over the uncapped."""
    total = float(sum(available.get(s, 0) for s in targets))
    most = {s: available.get(s, 0) * repeats for s, (_, repeats) in targets.items()}
    given = dict.fromkeys(targets, 0.0)
    free = {s for s, (share, _) in targets.items() if share > 0}
    while free:
        left = total - sum(v for s, v in given.items() if s not in free)
        weight = sum(targets[s][0] for s in free)
        want = {s: left * targets[s][0] / weight for s in free}
        full = {s for s in free if want[s] >= most[s]}
        given |= {s: float(most[s]) for s in full} if full else want
        if not full:
            break
        free -= full
    return given


def listed_sources(mix_targets: DataFrame) -> dict[str, tuple[float, int]]:
    """source -> (share, repeats), normalised to a sum of 1."""
    known = mix_targets.select(source_key("source").alias("source"), F.col("target_share").alias("share"), F.col("max_repeats").alias("repeats")).where("source IS NOT NULL")
    rows = known.groupBy("source").agg(F.max("share").alias("share"), F.max("repeats").alias("repeats")).limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    shares = {r.source: max(r.share or 0.0, 0.0) for r in rows}
    total = sum(shares.values()) or 1.0
    return {r.source: (shares[r.source] / total, max(r.repeats or 0, 0)) for r in rows}


def plan(sized: DataFrame, mix_targets: DataFrame) -> DataFrame:
    """(source, share, repeats, available, given, scale): one row per listed source."""
    spark = sized.sparkSession
    targets = listed_sources(mix_targets)
    listed = spark.createDataFrame([(s, share, repeats) for s, (share, repeats) in targets.items()], "source string, share double, repeats int").coalesce(1)
    sums = sized.join(F.broadcast(listed), "source").groupBy("source").agg(F.sum("tokens").alias("tokens"), F.sum(F.col("tokens") * F.col("weight")).alias("mass")).collect()
    available, mass = {r.source: r.tokens for r in sums}, {r.source: r.mass for r in sums}
    given = allocate(available, targets)
    rows = [(s, share, repeats, available.get(s, 0), given[s], given[s] / mass[s] if mass.get(s) else 0.0) for s, (share, repeats) in sorted(targets.items())]
    return spark.createDataFrame(rows, "source string, share double, repeats int, available long, given double, scale double").coalesce(1)


def mixture(sized: DataFrame, sources: DataFrame, seed: int = 0) -> DataFrame:
    """(doc_id, source, tokens, copies) of the drawn documents; ``sources`` is the result of ``plan`` (bounded by MAX_SOURCES)."""
    expected = F.least(F.col("weight") * F.col("scale"), F.col("repeats"))
    docs = sized.join(F.broadcast(sources.where("given > 0").select("source", "repeats", "given", "scale")), "source")
    docs = docs.select("doc_id", "source", "tokens", "given", F.floor(expected).alias("whole"), (expected - F.floor(expected)).alias("part"))
    draw = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("doc_id")), 11).cast("double") + 0.5) / F.lit(float(1 << 53))
    odds = (draw / (1 - draw)) / (F.col("part") / (1 - F.col("part")))
    docs = docs.withColumn("rank", F.when(F.col("part") > 0, odds / (1 + odds))).withColumn("bin", F.least(F.floor(F.col("rank") * _BINS), F.lit(_BINS - 1)))
    bins = docs.groupBy("source", "given", "bin").agg(F.sum(F.when(F.col("rank").isNotNull(), F.col("tokens"))).alias("tokens"), F.sum(F.col("tokens") * F.col("whole")).alias("sure"))
    by_source, by_bin = W.partitionBy("source"), W.partitionBy("source").orderBy(F.col("bin").asc_nulls_first())
    filled = bins.select("source", "bin", (F.col("given") - F.sum("sure").over(by_source)).alias("room"), "tokens", F.coalesce(F.sum("tokens").over(by_bin.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    cut = filled.where("bin IS NOT NULL AND before <= room AND before + tokens > room").groupBy("source").agg(F.min(F.struct("bin", "before", "room")).alias("cut"))
    full = filled.groupBy("source").agg(F.max("room").alias("room"), F.max(F.coalesce("tokens", F.lit(0)) + F.col("before")).alias("all")).select("source", F.col("all").alias("most"), F.col("room").alias("total_room"))
    limits = full.join(cut, "source", "left")
    ranked = docs.join(F.broadcast(limits), "source")
    edge = ranked.where(F.col("bin") == F.col("cut.bin"))
    upto = F.sum("tokens").over(W.partitionBy("source").orderBy("rank", "doc_id").rowsBetween(W.unboundedPreceding, 0)) + F.col("cut.before")
    drawn_edge = edge.withColumn("extra", ((upto - F.col("tokens") / 2) <= F.col("cut.room")).cast("long"))
    inside = F.col("rank").isNotNull() & F.when(F.col("cut").isNull(), F.col("most") <= F.col("total_room")).otherwise(F.col("bin") < F.col("cut.bin"))
    rest = ranked.where(F.col("bin").isNull() | F.col("cut").isNull() | (F.col("bin") != F.col("cut.bin"))).withColumn("extra", F.coalesce(inside, F.lit(False)).cast("long"))
    both = drawn_edge.unionByName(rest)
    return both.select("doc_id", "source", "tokens", (F.col("whole") + F.col("extra")).alias("copies")).where("copies > 0")


def report(drawn: DataFrame, sources: DataFrame) -> DataFrame:
    """Per listed source: target and actual share, tokens available and used, documents, the most copies of one, whether it was full."""
    used = drawn.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("used"), F.count("*").alias("documents"), F.max("copies").alias("most_copies"))
    rows = sources.join(used, "source", "left").na.fill(0, ["used", "documents", "most_copies"])
    total = F.sum("used").over(W.partitionBy())
    return rows.select(
        "source",
        F.col("share").alias("target_share"),
        F.coalesce(F.try_divide(F.col("used").cast("double"), total), F.lit(0.0)).alias("actual_share"),
        "available",
        "used",
        "documents",
        "most_copies",
        (F.col("given") >= F.col("available") * F.col("repeats")).alias("exhausted"),
    )
