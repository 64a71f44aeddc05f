"""Queries of report containers, one row per distinct query of a container.

NULL content, content that is no container and text without a query give a row with a warning in
``containers`` and no queries. The data set's name is the nearest one before the query;
``nearest=False`` takes the first one in reach instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from formquarry.decoders import report
from formquarry.session import arrow_function

_READ = "struct<warning:string,datasets:array<struct<ord:int,name:string,query:string>>>"


def containers(files: DataFrame, content: str = "content", nearest: bool = True) -> DataFrame:
    """``files`` with a column ``report``: a warning and the data sets."""

    def read(data: bytes | None) -> dict:
        text, wrong = report.container_text(data)
        found = report.datasets(text, nearest)
        return {"warning": wrong or (None if found else "no query found"), "datasets": found}

    return files.withColumn("report", arrow_function(read, _READ)(F.col(content))).drop(content)


def report_queries(read: DataFrame, key: list[str]) -> DataFrame:
    return read.select(*key, F.inline("report.datasets"))


def report_root(path: Column) -> Column:
    """The folder of the report a container belongs to: through the name after the first ``Report``, else three levels up."""
    parts = F.split(path, "/")
    at = F.array_position(parts, "Report")
    above = F.greatest(F.size(parts) - 3, F.lit(0))
    return F.array_join(F.slice(parts, 1, F.when((at > 0) & (F.size(parts) > at), at + 1).otherwise(above).cast("int")), "/")


def marked_blocks(texts: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    """(key, block_no, block): runs of lines that begin with a query word and go on to the next empty line."""
    lines = texts.select(*key, F.posexplode(F.split(text, "\n")).alias("line_no", "line"))
    order = W.partitionBy(*key).orderBy("line_no")
    begins = F.trim("line").rlike(r"(?iu)^(ВЫБРАТЬ|SELECT)\b").cast("int")
    ends = (F.trim("line") == "").cast("int")
    numbered = lines.withColumn("block_no", F.sum(begins).over(order)).withColumn("gap_no", F.sum(ends).over(order))
    opened = numbered.withColumn("first_gap", F.min("gap_no").over(W.partitionBy(*key, "block_no")))
    inside = opened.where("block_no > 0 AND gap_no = first_gap")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n")
    return inside.groupBy(*key, "block_no").agg(joined.alias("block"))
