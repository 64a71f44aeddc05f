"""Saved indexes and reports: JSON files of earlier runs, read with defaults for what older ones lack, and written.

``save_*`` writes tables: a row per entry in JSON lines, in parallel, with a header row beside them.
``export_*`` writes the exchange format instead, one JSON document, which one task makes; it is for a single
dump, whose size its folder bounds. ``load_*`` reads either. A missing file gives an empty table. Field order and unknown
fields do not matter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

FORM = (
    "struct<object_type:string,object_name:string,container_name:string,form_name:string,form_path:string,bsl_path:string,json_path:string,warnings:array<string>,"
    "bsl_mtime:double,form_elem_path:string,bsl_sha256:string,elem_sha256:string,elem_json_path:string>"
)
SCAN_INDEX = f"total bigint, scanned_at string, scan_warnings array<string>, reference_types map<string,string>, forms array<{FORM}>"
ENTRY = "struct<bin_path:string,unpacked_root:string,bin_mtime:double,unpacked_mtime:double,extraction_ok:boolean,warnings:array<string>>"
LISTS = ("added", "removed", "modified", "stale_extractions", "structure_modified")


def _fields(struct: str) -> list[str]:
    return [f.split(":")[0] for f in struct[7:-1].split(",")]


def exists(spark: SparkSession, path: str) -> bool:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def _json(spark: SparkSession, path: str, schema: str, lines: bool = False) -> DataFrame:
    try:
        return spark.read.schema(schema).option("multiLine", str(not lines).lower()).json(path)
    except AnalysisException as wrong:
        if "PATH_NOT_FOUND" not in str(wrong):
            raise
        return spark.createDataFrame([], schema)


def _columns(struct: str) -> str:
    return struct[7:-1].replace(":", " ")


def load_scan_index(spark: SparkSession, path: str) -> DataFrame:
    """One row per form; missing lists are empty, a missing time is 0."""
    if exists(spark, f"{path}/forms"):
        forms = _json(spark, f"{path}/forms", _columns(FORM), lines=True)
    else:
        forms = _json(spark, path, SCAN_INDEX).select(F.inline("forms"))
    return forms.withColumns({"warnings": F.coalesce("warnings", F.array().cast("array<string>")), "bsl_mtime": F.coalesce("bsl_mtime", F.lit(0.0))})


def load_reference_types(spark: SparkSession, path: str) -> DataFrame:
    if exists(spark, f"{path}/forms"):
        return _json(spark, f"{path}/reference_types", "uuid string, type_name string", lines=True)
    return _json(spark, path, SCAN_INDEX).select(F.explode("reference_types").alias("uuid", "type_name"))


def _scanned(forms: DataFrame) -> DataFrame:
    return forms.agg(F.count("*").alias("total"), F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX").alias("scanned_at"))


def save_scan_index(forms: DataFrame, path: str, reference_types: DataFrame | None = None, warnings: DataFrame | None = None) -> None:
    """The index as tables below ``path``: forms, reference_types and scan_warnings in JSON lines, and a header row."""
    forms.select(*_fields(FORM)).write.mode("overwrite").json(f"{path}/forms")
    _scanned(forms).write.mode("overwrite").json(f"{path}/header")
    if reference_types is not None:
        reference_types.select("uuid", "type_name").write.mode("overwrite").json(f"{path}/reference_types")
    if warnings is not None:
        warnings.select("warning").write.mode("overwrite").json(f"{path}/scan_warnings")


def export_scan_index(forms: DataFrame, path: str, reference_types: DataFrame | None = None) -> None:
    """The index of one dump as one JSON document: a folder with a single file."""
    document = forms.agg(F.count("*").alias("total"), F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX").alias("scanned_at"), F.sort_array(F.collect_list(F.struct(*_fields(FORM)))).alias("forms"))
    if reference_types is not None:
        types = reference_types.agg(F.map_from_entries(F.collect_list(F.struct("uuid", "type_name"))).alias("reference_types"))
        document = document.join(types)  # one row each
    document.select(F.to_json(F.struct("*")).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def load_freshness(spark: SparkSession, path: str) -> DataFrame:
    """(form_name, bin_path, ..., warnings) of a freshness index: its table, or an object keyed by form name."""
    if exists(spark, f"{path}/entries"):
        return _json(spark, f"{path}/entries", f"form_name string,{_columns(ENTRY)}", lines=True)
    whole = spark.read.option("wholetext", "true").text(path)
    entries = F.explode(F.from_json(F.regexp_replace("value", "^\\uFEFF", ""), f"map<string,{ENTRY}>")).alias("form_name", "e")
    return whole.select(entries).select("form_name", "e.*")


def save_freshness(entries: DataFrame, path: str) -> None:
    """The index as a table in JSON lines below ``path``."""
    entries.select("form_name", *_fields(ENTRY)).write.mode("overwrite").json(f"{path}/entries")


def export_freshness(entries: DataFrame, path: str) -> None:
    """The index of one dump as one JSON document, an object keyed by form name."""
    one = F.map_from_entries(F.sort_array(F.collect_list(F.struct("form_name", F.struct(*_fields(ENTRY)).alias("e")))))
    entries.agg(F.to_json(one).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def save_report_queries(queries: DataFrame, path: str) -> None:
    """(report_root, name, query) as one JSON list of {name, query} per report, each in a folder of its own; a report's containers bound its list."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct("path", "ord", F.struct("name", "query").alias("q")))), lambda x: x["q"])
    documents = queries.groupBy("report_root").agg(F.to_json(listed).alias("value"))
    documents.write.mode("overwrite").partitionBy("report_root").text(path)


def load_report_queries(spark: SparkSession, path: str) -> DataFrame:
    """(report_root, name, query) of saved lists."""
    lists = spark.read.text(path).select("report_root", F.from_json("value", "array<struct<name:string,query:string>>").alias("q"))
    return lists.select("report_root", F.inline("q"))


def load_drift_report(spark: SparkSession, path: str) -> DataFrame:
    lists = ", ".join(f"{k} array<string>" for k in LISTS)
    report = _json(spark, path, f"has_drift boolean, {lists}, checked_at string")
    return report.withColumns({k: F.coalesce(k, F.array().cast("array<string>")) for k in LISTS})


def save_drift_report(report: DataFrame, path: str) -> None:
    report.write.mode("overwrite").json(path)
