"""End-to-end operators over a folder: scan, drift check, contexts, report queries, unpacking with a caller's function.

Each is a plan over one listing; what is read twice is stored once in the shared folder.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from formquarry.operators import bindings, drift, freshness, objects, reports, routing, summary
from formquarry.session import stored
from formquarry.sources import dump, indexes

_OWNER = ["object_type", "object_name"]
#: What an unpacker returns for a form.
ARTIFACT = "form_name string, bin_path string, unpacked_root string, unpacked_mtime double, extraction_ok boolean, warnings array<string>"


def _is_folder(spark: SparkSession, root: str) -> bool:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    system = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return system.exists(place) and system.getFileStatus(place).isDirectory()


def check_drift(spark: SparkSession, root: str, index: str, save_to: str | None = None, mode: str = "config") -> DataFrame:
    """The report (one row) of the changes of a folder against a saved index.

    A root that is no folder is an error. Without an index all forms with code are added; an index that can't be
    read counts as an empty one, with a warning, and so does a scan without forms.
    """
    if not _is_folder(spark, root):
        raise NotADirectoryError(root)
    known = indexes.exists(spark, index)
    baseline = stored(indexes.load_scan_index(spark, index), "baseline")
    if known and baseline.isEmpty():
        warnings.warn(f"the index {index} has no forms or can't be read", stacklevel=2)
    files = dump.list_files(spark, root)
    current = stored(dump.scan_forms(spark, root, mode), "forms")
    if current.isEmpty():
        warnings.warn(f"the scan of {root} ({mode}) found no forms", stacklevel=2)
    changes = drift.drift(baseline, current).unionByName(drift.stale(baseline, files))
    report = stored(drift.drift_report(changes), "report")
    if save_to:
        indexes.save_drift_report(report, save_to)
    return report


def report_queries(spark: SparkSession, root: str, save_to: str | None = None, nearest: bool = True) -> DataFrame:
    """(report_root, path, extracted, warnings, datasets) of every ``Template.bin`` below a folder; ``save_to`` writes the query lists.

    Without any container there is one row, with a warning.
    """
    found = dump.contents(spark, root, "Template.bin").withColumn("report_root", reports.report_root(F.col("path")))
    read = reports.containers(found, nearest=nearest)
    said = F.when(F.col("report.warning").isNotNull(), F.array(F.concat_ws(": ", F.nullif("report_root", F.lit("")), "report.warning"))).otherwise(F.array().cast("array<string>"))
    rows = stored(read.select("report_root", "path", (F.size("report.datasets") > 0).alias("extracted"), said.alias("warnings"), "report.datasets"), "reports")
    if rows.isEmpty():
        kind = rows.schema["datasets"].dataType.simpleString()
        return spark.createDataFrame([("", None, False, [f"no Template.bin below {root}"], [])], f"report_root string, path string, extracted boolean, warnings array<string>, datasets {kind}")
    if save_to:
        indexes.save_report_queries(rows.select("report_root", "path", F.inline("datasets")), save_to)
    return rows


def batch_extracted(rows: DataFrame) -> DataFrame:
    """One row for the whole batch of ``report_queries``: whether anything was extracted, and all warnings."""
    return rows.agg(F.coalesce(F.bool_or("extracted"), F.lit(False)).alias("skd_extracted"), F.count_if("extracted").alias("extracted"), F.count("*").alias("containers"), F.array_sort(F.flatten(F.collect_list("warnings"))).alias("warnings"))


def form_contexts(spark: SparkSession, root: str, mode: str = "config", types: DataFrame | None = None, limit: int = -1) -> DataFrame:
    """(form_path, ids, metadata, context): the rendered context of every form of a folder, with its code.

    ``types`` (uuid, type_name) resolves reference types; without it they stay references.
    """
    files = dump.list_files(spark, root)
    forms = stored(dump.scan_forms(spark, root, mode, structure=False).drop("elem_sha256"), "forms")
    owned = stored(dump.owner_objects(spark, root, files).drop("text"), "owners")
    parsed = stored(dump.parsed_forms(spark, root, files, forms), "parsed")
    attributes = objects.object_attributes(owned, _OWNER).select(*_OWNER, F.coalesce("section_ord", F.lit(-1)).alias("section_ord"), "attr_ord", "name", "synonym", "type", "uuid", "section_name")
    if types is not None:
        attributes = objects.resolve_types(attributes, types)
    rows = stored(parsed.select("form_path", *_OWNER, F.inline("parsed.elements")), "elements")
    paths = rows.where("data_path IS NOT NULL").select("form_path", *_OWNER, "data_path").distinct()
    bound = bindings.resolve_paths(paths, attributes.withColumn("attr_ord", F.struct("section_ord", "attr_ord")), _OWNER)
    code = dump.texts(spark, root, "*.obj*").select(F.col("path").alias("bsl_path"), F.col("text").alias("module"))
    said = parsed.select("form_path", "parsed.warnings", "parsed.elem_sha256").withColumnRenamed("warnings", "parse_warnings")
    # A module without content is in no content scan: it is empty, not absent.
    module = F.coalesce("module", F.when(F.col("bsl_path").isNotNull(), ""))
    read = forms.join(code, "bsl_path", "left").join(said, "form_path", "left").withColumn("module", module)
    read = read.withColumn("warnings", F.concat("warnings", F.coalesce("parse_warnings", F.array().cast("array<string>"))))
    lists = summary.summaries(summary.summary_rows(rows, ["form_path"]), ["form_path"])
    return summary.form_contexts(read, lists, attributes, bound, ["form_path"], _OWNER, limit)


def unpack_forms(spark: SparkSession, dump_root: str, unpacked_root: str, unpacker: Callable[[str, str, str], dict], form_names: Iterable[str] | None = None) -> DataFrame:
    """Artifacts (ARTIFACT, elem_index_ok) of the binaries below ``dump_root``, unpacked by the caller's function on the executors.

    ``unpacker`` (bin path, unpacked root, form name) returns the fields of ARTIFACT that it knows; what it raises makes an
    artifact that failed, with the reason as its warning. The element files below ``unpacked_root`` are parsed afterwards.
    ``form_names`` selects; names without a binary are left out. Each binary is unpacked once: the result is stored.
    """
    bins = dump.form_bins(dump.list_files(spark, dump_root))
    if form_names is not None:
        wanted = spark.createDataFrame([(n,) for n in set(form_names)], "form_name string")
        bins = bins.join(wanted, "form_name", "left_semi")
    base = dump_root.rstrip("/")

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for name, path in zip(batch["form_name"], batch["bin_path"]):
                try:
                    made = unpacker(f"{base}/{path}", unpacked_root, name)
                except Exception as wrong:  # noqa: BLE001 - one form never ends the run
                    made = {"extraction_ok": False, "warnings": [f"{type(wrong).__name__}: {wrong}"]}
                rows.append((name, path, made.get("unpacked_root", f"{unpacked_root}/{name}"), made.get("unpacked_mtime"), bool(made.get("extraction_ok")), list(made.get("warnings") or [])))
            yield pd.DataFrame(rows, columns=["form_name", "bin_path", "unpacked_root", "unpacked_mtime", "extraction_ok", "warnings"])

    made = stored(bins.select("form_name", "bin_path").repartition("form_name").mapInPandas(unpack, ARTIFACT), "unpacked")
    return stored(freshness.checked_artifacts(_with_elements(spark, unpacked_root, made)), "artifacts")


def _with_elements(spark: SparkSession, unpacked_root: str, made: DataFrame) -> DataFrame:
    """Artifacts with whether their element file (below the folder named after the form) has elements, and its warnings."""
    texts = dump.texts(spark, unpacked_root, "*.elem.json")
    elem = texts.withColumn("form_name", F.split("path", "/")[0]).groupBy("form_name").agg(F.min_by("text", "path").alias("elem"))
    parsed = stored(dump.elements.parse_forms(elem, "elem").select("form_name", "parsed.ok", F.col("parsed.warnings").alias("said")), "parsed")
    joined = made.join(parsed, "form_name", "left")
    none = F.array().cast("array<string>")
    return joined.select("form_name", "bin_path", "unpacked_root", "unpacked_mtime", "extraction_ok", F.concat(F.coalesce("warnings", none), F.coalesce("said", none)).alias("warnings"), F.coalesce("ok", F.lit(False)).alias("elem_index_ok"))


def unpack_report(spark: SparkSession, path: str, unpacked_root: str, unpacker: Callable[[str, str], dict]) -> DataFrame:
    """One row (extraction_ok, warnings, skd_extracted): a report unpacked by the caller's function, and whether its containers have queries.

    Queries are a by-product: without any the extraction is as good as the unpacker says.
    """
    made = unpacker(path, unpacked_root)
    found = batch_extracted(report_queries(spark, unpacked_root))
    return found.select(F.lit(bool(made.get("extraction_ok"))).alias("extraction_ok"), F.lit(list(made.get("warnings") or [])).cast("array<string>").alias("warnings"), "skd_extracted")


def update_forms_index(spark: SparkSession, dump_root: str, artifacts: DataFrame, index: DataFrame | None = None) -> DataFrame:
    """The freshness index with the entries of the artifacts put over it; artifacts without a binary change nothing."""
    bins = dump.form_bins(dump.list_files(spark, dump_root))
    entries = freshness.entries_of_artifacts(artifacts.drop("bin_path"), bins)
    return entries if index is None else routing.upsert(index.select(*entries.columns), entries, ["form_name"])
