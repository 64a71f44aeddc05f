"""Scan of an unpacked dump: from a listing of its files to tables of forms.

One recursive listing (path, size, time; no content) is turned into all tables by path arithmetic and
grouping. A folder that is mounted is walked by the executors, subtree by subtree; other stores are
listed by Spark's file source, which leaves out names that begin with ``_`` or ``.`` and gives files
without content no time. Content is read only of the files that a table needs. Paths are relative to the
root and have ``/``.

A missing root gives empty tables. Folders without any file are in no listing, so they are not
reported as skipped.
"""

from __future__ import annotations

import os
import stat
from collections.abc import Iterator, Sequence
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from formquarry.functions import domain as D
from formquarry.functions.text import descent, ids_of_path
from formquarry.operators import elements, objects
from formquarry.operators.dedup import keep_first
from formquarry.session import stored

IDS = ["object_type", "object_name", "container_name", "form_name"]
_MTIME = "cast(unix_micros(modificationTime) as double) / 1e6"


def _read(spark: SparkSession, root: str, columns: list[str], glob: str | None = None) -> DataFrame:
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    base = root.rstrip("/")
    below = F.expr(f"substring(path, instr(path, {_quoted(base + '/')}) + {len(base) + 1})")
    try:
        return reader.load(base).select(below.alias("path"), *[F.expr(c) for c in columns])
    except AnalysisException:
        schema = {"length": "bigint", "content": "binary"}
        return spark.createDataFrame([], "path string, " + ", ".join(f"{c.split(' AS ')[-1]} {schema.get(c, 'double')}" for c in columns))


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _mounted(root: str) -> str | None:
    """The path of a root in the file system that driver and executors mount, None for any other store."""
    path = root.removeprefix("file://").removeprefix("file:")
    return path.rstrip("/") or "/" if path.startswith("/") and os.path.isdir(path) else None


#: Folders are listed by tasks of their own down to this depth; below it each task walks its subtree.
_SPREAD_DEPTH = 2


def _walked(spark: SparkSession, root: str) -> DataFrame:
    """(path, length, mtime) of every file of a mounted folder, listed by the executors, one subtree a row."""

    def step(batches: Iterator[pd.DataFrame], deep: bool) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for folder, was_file in zip(batch["path"], batch["is_file"]):
                found, stack = [], [] if was_file else [folder]
                if was_file:
                    yield batch[batch["path"] == folder]
                    continue
                while stack:
                    with os.scandir(os.path.join(root, stack.pop())) as entries:
                        for entry in entries:
                            info = entry.stat()
                            path = os.path.relpath(entry.path, root).replace(os.sep, "/")
                            if stat.S_ISDIR(info.st_mode) and deep:
                                stack.append(path)
                            else:
                                found.append((path, info.st_size, info.st_mtime, not stat.S_ISDIR(info.st_mode)))
                yield pd.DataFrame(found, columns=["path", "length", "mtime", "is_file"])

    schema = "path string, length bigint, mtime double, is_file boolean"
    found = spark.createDataFrame([(".", 0, 0.0, False)], schema)
    for depth in range(_SPREAD_DEPTH + 1):
        last = depth == _SPREAD_DEPTH
        found = found.mapInPandas(lambda batches, last=last: step(batches, last), schema)
        found = found if last else found.repartition("path")  # few folders end up in few tasks
    return found.where("is_file").select("path", "length", "mtime")


def _empty_files(spark: SparkSession, root: str, listed: DataFrame) -> DataFrame:
    """(path, length, mtime) of files without content in a store that is not mounted: Spark's file sources list and then leave them out.

    Their paths are compared with the listing that the file source makes on the driver anyway.
    """
    base = root.rstrip("/")
    schema = "path string, length bigint, mtime double"
    try:
        names = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(base).inputFiles()
    except AnalysisException:
        return spark.createDataFrame([], schema)
    below = base.removeprefix("file:").rstrip("/") + "/"
    paths = [(p[p.index(below) + len(below) :],) for p in map(unquote, names) if below in p]
    missing = spark.createDataFrame(paths, "path string").join(listed, "path", "left_anti")
    return missing.select("path", F.lit(0).cast("bigint").alias("length"), F.lit(0.0).alias("mtime"))


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, dir, name, parts, length, mtime) of every file below the root; stored, so that all who read it see the same files."""
    if mounted := _mounted(root):
        every = _walked(spark, mounted)
    else:
        listed = _read(spark, root, ["length", f"{_MTIME} AS mtime"])
        every = listed.unionByName(_empty_files(spark, root, listed))
    parts = F.split("path", "/")
    named = every.select("path", F.array_join(F.slice(parts, 1, F.size(parts) - 1), "/").alias("dir"), F.element_at(parts, -1).alias("name"), parts.alias("parts"), "length", "mtime")
    return stored(named, "files")


def contents(spark: SparkSession, root: str, glob: str) -> DataFrame:
    """(path, content) of the files whose names match."""
    return _read(spark, root, ["content"], glob)


def texts(spark: SparkSession, root: str, glob: str) -> DataFrame:
    """(path, text) of the files whose names match; bytes that are not UTF-8 become replacement characters."""
    return _read(spark, root, ["content"], glob).select("path", F.decode("content", "UTF-8").alias("text"))


def _first(test: Column, column: str = "path") -> Column:
    return F.min(F.when(test, F.col(column)))


def config_forms(files: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Form folders of a configuration: (by..., ids, form_path, bsl_path, json_path, elem_json_path, bsl_mtime); bsl_path NULL = skipped.

    ``by``: columns that tell the dumps apart in a listing of several; so for the other functions on listings.     A top folder ending in ``Form`` is a container of its own (no object name); else type, object,
    container ending in ``Form``, form.
    """
    three = F.get("parts", F.lit(0)).endswith("Form")
    depth = F.when(three, 2).otherwise(4)
    placed = files.where(F.size("parts") > depth).withColumn("ids", F.when(three, F.struct(F.col("parts")[0].alias("object_type"), F.lit("").alias("object_name"), F.col("parts")[0].alias("container_name"), F.col("parts")[1].alias("form_name"))).otherwise(
        F.struct(F.col("parts")[0].alias("object_type"), F.get("parts", F.lit(1)).alias("object_name"), F.get("parts", F.lit(2)).alias("container_name"), F.get("parts", F.lit(3)).alias("form_name"))
    ))
    inside = placed.withColumn("form_path", F.array_join(F.slice("parts", 1, depth), "/")).where(F.col("ids.container_name").endswith("Form"))
    direct = F.col("dir") == F.col("form_path")
    module = direct & (F.col("name") == F.concat("ids.container_name", F.lit(".obj.bsl")))
    return inside.groupBy(*by, "ids", "form_path").agg(
        _first(module).alias("bsl_path"),
        _first(direct & (F.col("name") == F.concat("ids.container_name", F.lit(".json")))).alias("json_path"),
        _first(direct & F.col("name").endswith(".elem.json")).alias("elem_json_path"),
        F.lit(None).cast("string").alias("form_elem_path"),
        F.max(F.when(module, F.col("mtime"))).alias("bsl_mtime"),
    ).select(*by, "ids.*", "form_path", "bsl_path", "json_path", "elem_json_path", "form_elem_path", "bsl_mtime")


def external_forms(files: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Form folders of external objects, below ``External`` if there is such a folder; columns as ``config_forms``.

    Files named after the container come before those named ``Form``, ``.obj.bsl`` before ``.obj``.
    """
    has_base = files.groupBy(*by).agg(F.coalesce(F.bool_or(F.col("parts")[0] == "External"), F.lit(False)).alias("has_base"))
    based = (files.join(has_base, list(by)) if by else files.join(F.broadcast(has_base))).withColumn("n", F.col("has_base").cast("int")).where("NOT has_base OR parts[0] = 'External'")
    named = based.withColumn("object_name", F.get("parts", F.col("n"))).withColumn("container_name", F.get("parts", F.col("n") + 1))
    modules = named.where(F.size("parts") == F.col("n") + 2).groupBy(*by, "object_name").agg(
        F.bool_or(F.col("name").isin("ExternalDataProcessor.obj.bsl", "ExternalDataProcessor.obj")).alias("processor"), F.bool_or(F.col("name").isin("ExternalReport.obj.bsl", "ExternalReport.obj")).alias("report")
    )
    inside = named.where((F.size("parts") > F.col("n") + 3) & F.col("container_name").isin("Form", "ReportForm")).withColumn("form_name", F.get("parts", F.col("n") + 2)).withColumn("form_path", F.array_join(F.slice("parts", 1, F.col("n") + 3), "/"))
    direct = F.col("dir") == F.col("form_path")

    def ranked(*names: Column) -> Column:
        rank = F.lit(None).cast("int")
        for i, name in reversed(list(enumerate(names))):
            rank = F.when(F.col("name") == name, i).otherwise(rank)
        return F.min(F.when(direct & rank.isNotNull(), F.struct(rank.alias("r"), "path", "mtime")))

    own = lambda ending: F.concat("container_name", F.lit(ending))
    grouped = inside.groupBy(*by, "object_name", "container_name", "form_name", "form_path").agg(
        ranked(own(".obj.bsl"), own(".obj")).alias("bsl"),
        ranked(own(".json"), F.lit("Form.json")).getField("path").alias("json_path"),
        _first(direct & F.col("name").endswith(".elem.json")).alias("elem_json_path"),
        ranked(own(".elem"), F.lit("Form.elem")).getField("path").alias("form_elem_path"),
    )
    kind = F.when(F.col("container_name") == "ReportForm", "ExternalReport").when(F.col("processor"), "ExternalDataProcessor").when(F.col("report"), "ExternalReport").otherwise("ExternalDataProcessor")
    return grouped.join(modules, [*by, "object_name"], "left").select(*by, kind.alias("object_type"), "object_name", "container_name", "form_name", "form_path", F.col("bsl.path").alias("bsl_path"), "json_path", "elem_json_path", "form_elem_path", F.col("bsl.mtime").alias("bsl_mtime"))


def elem_forms(files: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Folders with an element file below a container: its artifacts and the sets of files of other versions."""
    size = F.size("parts")
    held = files.where((size >= 3) & F.get("parts", size - 3).endswith("Form"))
    version = F.coalesce(F.when(F.col("name").endswith(".json") & ~F.col("name").endswith(".id.json") & ~F.col("name").endswith(".elem.json"), descent(F.col("name"), "json")), descent(F.col("name"), "bsl"))
    module = F.col("name").endswith(".bsl") & F.col("name").rlike(r"\.obj(\..*)?\.bsl$")
    is_elem, is_id = F.col("name").endswith(".elem.json"), F.col("name").endswith(".id.json")
    plain_json = F.col("name").endswith(".json") & ~is_elem & ~is_id
    rows = held.withColumn("version", version)
    pair = rows.where("version IS NOT NULL").groupBy(*by, "dir", "version").agg(_first(plain_json).alias("aux_json_path"), _first(module).alias("bsl_path"))
    sets = pair.groupBy(*by, "dir").agg(F.array_sort(F.collect_list(F.struct(F.col("version").alias("descent"), "aux_json_path", "bsl_path"))).alias("descent_artifacts"))
    forms = rows.groupBy(*by, "dir").agg(
        _first(is_elem).alias("elem_json_path"),
        F.count_if(is_elem).alias("elem_files"),
        _first(plain_json & F.col("version").isNull()).alias("meta_json_path"),
        _first(is_id).alias("id_json_path"),
        _first(module & F.col("version").isNull()).alias("plain_bsl"),
    ).where("elem_json_path IS NOT NULL")
    joined = forms.join(sets, [*by, "dir"], "left").withColumn("descent_artifacts", F.coalesce("descent_artifacts", F.expr("cast(array() as array<struct<descent:string,aux_json_path:string,bsl_path:string>>)")))
    said = F.array_compact(F.array(F.when(F.col("elem_files") > 1, "multiple *.elem.json"), F.when(F.size("descent_artifacts") > 1, "multiple descent sets; all are kept")))
    versioned = F.expr("get(filter(descent_artifacts, d -> d.bsl_path IS NOT NULL), 0).bsl_path")
    return joined.select(*by, F.col("dir").alias("form_path"), "elem_json_path", "meta_json_path", "id_json_path", F.coalesce("plain_bsl", versioned).alias("bsl_path"), "descent_artifacts", said.alias("extra_warnings"))


def form_bins(files: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(form_name, bin_path, bin_mtime) of ``Form.bin`` files; the name follows the last ``Forms``; the last path of a name counts."""
    after = F.expr("array_position(reverse(parts), 'Forms')").cast("int")
    named = files.where("name = 'Form.bin'").withColumn("at", after).where("at > 1").select(*by, F.expr("parts[size(parts) - at + 1]").alias("form_name"), F.col("path").alias("bin_path"), F.col("mtime").alias("bin_mtime"))
    return named.groupBy(*by, "form_name").agg(F.max(F.struct("bin_path", "bin_mtime")).alias("b")).select(*by, "form_name", "b.*")


def elem_only_forms(files: DataFrame, coded: DataFrame, external: bool = False, by: Sequence[str] = ()) -> DataFrame:
    """Forms that have an element file and are not among ``coded`` (by..., form_path): columns as ``config_forms`` and warnings."""
    only = elem_forms(files, by).join(coded.select(*by, "form_path").distinct(), [*by, "form_path"], "left_anti")
    none = F.lit(None).cast("string")
    named = only.select(*by, ids_of_path(F.col("form_path"), external).alias("i"), "form_path", "elem_json_path").select(*by, "i.*", "form_path", "elem_json_path")
    return named.select(*by, *IDS, "form_path", none.alias("bsl_path"), none.alias("json_path"), "elem_json_path", none.alias("form_elem_path"), F.lit(0.0).alias("bsl_mtime"), F.array(F.lit("elem-only: no .obj.bsl found")).alias("warnings"))


def scan_forms(spark: SparkSession, root: str, mode: str = "config", include_elem_only: bool = True, structure: bool = True) -> DataFrame:
    """The inventory: ids, paths, warnings, time and hash of the code, hash of the structure.

    Forms without code are left out, unless they have an element file and ``include_elem_only``.
    ``structure=False`` leaves out the structure hash, and so the parsing.
    """
    files = list_files(spark, root)
    all_forms = external_forms(files) if mode == "external" else config_forms(files)
    coded = all_forms.where("bsl_path IS NOT NULL").withColumn("warnings", F.array_compact(F.array(F.when(F.col("json_path").isNull(), F.concat(F.lit("missing "), "container_name", F.lit(".json"))))))
    forms = coded
    if include_elem_only:
        forms = coded.unionByName(elem_only_forms(files, coded, mode == "external"))
    code = _read(spark, root, ["sha2(content, 256) AS bsl_sha256"], "*.obj*").select(F.col("path").alias("bsl_path"), F.col("bsl_sha256"))
    empty = F.when(F.col("bsl_path").isNotNull(), F.sha2(F.lit(""), 256))
    found = forms.join(code, "bsl_path", "left").withColumn("bsl_sha256", F.coalesce("bsl_sha256", empty))
    if structure:
        hashes = parsed_forms(spark, root, files, forms).select("form_path", F.col("parsed.elem_sha256").alias("elem_sha256"))
        found = found.join(hashes, "form_path", "left")
    else:
        found = found.withColumn("elem_sha256", F.lit(None).cast("string"))
    return found.select(*IDS, "form_path", "bsl_path", "json_path", "form_elem_path", "elem_json_path", "warnings", "bsl_mtime", "bsl_sha256", "elem_sha256")


def scan_warnings(spark: SparkSession, root: str, mode: str = "config") -> DataFrame:
    """(warning) of folders that hold no code, in order of their paths."""
    files = list_files(spark, root)
    forms = external_forms(files) if mode == "external" else config_forms(files)
    return forms.where("bsl_path IS NULL").orderBy("form_path").select(F.concat(F.lit("skipped (no .obj.bsl): "), "form_path").alias("warning"))


def item_modules(files: DataFrame, forms: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by..., form_path, ord, path): the modules below ``Items`` of each form, in order of their paths."""
    below = F.transform(F.filter(F.sequence(F.lit(1), F.size("parts") - 2), lambda n: F.get("parts", n) == "Items"), lambda n: F.array_join(F.slice("parts", 1, n), "/"))
    inside = files.where("name LIKE '%.bsl' AND size(parts) > 2").select(*by, "path", F.explode(below).alias("form_path"))
    listed = inside.join(forms.select(*by, "form_path").distinct(), [*by, "form_path"], "left_semi")
    return listed.groupBy(*by, "form_path").agg(F.array_sort(F.collect_list("path")).alias("paths")).select(*by, "form_path", F.posexplode("paths").alias("ord", "path"))


def module_paths(files: DataFrame, forms: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by..., form_path, ord, path): the form's own module, if it has one, and then those of its items."""
    own = forms.where("bsl_path IS NOT NULL").select(*by, "form_path", F.lit(0).alias("ord"), F.col("bsl_path").alias("path"))
    return own.unionByName(item_modules(files, forms, by).withColumn("ord", F.col("ord") + 1))


def owner_files(files: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by..., object_type, object_name, path) of the metadata files of objects: ``<object>/<object>.json``, else ``<object>/<type>.json``, else the first."""
    direct = files.where((F.size("parts") == 3) & F.col("name").endswith(".json")).select(*by, F.col("parts")[0].alias("object_type"), F.col("parts")[1].alias("object_name"), "name", "path")
    rank = F.when(F.col("name") == F.concat("object_name", F.lit(".json")), 0).when(F.col("name") == F.concat("object_type", F.lit(".json")), 1).otherwise(2)
    return keep_first(direct.withColumn("rank", rank), [*by, "object_type", "object_name"], ["rank", "name"]).select(*by, "object_type", "object_name", "path")


def owner_objects(spark: SparkSession, root: str, files: DataFrame | None = None) -> DataFrame:
    """Owner objects with their decoded headers."""
    files = list_files(spark, root) if files is None else files
    with_text = owner_files(files).join(texts(spark, root, "*.json"), "path")
    return objects.decode_objects(with_text, "text").select("object_type", "object_name", "path", "decoded", "text")


def attribute_map(owned: DataFrame) -> DataFrame:
    """(object_type, object_name, names): attributes, columns and the platform's own attributes by UUID, the first counts."""
    rows = objects.object_attributes(owned, ["object_type", "object_name"]).select("object_type", "object_name", "uuid", "name", F.coalesce("section_ord", F.lit(-1)).alias("section_ord"), "attr_ord")
    header = "get_json_object(text, '$.header[0][1][{0}]')"
    standard = F.array(*[F.struct(F.expr(header.format(slot)).alias("uuid"), F.lit(name).alias("name"), F.lit(1 << 30).alias("section_ord"), F.lit(slot).alias("attr_ord")) for slot, name in D.STANDARD_SLOTS.items()])
    platform = owned.where(F.col("object_type").isin(*D.STANDARD_OWNERS)).select("object_type", "object_name", F.inline(standard)).where("length(uuid) = 36")
    return objects.attribute_names(rows.unionByName(platform), ["object_type", "object_name"])


def parsed_forms(spark: SparkSession, root: str, files: DataFrame, forms: DataFrame) -> DataFrame:
    """``forms`` with ``parsed`` elements and the ``module`` text, for those that have an element file.

    The positional form is the largest other JSON file of the folder, the code the first of three known
    places or the first module below it.
    """
    inside = files.select("path", "dir", "name", "length")
    other = inside.where("name LIKE '%.json' AND name NOT LIKE '%.elem.json' AND substring(name, 1, length(name) - 5) NOT LIKE '%.id%' AND name != 'form_elements_index.json'")
    positional = other.groupBy(F.col("dir").alias("form_path")).agg(F.max_by("path", F.struct("length", "path")).alias("form_json"))
    code = files.where("name LIKE '%.bsl'").select("path", "name", "parts")
    above = code.select("path", "name", F.explode(F.transform(F.sequence(F.lit(1), F.size("parts") - 1), lambda n: F.array_join(F.slice("parts", 1, n), "/"))).alias("form_path"))
    rest = F.substring("path", F.length("form_path") + 2, 1 << 20)
    rank = F.when(rest == "Form.obj.bsl", 0).when(rest == "ReportForm.obj.bsl", 1).when(rest == "Ext/ObjectModule.bsl", 2).otherwise(3)
    module = above.join(forms.select("form_path"), "form_path", "left_semi").groupBy("form_path").agg(F.min_by("path", F.struct(rank.alias("r"), "path")).alias("module_path"))
    elem = texts(spark, root, "*.elem.json").select(F.col("path").alias("elem_json_path"), F.col("text").alias("elem"))
    json = texts(spark, root, "*.json").select(F.col("path").alias("form_json"), F.col("text").alias("form_text"))
    bsl = texts(spark, root, "*.bsl").select(F.col("path").alias("module_path"), F.col("text").alias("module"))
    names = attribute_map(owner_objects(spark, root, files))
    joined = (
        forms.where("elem_json_path IS NOT NULL").join(elem, "elem_json_path", "left").join(positional, "form_path", "left").join(json, "form_json", "left")
        .join(module, "form_path", "left").join(bsl, "module_path", "left").join(names, ["object_type", "object_name"], "left")
    )
    joined = joined.withColumns({"elem": F.coalesce("elem", F.lit("")), "module": F.coalesce("module", F.when(F.col("module_path").isNotNull(), ""))})
    common = F.array_contains(F.split("form_path", "/"), "CommonForm")
    return elements.parse_forms(joined, "elem", F.col("names"), F.col("form_text"), F.col("module"), common).drop("elem", "form_text", "names", "form_json", "module_path")
