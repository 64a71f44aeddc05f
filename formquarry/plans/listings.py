"""Queries of the dump scan over listings of all snapshots of all dumps.

A listing of files is written from the paths in form_scans (and freshness), as if every snapshot were
unpacked once more, and the scan's operators turn it into forms again; the SQL twins say from the tables
what must come out.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from formquarry.session import read_table
from formquarry.sources import dump

_BY = ["dump_id", "snapshot_no"]
#: SQL of both engines: the folder of a form below the root; a container of its own has no object above it.
_FOLDER = "CASE WHEN object_type = container_name THEN container_name || '/' || form_name ELSE object_type || '/' || object_name || '/' || container_name || '/' || form_name END"
_OWN = "(object_type = container_name OR coalesce(object_name, '') != '')"


def _forms(spark, sf):
    return read_table(spark, sf, "form_scans").where(f"dump_id IS NOT NULL AND snapshot_no IS NOT NULL AND {_OWN}").withColumn("folder", F.expr(_FOLDER))


def _listing(rows, files, *by):
    """A listing (by..., path, dir, name, parts, length, mtime) of the paths that an array of SQL texts gives for each row; mtime: ``bsl_mtime``."""
    paths = rows.select(*by, F.explode(F.array_compact(F.array(*map(F.expr, files)))).alias("path"), F.coalesce("bsl_mtime", F.lit(0.0)).alias("mtime"))
    one = paths.groupBy(*by, "path").agg(F.max("mtime").alias("mtime"))
    parts = F.split("path", "/")
    return one.select(*by, "path", F.array_join(F.slice(parts, 1, F.size(parts) - 1), "/").alias("dir"), F.element_at(parts, -1).alias("name"), parts.alias("parts"), F.lit(1).cast("bigint").alias("length"), "mtime")


_CODE = ["if(bsl_path IS NOT NULL, folder || '/' || container_name || '.obj.bsl', NULL)"]
_REST = ["if(json_path IS NOT NULL, folder || '/' || container_name || '.json', NULL)", "if(elem_json_path IS NOT NULL, folder || '/' || container_name || '.elem.json', NULL)"]


def listing_config(spark, sf):
    """Forms of a configuration's layout."""
    forms = dump.config_forms(_listing(_forms(spark, sf), [*_CODE, *_REST], *_BY), _BY)
    return forms.where("bsl_path IS NOT NULL").select(*_BY, *dump.IDS, "form_path", "bsl_path", "json_path", "elem_json_path", "bsl_mtime")


def listing_elem_only(spark, sf):
    """Forms that have an element file and no code, where catalogs are listed without code."""
    files = _listing(_forms(spark, sf), ["if(object_type != 'Catalog', folder || '/' || container_name || '.obj.bsl', NULL)", *_REST], *_BY)
    coded = dump.config_forms(files, _BY).where("bsl_path IS NOT NULL")
    return dump.elem_only_forms(files, coded, by=_BY).select(*_BY, *dump.IDS, "form_path", "elem_json_path", F.array_join("warnings", "|").alias("warnings"))


_OUTSIDE = "'External/' || object_type || '.' || object_name"
_HELD = "CASE WHEN object_type = 'Report' THEN 'ReportForm' ELSE 'Form' END"


def listing_external(spark, sf):
    """Forms of the layout of external objects: their types, and which of several candidates for a file counts."""
    rows = _forms(spark, sf).where("coalesce(object_name, '') != ''").withColumn("held", F.expr(_HELD)).withColumn("base", F.expr(_OUTSIDE)).withColumn("at", F.expr("base || '/' || held || '/' || form_name || '/'"))
    files = [
        "if(snapshot_no % 2 = 0, at || held || '.obj.bsl', NULL)", "at || held || '.obj'", "if(json_path IS NOT NULL, at || held || '.json', NULL)", "at || 'Form.json'", "if(form_elem_path IS NOT NULL, at || 'Form.elem', NULL)",
        "if(object_type = 'Catalog', base || '/ExternalReport.obj', NULL)", "if(object_type = 'Document', base || '/ExternalDataProcessor.obj.bsl', NULL)",
    ]
    return dump.external_forms(_listing(rows, files, *_BY), _BY).select(*_BY, *dump.IDS, "bsl_path", "json_path", "form_elem_path")


def listing_artifacts(spark, sf):
    """The artifact set of each folder with an element file: auxiliary files, versions and the module that counts."""
    rows = _forms(spark, sf).where("elem_json_path IS NOT NULL").withColumn("stem", F.expr("folder || '/' || container_name"))
    files = [
        "stem || '.elem.json'", "if(json_path IS NOT NULL, stem || '.json', NULL)", "stem || '.id.json'", "stem || '.3.0.' || snapshot_no || '.json'", "stem || '.obj.3.0.' || snapshot_no || '.bsl'",
        "if(object_type = 'Document', stem || '.obj.7.bsl', NULL)", "if(object_type != 'Catalog', stem || '.obj.bsl', NULL)", "stem || '.mgr.bsl'",
    ]
    found = dump.elem_forms(_listing(rows, files, *_BY), _BY)
    sets = F.array_join(F.transform("descent_artifacts", lambda d: F.concat_ws("=", d["descent"], F.coalesce(d["aux_json_path"], F.lit("")), F.coalesce(d["bsl_path"], F.lit("")))), "|")
    return found.select(*_BY, "form_path", "elem_json_path", "meta_json_path", "id_json_path", "bsl_path", sets.alias("descents"), F.array_join("extra_warnings", "|").alias("extra_warnings"))


def listing_bins(spark, sf):
    """Binaries of forms by the name that their path tells."""
    rows = read_table(spark, sf, "freshness").where("bin_path IS NOT NULL").select("bin_path", F.col("bin_mtime").alias("bsl_mtime"))
    return dump.form_bins(_listing(rows, ["bin_path"]))


def listing_owners(spark, sf):
    """The metadata file of each object, by what its folder has."""
    rows = _forms(spark, sf).where("coalesce(object_name, '') != ''").select("dump_id", "object_type", "object_name", F.lit(0.0).alias("bsl_mtime"), F.expr("length(object_name) % 3").alias("v"), F.expr("object_type || '/' || object_name || '/'").alias("at"))
    files = ["if(v = 0, at || object_name || '.json', NULL)", "if(v < 2, at || object_type || '.json', NULL)", "at || '0.json'", "at || '1.json'", "at || '0.txt'"]
    return dump.owner_files(_listing(rows, files, "dump_id"), ["dump_id"])


def listing_modules(spark, sf):
    """The modules of each form and of its items, in order."""
    rows = _forms(spark, sf)
    files = [*_CODE, "folder || '/Items/B/' || snapshot_no || '.bsl'", "if(json_path IS NOT NULL, folder || '/Items/A/C/x.bsl', NULL)", "folder || '/Items/note.txt'"]
    listing = _listing(rows, files, *_BY)
    forms = dump.config_forms(listing, _BY)
    return dump.module_paths(listing, forms, _BY).select(*_BY, "form_path", F.col("ord").cast("int").alias("ord"), "path")


QUERIES = {f.__name__: f for f in (listing_config, listing_elem_only, listing_external, listing_artifacts, listing_bins, listing_owners, listing_modules)}

_SCANS = f"""
WITH forms AS (
  SELECT *, {_FOLDER} AS folder FROM form_scans WHERE dump_id IS NOT NULL AND snapshot_no IS NOT NULL AND {_OWN}
), folders AS (
  SELECT dump_id, snapshot_no, object_type, CASE WHEN object_type = container_name THEN '' ELSE object_name END AS object_name, container_name, form_name, folder,
    bool_or(bsl_path IS NOT NULL) AS code, bool_or(json_path IS NOT NULL) AS json, bool_or(elem_json_path IS NOT NULL) AS elem, bool_or(form_elem_path IS NOT NULL) AS form_elem,
    max(coalesce(bsl_mtime, 0.0)) FILTER (bsl_path IS NOT NULL) AS mtime
  FROM forms GROUP BY ALL
)"""
_named = lambda test, path: f"CASE WHEN {test} THEN {path} END"
_stem = "folder || '/' || container_name || "

ORACLES = {
    "listing_config": _SCANS
    + f" SELECT dump_id, snapshot_no, object_type, object_name, container_name, form_name, folder AS form_path, {_stem}'.obj.bsl' AS bsl_path, {_named('json', _stem + chr(39) + '.json' + chr(39))} AS json_path, {_named('elem', _stem + chr(39) + '.elem.json' + chr(39))} AS elem_json_path, mtime AS bsl_mtime FROM folders WHERE code",
    "listing_elem_only": _SCANS
    + f""" SELECT dump_id, snapshot_no, CASE WHEN object_type = container_name THEN '' ELSE object_type END AS object_type, object_name, container_name, form_name, folder AS form_path, {_stem}'.elem.json' AS elem_json_path, 'elem-only: no .obj.bsl found' AS warnings
FROM folders WHERE elem AND object_type = 'Catalog'""",
    "listing_external": _SCANS
    + f""", outside AS (
  SELECT dump_id, snapshot_no, CASE WHEN object_type IN ('Report', 'Catalog') THEN 'ExternalReport' ELSE 'ExternalDataProcessor' END AS kind, object_type || '.' || object_name AS object_name, {_HELD} AS held, form_name, {_OUTSIDE} || '/' || {_HELD} || '/' || form_name || '/' AS place,
    bool_or(json) AS json, bool_or(form_elem) AS form_elem FROM folders WHERE object_name != '' GROUP BY ALL
)
SELECT dump_id, snapshot_no, kind AS object_type, object_name, held AS container_name, form_name, place || held || CASE WHEN snapshot_no % 2 = 0 THEN '.obj.bsl' ELSE '.obj' END AS bsl_path,
  CASE WHEN json THEN place || held || '.json' ELSE place || 'Form.json' END AS json_path, CASE WHEN form_elem THEN place || 'Form.elem' END AS form_elem_path FROM outside""",
    "listing_artifacts": """
WITH forms AS (SELECT *, """
    + _FOLDER
    + f""" AS folder FROM form_scans WHERE dump_id IS NOT NULL AND snapshot_no IS NOT NULL AND elem_json_path IS NOT NULL AND {_OWN}),
stems AS (SELECT dump_id, snapshot_no, object_type, folder, folder || '/' || container_name AS stem, '3.0.' || snapshot_no AS v, bool_or(json_path IS NOT NULL) AS json FROM forms GROUP BY ALL)
SELECT dump_id, snapshot_no, folder AS form_path, stem || '.elem.json' AS elem_json_path, CASE WHEN json THEN stem || '.json' END AS meta_json_path, stem || '.id.json' AS id_json_path,
  CASE WHEN object_type != 'Catalog' THEN stem || '.obj.bsl' ELSE stem || '.obj.' || v || '.bsl' END AS bsl_path,
  v || '=' || stem || '.' || v || '.json=' || stem || '.obj.' || v || '.bsl' || CASE WHEN object_type = 'Document' THEN '|7==' || stem || '.obj.7.bsl' ELSE '' END AS descents,
  CASE WHEN object_type = 'Document' THEN 'multiple descent sets; all are kept' ELSE '' END AS extra_warnings FROM stems""",
    "listing_bins": "SELECT string_split(bin_path, '/')[-3] AS form_name, max(bin_path) AS bin_path, arg_max(bin_mtime, bin_path) AS bin_mtime FROM (SELECT bin_path, max(coalesce(bin_mtime, 0.0)) AS bin_mtime FROM freshness WHERE bin_path LIKE '%Forms/%/%/Form.bin' GROUP BY bin_path) GROUP BY 1",
    "listing_owners": _SCANS
    + """ SELECT DISTINCT dump_id, object_type, object_name, object_type || '/' || object_name || '/' || CASE len(object_name) % 3 WHEN 0 THEN object_name WHEN 1 THEN object_type ELSE '0' END || '.json' AS path FROM folders WHERE object_name != ''""",
    "listing_modules": _SCANS
    + """, modules AS (
  SELECT dump_id, snapshot_no, folder, 0 AS k, folder || '/' || container_name || '.obj.bsl' AS path FROM folders WHERE code
  UNION ALL SELECT dump_id, snapshot_no, folder, 1, folder || '/Items/B/' || snapshot_no || '.bsl' FROM folders
  UNION ALL SELECT dump_id, snapshot_no, folder, 1, folder || '/Items/A/C/x.bsl' FROM folders WHERE json
)
SELECT dump_id, snapshot_no, folder AS form_path, (row_number() OVER (PARTITION BY dump_id, snapshot_no, folder ORDER BY k, path) - 1)::INT AS ord, path FROM modules""",
}
