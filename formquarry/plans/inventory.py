"""Queries of the operators on forms, over the whole test tables, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from formquarry.functions import domain as D
from formquarry.functions.json import is_uuid
from formquarry.functions.keys import composite_key
from formquarry.functions.text import cut_text, descent, ids_of_path, path_segments, relative_to, safe_path_ref, unquote_lenient, unquote_strict, without_root
from formquarry.operators import bindings, classify, coverage, dedup, drift, elements, freshness, objects, reports, routing, summary
from formquarry.operators.snapshots import BROADCAST_STEPS, snapshot_steps
from formquarry.session import bounded, read_table, stored

_IDS = ["object_type", "object_name", "container_name", "form_name"]


def _scans(spark, sf):
    """What the queries on snapshots read of form_scans."""
    rows = read_table(spark, sf, "form_scans").where("dump_id IS NOT NULL AND snapshot_no IS NOT NULL")
    return rows.select("dump_id", "snapshot_no", *_IDS, "loaded_at", "bsl_sha256", "elem_sha256", "bsl_path", "bsl_mtime")


def _latest(scans):
    """Of several rows of a form in a snapshot the one that counts."""
    return dedup.keep_last(scans, ["dump_id", "snapshot_no", *_IDS], ["loaded_at", "bsl_sha256", "elem_sha256", "bsl_path", "bsl_mtime"])


def _edge_sides(spark, sf):
    """The forms of the first (``is_new`` false) and of the last snapshot (true) of each dump; a dump's only snapshot is both."""
    scans = _scans(spark, sf)
    edge = bounded(stored(scans.groupBy("dump_id").agg(F.min("snapshot_no").alias("lo"), F.max("snapshot_no").alias("hi")), "edges"), BROADCAST_STEPS)
    sides = F.explode(F.array_compact(F.array(F.when(F.col("snapshot_no") == F.col("lo"), False), F.when(F.col("snapshot_no") == F.col("hi"), True))))
    return _latest(scans.join(edge, "dump_id").where("snapshot_no IN (lo, hi)")).select("*", sides.alias("is_new")).drop("lo", "hi")


def _step_sides(spark, sf):
    """The forms of all snapshots, as the old side of the next existing one and as the new side of their own; step_no is the later number."""
    scans = _scans(spark, sf)
    steps = bounded(snapshot_steps(scans, "dump_id", "snapshot_no"), BROADCAST_STEPS).withColumnsRenamed({"part": "dump_id", "snap": "snapshot_no"})
    sides = F.expr("inline(filter(array(named_struct('step_no', next, 'is_new', false), named_struct('step_no', if(first, NULL, snapshot_no), 'is_new', true)), s -> s.step_no IS NOT NULL))")
    return _latest(scans).join(steps, ["dump_id", "snapshot_no"]).select("dump_id", "snapshot_no", *_IDS, "bsl_path", "bsl_mtime", "bsl_sha256", "elem_sha256", sides)


def drift_steps(spark, sf):
    """Drift from each snapshot of a dump to the next existing one."""
    return drift.drift_of_sides(_step_sides(spark, sf), ["dump_id", "step_no"])


def drift_step_lists(spark, sf):
    """The report of every step, also of those without drift."""
    steps = snapshot_steps(_scans(spark, sf), "dump_id", "snapshot_no").where("NOT first").select(F.col("part").alias("dump_id"), F.col("snap").alias("step_no"))
    return drift.drift_report(drift_steps(spark, sf), ["dump_id", "step_no"], steps).drop("checked_at").select("dump_id", "step_no", "has_drift", *[F.array_join(k, "|").alias(k) for k in drift.KINDS])


def stale_steps(spark, sf):
    """Forms of each snapshot whose code file the next one of the dump no longer has."""
    sides = stored(_step_sides(spark, sf).select("dump_id", "step_no", *_IDS, "bsl_path", "is_new"), "sides")
    return drift.stale(sides.where("NOT is_new"), sides.where("is_new AND bsl_path IS NOT NULL").select("dump_id", "step_no", F.col("bsl_path").alias("path")), ["dump_id", "step_no"])


def upsert_all(spark, sf):
    """All snapshots of each dump put over each other in their order: the latest row of every form that ever was in one."""
    rows = dedup.keep_last(_scans(spark, sf), ["dump_id", *_IDS], ["snapshot_no", "loaded_at", "bsl_sha256", "elem_sha256", "bsl_path", "bsl_mtime"])
    return rows.select("dump_id", composite_key(*_IDS).alias("form_key"), "snapshot_no")


def form_key(spark, sf):
    return read_table(spark, sf, "form_scans").select("dump_id", composite_key(*_IDS).alias("form_key")).distinct()


def drift_diff(spark, sf):
    return drift.drift_of_sides(_edge_sides(spark, sf), ["dump_id"])


def drift_lists(spark, sf):
    return drift.drift_report(drift_diff(spark, sf), ["dump_id"], _scans(spark, sf).select("dump_id")).drop("checked_at").select("dump_id", "has_drift", *[F.array_join(k, "|").alias(k) for k in drift.KINDS])


def stale_paths(spark, sf):
    """Forms of the first snapshots whose code file the last ones no longer have."""
    sides = stored(_edge_sides(spark, sf), "sides")
    return drift.stale(sides.where("NOT is_new"), sides.where("is_new AND bsl_path IS NOT NULL").select(F.col("bsl_path").alias("path")))


def content_hash(spark, sf):
    return read_table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"))


def stale_entries(spark, sf):
    return freshness.stale_forms(freshness.current_entries(read_table(spark, sf, "freshness")))


def current_freshness(spark, sf):
    return freshness.current_entries(read_table(spark, sf, "freshness")).select("form_name", "rec_id", "bin_path", "extraction_ok", F.array_join("warnings", "|").alias("warnings"))


def route_exact(spark, sf):
    return routing.route(read_table(spark, sf, "form_scans"), " ФормаСписка ").select("dump_id", "snapshot_no", "form_path", "confidence")


def route_object(spark, sf):
    return routing.route(read_table(spark, sf, "form_scans"), "УчетСкладаОсновной".lower()).select("dump_id", "snapshot_no", "form_path", "confidence")


def route_type(spark, sf):
    return routing.route(read_table(spark, sf, "form_scans"), "register").select("dump_id", "snapshot_no", "form_path", "confidence")


def upsert_reindex(spark, sf):
    """The first snapshot of each dump with the rows of the last one put over it."""
    sides = stored(_edge_sides(spark, sf), "sides")
    return routing.upsert(sides.where("NOT is_new"), sides.where("is_new"), ["dump_id", *_IDS]).select("dump_id", composite_key(*_IDS).alias("form_key"), "snapshot_no")


def ref_lookup(spark, sf):
    types = dedup.keep_last(read_table(spark, sf, "reference_types").where("type_name IS NOT NULL").withColumn("uuid", F.lower("uuid")), ["dump_id", "uuid"], ["registered_at", "type_name"])
    attributes = read_table(spark, sf, "object_attributes").select("attr_id", "dump_id", "value_type").distinct()
    return objects.resolve_types(attributes, types.select("dump_id", "uuid", "type_name"), ["dump_id"], "value_type").select("attr_id", "value_type")


def resolve_bindings(spark, sf):
    owner = ["dump_id", "object_type", "object_name"]
    attributes = read_table(spark, sf, "object_attributes").select(*owner, "section_name", F.col("attr_name").alias("name"), F.col("value_type").alias("type"), "synonym", F.struct("recorded_at", "attr_id").alias("attr_ord"))
    paths = read_table(spark, sf, "bindings").select("binding_id", *owner, "data_path").distinct()
    return bindings.resolve_paths(paths, attributes, owner).select("binding_id", "attribute_name", "value_type", "synonym", "resolved")


def unique_probe(spark, sf):
    """Attribute of each object name and UUID mention; mentions are the attributes' own UUIDs by section."""
    owner = ["dump_id", "object_type", "object_name"]
    attributes = read_table(spark, sf, "object_attributes").withColumn("name", F.trim("attr_name"))
    mentions = attributes.select(*owner, "uuid", F.coalesce("section_name", F.lit("")).alias("section"), F.coalesce("section_name", F.lit("")).alias("element_name")).distinct()
    return bindings.unique_probe(mentions, attributes, owner, ["section"]).drop("element_name")


def _bound(spark, sf):
    """Bindings as elements: the value type stands for the element's type."""
    kind = F.when(F.col("value_type") == "Boolean", "CheckBox").when(F.col("value_type").isNull(), F.lit(None)).otherwise("Field")
    parts = F.split("form_key", "/")
    return read_table(spark, sf, "bindings").where("form_key IS NOT NULL").select("dump_id", "form_key", F.element_at(parts, -1).alias("form_name"), kind.alias("type"), "data_path", "resolved")


def _as_elements(spark, sf):
    """Bindings as the elements of their forms, of every source, some with a handler; the middle of a path is the parent."""
    rows = read_table(spark, sf, "bindings").where("form_key IS NOT NULL AND binding_id IS NOT NULL").select("binding_id", "dump_id", "form_key", "attribute_name", "value_type", "data_path").distinct()
    source = F.expr("element_at(array('data', 'props', 'commands', 'tree'), int(binding_id % 4) + 1)")
    none = F.lit(None).cast("string")
    parent = F.expr("CASE WHEN size(split(data_path, '[.]')) = 3 THEN nullif(split(data_path, '[.]')[1], '') END")
    handler = F.when(F.col("binding_id") % 5 == 0, F.concat("attribute_name", F.lit("Нажатие")))
    return rows.select("dump_id", "form_key", F.col("binding_id").alias("ord"), F.col("attribute_name").alias("name"), F.col("value_type").alias("type"), parent.alias("parent"), none.alias("parent_path"), none.alias("path"), none.alias("page"), source.alias("source"), handler.alias("handler"), "data_path")


def binding_summary(spark, sf):
    """The summary of each form in long form, from its bindings."""
    return summary.summary_rows(_as_elements(spark, sf), ["dump_id", "form_key"])


def binding_parents(spark, sf):
    """Elements whose parent is none of their form."""
    return elements.missing_parents(_as_elements(spark, sf), ["dump_id", "form_key"])


def context_parts(spark, sf):
    """What the context of every bound form says: title, code (absent, empty or there), how many relations are resolved and how many types are not."""
    owner, form = ["dump_id", "object_type", "object_name"], ["dump_id", "form_key"]
    rows = _as_elements(spark, sf).withColumn("type", F.lit("Field"))
    parts = F.split("form_key", "/")
    keyed = rows.select(*form).distinct().select(*form, *[F.coalesce(F.get(parts, F.lit(i)), F.lit("")).alias(c) for i, c in enumerate(_IDS)])
    none = lambda kind: F.lit(None).cast(kind)
    module = F.expr("CASE length(form_key) % 3 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE concat('Процедура ', form_name, '()') END")
    forms = keyed.select("*", module.alias("module"), F.array().cast("array<string>").alias("warnings"), F.col("form_key").alias("form_path"), none("string").alias("elem_json_path"), none("string").alias("bsl_sha256"), none("string").alias("elem_sha256"), none("double").alias("bsl_mtime"))
    types = dedup.keep_last(read_table(spark, sf, "reference_types").where("type_name IS NOT NULL").withColumn("uuid", F.lower("uuid")), ["dump_id", "uuid"], ["registered_at", "type_name"])
    known = read_table(spark, sf, "object_attributes").select(*owner, F.lit(0).alias("section_ord"), F.col("attr_id").alias("attr_ord"), F.col("attr_name").alias("name"), "synonym", F.col("value_type").alias("type"), "uuid", "section_name").distinct()
    attributes = objects.resolve_types(known, types.select("dump_id", "uuid", "type_name"), ["dump_id"])
    paths = rows.where("coalesce(data_path, '') != ''").join(keyed, form).select(*form, "object_type", "object_name", "data_path").distinct()
    lists = summary.summaries(summary.summary_rows(rows, form), form)
    made = summary.form_contexts(forms, lists, attributes, bindings.resolve_paths(paths, attributes, owner), form, owner)
    code = F.expr(f"substring(context, locate('\n{summary.CODE_MARKER}\n', context) + {len(summary.CODE_MARKER) + 2})")
    return made.select(*form, F.substring_index("context", "\n", 1).alias("title"), code.alias("code"), F.regexp_count("context", F.lit('"resolved":true')).cast("bigint").alias("resolved"), F.regexp_count("context", F.lit('"type":"Ref#')).cast("bigint").alias("open_types"))


def binding_coverage(spark, sf):
    return coverage.coverage(_bound(spark, sf), ["dump_id", "form_key"])


def form_classes(spark, sf):
    return classify.classify_forms(_bound(spark, sf), ["dump_id", "form_key"])


def name_classes(spark, sf):
    names = read_table(spark, sf, "form_scans").select("form_name").distinct()
    return names.select("form_name", classify.class_by_name(F.col("form_name")).alias("by_name"), classify.class_of_empty_tree(F.col("form_name")).alias("e")).select("form_name", "by_name", "e.form_class", "e.reason")


def widget_classes(spark, sf):
    """Forms without widgets for each combination of proof."""
    names = read_table(spark, sf, "form_scans").select("form_name").distinct()
    proofs = names.select("form_name", F.explode(F.array(F.lit(None).cast("boolean"), F.lit(False), F.lit(True))).alias("flag"))
    return proofs.select("form_name", F.coalesce(F.col("flag").cast("string"), F.lit("none")).alias("flag"), classify.class_without_widgets(F.col("form_name"), F.lit("no_tabular_no_widgets"), F.col("flag")).alias("form_class"))


def reason_of_form(spark, sf):
    reasons = _bound(spark, sf).select("dump_id", "form_key", F.when(F.col("data_path").isNull(), "no_path").when(~F.coalesce("resolved", F.lit(False)), "unresolved").alias("reason"))
    return coverage.reason_of_form(reasons, ["dump_id", "form_key"])


def reason_counts(spark, sf):
    return coverage.reason_counts(reason_of_form(spark, sf))


def path_refs(spark, sf):
    paths = read_table(spark, sf, "form_scans").select("form_path", "elem_json_path").distinct()
    return paths.select("form_path", "elem_json_path", safe_path_ref(F.col("form_path")).alias("absolute_ref"), safe_path_ref(F.col("elem_json_path"), 2).alias("relative_ref"))


def path_ids(spark, sf):
    paths = read_table(spark, sf, "form_scans").where("elem_json_path IS NOT NULL").select(F.regexp_replace("elem_json_path", "/[^/]*$", "").alias("folder")).distinct()
    return paths.select("folder", ids_of_path(F.col("folder")).alias("i")).select("folder", "i.*")


def relative_paths(spark, sf):
    scans = read_table(spark, sf, "form_scans").where("form_path IS NOT NULL").select("form_path", F.regexp_extract("form_path", "^(/[^/]+/[^/]+)/", 1).alias("root")).distinct()
    return scans.select("form_path", "root", relative_to(F.col("form_path"), F.col("root")).alias("relative"), without_root(F.concat(F.lit("cannot read "), "form_path"), F.col("root")).alias("message"), F.size(path_segments(F.col("form_path"))).cast("bigint").alias("segments"))


def first_wins(spark, sf):
    return dedup.keep_first(read_table(spark, sf, "documents").select("doc_id", "text"), ["text"], ["doc_id"]).select("doc_id")


def last_wins(spark, sf):
    return dedup.keep_last(read_table(spark, sf, "reference_types").withColumn("uuid", F.lower("uuid")), ["dump_id", "uuid"], ["registered_at", "type_name"]).select("dump_id", "uuid", "type_name")


def priority_merge(spark, sf):
    """One row per attribute: types and synonyms from the latest record that has them."""
    rank = -F.unix_millis(F.col("recorded_at").cast("timestamp")) * 1000000 - F.col("attr_id")
    rows = read_table(spark, sf, "object_attributes").withColumn("rank", rank)
    return dedup.priority_merge(rows, ["dump_id", "uuid"], "rank", ["value_type", "synonym"], ("", "Undefined")).drop("merged_ranks")


def uuid_check(spark, sf):
    return read_table(spark, sf, "reference_types").groupBy(is_uuid("uuid").alias("valid")).agg(F.count("*").alias("n"))


def quoted_literals(spark, sf):
    texts = read_table(spark, sf, "object_attributes").select("attr_id", F.concat(F.lit('"'), F.coalesce("synonym", F.lit("")), F.lit('"')).alias("literal"), "attr_name").distinct()
    return texts.select("attr_id", "literal", "attr_name", unquote_strict(F.col("literal")).alias("strict"), unquote_lenient(F.col("attr_name")).alias("lenient")).drop("literal", "attr_name")


def json_aliases(spark, sf):
    """The code hash of index entries under any of its names."""
    names = ("bsl_sha256", "bslSha256", "BSL_SHA256")
    rows = read_table(spark, sf, "index_files").select("feed_id", "file_no", "rec_no", "payload").distinct()
    return rows.select("feed_id", "file_no", "rec_no", F.coalesce(*[F.nullif(F.get_json_object("payload", f"$.{n}"), F.lit("")) for n in names]).alias("bsl_sha256")).where("bsl_sha256 IS NOT NULL AND NOT startswith(bsl_sha256, '{')")


def version_suffixes(spark, sf):
    """Version suffixes of artifact names made of real stems."""
    stems = read_table(spark, sf, "form_scans").select("container_name", (F.col("snapshot_no") % 40).alias("v")).where("container_name IS NOT NULL").distinct()
    names = stems.select(F.concat("container_name", F.lit(".obj.3.0."), "v", F.lit(".bsl")).alias("bsl"), F.concat("container_name", F.lit("."), "v", F.lit(".json")).alias("json"), F.concat("container_name", F.lit(".obj.bsl")).alias("plain"))
    return names.select("bsl", "json", descent(F.col("bsl"), "bsl").alias("bsl_version"), descent(F.col("json"), "json").alias("json_version"), descent(F.col("plain"), "bsl").alias("plain_version"))


def text_fragments(spark, sf):
    docs = read_table(spark, sf, "documents")
    return docs.select("doc_id", cut_text(F.concat(F.lit("# "), F.coalesce("object_key", F.lit("")), F.lit("\n"), "text"), 200).alias("fragment"), cut_text(F.col("text"), 0).alias("none"))


def _parsed(spark, sf):
    """Every element file with the attribute names of its owner."""
    files = read_table(spark, sf, "elem_files").withColumn("parts", F.split("form_key", "/")).withColumns({"object_type": F.get("parts", F.lit(0)), "object_name": F.get("parts", F.lit(1)), "form_name": F.element_at("parts", -1)})
    attributes = read_table(spark, sf, "object_attributes").select("dump_id", "object_type", "object_name", "uuid", F.trim("attr_name").alias("name"), F.when(F.coalesce("section_name", F.lit("")) != "", 0).alias("section_ord"), F.col("attr_id").alias("attr_ord"))
    owner = ["dump_id", "object_type", "object_name"]
    names = objects.attribute_names(attributes.where("uuid IS NOT NULL AND name IS NOT NULL"), owner)
    one = dedup.keep_first(files.select("elem_id", *owner, "form_name", "form_key", "elem"), ["elem_id"], ["elem"])
    parsed = elements.parse_forms(one.join(names, owner, "left"), "elem", F.col("names"), common=F.col("object_type") == "CommonForm")
    return stored(parsed.drop("elem", "names"), "parsed")  # parsed once, however often a query reads it


def element_parse(spark, sf):
    return elements.form_elements(_parsed(spark, sf), ["elem_id"]).select("elem_id", "ord", "name", "type", "parent", "path", "source", "handler", "data_path")


def structure_hashes(spark, sf):
    return _parsed(spark, sf).select("elem_id", "parsed.elem_sha256", "parsed.ok")


def element_warnings(spark, sf):
    return elements.form_warnings(_parsed(spark, sf), ["elem_id"]).groupBy(F.regexp_extract("warning", "^[a-z ]+", 0).alias("warning")).agg(F.count("*").alias("n"))


def zero_bindings(spark, sf):
    return coverage.reason_of_form(elements.zero_bindings(_parsed(spark, sf), ["elem_id"]), ["elem_id"])


def unindexed_reason(spark, sf):
    return elements.unindexed_forms(_parsed(spark, sf), ["elem_id"])


def missing_parents(spark, sf):
    return elements.missing_parents(elements.form_elements(_parsed(spark, sf), ["elem_id"]), ["elem_id"])


def element_coverage(spark, sf):
    parsed = _parsed(spark, sf)
    forms = parsed.select("elem_id", "form_name", F.col("parsed.reason").alias("unindexed_reason"), "parsed.has_data_widgets")
    return coverage.coverage_of_forms(forms, elements.form_elements(parsed, ["elem_id", "form_name"]), ["elem_id"])


def summary_buckets(spark, sf):
    return summary.summary_rows(elements.form_elements(_parsed(spark, sf), ["elem_id"]), ["elem_id"])


def form_contexts(spark, sf):
    """The rendered context of every form of the last snapshots that has an element file."""
    parsed = _parsed(spark, sf)
    rows = elements.form_elements(parsed, ["elem_id", "dump_id", "object_type", "object_name"])
    owner = ["dump_id", "object_type", "object_name"]
    attributes = read_table(spark, sf, "object_attributes").select(*owner, F.lit(0).alias("section_ord"), F.col("attr_id").alias("attr_ord"), F.col("attr_name").alias("name"), "synonym", F.col("value_type").alias("type"), "uuid", "section_name").distinct()
    paths = rows.where("data_path IS NOT NULL").select("elem_id", *owner, "data_path").distinct()
    bound = bindings.resolve_paths(paths, attributes, owner)
    lists = summary.summaries(summary.summary_rows(rows, ["elem_id"]), ["elem_id"])
    none = F.lit(None)
    forms = parsed.select("elem_id", *owner, F.get(F.split("form_key", "/"), F.lit(2)).alias("container_name"), "form_name", none.cast("string").alias("module"), "parsed.warnings", F.col("form_key").alias("form_path"), none.cast("string").alias("elem_json_path"), none.cast("string").alias("bsl_sha256"), "parsed.elem_sha256", none.cast("double").alias("bsl_mtime"))
    return summary.form_contexts(forms, lists, attributes, bound, ["elem_id"], owner).select("elem_id", "form_name", "context")


def _decoded(spark, sf):
    first = dedup.keep_first(read_table(spark, sf, "owner_objects"), ["object_id"], ["header"])
    return stored(objects.decode_objects(first, "header", wrapped=False).drop("header"), "decoded")


def header_decode(spark, sf):
    return objects.object_attributes(_decoded(spark, sf), ["object_id"])


def header_errors(spark, sf):
    return _decoded(spark, sf).groupBy(F.coalesce("decoded.error", F.lit("none")).alias("error")).agg(F.count("*").alias("n"))


def reference_index(spark, sf):
    """The reference types of every dump."""
    return objects.reference_types(_decoded(spark, sf), ["object_type", "object_name", "object_id"], ["dump_id"])


def query_blocks(spark, sf):
    """Query texts inside documents, by lines."""
    return reports.marked_blocks(read_table(spark, sf, "documents").where("text IS NOT NULL"), ["doc_id"])


def query_datasets(spark, sf):
    """Documents read as report containers."""
    docs = read_table(spark, sf, "documents").select("doc_id", F.encode(F.concat(F.lit("<?xml?>"), "text"), "UTF-8").alias("content"))
    return reports.report_queries(reports.containers(docs), ["doc_id"])


QUERIES = {
    f.__name__: f
    for f in (
        form_key, drift_diff, drift_lists, stale_paths, drift_steps, drift_step_lists, stale_steps, upsert_all, content_hash, stale_entries, current_freshness, route_exact, route_object, route_type, upsert_reindex, ref_lookup, resolve_bindings,
        unique_probe, binding_summary, binding_parents, context_parts, binding_coverage, form_classes, name_classes, widget_classes, reason_of_form, reason_counts, path_refs, path_ids, relative_paths, first_wins, last_wins, priority_merge,
        uuid_check, quoted_literals, json_aliases, version_suffixes, text_fragments, element_parse, structure_hashes, element_warnings, zero_bindings, unindexed_reason,
        missing_parents, element_coverage, summary_buckets, form_contexts, header_decode, header_errors, reference_index, query_blocks, query_datasets,
    )
}

_KEY = "concat_ws('/', coalesce(object_type, ''), coalesce(object_name, ''), coalesce(container_name, ''), coalesce(form_name, ''))"
_EDGES = f"""
WITH scans AS (SELECT *, {_KEY} AS form_key, min(snapshot_no) OVER (PARTITION BY dump_id) AS lo, max(snapshot_no) OVER (PARTITION BY dump_id) AS hi FROM form_scans WHERE dump_id IS NOT NULL AND snapshot_no IS NOT NULL),
picked AS (
  SELECT *, row_number() OVER (PARTITION BY dump_id, snapshot_no, object_type, object_name, container_name, form_name
    ORDER BY loaded_at DESC NULLS LAST, bsl_sha256 DESC NULLS LAST, elem_sha256 DESC NULLS LAST, bsl_path DESC NULLS LAST, bsl_mtime DESC NULLS LAST) AS k
  FROM scans WHERE snapshot_no IN (lo, hi)
), firsts AS (SELECT * FROM picked WHERE k = 1 AND snapshot_no = lo), lasts AS (SELECT * FROM picked WHERE k = 1 AND snapshot_no = hi)"""
_ONE = "SELECT * FROM {0} QUALIFY row_number() OVER (PARTITION BY dump_id, form_key ORDER BY coalesce(bsl_path, '') DESC, coalesce(bsl_path, '') != '' DESC, bsl_mtime DESC NULLS LAST, bsl_sha256 DESC NULLS LAST, elem_sha256 DESC NULLS LAST) = 1"
_DRIFT = (
    _EDGES
    + f""", b AS ({_ONE.format("firsts")}), c AS ({_ONE.format("lasts")}),
pairs AS (
  SELECT dump_id, form_key, coalesce(b.bsl_path, '') != '' AS cb, coalesce(c.bsl_path, '') != '' AS cc, b.bsl_sha256 AS hb, c.bsl_sha256 AS hc, b.bsl_mtime AS mb, c.bsl_mtime AS mc, b.elem_sha256 AS eb, c.elem_sha256 AS ec
  FROM b FULL JOIN c USING (dump_id, form_key)
), kinds AS (
  SELECT dump_id, form_key, 'added' AS kind FROM pairs WHERE cc AND NOT cb
  UNION ALL SELECT dump_id, form_key, 'removed' FROM pairs WHERE cb AND NOT cc
  UNION ALL SELECT dump_id, form_key, 'modified' FROM pairs WHERE cb AND cc AND CASE WHEN hb IS NOT NULL THEN hc IS DISTINCT FROM hb ELSE abs(mc - mb) > 1.0 END
  UNION ALL SELECT dump_id, form_key, 'structure_modified' FROM pairs WHERE eb != ec
)"""
)
_STEPS = f"""
WITH scans AS (SELECT *, {_KEY} AS form_key FROM form_scans WHERE dump_id IS NOT NULL AND snapshot_no IS NOT NULL),
numbers AS (SELECT dump_id, snapshot_no, lead(snapshot_no) OVER w AS next_no, lag(snapshot_no) OVER w AS prev_no FROM (SELECT DISTINCT dump_id, snapshot_no FROM scans) WINDOW w AS (PARTITION BY dump_id ORDER BY snapshot_no)),
picked AS (
  SELECT * FROM scans QUALIFY row_number() OVER (PARTITION BY dump_id, snapshot_no, object_type, object_name, container_name, form_name
    ORDER BY loaded_at DESC NULLS LAST, bsl_sha256 DESC NULLS LAST, elem_sha256 DESC NULLS LAST, bsl_path DESC NULLS LAST, bsl_mtime DESC NULLS LAST) = 1
), olds AS (SELECT p.*, next_no AS step_no FROM picked p JOIN numbers USING (dump_id, snapshot_no) WHERE next_no IS NOT NULL),
news AS (SELECT p.*, snapshot_no AS step_no FROM picked p JOIN numbers USING (dump_id, snapshot_no) WHERE prev_no IS NOT NULL)"""
_STEP_DRIFT = (_STEPS + _DRIFT.removeprefix(_EDGES)).replace("FROM firsts", "FROM olds").replace("FROM lasts", "FROM news").replace("PARTITION BY dump_id, form_key", "PARTITION BY dump_id, step_no, form_key").replace("SELECT dump_id, form_key,", "SELECT dump_id, step_no, form_key,").replace("USING (dump_id, form_key)", "USING (dump_id, step_no, form_key)")
_in = lambda values: "(" + ", ".join(f"'{v}'" for v in values) + ")"
_starts = lambda c, prefixes: "(" + " OR ".join(f"starts_with(lower({c}), '{p}')" for p in prefixes) + ")"
_SERVICE, _HINT = _starts("form_name", D.SERVICE_NAME_PREFIXES), _starts("form_name", D.SERVICE_NAME_HINTS)
_REASON = f"CASE WHEN coalesce(form_name, '') = '' THEN 'no_name' WHEN {_SERVICE} THEN 'by_service_pattern' WHEN lower(form_name) IN {_in(D.PLATFORM_FORM_NAMES)} THEN 'platform_object_name_unparsed' WHEN {_HINT} THEN 'empty_tree_name_hint' ELSE 'unparsed_empty_tree' END"
_BOUND = """bound AS (
  SELECT dump_id, form_key, string_split(form_key, '/')[-1] AS form_name, CASE WHEN value_type = 'Boolean' THEN 'CheckBox' WHEN value_type IS NULL THEN NULL ELSE 'Field' END AS type, data_path, resolved
  FROM bindings WHERE form_key IS NOT NULL
)"""
_ELEMENTS = """WITH rows_ AS (SELECT DISTINCT binding_id, dump_id, form_key, attribute_name, value_type, data_path FROM bindings WHERE form_key IS NOT NULL AND binding_id IS NOT NULL),
e AS (
  SELECT dump_id, form_key, binding_id AS ord, attribute_name AS name, CASE WHEN len(string_split(data_path, '.')) = 3 THEN nullif(string_split(data_path, '.')[2], '') END AS parent, data_path,
    ['data', 'props', 'commands', 'tree'][binding_id % 4 + 1] AS source, to_json(coalesce(attribute_name, ''))::VARCHAR AS n, to_json(coalesce(nullif(value_type, ''), 'Unknown'))::VARCHAR AS t,
    CASE WHEN binding_id % 5 = 0 THEN nullif(attribute_name || 'Нажатие', '') END AS h FROM rows_
)"""
_CLASS = f"CASE WHEN {_SERVICE} THEN 'service' WHEN bool_or(coalesce(type IN ('Field', 'CheckBox') AND starts_with(lower(data_path), 'объект.'), false)) THEN 'object' ELSE 'service' END"
_LATEST = "SELECT * FROM freshness WHERE form_name IS NOT NULL QUALIFY row_number() OVER (PARTITION BY form_name ORDER BY delivered_at DESC NULLS LAST, rec_id DESC NULLS LAST) = 1"
_FIRST_HEADERS = "WITH first_headers AS (SELECT *, ltrim(header, chr(65279)) AS h FROM owner_objects QUALIFY row_number() OVER (PARTITION BY object_id ORDER BY header NULLS FIRST, dump_id, object_type, object_name) = 1) "
_REASONS = f"WITH {_BOUND}, reasons AS (SELECT dump_id, form_key, CASE WHEN data_path IS NULL THEN 'no_path' WHEN NOT coalesce(resolved, false) THEN 'unresolved' END AS reason FROM bound), forms AS (SELECT dump_id, form_key, CASE WHEN count(DISTINCT reason) = 1 THEN min(reason) WHEN count(DISTINCT reason) > 1 THEN 'mixed' END AS reason FROM reasons GROUP BY ALL) "

ORACLES = {
    "form_key": f"SELECT DISTINCT dump_id, {_KEY} AS form_key FROM form_scans",
    "drift_diff": _DRIFT + " SELECT * FROM kinds",
    "drift_lists": _DRIFT
    + " SELECT dump_id, count(kind) > 0 AS has_drift, "
    + ", ".join(f"coalesce(string_agg(form_key, '|' ORDER BY form_key) FILTER (kind = '{k}'), '') AS {k}" for k in drift.KINDS)
    + " FROM (SELECT DISTINCT dump_id FROM scans) LEFT JOIN kinds USING (dump_id) GROUP BY dump_id",
    "stale_paths": _EDGES + " SELECT DISTINCT form_key, 'stale_extractions' AS kind FROM firsts f WHERE coalesce(bsl_path, '') != '' AND NOT EXISTS (SELECT 1 FROM lasts l WHERE l.bsl_path = f.bsl_path)",
    "drift_steps": _STEP_DRIFT + " SELECT * FROM kinds",
    "drift_step_lists": _STEP_DRIFT
    + " SELECT dump_id, step_no, count(kind) > 0 AS has_drift, "
    + ", ".join(f"coalesce(string_agg(form_key, '|' ORDER BY form_key) FILTER (kind = '{k}'), '') AS {k}" for k in drift.KINDS)
    + " FROM (SELECT DISTINCT dump_id, step_no FROM news) LEFT JOIN kinds USING (dump_id, step_no) GROUP BY dump_id, step_no",
    "stale_steps": _STEPS + " SELECT DISTINCT dump_id, step_no, form_key, 'stale_extractions' AS kind FROM olds f WHERE coalesce(bsl_path, '') != '' AND NOT EXISTS (SELECT 1 FROM news l WHERE l.dump_id = f.dump_id AND l.step_no = f.step_no AND l.bsl_path = f.bsl_path)",
    "upsert_all": _STEPS + " SELECT dump_id, form_key, max(snapshot_no) AS snapshot_no FROM picked GROUP BY dump_id, form_key, object_type, object_name, container_name, form_name",
    "content_hash": "SELECT doc_id, sha256(text) AS sha256 FROM documents",
    "stale_entries": f"SELECT form_name FROM ({_LATEST}) WHERE bin_mtime IS NOT NULL AND (unpacked_mtime IS NULL OR bin_mtime > unpacked_mtime)",
    "current_freshness": f"SELECT form_name, rec_id, bin_path, extraction_ok, array_to_string(warnings, '|') AS warnings FROM ({_LATEST})",
    "route_exact": "SELECT dump_id, snapshot_no, form_path, 1.0::DOUBLE AS confidence FROM form_scans WHERE form_name = 'ФормаСписка'",
    "route_object": "SELECT dump_id, snapshot_no, form_path, 0.9::DOUBLE AS confidence FROM form_scans WHERE lower(object_name) = lower('УчетСкладаОсновной')",
    "route_type": "SELECT dump_id, snapshot_no, form_path, 0.4::DOUBLE AS confidence FROM form_scans WHERE contains(lower(object_type), 'register')",
    "upsert_reindex": _EDGES + " SELECT dump_id, form_key, max(snapshot_no) AS snapshot_no FROM (SELECT * FROM firsts UNION ALL SELECT * FROM lasts) GROUP BY dump_id, form_key, object_type, object_name, container_name, form_name",
    "ref_lookup": """WITH types AS (SELECT dump_id, lower(uuid) AS uuid, type_name FROM reference_types WHERE type_name IS NOT NULL QUALIFY row_number() OVER (PARTITION BY dump_id, lower(uuid) ORDER BY registered_at DESC NULLS LAST, type_name DESC) = 1)
SELECT a.attr_id, CASE WHEN coalesce(t.type_name, '') != '' THEN t.type_name ELSE a.value_type END AS value_type
FROM (SELECT DISTINCT attr_id, dump_id, value_type FROM object_attributes) a LEFT JOIN types t ON a.dump_id = t.dump_id AND a.value_type LIKE 'Ref#%' AND lower(substr(a.value_type, 5)) = t.uuid""",
    "resolve_bindings": """WITH attributes AS (
  SELECT dump_id, object_type, object_name, lower(trim(coalesce(section_name, ''))) AS s, lower(trim(attr_name)) AS n, value_type, synonym FROM object_attributes WHERE attr_name IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY dump_id, object_type, object_name, s, n ORDER BY recorded_at, attr_id, value_type NULLS FIRST, synonym NULLS FIRST) = 1
), paths AS (SELECT DISTINCT binding_id, dump_id, object_type, object_name, data_path, string_split(data_path, '.') AS p FROM bindings)
SELECT binding_id, p[-1] AS attribute_name, a.value_type, a.synonym, a.n IS NOT NULL AS resolved
FROM paths b LEFT JOIN attributes a ON a.dump_id = b.dump_id AND a.object_type = b.object_type AND a.object_name = b.object_name AND len(p) IN (2, 3)
  AND a.s = CASE WHEN len(p) = 3 THEN lower(trim(p[2])) ELSE '' END AND a.n = lower(trim(p[-1]))""",
    "unique_probe": """WITH m AS (SELECT DISTINCT dump_id, object_type, object_name, uuid, coalesce(section_name, '') AS section FROM object_attributes),
a AS (SELECT DISTINCT dump_id, object_type, object_name, uuid, trim(attr_name) AS name FROM object_attributes WHERE coalesce(uuid, '') != '')
SELECT m.dump_id, m.object_type, m.object_name, section, CASE WHEN count(DISTINCT name) = 1 THEN min(name) WHEN bool_or(name = section) THEN section END AS attribute_name, count(DISTINCT name) AS candidates
FROM m JOIN a USING (dump_id, object_type, object_name, uuid) GROUP BY m.dump_id, m.object_type, m.object_name, section""",
    "binding_coverage": f"""WITH {_BOUND} SELECT dump_id, form_key, form_name, count(*) AS total_elements, count(*) FILTER (type IN ('Field', 'CheckBox')) AS data_elements,
  count(*) FILTER (type IN ('Field', 'CheckBox') AND coalesce(data_path, '') != '') AS bound_data_elements,
  coalesce(count(*) FILTER (type IN ('Field', 'CheckBox') AND coalesce(data_path, '') != '') / nullif(count(*) FILTER (type IN ('Field', 'CheckBox')), 0)::DOUBLE, 0.0) * 100.0 AS coverage_pct, {_CLASS} AS form_class FROM bound GROUP BY dump_id, form_key, form_name""",
    "context_parts": f"""WITH forms AS (
  SELECT DISTINCT dump_id, form_key, coalesce(p[1], '') AS object_type, coalesce(p[2], '') AS object_name, coalesce(p[3], '') AS container_name, coalesce(p[4], '') AS form_name
  FROM (SELECT dump_id, form_key, string_split(form_key, '/') AS p FROM bindings WHERE form_key IS NOT NULL AND binding_id IS NOT NULL)
), types AS (SELECT dump_id, lower(uuid) AS uuid, type_name FROM reference_types WHERE type_name IS NOT NULL QUALIFY row_number() OVER (PARTITION BY dump_id, lower(uuid) ORDER BY registered_at DESC NULLS LAST, type_name DESC) = 1),
known AS (SELECT DISTINCT dump_id, object_type, object_name, attr_id, attr_name, synonym, value_type, uuid, section_name FROM object_attributes),
open_types AS (
  SELECT k.dump_id, object_type, object_name, count(*) FILTER (value_type LIKE 'Ref#%' AND coalesce(type_name, '') = '') AS n FROM known k LEFT JOIN types t ON t.dump_id = k.dump_id AND t.uuid = lower(substr(value_type, 5)) AND value_type LIKE 'Ref#%' GROUP BY ALL
), names AS (SELECT DISTINCT dump_id, object_type, object_name, lower(trim(coalesce(section_name, ''))) AS s, lower(trim(attr_name)) AS a FROM known WHERE attr_name IS NOT NULL),
paths AS (SELECT DISTINCT f.*, data_path, string_split(data_path, '.') AS p FROM bindings b JOIN forms f ON f.dump_id IS NOT DISTINCT FROM b.dump_id AND f.form_key = b.form_key WHERE coalesce(data_path, '') != ''),
found AS (
  SELECT p.dump_id, form_key, count(*) AS n FROM paths p JOIN names n ON n.dump_id = p.dump_id AND n.object_type = p.object_type AND n.object_name = p.object_name
    AND len(p.p) IN (2, 3) AND n.s = CASE WHEN len(p.p) = 3 THEN lower(trim(p.p[2])) ELSE '' END AND n.a = lower(trim(p.p[-1])) GROUP BY ALL
)
SELECT f.dump_id, f.form_key, '# FORM ' || concat_ws('/', nullif(f.object_type, ''), nullif(f.object_name, ''), nullif(container_name, ''), nullif(form_name, '')) AS title,
  CASE len(f.form_key) % 3 WHEN 0 THEN '{summary.NO_CODE}' WHEN 1 THEN '' ELSE 'Процедура ' || form_name || '()' END AS code,
  CASE WHEN o.dump_id IS NULL THEN 0 ELSE coalesce(found.n, 0) END AS resolved, coalesce(o.n, 0) AS open_types
FROM forms f LEFT JOIN open_types o ON o.dump_id = f.dump_id AND o.object_type = f.object_type AND o.object_name = f.object_name LEFT JOIN found ON found.dump_id = f.dump_id AND found.form_key = f.form_key""",
    "binding_parents": _ELEMENTS + "SELECT dump_id, form_key, name, parent FROM e WHERE coalesce(parent, '') != '' AND NOT EXISTS (SELECT 1 FROM e k WHERE k.dump_id IS NOT DISTINCT FROM e.dump_id AND k.form_key = e.form_key AND k.name = e.parent)",
    "binding_summary": _ELEMENTS
    + """, items AS (
  SELECT dump_id, form_key, ord, 0 AS step, CASE source WHEN 'props' THEN 'attributes' WHEN 'commands' THEN 'commands' ELSE 'elements' END AS bucket,
    CASE source WHEN 'props' THEN '{"name":' || n || ',"type":' || t || '}'
      WHEN 'commands' THEN '{' || coalesce('"handler":' || to_json(h)::VARCHAR || ',', '') || '"name":' || n || ',"type":' || t || '}'
      ELSE '{"kind":' || t || ',"name":' || n || coalesce(',"parent":' || to_json(parent)::VARCHAR, '') || ',"source":"' || source || '"}' END AS item FROM e
  UNION ALL SELECT dump_id, form_key, ord, 1, 'relations', '{"element":' || n || ',"kind":"data","target":' || to_json(data_path)::VARCHAR || '}' FROM e WHERE coalesce(data_path, '') != ''
  UNION ALL SELECT dump_id, form_key, ord, 2, 'events', '{"element":' || n || ',"name":' || to_json(h)::VARCHAR || '}' FROM e WHERE h IS NOT NULL
  UNION ALL SELECT dump_id, form_key, ord, 3, 'relations', '{"element":' || n || ',"kind":"event","target":' || to_json(h)::VARCHAR || '}' FROM e WHERE h IS NOT NULL
), numbered AS (SELECT *, ord * 8 + row_number() OVER (PARTITION BY dump_id, form_key, ord, u ORDER BY step) - 1 AS spot FROM (SELECT i.*, 0 AS u FROM items i))
SELECT dump_id, form_key, bucket, min(spot) AS ord, item FROM numbered GROUP BY dump_id, form_key, bucket, item""",
    "form_classes": f"WITH {_BOUND} SELECT dump_id, form_key, form_name, {_CLASS} AS form_class FROM bound GROUP BY dump_id, form_key, form_name",
    "name_classes": f"SELECT form_name, CASE WHEN {_SERVICE} THEN 'service' ELSE 'unknown' END AS by_name, CASE WHEN coalesce(form_name, '') != '' AND {_SERVICE} THEN 'service' ELSE 'unknown' END AS form_class, {_REASON} AS reason FROM (SELECT DISTINCT form_name FROM form_scans)",
    "widget_classes": f"SELECT form_name, flag, CASE WHEN flag != 'true' AND {_REASON} IN ('by_service_pattern', 'empty_tree_name_hint') THEN 'service' ELSE 'unknown' END AS form_class FROM (SELECT DISTINCT form_name FROM form_scans), (VALUES ('none'), ('false'), ('true')) AS f(flag)",
    "reason_of_form": _REASONS + "SELECT * FROM forms",
    "reason_counts": _REASONS + "SELECT reason, count(*) AS forms FROM forms GROUP BY reason",
    "path_refs": """SELECT form_path, elem_json_path,
  CASE WHEN coalesce(form_path, '') = '' THEN '<путь не указан>' WHEN len(a) > 4 THEN '.../' || array_to_string(a[-4:], '/') ELSE '.../' || a[-1] END AS absolute_ref,
  CASE WHEN coalesce(elem_json_path, '') = '' THEN '<путь не указан>' WHEN len(b) > 2 THEN '.../' || array_to_string(b[-2:], '/') ELSE array_to_string(b, '/') END AS relative_ref
FROM (SELECT DISTINCT form_path, elem_json_path, string_split(ltrim(form_path, '/'), '/') AS a, string_split(elem_json_path, '/') AS b FROM form_scans)""",
    "path_ids": """SELECT folder, CASE WHEN len(p) >= 4 THEN p[-4] ELSE '' END AS object_type, CASE WHEN len(p) >= 4 THEN p[-3] ELSE '' END AS object_name, CASE WHEN len(p) >= 2 THEN p[-2] ELSE '' END AS container_name, p[-1] AS form_name
FROM (SELECT DISTINCT regexp_replace(elem_json_path, '/[^/]*$', '') AS folder, string_split(regexp_replace(elem_json_path, '/[^/]*$', ''), '/') AS p FROM form_scans WHERE elem_json_path IS NOT NULL)""",
    "relative_paths": """SELECT form_path, root, CASE WHEN starts_with(form_path, root || '/') THEN substr(form_path, len(root) + 2) ELSE string_split(form_path, '/')[-1] END AS relative,
  CASE WHEN root = '' THEN 'cannot read ' || form_path ELSE replace(replace('cannot read ' || form_path, root || '/', ''), root, '') END AS message, len(string_split(ltrim(form_path, '/'), '/')) AS segments
FROM (SELECT DISTINCT form_path, regexp_extract(form_path, '^(/[^/]+/[^/]+)/', 1) AS root FROM form_scans WHERE form_path IS NOT NULL)""",
    "first_wins": "SELECT min(doc_id) AS doc_id FROM documents GROUP BY text",
    "last_wins": "SELECT dump_id, lower(uuid) AS uuid, type_name FROM reference_types QUALIFY row_number() OVER (PARTITION BY dump_id, lower(uuid) ORDER BY registered_at DESC NULLS LAST, type_name DESC NULLS LAST) = 1",
    "priority_merge": """WITH r AS (SELECT *, -epoch_ms(recorded_at) * 1000000 - attr_id AS rank FROM object_attributes)
SELECT dump_id, uuid, arg_min(value_type, (rank, value_type)) FILTER (value_type IS NOT NULL AND value_type NOT IN ('', 'Undefined')) AS value_type, arg_min(synonym, (rank, synonym)) FILTER (synonym IS NOT NULL AND synonym NOT IN ('', 'Undefined')) AS synonym FROM r GROUP BY dump_id, uuid""",
    "uuid_check": "SELECT coalesce(regexp_full_match(uuid, '[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}'), false) AS valid, count(*) AS n FROM reference_types GROUP BY ALL",
    "quoted_literals": "SELECT attr_id, nullif(trim(coalesce(synonym, '')), '') AS strict, CASE WHEN len(attr_name) >= 2 THEN nullif(trim(attr_name), '') END AS lenient FROM (SELECT DISTINCT attr_id, synonym, attr_name FROM object_attributes)",
    "json_aliases": """SELECT feed_id, file_no, rec_no, h AS bsl_sha256 FROM (
  SELECT feed_id, file_no, rec_no, coalesce(nullif(payload::JSON ->> '$.bsl_sha256', ''), nullif(payload::JSON ->> '$.bslSha256', ''), nullif(payload::JSON ->> '$.BSL_SHA256', '')) AS h
  FROM (SELECT DISTINCT feed_id, file_no, rec_no, payload FROM index_files WHERE json_valid(payload))) WHERE h IS NOT NULL AND NOT starts_with(h, '{')""",
    "version_suffixes": "SELECT c || '.obj.3.0.' || v || '.bsl' AS bsl, c || '.' || v || '.json' AS json, '3.0.' || v AS bsl_version, v::VARCHAR AS json_version, NULL::VARCHAR AS plain_version FROM (SELECT DISTINCT container_name AS c, snapshot_no % 40 AS v FROM form_scans WHERE container_name IS NOT NULL AND snapshot_no IS NOT NULL)",
    "text_fragments": "SELECT doc_id, substr('# ' || coalesce(object_key, '') || chr(10) || text, 1, 200) AS fragment, CASE WHEN text IS NOT NULL THEN '' END AS none FROM documents",
    "header_errors": _FIRST_HEADERS + """SELECT CASE WHEN header IS NULL THEN 'json_not_found' WHEN NOT json_valid(h) THEN 'json_parse_error' WHEN json_type(h) != 'ARRAY' THEN 'version_unsupported' ELSE 'none' END AS error, count(*) AS n FROM first_headers GROUP BY ALL""",
    "reference_index": _FIRST_HEADERS
    + f""", identities AS (
  SELECT o.*, prefix || '.' || object_name AS type_name, unnest([h ->> '$[0][1][1]', h ->> '$[0][1][2]', h ->> '$[0][1][3]']) AS uuid
  FROM (SELECT *, CASE object_type {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in D.REFERENCE_TYPE_PREFIXES.items())} END AS prefix FROM first_headers WHERE json_valid(h)) o WHERE prefix IS NOT NULL
)
SELECT dump_id, uuid, type_name FROM identities WHERE regexp_full_match(uuid, '[0-9a-fA-F]{{8}}(-[0-9a-fA-F]{{4}}){{3}}-[0-9a-fA-F]{{12}}')
QUALIFY row_number() OVER (PARTITION BY dump_id, uuid ORDER BY object_type NULLS FIRST, object_name NULLS FIRST, object_id) = 1""",
    "query_blocks": """WITH lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS line_no FROM documents WHERE text IS NOT NULL
), numbered AS (
  SELECT *, count(*) FILTER (regexp_matches(trim(line), '(?i)^(ВЫБРАТЬ|SELECT)([^а-яёa-z0-9_]|$)')) OVER w AS block_no, count(*) FILTER (trim(line) = '') OVER w AS gap_no FROM lines WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)
), opened AS (SELECT *, min(gap_no) OVER (PARTITION BY doc_id, block_no) AS first_gap FROM numbered)
SELECT doc_id, block_no, string_agg(line, chr(10) ORDER BY line_no) AS block FROM opened WHERE block_no > 0 AND gap_no = first_gap GROUP BY doc_id, block_no""",
}
