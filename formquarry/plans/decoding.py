"""Queries that reach every branch of the decoders, over inputs written from the test tables.

The tables have no positional forms, modules or report containers. Here such texts are written in their
formats from all attributes and bindings, with every variant that the decoders tell apart, and decoded
again; the SQL twins say from the tables what must come out.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from formquarry.functions import domain as D
from formquarry.operators import coverage, elements, objects, reports
from formquarry.session import read_table

_OWNER = ["dump_id", "object_type", "object_name"]
_U, _ALIEN = "11111111-1111-4111-8111-111111111111", "22222222-2222-4222-8222-222222222222"
_UUID = "^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"
_INPUT, _COMBO = D.WIDGET_TYPES
_NAME_CHARS = "[А-Яа-яA-Za-z0-9_]+"


def _text(sql: str) -> str:
    """SQL: the JSON text of a string."""
    return f"substr(to_json(array({sql})), 2, length(to_json(array({sql}))) - 2)"


def _quoted(sql: str) -> str:
    """SQL: the JSON text of a string that has its own double quotes."""
    return _text(f"""concat('"', {sql}, '"')""")


def _ordered(order: str, sql: str) -> str:
    """SQL: the texts of a group joined by commas in order."""
    return f"array_join(transform(array_sort(collect_list(struct({order}, {sql} AS x))), s -> s.x), ',')"


def _attributes(spark, sf):
    """Attributes that can be written down: (owner, section, uuid, name, attr_id, value_type, synonym), distinct."""
    rows = read_table(spark, sf, "object_attributes").where(f"uuid RLIKE '{_UUID}' AND trim(attr_name) != ''")
    owner = ["coalesce(dump_id, '') AS dump_id", "coalesce(object_type, '') AS object_type", "coalesce(object_name, '') AS object_name"]
    return rows.selectExpr(*owner, "trim(coalesce(section_name, '')) AS section", "uuid", "trim(attr_name) AS name", "attr_id", "value_type", "synonym").distinct()


def _names(attributes):
    known = attributes.select(*_OWNER, "uuid", "name", F.when(F.col("section") != "", 0).alias("section_ord"), F.col("attr_id").alias("attr_ord"))
    return objects.attribute_names(known, _OWNER)


def _tabular_forms(spark, sf):
    """(owner, form, names): for each owner a positional form with a tabular field per section whose slots name its attributes."""
    attributes = _attributes(spark, sf)
    slots = attributes.groupBy(*_OWNER, "section", "uuid").agg(F.min("attr_id").alias("ord"))
    slot = """concat('["column",["8",["16",["0","', uuid, '"]]]]')"""
    binding = f"""if(section = '', '["0"]', concat('["14",', {_quoted('section')}, ']'))"""
    fields = slots.groupBy(*_OWNER, "section").agg(F.expr(f"""concat('["{D.TABULAR_FIELD}","1",["5",[["11",["20","s","s","s","s","s",', {_ordered('ord', slot)}, ']]]],"0",', {binding}, ']')""").alias("field"))
    forms = fields.groupBy(*_OWNER).agg(F.expr(f"""concat('{{"form":[', {_ordered('section', 'field')}, ']}}')""").alias("form"))
    return forms.join(_names(attributes), _OWNER)


def legacy_columns(spark, sf):
    """Columns of tabular fields, where the element file is empty."""
    forms = _tabular_forms(spark, sf).withColumn("elem", F.lit("{}"))
    parsed = elements.parse_forms(forms, "elem", F.col("names"), F.col("form"))
    return elements.form_elements(parsed, _OWNER).select(*_OWNER, "name", "type", "data_path", "source")


def widget_elements(spark, sf):
    """Data widgets of positional forms without tabular fields."""
    widget = f"""concat('["', if(attr_id % 2 = 0, '{_INPUT}', '{_COMBO}'), '",1,2,3,["14",', {_quoted('name')}, ']]')"""
    forms = _attributes(spark, sf).groupBy(*_OWNER).agg(F.expr(f"""concat('{{"x":[["other",1,2,3,["14","\\\\"Other\\\\""]],', {_ordered('attr_id, section, uuid', widget)}, ']}}')""").alias("form"))
    parsed = elements.parse_forms(forms.withColumn("elem", F.lit("{}")), "elem", form=F.col("form"))
    return elements.form_elements(parsed, _OWNER).select(*_OWNER, "name", "type", "data_path", "source")


#: The reasons for a form without elements, by variant; each variant's form, names, module and whether it is common.
_UNINDEXED = ("no_legacy_json", "no_tabular_no_widgets", "no_owner_object", "tabular_field_empty_attr_map", "tabular_field_platform_dynamic", "unknown", "tabular_field_programmatic_no_defs", "tabular_field_bsl_source_mismatch", "tabular_field_no_uuid_hits", "unknown")


def unindexed_cases(spark, sf):
    """Why forms have no elements: every owner with every variant of missing evidence."""
    alien = f"""concat('{{"form":[["{D.TABULAR_FIELD}","1",["5",[["11",["20","s","s","s","s","s",["column",["8",["16",["0","{_ALIEN}"]]]]]]]],"0",["14","\\\\"', source, '\\\\""]]]}}')"""
    cases = _tabular_forms(spark, sf).withColumn("variant", F.explode(F.sequence(F.lit(0), F.lit(len(_UNINDEXED) - 1)))).withColumn("source", F.when(F.col("variant") == 4, D.PLATFORM_SOURCES[0]).otherwise("Товары"))
    cases = cases.withColumns({
        "shape": F.expr(f"""CASE variant WHEN 0 THEN NULL WHEN 1 THEN '{{"form":[]}}' WHEN 5 THEN form WHEN 9 THEN '{{' ELSE {alien} END"""),
        "known": F.when(F.col("variant") != 3, F.col("names")),
        "module": F.when(F.col("variant") == 7, 'Другой.Колонки.Добавить("К")').when(F.col("variant") == 8, 'ЭтаФорма.товары.Columns.Add( "К" )').otherwise(""),
    })
    judged = elements.unindexed_reasons(cases, F.col("known"), F.col("shape"), F.col("module"), F.col("variant") == 2)
    return judged.select(*_OWNER, "variant", F.col("unindexed.reason").alias("reason"))


def _paths(spark, sf):
    """Bindings with data paths of named segments: (binding_id, dump_id, form_key, parts)."""
    rows = read_table(spark, sf, "bindings").selectExpr("binding_id", "dump_id", "form_key", "transform(split(data_path, '[.]'), p -> trim(p)) AS parts").distinct()
    return rows.where("size(parts) > 1 AND forall(parts, p -> p != '')")


#: What comes of a chain, by variant; NULL: it is followed, by the form's attributes or (9) by a table that the form declares.
_CHAINS = (None, "no_bind_slot", "bind_slot_unbound_marker", "bind_slot_not_a_chain", "chain_malformed", "chain_too_short", "chain_table_not_declared", "chain_segment_unresolved", "chain_name_mismatch", None)


def _chained(spark, sf):
    """(binding_id, dump_id, form_key, data_path, reason): each data path written as a chain of numbers, and decoded."""
    rows = _paths(spark, sf).withColumn("variant", F.expr(f"binding_id % {len(_CHAINS)}")).withColumn("n", F.size("parts"))
    tabled = "variant = 9"
    props = f"""aggregate(reverse(sequence(1, if({tabled}, n - 1, n))), '', (below, i) -> concat('{{"name":', {_text('parts[i - 1]')}, ',"id":"', i, '"', if(below = '', '', concat(',"child":[', below, ']')), '}}'))"""
    segment = f"""if({tabled} AND i = n - 1, concat('["', i, '","{_U}"]'), concat('["', i, '"]'))"""
    chain = f"""concat('["', n, '",', array_join(transform(sequence(1, n), i -> {segment}), ','), ']')"""
    block = f"""CASE variant WHEN 2 THEN '["1","0"]' WHEN 3 THEN '"0"' WHEN 4 THEN '["9",["1"],["2"]]' WHEN 5 THEN '["1",["1"]]' WHEN 6 THEN '["2",["1"],["2","{_ALIEN}"]]' WHEN 7 THEN '["2",["1"],["77"]]' ELSE {chain} END"""
    raw = f"""concat('[', if(variant = 1, '"0","0","0","0","0"', concat(repeat('"0",', {D.BIND_SLOT}), {block})), ']')"""
    name = "concat(array_join(parts, ''), if(variant = 8, 'Иное', ''))"
    address = f"""array_join(transform(sequence(1, n - 1), i -> {segment}), ',')"""
    table = f"""if({tabled}, concat('["0",["', n - 1, '",', {address}, '],"1",["5","', n, '","0",', {_quoted('parts[n - 1]')}, ']]'), '')"""
    rows = rows.withColumns({
        "elem": F.expr(f"""concat('{{"props":[', {props}, '],"data":{{', {_text(name)}, ':{{"raw":', {raw}, '}}}}}}')"""),
        "form": F.expr(f"""concat('{{"form":[[["0","0","0",[', {table}, ']]]]}}')"""),
    })
    parsed = elements.parse_forms(rows, "elem", form=F.col("form"))
    return parsed.selectExpr("binding_id", "dump_id", "form_key", "get(filter(parsed.elements, e -> e.source = 'data'), 0).data_path AS data_path", "get(parsed.zero_binding, 0).reason AS reason")


def chain_bindings(spark, sf):
    """Data paths of chains, or the reason why there is none."""
    return _chained(spark, sf).drop("dump_id", "form_key")


def chain_reasons(spark, sf):
    """The reason of each form: that of all its chains without path, or mixed."""
    return coverage.reason_of_form(_chained(spark, sf).where("form_key IS NOT NULL"), ["dump_id", "form_key"])


def managed_paths(spark, sf):
    """Data paths of managed forms by the owner's attributes that a record mentions: one, and two."""
    attributes = _attributes(spark, sf)
    pairs = attributes.groupBy(*_OWNER, "uuid").agg(F.min("attr_id").alias("attr_id")).groupBy(*_OWNER).agg(F.array_sort(F.collect_list(F.struct("attr_id", "uuid"))).alias("all"))
    one = f"""concat('"e', a.attr_id, '":{{"raw":["48",["1","{_U}"],["0","', a.uuid, '"]]}}')"""
    two = """concat('"p/x', a.attr_id, '":{"raw":[["0","', a.uuid, '"],["0","', all[i + 1].uuid, '"]]}')"""
    data = f"array_join(flatten(transform(all, (a, i) -> array_compact(array({one}, if(i + 1 < size(all), {two}, NULL))))), ',')"
    forms = pairs.withColumn("elem", F.expr(f"""concat('{{"data":{{', {data}, '}}}}')""")).join(_names(attributes), _OWNER)
    parsed = elements.parse_forms(forms, "elem", F.col("names"))
    return elements.form_elements(parsed, _OWNER).select(*_OWNER, "name", "parent", "data_path")


def ordinary_paths(spark, sf):
    """Data paths of ordinary forms: a property and the attribute in the record's literal."""
    rows = _paths(spark, sf).where("size(parts) = 2")
    elem = f"""concat('{{"data":{{', {_text('parts[1]')}, ':{{"id":1,"raw":["1","2","3","4",["14",', {_quoted('parts[1]')}, ']],"prop":', {_text('parts[0]')}, '}}}}}}')"""
    parsed = elements.parse_forms(rows.withColumn("elem", F.expr(elem)), "elem")
    return elements.form_elements(parsed, ["binding_id"]).select("binding_id", "name", "data_path")


def _named(spark, sf):
    """(owner, name, id): the distinct attribute names of each owner with the least id of each."""
    return _attributes(spark, sf).groupBy(*_OWNER, "name").agg(F.min("attr_id").alias("id"))


def merged_elements(spark, sf):
    """Elements that several sections name, under different keys: one row each, of the better section, with the type that the tree says last."""
    listed = lambda test, sql: f"array_join(transform(filter(array_sort(collect_list(struct(id, name))), s -> {test}), s -> {sql}), ',')"
    name = _text("s.name")
    tree = f"""concat('{{"Имя":', {name}, ',"Тип":"Field"}},{{"name":', {name}, ',"kind":"Table"}}')"""
    sections = {"tree": listed("true", tree), "props": listed("true", f"""concat('{{"caption":', {name}, '}}')"""), "data": listed("s.id % 2 = 0", f"""concat({name}, ':{{"id":1}}')""")}
    forms = _named(spark, sf).groupBy(*_OWNER).agg(F.expr(f"""concat('{{"tree":[', {sections['tree']}, '],"props":[', {sections['props']}, '],"data":{{', {sections['data']}, '}}}}')""").alias("elem"))
    rows = elements.form_elements(elements.parse_forms(forms, "elem"), _OWNER)
    return rows.select(*_OWNER, "name", "type", "source", F.array_join("merged_sources", "|").alias("merged_sources"))


def tree_hashes(spark, sf):
    """Structure hashes of element files: ids, colours and the like play no part."""
    node = f"""concat('{{"id":', id, ',"color":"red","name":', {_text('name')}, ',"type":"Field"}}')"""
    forms = _named(spark, sf).groupBy(*_OWNER).agg(F.expr(f"""concat('{{"tree":[', {_ordered('id, name', node)}, ']}}')""").alias("elem"))
    return elements.parse_forms(forms, "elem").select(*_OWNER, "parsed.elem_sha256")


def procedures(spark, sf):
    """Procedures that module texts declare."""
    return elements.procedures_of(read_table(spark, sf, "documents"), ["doc_id"], "text")


def module_handlers(spark, sf):
    """Handlers of elements, named after them in the module of their form."""
    suffix = "|".join(D.HANDLER_SUFFIXES)
    node = f"""concat('{{"name":', {_text('name')}, ',"type":"Field"}}')"""
    named = procedures(spark, sf).withColumn("name", F.regexp_replace("procedure", f"({suffix})$", "")).where("name != ''").select("doc_id", "name").distinct()
    trees = named.groupBy("doc_id").agg(F.expr(f"""concat('{{"tree":[', {_ordered('name', node)}, ']}}')""").alias("elem"))
    forms = trees.join(read_table(spark, sf, "documents").groupBy("doc_id").agg(F.min("text").alias("text")), "doc_id")
    return elements.form_elements(elements.parse_forms(forms, "elem", module=F.col("text")), ["doc_id"]).select("doc_id", "name", "handler")


def module_columns(spark, sf):
    """Columns that module texts add to tabular fields."""
    rows = _attributes(spark, sf).where(f"section RLIKE '^{_NAME_CHARS}$' AND NOT contains(name, '\"')").select(*_OWNER, "section", "name", "attr_id").distinct()
    line = """concat(if(attr_id % 3 = 0, 'ЭтаФорма.', ''), section, if(attr_id % 2 = 0, '.Колонки.Добавить("', '.columns.add( "'), name, '");')"""
    modules = rows.groupBy(*_OWNER).agg(F.expr(f"array_join(transform(array_sort(collect_list(struct(attr_id, section, name, {line} AS x))), s -> s.x), '\\n')").alias("module"))
    return elements.columns_of_modules(modules, _OWNER, "module").select(*_OWNER, F.col("ord").cast("bigint").alias("ord"), "source", "column_name")


def _uuid_of(sql: str) -> str:
    """SQL (also of the twins): a UUID made of a text."""
    return "concat(" + ", '-', ".join(f"substr(md5({sql}), {start}, {size})" for start, size in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))) + ")"


def _headers(spark, sf, entry: str, section: str, header: str):
    """(owner, header): the attributes of each owner in a positional layout; an attribute of a section counts once."""
    rows = _attributes(spark, sf).groupBy(*_OWNER, "section", "uuid").agg(F.min(F.struct("attr_id", "name", "value_type", "synonym")).alias("a")).select(*_OWNER, "section", "uuid", "a.*")
    rows = rows.withColumn("section_uuid", F.expr(_uuid_of("concat_ws('/', dump_id, object_type, object_name, section)")))
    grouped = rows.groupBy(*_OWNER, "section", "section_uuid").agg(F.count("*").alias("n"), F.expr(_ordered("attr_id", entry)).alias("entries"))
    parts = grouped.select(*_OWNER, "section", F.expr(f"if(section = '', entries, {section})").alias("part"))
    join = lambda test: f"array_join(transform(filter(array_sort(collect_list(struct(section, part))), s -> {test}), s -> s.part), ',')"
    both = parts.groupBy(*_OWNER).agg(F.expr(join("s.section = ''")).alias("plain"), F.expr(join("s.section != ''")).alias("sections"))
    return both.select(*_OWNER, F.expr(header).alias("header"))


def _decoded(headers):
    decoded = objects.decode_objects(headers, "header", wrapped=False)
    return objects.object_attributes(decoded, _OWNER).select(*_OWNER, F.coalesce("section_name", F.lit("")).alias("section_name"), "uuid", "name", "type", "synonym")


_CODES = {"String": "S", "Number": "N", "Boolean": "B", "Date": "D", "Undefined": "U", "Null": "T"}


def header_entries(spark, sf):
    """Attributes and tabular sections of the newer header layout."""
    codes = " ".join(f"""WHEN value_type = '{k}' THEN '["\\\\"{v}\\\\""]'""" for k, v in _CODES.items())
    kind = f"""CASE WHEN startswith(value_type, 'Ref#') THEN concat('["\\\\"#\\\\"",', {_text('substr(value_type, 5)')}, ']') {codes} ELSE '["\\\\"ZZZ\\\\""]' END"""
    synonym = f"""if(synonym IS NULL, '["0"]', concat('["1","\\\\"ru\\\\"",', {_quoted('synonym')}, ']'))"""
    own = lambda uuid, name, more: f"""concat('["2",["1","100","', {uuid}, '"],', {_quoted(name)}, ',', {more}, ']')"""
    entry = f"""concat('[["8",["27",["2",', {own('uuid', 'name', synonym)}, ',["\\\\"Pattern\\\\"",', {kind}, ']]]],"0"]')"""
    bare = """'["0"]'"""
    section = f"""concat('[["1",["11","a","b","c","d",["2",', {own('section_uuid', 'section', bare)}, ']]],"1",["svc","', n, '",', entries, ']]')"""
    header = "concat('[[\"1\",[\"13\"]', if(sections = '', '', concat(',', sections)), if(plain = '', '', concat(',', plain)), ']]')"
    return _decoded(_headers(spark, sf, entry, section, header))


def legacy_header_entries(spark, sf):
    """Attributes and tabular sections of the older header layout."""
    kind = f"""if(value_type IS NULL, '[0]', concat('[0,', {_quoted('value_type')}, ']'))"""
    synonym = f"""if(synonym IS NULL, '[0,0,[0]]', concat('[0,0,[0,"\\\\"ru\\\\"",', {_quoted('synonym')}, ']]'))"""
    entry = f"""concat('[0,[0,0,"', uuid, '"],', {_quoted('name')}, ',', {kind}, ',', {synonym}, ']')"""
    section = f"""concat('[0,[0,0,"', section_uuid, '"],', {_quoted('section')}, ',[0,0,[0]],[0,', entries, ']]')"""
    header = "concat('[[', if(sections = '', '', concat('[0,', sections, ']')), if(sections = '' OR plain = '', '', ','), if(plain = '', '', concat('[0,', plain, ']')), ']]')"
    return _decoded(_headers(spark, sf, entry, section, header))


def _containers(spark, sf):
    """(owner, variant, report): a report container per owner, with a BOM, with an XML declaration, or without either."""
    rows = _attributes(spark, sf).where("name NOT RLIKE '[<\"]' AND object_name NOT RLIKE '[<\"]'").groupBy(*_OWNER, "name").agg(F.min("attr_id").alias("attr_id"))
    dataset = """concat('<DataSet Name="', name, '"><Query>ВЫБРАТЬ ', name, '\\n ИЗ Справочник.', object_name, '</Query></DataSet>')"""
    files = rows.groupBy(*_OWNER).agg(F.expr("min(attr_id) % 3").alias("variant"), F.expr(f"array_join(transform(array_sort(collect_list(struct(attr_id, name, {dataset} AS x))), s -> s.x), '')").alias("xml"))
    head = F.expr("CASE variant WHEN 0 THEN unhex('0000000000000000EFBBBF') WHEN 1 THEN concat(unhex('0000'), encode('<?xml version=\"1.0\"?>', 'UTF-8')) ELSE unhex('00FF') END")
    return reports.containers(files.select(*_OWNER, "variant", F.concat(head, F.encode("xml", "UTF-8")).alias("content")))


def container_queries(spark, sf):
    """Queries of report containers with the names of their data sets."""
    return reports.report_queries(_containers(spark, sf), _OWNER).select(*_OWNER, "name", "query")


def container_warnings(spark, sf):
    """How many containers could be read."""
    said = F.coalesce(F.regexp_extract("report.warning", "^[a-zA-Z ]+", 0), F.lit("none"))
    return _containers(spark, sf).groupBy("variant", F.trim(said).alias("warning")).agg(F.count("*").alias("n"))


QUERIES = {
    f.__name__: f
    for f in (
        legacy_columns, widget_elements, unindexed_cases, chain_bindings, chain_reasons, managed_paths, ordinary_paths, merged_elements, tree_hashes, procedures, module_handlers, module_columns,
        header_entries, legacy_header_entries, container_queries, container_warnings,
    )
}

_ATTRIBUTES = f"""
WITH attrs AS (
  SELECT DISTINCT coalesce(dump_id, '') AS dump_id, coalesce(object_type, '') AS object_type, coalesce(object_name, '') AS object_name, trim(coalesce(section_name, '')) AS section,
    uuid, trim(attr_name) AS name, attr_id, value_type, synonym
  FROM object_attributes WHERE regexp_full_match(uuid, '{_UUID}') AND trim(attr_name) != ''
), owners AS (SELECT DISTINCT dump_id, object_type, object_name FROM attrs),
names AS (
  SELECT dump_id, object_type, object_name, uuid, name FROM attrs
  QUALIFY row_number() OVER (PARTITION BY dump_id, object_type, object_name, uuid ORDER BY section != '', attr_id, name) = 1
)"""
_ONCE = """, once AS (
  SELECT * FROM attrs QUALIFY row_number() OVER (PARTITION BY dump_id, object_type, object_name, section, uuid ORDER BY attr_id, name, value_type NULLS FIRST, synonym NULLS FIRST) = 1
)"""
_PATHS = """
WITH paths AS (
  SELECT DISTINCT binding_id, dump_id, form_key, list_transform(string_split(data_path, '.'), lambda p: trim(p)) AS parts FROM bindings
), named AS (SELECT * FROM paths WHERE len(parts) > 1 AND NOT list_contains(parts, ''))"""
_case = lambda values: "CASE {0} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values) if v) + " END"
_CHAINED = _PATHS + f", chains AS (SELECT *, {_case(_CHAINS).format(f'binding_id % {len(_CHAINS)}')} AS reason FROM named)"
_PROCEDURES = r"""
WITH found AS (SELECT doc_id, text, unnest(regexp_extract_all(text, '(?im)^\s*Процедура\s+([А-Яа-яA-Za-z0-9_]+)\s*\(', 1)) AS procedure FROM documents)"""
_first = lambda suffixes: "CASE " + " ".join(f"WHEN list_contains(p.all_of, s.name || '{x}') THEN s.name || '{x}'" for x in suffixes) + " END"
_type = "CASE WHEN starts_with(value_type, 'Ref#') THEN CASE WHEN trim(substr(value_type, 5)) != '' THEN 'Ref#' || trim(substr(value_type, 5)) END WHEN value_type IN (" + ", ".join(f"'{k}'" for k in _CODES) + ") THEN value_type END"
_CONTAINERS = _ATTRIBUTES + """, sets AS (
  SELECT dump_id, object_type, object_name, name, min(attr_id) AS attr_id FROM attrs WHERE NOT regexp_matches(name, '[<"]') AND NOT regexp_matches(object_name, '[<"]') GROUP BY ALL
), files AS (SELECT dump_id, object_type, object_name, min(attr_id) % 3 AS variant FROM sets GROUP BY ALL)"""

ORACLES = {
    "legacy_columns": _ATTRIBUTES
    + """, slots AS (SELECT dump_id, object_type, object_name, section, uuid, min(attr_id) AS ord FROM attrs GROUP BY ALL)
SELECT dump_id, object_type, object_name, name, 'TabularFieldColumn' AS type, CASE section WHEN '' THEN 'Список' ELSE section END || '.' || name AS data_path, 'legacy_list_form_json' AS source
FROM slots JOIN names USING (dump_id, object_type, object_name, uuid)
QUALIFY row_number() OVER (PARTITION BY dump_id, object_type, object_name, name ORDER BY section, ord) = 1""",
    "widget_elements": _ATTRIBUTES
    + """ SELECT dump_id, object_type, object_name, name, CASE WHEN attr_id % 2 = 0 THEN 'InputField' ELSE 'ComboBox' END AS type, 'Объект.' || name AS data_path, 'legacy_form_json' AS source
FROM attrs QUALIFY row_number() OVER (PARTITION BY dump_id, object_type, object_name, name ORDER BY attr_id, section, uuid) = 1""",
    "unindexed_cases": _ATTRIBUTES + f" SELECT owners.*, v::INT AS variant, {_case(_UNINDEXED).format('v')} AS reason FROM owners, range({len(_UNINDEXED)}) r(v)",
    "chain_bindings": _CHAINED + " SELECT binding_id, CASE WHEN reason IS NULL THEN array_to_string(parts, '.') END AS data_path, reason FROM chains",
    "chain_reasons": _CHAINED + " SELECT dump_id, form_key, CASE WHEN count(DISTINCT reason) = 1 THEN min(reason) WHEN count(DISTINCT reason) > 1 THEN 'mixed' END AS reason FROM chains WHERE form_key IS NOT NULL GROUP BY dump_id, form_key",
    "managed_paths": _ATTRIBUTES
    + """, firsts AS (SELECT dump_id, object_type, object_name, uuid, min(attr_id) AS attr_id FROM attrs GROUP BY ALL),
pairs AS (SELECT f.*, n.name, lead(n.name) OVER (PARTITION BY f.dump_id, f.object_type, f.object_name ORDER BY attr_id, uuid) AS other, lead(1) OVER (PARTITION BY f.dump_id, f.object_type, f.object_name ORDER BY attr_id, uuid) AS more
  FROM firsts f JOIN names n USING (dump_id, object_type, object_name, uuid))
SELECT dump_id, object_type, object_name, 'e' || attr_id AS name, NULL::VARCHAR AS parent, 'Объект.' || name AS data_path FROM pairs
UNION ALL SELECT dump_id, object_type, object_name, 'x' || attr_id, 'p', CASE WHEN name = other THEN 'Объект.' || name END FROM pairs WHERE more = 1""",
    "ordinary_paths": _PATHS + " SELECT binding_id, parts[2] AS name, CASE WHEN parts[1] = parts[2] THEN parts[1] ELSE parts[1] || '.' || parts[2] END AS data_path FROM named WHERE len(parts) = 2",
    "merged_elements": _ATTRIBUTES
    + """ SELECT dump_id, object_type, object_name, name, CASE WHEN min(attr_id) % 2 = 0 THEN 'Table' ELSE 'Unknown' END AS type, CASE WHEN min(attr_id) % 2 = 0 THEN 'data' ELSE 'props' END AS source,
  CASE WHEN min(attr_id) % 2 = 0 THEN 'data|props' END AS merged_sources FROM attrs GROUP BY dump_id, object_type, object_name, name""",
    "tree_hashes": _ATTRIBUTES
    + """ SELECT dump_id, object_type, object_name, sha256('[' || string_agg('{"name": ' || to_json(name)::VARCHAR || ', "page": null, "parent": null, "parent_path": null, "path": null, "source": "tree", "type": "Field"}', ', ' ORDER BY id, name) || ']') AS elem_sha256
FROM (SELECT dump_id, object_type, object_name, name, min(attr_id) AS id FROM attrs GROUP BY ALL) GROUP BY dump_id, object_type, object_name""",
    "procedures": _PROCEDURES + " SELECT DISTINCT doc_id, procedure FROM found",
    "module_handlers": _PROCEDURES
    + f""", p AS (SELECT doc_id, list(DISTINCT procedure) AS all_of FROM found GROUP BY doc_id),
s AS (SELECT DISTINCT doc_id, regexp_replace(procedure, '({"|".join(D.HANDLER_SUFFIXES)})$', '') AS name FROM found)
SELECT doc_id, s.name, {_first(D.HANDLER_SUFFIXES)} AS handler FROM s JOIN p USING (doc_id) WHERE s.name != ''""",
    "module_columns": _ATTRIBUTES
    + f""", rows_ AS (SELECT DISTINCT dump_id, object_type, object_name, section, name, attr_id FROM attrs WHERE regexp_full_match(section, '{_NAME_CHARS}') AND NOT contains(name, '"'))
SELECT dump_id, object_type, object_name, row_number() OVER (PARTITION BY dump_id, object_type, object_name ORDER BY attr_id, section, name) - 1 AS ord, section AS source, name AS column_name FROM rows_""",
    "header_entries": _ATTRIBUTES
    + _ONCE
    + f"""SELECT dump_id, object_type, object_name, section AS section_name, uuid, name, {_type} AS type, nullif(trim(synonym), '') AS synonym
FROM once o WHERE section != '' OR NOT EXISTS (SELECT 1 FROM once c WHERE c.section != '' AND c.dump_id = o.dump_id AND c.object_type = o.object_type AND c.object_name = o.object_name AND c.uuid = o.uuid)""",
    "legacy_header_entries": _ATTRIBUTES + _ONCE + "SELECT dump_id, object_type, object_name, section AS section_name, uuid, name, nullif(trim(value_type), '') AS type, nullif(trim(synonym), '') AS synonym FROM once",
    "container_queries": _CONTAINERS + r""" SELECT dump_id, object_type, object_name, name, regexp_replace('ВЫБРАТЬ ' || name || ' ИЗ Справочник.' || object_name, '\s+', ' ', 'g') AS query FROM sets JOIN files USING (dump_id, object_type, object_name) WHERE variant != 2""",
    "container_warnings": _CONTAINERS + " SELECT variant, CASE variant WHEN 2 THEN 'neither a BOM nor an XML declaration in' ELSE 'none' END AS warning, count(*) AS n FROM files GROUP BY ALL",
}
