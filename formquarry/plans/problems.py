"""Queries of the five general data problems and their SQL twins where SQL can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from formquarry.operators import incremental, nested, orphans, schema_drift, snapshots
from formquarry.session import read_table


def p1_found(spark, sf):
    return nested.nested_links(read_table(spark, sf, "elem_files"), read_table(spark, sf, "owner_objects"))


def p1_tree(spark, sf):
    return nested.tree_table(read_table(spark, sf, "elem_files")).distinct()


def p1_raw(spark, sf):
    return nested.raw_table(read_table(spark, sf, "elem_files")).distinct()


def p1_header(spark, sf):
    return nested.entry_links(read_table(spark, sf, "owner_objects")).distinct()


def p1_child_counts(spark, sf):
    """Per source and kind: nodes, those with children, and the widest parent."""
    per_parent = p1_found(spark, sf).groupBy("link_kind", "owner_id", "parent").agg(F.count("*").alias("n"))
    return per_parent.groupBy("link_kind").agg(F.sum("n").alias("links"), F.count("*").alias("parents"), F.max("n").alias("widest"))


def p1_unread(spark, sf):
    """The texts that give no nodes because they are no JSON, and why."""
    elem = nested.unread_texts(read_table(spark, sf, "elem_files"), "elem_files", "elem_id", "elem")
    return elem.unionByName(nested.unread_texts(read_table(spark, sf, "owner_objects"), "owner_objects", "object_id", "header"))


def p2_unread(spark, sf):
    """The payloads that are no JSON, by file and reason."""
    records = read_table(spark, sf, "index_files").withColumn("id", F.concat_ws("/", "feed_id", "file_no", "rec_no", F.md5("payload")))
    return nested.unread_texts(records, "index_files", "id", "payload").groupBy(F.substring_index("row_id", "/", 2).alias("file"), "reason").agg(F.count("*").alias("n"))


def p2_found(spark, sf):
    return schema_drift.field_changes(read_table(spark, sf, "index_files"))


def p2_union_schema(spark, sf):
    """The promotion of the types that files have by majority."""
    return schema_drift.union_schema(schema_drift.file_headers(read_table(spark, sf, "index_files")))


def p2_full_schema(spark, sf):
    """The promotion of every type that occurs, as the columns of ``p2_entries`` have it."""
    return schema_drift.union_schema(schema_drift.file_kinds(read_table(spark, sf, "index_files")))


def p2_entries(spark, sf):
    return schema_drift.consistent_entries(read_table(spark, sf, "index_files"))


def p2_values(spark, sf):
    """The cells of the consistent table under the names that the files use, one per row."""
    return schema_drift.entry_values(schema_drift.consistent_entries(read_table(spark, sf, "index_files"), follow_renames=False))


def _orphans(spark, sf):
    return orphans.attribute_orphans(*(read_table(spark, sf, t) for t in ("reference_types", "object_attributes", "bindings")))


def p3_found(spark, sf):
    return _orphans(spark, sf).select("table_name", "row_id", "orphan_kind").distinct()


def p3_monthly(spark, sf):
    return orphans.orphan_counts(_orphans(spark, sf))


def p4_found(spark, sf):
    return snapshots.form_changes(read_table(spark, sf, "form_scans"))


def p4_report_check(spark, sf):
    return snapshots.report_check(p4_found(spark, sf), read_table(spark, sf, "drift_reports"))


def _ledger(spark, sf):
    return incremental.form_runs(read_table(spark, sf, "freshness"), read_table(spark, sf, "unpack_runs"))


def p5_found(spark, sf):
    return incremental.due_forms(_ledger(spark, sf))


def p5_ledger(spark, sf):
    return _ledger(spark, sf)


def p5_live(spark, sf):
    """The same by the ledger itself: one lease and one commit a run."""
    return incremental.live_forms(read_table(spark, sf, "freshness"), read_table(spark, sf, "unpack_runs"))


QUERIES = {f.__name__: f for f in (p1_found, p1_tree, p1_raw, p1_header, p1_child_counts, p1_unread, p2_found, p2_union_schema, p2_full_schema, p2_entries, p2_values, p2_unread, p3_found, p3_monthly, p4_found, p4_report_check, p5_found, p5_ledger, p5_live)}

_ORPHANS = """
WITH children AS (
  SELECT DISTINCT 'object_attributes' AS table_name, attr_id AS row_id, dump_id, '' AS k1, '' AS k2, lower(substr(value_type, 5)) AS k3, '' AS k4, recorded_at AS tm, 'r' AS parent
  FROM object_attributes WHERE value_type LIKE 'Ref#%'
  UNION
  SELECT DISTINCT 'bindings', binding_id, dump_id, object_type, object_name,
    CASE WHEN len(p) = 3 THEN lower(trim(p[2])) ELSE '' END, lower(trim(p[-1])), bound_at, 'a'
  FROM (SELECT *, string_split(data_path, '.') AS p FROM bindings) WHERE len(p) IN (2, 3)
), parents AS (
  SELECT 'r' AS parent, dump_id, '' AS k1, '' AS k2, lower(uuid) AS k3, '' AS k4, registered_at AS s, coalesce(deleted_at, TIMESTAMP '9999-12-31') AS e FROM reference_types
  UNION
  SELECT 'a', dump_id, object_type, object_name, lower(trim(coalesce(section_name, ''))), lower(trim(coalesce(attr_name, ''))), recorded_at, coalesce(removed_at, TIMESTAMP '9999-12-31') FROM object_attributes
), judged AS (
  SELECT c.table_name, c.row_id, c.tm, count(p.parent) AS n, count(*) FILTER (p.s <= c.tm) AS started, count(*) FILTER (p.s <= c.tm AND c.tm < p.e) AS live
  FROM children c LEFT JOIN parents p ON c.parent = p.parent AND c.dump_id = p.dump_id AND c.k1 = p.k1 AND c.k2 = p.k2 AND c.k3 = p.k3 AND c.k4 = p.k4
  GROUP BY ALL
), found AS (
  SELECT table_name, row_id, tm, CASE WHEN n = 0 THEN 'missing' WHEN started = 0 THEN 'late' ELSE 'deleted' END AS orphan_kind FROM judged WHERE live = 0
)
"""

_CHANGES = """
WITH latest AS (
  SELECT dump_id, snapshot_no, concat_ws('/', coalesce(object_type, ''), coalesce(object_name, ''), coalesce(container_name, ''), coalesce(form_name, '')) AS form_key,
    lower(bsl_sha256) AS b, lower(elem_sha256) AS e
  FROM form_scans WHERE dump_id IS NOT NULL AND snapshot_no IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY dump_id, snapshot_no, form_key ORDER BY loaded_at DESC NULLS LAST, b DESC NULLS LAST, e DESC NULLS LAST) = 1
), snaps AS (
  SELECT dump_id, snapshot_no, lag(snapshot_no) OVER (PARTITION BY dump_id ORDER BY snapshot_no) AS prev_no FROM (SELECT DISTINCT dump_id, snapshot_no FROM latest)
), olds AS (SELECT s.dump_id, s.snapshot_no, l.form_key, l.b, l.e FROM snaps s JOIN latest l ON l.dump_id = s.dump_id AND l.snapshot_no = s.prev_no),
news AS (SELECT l.* FROM snaps s JOIN latest l ON l.dump_id = s.dump_id AND l.snapshot_no = s.snapshot_no WHERE s.prev_no IS NOT NULL),
changes AS (
  SELECT dump_id, snapshot_no, form_key,
    CASE WHEN o.form_key IS NULL THEN 'added' WHEN n.form_key IS NULL THEN 'removed' WHEN n.b != o.b OR n.e != o.e THEN 'changed' END AS change_kind
  FROM (SELECT *, 1 AS there FROM news) n FULL JOIN (SELECT *, 1 AS there FROM olds) o USING (dump_id, snapshot_no, form_key)
)
"""
_CHANGES = _CHANGES.replace("o.form_key IS NULL", "o.there IS NULL").replace("n.form_key IS NULL", "n.there IS NULL")

_LEDGER = """
WITH runs AS (SELECT run_no, started_at, coalesce(run_status, '') = 'succeeded' AS ok FROM unpack_runs WHERE run_no IS NOT NULL AND started_at IS NOT NULL),
curs AS (
  SELECT r.run_no, r.ok, f.form_name, lower(f.bsl_sha256) AS h, f.bin_mtime AS m,
    f.bsl_sha256 IS NOT NULL AND f.unpacked_mtime IS NOT NULL AND coalesce(f.bin_mtime <= f.unpacked_mtime, false) AS trusted
  FROM runs r JOIN freshness f ON f.delivered_at <= r.started_at
  WHERE f.form_name IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY r.run_no, f.form_name ORDER BY f.bin_mtime DESC NULLS LAST, f.delivered_at DESC, f.rec_id DESC NULLS LAST) = 1
), succeeded AS (SELECT run_no, lag(run_no) OVER (ORDER BY run_no) AS prev_no FROM runs WHERE ok)
"""
_DUE = """SELECT c.run_no, c.form_name
FROM succeeded s JOIN curs c ON c.run_no = s.run_no LEFT JOIN curs p ON p.run_no = s.prev_no AND p.form_name = c.form_name
WHERE p.form_name IS NULL OR CASE WHEN c.trusted AND p.trusted THEN c.h != p.h ELSE abs(c.m - p.m) > 1.0 END
"""

_UUID = "[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}"
_DOCS = "SELECT DISTINCT {0} AS owner_id, json(ltrim({1}, chr(65279))) AS doc FROM {2} WHERE json_valid(ltrim({1}, chr(65279)))"
_NESTED = f"""
WITH RECURSIVE elems AS ({_DOCS.format("elem_id", "elem", "elem_files")}), owners AS ({_DOCS.format("object_id", "header", "owner_objects")}),
tops AS (SELECT owner_id, json_extract(doc, '$.tree') AS tree, json_extract(doc, '$.data') AS data FROM elems WHERE json_type(doc) = 'OBJECT'),
tree_nodes AS (
  SELECT owner_id, '0' AS child, '' AS parent, tree AS node FROM tops WHERE json_type(tree) = 'OBJECT'
  UNION ALL SELECT owner_id, e.key, '', e.value FROM tops, json_each(tree) e WHERE json_type(tree) = 'ARRAY' AND e.type = 'OBJECT'
  UNION ALL SELECT n.owner_id, n.child || '/' || e.key, n.child, e.value
  FROM tree_nodes n, (VALUES ('$.child'), ('$.items')) k(p), json_each(json_extract(n.node, k.p)) e
  WHERE json_type(json_extract(n.node, k.p)) = 'ARRAY' AND e.type = 'OBJECT'
), raws AS (
  SELECT owner_id, e.key AS parent, json_extract(e.value, '$.raw') AS raw FROM tops, json_each(data) e WHERE json_type(data) = 'OBJECT' AND e.type = 'OBJECT'
), raw_tops AS (
  SELECT owner_id, parent, CASE WHEN json_type(raw) = 'VARCHAR' AND json_valid(raw ->> '$') THEN json(raw ->> '$') ELSE raw END AS node FROM raws
), raw_arrays AS (
  SELECT owner_id, parent, node, {{key}} AS child FROM raw_tops WHERE json_type(node) = 'ARRAY'
  UNION ALL SELECT n.owner_id, coalesce(n.child, n.parent), e.value, {{key_below}}
  FROM raw_arrays n, json_each(n.node) e WHERE e.type = 'ARRAY'
), header_arrays AS (
  SELECT owner_id, '' AS path, 0 AS depth, '' AS parent, NULL::VARCHAR AS sec, NULL::VARCHAR AS own, doc AS node, {{entry}} AS uuid, {{record}} AS rec FROM owners WHERE json_type(doc) = 'ARRAY'
  UNION ALL SELECT n.owner_id, n.path || '/' || e.key, n.depth + 1, coalesce(n.uuid, n.parent),
    CASE WHEN n.uuid IS NOT NULL THEN NULL WHEN n.rec AND e.key = '2' THEN n.path ELSE n.sec END,
    CASE WHEN n.uuid IS NOT NULL OR (n.rec AND e.key = '2') THEN NULL WHEN n.rec AND e.key = '0' THEN n.path ELSE n.own END,
    e.value, {{entry_below}}, {{record_below}}
  FROM header_arrays n, json_each(n.node) e WHERE e.type = 'ARRAY'
), heads AS (SELECT owner_id, own, arg_min(uuid, depth) AS uuid FROM header_arrays WHERE uuid IS NOT NULL AND own IS NOT NULL GROUP BY ALL),
tree AS (SELECT DISTINCT 'tree' AS link_kind, owner_id, child, parent FROM tree_nodes),
raw AS (SELECT DISTINCT 'raw' AS link_kind, owner_id, child, parent FROM raw_arrays WHERE child IS NOT NULL),
header AS (SELECT DISTINCT 'header' AS link_kind, n.owner_id, n.uuid AS child, coalesce(h.uuid, n.parent) AS parent FROM header_arrays n LEFT JOIN heads h ON h.owner_id = n.owner_id AND h.own = n.sec WHERE n.uuid IS NOT NULL),
links AS (SELECT * FROM tree UNION ALL SELECT * FROM raw UNION ALL SELECT * FROM header)
"""


def _array_tests(sql: str) -> str:
    """Fill in what makes an array a node, an entry or a record, for the array ``doc``/``node`` and for a member ``e.value``."""
    key = f"CASE WHEN json_type({{0}}, '$[1]') = 'ARRAY' AND json_array_length({{0}}, '$[1]') = 2 AND regexp_full_match({{0}} ->> '$[1][1]', '{_UUID}') THEN coalesce({{0}} ->> '$[1][0]', '') END"
    entry = (
        f"CASE WHEN json_type({{0}}, '$[1]') = 'ARRAY' AND json_array_length({{0}}, '$[1]') = 3 AND regexp_full_match({{0}} ->> '$[1][2]', '{_UUID}') AND ({{0}} ->> '$[1][2]') != '00000000-0000-0000-0000-000000000000'"
        " AND json_type({0}, '$[2]') = 'VARCHAR' AND regexp_full_match({0} ->> '$[2]', '(?s)\".+\"') THEN {0} ->> '$[1][2]' END"
    )
    record = "coalesce(json_array_length({0}) = 3 AND json_type({0}, '$[0]') = 'ARRAY' AND json_type({0}, '$[1]') = 'VARCHAR' AND json_type({0}, '$[2]') = 'ARRAY', false)"
    filled = {"key": (key, "node"), "key_below": (key, "e.value"), "entry": (entry, "doc"), "entry_below": (entry, "e.value"), "record": (record, "doc"), "record_below": (record, "e.value")}
    for name, (test, array) in filled.items():
        sql = sql.replace(f"{{{name}}}", test.replace("{0}", array))
    return sql


_NESTED = _array_tests(_NESTED)

_HEADERS = """
WITH records AS (SELECT DISTINCT feed_id, file_no, rec_no, payload FROM index_files WHERE json_valid(payload) AND json_type(payload) = 'OBJECT' AND feed_id IS NOT NULL AND file_no IS NOT NULL),
fields AS (
  SELECT feed_id, file_no, e.key AS field, CASE e.type WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'ARRAY' THEN 'array' WHEN 'OBJECT' THEN 'object' ELSE 'number' END AS kind
  FROM records, json_each(records.payload) e WHERE e.type != 'NULL' AND e.key NOT IN ('object_type', 'object_name', 'container_name', 'form_name')
), headers AS (
  SELECT feed_id, file_no, field, kind FROM (SELECT feed_id, file_no, field, kind, count(*) AS n FROM fields GROUP BY ALL)
  QUALIFY row_number() OVER (PARTITION BY feed_id, file_no, field ORDER BY n DESC, kind) = 1
)
"""

_VALUES = (
    _HEADERS
    + """, cells AS (
  SELECT feed_id, file_no, rec_no, e.key AS field, e.type AS kind, e.value AS v FROM records, json_each(records.payload) e WHERE e.type != 'NULL'
), names AS (
  SELECT field, row_number() OVER (PARTITION BY lower(field) ORDER BY own DESC, field) AS k
  FROM (SELECT DISTINCT field, field IN ('object_type', 'object_name', 'container_name', 'form_name') AS own FROM cells)
), members AS (
  SELECT DISTINCT c.v AS v, '{' || (SELECT coalesce(string_agg(to_json(o.key)::VARCHAR || ':' || json(o.value)::VARCHAR, ',' ORDER BY o.key), '') FROM json_each(c.v) o) || '}' AS sorted FROM cells c WHERE c.kind = 'OBJECT'
)
SELECT feed_id, file_no, rec_no, CASE WHEN k = 1 THEN field ELSE field || '__' || k END AS column_name,
  CASE c.kind WHEN 'OBJECT' THEN m.sorted WHEN 'ARRAY' THEN json(c.v)::VARCHAR ELSE c.v ->> '$' END AS value
FROM cells c JOIN names USING (field) LEFT JOIN members m ON c.kind = 'OBJECT' AND m.v = c.v"""
)

_FIELD_CHANGES = (
    _HEADERS.replace("WITH records", "WITH RECURSIVE records")
    + """, files AS (
  SELECT feed_id, file_no, lag(file_no) OVER w AS prev_no FROM (SELECT DISTINCT feed_id, file_no FROM index_files WHERE feed_id IS NOT NULL AND file_no IS NOT NULL) WINDOW w AS (PARTITION BY feed_id ORDER BY file_no)
), news AS (SELECT f.feed_id, f.file_no, h.field, h.kind FROM files f JOIN headers h USING (feed_id, file_no) WHERE f.prev_no IS NOT NULL),
olds AS (SELECT f.feed_id, f.file_no, f.prev_no, h.field, h.kind FROM files f JOIN headers h ON h.feed_id = f.feed_id AND h.file_no = f.prev_no),
pairs AS (SELECT feed_id, file_no, field, n.kind AS is_kind, o.kind AS was_kind FROM news n FULL JOIN olds o USING (feed_id, file_no, field)),
ends AS (SELECT p.feed_id, p.file_no, f.prev_no, p.field FROM pairs p JOIN files f USING (feed_id, file_no) WHERE is_kind IS NULL),
begins AS (SELECT feed_id, file_no, field FROM pairs WHERE was_kind IS NULL),
vals AS (
  SELECT r.feed_id, r.file_no, concat_ws(chr(1), coalesce((r.payload -> 'object_type')::VARCHAR, ''), coalesce((r.payload -> 'object_name')::VARCHAR, ''), coalesce((r.payload -> 'container_name')::VARCHAR, ''), coalesce((r.payload -> 'form_name')::VARCHAR, '')) AS form, e.key AS field, json(e.value)::VARCHAR AS v
  FROM records r, json_each(r.payload) e WHERE e.type != 'NULL'
  QUALIFY row_number() OVER (PARTITION BY r.feed_id, r.file_no, form, e.key ORDER BY r.rec_no DESC NULLS LAST, v DESC) = 1
), shared AS (
  SELECT e.feed_id, e.file_no, e.field AS old, b.field AS new, count(*) AS n, count(*) FILTER (x.v = y.v) AS same
  FROM ends e JOIN begins b USING (feed_id, file_no) JOIN vals x ON x.feed_id = e.feed_id AND x.file_no = e.prev_no AND x.field = e.field JOIN vals y ON y.feed_id = e.feed_id AND y.file_no = e.file_no AND y.field = b.field AND y.form = x.form
  GROUP BY ALL
), ranked AS (SELECT *, row_number() OVER (PARTITION BY feed_id, file_no ORDER BY same / n DESC, same DESC, old, new) AS k FROM shared WHERE same > 0 AND 2 * same >= n),
walk AS (
  SELECT DISTINCT feed_id, file_no, 0::BIGINT AS k, []::VARCHAR[] AS a, []::VARCHAR[] AS b FROM ranked
  UNION ALL SELECT w.feed_id, w.file_no, r.k, CASE WHEN list_contains(a, old) OR list_contains(b, new) THEN a ELSE list_append(a, old) END, CASE WHEN list_contains(a, old) OR list_contains(b, new) THEN b ELSE list_append(b, new) END
  FROM walk w JOIN ranked r ON r.feed_id = w.feed_id AND r.file_no = w.file_no AND r.k = w.k + 1
), renames AS (SELECT feed_id, file_no, unnest(a) AS old, unnest(b) AS new FROM (SELECT * FROM walk QUALIFY row_number() OVER (PARTITION BY feed_id, file_no ORDER BY k DESC) = 1))
SELECT feed_id, file_no, field AS field_name, '' AS new_name, 'retyped' AS change_kind FROM pairs WHERE is_kind != was_kind
UNION ALL SELECT feed_id, file_no, old, new, 'renamed' FROM renames
UNION ALL SELECT feed_id, file_no, field, '', 'removed' FROM ends e WHERE NOT EXISTS (SELECT 1 FROM renames r WHERE r.feed_id = e.feed_id AND r.file_no = e.file_no AND r.old = e.field)
UNION ALL SELECT feed_id, file_no, field, '', 'added' FROM begins b WHERE NOT EXISTS (SELECT 1 FROM renames r WHERE r.feed_id = b.feed_id AND r.file_no = b.file_no AND r.new = b.field)
"""
)

ORACLES = {
    "p2_found": _FIELD_CHANGES,
    "p2_values": _VALUES,
    "p1_unread": """SELECT DISTINCT source, row_id, CASE WHEN coalesce(text, '') = '' THEN 'no text' ELSE 'not JSON' END AS reason
FROM (SELECT 'elem_files' AS source, elem_id AS row_id, elem AS text FROM elem_files UNION ALL SELECT 'owner_objects', object_id, header FROM owner_objects) WHERE coalesce(text, '') = '' OR NOT json_valid(ltrim(text, chr(65279)))""",
    "p2_unread": """SELECT file, reason, count(*) AS n FROM (
  SELECT DISTINCT concat_ws('/', feed_id, file_no) AS file, concat_ws('/', feed_id, file_no, rec_no, md5(payload)) AS id, CASE WHEN coalesce(payload, '') = '' THEN 'no text' ELSE 'not JSON' END AS reason
  FROM index_files WHERE coalesce(payload, '') = '' OR NOT json_valid(ltrim(payload, chr(65279)))) GROUP BY file, reason""",
    "p1_found": _NESTED + "SELECT * FROM links",
    "p1_tree": _NESTED + "SELECT * FROM tree",
    "p1_raw": _NESTED + "SELECT * FROM raw",
    "p1_header": _NESTED + "SELECT * FROM header",
    "p1_child_counts": _NESTED + "SELECT link_kind, sum(n)::BIGINT AS links, count(*) AS parents, max(n) AS widest FROM (SELECT link_kind, owner_id, parent, count(*) AS n FROM links GROUP BY ALL) GROUP BY link_kind",
    "p2_union_schema": _HEADERS
    + "SELECT field, CASE WHEN count(DISTINCT kind) > 1 THEN 'string' WHEN min(kind) = 'boolean' THEN 'boolean' WHEN min(kind) = 'number' THEN 'double' ELSE 'string' END AS kind FROM headers GROUP BY field",
    "p2_full_schema": _HEADERS
    + "SELECT field, CASE WHEN count(DISTINCT kind) > 1 THEN 'string' WHEN min(kind) = 'boolean' THEN 'boolean' WHEN min(kind) = 'number' THEN 'double' ELSE 'string' END AS kind FROM fields GROUP BY field",
    "p3_found": _ORPHANS + "SELECT DISTINCT table_name, row_id, orphan_kind FROM found",
    "p3_monthly": _ORPHANS + "SELECT table_name, strftime(tm, '%Y-%m') AS month, orphan_kind, count(*) AS orphans FROM found GROUP BY ALL",
    "p4_found": _CHANGES + "SELECT * FROM changes WHERE change_kind IS NOT NULL",
    "p4_report_check": _CHANGES
    + """, claims AS (
  SELECT DISTINCT dump_id, snapshot_no, change_kind, form_key FROM (
    SELECT dump_id, snapshot_no, 'added' AS change_kind, unnest(added) AS form_key FROM drift_reports
    UNION ALL SELECT dump_id, snapshot_no, 'removed', unnest(removed) FROM drift_reports)
), facts AS (SELECT c.* FROM changes c SEMI JOIN drift_reports d ON c.dump_id = d.dump_id AND c.snapshot_no = d.snapshot_no WHERE change_kind IN ('added', 'removed'))
SELECT dump_id, snapshot_no, change_kind, count(*) FILTER (c AND f) AS confirmed, count(*) FILTER (c AND f IS NULL) AS only_claimed, count(*) FILTER (f AND c IS NULL) AS only_found
FROM (SELECT *, true AS c FROM claims) FULL JOIN (SELECT *, true AS f FROM facts) USING (dump_id, snapshot_no, change_kind, form_key) GROUP BY ALL""",
    "p5_found": _LEDGER + _DUE,
    "p5_live": _LEDGER + _DUE,
    "p5_ledger": _LEDGER
    + """, numbered AS (
  SELECT run_no, ok, row_number() OVER (ORDER BY run_no) AS token, 1 + coalesce(sum(ok::INT) OVER before, 0) AS commit_no, max(CASE WHEN ok THEN run_no END) OVER before AS base_no
  FROM runs WINDOW before AS (ORDER BY run_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), judged AS (
  SELECT n.*, c.form_name, p.form_name IS NULL OR CASE WHEN c.trusted AND p.trusted THEN c.h != p.h ELSE abs(c.m - p.m) > 1.0 END AS pending
  FROM numbered n JOIN curs c ON c.run_no = n.run_no LEFT JOIN curs p ON p.run_no = n.base_no AND p.form_name = c.form_name
), spells AS (
  SELECT *, coalesce(count(*) FILTER (ok OR NOT coalesce(pending, false)) OVER (PARTITION BY form_name ORDER BY run_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spell FROM judged
)
SELECT form_name AS item, run_no, token::INT AS token, commit_no::INT AS commit_no, (row_number() OVER (PARTITION BY form_name, spell ORDER BY run_no))::INT AS attempt, CASE WHEN ok THEN 'done' ELSE 'expired' END AS state
FROM spells WHERE pending""",
}
