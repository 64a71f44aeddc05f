"""Schemas that drift between the files of a feed.

The header of each file (its field names and their JSON types) is read from its records in
parallel. Headers of consecutive files are compared by tagging each header row as the new side of
its own file and the old side of the next one, and a field that ends is paired with one that begins
where the values of the same records agree. A fold of all types that occur, those of a few stray values
too, through a promotion lattice gives the union schema, to which every record is cast without loss:
integers, decimals and doubles are told apart, and what no common number type holds exactly becomes text.

Defined results: text that is not JSON, or not a JSON object, has no fields; redelivered records count
once; rows without feed or file number are left out; a file whose records are all broken exists and
has no fields; among types equally frequent in a file the first in alphabetical order is the file's;
of several records of one key in a file the one with the greatest number counts; among several
possible renames the greatest share of equal values wins, then their number, then the names; each
field takes part in one rename at most.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from formquarry.functions.json import allow_duplicate_keys, parsed
from formquarry.session import bounded, stored

FORM_IDS = ("object_type", "object_name", "container_name", "form_name")
#: Field names are driver-side metadata of the union schema; more names than this are refused.
MAX_FIELDS = 5_000
#: Pairs of names that renames connect and that one file has both of; refused beyond, like names.
MAX_PAIRS = 100_000
#: Files with fields that end or begin are broadcast up to so many (some 200 bytes each) when values are compared.
BROADCAST_FILES = 200_000
#: What a column of one JSON type holds; anything else, and two different ones, become the JSON text.
PROMOTED = {"boolean": "boolean", "number": "double"}
#: Bottom of the exact lattice: what a column of one kind of value holds. Above: integers and decimals are
#: promoted to the decimal that holds both (up to MAX_DIGITS digits), all else to the JSON text, its top.
EXACT = {"boolean": "boolean", "BIGINT": "bigint", "DOUBLE": "double"}
INTEGER_DIGITS, MAX_DIGITS = 19, 38


def _parsed(df: DataFrame, *more: str) -> DataFrame:
    """Records as delivered, with their fields: (feed_id, file_no, rec_no, more..., doc map<name, variant>)."""
    allow_duplicate_keys(df.sparkSession)
    rows = df.dropna(subset=["feed_id", "file_no"])
    return rows.selectExpr("feed_id", "file_no", "rec_no", *more, f"{parsed('payload', kind='map<string,variant>')} AS doc")


def file_kinds(df: DataFrame, ids: Sequence[str] = FORM_IDS, exact: bool = False) -> DataFrame:
    """(feed_id, file_no, field, kind, n): the fields present in each file with every type of their values and how many have it.

    ``exact``: numbers have the kind BIGINT, DECIMAL(p,s) or DOUBLE instead of ``number``. Redelivered records are told by two hashes of their text next to their number, so that only
    field names and types are shuffled, not the records.
    """
    names = ",".join(f"'{i}'" for i in ids)
    first = "substring(to_json(e.value), 1, 1)"
    kind = f"CASE {first} WHEN '\"' THEN 'string' WHEN '{{' THEN 'object' WHEN '[' THEN 'array' WHEN 't' THEN 'boolean' WHEN 'f' THEN 'boolean' ELSE {'schema_of_variant(e.value)' if exact else "'number'"} END"
    present = f"filter(map_entries(doc), e -> e.key NOT IN ({names}) AND NOT is_variant_null(e.value))"
    fields = f"transform({present}, e -> concat({kind}, ' ', e.key))"
    records = _parsed(df, "xxhash64(payload) AS h1", "xxhash64(1, payload) AS h2").selectExpr("feed_id", "file_no", "rec_no", "h1", "h2", f"{fields} AS fields")
    values = records.distinct().select("feed_id", "file_no", F.explode("fields").alias("f")).select("feed_id", "file_no", F.substring_index("f", " ", 1).alias("kind"), F.expr("substring(f, instr(f, ' ') + 1)").alias("field"))
    return values.groupBy("feed_id", "file_no", "field", "kind").agg(F.count("*").alias("n"))


def file_headers(df: DataFrame, ids: Sequence[str] = FORM_IDS) -> DataFrame:
    """(feed_id, file_no, field, kind): the fields present in each file with the type of most of their values."""
    return majority(file_kinds(df, ids))


def majority(kinds: DataFrame) -> DataFrame:
    """The headers of ``file_kinds``: of each file and field the type that most values have."""
    return kinds.groupBy("feed_id", "file_no", "field").agg(F.min(F.struct(-F.col("n"), F.col("kind").alias("kind"))).getField("kind").alias("kind"))


def json_kinds(kinds: DataFrame) -> DataFrame:
    """``file_kinds`` of exact kinds with all numbers as one."""
    kind = F.when(F.col("kind").isin("boolean", "string", "array", "object"), F.col("kind")).otherwise("number")
    return kinds.groupBy("feed_id", "file_no", "field", kind.alias("kind")).agg(F.sum("n").alias("n"))


def file_steps(df: DataFrame) -> DataFrame:
    """(feed_id, file_no, prev_no, next_no) of the existing files."""
    order = W.partitionBy("feed_id").orderBy("file_no")
    files = df.select("feed_id", "file_no").dropna().distinct()
    return files.select("feed_id", "file_no", F.lag("file_no").over(order).alias("prev_no"), F.lead("file_no").over(order).alias("next_no"))


def field_changes(df: DataFrame, ids: Sequence[str] = FORM_IDS, headers: DataFrame | None = None) -> DataFrame:
    """(feed_id, file_no, field_name, new_name, change_kind): ``p2_found``. ``headers``: those of ``file_headers``, if known."""
    steps = stored(file_steps(df), "file_steps")  # a row per file; read three times
    headers = file_headers(df, ids) if headers is None else headers
    sides = F.expr(
        "filter(array(named_struct('at', if(prev_no IS NULL, NULL, file_no), 'new', kind, 'old', cast(NULL as string)),"
        " named_struct('at', next_no, 'new', cast(NULL as string), 'old', kind)), s -> s.at IS NOT NULL)"
    )
    tagged = headers.join(steps, ["feed_id", "file_no"]).select("feed_id", "field", F.inline(sides))
    both = tagged.groupBy("feed_id", "at", "field").agg(F.max("new").alias("new"), F.max("old").alias("old")).where("NOT (new <=> old)")
    ends, begins = F.collect_list(F.when(F.col("new").isNull(), F.col("field"))), F.collect_list(F.when(F.col("old").isNull(), F.col("field")))
    retyped = F.collect_list(F.when(F.col("new").isNotNull() & F.col("old").isNotNull(), F.col("field")))
    per_file = both.groupBy("feed_id", "at").agg(F.array_sort(ends).alias("ends"), F.array_sort(begins).alias("begins"), F.array_sort(retyped).alias("retyped"))
    per_file = stored(per_file, "field_steps")  # a row per file that changed; read twice
    renamed = _renames(df, per_file.where("size(ends) > 0 AND size(begins) > 0"), steps, ids)
    rows = per_file.join(renamed, ["feed_id", "at"], "left").withColumn("pairs", F.coalesce("pairs", F.expr("cast(array() as array<struct<old:string,new:string>>)")))
    change = "transform({0}, f -> named_struct('field_name', {1}, 'new_name', {2}, 'change_kind', '{3}'))"
    parts = (
        change.format("retyped", "f", "''", "retyped"),
        change.format("array_except(ends, transform(pairs, p -> p.old))", "f", "''", "removed"),
        change.format("array_except(begins, transform(pairs, p -> p.new))", "f", "''", "added"),
        change.format("pairs", "f.old", "f.new", "renamed"),
    )
    return rows.selectExpr("feed_id", "at AS file_no", f"inline(concat({', '.join(parts)}))")


def _renames(df: DataFrame, per_file: DataFrame, steps: DataFrame, ids: Sequence[str]) -> DataFrame:
    """(feed_id, at, pairs): the renames of each file, one-to-one, best first."""
    key = ",".join(f"coalesce(to_json(try_element_at(doc, '{i}')), '')" for i in ids)
    wanted = per_file.select("feed_id", F.col("at").alias("file_no"), F.col("at"), F.lit(True).alias("later"), F.col("begins").alias("fields")).unionByName(
        per_file.join(steps.select("feed_id", F.col("file_no").alias("at"), "prev_no"), ["feed_id", "at"]).select("feed_id", F.col("prev_no").alias("file_no"), "at", F.lit(False).alias("later"), F.col("ends").alias("fields"))
    )
    # A row per file, behind a count; so only files with such fields are parsed again, and no record moves to meet the list.
    wanted = bounded(stored(wanted, "wanted"), BROADCAST_FILES)
    picked = "filter(transform(fields, f -> named_struct('field', f, 'value', try_element_at(doc, f))), x -> x.value IS NOT NULL AND NOT is_variant_null(x.value))"
    values = _parsed(df.join(wanted, ["feed_id", "file_no"]), "at", "later", "fields").selectExpr("feed_id", "at", "later", "rec_no", f"concat_ws('\\u0001', {key}) AS form", f"inline({picked})").selectExpr("feed_id", "at", "later", "rec_no", "form", "field", "to_json(value) AS value")
    last = values.groupBy("feed_id", "at", "form", "later", "field").agg(F.max(F.struct("rec_no", "value")).getField("value").alias("value"))
    old = last.where("NOT later").select("feed_id", "at", "form", F.col("field").alias("old"), F.col("value").alias("was"))
    new = last.where("later").select("feed_id", "at", "form", F.col("field").alias("new"), F.col("value").alias("is"))
    shared = old.join(new, ["feed_id", "at", "form"]).groupBy("feed_id", "at", "old", "new").agg(F.count("*").alias("n"), F.count_if(F.col("was") == F.col("is")).alias("same")).where("same > 0 AND 2 * same >= n")
    best = shared.groupBy("feed_id", "at").agg(F.array_sort(F.collect_list(F.struct((-F.col("same") / F.col("n")).alias("share"), (-F.col("same")).alias("same"), "old", "new"))).alias("found"))
    taken = "exists(a, p -> p.old = c.old OR p.new = c.new)"
    greedy = f"aggregate(found, cast(array() as array<struct<old:string,new:string>>), (a, c) -> if({taken}, a, concat(a, array(named_struct('old', c.old, 'new', c.new)))))"
    return best.selectExpr("feed_id", "at", f"{greedy} AS pairs")


def union_schema(headers: DataFrame) -> DataFrame:
    """(field, kind): the promotion of all types a field has in ``headers``; boolean, double or string (the JSON text).

    Given ``file_headers`` it folds the type each file has by majority, given ``file_kinds`` every type that occurs.
    """
    kinds = headers.groupBy("field").agg(F.array_sort(F.collect_set("kind")).alias("kinds"))
    promoted = F.when(F.size("kinds") > 1, "string")
    for kind, target in PROMOTED.items():
        promoted = promoted.when(F.col("kinds")[0] == kind, target)
    return kinds.select("field", promoted.otherwise("string").alias("kind"))


def exact_schema(kinds: DataFrame) -> DataFrame:
    """(field, kind): the least type of the lattice that holds every value of a field, given ``file_kinds`` with exact kinds."""
    digits = lambda n: F.regexp_extract("kind", r"^DECIMAL\((\d+),(\d+)\)$", n)
    decimal, integer = F.col("kind").startswith("DECIMAL"), F.col("kind") == "BIGINT"
    scale = F.when(decimal, digits(2).cast("int")).when(integer, 0)
    whole = F.when(decimal, F.greatest(digits(1).cast("int") - digits(2).cast("int"), F.lit(0))).when(integer, INTEGER_DIGITS)
    folded = kinds.groupBy("field").agg(F.min("kind").alias("low"), F.max("kind").alias("high"), F.max(whole).alias("whole"), F.max(scale).alias("scale"), F.bool_and(decimal | integer).alias("numbers"))
    promoted = F.when((F.col("low") == F.col("high")) & F.col("low").isin(*EXACT), F.element_at(F.create_map(*[F.lit(x) for pair in EXACT.items() for x in pair]), F.col("low")))
    held = F.col("numbers") & (F.col("whole") + F.col("scale") <= MAX_DIGITS)
    return folded.select("field", promoted.when(held, F.format_string("decimal(%d,%d)", F.greatest(F.col("whole") + F.col("scale"), F.lit(1)), "scale")).otherwise("string").alias("kind"))


def field_groups(headers: DataFrame, changes: DataFrame) -> dict[str, str]:
    """name -> the name of its column: names that renames connect share one, unless a file has both of them.

    Names are driver-side metadata, refused beyond MAX_FIELDS. The column is called after the name
    that most files have. Renames seen most often are followed first.
    """
    renames = changes.where("change_kind = 'renamed'").groupBy("field_name", "new_name").agg(F.count("*").alias("n"))
    pairs = [(r.field_name, r.new_name) for r in sorted(renames.limit(MAX_FIELDS + 1).collect(), key=lambda r: (-r.n, r.field_name, r.new_name))]
    files = {r.field: r.n for r in headers.groupBy("field").agg(F.count("*").alias("n")).limit(MAX_FIELDS + 1).collect()}
    if max(len(pairs), len(files)) > MAX_FIELDS:
        raise ValueError(f"more than {MAX_FIELDS} field names")
    linked: dict[str, set[str]] = {}
    for pair in pairs:
        merged = set().union(*(linked.get(name, {name}) for name in pair))
        linked |= dict.fromkeys(merged, merged)
    # Only names that renames connect can share a column, so only their pairs are asked for: a number per
    # connected set keeps the rest apart.
    number = {name: i for i, group in enumerate({id(g): g for g in linked.values()}.values()) for name in group}
    apart: set[tuple[str, str]] = set()
    if number:
        numbers = F.create_map(*[F.lit(x) for item in number.items() for x in item])
        sets = headers.where(F.col("field").isin(*number)).groupBy("feed_id", "file_no", F.element_at(numbers, F.col("field")).alias("set")).agg(F.array_sort(F.collect_set("field")).alias("names")).select("names").distinct()
        together = sets.where(F.size("names") > 1).select(F.explode("names").alias("a"), "names").select("a", F.explode("names").alias("b")).where("a < b").distinct()
        met = together.limit(MAX_PAIRS + 1).collect()
        if len(met) > MAX_PAIRS:
            raise ValueError(f"more than {MAX_PAIRS} pairs of names that renames connect and files have together")
        apart = {(r.a, r.b) for r in met}
    groups = {name: {name} for name in files}
    for old, new in pairs:
        one, two = groups.get(old, {old}), groups.get(new, {new})
        if one is not two and not any((min(x, y), max(x, y)) in apart for x in one for y in two):
            for name in (merged := one | two):
                groups[name] = merged
    return {name: min(group, key=lambda x: (-files.get(x, 0), x)) for name, group in groups.items()}


def consistent_entries(df: DataFrame, ids: Sequence[str] = FORM_IDS, follow_renames: bool = True) -> DataFrame:
    """All records in one table with the columns of the union schema.

    A column has the values of all names it had (``field_groups``), cast to the promotion of all
    types that occur under them (``exact_schema``), in however few records, so that every value survives its
    cast exactly; names that differ only in case and are no renames of each other get a number.
    """
    kinds = stored(file_kinds(df, ids, exact=True), "file_kinds")  # a row per file, field and type; read several times
    headers = majority(json_kinds(kinds))
    column_of = field_groups(headers, field_changes(df, ids, headers)) if follow_renames else {}
    named = kinds.withColumn("field", F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in column_of.items() for x in pair]), "field"), "field")) if column_of else kinds
    schema = sorted((r.field, r.kind) for r in exact_schema(named).limit(MAX_FIELDS + 1).collect())
    if len(schema) > MAX_FIELDS:
        raise ValueError(f"more than {MAX_FIELDS} field names")
    names: dict[str, list[str]] = {}
    for name, column in sorted(column_of.items(), key=lambda x: (x[0] != x[1], x[0])):
        names.setdefault(column, []).append(name)
    seen = {"feed_id": 1, "file_no": 1, "rec_no": 1}
    columns = []
    for field, kind in [(i, "string") for i in ids] + schema:
        low = field.lower()
        seen[low] = seen.get(low, 0) + 1
        alias = field if seen[low] == 1 else f"{field}__{seen[low]}"
        values = [F.try_variant_get(F.try_element_at("doc", F.lit(n)), "$", kind) for n in names.get(field, [field])]
        columns.append(F.coalesce(*values).alias(alias))
    once = df.select("feed_id", "file_no", "rec_no", "payload").distinct()
    return _parsed(once).where("doc IS NOT NULL").select("feed_id", "file_no", "rec_no", *columns)


def entry_values(entries: DataFrame) -> DataFrame:
    """(feed_id, file_no, rec_no, column_name, value): the values of ``consistent_entries`` that are there, as text, one per row."""
    fields = [c for c in entries.columns if c not in ("feed_id", "file_no", "rec_no")]
    cells = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").cast("string").alias("value")) for c in fields])
    return entries.select("feed_id", "file_no", "rec_no", F.inline(cells)).where("value IS NOT NULL")
