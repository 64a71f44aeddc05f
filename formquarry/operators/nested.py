"""Deeply nested JSON to flat tables that keep parent-child links.

Each text is parsed once to VARIANT. A fold over the levels holds a frontier of arrays; in each
level nested ``transform`` calls attach the ancestor key and the index to every member, ``flatten``
joins the arrays of the level, and the nodes found are appended. One ``inline`` per target table
then emits the rows. No depth is assumed: the fold has as many steps as the parser admits levels,
and steps with an empty frontier cost nothing.

Defined results: NULL, empty or broken text gives no rows; a leading BOM is ignored; of a repeated
key the last value counts; repeated rows count once (the output is distinct); members that are no
objects (trees) or no arrays (positional lists) are skipped but keep their position; further columns
of the input are never read, whatever their names.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formquarry.functions.json import MAX_NESTING, NULL_UUID, UUID, allow_duplicate_keys, as_array, as_text, let, parsed, parsed_in_brackets
from formquarry.session import arrow_function

#: What is read of a tree node: the VARIANTs that may hold nodes below it.
_NODE = "struct<`child` variant,`items` variant>"


#: Steps per block of the fold; 1,024 in all, which is more levels than the JSON parser admits (MAX_NESTING).
_BLOCKS = (4, 4, 8, 16, 32, 64, 128, 256, 512)


def _fold(start: str, out_type: str, step: str, value: str = "a.out") -> str:
    """SQL: fold ``step`` (which sees ``a.out`` and ``a.front``) from the frontier ``start`` until no frontier is left.

    ``aggregate`` copies its state in every step, so the steps come in growing blocks: once the
    frontier is empty, at most the rest of the block and one step for each further block follow.
    """
    init = f"named_struct('out', cast(array() as array<{out_type}>), 'front', {start})"
    block = f"aggregate(array_repeat(0, if(size(s.front) = 0, 0, m)), s, (a, n) -> if(size(a.front) = 0, a, {step}))"
    return f"aggregate(array{_BLOCKS}, {init}, (s, m) -> {block}, a -> {value})"


def tree_links(doc: str, path: str = "$[0].tree") -> str:
    """SQL: the nodes of the tree (array, or one object) at ``path`` of a VARIANT as array of (child, parent) paths."""
    front = f"array<struct<child:string,parent:string,o:{_NODE.replace('` ', '`:')}>>"

    def members(array: str, where: str, prefix: str, parent: str) -> str:
        node = f"named_struct('child', {prefix}, 'parent', {parent}, 'o', x)"
        nodes = f"filter(transform(try_variant_get({array}, '{where}', 'array<{_NODE}>'), (x, i) -> {node}), m -> m.o IS NOT NULL)"
        return f"coalesce({nodes}, cast(array() as {front}))"

    single = f"filter(array(named_struct('child', '0', 'parent', '', 'o', try_variant_get({doc}, '{path}', '{_NODE}'))), m -> m.o IS NOT NULL)"
    start = f"concat({members(doc, path, 'cast(i as string)', repr(''))}, cast({single} as {front}))"
    inner = "$", "concat(f.child, '/', i)", "f.child"
    below = f"concat({members('f.o.child', *inner)}, {members('f.o.items', *inner)})"
    below = f"flatten(transform(filter(a.front, f -> f.o.child IS NOT NULL OR f.o.items IS NOT NULL), f -> {below}))"
    step = f"named_struct('out', concat(a.out, transform(a.front, f -> named_struct('child', f.child, 'parent', f.parent))), 'front', {below})"
    return _fold(start, "struct<child:string,parent:string>", step)


def raw_links(doc: str, path: str = "$[0].data") -> str:
    """SQL: the nodes of ``*.raw`` at ``path`` of a VARIANT as array of (child, parent); a node is an array whose second member is [id, UUID].

    A step takes three levels at once, since every look into a VARIANT copies what it returns: the
    frontier has arrays whose own node is settled; their members (c), the members of those (g) and
    the next (x) are settled in nested transforms, and x makes the next frontier.
    """
    front = "array<struct<parent:string,v:variant>>"

    def key(last: str, first: str, more: str) -> str:
        return f"if({last} RLIKE '{UUID}' AND {more} IS NULL, coalesce({first}, ''), NULL)"

    def key_at(v: str, path: str) -> str:
        return key(*(f"try_variant_get({v}, '{path}[{n}]', '{kind}')" for n, kind in ((1, "string"), (0, "string"), (2, "variant"))))

    def node(child: str, parent: str, more: str) -> str:
        return f"named_struct('child', {child}, 'parent', {parent}, {more})"

    raw = "e.value.raw"
    value = f"if(try_variant_get({raw}, '$[0]', 'string') IS NOT NULL, {raw}, {parsed(as_text(raw))})"
    records = f"transform(map_entries(try_variant_get({doc}, '{path}', 'map<string,struct<`raw` variant>>')), e -> named_struct('key', e.key, 'v', {value}))"
    start = f"coalesce(transform({records}, e -> named_struct('parent', e.key, 'v', e.v)), cast(array() as {front}))"
    arrays = "filter(transform(a.front, f -> named_struct('f', f, 'm', try_variant_get(f.v, '$', 'array<array<array<variant>>>'))), z -> z.m IS NOT NULL)"
    top = f"transform({arrays}, z -> {node(key_at('z.f.v', '$[1]'), 'z.f.parent', quoted('m', 'z.m'))})"
    in_c = key(as_text("get(get(c, 1), 1)"), as_text("get(get(c, 1), 0)"), "get(get(c, 1), 2)")
    c = f"transform(filter(t.m, c -> c IS NOT NULL), c -> {node(in_c, 'coalesce(t.child, t.parent)', quoted('m', 'c'))})"
    g = f"transform(filter(c.m, g -> g IS NOT NULL), g -> {node(key_at('get(g, 1)', '$'), 'coalesce(c.child, c.parent)', quoted('m', 'g'))})"
    x = "transform(g.m, x -> named_struct('parent', coalesce(g.child, g.parent), 'v', x))"
    flat = "flatten(filter(transform({0}, {1} -> {2}), z -> size(z) > 0))"
    found = "transform(filter({0}, k -> k.child IS NOT NULL), k -> named_struct('child', k.child, 'parent', k.parent))"
    links = ", ".join(found.format(k) for k in ("ts", "cs", "gs"))
    step = f"named_struct('out', concat(a.out, {links}), 'front', {flat.format('gs', 'g', x)})"
    step = let(top, "ts", let(flat.format("ts", "t", c), "cs", let(flat.format("cs", "c", g), "gs", step)))
    return _fold(start, "struct<child:string,parent:string>", step)


def quoted(name: str, value: str) -> str:
    return f"'{name}', {value}"


def header_links(header: str) -> str:
    """SQL: the entries of a positional header (array of VARIANT) as array of (child UUID, UUID of the tabular section or '').

    In the newer layout the section's own entry lies beside its columns (record [heading, count,
    columns]), so entries carry the record they head (``own``) or belong to (``sec``), and the links
    are resolved once all entries of the text are known.
    """
    front = "array<struct<parent:string,sec:string,own:string,path:string,arr:array<variant>>>"
    start = f"cast(if({header} IS NULL, array(), array(named_struct('parent', '', 'sec', NULL, 'own', NULL, 'path', '', 'arr', {header}))) as {front})"
    last = "try_variant_get(get(f.arr, 1), '$[2]', 'string')"
    named = f"{as_text('get(f.arr, 2)')} RLIKE '(?s)^\".+\"$' AND try_variant_get(get(f.arr, 1), '$[3]', 'variant') IS NULL"
    uuid = f"if({last} RLIKE '{UUID}' AND {last} != '{NULL_UUID}' AND {named}, {last}, NULL)"
    first = "try_variant_get(f.arr[{0}], '$[0]', 'variant')"
    record = f"if(size(f.arr) = 3, {first.format(0)} IS NOT NULL AND {first.format(2)} IS NOT NULL AND {first.format(1)} IS NULL AND {as_text('f.arr[1]')} IS NOT NULL, false)"
    nodes = f"transform(a.front, f -> named_struct('uuid', {uuid}, 'rec', {record}, 'f', f))"
    found = "transform(filter(ns, k -> k.uuid IS NOT NULL), k -> named_struct('uuid', k.uuid, 'parent', k.f.parent, 'sec', k.f.sec, 'own', k.f.own))"
    child = (
        "named_struct('parent', coalesce(k.uuid, k.f.parent), "
        "'sec', if(k.uuid IS NOT NULL, NULL, if(k.rec AND m.i = 2, k.f.path, k.f.sec)), "
        "'own', if(k.uuid IS NOT NULL OR (k.rec AND m.i = 2), NULL, if(k.rec AND m.i = 0, k.f.path, k.f.own)), "
        "'path', concat(k.f.path, '/', m.i), 'arr', m.arr)"
    )
    members = f"filter(transform(k.f.arr, (x, i) -> named_struct('i', i, 'arr', {as_array('x')})), z -> z.arr IS NOT NULL)"
    below = f"flatten(transform(ns, k -> transform({members}, m -> {child})))"
    step = let(nodes, "ns", f"named_struct('out', concat(a.out, {found}), 'front', {below})")
    section = "if(o.sec IS NULL, NULL, get(filter(hs, q -> q.own = o.sec), 0).uuid)"
    links = let("filter(a.out, q -> q.own IS NOT NULL)", "hs", f"transform(a.out, o -> named_struct('child', o.uuid, 'parent', coalesce({section}, o.parent)))")
    return _fold(start, "struct<uuid:string,parent:string,sec:string,own:string>", step, links)


def _table(df: DataFrame, id_col: str, text_col: str, kind: str, links: str) -> DataFrame:
    """One target table: the rows of one link kind, from one ``inline``."""
    allow_duplicate_keys(df.sparkSession)
    return df.selectExpr(f"'{kind}' AS link_kind", f"`{id_col}` AS owner_id", f"inline({let(parsed_in_brackets(f'`{text_col}`'), 'doc', links)})")


def tree_table(elem_files: DataFrame, id_col: str = "elem_id", text_col: str = "elem") -> DataFrame:
    """The nodes of the trees; not yet distinct."""
    return _table(elem_files, id_col, text_col, "tree", tree_links("doc"))


def raw_table(elem_files: DataFrame, id_col: str = "elem_id", text_col: str = "elem") -> DataFrame:
    """The nodes of the raw lists; not yet distinct."""
    return _table(elem_files, id_col, text_col, "raw", raw_links("doc"))


def element_links(elem_files: DataFrame, id_col: str = "elem_id", text_col: str = "elem") -> DataFrame:
    """Both tables of the element files in one pass that parses each text once; not yet distinct."""
    allow_duplicate_keys(elem_files.sparkSession)
    tables = f"array(named_struct('link_kind', 'tree', 'links', {tree_links('doc')}), named_struct('link_kind', 'raw', 'links', {raw_links('doc')}))"
    return (
        elem_files.selectExpr(f"`{id_col}` AS owner_id", f"inline({let(parsed_in_brackets(f'`{text_col}`'), 'doc', tables)})")
        .selectExpr("link_kind", "owner_id", "inline(links)")
    )


def entry_links(owner_objects: DataFrame, id_col: str = "object_id", text_col: str = "header") -> DataFrame:
    """(link_kind, owner_id, child, parent) of the entries of positional headers; not yet distinct."""
    allow_duplicate_keys(owner_objects.sparkSession)
    links = let(parsed(f"`{text_col}`", kind="array<variant>"), "doc", header_links("doc"))
    return owner_objects.selectExpr("'header' AS link_kind", f"`{id_col}` AS owner_id", f"inline({links})")


def nested_links(elem_files: DataFrame, owner_objects: DataFrame) -> DataFrame:
    """All parent-child links of both sources, distinct: ``p1_found``."""
    return element_links(elem_files).unionByName(entry_links(owner_objects)).distinct()


def _depth(text: str | None) -> int | None:
    """How deep the brackets of a text nest, those in its strings aside."""
    deepest = depth = 0
    for bracket in re.findall(r"[\[\]{}]", re.sub(r'"(?:[^"\\]|\\.)*("|$)', "", text or "", flags=re.DOTALL)):
        depth += 1 if bracket in "[{" else -1
        deepest = max(deepest, depth)
    return deepest


def unread_texts(df: DataFrame, source: str, id_col: str, text_col: str) -> DataFrame:
    """(source, row_id, reason) of the texts that give no rows anywhere: ``no text`` (NULL or empty), ``not JSON``, or ``nested too deep``
    for the parser, which admits MAX_NESTING - 1 levels; repeated rows count once.
    """
    allow_duplicate_keys(df.sparkSession)
    rows = df.select(F.col(id_col).alias("row_id"), F.col(text_col).alias("text"))
    failed = rows.where(f"coalesce(text, '') = '' OR {parsed_in_brackets('text')} IS NULL")
    depth = arrow_function(_depth, "int")(F.col("text"))
    reason = F.when(F.coalesce("text", F.lit("")) == "", "no text").when(depth >= MAX_NESTING, "nested too deep").otherwise("not JSON")
    return failed.select(F.lit(source).alias("source"), "row_id", reason.alias("reason")).distinct()
