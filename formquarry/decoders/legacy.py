"""Elements of positional forms: widgets, columns of tabular fields, and why there are none."""

from __future__ import annotations

import re
from typing import Any

from formquarry.decoders.values import arrays, at, strict, uuids
from formquarry.functions.domain import LIST_PREFIX, OBJECT_PREFIX, PLATFORM_SOURCES, PLATFORM_UUIDS, TABULAR_FIELD, WIDGET_TYPES

# Fixed value: how modules add a column to a source.
_ADD_COLUMN = re.compile(r'(?i)(?:ЭтаФорма\.)?([А-Яа-яA-Za-z0-9_]+)\.(?:Колонки|Columns)\.(?:Добавить|Add)\s*\(\s*"([^"]+)"')
_REFERENCE_TAGS = ("0", '"#"')


def tabular_fields(form: Any) -> list[list]:
    """The tabular fields of a form; those inside another one belong to it."""
    found, stack = [], [form]
    while stack:
        node = stack.pop()
        if isinstance(node, list) and at(node, 0) == TABULAR_FIELD:
            found.append(node)
        elif isinstance(node, (list, dict)):
            stack.extend(reversed(node if isinstance(node, list) else list(node.values())))
    return found


def source_of(field: list) -> str:
    """The name of what a tabular field shows."""
    return (strict(at(field, 4, 1)) if at(field, 4, 0) == "14" else None) or LIST_PREFIX


def columns_of(field: list, names: dict[str, str]) -> list[str]:
    """Attribute names of a field's columns.

    Of the column blocks (tag 20) the one with most slots that have exactly one known attribute
    counts, the first of equals; without any, single references to known attributes do.
    """
    best: list[str] = []
    for block in arrays(field):
        if at(block, 0) == "20":
            known = [{u: names[u] for u in uuids(slot) if names.get(u)} for slot in block[6:]]
            slots = [next(iter(k.values())) for k in known if len(k) == 1]
            best = slots if len(slots) > len(best) else best
    if best:
        return best
    pairs = (p[1] for p in arrays(field) if len(p) == 2 and p[0] in _REFERENCE_TAGS and isinstance(p[1], str))
    return [names[u] for u in dict.fromkeys(pairs) if u in names]


def columns_in_module(module: str | None) -> list[tuple[str, str]]:
    """(source, column) of each column that a module's code adds, in order."""
    return _ADD_COLUMN.findall(module or "")


def list_columns(form: Any, names: dict[str, str], module: str | None) -> list[dict]:
    """Columns of the tabular fields of a form whose owner's attributes are known; the first of a name counts."""
    found: dict[str, dict] = {}
    for field in tabular_fields(form) if names else ():
        source = source_of(field)
        columns, origin = columns_of(field, names), "legacy_list_form_json"
        if not columns and source not in PLATFORM_SOURCES:
            columns, origin = [c for s, c in columns_in_module(module) if s.lower() == source.lower()], "legacy_list_form_bsl"
        for name in columns:
            found.setdefault(name, {"name": name, "type": "TabularFieldColumn", "data_path": f"{source}.{name}", "source": origin})
    return list(found.values())


def widgets(form: Any) -> list[dict]:
    """Data widgets of a form, taken as bound to the object's attribute of the same name."""
    found: dict[str, dict] = {}
    roots = list(form.values()) if isinstance(form, dict) else [form]
    for node in (a for root in roots for a in arrays(root)):
        kind = WIDGET_TYPES.get(node[0]) if node and isinstance(node[0], str) else None
        name = strict(at(node, 4, 1)) if kind and at(node, 4, 0) == "14" else None
        if name:
            found.setdefault(name, {"name": name, "type": kind, "data_path": f"{OBJECT_PREFIX}.{name}", "source": "legacy_form_json"})
    return list(found.values())


def unindexed_reason(form: Any, form_known: bool, common: bool, names: dict[str, str], module: str | None) -> tuple[str, str]:
    """(reason, detail) why a form has no elements; the first rule that fits decides."""
    if not form_known:
        return "no_legacy_json", ""
    fields = tabular_fields(form)
    if not fields:
        return "no_tabular_no_widgets", ""
    if common:
        return "no_owner_object", ""
    if not names:
        return "tabular_field_empty_attr_map", ""
    sources = [source_of(f) for f in fields]
    own = [(f, s) for f, s in zip(fields, sources) if s not in PLATFORM_SOURCES]
    if not own:
        return "tabular_field_platform_dynamic", ", ".join(sorted(set(sources)))
    if any(columns_of(f, names) for f, _ in own):
        return "unknown", "the columns are known"
    coded = {s.lower() for s, _ in columns_in_module(module)}
    if not coded:
        return "tabular_field_programmatic_no_defs", ", ".join(s for _, s in own)
    if not coded & {s.lower() for _, s in own}:
        return "tabular_field_bsl_source_mismatch", ", ".join(sorted(coded))
    foreign = sum(len({u for u in uuids(f) if u not in names and u not in PLATFORM_UUIDS}) for f, _ in own)
    return "tabular_field_no_uuid_hits", f"{foreign} unknown UUIDs"
