"""Elements of a form from its element file, with their bindings to data.

Never raises and never guesses: what can't be decided has no data path and, where it helps, a warning.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from typing import Any

from formquarry.decoders import chain, legacy
from formquarry.decoders.values import load, strict, at, uuids
from formquarry.functions import domain as D

FIELDS = ("name", "type", "parent", "parent_path", "path", "page", "source", "handler", "data_path")
#: What the structure hash looks at: all of them.
STRUCTURAL = frozenset(FIELDS)
EMPTY_MAP = "owner attribute map is empty"
# Fixed value: how a module declares a procedure.
_PROCEDURE = re.compile(r"(?im)^\s*Процедура\s+([А-Яа-яA-Za-z0-9_]+)\s*\(")


def first_of(node: dict, keys: tuple[str, ...]) -> Any:
    """The value of the first key that is there and neither NULL nor empty text."""
    return next((node[k] for k in keys if node.get(k) not in ("", None)), None)


def named_nodes(value: Any, source: str, parent: str | None = None) -> Iterator[tuple[dict, str | None, str]]:
    """(node, name of the nearest named ancestor, source) of objects that have a name or a type, in preorder."""
    stack = [(value, parent)]
    while stack:
        node, above = stack.pop()
        if isinstance(node, list):
            stack.extend((x, above) for x in reversed(node))
        elif isinstance(node, dict):
            name = first_of(node, D.NAME_KEYS)
            if name or first_of(node, D.TYPE_KEYS):
                yield node, above, source
            below = str(name) if name else above
            stack.extend((x, below) for x in reversed(node.values()) if isinstance(x, (dict, list)))


def _row(name: str, kind: Any, source: str, **more: Any) -> dict:
    return {"name": name, "type": str(kind or "Unknown"), "parent": None, "parent_path": None, "path": None, "page": None, "source": source} | more


def _explicit(node: dict) -> dict:
    """The handler and the data path that a node states itself."""
    found = {"handler": first_of(node, D.HANDLER_KEYS), "data_path": first_of(node, D.DATA_PATH_KEYS)}
    return {k: str(v) for k, v in found.items() if v}


def inline_path(raw: Any) -> str | None:
    """A data path written out in a record: the text itself, a known key, or the first text with a dot in two levels."""
    if isinstance(raw, str):
        return raw.strip() or None
    if isinstance(raw, dict):
        return next((raw[k].strip() for k in D.RAW_DATA_PATH_KEYS if isinstance(raw.get(k), str) and raw[k].strip()), None)
    flat = (y for x in raw for y in (x if isinstance(x, list) else [x])) if isinstance(raw, list) else ()
    return next((t.strip() for t in flat if isinstance(t, str) and "." in t and t.strip()), None)


def managed_path(raw: Any, names: dict[str, str], element: str | None = None) -> tuple[str | None, list[str]]:
    """The data path of a managed form's record: inline, or by the one owner attribute it mentions."""
    if raw is None:
        return None, []
    if found := inline_path(raw):
        return found, []
    if not isinstance(raw, list):
        return None, [f"no data path in a record of type {type(raw).__name__}"] if not isinstance(raw, str) else []
    candidates = sorted({names[u] for u in uuids(raw) if u in names})
    if len(candidates) > 1 and element in candidates:
        candidates = [element]
    if len(candidates) > 1:
        return None, [f"ambiguous binding of {element!r}: {candidates!r}"]
    return (f"{D.OBJECT_PREFIX}.{candidates[0]}" if candidates else None), []


def ordinary_path(record: dict) -> tuple[str | None, list[str]]:
    """The data path of an ordinary form's record: its property, and the attribute in the tag-14 literal if that differs."""
    prop = record.get("prop")
    prop = prop.strip() if isinstance(prop, str) else ""
    if not prop:
        return None, []
    raw = record.get("raw")
    attribute = strict(at(raw, 4, 1)) if at(raw, 4, 0) == "14" else None
    if attribute is None:
        return prop, [f"no attribute name in the record of property {prop!r}"]
    return (prop if attribute == prop else f"{prop}.{attribute}"), []


def structural_path(path: str, name: str, form_attributes: set[str]) -> str | None:
    """The data path that follows from the element's place: a form attribute's own name, or its owner's and the rest."""
    if name in form_attributes:
        return name
    parts = [p for p in path.split("/") if p]
    if len(parts) < 2 or parts[-2] not in form_attributes:
        return None
    column = name.removeprefix(parts[-2])
    return f"{parts[-2]}.{column}" if column else None


def _last(path: str) -> str:
    return path.rstrip("/").rsplit("/", 1)[-1]


def _is_pages(key: str) -> bool:
    return key == D.PAGES_KEY or key.endswith("/" + D.PAGES_KEY)


def _from_data(doc: dict, names: dict[str, str], common: bool, warnings: list[str]) -> list[dict]:
    data = doc["data"]
    meta = {str(n): (node, _explicit(node)) for node, _, _ in named_nodes(doc.get("tree", []), "tree") if (n := first_of(node, D.NAME_KEYS))}
    props = [_row(str(n), first_of(node, D.TYPE_KEYS), "props") for node, _, _ in named_nodes(doc.get("props") if isinstance(doc.get("props"), list) else [], "props") if (n := first_of(node, D.NAME_KEYS))]
    form_attributes = {p["name"] for p in props}
    ordinary = any(isinstance(v, dict) and "prop" in v for v in data.values())
    if not ordinary and not names and not common:
        warnings.append(EMPTY_MAP)
    records = {k: v for k, v in data.items() if not _is_pages(k) and isinstance(v, dict) and ("id" in v or "raw" in v)}
    by_name = {_last(k): v for k, v in records.items() if "raw" in v}

    def placed(path: str, kind: Any) -> dict:
        name = _last(path) if kind != "Page" else path.rsplit("/", 1)[-1]
        above = path.rstrip("/").split("/")[:-1]
        row = _row(name, kind, "data", path=path, parent=above[-1] if above else None, page=above[-1] if above else None, parent_path="/".join(above) or None)
        row |= meta.get(name, (None, {}))[1]
        if "data_path" not in row and name in by_name:
            found, said = ordinary_path(by_name[name]) if ordinary else managed_path(by_name[name].get("raw"), names, name)
            warnings.extend(said)
            if found is None and not ordinary:
                found = structural_path(path, name, form_attributes)
            if found is not None:
                row["data_path"] = found
        return row

    rows: dict[str, dict] = {}
    for key, pages in data.items():
        if _is_pages(key) and isinstance(pages, list):
            owner = key[: -len(D.PAGES_KEY)]
            for page in pages:
                if isinstance(page, str):
                    rows.setdefault(owner + page, placed(owner + page, "Page") if owner + page not in rows else {})
    for key in records:
        if key not in rows:
            rows[key] = placed(key, first_of(meta[_last(key)][0], D.TYPE_KEYS) if _last(key) in meta else None)
    return [*rows.values(), *props]


def _from_sections(doc: Any) -> list[dict]:
    sections = [s for s in ("tree", "props", "commands", "params") if isinstance(doc, dict) and s in doc]
    nodes = [n for s in sections for n in named_nodes(doc[s], s)] or list(named_nodes(doc, "unknown"))
    rows = []
    for node, above, source in nodes:
        name, kind = first_of(node, D.NAME_KEYS), first_of(node, D.TYPE_KEYS)
        parent = next((str(node[k]) for k in D.PARENT_KEYS if node.get(k)), above)
        rows.append(_row(str(name) if name is not None else "", kind, source, parent=parent, page=first_of(node, D.PAGE_KEYS)) | _explicit(node))
    return rows


def distinct_rows(rows: list[dict]) -> list[dict]:
    """The first row of each (name, type, path, parent_path, source)."""
    return list({tuple(str(r.get(k)) for k in ("name", "type", "path", "parent_path", "source")): r for r in reversed(rows)}.values())[::-1]


def merge_sources(rows: list[dict]) -> list[dict]:
    """One row per name: the better source wins and takes from the other what it lacks; different paths stay apart."""
    best: dict[str, dict] = {}
    apart: list[dict] = []
    rank = {s: i for i, s in enumerate(D.SOURCE_ORDER)}
    for row in rows:
        name, source = row["name"], row["source"]
        if not name or (source != "data" and row.get("path")):
            apart.append(row)
        elif name not in best:
            best[name] = row
        elif row.get("path") and best[name].get("path") and row["path"] != best[name]["path"]:
            apart.append(row)
        else:
            old = best[name]
            wins = rank.get(source, 99) < rank.get(old["source"], 99)
            winner, loser = (row, old) if wins else (old, row)
            merged = list(dict.fromkeys([*winner.get("merged_sources", []), old["source"], source]))
            taken = {k: v for k, v in loser.items() if winner.get(k) in (None, "", "Unknown") and v not in (None, "")}
            best[name] = winner | taken | {"merged_sources": merged}
    return [*best.values(), *apart]


def structure_hash(rows: list[dict]) -> str | None:
    """SHA-256 of the structural keys of the rows in their order; NULL without rows."""
    if not rows:
        return None
    kept = [{k: v for k, v in r.items() if k in STRUCTURAL} for r in rows]
    return hashlib.sha256(json.dumps(kept, sort_keys=True, ensure_ascii=False).encode("utf-8", "surrogatepass")).hexdigest()


def _diagnose(rows: list[dict]) -> list[str]:
    known = {r["name"] for r in rows if r["name"]}
    said = [f"parent {r['parent']!r} of element {r['name']!r} is not in the index" for r in rows if r.get("parent") and r["parent"] not in known]
    groups = {r["name"] for r in rows if r["type"] == "Group"}
    if groups and not any(r.get("parent") in groups for r in rows):
        said.append("group nesting not restored")
    return said


def attach_handlers(rows: list[dict], module: str | None) -> None:
    """Give elements without handler the first procedure named after them."""
    procedures = set(_PROCEDURE.findall((module or "").removeprefix("﻿")))
    for row in rows:
        if not row.get("handler") and row["name"]:
            found = next((c for s in D.HANDLER_SUFFIXES if (c := row["name"] + s) in procedures), None)
            if found:
                row["handler"] = found


def parse(text: str | None, names: dict[str, str] | None = None, form_text: str | None = None, module: str | None = None, common: bool = False) -> dict:
    """{ok, elements, warnings, elem_sha256, zero_binding, reason, has_data_widgets} of one form.

    ``names``: attributes of the owner by UUID. ``form_text``: the positional form, for chains and
    as a fallback. ``zero_binding`` has (element, reason) of the records that stay without path.
    """
    names, warnings = names or {}, []
    doc, wrong = load(text)
    form, form_wrong = load(form_text) if form_text is not None else (None, None)
    rows: list[dict] = []
    zero: list[list[str]] = []
    if wrong:
        warnings.append(f"element file can't be read: {wrong}")
    else:
        if isinstance(doc, dict) and isinstance(doc.get("data"), dict):
            rows = merge_sources(distinct_rows(_from_data(doc, names, common, warnings)))
            if rows:
                _chains(doc, form, rows, zero)
        rows = rows or distinct_rows(_from_sections(doc))
        if not rows and form is not None:
            rows = [_row(r["name"], r["type"], r["source"], data_path=r["data_path"]) for r in legacy.list_columns(form, names, module) or legacy.widgets(form)]
            if rows:
                warnings.append(f"element file is empty, {len(rows)} elements are from the positional form")
        if form_wrong:
            warnings.append(f"positional form can't be read: {form_wrong}")
        if rows:
            warnings += _diagnose(rows)
            attach_handlers(rows, module)
        else:
            warnings.append("no elements found")
    reason = (None, None) if rows else ("unknown", form_wrong) if form_wrong else legacy.unindexed_reason(form, form_text is not None, common, names, module)
    return {
        "ok": bool(rows),
        "elements": [{k: r.get(k) if r.get(k) is None or k == "merged_sources" else str(r[k]) for k in (*FIELDS, "merged_sources")} | {"ord": i} for i, r in enumerate(rows)],
        "warnings": list(dict.fromkeys(warnings)),
        "elem_sha256": structure_hash(rows),
        "zero_binding": [{"element": e, "reason": r} for e, r in zero],
        "reason": reason[0],
        "detail": reason[1],
        "has_data_widgets": bool(legacy.tabular_fields(form)) if form is not None else None,
    }


def _chains(doc: dict, form: Any, rows: list[dict], zero: list[list[str]]) -> None:
    """Fill missing data paths from chains; note why the others have none."""
    declared = chain.definitions(form, doc.get("props"))
    records: dict[str, Any] = {}
    for key, value in doc["data"].items():
        if isinstance(value, dict) and isinstance(value.get("raw"), list):
            records.setdefault(_last(key), value["raw"])
    for row in rows:
        if not row.get("data_path") and row["name"] in records:
            path, reason = chain.follow(records[row["name"]], declared, row["name"])
            if path and declared.attributes:
                row["data_path"] = path
            elif reason:
                zero.append([row["name"], reason])
