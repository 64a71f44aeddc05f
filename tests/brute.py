"""Plain-Python forms of the operators, written from their definitions, to test against."""

from __future__ import annotations

import json
import re

UUID = re.compile(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")


def load(text):
    if not isinstance(text, str):
        return None
    try:
        return json.loads(text[1:] if text[:1] == "﻿" else text)
    except ValueError:
        return None


def uuid(x) -> bool:
    return isinstance(x, str) and UUID.fullmatch(x) is not None


def tree_links(tree):
    def walk(array, path):
        for i, x in enumerate(array):
            if isinstance(x, dict):
                here = f"{path}/{i}" if path else str(i)
                yield here, path
                for key in ("child", "items"):
                    if isinstance(x.get(key), list):
                        yield from walk(x[key], here)

    yield from walk([tree] if isinstance(tree, dict) else tree if isinstance(tree, list) else [], "")


def raw_links(data):
    def walk(array, parent):
        if len(array) > 1 and isinstance(array[1], list) and len(array[1]) == 2 and uuid(array[1][1]):
            yield str(array[1][0]), parent
            parent = str(array[1][0])
        for x in array:
            if isinstance(x, list):
                yield from walk(x, parent)

    for key, record in data.items() if isinstance(data, dict) else ():
        if isinstance(record, dict):
            raw = record.get("raw")
            raw = load(raw) if isinstance(raw, str) else raw
            if isinstance(raw, list):
                yield from walk(raw, key)


def entry(x):
    if isinstance(x, list) and len(x) > 2 and isinstance(x[1], list) and len(x[1]) == 3 and uuid(x[1][2]) and set(x[1][2]) - set("0-"):
        name = x[2]
        if isinstance(name, str) and len(name) > 2 and name[0] == name[-1] == '"':
            return x[1][2]
    return None


def header_links(header):
    def first(x):
        if entry(x):
            return entry(x)
        for y in x if isinstance(x, list) else ():
            if f := first(y):
                return f
        return None

    def walk(x, parent):
        if not isinstance(x, list):
            return
        if e := entry(x):
            yield e, parent
            parent = e
        elif len(x) == 3 and isinstance(x[0], list) and isinstance(x[1], str) and isinstance(x[2], list):
            yield from walk(x[0], parent)
            yield from walk(x[2], first(x[0]) or parent)
            return
        for y in x:
            yield from walk(y, parent)

    yield from walk(header, "")


def links(elem_files, owner_objects):
    found = set()
    for row in elem_files.itertuples():
        doc = load(row.elem)
        if isinstance(doc, dict):
            found |= {("tree", row.elem_id, *x) for x in tree_links(doc.get("tree"))}
            found |= {("raw", row.elem_id, *x) for x in raw_links(doc.get("data"))}
    for row in owner_objects.itertuples():
        found |= {("header", row.object_id, *x) for x in header_links(load(row.header))}
    return found


def json_kind(v) -> str:
    return {bool: "boolean", str: "string", list: "array", dict: "object"}.get(type(v), "number")


def same(a, b) -> bool:
    return json.dumps(a, sort_keys=True) == json.dumps(b, sort_keys=True)


def field_changes(index_files):
    ids = ("object_type", "object_name", "container_name", "form_name")
    files: dict = {}
    for row in index_files.drop_duplicates(["feed_id", "file_no", "rec_no", "payload"]).itertuples():
        records = files.setdefault(row.feed_id, {}).setdefault(row.file_no, [])
        doc = load(row.payload)
        if isinstance(doc, dict):
            records.append((row.rec_no, doc))

    def kinds(records):
        counts: dict = {}
        for _, doc in records:
            for k, v in doc.items():
                if k not in ids and v is not None:
                    counts.setdefault(k, {}).setdefault(json_kind(v), []).append(1)
        return {k: min(c, key=lambda x: (-len(c[x]), x)) for k, c in counts.items()}

    def values(records, field):
        return {json.dumps([d.get(i) for i in ids]): d[field] for _, d in sorted(records, key=lambda r: r[0]) if d.get(field) is not None}

    found = set()
    for feed, by_no in files.items():
        numbers = sorted(by_no)
        for before, now in zip(numbers, numbers[1:]):
            old, new = kinds(by_no[before]), kinds(by_no[now])
            ends, begins = sorted(set(old) - set(new)), sorted(set(new) - set(old))
            found |= {(feed, now, f, "", "retyped") for f in set(old) & set(new) if old[f] != new[f]}
            pairs = []
            for e in ends:
                was = values(by_no[before], e)
                for b in begins:
                    now_values = values(by_no[now], b)
                    shared = set(was) & set(now_values)
                    equal = sum(same(was[k], now_values[k]) for k in shared)
                    if equal and 2 * equal >= len(shared):
                        pairs.append((-equal / len(shared), -equal, e, b))
            used: set = set()
            for *_, e, b in sorted(pairs):
                if ("old", e) not in used and ("new", b) not in used:
                    used |= {("old", e), ("new", b)}
                    found.add((feed, now, e, b, "renamed"))
            found |= {(feed, now, e, "", "removed") for e in ends if ("old", e) not in used}
            found |= {(feed, now, b, "", "added") for b in begins if ("new", b) not in used}
    return found
