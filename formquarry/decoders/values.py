"""Safe access to positional JSON."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from typing import Any

_UUID = re.compile(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
NULL_UUID = "00000000-0000-0000-0000-000000000000"


def load(text: str | None) -> tuple[Any, str | None]:
    """(value, None) or (None, what is wrong with the text); a leading BOM is ignored."""
    if text is None:
        return None, "no text"
    try:
        return json.loads(text.removeprefix("﻿")), None
    except (ValueError, RecursionError) as wrong:
        return None, f"{type(wrong).__name__}: {wrong}"


def is_uuid(value: Any) -> bool:
    return isinstance(value, str) and _UUID.fullmatch(value) is not None


def is_named_uuid(value: Any) -> bool:
    """A UUID other than the all-zero one."""
    return is_uuid(value) and value != NULL_UUID


def strict(value: Any) -> str | None:
    """The inside of a literal in double quotes."""
    if isinstance(value, str) and len(value) > 2 and value[0] == value[-1] == '"':
        return value[1:-1].strip() or None
    return None


def lenient(value: Any) -> str | None:
    """The inside of a quoted literal, or the text as it is; at least two characters."""
    if not isinstance(value, str) or len(value) < 2:
        return None
    return (value[1:-1] if value[0] == value[-1] == '"' else value).strip() or None


def at(node: Any, *path: int) -> Any:
    """The member of nested arrays at a path, None where there is none."""
    for step in path:
        if not isinstance(node, list) or step >= len(node):
            return None
        node = node[step]
    return node


def arrays(node: Any, into_objects: bool = False) -> Iterator[list]:
    """All arrays in preorder, without recursion; objects are entered only if asked for."""
    stack = [node]
    while stack:
        node = stack.pop()
        if isinstance(node, list):
            yield node
            stack.extend(reversed(node))
        elif into_objects and isinstance(node, dict):
            stack.extend(reversed(node.values()))


def uuids(node: Any) -> list[str]:
    """All UUIDs but the all-zero one among the texts below a node, in preorder."""
    found, stack = [], [node]
    while stack:
        node = stack.pop()
        if isinstance(node, str):
            if is_named_uuid(node):
                found.append(node)
        elif isinstance(node, (list, dict)):
            stack.extend(reversed(node if isinstance(node, list) else list(node.values())))
    return found


def number(value: Any) -> int | None:
    """A text of digits as a number."""
    return int(value) if isinstance(value, str) and value.isdigit() else None
