"""Queries inside report containers."""

from __future__ import annotations

import re

# What begins a query and what names a data set.
_QUERY = re.compile(r'(ВЫБРАТЬ\b[^<"]{10,})', re.IGNORECASE | re.DOTALL)
_NAME = re.compile(r'(?:Name|Имя)\s*=\s*"([^"]+)"', re.IGNORECASE)
_BEFORE = 500
_BOM = b"\xef\xbb\xbf"


def container_text(content: bytes | None) -> tuple[str | None, str | None]:
    """(XML text, None) or (None, warning): what follows the BOM, else what begins with the XML declaration."""
    if content is None:
        return None, "no content"
    head, mark, tail = content.partition(_BOM)
    start = content.find(b"<?xml")
    if not mark and start < 0:
        return None, f"neither a BOM nor an XML declaration in {len(content)} bytes"
    try:
        return (tail if mark else content[start:]).decode("utf-8"), None
    except UnicodeDecodeError as wrong:
        return None, f"not UTF-8: {wrong}"


def datasets(text: str | None, nearest: bool = True) -> list[dict]:
    """Distinct queries with their data set's name: the nearest one before (or the first in reach), else a number."""
    found: dict[str, str] = {}
    for match in _QUERY.finditer(text or ""):
        query = re.sub(r"\s+", " ", match[1].strip())
        if query not in found:
            names = _NAME.findall(text[max(0, match.start() - _BEFORE) : match.start()])
            found[query] = (names[-1] if nearest else names[0]) if names else f"Dataset{len(found) + 1}"
    return [{"ord": i, "name": name, "query": query} for i, (query, name) in enumerate(found.items())]
