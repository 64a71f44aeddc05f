"""Plain-Python forms of the text operators."""

from __future__ import annotations

import re
import unicodedata


def words(text):
    plain = unicodedata.normalize("NFKC", text or "").lower()
    return re.findall(r"[^\W_]+", "".join(c for c in plain if unicodedata.category(c) != "Cf"))


def leaked(docs, items, least=12):
    """docs, items: dicts of id -> text."""
    runs: dict = {}
    for i, text in items.items():
        w = words(text)
        for k in range(len(w) - least + 1):
            runs.setdefault(tuple(w[k : k + least]), set()).add(i)
    found = set()
    for d, text in docs.items():
        w = words(text)
        for k in range(len(w) - least + 1):
            found |= {(d, i) for i in runs.get(tuple(w[k : k + least]), ())}
    return found


def spans(docs, length=100):
    where: dict = {}
    for d, text in docs.items():
        for k in range(len(text or "") - length + 1):
            where.setdefault(text[k : k + length], set()).add(d)
    found = set()
    for d, text in docs.items():
        begin = end = None
        for k in range(len(text or "") - length + 1):
            if where[text[k : k + length]] != {d}:
                if begin is not None and k <= end:
                    end = k + length
                else:
                    if begin is not None:
                        found.add((d, begin, end - begin))
                    begin, end = k, k + length
        if begin is not None:
            found.add((d, begin, end - begin))
    return found
