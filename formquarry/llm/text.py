"""Normalisation of texts to words, in Arrow batches."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_WORD = re.compile(r"[^\W_]+")
_HIDDEN = re.compile("[" + "".join(re.escape(chr(c)) for c in range(0x110000) if unicodedata.category(chr(c)) == "Cf") + "]")

#: Most texts fit into one byte a letter; there a table does what the expressions above do: lower-case letters
#: and digits stay, format characters go, all else is a gap.
_NARROW = "cp1251"


def _table() -> tuple[bytes, bytes]:
    """(what each byte becomes, the bytes to drop)."""
    table, dropped = bytearray(b" " * 256), bytearray()
    for code in range(256):
        letter = bytes([code]).decode(_NARROW, "ignore").lower()
        if letter and _HIDDEN.fullmatch(letter):
            dropped.append(code)
        elif letter and _WORD.fullmatch(letter):
            (table[code],) = letter.encode(_NARROW)
    return bytes(table), bytes(dropped)


_TABLE, _DROPPED = _table()


def words(text: str) -> list[str]:
    """Maximal runs of letters and digits after NFKC, lower-casing and dropping format characters."""
    plain = unicodedata.normalize("NFKC", text)
    try:
        narrow = plain.encode(_NARROW)
    except UnicodeEncodeError:
        return _WORD.findall(_HIDDEN.sub("", plain.lower()))
    return narrow.translate(_TABLE, _DROPPED).decode(_NARROW).split()


def joined_words(column: str) -> Column:
    """The words of each text joined by single spaces; NULL stays NULL."""

    @F.pandas_udf("string")
    def join(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series([None if t is None else " ".join(words(t)) for t in batch], dtype=object)

    # Not deterministic in name only: a filter on the result must not make the texts be read twice.
    return join.asNondeterministic()(column)
