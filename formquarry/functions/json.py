"""JSON text to VARIANT, and safe steps inside a VARIANT."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Regular expression of a UUID, any case.
UUID = "^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"
NULL_UUID = "00000000-0000-0000-0000-000000000000"
#: Jackson refuses deeper nesting, so no parsed value has more levels. The brackets of
#: ``parsed_in_brackets`` are one of them: a text of more than 999 levels is a defined NULL, like a broken one.
MAX_NESTING = 1000


def allow_duplicate_keys(spark: SparkSession) -> None:
    """Of a key given twice in one object the last one counts, as in most JSON readers."""
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")


def parsed_in_brackets(text: str) -> str:
    """SQL: a VARIANT array whose only member ($[0]) is the value of a JSON text, NULL where it is not JSON.

    The parser stops after the first value, so the text is put in brackets: anything that
    follows the value then breaks the parse or makes a second member. A leading BOM is ignored.
    """
    bare = f"if(startswith({text}, '\ufeff'), substring({text}, 2), {text})"
    return let(f"try_parse_json(concat('[', {bare}, ']'))", "p_", "if(try_variant_get(p_, '$[1]', 'variant') IS NULL, p_, NULL)")


def parsed(text: str, path: str = "", kind: str = "variant") -> str:
    """SQL: the value at ``path`` of a JSON text as ``kind``, NULL where the text is not JSON or the path leads nowhere."""
    return f"try_variant_get({parsed_in_brackets(text)}, '$[0]{path}', '{kind}')"


def let(value: str, name: str, body: str) -> str:
    """SQL: ``body`` with ``value`` bound to ``name`` and computed once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def as_array(value: str) -> str:
    """SQL: the members of a VARIANT array, NULL for anything else."""
    return f"try_variant_get({value}, '$', 'array<variant>')"


def as_text(value: str) -> str:
    return f"try_variant_get({value}, '$', 'string')"


def is_uuid(column: Column | str) -> Column:
    """True for a 36-character UUID of any case; NULL gives false."""
    column = F.col(column) if isinstance(column, str) else column
    return F.coalesce(column.rlike(UUID), F.lit(False))
