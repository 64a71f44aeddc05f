"""Scalar functions on names, paths and quoted literals, all JVM-side.

NULL in gives NULL out unless said otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What stands for a cut path and for a missing one.
TRUNCATION_MARKER = "..."
UNKNOWN_REF = "<путь не указан>"
SAFE_TAIL_SEGMENTS = 4


def unquote_strict(column: Column) -> Column:
    """The trimmed inside of a literal in double quotes; NULL if it is not quoted or empty."""
    inner = F.trim(F.regexp_extract(column, '(?s)^"(.+)"$', 1))
    return F.nullif(inner, F.lit(""))


def unquote_lenient(column: Column) -> Column:
    """As ``unquote_strict``, but text without quotes is only trimmed; NULL for fewer than two characters."""
    quoted = F.regexp_extract(column, '(?s)^"(.*)"$', 1)
    return F.when(F.length(column) >= 2, F.nullif(F.trim(F.when(column.rlike('(?s)^".*"$'), quoted).otherwise(column)), F.lit("")))


def path_segments(column: Column) -> Column:
    """Segments of a path of either separator, without empty ones, dots and drives."""
    return F.filter(F.split(column, r"[\\/]+"), lambda s: ~s.isin("", ".", "..") & ~s.rlike("^[A-Za-z]:$"))


def safe_path_ref(column: Column, tail: int = SAFE_TAIL_SEGMENTS) -> Column:
    """A reference to a path that doesn't tell where it lies: the last segments; a placeholder for NULL and empty ones.

    Relative paths of at most ``tail`` segments stay whole; of short absolute ones only the last segment is kept.
    """
    text = F.regexp_replace(F.trim(F.coalesce(column, F.lit(""))), '^"+|"+$', "")
    parts = path_segments(text)
    size = F.size(parts)
    if tail <= 0:
        return F.when(size == 0, UNKNOWN_REF).otherwise(F.element_at(parts, -1))
    last = F.concat(F.lit(TRUNCATION_MARKER + "/"), F.array_join(F.slice(parts, F.greatest(size - tail + 1, F.lit(1)), tail), "/"))
    name = F.concat(F.lit(TRUNCATION_MARKER + "/"), F.try_element_at(parts, F.lit(-1)))
    absolute = text.rlike(r"^([\\/]|[A-Za-z]:[\\/])")
    return F.when(size == 0, UNKNOWN_REF).when(size > tail, last).when(absolute, name).otherwise(F.array_join(parts, "/"))


def safe_text(column: Column, path: Column, tail: int = SAFE_TAIL_SEGMENTS) -> Column:
    """A message in which all spellings of ``path`` are replaced by its safe reference, the longest spelling first."""
    ref = safe_path_ref(path, tail)
    escaped = F.replace(F.replace(path, F.lit("/"), F.lit("\\")), F.lit("\\"), F.lit("\\\\"))
    out = column
    for spelling in (escaped, path, F.replace(path, F.lit("/"), F.lit("\\")), F.replace(path, F.lit("\\"), F.lit("/"))):
        out = F.when(F.coalesce(spelling, F.lit("")) == "", out).otherwise(F.replace(out, spelling, ref))
    return out


def without_root(column: Column, root: Column) -> Column:
    """A text without the root folder's prefix, whatever separator follows it."""
    return F.when(F.coalesce(root, F.lit("")) == "", column).otherwise(F.replace(F.replace(F.replace(column, F.concat(root, F.lit("/"))), F.concat(root, F.lit("\\"))), root))


def relative_to(column: Column, root: Column) -> Column:
    """A path below the root made relative; other absolute paths keep the name only; relative ones stay."""
    prefix = F.concat(F.rtrim(root, F.lit("/")), F.lit("/"))
    return F.when(column.startswith(prefix), F.substring(column, F.length(prefix) + 1, F.length(column))).when(column.startswith("/"), F.element_at(F.split(column, "/"), -1)).otherwise(column)


def cut_text(column: Column, limit: int) -> Column:
    """-1: all of it; 0 or less than -1: empty; else the first ``limit`` code points."""
    return column if limit == -1 else F.substring(column, 1, limit) if limit > 0 else F.when(column.isNotNull(), "")


def descent(name: Column, extension: str) -> Column:
    """The version suffix (1 to 4 numbers of 1 to 3 digits) before the extension: the longest one for ``json``, after the last ``.obj.`` for ``bsl``."""
    number = r"\d{1,3}(?:\.\d{1,3}){0,3}"
    pattern = rf"^.*\.obj\.({number})\.bsl$" if extension == "bsl" else rf"^[^.]*(?:\.[^.]*)*?\.({number})\.json$"
    return F.nullif(F.regexp_extract(name, pattern, 1), F.lit(""))


def ids_of_path(path: Column, external: bool = False) -> Column:
    """STRUCT<object_type, object_name, container_name, form_name> read off the end of a form folder's path.

    Four or more segments give all four; two or three leave type and object empty; one is the form.
    ``external``: of three or more segments in a form container the type follows from the container and
    the object's ``.erf`` ending.
    """
    parts = F.filter(F.split(path, "/"), lambda s: s != "")
    size = F.size(parts)
    at = lambda n: F.coalesce(F.try_element_at(parts, F.lit(n)), F.lit(""))
    report = (at(-2) == "ReportForm") | F.lower(at(-3)).endswith(".erf")
    outside = (size >= 3) & at(-2).isin("Form", "ReportForm") if external else F.lit(False)
    kind = F.when(outside, F.when(report, "ExternalReport").otherwise("ExternalDataProcessor")).when(size >= 4, at(-4)).otherwise("")
    return F.struct(kind.alias("object_type"), F.when(outside | (size >= 4), at(-3)).otherwise("").alias("object_name"), at(-2).alias("container_name"), at(-1).alias("form_name"))
