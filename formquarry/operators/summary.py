"""Summaries and contexts of forms: what a reader, human or model, needs of a form in one text.

Empty optional values are left out; lists keep the order of the elements, repeated entries count
once; forms without elements have empty lists; without a module the text says so, and an empty
module stays empty.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formquarry.functions.text import cut_text
from formquarry.session import arrow_function

# Markers and placeholders of the rendered context.
SUMMARY_MARKER, ATTRIBUTES_MARKER, CODE_MARKER = "## SUMMARY", "## OBJECT_ATTRIBUTES", "## BSL"
NO_CODE, NO_OBJECT = "(модуль формы отсутствует)", "(реквизиты объекта не найдены)"
BUCKETS = ("elements", "attributes", "commands", "events", "relations")


def _given(column: Column) -> Column:
    return F.nullif(column, F.lit(""))


def summary_rows(elements: DataFrame, key: list[str]) -> DataFrame:
    """(key, bucket, ord, item JSON): the long form of the summary; the first of equal items counts."""
    name, kind = F.coalesce("name", F.lit("")), F.coalesce(_given(F.col("type")), F.lit("Unknown"))
    source = F.coalesce("source", F.lit(""))
    as_json = lambda **fields: F.to_json(F.struct(*[v.alias(k) for k, v in sorted(fields.items())]))
    rest = {c: _given(F.col(c)) for c in ("path", "parent", "parent_path", "page", "source")}
    handler, path = _given(F.col("handler")), _given(F.col("data_path"))
    item = lambda bucket, when, **fields: F.when(when, F.struct(F.lit(bucket).alias("bucket"), as_json(**fields).alias("item")))
    items = F.array(
        item("attributes", source == "props", name=name, type=kind),
        item("commands", source == "commands", name=name, type=kind, handler=handler),
        item("elements", ~source.isin("props", "commands"), name=name, kind=kind, **rest),
        item("relations", path.isNotNull(), element=name, target=path, kind=F.lit("data")),
        item("events", handler.isNotNull(), name=handler, element=name),
        item("relations", handler.isNotNull(), element=name, target=handler, kind=F.lit("event")),
    )
    rows = elements.select(*key, "ord", F.posexplode(F.array_compact(items)).alias("part", "x")).select(*key, "x.bucket", F.struct("ord", "part").alias("at"), "x.item")
    return rows.groupBy(*key, "bucket", "item").agg(F.min("at").alias("at")).select(*key, "bucket", (F.col("at.ord") * 8 + F.col("at.part")).alias("ord"), "item")


def summaries(rows: DataFrame, key: list[str]) -> DataFrame:
    """(key, elements, attributes, commands, events, relations): arrays of JSON items, one row per form."""
    lists = [F.transform(F.array_sort(F.collect_list(F.when(F.col("bucket") == b, F.struct("ord", "item")))), lambda x: x["item"]).alias(b) for b in BUCKETS]
    return rows.groupBy(*key).agg(*lists)


def summary_json(warnings: Column) -> Column:
    """The summary as one JSON text with sorted keys."""
    array = lambda b: F.concat(F.lit(f'"{b}":['), F.array_join(F.col(b), ","), F.lit("]"))
    parts = [array(b) for b in ("attributes", "commands", "elements", "events", "relations")]
    said = F.concat(F.lit('"warnings":'), F.coalesce(F.to_json(warnings), F.lit("[]")))
    return F.concat(F.lit("{"), F.concat_ws(",", *parts, said), F.lit("}"))


def normalized_json(summary: Column) -> Column:
    """A summary's JSON text in its normal form: sorted keys, an indent of two blanks, letters as they are."""

    def normal(text: str | None) -> str | None:
        return None if text is None else json.dumps(json.loads(text), ensure_ascii=False, sort_keys=True, indent=2)

    return arrow_function(normal, "string")(summary)


def context_text(summary: Column, attributes: Column, module: Column, limit: int = -1) -> Column:
    """The rendered context: title, summary, attributes, code; cut to ``limit`` code points (-1: whole)."""
    ids = [_given(F.col(c)) for c in ("object_type", "object_name", "container_name", "form_name")]
    title = F.concat(F.lit("# FORM "), F.concat_ws("/", *ids))
    lines = (title, F.lit(SUMMARY_MARKER), summary, F.lit(ATTRIBUTES_MARKER), F.coalesce(attributes, F.lit(NO_OBJECT)), F.lit(CODE_MARKER), F.coalesce(module, F.lit(NO_CODE)))
    return cut_text(F.concat_ws("\n", *lines), limit)


def form_contexts(forms: DataFrame, summaries: DataFrame, attributes: DataFrame, bindings: DataFrame, key: list[str], owner: list[str], limit: int = -1) -> DataFrame:
    """(key, four ids, metadata, context): one row per form.

    ``forms`` has the ids, module, warnings and the six metadata columns; ``attributes`` those of the
    owners; ``bindings`` the resolved data relations of the forms. Each side is grouped to one row
    per key before it is joined.
    """
    listed = F.to_json(F.struct(F.transform(F.array_sort(F.collect_list(F.struct("section_ord", "attr_ord", F.struct("name", "synonym", "type", "uuid", "section_name").alias("item")))), lambda x: x["item"]).alias("Properties")))
    owned = attributes.groupBy(*owner).agg(listed.alias("__attributes"))
    related = bindings.groupBy(*key).agg(F.to_json(F.array_sort(F.collect_list(F.struct("data_path", "attribute_name", "value_type", "synonym", "resolved")))).alias("__relations"))
    joined = forms.join(summaries, key, "left").join(owned, owner, "left").join(related, key, "left")
    filled = joined.withColumns({b: F.coalesce(b, F.array().cast("array<string>")) for b in BUCKETS})
    objects = F.when(F.col("__attributes").isNotNull(), F.concat(F.lit('{"Object":'), F.col("__attributes"), F.lit(',"ResolvedRelations":'), F.coalesce("__relations", F.lit("[]")), F.lit("}")))
    metadata = F.struct("form_path", "elem_json_path", "bsl_sha256", "elem_sha256", "bsl_mtime", "warnings")
    ids = [c for c in ("object_type", "object_name", "container_name", "form_name") if c not in key]
    return filled.select(*key, *ids, metadata.alias("metadata"), context_text(summary_json(F.col("warnings")), objects, F.col("module"), limit).alias("context"))
