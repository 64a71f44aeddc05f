"""Elements of forms: parsed once per form in Arrow batches, then ordinary rows.

The parser is one Arrow function that returns typed structs. It is declared nondeterministic, so that no
filter on its result makes the forms be parsed twice in a plan; where the result is used more than
once, store it. A form that can't be read gives ``ok = false`` with a warning and a reason, never a
failed task; NULL and empty texts count as such forms.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formquarry.decoders import elements as decoder
from formquarry.decoders import legacy
from formquarry.decoders.values import load
from formquarry.session import arrow_function

_ELEMENT = "struct<name:string,type:string,parent:string,parent_path:string,path:string,page:string,source:string,handler:string,data_path:string,merged_sources:array<string>,ord:int>"
PARSED = f"struct<ok:boolean,elements:array<{_ELEMENT}>,warnings:array<string>,elem_sha256:string,zero_binding:array<struct<element:string,reason:string>>,reason:string,detail:string,has_data_widgets:boolean>"
_REASON = "struct<reason:string,detail:string>"


def _inputs(elem: Column, names: Column | None, form: Column | None, module: Column | None, common: Column | None) -> tuple[Column, ...]:
    text = F.lit(None).cast("string")
    none = F.lit(None).cast("map<string,string>")
    return (elem, none if names is None else names, text if form is None else form, text if module is None else module, F.lit(False) if common is None else F.coalesce(common, F.lit(False)))


def parse_forms(forms: DataFrame, elem: str, names: Column | None = None, form: Column | None = None, module: Column | None = None, common: Column | None = None) -> DataFrame:
    """``forms`` with a column ``parsed`` (PARSED).

    ``elem``: element file text. ``names``: map of the owner's attribute names by UUID. ``form``: text of the
    positional form. ``module``: code. ``common``: whether the form has no owner by design.
    """

    def parse(elem: str | None, names: list | None, form: str | None, module: str | None, common: bool) -> dict:
        return decoder.parse(elem, dict(names) if names else None, form, module, common)

    return forms.withColumn("parsed", arrow_function(parse, PARSED)(*_inputs(F.col(elem), names, form, module, common)))


def unindexed_reasons(forms: DataFrame, names: Column, form: Column, module: Column, common: Column) -> DataFrame:
    """``forms`` with ``unindexed`` (reason, detail): why the positional form alone gives no elements.

    Broken form texts are ``unknown``; a NULL text is a form without one.
    """

    def judge(elem: None, names: list | None, form: str | None, module: str | None, common: bool) -> dict:
        value, wrong = load(form) if form is not None else (None, None)
        found = ("unknown", wrong) if wrong else legacy.unindexed_reason(value, form is not None, common, dict(names or ()), module)
        return dict(zip(("reason", "detail"), found))

    return forms.withColumn("unindexed", arrow_function(judge, _REASON)(*_inputs(F.lit(None).cast("string"), names, form, module, common)))


def form_elements(parsed: DataFrame, key: list[str]) -> DataFrame:
    """One row per element, in the order ``ord`` of its form."""
    return parsed.select(*key, F.inline("parsed.elements"))


def form_warnings(parsed: DataFrame, key: list[str]) -> DataFrame:
    return parsed.select(*key, F.posexplode("parsed.warnings").alias("ord", "warning"))


def zero_bindings(parsed: DataFrame, key: list[str]) -> DataFrame:
    """(key, element, reason) of elements whose record gives no data path."""
    return parsed.select(*key, F.inline("parsed.zero_binding"))


def unindexed_forms(parsed: DataFrame, key: list[str]) -> DataFrame:
    """(key, reason, detail, has_data_widgets) of forms without elements."""
    return parsed.where("NOT parsed.ok").select(*key, "parsed.reason", "parsed.detail", "parsed.has_data_widgets")


def missing_parents(elements: DataFrame, key: list[str]) -> DataFrame:
    """(key, name, parent) of elements whose parent is not an element of their form."""
    known = elements.where("coalesce(name, '') != ''").select(*key, F.col("name").alias("parent")).distinct()
    return elements.where("coalesce(parent, '') != ''").select(*key, "name", "parent").join(known, [*key, "parent"], "left_anti").select(*key, "name", "parent")


def attach_handlers(elements: DataFrame, procedures: DataFrame, key: list[str], suffixes: tuple[str, ...]) -> DataFrame:
    """Elements with a handler where they had none: the first procedure (key, procedure) named element + suffix."""
    ranked = F.posexplode(F.array(*[F.concat("name", F.lit(s)) for s in suffixes])).alias("rank", "procedure")
    open_ones = elements.where("coalesce(handler, '') = '' AND coalesce(name, '') != ''").select(*key, "ord", "name").select(*key, "ord", ranked)
    found = open_ones.join(procedures.distinct(), [*key, "procedure"]).groupBy(*key, "ord").agg(F.min_by("procedure", "rank").alias("__handler"))
    joined = elements.join(found, [*key, "ord"], "left")
    return joined.withColumn("handler", F.coalesce(F.nullif("handler", F.lit("")), "__handler")).select(*elements.columns)


def procedures_of(modules: DataFrame, key: list[str], text: str) -> DataFrame:
    """(key, procedure) of procedures that a module declares; functions are none."""
    # Fixed value: how a module declares a procedure.
    pattern = r"(?imu)^\s*Процедура\s+([А-Яа-яA-Za-z0-9_]+)\s*\("
    return modules.select(*key, F.explode(F.regexp_extract_all(text, F.lit(pattern), F.lit(1))).alias("procedure")).distinct()


def columns_of_modules(modules: DataFrame, key: list[str], text: str) -> DataFrame:
    """(key, ord, source, column_name) of the columns that a module's code adds to tabular fields, in order."""
    # Fixed value: how modules add a column to a source.
    pattern = r'(?iu)(?:ЭтаФорма\.)?([А-Яа-яA-Za-z0-9_]+)\.(?:Колонки|Columns)\.(?:Добавить|Add)\s*\(\s*"([^"]+)"'
    found = [F.regexp_extract_all(text, F.lit(pattern), F.lit(i)) for i in (1, 2)]
    return modules.select(*key, F.posexplode(F.arrays_zip(found[0].alias("source"), found[1].alias("column_name"))).alias("ord", "c")).select(*key, "ord", "c.source", "c.column_name")
