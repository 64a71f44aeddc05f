"""Classes of forms: object, service or unknown, with the reason where there is one.

Unknown is a result, never a guess; NULL and empty names are unknown.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formquarry.functions import domain as D

OBJECT, SERVICE, UNKNOWN = "object", "service", "unknown"
_NO_WIDGETS = "no_tabular_no_widgets"


def _begins(name: Column, prefixes: tuple[str, ...]) -> Column:
    low = F.lower(name)
    return F.coalesce(reduce(lambda a, b: a | b, [low.startswith(p) for p in prefixes]), F.lit(False))


def class_by_name(name: Column) -> Column:
    return F.when(_begins(name, D.SERVICE_NAME_PREFIXES), SERVICE).otherwise(UNKNOWN)


def class_of_empty_tree(name: Column) -> Column:
    """STRUCT<form_class, reason> for a form without markup; the first rule that fits decides."""
    none = F.coalesce(name, F.lit("")) == ""
    service = _begins(name, D.SERVICE_NAME_PREFIXES)
    reason = (
        F.when(none, "no_name")
        .when(service, "by_service_pattern")
        .when(F.lower(name).isin(*D.PLATFORM_FORM_NAMES), "platform_object_name_unparsed")
        .when(_begins(name, D.SERVICE_NAME_HINTS), "empty_tree_name_hint")
        .otherwise("unparsed_empty_tree")
    )
    return F.struct(F.when(~none & service, SERVICE).otherwise(UNKNOWN).alias("form_class"), reason.alias("reason"))


def class_without_widgets(name: Column, unindexed_reason: Column, has_data_widgets: Column) -> Column:
    """Service if the markup proves that there are no data widgets and the name agrees; contradictions are unknown."""
    proven = F.coalesce(unindexed_reason == _NO_WIDGETS, F.lit(False)) & ~F.coalesce(has_data_widgets, F.lit(False))
    named = class_of_empty_tree(name).getField("reason").isin("by_service_pattern", "empty_tree_name_hint")
    return F.when(proven & named, SERVICE).otherwise(UNKNOWN)


def binds_to_object(element_type: Column, data_path: Column) -> Column:
    """True for a data element bound to the form's object; never NULL."""
    return F.coalesce(element_type.isin(*D.DATA_ELEMENT_TYPES) & F.lower(data_path).startswith(D.OBJECT_BINDING_PREFIX), F.lit(False))


def class_of_form(name: Column, elements: Column, bound: Column) -> Column:
    """From the name, the number of elements and whether any data element is bound to the object; a service name wins."""
    return F.when(F.coalesce(elements, F.lit(0)) == 0, UNKNOWN).when(_begins(name, D.SERVICE_NAME_PREFIXES), SERVICE).when(bound, OBJECT).otherwise(SERVICE)


def classify_forms(elements: DataFrame, key: list[str], name: str = "form_name") -> DataFrame:
    """One row per form with elements: its class. ``elements`` has type and data_path."""
    grouped = elements.groupBy(*key, name).agg(F.count("*").alias("n"), F.bool_or(binds_to_object(F.col("type"), F.col("data_path"))).alias("bound"))
    return grouped.select(*key, name, class_of_form(F.col(name), F.col("n"), F.col("bound")).alias("form_class"))
