"""Coverage: how many data elements of a form are bound to data.

A NULL or empty element type counts as Unknown, which is no data type; an empty data path is no
binding; a form without data elements has coverage 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formquarry.functions import domain as D
from formquarry.operators.classify import binds_to_object, class_of_empty_tree, class_of_form, class_without_widgets


def is_data(element_type: Column) -> Column:
    return F.coalesce(element_type.isin(*D.DATA_ELEMENT_TYPES), F.lit(False))


def coverage(elements: DataFrame, key: list[str], name: str = "form_name") -> DataFrame:
    """(key, total_elements, data_elements, bound_data_elements, coverage_pct, form_class) per form, in one aggregation."""
    data = is_data(F.col("type"))
    bound = data & (F.coalesce(F.col("data_path"), F.lit("")) != "")
    sums = elements.groupBy(*key, name).agg(
        F.count("*").alias("total_elements"),
        F.count_if(data).alias("data_elements"),
        F.count_if(bound).alias("bound_data_elements"),
        F.bool_or(binds_to_object(F.col("type"), F.col("data_path"))).alias("__bound"),
    )
    pct = F.coalesce(F.try_divide(F.col("bound_data_elements"), F.col("data_elements")), F.lit(0.0)) * 100.0
    return sums.select(*key, name, "total_elements", "data_elements", "bound_data_elements", pct.alias("coverage_pct"), class_of_form(F.col(name), F.col("total_elements"), F.col("__bound")).alias("form_class"))


def coverage_of_forms(forms: DataFrame, elements: DataFrame, key: list[str], name: str = "form_name") -> DataFrame:
    """As ``coverage``, with a zero row for every form without elements.

    ``forms`` has unindexed_reason and has_data_widgets; they decide the class of such a form.
    """
    proven = F.col("unindexed_reason") == "no_tabular_no_widgets"
    empty = F.when(proven, class_without_widgets(F.col(name), F.col("unindexed_reason"), F.col("has_data_widgets"))).otherwise(class_of_empty_tree(F.col(name)).getField("form_class"))
    joined = forms.select(*key, name, empty.alias("__empty")).join(coverage(elements, key, name), [*key, name], "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return joined.select(*key, name, zero("total_elements"), zero("data_elements"), zero("bound_data_elements"), zero("coverage_pct"), F.coalesce("form_class", "__empty").alias("form_class"))


def coverage_line() -> Column:
    """A line of text for a coverage row."""
    return F.format_string("%.1f%% (%d/%d data, %d total, %s)", "coverage_pct", "bound_data_elements", "data_elements", "total_elements", "form_class")


def coverage_record() -> Column:
    """A coverage row as it goes into reports: the counts, the percentage to two digits, the class."""
    return F.struct("total_elements", "data_elements", "bound_data_elements", F.bround("coverage_pct", 2).alias("coverage_pct"), "form_class")


def reason_of_form(reasons: DataFrame, key: list[str], reason: str = "reason") -> DataFrame:
    """The one reason of a form's elements, ``mixed`` if there are several, NULL if there is none; order plays no part."""
    low, high = F.min(reason), F.max(reason)
    return reasons.groupBy(*key).agg(F.when(low == high, low).when(low.isNotNull(), "mixed").alias(reason))


def reason_counts(reasons: DataFrame, reason: str = "reason") -> DataFrame:
    """(reason, forms), most frequent first."""
    return reasons.groupBy(reason).agg(F.count("*").alias("forms")).orderBy(F.desc("forms"), reason)
