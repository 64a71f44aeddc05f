import json

import pytest
from pyspark.sql import functions as F

from formquarry.functions.json import is_uuid
from formquarry.functions.keys import composite_key
from formquarry.functions.text import cut_text, descent, ids_of_path, safe_path_ref, safe_text, unquote_lenient, unquote_strict
from formquarry.operators import bindings, classify, coverage, dedup, elements, freshness, objects, summary
from formquarry.plans import inventory


def one(spark, column, **values):
    fields = ", ".join(f"{k} {'boolean' if isinstance(v, bool) else 'string'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], fields).select(column.alias("x")).first().x


@pytest.mark.parametrize(("path", "ref"), [("/a/b/c/d/e", ".../b/c/d/e"), ("/a/b", ".../b"), ("C:\\x\\y", ".../y"), ("a/b", "a/b"), ("a/b/c/d/e/f", ".../c/d/e/f"), ("./../a", "a"), ("", "<путь не указан>"), (None, "<путь не указан>"), ('"/a/b"', ".../b"), ("/", "<путь не указан>")])
def test_path_refs(spark, path, ref):
    assert one(spark, safe_path_ref(F.col("p")), p=path) == ref


def test_messages(spark):
    assert one(spark, safe_text(F.col("m"), F.col("p")), m="bad C:\\\\a\\\\b and C:/a/b and C:\\a\\b", p="C:\\a\\b") == "bad .../b and .../b and .../b"


def test_quotes(spark):
    for text, strict, lenient in (('"a"', "a", "a"), ('""', None, None), ("ab ", None, "ab"), ("x", None, None), (None, None, None), ('"x', None, '"x')):
        assert (one(spark, unquote_strict(F.col("t")), t=text), one(spark, unquote_lenient(F.col("t")), t=text)) == (strict, lenient)


def test_small_functions(spark):
    assert one(spark, composite_key("a", "b", "c", "d"), a=None, b="", c="C", d=None) == "//C/"
    assert one(spark, cut_text(F.col("t"), 2), t="😀аb") == "😀а" and one(spark, cut_text(F.col("t"), -5), t="x") == "" and one(spark, cut_text(F.col("t"), -1), t="x") == "x"
    assert one(spark, descent(F.col("n"), "bsl"), n="S.obj.3.0.1.bsl") == "3.0.1" and one(spark, descent(F.col("n"), "json"), n="S.3.10.json") == "3.10" and one(spark, descent(F.col("n"), "json"), n="S.json") is None
    assert one(spark, is_uuid("u"), u=None) is False and one(spark, is_uuid("u"), u="A" * 8 + "-aaaa-aaaa-aaaa-" + "0" * 12) is True
    assert tuple(one(spark, ids_of_path(F.col("p")), p="T/O/C/F")) == ("T", "O", "C", "F") and tuple(one(spark, ids_of_path(F.col("p")), p="C/F")) == ("", "", "C", "F") and tuple(one(spark, ids_of_path(F.col("p")), p="")) == ("", "", "", "")
    assert tuple(one(spark, ids_of_path(F.col("p"), True), p="x/Отч.ERF/Form/F")) == ("ExternalReport", "Отч.ERF", "Form", "F")


def test_classes(spark):
    names = {None: "no_name", "": "no_name", "ПомощникЭДО": "by_service_pattern", "ФормаЭлемента": "platform_object_name_unparsed", "ФормаНастройки": "empty_tree_name_hint", "Прочее": "unparsed_empty_tree"}
    for name, reason in names.items():
        found = one(spark, classify.class_of_empty_tree(F.col("n")), n=name)
        assert found.reason == reason and found.form_class == ("service" if reason == "by_service_pattern" else "unknown")
    widgets = lambda flag, reason="no_tabular_no_widgets", name="ФормаНастройки": one(spark, classify.class_without_widgets(F.col("n"), F.lit(reason), F.lit(flag).cast("boolean")), n=name)
    assert widgets(False) == widgets(None) == "service" and widgets(True) == "unknown" and widgets(False, "unknown") == "unknown" and widgets(False, name="Прочее") == "unknown"


def test_coverage(spark):
    rows = [("f", "Ф", "Field", "Объект.А"), ("f", "Ф", "Table", ""), ("f", "Ф", None, "x"), ("f", "Ф", "Label", "y"), ("g", "ПомощникХ", "Field", "Объект.А"), (None, "Н", "", None)]
    elems = spark.createDataFrame(rows, "k string, form_name string, type string, data_path string")
    found = {r.k: tuple(r)[2:] for r in coverage.coverage(elems, ["k"]).collect()}
    assert found == {"f": (4, 2, 1, 50.0, "object"), "g": (1, 1, 1, 100.0, "service"), None: (1, 0, 0, 0.0, "service")}
    forms = spark.createDataFrame([("f", "Ф", None, None), ("e", "ФормаНастройки", "no_tabular_no_widgets", False), ("h", "ПомощникХ", "no_legacy_json", None)], "k string, form_name string, unindexed_reason string, has_data_widgets boolean")
    assert {r.k: (r.total_elements, r.form_class) for r in coverage.coverage_of_forms(forms, elems, ["k"]).collect()} == {"f": (4, "object"), "e": (0, "service"), "h": (0, "service")}


def test_reasons(spark):
    rows = spark.createDataFrame([("a", "x"), ("a", None), ("a", "x"), ("b", "x"), ("b", "y"), ("c", None)], "k string, reason string")
    by_form = coverage.reason_of_form(rows, ["k"])
    assert {r.k: r.reason for r in by_form.collect()} == {"a": "x", "b": "mixed", "c": None}
    assert coverage.reason_counts(rows).first().reason == "x"


def test_dedup(spark):
    rows = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("a", 1, "z"), (None, 5, None), (None, None, "q")], "k string, o int, v string")
    assert sorted((str(r.k), r.v) for r in dedup.keep_first(rows, ["k"], ["o"]).collect()) == [("None", "q"), ("a", "y")]
    assert sorted((str(r.k), r.v) for r in dedup.keep_last(rows, ["k"], ["o"]).collect()) == [("None", None), ("a", "x")]
    merged = spark.createDataFrame([("a", 1, "", "Unknown"), ("a", 2, "p", "T"), ("a", 0, None, None)], "k string, r int, path string, type string")
    assert tuple(dedup.priority_merge(merged, ["k"], "r", ["path", "type"], ("", "Unknown")).first()) == ("a", "p", "T", [0, 1, 2])


def test_bindings(spark):
    attributes = spark.createDataFrame([("o", None, " Вес", "Number", "W", 1, "u1"), ("o", "", "вес", "String", "later", 2, "u2"), ("o", "Т", "Цена", "Number", None, 3, "u1"), ("o", "Т", None, "x", None, 4, None)], "o string, section_name string, name string, type string, synonym string, attr_ord int, uuid string")
    paths = spark.createDataFrame([("o", p, "c") for p in ("Объект.ВЕС", "x.т.цена", "Вес", "a.b.c.d", None, "o.Нет")] + [("other", "o.Вес", "c")], "o string, data_path string, resolved string").drop("resolved")
    found = {(r.o, r.data_path): (r.attribute_name, r.value_type, r.synonym, r.resolved) for r in bindings.resolve_paths(paths, attributes, ["o"]).collect()}
    assert found["o", "Объект.ВЕС"] == ("ВЕС", "Number", "W", True) and found["o", "x.т.цена"] == ("цена", "Number", None, True)
    assert [k for k, v in found.items() if v[3]] and sum(v[3] for v in found.values()) == 2 and found["o", None][3] is False
    mentions = spark.createDataFrame([("o", 1, "e", "u1"), ("o", 2, "Цена", "u1"), ("o", 3, "e", "u2"), ("o", 4, "e", None)], "o string, k int, element_name string, uuid string")
    assert {r.k: (r.attribute_name, r.candidates) for r in bindings.unique_probe(mentions, attributes, ["o"], ["k"]).collect()} == {1: (None, 2), 2: ("Цена", 2), 3: ("вес", 1)}


def test_types_resolve(spark):
    types = spark.createDataFrame([("AA", "CatalogRef.X"), ("bb", ""), ("cc", None)], "uuid string, type_name string")
    attributes = spark.createDataFrame([(i, t) for i, t in enumerate(("Ref#aa", "Ref#bb", "Ref#cc", "Ref#", "String", None))], "i int, type string")
    assert [r.type for r in objects.resolve_types(attributes, types).orderBy("i").collect()] == ["CatalogRef.X", "Ref#bb", "Ref#cc", "Ref#", "String", None]


def test_reference_types_by_dump(spark, tmp_path):
    header = lambda n: json.dumps([[0, [0, *[f"{n}{i}000000-0000-4000-8000-000000000001" for i in (1, 2, 3)]]]])
    rows = [(1, "cfg-main", "Catalog", "B", header(1)), (2, "cfg-main", "Catalog", "A", header(1)), (3, "other", "Catalog", "B", header(1)), (4, None, "Document", "D", header(2)), (5, None, "Document", "E", header(2)), (6, "other", "CommonForm", "F", header(3)), (7, "other", "Catalog", "G", "broken")]
    spark.createDataFrame(rows, "object_id bigint, dump_id string, object_type string, object_name string, header string").write.parquet(f"{tmp_path}/owner_objects.parquet")
    found = inventory.reference_index(spark, str(tmp_path))
    assert sorted((str(r.dump_id), r.uuid[:2], r.type_name) for r in found.collect()) == [(d, f"{n}{i}", t) for d, n, t in (("None", 2, "DocumentRef.D"), ("cfg-main", 1, "CatalogRef.A"), ("other", 1, "CatalogRef.B")) for i in (1, 2, 3)]
    conflicts = objects.reference_conflicts(inventory._decoded(spark, str(tmp_path)), ["object_type", "object_name", "object_id"], ["dump_id"])
    assert {(str(r.dump_id), r.uuid[:1], r.kept, r.skipped) for r in conflicts.collect()} == {("cfg-main", "1", "CatalogRef.A", "CatalogRef.B"), ("None", "2", "DocumentRef.D", "DocumentRef.E")}


def test_drift_of_every_step(spark, tmp_path):
    forms = {1: {"A": "x"}, 2: {"A": "y", "M": "m"}, 4: {"A": "x"}}  # M lives in the middle only, A is changed and reverted
    rows = [(d, n, "T", "O", "", f, f"/{f}{n if f == 'A' else ''}", h, None, None, 0) for d in ("d", "e") for n, s in forms.items() for f, h in s.items()]
    columns = "dump_id string, snapshot_no int, object_type string, object_name string, container_name string, form_name string, bsl_path string, bsl_sha256 string, elem_sha256 string, bsl_mtime double, loaded_at int"
    spark.createDataFrame(rows, columns).write.parquet(f"{tmp_path}/form_scans.parquet")
    q = inventory.QUERIES
    steps = {(2, "T/O//A", "modified"), (2, "T/O//M", "added"), (4, "T/O//A", "modified"), (4, "T/O//M", "removed")}
    assert {tuple(r) for r in q["drift_steps"](spark, str(tmp_path)).collect()} == {(d, *s) for d in "de" for s in steps}
    assert {tuple(r)[:5] for r in q["drift_step_lists"](spark, str(tmp_path)).collect()} == {(d, n, True, *lists) for d in "de" for n, lists in ((2, ("T/O//M", "")), (4, ("", "T/O//M")))}
    assert {tuple(r)[1:3] for r in q["stale_steps"](spark, str(tmp_path)).collect()} == {(2, "T/O//A"), (4, "T/O//A"), (4, "T/O//M")}
    assert {tuple(r) for r in q["upsert_all"](spark, str(tmp_path)).collect()} == {(d, f"T/O//{f}", n) for d in "de" for f, n in (("A", 4), ("M", 2))}


def test_freshness(spark):
    rows = spark.createDataFrame([("a", 1, 2.0, 1.0, 1), ("a", 2, 1.0, 5.0, 2), ("b", 3, 2.0, None, 1), ("c", 4, None, None, 1), (None, 5, 9.0, 1.0, 1)], "form_name string, rec_id int, bin_mtime double, unpacked_mtime double, delivered_at int")
    assert [r.form_name for r in freshness.stale_forms(freshness.current_entries(rows)).collect()] == ["b"]
    bad = spark.createDataFrame([(False, [])], "extraction_ok boolean, warnings array<string>")
    with pytest.raises(Exception, match="needs a warning"):
        freshness.checked_artifacts(bad).collect()


ROWS = "k int, ord int, name string, type string, parent string, parent_path string, path string, page string, source string, handler string, data_path string"


def test_summary_and_context(spark):
    rows = spark.createDataFrame([(1, 0, "A", "Field", "P", "", None, None, "data", "АНажатие", "Объект.А"), (1, 1, "A", "Field", "P", "", None, None, "data", "АНажатие", "Объект.А"), (1, 2, "R", None, None, None, None, None, "props", None, "x"), (1, 3, "C", None, None, None, None, None, "commands", "h", None)], ROWS)
    long = summary.summary_rows(rows, ["k"])
    lists = summary.summaries(long, ["k"]).first()
    assert lists.elements == ['{"kind":"Field","name":"A","parent":"P","source":"data"}'] and lists.attributes == ['{"name":"R","type":"Unknown"}'] and lists.commands == ['{"handler":"h","name":"C","type":"Unknown"}']
    assert lists.events == ['{"element":"A","name":"АНажатие"}', '{"element":"C","name":"h"}'] and len(lists.relations) == 4
    forms = spark.createDataFrame([(1, "T", "O", "", "F", None, ["w"], "p", None, "h", "e", 0.0), (2, "T", "X", "C", "G", "", None, "p", None, "h", "e", 0.0)], "k int, object_type string, object_name string, container_name string, form_name string, module string, warnings array<string>, form_path string, elem_json_path string, bsl_sha256 string, elem_sha256 string, bsl_mtime double")
    attributes = spark.createDataFrame([("T", "O", 0, 1, "N", None, "String", "u", None)], "object_type string, object_name string, section_ord int, attr_ord int, name string, synonym string, type string, uuid string, section_name string")
    bound = spark.createDataFrame([(1, "o.N", "N", "String", None, True)], "k int, data_path string, attribute_name string, value_type string, synonym string, resolved boolean")
    texts = {r.k: r.context for r in summary.form_contexts(forms, summary.summaries(long, ["k"]), attributes, bound, ["k"], ["object_type", "object_name"]).collect()}
    assert texts[1].startswith("# FORM T/O/F\n## SUMMARY\n{") and '"warnings":["w"]' in texts[1] and '"resolved":true' in texts[1] and texts[1].endswith("## BSL\n" + summary.NO_CODE)
    assert summary.NO_OBJECT in texts[2] and texts[2].endswith("## BSL\n")


def test_element_rows(spark):
    rows = spark.createDataFrame([(1, 0, "A", "Нет", None), (1, 1, "B", "A", ""), (2, 0, "A", "B", "x")], "k int, ord int, name string, parent string, handler string")
    assert [tuple(r) for r in elements.missing_parents(rows, ["k"]).orderBy("k").collect()] == [(1, "A", "Нет"), (2, "A", "B")]
    modules = spark.createDataFrame([(1, "процедура AВыбор(Э)\nПроцедура  AНажатие (Э)\nФункция BНажатие()"), (2, None)], "k int, text string")
    found = elements.attach_handlers(rows, elements.procedures_of(modules, ["k"], "text"), ["k"], ("Нажатие", "Выбор"))
    assert {(r.k, r.name): r.handler for r in found.collect()} == {(1, "A"): "AНажатие", (1, "B"): None, (2, "A"): "x"}
