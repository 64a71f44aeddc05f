import json

import pytest
from test_decoders import U, wrapped

from formquarry.operators import drift, reports, routing
from formquarry.sources import dump, indexes


def write(root, files):
    for path, content in files.items():
        target = root / path
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_bytes(content if isinstance(content, bytes) else content.encode())


ELEM = json.dumps({"tree": [{"name": "Вес", "type": "Field"}], "data": {"Вес": {"raw": [["0", U[2]]]}}})
OWNER = json.dumps({"header": [["m", ["i", U[0], U[1], U[3], 4, 5, 6, U[4], U[5]], wrapped(U[2], "Вес")]]})


@pytest.fixture
def root(tmp_path):
    base = "Catalog/Склад Главный"
    write(tmp_path, {
        f"{base}/CatalogForm/Форма/CatalogForm.obj.bsl": "Процедура ВесПриИзменении(Э)", f"{base}/CatalogForm/Форма/CatalogForm.json": "{}",
        f"{base}/CatalogForm/Форма/CatalogForm.elem.json": ELEM, f"{base}/CatalogForm/Пустая/readme.txt": "x",
        f"{base}/Catalog.json": OWNER, "CommonForm/Общая/CommonForm.obj.bsl": "", "Document/Д/DocumentForm/Ф/DocumentForm.elem.json": "{}",
        "Document/Д/Forms/Ф1/Ext/Form.bin": "1", "Document/Е/Forms/Ф1/Ext/Form.bin": "22",
    })
    return tmp_path


def test_config_inventory(spark, root):
    rows = {r.form_name: r for r in dump.scan_forms(spark, str(root)).collect()}
    assert set(rows) == {"Форма", "Общая", "Ф"}
    one, common, only = rows["Форма"], rows["Общая"], rows["Ф"]
    assert (one.object_type, one.object_name, one.container_name, one.warnings) == ("Catalog", "Склад Главный", "CatalogForm", []) and len(one.bsl_sha256) == 64 and one.elem_sha256
    assert (common.object_type, common.object_name, common.warnings, common.elem_json_path) == ("CommonForm", "", ["missing CommonForm.json"], None)
    assert only.bsl_sha256 is None and only.warnings == ["elem-only: no .obj.bsl found"] and only.elem_sha256 is None
    assert [r.warning for r in dump.scan_warnings(spark, str(root)).collect()] == ["skipped (no .obj.bsl): Catalog/Склад Главный/CatalogForm/Пустая", "skipped (no .obj.bsl): Document/Д/DocumentForm/Ф"]
    assert dump.scan_forms(spark, str(root), include_elem_only=False, structure=False).count() == 2


def test_missing_root(spark, tmp_path):
    assert dump.scan_forms(spark, str(tmp_path / "none"), structure=False).count() == 0


def test_parsed_forms_and_owner(spark, root):
    files = dump.list_files(spark, str(root))
    parsed = dump.parsed_forms(spark, str(root), files, dump.config_forms(files)).where("form_name = 'Форма'").first()
    element = parsed.parsed.elements[0]
    assert (element.data_path, element.handler) == ("Объект.Вес", "ВесПриИзменении")
    names = dump.attribute_map(dump.owner_objects(spark, str(root))).first()
    assert names.names == {U[2]: "Вес", U[4]: "Наименование", U[5]: "Код"}


def test_bins(spark, root):
    assert [tuple(r)[:2] for r in dump.form_bins(dump.list_files(spark, str(root))).collect()] == [("Ф1", "Document/Е/Forms/Ф1/Ext/Form.bin")]


@pytest.mark.parametrize("base", ["External/", ""])
def test_external(spark, tmp_path, base):
    write(tmp_path, {
        f"{base}Обр/ExternalDataProcessor.obj": "x", f"{base}Обр/Form/Ф/Form.obj": "x", f"{base}Обр/Form/Ф/Form.json": "{}", f"{base}Обр/Form/Ф/Form.elem": "e",
        f"{base}Отч/ReportForm/Ф/ReportForm.obj.bsl": "y", f"{base}Отч/ReportForm/Ф/Form.json": "{}", f"{base}Отч/Form/Г/Form.obj.bsl": "z", f"{base}Отч/Form/Г/Form.obj": "old",
        f"{base}Отч/ExternalReport.obj.bsl": "x", f"{base}Отч/Form/Нет/x.txt": "x", f"{base}Отч/Other/Ф/Other.obj.bsl": "x",
    })
    rows = {(r.object_name, r.form_name): r for r in dump.scan_forms(spark, str(tmp_path), "external").collect()}
    assert {k: r.object_type for k, r in rows.items()} == {("Обр", "Ф"): "ExternalDataProcessor", ("Отч", "Ф"): "ExternalReport", ("Отч", "Г"): "ExternalReport"}
    assert rows["Обр", "Ф"].form_elem_path.endswith("Form.elem") and rows["Отч", "Г"].bsl_path.endswith("Form.obj.bsl") and rows["Отч", "Ф"].json_path.endswith("Form.json")


def test_artifacts_of_elem_forms(spark, tmp_path):
    d = "Catalog/О/CatalogForm/Ф/"
    write(tmp_path, {d + n: "{}" for n in ("S.elem.json", "S.json", "S.id.json", "S.10.json", "S.obj.3.0.75.100.bsl", "S.mgr.bsl", "S2.elem.json")} | {"X/Ф/S.elem.json": "{}", "CatalogForm/Ф/S.elem.json": "{}", "CatalogForm/Ф/S.obj.bsl": "p", "CatalogForm/Ф/S.obj.1.bsl": "v"})
    rows = {r.form_path: r for r in dump.elem_forms(dump.list_files(spark, str(tmp_path))).collect()}
    assert set(rows) == {d[:-1], "CatalogForm/Ф"}
    one = rows[d[:-1]]
    assert one.meta_json_path == d + "S.json" and one.id_json_path == d + "S.id.json" and one.bsl_path == d + "S.obj.3.0.75.100.bsl"
    assert [(a.descent, a.aux_json_path, a.bsl_path) for a in one.descent_artifacts] == [("10", d + "S.10.json", None), ("3.0.75.100", None, d + "S.obj.3.0.75.100.bsl")]
    assert len(one.extra_warnings) == 2 and rows["CatalogForm/Ф"].bsl_path == "CatalogForm/Ф/S.obj.bsl"


def kinds(df):
    return {(r.form_key, r.kind) for r in df.collect()}


def test_drift_of_a_dump(spark, root, tmp_path_factory):
    saved = str(tmp_path_factory.mktemp("i") / "index")
    indexes.save_scan_index(dump.scan_forms(spark, str(root)), saved)
    base = indexes.load_scan_index(spark, saved).cache()
    assert base.count() == 3
    form = root / "Catalog/Склад Главный/CatalogForm/Форма"
    (form / "CatalogForm.obj.bsl").write_text("other")
    (form / "CatalogForm.elem.json").write_text(ELEM.replace("Вес", "Цена"))
    (root / "CommonForm/Общая/CommonForm.obj.bsl").unlink()
    write(root, {"CommonForm/Новая/CommonForm.obj.bsl": "n"})
    key = "Catalog/Склад Главный/CatalogForm/Форма"
    current = dump.scan_forms(spark, str(root))
    assert kinds(drift.drift(base, current)) == {(key, "modified"), (key, "structure_modified"), ("CommonForm//CommonForm/Общая", "removed"), ("CommonForm//CommonForm/Новая", "added")}
    assert kinds(drift.stale(base, dump.list_files(spark, str(root)))) == {("CommonForm//CommonForm/Общая", "stale_extractions")}
    report = drift.drift_report(drift.drift(base, current))
    path = str(tmp_path_factory.mktemp("r") / "report")
    indexes.save_drift_report(report, path)
    back = indexes.load_drift_report(spark, path).first()
    assert back.has_drift and back.added == ["CommonForm//CommonForm/Новая"] and back.stale_extractions == []
    empty = indexes.load_scan_index(spark, str(root / "no such index"))
    assert kinds(drift.drift(empty, current)) == {(key, "added"), ("CommonForm//CommonForm/Новая", "added")}


def test_old_indexes(spark, tmp_path):
    (tmp_path / "i.json").write_text(json.dumps({"forms": [{"object_type": "T", "form_name": "F", "form_xml_path": "x"}], "reference_types": {"u": "X"}}))
    row = indexes.load_scan_index(spark, str(tmp_path / "i.json")).first()
    assert row.warnings == [] and row.bsl_mtime == 0.0 and row.bsl_sha256 is None
    assert [tuple(r) for r in indexes.load_reference_types(spark, str(tmp_path / "i.json")).collect()] == [("u", "X")]


def test_freshness_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("f", "b", "r", 1.0, None, True, ["w"])], "form_name string, bin_path string, unpacked_root string, bin_mtime double, unpacked_mtime double, extraction_ok boolean, warnings array<string>")
    indexes.save_freshness(rows, str(tmp_path / "f"))
    assert indexes.load_freshness(spark, str(tmp_path / "f")).collect() == rows.collect()


def test_routing(spark):
    index = spark.createDataFrame([("T", "Obj", "F", 1), ("T", "F", "G", 2), ("TypeF", None, "G", 3)], "object_type string, object_name string, form_name string, confidence int").drop("confidence")
    pick = lambda q: sorted((r.object_type, r.form_name, r.confidence) for r in routing.route(index, q).collect())
    assert pick(" F ") == [("T", "F", 1.0)] and pick("f") == [("T", "G", 0.9)] and pick("typ") == [("TypeF", "G", 0.4)]
    assert pick("") == [] and pick(None) == [] and pick("zzz") == []


def test_upsert(spark):
    base = spark.createDataFrame([("a", 1, "x"), (None, 2, "y")], "k string, v int, old string")
    new = spark.createDataFrame([("a", 9, True), ("b", 3, None), (None, 7, None)], "k string, v int, extra boolean")
    assert sorted(map(str, map(tuple, routing.upsert(base, new, ["k"]).collect()))) == sorted(map(str, [("a", 9, None, True), ("b", 3, None, None), (None, 7, None, None)]))


def test_containers(spark):
    files = spark.createDataFrame([("Report/А/Template/Т/Template.bin", b"\xef\xbb\xbf<Q Name=\"N\">" + "ВЫБРАТЬ Поле ИЗ Т".encode()), ("x/y/z/w/T.bin", None), ("z", b"junk")], "path string, content binary")
    read = reports.containers(files)
    assert [tuple(r) for r in reports.report_queries(read, ["path"]).collect()] == [("Report/А/Template/Т/Template.bin", 0, "N", "ВЫБРАТЬ Поле ИЗ Т")]
    assert read.where("report.warning IS NOT NULL").count() == 2
    assert [r.root for r in files.select(reports.report_root(files.path).alias("root")).collect()] == ["Report/А", "x/y", ""]
