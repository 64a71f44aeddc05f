import json
import os

import pytest
from test_decoders import U, wrapped
from test_dump import ELEM, OWNER, write

import formquarry
from formquarry import workflows
from formquarry.functions.keys import artifact, is_common_form, owner_of_path
from formquarry.operators import coverage, summary
from formquarry.sources import dump, indexes

BASE = "Catalog/Склад"


@pytest.fixture
def root(tmp_path):
    write(tmp_path / "d", {
        f"{BASE}/CatalogForm/Форма/CatalogForm.obj.bsl": "Процедура ВесПриИзменении(Э)", f"{BASE}/CatalogForm/Форма/CatalogForm.json": "{}", f"{BASE}/CatalogForm/Форма/CatalogForm.elem.json": ELEM,
        f"{BASE}/CatalogForm/Пусто/CatalogForm.obj.bsl": "", f"{BASE}/Catalog.json": OWNER, "_hidden/x.txt": "x",
    })
    return tmp_path / "d"


def test_drift_check(spark, root, tmp_path):
    with pytest.raises(NotADirectoryError):
        workflows.check_drift(spark, str(root / "none"), "x")
    with pytest.raises(NotADirectoryError):
        workflows.check_drift(spark, str(root / BASE / "Catalog.json"), "x")
    keys = [f"{BASE}/CatalogForm/{n}" for n in ("Пусто", "Форма")]
    assert workflows.check_drift(spark, str(root), str(tmp_path / "no index")).first().added == keys
    (tmp_path / "bad.json").write_text("{")
    with pytest.warns(UserWarning):
        assert workflows.check_drift(spark, str(root), str(tmp_path / "bad.json")).first().added == keys
    saved, report = str(tmp_path / "index"), str(tmp_path / "report")
    indexes.export_scan_index(dump.scan_forms(spark, str(root)), saved)
    same = workflows.check_drift(spark, str(root), saved, report).first()
    assert not same.has_drift and not indexes.load_drift_report(spark, report).first().has_drift
    (root / BASE / "CatalogForm/Форма/CatalogForm.elem.json").write_text(ELEM.replace("Field", "Table"))
    (root / BASE / "CatalogForm/Пусто/CatalogForm.obj.bsl").unlink()
    found = workflows.check_drift(spark, str(root), saved).first()
    assert (found.structure_modified, found.removed, found.stale_extractions, found.modified) == ([keys[1]], [keys[0]], [keys[0]], [])


def test_contexts(spark, tmp_path):
    owner = json.dumps({"header": [["m", ["i", U[0], U[1], U[3], 4, 5, 6, U[4], U[5]], wrapped(U[2], "Вес", ['"#"', U[7]])]]})
    write(tmp_path, {f"{BASE}/CatalogForm/Форма/CatalogForm.obj.bsl": "Код", f"{BASE}/CatalogForm/Форма/CatalogForm.elem.json": ELEM, f"{BASE}/Catalog.json": owner, f"{BASE}/CatalogForm/Пусто/CatalogForm.obj.bsl": "", "Document/Д/DocumentForm/Ф/DocumentForm.elem.json": "{}"})
    types = spark.createDataFrame([(U[7], "CatalogRef.Единица")], "uuid string, type_name string")
    texts = {r.form_path.rsplit("/", 1)[1]: r for r in workflows.form_contexts(spark, str(tmp_path), types=types).collect()}
    full = texts["Форма"].context
    assert full.startswith("# FORM Catalog/Склад/CatalogForm/Форма\n") and full.endswith("## BSL\nКод") and '"type":"CatalogRef.Единица"' in full and '"resolved":true' in full
    assert texts["Пусто"].context.endswith("## BSL\n") and texts["Ф"].context.endswith(summary.NO_CODE) and summary.NO_OBJECT in texts["Ф"].context
    assert f"Ref#{U[7]}" in {r.form_path: r for r in workflows.form_contexts(spark, str(tmp_path), limit=100_000).collect()}[f"{BASE}/CatalogForm/Форма"].context
    assert texts["Форма"].metadata.elem_sha256 and str(tmp_path) not in str(list(texts.values()))


def test_report_batch(spark, tmp_path):
    query = "ВЫБРАТЬ Поле ИЗ Т"
    write(tmp_path / "r", {"Report/А/Template/Т/Template.bin": b"\xef\xbb\xbf<DataSet Name=\"N\">" + query.encode(), "Report/Б/Template/Т/Template.bin": b"junk"})
    rows = workflows.report_queries(spark, str(tmp_path / "r"), str(tmp_path / "q"))
    assert {(r.report_root, r.extracted, bool(r.warnings)) for r in rows.collect()} == {("Report/А", True, False), ("Report/Б", False, True)}
    batch = workflows.batch_extracted(rows).first()
    assert batch.skd_extracted and batch.containers == 2 and batch.warnings[0].startswith("Report/Б: ")
    assert [tuple(r) for r in indexes.load_report_queries(spark, str(tmp_path / "q")).collect()] == [("Report/А", "N", query)]
    (tmp_path / "e").mkdir()
    empty = workflows.batch_extracted(workflows.report_queries(spark, str(tmp_path / "e"))).first()
    assert not empty.skd_extracted and "Template.bin" in empty.warnings[0]


def test_unpacking(spark, tmp_path):
    write(tmp_path / "d", {f"Catalog/{n}/Forms/{n}/Ext/Form.bin": "1" for n in ("А", "Б", "В", "Г")})
    out = str(tmp_path / "out")

    def unpacker(path, folder, name):
        if name == "Б":
            raise ValueError("broken")
        os.makedirs(f"{folder}/{name}", exist_ok=True)
        with open(f"{folder}/{name}/Form.elem.json", "w") as file:
            file.write('{"tree":[{"name":"X","type":"Field"}]}' if name == "А" else "{}")
        return {"extraction_ok": True, "unpacked_mtime": 5.0}

    rows = {r.form_name: r for r in workflows.unpack_forms(spark, str(tmp_path / "d"), out, unpacker, ["А", "Б", "В", "нет"]).collect()}
    assert set(rows) == {"А", "Б", "В"} and rows["А"].elem_index_ok and not rows["В"].elem_index_ok and rows["В"].warnings == ["no elements found"]
    assert not rows["Б"].extraction_ok and rows["Б"].warnings == ["ValueError: broken"]
    artifacts = workflows.unpack_forms(spark, str(tmp_path / "d"), out, unpacker, ["А"])
    old = spark.createDataFrame([("А", "x", "y", 0.0, 0.0, False, ["w"]), ("Я", "x", "y", 0.0, 0.0, True, [])], "form_name string, bin_path string, unpacked_root string, bin_mtime double, unpacked_mtime double, extraction_ok boolean, warnings array<string>")
    index = {r.form_name: r for r in workflows.update_forms_index(spark, str(tmp_path / "d"), artifacts, old).collect()}
    assert set(index) == {"А", "Я"} and index["А"].bin_path.endswith("Form.bin") and index["А"].unpacked_mtime == 5.0 and index["А"].extraction_ok
    report = workflows.unpack_report(spark, "x.erf", out, lambda path, folder: {"extraction_ok": True}).first()
    assert report.extraction_ok and not report.skd_extracted


def test_listing_sees_every_file(spark, tmp_path):
    write(tmp_path, {"a/b/c/d/e.txt": "xy", "a/empty": "", "_x/.hidden": "1", "top": "1", "a/b/ы %20": "1"})
    assert {(r.path, r.dir, r.name, r.length) for r in dump.list_files(spark, str(tmp_path)).collect()} == {("a/b/c/d/e.txt", "a/b/c/d", "e.txt", 2), ("a/empty", "a", "empty", 0), ("_x/.hidden", "_x", ".hidden", 1), ("top", "", "top", 1), ("a/b/ы %20", "a/b", "ы %20", 1)}


def test_index_tables_and_documents(spark, root, tmp_path):
    forms = dump.scan_forms(spark, str(root))
    types = spark.createDataFrame([("u", "X")], "uuid string, type_name string")
    indexes.save_scan_index(forms, str(tmp_path / "t"), types)
    indexes.export_scan_index(forms, str(tmp_path / "x"), types)
    rows = [sorted(indexes.load_scan_index(spark, str(tmp_path / n)).collect(), key=str) for n in "tx"]
    assert rows[0] == rows[1] and len(rows[0]) == 2
    assert all([tuple(r) for r in indexes.load_reference_types(spark, str(tmp_path / n)).collect()] == [("u", "X")] for n in "tx")
    fresh = spark.createDataFrame([("f", "b", "r", 1.0, None, True, ["w"])], "form_name string, bin_path string, unpacked_root string, bin_mtime double, unpacked_mtime double, extraction_ok boolean, warnings array<string>")
    indexes.export_freshness(fresh, str(tmp_path / "f"))
    assert indexes.load_freshness(spark, str(tmp_path / "f")).collect() == fresh.collect()


def test_records_and_small_functions(spark):
    row = spark.createDataFrame([("b", 3, 2, 2, 66.666, "object", '{"b":[],"a":"Ы"}', "T/O/O.json", "x/CommonForm/F", "F", "r")], "k string, total_elements long, data_elements long, bound_data_elements long, coverage_pct double, form_class string, s string, p string, q string, name string, root string")
    got = row.select(coverage.coverage_record().alias("c"), summary.normalized_json(row.s).alias("n"), owner_of_path("p").alias("o"), is_common_form("q").alias("common"), is_common_form("p").alias("owned"), artifact("name", "root").alias("a")).first()
    assert got.c.coverage_pct == 66.67 and got.n == '{\n  "a": "Ы",\n  "b": []\n}' and tuple(got.o) == ("T", "O") and (got.common, got.owned) == (True, False)
    assert (got.a.unpacked_root, got.a.extraction_ok, got.a.warnings) == ("r/F", False, [])


def test_public_names():
    assert all(callable(getattr(formquarry, n)) for n in formquarry.__all__ if n != "__version__")
    with pytest.raises(AttributeError):
        formquarry.nothing  # noqa: B018
