import json

import pytest

from formquarry.decoders import chain, elements, legacy, owner, report
from formquarry.decoders.values import at, lenient, strict
from formquarry.functions import domain as D

U = [f"{i:08d}-0000-4000-8000-000000000001" for i in range(1, 10)]


def entry(u, name, synonym="Syn"):
    return ["2", ["1", "100", u], f'"{name}"', ["1", '"ru"', f'"{synonym}"']]


def wrapped(u, name, kind=None):
    return [["8", ["27", ["2", entry(u, name), ['"Pattern"', ['"S"'] if kind is None else kind]]]], "0"]


def section(u, name, *columns):
    own = ["2", entry(u, name)]
    return [["1", ["11", "a", "b", "c", "d", own]], "1", ["svc", str(len(columns)), *columns]]


def decode(header):
    return owner.decode(json.dumps({"header": header}))


def test_production_layout():
    header = [["1", ["13"], section(U[0], "Товары", wrapped(U[1], "Сумма", ['"N"'])), wrapped(U[2], "Вес"), wrapped(U[2], "Вес")]]
    found = decode(header)
    assert found.error is None and [(a.uuid, a.name, a.type, a.synonym) for a in found.attributes] == [(U[2], "Вес", "String", "Syn")]
    assert [(s.uuid, s.name, [(c.name, c.type) for c in s.columns]) for s in found.sections] == [(U[0], "Товары", [("Сумма", "Number")])]


@pytest.mark.parametrize(("node", "expected"), [(['"S"'], "String"), (['"N"'], "Number"), (['"B"'], "Boolean"), (['"D"'], "Date"), (['"U"'], "Undefined"), (['"T"'], "Null"), (['"#"', U[5]], f"Ref#{U[5]}"), (['"#"'], None), (['"ZZZ"'], None), ([], None)])
def test_types(node, expected):
    found = decode([wrapped(U[0], "A", node)])
    assert found.attributes[0].type == expected and bool(found.warnings) == (node == ['"ZZZ"'])


def test_compact_and_bare_entries():
    compact = [1, 1, ["a", "b", "c", U[0], '"Код"', "ru", '"Code"']]
    header = [["1", ["13"], 0, 0, 0, 0, [U[8], "1", compact]], ["x", entry(U[1], "Голый")]]
    assert [(a.uuid, a.name, a.type) for a in decode(header).attributes] == [(U[0], "Код", None), (U[1], "Голый", None)]


def test_legacy_layout():
    columns = [0, [0, [0, 0, U[1]], '"Col"', [0, '"Number"'], [0, 0, [0, '"ru"', '"C"']]]]
    sections = [0, [0, [0, 0, U[0]], '"TS"', [0, 0, [0, '"ru"', '"S"']], columns]]
    plain = [0, [0, [0, 0, U[2]], '"Attr"', [0, '"Type"'], [0, 0, [0, '"ru"', '"Syn"']]], [0, [0, 0, U[3]]]]
    found = decode([[sections, plain]])
    assert [tuple(a) for a in found.attributes] == [(U[2], "Attr", "Type", "Syn")]
    assert [(s.name, s.synonym, [c.name for c in s.columns]) for s in found.sections] == [("TS", "S", ["Col"])]
    assert any(U[3] in w for w in found.warnings)


@pytest.mark.parametrize(("text", "error"), [(None, owner.NO_TEXT), ("{", owner.NOT_JSON), ("", owner.NOT_JSON), ("[]", owner.NO_HEADER), ('{"a":1}', owner.NO_HEADER), ('{"header":{}}', owner.NOT_SUPPORTED), ('﻿{"header":[]}', None)])
def test_errors(text, error):
    assert owner.decode(text).error == error


def test_identity_and_standard_attributes():
    text = json.dumps({"header": [["m", ["i", U[0], U[1], U[0], "x", 5, 6, U[2], U[3]]]]})
    assert owner.identity(text) == [U[0], U[1]] and owner.identity("{") == []
    assert owner.standard_attributes(text, "Catalog", D.STANDARD_SLOTS, D.STANDARD_OWNERS) == [(U[2], "Наименование"), (U[3], "Код")]
    assert owner.standard_attributes(text, "Document", D.STANDARD_SLOTS, D.STANDARD_OWNERS) == []


def test_quotes_and_access():
    assert strict('"a "') == "a" and strict('""') is None and strict("a") is None and lenient("a ") == "a" and lenient("x") is None
    assert at([[1, [2]]], 0, 1, 0) == 2 and at([1], 3) is None and at({"a": 1}, 0) is None


def chain_form(*tables):
    return {"form": [[["0", "0", "0", [["0", [str(len(a)), *a], "1", *[["5", str(i), "0", f'"{n}"'] for i, n in fields.items()]] for a, fields in tables]]]]}


def record(block):
    return [0] * D.BIND_SLOT + [block]


def test_chains():
    props = [{"name": "A", "id": "1", "child": [{"name": "B", "id": "2"}]}]
    form = chain_form(([["1"], ["2", U[0]]], {3: "C"}))
    declared = chain.definitions(form, props)
    assert declared.known == {U[0]} and declared.attributes == {(None, 1): "A", ("A", 2): "B"}
    good = ["3", ["1"], ["2", U[0]], ["3"]]
    assert chain.follow(record(good), declared, "ABC") == ("A.B.C", None)
    assert chain.follow(record(["4", ["1"], ["0", U[4]], ["2", U[0]], ["3"]]), declared, "ABC") == ("A.B.C", None)
    reasons = {
        chain.NO_SLOT: ([0] * 5, "x"),
        chain.UNBOUND: (record(["1", "0"]), "x"),
        chain.NOT_A_CHAIN: (record("0"), "x"),
        chain.MALFORMED: (record(["9", ["1"], ["2"]]), "x"),
        chain.TOO_SHORT: (record(["1", ["1"]]), "A"),
        chain.NOT_DECLARED: (record(["2", ["1"], ["2", U[7]]]), "AB"),
        chain.UNRESOLVED: (record(["2", ["1"], ["77"]]), "A"),
        chain.MISMATCH: (record(good), "Other"),
    }
    for reason, (raw, name) in reasons.items():
        assert chain.follow(raw, declared, name) == (None, reason)


def test_odd_definitions_declare_nothing():
    for form in (None, [], {"form": []}, {"form": [[["0"]]]}, chain_form(([], {1: "x"}))):
        assert chain.segment_tables(form) == {}
    assert chain.attribute_ids("x") == {}


def field(*slots, source=None, extra=()):
    binding = ["14", f'"{source}"'] if source else ["0"]
    return [D.TABULAR_FIELD, "1", ["5", [["11", ["20", *["s"] * 5, *slots]]], *extra], "0", binding]


def slot(*uuids):
    return ["column", ["8", *[["16", ["x", u]] for u in uuids]]]


def test_tabular_fields():
    names = {U[0]: "A", U[1]: "B", U[2]: "C"}
    form = {"x": [field(slot(U[1]), slot(U[8]), slot(U[0]), source="Товары")]}
    assert [r["data_path"] for r in legacy.list_columns(form, names, None)] == ["Товары.B", "Товары.A"]
    pairs = {"x": [field(slot(U[0], U[1]), extra=(["0", U[2]], ['"#"', U[0]]))]}
    assert [r["data_path"] for r in legacy.list_columns(pairs, names, None)] == ["Список.C", "Список.A"]
    module = 'ЭтаФорма.товары.Колонки.Добавить("К1"); Товары.Columns.Add( "К2" )'
    assert [r["name"] for r in legacy.list_columns({"x": [field(source="Товары")]}, names, module)] == ["К1", "К2"]
    assert legacy.list_columns({"x": [field(source="Отбор")]}, names, 'Отбор.Колонки.Добавить("К")') == []
    assert legacy.list_columns(form, {}, module) == []


def test_widgets():
    kinds = list(D.WIDGET_TYPES)
    form = {"x": [[kinds[0], 1, 2, 3, ["14", '"Вес"', 0], ["0"]], [kinds[1], 1, 2, 3, ["14", '"Код"']], [kinds[0], 1, 2, 3, ["14", '"Вес"']], ["other", 1, 2, 3, ["14", '"Нет"']]]}
    assert [(r["name"], r["type"], r["data_path"]) for r in legacy.widgets(form)] == [("Вес", "InputField", "Объект.Вес"), ("Код", "ComboBox", "Объект.Код")]


def test_unindexed_reasons():
    names = {U[0]: "A"}
    own, known = {"x": [field(slot(U[8]), source="Товары")]}, {"x": [field(slot(U[0]))]}
    cases = [
        ("no_legacy_json", (None, False, False, names, None)),
        ("no_tabular_no_widgets", ({"x": []}, True, False, names, None)),
        ("no_owner_object", (own, True, True, names, None)),
        ("tabular_field_empty_attr_map", (own, True, False, {}, None)),
        ("tabular_field_platform_dynamic", ({"x": [field(source="Отбор")]}, True, False, names, None)),
        ("unknown", (known, True, False, names, None)),
        ("tabular_field_programmatic_no_defs", (own, True, False, names, "")),
        ("tabular_field_bsl_source_mismatch", (own, True, False, names, 'Другой.Колонки.Добавить("К")')),
        ("tabular_field_no_uuid_hits", (own, True, False, names, 'Товары.Колонки.Добавить("К")')),
    ]
    for reason, arguments in cases:
        assert legacy.unindexed_reason(*arguments)[0] == reason


def parse(doc, **more):
    return elements.parse(json.dumps(doc), **more)


def paths(result):
    return {e["name"]: e["data_path"] for e in result["elements"]}


def raw(name, *more):
    return ["1", "2", "3", "4", ["14", f'"{name}"'], *more]


def test_ordinary_form():
    doc = {"data": {"-pages-": ["P"], "P/Код": {"id": 1, "raw": raw("Код"), "prop": "Объект"}, "P/Список": {"id": 2, "raw": raw("Список"), "prop": "Список"}, "P/К": {"id": 3, "raw": raw("К")}}, "tree": [{"name": "Код", "type": "Field"}], "props": [{"name": "Список", "id": "1"}]}
    found = parse(doc)
    assert paths(found) == {"P": None, "Код": "Объект.Код", "Список": "Список", "К": None}
    row = {e["name"]: e for e in found["elements"]}
    assert (row["Код"]["type"], row["Код"]["parent"], row["Код"]["parent_path"], row["P"]["type"]) == ("Field", "P", "P", "Page")
    assert row["Список"]["merged_sources"] == ["data", "props"] and row["Список"]["source"] == "data"


def test_managed_form():
    doc = {"data": {"Вес": {"raw": ["48", ["1", U[6]], ["0", U[0]]]}, "Два": {"raw": [["0", U[0]], ["0", U[1]]]}, "Сумма": {"raw": [["0", U[0]], ["0", U[1]]]}, "Точка": {"raw": ["x", ["a.b"]]}, "Кнопка": {"raw": ["1"]}}}
    found = parse(doc, names={U[0]: "Вес", U[1]: "Сумма"})
    assert paths(found) == {"Вес": "Объект.Вес", "Два": None, "Сумма": "Объект.Сумма", "Точка": "a.b", "Кнопка": None}
    assert any("ambiguous" in w for w in found["warnings"])
    assert {z["element"]: z["reason"] for z in found["zero_binding"]} == {"Два": chain.NO_SLOT, "Кнопка": chain.NO_SLOT}


def test_structural_paths():
    doc = {"props": [{"name": "Список", "child": [{"name": "Номенклатура"}]}], "data": {"Список/СписокНоменклатура": {"raw": ["1"]}, "Список": {"raw": ["1"]}, "Прочее/Х": {"raw": ["1"]}}}
    assert {k: v for k, v in paths(parse(doc)).items() if v} == {"СписокНоменклатура": "Список.Номенклатура", "Список": "Список"}


def test_chain_fills_what_is_missing():
    doc = {"props": [{"name": "A", "id": "1", "child": [{"name": "B", "id": "2"}]}], "data": {"AB": {"raw": record(["2", ["1"], ["2"]])}}}
    assert paths(parse(doc))["AB"] == "A.B"


def test_sections_without_data():
    doc = {"tree": [{"name": "Г", "type": "Group", "items": [{"Имя": "П", "Тип": "Field", "ПутьКДанным": "Объект.П", "Обработчик": "ПНажатие"}]}], "commands": [{"name": "К"}]}
    found = parse(doc)
    assert [(e["name"], e["type"], e["parent"], e["source"], e["data_path"], e["handler"]) for e in found["elements"]] == [("Г", "Group", None, "tree", None, None), ("П", "Field", "Г", "tree", "Объект.П", "ПНажатие"), ("К", "Unknown", None, "commands", None, None)]


def test_handlers_and_diagnosis():
    doc = {"tree": [{"name": "Вес", "type": "Field", "parent": "Нет"}, {"name": "Г", "type": "Group"}]}
    found = parse(doc, module="﻿  процедура ВесПриИзменении(Элемент)\nПроцедура ВесВыбор (Э)\n")
    assert found["elements"][0]["handler"] == "ВесПриИзменении"
    assert any("'Нет'" in w for w in found["warnings"]) and any("nesting" in w for w in found["warnings"])


@pytest.mark.parametrize("text", [None, "", "{", "{}", "[]", "5", '{"data":{}}', '{"data":{"a":5,"-pages-":5}}', '{"tree":null}'])
def test_nothing_found(text):
    found = elements.parse(text)
    assert not found["ok"] and found["elements"] == [] and found["warnings"] and found["elem_sha256"] is None and found["reason"] == "no_legacy_json"


def test_positional_form_as_fallback():
    form = json.dumps({"x": [[next(iter(D.WIDGET_TYPES)), 1, 2, 3, ["14", '"Вес"']]]})
    found = elements.parse("{}", form_text=form)
    assert paths(found) == {"Вес": "Объект.Вес"} and found["ok"]
    assert elements.parse("{}", form_text="{")["reason"] == "unknown"


def test_structure_hash_ignores_noise():
    doc = {"tree": [{"name": "A", "type": "Field"}]}
    noisy = {"tree": [{"name": "A", "type": "Field", "id": 5, "top": 1, "color": "red"}]}
    assert parse(doc)["elem_sha256"] == parse(noisy)["elem_sha256"] != parse({"tree": [{"name": "B", "type": "Field"}]})["elem_sha256"]


def test_report_queries():
    xml = '<DataSet Name="Первый"><Query>ВЫБРАТЬ Поле\n  ИЗ Таблица</Query></DataSet><DataSet Name="Второй"><Query>выбрать Другое ИЗ Места</Query><Query>ВЫБРАТЬ Поле ИЗ Таблица</Query>'
    for content in (b"\0" * 8 + b"\xef\xbb\xbf" + xml.encode(), b"\0" * 24 + b"<?xml?>" + xml.encode()):
        text, wrong = report.container_text(content)
        assert wrong is None and [(d["name"], d["query"]) for d in report.datasets(text)] == [("Первый", "ВЫБРАТЬ Поле ИЗ Таблица"), ("Второй", "выбрать Другое ИЗ Места")]
    assert [d["name"] for d in report.datasets(xml, nearest=False)] == ["Первый", "Первый"]
    assert report.container_text(None)[1] and report.container_text(b"junk")[1] and report.container_text(b"\xef\xbb\xbf\xff")[1]
    assert [d["name"] for d in report.datasets("ВЫБРАТЬ 1234567890")] == ["Dataset1"] and report.datasets(None) == []
