import json
from decimal import Decimal

import brute
import pandas as pd

from formquarry.operators.schema_drift import consistent_entries, entry_values, exact_schema, field_changes, file_headers, file_kinds, union_schema

SCHEMA = "feed_id string, file_no int, rec_no int, payload string, field string, kind string"


def files(spark, *rows):
    return spark.createDataFrame([(f, n, r, p if p is None or isinstance(p, str) else json.dumps(p), "x", "y") for f, n, r, p in rows], SCHEMA)


def form(i, **fields):
    return {"object_type": "T", "object_name": f"O{i}", "container_name": "C", "form_name": "F"} | fields


def changes(df):
    return {tuple(r) for r in field_changes(df).collect()}


def test_kinds(spark):
    df = files(
        spark,
        ("a", 1, 1, form(1, h="x", n=1, gone=1, old="v1")),
        ("a", 1, 2, form(2, h="y", n=2, old="v2")),
        ("a", 4, 1, form(1, h="x", n="1", new="v1", fresh=True)),
        ("a", 4, 2, form(2, h="y", n="2", new="zz")),
        ("b", 1, 1, form(1, h="x")),
    )
    assert changes(df) == {("a", 4, "n", "", "retyped"), ("a", 4, "gone", "", "removed"), ("a", 4, "old", "new", "renamed"), ("a", 4, "fresh", "", "added")}


def test_case_matters_and_nulls_are_absent(spark):
    df = files(spark, ("a", 1, 1, form(1, h="x", k=None)), ("a", 2, 1, form(1, H="x", k=None)))
    assert changes(df) == {("a", 2, "h", "H", "renamed")}


def test_less_than_half_is_no_rename(spark):
    df = files(spark, *[("a", 1, i, form(i, old=i)) for i in range(3)], *[("a", 2, i, form(i, new=i if i == 0 else -1)) for i in range(3)])
    assert changes(df) == {("a", 2, "old", "", "removed"), ("a", 2, "new", "", "added")}


def test_each_field_is_renamed_once(spark):
    df = files(spark, ("a", 1, 1, form(1, old="v")), ("a", 2, 1, form(1, n1="v", n2="v")))
    assert changes(df) == {("a", 2, "old", "n1", "renamed"), ("a", 2, "n2", "", "added")}


def test_broken_records_redelivery_and_nulls(spark):
    rows = [("a", 1, 1, form(1, h=1)), ("a", 1, 2, '{"h": "cut'), ("a", 1, 3, None), ("a", 1, 4, "[1]"), (None, 1, 1, form(1, h=1)), ("a", None, 1, form(1)), ("a", 2, None, form(1, h=[1]))]
    assert changes(files(spark, *rows, *rows)) == {("a", 2, "h", "", "retyped")}
    assert changes(files(spark)) == set()


def test_equal_values_whatever_their_spelling(spark):
    df = files(spark, ("a", 1, 1, '{"object_type":"T","form_name":"F","old":{"a":1,"b":[2]}}'), ("a", 2, 1, '{"form_name":"F","object_type":"T","new":{"b":[2],"a":1}}'))
    assert changes(df) == {("a", 2, "old", "new", "renamed")}


def test_union_schema_and_entries(spark):
    df = files(spark, ("a", 1, 1, form(1, n=1, s="x", m=1, b=True, o={"a": 1})), ("a", 2, 1, form(2, n=2.5, m="t", B=2)))
    assert {r.field: r.kind for r in union_schema(file_headers(df)).collect()} == {"n": "double", "s": "string", "m": "string", "b": "boolean", "o": "string", "B": "double"}
    rows = {r.object_name: r.asDict() for r in consistent_entries(df).collect()}
    assert rows["O1"]["n"] == 1.0 and rows["O2"]["n"] == 2.5 and rows["O1"]["m"] == "1" and rows["O2"]["m"] == "t" and rows["O1"]["o"] == '{"a":1}'
    assert rows["O1"]["b__2"] is True and rows["O2"]["B"] == 2.0 and rows["O2"]["s"] is None


def test_stray_values_survive(spark):
    stray = ("t", [1], {"a": 1}, True, 7)
    df = files(spark, *[("a", 1, i, form(i, n=i, b=True, old=i)) for i in range(20)], *[("a", 1, 20 + i, form(20 + i, n=v, b=v)) for i, v in enumerate(stray)], *[("a", 2, i, form(i, n=1, b=False, new=i)) for i in range(9)], ("a", 2, 9, form(9, new="x")))
    assert {r.field: r.kind for r in union_schema(file_headers(df)).collect()} == {"n": "double", "b": "boolean", "old": "double", "new": "double"}
    assert {r.field: r.kind for r in union_schema(file_kinds(df)).collect()} == {"n": "string", "b": "string", "old": "double", "new": "string"}
    rows = {(r.file_no, r.rec_no): r.asDict() for r in consistent_entries(df).collect()}
    assert [(rows[1, 20 + i]["n"], rows[1, 20 + i]["b"]) for i in range(5)] == [(t, t) for t in ("t", "[1]", '{"a":1}', "true", "7")]
    assert rows[1, 3]["n"] == "3" and rows[2, 3]["b"] == "false"
    assert rows[1, 3]["new"] == rows[2, 3]["new"] == "3" and rows[2, 9]["new"] == "x"


def test_numbers_stay_exact(spark):
    big, long = 2**53 + 1, 12345678901234567890123
    values = {"int": [1, big], "d": [big, 2.25], "huge": [long, 1], "f": ["1e300", 2.5e-300], "mixed": [big, 1e300], "wide": [long, 0.12345678901234567], "one": [0.001, 0.5]}
    df = files(spark, *[("a", 1, k, json.dumps(form(k, **{n: v[k] for n, v in values.items() if n != "f"}))) for k in range(2)], ("a", 1, 2, '{"object_name":"x","f":1e300}'), ("a", 1, 3, '{"f":2.5e-300}'))
    assert {r.field: r.kind for r in exact_schema(file_kinds(df, exact=True)).collect()} == {"int": "bigint", "d": "decimal(21,2)", "huge": "decimal(23,0)", "f": "double", "mixed": "string", "wide": "string", "one": "decimal(3,3)"}
    rows = {r.rec_no: r.asDict() for r in consistent_entries(df).collect()}
    assert rows[1]["int"] == big and rows[0]["d"] == big and rows[1]["d"] == Decimal("2.25") and rows[0]["huge"] == long
    assert rows[0]["mixed"] == str(big) and float(rows[1]["mixed"]) == 1e300 and rows[0]["wide"] == str(long) and rows[2]["f"] == 1e300 and rows[0]["one"] == Decimal("0.001")


def test_no_value_is_lost(spark):
    rows = [("a", 1, i, form(i, n=v)) for i, v in enumerate((0, "stray", 2, 3, 4, True, [1], {"k": 2**53 + 1}, 9007199254740993, None))]
    cells = {(r.rec_no, r.column_name): r.value for r in entry_values(consistent_entries(files(spark, *rows, *rows))).collect()}
    assert {i: cells.get((i, "n")) for i in range(10)} == {0: "0", 1: "stray", 2: "2", 3: "3", 4: "4", 5: "true", 6: "[1]", 7: '{"k":9007199254740993}', 8: "9007199254740993", 9: None}
    assert sum(1 for (i, c) in cells if c != "n") == 40


def test_entries_follow_renames(spark):
    df = files(
        spark,
        ("a", 1, 1, form(1, hash="x", gone=1)), ("a", 2, 1, form(1, Hash="x")), ("a", 3, 1, form(1, digest="x")), ("a", 3, 2, form(2, digest=5)),
        ("b", 1, 1, form(1, old="q")), ("b", 2, 1, form(1, new="q")), ("b", 3, 1, form(1, old="r", new="s")),
    )
    rows = consistent_entries(df)
    assert set(rows.columns[7:]) == {"Hash", "gone", "old", "new"} or set(rows.columns[7:]) == {"digest", "gone", "old", "new"}
    column = next(c for c in rows.columns if c in ("Hash", "digest", "hash"))
    assert sorted(str(r[column]) for r in rows.where("feed_id = 'a'").collect()) == ["5", "x", "x", "x"]
    assert sorted(map(str, (r["old"] for r in rows.where("feed_id = 'b'").collect()))) == ["None", "q", "r"]
    assert len(consistent_entries(df, follow_renames=False).columns) == 7 + 6
    assert consistent_entries(files(spark)).count() == 0


def test_whole_table(spark, sf):
    df = spark.read.parquet(f"{sf}/index_files.parquet")
    assert changes(df) == brute.field_changes(pd.read_parquet(f"{sf}/index_files.parquet"))
