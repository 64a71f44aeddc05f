import json

import brute
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from formquarry.operators.nested import nested_links, unread_texts

U = "12345678-1234-1234-1234-1234567890ab"
V = "22345678-1234-1234-1234-1234567890AB"


def found(spark, elems=(), headers=()):
    elem = spark.createDataFrame([(i, t, "x") for i, t in elems], "elem_id long, elem string, link_kind string")
    owner = spark.createDataFrame([(i, t, "x") for i, t in headers], "object_id long, header string, child string")
    rows = [tuple(r) for r in nested_links(elem, owner).collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def wanted(elems=(), headers=()):
    return brute.links(pd.DataFrame(elems, columns=["elem_id", "elem"]), pd.DataFrame(headers, columns=["object_id", "header"]))


def test_positions_count_all_members(spark):
    tree = [None, "x", {"name": "a", "child": [1, {"items": [{}]}], "items": [{"q": 1}]}]
    rows = found(spark, [(1, json.dumps({"tree": tree}))])
    assert rows == {("tree", 1, "2", ""), ("tree", 1, "2/1", "2"), ("tree", 1, "2/1/0", "2/1"), ("tree", 1, "2/0", "2")}


def test_single_object_tree_and_bom(spark):
    assert found(spark, [(1, "﻿" + json.dumps({"tree": {"child": [{}]}}))]) == {("tree", 1, "0", ""), ("tree", 1, "0/0", "0")}


def test_raw_text_and_array(spark):
    raw = ["48", [12, U], [["7", ["a", V], []]], ["x", ["b", "no uuid"]], ["y", ["c", U, 1]]]
    doc = {"data": {"p/q": {"raw": raw}, "t": {"raw": json.dumps(raw)}, "o": {"raw": {"a": 1}}, "l": [raw], "n": {"raw": None}, "s": {"raw": 5}}}
    rows = found(spark, [(3, json.dumps(doc))])
    assert rows == {("raw", 3, "12", "p/q"), ("raw", 3, "12", "t"), ("raw", 3, "a", "12")}


def entry(u, name="N", more=()):
    return ["2", ["1", "100", u], f'"{name}"', *more]


def test_both_header_layouts(spark):
    new = [[["1", ["11", [entry(U, "S")]]], "1", ["svc", "1", [[entry(V)]]]]]
    old = [[0, [0, 0, U], '"S"', [0, [0, [0, [0, 0, V], '"C"']]]]]
    zero = [entry("00000000-0000-0000-0000-000000000000"), entry(U, "")]
    damaged = [[["1", ["11"]], "1", ["svc", "1", [[entry(V)]]]]]
    texts = [(i, json.dumps(h)) for i, h in enumerate((new, old, zero, damaged))]
    assert found(spark, (), texts) == {("header", 0, U, ""), ("header", 0, V, U), ("header", 1, U, ""), ("header", 1, V, U), ("header", 3, V, "")}


@pytest.mark.parametrize("text", [None, "", "{", "[1", '{"tree":[{}]} x', "5", "null", '"a"', "[]", "{}", '{"tree":5,"data":[]}', '{"tree":[{}]},{}'])
def test_odd_texts_give_nothing(spark, text):
    assert found(spark, [(1, text)], [(1, text)]) == set()


def test_last_of_a_repeated_key_counts(spark):
    assert found(spark, [(1, '{"tree":[],"tree":[{}]}')]) == {("tree", 1, "0", "")}


def test_repeated_rows_and_empty_tables(spark):
    text = json.dumps({"tree": [{}]})
    assert found(spark, [(1, text), (1, text)]) == {("tree", 1, "0", "")}
    assert found(spark) == set()


def test_depth_and_width(spark):
    deep: dict = {}
    for _ in range(300):
        deep = {"child": [deep]}
    raw: list = ["z"]
    for i in range(200):
        raw = [1, [i, U], raw]
    wide = {"tree": [{"child": [{}] * 500}] * 20}
    elems = [(1, json.dumps({"tree": [deep], "data": {"k": {"raw": raw}}})), (2, json.dumps(wide))]
    assert found(spark, elems) == wanted(elems)


_leaf = st.one_of(st.none(), st.booleans(), st.integers(0, 9), st.sampled_from(["a", U, V, '"N"', '"', "0"]))
_node = st.recursive(_leaf, lambda x: st.one_of(st.lists(x, max_size=4), st.tuples(st.just("k"), st.tuples(st.sampled_from(["1", 2]), st.sampled_from([U, V])), x).map(lambda t: [t[0], list(t[1]), t[2]]), st.builds(lambda u, n, r: [0, [0, 0, u], n, *r], st.sampled_from([U, V]), st.sampled_from(['"N"', '""']), st.lists(x, max_size=3)), st.builds(lambda a, b: [[a], "1", [b]], x, x), st.dictionaries(st.sampled_from(["child", "items", "raw", "x"]), x, max_size=2)), max_leaves=25)


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(_node, min_size=12, max_size=12))
def test_against_brute_force(spark, nodes):
    elems = [(i, json.dumps({"tree": n, "data": {"k": {"raw": n}, "s": {"raw": json.dumps(n)}}})) for i, n in enumerate(nodes)]
    headers = [(i, json.dumps([n])) for i, n in enumerate(nodes)]
    assert found(spark, elems, headers) == wanted(elems, headers)


def test_whole_table(spark, sf):
    from formquarry.plans.problems import p1_found

    rows = {tuple(r) for r in p1_found(spark, sf).collect()}
    assert rows == brute.links(pd.read_parquet(f"{sf}/elem_files.parquet"), pd.read_parquet(f"{sf}/owner_objects.parquet"))


def test_unread_texts(spark):
    deep, shallow = "[" * 1200 + "]" * 1200, "[" * 999 + "]" * 999
    texts = [None, "", "{", "[1] 2", deep, shallow, '{"a":1}', "\ufeff[]", '["' + "[" * 2000 + '"]', '["' + "[" * 2000]
    rows = spark.createDataFrame([*enumerate(texts), (0, None)], "i long, t string")
    found = {tuple(r) for r in unread_texts(rows, "s", "i", "t").collect()}
    assert found == {("s", 0, "no text"), ("s", 1, "no text"), ("s", 2, "not JSON"), ("s", 3, "not JSON"), ("s", 4, "nested too deep"), ("s", 9, "not JSON")}
