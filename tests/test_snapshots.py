from datetime import datetime

from formquarry.operators.snapshots import form_changes, report_check

SCHEMA = "dump_id string, snapshot_no int, loaded_at timestamp_ntz, object_type string, object_name string, container_name string, form_name string, bsl_sha256 string, elem_sha256 string, part string, snap int, row_key string"


def scan(snapshot, name, bsl="b", elem="e", hour=1, dump="d", object_name="O"):
    return (dump, snapshot, datetime(2025, 1, 1, hour), "T", object_name, "C", name, bsl, elem, "p", 1, "k")


def changes(spark, *rows):
    return {tuple(r) for r in form_changes(spark.createDataFrame(list(rows), SCHEMA)).collect()}


def test_added_removed_changed(spark):
    rows = [scan(1, "a"), scan(1, "b"), scan(1, "c"), scan(5, "a", "B"), scan(5, "b", "x"), scan(5, "n"), scan(7, "n", elem="E2"), scan(3, "z", dump="other")]
    assert changes(spark, *rows) == {("d", 5, "T/O/C/b", "changed"), ("d", 5, "T/O/C/c", "removed"), ("d", 5, "T/O/C/n", "added"), ("d", 7, "T/O/C/n", "changed"), ("d", 7, "T/O/C/a", "removed"), ("d", 7, "T/O/C/b", "removed")}


def test_latest_load_counts(spark):
    rows = [scan(1, "a", "x", hour=1), scan(1, "a", "y", hour=9), scan(2, "a", "y", hour=3), scan(2, "a", "x", hour=2)]
    assert changes(spark, *rows, *rows) == set()


def test_null_hashes_never_differ(spark):
    assert changes(spark, scan(1, "a", None, "e"), scan(2, "a", "x", "E"), scan(3, "a", None, None)) == set()


def test_null_and_empty_parts_are_one_key(spark):
    assert changes(spark, scan(1, "a", object_name=None), scan(2, "a", object_name="")) == set()


def test_rows_without_place_and_empty_table(spark):
    assert changes(spark, scan(None, "a"), scan(1, "a", dump=None)) == set()
    assert changes(spark) == set()


def test_ties_take_the_greatest_hash(spark):
    assert changes(spark, scan(1, "a", "x"), scan(1, "a", "y"), scan(2, "a", "y")) == set()


def test_report_check(spark):
    df = form_changes(spark.createDataFrame([scan(1, "a"), scan(2, "b")], SCHEMA))
    reports = spark.createDataFrame([("d", 2, ["T/O/C/b", "lie", "lie"], None)], "dump_id string, snapshot_no int, added array<string>, removed array<string>")
    assert {tuple(r) for r in report_check(df, reports).collect()} == {("d", 2, "added", 1, 1, 0), ("d", 2, "removed", 0, 0, 1)}
