import random
from datetime import datetime, timedelta

import pytest

from formquarry.operators import orphans as module
from formquarry.operators.orphans import attribute_orphans, orphan_counts

T0 = datetime(2025, 1, 1)
U = "12345678-1234-1234-1234-1234567890ab"


def day(n, hours=0):
    return T0 + timedelta(days=n, hours=hours)


def tables(spark, types=(), attributes=(), bindings=()):
    return (
        spark.createDataFrame(list(types), "dump_id string, uuid string, type_name string, registered_at timestamp_ntz, deleted_at timestamp_ntz"),
        spark.createDataFrame(list(attributes), "attr_id long, dump_id string, object_type string, object_name string, section_name string, attr_name string, value_type string, recorded_at timestamp_ntz, removed_at timestamp_ntz, k0 string, at string"),
        spark.createDataFrame(list(bindings), "binding_id long, dump_id string, object_type string, object_name string, data_path string, bound_at timestamp_ntz, until string"),
    )


def attr(i, name="A", at=0, end=None, section=None, kind=None, dump="d"):
    return (i, dump, "T", "O", section, name, kind, day(at), None if end is None else day(end), "x", "y")


def bind(i, path, at=5, dump="d", hours=0):
    return (i, dump, "T", "O", path, day(at, hours), "z")


def orphans(spark, *args):
    return {(r.table_name, r.row_id, r.orphan_kind) for r in attribute_orphans(*tables(spark, *args)).collect()}


def test_references_to_types(spark):
    types = [("d", U.upper(), "X", day(1), day(3)), ("d", U, "X", day(6), None), ("e", U, "X", day(0), None)]
    attributes = [attr(i, at=t, kind=f"Ref#{U}") for i, t in enumerate((0, 1, 2, 3, 5, 6, 9))] + [attr(20, kind="Ref#" + "0" * 36), attr(21, kind="String"), attr(22, dump=None, kind=f"Ref#{U}")]
    assert orphans(spark, types, attributes) == {("object_attributes", 0, "late"), ("object_attributes", 3, "deleted"), ("object_attributes", 4, "deleted"), ("object_attributes", 20, "missing"), ("object_attributes", 22, "missing")}


def test_paths(spark):
    attributes = [attr(1, " Вес ", 0), attr(2, "Вес", 0, section=""), attr(3, "Сумма", 0, section="Товары")]
    bindings = [bind(i, p) for i, p in enumerate(("Объект.вес", "x. ВЕС ", "Объект.товары.СУММА", "Объект.Сумма", "Объект.Товары.Вес", "Вес", "a.b.c.d", None, "", ".", "Объект."))]
    assert orphans(spark, (), attributes, bindings) == {("bindings", i, "missing") for i in (3, 4, 9, 10)}


def test_same_day_and_ties(spark):
    attributes = [(1, "d", "T", "O", None, "A", None, day(5, 6), day(5, 12), "x", "y")]
    bindings = [bind(i, "o.A", 5, hours=h) for i, h in enumerate((0, 6, 11, 12, 13))] + [bind(9, "o.A", 9)]
    assert orphans(spark, (), attributes, bindings) == {("bindings", 0, "late"), ("bindings", 3, "deleted"), ("bindings", 4, "deleted"), ("bindings", 9, "deleted")}


def test_nulls_repeats_and_empty_tables(spark):
    open_start = (1, "d", "T", "O", None, "A", None, None, None, "x", "y")
    unknown_time = (7, "d", "T", "O", "o.A", None, "z")
    assert orphans(spark, (), [open_start], [bind(1, "o.A"), bind(1, "o.A"), unknown_time]) == {("bindings", 1, "late"), ("bindings", 7, "late")}
    assert orphans(spark) == set()
    assert orphans(spark, (), (), [bind(1, "o.A")]) == {("bindings", 1, "missing")}


def test_counts(spark):
    found = attribute_orphans(*tables(spark, (), (), [bind(1, "o.A", 5), bind(2, "o.B", 6), bind(3, "o.A", 40)]))
    assert {tuple(r) for r in orphan_counts(found).collect()} == {("bindings", "2025-01", "missing", 2), ("bindings", "2025-02", "missing", 1)}


def judged(lives, at):
    """The definition: the kind of orphan at a time among (start, end) of all targets."""
    started = [e for s, e in lives if s is not None and at is not None and s <= at]
    return "missing" if not lives else "late" if not started else None if any(e is None or e > at for e in started) else "deleted"


@pytest.mark.parametrize(("starts", "hot"), [(1_000, 1_000_000), (1_000, 3), (0, 1_000_000), (2, 2)])
def test_hot_keys_like_the_definition(spark, monkeypatch, starts, hot):
    monkeypatch.setattr(module, "MAX_STARTS", starts)
    monkeypatch.setattr(module, "HOT_ROWS", hot)
    rng = random.Random(starts + hot)
    moment = lambda: None if rng.random() < 0.05 else T0 + timedelta(days=rng.randint(0, 2), seconds=rng.choice((0, 1, 5)), microseconds=rng.choice((0, 1, 7)))
    names = ["Hot"] * 6 + ["B", "C", "D"]
    attributes = [(i, "d", "T", "O", None, rng.choice(names), None, moment(), rng.choice((None, moment())), "x", "y") for i in range(60)]
    attributes += attributes[:5]
    bindings = [(i, rng.choice(("d", "d", "d", None)), "T", "O", f"o.{rng.choice([*names, 'None'])}", moment(), "z") for i in range(120)]
    wanted = set()
    for i, dump, _, _, path, at, _ in bindings:
        lives = [(a[7], a[8]) for a in attributes if dump == "d" and a[5] == path[2:]]
        if kind := judged(lives, at):
            wanted.add(("bindings", i, kind))
    assert orphans(spark, (), attributes, bindings + bindings[:9]) == wanted
