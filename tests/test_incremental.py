from datetime import datetime, timedelta

import pytest

from formquarry.operators.incremental import due_forms, form_runs
from formquarry.operators.ledger import LeaseTaken, LedgerError, StaleToken, WorkLedger

T0 = datetime(2025, 3, 1)


def at(h):
    return T0 + timedelta(hours=h)


def feed(spark, *rows):
    return spark.createDataFrame([(*r, "x") for r in rows], "rec_id long, form_name string, bin_mtime double, unpacked_mtime double, bsl_sha256 string, delivered_at timestamp_ntz, item string")


def runs(spark, *rows):
    return spark.createDataFrame(list(rows), "run_no int, started_at timestamp_ntz, run_status string")


def due(spark, rows, history):
    return sorted(tuple(r) for r in due_forms(form_runs(feed(spark, *rows), runs(spark, *history))).collect())


RUNS = [(1, at(10), "succeeded"), (2, at(20), "failed"), (3, at(30), "succeeded"), (4, at(40), None), (5, at(50), "succeeded")]


def test_failed_runs_leave_their_work(spark):
    rows = [(1, "a", 1.0, 2.0, "h", at(1)), (2, "b", 1.0, 2.0, "h", at(15)), (3, "a", 9.0, 10.0, "H", at(16)), (4, "a", 20.0, 30.0, "x", at(35))]
    assert due(spark, rows, RUNS) == [(1, "a"), (3, "b"), (5, "a")]


def test_late_and_older_deliveries_change_nothing(spark):
    rows = [(1, "a", 9.0, 10.0, "h", at(1)), (2, "a", 5.0, 6.0, "other", at(12)), (3, "a", 9.0, 10.0, "h", at(60))]
    assert due(spark, rows, RUNS) == [(1, "a")]


def test_untrusted_hashes_fall_back_to_time(spark):
    rows = [(1, "a", 1.0, None, "h", at(1)), (2, "a", 1.9, 5.0, "other", at(12)), (3, "b", 1.0, 5.0, None, at(1)), (4, "b", 9.0, 99.0, "z", at(12)), (5, "c", 5.0, 1.0, "q", at(1)), (6, "c", 5.5, 6.0, "r", at(45))]
    assert due(spark, rows, RUNS) == [(1, "a"), (1, "b"), (1, "c"), (3, "b")]


def test_ties_and_repeats(spark):
    rows = [(1, "a", 1.0, 2.0, "h", at(1)), (2, "a", 1.0, 2.0, "k", at(1))]
    assert due(spark, rows + rows, RUNS) == [(1, "a")]
    assert due(spark, [(1, "a", 1.0, 2.0, "k", at(1)), (3, "a", 1.0, 2.0, "z", at(20))], RUNS) == [(1, "a"), (3, "a")]


def test_nulls_and_empty_tables(spark):
    rows = [(1, None, 1.0, 2.0, "h", at(1)), (2, "a", None, None, None, at(1)), (3, "b", 1.0, 2.0, "h", None)]
    assert due(spark, rows, RUNS) == [(1, "a")]
    assert due(spark, [], RUNS) == [] and due(spark, rows, []) == []


def test_states_and_attempts(spark):
    ledger = form_runs(feed(spark, (1, "a", 1.0, 2.0, "h", at(11))), runs(spark, *RUNS))
    assert sorted((r.run_no, r.token, r.attempt, r.state) for r in ledger.collect()) == [(2, 2, 1, "expired"), (3, 3, 2, "done")]
    assert {r.commit_no for r in ledger.collect()} == {2}  # both attempts are at the second commit


def versions(spark, **items):
    return spark.createDataFrame(sorted(items.items()), "item string, version string")


def test_live_ledger(spark, tmp_path):
    now = [0.0]
    ledger = WorkLedger(spark, str(tmp_path / "l"), clock=lambda: now[0])
    first = versions(spark, a="1", b="1")
    token = ledger.lease(10)
    with pytest.raises(LeaseTaken):
        ledger.lease(10)
    path = ledger.output_path(token)
    assert ledger.output_path(token) == path
    now[0] = 11.0
    second = ledger.lease(10)
    assert second == token + 1 and ledger.output_path(second) != path and ledger.pending(first).count() == 2
    with pytest.raises(StaleToken):
        ledger.commit(token, first)
    assert ledger.commit(second, first) == 1
    with pytest.raises(StaleToken):
        ledger.commit(second, first)
    third = ledger.lease(10)
    later = versions(spark, a="2", b="1", c="1")
    assert {r.item for r in ledger.pending(later).collect()} == {"a", "c"}
    ledger.give_up(third)
    fourth = ledger.lease(10)
    with pytest.raises(StaleToken):
        ledger.commit(third, later)
    assert ledger.commit(fourth, later) == 2 and ledger.pending(later).count() == 0


def test_a_late_writer_is_never_read(spark, tmp_path):
    now = [0.0]
    ledger = WorkLedger(spark, str(tmp_path / "l"), clock=lambda: now[0])
    late, items = ledger.lease(10), versions(spark, a="1")
    now[0] = 11.0
    winner = ledger.lease(10)
    items.write.parquet(ledger.output_path(winner))
    assert ledger.commit(winner, items) == 1
    versions(spark, wrong="9").write.mode("overwrite").parquet(ledger.output_path(late))
    with pytest.raises(StaleToken):
        ledger.commit(late, versions(spark, wrong="9"))
    assert [tuple(r) for r in spark.read.parquet(*ledger.outputs()).collect()] == [("a", "1")] and ledger.pending(items).count() == 0


def test_torn_records(spark, tmp_path):
    ledger = WorkLedger(spark, str(tmp_path / "l"), clock=lambda: 0.0)
    (tmp_path / "l/leases/000000000001").write_bytes(b"")
    (tmp_path / "l/leases/000000000002").write_bytes(b'{"until": 9')
    token = ledger.lease(10)
    assert token == 3 and ledger.commit(token, versions(spark, a="1")) == 1
    assert not list((tmp_path / "l/aside").iterdir())
    (tmp_path / "l/commits/000000000002").write_bytes(b"{")
    with pytest.raises(LedgerError):
        ledger.lease(10)


def test_lease_that_ends_during_the_write(spark, tmp_path):
    times = iter([0.0, 1.0, 99.0])  # lease, before the state is written, after
    ledger = WorkLedger(spark, str(tmp_path / "l"), clock=lambda: next(times))
    token = ledger.lease(10)
    with pytest.raises(StaleToken):
        ledger.commit(token, versions(spark, a="1"))
    assert ledger.outputs() == [] and next(times, None) is None


def test_two_commits_on_one_base(spark, tmp_path):
    ledger = WorkLedger(spark, str(tmp_path / "l"), clock=lambda: 0.0)
    token = ledger.lease(10)
    assert ledger._publish("commits", 1, {"token": 99, "state": "s", "output": "o"}) and not ledger._publish("commits", 1, {"token": 1})
    with pytest.raises(StaleToken):
        ledger.commit(token, versions(spark, a="1"))


def test_runs_out_of_order(spark):
    history = [(1, at(30), "succeeded"), (2, at(10), "succeeded"), (3, at(40), "succeeded")]
    rows = [(1, "a", 1.0, 2.0, "h", at(20)), (2, "a", 9.0, 10.0, "k", at(35)), (3, "b", 1.0, 2.0, "h", at(5))]
    assert due(spark, rows, history) == [(1, "a"), (1, "b"), (3, "a")]
