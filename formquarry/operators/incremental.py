"""Processing only new or changed records, once each, whatever failed between.

A work item is a record key with a version. It is *pending* when the current version is new or
differs from the one seen by the last successful run, *leased* to a run under a fencing token, and
*done* once that run succeeds; the lease of a run that fails, aborts or never reports expires and
the item is pending again. Every run takes one lease, whose number is its token, towards the next commit.
``replay`` folds these transitions over a history of runs, each key on its own, in one pass; ``live_runs`` drives
``formquarry.operators.ledger`` through the same history, run by run, as live runs do.

Defined results: rows without key or delivery time are left out; NULL change times sort lowest;
repeated rows are the same version; a run without status counts as failed; no runs or no rows give
no events; extra columns are never read.
"""

from __future__ import annotations

from datetime import timedelta
from uuid import uuid4

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formquarry.operators.ledger import WorkLedger
from formquarry.session import ensure_shared_dir

#: Runs are driver-side metadata; their number is checked against this bound.
MAX_RUNS = 10_000


def run_history(runs: DataFrame) -> list[tuple[int, object, bool]]:
    """(run_no, started_at, succeeded) in order of run_no; of repeated run numbers the first started counts."""
    rows = runs.where("run_no IS NOT NULL AND started_at IS NOT NULL").groupBy("run_no").agg(F.min(F.struct("started_at", F.coalesce(F.col("run_status"), F.lit("")).alias("run_status"))).alias("r")).limit(MAX_RUNS + 1).collect()
    if len(rows) > MAX_RUNS:
        raise ValueError(f"more than {MAX_RUNS} runs")
    return sorted((r.run_no, r.r.started_at, r.r.run_status == "succeeded") for r in rows)


def visible_versions(feed: DataFrame, starts: list, key: str, delivered: str, version: Column) -> DataFrame:
    """(key, seen array<struct<slot, version>>): for each key the greatest version of each slot.

    ``starts`` are the sorted start times; slot n has the rows first visible at start n. Grouping by
    key and slot first keeps the array no longer than the number of runs, however many rows a key has.
    """
    at = F.expr("array(" + ",".join(f"timestamp_ntz'{t}'" for t in starts) + ")")
    slot = F.size(F.filter(at, lambda s: s < F.col(delivered).cast("timestamp_ntz")))
    rows = feed.where(F.col(key).isNotNull() & F.col(delivered).isNotNull()).select(F.col(key).alias("item"), slot.alias("slot"), version.alias("version")).where(F.col("slot") < len(starts))
    slots = rows.groupBy("item", "slot").agg(F.max("version").alias("version"))
    return slots.groupBy("item").agg(F.collect_list(F.struct("slot", "version")).alias("seen"))


def replay(feed: DataFrame, runs: DataFrame, key: str, delivered: str, version: Column, changed: str) -> DataFrame:
    """(item, run_no, token, commit_no, attempt, state in done/expired): the ledger's leases and what became of them.

    ``version`` is a struct that sorts by age; ``changed`` is SQL over structs ``cur`` and ``was``. The fold carries
    the greatest version seen so far, so its steps are as many as runs and versions.
    """
    history = run_history(runs)
    starts = sorted({h[1] for h in history})
    if not history:
        none = [F.lit(0).alias(n) for n in ("run_no", "token", "commit_no", "attempt")]
        return feed.select(F.col(key).alias("item"), *none, F.lit("").alias("state")).where("false")
    seen = visible_versions(feed, starts, key, delivered, version)
    kind = seen.schema["seen"].dataType.elementType["version"].dataType.simpleString()
    steps, commit = [], 1
    for token, (number, start, ok) in enumerate(history, 1):
        steps.append(f"named_struct('run_no', {number}, 'token', {token}, 'commit_no', {commit}, 'slot', {starts.index(start)}, 'ok', {str(ok).lower()})")
        commit += ok
    out = "array<struct<run_no:int,token:int,commit_no:int,attempt:int,state:string>>"
    init = f"named_struct('cur', cast(NULL as {kind}), 'was', cast(NULL as {kind}), 'attempt', 0, 'out', cast(array() as {out}))"
    pending = f"(cur IS NOT NULL AND (a.was IS NULL OR coalesce({changed.replace('was.', 'a.was.')}, false)))"
    lease = "array(named_struct('run_no', r.run_no, 'token', r.token, 'commit_no', r.commit_no, 'attempt', a.attempt + 1, 'state', if(r.ok, 'done', 'expired')))"
    run = f"named_struct('cur', cur, 'was', if(r.ok, cur, a.was), 'attempt', if(p AND NOT r.ok, a.attempt + 1, 0), 'out', if(p, concat(a.out, {lease}), a.out))"
    judged = f"transform(array({pending}), p -> {run})[0]"
    runs_at = f"array({','.join(steps)})"
    if [h[1] for h in history] == sorted(h[1] for h in history):
        # Versions and runs in one order of time, so every step sees one of them and the greatest version so far.
        events = f"array_sort(concat(transform(seen, v -> named_struct('slot', v.slot, 'run', 0, 'version', v.version)), transform({runs_at}, r -> named_struct('slot', r.slot, 'run', r.token, 'version', cast(NULL as {kind})))))"
        seen_one = "named_struct('cur', if(a.cur IS NULL OR e.version > a.cur, e.version, a.cur), 'was', a.was, 'attempt', a.attempt, 'out', a.out)"
        made = f"transform(array(get({runs_at}, e.run - 1)), r -> transform(array(a.cur), cur -> {judged})[0])[0]"
        fold = f"aggregate({events}, {init}, (a, e) -> if(e.run = 0, {seen_one}, {made}), a -> a.out)"
    else:
        # Runs that started in another order than their numbers each look at all that they could see.
        current = "array_max(transform(filter(seen, v -> v.slot <= r.slot), v -> v.version))"
        fold = f"aggregate({runs_at}, {init}, (a, r) -> transform(array({current}), cur -> {judged})[0], a -> a.out)"
    return seen.selectExpr("item", f"inline({fold})")


def live_runs(feed: DataFrame, runs: DataFrame, key: str, delivered: str, version: Column, changed: str, folder: str) -> DataFrame:
    """(run_no, item): what each successful run of a history processes, with a ``WorkLedger`` below ``folder`` in between.

    Each run leases, writes what is pending to its token's path, and commits, gives up (failed) or goes silent, all
    at the times of the history; the result is read from the outputs that commits name.
    """
    spark, now = feed.sparkSession, [0.0]
    ledger = WorkLedger(spark, folder, clock=lambda: now[0])
    rows = feed.where(F.col(key).isNotNull() & F.col(delivered).isNotNull()).select(F.col(key).alias("item"), version.alias("version"), F.col(delivered).cast("timestamp_ntz").alias("at"))
    ends = {r.run_no: (r.finished_at, r.run_status) for r in runs.groupBy("run_no").agg(F.max("finished_at").alias("finished_at"), F.min("run_status").alias("run_status")).collect()}
    differs = F.expr(changed.replace("cur.", "version."))
    for number, start, ok in run_history(runs):
        now[0] = start.timestamp()
        end, status = ends[number]
        end = end or start + timedelta(minutes=1)
        token = ledger.lease((end - start).total_seconds() + 1)
        current = rows.where(F.col("at") <= F.lit(start)).groupBy("item").agg(F.max("version").alias("version"))
        ledger.pending(current, differs).select(F.lit(number).alias("run_no"), "item").write.mode("overwrite").parquet(ledger.output_path(token))
        now[0] = end.timestamp()
        if ok:
            ledger.commit(token, current)
        elif status == "failed":
            ledger.give_up(token)
    done = ledger.outputs()
    return spark.read.parquet(*done) if done else spark.createDataFrame([], f"run_no int, item {rows.schema['item'].dataType.simpleString()}")


_VERSION = ("bin_mtime", "delivered_at", "rec_id", "unpacked_mtime", "lower(bsl_sha256) AS bsl_sha256")
_TRUSTED = "({0}.bsl_sha256 IS NOT NULL AND {0}.unpacked_mtime IS NOT NULL AND coalesce({0}.bin_mtime <= {0}.unpacked_mtime, false))"
#: The rule of change: trusted hashes decide, else a second of difference.
CHANGED = f"if({_TRUSTED.format('cur')} AND {_TRUSTED.format('was')}, cur.bsl_sha256 != was.bsl_sha256, coalesce(abs(cur.bin_mtime - was.bin_mtime) > 1.0, NOT (cur.bin_mtime <=> was.bin_mtime)))"


def form_runs(freshness: DataFrame, runs: DataFrame) -> DataFrame:
    """The ledger of form extraction; rows in state ``done`` are the forms each successful run has to process."""
    return replay(freshness, runs, "form_name", "delivered_at", F.struct(*map(F.expr, _VERSION)), CHANGED)


def live_forms(freshness: DataFrame, runs: DataFrame) -> DataFrame:
    """(run_no, form_name): as ``due_forms``, by live runs over a ledger in the shared folder."""
    folder = f"{ensure_shared_dir(freshness.sparkSession).rstrip('/')}/ledger-{uuid4().hex}"
    found = live_runs(freshness, runs, "form_name", "delivered_at", F.struct(*map(F.expr, _VERSION)), CHANGED, folder)
    return found.select("run_no", F.col("item").alias("form_name"))


def due_forms(ledger: DataFrame) -> DataFrame:
    """(run_no, form_name): ``p5_found``."""
    return ledger.where("state = 'done'").select("run_no", F.col("item").alias("form_name"))
