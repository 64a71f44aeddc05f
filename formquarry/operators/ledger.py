"""A work-item ledger in a shared folder, for live incremental runs.

Items are pending until a run has leased and finished them. A lease has a token, an end and the number of
the commit it builds on; only one is open at a time, and once it has ended the items are pending again and
the next lease gets a greater token. Committing needs the newest token (fencing), an open lease, and
publishes the next commit number exclusively, so of two writers that started from the same state one wins
and the other is told.

Output is staged: a lease writes to a path named after the commit to make and its token, so what a failed
attempt of the same lease left is overwritten, and a late writer with an older token only ever writes where
no reader looks. Readers take the paths that commits name (``outputs``).

Records are written aside, whole, and then given their name by a rename that never overwrites, so none is
ever torn; a lease record that can't be read (left by another program) counts as ended. This needs a store
with an atomic rename or link: HDFS and mounted folders have one, object stores without it are not safe.

Items are compared by ``item`` and ``version``; NULL items are left out, NULL versions are equal.
"""

from __future__ import annotations

import json
import os
import time
import uuid
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class LedgerError(RuntimeError):
    """The ledger refuses what was asked for."""


class LeaseTaken(LedgerError):
    """Another run holds an open lease."""


class StaleToken(LedgerError):
    """A newer lease or commit exists, or the lease has ended."""


class WorkLedger:
    """Ledger of one feed below ``folder``, which all executors and drivers share."""

    def __init__(self, spark: SparkSession, folder: str, clock=time.time) -> None:
        self.spark, self.folder, self.clock = spark, folder.rstrip("/"), clock
        hadoop = spark.sparkContext._jvm.org.apache.hadoop
        self._path, self._io = hadoop.fs.Path, hadoop.io.IOUtils
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path(self.folder).getFileSystem(self._conf)
        for part in ("leases", "commits", "aside"):
            self._fs.mkdirs(self._path(f"{self.folder}/{part}"))

    def _entries(self, part: str) -> dict[int, object]:
        """Records by number; names are numbers, so listing is enough to order them."""
        paths = [s.getPath() for s in self._fs.listStatus(self._path(f"{self.folder}/{part}"))]
        return {int(p.getName()): p for p in paths if p.getName().isdigit()}

    def _load(self, path) -> dict | None:
        """A record, None if it is not one."""
        stream = self._fs.open(path)
        try:
            found = json.loads(bytes(self._io.readFullyToByteArray(stream)).decode())
        except ValueError:
            return None
        finally:
            stream.close()
        return found if isinstance(found, dict) else None

    def _publish(self, part: str, number: int, record: dict) -> bool:
        """Write a record under a number unless there is one; whole or not at all."""
        aside, path = self._path(f"{self.folder}/aside/{uuid.uuid4().hex}"), self._path(f"{self.folder}/{part}/{number:012d}")
        stream = self._fs.create(aside, True)
        stream.write(bytearray(json.dumps(record).encode()))
        stream.close()
        try:
            if self._fs.getUri().getScheme() == "file":
                # A local rename overwrites; a link does not.
                local = [unquote(p.toUri().getPath()) for p in (aside, path)]
                try:
                    os.link(*local)
                except FileExistsError:
                    return False
                return True
            return not self._fs.exists(path) and bool(self._fs.rename(aside, path))
        finally:
            self._fs.delete(aside, False)

    def last_commit(self) -> tuple[int, dict | None]:
        """(number, record) of the last commit; (0, None) before the first."""
        commits = self._entries("commits")
        if not commits:
            return 0, None
        record = self._load(commits[max(commits)])
        if record is None:
            raise LedgerError(f"commit {max(commits)} can't be read")
        return max(commits), record

    def _open(self, token: int, leases: dict[int, object]) -> dict | None:
        """The record of a lease that has neither ended nor been given up."""
        record = self._load(leases[token]) if token in leases else None
        if record is None or self._failed(token):
            return None
        return record if record.get("until", 0) > self.clock() else None

    def lease(self, seconds: float) -> int:
        """A new token, unless a lease is open."""
        leases = self._entries("leases")
        newest = max(leases, default=0)
        number, commit = self.last_commit()
        done = commit is not None and commit["token"] >= newest
        if newest and not done and self._open(newest, leases):
            raise LeaseTaken(f"token {newest} is open")
        if not self._publish("leases", newest + 1, {"until": self.clock() + seconds, "base": number}):
            raise LeaseTaken(f"token {newest + 1} was taken meanwhile")
        return newest + 1

    def _failed(self, token: int) -> bool:
        return self._fs.exists(self._path(f"{self.folder}/leases/{token:012d}.failed"))

    def give_up(self, token: int) -> None:
        """End a lease early; its items are pending again at once."""
        self._fs.createNewFile(self._path(f"{self.folder}/leases/{token:012d}.failed"))

    def done(self) -> DataFrame | None:
        """(item, version) as of the last commit, None before the first."""
        _, record = self.last_commit()
        return None if record is None else self.spark.read.parquet(record["state"])

    def pending(self, current: DataFrame, changed: Column | None = None) -> DataFrame:
        """The rows (item, version) that are new or have changed since the last commit.

        ``changed``: a condition over ``version`` and ``was``, the version of the last commit; by default that they differ.
        """
        items, done = current.where("item IS NOT NULL"), self.done()
        if done is None:
            return items
        joined = items.join(done.select("item", F.col("version").alias("was"), F.lit(True).alias("known")), "item", "left")
        differs = ~F.col("version").eqNullSafe(F.col("was")) if changed is None else F.coalesce(changed, F.lit(False))
        return joined.where(F.col("known").isNull() | differs).drop("was", "known")

    def output_path(self, token: int) -> str:
        """Where the run under a token writes: the same for every attempt within its lease."""
        base = (self._load(self._entries("leases")[token]) or {}).get("base", 0)
        return f"{self.folder}/output/{base + 1:012d}-{token:012d}"

    def outputs(self) -> list[str]:
        """The output paths of all commits in their order; nothing else below ``output`` is to be read."""
        commits = self._entries("commits")
        return [record["output"] for n in sorted(commits) if (record := self._load(commits[n]))]

    def commit(self, token: int, current: DataFrame) -> int:
        """Make ``current`` (item, version) the done state and the token's output part of the results; the commit's number."""
        self._check(token)
        state = f"{self.folder}/state/{token:012d}"
        current.where("item IS NOT NULL").select("item", "version").write.mode("overwrite").parquet(state)
        base = self._check(token)  # writing took its time
        if not self._publish("commits", base + 1, {"token": token, "state": state, "output": self.output_path(token)}):
            raise StaleToken(f"commit {base + 1} was made by another run")
        return base + 1

    def _check(self, token: int) -> int:
        """The commit that a token builds on; refuses one that does not hold the newest, open lease on the last commit."""
        leases = self._entries("leases")
        record = self._open(token, leases)
        if token != max(leases, default=0) or record is None:
            raise StaleToken(f"token {token} no longer holds the lease")
        number, last = self.last_commit()
        if (last is not None and last["token"] >= token) or number != record["base"]:
            raise StaleToken(f"token {token} builds on commit {record['base']}, the last one is {number}")
        return number
