"""Tables whose changes are seen whole or not at all: snapshots, swaps of several tables at once, and retries.

A store is a folder that all executors share. Data are written first, each table to a new folder; then a manifest, which
names the folder of every table, is created under the next number. That creation fails if the number is taken, so that of
two writers who began from the same state one has to look again. A reader takes the last manifest, and keeps what it
names however the store goes on. What a writer leaves behind that died before its manifest is not read.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.operators import jobs as J


class Conflict(RuntimeError):
    """Another writer was first."""


@dataclass(frozen=True)
class Snapshot:
    number: int
    tables: dict[str, str] = field(default_factory=dict)  # name: folder
    notes: dict[str, Any] = field(default_factory=dict)  # small values that change with the tables, as cursors


class Store:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        jvm = spark._jvm
        self._path = lambda *parts: jvm.org.apache.hadoop.fs.Path("/".join((folder, *parts)))
        self._fs = self._path().getFileSystem(spark._jsc.hadoopConfiguration())

    def _numbers(self) -> list[int]:
        if not self._fs.exists(self._path("versions")):
            return []
        return sorted(int(s.getPath().getName().split(".")[0]) for s in self._fs.listStatus(self._path("versions")) if s.getPath().getName().endswith(".json"))

    def snapshot(self) -> Snapshot:
        """The last state that was written whole; its number is that of the last manifest, whole or not."""
        numbers = self._numbers()
        for n in reversed(numbers):
            stream = self._fs.open(self._path("versions", f"{n:08d}.json"))
            try:
                text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
            finally:
                stream.close()
            try:
                found = json.loads(text)
            except ValueError:  # its writer died, or is at it
                continue
            return Snapshot(numbers[-1], found["tables"], found["notes"])
        return Snapshot(numbers[-1] if numbers else 0)

    def read(self, name: str, at: Snapshot | None = None) -> DataFrame:
        return self.spark.read.parquet((at or self.snapshot()).tables[name])

    def commit(self, base: Snapshot, tables: dict[str, DataFrame], notes: dict[str, Any] | None = None) -> Snapshot:
        """Replaces the tables, all at once; those that aren't named stay. Conflict if the store isn't at `base` any more."""
        placed = {}
        for name, df in tables.items():
            placed[name] = f"{self.folder}/data/{name}-{uuid.uuid4().hex}"
            df.write.parquet(placed[name])
        new = Snapshot(base.number + 1, {**base.tables, **placed}, {**base.notes, **(notes or {})})
        try:
            out = self._fs.create(self._path("versions", f"{new.number:08d}.json"), False)
        except Py4JJavaError as e:
            if "AlreadyExists" in str(e.java_exception):
                raise Conflict(f"version {new.number} is taken") from None
            raise
        out.write(bytearray(json.dumps({"tables": new.tables, "notes": new.notes}).encode()))
        out.close()
        return new

    def update(self, change: Callable[[Snapshot], tuple[dict[str, DataFrame], dict[str, Any]] | None], tries: int = 20) -> Snapshot:
        """Commits what `change` makes of the present state, anew if another writer was first; nothing if it gives None."""
        for _ in range(tries):
            base = self.snapshot()
            made = change(base)
            if made is None:
                return base
            try:
                return self.commit(base, *made)
            except Conflict:
                continue
        raise Conflict(f"others were first {tries} times")


def replace_layers(store: Store, layers: dict[str, DataFrame]) -> Snapshot:
    """Communities and their edges, as any number of tables, replaced together: readers see the old or the new layers."""
    return store.update(lambda _: (layers, {}))


def reset(store: Store, names: list[str]) -> Snapshot:
    """The named tables are empty from then on, with their schemas; the others stay."""
    return store.update(lambda at: ({n: store.read(n, at).limit(0) for n in names if n in at.tables}, {}))


def apply_batch(store: Store, batch: int, cursor: str | None, change: Callable[[Snapshot], dict[str, DataFrame]], source: str = "feed") -> bool:
    """A batch of a stream, applied once: its tables, its number and the cursor behind it are one commit. A batch that is
    delivered again, after a restart, changes nothing. Whether it was applied."""
    done = False

    def once(at: Snapshot):
        nonlocal done
        done = at.notes.get(f"{source}.batch", -1) < batch
        if not done:
            return None
        kept = at.notes.get(f"{source}.cursor") if cursor is None else cursor
        return change(at), {f"{source}.batch": batch, f"{source}.cursor": kept}

    store.update(once)
    return done


class Drafts:
    """A cache of drafts by key: what a model would see. Keys: a DataFrame with a column `key`."""

    def __init__(self, store: Store, name: str = "drafts"):
        self.store, self.name = store, name

    def save(self, drafts: DataFrame) -> None:
        """drafts: key, draft. A key that is there gets the new draft; of equal keys among the new, the least draft."""
        new = drafts.groupBy("key").agg(F.min("draft").alias("draft"))

        def add(at: Snapshot):
            if self.name not in at.tables:
                return {self.name: new}, {}
            return {self.name: self.store.read(self.name, at).join(new.select("key"), "key", "left_anti").unionByName(new)}, {}

        self.store.update(add)

    def load(self, keys: DataFrame) -> DataFrame:
        """keys with their drafts, null where there is none."""
        at = self.store.snapshot()
        if self.name not in at.tables:
            return keys.withColumn("draft", F.lit(None).cast("string"))
        return keys.join(self.store.read(self.name, at), "key", "left")

    def clear(self) -> None:
        reset(self.store, [self.name])


def claim_jobs(store: Store, worker: str, n: int, now: Column, lease_seconds: int) -> DataFrame:
    """The next n jobs of the table `job` for a worker, who has them for the lease: pending ones, or ones whose lease is
    over; incremental lane first, then the oldest. Of workers that claim at once one commits, and the others look again,
    so that no job is given twice. Columns claimed_by and claimed_at are set."""
    mark = uuid.uuid4().hex

    def take(at: Snapshot):
        jobs = store.read("job", at)
        over = (F.col("status") == "in_progress") & (F.unix_timestamp(now.cast("timestamp")) - F.unix_timestamp(F.col("claimed_at").cast("timestamp")) > lease_seconds)
        free = jobs.withColumn("status", F.when(over, "pending").otherwise(F.col("status")))
        next_ = J.claim(free, n).select("job_id", F.lit(True).alias("_mine"))
        set_ = {"status": F.lit("in_progress"), "claimed_by": F.lit(f"{worker}/{mark}"), "claimed_at": now.cast(jobs.schema["claimed_at"].dataType)}
        mine = F.col("_mine").isNotNull()
        return {"job": free.join(F.broadcast(next_), "job_id", "left").withColumns({c: F.when(mine, v).otherwise(F.col(c)) for c, v in set_.items()}).select(*jobs.columns)}, {}  # n rows

    return store.read("job", store.update(take)).filter(F.col("claimed_by") == f"{worker}/{mark}")
