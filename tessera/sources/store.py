"""Keyed records behind a change log and atomic snapshots.

A store is a folder: `wal/` holds NDJSON files, and folders of such files, of entries {lsn, op, key, payload};
`snapshot-<lsn>/` is a Parquet table sorted by key, with all entries up to that lsn folded in; `CURRENT` names the
snapshot that counts. A snapshot has the columns key and payload and, where the store knows a schema, a typed column for
each of its scalars, so that filters and column lists reach the scan. Reading lays the log's later entries over the
snapshot: the latest entry of a key wins, and a delete takes it away; only the log is folded, the snapshot is filtered.
Lines that can't be parsed (torn writes) are left out; an unknown operation is an error. Writes are appended as one new
log file or folder each, so a batch costs one commit. All files are reached by Spark's own file systems.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.schema import Record, Schema
from tessera.functions.types import SPARK_TYPES
from tessera.sources import shared

OPS = ("put", "delete", "checkpoint")
LOG = "lsn long, op string, key long, payload map<string,string>"
STATE = "key long, payload map<string,string>"
TYPED = "v_"  # before the name of a scalar: its column in a snapshot


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """Entries of all log files under a path, torn lines left out."""
    raw = spark.read.schema(LOG).option("mode", "DROPMALFORMED").option("recursiveFileLookup", "true").json(path)
    return raw.filter("lsn is not null and op is not null")


def fold(log: DataFrame, state: DataFrame | None = None) -> DataFrame:
    """(key, payload): the latest put of every key that no later delete takes away.

    log has (lsn, op, key, payload); state is a folded table that is older than all of the log. One shuffle on the key.
    """
    entries = log.filter("op in ('put', 'delete')").select("lsn", "op", "key", "payload")
    if state is not None:
        entries = entries.unionByName(state.select(F.lit(-1).cast("long").alias("lsn"), F.lit("put").alias("op"), "key", "payload"))
    last = entries.groupBy("key").agg(F.max_by(F.struct("op", "payload"), "lsn").alias("e"))  # combines before the shuffle
    return last.filter("e.op = 'put'").select("key", F.coalesce("e.payload", F.create_map().cast("map<string,string>")).alias("payload"))


class RecordStore:
    def __init__(self, spark: SparkSession, path: str, recover: bool = True):
        self.spark, self.path = spark, path
        self.wal = f"{path}/wal"
        self.schema: Schema | None = None  # of the typed columns that the next snapshot gets
        shared.make_folder(self.wal, spark)
        self._lsn = 0
        self._snapshot: str | None = None
        if recover:
            self._recover()

    def _recover(self) -> None:
        if shared.exists(f"{self.path}/CURRENT", self.spark):
            self._snapshot = json.loads(shared.read_text(f"{self.path}/CURRENT", self.spark))["snapshot"]
            self._lsn = self.since() + 1
        if self._log_files():
            log = read_log(self.spark, self.wal)
            unknown = log.filter(~F.col("op").isin(*OPS)).select("op").limit(1).collect()
            if unknown:
                raise ValueError(f"unknown operation {unknown[0][0]!r} in the log")
            self._lsn = max(self._lsn, (log.agg(F.max("lsn")).first()[0] or -1) + 1)

    def _log_files(self) -> list[str]:
        return [f for f in shared.names(self.wal, self.spark) if f.endswith(".json")]

    def lsn(self) -> int:
        """The number that the next entry gets."""
        return self._lsn

    def since(self) -> int:
        """The lsn of the snapshot, -1 without one: later entries are in the log."""
        return int(self._snapshot.rpartition("-")[2]) if self._snapshot else -1

    def append(self, entries: Iterable[tuple[str, int | None, dict[str, str] | None]]) -> int:
        """Logs (op, key, payload) entries as one file; the first lsn."""
        first, lines = self._lsn, []
        for op, key, payload in entries:
            if op not in OPS:
                raise ValueError(f"unknown operation {op!r}")
            entry = {"lsn": self._lsn, "op": op}
            entry |= {} if key is None else {"key": key}
            entry |= {} if payload is None else {"payload": payload}
            lines.append(json.dumps(entry, ensure_ascii=False))
            self._lsn += 1
        if lines:
            shared.atomic_write(f"{self.wal}/{first:020d}.json", "\n".join(lines) + "\n", self.spark)
        return first

    def append_frame(self, changes: DataFrame) -> int:
        """Logs a frame of (op, key, payload) that is too large for the driver; the number of entries.

        Entries are numbered in the order of the frame, so of repeated keys the last holds. The files are written
        beside the log and join it by one rename: a write that fails leaves no entry.
        """
        if changes.filter(~F.col("op").isin(*OPS) | F.col("op").isNull()).limit(1).count():
            raise ValueError("unknown operation")
        beside = f"{self.path}/staged-{uuid.uuid4().hex}"
        numbered = changes.select((F.lit(self._lsn) + F.monotonically_increasing_id()).alias("lsn"), "op", F.col("key").cast("long").alias("key"), "payload")
        numbered.write.json(beside)
        n, last = read_log(self.spark, beside).agg(F.count("*"), F.max("lsn")).first()
        if n:
            shared.move(beside, f"{self.wal}/{self._lsn:020d}.json", self.spark)
            self._lsn = last + 1
        else:
            shared.delete(beside, self.spark)
        return n

    def put(self, record: Record) -> None:
        """Replaces the whole record."""
        self.append([("put", record.key, record.columns)])

    def put_many(self, records: Iterable[Record]) -> None:
        self.append(("put", r.key, r.columns) for r in records)

    def delete(self, key: int) -> bool:
        """False, and nothing logged, if there is no such record."""
        if not self.contains(key):
            return False
        self.append([("delete", key, None)])
        return True

    def changes(self, since: int, only: Column | None = None) -> DataFrame | None:
        """(key, payload) of the keys written after an lsn, the payload null for a deleted one; None if there are none.
        The log must reach back to it: since() and all that came later do."""
        if since < self.since():
            raise ValueError(f"the log begins after {self.since()}")
        if self._lsn <= since + 1 or not self._log_files():
            return None
        log = read_log(self.spark, self.wal).filter((F.col("lsn") > since) & F.col("op").isin("put", "delete"))
        log = log if only is None else log.filter(only)
        last = log.groupBy("key").agg(F.max_by(F.struct("op", "payload"), "lsn").alias("e"))  # combines before the shuffle
        empty = F.create_map().cast("map<string,string>")
        return last.select("key", F.when(F.col("e.op") == "put", F.coalesce("e.payload", empty)).alias("payload"))

    def _state(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{self._snapshot}") if self._snapshot else self.spark.createDataFrame([], STATE)

    def frame(self, only: Column | None = None) -> DataFrame:
        """(key, payload) of all records, or of those whose `key` fulfils a condition."""
        return self._current(only, lambda state: state.select("key", "payload"), lambda new: new)

    def typed(self, schema: Schema, only: Column | None = None) -> DataFrame:
        """As frame, with _key and the schema's scalars in place of the payload: from the snapshot's typed columns where
        it has them, else parsed."""

        def stored(state: DataFrame) -> DataFrame:
            have = dict(state.dtypes)
            kept = lambda c: have.get(TYPED + c.name) == SPARK_TYPES[c.type].simpleString()
            return state.select(F.col("key").alias("_key"), *(F.col(f"`{TYPED}{c.name}`").alias(c.name) if kept(c) else schema.value(c, F.col("payload")).alias(c.name) for c in schema.scalar_columns()))

        return self._current(only, stored, schema.typed)

    def _current(self, only: Column | None, of_state, of_log) -> DataFrame:
        state = self._state() if only is None else self._state().filter(only)
        new = self.changes(self.since(), only)
        if new is None:
            return of_state(state)
        kept = state.join(new.select("key"), "key", "left_anti") if self._snapshot else None
        put = of_log(new.filter("payload is not null"))
        return put if kept is None else of_state(kept).unionByName(put)

    def get(self, key: int) -> Record | None:
        row = self.frame(F.col("key") == key).first()
        return Record(row["key"], dict(row["payload"])) if row else None

    def contains(self, key: int) -> bool:
        return self.frame(F.col("key") == key).limit(1).count() > 0

    __contains__ = contains

    def __len__(self) -> int:
        return self.frame().count()

    def keys(self) -> DataFrame:
        return self.frame().select("key")

    def records(self) -> DataFrame:
        return self.frame()

    def checkpoint(self) -> None:
        """Folds everything into a new snapshot, switches to it, and drops what it replaces.

        The switch is the rename of CURRENT; a crash before it leaves the old snapshot and the log, one after it leaves
        files that are read no more (entries up to the snapshot's lsn are skipped).
        """
        name, old = f"snapshot-{self._lsn:020d}", self._snapshot
        self.append([("checkpoint", None, None)])
        rows = self.frame()
        if self.schema is not None:
            rows = rows.select("*", *(self.schema.value(c, F.col("payload")).alias(TYPED + c.name) for c in self.schema.scalar_columns()))
        rows.repartitionByRange("key").sortWithinPartitions("key").write.mode("overwrite").parquet(f"{self.path}/{name}")
        shared.atomic_write(f"{self.path}/CURRENT", json.dumps({"snapshot": name}), self.spark)
        self._snapshot = name
        for f in shared.names(self.wal, self.spark):
            shared.delete(f"{self.wal}/{f}", self.spark)
        if old:
            shared.delete(f"{self.path}/{old}", self.spark)

    def close(self) -> None:
        """Nothing is held open."""
