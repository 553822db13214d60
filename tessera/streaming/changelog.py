"""A table of current records that follows a change log, by Structured Streaming.

Every micro-batch is folded to the latest entry of each key and laid over the state. The state is a folder of Parquet
versions, one a batch; `CURRENT` names the one that counts and the batch that made it, so a batch that is run again
after a failure changes nothing.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.sources import shared
from tessera.sources.store import LOG, STATE

VERSION = STATE + ", lsn long, live boolean"


def read_changes(spark: SparkSession, folder: str, files_a_batch: int = 1000) -> DataFrame:
    """A stream of the log's entries, torn lines left out."""
    raw = spark.readStream.schema(LOG).option("mode", "DROPMALFORMED").option("maxFilesPerTrigger", files_a_batch).option("recursiveFileLookup", "true").json(folder)
    return raw.filter("lsn is not null and op in ('put', 'delete') and key is not null")


class FollowedTable:
    def __init__(self, spark: SparkSession, path: str, keep_versions: int = 2):
        self.spark, self.path, self.keep_versions = spark, path, keep_versions
        shared.make_folder(path, spark)

    def _current(self) -> dict:
        try:
            return json.loads(shared.read_text(f"{self.path}/CURRENT", self.spark))
        except FileNotFoundError:
            return {"batch": -1, "version": None}

    def _versions(self) -> DataFrame:
        version = self._current()["version"]
        return self.spark.read.schema(VERSION).parquet(f"{self.path}/{version}") if version else self.spark.createDataFrame([], VERSION)

    def frame(self) -> DataFrame:
        """(key, payload) of the records that are live now."""
        return self._versions().filter("live").select("key", "payload")

    def apply(self, batch: DataFrame, batch_id: int) -> None:
        """Lays one micro-batch over the state. Deleted keys stay as marks, so an older entry that comes late is no revival."""
        if batch_id <= self._current()["batch"]:
            return
        new = batch.select("key", F.coalesce("payload", F.create_map().cast("map<string,string>")).alias("payload"), "lsn", (F.col("op") == "put").alias("live"))
        last = self._versions().unionByName(new).groupBy("key").agg(F.max_by(F.struct("payload", "lsn", "live"), "lsn").alias("e"))
        version = f"version-{batch_id:012d}"
        last.select("key", "e.payload", "e.lsn", "e.live").write.mode("overwrite").parquet(f"{self.path}/{version}")
        shared.atomic_write(f"{self.path}/CURRENT", json.dumps({"batch": batch_id, "version": version}), self.spark)
        for old in sorted(v for v in shared.names(self.path, self.spark) if v.startswith("version-"))[: -self.keep_versions]:
            shared.delete(f"{self.path}/{old}", self.spark)

    def follow(self, folder: str, checkpoint: str, once: bool = True) -> StreamingQuery:
        """Starts the stream; once: takes what is there now and ends."""
        writer = read_changes(self.spark, folder).writeStream.foreachBatch(self.apply).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="10 seconds")).start()
