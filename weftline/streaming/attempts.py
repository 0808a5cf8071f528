"""Retry counts and histories of collected items as keyed state of a stream: a batch touches the keys that it holds, and no others.

An attempt at an item (key, attempt) has a row for the item itself (member null) and one for each member of it, such as the
files of an archive, with an outcome: "done", or else what went wrong. Attempts of a key count in ascending order. An item that
is done stays so; one that has failed is tried again by attempts with retry only; whatever an attempt comes too late for is
ignored, and so is one that was seen before, so a replay changes nothing. A failure's retry_count is that of the failure
before it plus 1, from 0 on; the members of the latest attempt replace those before, and each that isn't done takes its
count on from the same member of the attempt before.

State lives in Spark's keyed store (RocksDB, saved in the checkpoint): one small value for a key, its members and its
history, each read and written by itself. state() reads it back as tables, at any time between runs.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.workers import ready

ATTEMPT = "key string, attempt bigint, member string, outcome string, retry boolean"
CHANGED = "key string, status string, retry_count int, attempt bigint"
_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Attempts(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.item = handle.getValueState("item", "status string, retry_count int, attempt bigint")
        self.members = handle.getMapState("members", "member string", "outcome string, retry_count int")
        self.history = handle.getListState("history", "attempt bigint, event string, error string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # A batch's attempts at one item: what a key brings between two triggers.
        new: dict[int, list] = {}
        for part in rows:
            for attempt, member, outcome, retry in zip(part["attempt"], part["member"], part["outcome"], part["retry"], strict=True):
                new.setdefault(int(attempt), []).append((None if pd.isna(member) else member, outcome, bool(retry)))
        status, count, last = self.item.get() if self.item.exists() else (None, None, None)
        before = last
        for attempt in sorted(new):
            own = [(outcome, retry) for member, outcome, retry in new[attempt] if member is None]
            late = last is not None and attempt <= last
            if not own or late or status == "done" or (status == "failed" and not own[0][1]):
                continue
            last, outcome = attempt, own[0][0]
            self._take_members({m: o for m, o, _ in new[attempt] if m is not None})
            if outcome == "done":
                if status == "failed":
                    self.history.appendValue((attempt, "resolved", None))
                status, count = "done", None
            else:
                status, count = "failed", (-1 if count is None else count) + 1
                self.history.appendValue((attempt, "failure", outcome))
        if last != before:
            self.item.update((status, count, last))
            yield pd.DataFrame({"key": [key[0]], "status": [status], "retry_count": pd.array([count], "Int32"), "attempt": [last]})

    def _take_members(self, now: dict[str, str]) -> None:
        old = {k[0]: v[1] for k, v in self.members.iterator()} if self.members.exists() else {}
        for member in old.keys() - now.keys():
            self.members.removeKey((member,))
        for member, outcome in now.items():
            tried = old.get(member)
            self.members.updateValue((member,), (outcome, None if outcome == "done" else (-1 if tried is None else tried) + 1))

    def close(self) -> None:
        pass


def follow(spark: SparkSession, source: str, checkpoint: str, changes: str, fmt: str = "parquet", max_files: int | None = None) -> None:
    """Takes in all files of attempts (ATTEMPT) that the checkpoint hasn't seen and ends. Each batch writes the items that it changed to a
    folder of its own below changes; a batch that is replayed writes it again."""
    stream = ready(spark).readStream.schema(ATTEMPT).format(fmt)
    if max_files:
        stream = stream.option("maxFilesPerTrigger", max_files)
    before = spark.conf.get(_STORE, None)
    spark.conf.set(_STORE, _ROCKS)
    try:
        told = stream.load(source).where("key is not null and attempt is not null").groupBy("key").transformWithStateInPandas(Attempts(), CHANGED, "Update", "None")

        def keep(batch: DataFrame, epoch: int) -> None:
            batch.write.mode("overwrite").parquet(f"{changes}/epoch={epoch}")

        told.writeStream.outputMode("update").trigger(availableNow=True).option("checkpointLocation", checkpoint).foreachBatch(keep).start().awaitTermination()
    finally:
        spark.conf.set(_STORE, before) if before else spark.conf.unset(_STORE)


def state(spark: SparkSession, checkpoint: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(items, members, history) as the checkpoint's last batch left them: (key, status, retry_count, attempt), (key, member, outcome,
    retry_count) and (key, attempt, event, error)."""

    def read(name: str) -> DataFrame:
        return spark.read.format("statestore").option("path", checkpoint).option("stateVarName", name).load()

    items = read("item").select("key.key", "value.*")
    members = read("members").select(F.col("key.key").alias("key"), F.col("user_map_key.member").alias("member"), "user_map_value.*")
    history = read("history").select(F.col("key.key").alias("key"), "list_element.*")
    return items, members, history
