"""Collecting records from files, run by run: what is done stays done, failures are counted, history is kept.

State is three tables in one folder: items (a row for each file that is processed), events (failures and their
resolutions), records. Each run writes a folder of its own, records before items, so a lost driver never leaves a
file marked as done without its records; a run that is repeated under the same name replaces its own folder."""

from __future__ import annotations

import json
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.identity import stable_id
from ..sources import documents
from ..sources.archive import OUTCOME
from ..sources.record import RECORD
from .tables import chunks, least_loaded

ITEMS = "key string, source string, path string, n_records int"
EVENTS = "key string, source string, path string, event string, error string, retry_count int, retryable boolean, classification string"
RECORDS = f"id string, key string, source string, path string, file_position int, {RECORD}"
MEMBERS = f"key string, {OUTCOME}"
TABLES = {"items": ITEMS, "events": EVENTS, "records": RECORDS, "members": MEMBERS}


def state(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A state table with the run that wrote each row; empty before the first run."""
    schema = f"{TABLES[name]}, run string"
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", f"{folder}/{name}").parquet(f"{folder}/{name}")


def _file(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def _written_once(spark: SparkSession, path: str, text: str) -> bool:
    """Whether a small file that wasn't there is now; another writer's file stays as it is."""
    at, fs = _file(spark, path)
    try:
        out = fs.create(at, False)
    except Exception:  # noqa: BLE001  the store's own error for a file that is there
        if fs.exists(at):
            return False
        raise
    out.write(bytearray(text.encode()))
    out.close()
    return True


def _content(spark: SparkSession, path: str) -> str:
    return bytes(spark.read.format("binaryFile").load(path).first()["content"]).decode()


def claim(spark: SparkSession, folder: str, owner: str) -> None:
    """A state folder belongs to the owner that claims it first; any other is an error."""
    if not _written_once(spark, f"{folder}/owner.txt", owner) and _content(spark, f"{folder}/owner.txt") != owner:
        raise ValueError(f"{folder} belongs to another owner")


@contextmanager
def locked(spark: SparkSession, folder: str, owner: str) -> Iterator[None]:
    """Holds a folder's lock. A lock that another run holds is an error; one that a lost driver left must be deleted by hand."""
    claim(spark, folder, owner)
    if not _written_once(spark, f"{folder}/lock.txt", owner):
        raise ValueError(f"{folder} is in use")
    try:
        yield
    finally:
        at, fs = _file(spark, f"{folder}/lock.txt")
        fs.delete(at, False)


def finalize(spark: SparkSession, folder: str, run: str) -> None:
    """Makes a folder's state final: no later run may add to it."""
    if not _written_once(spark, f"{folder}/final.txt", run):
        raise ValueError(f"{folder} is final already")


def log(spark: SparkSession, folder: str, run: str, event: str, **told) -> None:
    """Adds an event to a folder's log, a JSON file for each; a run's event of one name is written once."""
    _written_once(spark, f"{folder}/log/{run}-{event}.json", json.dumps({"run": run, "event": event, **told}, sort_keys=True, ensure_ascii=False) + "\n")


def log_rows(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema("run string, event string, files bigint, failed bigint").json(f"{folder}/log")


def failures(events: DataFrame) -> DataFrame:
    """Files whose latest event is a failure. Runs must be named in ascending order."""
    last = events.groupBy("key").agg(F.max_by(F.struct("source", "path", "event", "error", "retry_count", "retryable", "classification"), F.struct("run", F.col("event") == "resolved")).alias("e"))
    return last.select("key", "e.*").where("event = 'failure'")


def collect(spark: SparkSession, files: DataFrame, folder: str, run: str, retry: bool = False, layouts: dict | None = None) -> None:
    """Processes files (source, path, content) that are neither processed nor, unless retry, failed. Ids of records that are there are never overwritten.

    run: a name greater than those of earlier runs. Repeated files within a run count once. A folder that is final is an error."""
    at, fs = _file(spark, f"{folder}/final.txt")
    if fs.exists(at):
        raise ValueError(f"{folder} is final")
    mine = F.col("run") != run
    done = state(spark, folder, "items").where(mine).select("key")
    open_ = failures(state(spark, folder, "events").where(mine))
    todo = files.withColumn("key", F.concat_ws(":", "source", "path")).dropDuplicates(["key"]).join(done, "key", "left_anti")
    todo = todo.join(open_.select("key", F.col("retry_count").alias("_tries")), "key", "left")
    if not retry:
        todo = todo.where("_tries is null")
    # Parsed once and kept in the run's folder: the tables below are views of it.
    staged = f"{folder}/_staged/{run}"
    documents.parse_documents(todo, F.col("path"), F.col("content"), layouts).drop("content").select("key", "source", "path", "_tries", "parsed").write.mode("overwrite").parquet(staged)
    parsed = spark.read.parquet(staged)
    good = F.col("parsed.error").isNull()
    new = documents.records(parsed.where(good), ["key", "source", "path"]).withColumn("id", stable_id(F.col("source"), F.col("path"), F.col("file_position").cast("string")))
    new = new.join(state(spark, folder, "records").where(mine).select("id"), "id", "left_anti")
    failed = parsed.where(~good).select(
        "key", "source", "path", F.lit("failure").alias("event"), F.col("parsed.error").alias("error"), (F.coalesce("_tries", F.lit(-1)) + 1).cast("int").alias("retry_count"),
        F.col("parsed.retryable").alias("retryable"), F.when(F.col("parsed.no_records"), "NOT_A_RECIPE_SOURCE").alias("classification"),
    )
    resolved = parsed.where(good & F.col("_tries").isNotNull()).select("key", "source", "path", F.lit("resolved").alias("event"), F.lit(None).cast("string").alias("error"), F.col("_tries").alias("retry_count"), F.lit(False).alias("retryable"), F.lit(None).cast("string").alias("classification"))
    members = parsed.select("key", F.explode("parsed.outcomes").alias("o")).select("key", "o.*")
    items = parsed.where(good).select("key", "source", "path", F.size("parsed.records").alias("n_records"))
    for name, rows in (("records", new), ("members", members), ("events", failed.unionByName(resolved)), ("items", items)):
        columns = [f.name for f in spark.createDataFrame([], TABLES[name]).schema]
        rows.select(*columns).write.mode("overwrite").parquet(f"{folder}/{name}/run={run}")
    told = parsed.agg(F.count("*").alias("files"), F.count_if(~good).alias("failed")).first()
    log(spark, folder, run, "collected", files=told["files"], failed=told["failed"])


def manifest(discovered: DataFrame, items: DataFrame, events: DataFrame) -> DataFrame:
    """(source, discovered, processed, failed, pending, records, complete) for each source of discovered (source, path)."""
    keyed = discovered.select("source", F.concat_ws(":", "source", "path").alias("key")).distinct()
    rows = keyed.join(items.select("key", "n_records"), "key", "left").join(failures(events).select("key", F.lit(True).alias("_failed")), "key", "left")
    done, bad = F.col("n_records").isNotNull(), F.col("n_records").isNull() & F.col("_failed")
    out = rows.groupBy("source").agg(F.count("*").alias("discovered"), F.count_if(done).alias("processed"), F.count_if(bad).alias("failed"), F.coalesce(F.sum("n_records"), F.lit(0)).cast("bigint").alias("records"))
    pending = F.col("discovered") - F.col("processed") - F.col("failed")
    return out.withColumns({"pending": pending, "complete": pending == 0})


def recovery_audit(before: DataFrame, items: DataFrame, events: DataFrame) -> DataFrame:
    """(key, outcome, error): what became of earlier failures: recovered, failed again, or not tried since."""
    now = failures(events).select("key", F.col("error").alias("now"))
    rows = before.select("key").distinct().join(items.select("key", F.lit(True).alias("_done")), "key", "left").join(now, "key", "left")
    return rows.select("key", F.when(F.col("_done"), "recovered").when(F.col("now").isNotNull(), "failed").otherwise("pending").alias("outcome"), F.when(F.col("_done").isNull(), F.col("now")).alias("error"))


def snapshot_status(discovery_complete: Column, pending: Column, failed: Column, blocked: Column) -> Column:
    """A snapshot is final only where discovery ended and every item is accounted for."""
    final = discovery_complete & (pending == 0)
    return F.when(blocked, "blocked").when(~final, "incomplete").when(failed > 0, "complete-with-failures").otherwise("complete")


def snapshot(discovered: DataFrame, outcomes: list[DataFrame], source: str = "source", url: str = "url") -> DataFrame:
    """(source, discovered, fetched, failed, blocked, pending, status) of a collection whose parts ran side by side.

    discovered: (source, url, complete), complete being true where discovery ended; outcomes: each part's (url, outcome). A URL
    that several parts report counts once, by its best outcome; what nobody reports is pending. A source is final only
    where discovery ended and nothing is pending."""
    rank = F.when(F.col("outcome").isin("fetched", "cached"), 0).when(F.col("outcome") == "blocked", 1).otherwise(2)
    reported = reduce(DataFrame.unionByName, [p.select(url, "outcome") for p in outcomes]).groupBy(url).agg(F.min(rank).alias("_rank"))
    wanted = discovered.groupBy(source, url).agg(F.bool_and(F.coalesce("complete", F.lit(False))).alias("complete"))
    rows = wanted.join(reported, url, "left").groupBy(source).agg(
        F.count("*").alias("discovered"), F.count_if(F.col("_rank") == 0).alias("fetched"), F.count_if(F.col("_rank") == 2).alias("failed"), F.count_if(F.col("_rank") == 1).alias("blocked"),
        F.count_if(F.col("_rank").isNull()).alias("pending"), F.bool_and("complete").alias("_complete"),
    )
    status = snapshot_status(F.col("_complete"), F.col("pending"), F.col("failed"), F.col("blocked") == F.col("discovered"))
    return rows.withColumn("status", status).drop("_complete")


def extended_plan(plan: DataFrame, candidates: DataFrame, revisions: DataFrame, size: int, agents: int) -> DataFrame:
    """New (source, path, revision, agent) rows for candidates (source, path, revision) that no agent owns yet.

    plan: what is owned, with agent; revisions: (source, revision) as pinned. A source at another revision than its
    pinned one fails the plan. Chunks of a source's paths go, in turn, to agents from the least loaded one on."""
    moved = candidates.join(revisions.withColumnRenamed("revision", "_pinned"), "source").where("revision <> _pinned").select("source").distinct().orderBy("source").limit(5).collect()
    if moved:
        raise ValueError(f"sources left their pinned revision: {[r['source'] for r in moved]}")
    new = candidates.join(plan.select("source", "path").distinct(), ["source", "path"], "left_anti").dropDuplicates(["source", "path"])
    cut = chunks(new, size, ["source"], F.col("path")).withColumn("unit", F.concat_ws("#", "source", F.col("chunk").cast("string")))
    owned = {r["agent"]: r["n"] for r in plan.groupBy("agent").agg(F.count("*").alias("n")).collect()}
    units = cut.groupBy("unit").agg(F.count("*").alias("size"))
    bins = least_loaded(units, "unit", "size", agents, start=[owned.get(k, 0) for k in range(agents)])
    return cut.join(bins, "unit").select("source", "path", "revision", F.col("bin").alias("agent"))
