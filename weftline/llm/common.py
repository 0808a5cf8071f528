"""Plumbing that the operators share: reading tables, cutting lineage, Arrow maps."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator
from functools import reduce
from operator import or_
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows that a Python worker holds at a time; texts are long, so Spark's default would hold tens of MB on both sides.
BATCH_ROWS = "1024"
ROOT = str(Path(__file__).resolve().parents[2])


def ready(spark: SparkSession) -> SparkSession:
    """Lets Python workers import this package, also where the driver found it by sys.path alone, and bounds their batches."""
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", ""):
        env["PYTHONPATH"] = ":".join(x for x in (ROOT, env.get("PYTHONPATH", "")) if x)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ready(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: the one that the cluster names, else the warehouse.

    A warehouse on one machine's disk serves a local master only; on a cluster it is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    root = named or spark.conf.get("spark.sql.warehouse.dir")
    if not named and not spark.sparkContext.master.startswith("local"):
        path = spark._jvm.org.apache.hadoop.fs.Path(root)
        if path.getFileSystem(spark._jsc.hadoopConfiguration()).getScheme() == "file":
            raise ValueError("set spark.checkpoint.dir: the warehouse is a folder of the driver's machine")
    return root


#: Folders that written() made and nothing has deleted yet, oldest first.
_made: list[str] = []


def written(df: DataFrame, what: str = "table") -> DataFrame:
    """df as a Parquet table in the shared folder: lineage is cut, and lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/weftline/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _made.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._weftline_path = path
    return out


def dropped(spark: SparkSession, *tables: DataFrame) -> None:
    """Deletes what written() made, once nothing reads it."""
    for table in tables:
        _delete(spark, table._weftline_path)


def dropped_but(spark: SparkSession, kept: DataFrame, since: int = 0) -> None:
    """Deletes all that written() made after the first `since` tables, but for one."""
    for path in list(_made[since:]):
        if path != kept._weftline_path:
            _delete(spark, path)


def n_written() -> int:
    return len(_made)


def _delete(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    if path in _made:
        _made.remove(path)


def fresh(name: str, columns: list[str]) -> str:
    """name, with as many leading underscores as keep it apart from columns."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


#: A key with more than this share (1 / PIECES) of a join's rows is cut into pieces.
PIECES = 256


def spread_join(big: DataFrame, small: DataFrame, on: list[str], rows: str, total: int, how: str = "inner", counted: DataFrame | None = None, mark: str | None = None) -> DataFrame:
    """big joined with small, which has a row for each key; a hot key's rows go to several tasks.

    rows: small's column that says how many rows of big have the key, dropped afterwards. total: big's rows, or
    more. A key of more than total / PIECES rows is cut into pieces of that size. There are at most PIECES such
    keys, which bounds their broadcast, and small grows by at most 2 * PIECES rows. big's rows must differ, as a
    hash of the whole row, or of its column mark, chooses its piece; rows with a null key are spread too.
    counted: on and rows of all keys of big, where an outer join's small lacks some."""
    spread, salt = fresh("_spread", [*big.columns, *small.columns]), fresh("_salt", [*big.columns, *small.columns])
    size = max(1, -(-total // PIECES))
    many = F.ceil(F.col(rows) / F.lit(size)).cast("int")
    hot = (small if counted is None else counted).where(F.col(rows) > size).select(*on, many.alias(spread))
    no_key = reduce(or_, (F.col(c).isNull() for c in on))
    piece = F.when(no_key, PIECES).otherwise(F.coalesce(F.col(spread), F.lit(1)))
    left = big.join(F.broadcast(hot), on, "left").withColumn(salt, F.pmod(F.xxhash64(*(big.columns if mark is None else [mark])), piece).cast("int")).drop(spread)
    copies = F.sequence(F.lit(0), F.when(F.col(rows) > size, many).otherwise(1) - 1)
    right = small.withColumn(salt, F.explode(copies)).drop(rows)
    return left.join(right, [*on, salt], how).drop(salt)


def release() -> None:
    """Gives the memory that a task's arrays left behind back to the system: Python workers live on through later stages."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc has it
        trim(0)


def map_columns(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], Iterator[tuple]]], added: dict[str, str], keep: list[str] | None = None) -> DataFrame:
    """df's columns (those in keep, else all) and added ones (name to Spark type), from a function on Arrow batches.

    make() is called once in each task; its function yields (first row, last row + 1, arrays) for consecutive
    pieces of a batch. An added column replaces one of the same name."""
    kept = [c for c in (df.columns if keep is None else keep) if c not in added]
    schema = T.StructType([df.schema[c] for c in kept])
    for name, kind in added.items():
        schema = schema.add(name, T.DataType.fromDDL(kind))

    def run(batches):
        f = make()
        for batch in batches:
            if batch.num_rows:
                own = [batch.schema.get_field_index(c) for c in kept]
                for i, j, arrays in f(batch):
                    part = batch.slice(i, j - i)
                    yield pa.RecordBatch.from_arrays([*(part.column(k) for k in own), *arrays], names=[*kept, *added])
                    del part, arrays
        f = batch = None
        release()

    return df.mapInArrow(run, schema)


def held_out(modulus: int, remainder: int = 0):
    """True where crc32 of doc_id as text leaves that remainder by the modulus; a null id counts as the text ''."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % modulus == remainder
