"""Immutable snapshots of tables, named by their content and verified when they are read.

A store holds objects and manifests. An object is the rows of one bucket (of the key's hash) in one version, named by their
checksums; a bucket that no snapshot in the store has had yet is written, any other is shared with the snapshots that have
it. A manifest lists a snapshot's objects with the size and SHA-256 of each file, and the snapshot's name is the SHA-256 of
its manifest: the same rows get the same name, and nothing can change without the name or a digest telling.

A manifest is written last and only where there is none, so a commit that is broken off leaves files that no manifest names
and nothing reads. What the driver holds is a line for each bucket, MAX_BUCKETS at most.
"""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .checksums import SUMS, row_hash, sums
from .storage import exists, hadoop

MAX_BUCKETS = 1 << 16
#: Rows of a file: a digest reads a file as one value.
FILE_ROWS = 1_000_000
_LINE = "snapshot string, kind string, bucket int, object string, rows bigint, files array<struct<path:string,size:bigint,sha256:string>>, schema string"


class Altered(ValueError):
    """A snapshot is not what its name says."""


def commit(rows: DataFrame, store: str, key: list[str], buckets: int = 64, bucket: Column | None = None) -> str:
    """Adds rows as a snapshot and returns its name. bucket: a column from 0 to buckets - 1 that follows from the key, its hash by default."""
    if not 1 <= buckets <= MAX_BUCKETS:
        raise ValueError(f"1 to {MAX_BUCKETS} buckets")
    spark, columns = rows.sparkSession, sorted(rows.columns)
    of = (F.pmod(row_hash(key, 0), F.lit(buckets)) if bucket is None else bucket).cast("int")
    schema = rows.schema.json()
    dealt = rows.withColumn("_bucket", of)
    told = dealt.groupBy("_bucket").agg(*sums(columns)).limit(buckets + 1).collect()
    names = {r["_bucket"]: hashlib.sha256(json.dumps([schema, r["_bucket"], *(r[c] for c in SUMS)]).encode()).hexdigest() for r in told}
    if len(names) > buckets or not all(b is not None and 0 <= b < buckets for b in names):
        raise ValueError("a bucket is a number from 0 to buckets - 1")
    counts = {r["_bucket"]: r["n"] for r in told}
    known = {r["object"]: [f.asDict() for f in r["files"]] for r in _lines(spark, store).where(F.col("object").isin([*names.values()])).select("object", "files").dropDuplicates(["object"]).collect()} if names else {}
    new = [b for b, name in names.items() if name not in known]
    if new:
        place = f"objects/{uuid.uuid4().hex}"
        # A bucket that a hot key makes large is dealt over tasks by the adaptive rebalance, and over files by the bound on rows.
        some = dealt.where(F.col("_bucket").isin(new)).hint("rebalance", "_bucket").sortWithinPartitions("_bucket", *key)
        some.write.option("maxRecordsPerFile", FILE_ROWS).partitionBy("_bucket").parquet(f"{store}/{place}")
        for r in _digests(spark, [f"{store}/{place}/_bucket={b}" for b in new], store).collect():
            known.setdefault(names[int(r["path"].split("/_bucket=")[1].split("/")[0])], []).append(r.asDict())
    head = {"kind": "snapshot", "schema": schema}
    body = [{"kind": "object", "bucket": b, "object": names[b], "rows": counts[b], "files": sorted(known[names[b]], key=lambda f: f["path"])} for b in sorted(names)]
    text = "".join(json.dumps(line, sort_keys=True) + "\n" for line in [head, *body])
    name = hashlib.sha256(text.encode()).hexdigest()
    at, fs = hadoop(spark, f"{store}/manifests/{name}.json")
    if not fs.exists(at):
        out = fs.create(at, False)
        out.write(bytearray(text.encode()))
        out.close()
    return name


def _lines(spark: SparkSession, store: str) -> DataFrame:
    """All manifests' lines."""
    if not exists(spark, f"{store}/manifests"):
        return spark.createDataFrame([], _LINE)
    return spark.read.schema(_LINE).json(f"{store}/manifests").withColumn("snapshot", F.regexp_extract(F.col("_metadata.file_name"), r"^([0-9a-f]+)", 1))


def _digests(spark: SparkSession, paths: list[str], store: str, hashed: bool = True) -> DataFrame:
    """(path below the store, size, sha256) of the files in some folders, or of some files."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(paths)
    path = F.regexp_extract("path", r"(objects/[^/]+/_bucket=.*)$", 1)
    return files.select(path.alias("path"), F.col("length").alias("size"), *([F.sha2("content", 256).alias("sha256")] if hashed else []))


def manifest(spark: SparkSession, store: str, name: str) -> DataFrame:
    """(kind, bucket, object, rows, files, schema) lines of a snapshot; Altered if its manifest is gone or has another digest than its name."""
    path = f"{store}/manifests/{name}.json"
    if not exists(spark, path):
        raise Altered(f"no snapshot {name}")
    text = spark.read.format("binaryFile").load(path).select(F.sha2("content", 256)).first()[0]
    if text != name:
        raise Altered(f"the manifest of {name} was altered")
    return spark.read.schema(_LINE).json(path)


def faults(spark: SparkSession, store: str, name: str) -> DataFrame:
    """(bucket, path, fault) of a snapshot's files: "missing", "size" or "altered". Sizes are told from listings; only files of the right size are read."""
    listed = manifest(spark, store, name).where("kind = 'object'").select("bucket", F.explode("files").alias("f")).select("bucket", "f.*")
    if not exists(spark, f"{store}/objects"):
        return listed.select("bucket", "path", F.lit("missing").alias("fault"))
    there = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{store}/objects").select(F.regexp_extract("path", r"(objects/[^/]+/_bucket=.*)$", 1).alias("path"), F.col("length").alias("now"))
    seen = listed.join(there, "path", "left")
    wrong = seen.where("now is null or now <> size").select("bucket", "path", F.when(F.col("now").isNull(), "missing").otherwise("size").alias("fault"))
    right = [f"{store}/{r['path']}" for r in seen.where("now = size").select("path").collect()]  # a name for each file
    if not right:
        return wrong
    digests = _digests(spark, right, store).select("path", F.col("sha256").alias("now"))
    return wrong.unionByName(listed.join(digests, "path").where("now <> sha256").select("bucket", "path", F.lit("altered").alias("fault")))


def read(spark: SparkSession, store: str, name: str, check: bool = True) -> DataFrame:
    """A snapshot's rows; Altered if any of its files isn't what the manifest says. Without check, only the manifest is verified."""
    lines = manifest(spark, store, name)
    schema = StructType.fromJson(json.loads(lines.where("kind = 'snapshot'").first()["schema"]))
    wrong = faults(spark, store, name).limit(5).collect() if check else []
    if wrong:
        raise Altered(f"{name}: {[tuple(r) for r in wrong]}")
    paths = [f"{store}/{r['path']}" for r in lines.where("kind = 'object'").select(F.explode("files.path").alias("path")).collect()]
    return spark.read.schema(schema).parquet(*paths).select(*schema.names) if paths else spark.createDataFrame([], schema)


def shared(spark: SparkSession, store: str, one: str, other: str) -> DataFrame:
    """(bucket, rows, shared) of one snapshot's objects: whether another snapshot has the same."""
    theirs = manifest(spark, store, other).where("kind = 'object'").select("object", F.lit(True).alias("_there"))
    return manifest(spark, store, one).where("kind = 'object'").join(theirs, "object", "left").select("bucket", "rows", F.coalesce("_there", F.lit(False)).alias("shared"))
