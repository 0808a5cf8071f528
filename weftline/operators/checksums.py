"""What differs between two versions of a table, by a tree of checksums.

Each row has two 64-bit hashes of its values; sums of them by bucket of the key's hash don't depend on the order of rows and
do on how often a row occurs. Leaves are FAN * FAN buckets, and FAN nodes of FAN leaves stand above them. Nodes are compared
first, then the leaves below nodes that differ; only rows in leaves that differ are compared key by key. Equal tables are
told by their trees alone, and rows of a few changes by a filtered scan and a small exchange, where two set differences
would shuffle all rows of both.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FAN = 256
SUMS = ["n", "s1", "s2", "s3", "s4"]


@dataclass(frozen=True)
class Tree:
    nodes: DataFrame
    leaves: DataFrame


def row_hash(columns: list[str], seed: int) -> Column:
    """64-bit hash of values and of which of them are null (xxhash64 alone skips nulls)."""
    return F.xxhash64(F.lit(seed), *(F.col(c) for c in columns), *(F.col(c).isNull() for c in columns))


def leaf_of(key: list[str]) -> Column:
    return F.pmod(row_hash(key, 0), F.lit(FAN * FAN)).cast("int")


def sums(columns: list[str]) -> list[Column]:
    """Count and sums of the 32-bit halves of both hashes: as bigint they are exact for 2^31 rows of a group."""
    half = [f(row_hash(columns, seed)) for seed in (1, 2) for f in (lambda h: h.bitwiseAND(0xFFFFFFFF), lambda h: F.shiftrightunsigned(h, 32))]
    return [F.count("*").alias("n"), *(F.sum(h).alias(name) for h, name in zip(half, SUMS[1:], strict=True))]


def _added(rows: DataFrame, *by: str) -> DataFrame:
    return rows.groupBy(*by).agg(*(F.sum(c).alias(c) for c in SUMS))


def tree(rows: DataFrame, key: list[str]) -> Tree:
    """Sums of all of rows' columns (any order of columns). Each task sums its own rows first, so a hot key is no hot task."""
    leaves = rows.groupBy(leaf_of(key).alias("leaf")).agg(*sums(sorted(rows.columns))).withColumn("node", F.floor(F.col("leaf") / FAN).cast("int"))
    return Tree(_added(leaves, "node"), leaves)


def written(spark: SparkSession, it: Tree, folder: str) -> Tree:
    """The tree as two small tables, leaves sorted by node, so that those of a few nodes are read alone."""
    it.leaves.repartitionByRange("node", "leaf").sortWithinPartitions("node", "leaf").write.parquet(f"{folder}/leaves")
    leaves = spark.read.parquet(f"{folder}/leaves")
    _added(leaves, "node").write.parquet(f"{folder}/nodes")
    return opened(spark, folder)


def opened(spark: SparkSession, folder: str) -> Tree:
    return Tree(spark.read.parquet(f"{folder}/nodes"), spark.read.parquet(f"{folder}/leaves"))


def _unequal(a: DataFrame, b: DataFrame, by: str) -> DataFrame:
    """by of rows that only one has or whose sums differ."""
    both = a.select(by, F.struct(*SUMS).alias("_a")).join(b.select(by, F.struct(*SUMS).alias("_b")), by, "full")
    return both.where(~F.col("_a").eqNullSafe(F.col("_b"))).select(by)


def differing(a: Tree, b: Tree) -> DataFrame:
    """Leaves (at most FAN * FAN) that differ."""
    nodes = [r["node"] for r in _unequal(a.nodes, b.nodes, "node").collect()]  # at most FAN
    mine = [t.leaves.where(F.col("node").isin(nodes)) for t in (a, b)]
    return _unequal(*mine, "leaf")


def changes(a: DataFrame, b: DataFrame, key: list[str], trees: tuple[Tree, Tree] | None = None) -> DataFrame:
    """(key, change) for each key whose rows differ: "added" (only b has it), "removed" (only a has it) or "changed".

    a and b have the same columns. A key may have several rows; they are compared as a bag. Null keys are keys like others."""
    if sorted(a.columns) != sorted(b.columns):
        raise ValueError("tables have different columns")
    leaves = F.broadcast(differing(*(trees or (tree(a, key), tree(b, key)))))
    sides = []
    for name, rows in (("_a", a), ("_b", b)):
        found = rows.withColumn("_leaf", leaf_of(key)).join(leaves.withColumnRenamed("leaf", "_leaf"), "_leaf", "left_semi").drop("_leaf")
        sides.append(found.groupBy(*key).agg(F.struct(*sums(sorted(rows.columns))).alias(name)))
    left, right = sides[0].select(*(F.col(c).alias(f"_l{k}") for k, c in enumerate(key)), "_a"), sides[1].select(*(F.col(c).alias(f"_r{k}") for k, c in enumerate(key)), "_b")
    same = F.lit(True)
    for k in range(len(key)):
        same = same & F.col(f"_l{k}").eqNullSafe(F.col(f"_r{k}"))
    both = left.join(right, same, "full").where(~F.col("_a").eqNullSafe(F.col("_b")))
    names = [F.when(F.col("_a").isNull(), F.col(f"_r{k}")).otherwise(F.col(f"_l{k}")).alias(c) for k, c in enumerate(key)]
    return both.select(*names, F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").otherwise("changed").alias("change"))
