"""Reports with subtotals, audits that are kept up to date file by file, and bounded lists of examples."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import exists


def histograms(rows: DataFrame, source: str, dimensions: list[str], measures: dict[str, Column] | None = None) -> DataFrame:
    """(source, dimension, value, n, measures) in one aggregation by grouping sets: for each source and dimension the count of every value,
    for each source and over all sources the same for each dimension, and totals (dimension null). is_total tells rows over all
    sources from those of a null source."""
    sets = [[source, d] for d in dimensions] + [[d] for d in dimensions] + [[source], []]
    out = rows.groupingSets(sets, source, *dimensions).agg(
        F.grouping(source).alias("_all"), *(F.grouping(d).alias(f"_g_{d}") for d in dimensions), F.count("*").alias("n"), *(c.alias(name) for name, c in (measures or {}).items())
    )
    dimension, value = F.lit(None).cast("string"), F.lit(None).cast("string")
    for d in dimensions:
        dimension = F.when(F.col(f"_g_{d}") == 0, d).otherwise(dimension)
        value = F.when(F.col(f"_g_{d}") == 0, F.col(d).cast("string")).otherwise(value)
    return out.select(source, (F.col("_all") == 1).alias("is_total"), dimension.alias("dimension"), value.alias("value"), "n", *(measures or {}))


def first_values(rows: DataFrame, group: list[str], lists: dict[str, tuple[str, int]], distinct: bool = True) -> DataFrame:
    """(group, n, name, ..., name): of each list's column the first k values in their order, from name to (column, k); null values are left out.

    Values are sorted and cut to k of a group in every task before they are sent, and again after, so a hot group costs
    k rows a task and a list never grows beyond k. distinct: equal values count once, told in the tasks too."""
    counted = rows.groupBy(*group).agg(F.count("*").alias("n"))
    parts = []
    for name, (column, k) in lists.items():
        values = rows.select(*group, F.col(column).alias("_v")).where("_v is not null")
        values = values.groupBy(*group, "_v").agg(F.lit(1).alias("_n")) if distinct else values
        order = F.struct("_v")
        ranked = values.withColumn("_r", F.expr(f"row_number() over (partition by {', '.join(f'`{g}`' for g in group)} order by _v)")).where(F.col("_r") <= k)
        parts.append(ranked.groupBy(*group).agg(F.transform(F.sort_array(F.collect_list(order)), lambda x: x["_v"]).alias(name)))

    def with_list(out: DataFrame, part: DataFrame) -> DataFrame:
        name = part.columns[-1]
        keys = [F.col(f"a.{g}").eqNullSafe(F.col(f"b.{g}")) for g in group]
        both = out.alias("a").join(part.alias("b"), reduce(lambda x, y: x & y, keys), "left")
        return both.select(*(F.col(f"a.{c}") for c in out.columns), F.coalesce(F.col(f"b.{name}"), F.array().cast(part.schema[name].dataType)).alias(name))

    return reduce(with_list, parts, counted)


class Audit:
    """Aggregates over the files of a folder that are kept for each file, so that an update reads new and replaced files only.

    group: columns or expressions by name; sums, lows and highs: what is added up, and of what the least and greatest value
    count. A file is known by path, size and time. Every update writes a folder of its own below state: which files it
    took in or found gone, and their partial aggregates. What counts is each file's latest entry, so an update that is
    repeated after a failure, under the number of the one that failed, replaces it."""

    def __init__(self, spark: SparkSession, folder: str, state: str, group: dict[str, Column], sums: dict[str, Column], lows: dict[str, Column] | None = None, highs: dict[str, Column] | None = None, fmt: str = "parquet"):
        self.spark, self.folder, self.state, self.fmt = spark, folder, state, fmt
        self.group, self.sums, self.lows, self.highs = group, sums, lows or {}, highs or {}

    def _files(self) -> DataFrame:
        files = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "[!_.]*").load(self.folder)
        return files.select(F.regexp_replace("path", "^file:/+", "file:/").alias("file"), F.concat_ws("/", "length", F.unix_micros("modificationTime")).alias("stamp"))

    def known(self, before: int | None = None) -> DataFrame:
        """(file, stamp, step) of every file's latest entry, of steps before one if that is given; the stamp of a file that is gone is null."""
        if not exists(self.spark, f"{self.state}/files"):
            return self.spark.createDataFrame([], "file string, stamp string, step int")
        rows = self.spark.read.schema("file string, stamp string, step int").parquet(f"{self.state}/files").where(F.lit(True) if before is None else F.col("step") < before)
        return rows.groupBy("file").agg(F.max_by(F.struct("stamp", "step"), "step").alias("x")).select("file", "x.*")

    def update(self, step: int, schema=None) -> tuple[int, int]:
        """(files read, files gone) since the last step; steps count up."""
        now = self._files().alias("now").join(self.known(step).alias("old"), "file", "full").select("file", F.col("now.stamp").alias("stamp"), F.col("old.stamp").alias("old"))
        changed = now.where("not (stamp <=> old)").select("file", "stamp").withColumn("step", F.lit(step)).cache()
        try:
            new = [r["file"] for r in changed.where("stamp is not null").select("file").collect()]  # what is new, not all there is
            gone = changed.where("stamp is null").count()
            if new:
                reader = self.spark.read.format(self.fmt)
                rows = (reader.schema(schema) if schema else reader).load(new)
                part = rows.groupBy(F.regexp_replace(F.col("_metadata.file_path"), "^file:/+", "file:/").alias("file"), *(c.alias(n) for n, c in self.group.items())).agg(
                    F.count("*").alias("n"), *(F.sum(c).alias(n) for n, c in self.sums.items()), *(F.min(c).alias(n) for n, c in self.lows.items()), *(F.max(c).alias(n) for n, c in self.highs.items())
                )
                part.write.mode("overwrite").parquet(f"{self.state}/parts/step={step}")
            # Files are entered last: partial aggregates without an entry don't count.
            changed.drop("step").write.mode("overwrite").parquet(f"{self.state}/files/step={step}")
            return len(new), gone
        finally:
            changed.unpersist()

    def result(self) -> DataFrame:
        """(group, n, sums, lows, highs) over all files as of the last update."""
        current = self.known().where("stamp is not null").select("file", "step")
        parts = self.spark.read.option("basePath", f"{self.state}/parts").parquet(f"{self.state}/parts").join(current, ["file", "step"])
        return parts.groupBy(*self.group).agg(
            F.sum("n").alias("n"), *(F.sum(n).alias(n) for n in self.sums), *(F.min(n).alias(n) for n in self.lows), *(F.max(n).alias(n) for n in self.highs)
        )
