"""Global row numbers and pages without a one-task sort.

Rows are dealt into ranges of the order by sampled bounds, sorted within each range and written once; counts for each
range, summed up from the first one on, turn a row's place within its range into its number in the whole. A page is read by
the ranges and places it covers, which reach the scan as filters, so a late page costs no more than the first one.

The order must be total (end with a unique key): numbers of ties would differ from one run to the next, and rows that are
equal in the order could not be split into ranges.
"""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass
from functools import reduce
from itertools import accumulate
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

RANGE, PLACE = "_range", "_place"


def placed(rows: DataFrame, *columns: Column | str) -> DataFrame:
    """Columns of a table that is read from files, with file (a number in the order of paths) and row (a place in the file).

    One row for each file is numbered and broadcast, so that no row carries a path through an exchange or a sort."""
    path = F.col("_metadata.file_path").alias("_path")
    files = rows.select(path).distinct().select("_path", F.row_number().over(Window.orderBy("_path")).alias("file"))
    return rows.select(*columns, path, F.col("_metadata.row_index").alias("row")).join(F.broadcast(files), "_path").drop("_path")


def in_order(rows: DataFrame, order: list[Column], ranges: int | None = None) -> DataFrame:
    """rows dealt into ascending ranges, each sorted: written out, they are files whose names follow the order."""
    return (rows.repartitionByRange(ranges, *order) if ranges else rows.repartitionByRange(*order)).sortWithinPartitions(*order)


@dataclass(frozen=True)
class Numbered:
    """A table written in order, with the range and the place within it of each row, and the rows before each range."""

    table: DataFrame
    before: dict[int, int]
    total: int

    def rows(self, number: str = "number") -> DataFrame:
        """All rows with their numbers, from 1 on. One small row for each range is broadcast."""
        starts = self.table.sparkSession.createDataFrame(list(self.before.items()), f"{RANGE} bigint, _before bigint")
        return self.table.join(F.broadcast(starts), RANGE).withColumn(number, F.col("_before") + F.col(PLACE) + 1).drop(RANGE, PLACE, "_before")

    def between(self, first: int, last: int, number: str = "number") -> DataFrame:
        """Rows with numbers from first to last."""
        covered = [(r, max(0, first - 1 - b), min(n, last - b)) for r, b, n in self._ranges() if b < last and b + n >= first]
        return self._picked([(r, F.col(PLACE).between(low, high - 1)) for r, low, high in covered], number)

    def page(self, number: int, size: int = 120) -> DataFrame:
        """The page of that number, held to the first and last, with position, page and pages."""
        pages = max(1, -(-self.total // size))
        number = min(max(1, number), pages)
        return self.between((number - 1) * size + 1, number * size, "position").withColumns({"page": F.lit(number), "pages": F.lit(pages)})

    def pick(self, numbers: list[int], number: str = "number") -> DataFrame:
        """Rows of some numbers, a bounded list."""
        ranges = self._ranges()
        starts = [b for _, b, _ in ranges]
        places: dict[int, list[int]] = {}
        for n in sorted(set(numbers)):
            if 1 <= n <= self.total:
                r, b, _ = ranges[bisect_right(starts, n - 1) - 1]
                places.setdefault(r, []).append(n - 1 - b)
        return self._picked([(r, F.col(PLACE).isin(some)) for r, some in places.items()], number)

    def _ranges(self) -> list[tuple[int, int, int]]:
        """(range, rows before it, rows in it), all of them with rows."""
        known = sorted(self.before.items())
        ends = [*(b for _, b in known[1:]), self.total][: len(known)]
        return [(r, b, e - b) for (r, b), e in zip(known, ends, strict=True)]

    def _picked(self, wanted: list[tuple[int, Column]], number: str) -> DataFrame:
        chosen = reduce(or_, ((F.col(RANGE) == r) & place for r, place in wanted), F.lit(False))
        before = reduce(lambda c, r: c.when(F.col(RANGE) == r[0], self.before[r[0]]), wanted[1:], F.when(F.col(RANGE) == wanted[0][0], self.before[wanted[0][0]])) if wanted else F.lit(0)
        return self.table.where(chosen).withColumn(number, before + F.col(PLACE) + 1).drop(RANGE, PLACE)


def number(rows: DataFrame, order: list[Column], folder: str, ranges: int | None = None, keep: list[str] | None = None) -> Numbered:
    """Writes rows (their columns in keep, else all) in order to a folder and numbers them. What the driver holds is a count for each range."""
    placed = in_order(rows, order, ranges).select(*(keep or rows.columns), F.monotonically_increasing_id().alias(PLACE))
    placed.select("*", F.shiftrightunsigned(PLACE, 33).alias(RANGE)).withColumn(PLACE, F.col(PLACE).bitwiseAND((1 << 33) - 1)).write.parquet(folder)
    return opened(rows.sparkSession, folder)


def opened(spark: SparkSession, folder: str) -> Numbered:
    """A numbered table from its folder."""
    table = spark.read.parquet(folder)
    counts = {r[RANGE]: r["n"] for r in table.groupBy(RANGE).agg(F.count("*").alias("n")).collect()}
    ends = list(accumulate(counts[r] for r in sorted(counts)))
    return Numbered(table, dict(zip(sorted(counts), [0, *ends[:-1]], strict=True)) if counts else {}, ends[-1] if ends else 0)


def within_groups(rows: DataFrame, group: list[str], order: list[Column], folder: str, place: str = "place") -> DataFrame:
    """rows with each row's number within its group, from 1 on, in an order that is total within a group.

    Rows are numbered as a whole by group and order, and a group's first number, a sum of tasks, is taken off: a hot group
    is dealt over ranges like any other rows, where a window would sort it in one task."""
    whole = number(rows, [*(F.col(c) for c in group), *order], folder).rows("_number")
    starts = whole.groupBy(*group).agg(F.min("_number").alias("_start"))
    same = reduce(lambda a, b: a & b, (F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in group))
    return whole.alias("a").join(starts.alias("b"), same).select(*(F.col(f"a.{c}") for c in rows.columns), (F.col("a._number") - F.col("b._start") + 1).alias(place))


def chunks(rows: DataFrame, size: int, group: list[str], order: list[Column], folder: str) -> DataFrame:
    """rows with chunk: each group's rows in order, cut into chunks of so many, from 0 on."""
    return within_groups(rows, group, order, folder, "_place").withColumn("chunk", F.floor((F.col("_place") - 1) / size).cast("bigint")).drop("_place")


def dealt(rows: DataFrame, bins: int, order: list[Column], folder: str) -> DataFrame:
    """rows with bin: dealt one by one, in order, over so many bins (as many as there are rows, if these are fewer)."""
    it = number(rows, order, folder)
    return it.rows("_number").withColumn("bin", ((F.col("_number") - 1) % max(1, min(bins, it.total))).cast("int")).drop("_number")
