"""Relational operators over record tables: shards, duplicates, pending work, plans, catalogs, audits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Units of a plan that least_loaded deals on the driver.
MAX_UNITS = 1_000_000


def merge_shards(shards: list[DataFrame], key: str) -> tuple[DataFrame, DataFrame]:
    """(merged, conflicts): one row for each key on whose row all shards agree, and the keys whose shards disagree (key, versions).

    Rows are compared as JSON with their nulls in place, so values that stand in different columns differ. A key in
    conflict has no row in merged: none of its versions is the right one. Null keys are one key."""
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), shards)
    mark = F.sha2(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}), 256)
    versions = rows.withColumn("_mark", mark).groupBy(key, "_mark").agg(F.first(F.struct(*rows.columns)).alias("_row"))
    counted = versions.groupBy(key).agg(F.count("*").alias("versions"), F.first("_row").alias("_row"))
    return counted.where("versions = 1").select("_row.*"), counted.where("versions > 1").select(key, "versions")


def union_sorted(parts: list[DataFrame], *sort: Column) -> DataFrame:
    """All parts' rows, columns that one lacks as null, in the given order; ties stay in the order of the parts."""
    marked = [p.withColumn("_part", F.lit(k)) for k, p in enumerate(parts)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), marked).orderBy(*sort, "_part").drop("_part")


def share(rows: DataFrame, group: list[str], ok: Column) -> DataFrame:
    """(group, coverage, covered, n): the share of each group's rows for which a condition holds; null counts as not."""
    yes = F.coalesce(ok, F.lit(False))
    return rows.groupBy(*group).agg(F.round(F.avg(yes.cast("double")), 6).alias("coverage"), F.count_if(yes).alias("covered"), F.count("*").alias("n"))


def greatest_of_each(rows: DataFrame, group: list[str], amount: str, name: str) -> DataFrame:
    """(group, name, amount) of the greatest amount in each group, of equal ones the greater name; null amounts only where there is no other."""
    best = F.max(F.struct(F.col(amount).isNotNull().alias("known"), F.col(amount), F.col(name)))
    return rows.groupBy(*group).agg(best.alias("_best")).select(*group, F.col(f"_best.{name}").alias(name), F.col(f"_best.{amount}").alias(amount))


def most_frequent(rows: DataFrame, column: str, k: int) -> DataFrame:
    """(column, n): the k most frequent values, ties in their order; each task keeps k of its sums."""
    return rows.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column).limit(k)


def duplicate_groups(records: DataFrame, fingerprint: str, key: str) -> DataFrame:
    """(fingerprint, representative, ids, size): exact duplicates; the least id represents."""
    return records.groupBy(fingerprint).agg(F.min(key).alias("representative"), F.sort_array(F.collect_list(key)).alias("ids"), F.count("*").alias("size"))


def duplicate_members(records: DataFrame, fingerprint: str, key: str) -> DataFrame:
    """(fingerprint, key, representative): membership as rows, so that a group of any size is never one value."""
    first = records.groupBy(fingerprint).agg(F.min(key).alias("representative"), F.count("*").alias("_size")).where("_size > 1").drop("_size")
    return records.select(fingerprint, key).join(first, fingerprint)


def duplicate_manifest(groups: DataFrame) -> DataFrame:
    return groups.agg(F.count("*").alias("groups"), F.count_if(F.col("size") > 1).alias("multi_member_groups"), F.coalesce(F.sum(F.col("size") - 1), F.lit(0)).cast("bigint").alias("duplicate_records"))


def discovery_representative(records: DataFrame, title: Column, order: list[Column], eligible: Column | None = None) -> DataFrame:
    """records with discovery_representative: the first eligible one of each title."""
    eligible = F.lit(True) if eligible is None else eligible
    w = Window.partitionBy(title, eligible).orderBy(*order)
    return records.withColumn("discovery_representative", eligible & (F.row_number().over(w) == 1))


def pending(discovered: DataFrame, processed: DataFrame, failures: DataFrame, key: str, retry: bool = False) -> DataFrame:
    """discovered without processed, and without failures unless they are retried."""
    out = discovered.join(processed.select(key).distinct(), key, "left_anti")
    return out if retry else out.join(failures.select(key).distinct(), key, "left_anti")


def ownership_collisions(claims: DataFrame, key: str, owner: str) -> DataFrame:
    return claims.groupBy(key).agg(F.count_distinct(owner).alias("owners")).where("owners > 1")


def orphans(rows: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    return rows.join(parents.select(key).distinct(), key, "left_anti")


def round_robin(rows: DataFrame, n: int, *order: Column) -> DataFrame:
    """rows with bin: dealt in order over at most n bins. For plans (units of work), not for bulk rows: the order is global."""
    count = F.count("*").over(Window.partitionBy())
    return rows.withColumn("bin", ((F.row_number().over(Window.orderBy(*order)) - 1) % F.least(F.lit(n), count)).cast("int"))


def chunks(rows: DataFrame, size: int, group: list[str], *order: Column) -> DataFrame:
    return rows.withColumn("chunk", F.floor((F.row_number().over(Window.partitionBy(*group).orderBy(*order)) - 1) / size).cast("bigint"))


def least_loaded(units: DataFrame, unit: str, size: str, n: int, start: list[int] | None = None) -> DataFrame:
    """(unit, bin): units, largest first, each to the bin with the least load (from start on).

    Sequential by nature, so it runs on the driver, over a plan's units only: more than MAX_UNITS are an error."""
    rows = units.select(unit, size).orderBy(F.desc(size), unit).limit(MAX_UNITS + 1).collect()
    if len(rows) > MAX_UNITS:
        raise ValueError(f"a plan has at most {MAX_UNITS} units")
    loads, out = list(start or [0] * n), []
    for r in rows:
        k = min(range(n), key=lambda b: (loads[b], b))
        loads[k] += r[size]
        out.append((r[unit], k))
    return units.sparkSession.createDataFrame(out, f"{unit} {units.schema[unit].dataType.simpleString()}, bin int")


def first_claim(rows: DataFrame, key: str, *order: Column) -> DataFrame:
    return rows.withColumn("_rank", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_rank = 1").drop("_rank")


def facet_counts(rows: DataFrame, facets: dict[str, Column]) -> DataFrame:
    """(axis, label, n): a row counts for every label of its array-valued facets."""
    def labelled(axis: str, labels: Column) -> Column:
        return F.transform(labels, lambda x: F.struct(F.lit(axis).alias("axis"), x.alias("label")))

    pairs = F.flatten(F.array(*(labelled(axis, labels) for axis, labels in facets.items())))
    return rows.select(F.explode(pairs).alias("p")).groupBy("p.axis", "p.label").agg(F.count("*").alias("n"))


def time_buckets(minutes: Column) -> Column:
    """Overlapping buckets: what is under 15 is under 30 too."""
    buckets = F.array(
        F.when(minutes < 15, "Under 15 min"), F.when(minutes < 30, "Under 30 min"), F.when(minutes.between(30, 45), "30–45 min"),
        F.when((minutes > 45) & (minutes <= 60), "45–60 min"), F.when(minutes > 60, "Over 60 min"),
    )
    return F.when(F.coalesce(minutes > 0, F.lit(False)), F.filter(buckets, lambda x: x.isNotNull())).otherwise(F.array(F.lit("Unknown")))


def facet_filter(rows: DataFrame, selected: dict[str, str]) -> DataFrame:
    """Every selected facet equals its label, or contains it where the column is an array."""
    for column, label in selected.items():
        is_list = rows.schema[column].dataType.typeName() == "array"
        rows = rows.where(F.array_contains(column, label) if is_list else F.col(column) == label)
    return rows


def without_hidden(rows: DataFrame, hidden: DataFrame, key: str) -> DataFrame:
    return rows.join(hidden.select(key).distinct(), key, "left_anti")


def page(rows: DataFrame, order: list[Column], number: int, size: int = 120) -> DataFrame:
    """The page of that number, held to the first and last, with position and pages. Spark sorts only as many rows as the pages up to it need."""
    total = rows.count()
    pages = max(1, -(-total // size))
    number = min(max(1, number), pages)
    top = rows.orderBy(*order).limit(number * size)
    w = Window.orderBy(*order)
    return top.withColumn("position", F.row_number().over(w)).where(F.col("position") > (number - 1) * size).withColumns({"page": F.lit(number), "pages": F.lit(pages)})


def top_of_each(rows: DataFrame, group: list[Column], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group with rank. Spark keeps k rows of a group in each task before the exchange."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("rank") <= k)


def violations(rows: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """(key, rule) for every rule (a condition that must hold; null counts as broken) that a row breaks."""
    broken = F.filter(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items())), lambda x: x.isNotNull())
    return rows.select(F.col(key), F.explode(broken).alias("rule"))


def null_counts(rows: DataFrame, columns: list[str]) -> DataFrame:
    counts = rows.agg(*(F.count_if(F.col(c).isNull()).alias(c) for c in columns))
    return counts.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(c).alias("nulls")) for c in columns))).alias("x")).select("x.*")


def coverage_status(pending_n: Column, failures: Column, gaps: Column, error: Column) -> Column:
    return F.when(error.isNotNull(), "BLOCKED").when((pending_n > 0) | (failures > 0) | (gaps > 0), "PARTIAL").otherwise("COMPLETE")


def breakdown(rows: DataFrame, dimensions: list[str]) -> DataFrame:
    """(dimension, value, n) for each dimension on its own, in one aggregation by grouping sets."""
    told = rows.groupingSets([[d] for d in dimensions], *dimensions).agg(*(F.grouping(d).alias(f"_g_{d}") for d in dimensions), F.count("*").alias("n"))
    name, value = F.lit(None).cast("string"), F.lit(None).cast("string")
    for d in dimensions:
        name, value = F.when(F.col(f"_g_{d}") == 0, d).otherwise(name), F.when(F.col(f"_g_{d}") == 0, F.col(d).cast("string")).otherwise(value)
    return told.select(name.alias("dimension"), value.alias("value"), "n")


def same_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that only one of two tables has (with multiplicity); none if a repeated run gives the same."""
    return a.exceptAll(b).withColumn("side", F.lit("first")).unionByName(b.exceptAll(a).withColumn("side", F.lit("second")))


def named(rows: DataFrame, names: DataFrame, key: str, name: str, otherwise: Column | None = None) -> DataFrame:
    """rows with the name of their key: only rows that have one, or all rows with otherwise for those that have none.

    names has at most one name for each key that matters; of more, the least counts."""
    one = names.groupBy(key).agg(F.min(name).alias(name))
    out = rows.drop(name).join(one, key, "inner" if otherwise is None else "left")
    return out if otherwise is None else out.withColumn(name, F.coalesce(name, otherwise))
