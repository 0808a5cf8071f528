"""The flagship plan: records scored by weighted evidence over their items, ranked for discovery.

Orders are records, lineitems their items, parts the items' names; a part's inventory is the tri-state
availability of its lines by return flag and its number of suppliers. One aggregation makes the
inventory, one join brings it to the items, one aggregation brings items to records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import scoring, tables


def inventory(lineitem: DataFrame) -> DataFrame:
    """(l_partkey, available, n_suppliers, state): A is in stock, R is out of stock, N is unknown.

    In two steps, by supplier and then by part, so that counting suppliers multiplies no rows; a part's rows are summed
    in the tasks before either exchange."""
    seen = F.when(F.col("l_returnflag") == "A", True).when(F.col("l_returnflag") == "R", False)
    some, none = F.bool_or(F.coalesce(seen, F.lit(False))), F.bool_and(F.coalesce(~seen, F.lit(False)))
    sold = lineitem.groupBy("l_partkey", "l_suppkey").agg(some.alias("some"), none.alias("none"))
    rows = sold.groupBy("l_partkey").agg(F.when(F.bool_or("some"), True).when(F.bool_and("none"), False).alias("available"), F.count("l_suppkey").alias("n_suppliers"))
    state = F.when(F.col("available") & (F.col("n_suppliers") >= 10), "verified").when(F.col("available"), "likely").when(~F.col("available"), "unavailable").otherwise("unknown")
    return rows.withColumn("state", state)


def scored_records(orders: DataFrame, lineitem: DataFrame, part: DataFrame, w: scoring.Weights = scoring.Weights()) -> DataFrame:  # noqa: B008
    stock = inventory(lineitem).select("l_partkey", "state")
    big = part.select(F.col("p_partkey").alias("l_partkey"), (F.col("p_size") >= 25).alias("protein"), F.col("p_type").isNotNull().alias("named"))
    lines = lineitem.select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_discount", F.date_diff(F.col("l_shipdate").cast("date"), F.lit("1992-01-01").cast("date")).alias("day"))
    # Both sides have a row for each part; joined first, lines are exchanged by part once.
    items = lines.join(stock.join(big, "l_partkey"), "l_partkey")
    optional = F.col("l_linenumber") > 4
    credit = F.when(F.col("state").isin("verified", "likely"), 1.0).otherwise(w.unknown_credit)
    per = items.groupBy("l_orderkey").agg(
        F.avg(F.when(~optional, credit)).alias("required"), F.avg(F.when(optional, credit)).alias("optional"), F.bool_or(optional).alias("has_optional"),
        F.bool_or(~optional & (F.col("state") == "unknown") & (F.col("l_quantity") >= 45)).alias("unknown_main"),
        F.count("*").alias("n_items"), F.count_if(F.col("state") == "verified").alias("n_verified"), F.count_if(F.col("state") == "unknown").alias("n_unknown"),
        F.bool_or("protein").alias("protein"), F.bool_or(F.col("l_discount") > 0.05).alias("vegetable"), F.bool_or(F.col("l_quantity") > 40).alias("staple"),
        F.avg(F.when(F.col("l_discount") > 0.08, 1.0).otherwise(0.0)).alias("processed"), (F.max("day") - F.min("day")).alias("spread"),
    )
    total = F.when(F.col("spread") > 0, F.col("spread").cast("double"))
    no = F.lit(False)
    score = (
        scoring.compatibility_score(F.col("required"), F.col("optional"), F.col("has_optional"), F.col("unknown_main"), w)
        + scoring.time_score(F.lit(None).cast("double"), total, F.lit("Moderate"), no, w)
        + scoring.balance_score(F.col("protein"), F.col("vegetable"), F.col("staple"), F.col("processed"), F.lit(0.0), no, w)
        + scoring.simplicity_score(F.col("n_items"), F.col("n_items"), F.lit(2), no, F.lit(4), w)
    )
    rows = orders.select("o_orderkey", "o_custkey", "o_orderstatus").join(per, F.col("o_orderkey") == F.col("l_orderkey"))
    eligible = F.col("o_orderstatus") != "P"
    rows = rows.withColumn("score", scoring.capped(score, eligible, F.col("n_items") < 2, w))
    rows = rows.withColumns({"band": scoring.band(F.col("score")), "status": scoring.status(F.col("score"), eligible, F.col("n_items") < 2, w)})
    return tables.discovery_representative(rows, F.col("o_custkey"), [F.desc("score"), F.col("o_orderkey")])


def flagship(orders: DataFrame, lineitem: DataFrame, part: DataFrame, top: int = 100) -> DataFrame:
    rows = scored_records(orders, lineitem, part).where("discovery_representative")
    return rows.orderBy(F.desc("score"), "o_orderkey").limit(top).select("o_orderkey", "o_custkey", "score", "band", "status", "n_items", "n_verified", "n_unknown")
