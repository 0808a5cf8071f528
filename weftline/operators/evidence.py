"""Item evidence under three-valued logic: unknown is never taken for absent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def any_known(value: Column, says: Column | None = None) -> Column:
    """Aggregate: true if any is true, false if all are false, else null. Rows where says (if given) isn't true don't count."""
    false = F.coalesce(~value, F.lit(False))
    return F.when(F.bool_or(F.coalesce(value, F.lit(False))), True).when(F.bool_and(false if says is None else F.when(says, false)), False)


def rollup(products: DataFrame, item: str, product: str, name: str, available: str, observed: str, category: str, order: str | None = None, says: str | None = None) -> DataFrame:
    """One row for each item: its products' ids (sorted), number, distinct names, tri-state availability (of rows where says holds, if given),
    last observation, and the category of its first product by order (by id where order isn't given; rows with a null order are passed over).

    An order that two products of an item share leaves the category open: give a struct that ends in a row's own place."""
    return products.groupBy(item).agg(
        F.sort_array(F.collect_set(product)).alias("product_ids"), F.count("*").alias("n_products"), F.sort_array(F.collect_set(name)).alias("names"),
        any_known(F.col(available), None if says is None else F.col(says)).alias("available"), F.max(observed).alias("last_observed"), F.min_by(category, order or product).alias("category"),
    )


def winners(entries: DataFrame, item: str, n_evidence: Column, *ties: Column) -> DataFrame:
    """The entry with the most evidence of each item; ties by the given order."""
    w = Window.partitionBy(item).orderBy(n_evidence.desc(), *ties)
    return entries.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def evidence_state(entry: Column, configured: Column, first_party) -> Column:
    """verified_available, likely_available, unavailable or unknown: the first rule that applies.

    entry: struct with product_ids, status, currently_available, store_id, store_specificity, snapshot_id, verified_at,
    evidence (structs of source_url, retrieved_at, store_id, store_specificity); first_party: condition on a URL."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    other = yes(entry["store_id"] != F.coalesce(configured, F.lit(""))) | yes(entry["store_specificity"].isin("other_store", "national_catalog"))
    credible = F.filter(F.coalesce(entry["evidence"], F.array().cast(_EVIDENCE)), lambda e: e["retrieved_at"].isNotNull() & first_party(e["source_url"]))
    scoped = yes((entry["store_id"] == configured) & entry["snapshot_id"].isNotNull() & entry["verified_at"].isNotNull()) & ~other
    own = F.exists(credible, lambda e: yes(e["store_specificity"].isin("configured_store", "specific_store") & (e["store_id"] == configured)))
    some = F.size(credible) > 0
    return (
        F.when(F.coalesce(F.size(entry["product_ids"]), F.lit(0)) <= 0, "unknown")
        .when(other & yes(entry["currently_available"]), F.when(some, "likely_available").otherwise("unknown"))
        .when(yes(~entry["currently_available"]) & scoped, "unavailable")
        .when(yes(entry["currently_available"]) & scoped, "verified_available")
        .when(yes(entry["status"] == "verified_available") & own, "verified_available")
        .when(yes(entry["status"].isin("likely_available", "verified_available")) & some, "likely_available")
        .otherwise("unknown")
    )


_EVIDENCE = "array<struct<source_url:string,retrieved_at:string,store_id:string,store_specificity:string>>"


def observation_state(available: Column, store_id: Column, specificity: Column, configured: Column) -> Column:
    """Stock seen in the configured store is verified or unavailable, elsewhere at most likely."""
    same = F.coalesce((store_id == configured) & ~F.coalesce(specificity.isin("other_store", "national_catalog"), F.lit(False)), F.lit(False))
    return F.when(same & available, "verified_available").when(same & ~available, "unavailable").when(~same & F.coalesce(available | (specificity == "national_catalog"), F.lit(False)), "likely_available").otherwise("unknown")


def compatibility(state: Column, all_first_party: Column, item: Column, pantry: list[str]) -> Column:
    return F.when(state.isin("verified_available", "likely_available") | F.coalesce(all_first_party, F.lit(False)), "yes").when(item.isin(*pantry), "probably").otherwise("unknown")


def prefix_rules(products: DataFrame, rules: DataFrame, slug: str = "slug", prefix: str = "prefix") -> DataFrame:
    """products ⋈ rules where the slug starts with the prefix and goes on with a digit.

    An equi-join: a slug has one candidate prefix for each digit that doesn't follow another one, and rules meet those."""
    marks = F.filter(F.sequence(F.lit(2), F.greatest(F.length(slug), F.lit(2))), lambda i: F.substr(F.col(slug), i, F.lit(1)).rlike("[0-9]"))
    keyed = products.withColumn("_prefix", F.explode(F.transform(marks, lambda i: F.substr(F.col(slug), F.lit(1), i - 1))))
    return keyed.join(rules, F.col("_prefix") == F.col(prefix)).drop("_prefix")


def with_inventory(items: DataFrame, entries: DataFrame, item: str, n_evidence: Column, *ties: Column) -> DataFrame:
    """items with the columns of their name's best entry, null where there is none: one entry a name is chosen first, so no item is repeated."""
    return items.join(winners(entries, item, n_evidence, *ties), item, "left")


def state_counts(rows: DataFrame, group: list[str], state: str) -> DataFrame:
    """(group, verified, likely, unknown, unavailable): how many rows are in each state; a null state is unknown."""
    names = {"verified": "verified_available", "likely": "likely_available", "unknown": "unknown", "unavailable": "unavailable"}
    return rows.groupBy(*group).agg(*(F.count_if(F.coalesce(state, F.lit("unknown")) == value).alias(name) for name, value in names.items()))


def matched_rollup(pairs: DataFrame, item: str, product: str, observed: str) -> DataFrame:
    """(item, product_ids, n_products, last_observed) from pairs of products and the items that rules give them."""
    return pairs.groupBy(item).agg(F.sort_array(F.collect_set(product)).alias("product_ids"), F.count_distinct(product).alias("n_products"), F.max(observed).alias("last_observed"))
