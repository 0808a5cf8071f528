"""What a record is and why it scores as it does: roles, eligibility, shares of items, added fat, labels, reasons.

Lists of names and patterns that a user may configure are parameters; nothing here gathers rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scoring import reasons

# Patterns of titles and items that override a role.
STRONG_DESSERT = r"(?i)snickerdoodle|fruit pizza|pumpkin pie|dutch baby"
SAVORY_CAKE = r"(?i)fish cakes?|crab cakes?|rice cakes?"
MIX_INS = r"(?i)mixins|mix.ins|toppings|taco seasoning"
SUGAR, FLOUR = r"sugar|syrup|糖", r"flour|面粉"
SWEET_FLAVOR = r"vanilla|chocolate|cocoa|cinnamon|icing|raisins|香草|巧克力"
SAVORY_CATEGORIES = ("meat", "seafood", "legume")
PROCESSED_LINE = r"(?i)tater.tots?|condensed|cream of .+ soup|instant .+ mix|processed cheese"
# Meal types that make an everyday meal, what is no meal at all, issues that are only about times.
EVERYDAY = ("Full meal", "Main dish", "Sandwich", "Pasta", "Rice/grain", "Soup/stew", "Salad")
NO_MEAL = r"(?i)dishwasher|dish washer|洗碗机"
TIMING_ISSUES = ("instructions require advance preparation", "explicit instruction duration")
# Fats by name; labels of scores, from the least score on.
FATS = ("cooking oil", "vegetable oil", "olive oil", "coconut oil", "butter")
LABELS = ((90, "Excellent"), (80, "Strong"), (70, "Good"), (60, "Usable"), (0, "Low priority"))
EASY_CLEANUP = ("one-pan", "one-pot", "sheet-pan", "air fryer", "no-cook")


def _yes(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def distinct_items(rows: DataFrame, key: str, name: str, optional: str) -> DataFrame:
    """(key, name, optional): a row for each name of a record; it is optional only where all of its repeats are. Null counts as not optional."""
    return rows.groupBy(key, name).agg(F.bool_and(_yes(F.col(optional))).alias("optional"))


def distinct_lists(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, columns): the distinct values of each column for each key, sorted, without nulls. A record's own lines only."""
    return rows.groupBy(key).agg(*(F.array_sort(F.collect_set(c)).alias(c) for c in columns))


def practical_role(role: Column, title: Column, names: Column, categories: Column, dessert: str) -> Column:
    """The role after what title and items say for certain. names: canonical, categories: of the vocabulary; dessert: the configured title pattern."""
    text = F.lower(F.array_join(F.coalesce(names, F.array().cast("array<string>")), " "))
    title = F.replace(F.coalesce(title, F.lit("")), F.lit("_"), F.lit(" "))
    savory = _yes(F.arrays_overlap(categories, F.array(*map(F.lit, SAVORY_CATEGORIES))))
    by_title = (title.rlike(dessert) | title.rlike(STRONG_DESSERT)) & ~title.rlike(SAVORY_CAKE)
    sweet = text.rlike(SUGAR) & text.rlike(FLOUR) & text.rlike(SWEET_FLAVOR) & ~savory
    return F.when(title.rlike(MIX_INS), "component").when(by_title | sweet, "dessert").otherwise(role)


def processed_fraction(items: Column, processed: list[str]) -> Column:
    """The share of item lines that are processed food, by name or by their text. items: array<struct<name, original_text>>."""
    hit = F.filter(items, lambda i: _yes(i["name"].isin(*processed) if processed else F.lit(False)) | _yes(F.coalesce(i["original_text"], i["name"]).rlike(PROCESSED_LINE)))
    return F.coalesce(F.size(hit) / F.greatest(F.size(items), F.lit(1)), F.lit(0.0))


def named_fraction(names: Column, listed: list[str]) -> Column:
    """The share of distinct names that are listed."""
    distinct = F.array_distinct(names)
    return F.coalesce(F.size(F.filter(distinct, lambda n: n.isin(*listed) if listed else F.lit(False))) / F.greatest(F.size(distinct), F.lit(1)), F.lit(0.0))


def structural_issues(issues: Column) -> Column:
    """Issues that are about the record's text and not only about its times."""
    return F.filter(issues, lambda i: ~(F.startswith(i, F.lit(TIMING_ISSUES[0])) | F.startswith(i, F.lit(TIMING_ISSUES[1]))))


def everyday_eligible(kind: Column, protein: Column, structural: Column, title: Column, steps: Column) -> Column:
    """An everyday meal: a fitting meal type, some protein, a text without structural issues that is about food."""
    said = F.concat_ws(" ", F.replace(F.coalesce(title, F.lit("")), F.lit("_"), F.lit(" ")), F.array_join(F.coalesce(steps, F.array().cast("array<string>")), " "))
    return _yes(kind.isin(*EVERYDAY)) & _yes(protein) & (F.size(structural) == 0) & ~said.rlike(NO_MEAL)


def added_fat(items: Column) -> Column:
    """mL of fat that items name. items: array<struct<name, quantity, unit>>."""
    volumes = F.transform(F.filter(items, lambda i: i["name"].isin(*FATS) & i["unit"].isin("mL", "L") & i["quantity"].isNotNull()), lambda i: i["quantity"] * F.when(i["unit"] == "L", 1000).otherwise(1))
    return F.coalesce(F.aggregate(volumes, F.lit(0.0), lambda a, x: a + x), F.lit(0.0))


def prominent_fat(fat: Column, servings: Column, least: float, per_serving: float) -> Column:
    """Much added fat, also for each serving where their number is known."""
    return (fat >= least) & (~_yes(servings > 0) | (fat / servings >= per_serving))


def unknown_mains(items: Column, unknown: Column, least_grams: float) -> Column:
    """Sorted names of substantial items, by mass, that aren't optional and whose stock is unknown. items: array<struct<name, quantity, unit, optional>>."""
    grams = lambda i: i["quantity"] * F.when(i["unit"] == "kg", 1000).when(i["unit"] == "g", 1)
    mains = F.filter(items, lambda i: F.array_contains(unknown, i["name"]) & ~_yes(i["optional"]) & _yes(grams(i) >= least_grams))
    return F.coalesce(F.array_sort(F.array_distinct(F.transform(mains, lambda i: i["name"]))), F.array().cast("array<string>"))


def score_label(score: Column) -> Column:
    out = F.lit(LABELS[-1][1])
    for least, label in reversed(LABELS[:-1]):
        out = F.when(score >= least, label).otherwise(out)
    return out


def explanation(unknown_main: Column, fat: Column, coverage: Column, active: Column, total: Column, protein: Column, vegetables: Column, staple: Column, easy: Column, batch: Column, ahead: Column, structural: Column, market: str = "the shop") -> Column:
    """Why a record scores as it does, in a fixed order; of alternatives the first that holds."""
    quick, soon = _yes(active <= 15), _yes(total <= 30)
    return reasons(
        (unknown_main, f"Check the main ingredient choice for your {market} shop" if market != "the shop" else "Check the main ingredient choice"),
        (fat, "Uses a substantial amount of added cooking fat"),
        (coverage >= 0.85, f"Ingredients generally sold at {market}"),
        ((coverage >= 0.7) & (coverage < 0.85), f"Most ingredients fit {market}"),
        (coverage < 0.7, "Some ingredient choices may need checking"),
        (quick, "At most 15 minutes of active work"),
        (~quick & soon, "Ready within 30 minutes"),
        (~quick & ~soon & active.isNull(), "Active time not listed; effort estimated from recipe steps"),
        (protein & vegetables, "Protein and vegetables"),
        (protein & ~vegetables, "Includes a protein source"),
        (staple, "Includes a staple food"),
        (easy, "Simple cooking method and cleanup"),
        (batch, "Makes several servings"),
        (ahead, "Plan ahead for preparation or resting"),
        (structural, "Check the original recipe before cooking"),
    )


def easy_cleanup(methods: Column) -> Column:
    return _yes(F.arrays_overlap(methods, F.array(*map(F.lit, EASY_CLEANUP))))


def cohort(records: DataFrame, key: str, *filters: DataFrame) -> DataFrame:
    """records whose key all of the filters hold (semi joins: repeated keys on either side change nothing)."""
    for f in filters:
        records = records.join(f.select(key), key, "left_semi")
    return records
