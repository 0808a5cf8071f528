"""Practical signals of a record's title and steps: methods, operations, labour, vessels, durations. Native expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.binding import fresh

# Cooking methods by the lower-cased title, equipment, tags and steps; more of them by the title alone.
METHODS = (
    ("air fryer", "air[ -]fry"), ("oven", r"\boven\b|烤箱"), ("stovetop", r"\bstovetop\b|\bskillet\b|\bfrying pan\b"), ("one-pan", r"\bone[ -]pan\b|\bone[ -]pot\b"),
    ("sheet-pan", r"\bsheet[ -]pan\b|\bbaking sheet\b"), ("microwave", r"\bmicrowave\b|微波炉"), ("no-cook", r"\bno[ -]cook\b"),
)
TITLE_METHODS = (("one-pan", r"(?i)\bone.pan\b"), ("one-pot", r"(?i)\bone.pot\b"), ("sheet-pan", r"(?i)\bsheet.pan\b"), ("air fryer", r"(?i)\bair.fr(?:yer|ied)\b"))
# Labels of methods in the catalog, and methods by title and equipment.
METHOD_LABELS = {
    "air fryer": "Air fryer", "oven": "Oven", "stovetop": "Stovetop", "one-pan": "One-pan", "one-pot": "One-pot", "sheet-pan": "Sheet-pan", "pressure cooker": "Pressure cooker",
    "slow cooker": "Slow cooker", "microwave": "Microwave", "grill": "Grill", "no-cook": "No-cook",
}
EQUIPMENT_METHODS = (("Pressure cooker", r"(?i)pressure cooker|instant pot"), ("Slow cooker", r"(?i)slow cooker|crock.pot"), ("Grill", r"(?i)\bgrill(?:ed|ing)?\b"))
# Words in steps.
OPERATIONS = r"(?i)(\b(?:chop|dice|mince|peel|grate|slice|whisk|beat|roll|fold|wrap|stuff|shape|knead|dredge|drain|brown|saute|mix|stir|fry|frying)\b|切碎|切片|切丁|搅拌|揉面|擀|包入)"
LABOUR = r"(?i)deep.fry|deep.fried|knead|dredge|breading|continue rolling|fill.{0,40}wrapper|working in batches|wrap each|roll up|封口|揉|擀|面团|包入|包成"
VESSELS = r"(?i)(\b(?:skillet|saucepan|pot|bowl|baking sheet|wok|frying pan|pan)\b)"
MORE_VESSELS = r"(?i)(\b(?:another|separate|second)\s+(?:small |large |mixing )?(?:pot|skillet|pan|bowl)\b)"
HEAT = r"(?i)\b(bake|fry|boil|simmer|roast|grill|cook|heat)\b"
KEEPING = r"(?i)leftovers?|store|keeps? for|can be kept"
WAITING = r"(?i)chill|refrigerat|marinat|rest|soak|simmer|cook|bake|roast|proof|rise|冷藏|腌"
AHEAD = r"(?i)overnight|few hours|several hours|隔夜"
NUMBER_WORDS = ("one", "two", "three", "four", "five", "six")
# Proteins of the catalog's groups; the weight of a category where masses tie.
PROTEIN_GROUPS = {
    "Chicken": ("chicken", "chicken breast", "chicken thigh", "chicken wing", "chicken leg", "chicken drumstick", "whole chicken"),
    "Beef": ("beef", "ground beef"),
    "Pork": ("pork", "ground pork", "pork belly", "ham", "bacon", "sausage"),
    "Fish": ("salmon", "tuna", "cod", "fish", "tilapia"),
    "Seafood": ("shrimp", "prawn", "crab", "clam", "mussel", "scallop"),
    "Eggs": ("egg",),
    "Tofu": ("tofu",),
    "Beans / Lentils": ("chickpea", "lentil", "black bean", "kidney bean", "bean"),
    "Cheese / Dairy": ("cheddar", "parmesan", "feta", "mozzarella", "greek yogurt", "yogurt", "cheese"),
}
CATEGORY_WEIGHT = {"meat": 5, "seafood": 5, "plant-protein": 4, "legumes": 4, "dairy": 1}
OTHER_WEIGHT = 2
# Names of animal products that keep a dish from being vegetarian.
ANIMAL = r"(?i)chicken|beef|pork|fish|oyster|anchov|gelatin|lard|肉|鱼"


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def _list(c: Column) -> Column:
    return F.coalesce(c, F.array().cast("array<string>"))


def matching(text: Column, patterns) -> Column:
    """The labels whose patterns text has, in order."""
    return F.filter(F.array(*(F.when(text.rlike(p), F.lit(label)) for label, p in patterns)), lambda x: x.isNotNull())


def method_tags(title: Column, equipment: Column, tags: Column, steps: Column) -> Column:
    said = F.lower(F.array_join(F.concat(F.array(_text(title)), _list(equipment), _list(tags), _list(steps)), " "))
    return matching(said, METHODS)


def practical_methods(methods: Column, title: Column, meal_type: Column, steps: Column) -> Column:
    """Methods with those of the title; salads and sandwiches that are never heated need no cooking."""
    cold = meal_type.isin("Salad", "Sandwich") & ~F.array_join(_list(steps), " ").rlike(HEAT)
    found = F.concat(_list(methods), matching(F.replace(_text(title), F.lit("_"), F.lit(" ")), TITLE_METHODS), F.when(cold, F.array(F.lit("no-cook"))).otherwise(F.array().cast("array<string>")))
    return F.array_sort(F.array_distinct(found))


_COUNT = rf"\b(?:{'|'.join(NUMBER_WORDS)})(?=\s+(?:hours?|minutes?)\b)"
#: A duration, its first number and its unit; a number word counts only right before the unit.
DURATION = rf"(?i)((?:[0-9]+(?:\.[0-9]+)?|{_COUNT})\s*(?:[-–]\s*(?:[0-9]+|{_COUNT}))?\s*(?:hours?|minutes?)\b)"


def _minutes(found: Column) -> Column:
    """Minutes of one match of DURATION."""
    number = F.regexp_extract(found, r"^([0-9]+(?:\.[0-9]+)?)", 1)
    word = F.array_position(F.array(*map(F.lit, NUMBER_WORDS)), F.lower(F.regexp_extract(found, r"^([A-Za-z]+)", 1))).cast("double")
    return F.when(number != "", number.cast("double")).otherwise(word) * F.when(found.rlike("(?i)hours?$"), 60).otherwise(1)


def with_practical(rows: DataFrame, steps: Column, out_col: str = "practical") -> DataFrame:
    """rows with struct<operations, labour, vessels, vessel_count, lower_bound, advance> of a record's steps; null steps are none.

    Sentences on keeping food are passed over, and only sentences on waiting have durations; these are joined to one
    text, so that each pattern runs over it once. Texts are made in projections of their own: as parts of one
    expression, each of their uses would make them again."""
    text, waits, vessels = (fresh(c, rows.columns) for c in ("_text", "_waits", "_vessels"))
    # A point within a number also ends a sentence. A text that never waits is not split at all.
    sentences = F.filter(F.split(text, "[.!?。]"), lambda s: s.rlike(WAITING) & ~s.rlike(KEEPING))
    bound = rows.withColumn(text, F.array_join(_list(steps), " ")).withColumn(waits, F.when(F.col(text).rlike(WAITING), F.array_join(sentences, " . ")).otherwise(""))
    bound = bound.withColumn(vessels, F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(VESSELS), F.lit(1)))))
    longest = F.array_max(F.transform(F.regexp_extract_all(waits, F.lit(DURATION), F.lit(1)), _minutes))
    out = F.struct(
        F.regexp_count(text, F.lit(OPERATIONS)).alias("operations"), F.col(text).rlike(LABOUR).alias("labour"), F.col(vessels).alias("vessels"),
        (F.size(vessels) + F.regexp_count(text, F.lit(MORE_VESSELS))).alias("vessel_count"), F.coalesce(longest, F.lit(0.0)).alias("lower_bound"), F.col(waits).rlike(AHEAD).alias("advance"),
    )
    return bound.withColumn(out_col, out).drop(text, waits, vessels)


def major_protein(items: Column) -> Column:
    """The protein with the greatest mass, then the weight of its category, then the greater name.

    items: array<struct<name, category, quantity, unit, protein>>; quantities in g and kg count."""
    weight = lambda c: F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in CATEGORY_WEIGHT.items() for x in kv)), c), F.lit(OTHER_WEIGHT))
    mass = lambda x: F.when(x["unit"] == "kg", x["quantity"] * 1000).when(x["unit"] == "g", x["quantity"])
    ranked = F.transform(F.filter(items, lambda x: F.coalesce(x["protein"], F.lit(False)) & x["name"].isNotNull()), lambda x: F.struct(F.coalesce(mass(x), F.lit(0.0)).alias("m"), weight(x["category"]).alias("w"), x["name"].alias("n")))
    return F.array_max(ranked)["n"]


def protein_labels(major: Column, names: Column, known: Column, meat: Column) -> Column:
    """The group of the major protein; Vegetarian only where every name is known and none is of an animal.

    names: canonical names; known: names in the vocabulary; meat: those of meat and seafood."""
    groups = F.filter(F.array(*(F.when(major.isin(*members), F.lit(label)) for label, members in PROTEIN_GROUPS.items())), lambda x: x.isNotNull())
    plain = (F.size(_list(names)) > 0) & (F.size(F.array_except(names, known)) == 0) & ~F.arrays_overlap(names, meat) & ~F.exists(names, lambda n: n.rlike(ANIMAL))
    out = F.concat(groups, F.when(plain, F.array(F.lit("Vegetarian"))).otherwise(F.array().cast("array<string>")))
    return F.when(F.size(out) > 0, out).otherwise(F.array(F.lit("Other")))


def method_labels(methods: Column, title: Column, equipment: Column) -> Column:
    table = F.create_map(*(F.lit(x) for kv in METHOD_LABELS.items() for x in kv))
    told = F.filter(F.transform(_list(methods), lambda m: F.try_element_at(table, m)), lambda x: x.isNotNull())
    out = F.array_sort(F.array_distinct(F.concat(told, matching(F.array_join(F.concat(F.array(_text(title)), _list(equipment)), " "), EQUIPMENT_METHODS))))
    return F.when(F.size(out) > 0, out).otherwise(F.array(F.lit("Other")))


def facts(minutes: Column, methods: Column) -> Column:
    """ "20 min · Oven": the time, if any, and the methods that are named."""
    shown = F.regexp_replace(F.format_string("%.6f", minutes), r"\.?0+$", "")
    said = F.concat(F.array(F.when(minutes > 0, F.concat(shown, F.lit(" min")))), F.transform(_list(methods), lambda m: F.when(~m.isin("Other", "Unknown"), m)))
    return F.array_join(F.filter(said, lambda x: x.isNotNull()), " · ")


def dish_issues(names: Column, known: Column, items: Column, steps: Column, least: int) -> Column:
    """struct<unresolved, issues>: the share of names that the vocabulary lacks, and what keeps a record from being trusted.

    items: array<struct<original_text, quantity>>."""
    counted = F.size(F.filter(items, lambda i: i["original_text"].rlike(r"[A-Za-z]\s+_?[0-9]+_?$") & i["quantity"].isNull()))
    distinct = F.array_distinct(F.filter(_list(names), lambda n: n.isNotNull() & (n != "")))
    n = F.size(distinct)
    issues = F.array(
        F.when((F.size(items) >= 20) & (counted > 0.7 * F.size(items)), "ingredient frequency/category aggregate, not a recipe ingredient list"),
        F.when(F.size(_list(steps)) == 0, "no parsed instructions"), F.when(n < least, "too few meaningful parsed ingredients"),
    )
    share = F.round(F.size(F.array_except(distinct, known)) / F.greatest(n, F.lit(1)), 6)
    return F.struct(share.alias("unresolved"), F.filter(issues, lambda x: x.isNotNull()).alias("issues"))
