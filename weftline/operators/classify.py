"""Classification of records and sources: ordered patterns compiled to CASE expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Meal types by title, the first that matches counts.
MEAL_TYPES = (
    ("Sandwich", r"(?iU)\b(sandwich|burger|wrap|taco|burrito|quesadilla|banh mi)\b|三明治|汉堡"),
    ("Soup/stew", r"(?iU)\b(soup|stew|chili(?! (?:pepper|flakes|powder))|chowder|gumbo|dal|dahl)\b|汤|炖"),
    ("Salad", r"(?iU)\bsalad\b|沙拉"),
    ("Pasta", r"(?iU)\b(pasta|spaghetti|lasagn\w*|linguine|rigatoni|macaroni|penne|noodles?|fettuccine|gnocchi)\b|面条|拌面"),
    ("Rice/grain", r"(?iU)\b(rice|risotto|quinoa|grain bowl|pilaf)\b|炒饭|盖饭"),
    ("Breakfast", r"(?iU)\b(breakfast|pancake|waffle|omelet|omelette|porridge|oatmeal)\b"),
    ("Snack", r"(?iU)\b(sausage balls|cheese balls|snack|popcorn|chips|nachos|trail mix|energy bar)\b"),
)
# The meal type of a dish role that is no meal.
ROLE_TYPES = {"dessert": "Dessert", "condiment": "Sauce/condiment", "drink": "Snack", "bread": "Baking", "component": "Side dish", "side": "Side dish"}

# What captured texts look like that gave no record.
BLOCKED_PAGE = r"(?i)access denied|403 forbidden|enable javascript|captcha|robot check|just a moment|request blocked"
POINTER_FILE = r"^\s*#[^\n]*(?:\n\s*(?:`?TODO`?|See \[[^\]]+\]\([^)]*\)\.?))?\s*$"
SAMPLE_FILE = r"%(?:INGREDIENT|INSTRUCTION|IMAGE)_NAME%|Sample recipe name|<title>asdf</title>"
LIST_PARTS = r"(?im)^\s*(?:#+\s*)?(?:ingredients|instructions|directions|steps|recipe|材料)\b|^\s*[-*+]\s+\d"


def first_match(text: Column, patterns, default: Column | None = None) -> Column:
    out = F.lit(None).cast("string") if default is None else default
    for label, pattern in reversed(tuple(patterns)):
        out = F.when(F.coalesce(text, F.lit("")).rlike(pattern), label).otherwise(out)
    return out


def dish_role(title: Column, tags: Column, roles, exceptions: str, protein: Column, vegetable: Column) -> Column:
    """A configured title pattern unless an exception matches, then a tag, then protein with vegetable."""
    by_title = F.when(~F.coalesce(title, F.lit("")).rlike(exceptions), first_match(title, roles))
    by_tag = first_match(F.array_join(F.coalesce(tags, F.array().cast("array<string>")), " "), [(r, rf"(?i)\b{r}\b") for r in ("dessert", "condiment", "drink")])
    return F.coalesce(by_title, by_tag, F.when(protein & vegetable, "meal_candidate"), F.lit("unknown"))


def meal_type(role: Column, title: Column, protein: Column, vegetable: Column, staple: Column, egg_only: Column) -> Column:
    by_role = F.lit(None).cast("string")
    for name, kind in ROLE_TYPES.items():
        by_role = F.when(role == name, kind).otherwise(by_role)
    by_items = F.when(protein & vegetable & staple, "Full meal").when(protein, "Main dish").otherwise("Side dish")
    kind = F.coalesce(by_role, first_match(title, MEAL_TYPES), by_items)
    return F.when(egg_only & ~vegetable & (kind == "Main dish"), "Breakfast").otherwise(kind)


def effort(labour: Column, steps: Column, items: Column, vessels: Column, active: Column) -> Column:
    involved = labour | (steps > 14) | (items > 20) | F.coalesce(active > 45, F.lit(False))
    easy = (steps <= 8) & (items <= 12) & (vessels <= 2) & ~labour & F.coalesce(active <= 15, F.lit(True))
    return F.when(involved, "Involved").when(easy, "Easy").otherwise("Moderate")


def triage(text: Column, path: Column) -> Column:
    """Why a captured text gave no record: struct<outcome, cause>. What is uncertain stays unsupported."""
    cached = F.endswith(path, F.lit(".gz"))
    body = F.when(cached, F.regexp_replace(text, r"^[^\n]*\n?", "")).otherwise(text)
    size = F.length(F.trim(body))
    visible = F.trim(F.regexp_replace(body, r"(?s)<!--.*?-->", ""))

    def case(outcome: str, cause: str) -> Column:
        return F.struct(F.lit(outcome).alias("outcome"), F.lit(cause).alias("cause"))

    blocked = (size < 600) & body.rlike(BLOCKED_PAGE)
    pointer = visible.rlike(POINTER_FILE)
    sample = text.rlike(SAMPLE_FILE)
    parts = text.rlike(LIST_PARTS)
    return (
        F.when(blocked, case("BLOCKED", "captured-access-or-missing-page"))
        .when(pointer, case("NOT_A_RECIPE_SOURCE", "duplicate/non-recipe-file"))
        .when(sample, case("NOT_A_RECIPE_SOURCE", "repository-metadata"))
        .when(cached & (size < 250), case("UNSUPPORTED", "incomplete-cached-content"))
        .when(path.rlike(r"\.html?$"), case("UNSUPPORTED", "HTML"))
        .when(cached & text.rlike(r"(?im)^\s*(?:recipe )?ingredients\b"), case("LEGITIMATE_RECIPE_FAILURE", "instructions-parser-failure"))
        .when(cached, case("UNSUPPORTED", "unlabelled-or-index-archive"))
        .when(parts, case("LEGITIMATE_RECIPE_FAILURE", "alternate-markdown-layout"))
        .otherwise(case("UNSUPPORTED", "other"))
    )
