"""Measurements in free text: fractions, units, metric rewriting, durations. Native expressions."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .binding import let

# Spellings of units, each with its factor to the metric unit.
UNITS = {
    "c. à soupe": (15.0, "mL"),
    "cuillère à soupe": (15.0, "mL"),
    "cuillères à soupe": (15.0, "mL"),
    "c. à café": (5.0, "mL"),
    "cuillère à café": (5.0, "mL"),
    "cuillères à café": (5.0, "mL"),
    "tl": (5.0, "mL"),
    "teelöffel": (5.0, "mL"),
    "el": (15.0, "mL"),
    "esslöffel": (15.0, "mL"),
    "κ.σ.": (15.0, "mL"),
    "κ.γ.": (5.0, "mL"),
    "茶匙": (5.0, "mL"),
    "汤匙": (15.0, "mL"),
    "tsp": (5.0, "mL"),
    "teaspoon": (5.0, "mL"),
    "teaspoons": (5.0, "mL"),
    "tbsp": (15.0, "mL"),
    "tablespoon": (15.0, "mL"),
    "tablespoons": (15.0, "mL"),
    "cup": (240.0, "mL"),
    "cups": (240.0, "mL"),
    "fl oz": (29.5735, "mL"),
    "fl. oz.": (29.5735, "mL"),
    "fl. oz": (29.5735, "mL"),
    "fluid ounce": (29.5735, "mL"),
    "fluid ounces": (29.5735, "mL"),
    "oz": (28.3495, "g"),
    "ounce": (28.3495, "g"),
    "ounces": (28.3495, "g"),
    "lb": (453.592, "g"),
    "lbs": (453.592, "g"),
    "pound": (453.592, "g"),
    "pounds": (453.592, "g"),
    "pint": (473.176, "mL"),
    "pints": (473.176, "mL"),
    "quart": (946.353, "mL"),
    "quarts": (946.353, "mL"),
    "gallon": (3.78541, "L"),
    "gallons": (3.78541, "L"),
    "g": (1.0, "g"),
    "gram": (1.0, "g"),
    "grams": (1.0, "g"),
    "克": (1.0, "g"),
    "kg": (1.0, "kg"),
    "kilogram": (1.0, "kg"),
    "kilograms": (1.0, "kg"),
    "千克": (1.0, "kg"),
    "ml": (1.0, "mL"),
    "milliliter": (1.0, "mL"),
    "milliliters": (1.0, "mL"),
    "毫升": (1.0, "mL"),
    "l": (1.0, "L"),
    "liter": (1.0, "L"),
    "liters": (1.0, "L"),
    "litre": (1.0, "L"),
    "litres": (1.0, "L"),
}
# Single-character fractions.
FRACTIONS = {"½": "1/2", "¼": "1/4", "¾": "3/4", "⅓": "1/3", "⅔": "2/3", "⅛": "1/8", "⅜": "3/8", "⅝": "5/8", "⅞": "7/8", "⅕": "1/5", "⅖": "2/5", "⅗": "3/5", "⅘": "4/5", "⅙": "1/6", "⅚": "5/6"}

NUMBER = r"(?:[0-9]+\s+[0-9]+/[0-9]+|[0-9]+/[0-9]+|[0-9]+(?:\.[0-9]+)?|\.[0-9]+)"


def _quoted(text: str) -> str:
    return re.sub(r"([.()\[\]*+?^$|\\])", r"\\\1", text)


UNIT = "(?:" + "|".join(_quoted(u) for u in sorted(UNITS, key=lambda u: (-len(u), u))) + ")"
#: Works in Java's and in Python's regular expressions. Groups: quantity, range end, unit.
MEASUREMENT = rf"(?<![A-Za-z]-)(?<![A-Za-z0-9.,/⁄])({NUMBER})(?:\s*(?:-|–|to)\s*({NUMBER}))?(?:\s*-\s*|\s*)({UNIT})(?![A-Za-z0-9_])\.?"


def fraction_text(text: Column) -> Column:
    """Fractions and decimal commas in one plain notation: 1½ and 1-1/2 as 1 1/2, 0,5 as 0.5."""
    text = F.replace(F.replace(text, F.lit("⁄"), F.lit("/")), F.lit("℃"), F.lit("°C"))
    text = F.regexp_replace(text, r"(?<![0-9/])([0-9]+)-([0-9]+/[0-9]+)", "$1 $2")
    text = F.regexp_replace(text, r"(?<![0-9,])([0-9]+),([0-9]{1,2})(?![0-9,])", "$1.$2")
    text = F.regexp_replace(text, f"([0-9])([{''.join(FRACTIONS)}])", "$1 $2")
    for sign, plain in FRACTIONS.items():
        text = F.replace(text, F.lit(sign), F.lit(plain))
    return text


def number(text: Column) -> Column:
    """The value of "1 1/2", "3/4", "2.5"; null where a denominator is 0 or the text is no number."""

    def part(p: Column) -> Column:
        return let(F.split(p, "/"), lambda x: F.try_divide(x[0].try_cast("double"), F.coalesce(F.get(x, F.lit(1)), F.lit("1")).try_cast("double")))

    return F.when(text.isNotNull(), let(F.trim(text), lambda t: F.when(t != "", F.aggregate(F.transform(F.split(t, r"\s+"), part), F.lit(0.0), lambda a, x: a + x))))


def pretty(value: Column) -> Column:
    """At most three decimals and six significant digits, without trailing zeros; exponents from 1e6 on."""

    def short(text: Column) -> Column:
        return F.regexp_replace(F.regexp_replace(text, r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")

    def form(v: Column, power: Column) -> Column:
        scale = F.pow(F.lit(10.0), F.when(F.abs(v) < 1, 6).otherwise(F.lit(5) - power))
        plain = let(scale, lambda x: short(F.format_string("%.6f", F.round(v * x) / x)))
        large = F.concat(short(F.format_string("%.5f", v / F.pow(F.lit(10.0), power))), F.lit("e+"), F.lpad(power.cast("string"), 2, "0"))
        return F.when(F.abs(v) >= 999999.5, large).otherwise(plain)

    return let(F.round(value, 3), lambda v: let(F.floor(F.log10(F.greatest(F.abs(v), F.lit(1.0)))).cast("int"), lambda power: form(v, power)))


def measurement_layout(text: Column) -> Column:
    """A jar's size becomes a note on its capacity, "2 - 16oz can" becomes "2 (16 oz) can", and a blank lost after a long unit comes back."""
    text = F.regexp_replace(text, rf"(?i)(?<![\w.]){NUMBER}(?:\s*-\s*|\s*)(?:oz\.?|ounces?)\s+((?:mason |drinking |measuring )?(?:jars?|glasses?|mugs?|bowls?|cups?))\b", "$1 (check source capacity)")
    text = F.regexp_replace(text, rf"(?i)(?<![\w.])([0-9]+)\s*[-–]\s*({NUMBER})\s*({UNIT})\.?\s+(cans?|packages?|pkgs?|jars?)\b", r"$1 ($2 $3) $4")
    return F.regexp_replace(text, rf"(?i)(?<![A-Za-z])({NUMBER})\s*((?>tablespoons?|teaspoons?|tbsp|tsp))(?=[A-Za-z])", "$1 $2 ")


def _rewritten(text: Column, pattern: str, convert: Callable[[Column], Column]) -> Column:
    """text with each match of pattern replaced by convert of it."""

    def join(t: Column) -> Column:
        found = F.regexp_extract_all(t, F.lit(f"({pattern})"), F.lit(1))
        return let(F.transform(found, convert), lambda f: F.when(F.size(f) == 0, t).otherwise(F.array_join(F.transform(F.split(t, pattern, -1), lambda p, i: F.concat(p, F.coalesce(F.get(f, i), F.lit("")))), "")))

    return let(text, join)


def unit_of(spelling: Column) -> Column:
    """struct<factor, unit> of a spelling in any case; null for any other text."""
    table = F.create_map(*(x for u, (factor, unit) in UNITS.items() for x in (F.lit(u), F.struct(F.lit(factor).alias("factor"), F.lit(unit).alias("unit")))))
    return F.try_element_at(table, F.lower(spelling))


def metric_text(text: Column) -> Column:
    """Every measurement in prose in metric units, Fahrenheit in Celsius; unquantified spoons as a measure of so many mL."""
    text = measurement_layout(fraction_text(F.coalesce(text, F.lit(""))))
    parts = f"(?iu)^({NUMBER})(?:\\s*(?:-|–|to)\\s*({NUMBER}))?(?:\\s*-\\s*|\\s*)({UNIT})\\.?$"

    def convert(m: Column) -> Column:
        q, end = F.regexp_extract(m, parts, 1), F.regexp_extract(m, parts, 2)

        def said(unit: Column) -> Column:
            return let(unit["factor"], lambda f: F.concat(pretty(number(q) * f), F.when(end != "", F.concat(F.lit("–"), pretty(number(end) * f))).otherwise(F.lit("")), F.lit(" "), unit["unit"]))

        return let(unit_of(F.regexp_extract(m, parts, 3)), said)

    text = _rewritten(text, f"(?iu){MEASUREMENT}", convert)
    heat = r"(?i)\b(?:[0-9]+(?:\.[0-9]+)?|\.[0-9]+)\s*(?:°\s*F|F|degrees?\s*F(?:ahrenheit)?|Fahrenheit)\b"
    text = _rewritten(text, heat, lambda m: F.concat(pretty((F.regexp_extract(m, r"^([0-9.]+)", 1).cast("double") - 32) * 5 / 9), F.lit(" °C")))
    text = F.regexp_replace(text, r"(?i)\b(?:tablespoons?|tbsp)\b\.?", "15 mL measure")
    return F.regexp_replace(text, r"(?i)\b(?:teaspoons?|tsp)\b\.?", "5 mL measure")


def servings(text: Column) -> Column:
    """The number of "serves 4", "4 people", "4"; null for any other text."""
    found = F.regexp_extract(text, r"(?i)^\s*(?:serves?\s*)?([0-9]+(?:\.[0-9]+)?)(?:\s*(?:servings?|people|portions?))?\s*$", 1)
    return F.when(found != "", found.cast("double"))


def iso_minutes(text: Column) -> Column:
    """Minutes of PT#H#M#S or "N min"; null otherwise. A bare PT is 0."""
    unit = lambda k: F.coalesce(F.regexp_extract(text, f"([0-9]+){k}", 1).try_cast("double"), F.lit(0.0))
    plain = F.regexp_extract(text, r"(?i)^\s*([0-9]+(?:\.[0-9]+)?)\s*(?:minutes?|mins?)\s*$", 1)
    return F.when(text.rlike(r"^PT(?:[0-9]+H)?(?:[0-9]+M)?(?:[0-9]+S)?$"), unit("H") * 60 + unit("M") + unit("S") / 60).when(plain != "", plain.cast("double"))


ACTION = r"(?i)\b(?:marinate|refrigerate|chill|rest|soak|ferment|proof|simmer|bake|cook|roast|freeze|leave|set aside|saute|sauté|prepare|make)\b|炖|煮|蒸|烤|腌|静置|冷藏"
STORAGE = r"(?i)\b(?:leftovers?|store|storage|keeps? for|lasts? for)\b"


def step_durations(step: Column) -> Column:
    """array<struct<minutes, text>> of a step's explicit durations, a range by its lower end; none for steps on storage or without an action."""
    pattern = rf"(?i)((?<![0-9./]){NUMBER}(?:\s*(?:-|–|to)\s*{NUMBER})?\s*(?:minutes?|mins?|hours?|hrs?|days?|分钟|小时|天)(?![A-Za-z]))"

    def value(m: Column) -> Column:
        factor = F.when(m.rlike(r"(?i)days?$|天$"), 1440.0).when(m.rlike(r"(?i)(?:hours?|hrs?)$|小时$"), 60.0).otherwise(1.0)
        return F.struct((number(F.regexp_extract(m, f"^({NUMBER})", 1)) * factor).alias("minutes"), m.alias("text"))

    found = F.transform(F.regexp_extract_all(step, F.lit(pattern), F.lit(1)), value)
    return F.when(step.rlike(ACTION) & ~step.rlike(STORAGE), found).otherwise(F.array().cast("array<struct<minutes:double,text:string>>"))


def step_minutes(step: Column) -> Column:
    return F.transform(step_durations(step), lambda x: x["minutes"])


def timing_evidence(steps: Column) -> Column:
    """array<struct<instruction_index, minimum_minutes, source_duration>>: the durations that timing goes by, in order, steps counted from 0."""
    def of(step: Column, i: Column) -> Column:
        return F.transform(step_durations(step), lambda x: F.struct(i.alias("instruction_index"), x["minutes"].alias("minimum_minutes"), x["text"].alias("source_duration")))

    return F.flatten(F.transform(steps, of))


def timing(steps: Column, total: Column) -> Column:
    """struct<lower_bound, advance, conflict> of instruction steps against a stated total."""
    longest = F.array_max(F.flatten(F.transform(steps, step_minutes)))
    return let(longest, lambda x: F.struct(x.alias("lower_bound"), F.coalesce(x >= 1440, F.lit(False)).alias("advance"), F.coalesce(x > total, F.lit(False)).alias("conflict")))
