"""Quality rules as a short-circuit cascade, in DataFrame functions only.

The measures are per-row expressions; nothing is shuffled but sums. Each rule's rejections and its cost are
estimated in one pass over a sample of about SAMPLE_ROWS rows (each row is drawn with the same chance, from a
count), of SAMPLE_FILES evenly spaced files where the rows come straight from more files than that, so that no
second read of the whole is needed: around every rule's condition the clock is read in the row itself, after the
measures that the caller makes anyway. Rules are put in order greedily by
rejections among the rows that earlier rules leave, per cost. A CASE in this order decides each row, so a dear
rule runs only for rows that cheaper ones kept; measures that only such a rule needs (LAZY) are made nowhere
else. The order changes the speed, never a verdict.

A text's words are hashed once to 64 bits, and the measures work on the hashes. Repeated three-word windows are
found by sorting a row's window hashes. Up to PACKED words, hash and place share 64 bits, of which at least 49
are the hash's; longer texts sort whole hashes.

Cases: null text counts as empty, has no words and is rejected; repeated rows and other columns pass
through (a column with a measure's name is replaced, in any case of letters); an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh

SAMPLE_ROWS, SAMPLE_FILES = 512, 16
PACKED = 1 << 15
_INK = r"[^\x20\x09-\x0D]"
_BLANK = " \t\n\x0b\x0c\r"
_SYMBOLS = "#*$%&|<>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, evaluated once a row however often body uses it."""
    return F.transform(F.array(value), body)[0]


def _text(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def hashed_words(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(_text(text), F.lit(f"{_INK}+"), F.lit(0)), lambda w: F.xxhash64(w))


def n_words(text: Column, words: Column) -> Column:
    return F.size(words).cast("bigint")


def word_chars(text: Column, words: Column) -> Column:
    return F.length(F.translate(_text(text), _BLANK, "")).cast("bigint")


def n_symbols(text: Column, words: Column) -> Column:
    return (F.length(_text(text)) - F.length(F.translate(_text(text), _SYMBOLS, ""))).cast("bigint")


def n_dup_lines(text: Column, words: Column) -> Column:
    lines = F.filter(F.split(_text(text), "\n"), lambda x: x.rlike(_INK))
    return let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("bigint")


def _window(words: Column, i: Column, size: int) -> Column:
    return F.get(words, i) if size == 1 else F.xxhash64(*(F.get(words, i + k) for k in range(size)))


def n_repeat_words(text: Column, words: Column) -> Column:
    """Words in three-word windows found twice or more in the text."""
    n = F.size(words)

    def packed(i: Column, bits: Column) -> Column:
        return F.call_function("shiftleft", F.call_function("shiftright", _window(words, i, 3), bits), bits).bitwiseOR(i.cast("bigint"))

    def unpacked(x: Column, bits: Column) -> Column:
        low = F.call_function("shiftleft", F.lit(1).cast("bigint"), bits) - 1
        return F.struct(F.call_function("shiftright", x, bits).alias("h"), x.bitwiseAND(low).alias("at"))

    places = F.sequence(F.lit(0), n - 3)
    short = let(F.length(F.bin(n.cast("bigint"))).cast("int"), lambda bits: F.transform(F.sort_array(F.transform(places, lambda i: packed(i, bits))), lambda x: unpacked(x, bits)))
    long = F.sort_array(F.transform(places, lambda i: F.struct(_window(words, i, 3).alias("h"), i.cast("bigint").alias("at"))))

    def twice(keys: Column) -> Column:
        def same(x: Column, other: Column) -> Column:
            return F.coalesce(x["h"] == other["h"], F.lit(False))

        # Beyond the last key, get() gives null; before the first, index -1 does.
        return F.sort_array(F.transform(F.filter(keys, lambda x, i: same(x, F.get(keys, i - 1)) | same(x, F.get(keys, i + 1))), lambda x: x["at"]))

    def covered(found: Column) -> Column:
        gaps = F.transform(found, lambda x, i: F.least(F.lit(3).cast("bigint"), F.coalesce(F.get(found, i + 1), x + 3) - x))
        return F.aggregate(gaps, F.lit(0).cast("bigint"), lambda a, x: a + x)

    return F.when(n < 4, F.lit(0).cast("bigint")).otherwise(let(let(F.when(n < PACKED, short).otherwise(long), twice), covered))


def most_frequent(size: int) -> Callable[[Column, Column], Column]:
    """A measure: how often the text's most frequent window of so many words stands in it."""

    def measure(text: Column, words: Column) -> Column:
        def longest_run(keys: Column) -> Column:
            ends = F.filter(F.sequence(F.lit(1), F.size(keys)), lambda i: ~F.get(keys, i - 1).eqNullSafe(F.get(keys, i)))
            return let(ends, lambda e: F.array_max(F.transform(e, lambda x, i: x - F.coalesce(F.get(e, i - 1), F.lit(0)))))

        keys = F.sort_array(F.transform(F.sequence(F.lit(0), F.size(words) - size), lambda i: _window(words, i, size)))
        return F.when(F.size(words) < size, F.lit(0)).otherwise(let(keys, longest_run)).cast("bigint")

    return measure


#: Measures that every row gets, and those that only the rules that ask for them make.
MEASURES = {"n_words": n_words, "word_chars": word_chars, "n_symbols": n_symbols, "n_dup_lines": n_dup_lines, "n_repeat_words": n_repeat_words}
LAZY = {"n_top_word": most_frequent(1), "n_top_pair": most_frequent(2)}


@dataclass(frozen=True)
class Rule:
    """reject: the condition under which a row goes, from a function that gives measures by name. base: it belongs to base_failed."""

    name: str
    reject: Callable[[Callable[[str], Column]], Column]
    base: bool = False


RULES = (
    Rule("few_words", lambda m: m("n_words") < 50, base=True),
    Rule("repeats", lambda m: 100 * m("n_repeat_words") > 50 * m("n_words"), base=True),
    Rule("symbols", lambda m: 5 * m("n_symbols") > m("n_words")),
    Rule("short_words", lambda m: m("word_chars") < 2 * m("n_words")),
    Rule("long_words", lambda m: m("word_chars") > 40 * m("n_words")),
    Rule("duplicate_lines", lambda m: 2 * m("n_dup_lines") > m("n_words")),
    Rule("top_word", lambda m: 100 * m("n_top_word") > 30 * m("n_words")),
    Rule("top_pair", lambda m: 100 * 2 * m("n_top_pair") > 20 * m("n_words")),
)


def _measures(text: Column, words: Column, ready: tuple[str, ...] = ()) -> Callable[[str], Column]:
    """Measures by name: a column where it is ready, else the expression."""
    return lambda name: F.col(name) if name in ready else (MEASURES | LAZY)[name](text, words)


def some_files(docs: DataFrame, n: int = SAMPLE_FILES) -> DataFrame:
    """docs' rows of at most n of the files that they come from, evenly spaced; all rows where docs aren't plain columns of files. Spark
    leaves out the other files when it plans the scan."""
    files = sorted(docs.inputFiles())
    if len(files) <= n:
        return docs
    plain = lambda path: F.regexp_replace(path, "^file:/+", "file:/")  # noqa: E731  a local path comes in two forms
    chosen = [F.lit(files[k * len(files) // n]) for k in range(n)]
    try:
        return docs.where(plain(F.col("_metadata.file_path")).isin([plain(f) for f in chosen]))
    except AnalysisException:
        return docs


def rule_order(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text", sample_rows: int = SAMPLE_ROWS, ready: tuple[str, ...] = ()) -> list[Rule]:
    """Rules in the order of rejections per nanosecond on a sample, each judged on what those before it leave.

    ready: measures that are made for every row before the cascade, whose cost no rule is charged."""
    text = F.col(text_col)

    def clock() -> Column:
        return F.call_function("reflect", F.lit("java.lang.System"), F.lit("nanoTime")).cast("bigint")

    def timed(words: Column) -> Column:
        def after(made: Column) -> Column:
            other = _measures(text, words)
            measure = lambda name: made[name] if name in ready else other(name)
            parts = [clock().alias("idle"), clock().alias("t0")]
            for k, rule in enumerate(rules):
                parts += [F.coalesce(rule.reject(measure), F.lit(False)).alias(f"r{k}"), clock().alias(f"t{k + 1}")]
            return F.struct(*parts)

        return let(F.struct(*(MEASURES[name](text, words).alias(name) for name in ready)), after) if ready else after(words)

    rows = some_files(docs)
    share = min(1.0, sample_rows / max(1, rows.count()))
    sample = rows.where(F.rand(11) < share).select(let(hashed_words(text), timed).alias("x"))
    idle = F.sum(F.col("x.t0") - F.col("x.idle")).alias("idle")
    spent = [F.sum(F.col(f"x.t{k + 1}") - F.col(f"x.t{k}")).alias(f"c{k}") for k in range(len(rules))]
    outcomes = sample.groupBy(*(F.col(f"x.r{k}").alias(f"r{k}") for k in range(len(rules)))).agg(F.count("*").alias("n"), idle, *spent).collect()  # at most 2^rules rows
    cost = [max(1, sum(o[f"c{k}"] - o["idle"] for o in outcomes)) for k in range(len(rules))]
    left, order = set(range(len(rules))), []
    while left:
        gone = {k: sum(o["n"] for o in outcomes if o[f"r{k}"]) for k in left}
        best = max(sorted(left), key=lambda k: (gone[k] / cost[k], -cost[k]))
        order.append(rules[best])
        left.remove(best)
        outcomes = [o for o in outcomes if not o[f"r{best}"]]
    return order


def verdict(order: list[Rule], measure: Callable[[str], Column]) -> Column:
    """True if no rule rejects; rules after the first that does aren't evaluated."""
    out = F
    for rule in order:
        out = out.when(rule.reject(measure), F.lit(False))
    return out.otherwise(F.lit(True)) if order else F.lit(True)


def apply_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text", order: list[Rule] | None = None) -> DataFrame:
    """docs with all measures, base_failed (a base rule rejects) and kept."""
    order = rule_order(docs, rules, text_col, ready=tuple(MEASURES)) if order is None else order
    added = [*MEASURES, "base_failed", "kept"]
    kept = [c for c in docs.columns if c.lower() not in added]
    words, text = fresh("_words", docs.columns), fresh("_text", docs.columns)
    source = docs.select(*kept, F.col(text_col).alias(text), hashed_words(F.col(text_col)).alias(words))
    measured = source.select(*kept, text, words, *(f(F.col(text), F.col(words)).alias(name) for name, f in MEASURES.items()))
    measure, base = _measures(F.col(text), F.col(words), tuple(MEASURES)), F.lit(False)
    for rule in rules:
        if rule.base:
            base = base | rule.reject(measure)
    return measured.select(*kept, *MEASURES, base.alias("base_failed"), verdict(order, measure).alias("kept"))


def keep_good(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text") -> DataFrame:
    """The rows that no rule rejects, with docs' columns; measures are evaluated only as far as the cascade goes."""
    order = rule_order(docs, rules, text_col)
    return docs.where(let(hashed_words(F.col(text_col)), lambda words: verdict(order, _measures(F.col(text_col), words))))
