"""Ranked search over items and metadata."""

from __future__ import annotations

from dataclasses import dataclass
from urllib.parse import parse_qsl, urlencode

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import contains_words, search_text


@dataclass(frozen=True)
class Part:
    """One part of a query: its phrase, the canonical items it names, and all spellings of those."""

    phrase: str
    canonical: tuple[str, ...] = ()
    phrases: tuple[str, ...] = ()


def parse_query(words: list[str], terms: dict[str, set[str]], variants: dict[str, set[str]], longest: int = 8) -> list[Part]:
    """Left to right, the longest known term of up to eight words, else one word."""
    out, i = [], 0
    while i < len(words):
        n = next((n for n in range(min(longest, len(words) - i), 1, -1) if " ".join(words[i : i + n]) in terms), 1)
        phrase = " ".join(words[i : i + n])
        names = terms.get(phrase, set())
        out.append(Part(phrase, tuple(sorted(names)), tuple(sorted({phrase}.union(*(variants.get(x, set()) for x in names))))))
        i += n
    return out


def rank(rows: DataFrame, parts: list[Part], titles: list[Column], items: Column, metadata: Column) -> DataFrame:
    """Eligible rows with priority (0 exact title, 1 title contains, 2 all parts are items, 3 some, 4 metadata only) and n_items.

    titles, metadata: search texts; items: array<struct<canonical, terms>> of search texts. No parts: all rows, priority 0."""
    if not parts:
        return rows.withColumns({"priority": F.lit(0), "n_items": F.lit(0)})
    text = " ".join(p.phrase for p in parts)

    def hit(p: Part) -> Column:
        return F.coalesce(F.exists(items, lambda i: i["canonical"].isin(*p.canonical, *([] if p.canonical else ["\x00"])) | contains_words(i["canonical"], F.lit(p.phrase)) | F.exists(F.concat(F.array(i["canonical"]), i["terms"]), lambda t: _any(contains_words(t, F.lit(x)) for x in p.phrases or (p.phrase,)))), F.lit(False))

    hits = [hit(p) for p in parts]
    count = sum((h.cast("int") for h in hits), F.lit(0))
    every = F.lit(True)
    for p, h in zip(parts, hits, strict=True):
        every = every & (h | contains_words(metadata, F.lit(p.phrase)))
    exact = _any(t == text for t in titles)
    strong = _any(F.startswith(t, F.lit(text)) | contains_words(t, F.lit(text)) for t in titles)
    scored = rows.withColumns({"_every": every, "_exact": exact, "_strong": strong, "n_items": count}).where("_every or _exact or _strong")
    priority = F.when(F.col("_exact"), 0).when(F.col("_strong"), 1).when(F.col("n_items") == len(parts), 2).when(F.col("n_items") > 0, 3).otherwise(4)
    return scored.withColumn("priority", priority).drop("_every", "_exact", "_strong")


def _any(conditions) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | F.coalesce(c, F.lit(False))
    return out


def prepare(rows: DataFrame, items: Column, normalized: bool = False) -> tuple[DataFrame, DataFrame]:
    """(terms, variants): what queries are read with, from rows' items (array<struct<canonical, terms, aliases>>).

    terms: (term, canonical) for every spelling and line that names an item; variants: (canonical, variant) for its
    curated spellings. Both are distinct; as tables they may be of any size."""
    lines = rows.select(F.explode(items).alias("i"))
    found = lines.select(F.col("i.canonical").alias("c"), F.col("i.terms").alias("t"), F.coalesce("i.aliases", F.array().cast("array<string>")).alias("a"))
    named = found.withColumn("c", search_text(F.col("c"), normalized)).where("c <> ''")
    said = named.select("c", F.explode(F.concat(F.array("c"), F.coalesce("t", F.array().cast("array<string>")))).alias("x")).distinct()
    also = named.select("c", F.explode(F.concat(F.array("c"), "a")).alias("x")).distinct()
    terms = said.withColumn("term", search_text(F.col("x"), normalized)).where("term <> ''").select("term", F.col("c").alias("canonical")).distinct()
    variants = also.withColumn("variant", search_text(F.col("x"), normalized)).where("variant <> ''").select(F.col("c").alias("canonical"), "variant").distinct()
    return terms, variants


def query_parts(text: str, terms: DataFrame, variants: DataFrame, longest: int = 8) -> list[Part]:
    """parse_query of a query's words with the rows of prepare's tables that concern it: only these reach the driver."""
    words = text.split()
    phrases = {" ".join(words[i : i + n]) for i in range(len(words)) for n in range(1, longest + 1) if i + n <= len(words)}
    if not phrases:
        return []
    mine = terms.where(F.col("term").isin(*sorted(phrases)))
    names: dict[str, set[str]] = {}
    for r in mine.collect():
        names.setdefault(r["term"], set()).add(r["canonical"])
    spelt: dict[str, set[str]] = {}
    for r in variants.join(mine.select("canonical").distinct(), "canonical", "left_semi").collect():
        spelt.setdefault(r["canonical"], set()).add(r["variant"])
    return parse_query(words, names, spelt, longest)


def order(kind: str, searched: bool, title: str = "title", minutes: str = "minutes", position: str = "position", key: str = "id") -> list[Column]:
    """The order of found rows. "default": by priority and items where something was searched for, then catalog position;
    "time": by minutes, unknown ones last; "name": by title. Ties by title and key."""
    ties = [F.col(title), F.col(key)]
    if kind == "time":
        return [F.col(minutes).asc_nulls_last(), *ties]
    if kind == "name":
        return ties
    return [*([F.col("priority"), F.desc("n_items")] if searched else []), F.col(position), *ties]


def to_url(query: str, filters: dict[str, str], sort: str = "default", page: int = 1) -> str:
    """A search's state as a URL's query string; what is at its default is left out, but for the page."""
    pairs = [("q", query), *filters.items(), ("sort", "" if sort == "default" else sort), ("page", str(page))]
    return urlencode([(k, v) for k, v in pairs if v])


def from_url(text: str, axes: list[str]) -> tuple[str, dict[str, str], str, int]:
    """(query, filters, sort, page) of a query string; unknown names are ignored, a page that is no positive number is the first."""
    given = dict(parse_qsl(text.lstrip("?")))
    page = given.get("page", "1")
    return given.get("q", ""), {a: given[a] for a in axes if given.get(a)}, given.get("sort", "default"), max(1, int(page)) if page.isascii() and page.isdigit() else 1
