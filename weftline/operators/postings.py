"""An inverted index for ranked search: a query reads the postings of its own words only, and stops early.

Tables in one folder:
* records: the records in catalog order, numbered (numbering.Numbered); row = number - 1, block = row div BLOCK.
* postings: (term, block, row, field, at), one row for each word of a record's texts, sorted by term, block and row and
  dealt into ranges of these, so that a term in every record spans many files. at is 4 * position + 2 where the word is
  its text's first + 1 where it is its last; positions run on over a record's texts with a gap between two texts.
* blocks: (term, block, fields): which fields of a block's records hold a term, as bits. From these follow the best
  priority and number of items that any record of a block can reach for a query (its block maximum).

A search takes the blocks with the best bounds, evaluates their postings exactly, and goes on with the next ones only while
one of them could still hold a record that belongs among the k best found. Terms and blocks reach the scan as filters.
Results equal search.rank's, in the order priority, most items, catalog order.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import numbering
from .search import Part
from .storage import fresh, hadoop

BLOCK = 4096
TITLE, CANONICAL, TERM, METADATA = range(4)
#: Blocks that the first step of a search evaluates; every further step takes twice as many, up to the last number.
FIRST_STEP, LARGEST_STEP = 16, 4096


def build(rows: DataFrame, key: str, order: list[Column], titles: list[Column], items: Column, metadata: Column, folder: str, block: int = BLOCK) -> Index:
    """Writes the index of rows to a new folder. titles, items (array<struct<canonical, terms>>) and metadata are as in search.rank; order is total."""
    none = F.array().cast("array<string>")
    lines = F.coalesce(items, F.array().cast("array<struct<canonical:string,terms:array<string>>>"))
    texts = F.concat(
        F.array(*(F.struct(F.lit(TITLE).alias("field"), t.alias("text")) for t in titles)),
        F.transform(lines, lambda i: F.struct(F.lit(CANONICAL).alias("field"), i["canonical"].alias("text"))),
        F.flatten(F.transform(lines, lambda i: F.transform(F.coalesce(i["terms"], none), lambda t: F.struct(F.lit(TERM).alias("field"), t.alias("text"))))),
        F.array(F.struct(F.lit(METADATA).alias("field"), metadata.alias("text"))),
    )
    spark, held = rows.sparkSession, fresh("_texts", rows.columns)
    staged = numbering.number(rows.withColumn(held, texts), order, f"{folder}/_staged", keep=[key, held])
    staged.table.select(key, numbering.RANGE, numbering.PLACE).write.parquet(f"{folder}/records")
    row = F.col("_number") - 1

    def marked(t: Column) -> Column:
        words = F.filter(F.split(F.coalesce(t["text"], F.lit("")), " "), lambda w: w != "")
        own = lambda ws: F.transform(ws, lambda w, i: F.struct(t["field"].alias("field"), w.alias("term"), (F.when(i == 0, 2).otherwise(0) + F.when(i == F.size(ws) - 1, 1).otherwise(0)).alias("ends")))
        gap = F.array(F.struct(t["field"].alias("field"), F.lit(None).cast("string").alias("term"), F.lit(0).alias("ends")))
        return F.concat(F.transform(F.array(words), own)[0], gap)

    said = staged.rows("_number").select(row.alias("row"), F.posexplode(F.flatten(F.transform(held, marked))).alias("position", "w")).where("w.term is not null")
    found = said.select(F.col("w.term").alias("term"), F.floor(F.col("row") / block).cast("bigint").alias("block"), "row", F.col("w.field").alias("field"), (F.col("position").cast("bigint") * 4 + F.col("w.ends")).alias("at"))
    numbering.in_order(found, [F.col(c) for c in ("term", "block", "row", "field", "at")]).write.parquet(f"{folder}/postings")
    seen = spark.read.parquet(f"{folder}/postings").groupBy("term", "block").agg(F.bit_or(F.expr("shiftleft(1, field)")).alias("fields"))
    numbering.in_order(seen, [F.col("term"), F.col("block")]).write.parquet(f"{folder}/blocks")
    at, fs = hadoop(spark, f"{folder}/_staged")
    fs.delete(at, True)
    return Index(spark, folder, key, block)


@dataclass(frozen=True)
class Index:
    spark: SparkSession
    folder: str
    key: str
    block: int = BLOCK

    def search(self, parts: list[Part], k: int) -> DataFrame:
        """(key, row, priority, n_items) of the first k eligible records, with place from 1 on. k, a report's length, is held on the driver."""
        records = numbering.opened(self.spark, f"{self.folder}/records")
        if not parts:
            best = [(0, 0, r) for r in range(min(k, records.total))]
        else:
            best = self._best(_Query(parts), k)
        places = self.spark.createDataFrame([(n + 1, p, -i, r) for n, (p, i, r) in enumerate(best)], "place int, priority int, n_items int, row bigint")
        named = records.pick([r + 1 for _, _, r in best]).select(self.key, (F.col("number") - 1).alias("row"))
        return named.join(F.broadcast(places), "row").select(self.key, "row", "priority", "n_items", "place")

    def all(self, parts: list[Part]) -> DataFrame:
        """(key, row, priority, n_items) of all eligible records."""
        records = numbering.opened(self.spark, f"{self.folder}/records").rows().select(self.key, (F.col("number") - 1).alias("row"))
        if not parts:
            return records.withColumns({"priority": F.lit(0), "n_items": F.lit(0)})
        return records.join(self._evaluated(_Query(parts), None), "row")

    def bounds(self, query: _Query) -> DataFrame:
        """(block, priority, fewer): the best that any record of a block could reach, fewer being -n_items. Blocks without eligible records are left out where that is certain."""
        rows = self.spark.read.parquet(f"{self.folder}/blocks").where(query.wanted())
        has = {w: F.coalesce(F.bit_or(F.when(F.col("term") == w, F.col("fields"))), F.lit(0)).alias(f"w{n}") for n, w in enumerate(query.words)}
        begins = F.coalesce(F.bool_or(F.startswith(F.col("term"), F.lit(query.text[-1])) & (F.col("fields").bitwiseAND(1 << TITLE) != 0)), F.lit(False)).alias("begins")
        known = rows.groupBy("block").agg(*has.values(), begins)

        def there(phrase: tuple[str, ...], *fields: int) -> Column:
            return _any([_all([F.col(f"w{query.words.index(w)}").bitwiseAND(1 << f) != 0 for w in phrase]) for f in fields])

        items = [_any([there(x, CANONICAL) for x in (*p.inside_canonical, *p.canonical)] + [there(x, TERM) for x in p.inside]) for p in query.parts]
        every = _all([i | there(p.phrase, METADATA) for i, p in zip(items, query.parts, strict=True)])
        exact = there(query.text, TITLE)
        strong = exact | (_all([there((w,), TITLE) for w in query.text[:-1]]) & F.col("begins"))
        count = sum((i.cast("int") for i in items), F.lit(0))
        return known.where(every | exact | strong).select("block", _priority(exact, strong, count, len(items)).alias("priority"), (-count).alias("fewer"))

    def _best(self, query: _Query, k: int) -> list[tuple[int, int, int]]:
        best: list[tuple[int, int, int]] = []
        last, step = None, FIRST_STEP
        while True:
            rows = self.bounds(query)
            bound = F.struct("priority", "fewer", "block")
            if last is not None:
                rows = rows.where(bound > F.struct(F.lit(last[0]).alias("priority"), F.lit(last[1]).alias("fewer"), F.lit(last[2]).cast("bigint").alias("block")))
            # One more than is evaluated: its bound tells whether to go on.
            some = [tuple(r) for r in rows.select("priority", "fewer", "block").orderBy("priority", "fewer", "block").limit(step + 1).collect()]
            if some[:step]:
                found = self._evaluated(query, [b for _, _, b in some[:step]]).select("priority", (-F.col("n_items")).alias("fewer"), "row")
                best = sorted([*best, *(tuple(r) for r in found.orderBy("priority", "fewer", "row").limit(k).collect())])[:k]
            if len(some) <= step or (len(best) == k and best[-1] < (some[step][0], some[step][1], some[step][2] * self.block)):
                return best
            last, step = some[step - 1], min(step * 2, LARGEST_STEP)

    def _evaluated(self, query: _Query, blocks: list[int] | None) -> DataFrame:
        """(row, priority, n_items) of eligible records of some blocks, or of all."""
        rows = self.spark.read.parquet(f"{self.folder}/postings").where(query.wanted())
        if blocks is not None:
            rows = rows.where(F.col("block").isin(blocks))
        lists = {(w, f): F.collect_list(F.when((F.col("term") == w) & (F.col("field") == f), F.col("at"))).alias(f"p{f}_{n}") for n, w in enumerate(query.words) for f in range(4)}
        begins = F.collect_list(F.when(F.startswith(F.col("term"), F.lit(query.text[-1])) & (F.col("field") == TITLE), F.col("at"))).alias("begins")
        # A group is one record: its lists are no longer than its texts.
        told = rows.groupBy("row").agg(*lists.values(), begins)

        def places(w: str, f: int, only: int = 0) -> Column:
            return _places(F.col(f"p{f}_{query.words.index(w)}"), only)

        def stands(phrase: tuple[str, ...], f: int, whole: bool = False) -> Column:
            last = len(phrase) - 1
            each = [_back(places(w, f, (2 if whole and n == 0 else 0) | (1 if whole and n == last else 0)), n) for n, w in enumerate(phrase)]
            return F.size(_common(each)) > 0

        items = [
            _any([stands(x, CANONICAL) for x in p.inside_canonical] + [stands(x, CANONICAL, True) for x in p.canonical] + [stands(x, TERM) for x in p.inside])
            for p in query.parts
        ]
        every = _all([i | stands(p.phrase, METADATA) for i, p in zip(items, query.parts, strict=True)])
        exact = stands(query.text, TITLE, True)
        head = [_back(places(w, TITLE, 2 if n == 0 else 0), n) for n, w in enumerate(query.text[:-1])]
        tail = _back(_places(F.col("begins"), 0 if head else 2), len(head))
        strong = (F.size(_common([*head, tail])) > 0) | stands(query.text, TITLE)
        out = told.select("row", every.alias("_every"), exact.alias("_exact"), strong.alias("_strong"), sum((i.cast("int") for i in items), F.lit(0)).alias("n_items"))
        priority = _priority(F.col("_exact"), F.col("_strong"), F.col("n_items"), len(items))
        return out.where("_every or _exact or _strong").select("row", priority.alias("priority"), "n_items")


@dataclass(frozen=True)
class _Part:
    phrase: tuple[str, ...]
    inside: tuple[tuple[str, ...], ...]
    inside_canonical: tuple[tuple[str, ...], ...]
    canonical: tuple[tuple[str, ...], ...]


class _Query:
    """The words and phrases of a query's parts."""

    def __init__(self, parts: list[Part]):
        cut = lambda x: tuple(w for w in x.split(" ") if w)
        self.text = tuple(w for p in parts for w in cut(p.phrase))
        self.parts = []
        for p in parts:
            own = tuple(filter(None, map(cut, p.phrases or (p.phrase,))))
            self.parts.append(_Part(cut(p.phrase), own, tuple(dict.fromkeys([cut(p.phrase), *own])), tuple(filter(None, map(cut, p.canonical)))))
        phrases = [self.text, *(x for p in self.parts for x in (p.phrase, *p.inside, *p.canonical))]
        self.words = sorted({w for x in phrases for w in x})
        if not self.text or not all(p.phrase for p in self.parts):
            raise ValueError("a part without words")

    def wanted(self) -> Column:
        """What the scan reads: the words' rows, and those of words that begin with the last one, which may stand in a title that begins with the query."""
        return F.col("term").isin(self.words) | F.startswith(F.col("term"), F.lit(self.text[-1]))


def _places(at: Column, only: int) -> Column:
    """Positions of those places that have all bits of only."""
    return F.transform(F.filter(at, lambda x: x.bitwiseAND(only) == only) if only else at, lambda x: F.shiftright(x, 2))


def _back(places: Column, n: int) -> Column:
    return F.transform(places, lambda x: x - n) if n else places


def _common(each: list[Column]) -> Column:
    out = each[0]
    for x in each[1:]:
        out = F.array_intersect(out, x)
    return out


def _priority(exact: Column, strong: Column, count: Column, parts: int) -> Column:
    return F.when(exact, 0).when(strong, 1).when(count == parts, 2).when(count > 0, 3).otherwise(4)


def _any(conditions: list[Column]) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


def _all(conditions: list[Column]) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out
