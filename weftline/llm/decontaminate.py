"""Benchmark decontamination by an FM-index per training shard.

A shard is about SHARD_BYTES of whole documents of one partition. Its words are mapped to the symbols of
the benchmark's vocabulary; a maximal run of such words, if it is at least as long as the shortest
phrase, is a segment of the shard's index (any other word can't be part of a phrase, so nothing is
lost). Every phrase is searched backwards through wavelet ranks, its occurrences are located by sampled
suffix positions, and the word spans that they cover are merged into removal spans. There is no shuffle.

A phrase is a window of ``window`` consecutive words of an item; an item of fewer words, but not none, is
one phrase. Words are [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ after lower-casing A-Z.

The benchmark is read in blocks of at most 2 * BLOCK_WORDS words. One block is broadcast and searched for in a pass over the
documents. If there are more, documents are numbered and written once, and every block has a job of its own: its spans and
items are written, only for documents that have some, and its broadcast is destroyed before the next block's is made; a last
pass joins what was found by number and merges it. So the driver and a task hold one block at a time, whatever the
benchmark is. An item of more than BLOCK_WORDS words comes in pieces that overlap by a window less a word.

Cases: null texts have no words; null or repeated item ids are items like others (a null id isn't
listed); an item's repeated window counts once; repeated documents are judged alike; other columns pass
through, one with an output's name is replaced; an empty benchmark leaves all documents clean.
"""

from __future__ import annotations

import re
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, map_columns, ready, written
from .fm_index import FmIndex
from .textkit import HashTable, ragged, slices, words

SHARD_BYTES = 1 << 20
BLOCK_WORDS = 1 << 20

#: Words before lower-casing.
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")

ADDED = {
    "n_words": "bigint",
    "removal_spans": "array<struct<first_word:bigint,end_word:bigint,first_byte:bigint,end_byte:bigint>>",
    "item_ids": "array<string>",
}


class Phrases:
    """The windows of a block of benchmark items, as symbols of the block's vocabulary (from 1)."""

    def __init__(self, texts: list[str | None], window: int):
        by_size: dict[int, dict[bytes, list[int]]] = {}
        for i, _, data, offsets in slices(pa.array(texts, pa.string())):
            h, _, _, first = words(data, offsets)
            for k, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
                size = min(window, b - a)
                for p in range(a, b - size + 1) if size else ():
                    items = by_size.setdefault(size, {}).setdefault(h[p : p + size].tobytes(), [])
                    if not items or items[-1] != i + k:
                        items.append(i + k)
        self.sizes = sorted(by_size)
        raw = {n: np.frombuffer(b"".join(by_size[n]), np.uint64).reshape(-1, n) for n in self.sizes}
        self.vocabulary = np.unique(np.concatenate([x.ravel() for x in raw.values()])) if raw else np.zeros(0, np.uint64)
        self.sigma = len(self.vocabulary) + 1
        self.rows = {n: np.searchsorted(self.vocabulary, raw[n]) + 1 for n in self.sizes}
        listed = {n: list(by_size[n].values()) for n in self.sizes}
        self.item_at = {n: np.concatenate([[0], np.cumsum([len(x) for x in listed[n]])]) for n in self.sizes}
        self.items = {n: np.array([i for x in listed[n] for i in x], np.int64) for n in self.sizes}

    def table(self) -> HashTable:
        out = HashTable(max(16, len(self.vocabulary)))
        out.put(self.vocabulary, np.arange(1, self.sigma, dtype=np.int32))
        return out


def search_shard(phrases: Phrases, table: HashTable, h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which of a shard's words are hit, and the distinct (document, item) pairs found."""
    n = len(h)
    hit = np.zeros(n, bool)
    none = np.zeros(0, np.int64)
    if not n or not phrases.sizes:
        return hit, none, none
    symbol = table.get(h)
    known = symbol > 0
    edge = np.zeros(n + 1, bool)
    edge[first] = True
    start = np.flatnonzero(known & (edge[:-1] | ~np.append(False, known[:-1])))
    end = np.flatnonzero(known & (edge[1:] | ~np.append(known[1:], False))) + 1
    long = end - start >= phrases.sizes[0]
    start, end = start[long], end[long]
    most = 1 << 19
    if len(start) and (end - start).max() > most:  # such a segment is cut into parts that share all but one word of a longest phrase
        cuts = [(p, min(p + most + phrases.sizes[-1], b)) for a, b in zip(start.tolist(), end.tolist(), strict=True) for p in range(a, b, most)]
        start, end = (np.array(x, np.int64) for x in zip(*cuts, strict=True))
    pairs = []
    cover = np.zeros(n + 1, np.int64)
    # One index over at most 2^20 words, or a little over.
    total = np.cumsum(end - start + 1)
    part = 0
    while part < len(start):
        done = total[part - 1] if part else 0
        upto = max(part + 1, int(np.searchsorted(total, done + (1 << 20), "right")))
        s, size = start[part:upto], (end - start)[part:upto] + 1
        part = upto
        word = ragged(s, size)
        text = symbol[np.minimum(word, n - 1)]
        text[np.cumsum(size) - 1] = 0
        index = FmIndex(text, phrases.sigma)
        for length in phrases.sizes:
            which, low, high = index.search(phrases.rows[length])
            if not len(which):
                continue
            at = word[index.locate(ragged(low, high - low))]
            which = np.repeat(which, high - low)
            np.add.at(cover, at, 1)
            np.add.at(cover, at + length, -1)
            doc = np.searchsorted(first, at, "right") - 1
            seen = np.unique(doc * len(phrases.rows[length]) + which)
            doc, which = seen // len(phrases.rows[length]), seen % len(phrases.rows[length])
            counts = np.diff(phrases.item_at[length])[which]
            item = phrases.items[length][ragged(phrases.item_at[length][which], counts)]
            pairs.append((np.repeat(doc, counts), item))
    hit = np.cumsum(cover)[:-1] > 0
    if not pairs:
        return hit, none, none
    doc, item = (np.concatenate(x) for x in zip(*pairs, strict=True))
    seen = np.unique(doc << 32 | item)
    return hit, seen >> 32, seen & 0xFFFFFFFF


def _runs(hit: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.zeros(len(hit) + 1, bool)
    edge[first] = True
    return np.flatnonzero(hit & (edge[:-1] | ~np.append(False, hit[:-1]))), np.flatnonzero(hit & (edge[1:] | ~np.append(hit[1:], False))) + 1


def _pass(df: DataFrame, shared, text_col: str, more: bool, keep: list[str] | None, cut: bool) -> DataFrame:
    """A block's spans and items (shared: its broadcast phrases and ids), merged with those in df's own columns if there are more. cut: text_col comes without the spans."""

    def make():
        phrases, ids = shared.value
        table = phrases.table()

        def f(batch):
            for i, j, data, offsets in slices(batch.column(batch.schema.get_field_index(text_col)), SHARD_BYTES):
                h, start, end, first = words(data, offsets)
                hit, doc, item = search_shard(phrases, table, h, first)
                listed = [set() for _ in range(j - i)]
                for d, k in zip(doc.tolist(), item.tolist(), strict=True):
                    if ids[k] is not None:
                        listed[d].add(ids[k])
                if more:
                    spans = batch.column(batch.schema.get_field_index("removal_spans")).slice(i, j - i).to_pylist()
                    items = batch.column(batch.schema.get_field_index("item_ids")).slice(i, j - i).to_pylist()
                    for d, (old, some) in enumerate(zip(spans, items, strict=True)):
                        listed[d].update(some)
                        for span in old:
                            hit[first[d] + span["first_word"] : first[d] + span["end_word"]] = True
                a, b = _runs(hit, first)
                d = np.searchsorted(first, a, "right") - 1
                bound = np.searchsorted(d, np.arange(j - i + 1))
                spans = pa.StructArray.from_arrays(
                    [pa.array(x, pa.int64()) for x in (a - first[d], b - first[d], start[a] - offsets[d], end[b - 1] - offsets[d])],
                    names=["first_word", "end_word", "first_byte", "end_byte"],
                )
                out = [pa.array(np.diff(first), pa.int64()), pa.ListArray.from_arrays(pa.array(bound, pa.int32()), spans), pa.array([sorted(x) for x in listed], pa.list_(pa.string()))]
                if cut:
                    texts = batch.column(batch.schema.get_field_index(text_col)).slice(i, j - i)
                    out.append(_without(texts, data, offsets, start[a], end[b - 1], bound) if len(a) else texts)
                yield i, j, out

        return f

    return map_columns(df, make, ADDED | ({text_col: "string"} if cut else {}), keep)


def _without(texts: pa.Array, data: np.ndarray, offsets: np.ndarray, start: np.ndarray, end: np.ndarray, bound: np.ndarray) -> pa.Array:
    """texts, of the slice data, with the byte ranges start to end cut out; bound tells where each text's ranges begin."""
    out = texts.to_pylist()
    raw = data.tobytes()
    for d in np.flatnonzero(np.diff(bound)).tolist():
        own = slice(bound[d], bound[d + 1])
        edges = [offsets[d], *np.stack([start[own], end[own]], 1).ravel().tolist(), offsets[d + 1]]
        out[d] = b"".join(raw[x:y] for x, y in zip(edges[::2], edges[1::2], strict=True)).decode()
    return pa.array(out, pa.string())


def _pieces(text: str, window: int):
    """(piece, number of words) of an item: all of its windows, in pieces of at most BLOCK_WORDS words or one window."""
    at = [m.span() for m in _WORD.finditer(text)]
    size = max(BLOCK_WORDS, window)
    for p in range(0, max(1, len(at) - window + 1), size - window + 1) if len(at) > size else ():
        some = at[p : p + size]
        yield text[some[0][0] : some[-1][1]], len(some)
    if len(at) <= size:
        yield text, len(at)


def _blocks(benchmark: DataFrame, item_text_col: str, item_id_col: str, window: int):
    """(ids, texts) of each block; one at least."""
    texts, ids, size = [], [], 0
    for row in benchmark.select(benchmark[item_id_col].cast("string"), benchmark[item_text_col]).toLocalIterator():
        for piece, n in _pieces(row[1] or "", window):
            if size >= BLOCK_WORDS:
                yield ids, texts
                texts, ids, size = [], [], 0
            ids.append(row[0])
            texts.append(piece)
            size += n
    yield ids, texts


def find_leaks(docs: DataFrame, benchmark: DataFrame, window: int = 10, text_col: str = "text", item_text_col: str = "text", item_id_col: str = "item_id", keep: list[str] | None = None, cut: bool = False) -> DataFrame:
    """docs with n_words, removal_spans (merged, in order, in words and bytes of the text) and item_ids
    (as strings, sorted) of the benchmark items whose phrases occur. cut: text_col comes with the spans cut out."""
    spark = ready(docs.sparkSession)
    blocks = _blocks(benchmark, item_text_col, item_id_col, window)
    block, after = next(blocks), next(blocks, None)

    def shared(block):
        return spark.sparkContext.broadcast((Phrases(block[1], window), block[0]))

    if after is None:
        return _pass(docs, shared(block), text_col, False, keep, cut)
    row = fresh("_row", [*docs.columns, *ADDED])
    rows = written(docs.drop(*(c for c in ADDED if c != text_col)).withColumn(row, F.monotonically_increasing_id()), "numbered")
    found = []
    while block is not None:
        sent = shared(block)
        found.append(written(_pass(rows.select(row, text_col), sent, text_col, False, [row], False).drop("n_words").where(F.size("removal_spans") > 0), "spans"))
        sent.destroy()
        block, after = after, next(blocks, None)
    each = reduce(DataFrame.unionByName, found).groupBy(row).agg(*(F.flatten(F.collect_list(c)).alias(c) for c in ("removal_spans", "item_ids")))
    joined = rows.join(each, row, "left").withColumns({c: F.coalesce(c, F.array().cast(ADDED[c])) for c in ("removal_spans", "item_ids")})
    return _pass(joined, shared(([], [])), text_col, True, docs.columns if keep is None else keep, cut)
