"""Language identification by hyperdimensional profiles.

Every letter has a random vector of DIM entries +1 and -1 (a bit each, from a counter-based hash, so that no table of letters
is needed). A 3-gram of letters is bound from its letters' vectors, the first one permuted twice, the second once: the
product of entries, which is XOR of bits; a permutation turns the vector by 64 entries. Text is lower-cased code point by
code point, and a run of anything but letters is one blank, which is a letter of its own here. A document's vector is the
bundle of its 3-grams' vectors, a language's prototype that of all its training documents; a 3-gram that occurs c times has
the weight 16 log2(1 + c), rounded, so that neither long documents nor thousands of copies of one text rule a profile.
Weights are integers, so bundles are exact and don't depend on how rows are dealt. A document gets the language whose
prototype has the greatest cosine.

A block of documents is bundled as weights (documents x distinct 3-grams) times vectors (distinct 3-grams x DIM), the
vectors made for at most GRAMS 3-grams at a time; this bounds memory for texts of any length and script. Learning counts
3-grams of languages first (a sum in each task, then by key), so that vectors are made once for each 3-gram.

Cases: a text that is null or has no letter gets "und" and score 0, as all texts do where there was nothing to learn from;
languages of equal cosine are taken in their order; repeated rows get equal results, one for each row; extra columns pass
through, and one that has an output's name is replaced; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, map_columns, release
from .textkit import _LETTER, _kinds, mix, slices

DIM = 1024
SEED = 12
#: A block is so many documents, or so many bytes, whichever is less; a longer document is a block of its own.
BLOCK_DOCS, BLOCK_BYTES = 64, 1 << 17
GRAMS = 4096
#: Distinct 3-grams that a counting task holds before it hands them on.
HELD = 1 << 19
#: The prototypes stand in every task: DIM * 8 bytes a language. More languages are an error.
MAX_LANGUAGES = 1024
OUT = ["lang_pred", "score", "margin"]


@cache
def _lower() -> np.ndarray:
    """Code point to its lower case where that is one code point; 0 where it is no letter."""
    out = np.arange(0x110000, dtype=np.uint32)
    for i in range(0x110000):
        low = chr(i).lower()
        if len(low) == 1:
            out[i] = ord(low)
    out[_kinds() != _LETTER] = 0
    return out


def letter_bits(points: np.ndarray, dim: int, seed: int) -> np.ndarray:
    """(points, dim / 64) random words."""
    word = np.arange(dim // 64, dtype=np.uint64) + np.uint64(1)
    return mix(mix(points.astype(np.uint64)[:, None] + np.uint64(seed << 32)) + word * np.uint64(0x9E3779B97F4A7C15))


def gram_bits(grams: np.ndarray, dim: int, seed: int) -> np.ndarray:
    """(grams, dim) bits of the bound vectors; a bit stands for -1. A gram is three code points of 21 bits."""
    bound = np.zeros((len(grams), dim // 64), np.uint64)
    for k in range(3):
        points, at = np.unique(grams >> np.uint64(21 * (2 - k)) & np.uint64(0x1FFFFF), return_inverse=True)
        bound ^= np.roll(letter_bits(points, dim, seed), 2 - k, axis=1)[at]
    return np.unpackbits(bound.view(np.uint8), axis=1)


def _grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The 3-grams of a slice's documents and the documents they are of. Each document begins and ends with a blank."""
    n = len(offsets) - 1
    point = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    border = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]
    size = np.diff(border)
    letters = np.zeros(len(point) + 2 * n, np.uint64)
    doc = np.repeat(np.arange(n), size + 2)
    inner = np.ones(len(letters), bool)
    first = border[:-1] + 2 * np.arange(n)
    inner[first] = inner[first + size + 1] = False
    letters[inner] = _lower()[point]
    kept = letters != 0
    kept[1:] |= (letters[:-1] != 0) | (doc[1:] != doc[:-1])
    kept[0] = True
    letters, doc = letters[kept], doc[kept]
    whole = doc[2:] == doc[:-2]
    return (letters[:-2] << np.uint64(42) | letters[1:-1] << np.uint64(21) | letters[2:])[whole], doc[2:][whole]


def _grams_of_one(data: np.ndarray) -> Iterator[np.ndarray]:
    """The same of one long document, window by window; two letters are carried over."""
    carried, low = np.zeros(1, np.uint64), 0
    while low < len(data):
        high = min(low + BLOCK_BYTES, len(data))
        while high < len(data) and data[high] & 0xC0 == 0x80:
            high += 1
        point = np.frombuffer(data[low:high].tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        letters = np.concatenate([carried, _lower()[point].astype(np.uint64), np.zeros(int(high == len(data)), np.uint64)])
        kept = letters != 0
        kept[1:] |= letters[:-1] != 0
        kept[0] = True
        letters = letters[kept]
        yield letters[:-2] << np.uint64(42) | letters[1:-1] << np.uint64(21) | letters[2:]
        carried, low = letters[-2:], high


def weight(counts: np.ndarray) -> np.ndarray:
    return np.rint(16 * np.log2(1 + counts.astype(np.float64)))


def _bundled(weights: np.ndarray, known: np.ndarray, dim: int, seed: int) -> np.ndarray:
    """(rows, dim) from weights (rows, 3-grams). Products of a part stay below 2^24, up to which float32 is exact: GRAMS times a weight of at most 16 * 63."""
    out = np.repeat(weights.sum(1, dtype=np.int64)[:, None], dim, axis=1)
    for low in range(0, len(known), GRAMS):
        part = slice(low, low + GRAMS)
        out -= 2 * (weights[:, part].astype(np.float32) @ gram_bits(known[part], dim, seed).astype(np.float32)).astype(np.int64)
    return out


def _merged(grams: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    known, at = np.unique(np.concatenate(grams), return_inverse=True)
    total = np.zeros(len(known), np.int64)
    np.add.at(total, at, np.concatenate(counts))
    return known, total


def _counted_one(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct 3-grams of a long document and their counts."""
    known, total = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    for grams in _grams_of_one(data):
        known, total = _merged([known, grams], [total, np.ones(len(grams), np.int64)])
    return known, total


def bundles(column: pa.Array, dim: int = DIM, seed: int = SEED) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, vectors, numbers of 3-grams) of blocks of documents."""
    for i, j, data, offsets in slices(column, BLOCK_BYTES):
        if len(data) > BLOCK_BYTES:
            known, total = _counted_one(data)
            yield i, j, _bundled(weight(total)[None, :], known, dim, seed), total.sum(keepdims=True)
            continue
        for a in range(0, j - i, BLOCK_DOCS):
            b = min(a + BLOCK_DOCS, j - i)
            grams, doc = _grams(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            known, at = np.unique(grams, return_inverse=True)
            counts = np.bincount(doc * len(known) + at, minlength=(b - a) * len(known)).reshape(b - a, len(known))
            yield i + a, i + b, _bundled(weight(counts), known, dim, seed), counts.sum(1)


def count_grams(rows: DataFrame) -> DataFrame:
    """(lang, gram, n) from rows (text, lang): sums of tasks, then by key."""

    def sums(batches):
        held: dict[str, tuple[list, list]] = {}
        size = 0

        def all_of() -> Iterator[pa.RecordBatch]:
            for name, (grams, counts) in held.items():
                known, total = _merged(grams, counts)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(known)), pa.array(known.view(np.int64)), pa.array(total)], names=["lang", "gram", "n"])

        for batch in batches:
            names, codes = np.unique(np.array(batch.column(1).to_pylist(), object).astype(str), return_inverse=True)
            for i, j, data, offsets in slices(batch.column(0)):
                if len(data) > 1 << 20:
                    parts = [(codes[i], *_counted_one(data))]
                else:
                    grams, doc = _grams(data, offsets)
                    lang = codes[i:j][doc]
                    parts = [(c, *np.unique(grams[lang == c], return_counts=True)) for c in np.unique(lang)]
                for c, known, total in parts:
                    own = held.setdefault(str(names[c]), ([], []))
                    own[0].append(known), own[1].append(total)
                    size += len(known)
                if size > 2 * HELD:
                    for name, own in held.items():
                        known, total = _merged(*own)
                        held[name] = [known], [total]
                    size = sum(len(g) for own in held.values() for g in own[0])
                    if size > HELD:
                        yield from all_of()
                        held, size = {}, 0
        yield from all_of()
        release()

    return rows.mapInArrow(sums, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


@dataclass(frozen=True)
class Profiles:
    languages: tuple[str, ...]
    prototypes: np.ndarray  # unit vectors, a row for each language
    dim: int = DIM
    seed: int = SEED

    def compare(self, vectors: np.ndarray) -> np.ndarray:
        """Cosines (documents, languages); 0 for a vector without length."""
        length = np.sqrt((vectors.astype(np.float64) ** 2).sum(1, keepdims=True))
        return vectors @ self.prototypes.T / np.where(length > 0, length, 1)


def learn(docs: DataFrame, usable: Column, text_col: str = "text", lang_col: str = "lang", dim: int = DIM, seed: int = SEED) -> Profiles:
    """Profiles from all of docs' usable rows with a text and a language. What reaches the driver is a vector for each language."""
    if dim % 64 or dim < 192:
        raise ValueError("dim is a multiple of 64, three times that at least")
    rows = docs.where(usable & F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    if rows.select("lang").distinct().limit(MAX_LANGUAGES + 1).count() > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")

    def sums(batches):
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            lang = np.array(batch.column(0).to_pylist(), object)
            grams, weights = batch.column(1).to_numpy().view(np.uint64), weight(batch.column(2).to_numpy())
            for name in set(lang):
                mine = lang == name
                vector = _bundled(weights[mine][None, :], grams[mine], dim, seed)[0]
                total[name] = total[name] + vector if name in total else vector
        for name, vector in total.items():
            yield pa.RecordBatch.from_pydict({"lang": pa.array([name]), "vector": pa.array([vector.tolist()], pa.list_(pa.int64()))})
        release()

    each = count_grams(rows).mapInArrow(sums, "lang string, vector array<bigint>").select("lang", F.posexplode("vector").alias("at", "x"))
    whole = each.groupBy("lang", "at").agg(F.sum("x").alias("x")).groupBy("lang").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "x"))), lambda e: e["x"]).alias("vector"))
    named = sorted((r["lang"], np.array(r["vector"], np.float64)) for r in whole.collect())
    named = [(name, v / length) for name, v in named if (length := np.sqrt((v**2).sum())) > 0]
    return Profiles(tuple(name for name, _ in named), np.array([v for _, v in named]).reshape(len(named), dim), dim, seed)


def identify(docs: DataFrame, model: Profiles, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The kept columns of docs (all where keep isn't given) with lang_pred, score (the cosine, no less than 0) and margin (by how
    much the next language's cosine is less)."""
    kept = [c for c in (docs.columns if keep is None else keep) if c not in OUT]
    text = fresh("_text", [*docs.columns, *OUT])
    rows = docs.select(*kept, F.col(text_col).alias(text))

    def make():
        names = np.array([*model.languages, "und"], object)

        def run(batch):
            for i, j, vectors, size in bundles(batch.column(batch.schema.get_field_index(text)), model.dim, model.seed):
                best, score, margin = np.full(j - i, -1), np.zeros(j - i), np.zeros(j - i)
                told = np.flatnonzero(size) if len(model.languages) else np.zeros(0, np.int64)
                if len(told):
                    cosine = model.compare(vectors[told])
                    top = cosine.argmax(1)
                    best[told], score[told] = top, np.clip(cosine[np.arange(len(told)), top], 0, 1)
                    if len(model.languages) > 1:
                        second, first = np.partition(cosine, -2, axis=1)[:, -2:].T
                        margin[told] = first - second
                yield i, j, [pa.array(names[best], pa.string()), pa.array(score), pa.array(margin)]

        return run

    return map_columns(rows, make, {"lang_pred": "string", "score": "double", "margin": "double"}, kept)
