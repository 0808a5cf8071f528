"""Product-quantisation codes of vectors, by exact integer arithmetic behind a float32 screen.

Components become integers, floor(scale * x), and a vector is cut into equal consecutive parts. Each part position has a
codebook; a round assigns every part to the nearest entry and moves each entry to its parts' mean, rounded down.

The nearest entry comes from a float32 matrix product. Every entry gets an interval that holds its exact squared distance
(less the part's own square): with u = 2^-24 and a part of p components, a float32 product of rounded operands, summed in
any order, is off by at most g(p + 2) |x||c|, g(m) = m u / (1 - m u); rounding the entry's square and the difference adds at
most 3 u (|c|^2 + |x||c|). Entries whose interval overlaps that of the best are computed anew in int64, and of equal
distances the lower index wins. So codes equal those of plain int64 arithmetic, for any input within its range.

What leaves a task in a round is one row for each codebook entry it used; codebooks (parts * entries rows) are all that the
driver holds.

Cases: a vector that is null or holds null, NaN or infinite components is dropped; the dimension is the longest kept
vector's, rounded up to a multiple of parts, and a shorter vector counts as continued by zeros; a null id comes after all
others when entries are chosen, and rows of one id are taken in the order of their vectors; repeated rows count each;
fewer kept rows than entries give fewer entries; extra columns pass through, and one that has an output's name is replaced;
an empty table gives an empty table. Components so large that int64 could overflow are an error (within).
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, map_columns, release, spread_join
from .textkit import ragged

OUT = ["code", "error"]
_U = 2.0**-24


@dataclass(frozen=True)
class Codebooks:
    """entries: int64 (parts, entries, components of a part)."""

    entries: np.ndarray
    scale: int = 256

    @property
    def dim(self) -> int:
        return self.entries.shape[0] * self.entries.shape[2]

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def finite(vector: Column) -> Column:
    """Whether a vector is kept: neither null nor with null, NaN or infinite components."""
    return vector.isNotNull() & F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def integers(column: pa.Array, dim: int, scale: int) -> np.ndarray:
    """int64 (rows, dim) of a list array; shorter rows end in zeros. A longer row, or one out of range, is an error."""
    size = pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    if len(size) and size.max() > dim:
        raise ValueError(f"a vector of more than {dim} components")
    real = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    within(float(np.abs(real).max()) if len(real) else 0.0, 1, dim, scale)
    flat = np.floor(real * scale).astype(np.int64)
    if (size == dim).all():
        return flat.reshape(len(size), dim)
    out = np.zeros((len(size), dim), np.int64)
    out.ravel()[ragged(np.arange(len(size)) * dim, size)] = flat
    return out


class Screen:
    """Nearest entries of one part position's codebook."""

    def __init__(self, book: np.ndarray):
        p = book.shape[1]
        self.book, self.low = book, np.ascontiguousarray(book.astype(np.float32).T)
        square = (book**2).sum(1)
        self.square = square.astype(np.float32)
        if (p + 2) * _U >= 0.5:
            raise ValueError("parts are too long for float32 screening")
        gamma = (p + 2) * _U / (1 - (p + 2) * _U)
        # A ten-thousandth more than the bound covers the float64 arithmetic of the bound itself.
        length = np.sqrt(square.astype(np.float64))
        self.by_length, self.fixed = 1.0001 * (2 * gamma + 3 * _U) * length, 1.0001 * 3 * _U * square.astype(np.float64)

    def intervals(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bounds of each entry's squared distance less the part's own square, float64 (rows, entries)."""
        middle = (self.square - 2 * (x.astype(np.float32) @ self.low)).astype(np.float64)
        length = np.sqrt((x.astype(np.float64) ** 2).sum(1))
        off = length[:, None] * self.by_length + self.fixed
        return middle - off, middle + off

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """(index, exact squared distance) of each part, and how many entries were computed anew."""
        lower, upper = self.intervals(x)
        near = lower <= upper.min(1)[:, None]
        index = near.argmax(1)
        unsure = np.flatnonzero(near.sum(1) > 1)
        again = 0
        if len(unsure):
            row, entry = np.nonzero(near[unsure])  # by row, then by index
            exact = ((x[unsure[row]] - self.book[entry]) ** 2).sum(1)
            start = np.searchsorted(row, np.arange(len(unsure)))
            best = np.flatnonzero(exact == np.minimum.reduceat(exact, start)[row])
            first = best[np.searchsorted(row[best], np.arange(len(unsure)))]
            index[unsure], again = entry[first], len(row)
        return index, ((x - self.book[index]) ** 2).sum(1), again


def assigned(x: np.ndarray, screens: list[Screen]) -> tuple[np.ndarray, np.ndarray]:
    """Indexes (rows, parts) and squared distances summed over parts."""
    p = x.shape[1] // len(screens)
    code, error = np.empty((len(x), len(screens)), np.int64), np.zeros(len(x), np.int64)
    for k, screen in enumerate(screens):
        code[:, k], distance, _ = screen.nearest(x[:, k * p : (k + 1) * p])
        error += distance
    return code, error


def within(largest: float, n: int, dim: int, scale: int) -> None:
    """Raises ValueError where squared distances, or sums of n components, could leave int64."""
    top = int(np.floor(largest * scale)) + 1 if largest < 2.0**62 else 1 << 62
    if dim * (2 * top) ** 2 >= 1 << 63 or n * top >= 1 << 63:
        raise ValueError("components are too large for exact int64 arithmetic")


def learn(vectors: DataFrame, vector_col: str = "embedding", id_col: str = "vec_id", parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256) -> Codebooks | None:
    """Codebooks of all kept vectors, from those of the least ids on; None where no vector is kept."""
    if not 1 <= entries <= 256:
        raise ValueError("an index has two hex digits: 1 to 256 entries")
    kept = vectors.where(finite(F.col(vector_col))).select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector"))
    told = kept.agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("dim"), F.max(F.greatest(F.array_max("vector"), -F.array_min("vector"))).alias("top")).first()
    if not told["n"]:
        return None
    p = max(1, -(-told["dim"] // parts))
    within(told["top"] or 0.0, told["n"], p * parts, scale)
    first = kept.orderBy(F.col("id").asc_nulls_last(), "vector").limit(entries).collect()
    start = integers(pa.array([r["vector"] for r in first], pa.list_(pa.float64())), p * parts, scale)
    books = np.ascontiguousarray(start.reshape(len(first), parts, p).transpose(1, 0, 2))
    for _ in range(rounds):
        books = _moved(kept.select("vector"), books, scale)
    return Codebooks(books, scale)


def _moved(kept: DataFrame, books: np.ndarray, scale: int) -> np.ndarray:
    parts, size, p = books.shape

    def sums(batches):
        screens = [Screen(b) for b in books]
        n, total = np.zeros(parts * size, np.int64), np.zeros((parts * size, p), np.int64)
        for batch in batches:
            if batch.num_rows:
                x = integers(batch.column(0), parts * p, scale)
                code, _ = assigned(x, screens)
                slot = (code + np.arange(parts) * size).ravel()
                n += np.bincount(slot, minlength=parts * size)
                order = np.argsort(slot, kind="stable")
                used, start = np.unique(slot[order], return_index=True)
                total[used] += np.add.reduceat(x.reshape(-1, p)[order], start)
        used = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(n[used]), pa.array(list(total[used]), pa.list_(pa.int64()))], names=["slot", "n", "total"])
        release()

    each = kept.mapInArrow(sums, "slot bigint, n bigint, total array<bigint>")
    whole = each.groupBy("slot").agg(F.sum("n").alias("n"), F.array(*(F.sum(F.get("total", F.lit(k))) for k in range(p))).alias("total"))
    out = books.reshape(parts * size, p).copy()
    for r in whole.collect():  # parts * entries rows at most
        out[r["slot"]] = [t // r["n"] for t in r["total"]]
    return out.reshape(books.shape)


def encode(vectors: DataFrame, books: Codebooks | None, vector_col: str = "embedding", keep: list[str] | None = None) -> DataFrame:
    """The kept columns of vectors (all where keep isn't given), without dropped rows, with code (two hex digits for each part) and error."""
    kept = [c for c in (vectors.columns if keep is None else keep) if c not in OUT]
    own = fresh("_vector", [*vectors.columns, *OUT])
    rows = vectors.where(finite(F.col(vector_col)) if books else F.lit(False)).select(*kept, F.col(vector_col).alias(own))

    def make():
        screens = [Screen(b) for b in books.entries]

        def run(batch):
            x = integers(batch.column(batch.schema.get_field_index(own)), books.dim, books.scale)
            code, error = assigned(x, screens)
            digits, width = code.astype(np.uint8).tobytes().hex(), 2 * len(screens)
            yield 0, len(x), [pa.array([digits[k : k + width] for k in range(0, len(digits), width)], pa.string()), pa.array(error)]

        return run

    return map_columns(rows, make, {"code": "string", "error": "bigint"}, kept)


def decode(codes: DataFrame, books: Codebooks, code_col: str = "code", keep: list[str] | None = None) -> DataFrame:
    """The kept columns with vector array<double>: each component in the middle of its entry's step; null for a null code."""
    kept = [c for c in (codes.columns if keep is None else keep) if c != "vector"]
    own = fresh("_code", [*codes.columns, "vector"])

    def make():
        at = np.arange(len(books.entries))

        def run(batch):
            given = batch.column(batch.schema.get_field_index(own)).to_pylist()
            out = [None if c is None else ((books.entries[at, np.frombuffer(bytes.fromhex(c), np.uint8)] + 0.5) / books.scale).ravel() for c in given]
            yield 0, len(out), [pa.array(out, pa.list_(pa.float64()))]

        return run

    return map_columns(codes.select(*kept, F.col(code_col).alias(own)), make, {"vector": "array<double>"}, kept)


def with_totals(coded: DataFrame, label_col: str = "label", error_col: str = "error", total_col: str = "label_error") -> DataFrame:
    """coded with each label's sum of errors, null labels together. A hot label's rows go to several tasks; the sums of labels
    are joined, so no label's rows meet in one task. coded is read three times: give a written table."""
    label, none, rows, mark = (fresh(c, coded.columns) for c in ("_label", "_none", "_rows", "_mark"))
    keyed = coded.drop(total_col).withColumns({none: F.col(label_col).isNull(), mark: F.monotonically_increasing_id()})
    keyed = keyed.withColumn(label, F.coalesce(F.col(label_col), F.lit(0).cast(coded.schema[label_col].dataType)))
    totals = keyed.groupBy(label, none).agg(F.sum(error_col).alias(total_col), F.count("*").alias(rows))
    return spread_join(keyed, totals, [label, none], rows, coded.count()).select(*(c for c in coded.columns if c != total_col), total_col)
