"""Vector codes against plain integer arithmetic."""

import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from weftline.llm import queries, vector_codes as vc


def plainly(rows, parts, entries, rounds, scale=256):
    """{row number: (code, error)} and codebooks, by loops over Python integers."""
    ok = [k for k, (_, v, _) in enumerate(rows) if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    p = max(1, -(-max(len(rows[k][1]) for k in ok) // parts))
    whole = {k: [math.floor(scale * x) for x in rows[k][1]] + [0] * (p * parts - len(rows[k][1])) for k in ok}
    first = sorted(ok, key=lambda k: (rows[k][0] is None, rows[k][0] or 0, rows[k][1]))[:entries]
    books = [[whole[k][q * p : (q + 1) * p] for k in first] for q in range(parts)]

    def near(q, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), e) for e, c in enumerate(books[q]))

    for _ in range(rounds):
        new = []
        for q in range(parts):
            mine = {}
            for x in whole.values():
                mine.setdefault(near(q, x[q * p : (q + 1) * p])[1], []).append(x[q * p : (q + 1) * p])
            new.append([[sum(c) // len(mine[e]) for c in zip(*mine[e], strict=True)] if e in mine else old for e, old in enumerate(books[q])])
        books = new
    out = {}
    for k, x in whole.items():
        found = [near(q, x[q * p : (q + 1) * p]) for q in range(parts)]
        out[k] = "".join(f"{e:02x}" for _, e in found), sum(d for d, _ in found)
    return out, books


def test_screen_is_exact():
    rng = np.random.default_rng(7)
    again = 0
    for p, top, k in [(1, 5, 64), (4, 300, 64), (4, 3, 64), (7, 1 << 26, 256), (96, 1 << 20, 64), (3, 1 << 26, 9)]:
        for shift in (0, top * 7):  # far from the origin: squares nearly cancel
            book = rng.integers(-top, top, (k, p)) + shift
            book[k // 2] = book[0]
            x = np.concatenate([rng.integers(-top, top, (300, p)) + shift, book, (book + book[::-1]) // 2])
            screen = vc.Screen(book)
            exact = ((x[:, None, :] - book) ** 2).sum(2)
            index, distance, n = screen.nearest(x)
            assert (index == exact.argmin(1)).all() and (distance == exact.min(1)).all()
            lower, upper = screen.intervals(x)
            for row in range(0, len(x), 17):
                own = [int((book[e].astype(object) ** 2).sum() - 2 * (x[row].astype(object) * book[e].astype(object)).sum()) for e in range(k)]
                assert all(lower[row, e] <= own[e] <= upper[row, e] for e in range(k))
            again += n
    assert again > 0  # some were computed anew


@pytest.mark.parametrize("parts, entries, rounds", [(4, 8, 2), (2, 64, 1), (16, 3, 0)])
def test_like_plain_integers(spark, parts, entries, rounds):
    rng = np.random.default_rng(entries)
    rows = [(int(k) - 20, (rng.integers(-3, 4, 12) / 8).tolist(), int(k) % 3 or None) for k in range(150)]
    rows += [(5, rows[25][1], 1), (5, [0.5] * 12, 1), (200, None, 1), (201, [0.1, None], 2), (202, [float("nan")] * 12, 2), (-99, [float("-inf")] + [0.0] * 11, 2), (203, [], 1), (204, [1.5, -2.5], None), (None, [0.25] * 12, 1), (205, [0.3] * 11, 2)]
    vectors = spark.createDataFrame([(*r, "own", i) for i, r in enumerate(rows)], "vec_id long, embedding array<double>, label int, code string, row int").repartition(5)
    books = vc.learn(vectors, parts=parts, entries=entries, rounds=rounds)
    want, plain_books = plainly(rows, parts, entries, rounds)
    assert books.entries.tolist() == plain_books
    coded = vc.encode(vectors, books)
    got = vc.with_totals(coded).collect()
    assert {r["row"]: (r["code"], r["error"]) for r in got} == want and len(got) == len(want)
    totals = {}
    for k, (_, error) in want.items():
        totals[rows[k][2]] = totals.get(rows[k][2], 0) + error
    assert all(r["label_error"] == totals[r["label"]] for r in got)
    if rounds == 0:
        exact = vc.decode(coded.where("error = 0"), books, keep=["row", "embedding"]).collect()
        assert exact and all(abs(a - b) <= 1 / 256 for r in exact for a, b in zip(r["embedding"], r["vector"], strict=False))


def test_hot_label_is_cut(spark):
    coded = spark.range(0, 4000, 1, 8).select(F.when(F.col("id") % 3 > 0, F.lit(7)).otherwise(F.col("id").cast("int")).alias("label"), F.lit(2).cast("bigint").alias("error"), F.lit("x").alias("_label"))
    out = vc.with_totals(coded)
    assert out.where("label = 7").select("label_error").distinct().collect()[0][0] == 2 * coded.where("label = 7").count() and out.count() == 4000


def test_empty_and_out_of_range(spark):
    none = spark.createDataFrame([(1, None, 1)], "vec_id long, embedding array<float>, label int")
    for vectors in (none, none.where("false")):
        assert vc.learn(vectors) is None and vc.encode(vectors, None).collect() == []
    with pytest.raises(ValueError):
        vc.learn(spark.createDataFrame([(1, [1e30] * 16)], "vec_id long, embedding array<float>"))
    with pytest.raises(ValueError):
        vc.integers(pa.array([[1.0, 2.0, 3.0]]), 2, 256)
    with pytest.raises(ValueError):
        vc.learn(none, entries=257)


def test_sums_leave_tasks_and_not_rows(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    assert queries.op13_vector_codes(spark, "/root/testdata/sf0.001").count() == vectors.count()
