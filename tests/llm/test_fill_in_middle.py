"""Fill-in-middle against a plain computation with re, for texts of every odd kind."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from weftline.llm import fill_in_middle as fim
from weftline.llm import queries
from weftline.llm.textkit import slices

UNIT = re.compile(r"[A-Za-z]+|[^A-Za-z]", re.S)


def plainly(key, text):
    text = text or ""
    h = hashlib.sha256(f"1:{'' if key is None else key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    units = UNIT.findall(text)
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    if h4 % 100 < 20:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def some_texts(n):
    rng = random.Random(3)
    parts = ["word", "a", "B", " ", "\n", "é", "漢", "🙂", "7", "<", "<P", "S>", "P>", "\x00", "ab" * 40, "."]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 60))) for _ in range(n)]


@pytest.mark.parametrize("every, window", [(1, 4), (3, 7), (5, 64), (256, 1 << 16)])
def test_index_finds_every_unit(every, window):
    texts = [*some_texts(60), "", "", "x" * 500, "é" * 40, ""]
    for _, _, data, offsets in slices(pa.array(texts)):
        index = fim.CheckpointIndex(data, offsets, every, window)
        want, chars = [], 0
        for text, low in zip(texts, offsets, strict=False):
            want += [(int(low) + len(text[: x.start()].encode()), chars + x.start()) for x in UNIT.finditer(text)]
            chars += len(text)
        assert [index.find(k) for k in range(len(want))] == want and index.find(len(want)) == (len(data), chars)
        assert np.diff(index.units).tolist() == [len(UNIT.findall(t)) for t in texts]
        if len(index.check_unit) > 1:  # sparse, and a rescan never crosses a window
            assert np.diff(index.check_unit).max() <= every and len(index.check_unit) <= len(want) // every + len(data) // window + 2


def test_like_re(spark):
    texts = [None, "", "<P>", "a <M> b", "abc", "x" * 300_000, "漢字 " * 70_000, *some_texts(1500)]
    rows = [(k, t, "own", -1) for k, t in enumerate(texts)] + [(None, "no id at all", "own", -1), (4, "abc", "own", -1), (None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, form string, _first int")
    out = fim.fill_in_middle(docs).withColumn("back", fim.restored("fim", "form"))
    got = out.collect()
    assert len(got) == len(rows) and set(out.columns) == {"doc_id", "text", "_first", "back", *fim.OUT}
    for r in got:
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["fim"]) == plainly(r["doc_id"], r["text"])
        assert r["back"] == (r["text"] or "")
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}
    assert fim.fill_in_middle(docs.where("false"), keep=["doc_id"]).collect() == []


def test_other_marks(spark):
    marks = fim.Marks("[[a", "[[b", "[[c")
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(["[[", "[[a", "x[[[[ y", "[.*] [", "ab [["] * 20)], "doc_id long, text string")
    assert docs.count() == fim.fill_in_middle(docs, marks=marks, fim_percent=100, spm_percent=50).where(fim.restored("fim", "form", marks) == F.col("text")).count()
    for bad in (("", "b", "c"), ("<a", "a>", "c"), ("xx", "b", "xxx"), ("aba", "c", "d"), ("a", "a", "b")):
        with pytest.raises(ValueError):
            fim.Marks(*bad)


def test_query_has_no_exchange(spark):
    out = queries.op11_fill_in_middle(spark, "/root/testdata/sf0.001")
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    assert out.where("output_sha256 is null or restored_sha256 is null").count() == 0
