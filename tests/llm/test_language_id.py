"""Language identification against a 3-gram by 3-gram computation, and its accuracy on rows held out."""

import math
import unicodedata
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from weftline.llm import language_id as lid
from weftline.llm import queries
from weftline.llm.common import held_out, table

DIM = 192
TEXTS = [None, "", " ...", "a", "Hello, wörld! it's", "ПРИВЕТ мир", "漢字かな", "ǅ İx", "x" * 9, "one  two\n\nthree 3 four", "no7no", "é" * 70_000 + " end of it"]


def plain_grams(text):
    letters = [" "]
    for c in text or "":
        c = (c.lower() if len(c.lower()) == 1 else c) if unicodedata.category(c)[0] == "L" else " "
        if c != " " or letters[-1] != " ":
            letters.append(c)
    if letters[-1] != " ":
        letters.append(" ")
    return ["".join(letters[i : i + 3]) for i in range(len(letters) - 2)]


def weight(n):
    return round(16 * math.log2(1 + n))


def bound(gram, known={}):  # noqa: B006
    if gram not in known:
        known[gram] = np.ones(DIM, np.int64)
        for k, c in enumerate(gram):
            bits = np.unpackbits(lid.letter_bits(np.array([0 if c == " " else ord(c)]), DIM, lid.SEED).view(np.uint8))
            known[gram] = known[gram] * np.roll(1 - 2 * bits.astype(np.int64), 64 * (2 - k))
    return known[gram]


def plain_vector(*texts):
    counts = Counter(g for t in texts for g in plain_grams(t))
    return sum((weight(n) * bound(g) for g, n in counts.items()), np.zeros(DIM, np.int64))


def cosine(a, b):
    return float(a @ b) / math.sqrt(float(a @ a) * float(b @ b))


def test_bundles_like_definition():
    seen = 0
    for i, j, vectors, size in lid.bundles(pa.array(TEXTS), DIM):
        for k in range(i, j):
            assert (vectors[k - i] == plain_vector(TEXTS[k])).all() and size[k - i] == len(plain_grams(TEXTS[k]))
            seen += 1
    assert seen == len(TEXTS)


def test_windows_change_nothing(monkeypatch):
    texts = ["ab cd, éf. " * 30, "漢字 " * 50, "x" * 100]
    whole = np.concatenate([v for _, _, v, _ in lid.bundles(pa.array(texts), DIM)])
    monkeypatch.setattr(lid, "BLOCK_BYTES", 7)
    monkeypatch.setattr(lid, "GRAMS", 3)
    assert (np.concatenate([v for _, _, v, _ in lid.bundles(pa.array(texts), DIM)]) == whole).all()


def test_learn_and_identify_like_definition(spark):
    rows = [(k, t, ["one", "two", None, "three"][k % 4], "own", 2.0) for k, t in enumerate(TEXTS)] + [(None, "again", "one", "own", None), (4, TEXTS[4], "one", "own", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string, score double")
    usable = F.coalesce(F.col("doc_id"), F.lit(0)) % 5 < 4
    model = lid.learn(docs, usable, dim=DIM)
    sums = {}
    for key, text, lang, *_ in rows:
        if (key or 0) % 5 < 4 and lang and text is not None:
            sums.setdefault(lang, []).append(text)
    sums = {lang: plain_vector(*texts) for lang, texts in sums.items()}
    names = sorted(lang for lang in sums if sums[lang].any())
    assert list(model.languages) == names
    got = lid.identify(docs, model).collect()
    assert len(got) == len(rows)
    for r in got:
        if not plain_grams(r["text"]):
            assert (r["lang_pred"], r["score"], r["margin"]) == ("und", 0.0, 0.0)
            continue
        cosines = [cosine(plain_vector(r["text"]), sums[n]) for n in names]
        best = max(range(len(names)), key=lambda k: cosines[k])
        assert r["lang_pred"] == names[best] and abs(r["score"] - max(0.0, cosines[best])) < 1e-9
        assert abs(r["margin"] - (cosines[best] - sorted(cosines)[-2])) < 1e-9


def test_nothing_to_learn_from_and_empty(spark):
    docs = spark.createDataFrame([(1, "some text", None), (2, None, "en"), (3, "...", "fr")], "doc_id long, text string, lang string")
    model = lid.learn(docs, F.lit(True), dim=DIM)
    assert model.languages == () and {r["lang_pred"] for r in lid.identify(docs, model).collect()} == {"und"}
    assert lid.identify(docs.where("false"), lid.learn(docs.where("false"), F.lit(True), dim=DIM)).collect() == []


def test_counting_hands_on_and_is_exact(spark, monkeypatch):
    monkeypatch.setattr(lid, "HELD", 40)
    rows = [(t, lang) for t in TEXTS if t is not None for lang in ("a", "b")] * 3
    got = {(r["lang"], r["gram"]): r["n"] for r in lid.count_grams(spark.createDataFrame(rows, "text string, lang string").repartition(3)).collect()}
    want = Counter((lang, sum((0 if c == " " else ord(c)) << 21 * (2 - k) for k, c in enumerate(g))) for t, lang in rows for g in plain_grams(t))
    assert got == dict(want)


def test_copies_of_one_text_do_not_rule_a_profile(spark):
    own, other = "the quick brown fox jumps over the lazy dog", "der schnelle braune fuchs springt ueber den faulen hund"
    docs = spark.createDataFrame([(own, "en")] * 50 + [("xyzzy plugh xyzzy", "en")] * 5000 + [(other, "de")] * 50, "text string, lang string")
    model = lid.learn(docs, F.lit(True))
    seen = {r["text"]: r["lang_pred"] for r in lid.identify(spark.createDataFrame([("the lazy brown dog",), ("der braune hund",)], "text string"), model).collect()}
    assert seen == {"the lazy brown dog": "en", "der braune hund": "de"}


def test_too_many_languages(spark, monkeypatch):
    monkeypatch.setattr(lid, "MAX_LANGUAGES", 3)
    docs = spark.createDataFrame([(k, "text", f"l{k}") for k in range(5)], "doc_id long, text string, lang string")
    with pytest.raises(ValueError):
        lid.learn(docs, F.lit(True), dim=DIM)


def test_accuracy_held_out(spark):
    sf = "/root/testdata/sf0.01"
    docs = table(spark, sf, "documents").select("doc_id", "lang", F.regexp_count("text", F.lit(r"\p{L}{2,}")).alias("words"))
    out = queries.op12_language_id(spark, sf).join(docs, "doc_id")
    assert out.count() == docs.count() and out.where(held_out(4, 2) != F.col("held_out")).count() == 0
    right = out.where("held_out and words >= 5 and lang is not null").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")).alias("x")).first()["x"]
    assert right >= 0.98
