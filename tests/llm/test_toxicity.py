"""The network against a word-by-word computation, and how its training rows are chosen."""

import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from weftline.llm import toxicity as tox
from weftline.llm.textkit import hash_bytes, slices

MASK = (1 << 64) - 1


def mix(h):
    h ^= h >> 32
    h = h * 0xD6E8FEB86659FD93 & MASK
    h ^= h >> 32
    h = h * 0xD6E8FEB86659FD93 & MASK
    return h ^ h >> 32


def sigmoid(x):
    return 1 / (1 + np.exp(-x))


def vector(m, word):
    """A word's input: its log-odds, its trigrams' mean and largest, and the learned vectors."""
    row = hash_bytes(word) >> 50
    padded = [0, *word, 0]
    chars = [mix((a << 16 | b << 8 | c) + 1) >> 52 for a, b, c in zip(padded, padded[1:], padded[2:], strict=False)]
    odds = m.char_odds[chars]
    return np.concatenate([[m.word_odds[row], odds.mean(), odds.max()], m.word[row] + m.char[chars].mean(0)])


def run(m, d, xs):
    h, out = np.zeros(tox.HIDDEN), []
    for x in xs if d == 0 else xs[::-1]:
        gates, inner = x @ m.wx[d] + m.bias[d], h @ m.wh[d]
        z, r = sigmoid(gates[: tox.HIDDEN] + inner[: tox.HIDDEN]), sigmoid(gates[tox.HIDDEN : 2 * tox.HIDDEN] + inner[tox.HIDDEN : 2 * tox.HIDDEN])
        new = np.tanh(gates[2 * tox.HIDDEN :] + r * inner[2 * tox.HIDDEN :])
        h = (1 - z) * new + z * h
        out.append(h)
    return out if d == 0 else out[::-1]


def plain_score(m, text):
    low = re.sub("[A-Z]", lambda c: c[0].lower(), text or "")
    xs, best = [vector(m, w.encode()) for w in re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)], None
    for start in range(0, len(xs), tox.STRIDE):
        part = xs[start : start + tox.WINDOW]
        states = [np.concatenate(p) for p in zip(run(m, 0, part), run(m, 1, part), strict=True)]
        scores = np.array([np.tanh(s @ m.attend) @ m.query for s in states])
        a = np.exp(scores - scores.max())
        logit = (a / a.sum()) @ np.array(states) @ m.out[:-1] + m.out[-1]
        best = logit if best is None else max(best, logit)
        if start + tox.WINDOW >= len(xs):
            break
    return 0.0 if best is None else sigmoid(m.scale * best + m.shift)


def corpus(n=300):
    rng = random.Random(3)
    vocab = [f"{a}{b}{c}" for a in "ktpm" for b in "aeiou" for c in ("ra", "no", "sel", "vim")]
    texts = []
    for k in range(n):
        w = [rng.choice(vocab) for _ in range(rng.randint(1, 90))]
        if k % 3 == 0:
            w.insert(rng.randrange(len(w) + 1), rng.choice(["grumbo", "grumbit", "snorf"]))
        texts.append(" ".join(w))
    return texts, [int(k % 3 == 0) for k in range(n)]


def test_scores_by_brute_force(spark):
    texts, labels = corpus()
    m = tox.fit(texts, labels, 1 / 3)
    more = [*texts[:40], None, "", "...", "one", "Ünï 漢字 KARA", "kara " * 33, " ".join(texts[:20])]
    got = {r["id"]: r["score"] for r in tox.score(spark.createDataFrame(list(enumerate(more)), "id long, text string"), m).collect()}
    for k, t in enumerate(more):
        assert abs(got[k] - plain_score(m, t)) < 1e-4


def test_windows_overlap_and_reach_the_end():
    for n in (0, 1, 31, 32, 33, 40, 41, 200):
        doc, start, size = tox.windows(np.array([0, 5, 5 + n]))
        own = [(int(a) - 5, int(s)) for d, a, s in zip(doc, start, size, strict=True) if d == 1]
        assert {a + k for a, s in own for k in range(s)} == set(range(n))
        for p in range(max(0, n - (tox.WINDOW - tox.STRIDE))):
            assert any(a <= p and p + tox.WINDOW - tox.STRIDE <= a + s for a, s in own)


def test_passages_are_found_wherever_they_stand():
    texts, labels = corpus(600)
    m = tox.fit(texts, labels, 1 / 3)
    rng = random.Random(9)
    clean = [t for t, y in zip(texts, labels, strict=True) if not y]
    moved = []
    for place in range(0, 64, 4):
        w = (" ".join(rng.sample(clean, 12))).split()[:100]
        moved.append(" ".join([*w[:place], "grumbo", *w[place:]]))
    s = np.concatenate([tox.score_slice(m, d, o) for _, _, d, o in slices(pa.array(moved))])
    assert (s >= 0.5).mean() > 0.9


def test_training_sample(spark):
    """Null ids and labels don't train, an id labelled twice has its larger label, long texts don't train, rows are bounded."""
    docs = spark.createDataFrame([(k, f"text {k}", 0) for k in range(40)] + [(None, "none", 0), (3, "again", 1), (50, "x" * (tox.MAX_CHARS + 1), 0), (51, None, 0)], "doc_id long, text string, toxic int")
    labels = spark.createDataFrame([(k, 0) for k in range(40)] + [(k, 1) for k in range(0, 40, 4)] + [(None, 1), (41, None), (50, 1), (51, 0), (99, 1)], "doc_id long, toxic int")
    texts, known, prior = tox.training_sample(docs, labels, F.col("doc_id") != 8)
    want = {(f"text {k}", int(k % 4 == 0)) for k in range(40) if k != 8} | {("again", 0), (None, 0)}
    assert set(zip(texts, known, strict=True)) == want and abs(prior - 9 / 40) < 1e-9
    few = tox.training_sample(docs, labels, F.lit(True), per_class=5)
    assert len(few[0]) <= 10 and few[0] == tox.training_sample(docs.repartition(3), labels, F.lit(True), per_class=5)[0]
    assert tox.training_sample(docs, labels.where("false"), F.lit(True)) == ([], [], 0.0)


def test_sample_is_full_where_labels_outnumber_documents(spark):
    """Labels of documents that aren't there, or are too long, take no place in the sample, and count for nothing in the prior."""
    docs = spark.range(0, 4000, 20).select(F.col("id").alias("doc_id"), F.when(F.col("id") == 40, F.repeat(F.lit("x"), tox.MAX_CHARS + 1)).otherwise(F.concat(F.lit("text "), "id")).alias("text"))
    labels = spark.range(20_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 40 == 0, 1).otherwise(F.when(F.col("id") % 20 == 0, 0).otherwise(1)).cast("int").alias("toxic"))
    texts, known, prior = tox.training_sample(docs, labels, F.lit(True), per_class=100)
    assert (len(texts), sum(known)) == (199, 99) and abs(prior - 99 / 199) < 1e-12
    assert len(tox.training_sample(docs, labels, F.lit(True), per_class=30)[0]) == 60
