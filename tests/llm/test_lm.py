"""The language model against a word-by-word computation in plain Python."""

import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from weftline.llm import maxent_lm as lm
from weftline.llm.textkit import hash_bytes, slices

MASK, GOLD = (1 << 64) - 1, 0x9E3779B97F4A7C15


def mix(h):
    h ^= h >> 32
    h = h * 0xD6E8FEB86659FD93 & MASK
    h ^= h >> 32
    h = h * 0xD6E8FEB86659FD93 & MASK
    return h ^ h >> 32


def tokens(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [*(w.encode() for w in re.findall(r"[^\x20\x09-\x0D]+", low)), None]


class Plain:
    """log10 P(word | history) by the definition."""

    def __init__(self, counts, model):
        self.m = model
        self.counts = {r["h"] & MASK: r["n"] for r in counts.collect()}
        self.head = {int(k): (int(c), int(b)) for k, c, b in zip(model.classes.keys, model.classes.classes, model.classes.buckets, strict=True)}

    def kind(self, word):
        h = int(lm.END) if word is None else hash_bytes(word)
        if h in self.head:
            return h, *self.head[h]
        if word is None:
            return h, 0, 0
        data = np.frombuffer(word, np.uint8)
        return h, int(self.m.classes.of(data, np.array([0]), np.array([len(data)]))[0]), lm.OWN + (h >> 17) % lm.TAIL

    def softmax(self, rows):
        z = sum(x.astype(float) for x in rows)
        e = np.exp(z - z.max())
        return e / e.sum()

    def chances(self, history, cls):
        """P(class | history), and P(bucket | class, history) for the class cls."""
        w, shift, size = self.m.weights, 64 - self.m.weights.bits, 1 << self.m.weights.bits
        past = [*history[::-1], *[(int(lm.END), 0, 0)] * 4]
        (a, ca, _), (b, cb, _), (_, cc, _), (_, cd, _) = past[:4]
        rows = [0, 1 + (mix(a) >> shift), 1 + size + (mix(b) >> shift), 1 + 2 * size + ca * lm.CLASSES + cb, 1 + 2 * size + lm.CLASSES**2 + cc * lm.CLASSES + cd]
        own = (cls + 1) * GOLD & MASK
        inner = [cls, lm.CLASSES + (mix(mix(a) ^ own) >> shift), lm.CLASSES + size + (mix(mix(b) ^ own) >> shift)]
        return self.softmax([w.by_class[r] for r in rows]), self.softmax([w.by_bucket[r] for r in inner])

    def word(self, history, h, cls, bucket):
        by_class, by_bucket = self.chances(history, cls)
        if cls <= lm.SINGLES:
            return by_class[cls]
        share = 1.0 if bucket < lm.OWN else (self.counts.get(h, 0) + 0.1) / 10 ** self.m.below[cls, bucket]
        return by_class[cls] * by_bucket[bucket] * share

    def score(self, text):
        history, total = [], 0.0
        for t in tokens(text):
            kind = self.kind(t)
            total += np.log10(self.word(history, *kind))
            history.append(kind)
        return total


def corpus(spark):
    rng = random.Random(4)
    texts = [" ".join(rng.choice((["der", "die", "das", "ung"], ["the", "of", "and", "ing"])[i % 2]) + (f" w{rng.randrange(300)}" if rng.random() < 0.5 else "") for _ in range(40)) for i in range(120)]
    texts += [None, "", " . ", "never SEEN words Ünï 漢字", "The the THE", "der " * 3000]
    return texts, spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)


def test_scores_by_brute_force(spark):
    texts, docs = corpus(spark)
    training = F.col("doc_id") % 5 != 0
    counts, model = lm.fit_lm(docs, training)
    plain = Plain(counts, model)
    assert sum(plain.counts.values()) == model.n_tokens == sum(len(tokens(t)) for i, t in enumerate(texts) if i % 5)
    rows = lm.score_with(counts, model, docs, training).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = plain.score(texts[r["doc_id"]])
        assert abs(r["score"] - want) < 1e-4 * max(1, abs(want))


def test_words_probabilities_sum_to_one(spark):
    """Over all known words and, for each bucket of rare words, the one word that stands for unknown ones."""
    texts, docs = corpus(spark)
    counts, model = lm.fit_lm(docs, F.lit(True))
    plain = Plain(counts, model)
    words = {plain.kind(t) for text in texts for t in tokens(text)}
    assert len(words) > 250 and len({(c, b) for _, c, b in words}) > 20
    for text in ("", "the", "der w17 of", "nothing like this"):
        history = [plain.kind(t) for t in tokens(text)[:-1]]
        total = sum(plain.word(history, *w) for w in words)
        for cls in range(1 + lm.SINGLES, lm.CLASSES):
            by_class, by_bucket = plain.chances(history, cls)
            total += sum(by_class[cls] * by_bucket[b] * 0.1 / 10 ** model.below[cls, b] for b in range(lm.OWN, lm.BUCKETS))
        # Classes of single words that no word took hold what is missing.
        taken = {c for _, c, _ in words}
        total += sum(plain.chances(history, 0)[0][c] for c in range(1 + lm.SINGLES) if c not in taken)
        assert abs(total - 1) < 1e-4


def test_history_tells_words_of_one_class_apart(spark):
    """After "red" comes "apple", after "blue" comes "apply": the same class by their characters, told apart by the history."""
    rng = random.Random(1)
    texts = [" ".join(rng.choice(["red apple", "blue apply"]) + f" x{rng.randrange(40)}" for _ in range(60)) for _ in range(150)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    counts, model = lm.fit_lm(docs, F.lit(True))
    pairs = ["red apple", "red apply", "blue apply", "blue apple"]
    some = spark.createDataFrame(list(enumerate(pairs)), "doc_id long, text string")
    s = {r["doc_id"]: r["score"] for r in lm.score_with(counts, model, some, F.lit(True)).collect()}
    assert s[0] > s[1] + 0.5 and s[2] > s[3] + 0.5


def test_hash_width_grows_and_sums_are_bounded(spark, monkeypatch):
    assert [lm.word_bits(n) for n in (0, 1 << 17, 1 << 20, 1 << 40)] == [8, 10, 13, 16]
    rows = [(b, t, np.full(4, t, np.float32).tobytes()) for t in range(37) for b in range(2)]
    changes = spark.createDataFrame(rows, "block int, grp int, change binary").repartition(5)
    monkeypatch.setattr(lm, "FAN", 3)
    got = lm._summed(changes, 37, 2)
    assert sorted(b for b, _ in got) == [0, 1] and all((np.frombuffer(x, np.float32) == sum(range(37))).all() for _, x in got)


def test_head_is_bounded_by_counts(spark, monkeypatch):
    counts = spark.createDataFrame([(k, f"w{k}".encode(), 1 + k % 7) for k in range(100)] + [(1000, b"x" * 100, 500), (1001, b"big", 900)], "h long, word binary, n long")
    monkeypatch.setattr(lm, "HEAD", 30)
    top = lm.head_words(counts)
    assert top["n"].to_pylist() == [900, *[7] * 14, *[6] * 14]
    assert (lm.head_words(counts.where("false")).num_rows, lm.head_words(counts.where("n = 1")).num_rows) == (0, 15)
    assert lm.long_words(counts)["n"].to_pylist() == [500] and lm.long_words(counts.where("n < 100")).num_rows == 0


def test_long_words_of_every_document_are_no_hot_key(spark, monkeypatch):
    """A long separator in all documents doesn't reach the lookup of rare words' counts; results are the same if it did."""
    line = "=" * 80
    docs = spark.createDataFrame([(k, f"{line} word{k % 7} rare{k} {line} {'-' * 70 if k % 2 else ''}") for k in range(200)], "doc_id long, text string").repartition(4)
    usable = F.col("doc_id") % 10 != 0
    counts, model = lm.fit_lm(docs, usable)
    assert sorted(model.long[1].tolist()) == [100, 360]
    got = {r["doc_id"]: tuple(r) for r in lm.score_with(counts, model, docs, usable).collect()}
    model.long = (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    plain = {r["doc_id"]: tuple(r) for r in lm.score_with(counts, model, docs, usable).collect()}
    assert set(got) == set(plain) and all(np.allclose(got[k], plain[k]) for k in got)


def test_tokens_of_slices():
    (_, _, data, offsets), *_ = slices(pa.array(["a B", "", "c"]))
    t = lm.Tokens(data, offsets)
    assert t.is_end.tolist() == [False, False, True, True, False, True] and int(t.h[1]) == hash_bytes(b"b")
