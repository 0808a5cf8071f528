"""LM scoring by a hashed maximum-entropy model with a class-factored softmax.

P(word | history) = P(class | history) * P(bucket | class, history) * P(word | bucket). Both softmaxes are over
hashed features of the history.

Every word has a class that depends on its characters alone (so unseen words have one): the text's end and the
most frequent words are classes of their own, the rest are clustered by character trigrams; the clusters are
fitted on the CLUSTERED most frequent words, a bound, and every word is assigned. In a class, its OWN most
frequent words are buckets of their own, where P(word | bucket) is 1; other words are dealt by their hash to TAIL
buckets, where it is the smoothed share of the word's count. So a frequent word is predicted from its history
twice, as a class and as a word, and normalising takes CLASSES + BUCKETS terms whatever the vocabulary is.

Features of P(class | history): the word before, the word two before (a skip), the pairs of classes one and
two before, and three and four before (a skip). Features of P(bucket | class, history): the word before and the
word two before, each with the class. The number of rows that words are hashed to grows with the number of
distinct words that were counted (word_bits), up to 2^MAX_BITS, which bounds what is broadcast.

Corpus statistics cover all training documents. Counts of all distinct words are summed by Spark (tasks
pre-aggregate) and stay distributed; only the most frequent ones (HEAD at most, none longer than WORD_BYTES, found
by a histogram of the counts) are broadcast. The counts of other words reach the documents by a shuffle join, one
row for each document and such word.

The softmaxes are trained by distributed gradient updates: in each of ROUNDS rounds tasks, each of MERGED input
partitions, run through their part of the round's training documents with sparse Adagrad steps from the broadcast
weights, and the mean of the tasks' changes, feature by feature over the tasks that met it, is added. What a task
sends is of the model's size. It is summed in levels, FAN tasks' changes at a time and block by block, so that no
task reads more than a constant however many tasks there are. Scoring is in numpy batches over sparse features.

Cases: null texts count as empty, which have one token, the end; with no training documents all counts
are 0; repeated rows are scored one by one; ids may be null or repeat; other columns don't matter; an
empty table gives an empty table.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import dropped, ready, release, written
from .textkit import INK, HashTable, mix, ragged, slices, trigrams, words

CLASSES, SINGLES, CLUSTERED = 32, 8, 1 << 13
OWN, TAIL = 12, 4
BUCKETS = OWN + TAIL
HEAD, WORD_BYTES = 1 << 17, 64
#: Longer words whose counts stand in every task.
LONG = 1 << 14
MIN_BITS, MAX_BITS, TRIGRAM_BITS = 8, 16, 10
ROUNDS, BATCH, RATE = 2, 8192, 0.3
MERGED, FAN, BLOCK = 4, 64, 2048
_PAIRS = CLASSES * CLASSES
_CLOSED = np.float32(-1e4)
END = np.uint64(0x5851F42D4C957F2D)


def word_bits(n_types: int) -> int:
    """Words of the history are hashed to 2^bits rows: about one row for 256 distinct words."""
    return int(np.clip(int(n_types).bit_length() - 8, MIN_BITS, MAX_BITS))


@dataclass
class Classes:
    """The head's words with counts, classes and buckets, and what gives any other word its class."""

    keys: np.ndarray
    counts: np.ndarray
    classes: np.ndarray
    buckets: np.ndarray
    centroids: np.ndarray  # trigram, cluster

    def table(self) -> HashTable:
        out = HashTable(max(16, len(self.keys)))
        out.put(self.keys, np.arange(len(self.keys), dtype=np.int32))
        return out

    def of(self, low: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Classes of words outside the head."""
        return 1 + SINGLES + cluster_of(self.centroids, low, start, end)

    def open(self) -> np.ndarray:
        """Which buckets of a class (class, bucket) may hold words: its own words' and, but for the end and single words, the tail."""
        out = np.zeros((CLASSES, BUCKETS), bool)
        out[1 + SINGLES :, OWN:] = True
        out[: 1 + SINGLES, 0] = True
        out[self.classes, self.buckets] = True
        return out


def tail_bucket(h: np.ndarray) -> np.ndarray:
    return OWN + ((h >> np.uint64(17)) % np.uint64(TAIL)).astype(np.int64)


def _vectors(low: np.ndarray, start: np.ndarray, end: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Sums of the rows of weights of each word's trigrams."""
    rows, first = trigrams(low, start, end, TRIGRAM_BITS)
    return np.add.reduceat(weights[rows], first) if len(first) else np.zeros((0, weights.shape[1]), weights.dtype)


def cluster_of(centroids: np.ndarray, low: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    out = np.empty(len(start), np.int64)
    for p in range(0, len(start), 1 << 14):
        q = slice(p, p + (1 << 14))
        out[q] = _vectors(low, start[q], end[q], centroids).argmax(1)
    return out


def make_classes(keys: np.ndarray, counts: np.ndarray, pieces: list[bytes]) -> Classes:
    """From the head in order of falling counts. Clusters are spherical k-means on trigrams of the first CLUSTERED words."""
    size = np.array([len(p) for p in pieces], np.int64)
    low = np.frombuffer(b"".join(pieces), np.uint8)
    end = np.cumsum(size)
    start = end - size
    k = CLASSES - SINGLES - 1
    own = slice(0, CLUSTERED)
    is_word = size[own] > 0  # the end has no characters
    at = np.flatnonzero(is_word)
    x = np.zeros((len(at), 1 << TRIGRAM_BITS), np.float32)
    rows, first = trigrams(low, start[at], end[at], TRIGRAM_BITS)
    np.add.at(x, (np.repeat(np.arange(len(at)), np.diff(np.append(first, len(rows)))), rows), 1)
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    weight = np.log1p(counts[at]).astype(np.float32)
    centroids = np.zeros((1 << TRIGRAM_BITS, k), np.float32)
    if len(at):
        rng = np.random.default_rng(3)
        chosen = [0]
        near = x @ x[0]
        for _ in range(1, min(k, len(at))):  # far-apart seeds
            far = np.clip(1 - near, 0, None) ** 2 * weight
            chosen.append(int(rng.choice(len(at), p=far / far.sum())) if far.sum() > 0 else 0)
            near = np.maximum(near, x @ x[chosen[-1]])
        c = np.zeros((k, x.shape[1]), np.float32)
        c[: len(chosen)] = x[chosen]
        for _ in range(10):
            label = (x @ c.T).argmax(1)
            new = np.zeros_like(c)
            for j in range(k):
                new[j] = weight[label == j] @ x[label == j]
            norm = np.linalg.norm(new, axis=1, keepdims=True)
            c = np.where(norm > 0, new / np.maximum(norm, 1e-9), c)
        centroids = c.T.copy()
    classes = np.zeros(len(keys), np.int64)
    word = np.flatnonzero(size > 0)
    classes[word] = 1 + SINGLES + cluster_of(centroids, low, start[word], end[word])
    classes[word[:SINGLES]] = 1 + np.arange(len(word[:SINGLES]))
    # Buckets: places among the class's words, which come by falling counts.
    order = np.argsort(classes, kind="stable")
    place = np.empty(len(keys), np.int64)
    place[order] = np.arange(len(keys)) - np.searchsorted(classes[order], classes[order])
    buckets = np.where(place < OWN, place, tail_bucket(keys))
    return Classes(keys, counts, classes.astype(np.int32), buckets.astype(np.int32), centroids)


class Tokens:
    """A slice's tokens in order: each document's words and then the end."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        h, self.start, self.end, first = words(data, offsets, INK)
        docs = np.arange(len(offsets) - 1)
        self.first = first + np.arange(len(first))
        self.h = np.empty(len(h) + len(docs), np.uint64)
        self.is_end = np.zeros(len(self.h), bool)
        self.is_end[self.first[1:] - 1] = True
        self.h[~self.is_end], self.h[self.is_end] = h, END
        self.low = np.where((data >= 65) & (data <= 90), data + 32, data)

    def classify(self, classes: Classes, table: HashTable) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Place in the head (-1: outside), class and bucket of every token."""
        at = table.get(self.h)
        out, bucket = np.zeros(len(at), np.int64), np.where(self.is_end, 0, tail_bucket(self.h))
        if len(classes.classes):
            out = np.where(at >= 0, classes.classes[at], 0).astype(np.int64)
            bucket = np.where(at >= 0, classes.buckets[at], bucket)
        word = np.cumsum(~self.is_end) - 1
        miss = np.flatnonzero((at < 0) & ~self.is_end)
        if len(miss):
            _, lead, back = np.unique(self.h[miss], return_index=True, return_inverse=True)
            w = word[miss[lead]]
            out[miss] = classes.of(self.low, self.start[w], self.end[w])[back]
        return at, out, bucket

    def features(self, cls: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """Each token's rows (feature, token) in the tables of its history's features, for the class and for the bucket."""
        place = np.arange(len(self.h)) - np.repeat(self.first[:-1], np.diff(self.first))

        def back(x: np.ndarray, k: int, fill) -> np.ndarray:
            out = np.full(len(x), fill, x.dtype)
            out[k:] = x[:-k]
            out[place < k] = fill
            return out

        shift = np.uint64(64 - bits)
        one, two = mix(back(self.h, 1, END)), mix(back(self.h, 2, END))
        own = (cls.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        rows = np.empty((4, len(cls)), np.uint16)
        rows[0], rows[1] = one >> shift, two >> shift
        rows[2] = back(cls, 1, 0) * CLASSES + back(cls, 2, 0)
        rows[3] = back(cls, 3, 0) * CLASSES + back(cls, 4, 0)
        inner = np.empty((2, len(cls)), np.uint16)
        inner[0], inner[1] = mix(one ^ own) >> shift, mix(two ^ own) >> shift
        return rows, inner


class Weights:
    """Tables of the two softmaxes' weights (row, output) in one matrix each: biases first, then a table for each feature.

    The class softmax has one row of biases; the bucket softmax has one for each class."""

    def __init__(self, bits: int):
        size = 1 << bits
        self.bits = bits
        self.class_at = np.array([1, 1 + size, 1 + 2 * size, 1 + 2 * size + _PAIRS])
        self.bucket_at = np.array([CLASSES, CLASSES + size])
        self.by_class = np.zeros((1 + 2 * size + 2 * _PAIRS, CLASSES), np.float32)
        self.by_bucket = np.zeros((CLASSES + 2 * size, BUCKETS), np.float32)

    def start(self, n: np.ndarray, opened: np.ndarray) -> None:
        """Biases from the counts of tokens (class, bucket); closed buckets have no probability."""
        self.by_class[0] = np.log((n.sum(1) + 0.1) / (n.sum() + 0.1 * CLASSES))
        share = np.log((n + 0.1) / (n.sum(1, keepdims=True) + 0.1 * BUCKETS))
        self.by_bucket[:CLASSES] = np.where(opened, share, _CLOSED)

    def tables(self) -> list[np.ndarray]:
        return [self.by_class, self.by_bucket]


def _log_softmax(z: np.ndarray) -> np.ndarray:
    # Weights stay far below the bound, which keeps exp finite; numpy's reductions along short rows are slow, a product isn't.
    np.clip(z, -60, 60, out=z)
    z -= np.log(np.exp(z) @ np.ones(z.shape[1], np.float32))[:, None]
    return z


def _logits(table: np.ndarray, bias: np.ndarray, starts: np.ndarray, rows: np.ndarray) -> np.ndarray:
    z = np.take(table, bias, axis=0)
    for at, row in zip(starts, rows, strict=True):
        z += np.take(table, at + row.astype(np.int64), axis=0)
    return z


def class_logs(w: Weights, rows: np.ndarray) -> np.ndarray:
    """Natural logs of P(class | history) (token, class)."""
    return _log_softmax(_logits(w.by_class, np.zeros(rows.shape[1], np.int64), w.class_at, rows))


def bucket_logs(w: Weights, cls: np.ndarray, inner: np.ndarray) -> np.ndarray:
    """Natural logs of P(bucket | class, history) (token, bucket)."""
    return _log_softmax(_logits(w.by_bucket, cls, w.bucket_at, inner))


def token_logs(w: Weights, cls: np.ndarray, bucket: np.ndarray, rows: np.ndarray, inner: np.ndarray) -> np.ndarray:
    """Natural log of P(class | history) P(bucket | class, history) of every token."""
    out = np.empty(len(cls))
    for p in range(0, len(cls), BATCH):
        q = slice(p, p + BATCH)
        at = np.arange(len(cls[q]))
        out[q] = class_logs(w, rows[:, q])[at, cls[q]]
        many = np.flatnonzero(cls[q] > SINGLES) + p  # other classes have one word
        out[many] += bucket_logs(w, cls[many], inner[:, many])[np.arange(len(many)), bucket[many]]
    return out


def _descend(table: np.ndarray, square: np.ndarray, met: np.ndarray, at: int, rows: np.ndarray, grad: np.ndarray) -> None:
    """An Adagrad step on the rows (from row `at` on) that a batch of gradients touches."""
    order = np.argsort(rows, kind="stable")  # of 16 bits: a radix sort
    rows = rows[order]
    lead = np.flatnonzero(np.append(True, rows[1:] != rows[:-1]))
    size = np.diff(np.append(lead, len(rows)))
    # Most rows of a words' table are met once in a batch; reduceat is slow on segments of one.
    own, part = at + rows[lead].astype(np.int64), np.take(grad, order[lead], axis=0)
    many = np.flatnonzero(size > 1)
    if len(many):
        part[many] = np.add.reduceat(np.take(grad, order[ragged(lead[many], size[many])], axis=0), np.cumsum(size[many]) - size[many])
    scale = square[own] + (part * part) @ np.full(part.shape[1], 1 / part.shape[1], np.float32)
    square[own] = scale
    part *= (RATE / np.sqrt(scale))[:, None]
    table[own] = np.take(table, own, axis=0) - part
    met[own] = True


def train_on(w: Weights, squares: list[np.ndarray], met: list[np.ndarray], cls: np.ndarray, bucket: np.ndarray, rows: np.ndarray, inner: np.ndarray) -> None:
    """Sparse Adagrad steps over batches of tokens, in place."""
    for p in range(0, len(cls), BATCH):
        q = slice(p, p + BATCH)
        c, b = cls[q], bucket[q]
        g = np.exp(class_logs(w, rows[:, q]))
        g[np.arange(len(c)), c] -= 1
        total = g.sum(0)
        squares[0][0] += float(total @ total) / CLASSES
        w.by_class[0] -= RATE * total / np.sqrt(squares[0][0])
        met[0][0] = True
        for at, row in zip(w.class_at, rows[:, q], strict=True):
            _descend(w.by_class, squares[0], met[0], at, row, g)
        many = np.flatnonzero(c > SINGLES)
        if len(many):
            c, f = c[many], inner[:, q][:, many]
            g = np.exp(bucket_logs(w, c, f))
            g[np.arange(len(c)), b[many]] -= 1
            _descend(w.by_bucket, squares[1], met[1], 0, c.astype(np.uint16), g)
            for at, row in zip(w.bucket_at, f, strict=True):
                _descend(w.by_bucket, squares[1], met[1], at, row, g)


def count_words(docs: DataFrame, training: Column, text_col: str) -> DataFrame:
    """(h, word, n): counts of all distinct tokens of the training documents; the end is the empty word."""

    def run(batches):
        held, size = [], 0

        def out():
            keys, lead, back = np.unique(np.concatenate([k for k, _, _ in held]), return_index=True, return_inverse=True)
            counts = np.bincount(back, np.concatenate([n for _, _, n in held])).astype(np.int64)
            pieces = pa.concat_arrays([p for _, p, _ in held]).take(pa.array(lead)).cast(pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pieces, pa.array(counts)], names=["h", "word", "n"])

        for batch in batches:
            for _, _, data, offsets in slices(batch.column(0)):
                t = Tokens(data, offsets)
                own, at, n = np.unique(t.h, return_index=True, return_counts=True)
                word = (np.cumsum(~t.is_end) - 1)[at]
                length = np.where(t.is_end[at], 0, (t.end - t.start)[word] if len(t.start) else 0)
                start = t.start[word] if len(t.start) else np.zeros(len(at), np.int64)
                raw = t.low[ragged(start, length)]
                pieces = pa.Array.from_buffers(pa.large_binary(), len(own), [None, pa.py_buffer(np.concatenate([[0], np.cumsum(length)]).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(raw, np.uint8))])
                held.append((own, pieces, n))
                size += len(own)
                if size > 1 << 20:
                    yield out()
                    held, size = [], 0
        if held:
            yield out()
        held = batch = None
        release()

    return docs.where(training).select(text_col).mapInArrow(run, "h bigint, word binary, n bigint").groupBy("h", "word").agg(F.sum("n").alias("n"))


def _top(some: DataFrame, most: int, columns: list[str]) -> pa.Table:
    """The most frequent words, `most` at most, by falling counts. A histogram of the counts gives the least count, so that no more are sent."""
    level = F.when(F.col("n") < 64, F.col("n")).otherwise(16 + F.floor(F.log2("n") * 8)).cast("int")
    some = some.withColumn("level", level)
    least, total = 1 << 30, 0
    for at, n in sorted(some.groupBy("level").count().collect(), reverse=True):  # some hundred rows
        total += n
        if total > most:
            break
        least = at
    return some.where(F.col("level") >= least).select(*columns).toArrow().sort_by([("n", "descending"), ("h", "ascending")])


def head_words(counts: DataFrame) -> pa.Table:
    return _top(counts.where(F.length("word") <= WORD_BYTES), HEAD, ["h", "word", "n"])


def long_words(counts: DataFrame) -> pa.Table:
    """Hashes and counts of the most frequent words that are too long for the head: a separator line that stands in every document must not
    become a hot key when counts are looked up. Their classes come from their characters, as those of all words outside the head."""
    return _top(counts.where(F.length("word") > WORD_BYTES), LONG, ["h", "n"])


def bucket_totals(counts: DataFrame, shared) -> tuple[np.ndarray, np.ndarray]:
    """Tokens and distinct words of each (class, bucket)."""
    size = CLASSES * BUCKETS

    def run(batches):
        classes = shared.value
        table = classes.table()
        n, v = np.zeros(size, np.int64), np.zeros(size, np.int64)
        for batch in batches:
            h = np.asarray(batch.column(0)).view(np.uint64)
            at = table.get(h)
            cls = np.where(at >= 0, classes.classes[at], 0).astype(np.int64)
            bucket = np.where(at >= 0, classes.buckets[at], tail_bucket(h))
            is_end = h == END
            bucket[is_end] = 0
            miss = np.flatnonzero((at < 0) & ~is_end)
            if len(miss):
                some = batch.column(1).take(pa.array(miss)).to_pylist()
                end = np.cumsum([len(w) for w in some])
                cls[miss] = classes.of(np.frombuffer(b"".join(some), np.uint8), end - [len(w) for w in some], end)
            n += np.bincount(cls * BUCKETS + bucket, np.asarray(batch.column(2)), minlength=size).astype(np.int64)
            v += np.bincount(cls * BUCKETS + bucket, minlength=size)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), pa.array(n), pa.array(v)], names=["c", "n", "v"])

    n, v = np.zeros(size, np.int64), np.zeros(size, np.int64)
    for c, a, b in counts.mapInArrow(run, "c bigint, n bigint, v bigint").groupBy("c").agg(F.sum("n"), F.sum("v")).collect():  # a row for each bucket
        n[c], v[c] = a, b
    return n.reshape(CLASSES, BUCKETS), v.reshape(CLASSES, BUCKETS)


def _summed(changes: DataFrame, n_tasks: int, n_blocks: int) -> list:
    """(block, sum of the tasks' changes): FAN tasks' changes at a time, level by level."""

    def total(batches):
        sums: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for block, group, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                x = np.frombuffer(raw.as_buffer(), np.float32)
                sums[block, group] = sums[block, group] + x if (block, group) in sums else x.copy()
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in sums], pa.int32()), pa.array([k[1] for k in sums], pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], names=["block", "grp", "change"])

    while n_tasks > 1:
        n_tasks = -(-n_tasks // FAN)
        changes = changes.withColumn("grp", F.floor(F.col("grp") / FAN).cast("int"))
        changes = changes.repartition(max(1, n_blocks * n_tasks // 4), "block", "grp").mapInArrow(total, "block int, grp int, change binary")
    return [(r["block"], r["change"]) for r in changes.select("block", "change").collect()]


def train(docs: DataFrame, training: Column, shared, weights: Weights, text_col: str) -> Weights:
    """weights after ROUNDS rounds."""
    sc = docs.sparkSession.sparkContext
    tables = weights.tables()
    blocks = [(k, p) for k, table in enumerate(tables) for p in range(0, len(table), BLOCK)]
    n_tasks = max(1, -(-docs.rdd.getNumPartitions() // MERGED))
    for round_ in range(ROUNDS):
        now = sc.broadcast(weights)

        def run(batches, now=now):
            begun, classes = now.value, shared.value
            table, own = classes.table(), Weights(begun.bits)
            own.by_class, own.by_bucket = (x.copy() for x in begun.tables())
            squares, met = [np.ones(len(x), np.float32) for x in own.tables()], [np.zeros(len(x), bool) for x in own.tables()]
            for batch in batches:
                for _, _, data, offsets in slices(batch.column(0)):
                    t = Tokens(data, offsets)
                    _, cls, bucket = t.classify(classes, table)
                    train_on(own, squares, met, cls, bucket, *t.features(cls, own.bits))
            if met[0].any():
                part = TaskContext.get().partitionId()
                for k, p in blocks:
                    q = slice(p, p + BLOCK)
                    change = np.where(met[k][q, None], own.tables()[k][q] - begun.tables()[k][q], 0)
                    raw = np.concatenate([change, met[k][q, None]], 1).astype(np.float32).tobytes()
                    yield pa.RecordBatch.from_arrays([pa.array([blocks.index((k, p))], pa.int32()), pa.array([part], pa.int32()), pa.array([raw], pa.binary())], names=["block", "grp", "change"])
            begun = own = squares = met = table = None
            release()

        of_round = docs.where(training & (F.pmod(F.xxhash64(text_col), F.lit(ROUNDS)) == round_)).select(text_col).coalesce(n_tasks)
        for block, raw in _summed(of_round.mapInArrow(run, "block int, grp int, change binary"), n_tasks, len(blocks)):  # the model's size
            k, p = blocks[block]
            x = np.frombuffer(raw, np.float32).reshape(-1, tables[k].shape[1] + 1)
            tables[k][p : p + BLOCK] += x[:, :-1] / np.maximum(x[:, -1:], 1)
        now.unpersist()
    return weights


@dataclass
class Model:
    """What scoring needs. below: log10 of what a word's count is divided by in its bucket (class, bucket); own words' is their own count."""

    classes: Classes
    weights: Weights
    below: np.ndarray
    n_tokens: int
    n_types: int
    long: tuple[np.ndarray, np.ndarray]


def fit_lm(docs: DataFrame, training: Column, text_col: str = "text") -> tuple[DataFrame, Model]:
    """The counts of all training words, and the model."""
    sc = ready(docs.sparkSession).sparkContext
    counts = written(count_words(docs, training, text_col), "counts")
    n_tokens, n_types = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    top = head_words(counts)
    classes = make_classes(top["h"].to_numpy().view(np.uint64), top["n"].to_numpy(), top["word"].to_pylist())
    del top
    shared = sc.broadcast(classes)
    n, v = bucket_totals(counts, shared)
    weights = Weights(word_bits(n_types))
    weights.start(n, classes.open())
    weights = train(docs, training, shared, weights, text_col)
    shared.unpersist()
    below = np.log10(n + 0.1 * (v + 1))
    long = long_words(counts)
    return counts, Model(classes, weights, below, n_tokens, n_types, (long["h"].to_numpy().view(np.uint64), long["n"].to_numpy()))


def own_words(cls: np.ndarray, bucket: np.ndarray) -> np.ndarray:
    """Tokens whose bucket (or class) is theirs alone."""
    return (cls <= SINGLES) | (bucket < OWN)


def score_lm(docs: DataFrame, training: Column, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id_col, held_out, n_tokens, n_known, train_tokens, base_score, score) of each whole text; logs are to base 10.

    training: the condition on docs' columns under which a row is learned from."""
    counts, model = fit_lm(docs, training, text_col)
    out = score_with(counts, model, docs, training, text_col, id_col)
    dropped(docs.sparkSession, counts)
    return out


def score_with(counts: DataFrame, model: Model, docs: DataFrame, training: Column, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """score_lm's rows by a model that is there; nothing of the result reads counts any more."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        c, w = m.classes, m.weights
        table, row = c.table(), TaskContext.get().partitionId() << 36
        head_log = np.log10(c.counts + 0.1)
        long, long_log = HashTable(max(16, len(m.long[0]))), np.log10(m.long[1] + 0.1)
        long.put(m.long[0], np.arange(len(m.long[0]), dtype=np.int32))
        for batch in batches:
            ids, held = batch.column(0), batch.column(2)
            for i, j, data, offsets in slices(batch.column(1)):
                t = Tokens(data, offsets)
                at, cls, bucket = t.classify(c, table)
                known = at >= 0
                logs = np.zeros(len(at))
                logs[known] = head_log[at[known]]
                # A word that is all of its bucket has P(word | bucket) = 1: its count cancels out.
                below = np.where(own_words(cls, bucket), np.where(known, logs, np.log10(0.1)), m.below[cls, bucket])
                # Counts of frequent long words are at hand too; they are in no bucket of their own.
                place = long.get(t.h) if len(long_log) else np.full(len(at), -1)
                logs[place >= 0] = long_log[place[place >= 0]]
                known |= place >= 0
                chance = token_logs(w, cls, bucket, *t.features(cls, w.bits)) / np.log(10) - below
                doc = np.repeat(np.arange(j - i), np.diff(t.first))
                tail = np.flatnonzero(~known)
                key, tf = _pairs(doc[tail], t.h[tail])
                bound = np.searchsorted(key[0], np.arange(j - i + 1, dtype=np.uint64))
                tails = pa.ListArray.from_arrays(pa.array(bound, pa.int32()), pa.StructArray.from_arrays([pa.array(key[1].view(np.int64)), pa.array(tf.astype(np.int64))], names=["h", "tf"]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(row, row + j - i)), ids.slice(i, j - i), held.slice(i, j - i), pa.array(np.diff(t.first)), *(pa.array(np.add.reduceat(x, t.first[:-1])) for x in (known.astype(np.int64), logs, chance)), tails],
                    names=["row", "id", "held_out", "n_tokens", "head_known", "head_log", "model_log", "tails"],
                )
                row += j - i
        release()

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"row bigint, id {kind}, held_out boolean, n_tokens bigint, head_known bigint, head_log double, model_log double, tails array<struct<h:bigint,tf:bigint>>"
    scored = written(docs.select(id_col, text_col, (~training).alias("held_out")).mapInArrow(run, schema), "scored")
    tails = scored.select("row", F.explode("tails").alias("t")).select("row", "t.h", "t.tf")
    found = tails.join(counts.select("h", "n"), "h", "left").groupBy("row").agg(
        F.sum(F.col("tf") * F.log10(F.coalesce("n", F.lit(0)) + 0.1)).alias("tail_log"), F.sum(F.when(F.col("n") > 0, F.col("tf")).otherwise(0)).alias("tail_known")
    )
    found = written(found, "tails")
    log = F.col("head_log") + F.coalesce("tail_log", F.lit(0.0))
    bottom = float(np.log10(model.n_tokens + 0.1 * (model.n_types + 1)))
    return scored.drop("tails").join(found, "row", "left").select(
        F.col("id").alias(id_col), "held_out", "n_tokens", (F.col("head_known") + F.coalesce("tail_known", F.lit(0))).cast("bigint").alias("n_known"), F.lit(model.n_tokens).cast("bigint").alias("train_tokens"),
        (log - F.col("n_tokens") * F.lit(bottom)).alias("base_score"), (log + F.col("model_log")).alias("score"),
    )


def _pairs(doc: np.ndarray, h: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray], np.ndarray]:
    """Distinct (document, word) pairs in order, and their counts."""
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])
    lead = np.flatnonzero(new)
    return (doc[lead].astype(np.uint64), h[lead]), np.diff(np.append(lead, len(h)))
