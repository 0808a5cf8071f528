"""Toxicity scores by a bidirectional gated recurrent network with attention pooling, trained in numpy.

A word's input is its own vector (by a hash of the word) and the mean vector of its character trigrams, so
unseen words made of known parts are read too. Three inputs are set from counts before training: the
word's log-odds of standing in a toxic text, and the mean and largest log-odds of its trigrams. Two gated
recurrent units read a window of WINDOW words in both directions, attention pools their states into one
logit, and a text's logit is the largest of its windows, which start every STRIDE words. They overlap by three
quarters, so every passage of up to WINDOW - STRIDE words stands whole in one of them, wherever it begins.

The network is fitted by the driver on a bounded sample of labelled rows: at most ``per_class`` rows of each
label, first in the order of a hash of their ids, of texts of at most MAX_CHARS characters (so the driver takes
2 * per_class * MAX_CHARS characters at most). A text trains on the window that scores highest among its MINED windows
of highest log-odds. Scoring is one map over all rows with the weights broadcast (under 1 MB).

Cases: a null or empty text, or one without words, has score 0; null labels and ids don't train; an id
labelled twice counts once with its larger label; with fewer than two labels in the sample every text gets the
share of toxic ones in it as its score; repeated rows and other columns pass through (a column with an
output's name is replaced); an empty table gives an empty table.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import dropped, map_columns, ready, release, written
from .textkit import ragged, slices, trigrams, words

WINDOW, STRIDE, MINED = 32, 8, 4
WORD_ROWS, CHAR_ROWS, LEARNED, HIDDEN, ATTEND = 1 << 14, 1 << 12, 5, 8, 8
INPUTS = 3 + LEARNED
PER_CLASS, MAX_CHARS, EPOCHS, BATCH = 2000, 1 << 15, 5, 64


def _word_rows(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(50)).astype(np.int64)


class Types:
    """The distinct words of a slice: type of each word, word row of each type, trigram rows of each type."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        h, start, end, self.first = words(data, offsets)
        own, at, self.of_word = np.unique(h, return_index=True, return_inverse=True)
        self.rows = _word_rows(own)
        low = np.where((data >= 65) & (data <= 90), data + 32, data)
        self.chars, self.char_first = trigrams(low, start[at], end[at], 12)


@dataclass
class Model:
    word_odds: np.ndarray
    char_odds: np.ndarray
    word: np.ndarray
    char: np.ndarray
    wx: np.ndarray  # 2 directions, INPUTS, 3 gates of HIDDEN: update, reset, new
    wh: np.ndarray
    bias: np.ndarray
    attend: np.ndarray
    query: np.ndarray
    out: np.ndarray
    shift: float = 0.0
    scale: float = 1.0
    constant: float | None = None

    def inputs(self, t: Types) -> np.ndarray:
        """A row for each type."""
        n = len(t.rows)
        x = np.zeros((n, INPUTS), np.float32)
        if n:
            count = np.diff(np.append(t.char_first, len(t.chars)))[:, None]
            odds = self.char_odds[t.chars]
            x[:, 0] = self.word_odds[t.rows]
            x[:, 1] = np.add.reduceat(odds, t.char_first) / count[:, 0]
            x[:, 2] = np.maximum.reduceat(odds, t.char_first)
            x[:, 3:] = self.word[t.rows] + np.add.reduceat(self.char[t.chars], t.char_first) / count
        return x


def _new_model(rng: np.random.Generator) -> Model:
    def some(*shape, size=0.3):
        return rng.normal(0, size, shape).astype(np.float32)

    return Model(
        np.zeros(WORD_ROWS, np.float32), np.zeros(CHAR_ROWS, np.float32), some(WORD_ROWS, LEARNED, size=0.05), some(CHAR_ROWS, LEARNED, size=0.05),
        some(2, INPUTS, 3 * HIDDEN), some(2, HIDDEN, 3 * HIDDEN), np.zeros((2, 3 * HIDDEN), np.float32), some(2 * HIDDEN, ATTEND), some(ATTEND, size=1.0), np.append(some(2 * HIDDEN), np.float32(0)),
    )


def windows(first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, first word and number of words of every window. A text of n words has one at 0, STRIDE, ... up to the first that reaches its end."""
    n = np.diff(first)
    count = np.where(n > 0, 1 + np.maximum(0, -(-(n - WINDOW) // STRIDE)), 0)
    doc = np.repeat(np.arange(len(n)), count)
    offset = ragged(np.zeros(len(n), np.int64), count) * STRIDE
    return doc, first[doc] + offset, np.minimum(WINDOW, n[doc] - offset)


def _attention(m: Model, states: np.ndarray, size: np.ndarray):
    """Logits from states (step, window, 2 HIDDEN)."""
    u = np.tanh(states @ m.attend)
    s = u @ m.query
    s[np.arange(len(s))[:, None] >= size[None, :]] = -np.inf
    s -= s.max(0)
    a = np.exp(s)
    a /= a.sum(0)
    pooled = np.einsum("tb,tbh->bh", a, states)
    return u, a, pooled, pooled @ m.out[:-1] + m.out[-1]


def logits(m: Model, gates: np.ndarray, types: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Window logits. gates: input part of the gates for each type (2, types, 3 HIDDEN); types: (step, window)."""
    steps, n = types.shape
    h = np.zeros((2, n, HIDDEN), np.float32)
    states = np.empty((steps, n, 2 * HIDDEN), np.float32)
    x = np.empty((2, n, 3 * HIDDEN), np.float32)
    full = (size == steps).all()
    for t in range(steps):
        x[0], x[1] = gates[0][types[t]], gates[1][types[steps - 1 - t]]
        r = np.matmul(h, m.wh)
        # sigmoid(v) is 0.5 + 0.5 tanh(v / 2)
        g = x[..., : 2 * HIDDEN] + r[..., : 2 * HIDDEN]
        g *= 0.5
        np.tanh(g, out=g)
        g *= 0.5
        g += 0.5
        new = np.tanh(x[..., 2 * HIDDEN :] + g[..., HIDDEN:] * r[..., 2 * HIDDEN :])
        h = new + g[..., :HIDDEN] * (h - new)
        if not full:
            h[1] *= (steps - 1 - t < size)[:, None]
        states[t, :, :HIDDEN], states[steps - 1 - t, :, HIDDEN:] = h[0], h[1]
    return _attention(m, states, size)[3]


def _gates(m: Model, x: np.ndarray) -> np.ndarray:
    return np.matmul(x, m.wx) + m.bias[:, None, :]


def _index(of_word: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    step = np.minimum(np.arange(WINDOW)[:, None], size[None, :] - 1)
    return of_word[start[None, :] + step]


def score_slice(m: Model, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Scores of a slice's texts: over all windows."""
    n = len(offsets) - 1
    if m.constant is not None:
        return np.full(n, m.constant)
    t = Types(data, offsets)
    doc, start, size = windows(t.first)
    best = np.full(n, -np.inf)
    gates = _gates(m, m.inputs(t))
    partial = size < WINDOW
    for group in (np.flatnonzero(~partial), np.flatnonzero(partial)):
        for p in range(0, len(group), 2048):
            q = group[p : p + 2048]
            np.maximum.at(best, doc[q], logits(m, gates, _index(t.of_word, start[q], size[q]), size[q]))
    return np.where(np.isinf(best), 0.0, 1 / (1 + np.exp(-np.clip(m.scale * best + m.shift, -30, 30))))


def _seen(rows: np.ndarray, doc: np.ndarray, n_rows: int, label: np.ndarray) -> np.ndarray:
    """How many texts of each label (0, 1) every row stands in; doc counts from 0 in label."""
    own = np.unique(doc * n_rows + rows)
    kind = label[own // n_rows]
    return np.stack([np.bincount(own[kind == k] % n_rows, minlength=n_rows) for k in (0, 1)])


def _odds(seen: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """Shrunken log-odds of rows by how many toxic and other texts they stand in; none for rows of one or two texts."""
    neg, pos = seen
    raw = np.log((pos + 1) / (texts[1] + 2)) - np.log((neg + 1) / (texts[0] + 2))
    return np.clip(raw * np.maximum(pos + neg - 2, 0) / (pos + neg + 4), -3, 3).astype(np.float32)


def _gradients(m: Model, x: np.ndarray, size: np.ndarray, label: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
    """Gradients of the mean log loss on windows with inputs x (step, window, INPUTS), of the inputs too, and the logits."""
    steps, n, _ = x.shape
    states, kept = np.empty((steps, n, 2 * HIDDEN), np.float32), []
    mask = (np.arange(steps)[:, None] < size[None, :]).astype(np.float32)[..., None]
    for d in range(2):
        h, trail = np.zeros((n, HIDDEN), np.float32), []
        for t in range(steps) if d == 0 else range(steps - 1, -1, -1):
            pre, r = x[t] @ m.wx[d] + m.bias[d], h @ m.wh[d]
            g = 1 / (1 + np.exp(-np.clip(pre[:, : 2 * HIDDEN] + r[:, : 2 * HIDDEN], -30, 30)))
            z, reset, rn = g[:, :HIDDEN], g[:, HIDDEN:], r[:, 2 * HIDDEN :]
            new = np.tanh(pre[:, 2 * HIDDEN :] + reset * rn)
            after = (new + z * (h - new)) * mask[t]
            trail.append((t, h, z, reset, rn, new))
            h = after
            states[t, :, d * HIDDEN : (d + 1) * HIDDEN] = h
        kept.append(trail)
    u, a, pooled, logit = _attention(m, states, size)
    dl = ((1 / (1 + np.exp(-np.clip(logit, -30, 30))) - label) / n).astype(np.float32)
    grad = {k: np.zeros_like(getattr(m, k)) for k in ("wx", "wh", "bias", "attend", "query", "out")}
    grad["out"][:-1], grad["out"][-1] = pooled.T @ dl, dl.sum()
    dpooled = dl[:, None] * m.out[:-1]
    da = np.einsum("bh,tbh->tb", dpooled, states)
    ds = a * (da - (a * da).sum(0))
    du = ds[..., None] * m.query * (1 - u * u)
    grad["query"] = np.einsum("tb,tba->a", ds, u)
    grad["attend"] = np.einsum("tbh,tba->ha", states, du)
    dstates = a[..., None] * dpooled[None] + du @ m.attend.T
    dx = np.zeros_like(x)
    for d in range(2):
        dh = np.zeros((n, HIDDEN), np.float32)
        for t, before, z, reset, rn, new in reversed(kept[d]):
            dh = (dh + dstates[t, :, d * HIDDEN : (d + 1) * HIDDEN]) * mask[t]
            dnew = dh * (1 - z) * (1 - new * new)
            dz = dh * (before - new) * z * (1 - z)
            dreset = dnew * rn * reset * (1 - reset)
            dpre = np.concatenate([dz, dreset, dnew], 1)
            dr = np.concatenate([dz, dreset, dnew * reset], 1)
            grad["wx"][d] += x[t].T @ dpre
            grad["bias"][d] += dpre.sum(0)
            grad["wh"][d] += before.T @ dr
            dx[t] += dpre @ m.wx[d].T
            dh = dh * z + dr @ m.wh[d].T
    return grad, dx, logit


def fit(texts: list[str | None], labels: list[int], prior: float, seed: int = 7) -> Model:
    """A model from texts and labels (0, 1). prior: the share of toxic texts among all labelled ones, for the final calibration."""
    rng = np.random.default_rng(seed)
    m, label = _new_model(rng), np.array(labels, np.int64)
    if len(label) == 0 or label.min() == label.max():
        m.constant = float(label.mean()) if len(label) else 0.0
        return m
    column = pa.array(texts, pa.string())
    parts, docs = [], []
    for i, j, data, offsets in slices(column, 1 << 20):
        parts.append(Types(data, offsets))
        docs.append((i, j))
    # Every fifth text is kept for calibration and sets no odds.
    train = np.arange(len(label)) % 5 != 0
    word_seen, char_seen = np.zeros((2, WORD_ROWS), np.int64), np.zeros((2, CHAR_ROWS), np.int64)
    for t, (i, j) in zip(parts, docs, strict=True):
        doc = np.repeat(np.arange(j - i), np.diff(t.first))
        pair = np.unique(doc * len(t.rows) + t.of_word) if len(doc) else np.zeros(0, np.int64)
        doc, kind = (pair // len(t.rows), pair % len(t.rows)) if len(pair) else (pair, pair)
        use = train[doc + i]
        doc, kind = doc[use], kind[use]
        word_seen += _seen(t.rows[kind], doc, WORD_ROWS, label[i:j])
        count = np.diff(np.append(t.char_first, len(t.chars)))[kind]
        char_seen += _seen(t.chars[ragged(t.char_first[kind], count)], np.repeat(doc, count), CHAR_ROWS, label[i:j])
    texts_of = np.bincount(label[train], minlength=2)
    m.word_odds, m.char_odds = _odds(word_seen, texts_of), _odds(char_seen, texts_of)
    # Windows to train on: of each text, the MINED with the highest odds in them.
    items = []  # part, document, first word, size
    for k, (t, (i, _)) in enumerate(zip(parts, docs, strict=True)):
        doc, start, size = windows(t.first)
        if not len(doc):
            continue
        x = m.inputs(t)
        level = np.maximum(x[:, 0], x[:, 2])[_index(t.of_word, start, size)].max(0)
        order = np.lexsort((-level, doc))
        place = np.arange(len(doc)) - np.searchsorted(doc[order], doc[order])
        chosen = order[place < MINED]
        chosen = chosen[train[doc[chosen] + i]]
        items += [(k, int(doc[c]) + i, int(start[c]), int(size[c])) for c in chosen]
    by_doc: dict[int, list[tuple]] = {}
    for item in items:
        by_doc.setdefault(item[1], []).append(item)
    ids = list(by_doc)
    names = ("wx", "wh", "bias", "attend", "query", "out")
    first, second, step = {k: np.zeros_like(getattr(m, k)) for k in names}, {k: np.zeros_like(getattr(m, k)) for k in names}, 0
    square = {"word": np.full(WORD_ROWS, 1e-4, np.float32), "char": np.full(CHAR_ROWS, 1e-4, np.float32)}
    epochs = max(EPOCHS, min(40, 8000 // max(1, len(ids))))
    for epoch in range(epochs):
        rng.shuffle(ids)
        rate = 0.02 * (1 - epoch / epochs) + 0.001
        for p in range(0, len(ids), BATCH):
            group = [item for i in ids[p : p + BATCH] for item in by_doc[i]]
            size = np.array([g[3] for g in group])
            doc = np.array([g[1] for g in group])
            x = np.zeros((WINDOW, len(group), INPUTS), np.float32)
            word_at, chars = np.zeros((WINDOW, len(group)), np.int64), []
            logit = np.empty(len(group), np.float32)
            for k in {g[0] for g in group}:
                own = np.array([c for c, g in enumerate(group) if g[0] == k])
                t = parts[k]
                kinds = _index(t.of_word, np.array([group[c][2] for c in own]), size[own])
                types, back = np.unique(kinds, return_inverse=True)
                count = np.diff(np.append(t.char_first, len(t.chars)))[types]
                sub = object.__new__(Types)
                sub.rows, sub.chars, sub.char_first = t.rows[types], t.chars[ragged(t.char_first[types], count)], np.cumsum(count) - count
                inputs = m.inputs(sub)
                back = back.reshape(kinds.shape)
                x[:, own] = inputs[back]
                logit[own] = logits(m, _gates(m, inputs), back, size[own])
                word_at[:, own] = sub.rows[back]
                chars.append((own, back, sub, count))
            order = np.lexsort((-logit, doc))
            lead = order[np.unique(doc[order], return_index=True)[1]]
            grad, dx, _ = _gradients(m, x[:, lead], size[lead], label[doc[lead]].astype(np.float32))
            step += 1
            for k in names:
                g = grad[k] + 1e-4 * getattr(m, k) / len(lead)
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                setattr(m, k, getattr(m, k) - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8))
            spread = np.zeros((WINDOW, len(group), LEARNED), np.float32)
            spread[:, lead] = dx[:, :, 3:]
            _adagrad(m.word, square["word"], word_at[:, lead].ravel(), spread[:, lead].reshape(-1, LEARNED), rate)
            for own, back, sub, count in chars:
                per_type = np.zeros((len(sub.rows), LEARNED), np.float32)
                np.add.at(per_type, back.ravel(), spread[:, own].reshape(-1, LEARNED))
                _adagrad(m.char, square["char"], sub.chars, np.repeat(per_type / count[:, None], count, 0), rate)
    # Calibration by logistic regression on the texts left out, with their true share of toxic ones.
    raw = np.concatenate([_raw(m, data, offsets) for _, _, data, offsets in slices(column)])
    use = ~train & np.isfinite(raw)
    y, z = label[use].astype(float), raw[use]
    if 0 < y.sum() < len(y):
        weight = np.where(y == 1, prior / y.mean(), (1 - prior) / (1 - y.mean()))
        w, b = 1.0, 0.0
        for _ in range(200):
            q = 1 / (1 + np.exp(-np.clip(w * z + b, -30, 30)))
            gw, gb = (weight * (q - y) * z).mean() + 1e-3 * (w - 1), (weight * (q - y)).mean()
            hw, hb = (weight * q * (1 - q) * z * z).mean() + 1e-3, (weight * q * (1 - q)).mean() + 1e-3
            w, b = w - 0.5 * np.clip(gw / hw, -1, 1), b - 0.5 * np.clip(gb / hb, -1, 1)
        m.scale, m.shift = float(max(w, 0.05)), float(b)
    return m


def _raw(m: Model, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    s = score_slice(m, data, offsets)
    with np.errstate(divide="ignore"):
        return np.where(s > 0, np.log(s / (1 - s)), -np.inf)


def _adagrad(table: np.ndarray, square: np.ndarray, rows: np.ndarray, grad: np.ndarray, rate: float) -> None:
    own, back = np.unique(rows, return_inverse=True)
    total = np.zeros((len(own), grad.shape[1]), np.float32)
    np.add.at(total, back, grad)
    square[own] += (total * total).mean(1)
    table[own] -= rate * total / np.sqrt(square[own])[:, None]


def training_sample(docs: DataFrame, labels: DataFrame, usable: Column, per_class: int = PER_CLASS) -> tuple[list[str | None], list[int], float]:
    """Texts and labels of at most 2 * per_class rows, and the share of toxic ones among all of docs' own labelled rows.

    usable: a condition on doc_id. Labels are first held to ids of documents that are there and not too long, so the bound
    is reached wherever docs have so many; a label table of any size for other documents changes nothing."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & usable).groupBy("doc_id").agg(F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic"))
    docs = docs.select("doc_id", "text").where(F.coalesce(F.length("text"), F.lit(0)) <= MAX_CHARS)
    own = written(known.join(docs.select("doc_id").distinct(), "doc_id"), "labelled")
    order = F.struct(F.xxhash64("doc_id").alias("h"), "doc_id")
    counts = dict(own.groupBy("toxic").count().collect())
    some = [own.where(F.col("toxic") == k).orderBy(order).limit(per_class) for k in (0, 1)]
    # Bounded: 2 * per_class ids.
    ids = some[0].unionByName(some[1]).select(F.col("doc_id").alias("labelled"), "toxic")
    rows = docs.join(F.broadcast(ids), F.col("doc_id") == F.col("labelled")).select("doc_id", "text", "toxic").orderBy(order, "text").limit(2 * per_class).collect()
    dropped(docs.sparkSession, own)
    return [r["text"] for r in rows], [r["toxic"] for r in rows], counts.get(1, 0) / max(1, sum(counts.values()))


def fit_on(docs: DataFrame, labels: DataFrame, usable: Column, per_class: int = PER_CLASS) -> Model:
    """fit() on training_sample(). The driver lives on through later stages, so what the fit took goes back to the system."""
    model = fit(*training_sample(docs, labels, usable, per_class))
    release()
    return model


def score(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "score", keep: list[str] | None = None) -> DataFrame:
    """docs with score_col, between 0 and 1, of each whole text."""
    shared = ready(docs.sparkSession).sparkContext.broadcast(model)

    def make():
        m = shared.value

        def f(batch):
            for i, j, data, offsets in slices(batch.column(batch.schema.get_field_index(text_col))):
                yield i, j, [pa.array(score_slice(m, data, offsets).astype(np.float64))]

        return f

    return map_columns(docs, make, {score_col: "double"}, keep)
