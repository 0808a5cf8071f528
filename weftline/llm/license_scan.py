"""License scans by an exact set-similarity join of text blocks with license templates.

A block is a window of consecutive words, wherever lines end; a template of n words has windows of
ceil(n / t) words, which overlap by all but one word. A window's set of words is joined with the template's
set. A pair meets the threshold t if the window contains at least t of the template's distinct words. Words
are ordered by their frequency over all documents (a first pass counts the templates' words, a fixed number
of sums), rarest first. A template T needs an overlap of o = ceil(t |T|), so a window must contain one of its
first |T| - o + 1 words (prefix filter). Within reach of that word's windows, o words of the templates'
vocabulary must stand (length filter), and o distinct ones of T that are this word or follow it in the order
(positional filter). What is left is verified by counting in each window. Templates are a parameter,
of at most MAX_WORDS words together (more are an error), and are broadcast; nothing is shuffled but the counts. Of a template's overlapping windows that meet the threshold, the
best is reported, the first of equals.

Beside the join, fixed phrases are found as consecutive words anywhere in the text, across lines too.

Words are [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ after lower-casing A-Z.

Cases: null text has no words; repeated rows and other columns pass through, one with an output's name is
replaced; ties between templates are all reported; an empty table gives an empty table.
"""

from __future__ import annotations

from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_columns, ready
from .textkit import HashTable, ragged, slices, words

THRESHOLD = 0.9
PAIRS = 1 << 14  # windows or pairs that are expanded at a time
MAX_WORDS = 1 << 16

# Phrases and their labels.
PHRASES = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)

# Notices of common licenses and their labels.
TEMPLATES = (
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("licensed under the apache license version 2 0", "apache-2"),
    ("you may not use this file except in compliance with the license you may obtain a copy of the license at", "apache-2"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("licensed under cc by sa 4 0", "cc-by-sa"),
    ("this work is licensed under a creative commons attribution 4 0 international license", "cc-by"),
    ("this work is licensed under the gnu general public license version 3", "gpl-3"),
    ("you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "gpl"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl-2"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
)


def _hashes(text: str) -> np.ndarray:
    (_, _, data, offsets), *_ = slices(pa.array([text]))
    return words(data, offsets)[0]


def count_words(docs: DataFrame, vocabulary: np.ndarray, text_col: str) -> np.ndarray:
    """How often each word of a fixed vocabulary stands in all documents."""
    shared = ready(docs.sparkSession).sparkContext.broadcast(vocabulary)

    def run(batches):
        table, total = HashTable(max(16, len(shared.value))), np.zeros(len(shared.value), np.int64)
        table.put(shared.value, np.arange(len(shared.value), dtype=np.int32))
        for batch in batches:
            for _, _, data, offsets in slices(batch.column(0)):
                at = table.get(words(data, offsets)[0])
                total += np.bincount(at[at >= 0], minlength=len(total))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], names=["word", "n"])

    out = np.zeros(len(vocabulary), np.int64)
    for word, n in docs.select(text_col).mapInArrow(run, "word bigint, n bigint").groupBy("word").agg(F.sum("n")).collect():  # a row for each word of the vocabulary
        out[word] = n
    return out


class Templates:
    """Template sets over words numbered from the rarest, with their prefixes as an inverted index."""

    def __init__(self, sets: list[np.ndarray], length: list[int], vocabulary: np.ndarray, frequency: np.ndarray, threshold: float):
        self.vocabulary = vocabulary[np.lexsort((vocabulary, frequency))]
        number = {int(h): k for k, h in enumerate(self.vocabulary)}
        self.member = np.zeros((len(sets), len(vocabulary)), bool)
        self.size = np.array([len(s) for s in sets], np.int64)
        self.need = np.array([max(1, ceil(threshold * len(s) - 1e-9)) for s in sets], np.int64)
        self.width = np.array([ceil(n / threshold - 1e-9) for n in length], np.int64)
        posting: list[list[int]] = [[] for _ in vocabulary]
        for k, s in enumerate(sets):
            ids = sorted(number[int(h)] for h in s)
            self.member[k, ids] = True
            for word in ids[: len(ids) - self.need[k] + 1]:
                posting[word].append(k)
        self.posting_at = np.cumsum([0, *(len(x) for x in posting)], dtype=np.int64)
        self.posting = np.array([x for some in posting for x in some], np.int64)

    def table(self) -> HashTable:
        out = HashTable(max(16, len(self.vocabulary)))
        out.put(self.vocabulary, np.arange(len(self.vocabulary), dtype=np.int32))
        return out

    def join(self, place: np.ndarray, owner: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """First and last word, template and overlap of the best windows that meet the threshold, from places, documents
        and numbers of the vocabulary's words; first and last are rows of these. Sorted by first word."""
        counts = np.diff(self.posting_at)[word]
        at = np.repeat(np.arange(len(word)), counts)
        template = self.posting[ragged(self.posting_at[word], counts)]
        order = np.lexsort((at, template))
        found = [self._windows(place, owner, word, at[order[p : p + PAIRS]], template[order[p : p + PAIRS]]) for p in range(0, len(at), PAIRS)]
        rows = np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 4), np.int64)
        best, chosen, k = [], rows.tolist(), 0
        while k < len(chosen):
            kind, first, last, most = chosen[k]
            k += 1
            # Windows that begin before the best one so far ends are windows of the same notice.
            while k < len(chosen) and chosen[k][0] == kind and chosen[k][1] <= last:
                if chosen[k][3] > most:
                    first, last, most = chosen[k][1:]
                k += 1
            best.append((first, last, kind, most))
        return tuple(np.array(sorted(best), np.int64).reshape(-1, 4).T)

    def _windows(self, place, owner, word, anchor, template) -> np.ndarray:
        """(template, first row, last row, overlap) of the windows around anchors that meet the threshold."""
        key = owner * (int(place[-1]) + 2 * int(self.width.max())) + place  # a document's windows end with it
        width = self.width[template]
        low, high = np.searchsorted(key, key[anchor] - width, "right"), np.searchsorted(key, key[anchor] + width)
        enough = high - low >= self.need[template]
        anchor, template, low, high = anchor[enough], template[enough], low[enough], high[enough]
        pair, row = np.repeat(np.arange(len(anchor)), high - low), ragged(low, high - low)
        own = self.member[template[pair], word[row]] & (word[row] >= word[anchor[pair]])
        pair, row = pair[own], row[own]
        distinct = np.unique(pair * len(self.vocabulary) + word[row]) // len(self.vocabulary)
        enough = np.bincount(distinct, minlength=len(anchor)) >= self.need[template]
        pair, row = pair[enough[pair]], row[enough[pair]]
        # Each window begins with a word of its template; the same one may have several anchors.
        start = np.unique(template[pair] * len(word) + row)
        out = [np.zeros((0, 4), np.int64)]
        for p in range(0, len(start), PAIRS):
            kind, begin = start[p : p + PAIRS] // len(word), start[p : p + PAIRS] % len(word)
            size = np.searchsorted(key, key[begin] + self.width[kind]) - begin
            window, row = np.repeat(np.arange(len(begin)), size), ragged(begin, size)
            own = self.member[kind[window], word[row]]
            window, row = window[own], row[own]
            _, new = np.unique(window * len(self.vocabulary) + word[row], return_index=True)  # a word's first place in a window
            overlap = np.bincount(window[new], minlength=len(begin))
            last = np.zeros(len(begin), np.int64)
            np.maximum.at(last, window[new], row[new])
            good = overlap >= self.need[kind]
            out.append(np.stack([kind, begin, last, overlap], 1)[good])
        return np.concatenate(out)


ADDED = {
    "n_words": "bigint",
    "phrases": "array<struct<label:string,word:bigint>>",
    "matches": "array<struct<label:string,first_byte:bigint,end_byte:bigint,containment:double>>",
}


def _lists(doc: np.ndarray, n: int, fields: dict[str, pa.Array]) -> pa.Array:
    bound = np.searchsorted(doc, np.arange(n + 1))
    return pa.ListArray.from_arrays(pa.array(bound, pa.int32()), pa.StructArray.from_arrays(list(fields.values()), names=list(fields)))


def scan_licenses(docs: DataFrame, templates=TEMPLATES, phrases=PHRASES, threshold: float = THRESHOLD, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs with n_words, phrases (label and first word of every place) and matches (label, extent in bytes,
    containment of the best windows that meet a template's threshold)."""
    hashed = [_hashes(text) for text, _ in templates]
    if sum(map(len, hashed)) > MAX_WORDS:
        raise ValueError(f"templates have at most {MAX_WORDS} words together")
    sets = [np.unique(h) for h in hashed]
    vocabulary = np.unique(np.concatenate(sets)) if sets else np.zeros(0, np.uint64)
    joined = Templates(sets, [len(h) for h in hashed], vocabulary, count_words(docs, vocabulary, text_col), threshold)
    wanted = [(_hashes(text), label) for text, label in phrases]
    shared = ready(docs.sparkSession).sparkContext.broadcast((joined, [label for _, label in templates], wanted))

    def make():
        joined, labels, wanted = shared.value
        table = joined.table()
        names = np.array([*labels, *(label for _, label in wanted)], object)

        def f(batch):
            for i, j, data, offsets in slices(batch.column(batch.schema.get_field_index(text_col))):
                h, start, end, first = words(data, offsets)
                n = j - i
                places, kinds = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
                for k, (phrase, _) in enumerate(wanted):
                    at = np.flatnonzero(h[: max(0, len(h) - len(phrase) + 1)] == phrase[0])
                    for p in range(1, len(phrase)):
                        at = at[h[at + p] == phrase[p]]
                    at = at[at + len(phrase) <= first[np.searchsorted(first, at, "right")]] if len(at) else at
                    places.append(at)
                    kinds.append(np.full(len(at), len(labels) + k))
                at, kind = np.concatenate(places).astype(np.int64), np.concatenate(kinds).astype(np.int64)
                order = np.argsort(at, kind="stable")
                at, kind = at[order], kind[order]
                doc = np.searchsorted(first, at, "right") - 1
                found = _lists(doc, n, {"label": pa.array(names[kind], pa.string()), "word": pa.array(at - first[doc], pa.int64())})
                word = table.get(h)
                known = np.flatnonzero(word >= 0)
                owner = np.searchsorted(first, known, "right") - 1
                a, b, template, overlap = joined.join(known, owner, word[known].astype(np.int64))
                doc = owner[a]
                matched = _lists(
                    doc,
                    n,
                    {
                        "label": pa.array(names[template], pa.string()),
                        "first_byte": pa.array(start[known[a]] - offsets[doc], pa.int64()),
                        "end_byte": pa.array(end[known[b]] - offsets[doc], pa.int64()),
                        "containment": pa.array(overlap / joined.size[template], pa.float64()),
                    },
                )
                yield i, j, [pa.array(np.diff(first), pa.int64()), found, matched]

        return f

    return map_columns(docs, make, ADDED, keep)
