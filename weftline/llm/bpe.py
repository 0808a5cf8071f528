"""BPE encoding and decoding by backtracking over longest token matches.

An Aho-Corasick automaton over the vocabulary gives the longest token that starts at each byte of a
pre-token. The encoder takes longest tokens left to right; a token may follow another only if the pair
is *compatible*: re-encoding the two tokens' bytes by merges would give back exactly these two. If not,
it tries the next shorter token with the same start, and if none is left it goes back by one token and
never tries that position again, so the work is linear in the text. The result is what applying merges
in order gives. Decoding copies bytes by a table of token offsets.

Each worker keeps the encodings of pre-tokens that it has seen (at most CACHE_ENTRIES, then it starts
anew), so a pre-token is encoded once and looked up in numpy afterwards. There is no shuffle.

Cases: null text counts as empty and encodes to no ids; null ids decode to an empty text; an id outside
the vocabulary raises; repeated rows and any other columns pass through; a column with the output's name
is replaced; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_columns, ready
from .textkit import HashTable, pre_tokens, ragged, slices, span_hash

CACHE_ENTRIES = 1 << 19


def _byte_alphabet() -> dict[str, int]:
    """The printable character that byte-level vocabularies write for each byte, by rule: printable Latin-1
    characters stand for themselves, the other bytes take 256, 257, ... in order."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = {chr(b): b for b in own}
    rest = [b for b in range(256) if b not in set(own)]
    return out | {chr(256 + k): b for k, b in enumerate(rest)}


class Bpe:
    """Tables of one byte-level vocabulary, made from the text of its tokenizer file."""

    def __init__(self, spec: bytes):
        import ahocorasick

        model = json.loads(spec)
        special = [(t["id"], t["content"].encode()) for t in model.get("added_tokens", [])]
        if len(special) > 1 or model.get("normalizer") or model["pre_tokenizer"].get("type") != "ByteLevel":
            raise ValueError("a byte-level vocabulary without normalizer and with at most one special token is needed")
        self.special_id, self.special = special[0] if special else (-1, b"")
        alphabet = _byte_alphabet()
        vocab = {bytes(alphabet[c] for c in text): i for text, i in model["model"]["vocab"].items() if i != self.special_id}
        size = max([*vocab.values(), self.special_id]) + 1
        self.token = [b""] * size
        for text, i in vocab.items():
            self.token[i] = text
        self.length = [len(t) for t in self.token]
        self.pair: dict[tuple[int, int], int] = {}
        self.left, self.right = list(range(size)), list(range(size))
        rank = 0
        for merge in model["model"]["merges"]:
            a, b = (vocab[bytes(alphabet[c] for c in part)] for part in (merge.split(" ") if isinstance(merge, str) else merge))
            i = vocab[self.token[a] + self.token[b]]
            if i <= rank:
                raise ValueError("ids must follow the order of merges")
            rank = i
            self.pair[a, b] = i
            self.left[i], self.right[i] = a, b
        self.shorter = [-1] * size
        self.automaton = ahocorasick.Automaton()
        for text, i in vocab.items():
            self.automaton.add_word(text.decode("latin-1"), (len(text), i))
            for n in range(len(text) - 1, 0, -1):
                if (k := vocab.get(text[:n])) is not None:
                    self.shorter[i] = k
                    break
        self.automaton.make_automaton()
        if self.special:
            self.token[self.special_id] = self.special
        self.known_pairs: dict[tuple[int, int], bool] = {}
        self.offsets = np.concatenate([[0], np.cumsum([len(t) for t in self.token])])
        self.blob = np.frombuffer(b"".join(self.token), np.uint8)
        digits = [b"%d," % i for i in range(size)]
        self.digit_offsets = np.concatenate([[0], np.cumsum([len(t) for t in digits])])
        self.digits = np.frombuffer(b"".join(digits), np.uint8)

    def compatible(self, a: int, b: int) -> bool:
        """Whether merging the bytes of a and b in order leaves just a and b: no merge across their border
        comes before the merges that made the parts beside it."""
        if (found := self.known_pairs.get((a, b))) is not None:
            return found
        key, limit, out = (a, b), 1 << 62, True
        while True:
            if self.pair.get((a, b), limit) < limit:
                out = False
                break
            # Undo the later of the two merges beside the border; earlier parts met only before that merge.
            undo_left = a > b
            for _ in range(2):
                if undo_left:
                    limit, a = a, self.right[a]
                    stuck = a == limit
                else:
                    limit, b = b + 1, self.left[b]
                    stuck = b + 1 == limit
                if not stuck:
                    break
                undo_left = not undo_left
            if stuck:
                break
        if len(self.known_pairs) > 1 << 16:
            self.known_pairs.clear()
        self.known_pairs[key] = out
        return out

    def encode_piece(self, piece: bytes) -> list[int]:
        """Ids of one pre-token."""
        if piece == self.special and piece:
            return [self.special_id]
        n = len(piece)
        longest = [-1] * (n + 1)
        for end, (size, i) in self.automaton.iter(piece.decode("latin-1")):
            longest[end - size + 1] = i
        if self.length[longest[0]] == n:
            return [longest[0]]
        length, shorter, compatible = self.length, self.shorter, self.compatible
        usable, out, at, token = bytearray(b"\x01" * (n + 1)), [], 0, longest[0]
        while at < n:
            before = out[-1] if out else -1
            while token >= 0 and not (usable[at + length[token]] and (before < 0 or compatible(before, token))):
                token = shorter[token]
            if token >= 0:
                out.append(token)
                at += length[token]
                token = longest[at]
            else:
                usable[at] = 0
                token = out.pop()
                at -= length[token]
        return out


@lru_cache(maxsize=4)
def _tables(spec: bytes) -> Bpe:
    return Bpe(spec)


class Encoder:
    """A worker's encodings of pre-tokens: a hash table into a pool of ids."""

    def __init__(self, bpe: Bpe):
        self.bpe = bpe
        self.clear()

    def clear(self) -> None:
        self.table, self.n, self.used = HashTable(1 << 14), 0, 0
        self.start, self.count, self.pool = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int32), np.zeros(1 << 15, np.int32)

    def _add(self, keys: np.ndarray, found: list[list[int]]) -> None:
        counts = np.fromiter(map(len, found), np.int32, len(found))
        flat = np.fromiter((i for ids in found for i in ids), np.int32, int(counts.sum()))
        while self.n + len(keys) > len(self.start):
            self.start, self.count = np.append(self.start, np.zeros_like(self.start)), np.append(self.count, np.zeros_like(self.count))
        while self.used + len(flat) > len(self.pool):
            self.pool = np.append(self.pool, np.zeros_like(self.pool))
        rows = slice(self.n, self.n + len(keys))
        self.count[rows] = counts
        self.start[rows] = self.used + np.cumsum(counts) - counts
        self.pool[self.used : self.used + len(flat)] = flat
        self.table.put(keys, np.arange(self.n, self.n + len(keys), dtype=np.int32))
        self.n, self.used = self.n + len(keys), self.used + len(flat)

    def entries(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, h: np.ndarray) -> np.ndarray:
        """Rows of start and count for each pre-token."""
        if self.n > CACHE_ENTRIES:
            self.clear()
        at = self.table.get(h)
        miss = np.flatnonzero(at < 0)
        if len(miss):
            keys, first = np.unique(h[miss], return_index=True)
            where = miss[first]
            raw = data.tobytes()
            encode = self.bpe.encode_piece
            self._add(keys, [encode(raw[a:b]) for a, b in zip(start[where].tolist(), end[where].tolist(), strict=True)])
            at[miss] = self.table.get(h[miss])
        return at

    def slice_ids(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a slice's texts, and where each text's ids begin (one more entry than texts)."""
        start, end, first = pre_tokens(data, offsets, self.bpe.special)
        at = self.entries(data, start, end, span_hash(data, start, end))
        counts = self.count[at].astype(np.int64)
        return self.pool[ragged(self.start[at], counts)], np.concatenate([[0], np.cumsum(counts)])[first]


@lru_cache(maxsize=4)
def encoder(spec: bytes) -> Encoder:
    """One for each worker process and vocabulary."""
    return Encoder(_tables(spec))


def decode_ids(bpe: Bpe, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the ids' tokens, and each token's end in them."""
    size = bpe.offsets[ids + 1] - bpe.offsets[ids]
    return bpe.blob[ragged(bpe.offsets[ids], size)], np.cumsum(size)


def load_spec(path: str) -> bytes:
    """A tokenizer file's bytes, read by the driver and sent to tasks; a vocabulary's size bounds it."""
    with open(path, "rb") as f:
        return f.read()


def encode(df: DataFrame, tokenizer_path: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """df with ids_col, array<int>: the ids of the whole of text_col."""
    spec = ready(df.sparkSession).sparkContext.broadcast(load_spec(tokenizer_path))

    def make():
        enc = encoder(spec.value)

        def f(batch):
            for i, j, data, offsets in slices(batch.column(batch.schema.get_field_index(text_col))):
                ids, bound = enc.slice_ids(data, offsets)
                yield i, j, [pa.ListArray.from_arrays(pa.array(bound, pa.int32()), pa.array(ids, pa.int32()))]

        return f

    return map_columns(df, make, {ids_col: "array<int>"})


def decode(df: DataFrame, tokenizer_path: str, ids_col: str = "ids", text_col: str = "text") -> DataFrame:
    """df with text_col: the text of ids_col; bytes that aren't UTF-8 become U+FFFD."""
    spec = ready(df.sparkSession).sparkContext.broadcast(load_spec(tokenizer_path))

    def make():
        bpe = _tables(spec.value)

        def f(batch):
            column = batch.column(batch.schema.get_field_index(ids_col))
            for i in range(0, len(column), 256):
                part = column.slice(i, 256)
                counts = np.asarray(part.value_lengths().fill_null(0), np.int64)
                ids = np.asarray(part.flatten(), np.int64)
                if len(ids) and (ids.min() < 0 or ids.max() >= len(bpe.token)):
                    raise ValueError("an id is outside the vocabulary")
                data, ends = decode_ids(bpe, ids)
                bound = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])]
                raw = data.tobytes()
                yield i, i + len(part), [pa.array([raw[a:b].decode("utf-8", "replace") for a, b in zip(bound[:-1].tolist(), bound[1:].tolist(), strict=True)], pa.string())]

        return f

    return map_columns(df, make, {text_col: "string"})


def round_trip(df: DataFrame, tokenizer_path: str, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """df's columns (or those in keep) with n_tokens, ids_sha256 and decoded_sha256, encoding and then decoding
    each whole text in one pass; ids_sha256 is of the decimal ids joined by commas. Ids and texts don't leave the task."""
    spec = ready(df.sparkSession).sparkContext.broadcast(load_spec(tokenizer_path))

    def make():
        enc = encoder(spec.value)
        bpe = enc.bpe

        def f(batch):
            for i, j, data, offsets in slices(batch.column(batch.schema.get_field_index(text_col))):
                ids, bound = enc.slice_ids(data, offsets)
                size = bpe.digit_offsets[ids + 1] - bpe.digit_offsets[ids]
                digits = bpe.digits[ragged(bpe.digit_offsets[ids], size)].tobytes()
                at = np.concatenate([[0], np.cumsum(size)])[bound].tolist()
                text, ends = decode_ids(bpe, ids)
                raw, to = text.tobytes(), np.concatenate([[0], ends])[bound].tolist()
                listed = [hashlib.sha256(digits[a : max(a, b - 1)]).hexdigest() for a, b in zip(at, at[1:], strict=False)]
                back = [hashlib.sha256(raw[a:b].decode("utf-8", "replace").encode()).hexdigest() for a, b in zip(to, to[1:], strict=False)]
                yield i, j, [pa.array(np.diff(bound), pa.int64()), pa.array(listed), pa.array(back)]

        return f

    return map_columns(df, make, {"n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"}, keep)
