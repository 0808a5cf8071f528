"""Vectorised text primitives on UTF-8 buffers, shared by the operators of this subpackage.

All functions work on one *slice*: the concatenated UTF-8 bytes of some whole documents plus the
documents' byte offsets. Slices are cut on document borders at about ``SLICE_BYTES``, so temporaries
stay a small multiple of that (or of the longest single document). Words and pre-tokens are identified
by a 64-bit polynomial hash with a strong finaliser; with 10 million distinct strings the chance of any
collision is about 3e-6.
"""

from __future__ import annotations

import unicodedata
from functools import cache

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
_R = np.uint64(0x9E3779B97F4A7C15 | 1)
_R_INV = np.uint64(pow(int(_R), -1, 1 << 64))
_POW = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Members of [^\x00-\x2F\x3A-\x60\x7B-\x7F] after lower-casing A-Z: digits, a-z and every non-ASCII byte.
WORD = np.zeros(256, bool)
WORD[48:58] = WORD[97:123] = WORD[128:] = True
#: Members of [^\x20\x09-\x0D].
INK = np.ones(256, bool)
INK[32] = INK[9:14] = False


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POW[0]) < n:
        for k, base in enumerate((_R, _R_INV)):
            x = np.full(max(n, SLICE_BYTES + (SLICE_BYTES >> 1)), base, np.uint64)
            x[0] = 1
            _POW[k] = np.multiply.accumulate(x)
    return _POW[0], _POW[1]


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (a bijection), in place."""
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def slices(column: pa.Array | pa.ChunkedArray, limit: int = SLICE_BYTES):
    """Yields (first row, last row + 1, bytes, offsets) of whole rows; null texts count as empty."""
    chunks = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    base = 0
    for chunk in chunks:
        chunk = chunk.cast(pa.large_string())
        if chunk.null_count:
            chunk = chunk.fill_null("")
        n = len(chunk)
        _, off_buffer, data_buffer = chunk.buffers()
        off = np.frombuffer(off_buffer, np.int64)[chunk.offset : chunk.offset + n + 1] if n else np.zeros(1, np.int64)
        data = np.frombuffer(data_buffer, np.uint8) if data_buffer is not None else np.zeros(0, np.uint8)
        i = 0
        while i < n:
            j = int(np.searchsorted(off, off[i] + limit, "right")) - 1
            j = min(max(j, i + 1), n)
            yield base + i, base + j, data[off[i] : off[j]], off[i : j + 1] - off[i]
            i = j
        base += n


def spans(member: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of members that don't cross a document's border."""
    n = len(member)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = offsets[(offsets > 0) & (offsets < n)]
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = member[:-1]
    before[edge] = False
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = member[1:]
    after[edge - 1] = False
    return np.flatnonzero(member & ~before), np.flatnonzero(member & ~after) + 1


def span_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of data[start:end] for each span; equal bytes give equal hashes in any slice."""
    power, inverse = _powers(len(data) + 1)
    total = np.empty(len(data) + 1, np.uint64)
    total[0] = 0
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], out=total[1:])
    h = (total[end] - total[start]) * inverse[start]
    h ^= (end - start).astype(np.uint64) << np.uint64(40)
    return mix(h)


def hash_bytes(text: bytes) -> int:
    data = np.frombuffer(text, np.uint8)
    return int(span_hash(data, np.array([0]), np.array([len(data)]))[0])


def words(data: np.ndarray, offsets: np.ndarray, member: np.ndarray = WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end byte of each word of the A-Z-lower-cased slice, and the documents' first words.

    The last array has one more entry than there are documents."""
    low = LOWER[data]
    start, end = spans(member[low], offsets)
    return span_hash(low, start, end), start, end, np.searchsorted(start, offsets)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start + 1, ... of each row, one row after another."""
    if not len(starts):
        return np.zeros(0, np.int64)
    first = np.cumsum(lengths) - lengths
    return np.arange(int(lengths.sum()), dtype=np.int64) + np.repeat(starts - first, lengths)


class HashTable:
    """Open-addressing table from non-zero uint64 keys to int32 values, with vectorised get and put."""

    def __init__(self, capacity: int = 1 << 12):
        self.bits = max(4, int(capacity * 2 - 1).bit_length())
        self.keys = np.zeros(1 << self.bits, np.uint64)
        self.values = np.zeros(1 << self.bits, np.int32)
        self.size = 0

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """Values of keys; -1 where absent."""
        slot, mask = self._slot(keys), len(self.keys) - 1
        seen = self.keys[slot]
        out = np.where(seen == keys, self.values[slot], np.int32(-1))
        rest = np.flatnonzero((seen != keys) & (seen != 0))
        slot = slot[rest]
        while len(rest):
            slot = (slot + 1) & mask
            seen = self.keys[slot]
            hit = seen == keys[rest]
            out[rest[hit]] = self.values[slot[hit]]
            go = ~hit & (seen != 0)
            rest, slot = rest[go], slot[go]
        return out

    def put(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Adds distinct keys that aren't in the table."""
        if (self.size + len(keys)) * 2 > len(self.keys):
            full = self.keys != 0
            old_keys, old_values = self.keys[full], self.values[full]
            self.__init__(max((self.size + len(keys)) * 2, 16))
            self.put(old_keys, old_values)
        mask = len(self.keys) - 1
        slot, todo = self._slot(keys), np.arange(len(keys))
        while len(todo):
            free = self.keys[slot] == 0
            self.keys[slot[free]] = keys[todo[free]]
            mine = free & (self.keys[slot] == keys[todo])
            self.values[slot[mine]] = values[todo[mine]]
            todo, slot = todo[~mine], (slot[~mine] + 1) & mask
        self.size += len(keys)


#: White_Space of Unicode, as the pre-tokenizer's \s has it.
_SPACE = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_LETTER, _NUMBER, _WHITE, _OTHER = 0, 1, 2, 3


@cache
def _kinds() -> np.ndarray:
    initial = {"L": _LETTER, "N": _NUMBER}
    out = np.fromiter((initial.get(unicodedata.category(chr(i))[0], _OTHER) for i in range(0x110000)), np.uint8, 0x110000)
    out[_SPACE] = _WHITE
    return out


def pre_tokens(data: np.ndarray, offsets: np.ndarray, special: bytes = b"") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of the pre-tokens of a byte-level BPE, and the documents' first pre-tokens.

    They are what the pattern 's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+
    finds. An occurrence of special is one pre-token, and text beside it is split as if it stood alone."""
    if not len(data):
        zero = np.zeros(0, np.int64)
        return zero, zero, np.zeros(len(offsets), np.int64)
    raw = data.tobytes()
    char_at = np.flatnonzero((data & 0xC0) != 0x80)
    point = np.frombuffer(raw.decode("utf-8").encode("utf-32-le"), np.uint32)
    n = len(point)
    kind = _kinds()[point]
    head = np.zeros(n + 1, bool)  # text starts anew here
    head[0] = head[n] = True
    inside = offsets[(offsets > 0) & (offsets < len(data))]
    head[np.searchsorted(char_at, inside)] = True
    whole = []
    if special and (at := raw.find(special)) >= 0:
        border = set(offsets.tolist())
        while at >= 0:
            if not any(p in border for p in range(at + 1, at + len(special))):
                whole.append(at)
                at = raw.find(special, at + len(special))
            else:
                at = raw.find(special, at + 1)
        for at in whole:
            head[np.searchsorted(char_at, at)] = head[np.searchsorted(char_at, at + len(special))] = True
    first = np.empty(n, bool)  # of a run
    first[0] = True
    first[1:] = kind[1:] != kind[:-1]
    first |= head[:n]
    space = (point == 0x20) & ~head[1:]  # a blank that something follows
    white = kind == _WHITE
    start = first.copy()
    last_white = np.zeros(n, bool)  # of a run that something follows
    last_white[:-1] = white[:-1] & ~white[1:] & ~head[1:n]
    start |= last_white
    led = np.zeros(n, bool)  # by a blank
    led[1:] = space[:-1] & ~white[1:] & first[1:]
    start &= ~led
    quote = np.flatnonzero((point == 0x27) & start)
    quote = quote[quote + 1 < n]
    quote = quote[(kind[quote + 1] == _LETTER) & ~head[quote + 1]]
    if len(quote):
        one = np.isin(point[quote + 1], [ord(c) for c in "stmd"])
        after = np.minimum(quote + 2, n - 1)
        pair = point[quote + 1].astype(np.int64) << 32 | point[after]
        two = ~one & (quote + 2 < n) & (kind[after] == _LETTER) & ~head[np.minimum(quote + 2, n)] & np.isin(pair, [ord(a) << 32 | ord(b) for a, b in ("re", "ve", "ll")])
        start[quote[one | two] + 1] = False
        after = np.concatenate([quote[one] + 2, quote[two] + 3])
        start[after[after < n]] = True
    for at in whole:
        a, b = np.searchsorted(char_at, [at, at + len(special)])
        start[a] = True
        start[a + 1 : b] = False
    begin = char_at[start]
    return begin, np.append(begin[1:], len(data)), np.searchsorted(begin, offsets)


def trigrams(data: np.ndarray, start: np.ndarray, end: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of so many bits of the trigrams (in UTF-8 bytes, with a border on each side) of words, and each word's first one."""
    size = end - start
    padded = np.zeros(int(size.sum() + 2 * len(size)), np.uint64)
    inner = ragged(np.cumsum(size + 2) - size - 1, size)
    padded[inner] = data[ragged(start, size)]
    at = ragged(np.cumsum(size + 2) - size - 2, size)
    code = padded[at] << np.uint64(16) | padded[at + 1] << np.uint64(8) | padded[at + 2]
    return (mix(code + np.uint64(1)) >> np.uint64(64 - bits)).astype(np.int64), np.cumsum(size) - size
