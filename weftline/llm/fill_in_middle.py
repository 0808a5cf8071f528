"""Fill-in-the-middle transformation of whole texts: cut at units, reordered around three marks, restored exactly.

A unit is a run of A-Z and a-z, or one other code point. Counting a text's units leaves a sparse checkpoint index: unit
number, byte and code-point offset of every EVERY-th unit and of the first unit in each window of WINDOW bytes. A cut is
found by binary search among the checkpoints and a rescan of at most EVERY units, all in one window, so neither a list of
all units nor a second pass over the text is needed, however long it is.

Cases: a null text counts as empty; empty texts, and texts that hold a mark, stay plain; a null id draws like the text '';
repeated rows get equal results, one for each row; extra columns pass through, and one that has an output's name is
replaced; an empty table gives an empty table. Marks that could be confused with each other or with text beside them are
an error (Marks.check).
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, map_columns
from .textkit import slices

EVERY = 256
WINDOW = 1 << 16
OUT = ["n", "form", "prefix_chars", "middle_chars", "fim"]
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True


@dataclass(frozen=True)
class Marks:
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    def __post_init__(self):
        self.check()

    def all(self) -> tuple[str, str, str]:
        return self.prefix, self.suffix, self.middle

    def check(self) -> None:
        """Raises ValueError unless texts without marks, put between marks, can always be told from them."""
        if len(set(self.all())) < 3:
            raise ValueError("marks must differ")
        for x in self.all():
            for y in self.all():
                if not x or (x != y and x in y) or any(x[-k:] == y[:k] for k in range(1, min(len(x), len(y)))):
                    raise ValueError("marks may not be empty, hold each other, or begin as another one ends")


class CheckpointIndex:
    """The units of some documents' concatenated UTF-8 bytes; a document's end ends its last unit."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, every: int = EVERY, window: int = WINDOW):
        self.data, self.offsets, self.window = data, offsets, window
        #: units and code points before each document, and before the end
        self.units, self.chars = np.zeros(len(offsets), np.int64), np.zeros(len(offsets), np.int64)
        checks, n_units, n_chars = [], 0, 0
        for low in range(0, len(data), window):
            unit, char = self._marks(low, min(low + window, len(data)))
            at = np.flatnonzero(unit)
            before = np.cumsum(char) - char
            i, j = np.searchsorted(offsets, [low, low + len(unit)])
            self.units[i:j] = n_units + np.searchsorted(at, offsets[i:j] - low)
            self.chars[i:j] = n_chars + before[offsets[i:j] - low]
            picked = np.unique(np.append(0, np.arange(-n_units % every, len(at), every))) if len(at) else at
            checks.append(np.stack([n_units + picked, low + at[picked], n_chars + before[at[picked]]]))
            n_units, n_chars = n_units + len(at), n_chars + int(char.sum())
        ends = np.searchsorted(offsets, len(data))
        self.units[ends:], self.chars[ends:] = n_units, n_chars
        self.total = n_units, len(data), n_chars
        self.check_unit, self.check_byte, self.check_char = np.concatenate(checks, axis=1) if checks else np.zeros((3, 0), np.int64)

    def _marks(self, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
        """Where a unit and where a code point begins in data[low:high]."""
        part = self.data[low:high]
        char = (part & 0xC0) != 0x80
        letter = _LETTER[part]
        joined = np.empty(len(part), bool)
        joined[0] = low > 0 and letter[0] and _LETTER[self.data[low - 1]]
        joined[1:] = letter[1:] & letter[:-1]
        i, j = np.searchsorted(self.offsets, [low, high])
        joined[self.offsets[i:j] - low] = False
        return char & ~joined, char

    def find(self, unit: int) -> tuple[int, int]:
        """(byte, code points before it) of the unit of that number; the end for the number after the last."""
        if unit >= self.total[0]:
            return self.total[1], self.total[2]
        k = int(np.searchsorted(self.check_unit, unit, "right")) - 1
        low, left = int(self.check_byte[k]), unit - int(self.check_unit[k])
        if not left:
            return low, int(self.check_char[k])
        # A unit in a later window would have a later checkpoint.
        high = min((low // self.window + 1) * self.window, int(self.check_byte[k + 1]) if k + 1 < len(self.check_byte) else len(self.data))
        units, chars = self._marks(low, high)
        at = int(np.flatnonzero(units)[left])
        return low + at, int(self.check_char[k]) + int(np.count_nonzero(chars[:at]))


def draws(key: Column, seed: int = 1) -> list[Column]:
    """Four numbers below 2^32: the first 8-digit groups of the hex sha256 of seed, ':' and the decimal key."""
    hexed = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(hexed, 8 * k + 1, 8), 16, 10).cast("bigint") for k in range(4)]


def fill_in_middle(
    docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", keep: list[str] | None = None, marks: Marks | None = None, seed: int = 1, fim_percent: int = 90, spm_percent: int = 20
) -> DataFrame:
    """The kept columns of docs (all where keep isn't given) with n (units), form (plain, psm or spm), prefix_chars, middle_chars
    (code points, null if plain) and fim (the reordered text).

    The prefix ends after the smaller, the middle after the larger of two drawn unit counts from 0 to n."""
    marks = marks or Marks()
    kept = [c for c in (docs.columns if keep is None else keep) if c not in OUT]
    own = {}
    for name in ("_text", "_first", "_second", "_form"):
        own[name] = fresh(name, [*docs.columns, *OUT])
    text = F.coalesce(F.col(text_col), F.lit(""))
    first, second, third, fourth = draws(F.col(id_col), seed)
    holds = F.contains(text, F.lit(marks.prefix)) | F.contains(text, F.lit(marks.suffix)) | F.contains(text, F.lit(marks.middle))
    form = F.when((text == "") | holds | (third % 100 >= fim_percent), "plain").when(fourth % 100 < spm_percent, "spm").otherwise("psm")
    rows = docs.select(*kept, text.alias(own["_text"]), first.alias(own["_first"]), second.alias(own["_second"]), form.alias(own["_form"]))
    p, s, m = (x.encode() for x in marks.all())

    def make():
        def run(batch):
            column = {name: batch.column(batch.schema.get_field_index(own[name])) for name in own}
            drawn = [column[name].to_numpy() for name in ("_first", "_second")]
            forms = column["_form"].to_pylist()
            for i, j, data, offsets in slices(column["_text"]):
                index, raw = CheckpointIndex(data, offsets), data.tobytes()
                n = np.diff(index.units)
                a, b = np.sort(np.stack([d[i:j] % (n + 1) for d in drawn]), axis=0)
                out, prefix, middle = [], [], []
                for k in range(j - i):
                    low, high = int(offsets[k]), int(offsets[k + 1])
                    if forms[i + k] == "plain":
                        out.append(raw[low:high]), prefix.append(None), middle.append(None)
                        continue
                    base = int(index.units[k])
                    (cut, c), (end, e) = index.find(base + int(a[k])), index.find(base + int(b[k]))
                    head, mid, tail = raw[low:cut], raw[cut:end], raw[end:high]
                    out.append(b"".join((p, head, s, tail, m, mid) if forms[i + k] == "psm" else (s, tail, p, head, m, mid)))
                    prefix.append(c - int(index.chars[k])), middle.append(e - c)
                yield i, j, [pa.array(n), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(out, pa.binary()).cast(pa.string())]

        return run

    added = {"n": "bigint", "prefix_chars": "bigint", "middle_chars": "bigint", "fim": "string"}
    return map_columns(rows, make, added, [*kept, own["_form"]]).withColumnRenamed(own["_form"], "form").select(*kept, *OUT)


def restored(fim: Column | str, form: Column | str, marks: Marks | None = None) -> Column:
    """The text that fill_in_middle took, from its output and form alone, in built-in functions."""
    fim, form = (F.col(c) if isinstance(c, str) else c for c in (fim, form))
    part = F.split(fim, "|".join(re.escape(x) for x in (marks or Marks()).all()), -1)
    psm, spm = F.concat(F.get(part, F.lit(1)), F.get(part, F.lit(3)), F.get(part, F.lit(2))), F.concat(F.get(part, F.lit(2)), F.get(part, F.lit(3)), F.get(part, F.lit(1)))
    return F.when(form == "plain", fim).when(form == "psm", psm).otherwise(spm)
