"""Chat formatting from a declarative template, in DataFrame functions only.

A conversation's turns, in order, pass a finite-state machine over roles, and every turn becomes three
text segments with a loss flag each: a header, the escaped text and an end mark. Control strings inside
roles and texts are escaped reversibly, so the formatted text can be read back exactly.

Each conversation is gathered into one row, as its formatted text is one value; that text's size, not the
number of conversations, bounds a row.

Cases: null role and null text count as empty; turns are ordered by (turn, role, text), so ties and
repeated rows keep a definite order; null conversation ids form one conversation; roles outside the
machine make a conversation invalid but are formatted all the same; extra columns are ignored; an empty
table gives an empty table. A template whose marks could not be told from texts is an error (Template.check).
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """open + role + middle + text + close for each turn.

    escapes: what stands for a control string inside texts, the escape character's own first; role_escapes: more of
    them inside roles. Where they aren't given, they follow from the marks: open and close (without blanks around
    them) inside texts, and middle too inside roles."""

    open: str = "### "
    middle: str = ": "
    close: str = "</turn>\n"
    escapes: tuple[tuple[str, str], ...] = ()
    role_escapes: tuple[tuple[str, str], ...] = ()
    loss_roles: tuple[str, ...] = ("assistant",)
    #: state (the role before, or "start") to the roles that may follow
    turns: dict[str, tuple[str, ...]] = field(default_factory=lambda: {"start": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)})
    final: tuple[str, ...] = ("assistant",)
    escape_char: str = "\\"

    def __post_init__(self):
        marks = [m.strip() or m for m in (self.open, self.close, self.middle)]
        letters = [c for c in "hecbdfgijklmnop" if not any(m.startswith(c) for m in marks)]
        codes = [(m, self.escape_char + c) for m, c in zip(marks, letters, strict=False)]
        if not self.escapes:
            object.__setattr__(self, "escapes", ((self.escape_char, self.escape_char + letters[3]), *codes[:2]))
        if not self.role_escapes:
            object.__setattr__(self, "role_escapes", (codes[2],))
        self.check()

    def check(self) -> None:
        """Raises ValueError unless every formatted conversation can be read back."""
        pairs = self.escapes + self.role_escapes
        controls, codes = [c for c, _ in pairs[1:]], [c for _, c in pairs]
        mark = self.escape_char
        if len(mark) != 1 or pairs[0][0] != mark or any(len(c) != 2 or c[0] != mark or c[1] == mark for c in codes) or len(set(codes)) < len(codes):
            raise ValueError("codes are the escape character and one other character each, the escape character's own comes first")
        if not all(controls) or any(mark in x for x in (*controls, self.open, self.middle, self.close)) or any(c.startswith(x[1]) for c in controls for x in codes):
            raise ValueError("a control string may hold no escape character and may not begin like a code")
        if not (self.open and self.middle and self.close):
            raise ValueError("marks may not be empty")
        inside_texts = [c for c, _ in self.escapes]
        if not all(any(c in x for c in inside_texts) for x in (self.open, self.close)) or not any(c in self.middle for c in (*inside_texts, *controls)):
            raise ValueError("an open or close mark must hold a control string of texts, the middle mark one of roles")
        if any(x[:k] == x[-k:] for x in (self.middle, self.close) for k in range(1, len(x))):
            raise ValueError("a mark that begins as it ends can't be found again beside a text")
        role, text = [c for c, _ in self.escapes + self.role_escapes], inside_texts
        if _can_form(self.close, [self.open, role, self.middle, text]) or _can_form(self.middle, [self.open, role]):
            raise ValueError("a close mark may not come about before a turn's end, nor a middle mark before its place, whatever role and text are")


def _can_form(mark: str, pieces: list) -> bool:
    """Whether a mark can stand in pieces set side by side: a string is itself, a list any escaped text, which holds none of the list's strings."""

    def rest(at: int, k: int) -> bool:  # mark[:at] stands, the next character is the k-th piece's first
        if at == len(mark):
            return True
        if k == len(pieces):
            return False
        if isinstance(pieces[k], str):
            return pieces[k].startswith(mark[at:]) or (mark.startswith(pieces[k], at) and rest(at + len(pieces[k]), k + 1))
        return any(rest(end, k + 1) for end in range(at, len(mark) + 1) if not any(c in mark[at:end] for c in pieces[k]))

    def begin(k: int) -> bool:
        if not isinstance(pieces[k], str):
            return rest(0, k)
        return any(s.startswith(mark) or (mark.startswith(s) and rest(len(s), k + 1)) for s in (pieces[k][i:] for i in range(len(pieces[k]))))

    return any(begin(k) for k in range(len(pieces)))


def escape(text: Column, pairs: tuple[tuple[str, str], ...]) -> Column:
    for control, code in pairs:
        text = F.replace(text, F.lit(control), F.lit(code))
    return text


def unescape(text: Column, pairs: tuple[tuple[str, str], ...]) -> Column:
    """Every escape character in an escaped text starts a code, so codes can be undone one kind after another, the character's own last."""
    for control, code in reversed(pairs):
        text = F.replace(text, F.lit(code), F.lit(control))
    return text


def format_chat(turns: DataFrame, template: Template | None = None) -> DataFrame:
    """(conv_id, n_turns, valid, first_error, segments array<struct<text, loss>>, formatted) from rows (conv_id, turn, role, text).

    first_error is the place, from 0, of the first turn that the machine doesn't allow; n_turns if the conversation
    ends in a state that isn't final; null if valid."""
    t = template or Template()
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    grouped = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    roles = F.col("roles")
    allowed = F.array(*(F.struct(F.lit(a), F.lit(b)) for a, some in t.turns.items() for b in some))
    wrong = F.filter(
        F.transform(roles, lambda r, i: F.when(~F.array_contains(allowed, F.struct(F.when(i == 0, F.lit("start")).otherwise(F.get(roles, i - 1)).alias("col1"), r.alias("col2"))), i)), lambda x: x.isNotNull()
    )
    error = F.coalesce(F.get(wrong, F.lit(0)), F.when(~F.element_at(roles, -1).isin(*t.final), F.size(roles)))
    pieces = F.flatten(
        F.transform(
            "turns",
            lambda x: F.array(
                F.struct(F.concat(F.lit(t.open), escape(x["role"], t.escapes + t.role_escapes), F.lit(t.middle)).alias("text"), F.lit(False).alias("loss")),
                F.struct(escape(x["text"], t.escapes).alias("text"), x["role"].isin(*t.loss_roles).alias("loss")),
                F.struct(F.lit(t.close).alias("text"), F.lit(False).alias("loss")),
            ),
        )
    )
    out = grouped.withColumn("roles", F.transform("turns", lambda x: x["role"])).select("conv_id", F.size("turns").cast("bigint").alias("n_turns"), error.cast("bigint").alias("first_error"), pieces.alias("segments"))
    return out.select("conv_id", "n_turns", F.col("first_error").isNull().alias("valid"), "first_error", "segments", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"))


def read_back(formatted: DataFrame, template: Template | None = None) -> DataFrame:
    """formatted with turns array<struct<role, text>> and loss_text (the text under the loss mask, unescaped), from format_chat's output alone."""
    t = template or Template()
    quoted = "\\Q" + t.close.replace("\\E", "\\E\\\\E\\Q") + "\\E"
    parts = F.filter(F.split("formatted", quoted), lambda x: x != "")
    turns = F.transform(
        parts,
        lambda x: F.struct(
            unescape(F.substr(F.substring_index(x, t.middle, 1), F.lit(len(t.open) + 1)), t.escapes + t.role_escapes).alias("role"),
            unescape(F.substr(x, F.length(F.substring_index(x, t.middle, 1)) + len(t.middle) + 1), t.escapes).alias("text"),
        ),
    )
    loss = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"], t.escapes)), "")
    return formatted.withColumns({"turns": turns, "loss_text": loss})
