from itertools import product

import pytest

from weftline.llm.chat_format import Template, format_chat, read_back

CHATML = {"open": "<|im_start|>", "middle": "\n", "close": "<|im_end|>\n"}
BARS = {"open": "[", "middle": "|", "close": "]*", "escape_char": "~"}


@pytest.mark.parametrize("marks", [{}, CHATML, BARS])
def test_texts_come_back(spark, marks):
    t = Template(**marks)
    nasty = ["", "\\", "~", "~h~e~c~b", "\\h\\e\\c\\b\\", t.open, t.close, t.middle, t.open.strip() * 2, t.close[:-1], t.close[1:], t.open + "user" + t.middle + "x" + t.close, ".*\\E\\Q(?i)[", "###### </turn></turn>\n", "a|b]c[", None]
    rows = [(1, k, ("user", "assistant")[k % 2], x) for k, x in enumerate(nasty)] + [(2, 0, t.middle + "r" + t.open, "x"), (2, 1, t.close, "y")]
    out = {r["conv_id"]: r for r in read_back(format_chat(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), t), t).collect()}
    assert [(x["role"], x["text"]) for x in out[1]["turns"]] == [(r, x or "") for _, _, r, x in rows[: len(nasty)]]
    assert [(x["role"], x["text"]) for x in out[2]["turns"]] == [(r, x) for _, _, r, x in rows[len(nasty) :]]
    assert out[1]["loss_text"] == "".join(x or "" for x in nasty[1::2]) and out[1]["valid"]
    for s in out[1]["segments"][1::3]:
        assert t.open.strip() not in s["text"] and t.close.strip() not in s["text"]


def test_default_escapes_are_what_the_query_states():
    assert Template().escapes == (("\\", "\\b"), ("###", "\\h"), ("</turn>", "\\e")) and Template().role_escapes == ((":", "\\c"),)


@pytest.mark.parametrize(
    "bad",
    [
        {"close": ""}, {"close": "aba"}, {"close": "</turn>\\"}, {"escapes": (("\\", "\\b"), ("###", "\\h"))}, {"escapes": (("\\", "\\b"), ("###", "\\h"), ("</turn>", "\\h"))},
        {"escapes": (("###", "\\h"), ("\\", "\\b"), ("</turn>", "\\e"))}, {"role_escapes": (("x", "\\c"),)}, {"escape_char": "xx"}, {"escapes": (("\\", "\\<"), ("###", "\\h"), ("</turn>", "\\e"))},
    ],
)
def test_templates_that_could_not_be_read_back(bad):
    with pytest.raises(ValueError, match="mark|code|control"):
        Template(**bad)


@pytest.mark.parametrize("marks", [("[", ":<", "<e>"), ("<s>", " [", "[/end]")])
def test_marks_that_join_with_texts(marks):
    with pytest.raises(ValueError, match="mark"):
        Template(**dict(zip(("open", "middle", "close"), marks, strict=True)))


def _there_and_back(t, turns):
    """format_chat and read_back in plain string operations."""
    def escaped(x, pairs):
        for a, b in pairs:
            x = x.replace(a, b)
        return x

    def plain(x, pairs):
        for a, b in reversed(pairs):
            x = x.replace(b, a)
        return x

    whole = "".join(t.open + escaped(r, t.escapes + t.role_escapes) + t.middle + escaped(x, t.escapes) + t.close for r, x in turns)
    parts = [p for p in whole.split(t.close) if p]
    return [(plain(p.partition(t.middle)[0][len(t.open) :], t.escapes + t.role_escapes), plain(p.partition(t.middle)[2], t.escapes)) for p in parts]


def test_all_short_marks_against_all_short_texts(spark):
    """Every template over a small alphabet that is accepted gives back every short role and text; the others would lose one, or hold too little to escape."""
    strings = ["".join(x) for n in range(4) for x in product("ab", repeat=n)]
    marks = ["".join(x) for n in (1, 2, 3) for x in product("ab ", repeat=n)]
    accepted = []
    for open_, middle, close in product(marks[:12], marks, marks):
        try:
            accepted.append(Template(open=open_, middle=middle, close=close))
        except ValueError:
            continue
    assert len(accepted) > 50
    for t in accepted[:: max(1, len(accepted) // 400)]:
        for role, text in product(strings, strings):
            turns = [(role, text), (text, role)]
            assert _there_and_back(t, turns) == turns, (t, turns)
    for t in accepted[:: max(1, len(accepted) // 3)]:
        rows = [(i, k, r, x) for i, (a, b) in enumerate(product(strings, strings)) for k, (r, x) in enumerate([(a, b), (b, a)])]
        for r in read_back(format_chat(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), t), t).collect():
            assert [tuple(x) for x in r["turns"]] == [x[2:] for x in rows[2 * r["conv_id"] : 2 * r["conv_id"] + 2]], t
