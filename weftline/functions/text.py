"""Text and URL expressions. Arrow functions only where Spark lacks a built-in (NFKC, casefold)."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.StringType())
def nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


@F.pandas_udf(T.StringType())
def casefold(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else x.casefold())


def clean_name(text: Column, normalized: bool = False) -> Column:
    """Lower case without Markdown marks, runs of blanks as one, no punctuation at the ends. normalized: the text is NFKC already."""
    text = F.trim(F.lower(text if normalized else nfkc(text)))
    text = F.regexp_replace(F.regexp_replace(text, r"[*_`\[\]]", ""), r"(?U)\s+", " ")
    return F.regexp_replace(text, r"^[ .,\-:;]+|[ .,\-:;]+$", "")


def search_text(text: Column, normalized: bool = False) -> Column:
    """Letters and numbers in lower case with single blanks between."""
    text = F.lower(F.coalesce(text if normalized else nfkc(text), F.lit("")))
    return F.trim(F.regexp_replace(text, r"[^\p{L}\p{N}]+", " "))


def contains_words(text: Column, words: Column) -> Column:
    """words stand in text at word borders; both are search texts."""
    return F.contains(F.concat(F.lit(" "), text, F.lit(" ")), F.concat(F.lit(" "), words, F.lit(" ")))


def glob_regex(pattern: str) -> str:
    """A file-name pattern as a regular expression: * and ? also cross slashes."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        close = pattern.find("]", i + 2) if c == "[" else -1
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif close > 0:
            body, no = pattern[i + 1 : close], pattern[i + 1] == "!"
            out += ("[^" if no else "[") + re.sub(r"[\\\[\]^&]", r"\\\g<0>", body[no:]) + "]"
            i = close
        else:
            out += re.escape(c)
        i += 1
    return rf"(?s)^{out}\z"


def path_selected(path: Column, include: list[str], exclude: list[str] = ()) -> Column:
    """Some include pattern matches and no exclude pattern does."""

    def some(patterns):
        return F.lit(False) if not patterns else path.rlike("|".join(f"(?:{glob_regex(p)})" for p in patterns))

    return some(include) & ~some(exclude)


def safe_url(*candidates: Column) -> Column:
    """The first candidate that is http or https, has a host and no user, a valid port if any, and no blanks or <>\\."""

    def good(u: Column) -> Column:
        parsed = u.rlike(r"^(?i:https?)://[^/?#@\s<>\\:]+(?::[0-9]{1,5})?(?:[/?#][^\s<>\\]*)?$")
        port = F.regexp_extract(u, r"^[A-Za-z]+://[^/?#:]+:([0-9]{1,5})", 1)
        return F.when(parsed & ((port == "") | (port.try_cast("int") <= 65535)), u)

    return F.coalesce(*(good(u) for u in candidates))


def host_within(url: Column, domain: str) -> Column:
    """The URL's host is the domain or below it."""
    host = F.lower(F.try_parse_url(url, F.lit("HOST")))
    return F.coalesce((host == domain) | F.endswith(host, F.lit("." + domain)), F.lit(False))


def html_escape(text: Column) -> Column:
    text = F.coalesce(text, F.lit("Unknown"))
    for raw, code in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(raw), F.lit(code))
    return text


# Named character references that are read.
REFERENCES = {
    "lt": "<",
    "gt": ">",
    "quot": '"',
    "apos": "'",
    "nbsp": " ",
    "copy": "©",
    "reg": "®",
    "deg": "°",
    "middot": "·",
    "frac12": "½",
    "frac14": "¼",
    "frac34": "¾",
    "ndash": "–",
    "mdash": "—",
    "hellip": "…",
    "lsquo": "‘",
    "rsquo": "’",
    "ldquo": "“",
    "rdquo": "”",
    "eacute": "é",
    "egrave": "è",
    "agrave": "à",
    "ccedil": "ç",
    "uuml": "ü",
    "ouml": "ö",
    "auml": "ä",
    "amp": "&",
}
_SCRIPTS = r"(?is)<!--.*?-->|<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>"


_REFERENCE = r"&(#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6}|[A-Za-z][A-Za-z0-9]{1,7});"


def unescaped(text: Column) -> Column:
    """Character references as characters, in one pass: named ones of REFERENCES, and numeric ones, decimal or hexadecimal. Others stay, and
    what a reference gives is not read again. A text without & is left alone."""
    named = F.create_map(*(F.lit(x) for pair in REFERENCES.items() for x in pair))

    def sign(m: Column) -> Column:
        code = F.when(F.lower(F.substring(m, 2, 1)) == "x", F.conv(F.substring(m, 3, 6), 16, 10)).otherwise(F.substring(m, 2, 7)).cast("int")
        known = F.transform(F.array(code), lambda c: F.when((c > 0) & (c < 0xD800) | (c >= 0xE000) & (c <= 0x10FFFF), F.decode(F.unhex(F.lpad(F.hex(c), 8, "0")), "UTF-32")).otherwise("\ufffd"))[0]
        return F.when(F.startswith(m, F.lit("#")), known).otherwise(F.coalesce(F.try_element_at(named, m), F.concat(F.lit("&"), m, F.lit(";"))))

    def read(t: Column) -> Column:
        signs = F.transform(F.regexp_extract_all(t, F.lit(_REFERENCE), F.lit(1)), sign)
        return F.array_join(F.zip_with(F.split(t, _REFERENCE, -1), signs, lambda p, s: F.concat(p, F.coalesce(s, F.lit("")))), "")

    return F.when(F.contains(text, F.lit("&")), F.transform(F.array(text), read)[0]).otherwise(text)


def visible_text(page: Column) -> Column:
    """A page's text without scripts, styles, comments and tags, with character references read."""
    bare = F.regexp_replace(F.regexp_replace(page, _SCRIPTS, " "), r"<[^>]*>", " ")
    return F.trim(F.regexp_replace(unescaped(bare), r"\s+", " "))


def page_title(page: Column) -> Column:
    return F.regexp_extract(page, r"(?is)<title[^>]*>(.*?)</title>", 1)


def display_title(title: Column) -> Column:
    """Without a final 做法 after a Chinese title, unless the title is about kinds of methods."""
    title = F.when(F.coalesce(title, F.lit("")) == "", "Untitled recipe").otherwise(title)
    stem = F.rtrim(F.regexp_extract(title, r"^(.+?)(?:的)?做法\s*$", 1))
    return F.when((stem != "") & stem.rlike("[㐀-鿿]") & ~stem.rlike("(?:传统|常见|不同|惯用|这种|那种|某种|其他|其它|[一二三四五六七八九十两0-9]+种)$"), stem).otherwise(title)


def page_url(identifier: Column) -> Column:
    """A page's file name: the id itself where it is safe, else a hash of it."""
    return F.concat(F.lit("recipes/"), F.when(identifier.rlike(r"^[A-Za-z0-9_-]{1,80}$"), identifier).otherwise(F.substring(F.sha2(identifier, 256), 1, 24)), F.lit(".html"))


def labels(value: Column, known: dict[str, str]) -> Column:
    """Comma-separated tokens through a table of lower-case names to labels (commas allowed), sorted; ["Unknown"] if none is known."""
    table = F.create_map(*(F.lit(x) for k, v in known.items() for x in (k, v)))
    found = F.flatten(F.transform(F.split(F.coalesce(value, F.lit("")), ","), lambda t: F.split(F.coalesce(F.try_element_at(table, F.lower(F.trim(t))), F.lit("")), ",")))
    out = F.array_sort(F.array_distinct(F.filter(found, lambda x: x != "")))
    return F.when(F.size(out) > 0, out).otherwise(F.array(F.lit("Unknown")))
