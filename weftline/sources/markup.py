"""Pages as trees. One lenient tree is built from a page; the readers of records are queries over it."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

from .record import from_object, objects_in

# Elements without content, and names that mark items and steps in pages.
VOID = frozenset(
    (
        "meta",
        "link",
        "img",
        "br",
        "hr",
        "input",
        "source",
        "wbr",
    )
)
ITEM_NAMES = frozenset(
    (
        "wprm-recipe-ingredient",
        "tasty-recipes-ingredient",
        "ingredient",
        "ingredients-item",
        "recipe-ingredient",
        "recipeingredient",
    )
)
STEP_NAMES = frozenset(
    (
        "wprm-recipe-instruction-text",
        "tasty-recipes-instructions",
        "instruction",
        "instruction-step",
        "recipe-instruction",
        "recipeinstructions",
    )
)
CARD_NAMES = frozenset(("recipe", "recipe-details"))
BLOCKS = frozenset(("p", "li", "div"))


@dataclass
class Node:
    tag: str
    attrs: dict[str, str] = field(default_factory=dict)
    parts: list = field(default_factory=list)

    def bottom_up(self) -> Iterator[Node]:
        """This node and those below, children before parents."""
        todo = [(self, False)]
        while todo:
            node, done = todo.pop()
            if done:
                yield node
            else:
                todo.append((node, True))
                todo.extend((p, False) for p in reversed(node.parts) if isinstance(p, Node))

    def below(self) -> Iterator[Node]:
        todo = [self]
        while todo:
            node = todo.pop()
            yield node
            todo.extend(p for p in reversed(node.parts) if isinstance(p, Node))


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("")
        self.open = [self.root]

    def handle_starttag(self, tag, attrs):
        node = Node(tag, {k: v or "" for k, v in attrs})
        self.open[-1].parts.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.open[-1].parts.append(Node(tag, {k: v or "" for k, v in attrs}))

    def handle_endtag(self, tag):
        for depth in range(len(self.open) - 1, 0, -1):
            if self.open[depth].tag == tag:
                del self.open[depth:]
                return

    def handle_data(self, data):
        self.open[-1].parts.append(data)


def tree(page: str) -> Node:
    builder = _Builder()
    builder.feed(page)
    builder.close()
    return builder.root


def _texts(root: Node, join) -> dict[int, str]:
    """The text of each node by its identity, joined from its children's by join(node, parts)."""
    out: dict[int, str] = {}
    for node in root.bottom_up():
        out[id(node)] = join(node, [p if isinstance(p, str) else (p, out[id(p)]) for p in node.parts])
    return out


def _one_line(_: Node, parts: list) -> str:
    return " ".join(" ".join(p if isinstance(p, str) else p[1] for p in parts).split())


def _by_blocks(node: Node, parts: list) -> str:
    own = [node.attrs["content"]] if node.tag in VOID and node.attrs.get("content") else []
    return "".join(own + [p if isinstance(p, str) else p[1] + ("\n" if p[0].tag in BLOCKS else " ") for p in parts]).strip()


def _types(root: Node) -> dict[int, str]:
    """The nearest item type of each node, its own included."""
    out, todo = {}, [(root, "")]
    while todo:
        node, kind = todo.pop()
        kind = node.attrs.get("itemtype") or kind
        out[id(node)] = kind
        todo.extend((p, kind) for p in node.parts if isinstance(p, Node))
    return out


def json_ld(page: str) -> list[dict]:
    """Records in the page's linked-data blocks; blocks that are no JSON are passed over."""
    out = []
    for block in re.findall(r"(?is)<script\b[^>]*type=[\"']application/ld\+json[\"'][^>]*>(.*?)</script>", page):
        try:
            out += [from_object(o) for o in objects_in(json.loads(block))]
        except (ValueError, TypeError, AttributeError):
            continue
    return out


def _first(values: dict[str, list[str]], *names: str) -> str | None:
    return next((values[n][0] for n in names if values.get(n)), None)


def _title(root: Node, texts: dict[int, str]) -> str | None:
    return next((texts[id(n)] for n in root.below() if n.tag == "title"), None)


def microdata(page: str) -> list[dict]:
    """The record that item properties tell; a name counts within a recipe's scope alone."""
    root = tree(page)
    texts, kinds, values = _texts(root, _one_line), _types(root), {}
    for node in root.bottom_up():
        value = node.attrs.get("content", node.attrs.get("datetime", texts[id(node)]))
        for prop in node.attrs.get("itemprop", "").split():
            if value and (prop != "name" or kinds[id(node)].rstrip("/").endswith("Recipe")):
                values.setdefault(prop, []).append(value)
    items, steps = values.get("recipeIngredient") or values.get("ingredients"), values.get("recipeInstructions")
    if not items or not steps:
        return []
    link = next((n.attrs.get("href") for n in root.below() if n.tag == "link" and n.attrs.get("rel") == "canonical"), None)
    name = _first(values, "name") or _title(root, texts)
    return [from_object({"name": name, "recipeIngredient": items, "recipeInstructions": steps, "recipeYield": _first(values, "recipeYield"), "totalTime": _first(values, "totalTime"), "url": link})]


def named_components(page: str) -> list[dict]:
    """The record whose parts have well-known class, property or itemprop names."""
    root = tree(page)
    texts, found = _texts(root, _one_line), {"ingredients": [], "instructions": []}
    for node in root.bottom_up():
        names = set(" ".join(node.attrs.get(a, "") for a in ("class", "property", "itemprop")).lower().split())
        part = "instructions" if names & STEP_NAMES else "ingredients" if names & ITEM_NAMES else None
        if part and texts[id(node)]:
            found[part].append(texts[id(node)])
    title = _title(root, texts)
    return [from_object({"name": title, **found}) | {"method": "html-components"}] if title and all(found.values()) else []


def export_cards(page: str) -> list[dict]:
    """One record for each outermost card of an export page."""
    cards, todo = [], [tree(page)]
    while todo:
        node = todo.pop()
        if node.tag == "div" and CARD_NAMES & set(node.attrs.get("class", "").split()):
            cards.append(node)
        else:
            todo.extend(p for p in reversed(node.parts) if isinstance(p, Node))
    out = []
    for card in cards:
        texts, values = _texts(card, _by_blocks), {}
        for node in card.bottom_up():
            name = node.attrs.get("itemprop") or node.attrs.get("id") or next((c for c in node.attrs.get("class", "").split() if c in ("recipeIngredient", "instruction")), "")
            if name and texts[id(node)]:
                values.setdefault(name, []).append(texts[id(node)])
        pick = lambda *names: next((values[n] for n in names if n in values), None)
        out.append(from_object({
            "name": _first(values, "name"), "recipeIngredient": pick("recipeIngredient", "recipeIngredients"), "recipeInstructions": pick("instruction", "recipeDirections", "recipeInstructions"),
            "recipeYield": _first(values, "recipeYield"), "url": _first(values, "original_link", "recipeSource"),
        }))
    return out


