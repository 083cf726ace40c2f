"""HTML extraction by layout-aware rendering.

A tree builder with implied tags (tags that end others, table sections and rows, content that a
table gives up to what is before it) makes a tree of the page; visibility rules take out what a
browser does not show on a screen; a renderer emits all other text: blocks on lines of their own
with blank lines where they have margins, list items with bullets or numbers and indents,
preformatted text as it is, and table cells padded to columns over a grid in which cells may span
columns and rows.

Visibility: head, scripts, styles, templates, media fallbacks, comments, closed ``details`` but for
their summary, and what the cascade of the page's style sheets and ``style`` attributes gives no
display; hidden visibility is inherited, and an element within may be visible again. Style sheets
are read with comments, nested at-rules (``media`` for a screen of ``SCREEN`` pixels), importance,
specificity and order; selectors with all combinators, classes, ids, attributes, structural
pseudo-classes and ``:is``, ``:where`` and ``:not``. Sheets that a page only links to are not known.
Text of inline svg and of math, the chosen option of a select (all of a list box), labels of buttons
and contents of text fields are shown, an image as its ``alt``.

Defined cases: null stays null and empty or textless pages give ''; broken markup and style never
raise; tags nest to any depth (no recursion on input but in ``:is``, ``:where`` and ``:not``, where
it is bounded); numbers outside the limits of the HTML standard are as it says; repeated rows stay;
input columns named like a result column are replaced.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from html import unescape
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm.staging import extend, pieces

# fixed values: element classes of the HTML standard
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes noscript textarea title plaintext".split())
HIDDEN = frozenset("head script style template noscript iframe noembed noframes title datalist object audio video canvas progress meter annotation annotation-xml param meta link base area rp".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup p pre search section summary table ul caption xmp".split())
MARGIN = frozenset("blockquote dl figure h1 h2 h3 h4 h5 h6 ol p pre table ul menu dir xmp hr".split())
ENDS_P = BLOCK - frozenset("body html dd dt li legend optgroup caption summary".split()) | {"summary", "li", "dd", "dt"}
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
LISTS = frozenset("ul ol menu dir".split())
#: a start tag closes open elements of these names, up to a scope element
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir", "td", "th", "table"}),
    "dt": ({"dt", "dd"}, {"dl", "td", "th", "table"}),
    "dd": ({"dt", "dd"}, {"dl", "td", "th", "table"}),
    "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "rt": ({"rt", "rp"}, {"ruby"}),
    "rp": ({"rt", "rp"}, {"ruby"}),
    "a": ({"a"}, {"td", "th", "table", "button"}),
    "button": ({"button"}, {"td", "th", "table"}),
    "body": ({"head"}, set()),
}
SCOPE = frozenset("table td th caption html template object button".split())
IN_HEAD = frozenset("title meta link base script style template noscript".split())
SECTIONS = frozenset("tbody thead tfoot".split())
CELLS = frozenset("td th".split())
TABULAR = SECTIONS | CELLS | {"caption", "colgroup", "col", "tr"}
#: open elements in which only tabular ones may stand, and what else they take
GRID, IN_GRID = SECTIONS | {"table", "tr", "colgroup"}, frozenset("script style template".split())
#: the most columns and rows that a cell may span
MOST_COLUMNS, MOST_ROWS = 1000, 65534
#: what holds text in an inline svg that is not drawn where it stands
UNDRAWN = frozenset("title desc defs symbol metadata clippath mask pattern marker style script".split())
#: types of input that show no text of theirs, and those that show a label
WORDLESS = frozenset("hidden password checkbox radio file range color".split())
LABELLED = frozenset("submit button reset image".split())
# fixed values: what a style sheet may say of display and visibility
INLINE = frozenset("inline inline-block inline-flex inline-grid inline-table contents ruby".split())
BLOCKS = frozenset("block flex grid table list-item flow-root table-row table-cell table-caption table-row-group table-header-group table-footer-group table-column table-column-group run-in".split())
DISPLAY = INLINE | BLOCKS | {"none"}
VISIBILITY = frozenset("visible hidden collapse".split())
#: the screen that media queries are answered for, in pixels
SCREEN = (1280, 800)
RESULT = {"text": "string"}

_token = re.compile(r"<!--(?:-?>|(.*?)(?:-->|--!>|$))|<[!?]([^>]*)(?:>|$)|<(/?)([a-zA-Z][^\s/>]*+)((?:=\s*+(?:\"[^\"]*\"|'[^']*'|(?![\"'])[^\s>]*+)|[^>=])*+)(?:>|$)", re.S)
_attribute = re.compile(r"([^\s=/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_number = re.compile(r"[ \t\n\r\f]*([+-]?[0-9]{1,10})(?![0-9])")
_space = re.compile(r"[ \t\n\r\f]+")
_css = re.compile(r"/\*.*?(?:\*/|$)|(\"(?:\\.|[^\"\\\n])*\"?|'(?:\\.|[^'\\\n])*'?)|([{}])|((?:\\.|[^{}\"'/\\])+|.)", re.S)
_name = re.compile(r"@[\w-]*")
_break = re.compile(r"\r?\n")
_feature = re.compile(r"\(\s*(min-|max-)?(width|height)\s*:\s*([0-9.]+)\s*(px|r?em)?\s*\)$")
_part = re.compile(
    r"(?P<tag>\*|(?:[\w-]|[^\x00-\x7f]|\\.)+)|#(?P<id>(?:[\w-]|[^\x00-\x7f]|\\.)+)|\.(?P<cls>(?:[\w-]|[^\x00-\x7f]|\\.)+)"
    r"|\[\s*(?P<attr>[\w:-]+)\s*(?:(?P<op>[~|^$*]?=)\s*(?:\"(?P<v1>[^\"]*)\"|'(?P<v2>[^']*)'|(?P<v3>[^\]\s]+))\s*(?P<fold>[iIsS])?\s*)?\]"
    r"|(?P<colons>::?)(?P<pseudo>[\w-]+)(?P<open>\()?"
)
_nth = re.compile(r"\s*(?:(?P<word>odd|even)|(?P<a>[+-]?\d{0,9})n\s*(?:(?P<sign>[+-])\s*(?P<b>\d{1,9}))?|(?P<only>[+-]?\d{1,9}))\s*$", re.I)


def whole(text: str | None, default: int) -> int:
    """A number as HTML reads it; what no 32 bits can hold counts as none."""
    m = _number.match(text or "")
    n = int(m[1]) if m else default
    return n if -(1 << 31) <= n < 1 << 31 else default


class Node:
    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None = None):
        self.tag, self.attrs, self.children, self.parent = tag, attrs, [], parent


class Builder:
    """The stack of open elements, and where new ones go."""

    def __init__(self):
        self.root = Node("#root", {})
        self.stack, self.open = [self.root], Counter()

    def cut(self, size: int) -> None:
        while len(self.stack) > size:
            self.open[self.stack.pop().tag] -= 1

    def close(self, names, scope) -> None:
        """Close elements of these names up to a scope element."""
        if not any(self.open[n] for n in names):
            return
        found = None
        for k in range(len(self.stack) - 1, 0, -1):
            if self.stack[k].tag in names:
                found = k
            elif self.stack[k].tag in scope:
                break
        if found is not None:
            self.cut(found)

    def table(self) -> int | None:
        """Place of the innermost open table."""
        if not self.open["table"]:
            return None
        return next(k for k in range(len(self.stack) - 1, 0, -1) if self.stack[k].tag == "table")

    def add(self, child: Node | str, foster: bool = False) -> None:
        """A child of the open element; with ``foster`` it goes before the table instead."""
        to = self.stack[-1]
        if foster and (t := self.table()) is not None:
            table = self.stack[t]
            to = table.parent
            at = next(k for k in range(len(to.children) - 1, -1, -1) if to.children[k] is table)
            to.children.insert(at, child)
        else:
            to.children.append(child)
        if isinstance(child, Node):
            child.parent = to

    def push(self, node: Node, foster: bool = False) -> None:
        self.add(node, foster)
        self.stack.append(node)
        self.open[node.tag] += 1

    def text(self, text: str) -> None:
        if not text:
            return
        blank = not text.strip(" \t\n\r\f")
        if self.stack[-1].tag == "head" and not blank:
            self.cut(len(self.stack) - 1)
        self.add(unescape(text), foster=not blank and self.stack[-1].tag in GRID)

    def tabular(self, name: str) -> bool:
        """Make room for a part of a table. False outside of tables, where it is ignored."""
        t = self.table()
        if t is None:
            return False
        section = len(self.stack) > t + 1 and self.stack[t + 1].tag in SECTIONS
        if name == "tr" or name in CELLS:
            self.cut(self._row(t, section) if name in CELLS else t + 1 + section)
            if not section and self.stack[-1].tag == "table":
                self.push(Node("tbody", {}))
            if name in CELLS and self.stack[-1].tag != "tr":
                self.push(Node("tr", {}))
        else:
            self.cut(t + 1)
        return True

    def _row(self, t: int, section: bool) -> int:
        at = t + 1 + section
        return at + 1 if len(self.stack) > at and self.stack[at].tag == "tr" else at

    def end(self, name: str) -> None:
        if name in ("html", "body"):
            return
        if name == "br" or name == "p" and not self.open["p"]:
            self.add(Node(name, {}), foster=self.stack[-1].tag in GRID)
            return
        names = HEADING if name in HEADING else {name}
        if not any(self.open[n] for n in names):
            return
        for k in range(len(self.stack) - 1, 0, -1):
            tag = self.stack[k].tag
            if tag in names:
                return self.cut(k)
            if tag == "table" or tag in ("td", "th", "caption") and name not in GRID:
                return None


def parse(html: str) -> Node:
    """The tree of a page; text nodes are strings with entities resolved."""
    b = Builder()
    at, n = 0, len(html)
    while at < n:
        m = _token.search(html, at)
        if m is None:
            b.text(html[at:])
            break
        b.text(html[at : m.start()])
        at = m.end()
        name = m[4]
        if name is None:
            continue
        name = name.lower()
        if m[3]:
            b.end(name)
            continue
        attrs = {}
        for a in _attribute.finditer(m[5]) if m[5] else ():
            attrs.setdefault(a[1].lower(), unescape(a[2] or a[3] or a[4] or ""))
        if b.stack[-1].tag == "head" and name not in IN_HEAD:
            b.cut(len(b.stack) - 1)
        if name in TABULAR and not b.tabular(name):
            continue
        if name == "table" and b.stack[-1].tag in GRID:
            b.cut(b.table())
        if name in IMPLIED:
            b.close(*IMPLIED[name])
        if name in ENDS_P:
            b.close({"p"}, SCOPE)
        if name in HEADING and b.stack[-1].tag in HEADING:
            b.cut(len(b.stack) - 1)
        node = Node(name, attrs)
        stray = b.stack[-1].tag in GRID and name not in TABULAR and name not in IN_GRID
        if name in VOID or m[5].endswith("/") and (name in ("svg", "math") or b.open["svg"] or b.open["math"]):
            b.add(node, stray)
        elif name in RAW:
            b.add(node, stray)
            end = re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I).search(html, at) if name != "plaintext" else None
            text = html[at : end.start()] if end else html[at:]
            node.children.append(unescape(text) if name in ("textarea", "title") else text)
            at = end.end() if end else n
        else:
            b.push(node, stray)
        # a line break that follows at once is no text
        if name == "textarea" and (first := _break.match(node.children[0])):
            node.children[0] = node.children[0][first.end() :]
        elif name in ("pre", "listing") and (first := _break.match(html, at)):
            at = first.end()
    return b.root


# -- style ---------------------------------------------------------------------------------------------


def fits_screen(query: str) -> bool:
    """Whether a list of media queries lets a screen in."""

    def one(q: str) -> bool:
        parts = [p.strip() for p in re.split(r"\s+and\s+", q.strip().lower())]
        negated = parts[0].startswith("not ")
        parts[0] = re.sub(r"^(?:not|only)\s+", "", parts[0])
        return negated != all(map(holds, parts))

    def holds(part: str) -> bool:
        if part in ("", "all", "screen", "(orientation: landscape)", "(orientation:landscape)", "(hover)", "(hover: hover)", "(hover:hover)"):
            return True
        if m := _feature.match(part):
            size, wanted = SCREEN[m[2] == "height"], float(m[3] if m[3].count(".") < 2 and m[3] != "." else 0) * (16 if m[4] in ("em", "rem") else 1)
            return size >= wanted if m[1] == "min-" else size <= wanted if m[1] == "max-" else size == wanted
        return False

    return any(map(one, query.split(","))) if query.strip() else True


def rules_of(sheet: str) -> Iterator[tuple[str, str]]:
    """Selectors and declarations of a style sheet that are in force on a screen, in order."""
    text, live, inside = [], [True], None  # what stands before a brace; nested blocks; a selector
    for m in _css.finditer(sheet):
        brace = m[2]
        if brace is None:
            if m[1] or m[3]:
                text.append(m[0])
            continue
        held, text = "".join(text), []
        if brace == "{":
            head = held.rsplit(";", 1)[-1].strip() if inside is None else held.strip()
            if inside is not None:
                live.append(False)  # a block within a rule
            elif head.startswith("@"):
                name = _name.match(head)[0].lower()
                live.append(live[-1] and (name in ("@supports", "@layer") or name == "@media" and fits_screen(head[len(name) :])))
            else:
                inside = (len(live), head)
                live.append(live[-1])
        elif len(live) > 1:
            on = live.pop()
            if inside is not None and len(live) == inside[0]:
                if on:
                    yield inside[1], held
                inside = None


def declared(body: str) -> dict[str, tuple[bool, str]]:
    """``display`` and ``visibility`` of declarations: whether important, and the value."""
    out: dict[str, tuple[bool, str]] = {}
    for part in re.sub(r"/\*.*?(?:\*/|$)", "", body, flags=re.S).split(";"):
        name, _, value = part.partition(":")
        name, value = name.strip().lower(), value.strip().lower()
        if name not in ("display", "visibility"):
            continue
        important = value.endswith("important") and "!" in value
        value = " ".join(value.partition("!")[0].split())
        value = value.removeprefix("block ").removeprefix("inline ") if " " in value else value
        if value in (DISPLAY if name == "display" else VISIBILITY) and (important or not out.get(name, (False,))[0]):
            out[name] = (important, value)
    return out


def _plain(name: str) -> str:
    return re.sub(r"\\(.)", r"\1", name)


def _elements(node: Node) -> list[Node]:
    return [c for c in node.children if isinstance(c, Node)]


def _attribute_test(name: str, op: str | None, value: str, fold: bool) -> Callable[[Node], bool]:
    if fold:
        value = value.lower()

    def test(node: Node) -> bool:
        held = node.attrs.get(name)
        if held is None or op is None:
            return held is not None
        held = held.lower() if fold else held
        if op == "=":
            return held == value
        if op == "~=":
            return value in held.split()
        if op == "|=":
            return held == value or held.startswith(value + "-")
        return bool(value) and (held.startswith(value) if op == "^=" else held.endswith(value) if op == "$=" else value in held)

    return test


def _place_test(pseudo: str, inner: str) -> Callable[[Node], bool] | None:
    """Tests of an element's place among its siblings; None for what is not known."""
    if pseudo == "root":
        return lambda node: node.tag == "html"
    if pseudo == "empty":
        return lambda node: not any(isinstance(c, Node) or c for c in node.children)
    if pseudo in ("first-child", "last-child", "only-child", "nth-child", "nth-last-child"):
        a, b = 0, 1
        if pseudo.startswith("nth"):
            if not (m := _nth.match(inner)):
                return None
            if m["word"]:
                a, b = 2, int(m["word"].lower() == "odd")
            elif m["only"]:
                b = int(m["only"])
            else:
                a = int(m["a"] + "1") if m["a"] in ("", "+", "-") else int(m["a"])
                b = int((m["sign"] or "+") + (m["b"] or "0"))

        def at(node: Node, back: bool) -> bool:
            row = _elements(node.parent) if node.parent else [node]
            k = next(i for i, x in enumerate(reversed(row) if back else row) if x is node) + 1 - b
            return k == 0 if a == 0 else k % a == 0 and k // a >= 0

        if pseudo == "only-child":
            return lambda node: at(node, False) and at(node, True)
        return lambda node: at(node, "last" in pseudo)
    return None


def selector(text: str, depth: int = 0) -> Selector | None:
    """A selector without commas. None if it is not valid, or matches nothing that is shown: states
    of a pointer, and parts of elements."""
    chain: list[tuple[str, list]] = []
    weight, combinator, at = [0, 0, 0], "", 0
    text = text.strip()
    key = ("", "")
    while at < len(text):
        tests: list[Callable[[Node], bool]] = []
        key, begun = ("", ""), at
        while at < len(text) and (m := _part.match(text, at)) and not (m["tag"] and at > begun):
            at = m.end()
            if m["tag"]:
                if (tag := _plain(m["tag"]).lower()) != "*":
                    tests.append(lambda node, tag=tag: node.tag == tag)
                    weight[2] += 1
                    key = ("", tag)
            elif m["id"]:
                tests.append(lambda node, name=_plain(m["id"]): node.attrs.get("id") == name)
                weight[0] += 1
                key = ("#", _plain(m["id"]))
            elif m["cls"]:
                tests.append(lambda node, name=_plain(m["cls"]): name in node.attrs.get("class", "").split())
                weight[1] += 1
                key = key if key[0] == "#" else (".", _plain(m["cls"]))
            elif m["attr"]:
                tests.append(_attribute_test(m["attr"].lower(), m["op"], m["v1"] or m["v2"] or m["v3"] or "", (m["fold"] or "").lower() == "i"))
                weight[1] += 1
            else:
                pseudo, inner = m["pseudo"].lower(), ""
                if m["open"]:
                    level, end = 1, at
                    while end < len(text) and level:
                        level += (text[end] == "(") - (text[end] == ")")
                        end += 1
                    inner, at = text[at : end - 1], end
                if m["colons"] == "::":
                    return None
                if pseudo in ("is", "where", "not", "matches") and depth < 4:
                    held = [selector(s, depth + 1) for s in split_list(inner)]
                    held = [s for s in held if s is not None]
                    tests.append((lambda node, held=held: not any(s.matches(node) for s in held)) if pseudo == "not" else (lambda node, held=held: any(s.matches(node) for s in held)))
                    if held and pseudo != "where":
                        weight = [a + b for a, b in zip(weight, max(s.weight for s in held), strict=True)]
                elif (test := _place_test(pseudo, inner)) is not None:
                    tests.append(test)
                    weight[1] += 1
                else:
                    return None
        if at == begun:
            return None
        chain.append((combinator, tests))
        if at < len(text):
            gap = re.compile(r"\s*([>+~])\s*|\s+").match(text, at)
            if not gap or gap.end() == len(text):
                return None
            combinator, at = gap[1] or " ", gap.end()
    return Selector(chain, tuple(weight), key) if chain else None


class Selector:
    __slots__ = ("chain", "weight", "key")

    def __init__(self, chain: list, weight: tuple, key: tuple[str, str]):
        self.chain, self.weight, self.key = chain, weight, key

    def matches(self, node: Node) -> bool:
        seen, todo = set(), [(len(self.chain) - 1, node)]
        while todo:
            k, x = todo.pop()
            if (k, id(x)) in seen or x.tag == "#root" or not all(test(x) for test in self.chain[k][1]):
                continue
            if k == 0:
                return True
            seen.add((k, id(x)))
            how = self.chain[k][0]
            if how in (" ", ">"):
                x = x.parent
                while x is not None:
                    todo.append((k - 1, x))
                    x = x.parent if how == " " else None
            elif x.parent is not None:
                row = _elements(x.parent)
                before = row[: next(i for i, y in enumerate(row) if y is x)]
                todo += [(k - 1, y) for y in (before if how == "~" else before[-1:])]
        return False


def split_list(text: str) -> list[str]:
    """Parts between commas that are not in brackets."""
    out, level, begun = [], 0, 0
    for k, c in enumerate(text):
        level += (c in "([") - (c in ")]")
        if c == "," and not level:
            out.append(text[begun:k])
            begun = k + 1
    return [*out, text[begun:]]


class Styles:
    """What the page's style sheets and attributes say of display and visibility."""

    def __init__(self, root: Node):
        self.rules: dict[tuple[str, str], list] = defaultdict(list)
        todo, order = [root], 0
        while todo:
            node = todo.pop()
            if node.tag == "style" and fits_screen(node.attrs.get("media", "")):
                for selectors, body in rules_of("".join(c for c in node.children if isinstance(c, str))):
                    if said := declared(body):
                        for s in split_list(selectors):
                            if found := selector(s):
                                order += 1
                                self.rules[found.key].append((found, order, said))
            todo += [c for c in reversed(node.children) if isinstance(c, Node)]

    def of(self, node: Node) -> tuple[str | None, str | None]:
        """Display and visibility; None where nothing is said."""
        attrs = node.attrs
        if not self.rules and "style" not in attrs and "hidden" not in attrs and node.tag != "dialog":
            return None, None
        best: dict[str, tuple] = {}
        if "hidden" in attrs or node.tag == "dialog" and "open" not in attrs:
            best["display"] = ((False, (-1,), 0), "none")
        if self.rules:
            keys = [("", ""), ("", node.tag), *((".", c) for c in attrs.get("class", "").split()), *([("#", attrs["id"])] if "id" in attrs else [])]
            for key in keys:
                for found, order, said in self.rules.get(key, ()):
                    if found.matches(node):
                        for name, (important, value) in said.items():
                            rank = (important, (0, *found.weight), order)
                            if name not in best or rank > best[name][0]:
                                best[name] = (rank, value)
        for name, (important, value) in declared(attrs["style"]).items() if "style" in attrs else ():
            rank = (important, (1,), 0)
            if name not in best or rank > best[name][0]:
                best[name] = (rank, value)
        return (best["display"][1] if "display" in best else None), (best["visibility"][1] if "visibility" in best else None)

    def gone(self, node: Node) -> bool:
        return node.tag in HIDDEN or self.of(node)[0] == "none"


def drawn(svg: Node, styles: Styles) -> list[Node]:
    """Text elements and embedded HTML of an inline svg, in order."""
    out, todo = [], [svg]
    while todo:
        node = todo.pop()
        if node.tag in UNDRAWN or styles.gone(node):
            continue
        if node.tag in ("text", "foreignobject"):
            out.append(node)
        else:
            todo += [c for c in reversed(node.children) if isinstance(c, Node)]
    return out


def shown(select: Node, styles: Styles) -> list[Node]:
    """The chosen option of a select; all of a list box."""
    options, todo = [], [select]
    while todo:
        node = todo.pop()
        if node is not select and styles.gone(node):
            continue
        if node.tag == "option":
            options.append(node)
        else:
            todo += [c for c in reversed(node.children) if isinstance(c, Node)]
    if "multiple" in select.attrs or whole(select.attrs.get("size"), 1) > 1:
        return options
    chosen = [o for o in options if "selected" in o.attrs] or [o for o in options if "disabled" not in o.attrs][:1]
    return chosen[-1:]


def numeral(n: int, kind: str) -> str:
    """A list item's number in the list's type."""
    if kind in ("a", "A") and n > 0:
        out = ""
        while n:
            n, k = divmod(n - 1, 26)
            out = chr(97 + k) + out
        return out if kind == "a" else out.upper()
    if kind in ("i", "I") and 0 < n < 4000:
        # fixed values: roman numerals
        steps = ((1000, "m"), (900, "cm"), (500, "d"), (400, "cd"), (100, "c"), (90, "xc"), (50, "l"), (40, "xl"), (10, "x"), (9, "ix"), (5, "v"), (4, "iv"), (1, "i"))
        out = ""
        for value, sign in steps:
            out += sign * (n // value)
            n %= value
        return out if kind == "i" else out.upper()
    return str(n)


def width(text: str) -> int:
    """Columns of a line on a terminal: wide characters take two, combining ones none."""
    if text.isascii():
        return len(text)
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


class Lines:
    """Lines under construction: inline text flows, blocks break it, margins leave a blank line."""

    def __init__(self):
        self.done: list[str] = []
        self.parts: list[str] = []
        self.gap = False
        self.indent, self.lead = "", ""

    def text(self, text: str) -> None:
        text = _space.sub(" ", text)
        if not self.parts or self.parts[-1].endswith((" ", "\n")):
            text = text.lstrip(" ")
        if text:
            self.parts.append(text)

    def line(self) -> None:
        text = "".join(self.parts).rstrip(" ")
        self.parts = []
        if text:
            self.emit(text)

    def emit(self, text: str) -> None:
        if self.gap and self.done:
            self.done.append("")
        self.gap = False
        self.done.append((self.lead or self.indent) + text)
        self.lead = ""

    def forced(self) -> None:
        """A line break: ends the line, or leaves an empty one."""
        if self.parts:
            self.line()
        elif self.done and self.done[-1]:
            self.gap = True

    def block(self, margin: bool) -> None:
        self.line()
        if margin:
            self.gap = True


def render(root: Node) -> str:
    """The page's lines. An explicit stack of steps stands in for recursion."""
    styles, base = Styles(root), Lines()
    # steps: a node, how deep in lists it is, whether text keeps its spaces and whether it is seen
    targets, steps = [base], [(root, 0, False, True)]
    tables: list[dict] = []
    numbers: list[dict] = []  # of open lists: the next number, the step to the one after, the type
    while steps:
        node, depth, pre, seen = steps.pop()
        lines = targets[-1]
        if callable(node):
            node()
            continue
        if isinstance(node, str):
            if not seen:
                continue
            if pre:
                for k, part in enumerate(node.replace("\r\n", "\n").split("\n")):
                    if k:
                        text = "".join(lines.parts)
                        lines.parts = []
                        lines.emit(text.rstrip()) if text.strip() else lines.done.append("")
                    if part:
                        lines.parts.append(part)
            else:
                lines.text(node)
            continue
        tag, attrs = node.tag, node.attrs
        display, visibility = styles.of(node)
        if tag in HIDDEN or display == "none":
            continue
        seen = visibility == "visible" if visibility else seen
        if tag == "br":
            lines.forced()
            continue
        if tag == "hr":
            lines.block(True)
            if seen:
                lines.emit("----")
            lines.gap = True
            continue
        if tag in ("img", "input"):
            if seen and (label := label_of(node)):
                lines.text(label if tag == "img" else f" {label} ")
            continue

        def after(call: Callable[[], None]) -> None:
            steps.append((call, 0, False, True))

        children = node.children
        if tag in ("svg", "select"):
            children = drawn(node, styles) if tag == "svg" else shown(node, styles)
        elif tag in ("text", "option", "textarea"):
            lines.text(" ")
            after(lambda lines=lines: lines.text(" "))
            if tag == "option" and attrs.get("label"):
                children = [attrs["label"]]
            elif tag == "textarea" and not "".join(c for c in children if isinstance(c, str)):
                children = [attrs.get("placeholder", "")]
        if tag == "details" and "open" not in attrs:
            children = [c for c in children if isinstance(c, Node) and c.tag == "summary"][:1]
        block = (tag in BLOCK or display in BLOCKS) and display not in INLINE
        if tag == "table":
            lines.block(True)
            grid: dict = {"groups": [], "caption": []}
            tables.append(grid)

            def finish(lines=lines, grid=grid):
                tables.pop()
                for text in grid["caption"] + aligned(grid["groups"]):
                    lines.emit(text)
                lines.gap = True

            after(finish)
        elif tag in SECTIONS and tables:
            tables[-1]["groups"].append((tag, []))
        elif tag == "tr" and tables:
            tables[-1]["groups"][-1][1].append([])
        elif tag in ("td", "th", "caption") and tables:
            grid, cell = tables[-1], Lines()
            targets.append(cell)

            def close(grid=grid, cell=cell, tag=tag, attrs=attrs):
                targets.pop()
                cell.line()
                if tag == "caption":
                    grid["caption"] += cell.done
                else:
                    columns, rows = whole(attrs.get("colspan"), 1), whole(attrs.get("rowspan"), 1)
                    grid["groups"][-1][1][-1].append((cell.done, min(columns, MOST_COLUMNS) if columns > 0 else 1, min(rows, MOST_ROWS) if rows >= 0 else 1))

            after(close)
        elif tag == "li" and block:
            lines.line()
            mark = "- "
            if numbers and numbers[-1]:
                row = numbers[-1]
                row["next"] = whole(attrs.get("value"), row["next"])
                mark = numeral(row["next"], attrs.get("type", row["type"])) + ". "
                row["next"] += row["step"]
            held = lines.indent
            if seen:
                lines.lead = held + mark
            lines.indent = held + " " * len(mark)

            def unindent(lines=lines, held=held):
                lines.line()
                lines.lead = ""  # of an item without text
                lines.indent = held

            after(unindent)
        elif tag in ("blockquote", "dd") and block:
            lines.block(tag == "blockquote")
            held = lines.indent
            lines.indent = held + "  "

            def unquote(lines=lines, held=held, margin=tag == "blockquote"):
                lines.block(margin)
                lines.indent = held

            after(unquote)
        elif block:
            # a list in a list stands close to its item
            margin = tag in MARGIN and not (tag in LISTS and depth > 0)
            lines.block(margin)
            after(lambda lines=lines, margin=margin: lines.block(margin))
        elif tag == "q" and seen:
            lines.text('"')
            after(lambda lines=lines: lines.text('"'))
        if tag in LISTS:
            depth += 1
            numbers.append(numbering(node) if tag == "ol" else {})
            after(numbers.pop)
        inner = pre or tag in ("pre", "xmp", "listing", "textarea")
        if tag in GRID and tables:
            children = [c for c in children if isinstance(c, Node)]
        steps += [(c, depth, inner, seen) for c in reversed(children)]
    base.line()
    while base.done and not base.done[-1]:
        base.done.pop()
    return "\n".join(base.done)


def label_of(node: Node) -> str:
    """What an image or an input shows."""
    attrs = node.attrs
    if node.tag == "img":
        return attrs.get("alt", "") if attrs.get("alt", "").strip() else ""
    kind = attrs.get("type", "").lower()
    if kind in WORDLESS:
        return ""
    if kind in LABELLED:
        return attrs.get("alt" if kind == "image" else "value", "")
    return attrs.get("value") or attrs.get("placeholder", "")


def numbering(ol: Node) -> dict:
    items = sum(c.tag == "li" for c in _elements(ol))
    back = "reversed" in ol.attrs
    return {"next": whole(ol.attrs.get("start"), items if back else 1), "step": -1 if back else 1, "type": ol.attrs.get("type", "1")}


def placed(groups: list[tuple[str, list]]) -> tuple[int, list[tuple[int, int, int, list[str]]]]:
    """Number of rows, and cells as row, first column, column after the last, and lines. The first
    head stands above and the first foot below; no cell reaches out of its group of rows."""
    kinds = [k for k, _ in groups]
    order = sorted(range(len(groups)), key=lambda i: (0 if kinds[i] == "thead" and kinds.index("thead") == i else 2 if kinds[i] == "tfoot" and kinds.index("tfoot") == i else 1, i))
    out, y = [], 0
    for i in order:
        rows, taken = groups[i][1], {}  # column -> row in which it is free again
        for r, row in enumerate(rows):
            x = 0
            for lines, columns, span in row:
                while taken.get(x, 0) > r:
                    x += 1
                until = len(rows) if span == 0 else min(len(rows), r + span)
                out.append((y + r, x, x + columns, lines))
                if until > r + 1:
                    taken.update(dict.fromkeys(range(x, x + columns), until))
                x += columns
        y += len(rows)
    return y, out


def aligned(groups: list[tuple[str, list]]) -> list[str]:
    """Cells padded to the columns' widths, two spaces apart; cells may have several lines."""
    height, cells = placed(groups)
    # columns in which no cell begins are part of the one before
    starts = sorted({x for _, x, _, _ in cells})
    spans = [(y, bisect_left(starts, a), bisect_left(starts, b), lines, max(map(width, lines), default=0)) for y, a, b, lines in cells]
    columns = [0] * len(starts)
    for _, a, b, _, wide in spans:
        if b == a + 1:
            columns[a] = max(columns[a], wide)
    for _, a, b, _, wide in spans:  # cells over several columns widen the last of them
        if b > a + 1:
            room = sum(columns[a:b]) + 2 * max(0, sum(map(bool, columns[a:b])) - 1)
            columns[b - 1] += max(0, wide - room)
    left = [0, *accumulate(c + 2 if c else 0 for c in columns)]
    by_row: list[list] = [[] for _ in range(height)]
    for y, a, _, lines, _ in spans:
        by_row[y].append((left[a], lines))
    out = []
    for row in by_row:
        row.sort(key=lambda c: c[0])
        for k in range(max((len(lines) for _, lines in row), default=0)):
            text, wide = "", 0
            for at, lines in row:
                if k < len(lines):
                    text += " " * (at - wide if at > wide else bool(text) and at < wide) + lines[k]
                    wide = max(at, wide) + width(lines[k])
            if text := text.rstrip():
                out.append(text)
    return out


def html_to_text(html: str | None) -> str | None:
    return None if html is None else render(parse(html))


def extract_text(df: DataFrame, html: str = "html", keep: list[str] | None = None) -> DataFrame:
    """``df`` (its columns ``keep``; all by default) with ``text``, what its pages show."""
    keep = [c for c in keep or df.columns if c not in RESULT]
    schema = extend(df.select(*keep).schema, RESULT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            texts = [html_to_text(t.as_py()) for t in batch.column(batch.schema.get_field_index(html))]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(k)) for k in keep), pa.array(texts, pa.string())], names=schema.names)

    return df.select(*dict.fromkeys([*keep, html])).mapInArrow(run, schema)
