"""Visibility and layout of HTML, by cases and against generated pages whose visible words are known."""

import random

import pytest

from tidemark.llm.html_text import html_to_text, selector, whole

CASES = [
    # the cascade
    ("<style>@media print{.x{display:none}}</style><p class=x>a", "a"),
    ("<style media=print>p{display:none}</style><p>a", "a"),
    ("<style>@media screen and (min-width:600px){.x{display:none}}</style><p class=x>no</p>a", "a"),
    ("<style>@media not screen, (max-width: 20em){p{display:none}}</style><p>a", "a"),
    ("<style>@import 'x';@font-face{src:x}@supports (a:b){@media all{.x{display:none}}}</style><i class=x>no</i>a", "a"),
    ("<style>.x{display:none}.x{display:block}</style><p class=x>a", "a"),
    ("<style>#i{display:none}p.x{display:block}</style><p class=x id=i>no</p>a", "a"),
    ("<style>.x{display:none}</style><p class=x style='display:block'>a", "a"),
    ("<style>p{display:none!important}</style><p style='display:block'>no", ""),
    ("<style>p{display:none}p{display:nonsense}</style><p>no", ""),
    ("<p hidden style='display:block'>a<p hidden>no", "a"),
    ("<style>/* .q */ /*c*/.x{display:none}</style><p class=x>no</p>a", "a"),
    ("<style>.x{/* display:none */}</style><p class=x>a", "a"),
    ("<style>.y::after{content:'}'}.x{display:none}</style><p class=x>no</p>a", "a"),
    # selectors
    ("<style>div.a.b{display:none}</style><div class='b a'>no</div><div class=a>a", "a"),
    ("<style>.m .x{display:none}</style><div class=m><i><b class=x>no</b></i></div><b class=x>a", "a"),
    ("<style>.m>.x{display:none}</style><div class=m><i><b class=x>a</b></i><b class=x>no</b></div>", "a"),
    ("<style>h1+p~p{display:none}</style><h1>a</h1><p>b<p>no", "a\n\nb"),
    ("<style>[data-x^='a'],[lang|=en]{display:none}</style><i data-x=ab>no</i><i lang=en-GB>no</i><i data-x=b>a</i>", "a"),
    ("<style>li:nth-child(2n+1){display:none}</style><ul><li>no<li>a<li>no</ul>", "- a"),
    ("<style>a:not(.k)>b{display:none}</style><a><b>no</b></a><a class=k><b>x</b></a>", "x"),
    ("<style>:is(.a,.b) i:first-child{display:none}</style><p class=b><i>no</i><i>a</i>", "a"),
    ("<style>p:hover,p::before{display:none}.sm\\:x{display:none}</style><p>a<b class='sm:x'>no</b>", "a"),
    # inherited visibility
    ("<div style='visibility:hidden'>no<b style='visibility:visible'>a</b></div>", "a"),
    ("<style>div{visibility:hidden}p{visibility:visible}</style><div>no<ul><li>no</ul><hr><p>a</div>", "a"),
    # tables
    ("<table><tr><td rowspan=2>A<td>B<tr><td>C</table>", "A  B\n   C"),
    ("<table><tr><td>A<td rowspan=0>B<tr><td>C<tr><td>D<td>E</table>", "A  B\nC\nD     E"),
    ("<table><tbody><tr><td rowspan=9>A<td>B<tbody><tr><td>C<td>D</table>", "A  B\nC  D"),
    ("<table><tr><td colspan=1000000>a<td>b</table>", "a  b"),
    ("<table><tr><td colspan=60>wide cell<td>b<tr>" + "<td>c" * 60 + "<td>d</table>", "wide cell" + " " * 171 + "b\n" + "c  " * 60 + "d"),
    ("<table><tfoot><tr><td>f</tfoot><thead><tr><td>h<tbody><tr><td>b</table>", "h\nb\nf"),
    ("<table>x<tr><td>y</table>", "x\n\ny"),
    ("<table><tr><b>x</b><td>y</table>z", "x\n\ny\n\nz"),
    ("<table><td>a<table><td>b</table></table>", "a\nb"),
    ("<table><tr><td>a<div>b<td>c</table>", "a  c\nb"),
    ("<tr><td>a</td></tr>b", "ab"),
    # lists
    ("<ol><li value=5>a<li>b</ol>", "5. a\n6. b"),
    ("<ol start=123456789><li>a</ol>", "123456789. a"),
    ("<ol start=99999999999><li>a</ol>", "1. a"),
    ("<ol reversed><li>a<li>b</ol>", "2. a\n1. b"),
    ("<ol type=a start=27><li>x<li>y</ol><ol type=I start=9><li>z</ol>", "aa. x\nab. y\n\nIX. z"),
    ("<ol><div><li>a</div><li>b<ul><li>c</ul><li>d</ol>", "1. a\n2. b\n   - c\n3. d"),
    # fields
    ("<textarea>\na\nb</textarea>", "a\nb"),
    ("<input value=a><input placeholder=b><input type=password value=no><textarea placeholder=c></textarea>", "a b c"),
    ("<map>a</map><progress>no</progress>", "a"),
    ("<span style='display:block'>a</span>b<div style='display:inline'>c</div>", "a\nbc"),
]


@pytest.mark.parametrize("page, want", CASES)
def test_cases(page, want):
    assert html_to_text(page) == want


def generated(rng):
    """A page, and the words that a browser shows, in order. How an element is hidden is dealt at
    random; what the rules say is kept apart from how the tree is walked."""
    css, words, count = [], [], iter(range(1 << 30))

    def style(kind, name):
        hides = {"class": f".{name}", "id": f"#{name}", "two": f"div.{name}.extra", "within": f"section .{name}", "attr": f"[data-n='{name}']"}
        css.append((hides[kind], rng.choice(["display:none", "DISPLAY : none", "color:red;display:none;top:0"])))

    def word(seen):
        w = f"w{next(count)}"
        if seen:
            words.append(w)
        return w

    def node(depth, seen, gone):
        out = []
        for _ in range(rng.randint(1, 4)):
            pick = rng.random()
            if depth == 0 or pick < 0.3:
                out.append(f" {word(seen and not gone)} ")
                continue
            name, kind = f"n{next(count)}", rng.choice(["none", "none", "none", "inline", "hidden", "class", "id", "two", "within", "attr", "media", "beaten", "unseen", "seen", "comment", "script", "table", "list"])
            attrs, more, now = "", gone, seen
            if kind == "inline":
                attrs, more = " style='display:none'", True
            elif kind == "hidden":
                attrs, more = " hidden", True
            elif kind in ("class", "id", "two", "within", "attr"):
                attrs = {"class": f" class='{name}'", "id": f" id='{name}'", "two": f" class='extra {name}'", "within": f" class='{name}'", "attr": f" data-n='{name}'"}[kind]
                more = True
                style(kind, name)
            elif kind == "media":
                attrs = f" class={name}"
                css.append(("@media print{." + name, "display:none}"))
            elif kind == "beaten":
                attrs = f" class={name} id={name}"
                css.append((f"#{name}", "display:block"))
                css.append((f".{name}", "display:none"))
            elif kind == "unseen":
                attrs, now = " style='visibility:hidden'", False
            elif kind == "seen":
                attrs, now = " style='visibility:visible'", True
            elif kind == "comment":
                out.append(f"<!-- {word(False)} <p> -->")
                continue
            elif kind == "script":
                out.append(f"<script>if (a<b) '{word(False)}'</script>")
                continue
            elif kind == "table":
                cells = "".join("<tr>" + "".join(f"<td>{word(seen and not gone)}" for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(1, 3)))
                out.append(f"<table>{cells}</table>")
                continue
            elif kind == "list":
                items = "".join(f"<li>{word(seen and not gone)}{rng.choice(['', '</li>'])}" for _ in range(rng.randint(1, 3)))
                out.append(f"<ul>{items}</ul>")
                continue
            inner = node(depth - 1, now, more)
            out.append(f"<div{attrs}>{inner}</div>")
        return "".join(out)

    body = node(rng.randint(1, 5), True, False)
    rng.shuffle(css)
    # of a beaten pair the id wins in any order; a rule for print needs its own closing brace
    sheet = " /* x{} */ ".join(f"{s} {{ {d} }}" for s, d in css)
    return f"<html><head><title>no</title><style>{sheet}</style></head><body><section>{body}</section></body></html>", words


def test_generated_pages():
    rng = random.Random(4)
    for _ in range(1500):
        page, want = generated(rng)
        assert [w for w in html_to_text(page).split() if w != "-"] == want, page


def test_odd_style_never_raises():
    rng = random.Random(5)
    bits = ["{", "}", "@media", "(", ")", ";", ":", "display", "none", ".x", "#y", "/*", "*/", "'", '"', "\\", ",", ">", "+", "~", "[a", "=", "]", ":not(", "nth-child(", "2n", " ", "p", "!important", "min-width", "3..5px"]
    for _ in range(4000):
        style = "".join(rng.choice(bits) for _ in range(rng.randint(0, 25)))
        html_to_text(f"<style>{style}</style><p class=x id=y style=\"{style.replace(chr(34), '')}\">a")
        selector(style)
    assert [whole(t, 7) for t in (None, "", " 5x", "-3", "99999999999999999999", "٣")] == [7, 7, 5, -3, 7, 7]


def test_long_page():
    page = "<style>.x{display:none}</style>" + "<p class=x>no</p><p>word " * 40_000
    assert html_to_text(page).split() == ["word"] * 40_000


def test_query_equals_a_plain_parser(spark, data):
    """On the supplied pages, which hide nothing by style, the words are those outside of head, script
    and style, in order."""
    from html.parser import HTMLParser

    from tidemark.llm import queries

    class Plain(HTMLParser):
        def __init__(self):
            super().__init__()
            self.inside, self.words = 0, []

        def handle_starttag(self, tag, attrs):
            self.inside += tag in ("head", "script", "style")

        def handle_endtag(self, tag):
            self.inside -= tag in ("head", "script", "style")

        def handle_data(self, text):
            if not self.inside:
                self.words.append(text)

    pages = {r.page_id: r.html for r in spark.read.parquet(f"{data}/pages.parquet").collect()}
    for r in queries.op6_html_text(spark, data).collect():
        plain = Plain()
        plain.feed(pages[r.page_id] or "")
        plain.close()
        assert "".join("".join(line.removeprefix("- ").split()) for line in (r.text or "").split("\n") if line != "----") == "".join("".join(plain.words).split()), r.page_id
