"""HTML extraction: attribute states, styles, drawings, and pages whose depth or width must not cost its square."""

from __future__ import annotations

import random
import time

import pytest

from lumenry.llm.html_text import ALIGNED, INDENTS, text_of

PAGES = {
    "<p class=it's>hello</p>": "hello",
    "<p class=a\"b>one</p><p>two": "one\n\ntwo",
    "a <a title=\"x>link</a> more": "a",
    "a <a title='x > y' href=/z>link</a> more": "a link more",
    "<p a = 'x>y' b>one<br/>two": "one\ntwo",
    "<p =x>one</p>": "one",
    "1 < 2 <3 </ p>4": "1 < 2 <3 4",
    "<!-->shown<!-- a --!>too": "showntoo",
    "x<b": "x",
    "<style>@media print { .note { display:none } } .a { display:none }</style><p class=note>note</p><p class=a>a": "note",
    "<style>@media (max-width: 9px) { p { display:none } }</style><p>wide": "wide",
    "<style>@media screen { .b { display:none } }</style><p class=b>b</p>c": "c",
    "<style>.x{display:none} .x{display:block}</style><p class=x>later": "later",
    "<style>.x{display:none !important} .x{display:block}</style><p class=x>never</p>seen": "seen",
    "<style>.x{display:none} #i{display:inline}</style><p class=x id=i>heavier": "heavier",
    "<style>.x{display:none}</style><p class=x style='display:block'>own": "own",
    "<style>/* .x{display:none} */ .y{visibility:hidden}</style><p class=x>one</p><p class=y>two <b style='visibility:visible'>three": "one\n\nthree",
    "<style>@import url(x); p.x { color: red; display: none }</style><p class=x>gone</p>kept": "kept",
    "<svg><title>no</title><desc>no</desc><rect/>no<text>label <tspan>two</tspan></text></svg> after": "label two after",
    "<math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>no</annotation></math>": "x=2",
    "<p hidden>no</p><div hidden style='display:block'>yes</div>": "yes",
    "<ul><li>a<ol start=3><li>b<li>c</ol><li>d</ul>": "- a\n  3. b\n  4. c\n- d",
    "<table><tr><td>a<td>bb<tr><td>ccc<td>d</table>": "a    bb\nccc  d",
    "<table><tr><td>a<table><tr><td>in<td>ner</table><td>b</table>": "a        b\n\nin  ner",
    "<p>one<div>two</div>three": "one\n\ntwo\nthree",
    "<dl><dt>t<dd>d<dt>u<dd>e</dl>": "t\n  d\nu\n  e",
    "<pre>\n a\n  b</pre>": "a\n  b",
    "<select><option>a<option>b</select>": "a\nb",
    "<details><summary>s</summary>no</details><details open><summary>t</summary>yes</details>": "s\nt\nyes",
    "&lt;b&gt; &amp;amp; &copy;": "<b> &amp; ©",
}


@pytest.mark.parametrize("page", PAGES)
def test_pages(page):
    assert text_of(page).strip() == PAGES[page]


@pytest.mark.parametrize("unit", ("<div>x", "<p><div>", "<ul><li>x", "<b>", "<p><a>", "<blockquote>x", "<button><p>", "<svg><text>", "<td>", "</p>", "<a b=\"", "<dl><dd>x"))
def test_time_grows_with_the_page(unit):
    def took(n):
        page = unit * n
        began = time.process_time()
        text_of(page)
        return time.process_time() - began

    took(2000)
    small, large = min(took(10_000), took(10_000)), took(40_000)
    assert large < 12 * small + 0.5, (small, large)


def test_very_deep():
    page = "<div>" * 200_000 + "end" + "</div>" * 200_000
    began = time.process_time()
    assert text_of(page) == "end"
    assert time.process_time() - began < 60


def test_deep_lists_and_tables_keep_their_text():
    deep = text_of("".join(f"<ul><li>w{k}" for k in range(3 * INDENTS)))
    assert deep.split() == [x for k in range(3 * INDENTS) for x in ("-", f"w{k}")]
    tables = text_of("".join(f"<table><tr><td>w{k}<td>" for k in range(5 * ALIGNED)))
    assert tables.split() == [f"w{k}" for k in range(5 * ALIGNED)]
    long = text_of("<table>" + f"<tr><td>{'x' * 50_000}<td>y" + "<tr><td>a<td>b" * 1000 + "</table>")
    assert len(long) < 250_000 and long.count("b") == 1000


def test_any_markup_gives_its_words():
    """Random pages of known visibility: all words that show, in order, and no other."""
    rng = random.Random(4)
    for _ in range(300):
        out, want, open_ = [], [], []
        for k in range(rng.randrange(40)):
            hidden = any(h for _, h in open_)
            kind = rng.randrange(6)
            if kind < 3:
                out.append(f" w{k} ")
                if not hidden:
                    want.append(f"w{k}")
            elif kind < 5:
                tag = rng.choice(["div", "span", "section", "b", "article"])
                attr, hides = rng.choice([("", False), (" hidden", True), (" style=display:none", True), (" class='x>y'", False), (" title=a'b\"c", False), (" class=gone", True)])
                out.append(f"<{tag}{attr}>")
                open_.append((tag, hides))
            elif open_:
                out.append(f"</{open_.pop()[0]}>")
        assert text_of("<style>.gone{display:none}</style>" + "".join(out)).split() == want
