"""Tables, heads and depths of pages; visible words against a plain second reader."""

import random
from html.parser import HTMLParser

import pytest

from arrearly.llm.html_text import WIDEST, html_text


def table(*rows):
    return "<table>" + "".join(f"<tr>{r}</tr>" for r in rows) + "</table>"


def td(text, **spans):
    return "<td" + "".join(f" {k}={v}" for k, v in spans.items()) + f">{text}</td>"


def test_rowspan_keeps_the_columns_below():
    page = table(td("a", rowspan=2) + td("b1") + td("c1"), td("b2") + td("c2"), td("d") + td("e") + td("f"))
    assert html_text(page) == "a  b1  c1\n   b2  c2\nd  e   f"


def test_rowspan_ends_with_its_rows_group():
    page = "<table><thead><tr><th rowspan=9>h<th>i</thead><tbody><tr><td>a<td>b</tbody></table>"
    assert html_text(page) == "h  i\na  b"
    assert html_text(table(td("a", rowspan=0) + td("b"), td("c"), td("d"))) == "a  b\n   c\n   d"


def test_rowspan_and_colspan_together():
    page = table(
        td("a", rowspan=2, colspan=2) + td("b"), td("c"), td("d") + td("e") + td("f"),
    )
    assert html_text(page) == "a     b\n      c\nd  e  f"


@pytest.mark.parametrize("n", [100, 101, 1000, 4000, 1234567])
def test_long_colspans(n):
    page = table(td("a", colspan=n) + td("b"), td("c") + td("d"))
    assert html_text(page).splitlines()[0].split() == ["a", "b"]


def test_a_spanning_cell_stands_in_its_first_column():
    page = table(td("a title", colspan=2) + td("x"), td("one") + td("two") + td("three"))
    assert html_text(page) == "a title       x\none      two  three"


def test_wide_cells_are_wrapped_and_the_next_column_is_aligned():
    wide = " ".join(f"word{i}" for i in range(30))
    page = table(td(wide) + td("x") + td("y"), td("short") + td("z") + td("w"))
    lines = html_text(page).splitlines()
    at = lines[0].index("  x") + 2
    assert lines[-1].index("z") == at and lines[-1].index("w") == lines[0].index("y")
    assert at <= WIDEST + 2
    assert " ".join(x[:at].strip() for x in lines[:-1]) == wide


def test_a_word_is_never_broken():
    word = "x" * 200
    lines = html_text(table(td(word) + td("a"), td("b") + td("c"))).splitlines()
    assert lines[0].split() == [word, "a"] and lines[1].split() == ["b", "c"]


def test_text_closes_the_head():
    assert html_text("<head><title>t</title>Visible text") == "Visible text"
    assert html_text("<head><title>t</title> <meta x>\n<p>Visible") == "Visible"
    assert html_text("<head><style>p{}</style><script>x</script></head>Seen") == "Seen"


@pytest.mark.parametrize("depth", [510, 511, 512, 600, 3000])
def test_hidden_below_any_depth(depth):
    page = (
        "<div>" * depth + "<p hidden>no</p>yes <span style='display:none'>no<b>no</b></i></span> and <b>more</b>"
        + "<div hidden>no<div>no</div>no</div> end" + "</div>" * depth + "<p>after</p>"
    )
    assert html_text(page).split() == ["yes", "and", "more", "end", "after"]


def test_blocks_below_any_depth_break_lines():
    page = "<div>" * 600 + "one<div>two</div>three" + "</div>" * 600
    assert html_text(page).split("\n") == ["one", "two", "three"]


def test_many_unmatched_end_tags_are_quick():
    assert html_text("<a>" * 60_000 + "</b>" * 60_000 + "text") == "text"


class Reader(HTMLParser):
    """Words outside hidden elements, by counting open ones."""

    def __init__(self):
        super().__init__()
        self.words, self.open = [], []

    def handle_starttag(self, tag, attrs):
        if tag not in ("br", "img"):
            attrs = dict(attrs)
            hidden = "hidden" in attrs or "none" in (attrs.get("style") or "") or tag in ("script", "style", "head")
            self.open.append((tag, hidden or bool(self.open and self.open[-1][1])))

    def handle_endtag(self, tag):
        if any(t == tag for t, _ in self.open):
            while self.open.pop()[0] != tag:
                pass

    def handle_data(self, data):
        if not (self.open and self.open[-1][1]):
            self.words += data.split()


def page(rng, depth=0):
    """Well-formed random markup."""
    out = []
    for _ in range(rng.randint(1, 4)):
        kind = rng.random()
        if kind < 0.4 or depth > 7:
            out.append(" " + " ".join(f"w{rng.randrange(999)}" for _ in range(rng.randint(1, 5))) + " ")
        elif kind < 0.5:
            rows = [
                [f"<td{rng.choice(['', ' colspan=2', ' rowspan=2'])}>{page(rng, 8)}</td>" for _ in range(rng.randint(1, 4))]
                for _ in range(rng.randint(1, 3))
            ]
            out.append(table(*map("".join, rows)))
        else:
            tag = rng.choice(["div", "section", "span", "b", "ul", "blockquote", "article"])
            extra = rng.choice(["", "", "", " hidden", " style='display:none'", " class=x"])
            inner = page(rng, depth + 1)
            out.append(f"<{tag}{extra}>{'<li>' + inner + '</li>' if tag == 'ul' else inner}</{tag}>")
    return "".join(out)


@pytest.mark.parametrize("seed", range(300))
def test_visible_words_of_random_pages(seed):
    """All visible words and no others; rows of cells may change their order by lines."""
    html = page(random.Random(seed))
    reader = Reader()
    reader.feed(html)
    found = [w for w in html_text(html).split() if w != "-"]
    assert sorted(found) == sorted(reader.words)
    if "<table" not in html:
        assert found == reader.words
