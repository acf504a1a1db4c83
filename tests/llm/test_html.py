import time
from html.parser import HTMLParser

import pytest

from affinia.llm import html_text as H
from tests.llm.data import empty

A = "One, two, three and so on, a sentence of some length that says a little."
B = "Another paragraph, with more commas, and words, which belongs to the text too."
CASES = [
    (None, ""), ("", ""), ("<", "<"), ("no tags &amp; more", "no tags & more"),
    (f"<html><head><title>T</title><style>p{{}}</style><script>var a='</p>'</script></head><body><nav><a href=x>m</a></nav><article><h1>Head</h1><p>{A}<p>{B}</article><footer>f</footer></body></html>", f"Head\n\n{A}\n\n{B}"),
    (f"<body><div class='menu'><a>x</a></div><div id=main><p>{A}</p>\n<p> {B}\n\n x </p></div><div id='comments'><p>{A}</p></div></body>", f"{A}\n\n{B} x"),
    (f"<div><form><p>{A}</p></form><p>{B}</p><aside>{A}</aside><div class='cookie-notice'>{A}</div></div>", B),
    (f"<article><p>{A}</p><ul><li>one</li><li>two</ul><table><tr><td>c1<td>c2</table></article>", f"{A}\n\none\n\ntwo\n\nc1\n\nc2"),
    (f"<article><p>a&nbsp;b &lt;c&gt; &#233; &eacute;<br>next</p><p>{A}</p></article>", f"a b <c> é é next\n\n{A}"),
    (f"<article><p>{A}</p><!-- <p>gone</p> --><ul><li><a href=1>rel one</a></li><li><a href=2>rel two</a></li></ul></article>", A),
    (f"<article><p>{A}</p><div hidden>h</div><div style='display: none'>h</div><p>{B}</p></article><article class='comment'><p>{A}</p></article>", f"{A}\n\n{B}"),
    (f"<div class=x><p>{A}</p></div><div class=x><p>{B}</p></div>", f"{A}\n\n{B}"),
]


@pytest.mark.parametrize("source, want", CASES)
def test_cases(source, want):
    assert H.main_text(source) == want


@pytest.mark.parametrize("source, want", [
    (f"<head><title>x</title><body><article><p>{A}</article>", A),  # the head's end tag is optional
    (f"<html><head><meta charset=x><title>x</title><p>{A}</p><p>{B}", f"{A}\n\n{B}"),
    (f"<head><title>x</title>{A}", A),
    (f"<div><label>Name<p>{A}</p><p>{B}</p></div>", f"{A}\n\n{B}"),
    (f"<div><label>Name <div>{B}</div></label><p>{A}</p></div>", A),  # one with an end tag holds its blocks
    (f"<div><select><option>a<option>b<p>{A}</p></div>", A),
    (f"<div><button>Go<h2>Title</h2><p>{A}</p></div>", f"Title\n\n{A}"),
    (f"<div><p>{'İ' * 60}</p><SCRIPT>x</p></SCRIPT><p>{A}</p></div>", f"{'İ' * 60}\n\n{A}"),  # letters that lower-case to two
    (f"<article><p title='a > b'>{A}</p><p title=\"it's\">{B}</p></article>", f"{A}\n\n{B}"),
    (f"<article><p \"x>{A}</p></article>", A),  # a quote that no = precedes is none
    (f"<article><p>{A} <math><mi>E</mi><mo>=</mo><mi>m</mi><annotation>E=m</annotation></math> long ago</p></article>", f"{A} E=m long ago"),
    (f"<article><p title='x>{A}</p><p title=\"a > b\">{B}</p></article>", f"{A}\n\nb\">{B}"),  # one quote is never closed
    (f"<article><textarea>{B}</textarea><!-- > --><p>{A}</p><!---->1 < 2 <3</article>", f"{A}\n\n1 < 2 <3"),
])
def test_optional_ends_and_odd_markup(source, want):
    assert H.main_text(source) == want


L = " ".join([A, B] * 4)


@pytest.mark.parametrize("source, want", [
    (f"<body><div id='social-history'><h1>T</h1><p>{L}</p><p>{B}</p></div><footer>{A}</footer></body>", f"T\n\n{L}\n\n{B}"),
    (f"<body><form action=x><input name=state><div id=content><p>{L}</p><p>{B}</p></div></form></body>", f"{L}\n\n{B}"),
    (f"<body><div class='search'><div class='legal notice'><div class=share><p>{L}</p></div></div></div><div class=comments><p>{L}</p></div></body>", L),
    (f"<body><form><div class=menu><a href=1>{A}</a></div><div class='comment-list'><p>{L}</p><p>{L}</p></div><p>{B}</p></form></body>", B),
    (f"<body><article><p>{L}</p></article><div class=related><p>{L}</p></div></body>", L),  # enough is left
    (f"<body><div class=cookie-notice hidden><p>{L}</p></div><p>{A}</p></body>", A),  # hidden stays hidden
])
def test_pages_whose_names_mislead_are_not_lost(source, want):
    assert H.main_text(source) == want


def test_no_given_page_is_empty(spark, sf):
    rows = H.op2_html_text(spark, sf).collect()
    assert len(rows) >= 40 and all(r.n_chars for r in rows)


BROKEN = ["<a ", '<div "', "<div><p>x y z, w</p>", '<a =">" ', "<p><dd><figcaption>", "<ul><li>", "<textarea>", "<label>x<p>", "<option>", "<!", "<button><div>", "<div class=share>", f"<form><p>{A}", "<a b='", "<tr><td>", "</p><div>"]


@pytest.mark.parametrize("unit", BROKEN)
def test_broken_markup_takes_time_in_proportion(unit):
    took = []
    for size in (1 << 17, 1 << 20):
        began = time.process_time()
        H.main_text(unit * (size // len(unit)))
        took.append(time.process_time() - began)
    assert took[1] <= max(2.0, 16 * took[0])


def test_deep_and_long_pages_end():
    assert H.main_text("<div>" * 20_000 + A).endswith(A)
    assert len(H.main_text("<article>" + f"<p>{A}</p>" * 20_000 + "</article>").split("\n\n")) == 20_000
    H.main_text("<a " * 5000), H.main_text("<p '" * 2000), H.main_text("<script>" * 100)


def test_odd_rows(spark):
    t = spark.createDataFrame([(1, "u", None, "x"), (None, None, "", "x"), (2, "u", f"<p>{A} 🙂</p>", "x"), (2, "u", f"<p>{A} 🙂</p>", "x")], "page_id long, url string, html string, text string")
    got = H.extract(t).toPandas()
    assert list(got.columns) == ["page_id", "url", "text", "n_chars"] and len(got) == 4
    assert sorted(got.n_chars) == [0, 0, len(A) + 2, len(A) + 2]
    assert H.extract(empty(t)).count() == 0


class Walker(HTMLParser):
    """The same rules on another parser's events, every block climbing to every ancestor."""

    def __init__(self, source):
        super().__init__()
        self.up, self.kind, self.style, self.blocks, self.open, self.buf, self.link, self.linked, self.gone = [-1], ["#root"], [""], [], [0], "", False, 0, 0
        self.feed(source)
        self.close()
        self.flush()

    def flush(self):
        if text := " ".join(self.buf.split()):
            self.blocks.append((self.open[-1], text, min(self.linked, len(text))))
        self.buf, self.linked = "", 0

    def end(self, depth):
        self.flush()
        del self.open[depth:]
        if self.gone and len(self.open) <= self.gone:
            self.gone = 0

    def handle_starttag(self, tag, attrs):
        raw = self.get_starttag_text()[1 + len(tag) : -1]
        if tag == "br" and not self.gone:
            self.buf += " "
        if tag == "a" and not self.gone:
            self.link = True
        drop = not self.gone and (tag in H.RAW or H._dropped(tag, raw))
        if tag in H.BLOCK:
            if not self.gone:
                self.flush()
            if tag in H.CLOSES_P and self.kind[self.open[-1]] == "p":
                self.end(len(self.open) - 1)
        if tag not in H.VOID and (tag in H.BLOCK or drop or self.gone):
            self.up.append(self.open[-1]), self.kind.append(tag), self.style.append(raw)
            if drop:
                self.flush()
                self.gone = len(self.open)
            self.open.append(len(self.up) - 1)

    def handle_endtag(self, tag):
        if tag == "a" and not self.gone:
            self.link = False
        for i in range(len(self.open) - 1, 0, -1):
            if self.kind[self.open[i]] == tag:
                return self.end(i)

    def handle_data(self, data):
        if not self.gone:
            self.buf += data
            self.linked += len(data) if self.link and not data.isspace() else 0

    def above(self, x):
        while x >= 0:
            yield x
            x = self.up[x]

    def text(self):
        size = lambda x: sum(len(t) for b, t, _ in self.blocks if x in self.above(b))

        def points(x):
            got = 0.0
            for b, t, _ in self.blocks:
                far = {y: d for d, y in enumerate(self.above(b), self.kind[b] in H.CONTAINER and self.kind[b] != "td")}.get(x, 0)
                got += (min(len(t) / 100, 3.0) + t.count(",") + (1.0 if len(t) >= 25 else 0.1)) * (0.5 ** (far - 1) if far else 0)
            return got

        share = lambda x: sum(k for b, _, k in self.blocks if x in self.above(b)) / max(1, size(x))
        worth = lambda x: (points(x) + H.CONTAINER[self.kind[x]]) * (1 - share(x))
        holders = {x: worth(x) for x in range(len(self.up)) if self.kind[x] in H.CONTAINER and size(x)}
        best = max(holders, key=lambda x: (holders[x], -x))
        near = lambda x: (self.kind[x], self.style[x]) == (self.kind[best], self.style[best]) or holders.get(x, 0) >= max(10, 0.2 * holders[best]) or (size(x) > 80 and self.kind[x] in ("p", "pre", "blockquote"))
        keep = {best} | {x for x in range(len(self.up)) if x != best and self.up[x] == self.up[best] and size(x) and share(x) < 0.33 and near(x)}

        def inside(x):
            for y in self.above(x):
                if y in keep:
                    return True
                if self.kind[y] in ("ul", "ol", "dl", "table") and share(y) > 0.66:
                    return False
            return False

        return "\n\n".join(t for b, t, _ in self.blocks if inside(b))


def test_all_pages_against_another_walk(spark, sf):
    pages = [r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect() if r.html]
    assert len(pages) >= 40
    for source in pages:
        assert H.main_text(source) == Walker(source).text()
