"""Main text of web pages by tree scoring.

A page is read into a tree of block elements, without those that hold menus, notices, forms and the like. Each block of
text passes points for its length and commas to the elements around it, half as many to each further one; a container's
points are discounted by the share of its text that is links. The best container is kept, with those of its siblings that
look like more of the same text.

A name may mislead: a whole page may stand in one form, or in an element called social-history. Where little is left beside
what was dropped for its name, the elements that hold most of the sentences stay, and what is dropped inside them is judged
by itself. Comments never do. Fallback text of scripts, frames and media is no part of the page; MathML is text.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from affinia.session import bound_batches, table

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_MARK = re.compile(r"""["'>]""")
_ATTR = re.compile(r"""([a-zA-Z:_-]+)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split()
)
CLOSES_P = BLOCK - frozenset("body html dd dt li td th tr tbody thead tfoot caption legend summary figcaption".split())
#: Where an element of a list, table or menu is ended by the next: kinds that a tag ends, and where that stops.
ENDED_BY = {"p": "p", "li": "li", "dt": "d", "dd": "d", "tr": "row", "td": "cell", "th": "cell", "option": "option"}
ENDS = {"p": ("p",), "li": ("li",), "d": ("dt", "dd"), "row": ("tr", "td", "th"), "cell": ("td", "th"), "option": ("option",)}
STOPS = {"p": ("td", "th", "article", "div", "section", "body", "main"), "li": ("ul", "ol", "menu"), "d": ("dl",), "row": ("table",), "cell": ("tr", "table"), "option": ("select",)}
KINDS = {k: i for i, k in enumerate(ENDS)}
NEAR = {t: [(i, True) for k, i in KINDS.items() if t in ENDS[k]] + [(i, False) for k, i in KINDS.items() if t in STOPS[k] and t not in ENDS[k]] for t in {x for v in (*ENDS.values(), *STOPS.values()) for x in v}}
#: What may stand in a head; anything else ends it. Of LOOSE, one without an end tag ends at the next block.
IN_HEAD = frozenset("head title meta link script style base noscript template noframes".split())
LOOSE = frozenset("label option select button".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe textarea title svg annotation annotation-xml object noembed noframes xmp canvas audio video".split())
DROP = frozenset("nav header footer aside form button select option fieldset label menu dialog head datalist input".split())
ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar toolbar form status".split())
_BAD = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|adbox|adslot|sponsor\w*|promo\w*|banner\w*|comments?|commentlist|comment-?\w*|disqus\w*|respond|replies|reply|"
    r"sidebar\w*|side-?bar|side-?nav|widget\w*|menu\w*|nav|navbar|navigation|subnav|topnav|breadcrumbs?|footer\w*|header|site-?header|page-?header|masthead|topbar|"
    r"cookies?|cookie\w*|consent|gdpr|notices?|notifications?|alerts?|popup\w*|modal\w*|overlay|newsletter\w*|subscribe\w*|subscription|signup|sign-?up|login|"
    r"share|sharing|sharebar|social\w*|related\w*|recommended|recommendations|pagination|pager|search|searchbox|toolbar|skip-?link|copyright|disclaimer|legal|feedback)(?=$|[\s_-])",
    re.I,
)
_COMMENT = re.compile(r"(?:^|[\s_-])(?:comments?|commentlist|disqus\w*|reply|replies)(?=$|[\s_-])", re.I)
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
CONTAINER = {"article": 25.0, "main": 25.0, "section": 3.0, "div": 5.0, "td": 3.0, "blockquote": 3.0, "body": 0.0}


def _dropped(tag: str, attrs: str) -> bool:
    if tag in DROP:
        return True
    if not attrs or attrs.isspace() or tag in ("html", "body"):
        return False
    bad = _COMMENT if tag in ("article", "main") else _BAD
    for m in _ATTR.finditer(attrs):
        name = m.group(1).lower()
        value = m.group(2) or m.group(3) or m.group(4) or ""
        if name in ("class", "id"):
            if bad.search(value):
                return True
        elif name == "role":
            if value.lower() in ROLES:
                return True
        elif name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and _HIDDEN.search(value)):
            return True
    return False


#: Letters of a stretch of text that counts as a sentence, and the share of these that is little.
SENTENCE, LITTLE = 25, 0.25


def _spared(tag: str, attrs: str) -> bool:
    """Whether an element that is dropped may hold the main text after all: one named by a word that isn't of comments, or a form."""
    named = [m for m in _ATTR.finditer(attrs) if m.group(1).lower() in ("class", "id")]
    if any(_COMMENT.search(m.group(2) or m.group(3) or m.group(4) or "") for m in named):
        return False
    for m in reversed(named):
        attrs = attrs[: m.start()] + attrs[m.end() :]
    return (tag == "form" or tag not in DROP) and not _dropped("div", attrs)


class _Page:
    """Tree of blocks. parent, tag and style are by element; a block is (element, text, letters in links).

    Reading takes time in proportion to the page however broken its markup is: what a search found missing is not
    sought again, and what may end an element is kept with each open one.
    """

    def __init__(self, source: str, spare: frozenset[int] = frozenset(), every: bool = False):
        """spare has the places of elements that stay though their names say otherwise; with every, all of them stay."""
        self.parent, self.tag, self.style = [-1], ["#root"], [""]
        self.blocks: list[tuple[int, str, int]] = []
        self.source, self.quotes, self.missing = source, True, set()
        self.spare, self.every = spare, every
        self.lost: list[list] = []  # of each element dropped: place, tag, attributes, letters of sentences
        self._read(source)

    def _tag_end(self, at: int) -> int:
        """Place of the > that ends a tag, -1 if there is none. One in a quoted value doesn't, unless no other does: a quote
        that never closes makes all quotes of the rest of the page plain characters."""
        source = self.source
        first = source.find(">", at)
        if first < 0 or not self.quotes or (source.find('"', at, first) < 0 and source.find("'", at, first) < 0):
            return first
        pos = at
        while m := _MARK.search(source, pos):
            k = m.start()
            if source[k] == ">":
                return k
            pos, j = k + 1, k - 1
            while source[j].isspace():
                j -= 1
            if source[j] == "=":  # only there does a quote begin a value
                close = source.find(source[k], pos)
                if close < 0:
                    break
                pos = close + 1
        self.quotes = False
        return first

    def _next(self, pattern: str, at: int) -> re.Match | None:
        if pattern in self.missing:
            return None
        found = re.compile(pattern, re.I | re.A).search(self.source, at)
        if not found:
            self.missing.add(pattern)
        return found

    def _read(self, source: str) -> None:
        stack, gone, parts, linked, links = [0], 0, [], 0, 0  # gone: depth in the stack at which dropping began
        near, opened, loose = [(-1,) * len(KINDS)], {}, False  # by open element the nearest one of each kind

        def flush():
            nonlocal linked
            if parts:
                text = " ".join(html.unescape("".join(parts)).split())
                if text:
                    self.blocks.append((stack[-1], text, min(linked, len(text))))
                parts.clear()
                linked = 0

        def close(depth: int):
            nonlocal gone
            flush()
            for x in stack[depth:]:
                opened[self.tag[x]] -= 1
            del stack[depth:], near[depth:]
            if gone and len(stack) <= gone:
                gone = 0

        at, n = 0, len(source)
        while True:
            # Text up to the next tag, end tag, comment or declaration.
            lt, name, stop = at, None, -1
            while (lt := source.find("<", lt)) >= 0:
                ending = source.startswith("/", lt + 1)
                name = _NAME.match(source, lt + 1 + ending)
                if name:
                    stop = self._tag_end(name.end())
                elif source.startswith("<!--", lt):
                    stop = source.find("-->", lt + 2) + 2
                    stop = n - 1 if stop < 2 else stop
                elif source.startswith(("<!", "<?"), lt):
                    stop = source.find(">", lt)
                else:
                    lt += 1
                    continue
                if stop < 0:
                    lt = -1  # nothing ends a tag from here on
                break
            text = source[at : lt if lt >= 0 else n]
            if text and gone and self.tag[stack[gone]] == "head" and not text.isspace():
                close(gone)
            if gone and len(text) >= SENTENCE and self.tag[stack[-1]] != "a" and len(text.strip()) >= SENTENCE:
                self.lost[-1][3] += len(text.strip())
            if text and not gone:
                parts.append(text)
                if links and not text.isspace():
                    linked += len(text)
            if lt < 0:
                break
            at = stop + 1
            if not name:
                continue
            tag, attrs = name.group().lower(), source[name.end() : stop]
            if gone and not ending and self.tag[stack[gone]] == "head" and tag not in IN_HEAD:
                close(gone)
            if tag in RAW:
                if not ending and not attrs.endswith("/"):
                    end = self._next("</" + tag, at)
                    if not end:
                        if tag in ("script", "style"):
                            at = n
                        continue
                    at = source.find(">", end.start()) + 1 or n
                continue
            if tag == "br":
                if not gone:
                    parts.append(" ")
                continue
            if tag == "a" and not gone:
                links = 0 if ending else 1
                if ending or not attrs or not _dropped(tag, attrs):
                    continue
            if ending:
                if tag in BLOCK or gone:
                    if opened.get(tag):
                        i = len(stack) - 1
                        while self.tag[stack[i]] != tag:
                            i -= 1
                        close(i)
                        if tag in BLOCK:
                            links = 0
                    elif tag in BLOCK and not gone:
                        flush()
                continue
            if gone and loose and tag in BLOCK:
                close(gone)
            drop = not gone and _dropped(tag, attrs) and not (lt in self.spare or self.every and _spared(tag, attrs))
            if tag not in BLOCK and not drop and not (gone and tag not in VOID):
                continue
            if tag in BLOCK:
                if not gone:
                    flush()
                links = 0
                if tag in CLOSES_P and (i := near[-1][KINDS["p"]]) > gone:
                    close(i)
                if tag in ENDED_BY and tag != "p" and (i := near[-1][KINDS[ENDED_BY[tag]]]) > gone:
                    close(i)
                    if tag == "tr" and self.tag[stack[-1]] == "tr" and len(stack) - 1 > gone:
                        close(len(stack) - 1)
            elif tag == "option" and (i := near[-1][KINDS["option"]]) > gone:
                close(i)
            if tag in VOID or (attrs.endswith("/") and tag not in BLOCK):
                continue
            if drop:
                flush()
                self.lost.append([lt, tag, attrs, 0])
            self.parent.append(stack[-1])
            self.tag.append(tag)
            self.style.append(attrs)
            stack.append(len(self.tag) - 1)
            opened[tag] = opened.get(tag, 0) + 1
            if tag in NEAR:
                mine = list(near[-1])
                for i, sets in NEAR[tag]:
                    mine[i] = len(stack) - 1 if sets else -1
                near.append(tuple(mine))
            else:
                near.append(near[-1])
            if drop:
                gone = len(stack) - 1
                loose = tag in LOOSE and not ((m := self._next(rf"</?{tag}(?=[\s/>])", at)) and m.group().startswith("</"))
        flush()

    def text(self) -> str:
        if not self.blocks:
            return ""
        n = len(self.tag)
        points, size, linked = [0.0] * n, [0] * n, [0] * n
        passed = [0.0] * n
        for node, text, links in self.blocks:
            worth = min(len(text) / 100, 3.0) + text.count(",") + (1.0 if len(text) >= 25 else 0.1)
            size[node] += len(text)
            linked[node] += links
            if self.tag[node] in CONTAINER and self.tag[node] != "td":
                points[node] += worth  # text of its own
                passed[node] += worth / 2
            else:
                passed[node] += worth
        for x in range(n - 1, 0, -1):  # the next element gets all, each further one half of what the one before it got
            points[self.parent[x]] += passed[x]
            passed[self.parent[x]] += passed[x] / 2
            size[self.parent[x]] += size[x]
            linked[self.parent[x]] += linked[x]
        worth = lambda x: (points[x] + CONTAINER.get(self.tag[x], 0.0)) * (1 - linked[x] / max(1, size[x]))
        holders = [x for x in range(n) if self.tag[x] in CONTAINER and size[x]]
        if not holders:
            keep = {0}
        else:
            best = max(holders, key=lambda x: (worth(x), -x))
            keep, top = {best}, worth(best)
            for x in range(n):
                if x != best and self.parent[x] == self.parent[best] and size[x]:
                    share = linked[x] / size[x]
                    alike = self.tag[x] == self.tag[best] and self.style[x] == self.style[best]
                    if share < 0.33 and (alike or worth(x) >= max(10.0, 0.2 * top) or (size[x] > 80 and self.tag[x] in ("p", "pre", "blockquote"))):
                        keep.add(x)
        inside = [False] * n
        for x in range(n):
            inside[x] = x in keep or (self.parent[x] >= 0 and inside[self.parent[x]])
            if inside[x] and x not in keep and self.tag[x] in ("ul", "ol", "dl", "table") and size[x] and linked[x] / size[x] > 0.66:
                inside[x] = False  # a menu without a name
        return "\n\n".join(t for x, t, _ in self.blocks if inside[x])


def _unburied(source: str) -> _Page:
    """The page, read again where little but what has been dropped for its name is left: with the elements that hold most of
    its sentences, and if these are named so all the way down, with all such."""
    page = _Page(source)
    for last in (False, True):
        kept = sum(len(t) - k for _, t, k in page.blocks if len(t) >= SENTENCE)
        lost = [(at, n) for at, tag, attrs, n in page.lost if n and _spared(tag, attrs)]
        total = kept + sum(n for _, n in lost)
        if not lost or kept >= LITTLE * total:
            break
        most = frozenset(at for at, n in lost if 2 * n > total)
        page = _Page(source, every=True) if last or not most else _Page(source, page.spare | most)
    return page


def main_text(source: str | None) -> str:
    """Main text of a page; empty for null, for an empty page and for one without text."""
    return _unburied(source).text() if source else ""


def extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """pages with text and n_chars (code points) for the html; columns of these names are replaced, the rest stay.

    A null html counts as empty. Repeated rows give equal rows, an empty table none.
    """
    bound_batches(pages.sparkSession)
    pages = pages.drop("text", "n_chars")
    at = pages.columns.index(html_col)
    schema = pages.drop(html_col).withColumns({"text": F.lit(""), "n_chars": F.lit(0).cast("long")}).schema

    def run(batches):
        for b in batches:
            texts = [main_text(h) for h in b.column(at).to_pylist()]
            rest = [c for i, c in enumerate(b.columns) if i != at]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[f.name for f in schema])

    return pages.mapInArrow(run, schema)


def op2_html_text(spark, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
