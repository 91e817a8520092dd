"""The card reader against a plain tree of the same markup."""

from __future__ import annotations

import random
from html.parser import HTMLParser

import numpy as np
import pytest

from bidlens.sources import cards

BIDS = "su-styled-text secondary large"


class Node:
    def __init__(self, name, attributes=(), parent=None):
        self.name, self.attributes, self.parent, self.children = name, dict(attributes), parent, []

    def walk(self):
        for c in self.children:
            if isinstance(c, Node):
                yield c
                yield from c.walk()

    def strings(self):
        for c in self.children:
            if isinstance(c, Node):
                yield from c.strings() if c.name not in ("script", "style") else ()
            elif c is not None:
                yield c

    def text(self):
        return "".join(s.strip() for s in self.strings())

    def string(self):
        if len(self.children) != 1:
            return None
        c = self.children[0]
        return c.string() if isinstance(c, Node) else c


class Tree(HTMLParser):
    """Elements close with their own tag or any outer one's; any tag, also a stray one, ends a string; a comment is a child without text."""

    def __init__(self, markup):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("div")
        self.done = self.flowing = False
        self.feed(markup)
        self.close()

    def handle_starttag(self, tag, attrs):
        self.flowing = False
        if not self.done:
            n = Node(tag, attrs, self.at)
            self.at.children.append(n)
            if tag not in cards.VOID:
                self.at = n

    def handle_startendtag(self, tag, attrs):
        self.flowing = False
        if not self.done:
            self.at.children.append(Node(tag, attrs, self.at))

    def handle_endtag(self, tag):
        self.flowing = False
        n = self.at
        while n is not None and (n.name != tag or n is self.root and tag != "div"):
            n = n.parent
        if n is self.root:
            self.done = True
        elif n is not None:
            self.at = n.parent

    def handle_data(self, data):
        if not self.done:
            if self.flowing:
                self.at.children[-1] += data
            else:
                self.at.children.append(data)
            self.flowing = True

    def handle_comment(self, data):
        self.flowing = False
        if not self.done:
            self.at.children.append(None)


def plain(markup):
    every = list(Tree(markup).root.walk())

    def marked(role):
        want = cards.CLASSES[role].split()
        for n in every:
            have = (n.attributes.get("class") or "").split()
            if have == want if len(want) > 1 else want[0] in have:
                yield n

    def first(nodes):
        return next(iter(nodes), None)

    def span_in(n):
        return first(x for x in n.walk() if x.name == "span") if n else None

    def text(n):
        return n.text() if n else None

    heading = first(marked("heading"))
    spans = [x.text() for x in heading.walk() if x.name == "span"] if heading else []
    anchor = first(n for n in every if n.name == "a")
    return {
        "link": anchor.attributes.get("href") if anchor else None,
        "title": spans[1] if len(spans) > 1 and spans[0] == "New listing" else spans[0] if spans and spans[0] != "New listing" else None,
        "cost": text(first(n for n in marked("cost") if n.name == "span")),
        "postage": text(span_in(first(n for n in marked("postage") if n.name == "span"))),
        "bidding": text(first(n for n in marked("postage") if "bid" in (n.string() or ""))),
        "reviews": text(span_in(first(marked("reviews")))),
        "left": text(first(marked("left"))),
        "end": text(first(marked("end"))),
        "sale": text(first(marked("sale"))),
    }


def read(markups):
    raw = [m.encode() for m in markups]
    off = np.r_[0, np.cumsum([len(r) for r in raw])].astype(np.int64)
    got = cards.elements(np.frombuffer(b"".join(raw), np.uint8), off)
    return [dict(zip(cards.ELEMENTS, row, strict=True)) for row in zip(*[c.to_pylist() for c in got], strict=True)]


CASES = {
    "": {},
    "<p>nothing</p>": {},
    '<div class="s-card__title"><span>New listing</span><span>\n A &amp; B <b>C</b> &nbsp;</span></div>': {"title": "A & BC"},
    '<div class="s-card__title"><span>New listing</span></div>': {},
    '<div class="s-card__title">no span</div>': {},
    "<div class='x s-card__title y'><p><span>deep &lt;br&gt; &#163;5</span></p></div>": {"title": "deep <br> £5"},
    '<span class="s-card__price x">£1</span>': {"cost": "£1"},
    '<b class="s-card__price">£1</b><span class="s-card__price">£2</span>': {"cost": "£2"},
    f'<span class="{BIDS}">3 bids</span><span class="{BIDS}"><span>£2 postage</span></span>': {"bidding": "3 bids"},
    f'<span class="{BIDS}"><span>Free</span></span><span class="{BIDS}">3 bids</span>': {"postage": "Free", "bidding": "3 bids"},
    f'<span class="{BIDS} x">9 bids</span><i class="{BIDS}"><b>5 bids</b></i>': {"bidding": "5 bids"},
    f'<span class="{BIDS}">5 bids<b></b></span>': {},
    f'<span class="{BIDS}">Bids: 5</span>': {},
    "<a>x</a><a href='/itm/2'>y</a>": {},
    "<A NAME='a > b' HREF='/itm/5?a=1&amp;b=2'>x</A>": {"link": "/itm/5?a=1&b=2"},
    '<a title="it\'s" href = "/itm/6">x</a>': {"link": "/itm/6"},
    "<a href=/itm/7 class=q>x</a>": {"link": "/itm/7"},
    '<a data-href="/itm/8" href="/itm/9" href="/itm/10">x</a>': {"link": "/itm/10"},
    '<!-- <span class="s-card__price">£9</span> --><span class="s-card__price">£<!-- x -->1</span>': {"cost": "£1"},
    '<script>"<span class=\'s-card__price\'>1</span>"</script><span class="s-card__price">£2</span>': {"cost": "£2"},
    '<span class="s-card__time-left">1 < 2 > 0</span>': {"left": "1 < 2 > 0"},
    '<div><span class="s-card__time-left">a</div>b<span class="s-card__time-end">c</span>': {"left": "a", "end": "c"},
    '<p class="s-card__time-left">a<p>b</div><span class="s-card__time-end">out</span>': {"left": "ab"},
    '</b><span class="s-card__time-end">in</i>side</span></div></div><span class="s-card__price">£3</span>': {"end": "inside"},
    '<span class="su-styled-text positive default">Sold  1 Dec 2025 </span>': {"sale": "Sold  1 Dec 2025"},
    '<div class="s-item__reviews-count"><br><img src="x"/><span>3,107 reviews</span></div>': {"reviews": "3,107 reviews"},
    '<span class="s-card__price">ünïcödé 漢字 &euro;</span>': {"cost": "ünïcödé 漢字 €"},
    "<": {}, "a < b": {}, "<<>><a": {}, "&amp;": {},
}


def test_rules():
    for markup, want in CASES.items():
        assert {k: v for k, v in read([markup])[0].items() if v is not None} == want, markup
        assert {k: v for k, v in plain(markup).items() if v is not None} == want, markup
    together = read(list(CASES))  # neighbours change nothing
    assert [{k: v for k, v in r.items() if v is not None} for r in together] == list(CASES.values())


PIECES = [
    *[f'<{t} class="{c}">' for t in ("span", "div", "b") for c in cards.CLASSES.values()],
    "<span>", "<b>", "<div>", "<p>", "<i>", "</span>", "</span>", "</b>", "</p>", "</i>", "</span>", "<br>", "<img src='a>b'>", '<a href="/itm/1">', "</a>",
    "New listing", "3 bids", "£1.50", " ", "\n", "&amp;", "&nbsp;", "é", "<!-- <b> -->", "x", " y ", "<SPAN CLASS='s-card__price x'>", "<span/>", "<span title=\"it's\">",
]


@pytest.mark.parametrize("seed", range(4))
def test_random_markup(seed):
    rnd = random.Random(seed)
    markups = ["".join(rnd.choice(PIECES) for _ in range(rnd.randint(0, 25))) for _ in range(1500)]
    for m, got in zip(markups, read(markups), strict=True):
        assert got == plain(m), m


def test_read_keeps_other_columns_and_null_cards(spark):
    df = spark.createDataFrame([(1, '<span class="s-card__price">£1</span>', "k"), (2, None, None), (3, "<b>", "z")], "n int, card string, other string")
    got = {r["n"]: (r["other"], r["cost"], r["title"]) for r in cards.read(df).collect()}
    assert got == {1: ("k", "£1", None), 2: (None, None, None), 3: ("z", None, None)}
    assert cards.read(df.limit(0)).collect() == []


def test_only_the_named_elements_are_read(spark):
    raw = "".join(CASES).encode()
    data, off = np.frombuffer(raw, np.uint8), np.r_[0, np.cumsum([len(m.encode()) for m in CASES])].astype(np.int64)
    every = dict(zip(cards.ELEMENTS, cards.elements(data, off), strict=True))
    for n in cards.ELEMENTS:
        assert cards.elements(data, off, (n,))[0].equals(every[n]), n
    df = spark.createDataFrame([(1, '<span class="s-card__price">£1</span>')], "n int, card string")
    assert cards.read(df, ("cost",)).columns == ["n", "cost"]


def test_cards_of_a_file_of_one_row_group_are_dealt(spark):
    from bidlens.plans import queries

    plan = queries.QUERIES["parse_price"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "hashpartitioning(id" in plan


def test_a_run_reads_its_cards_once(spark):
    from bidlens.plans import queries

    plan = queries.QUERIES["full_run"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan  # typed rows come from a table; before, four branches read the markup each
