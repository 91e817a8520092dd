"""Card reader: the elements of result cards by first-match rules, in one vectorised pass over the markup of many cards.

A batch's cards lie side by side in one Arrow buffer. Tags, their names, attributes and nesting are found for all of them at
once with array operations; cards whose markup needs care (comments, scripts, angle brackets in attribute values,
tags left open or closed too often) are first masked, or their tags paired, one by one, to the same arrays.
"""

from __future__ import annotations

import html
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Bytes of markup that one pass holds, about.
PASS_BYTES = 1 << 21
#: Elements of so many tags or fewer have their texts joined all at once.
FEW = 4
# What marks the elements of a card. A class of one name is found among others, one of several names as it stands.
CLASSES = {
    "heading": "s-card__title",
    "cost": "s-card__price",
    "postage": "su-styled-text secondary large",
    "left": "s-card__time-left",
    "end": "s-card__time-end",
    "sale": "su-styled-text positive default",
    "reviews": "s-item__reviews-count",
}
# Elements that never have content.
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr")
#: What the reader gives of each card: texts, null where the element is missing.
ELEMENTS = ("link", "title", "cost", "postage", "bidding", "reviews", "left", "end", "sale")

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: What ends a name, and, by the places of such bytes among eight, a mask of those before the first.
_ENDS = _SPACE.copy()
LT, GT, SLASH, BANG, QUERY, DOUBLE, SINGLE, EQUALS = b"<>/!?\"'="
_ENDS[[SLASH, GT]] = True
_KEEP = np.array([(1 << 8 * ((e & -e).bit_length() - 1 if e else 8)) - 1 for e in range(256)], "<u8")
_TAG = re.compile(rb"<!--.*?-->|<(script|style)\b[^>]*>.*?</\1\s*>|<[!?][^>]*>|</?[a-z](?:[^>\"']|\"[^\"]*\"|'[^']*')*>", re.S | re.I)
_BODY = re.compile(rb"(<[^>]*>)(.*)(<[^>]*>)", re.S)
#: Texts, and tags without angle brackets inside, but for those of scripts and styles: what masking leaves as it is.
_PLAIN = re.compile(rb"(?:[^<]++|</?(?!(?:script|style)\b)[a-z](?:[^<>\"']|\"[^\"<>]*+\"|'[^'<>]*+')*+>)*+", re.S | re.I)
_ATTRIBUTE = re.compile(rb"([^\s\"'>/=]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")


def _hidden(b: bytes) -> bytes:
    """A mark of the same length that ends one text and begins another, but is no element."""
    return b"<!" + b"." * (len(b) - 3) + b">" if len(b) >= 3 else b" " * len(b)


def masks(card: bytes):
    """(place, bytes) of what hides a card's comments, scripts and styles, and angle brackets inside its tags; no byte moves."""
    at = _PLAIN.match(card).end()
    while at < len(card):
        m = _TAG.match(card, at)
        if m:
            b = m.group()
            if m.group(1):
                head, body, tail = _BODY.fullmatch(b).groups()
                yield at, head + _hidden(body) + tail
            elif b[1] == BANG or b[1] == QUERY:
                yield at, _hidden(b)
            else:
                yield at, b"<" + b[1:-1].replace(b"<", b".").replace(b">", b".") + b">"
        at = _PLAIN.match(card, m.end() if m else at + 1).end()


def _names(data: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Names from `start` on, lower-cased, as numbers of their first 16 bytes."""
    ahead = np.full(len(data) + 16, GT, np.uint8)
    ahead[: len(data)] = data
    words = np.ndarray(len(data) + 9, "<u8", ahead.data, strides=(1,))  # eight bytes from each byte on
    out = _word(words[start])
    longer = np.flatnonzero(out >> np.uint64(56))
    out[longer] ^= _word(words[start[longer] + 8]) * np.uint64(0x9E3779B97F4A7C15)
    return out


def _word(n: np.ndarray) -> np.ndarray:
    """Eight bytes each, lower-cased, without what follows a name's end."""
    b = n.view(np.uint8).reshape(-1, 8)
    ends = np.packbits(_ENDS[b], axis=1, bitorder="little")[:, 0]
    return _LOWER[b].view("<u8")[:, 0] & _KEEP[ends]


def _name(name: str) -> np.uint64:
    raw = np.frombuffer(name.encode() + b">" * 17, np.uint8)
    return _names(raw, np.zeros(1, np.int64))[0]


SPAN, ANCHOR, DIV = map(_name, ("span", "a", "div"))
_VOIDS = np.array([_name(n) for n in VOID])


class Tags:
    """The tags of cards in data, card i from off[i] to off[i + 1].

    start, end: a tag's `<` and `>`; card; name; element: whether it opens one; close: the tag that closes it (itself for one without content), or
    the card's end. A card ends where its own division is closed."""

    def __init__(self, original: np.ndarray, off: np.ndarray):
        self.original, self.data, self.off = original, original, off
        self._find()
        if len(self.start):
            care = self._careful()
            if len(care):
                self.data = original.copy()
                for c in care.tolist():
                    a = off[c]
                    for at, b in masks(original[a : off[c + 1]].tobytes()):
                        self.data[a + at : a + at + len(b)] = np.frombuffer(b, np.uint8)
                self._find()
        self._name()
        self._pair()

    def _find(self) -> None:
        data, off = self.data, self.off
        angle = data == GT
        lt, gt = np.flatnonzero(data == LT), np.flatnonzero(angle)
        #: Up to and with each byte, how many quotes of either kind there are.
        self.quoted = [np.cumsum(data == q, dtype=np.int32) for q in (DOUBLE, SINGLE)]
        card = np.repeat(np.arange(len(off) - 1), np.diff(np.searchsorted(lt, off)))
        after = data[np.minimum(lt + 1, len(data) - 1)]
        at = np.cumsum(angle, dtype=np.int32)[lt]
        ok = (_LETTER[after] | (after == SLASH) | (after == BANG) | (after == QUERY)) & (at < len(gt))
        lt, card, at, after = lt[ok], card[ok], at[ok], after[ok]
        end = gt[at] if len(at) else at
        ok = end < off[card + 1]
        self.start, self.end, self.card = lt[ok], end[ok], card[ok]
        self.mixed = np.stack([q[self.end] - q[self.start] for q in self.quoted])

    def _name(self) -> None:
        data = self.data
        closing = data[np.minimum(self.start + 1, len(data) - 1)] == SLASH if len(data) else np.zeros(0, bool)
        first = self.start + 1 + closing
        named = _LETTER[data[np.minimum(first, len(data) - 1)]] if len(data) else closing
        self.name = _names(data, first) if len(first) else np.zeros(0, np.uint64)
        self.element = named & ~closing
        empty = self.element & (np.isin(self.name, _VOIDS) | (data[self.end - 1] == SLASH))
        self.kind = np.where(self.element & ~empty, 1, np.where(named & closing, -1, 0))

    def _careful(self) -> np.ndarray:
        """Cards with tags that may not end at the next `>`, and such as hide markup."""
        data, (double, single) = self.data, self.mixed
        second, third = _LOWER[data[self.start + 1]], _LOWER[data[np.minimum(self.start + 2, len(data) - 1)]]
        hides = (second == BANG) | (second == QUERY) | ((second == ord("s")) & ((third == ord("c")) | (third == ord("t"))))
        crossed = np.r_[self.start[1:] < self.end[:-1], False]
        return np.unique(self.card[hides | crossed | (double % 2 > 0) | (single % 2 > 0) | ((double > 0) & (single > 0))])

    def _pair(self) -> None:
        n, kind, card = len(self.start), self.kind, self.card
        cards = len(self.off) - 1
        first = np.searchsorted(card, np.arange(cards + 1))
        total = np.r_[0, np.cumsum(kind)]
        depth = total[1:] - total[first[card]]
        #: The tag with which each card ends; beyond the last one if none closes it.
        self.last = first[1:].copy()
        out = np.flatnonzero(depth < 0)
        if len(out):
            c, i = np.unique(card[out], return_index=True)
            self.last[c] = out[i]
        inside = np.arange(n) < self.last[card]
        level = np.where(kind > 0, depth, depth + 1)
        pick = np.flatnonzero(inside & (kind != 0))
        order = pick[np.lexsort((level[pick], card[pick]))]
        group = card[order] * (1 << 32) + level[order]
        edge = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if len(order) else order
        size = np.diff(np.r_[edge, len(order)])
        rank = np.arange(len(order)) - np.repeat(edge, size)
        wrong = kind[order] != np.where(rank % 2 == 0, 1, -1)
        wrong |= (rank % 2 == 1) & (self.name[order] != self.name[np.roll(order, 1)])
        wrong |= np.repeat(size % 2 == 1, size)
        self.close = np.arange(n)
        opened = order[rank % 2 == 0]
        follow = np.roll(order, -1)[rank % 2 == 0]
        self.close[opened] = follow
        ragged = set(card[order[wrong]].tolist())
        left = self.last[self.last < first[1:]]
        ragged |= set(card[left[self.name[left] != DIV]].tolist())
        for c in ragged:
            self._stack(c, int(first[c]), int(first[c + 1]))
        self.inside = np.arange(n) < self.last[card]
        self.element &= self.inside
        #: Where the text after each tag ends.
        stop = np.r_[self.start[1:], len(self.data)]
        self.stop = np.minimum(stop, self.off[card + 1]) if n else stop[:0]

    def _stack(self, c: int, a: int, b: int) -> None:
        """Pairs one card's tags: a closing tag closes the innermost open element of its name and all inside it; without one it is
        passed over, but for the division's, which ends the card."""
        held: list[int] = []
        self.last[c] = b
        for i in range(a, b):
            if self.kind[i] > 0:
                held.append(i)
            elif self.kind[i] < 0:
                same = next((p for p in range(len(held) - 1, -1, -1) if self.name[held[p]] == self.name[i]), None)
                if same is not None:
                    for p in held[same:]:
                        self.close[p] = i
                    del held[same:]
                elif self.name[i] == DIV:
                    self.last[c] = i
                    break
        for p in held:
            self.close[p] = self.last[c]

    # -- attributes ---------------------------------------------------------------------------

    def attribute(self, name: str, of: np.ndarray) -> pa.Array:
        """The value of an attribute for each of the elements `of` (ascending); null without it. The last of several counts."""
        data = self.data
        a, b = np.full(len(self.start), -1), np.full(len(self.start), -1)
        eq = np.flatnonzero(data == EQUALS)
        tag = np.searchsorted(self.start, eq) - 1
        ok = (tag >= 0) & (eq < self.end[np.maximum(tag, 0)]) if len(self.start) else np.zeros(len(eq), bool)
        eq, tag = eq[ok], tag[ok]
        quoted = np.logical_or.reduce([(q[eq] - q[self.start[tag]]) % 2 > 0 for q in self.quoted])
        eq, tag = eq[~quoted], tag[~quoted]
        after = data[eq + 1]
        plain = ((after == DOUBLE) | (after == SINGLE)) & ~_SPACE[data[eq - 1]]
        care = np.zeros(len(self.start), bool)
        care[tag[~plain]] = True
        care |= (self.mixed > 0).all(0)
        size = len(name)
        mine = plain & (eq - size > self.start[tag])
        for i, x in enumerate(name.encode()):
            mine &= _LOWER[data[np.maximum(eq - size + i, 0)]] == x
        before = data[np.maximum(eq - size - 1, 0)]
        mine &= _SPACE[before] | (before == DOUBLE) | (before == SINGLE) | (before == SLASH)
        eq, tag, after = eq[mine], tag[mine], after[mine]
        for quote, up_to in zip((DOUBLE, SINGLE), self.quoted, strict=True):
            which = after == quote
            places = np.flatnonzero(data == quote) if which.any() else eq[:0]
            at = up_to[eq[which] + 1]
            a[tag[which]] = eq[which] + 2
            b[tag[which]] = places[np.minimum(at, len(places) - 1)] if len(places) else 0
        got = self._strings(self.original, np.maximum(a[of], 0), np.where(a[of] < 0, 0, np.maximum(b[of], a[of])))
        none = a[of] < 0
        slow = {}
        for p in np.flatnonzero(care[of]).tolist():
            i = int(of[p])
            raw = self.original[self.start[i] + 1 : self.end[i]].tobytes()
            found = [m.group(2) or m.group(3) or m.group(4) or b"" for m in _ATTRIBUTE.finditer(raw) if m.group(1).lower() == name.encode()]
            none[p] = not found
            slow[p] = found[-1].decode() if found else ""
        return pc.if_else(pa.array(none), pa.scalar(None, pa.string()), self._unescaped(got, slow))

    # -- texts --------------------------------------------------------------------------------

    @staticmethod
    def _strings(data: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.Array:
        size = b - a
        ends = np.r_[0, np.cumsum(size)]
        raw = data[np.repeat(a - ends[:-1], size) + np.arange(ends[-1])]
        return pa.StringArray.from_buffers(len(a), pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(raw.tobytes()))

    @staticmethod
    def _unescaped(got: pa.Array, slow: dict[int, str]) -> pa.Array:
        """got with references resolved, and with the values of slow in their places, resolved likewise."""
        entity = np.flatnonzero(pc.match_substring(got, "&").to_numpy(zero_copy_only=False))
        values = {p: html.unescape(got[p].as_py()) for p in entity.tolist()} | {p: html.unescape(v) for p, v in slow.items()}
        return Tags._replaced(got, values)

    @staticmethod
    def _replaced(got: pa.Array, values: dict[int, str]) -> pa.Array:
        if not values:
            return got
        mask = np.zeros(len(got), bool)
        mask[list(values)] = True
        return pc.replace_with_mask(got, pa.array(mask), pa.array([values[p] for p in sorted(values)], pa.string()))

    def text(self, of: np.ndarray) -> pa.Array:
        """The text of each element in `of`, null where of is negative: its strings, each without white space at its ends, in a row."""
        i = np.maximum(of, 0)
        if not len(self.start):
            return pa.nulls(len(of), pa.string())
        close = self.close[i]
        few = close <= i + FEW
        pieces = []
        for k in range(FEW):
            here = few & (of >= 0) & (close > i + k)
            if k and not here.any():
                break
            at = np.minimum(i + k, len(self.start) - 1)
            a = np.where(here, self.end[at] + 1, 0)
            got = self._strings(self.original, a, np.where(here, np.maximum(a, self.stop[at]), 0))
            values = {p: html.unescape(got[p].as_py()) for p in np.flatnonzero(pc.match_substring(got, "&").to_numpy(zero_copy_only=False)).tolist()}
            pieces.append(pc.utf8_trim_whitespace(self._replaced(got, values)))
        got = pc.binary_join_element_wise(*pieces, "") if len(pieces) > 1 else pieces[0]
        values = {}
        for p in np.flatnonzero(~few & (of >= 0)).tolist():
            parts = (self.original[self.end[k] + 1 : self.stop[k]].tobytes().decode() for k in range(int(i[p]), int(close[p])))
            values[p] = "".join(html.unescape(x).strip() for x in parts)
        return pc.if_else(pa.array(of < 0), pa.scalar(None, pa.string()), self._replaced(got, values))

    def only_text(self, of: np.ndarray) -> np.ndarray:
        """Those of the elements `of` whose one child is a text, or an element of which that holds."""
        if not len(of):
            return of
        said = self.stop > self.end + 1
        plain = (self.close == np.arange(len(self.close)) + 1) & said
        at = [np.minimum(of + k, len(said) - 1) for k in range(3)]
        nested = (self.close[of] == of + 3) & ~said[of] & self.element[at[1]] & plain[at[1]] & ~said[at[2]]
        sure = plain[of] | nested
        for p in np.flatnonzero(~sure).tolist():
            sure[p] = self._lone(int(of[p]))
        return of[sure]

    def _lone(self, i: int) -> bool:
        """As only_text, by a walk over the element's children; tags closed without being open are no children."""
        close, k, held, child = int(self.close[i]), i, 0, -1
        while k < close:
            if self.stop[k] > self.end[k] + 1:
                held += 1
                child = -1
            k += 1
            if k < close and (self.element[k] or self.kind[k] == 0):
                held += 1
                child = k
                k = int(self.close[k])
        return held == 1 and (child < 0 or (bool(self.element[child]) and self._lone(child)))

    def first(self, of: np.ndarray) -> np.ndarray:
        """For each card the first of the elements `of`, or -1."""
        out = np.full(len(self.off) - 1, -1)
        c, i = np.unique(self.card[of], return_index=True)
        out[c] = of[i]
        return out

    def nth_inside(self, outer: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
        """For each element of outer its nth descendant (from 0) among the elements `of`, or -1."""
        if not len(of):
            return np.full(len(outer), -1)
        o = np.maximum(outer, 0)
        at = np.searchsorted(of, o, "right") + n
        found = of[np.minimum(at, len(of) - 1)]
        return np.where((outer >= 0) & (at < len(of)) & (found < self.close[o]) & (self.card[found] == self.card[o]), found, -1)


def elements(data: np.ndarray, off: np.ndarray, names: tuple[str, ...] = ELEMENTS) -> list[pa.Array]:
    """Those of the ELEMENTS that are named, of each card."""
    t = Tags(data, off)
    if not len(t.start):
        return [pa.nulls(len(off) - 1, pa.string())] * len(names)
    every = np.flatnonzero(t.element)
    spans, anchors = every[t.name[every] == SPAN], every[t.name[every] == ANCHOR]
    if names != ("link",):
        classes = t.attribute("class", every).dictionary_encode()
        code = classes.indices.fill_null(-1).to_numpy(zero_copy_only=False)
        known = [(x or "").split() for x in classes.dictionary.to_pylist()]

    def marked(role: str, among: np.ndarray | None = None) -> np.ndarray:
        want = CLASSES[role].split()
        fits = np.array([want == x if len(want) > 1 else want[0] in x for x in known] + [False])
        found = every[fits[code]]
        return found if among is None else np.intersect1d(found, among, assume_unique=True)

    def link() -> pa.Array:
        anchor = t.first(anchors)
        href = t.attribute("href", np.maximum(anchor, 0)) if len(anchors) else pa.nulls(len(anchor), pa.string())
        return pc.if_else(pa.array(anchor < 0), pa.scalar(None, pa.string()), href)

    def title() -> pa.Array:
        heading = t.first(marked("heading"))
        titles = [t.text(t.nth_inside(heading, spans, n)) for n in (0, 1)]
        news = pc.fill_null(pc.equal(titles[0], "New listing"), False)
        return pc.if_else(news, titles[1], titles[0])

    def bidding() -> pa.Array:
        told = t.only_text(marked("postage"))
        told = told[pc.match_substring(t.text(told), "bid").to_numpy(zero_copy_only=False).astype(bool)] if len(told) else told
        return t.text(t.first(told))

    find = {
        "link": link,
        "title": title,
        "cost": lambda: t.text(t.first(marked("cost", spans))),
        "postage": lambda: t.text(t.nth_inside(t.first(marked("postage", spans)), spans, 0)),
        "bidding": bidding,
        "reviews": lambda: t.text(t.nth_inside(t.first(marked("reviews")), spans, 0)),
        "left": lambda: t.text(t.first(marked("left"))),
        "end": lambda: t.text(t.first(marked("end"))),
        "sale": lambda: t.text(t.first(marked("sale"))),
    }
    return [find[n]() for n in names]


def _passes(col: pa.Array):
    """(first row, offsets, bytes) of runs of cards; a null card is an empty one."""
    col = col.fill_null("") if col.null_count else col
    kind = np.int64 if pa.types.is_large_string(col.type) else np.int32
    off = np.frombuffer(col.buffers()[1], kind)[col.offset : col.offset + len(col) + 1].astype(np.int64) if len(col) else np.zeros(1, np.int64)
    raw = np.frombuffer(col.buffers()[2], np.uint8) if len(col) and col.buffers()[2] is not None else np.zeros(0, np.uint8)
    a = 0
    while a < len(col):
        b = max(a + 1, int(np.searchsorted(off, off[a] + PASS_BYTES, "right")) - 1)
        yield a, off[a : b + 1] - off[a], raw[off[a] : off[b]]
        a = b


def read(cards: DataFrame, names: tuple[str, ...] = ELEMENTS) -> DataFrame:
    """cards (card: a card's markup, and other columns) with the named ELEMENTS in place of the markup, others aren't looked for; no shuffle."""
    rest = [f for f in cards.schema.fields if f.name != "card"]
    schema = T.StructType([*rest, *[T.StructField(n, T.StringType()) for n in names]])

    def look(batches):
        for batch in batches:
            card = batch.column(batch.num_columns - 1)
            for a, off, data in _passes(card):
                part = batch.slice(a, len(off) - 1)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *elements(data, off, names)], schema.names)

    return cards.select(*[f.name for f in rest], "card").mapInArrow(look, schema)
