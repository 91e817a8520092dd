"""Byte-pair ids of many texts at once: words are split and looked up with numpy, new ones encoded. A hash finds a
word; its bytes confirm it."""

from __future__ import annotations

import functools
import json
import re

import numpy as np

from .common import PASS_BYTES, differ, prefix, span_hash

#: What tokenizer files of this kind split texts by.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Different words kept between batches; the table starts anew beyond.
KEPT = 3_000_000

_SPACE, _OTHER_SPACE, _LETTER, _DIGIT, _SIGN = range(5)
_CLASS = np.full(256, _SIGN, np.uint8)
_CLASS[32] = _SPACE
_CLASS[9:14] = _OTHER_SPACE
_CLASS[48:58] = _DIGIT
for _a, _b in ((65, 91), (97, 123), (0x80, 0xC0)):
    _CLASS[_a:_b] = _LETTER
_CLASS[0xC3] = _LETTER  # with a byte from 80 to BF: a Latin-1 letter, but for two signs
_ODD = np.zeros(256, bool)
_ODD[0xC0:] = True
_ODD[0xC3] = False
_AFTER = np.zeros(256, bool)
_AFTER[list(b"stmdrvl")] = True


def ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ids of a byte-level tokenizer file, whose bytes are written as characters: the
    printable ones as themselves, the others from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
    vocab = json.load(open(path, encoding="utf-8"))["model"]["vocab"]
    return {bytes(of[c] for c in t): i for t, i in vocab.items() if all(c in of for c in t) and t != "<|endoftext|>"}


def added(path: str) -> dict[bytes, int]:
    """Strings and ids of the tokenizer file's added tokens, which its tokenizer finds in any text."""
    tokens = json.load(open(path, encoding="utf-8")).get("added_tokens") or []
    for t in tokens:
        if t.get("single_word") or t.get("lstrip") or t.get("rstrip"):
            raise ValueError(f"added token {t['content']!r}: only plain ones are supported")
    return {t["content"].encode(): t["id"] for t in tokens if t["content"]}


def starts(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Where a word starts, for texts without odd bytes or contractions."""
    kind = _CLASS[data]
    space = kind <= _OTHER_SPACE
    begins = np.zeros(len(data) + 1, bool)
    begins[off] = True
    first, last = begins[:-1], begins[1:]
    out = first.copy()
    out[1:] |= space[1:] & ~space[:-1]  # a run of white space
    out[:-1] |= space[:-1] & ~space[1:] & ~last[:-1]  # its last character, if more follows
    out[1:] |= ~space[1:] & (kind[1:] != kind[:-1]) & (kind[:-1] != _SPACE)
    return np.flatnonzero(out)


class Encoder:
    def __init__(self, path: str):
        import tiktoken

        self.bpe = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks(path), special_tokens={})
        self.added = added(path)
        self.find = re.compile(b"|".join(re.escape(t) for t in sorted(self.added, key=len, reverse=True))) if self.added else None
        self.clear()

    def clear(self) -> None:
        self.hash = np.zeros(0, np.uint64)
        self.at = self.count = self.text_at = self.text_size = np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.uint32)
        self.text = np.zeros(0, np.uint8)

    def learn(self, new: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> None:
        """Adds the words at start to end; new: their hashes, sorted."""
        raw = data.tobytes()
        ids = [self.bpe._encode_single_piece(raw[a:b]) for a, b in zip(start.tolist(), end.tolist(), strict=True)]
        count = np.fromiter(map(len, ids), np.int64, len(ids))
        where = np.searchsorted(self.hash, new)
        self.at = np.insert(self.at, where, len(self.flat) + np.cumsum(count) - count)
        self.count = np.insert(self.count, where, count)
        self.text_at = np.insert(self.text_at, where, len(self.text) + np.cumsum(end - start) - (end - start))
        self.text_size = np.insert(self.text_size, where, end - start)
        self.text = np.r_[self.text, np.concatenate([data[a:b] for a, b in zip(start.tolist(), end.tolist(), strict=True)])]
        self.hash = np.insert(self.hash, where, new)
        self.flat = np.r_[self.flat, np.array([i for x in ids for i in x], np.uint32)]

    def tokens(self, data: np.ndarray, off: np.ndarray) -> list[bytes]:
        """As encode, but added tokens in a text have their own ids: what the file's tokenizer gives at its
        defaults. The text between them is split and encoded part by part."""
        raw = data.tobytes()
        if self.find is None or not self.find.search(raw):
            return self.encode(data, off)
        cuts, ids, own = [], [], []  # ends of parts, the added id after each, its text
        for i in range(len(off) - 1):
            for m in self.find.finditer(raw[off[i] : off[i + 1]]):
                cuts += [off[i] + m.start(), off[i] + m.end()]
                ids += [None, self.added[m[0]]]
                own += [i, i]
            cuts.append(off[i + 1])
            ids.append(None)
            own.append(i)
        out: list[list[bytes]] = [[] for _ in range(len(off) - 1)]
        plain = self.encode(data, np.r_[0, np.array(cuts, np.int64)])
        for i, k, part in zip(own, ids, plain, strict=True):
            out[i].append(part if k is None else np.array([k], "<u4").tobytes())
        return [b"".join(x) for x in out]

    def encode(self, data: np.ndarray, off: np.ndarray) -> list[bytes]:
        """Each text's ids as little-endian 32-bit numbers; special tokens' strings are ordinary text."""
        n = len(off) - 1
        odd = _ODD[data]
        odd[:-1] |= ((data[:-1] == 39) & _AFTER[data[1:]]) | ((data[:-1] == 0xC3) & ((data[1:] == 0x97) | (data[1:] == 0xB7)))
        bad = np.r_[0, np.cumsum(odd)]
        bad = bad[off[1:]] > bad[off[:-1]]
        out = [b""] * n
        for i in np.flatnonzero(bad):
            out[i] = np.array(self.bpe.encode_ordinary(data[off[i] : off[i + 1]].tobytes().decode()), "<u4").tobytes()
        if bad.all() or not len(data):
            return out
        start = starts(data, off)
        end = np.r_[start[1:], len(data)]
        good = ~bad[np.searchsorted(off, start, "right") - 1]
        start, end = start[good], end[good]
        h, first, word = np.unique(span_hash(prefix(data), start, end), return_index=True, return_inverse=True)
        if len(self.hash) > KEPT:
            self.clear()
        k = np.searchsorted(self.hash, h)
        miss = np.flatnonzero((k == len(self.hash)) | (self.hash[np.minimum(k, max(0, len(self.hash) - 1))] != h) if len(self.hash) else np.ones(len(h), bool))
        if len(miss):
            self.learn(h[miss], data, start[first[miss]], end[first[miss]])
            k = np.searchsorted(self.hash, h)
        # words whose hashes agree but not their bytes, with those before them in this pass or in the table
        size = end - start
        same = size == self.text_size[k][word]
        same[same] = ~differ(data, start[same], self.text, self.text_at[k][word][same], size[same])
        for i in np.unique(np.searchsorted(off, start[~same], "right") - 1):
            bad[i] = True
            out[i] = np.array(self.bpe.encode_ordinary(data[off[i] : off[i + 1]].tobytes().decode()), "<u4").tobytes()
        count, at = self.count[k][word], self.at[k][word]
        total = np.r_[0, np.cumsum(count)]
        flat = self.flat[np.arange(total[-1]) + np.repeat(at - total[:-1], count)]
        cut = total[np.searchsorted(start, off)]
        for i in np.flatnonzero(~bad):
            out[i] = flat[cut[i] : cut[i + 1]].astype("<u4").tobytes()
        return out


@functools.lru_cache(2)
def encoder(path: str) -> Encoder:
    """One for each Python worker, which keeps the words that it has met."""
    return Encoder(path)


__all__ = ["PASS_BYTES", "encoder", "ranks", "starts"]
