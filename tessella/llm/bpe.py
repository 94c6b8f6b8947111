"""Encoding whole Arrow batches with a byte-level BPE tokenizer of the tokenizers library.

The library's own pre-tokenizer cuts a text into pieces that are encoded on their own. Here the cuts are found by
numpy over the batch's code points, each distinct piece is encoded by the library once and kept (up to a bound) for
later batches of the same worker, and the ids are gathered. Texts with code points whose class is not settled
(unassigned, private or beyond the basic plane) or with a special token's string go to the library whole.
"""

from __future__ import annotations

import sys
import unicodedata

import numpy as np

from . import common as C

#: Pieces kept by a worker; beyond that it starts anew.
KEPT = 800_000
LETTER, NUMBER, BLANK, OTHER, ODD = 1, 2, 3, 0, 4
#: The code points of Unicode's White_Space property.
WHITE = [0x9, 0xA, 0xB, 0xC, 0xD, 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: Letters that an apostrophe takes with it.
ONE, TWO = "stmd", ("re", "ve", "ll")


def _classes() -> np.ndarray:
    t = np.full(sys.maxunicode + 1, ODD, np.uint8)
    for c in range(0x10000):
        kind = unicodedata.category(chr(c))
        t[c] = LETTER if kind[0] == "L" else NUMBER if kind[0] == "N" else ODD if kind in ("Cn", "Co", "Cs") else OTHER
    t[WHITE] = BLANK
    return t


class Encoder:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.classes = _classes()
        vocab = self.lib.get_vocab()
        self.length = np.zeros(max(vocab.values()) + 1, np.int64)
        for piece, i in vocab.items():
            self.length[i] = len(piece)  # a character of a piece stands for a byte
        self.special = [t.content.encode() for t in self.lib.get_added_tokens_decoder().values()]
        self._clear()

    def _clear(self) -> None:
        self.index: dict[int, int] = {}
        self.ids = [np.zeros(0, np.int32)]
        self.many = [np.zeros(0, np.int64)]

    def cuts(self, cp: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Where pieces start, as a mask over code points. off: offsets of the texts."""
        n = len(cp)
        kind = self.classes[cp]
        begin = np.zeros(n + 1, bool)
        begin[off] = True
        new = np.ones(n, bool)
        new[1:] = kind[1:] != kind[:-1]
        new |= begin[:-1]
        blank = kind == BLANK
        # the last blank of a run goes its own way where a text goes on
        last = blank.copy()
        last[:-1] &= ~blank[1:]
        last &= ~begin[1:]
        at = np.flatnonzero(last)
        new[at] = True
        joined = at[cp[at] == 0x20]
        new[joined + 1] = False
        tick = np.flatnonzero((cp == 0x27) & new)  # starts a piece, so no space leads it
        if len(tick):
            tick = tick[(tick + 1 < n)]
            tick = tick[~begin[tick + 1]]
            a = cp[tick + 1]
            one = np.isin(a, [ord(x) for x in ONE])
            b = np.where(tick + 2 < n, cp[np.minimum(tick + 2, n - 1)], 0)
            b[begin[np.minimum(tick + 2, n)]] = 0
            two = np.zeros(len(tick), bool)
            for x in TWO:
                two |= (a == ord(x[0])) & (b == ord(x[1]))
            for hit, size in ((one, 2), (two, 3)):
                p = tick[hit]
                new[p + 1] = False
                q = p + size
                q = q[q < n]
                letters = q[kind[q] == LETTER]
                new[letters] = True
        return new

    def _learn(self, data: np.ndarray, starts: np.ndarray, lens: np.ndarray, plain: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """ids of new pieces one after another, and how many each has; the plain ones come first.

        Plain pieces are a space and letters, so the library cuts many of them in a row as they were cut here.
        """
        got, many = [], []
        first, size = starts[plain], lens[plain]
        for lo in range(0, len(first), 16384):
            st, n = first[lo : lo + 16384], size[lo : lo + 16384]
            total = np.cumsum(n)
            text = data[np.repeat(st - total + n, n) + np.arange(total[-1])].tobytes().decode()
            ids = np.array(self.lib.encode(text, add_special_tokens=False).ids, np.int32)
            got.append(ids)
            many.append(np.diff(np.searchsorted(np.cumsum(self.length[ids]), total) + 1, prepend=0))
        rest = [data[a : a + n].tobytes().decode() for a, n in zip(starts[~plain], lens[~plain])]
        ids = [e.ids for e in self.lib.encode_batch_fast(rest, add_special_tokens=False)]
        many.append(np.array([len(i) for i in ids], np.int64))
        got.append(np.array([x for i in ids for x in i], np.int32))
        return np.concatenate(got), np.concatenate(many)

    def chunk(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """ids of the texts one after another, and offsets of each text's ids."""
        n = len(off) - 1
        whole: dict[int, np.ndarray] = {}
        raw = data.tobytes()
        for s in self.special:
            at = raw.find(s)
            while at >= 0:
                whole[int(np.searchsorted(off, at, "right")) - 1] = None
                at = raw.find(s, at + 1)
        lead = np.flatnonzero((data & 0xC0) != 0x80)
        cp = np.frombuffer(raw.decode().encode("utf-32-le"), np.uint32)
        at = np.searchsorted(lead, off)
        odd = np.flatnonzero(self.classes[cp] == ODD)
        for r in np.unique(np.searchsorted(at, odd, "right") - 1):
            whole[int(r)] = None
        for r in whole:
            whole[r] = np.array(self.lib.encode(raw[off[r] : off[r + 1]].decode(), add_special_tokens=False).ids, np.int32)
        if not len(cp):
            return np.zeros(0, np.int32), np.zeros(n + 1, np.int64)
        first = np.flatnonzero(self.cuts(cp, at))
        starts = lead[first]
        ends = np.append(starts[1:], len(data))
        per = np.searchsorted(first, at)
        h = C.span_hashes(data, starts, ends)
        uniq, where, back = np.unique(h, return_index=True, return_inverse=True)
        if len(self.index) > KEPT:
            self._clear()
        get = self.index.get
        keys = uniq.tolist()
        slot = np.array([get(x, -1) for x in keys], np.int64)
        fresh = np.flatnonzero(slot < 0)
        if len(fresh):
            at_cp = first[where[fresh]]
            plain = (cp[at_cp] == 0x20) & (self.classes[cp[np.minimum(at_cp + 1, len(cp) - 1)]] == LETTER) & (ends[where[fresh]] - starts[where[fresh]] > 1)
            fresh, plain = fresh[np.argsort(~plain, kind="stable")], np.sort(plain)[::-1]
            ids, many = self._learn(data, starts[where[fresh]], ends[where[fresh]] - starts[where[fresh]], plain)
            slot[fresh] = np.arange(len(self.index), len(self.index) + len(fresh))
            self.index.update(zip((keys[k] for k in fresh), slot[fresh].tolist()))
            self.ids, self.many = [np.concatenate((self.ids[0], ids))], [np.concatenate((self.many[0], many))]
            self.at = np.concatenate(([0], np.cumsum(self.many[0])))
        pool, slot = self.ids[0], slot[back]
        many, begin = self.many[0][slot], self.at[slot]
        total = np.concatenate(([0], np.cumsum(many)))
        ids = pool[np.repeat(begin - total[:-1], many) + np.arange(total[-1])]
        out = total[per]
        if whole:
            rows = [whole[r] if r in whole else ids[out[r] : out[r + 1]] for r in range(n)]
            out = np.concatenate(([0], np.cumsum([len(r) for r in rows])))
            ids = np.concatenate(rows)
        return ids, out


_made: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This worker's encoder of a tokenizer file."""
    if path not in _made:
        _made[path] = Encoder(path)
    return _made[path]


def public(name: str) -> str:
    """Where a public tokenizer's file is on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)
