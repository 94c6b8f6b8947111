"""A dictionary of aliases as one automaton in arrays: a double-array trie with failure links, stepped over many texts at once.

A state is a slot: its child by a byte of class c is slot base + c, if the check there names the state. Texts are cut
into stretches that overlap by the longest alias, and each stretch is a lane: a step moves all lanes by one byte, so a
batch costs as many numpy steps as a stretch has bytes, whatever the number of texts and aliases. The trie is built level
by level from the sorted aliases, in time linear in their bytes.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np

#: What may stand beside a strict alias.
SEPARATORS = ' ",/|\n\t;•'

LANE = 256
_WORD = np.zeros(256, bool)
_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B)]] = True
_APART = np.zeros(256, bool)
_APART[[ord(c) for c in SEPARATORS if c.isascii()]] = True
_WIDE = [c.encode() for c in SEPARATORS if not c.isascii()]


class Automaton:
    """Aliases and their labels. An alias is met in any case of letters; its neighbours must not be ASCII letters or digits,
    those of a strict alias must be separators or the text's ends. Empty aliases are left out."""

    def __init__(self, aliases: dict[str, str] | Iterable[tuple[str, str]], strict: Iterable[str] = ()):
        pairs = [(a, label) for a, label in (aliases.items() if isinstance(aliases, dict) else aliases) if a]
        tight = set(strict)
        self.aliases = [a for a, _ in pairs]
        self.labels = sorted({label for _, label in pairs})
        place = {label: i for i, label in enumerate(self.labels)}
        self.label_of = np.array([place[label] for _, label in pairs], np.int64)
        self.strict = np.array([a in tight for a in self.aliases], bool)
        raw = [a.lower().encode() for a in self.aliases]
        self.size = np.array([len(r) for r in raw], np.int64)
        self.longest = int(self.size.max(initial=1))
        words = sorted(set(raw))
        at = {w: i for i, w in enumerate(words)}
        last = self._build(words)
        # aliases by the state that ends them
        end = last[[at[r] for r in raw]] if raw else np.zeros(0, np.int64)
        order = np.argsort(end, kind="stable")
        self.own = order
        count = np.bincount(end, minlength=len(self.base))
        self.first = np.cumsum(count) - count
        self.count = count
        self._link()

    def _build(self, words: list[bytes]) -> np.ndarray:
        """Place the trie of sorted words; the state that ends each."""
        size = np.array([len(w) for w in words], np.int64)
        off = np.cumsum(size) - size
        flat = np.frombuffer(b"".join(words), np.uint8)
        used = np.unique(flat)
        self.classes = np.zeros(256, np.int64)
        self.classes[used] = np.arange(1, len(used) + 1)
        node, rows, last = np.zeros(len(words), np.int64), np.arange(len(words)), np.zeros(len(words), np.int64)
        parent, label, levels, n = [np.zeros(1, np.int64)], [np.zeros(1, np.int64)], [(0, 1)], 1
        depth = 0
        while True:  # nodes of one depth, by parent and byte
            rows = rows[size[rows] > depth]
            if not len(rows):
                break
            ch = self.classes[flat[off[rows] + depth]]
            new = np.ones(len(rows), bool)
            new[1:] = (node[rows[1:]] != node[rows[:-1]]) | (ch[1:] != ch[:-1])
            parent.append(node[rows[new]])
            label.append(ch[new])
            node[rows] = n + np.cumsum(new) - 1
            levels.append((n, n + int(new.sum())))
            n += int(new.sum())
            depth += 1
            done = rows[size[rows] == depth]
            last[done] = node[done]
        parent, label = np.concatenate(parent), np.concatenate(label)
        slot, base = self._place(parent, label, n)
        m = int(max(slot.max(), base.max())) + 257
        self.base, self.check = np.zeros(m, np.int64), np.full(m, -1, np.int64)
        self.base[slot] = base
        self.check[slot[1:]] = slot[parent[1:]]
        self._levels = [(slot[a:b], slot[parent[a:b]], label[a:b]) for a, b in levels[1:]]
        return slot[last]

    @staticmethod
    def _place(parent: np.ndarray, label: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """A slot for each node and a base for each: nodes of several children by first fit, single children in what is left."""
        lo = np.searchsorted(parent[1:], np.arange(n)) + 1
        hi = np.searchsorted(parent[1:], np.arange(n), "right") + 1
        slot, base = np.zeros(n, np.int64), np.zeros(n, np.int64)
        free = np.ones(2 * n + 2048, bool)
        free[:257] = False  # the root is slot 0, and no base falls below 0
        many, at = np.flatnonzero(hi - lo > 1), 257
        for s in many[np.argsort(lo[many] - hi[many], kind="stable")].tolist():
            c = label[lo[s] : hi[s]]
            p = at
            while True:
                if p + 1024 > len(free):
                    free = np.concatenate([free, np.ones(len(free), bool)])
                ok = free[p : p + 256].copy()
                for d in (c[1:] - c[0]).tolist():
                    ok &= free[p + d : p + d + 256]
                k = int(ok.argmax())
                if ok[k]:
                    break
                p += 256
                at = p if p - at > 4096 else at  # what is as good as full is left behind
            base[s] = p + k - c[0]
            free[base[s] + c] = False
            slot[lo[s] : hi[s]] = base[s] + c
        one = np.flatnonzero(hi - lo == 1)
        room = np.flatnonzero(free)
        if len(room) < len(one):
            room = np.concatenate([room, len(free) + np.arange(len(one))])
        slot[lo[one]] = room[: len(one)]
        base[one] = room[: len(one)] - label[lo[one]]
        return slot, base

    def _link(self) -> None:
        """Failure links: the longest suffix that is a prefix of an alias; and the next state on them that ends an alias."""
        self.fail = np.zeros(len(self.base), np.int64)
        self.next_out = np.zeros(len(self.base), np.int64)
        for d, (slots, parents, labels) in enumerate(self._levels):
            if d:
                self.fail[slots] = self._moved(self.fail[parents], labels)
            f = self.fail[slots]
            self.next_out[slots] = np.where(self.count[f] > 0, f, self.next_out[f])
        self.some = (self.count > 0) | (self.next_out > 0)
        del self._levels

    def _moved(self, state: np.ndarray, c: np.ndarray) -> np.ndarray:
        t = self.base[state] + c
        out = np.where(self.check[t] == state, t, 0)
        open_ = np.flatnonzero((out == 0) & (state > 0))
        state, c = state[open_], c[open_]
        while len(open_):
            state = self.fail[state]
            t = self.base[state] + c
            hit = self.check[t] == state
            out[open_[hit]] = t[hit]
            more = ~hit & (state > 0)
            open_, state, c = open_[more], state[more], c[more]
        return out

    def occurrences(self, texts: Iterable[str | None], apart: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Every hit in the texts: row, alias, place in characters from 0; by row, place and alias. Hits that overlap count
        each; apart: of hits of one alias in one text, those that overlap an earlier counted one do not."""
        raw = [(t or "").lower().encode("utf-8", "surrogatepass") for t in texts]
        size = np.array([len(r) for r in raw], np.int64)
        off = np.cumsum(size) - size
        data = np.frombuffer(b"".join(raw), np.uint8)
        none = np.zeros(0, np.int64)
        if not len(data) or not len(self.aliases):
            return none, none, none
        lane = max(LANE, 4 * self.longest)
        parts = -(-size // lane)
        row = np.repeat(np.arange(len(raw)), parts)
        begin = off[row] + (np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)) * lane
        stop = np.minimum(begin + lane, off[row] + size[row])
        start = np.maximum(begin - self.longest + 1, off[row])
        order = np.argsort(start - stop, kind="stable")
        begin, stop, start, row = begin[order], stop[order], start[order], row[order]
        length = stop - start
        active = np.searchsorted(-length, -np.arange(int(length[0])), "left")
        classes = self.classes[data]
        state = np.zeros(len(start), np.int64)
        lanes, places, states = [], [], []
        for i, n in enumerate(active.tolist()):
            at = start[:n] + i
            state = self._moved(state[:n], classes[at])
            hit = np.flatnonzero(self.some[state])
            if len(hit):
                hit = hit[at[hit] >= begin[hit]]
                lanes.append(hit)
                places.append(at[hit] + 1)
                states.append(state[hit])
        if not lanes:
            return none, none, none
        rows, ends, found = row[np.concatenate(lanes)], np.concatenate(places), np.concatenate(states)
        out = []
        while len(found):  # all aliases that end here: the state's, and those on its links
            n = self.count[found]
            k = np.repeat(np.arange(len(found)), n)
            alias = self.own[np.repeat(self.first[found], n) + np.arange(len(k)) - np.repeat(np.cumsum(n) - n, n)]
            out.append((rows[k], alias, ends[k]))
            found = self.next_out[found]
            more = found > 0
            rows, ends, found = rows[more], ends[more], found[more]
        rows, alias, ends = (np.concatenate(x) for x in zip(*out))
        starts = ends - self.size[alias]
        ok = self._bounded(data, starts, ends, off[rows], off[rows] + size[rows], self.strict[alias])
        rows, alias, starts, ends = rows[ok], alias[ok], starts[ok], ends[ok]
        if apart:
            keep = _apart(rows, alias, starts, ends)
            rows, alias, starts = rows[keep], alias[keep], starts[keep]
        chars = np.r_[0, np.cumsum((data & 0xC0) != 0x80)]
        place = chars[starts] - chars[off[rows]]
        order = np.lexsort((alias, place, rows))
        return rows[order], alias[order], place[order]

    @staticmethod
    def _bounded(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lo: np.ndarray, hi: np.ndarray, strict: np.ndarray) -> np.ndarray:
        left, right = data[np.maximum(starts - 1, 0)], data[np.minimum(ends, len(data) - 1)]
        first, last = starts == lo, ends == hi
        plain = (first | ~_WORD[left]) & (last | ~_WORD[right])
        if not strict.any():
            return plain
        before, after = first | _APART[left], last | _APART[right]
        for w in _WIDE:
            b = np.frombuffer(w, np.uint8)
            k = np.arange(len(w))
            room = starts - len(w) >= lo
            before |= room & (data[np.maximum(starts[:, None] - len(w) + k, 0)] == b).all(axis=1)
            room = ends + len(w) <= hi
            after |= room & (data[np.minimum(ends[:, None] + k, len(data) - 1)] == b).all(axis=1)
        return np.where(strict, before & after, plain)

    def find(self, text: str) -> dict[str, tuple[int, int]]:
        """label: (hits, place of the first), overlapping hits included."""
        found: dict[str, tuple[int, int]] = {}
        for alias, place in zip(*(x.tolist() for x in self.occurrences([text])[1:])):
            label = self.labels[self.label_of[alias]]
            n, first = found.get(label, (0, place))
            found[label] = n + 1, min(first, place)
        return found


def _apart(rows: np.ndarray, alias: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    order = np.lexsort((starts, alias, rows))
    same = (rows[order][1:] == rows[order][:-1]) & (alias[order][1:] == alias[order][:-1])
    keep = np.ones(len(order), bool)
    free = -1
    tight = np.flatnonzero(same & (starts[order][1:] < ends[order][:-1])) + 1
    for i in tight.tolist():  # few: an alias that overlaps itself
        if keep[i - 1]:
            free = int(ends[order[i - 1]])
        keep[i] = starts[order[i]] >= free
    return order[keep]
