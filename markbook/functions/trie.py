"""Replacing phrases of a large dictionary: longest match from left to right on a double-array trie.

The trie is two integer arrays: the child of state s over symbol c is at base[s] + c if check there says s.  A whole batch of texts
is one array of code points, and every position takes its steps at once: after d steps only those positions are left at
which some phrase of more than d characters may begin, which in running text are few.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import cached_property

import numpy as np

CODE_POINTS = 0x110000
SLICE = 1 << 18  # code points converted at once; each takes about 60 bytes while it is
FULL = 64  # places tried in vain before the search for free ones begins further on


class Trie:
    """Phrases and single characters with what they become.  ``chars`` are replaced where no phrase matches."""

    def __init__(self, chars: dict[str, str], phrases: dict[str, str]):
        self.chars = {c: t for c, t in chars.items() if len(c) == 1 and len(t) == 1}
        self.phrases = {p: t for p, t in phrases.items() if p}

    @property
    def parts(self) -> tuple:
        """Plain values that ``of`` makes the same trie from."""
        return self.chars, self.arrays

    @classmethod
    def of(cls, parts: tuple) -> Trie:
        trie = cls(parts[0], {})
        trie.arrays = parts[1]
        return trie

    @cached_property
    def arrays(self) -> tuple[np.ndarray, ...]:
        """(code points in use, base, check, which phrase ends in a state or -1, target starts, targets)."""
        listed = sorted(self.phrases)
        used = np.array(sorted({ord(c) for p in listed for c in p}), np.int64)
        symbol = {int(c): i + 1 for i, c in enumerate(used)}
        size = 1 << max(10, (2 * sum(map(len, listed)) + 2 * len(used)).bit_length())
        base, check, ends = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
        check[0] = 0
        # Phrases are sorted, so a state is a stretch of them that share their first characters.
        waiting, low = [(0, 0, len(listed), 0)], 1
        for state, first, last, depth in waiting:
            if first < last and len(listed[first]) == depth:
                ends[state] = first
                first += 1
            children: list[list[int]] = []
            for i in range(first, last):
                c = symbol[ord(listed[i][depth])]
                if children and children[-1][0] == c:
                    children[-1][2] = i + 1
                else:
                    children.append([c, i, i + 1])
            if not children:
                continue
            over = np.array([c for c, _, _ in children])
            place, tries = max(low - int(over[0]), 0), 0
            while True:
                if place + int(over[-1]) >= len(check):
                    grown = len(check)
                    base, check, ends = np.append(base, np.zeros(grown, np.int32)), np.append(check, np.full(grown, -1, np.int32)), np.append(ends, np.full(grown, -1, np.int32))
                if (check[place + over] < 0).all():
                    break
                place, tries = place + 1, tries + 1
            base[state] = place
            check[place + over] = state
            if tries > FULL or len(children) == 1:
                low = max(low, place + int(over[0]))
            waiting.extend((place + c, a, b, depth + 1) for c, a, b in children)
        targets = [self.phrases[p] for p in listed]
        starts = np.concatenate([[0], np.cumsum([len(t) for t in targets])]).astype(np.int64)
        return used, base, check, ends, starts, _points("".join(targets))

    @cached_property
    def _symbols(self) -> np.ndarray:
        out = np.zeros(CODE_POINTS + 1, np.int32)
        used = self.arrays[0]
        out[used] = np.arange(1, len(used) + 1)
        return out

    @cached_property
    def _mapped(self) -> np.ndarray:
        out = np.arange(CODE_POINTS, dtype=np.uint32)
        for c, t in self.chars.items():
            out[ord(c)] = ord(t)
        return out

    def matches(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(where, how long, which phrase) of the longest match at every position that has one; CODE_POINTS ends a text."""
        _, base, check, ends, _, _ = self.arrays
        symbols = self._symbols[points]
        at = np.flatnonzero(symbols)
        state = np.zeros(len(at), np.int32)
        length, which = np.zeros(len(points), np.int32), np.full(len(points), -1, np.int32)
        depth = 0
        while len(at):
            inside = at + depth < len(points)
            at, state = at[inside], state[inside]
            c = symbols[at + depth]
            to = base[state] + c
            goes = (c > 0) & (to < len(check))
            goes[goes] = check[to[goes]] == state[goes]
            at, state = at[goes], to[goes]
            depth += 1
            found = ends[state] >= 0
            length[at[found]], which[at[found]] = depth, ends[state[found]]
        where = np.flatnonzero(length)
        return where, length[where], which[where]

    def convert(self, texts: Sequence[str | None]) -> list[str | None]:
        """The texts converted, in slices of about SLICE code points, however many texts a batch has."""
        out: list[str | None] = []
        first = size = 0
        for i, text in enumerate(texts):
            size += len(text or "")
            if size >= SLICE:
                out += self._converted(texts[first: i + 1])
                first, size = i + 1, 0
        return out + self._converted(texts[first:]) if first < len(texts) else out

    def _converted(self, texts: Sequence[str | None]) -> list[str | None]:
        held = [t for t in texts if t is not None]
        points = _points(chr(0).join([*held, ""])) if held else np.zeros(0, np.uint32)
        sizes = np.array([len(t) for t in held], np.int64)
        stops = np.cumsum(sizes + 1) - 1
        cut = points.astype(np.int64)
        cut[stops] = CODE_POINTS
        where, length, which = self.matches(cut)
        keep = _first_come(where, where + length)
        where, length, which = where[keep], length[keep], which[keep]
        starts, targets = self.arrays[4:]
        width = np.ones(len(points), np.int64)
        covered = np.repeat(where, length) + _within(length)
        width[covered] = 0
        given = starts[which + 1] - starts[which]
        width[where] = given
        ends = np.cumsum(width)
        out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint32)
        single = np.ones(len(points), bool)
        single[covered] = False
        out[ends[single] - 1] = self._mapped[points[single]]
        inner = _within(given)
        out[np.repeat(ends[where] - given, given) + inner] = targets[np.repeat(starts[which], given) + inner]
        whole = out.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
        last = ends[stops] - 1 if len(stops) else []
        done = iter(whole[a:b] for a, b in zip([0, *(x + 1 for x in last)], last))
        return [None if t is None else next(done) for t in texts]


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def _within(lengths: np.ndarray) -> np.ndarray:
    """0 .. n - 1 for each n."""
    total = np.cumsum(lengths)
    return np.arange(int(total[-1]) if len(total) else 0) - np.repeat(total - lengths, lengths)


def _first_come(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """True for matches that begin after all chosen ones before have ended; only stretches of overlapping ones are walked."""
    keep = np.ones(len(starts), bool)
    reach = np.maximum.accumulate(ends) if len(ends) else ends
    free = np.append(True, starts[1:] >= reach[:-1]) if len(starts) else keep
    heads = np.flatnonzero(free)
    sizes = np.diff(np.append(heads, len(starts)))
    for head, size in zip(heads[sizes > 1].tolist(), sizes[sizes > 1].tolist()):
        end = 0
        for i in range(head, head + size):
            keep[i] = starts[i] >= end
            if keep[i]:
                end = ends[i]
    return keep
