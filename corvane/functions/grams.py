"""Character n-grams (two to four) of many texts at a time, counted as numbers. Texts come lower-cased; a white-space run of two or more is one space."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

LEAST, MOST = 2, 4
#: Unicode's white space, as Java's (?U)\s has it (Python's \s has four control characters besides).
SPACES = "\t\n\x0b\x0c\r \x85\xa0 " + "".join(map(chr, range(0x2000, 0x200B))) + "    　"
_WHITE = np.zeros(0x3002, dtype=bool)
_WHITE[[ord(c) for c in SPACES]] = True
POINTS = 0x110000
#: More than the code points told apart at once; its fourth power is under 2**63.
BASE = 55_108


def slices(texts: list[str], size: int = 1 << 20) -> Iterator[list[str]]:
    """Texts in order, some ``size`` characters at a time."""
    held, n = [], 0
    for t in texts:
        if held and n + len(t) > size:
            yield held
            held, n = [], 0
        held.append(t)
        n += len(t)
    if held:
        yield held


def squeezed(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, and where each text ends."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    ends = np.cumsum(sizes)
    white = _WHITE[np.minimum(points, len(_WHITE) - 1)]
    before, after = np.zeros(len(points), dtype=bool), np.zeros(len(points), dtype=bool)
    before[1:], after[:-1] = white[:-1], white[1:]
    full = sizes > 0
    before[(ends - sizes)[full]] = False
    after[ends[full] - 1] = False
    keep = ~(white & before)
    points = np.where(white & (before | after), np.uint32(32), points)[keep]
    return points, np.concatenate([[0], np.cumsum(keep)])[ends]


class Counts:
    """(key, total, df) of the grams of all texts that it is given; keys are numbers of code points that ``points`` holds."""

    def __init__(self, most: int = 3_000_000):
        self.most = most
        self.code = np.zeros(POINTS, dtype=np.int64)
        self.points, self.held, self.rows = 0, [], 0

    def add(self, texts: list[str]) -> Iterator[tuple[np.ndarray, ...]]:
        """Takes texts; gives rows (see drain) when too many are held."""
        points, ends = squeezed(texts)
        new = np.unique(points)
        new = new[self.code[new] == 0]
        if self.points + len(new) >= BASE:
            yield from self.drain()
            new = np.unique(points)
        if len(new) >= BASE:
            yield from self.plainly(texts)
            return
        self.code[new] = np.arange(self.points + 1, self.points + 1 + len(new))
        self.points += len(new)
        c = self.code[points]
        two = c[:-1] * BASE + c[1:]
        keys, fresh, at = np.empty(3 * len(c), dtype=np.int64), np.zeros(3 * len(c), dtype=bool), 0
        by_size = (two * BASE**2, (two[:-1] * BASE + c[2:]) * BASE, two[:-2] * BASE**2 + two[2:])
        s = 0
        for e in ends.tolist():
            if e - s >= LEAST:
                own = np.concatenate([x[s : e - n + 1] for n, x in enumerate(by_size, LEAST) if e - s >= n])
                own.sort()
                keys[at : at + len(own)] = own
                fresh[at] = True
                at += len(own)
            s = e
        keys, fresh = keys[:at], fresh[:at]
        fresh[1:] |= keys[1:] != keys[:-1]
        of_texts = keys[fresh]
        if len(keys):
            keys.sort()
            of_texts.sort()
            self.held.append((keys[first := starts(keys)], runs(first, len(keys)), runs(starts(of_texts), len(of_texts))))
            self.rows += len(first)
        if self.rows > self.most:
            self.merge()
            if self.rows > self.most * 2 // 3:
                yield from self.drain()

    def merge(self) -> None:
        keys, total, df = (np.concatenate(x) for x in zip(*self.held))
        order = np.argsort(keys)
        keys, total, df = keys[order], total[order], df[order]
        first = starts(keys)
        self.held, self.rows = [(keys[first], np.add.reduceat(total, first), np.add.reduceat(df, first))], len(first)

    def drain(self) -> Iterator[tuple[np.ndarray, ...]]:
        """(high, low, total, df) of what is held, which then is empty. high and low are the gram's code points plus one, two and two, 0 for none: they sort as the grams do."""
        if self.held:
            self.merge()
            keys, total, df = self.held[0]
            back = np.zeros(BASE, dtype=np.int64)
            has = np.flatnonzero(self.code)
            back[self.code[has]] = has + 1
            a, b, c, d = (back[keys // BASE**i % BASE] for i in (3, 2, 1, 0))
            yield a << 21 | b, c << 21 | d, total, df
        self.code[:] = 0
        self.points, self.held, self.rows = 0, [], 0

    @staticmethod
    def plainly(texts: list[str]) -> Iterator[tuple[np.ndarray, ...]]:
        """drain() of texts of too many different code points."""
        for text in texts:
            points = squeezed([text])[0].tolist()
            for n in range(LEAST, MOST + 1):
                seen: dict[tuple[int, ...], int] = {}
                for i in range(len(points) - n + 1):
                    seen[g] = seen.get(g := tuple(points[i : i + n]), 0) + 1
                if seen:
                    x = np.array([(*(p + 1 for p in g), *[0] * (MOST - n)) for g in seen], dtype=np.int64)
                    yield x[:, 0] << 21 | x[:, 1], x[:, 2] << 21 | x[:, 3], np.array(list(seen.values()), dtype=np.int64), np.ones(len(seen), dtype=np.int64)


def starts(ordered: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(ordered) else np.zeros(0, dtype=np.int64)


def runs(first: np.ndarray, n: int) -> np.ndarray:
    return np.diff(np.append(first, n))


def spelled(high: int, low: int) -> str:
    """The gram of two numbers that drain() gives."""
    return "".join(chr(x - 1) for x in (high >> 21, high & 0x1FFFFF, low >> 21, low & 0x1FFFFF) if x)


class Trie:
    """Grams by their code points, one table a level: which of a model's grams ends where, without a search."""

    def __init__(self, grams: list[str], idx: list[int]):
        letters = sorted({c for g in grams for c in g})
        self.letter = np.zeros(POINTS, dtype=np.int32)
        self.letter[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        heads = {n: sorted({g[:n] for g in grams if len(g) >= n}) for n in range(1, MOST + 1)}
        number = {n: {h: i for i, h in enumerate(heads[n], 1)} for n in heads}
        self.step, self.idx = {}, {}
        for n in range(LEAST, MOST + 1):
            before = number[n - 1] if n > LEAST else {c: i for i, c in enumerate(letters, 1)}
            self.step[n] = np.zeros((len(before) + 1, len(letters) + 1), dtype=np.int32)
            self.idx[n] = np.full(len(heads[n]) + 1, -1, dtype=np.int64)
            for h, i in number[n].items():
                self.step[n][before[h[:-1]], self.letter[ord(h[-1])]] = i
        for g, i in zip(grams, idx):
            self.idx[len(g)][number[len(g)][g]] = i
        self.width = max(idx, default=-1) + 1

    def counts(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(text, idx, tf) of the model's grams in texts, in order of texts and idx."""
        base = 0
        for part in slices(texts, 1 << 18):
            points, ends = squeezed(part)
            letter = self.letter[points]
            state, text, found = letter, np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0)), []
            for n in range(LEAST, MOST + 1):
                state = self.step[n][state[: len(letter) - n + 1], letter[n - 1 :]]
                # a gram that goes over a text's end is none; what it leads to goes over it too
                state = np.where(text[: len(state)] == text[n - 1 :], state, 0)
                at = self.idx[n][state]
                has = np.flatnonzero(at >= 0)
                found.append(text[has] * self.width + at[has])
            slot, tf = np.unique(np.concatenate(found), return_counts=True)
            yield base + slot // max(1, self.width), slot % max(1, self.width), tf
            base += len(part)
