"""difflib's ratio of many pairs of short texts at once, in numpy.

The pairs of two lists are bounded from above by the characters in common. What is left is taken
apart as SequenceMatcher does: the longest common block, the earliest one of equal length, and then
what stands on both sides of it, for all pairs together. A common beginning is the first block
outright where it is so long, and repeats itself so little, that no other block can be longer."""

from __future__ import annotations

from difflib import SequenceMatcher

import numpy as np

#: From this length on SequenceMatcher leaves out frequent characters: such pairs go to it.
LONG = 200
_CLASSES = 64
_TILE = 1 << 18
_SOME = 1 << 15
_STEP = (1 << 16) + 257


class Texts:
    """Texts as codes of characters: (n, width), with their lengths and counts of characters."""

    def __init__(self, texts: list[str], alphabet: np.ndarray | None = None) -> None:
        self.texts = texts
        self.length = np.array([len(t) for t in texts], np.int64)
        width = max(int(self.length.max(initial=0)), 1)
        points = np.array(texts, f"U{width}").view(np.uint32).reshape(len(texts), width)
        inside = np.arange(width) < self.length[:, None]
        self.alphabet = np.unique(points[inside]) if alphabet is None else alphabet
        codes = np.searchsorted(self.alphabet, points) + 1
        self.codes = np.where(inside, codes, 0).astype(np.uint8 if len(self.alphabet) < 250 else np.uint32)
        classes = self.codes.astype(np.int64) % _CLASSES
        self.counts = np.zeros((_CLASSES, len(texts)), np.uint8)
        for k in range(width):
            at = np.flatnonzero(inside[:, k] & (self.length < LONG))
            self.counts[classes[at, k], at] += 1
        self.used = np.flatnonzero(self.counts.any(axis=1))

    def first_blocks(self) -> np.ndarray:
        """(n, p): how much may follow the first p characters, but for the one that differs, with
        no longer block than these. Another block would be moved by s against itself, and begin
        by then, so that what is left of the p characters would repeat with period s."""
        n, width = self.codes.shape
        most, least = np.zeros((n, width + 1), np.int16), np.full((n, width + 1), width, np.int16)
        open_ = np.ones((n, width + 1), bool)
        for s in range(1, width // 2 + 1):
            last = np.full((n, width + 1), -1, np.int16)
            unlike = self.codes[:, :-s] != self.codes[:, s:]
            # last place below p - s where a character differs from the one s behind it
            last[:, s + 1 :] = np.maximum.accumulate(np.where(unlike, np.arange(width - s, dtype=np.int16), -1), axis=1)
            least = np.minimum(least, last)
            open_ &= least >= s
            most[open_] = s
        return most


def _needed(threshold: float, total: int) -> np.ndarray:
    """By the sum of two lengths, how many characters must match."""
    sums = np.arange(total + 1)
    low = np.maximum(np.ceil(threshold * sums / 2).astype(np.int64) - 1, 0)
    for _ in range(2):
        low = np.where(2.0 * low / np.maximum(sums, 1) < threshold, low + 1, low)
    return low


def _longest(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """x (m, n) and y (k, n): of each pair the longest block, as run << 16 less its places."""
    best = np.zeros(x.shape[1], np.int32)
    runs = [np.zeros(x.shape[1], np.int32) for _ in range(len(y) + 1)]
    for i in range(len(x)):
        for j in range(len(y) - 1, -1, -1):
            run = runs[j] + _STEP
            run *= x[i] == y[j]
            runs[j + 1] = run
            np.maximum(best, run - ((i + 1) * 256 + j + 1), out=best)
    return best


def _matched(a: Texts, b: Texts, i: np.ndarray, j: np.ndarray, start: np.ndarray, need: np.ndarray, whole: bool) -> np.ndarray:
    """The matching characters of pairs that share the first start characters, or, if not whole,
    at least as many as needed if they have them; fewer than needed means no more than that."""
    width_a, width_b = a.codes.shape[1], b.codes.shape[1]
    flat_a, flat_b, none = a.codes.ravel(), b.codes.ravel(), np.iinfo(a.codes.dtype).max
    found, rest = start.copy(), np.minimum(a.length[i], b.length[j]) - start
    todo = np.flatnonzero((rest > 0) & (found + rest >= need) & (whole | (found < need)))
    a_lo, a_n, b_lo, b_n = start[todo], a.length[i[todo]] - start[todo], start[todo], b.length[j[todo]] - start[todo]
    while len(todo):
        round_up = lambda n: np.where(n <= 6, n, (n + 3) // 4 * 4)
        kinds = round_up(a_n) * 256 + round_up(b_n)
        order = np.argsort(kinds, kind="stable")
        begins = np.flatnonzero(np.diff(kinds[order], prepend=-1))
        parts = []
        for at, to in zip(begins, [*begins[1:], len(order)]):
            m, k = divmod(int(kinds[order[at]]), 256)
            for low in range(at, to, _SOME):
                s = order[low : min(low + _SOME, to)]
                p, al, an, bl, bn = todo[s], a_lo[s], a_n[s], b_lo[s], b_n[s]
                from_a, from_b = i[p] * width_a + al, j[p] * width_b + bl
                x = np.stack([flat_a.take(from_a + q, mode="clip") for q in range(m)])
                y = np.stack([flat_b.take(from_b + q, mode="clip") for q in range(k)])
                if m > 6:
                    x[np.arange(m)[:, None] >= an] = none
                if k > 6:
                    y[np.arange(k)[:, None] >= bn] = none - 1
                best = _longest(x, y).astype(np.int64)
                run = (best + 65535) >> 16
                place = (run << 16) - best
                sa, sb = place >> 8, place & 255
                np.add.at(found, p, run)
                np.add.at(rest, p, -np.minimum(an, bn))
                for keep, new in (((run > 0) & (sa > 0) & (sb > 0), (al, sa, bl, sb)), ((run > 0) & (an > sa + run) & (bn > sb + run), (al + sa + run, an - sa - run, bl + sb + run, bn - sb - run))):
                    new = (p[keep], *[c[keep] for c in new])
                    np.add.at(rest, new[0], np.minimum(new[2], new[4]))
                    parts.append(new)
        todo, a_lo, a_n, b_lo, b_n = (np.concatenate(c) for c in zip(*parts))
        open_ = (found + rest >= need)[todo] & (whole | (found < need)[todo])
        todo, a_lo, a_n, b_lo, b_n = (c[open_] for c in (todo, a_lo, a_n, b_lo, b_n))
    return found


def alike(a_texts: list[str], b_texts: list[str], threshold: float, wanted, whole: bool):
    """Yields (i, j, matched) of the pairs with a ratio of the threshold or more, in arrays. wanted
    tells of some rows of a which pairs with all of b to look at. whole: matched is exact, else
    enough to know."""
    both = Texts(a_texts + b_texts)
    a, b = Texts(a_texts, both.alphabet), Texts(b_texts, both.alphabet)
    need_of, first = _needed(threshold, 2 * both.codes.shape[1]), a.first_blocks() if a.codes.shape[1] < LONG else None
    rows = max(_TILE // max(len(b_texts), 1), 1)
    for low in range(0, len(a_texts), rows):
        part = slice(low, min(low + rows, len(a_texts)))
        la, lb = a.length[part][:, None], b.length[None, :]
        need = need_of[la + lb]
        ok = wanted(part) & (np.minimum(la, lb) >= need)
        far = ok & ((la >= LONG) | (lb >= LONG))
        for i, j in zip(*np.nonzero(far)):
            matcher = SequenceMatcher(None, a_texts[low + i], b_texts[j])
            if matcher.ratio() >= threshold:
                yield np.array([low + i]), np.array([j]), np.array([sum(m.size for m in matcher.get_matching_blocks())])
        common = np.zeros(ok.shape, np.uint8)
        for c in both.used:
            common += np.minimum(a.counts[c, part][:, None], b.counts[c][None, :])
        ok &= ~far & (common >= need)
        same, prefix = np.ones(ok.shape, bool), np.zeros(ok.shape, np.uint8)
        for k in range(min(a.codes.shape[1], b.codes.shape[1], LONG)):
            same &= (a.codes[part, k][:, None] == b.codes[:, k][None, :]) & (a.codes[part, k] > 0)[:, None]
            if not same.any():
                break
            prefix += same
        i, j = np.nonzero(ok)
        if not len(i):
            continue
        start, need, i = prefix[i, j].astype(np.int64), need[i, j], i + low
        behind = np.maximum(a.length[i], b.length[j]) - start - 1
        clear = (behind <= 0) | (behind <= first[i, start]) if first is not None else behind <= 0
        found = _matched(a, b, i, j, np.where(clear, start, 0), need, whole)
        good = found >= need
        yield i[good], j[good], found[good]


def needed_behind(texts: list[str], threshold: float, behind: int) -> list[int | None]:
    """Of texts longer than behind how many of their last characters must match those of a text of the same
    length and the same beginning; none where another block could come before a common beginning that long."""
    both = Texts(texts)
    first, need = both.first_blocks(), _needed(threshold, 2 * both.codes.shape[1])
    clear = np.ones(len(texts), bool)
    for j in range(1, behind + 1):
        clear &= first[np.arange(len(texts)), both.length - j] >= j - 1
    return [int(need[2 * n]) - int(n - behind) if c else None for n, c in zip(both.length, clear)]


class Alike:
    """Counts, among texts of so many characters, those of which need match a given one behind what begins both.

    What a text matches depends on its own characters alone: to it, all others are one. So
    texts are counted by their patterns in a set of characters, and a text with this set adds up
    the counts of the patterns alike to its own, which are the same for all texts that repeat
    their characters at the same places."""

    def __init__(self, width: int, need: int) -> None:
        self.width, self.need, self.known = width, need, {}

    def patterns(self, form: tuple[int, ...]) -> np.ndarray:
        """(width, n): the patterns alike to a form, whose characters are numbered as they come;
        a number beyond them is any other."""
        if form not in self.known:
            k = max(form) + 1
            of = np.indices((k + 1,) * self.width, np.uint8).reshape(self.width, -1)
            start = np.cumprod(of == np.array(form, np.uint8)[:, None], axis=0).sum(axis=0)
            letters = lambda codes: (codes.T.astype(np.uint32) + ord("A")).copy().view(f"U{self.width}").ravel().tolist()
            b = Texts(letters(of))
            a = Texts(letters(np.array(form)[:, None]), b.alphabet)
            n = of.shape[1]
            found = _matched(a, b, np.zeros(n, np.int64), np.arange(n), start.astype(np.int64), np.full(n, self.need), False)
            self.known[form] = np.ascontiguousarray(of[:, found >= self.need].astype(np.int64))
        return self.known[form]

    def counts(self, a_texts: list[str], b_texts: str) -> np.ndarray:
        """Of each of a_texts how many of b_texts, written one behind the other, are alike."""
        points = lambda t: np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32).reshape(-1, self.width)
        a, b = points("".join(a_texts)), points(b_texts)
        alphabet = np.unique(a)
        # what no text of a holds is the number behind the alphabet
        at = np.minimum(np.searchsorted(alphabet, b), len(alphabet) - 1)
        b = np.where(alphabet[at] == b, at, len(alphabet)).T.copy()
        sets: dict[tuple, list[int]] = {}
        for row, text in enumerate(np.searchsorted(alphabet, a).tolist()):
            sets.setdefault(tuple(sorted(set(text))), []).append(row)
        out, a = np.zeros(len(a_texts), np.int64), np.searchsorted(alphabet, a).tolist()
        for held, rows in sets.items():
            k = len(held)
            number = np.full(len(alphabet) + 1, k)
            number[list(held)] = np.arange(k)
            flat = np.zeros(b.shape[1], np.int64)
            for codes in b:
                flat = flat * (k + 1) + number[codes]
            n = np.bincount(flat, minlength=(k + 1) ** self.width)
            for row in rows:
                come = list(dict.fromkeys(a[row]))
                own = np.array([*number[come], k])
                flat = 0
                for codes in self.patterns(tuple(come.index(c) for c in a[row])):
                    flat = flat * (k + 1) + own[codes]
                out[row] = n[flat].sum()
        return out
