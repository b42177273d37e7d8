"""Evaluation texts leaking into training text, by spaced-seed hashing.

Texts become rows of normalised words. A mask names some positions of a window and leaves out others; the words at the named
positions give a hash, so that a window still hits when words at the left-out positions differ. The hashes of all
windows of the test texts are joined with those of all documents. Where they meet, the two texts are aligned
word by word, allowing altered and missing words and interruptions, and the longest stretch of the test text is measured.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage


@dataclass(frozen=True)
class Search:
    words: int = 15  # words of the test text that a document must hold in a row
    # positions that count; together they hit any 15 words of which any 3 are altered
    masks: tuple[tuple[int, ...], ...] = ((0, 1, 2, 4, 5), (0, 1, 3, 7, 8), (0, 3, 4, 5, 6))
    straight: float = 0.8  # share of a stretch's words that must be equal or near where it stands word for word in its place: 12 of 15, as many as the masks look for
    equal: float = 0.66  # share of those that must be equal
    agree: float = 0.88  # share that must be equal or near where words are put in or left out
    left: int = 3  # successive words of the test text that a stretch may lack
    around: int = 24  # a test word is looked for up to so many words from where a hit expects it; pieces farther off need hits of their own
    block: int = 1 << 26  # characters of test texts that the tasks hold at once when they verify
    rows: int = 1 << 20  # test windows up to which their table is broadcast for the join


# the character itself first: a search for one of a set skips fast
_HYPHEN = re.compile("-(?<=[^\\W\\d_]-)[ \t]*\r?\n\\s*(?=[^\\W\\d_])")
_INVISIBLE = re.compile("[\u00ad\u200b-\u200d\u2060\ufeff]+")
_ACCENTS = re.compile("[\u0300-\u036f]+")
_DIGITS = re.compile("[.,' \u2019\u00a0\u202f\u2009](?<=\\d.)(?:(?<! )(?=\\d)|(?=\\d{3}(?!\\d)))")
_WORD = re.compile(r"[^\W_]+")
_PLAIN = {i: " " for i in range(128) if not chr(i).isalnum()}  # the same for plain texts


def words(text: str | None) -> list[str]:
    """Words without case, accents, punctuation, soft or line-end hyphens and number separators; NULL gives none."""
    if not text:
        return []
    t = text.casefold()
    if not t.isascii():
        t = _ACCENTS.sub("", unicodedata.normalize("NFKD", _INVISIBLE.sub("", t)))
    if "-" in t and "\n" in t:
        t = _HYPHEN.sub("", t)
    t = _DIGITS.sub("", t)
    return t.translate(_PLAIN).split() if t.isascii() else _WORD.findall(t)


class _Bits(dict):
    """A bit for every character; a few characters may share one."""

    def __missing__(self, c: str) -> int:
        b = self[c] = 1 << (ord(c) & 63)
        return b


class Vocabulary:
    """Numbers of words, with the hash and, if asked for, ``looks``: the set of letters (as 64 bits), the length and the first and last letter of each number's word."""

    def __init__(self, letters: bool = False) -> None:
        self.letters, self.bit = letters, _Bits()
        self.reset()

    def reset(self) -> None:
        self.of: dict[str, int] = {}
        self.hash, self.looks = np.empty(0, np.uint64), (np.empty(0, np.uint64), *(np.empty(0, np.int64) for _ in range(3)))

    def hashes(self, ws: list[str]) -> np.ndarray:
        own = self.numbers(ws)
        return self.hash[own]

    def numbers(self, ws: list[str]) -> np.ndarray:
        """The numbers of words; those given before may no longer hold."""
        if len(self.of) > 1_000_000:
            self.reset()
        new = list(set(ws).difference(self.of))
        if new:
            self.of.update(zip(new, range(len(self.of), len(self.of) + len(new)), strict=True))
            self.hash = np.append(self.hash, np.array(list(map(xxhash.xxh3_64_intdigest, new)), np.uint64))
            if self.letters:
                bit = self.bit.__getitem__
                more = [sum(set(map(bit, w))) for w in new], list(map(len, new)), [ord(w[0]) for w in new], [ord(w[-1]) for w in new]
                self.looks = tuple(np.append(v, np.array(x, v.dtype)) for v, x in zip(self.looks, more, strict=True))
        return np.fromiter(map(self.of.__getitem__, ws), np.int64, len(ws))


@functools.lru_cache(maxsize=1)
def _coefficients() -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(f"place {i}") | 1 for i in range(64)], np.uint64)


def _windows(tok: np.ndarray, masks: tuple[tuple[int, ...], ...]) -> Iterator[tuple[int, np.ndarray]]:
    """Per mask: its span and the hash of every window start (windows that reach past the end are left out)."""
    c = _coefficients()
    for k, mask in enumerate(masks):
        span = mask[-1] + 1
        n = max(0, len(tok) - span + 1)
        h = np.full(n, np.uint64(k + 1) * c[63], np.uint64)
        for o in mask:
            h += tok[o : o + n] * c[o]
        h ^= h >> np.uint64(31)
        yield span, h * c[62]


def near(a: str, b: str) -> bool:
    """Whether two words differ by a light alteration: one or two letters changed, added, left out or swapped, but not both the first and the last."""
    if a == b:
        return True
    if not a or not b or (a[0] != b[0] and a[-1] != b[-1]):
        return False
    n = max(len(a), len(b))
    most = 0 if n < 4 else 1 if n < 8 else 2
    if abs(len(a) - len(b)) > most or (a.isdigit() and b.isdigit()):
        return False
    lo, hi = 0, min(len(a), len(b))
    while lo < hi and a[lo] == b[lo]:
        lo += 1
    while hi > lo and a[hi - min(len(a), len(b)) - 1] == b[hi - min(len(a), len(b)) - 1]:
        hi -= 1
    # what differs, without the equal letters at both ends
    a, b = a[lo : len(a) - min(len(a), len(b)) + hi], b[lo : len(b) - min(len(a), len(b)) + hi]
    if most == 0 or (most == 1 and max(len(a), len(b)) > 1):
        return most == 1 and len(a) == len(b) == 2 and a == b[::-1]
    if len(a) == 0 or len(b) == 0:
        return True
    row = list(range(len(b) + 1))
    before = row
    for i, x in enumerate(a, 1):
        older, before, row = before, row, [i]
        for j, y in enumerate(b, 1):
            v = min(before[j] + 1, row[j - 1] + 1, before[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                v = min(v, older[j - 2] + 1)
            row.append(v)
        if min(row) > most:
            return False
    return row[-1] <= most


def parts_of(text: str) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The words of a test text as compared, for each the number of the word of the text (as written) that it stands in, and whether it is a name or a number.

    Names are words with a capital that do not begin a sentence.
    """
    w, of, fixed = [], [], []
    begins = True
    for i, part in enumerate(_DIGITS.sub("", text or "").split()):
        got = words(part)
        w += got
        of += [i] * len(got)
        name = not begins and any(c.isupper() for c in part[:3])
        fixed += [name or x.isdigit() for x in got]
        begins = part[-1] in ".!?:" if got else begins
    return w, np.array(of, np.int64), np.array(fixed, bool)


class Test:
    """A test text made ready for comparison."""

    def __init__(self, item: int, text: str, known: Vocabulary, s: Search):
        self.item = item
        self.words, self.of, self.fixed = parts_of(text)
        of = self.of
        own = known.numbers(self.words)
        self.tok, self.letters = known.hash[own], tuple(v[own] for v in known.looks)
        self.digits = np.array([w.isdigit() for w in self.words], bool)
        # fewest words, as compared, in a stretch of s.words (places without any, such as dashes, count there too)
        begins = of + s.words - 1 <= of[-1]
        self.rows = int((np.searchsorted(of, of + s.words - 1) - np.arange(len(of)))[begins].min()) + 1


class Tests:
    """Test texts, at least one, laid end to end."""

    def __init__(self, rows: list[tuple[int, int, str]], s: Search):
        self.known = Vocabulary(letters=True)
        self.all = [Test(item, text, self.known, s) for _, item, text in rows]
        self.number = {e: i for i, (e, _, _) in enumerate(rows)}
        self.start = np.concatenate([[0], np.cumsum([len(t.tok) for t in self.all])]).astype(np.int64)
        self.tok = np.concatenate([t.tok for t in self.all])
        self.rows = np.array([t.rows for t in self.all], np.int64)
        self.letters = tuple(map(np.concatenate, zip(*(t.letters for t in self.all), strict=True)))
        self.fixed = np.concatenate([t.fixed for t in self.all])


_MISS, _OPEN, _STEP, _FAR = 2.5, 1.0, 0.05, 4.0


def align(same: np.ndarray, at: np.ndarray, most: int = 1 << 25) -> list[tuple[int, int]]:
    """Best local alignment of rows (test words) and columns (document words): the aligned pairs, in order.

    ``at`` holds the columns' places in the document (-1: a cut, that nothing is aligned with). An equal pair counts 1, an unequal one and a test word left out
    -2.5; words put in between cost 1 and 0.05 each, but never more than 4, so that two pieces of five words are joined over any interruption. Rows are
    halved, with an overlap, where rows times columns exceed ``most``.
    """
    n, m = same.shape
    if n * m > most and n > 256:
        half, lap = n // 2, n // 8
        first, second = align(same[: half + lap], at, most), align(same[half - lap :], at, most)
        return first if len(first) >= len(second) else [(i + half - lap, j) for i, j in second]
    score = np.where(same, np.float32(1), np.float32(-_MISS))
    score[:, at < 0] = -1e6
    h = np.zeros((n + 1, m + 1), np.float32)  # best alignment that ends at or, after words put in, before this column
    base = np.zeros((n + 1, m + 1), np.float32)  # the same without words put in at the end
    place = np.maximum.accumulate(np.concatenate([[0], at + 1]))
    step = (_STEP * (place - place[0])).astype(np.float32)
    late = step + np.float32(_OPEN)
    for i in range(1, n + 1):
        best = base[i]
        np.add(h[i - 1, :-1], score[i - 1], out=best[1:])
        np.maximum(best, h[i - 1] - np.float32(_MISS), out=best)
        np.maximum(best, 0, out=best)
        np.maximum(best, np.maximum.accumulate(best + step) - late, out=h[i])
        np.maximum(h[i], np.maximum.accumulate(best) - np.float32(_FAR), out=h[i])
    i, k = (int(x) for x in np.unravel_index(int(base.argmax()), h.shape))
    pairs = []
    while i > 0 and k > 0 and h[i, k] > 0:
        if h[i, k] > base[i, k]:  # words put in: back to where they begin
            near_, far = int(np.argmax(base[i, : k + 1] + step[: k + 1])), int(np.argmax(base[i, : k + 1]))
            k = near_ if base[i, near_] + step[near_] - late[k] >= base[i, far] - _FAR else far
        if base[i, k] <= 0:
            break
        if base[i, k] == h[i - 1, k - 1] + score[i - 1, k - 1]:
            pairs.append((i - 1, k - 1))
            k -= 1
        i -= 1
    return pairs[::-1]


def longest_run(rows: np.ndarray, of: np.ndarray, agree: float) -> tuple[int, int]:
    """First and last of the agreeing ``rows`` (rising) that hold most words of the text while ``agree`` of the rows between them agree."""
    n = of[rows]
    # the share holds from a to b where u[b + 1] >= u[a]; the best b of each a is the last such, found on the maxima from behind
    k = np.arange(len(rows))
    begin, end = k - agree * rows, k + 1 - agree * (rows + 1)
    behind = np.maximum.accumulate(end[::-1])[::-1]
    last = len(rows) - 1 - np.searchsorted(behind[::-1], begin - 1e-9, side="left")
    a = int(np.argmax(n[last] - n))
    return a, int(last[a])


_near = functools.lru_cache(1 << 17)(near)
_Letters = tuple[np.ndarray, ...]


def may_be_near(x: _Letters, y: _Letters) -> np.ndarray:
    """Whether words may be near by their ``looks``: one alteration changes the set of letters by two at most."""
    n = np.maximum(x[1], y[1])
    most = (n >= 4).astype(np.int8) + (n >= 8)
    return ((x[2] == y[2]) | (x[3] == y[3])) & (most > 0) & (np.bitwise_count(x[0] ^ y[0]) <= 2 * most) & (np.abs(x[1] - y[1]) <= most)


def could_hold(t: Test, doc: list[str], y: _Letters, same: np.ndarray, s: Search, free: np.ndarray) -> bool:
    """Whether words for a stretch occur at all, in whatever order: ``s.agree`` of its words need an equal (``free``) or a near one.

    ``y`` holds the ``looks`` of the document's words.
    """
    there = free.any(axis=1)

    def enough() -> bool:  # some rows or more of which s.agree are there
        f = np.concatenate([[0.0], np.cumsum(there - s.agree)])
        return bool((f[t.rows :] >= np.minimum.accumulate(f[: len(f) - t.rows]) - 1e-9).any())

    at = np.flatnonzero(~there)
    if not len(at):
        return True
    close = may_be_near(tuple(v[at, None] for v in t.letters), y) & ~same[at]
    there[at] = close.any(axis=1)
    if not enough():
        return False
    # word by word, until too many have nothing near
    for k, i in enumerate(at.tolist()):
        if there[i] and not any(_near(t.words[i], doc[j]) for j in np.flatnonzero(close[k]).tolist()):
            there[i] = False
            if not enough():
                return False
    return True


def _parted(pairs: list[tuple[int, int]], t: Test, doc: list[str], left: int) -> Iterator[list[tuple[int, int]]]:
    """``pairs`` cut where more than ``left`` test words are missing, and where the document has another number in a test number's stead: there it tells something else.

    A number that the document breaks up, such as 6 528 for 6528, is the same number.
    """
    part = pairs[:1]
    for (i, j), (k, m) in zip(pairs, pairs[1:], strict=False):
        cut = k - i - 1 > left
        if not cut and t.digits[i + 1 : k].any() and m - j <= 2 * (k - i) + 4:
            wanted, given = ("".join(w for w in ws if w.isdigit()) for ws in (t.words[i + 1 : k], doc[j + 1 : m]))
            cut = given not in ("", wanted)
        if cut:
            yield part
            part = []
        part.append((k, m))
    if part:
        yield part


def stretch(t: Test, doc: list[str], at: np.ndarray, same: np.ndarray, s: Search, holds: Callable[[np.ndarray], bool] = np.any) -> int:
    """Words of the test text in its longest stretch that the document's words hold; 0 if there is none.

    Where an alignment as a whole agrees too little, its longest run that does agree counts. Its pairs are then taken out and the rest is
    aligned again, as long as ``holds`` says so.
    """
    agrees = lambda i, j: same[i, j] or (at[j] >= 0 and near(t.words[i], doc[j]))
    of, free, most = t.of, same.copy(), 0
    while most < of[-1] - of[0] + 1 and (pairs := align(free, at)):
        taken = tuple(np.array(pairs).T)
        # a lightly altered word at an end belongs to the stretch
        got = _grown([p for p in pairs if agrees(*p)], agrees, same.shape)
        for part in _parted(got, t, doc, s.left):
            a, b = longest_run(np.array([i for i, _ in part]), of, s.agree)
            run = _grown(part[a : b + 1], agrees, same.shape)
            most = max(most, int(of[run[-1][0]] - of[run[0][0]] + 1))
        before = int(free.sum())
        free[taken] = False
        if int(free.sum()) == before or not holds(free):
            break
    return most


def _grown(pairs: list[tuple[int, int]], agrees: Callable[[int, int], bool], shape: tuple[int, int]) -> list[tuple[int, int]]:
    """Agreeing pairs with those that follow at both ends on the same diagonal."""
    pairs = list(pairs)
    for step, stop_i, stop_j in ((-1, -1, -1), (1, *shape)) if pairs else ():
        i, j = pairs[0 if step < 0 else -1]
        while i + step != stop_i and j + step != stop_j and agrees(i + step, j + step):
            i, j = i + step, j + step
            pairs.insert(0 if step < 0 else len(pairs), (i, j))
    return pairs


def columns(n: int, rows: int, diagonals: np.ndarray, s: Search) -> np.ndarray:
    """Places of a document of ``n`` words that an alignment looks at: those around the (rising) diagonals hit, with -1 at every cut."""
    lo, hi = np.maximum(diagonals - s.around, 0), np.minimum(diagonals + rows + s.around, n)
    new = np.concatenate([[True], lo[1:] > hi[:-1]])
    begin, end = lo[new], np.append(hi[:-1][new[1:]], hi[-1])
    if len(begin) == 1:
        return np.arange(begin[0], end[0])
    out = [x for a, b in zip(begin.tolist(), end.tolist(), strict=True) for x in (np.arange(a, b), np.array([-1]))]
    return np.concatenate(out[:-1])


def banded(rows: int, at: np.ndarray, diagonals: np.ndarray, s: Search) -> np.ndarray:
    """Which cells lie up to ``s.around`` words from a hit's diagonal."""
    off = at[None, :] - np.arange(rows)[:, None]
    # diagonals that lie close together make one band
    cut = np.flatnonzero(np.diff(diagonals) > 2 * s.around + 1)
    band = np.zeros(off.shape, bool)
    for a, b in zip(diagonals[np.append(0, cut + 1)].tolist(), diagonals[np.append(cut, len(diagonals) - 1)].tolist(), strict=True):
        band |= (off >= a - s.around) & (off <= b + s.around)
    return band & (at >= 0)


def straight(t: Test, doc: list[str], tok: np.ndarray, diagonal: int, s: Search) -> int:
    """Words of the longest stretch of the test text that stands in the document word for word from ``diagonal`` on, ``s.straight`` of them equal or near."""
    lo, hi = max(0, -diagonal), min(len(t.tok), len(doc) - diagonal)
    rows = np.arange(lo, hi)
    same = t.tok[lo:hi] == tok[lo + diagonal : hi + diagonal]
    other = np.flatnonzero(~same)
    there = same.copy()
    there[other] = [_near(t.words[lo + k], doc[lo + k + diagonal]) for k in other.tolist()]
    # where a name or a number is replaced the text tells something else
    ends = [*np.flatnonzero(~there & t.fixed[lo:hi]).tolist(), len(rows)]
    most, begin = 0, 0
    for end in ends:
        own = np.flatnonzero(there[begin:end]) + begin
        begin = end + 1
        for own in np.split(own, np.flatnonzero(np.diff(own) > s.left + 1) + 1) if len(own) else ():
            a, b = longest_run(rows[own], t.of, s.straight)
            if same[own[a : b + 1]].sum() >= s.equal * (own[b] - own[a] + 1):
                most = max(most, int(t.of[rows[own[b]]] - t.of[rows[own[a]]] + 1))
    return most


def leaks_of(docs: list[list[str]], doc_of: np.ndarray, key: np.ndarray, diagonal: np.ndarray, tests: Tests, s: Search) -> list[tuple[int, int, int]]:
    """(number of the document, test item, words of the longest stretch) of documents as words.

    The hits: number of the document, number of the test text and the place in the document where that would begin.
    """
    if not len(doc_of):
        return []
    known = tests.known
    flat = known.numbers([w for ws in docs for w in ws])
    tok, sets = known.hash[flat], tuple(v[flat] for v in known.looks)
    starts = np.concatenate([[0], np.cumsum([len(x) for x in docs])]).astype(np.int64)
    order = np.lexsort((diagonal, key, doc_of))
    d, e, diagonal = doc_of[order], key[order], diagonal[order]
    out: dict[tuple[int, int], int] = {}

    def note(doc: int, item: int, n: int) -> None:
        if n >= s.words:
            out[doc, item] = max(out.get((doc, item), 0), n)

    # every word of the test text on every diagonal
    size, rows = np.diff(tests.start)[e], tests.rows[e]
    first = np.cumsum(size) - size
    cell = np.arange(size.sum()) - np.repeat(first, size)
    mine = np.repeat(tests.start[e], size) + cell
    own = tests.tok[mine]
    place = np.repeat(diagonal, size) + cell
    inside = (place >= 0) & (place < np.repeat(np.diff(starts)[d], size))
    col = np.where(inside, place + np.repeat(starts[d], size), 0)
    equal = inside & (tok[col] == own)
    close = equal | (inside & may_be_near(tuple(v[mine] for v in tests.letters), tuple(v[col] for v in sets)))

    def windows(there: np.ndarray, cell: np.ndarray, rows: np.ndarray, size: np.ndarray) -> np.ndarray:
        """How many are there in each window of a stretch's words; -1 where no window begins."""
        sums = np.concatenate([[0], np.cumsum(there)])
        span = np.repeat(rows, size)
        return np.where(cell + span <= np.repeat(size, size), sums[np.minimum(np.arange(len(cell)) + span, len(cell))] - sums[:-1], -1)

    share = lambda x: np.repeat(np.ceil(x * rows - 1e-9), size)
    good = (windows(close, cell, rows, size) >= share(s.straight)) & (windows(equal, cell, rows, size) >= share(s.equal)) & (windows(tests.fixed[mine] & ~close, cell, rows, size) == 0)
    for k in np.flatnonzero(np.logical_or.reduceat(good, first)).tolist():
        t = tests.all[e[k]]
        note(int(d[k]), t.item, straight(t, docs[d[k]], tok[starts[d[k]] : starts[d[k] + 1]], int(diagonal[k]), s))
    # every pair: few of the first words of an alignment, as many as a stretch has, are missing near where the hits expect them, as they count above 0
    new = np.concatenate([[True], (d[1:] != d[:-1]) | (e[1:] != e[:-1])])
    heads = np.flatnonzero(new)
    c = _coefficients()
    mixed = lambda doc, w: ((w ^ (doc.astype(np.uint64) * c[61])) * c[60]) >> np.uint64(24) << np.uint64(24)
    at = np.arange(len(tok)) - np.repeat(starts[:-1], np.diff(starts))
    stands = np.append(np.sort(mixed(np.repeat(np.arange(len(docs)), np.diff(starts)), tok) + at.astype(np.uint64)), ~np.uint64(0))
    want = mixed(np.repeat(d, size), own)
    next_ = stands[np.searchsorted(stands[:-1], want + np.maximum(place - s.around, 0).astype(np.uint64))]
    held = (next_ >= want) & (next_ - want <= np.maximum(place + s.around, 0).astype(np.uint64)) & (place + s.around >= 0)
    psize, prows = size[heads], rows[heads]
    pfirst = np.cumsum(psize) - psize
    pair = np.repeat(np.cumsum(new) - 1, size)
    to = pfirst[pair] + cell
    there = np.zeros(int(psize.sum()), bool)
    there[to[held]] = True
    best = lambda: np.maximum.reduceat(windows(there, np.arange(len(there)) - np.repeat(pfirst, psize), prows, psize), pfirst)
    likely = (prows - best()) * (1 + _MISS) < prows
    # the other words of those pairs may be near to one that stands there; a longer stretch holds a window of as many words with one less than its share at worst
    open_ = np.flatnonzero(likely[pair] & ~there[to])
    lows, highs = starts[d], starts[d + 1]
    low, high = np.repeat(lows, size)[open_], np.repeat(highs, size)[open_]
    for off in range(-s.around, s.around + 1):
        col = low + place[open_] + off
        ok = (col >= low) & (col < high)
        ok[ok] = may_be_near(tuple(v[mine[open_[ok]]] for v in tests.letters), tuple(v[col[ok]] for v in sets))
        there[to[open_[ok]]] = True
        still = ~there[to[open_]]
        open_, low, high = open_[still], low[still], high[still]
    likely &= best() >= np.ceil(s.agree * prows) - 1
    ends = np.append(heads[1:], len(d))
    for k, end in zip(heads[likely].tolist(), ends[likely].tolist(), strict=True):
        n, t = int(d[k]), tests.all[e[k]]
        if out.get((n, t.item), 0) >= t.of[-1] - t.of[0] + 1:
            continue
        doc, lo, hi = docs[n], starts[n], starts[n + 1]
        at = columns(len(doc), len(t.tok), diagonal[k:end], s)
        same = (t.tok[:, None] == tok[lo:hi][None, at]) & banded(len(t.tok), at, diagonal[k:end], s)
        text = [doc[j] if j >= 0 else "" for j in at.tolist()]
        holds = functools.partial(could_hold, t, text, tuple(v[lo:hi][at] for v in sets), same, s)
        if holds(same):
            note(n, t.item, stretch(t, text, at, same, s, holds))
    return [(a, b, n) for (a, b), n in out.items()]


def _test_windows(s: Search) -> object:
    """Rows hash, e, place of all windows of the test texts e, text; texts that are too short give none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Vocabulary()
        for b in batches:
            e, h, at = [], [], []
            for key, text in zip(b.column("e").to_pylist(), b.column("text").to_pylist(), strict=True):
                w, of, _ = parts_of(text)
                if len(of) and of[-1] - of[0] + 1 >= s.words:
                    for _, x in _windows(known.hashes(w), s.masks):
                        h.append(x)
                        at.append(np.arange(len(x), dtype=np.int32))
                        e.append(np.full(len(x), key, np.int64))
            if h:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(h).view(np.int64)), pa.array(np.concatenate(e)), pa.array(np.concatenate(at))], names=["hash", "e", "place"])

    return run


def bit_table(windows: DataFrame, n: int) -> tuple[int, np.ndarray]:
    """Bits and the table of which leading bits of a hash occur, as bytes: at most 16 MB, however many windows there are."""
    bits = min(27, max(20, (16 * n).bit_length()))
    b = F.shiftrightunsigned("hash", 64 - bits)
    rows = windows.groupBy(F.shiftright(b, 3).cast("int").alias("at")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1), (b % 8).cast("int"))).cast("int").alias("v")).toArrow()
    table = np.zeros(1 << (bits - 3), np.uint8)
    table[rows["at"].to_numpy()] = rows["v"].to_numpy()
    return bits, table


def _seen(shared: object, bits: int, s: Search) -> object:
    """Documents with windows that may be in the test texts: id, row, words (with spaces between), hits (hash, place)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        there, known = shared.value, Vocabulary()
        row = TaskContext.get().partitionId() << 33
        shift, low = np.uint64(64 - bits), np.uint64(7)
        for b in batches:
            for first in range(0, b.num_rows, 2000):
                c = b.slice(first, 2000)
                lists = [words(t) for t in c.column("text").to_pylist()]
                tok = known.hashes([w for ws in lists for w in ws])
                size = np.array([len(x) for x in lists], np.int64)
                ends = np.cumsum(size)
                doc_of = np.repeat(np.arange(len(lists)), size)
                of, place, found = [], [], []
                for span, h in _windows(tok, s.masks):
                    at = h >> shift
                    maybe = np.flatnonzero(there[(at >> np.uint64(3)).astype(np.int64)] >> (at & low).astype(np.uint8) & 1)
                    maybe = maybe[maybe + span <= ends[doc_of[maybe]]]
                    of.append(doc_of[maybe])
                    place.append(maybe - (ends - size)[doc_of[maybe]])
                    found.append(h[maybe])
                of, place, found = np.concatenate(of), np.concatenate(place), np.concatenate(found)
                order = np.argsort(of, kind="stable")
                kept, n = np.unique(of, return_counts=True)
                offsets = pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32))
                lists_ = [pa.ListArray.from_arrays(offsets, pa.array(v[order])) for v in (found.view(np.int64), place.astype(np.int32))]
                yield pa.RecordBatch.from_arrays(
                    [c.column("id").take(pa.array(kept)), pa.array(row + np.arange(len(kept), dtype=np.int64)), pa.array([" ".join(lists[k]) for k in kept.tolist()], pa.string()), *lists_], names=["id", "row", "words", "hash", "place"])
                row += len(kept)

    return run


@functools.lru_cache(maxsize=1)
def _ready(shared: object, s: Search) -> Tests:
    """The test texts of a broadcast made ready, once per worker process."""
    return Tests(shared.value, s)


def _verified(shared: object, s: Search) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tests = _ready(shared, s)
        for b in batches:
            for lo in range(0, b.num_rows, 1000):
                c = b.slice(lo, 1000)
                hits = c.column("hits")
                own = hits.flatten()
                key = np.array([tests.number.get(e, -1) for e in own.field("e").to_pylist()], np.int64)
                doc_of = np.repeat(np.arange(c.num_rows), hits.value_lengths().to_numpy())
                mine = key >= 0
                rows = leaks_of([w.split(" ") for w in c.column("words").to_pylist()], doc_of[mine], key[mine], own.field("diagonal").to_numpy().astype(np.int64)[mine], tests, s)
                ids = c.column("id").take(pa.array([r[0] for r in rows], pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, *(pa.array([r[k] for r in rows], ty) for k, ty in ((1, pa.int64()), (2, pa.int32())))], names=["id", "item", "words"])

    return run


def leaks(docs: DataFrame, id_: str, text: str, tests: DataFrame, item: str, parts: list[str], s: Search = Search()) -> DataFrame:  # noqa: B008
    """Documents that hold at least ``s.words`` successive words of a test item: ``id, item, words`` (of the longest stretch).

    ``parts`` are the columns of ``tests`` that hold its texts. Words may be altered as long as ``s.straight`` of the stretch's words are equal
    or near; where words are left out or put in, ``s.agree`` of them. Interruptions may have any length. Another number in a number's stead ends a stretch;
    so does any word in the stead of a name or number where fewer than ``s.agree`` agree. NULL and empty texts hold nothing; NULL ids are
    left out; repeated documents or items give one row; empty tables give none. Test texts of fewer than ``s.words`` words cannot leak.

    The documents are read once. A table of bits of fixed size drops the windows that no test text has; the others are joined with the test windows
    by their hashes (broadcast up to ``s.rows`` of them, shuffled beyond), and documents where they meet are verified. Only test texts
    reach the tasks whole, in blocks of ``s.block`` characters, which go over the hits again, not over the documents.
    """
    spark = docs.sparkSession
    t = None
    for p in parts:
        x = tests.select(F.col(f"`{item}`").cast("long").alias("item"), F.col(f"`{p}`").alias("text")).where("item is not null and text is not null")
        t = x if t is None else t.unionByName(x)
    t = stage(t.distinct().withColumn("e", F.xxhash64("item", "text")))
    windows = stage(t.select("e", "text").mapInArrow(_test_windows(s), "hash long, e long, place int"))
    n = windows.count()
    if not n:
        return spark.createDataFrame([], "id long, item long, words int")
    bits, there = bit_table(windows, n)
    d = docs.select(F.col(f"`{id_}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text")).where("id is not null and text is not null")
    seen = stage(d.mapInArrow(_seen(spark.sparkContext.broadcast(there), bits, s), "id long, row long, words string, hash array<long>, place array<int>"))
    of_doc = seen.select("row", F.explode(F.arrays_zip("hash", "place")).alias("w")).select("row", "w.hash", F.col("w.place").alias("j"))
    of_test = F.broadcast(windows) if n <= s.rows else windows
    hit = of_doc.join(of_test, "hash").select("row", F.struct("e", (F.col("j") - F.col("place")).alias("diagonal")).alias("h"))
    hits = hit.groupBy("row").agg(F.collect_set("h").alias("hits"))
    used_texts = t.join(windows.select("e").distinct(), "e", "left_semi").select("e", "item", "text")
    blocks = -(-(used_texts.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0] + 1) // s.block)
    found = None
    for k in range(blocks):
        mine = lambda e, k=k: F.pmod(e, F.lit(blocks)) == k
        texts = [tuple(r) for r in used_texts.where(mine(F.col("e"))).collect()]
        if not texts:
            continue
        shared = spark.sparkContext.broadcast(texts)
        own = hits if blocks == 1 else hits.withColumn("hits", F.filter("hits", lambda h: mine(h["e"]))).where(F.size("hits") > 0)
        one = own.join(seen.select("row", "id", "words"), "row").select("id", "words", "hits").mapInArrow(_verified(shared, s), "id long, item long, words int")
        if blocks > 1:
            one = stage(one)
            shared.destroy()
        found = one if found is None else found.unionByName(one)
    return found.groupBy("id", "item").agg(F.max("words").alias("words"))
