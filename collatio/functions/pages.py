"""`kernels.page_counts` of many pages at once.

Pages whose lines are read in their own places, and each only lost, only gained or only replaced members, are counted side by side: their
characters lie in one array a side, and what is asked of each character is asked of all by a few calls. Other pages are counted one by one.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Sequence
from functools import lru_cache

import numpy as np

from . import kernels as K

#: Characters of a block, both sides; numbers of a block's table of pages by kinds of characters; lines of a page that are bounded side by side.
BLOCK, TABLE, SIDE_BY_SIDE = 1 << 17, 1 << 22, 32
_C = {name: i for i, name in enumerate(K.COUNTS)}
_GAPS, _BREAKS = re.compile("  +"), re.compile(" ?\n[ \n]*")


@lru_cache(4)
def _text(s: str) -> tuple[str, str | None] | None:
    """The lines at L1, each ended by a line feed, and those at L0 where they are others, of a text that is tame by its kinds of characters, which are looked at later. None if it has no line."""
    if not s.isascii() and not K.unicodedata.is_normalized("NFC", s):
        return None
    c = s.strip(" \n")
    if not c:
        return None
    if "  " in c:
        c = _GAPS.sub(" ", c)
    if " \n" in c or "\n " in c or "\n\n" in c:
        c = _BREAKS.sub("\n", c)
    if s.isascii() or not any(map(c.__contains__, K._SPELT)):
        return c + "\n", None
    return K._steps(c, K._SPELLING) + "\n", c + "\n"


def page_counts(refs: Sequence[str | None], hyps: Sequence[str | None], failed: Sequence[bool]) -> tuple[np.ndarray, list[list[str]]]:
    """A row of counts (`kernels.COUNTS`) for each page, and the words read for others."""
    counts, words = np.zeros((len(refs), len(K.COUNTS)), np.int64), [[] for _ in refs]
    block, size, alone = [], 0, []
    for i, (ref, hyp, f) in enumerate(zip(refs, hyps, failed, strict=True)):
        a, b = (None, None) if f else (_text(ref or ""), _text(hyp or ""))
        if a is None or b is None or a[0].count("\n") != b[0].count("\n"):
            alone.append(i)
            continue
        if block and size + len(a[0]) + len(b[0]) > BLOCK:
            alone += _count(block, counts, words)
            block, size = [], 0
        block.append((i, a, b, ref, hyp))
        size += len(a[0]) + len(b[0])
    if block:
        alone += _count(block, counts, words)
    for i in alone:
        row = K.page_counts(refs[i], hyps[i], bool(failed[i]))
        counts[i], words[i] = [row[c] for c in K.COUNTS], row["substituted"]
    return counts, words


class _Kinds:
    """The kinds of characters of a block, and what is asked of them."""

    def __init__(self, codes: np.ndarray):
        chars = [*map(chr, codes.tolist())]
        at = {c: i for i, c in enumerate(chars)}
        told = lambda test: np.array([*map(test, chars)], bool)
        self.n, self.space, self.feed = len(chars), at.get(" "), at["\n"]
        self.stepped, self.mark, self.capital, self.glyph = map(told, (K._STEPPED.__contains__, K._MARKS.__contains__, K._is_capital, K._is_glyph))
        self.punct, self.digit = told(K._is_punctuation), told(str.isdigit)
        self.lower = np.array([at.get(c.lower(), -1) for c in chars])
        low = [*map(K._lowered, chars)]
        kinds = {c: i for i, c in enumerate(dict.fromkeys(low))}
        self.low = np.array([kinds[c] for c in low])
        self.low_punct = np.array([len(c) == 1 and K._is_punctuation(c) for c in kinds], bool)

    def lowered(self, held: np.ndarray) -> np.ndarray:
        """Which lowered kinds pages hold, of the kinds they hold."""
        order = np.argsort(self.low, kind="stable")
        return np.logical_or.reduceat(held[:, order], np.searchsorted(self.low[order], np.arange(len(self.low_punct))), axis=1)


def _codes(texts: list[str]) -> np.ndarray:
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.int32).astype(np.intp)


def _sums(pages: np.ndarray, n: int, which: np.ndarray | None = None) -> np.ndarray:
    """How often each page occurs, where `which` holds."""
    return np.bincount(pages if which is None else pages[which], minlength=n)


def _strangers(pages: np.ndarray, n: int, x: np.ndarray, y: np.ndarray, held_x: np.ndarray, held_y: np.ndarray) -> np.ndarray:
    """Of each page, whether the replaced members of one side are not in the other."""
    return (_sums(pages, n, held_y[pages, x]) == 0) | (_sums(pages, n, held_x[pages, y]) == 0)


def _left(long: np.ndarray, of_long: np.ndarray, at_long: np.ndarray, short: np.ndarray, of_short: np.ndarray, at_short: np.ndarray, table_long: np.ndarray, table_short: np.ndarray, pages: np.ndarray, texts) -> np.ndarray:
    """Of the given pages, those whose shorter side is left when members of the longer go, line by line.

    Kinds that both have as often must all stay and so come in the same order, line feeds among them. Of another kind a stretch between two of
    them must have no fewer on the longer side. Where that is so of several kinds, their order counts too and is looked at.
    """
    more = table_long - table_short
    pages = pages & ~(more < 0).any(axis=1)
    partly = (more > 0) & (table_short > 0)
    n = len(pages)
    # of each character of these pages: 0 stays, 1 goes, 2 may go
    role = np.where(pages[:, None], (more > 0) + partly.astype(np.int8), 3).astype(np.int8).ravel()
    of, to = role.take(at_long), role.take(at_short)
    stay, still = np.flatnonzero(of == 0), np.flatnonzero(to == 0)
    of_stay = of_long.take(stay)
    pages &= _sums(of_stay, n, long.take(stay) != short.take(still)) == 0
    here, there = (np.bincount(np.searchsorted(kept, np.flatnonzero(r == 2)), minlength=len(stay)) for kept, r in ((stay, of), (still, to)))
    pages &= _sums(of_stay, n, here < there) == 0
    for i in np.flatnonzero(pages & (partly.sum(axis=1) > 1)).tolist():
        pages[i] = K._within(*sorted(texts(i), key=len))
    return pages


def _apart(n_lines: np.ndarray, first: np.ndarray, la: np.ndarray, lb: np.ndarray, own: np.ndarray, pages: np.ndarray, lines) -> np.ndarray:
    """Of the given pages, those where any assignment but that of equal places is sure to cost more: by the lengths of lines, and by the lines where these don't tell."""
    sure, doubtful = ~pages | (n_lines == 1), []
    for n in np.unique(n_lines[~sure]).tolist():
        which = np.flatnonzero(~sure & (n_lines == n))
        if n <= SIDE_BY_SIDE:
            i = np.arange(n)
            at = first[which, None] + i
            x, y = la[at][:, :, None], lb[at][:, None, :]
            open_ = 1 - np.minimum(x, y) / np.maximum(x, y) + K.ORDER_WEIGHT * np.abs(i[:, None] - i) / n <= 1 - own[at][:, :, None] + K.SURE
            open_[:, i, i] = False
            open_ = open_.any(axis=(1, 2))
            sure[which[~open_]] = True
            which = which[open_]
        doubtful += which.tolist()
    for k in doubtful:
        refs, outs = lines(k)
        n = len(refs)
        sure[k] = (K._few_elsewhere if n <= K.FEW else K._elsewhere)(refs, outs, own[first[k] : first[k] + n].tolist())
    return pages & sure


def _count(block: list, counts: np.ndarray, words: list[list[str]]) -> list[int]:
    """Fills in the counts and words of a block's pages, but for those it returns."""
    p = len(block)
    text_a, text_b = [a[0] for _, a, *_ in block], [b[0] for _, _, b, *_ in block]
    a, b = _codes(text_a), _codes(text_b)
    number = np.zeros(int(max(a.max(), b.max())) + 1, np.intp)
    number[a] = number[b] = 1
    codes = np.flatnonzero(number)
    if p > 1 and p * len(codes) > TABLE:
        return _count(block[: p // 2], counts, words) + _count(block[p // 2 :], counts, words)
    kinds = _Kinds(codes)
    number[codes] = np.arange(kinds.n)
    x, y = number.take(a), number.take(b)
    size_a, size_b = (np.array([*map(len, t)]) for t in (text_a, text_b))
    of_a, of_b = np.repeat(np.arange(p), size_a), np.repeat(np.arange(p), size_b)
    place_a, place_b = of_a * kinds.n + x, of_b * kinds.n + y  # in the tables
    table_a, table_b = (np.bincount(z, minlength=p * kinds.n).reshape(p, kinds.n) for z in (place_a, place_b))
    held_a, held_b = table_a > 0, table_b > 0
    good = ~(held_a | held_b)[:, kinds.stepped].any(axis=1)
    for i in np.flatnonzero(good & (held_a | held_b)[:, kinds.mark].any(axis=1)).tolist():
        good[i] = not (K._MARKED.search(block[i][3]) or K._MARKED.search(block[i][4]))

    ends_a, ends_b = np.flatnonzero(x == kinds.feed), np.flatnonzero(y == kinds.feed)
    la, lb = np.diff(ends_a, prepend=-1) - 1, np.diff(ends_b, prepend=-1) - 1
    n_lines = table_a[:, kinds.feed]
    first = np.cumsum(n_lines) - n_lines
    replaced = np.logical_and.reduceat(la == lb, first)
    lines = lambda i: (text_a[i][:-1].split("\n"), text_b[i][:-1].split("\n"))

    # members replaced one by one
    if kinds.space is not None:
        held_a[:, kinds.space] = held_b[:, kinds.space] = True
    at, to = np.flatnonzero(replaced[of_a]), np.flatnonzero(replaced[of_b])
    differ = np.flatnonzero(x[at] != y[to])
    rx, ry, of = x[at[differ]], y[to[differ]], of_a[at[differ]]
    n_sub = _sums(of, p)
    good &= ~replaced | _strangers(of, p, rx, ry, held_a, held_b)
    # members lost or gained
    short_b = size_b < size_a
    lost, gained = good & ~replaced & short_b, good & ~replaced & ~short_b
    if lost.any():
        good &= ~lost | _left(x, of_a, place_a, y, of_b, place_b, table_a, table_b, lost, lambda i: (text_a[i], text_b[i]))
    if gained.any():
        good &= ~gained | _left(y, of_b, place_b, x, of_a, place_a, table_b, table_a, gained, lambda i: (text_a[i], text_b[i]))

    far = np.abs(la - lb) + np.bincount(np.searchsorted(ends_a, at[differ]), minlength=len(la))
    own = 1 - far / np.maximum(np.maximum(la, lb), 1)
    same = replaced & (n_sub == 0)
    good &= same | (np.minimum.reduceat(own, first) >= K.ACCEPT)
    good &= same | _apart(n_lines, first, la, lb, own, good & ~same, lines)

    out = np.zeros((p, len(K.COUNTS)), np.int64)

    def put(name: str, value: np.ndarray) -> None:
        out[:, _C[name]] = value

    asked = np.stack([kinds.capital, kinds.glyph, kinds.punct], axis=1).astype(np.int64)
    (caps, glyphs, punct), (caps_b, glyphs_b, punct_b) = (table_a @ asked).T, (table_b @ asked).T
    put("n_ref_chars", size_a - 1)
    put("n_ref_words", n_lines + (table_a[:, kinds.space] if kinds.space is not None else 0))
    put("ins", np.where(replaced, 0, np.maximum(0, size_b - size_a)))
    put("dele", np.where(replaced, 0, np.maximum(0, size_a - size_b)))
    put("sub", n_sub)
    put("n_lines_ref", n_lines)
    put("n_lines_matched", n_lines)
    put("n_glyph_ref", glyphs)
    put("glyph_kept", np.where(replaced, glyphs - _sums(of, p, kinds.glyph[rx]), np.minimum(glyphs, glyphs_b)))
    put("n_glyph_hyp", glyphs_b)
    lowered = _sums(of, p, kinds.capital[rx] & (ry == kinds.lower[rx]))
    put("n_caps_read", np.where(replaced, caps - _sums(of, p, kinds.capital[rx]) + lowered, np.where(short_b, caps_b, caps)))
    put("caps_lowered", lowered)

    low_x, low_y = kinds.low[rx], kinds.low[ry]
    other = low_x != low_y
    gone, new, of_gone = low_x[other], low_y[other], of[other]
    told = _strangers(of_gone, p, gone, new, kinds.lowered(held_a), kinds.lowered(held_b))
    put("n_punct_ref", punct)
    put("punct_kept", np.where(replaced, punct - _sums(of_gone, p, kinds.low_punct[gone]), np.where(short_b, punct_b, punct)))
    for i in np.flatnonzero(good & replaced & ~told & (punct > 0)).tolist():
        out[i, _C["punct_kept"]] = sum(K.punct_counts(K._lowered(r), K._lowered(h))[1] for r, h in zip(*lines(i), strict=True))
    for i in np.flatnonzero(good & (held_a | held_b)[:, kinds.digit].any(axis=1)).tolist():
        out[i, _C["n_num_ref"] : _C["n_num_hyp"] + 1] = [*map(sum, zip(*map(K.numeral_counts, *lines(i)), strict=True))]
    for i in (i for i, (_, s, t, *_) in enumerate(block) if good[i] and (s[1] or t[1])):
        l0 = ((z[1] or z[0])[:-1].split("\n") for z in block[i][1:3])
        out[i, _C["n_glyph_ref"] : _C["n_glyph_hyp"] + 1] = [*map(sum, zip(*map(K.glyph_counts, *l0), strict=True))]

    # where lines have as many words on either side, no space is replaced, lost or gained: a word differs if one of its members does, or its length
    stops_a, stops_b = (np.flatnonzero((z == kinds.space) | (z == kinds.feed)) if kinds.space is not None else ends for z, ends in ((x, ends_a), (y, ends_b)))
    at_feed, to_feed = np.searchsorted(stops_a, ends_a), np.searchsorted(stops_b, ends_b)
    in_turn = good & ~same & np.logical_and.reduceat(np.diff(at_feed, prepend=-1) == np.diff(to_feed, prepend=-1), first)
    hit = np.zeros(len(stops_a), bool)
    hit[np.searchsorted(stops_a, at[differ])] = True
    line = np.searchsorted(at_feed, np.arange(len(stops_a)))
    which, there = np.flatnonzero(in_turn[of_a[stops_a]]), np.flatnonzero(in_turn[of_b[stops_b]])
    start_a, start_b = (np.concatenate([[-1], stops[:-1]])[w] + 1 for stops, w in ((stops_a, which), (stops_b, there)))
    end_a, end_b, line = stops_a[which], stops_b[there], line[which]
    other = hit[which] | (end_a - start_a != end_b - start_b)
    said_a, said_b = "".join(text_a), "".join(text_b)
    r = [said_a[i:j] for i, j in zip(start_a[other].tolist(), end_a[other].tolist(), strict=True)]
    h = [said_b[i:j] for i, j in zip(start_b[other].tolist(), end_b[other].tolist(), strict=True)]
    keys = [(k if q != k else None) for q, k in zip(map(K.key, r), map(K.key, h), strict=True)]
    line, bounds = line[other], np.searchsorted(of_a[end_a[other]], np.arange(p + 1)).tolist()
    for i in np.flatnonzero(good & ~same).tolist():
        u, v = bounds[i], bounds[i + 1]
        if not in_turn[i]:
            edits, read = _words(text_a[i], text_b[i])
        elif set(r[u:v]).isdisjoint(h[u:v]):
            edits, read = v - u, [k for k in keys[u:v] if k is not None]
        else:
            edits, read = _words_in_turn(text_a[i], text_b[i], r[u:v], h[u:v], keys[u:v], (line[u:v] - first[i]).tolist())
        out[i, _C["word_edits"]], words[block[i][0]] = edits, read
    done = np.array([i for i, *_ in block])
    counts[done[good]] = out[good]
    return done[~good].tolist()


def _words(a: str, b: str) -> tuple[int, list[str]]:
    """The edits of words, and the keys of those read for others."""
    x, y = a.split(), b.split()
    return K.distance(x, y), [w for r, h in zip(a[:-1].split("\n"), b[:-1].split("\n"), strict=True) for w in K.substitutions(r, h)]


def _words_in_turn(a: str, b: str, r: list[str], h: list[str], keys: list[str | None], line: list[int]) -> tuple[int, list[str]]:
    """The same where only these words differ in their places, by lines.

    Members that are left where they are, and those replaced that both sides have, are all that can be equal in any script; the rest of one side
    costs an edit each. One that leaves the diagonal loses and gains a member besides. So if both sides have none the diagonal alone is
    cheapest, and if they have one, nothing is cheaper than it.
    """
    edits = len(r) if (Counter(r) & Counter(h)).total() <= 1 else K.distance(a.split(), b.split())
    read, refs, outs = [], a.split("\n"), b.split("\n")
    u = 0
    while u < len(r):
        v = bisect_right(line, line[u])
        read += [k for k in keys[u:v] if k is not None] if set(r[u:v]).isdisjoint(h[u:v]) else K.substitutions(refs[line[u]], outs[line[u]])
        u = v
    return edits, read
