"""Alignment kernels that SQL cannot express, in plain Python on one pair; `align` applies them by Arrow batches.

Among scripts of equal cost the one is taken that, read from the end, deletes before it inserts, and inserts before it
steps over both; common ends are matched first. Totals don't depend on that choice, what is counted at aligned places may.
A script's memory grows with the square root of the longer side times the shorter, not with their product.
"""

from __future__ import annotations

import math
import re
import unicodedata
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Hashable, Iterator, Sequence
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import compress, repeat
from operator import contains, ne

import numpy as np

from . import text as T

# ---------------------------------------------------------------------------------------------- text on one string
_LINE_END, _CELL_EDGE, _HYPHENATED = (T.python(x) for x in (T.LINE_END, T.CELL_EDGE, T.HYPHENATED))
_UNCERTAIN, _BRACKETED, _ANGLED, _SEPARATOR, _RULE = (T.python(x) for x in (T.UNCERTAIN, T.BRACKETED, T.ANGLED, T.SEPARATOR, T.RULE))
_GLYPH = T.python(T.PERIOD_CLASS)


def _each_line(s: str, f) -> str:
    return "\n".join(x for x in map(f, s.split("\n")) if x is not None)


def _unmarked(line: str) -> str | None:
    if ("--" in line and _SEPARATOR.search(line)) or (any(c in line for c in "-*_") and _RULE.search(line)):
        return None
    return _CELL_EDGE.sub(" ", line).strip() if "|" in line else line


def _uncertain(s: str) -> str:
    if "[" in s or "(" in s:
        s = _BRACKETED.sub(r"\1", _UNCERTAIN.sub("", s))
    return _ANGLED.sub(r"\1", s) if "⟨" in s else s


def _pairs(s: str, pairs: Sequence[tuple[str, str]]) -> str:
    for a, b in pairs:
        s = s.replace(a, b)
    return s


#: `text.STEPS` on one string, by the same patterns and tables.
_ONE = {
    "nfc": lambda s: unicodedata.normalize("NFC", s),
    "line_strip": lambda s: _each_line(_LINE_END.sub("\n", s), str.strip),
    "markdown": lambda s: _each_line(s, _unmarked),
    "dehyphenate": lambda s: _HYPHENATED.sub("", s) if "\n" in s else s,
    "uncertainty_marks": _uncertain,
    "newline_to_space": lambda s: s.replace("\n", " "),
    "ligatures": lambda s: _pairs(s, T.LIGATURES),
    "long_s": lambda s: _pairs(s, tuple(zip(*T.LONG_S, strict=True))),
    "sharp_s": lambda s: _pairs(s, T.SHARP_S),
    "combining_e": lambda s: _pairs(s, T.SMALL_E),
    "lowercase": str.lower,
    "uv": lambda s: _pairs(s, tuple(zip(*T.V_AS_U, strict=True))),
    "ij": lambda s: _pairs(s, tuple(zip(*T.J_AS_I, strict=True))),
    "whitespace": lambda s: " ".join(s.split()),  # white space is named after this
}


#: What these steps look for is beyond ASCII.
_BEYOND = {"nfc", "ligatures", "long_s", "sharp_s", "combining_e"}
_TIERS = {t: [(_ONE[n], n in _BEYOND) for n in steps] for t, steps in T.TIERS.items()}


#: Where none of the first is in a text, and no match of the second, all steps but those of white space, of spelling and of case leave it as it is.
#: Among the first are letters that aren't lowered one by one. Rules, separators and broken words have a mark before another one or white space.
_STEPPED = frozenset({*T.WHITE, *"|[⟨İΣ"} - {" ", "\n"})
_MARKS = frozenset("-¬⸗=*_(")
_MARKED = re.compile(r"[-¬⸗=*_][-*_\s]|\(\?\)")
_SPELLING = ("ligatures", "long_s", "sharp_s", "combining_e")
_SPELT = frozenset({*T.LONG_S[0], *(a[-1] for a, _ in (*T.LIGATURES, *T.SHARP_S, *T.SMALL_E))})


def _tame(s: str, chars: set[str]) -> bool:
    """Whether a text of these characters is left as it is by all steps but those of white space, of spelling and of case."""
    return chars.isdisjoint(_STEPPED) and (chars.isdisjoint(_MARKS) or not _MARKED.search(s)) and (s.isascii() or unicodedata.is_normalized("NFC", s))


def _steps(s: str, names: Sequence[str]) -> str:
    for name in names:
        s = _ONE[name](s)
    return s


def _lowered(s: str) -> str:
    """A tame text's L2, of its L1: letter by letter."""
    return _steps(s, ("lowercase", "uv", "ij"))


def normalize(s: str | None, tier: str) -> str:
    """What `text.normalize` gives, for one string."""
    s = s or ""
    chars = set(s)
    if _tame(s, chars):
        s = " ".join(s.split())
        if tier != "L0" and not chars.isdisjoint(_SPELT):
            s = _steps(s, _SPELLING)
        return _lowered(s) if tier == "L2" else s
    plain = s.isascii()
    for step, beyond in _TIERS[tier]:
        if not (plain and beyond):
            s = step(s)
    return s


def split_lines(s: str | None) -> list[str]:
    return [x for x in (y.strip() for y in _LINE_END.sub("\n", s or "").split("\n")) if x]


@lru_cache(1 << 14)
def key(token: str) -> str:
    return token.strip(T.TOKEN_EDGES).lower()


# ---------------------------------------------------------------------------------------------- edit distance
class _Columns:
    """The table of distances of two sequences, a column for each member of b, as bit vectors of its rises and falls along a (bit-parallel, Hyyrö's form of Myers' method)."""

    def __init__(self, a: Sequence[Hashable], b: Sequence[Hashable]):
        self.a, self.b = a, b
        self.full = (1 << len(a)) - 1
        self.where: dict[Hashable, int] = {}
        for i, x in enumerate(a):
            self.where[x] = self.where.get(x, 0) | 1 << i

    def _walk(self, up: int, down: int, members: Sequence[Hashable]) -> Iterator[tuple[int, int, int, int]]:
        """From a column on: for each member the column's rises and falls, and the rises and falls towards it."""
        full, where = self.full, self.where
        for x in members:
            match = where.get(x, 0)
            d = (((match & up) + up) ^ up) | match | down
            rise, fall = down | (full & ~(d | up)), d & up
            shifted = (rise << 1 | 1) & full
            up, down = (fall << 1) & full | (full & ~(d | shifted)), shifted & d
            yield up, down, rise, fall

    def from_the_end(self) -> Iterator[tuple[int, int]]:
        """For each member of b, the last first, the rises of its column and towards it. Every so many columns are kept, those between made again."""
        step = max(1, math.isqrt(len(self.b)))
        kept, now = [], (self.full, 0)
        for j in range(0, len(self.b), step):
            kept.append(now)
            for up, down, _, _ in self._walk(*now, self.b[j : j + step]):
                now = up, down
        for k in range(len(kept) - 1, -1, -1):
            block = [(up, rise) for up, _, rise, _ in self._walk(*kept[k], self.b[k * step : (k + 1) * step])]
            yield from reversed(block)


def distances(many: Sequence[Sequence[Hashable]], b: Sequence[Hashable]) -> list[int]:
    """Insertions, deletions and substitutions from each of many to b, in one walk: their columns lie side by side in one bit vector.

    A free bit between two takes the carry. The last column's rises and falls add up to the distance.
    """
    where: dict[Hashable, int] = {}
    full = starts = at = 0
    spans = []
    for a in many:
        spans.append((at, (1 << len(a)) - 1))
        if a:
            starts |= 1 << at
            full |= spans[-1][1] << at
        for i, x in enumerate(a, at):
            where[x] = where.get(x, 0) | 1 << i
        at += len(a) + 1
    up, down, get = full, 0, where.get
    for x in b:
        match = get(x, 0)
        d = ((((match & up) + up) ^ up) | match | down) & full
        rise = down | (full ^ (d | up) & full)
        shifted = (rise << 1 | starts) & full
        up, down = ((d & up) << 1) & full | (full ^ (d | shifted)), shifted & d
    return [len(b) + (up >> i & whole).bit_count() - (down >> i & whole).bit_count() for i, whole in spans]


def _within(short: Sequence[Hashable], long: Sequence[Hashable]) -> bool:
    """Whether one is left when some of the other's members go."""
    return all(map(contains, repeat(iter(long)), short))


def _replaced(x: Sequence[Hashable], y: Sequence[Hashable]) -> list[bool] | None:
    """Of sides of one length, which members are replaced, if those of one side are strangers to the other: each costs an edit, and no more is needed. Else None."""
    apart = list(map(ne, x, y))
    if set(compress(x, apart)).isdisjoint(y) or set(compress(y, apart)).isdisjoint(x):
        return apart
    return None


def _by_foreign(a: Sequence[Hashable], b: Sequence[Hashable]) -> int | None:
    """The distance, where members that only one side has tell it; else None.

    Each of them costs an edit, and one edit serves at most one of either side, so the larger number is the least possible. If what both have
    comes in the same order, it can stay, and between two of its members the larger number of strangers is enough.
    """
    sides = []
    for x, other in ((a, set(b)), (b, set(a))):
        kept, gaps = [], [0]
        for m in x:
            if m in other:
                kept.append(m)
                gaps.append(0)
            else:
                gaps[-1] += 1
        sides.append((kept, gaps))
    (x, foreign), (y, strange) = sides
    if x != y:
        return None
    enough = sum(map(max, foreign, strange))
    return enough if enough == max(sum(foreign), sum(strange)) else None


def distance(a: Sequence[Hashable], b: Sequence[Hashable]) -> int:
    """Insertions, deletions and substitutions.

    What only lost members, and what only had them replaced by or for strangers, is counted in one pass; the rest fills the table's columns.
    """
    if a == b:
        return 0
    if len(a) < len(b):
        a, b = b, a
    head, tail = _ends_shared(a, b)
    x, y = a[head : len(a) - tail], b[head : len(b) - tail]
    if len(x) > len(y):
        if _within(y, x):
            return len(x) - len(y)
    elif (apart := _replaced(x, y)) is not None:
        return sum(apart)
    known = _by_foreign(x, y)
    return distances([x], y)[0] if known is None else known


def similarity(a: str, b: str) -> float:
    longer = max(len(a), len(b))
    return 1 - distance(a, b) / longer if longer else 1.0


def _shared(a: Sequence[Hashable], b: Sequence[Hashable]) -> int:
    """How many members a and b have in common at their start."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[low:mid] == b[low:mid] else (low, mid - 1)
    return low


def _ends_shared(a: Sequence[Hashable], b: Sequence[Hashable]) -> tuple[int, int]:
    """Members in common at the start, and of what is left those at the end."""
    head = _shared(a, b)
    return head, _shared(a[head:][::-1], b[head:][::-1])


@dataclass
class Script:
    """How a becomes b: members that are equal at both ends, and between them steps (equal | replace | delete | insert, place in a, place in b), in order."""

    head: int
    tail: int
    steps: list[tuple[str, int, int]]

    def count(self, op: str) -> int:
        return sum(s[0] == op for s in self.steps)


def _lost(x: Sequence[Hashable], y: Sequence[Hashable], head: int, op: str) -> list[tuple[str, int, int]] | None:
    """The steps where y, the shorter, is left when some members of x go: each is found as early as can be. None if it isn't left."""
    steps, i = [], 0
    for j, m in enumerate(y, head):
        start = i
        while i < len(x) and x[i] != m:
            i += 1
        if i == len(x):
            return None
        steps += [(op, k, j) for k in range(head + start, head + i)]
        steps.append(("equal", head + i, j))
        i += 1
    steps += [(op, k, head + len(y)) for k in range(head + i, head + len(x))]
    return steps if op == "delete" else [(o, b, a) for o, a, b in steps]


def _plain_steps(x: Sequence[Hashable], y: Sequence[Hashable], head: int) -> list[tuple[str, int, int]] | None:
    """The steps that the table would give, where they are told without it: members only lost, only added, or replaced one by one.

    Lost: from the end, a step deletes as long as what is before still holds the rest, so members are matched where they come first.
    Replaced, the members of one side being strangers to the other: a way off the diagonal pays for each of them and for leaving it.
    """
    if len(x) > len(y):
        return _lost(x, y, head, "delete")
    if len(x) < len(y):
        return _lost(y, x, head, "insert")
    apart = _replaced(x, y)
    return None if apart is None else [("replace" if d else "equal", i, i) for i, d in enumerate(apart, head)]


def edit_counts(a: Sequence[Hashable], b: Sequence[Hashable]) -> tuple[int, int, int]:
    """Insertions, deletions and substitutions of the script, without its steps where it only loses, adds or replaces."""
    if a == b:
        return 0, 0, 0
    head, tail = _ends_shared(a, b)
    x, y = a[head : len(a) - tail], b[head : len(b) - tail]
    if len(x) == len(y):
        if (apart := _replaced(x, y)) is not None:
            return 0, 0, sum(apart)
    elif _within(*sorted((x, y), key=len)):
        return max(0, len(y) - len(x)), max(0, len(x) - len(y)), 0
    s = script(a, b)
    return s.count("insert"), s.count("delete"), s.count("replace")


def script(a: Sequence[Hashable], b: Sequence[Hashable]) -> Script:
    if a == b:
        return Script(len(a), 0, [])
    head, tail = _ends_shared(a, b)
    x, y = a[head : len(a) - tail], b[head : len(b) - tail]
    told = _plain_steps(x, y, head)
    if told is not None:
        return Script(head, tail, told)
    i, j, steps = len(x), len(y), []
    columns = _Columns(x, y).from_the_end() if x and y else iter(())
    up, rise = next(columns, (0, 0))
    while i or j:
        if i and (not j or up >> (i - 1) & 1):
            i -= 1
            steps.append(("delete", head + i, head + j))
            continue
        if j and (not i or rise >> (i - 1) & 1):
            j -= 1
            steps.append(("insert", head + i, head + j))
        else:
            i, j = i - 1, j - 1
            steps.append(("equal" if x[i] == y[j] else "replace", head + i, head + j))
        up, rise = next(columns, (0, 0))
    return Script(head, tail, steps[::-1])


# ---------------------------------------------------------------------------------------------- counts of a line pair
def _ends(s: Script, ref: str) -> str:
    return ref[: s.head] + ref[len(ref) - s.tail :]


def _told(ref: str, hyp: str) -> str | None:
    """How the script goes where it is told without a table: members are only `lost` or `added`, or `replaced` one by one; else None."""
    if len(ref) == len(hyp):
        head, tail = (len(ref), 0) if ref == hyp else _ends_shared(ref, hyp)
        return None if _replaced(ref[head : len(ref) - tail], hyp[head : len(hyp) - tail]) is None else "replaced"
    if len(hyp) < len(ref):
        return "lost" if _within(hyp, ref) else None
    return "added" if _within(ref, hyp) else None


def _count(test: Callable[[str], bool], s: str) -> int:
    """How many characters pass, each distinct one tested once."""
    return sum(s.count(c) for c in set(s) if test(c))


def glyph_counts(ref: str, hyp: str) -> tuple[int, int, int]:
    """Period glyphs of the reference, those kept at their aligned place, those of the hypothesis."""
    if ref.isascii() and hyp.isascii():
        return 0, 0, 0
    n_ref, n_hyp = len(_GLYPH.findall(ref)), len(_GLYPH.findall(hyp))
    if not (n_ref and n_hyp):
        return n_ref, 0, n_hyp
    told = _told(ref, hyp)
    if told in ("lost", "added"):  # all of the shorter side is kept
        return n_ref, min(n_ref, n_hyp), n_hyp
    if told == "replaced":
        return n_ref, sum(r == h and bool(_GLYPH.match(r)) for r, h in zip(ref, hyp, strict=True)), n_hyp
    s = script(ref, hyp)
    return n_ref, len(_GLYPH.findall(_ends(s, ref))) + sum(op == "equal" and bool(_GLYPH.match(ref[i])) for op, i, _ in s.steps), n_hyp


@lru_cache(1 << 14)
def _is_punctuation(c: str) -> bool:
    return unicodedata.category(c)[0] in "PS"


@lru_cache(1 << 14)
def _is_glyph(c: str) -> bool:
    return bool(_GLYPH.match(c))


@lru_cache(1 << 14)
def _is_capital(c: str) -> bool:
    return c.isupper() and c.isalpha()


def punct_counts(ref: str, hyp: str) -> tuple[int, int]:
    """Punctuation and symbols of the reference, and those neither replaced nor lost."""
    n = _count(_is_punctuation, ref)
    told = _told(ref, hyp) if n else "added"
    if told == "added":
        return n, n
    if told == "lost":
        return n, _count(_is_punctuation, hyp)
    if told == "replaced":
        return n, n - sum(r != h and _is_punctuation(r) for r, h in zip(ref, hyp, strict=True))
    return n, n - sum(op in ("replace", "delete") and _is_punctuation(ref[i]) for op, i, _ in script(ref, hyp).steps)


def case_counts(ref: str, hyp: str) -> tuple[int, int]:
    """Capitals of the reference read as the same letter, and those of them read in lower case."""
    told = _told(ref, hyp)
    if told in ("lost", "added"):  # all of the shorter side is read as it is
        return _count(_is_capital, min(ref, hyp, key=len)), 0
    if told == "replaced":
        same, pairs = 0, [(r, h) for r, h in zip(ref, hyp, strict=True) if _is_capital(r)]
    else:
        s = script(ref, hyp)
        same = _count(_is_capital, _ends(s, ref))
        pairs = [(ref[i], hyp[j]) for op, i, j in s.steps if op in ("equal", "replace") and _is_capital(ref[i])]
    lowered = sum(r != h and h == r.lower() for r, h in pairs)
    return same + sum(r == h for r, h in pairs) + lowered, lowered


def numeral_counts(ref: str, hyp: str) -> tuple[int, int, int]:
    """Numeral tokens of the reference, of both as multisets, of the hypothesis."""
    if not any(map(str.isdigit, {*ref, *hyp})):
        return 0, 0, 0
    r, h = (Counter(t for t in (w.strip(T.TOKEN_EDGES) for w in s.split()) if not t.isalpha() and any(c.isdigit() for c in t)) for s in (ref, hyp))
    return r.total(), (r & h).total(), h.total()


def substitutions(ref: str, hyp: str) -> list[str]:
    """The key of each word read for another one; words that differ in case or outer punctuation alone are not."""
    r, h = ref.split(), hyp.split()
    return [key(h[j]) for op, i, j in script(r, h).steps if op == "replace" and key(r[i]) != key(h[j])]


# ---------------------------------------------------------------------------------------------- assignment
def assign(cost: np.ndarray) -> list[tuple[int, int]]:
    """The cheapest one-to-one assignment of a rectangular matrix, by shortest augmenting paths."""
    if cost.shape[0] > cost.shape[1]:
        return sorted((i, j) for j, i in assign(cost.T))
    n, m = cost.shape
    u, v = np.zeros(n), np.zeros(m)
    owner = np.full(m, -1)
    for row in range(n):
        best, came, done = np.full(m, np.inf), np.full(m, -1), np.zeros(m, bool)
        i, j, reach = row, -1, 0.0
        tree = []
        while True:
            free = ~done
            through = reach + cost[i] - u[i] - v
            better = free & (through < best)
            best[better], came[better] = through[better], j
            j = int(np.argmin(np.where(free, best, np.inf)))
            reach = float(best[j])
            done[j] = True
            if owner[j] < 0:
                break
            tree.append(j)
            i = int(owner[j])
        u[row] += reach
        for k in tree:
            u[owner[k]] += reach - best[k]
            v[k] -= reach - best[k]
        while j >= 0:
            p = int(came[j])
            owner[j] = row if p < 0 else owner[p]
            j = p
    return sorted((int(i), j) for j, i in enumerate(owner) if i >= 0)


def partial_ratio(needle: str, hay: str) -> tuple[float, int, int]:
    """The best window of a longer text for a shorter one, by shared subsequence: score 0 to 1, start and end; the first of the best.

    A window can't share more of a character than either side has of it; running counts bound all windows at once, and only
    those whose bound can still win are compared.
    """
    n, size = len(needle), len(hay)
    lo = np.maximum(0, np.arange(1 - n, size))
    hi = np.minimum(size, np.arange(1 - n, size) + n)
    codes = np.frombuffer(hay.encode("utf-32-le", "surrogatepass"), np.uint32)
    bound = np.zeros(len(lo), np.int64)
    where: dict[str, int] = {}
    for i, c in enumerate(needle):
        where[c] = where.get(c, 0) | 1 << i
    for c, bits in where.items():
        seen = np.concatenate([[0], np.cumsum(codes == ord(c))])
        bound += np.minimum(seen[hi] - seen[lo], bits.bit_count())
    limit = 2 * bound / (n + hi - lo)
    best = (0.0, 0, 0)
    for k in np.argsort(-limit, kind="stable").tolist():
        if limit[k] < best[0] or not limit[k]:
            break
        a, b = int(lo[k]), int(hi[k])
        if limit[k] == best[0] and (a, b) >= best[1:]:
            continue
        free = (1 << n) - 1
        for c in hay[a:b]:
            hit = free & where.get(c, 0)
            free = (free + hit) | (free - hit)
        score = 2 * (n - (free & ((1 << n) - 1)).bit_count()) / (n + b - a)
        if score > best[0] or (score == best[0] and (a, b) < best[1:]):
            best = (score, a, b)
    return best


# ---------------------------------------------------------------------------------------------- line matching
# They must be as they are for right results.
ACCEPT, ORDER_WEIGHT, MERGE_ACCEPT, FUZZY_CHARS = 0.35, 0.15, 0.60, 4
OWNER_LOSS, SPLIT_GAIN, MERGE_ROUNDS, JOIN_CHARS = 0.02, 0.10, 4, 12
#: Bins of characters for a bound on what lines share, how many numbers a block of it has at most, and a margin beyond rounding.
BINS, BAG_ROOM, SURE = 128, 1 << 21, 1e-9
#: So many lines at most are bounded one by one, which for few is quicker than all at once.
FEW = 8


@lru_cache(1 << 14)
def _plain(s: str) -> str:
    return normalize(s, "L1")


def _alike(ref: str, hyp: str) -> float:
    return similarity(_plain(ref), _plain(hyp))


def _placed(want: str, hay: str) -> tuple[float, int, int]:
    """Where a line lies within a longer output line: score, start, end. A very short one must be a token of it."""
    if len(want) >= FUZZY_CHARS:
        return partial_ratio(want, hay)
    bare, at = want.strip(".,;:"), 0
    for token in hay.split():
        at = hay.index(token, at)
        if bare and token.strip(".,;:") == bare:
            return 1.0, at, at + len(token)
        at += len(token)
    return 0.0, 0, 0


@dataclass
class Lines:
    """What a page's output lines (`outs`) hold of its reference lines (`refs`), whatever their order; a row for each reference line.

    kind: match, merged (part of a line that has another owner, or of one that has none), split (of several output lines) or missing.
    at: the output line, the first of several; sim and text: how alike, and what was read. given: for each output line the characters that
    went to other lines than its owner's. used: the output lines that something was taken from.
    """

    refs: list[str]
    outs: list[str]
    kind: list[str] = field(default_factory=list)
    at: list[int | None] = field(default_factory=list)
    sim: list[float] = field(default_factory=list)
    text: list[str] = field(default_factory=list)
    given: dict[int, np.ndarray] = field(default_factory=dict)
    used: set[int] = field(default_factory=set)

    def __post_init__(self) -> None:
        n = len(self.refs)
        self.kind, self.at, self.sim, self.text = ["missing"] * n, [None] * n, [0.0] * n, [""] * n

    def put(self, i: int, kind: str, outs: Sequence[int], sim: float, text: str) -> None:
        self.kind[i], self.at[i], self.sim[i], self.text[i] = kind, outs[0], sim, text
        self.used.update(outs)

    def rows(self, kind: str) -> list[int]:
        return [i for i, k in enumerate(self.kind) if k == kind]

    @property
    def extra(self) -> list[int]:
        return [j for j in range(len(self.outs)) if j not in self.used]

    def remainder(self, j: int, also: slice = slice(0, 0)) -> str:
        """An output line without the characters given away, and a span."""
        gone = self.given.get(j, np.zeros(len(self.outs[j]), bool)).copy()
        gone[also] = True
        return " ".join("".join(c for c, g in zip(self.outs[j], gone, strict=True) if not g).split()) if gone.any() else self.outs[j]


def _own_places(refs: list[str], outs: list[str]) -> list[float] | None:
    """How alike the lines in equal places are, where any other assignment is sure to cost more; else None."""
    own = [similarity(a, b) for a, b in zip(refs, outs, strict=True)]
    return own if (_few_elsewhere if len(refs) <= FEW else _elsewhere)(refs, outs, own) else None


def _dearer(refs: list[str], out: str, which: list[int], j: int, n: int, enough: list[float]) -> bool:
    """Whether an output line costs each of some reference lines more than enough."""
    for i, d, most in zip(which, distances([refs[i] for i in which], out), enough, strict=True):
        longer = max(len(refs[i]), len(out))
        if (d / longer if longer else 0.0) + ORDER_WEIGHT * abs(i - j) / n <= most:
            return False
    return True


def _few_elsewhere(refs: list[str], outs: list[str], own: list[float]) -> bool:
    """`_elsewhere` for a few lines, by their lengths first and their bags where these don't tell."""
    n = len(refs)
    open_ = []
    for i, a in enumerate(refs):
        enough, size = 1 - own[i] + SURE, len(a)
        for j, b in enumerate(outs):
            if i != j:
                other, away = len(b), ORDER_WEIGHT * abs(i - j) / n
                longer = max(size, other)
                if (1 - min(size, other) / longer if longer else 0.0) + away <= enough:
                    open_.append((i, j, longer, away, enough))
    if not open_:
        return True
    kinds = set().union(*refs)
    bag = lru_cache(None)(lambda s: [*map(s.count, kinds)])
    for i, j, longer, away, enough in open_:
        shared = sum(map(min, bag(refs[i]), bag(outs[j])))
        if (1 - shared / longer if longer else 0.0) + away <= enough and not _dearer(refs, outs[j], [i], j, n, [enough]):
            return False
    return True


def _elsewhere(refs: list[str], outs: list[str], own: list[float]) -> bool:
    """Whether any assignment but that of equal places, where lines are so much alike, is sure to cost more.

    It is, if in each row of the costs the own place has the least. Lines can't share more of a character than either has of it, which
    bounds most of a row; only what this leaves open is compared. Characters that fall into one bin raise the bound, no more.
    """
    n = len(refs)
    own = np.array(own)
    size = np.array([*map(len, refs), *map(len, outs)])
    codes = np.frombuffer("".join([*refs, *outs]).encode("utf-32-le", "surrogatepass"), np.uint32)
    bags = np.bincount(np.repeat(np.arange(2 * n), size) * BINS + codes % BINS, minlength=2 * n * BINS).reshape(2 * n, BINS).astype(np.int32)
    step = max(1, BAG_ROOM // (n * BINS))
    for i in range(0, n, step):
        rows = np.arange(i, min(n, i + step))
        shared = np.minimum(bags[rows, None, :], bags[None, n:, :]).sum(axis=2)
        longer = np.maximum(size[rows, None], size[None, n:])
        least = 1 - np.where(longer > 0, shared / np.maximum(longer, 1), 1.0) + ORDER_WEIGHT * np.abs(rows[:, None] - np.arange(n)) / n
        enough = 1 - own[rows] + SURE
        open_ = least <= enough[:, None]
        open_[np.arange(len(rows)), rows] = False
        for j in np.flatnonzero(open_.any(axis=0)).tolist():
            if not _dearer(refs, outs[j], rows[open_[:, j]].tolist(), j, n, enough[open_[:, j]].tolist()):
                return False
    return True


def _assigned(page: Lines) -> None:
    """The cheapest assignment one to one; likeness counts, and a little the place on the page. Equal lines in equal places cost nothing, any other way does."""
    n, m = len(page.refs), len(page.outs)
    refs, outs = [_plain(x) for x in page.refs], [_plain(x) for x in page.outs]
    own = [1.0] * n if refs == outs else _own_places(refs, outs) if n == m else None
    if own is not None:
        for i, text in enumerate(page.outs):
            if own[i] >= ACCEPT:
                page.put(i, "match", [i], own[i], text)
        return
    kinds, table = list(dict.fromkeys(refs)), {}
    for b in set(outs):
        for a, d in zip(kinds, distances(kinds, b) if len(kinds) > 1 else [distance(kinds[0], b)], strict=True):
            longer = max(len(a), len(b))
            table[a, b] = 1 - d / longer if longer else 1.0
    sim = np.array([[table[a, b] for b in outs] for a in refs])
    away = np.abs(np.arange(n)[:, None] / n - np.arange(m)[None, :] / m)
    for i, j in assign(1 - sim + ORDER_WEIGHT * away):
        if sim[i, j] >= ACCEPT:
            page.put(i, "match", [j], float(sim[i, j]), page.outs[j])


def _granted(page: Lines, owner: dict[int, int], j: int, span: slice) -> bool:
    """Whether an output line can give a span away: nobody has any of it, and what is left still serves its owner."""
    if j in page.given and page.given[j][span].any():
        return False
    if j not in owner:
        return True
    ref = page.refs[owner[j]]
    return _alike(ref, page.remainder(j, span)) >= _alike(ref, page.remainder(j)) - OWNER_LOSS


def _merged(page: Lines) -> None:
    """Missing lines claim spans of the output lines next to theirs or of those without an owner, the best claim that is granted first.

    What a claim is worth doesn't change, so claims are kept from round to round; what can be reached and what is granted does.
    """
    owner = {page.at[i]: i for i in page.rows("match")}
    claims: dict[tuple[int, int], tuple[float, int, int]] = {}
    for _ in range(MERGE_ROUNDS):
        missing = page.rows("missing")
        for i in missing:
            next_to = [page.at[k] for k in (i - 1, i + 1, i - 2, i + 2) if 0 <= k < len(page.refs) and page.at[k] is not None]
            options = []
            for order, j in enumerate(dict.fromkeys([*next_to, *page.extra])):
                want = page.refs[i].strip()
                if len(page.outs[j]) > len(want):
                    if (i, j) not in claims:
                        claims[i, j] = _placed(want, page.outs[j])
                    score, a, b = claims[i, j]
                    if score >= MERGE_ACCEPT:
                        options.append((-score, order, j, slice(a, b)))
            for loss, _, j, span in sorted(options, key=lambda o: o[:2]):
                if _granted(page, owner, j, span):
                    page.put(i, "merged", [j], -loss, page.outs[j][span].strip() or page.outs[j])
                    page.given.setdefault(j, np.zeros(len(page.outs[j]), bool))[span] = True
                    break
        if page.rows("missing") == missing:
            break
    for j in page.given:
        if j in owner:
            page.text[owner[j]] = page.remainder(j)  # how alike it was stands


def _completed(page: Lines) -> None:
    """A match takes the free output line behind or before its own, if that makes it much more alike."""
    for i in page.rows("match"):
        own = page.at[i]
        options = ((own + 1, lambda x, y: (x, y)), (own - 1, lambda x, y: (y, x)))
        for j, order in options:
            if j in page.used or not 0 <= j < len(page.outs):
                continue
            text = " ".join(order(page.text[i], page.outs[j])).strip()
            sim = _alike(page.refs[i], text)
            if sim > page.sim[i] + SPLIT_GAIN:
                page.put(i, "split", [own, j], sim, text)
                break


def _gathered(page: Lines) -> None:
    """A longer line that is still missing is made of two or three free output lines in a row, those that are most alike."""
    for i in page.rows("missing"):
        if len(_plain(page.refs[i])) < JOIN_CHARS:
            continue
        free = set(page.extra)
        found = None
        for j in sorted(free):
            for own in (range(j, j + 2), range(j, j + 3)):
                if free.issuperset(own):
                    text = " ".join(page.outs[x] for x in own)
                    sim = _alike(page.refs[i], text)
                    if sim >= ACCEPT and (found is None or sim > found[0]):
                        found = sim, own, text
        if found:
            page.put(i, "split", list(found[1]), found[0], found[2])


def match_lines(refs: list[str], outs: list[str]) -> Lines:
    page = Lines(refs, outs)
    if refs and outs:
        for stage in (_assigned, _merged, _completed, _gathered):
            stage(page)
    return page


# ---------------------------------------------------------------------------------------------- a page
COUNTS = ("n_ref_chars", "n_ref_words", "ins", "dele", "sub", "word_edits", "n_lines_ref", "n_lines_matched", "n_glyph_ref", "glyph_kept", "n_glyph_hyp", "n_punct_ref", "punct_kept", "n_caps_read", "caps_lowered", "n_num_ref", "num_kept", "n_num_hyp")
#: What is counted of a line pair, at which tier.
BY_TIER = {
    "L0": ((glyph_counts, ("n_glyph_ref", "glyph_kept", "n_glyph_hyp")),),
    "L1": ((case_counts, ("n_caps_read", "caps_lowered")), (numeral_counts, ("n_num_ref", "num_kept", "n_num_hyp"))),
    "L2": ((punct_counts, ("n_punct_ref", "punct_kept")),),
}


@dataclass
class _Side:
    """A tame text at L1: its lines, all of it, its words, its characters, maybe with some more white space; and its lines at L0, where they are others."""

    lines: list[str]
    text: str
    words: list[str]
    chars: set[str]
    unspelt: list[str] | None = None


@lru_cache(4)
def _side(s: str) -> _Side | None:
    chars = set(s)
    if not _tame(s, chars):
        return None
    words = s.split()
    lines = [x for x in map(str.strip, s.split("\n")) if x]
    if "  " in s:
        lines = [" ".join(x.split()) for x in lines]
    if chars.isdisjoint(_SPELT):
        return _Side(lines, " ".join(words), words, chars | {" "})
    text = _steps(" ".join(words), _SPELLING)
    return _Side([_steps(x, _SPELLING) for x in lines], text, text.split(), set(text), lines)


def _places_apart(a: str, b: str) -> list[int]:
    """Where texts of one length differ."""
    x, y = (np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32) for s in (a, b))
    return np.flatnonzero(x != y).tolist()


def _of(test: Callable[[str], bool], s: str, chars: set[str]) -> int:
    """How many characters pass, of a text that has no others than these."""
    return sum(map(s.count, filter(test, chars)))


def _strangers(x: Sequence[Hashable], y: Sequence[Hashable], all_x: Sequence[Hashable], all_y: Sequence[Hashable]) -> bool:
    """Whether the replaced members of one side are not in the other."""
    return set(x).isdisjoint(all_y) or set(y).isdisjoint(all_x)


def _in_places(a: _Side, b: _Side) -> tuple[dict[str, int], list[str]] | None:
    """The counts of a page and its substituted words, where all lines are read in their own places and all only lost, only gained or only replaced members, the
    latter strangers to the other side; else None. What is so for the lines is so for the page, so it is counted once for all lines."""
    n = len(a.lines)
    if not n or n != len(b.lines):
        return None
    sizes, others = list(map(len, a.lines)), list(map(len, b.lines))
    replaced = sizes == others
    at: list[int] = []
    if replaced:
        if a.text != b.text:
            at = _places_apart(a.text, b.text)
            if not _strangers([a.text[i] for i in at], [b.text[i] for i in at], a.chars, b.chars):
                return None
        edits, start, far = (0, 0, len(at)), 0, []
        for size in sizes if at else ():
            far.append(bisect_left(at, start + size) - bisect_left(at, start))
            start += size + 1
    else:
        short, long = (b, a) if len(b.text) < len(a.text) else (a, b)
        if any(len(x) > len(y) for x, y in zip(short.lines, long.lines, strict=True)) or not all(map(_within, short.lines, long.lines)):
            return None
        far = [abs(x - y) for x, y in zip(sizes, others, strict=True)]
        edits = max(0, len(b.text) - len(a.text)), max(0, len(a.text) - len(b.text)), 0
    if far:
        own = [1 - d / max(x, y) for d, x, y in zip(far, sizes, others, strict=True)]
        if min(own) < ACCEPT or not (n == 1 or (_few_elsewhere if n <= FEW else _elsewhere)(a.lines, b.lines, own)):
            return None

    glyphs = 0, 0, 0
    n_caps = _of(_is_capital, a.text, a.chars)
    read = [(a.text[i], b.text[i]) for i in at]
    if a.unspelt or b.unspelt:
        glyphs = tuple(map(sum, zip(*map(glyph_counts, a.unspelt or a.lines, b.unspelt or b.lines), strict=True)))
    elif not (a.text.isascii() and b.text.isascii()):
        x, y = (_of(_is_glyph, s.text, s.chars) for s in (a, b))
        glyphs = x, x - sum(_is_glyph(r) for r, _ in read) if replaced else min(x, y), y
    if replaced:
        changed = [(r, h) for r, h in read if _is_capital(r)]
        lowered = sum(h == r.lower() for r, h in changed)
        caps = n_caps - len(changed) + lowered, lowered
    else:  # all of the shorter side is read as it is
        caps = n_caps if short is a else _of(_is_capital, b.text, b.chars), 0
    numerals = 0, 0, 0
    if any(map(str.isdigit, a.chars | b.chars)):
        numerals = tuple(map(sum, zip(*map(numeral_counts, a.lines, b.lines), strict=True)))

    n_punct = kept = _of(_is_punctuation, a.text, a.chars)  # L2 makes no letter of a mark, nor the other way
    if not replaced:
        kept = n_punct if short is a else _of(_is_punctuation, b.text, b.chars)
    elif at and n_punct:
        apart = [(r, h) for r, h in zip(_lowered("".join(r for r, _ in read)), _lowered("".join(h for _, h in read)), strict=True) if r != h]
        gone, new = zip(*apart, strict=True) if apart else ((), ())
        if _strangers(gone, new, _lowered("".join(a.chars)), _lowered("".join(b.chars))):
            kept = n_punct - sum(map(_is_punctuation, gone))
        else:
            kept = sum(punct_counts(_lowered(r), _lowered(h))[1] for r, h in zip(a.lines, b.lines, strict=True))

    word_edits, words = 0, []
    if a.words != b.words:
        differ = [*map(ne, a.words, b.words)]
        x, y = ([*compress(s.words, differ)] for s in (a, b))
        if len(a.words) == len(b.words) and (n == 1 or all(r.count(" ") == h.count(" ") for r, h in zip(a.lines, b.lines, strict=True))) and _strangers(x, y, a.words, b.words):
            word_edits, words = len(x), [k for r, k in zip(map(key, x), map(key, y), strict=True) if r != k]
        else:
            word_edits = distance(a.words, b.words)
            words = [w for r, h in zip(a.lines, b.lines, strict=True) for w in substitutions(r, h)]
    return dict(zip(COUNTS, (len(a.text), len(a.words), *edits, word_edits, n, n, *glyphs, n_punct, kept, *caps, *numerals), strict=True)), words


def page_counts(ref: str | None, hyp: str | None, failed: bool) -> dict[str, object]:
    """All counts of a page, and the keys of the words read for others (`substituted`). A failed page counts as if nothing was read."""
    hyp = "" if failed else hyp or ""
    sides = _side(ref or ""), _side(hyp)
    if None not in sides and (told := _in_places(*sides)) is not None:
        return told[0] | {"substituted": told[1]}
    a, b = normalize(ref, "L1"), normalize(hyp, "L1")
    ins, dele, sub = edit_counts(a, b)
    words_a, words_b = a.split(), b.split()
    page = match_lines(split_lines(ref), split_lines(hyp))
    out: Counter = Counter(n_ref_chars=len(a), n_ref_words=len(words_a), ins=ins, dele=dele, sub=sub, word_edits=distance(words_a, words_b),
                           n_lines_ref=len(page.refs), n_lines_matched=len(page.refs) - len(page.rows("missing")))
    substituted: list[str] = []
    for tier, counted in BY_TIER.items():
        for line, read in zip(page.refs, page.text, strict=True):
            r, h = normalize(line, tier), normalize(read, tier)
            if not r:
                continue
            for count, names in counted:
                out.update(dict(zip(names, count(r, h), strict=True)))
            if tier == "L1":
                substituted += substitutions(r, h)
    return {c: out[c] for c in COUNTS} | {"substituted": substituted}
