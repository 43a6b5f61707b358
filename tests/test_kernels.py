import itertools
import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given
from hypothesis import strategies as st

from collatio.functions import align, pages
from collatio.functions import kernels as K


def table_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


words = st.text("abc ſ", max_size=12)


@given(words, words)
def test_scripts_are_optimal(a, b):
    made = K.script(a, b)
    ops = [*(("equal", k, k) for k in range(made.head)), *made.steps, *(("equal", len(a) - made.tail + k, len(b) - made.tail + k) for k in range(made.tail))]
    assert K.distance(a, b) == table_distance(a, b) == sum(o != "equal" for o, _, _ in ops)
    assert [i for o, i, _ in ops if o != "insert"] == list(range(len(a)))
    assert [j for o, _, j in ops if o != "delete"] == list(range(len(b)))
    assert all((a[i] == b[j]) == (o == "equal") for o, i, j in ops if o in ("equal", "replace"))
    assert sum(o == "insert" for o, _, _ in ops) - sum(o == "delete" for o, _, _ in ops) == len(b) - len(a)


@given(words, words)
def test_counts_stay_within_the_reference(a, b):
    n, kept, _ = K.glyph_counts(a, b)
    assert 0 <= kept <= n
    n, kept = K.punct_counts(a, b)
    assert 0 <= kept <= n


def test_assignment_is_cheapest():
    rng = np.random.default_rng(0)
    for n, m in itertools.product(range(1, 6), repeat=2):
        cost = rng.random((n, m))
        got = K.assign(cost)
        small = cost if n <= m else cost.T
        best = min(sum(small[i, p[i]] for i in range(len(small))) for p in itertools.permutations(range(small.shape[1]), len(small)))
        assert len(got) == min(n, m) and abs(sum(cost[i, j] for i, j in got) - best) < 1e-9


COUNTS = [
    (K.glyph_counts, "ſeeʆ geweſte", "ſeel geweste", (3, 1, 1)), (K.glyph_counts, "dass", "daſs", (0, 0, 1)), (K.glyph_counts, "Bruͤder", "Brüder", (1, 0, 0)),
    (K.punct_counts, "concl: ad 1. der erstere", "concl ad 1, der erstere", (2, 0)), (K.punct_counts, "concl: ad 1.", "concl: ad 1.", (2, 2)),
    (K.case_counts, "Der Wald bei Harzburg", "der Wald bei Marzburg", (2, 1)), (K.numeral_counts, "den 25. Januar 1923, 25 fl.", "den 25. Januar 1928", (3, 1, 2)),
]


@pytest.mark.parametrize("f,ref,hyp,want", COUNTS)
def test_counts(f, ref, hyp, want):
    assert f(ref, hyp) == want


def test_substitutions():
    assert K.substitutions("bei Harzburg am Harze", "bei Herzberg am Hxrze") == ["herzberg", "hxrze"]
    assert K.substitutions("Am Harze.", "am Harze") == []


LINES = ["erste Zeile der Seite", "zweite Zeile steht da", "dritte Zeile am Ende"]


def kinds(refs, hyps):
    m = K.match_lines(refs, hyps)
    return m.kind, m.text, m.extra


def test_lines():
    assert kinds(LINES, LINES) == (["match"] * 3, LINES, [])
    assert kinds(LINES, LINES[::-1])[1] == LINES
    joined = kinds(LINES, [" ".join(LINES)])
    assert "missing" not in joined[0] and "merged" in joined[0]
    broken = kinds([LINES[0], LINES[1]], ["erste Zeile", "der Seite", LINES[1]])
    assert broken[0] == ["split", "match"] and broken[1][0] == LINES[0]
    missing = kinds(LINES, [LINES[0], "0000 1111 2222 3333 4444"])
    assert missing[0] == ["match", "missing", "missing"] and missing[2] == [1]
    assert kinds([], ["x"]) == ([], [], [0]) and kinds(LINES, [])[0] == ["missing"] * 3


def test_pages():
    text = "Concʆ: Sub Consuetis clausu[-]\nſeeʆ geweſte Köchin außgeſaget\nden 25. Januar 1739"
    own = K.page_counts(text, text, False)
    assert own["ins"] == own["dele"] == own["sub"] == own["word_edits"] == 0 and own["n_lines_matched"] == own["n_lines_ref"] == 3
    assert own["n_num_ref"] == own["num_kept"] == 2 and own["substituted"] == []
    none = K.page_counts(text, "I cannot read this", True)
    assert none["dele"] == none["n_ref_chars"] and none["word_edits"] == none["n_ref_words"] and none["n_lines_matched"] == 0 and none["num_kept"] == 0
    assert none["n_punct_ref"] == own["n_punct_ref"]


def test_a_line_within_another():
    refs = ["Concl: Sub Consuetis clausulis", "fl.", "den 25. Januar 1739 zu Harzburg"]
    m = K.match_lines(refs, ["Concl: Sub Consuetis clausulis fl. den 25. Januar 1739 zu Harzburg"])
    assert sorted(m.kind) == ["match", "merged", "merged"] and m.text[1] == "fl." and m.extra == []
    assert [K.similarity(a, b) > 0.9 for a, b in zip(refs, m.text, strict=True)] == [True] * 3
    gathered = K.match_lines(["eine sehr lange Zeile der alten Seite Nr"], ["eine sehr lan", "ge Zeile der a", "lten Seite Nr", "ganz was?"])
    assert gathered.kind == ["split"] and gathered.extra == [3]


def test_long_scripts_need_little_memory():
    import tracemalloc

    rng = random.Random(1)
    a = "".join(rng.choices("abcdefgh ", k=20_000))
    b = "".join(c for c in a if rng.random() > 0.02)
    tracemalloc.start()
    s = K.script(a, b)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert s.count("delete") - s.count("insert") == len(a) - len(b) and peak < 16 << 20  # the whole table would take 50 MB


def plain_partial_ratio(needle, hay):
    """Every window, the shared subsequence by the table."""
    best, n = (0.0, 0, 0), len(needle)
    for at in range(1 - n, len(hay)):
        lo, hi = max(0, at), min(len(hay), at + n)
        row = [0] * (n + 1)
        for c in hay[lo:hi]:
            row = [0, *itertools.accumulate(range(n), lambda last, i, row=row, c=c: max(last, row[i + 1], row[i] + (needle[i] == c)), initial=0)][1:]
        score = 2 * row[-1] / (n + hi - lo)
        best = max(best, (score, -lo, -hi), key=lambda x: x[0]) if score > best[0] else best
    return best[0], -best[1], -best[2]


def test_windows_left_out_cannot_win():
    rng = random.Random(2)
    for _ in range(300):
        a, b = "".join(rng.choices("ab c", k=rng.randint(1, 7))), "".join(rng.choices("ab c", k=rng.randint(1, 16)))
        assert K.partial_ratio(a, b) == plain_partial_ratio(a, b)


def test_partial_ratio():
    assert K.partial_ratio("abc", "xxabcxx") == (1.0, 2, 5)
    random.seed(0)
    for _ in range(200):
        a, b = "".join(random.choices("ab", k=3)), "".join(random.choices("abc", k=8))
        score, lo, hi = K.partial_ratio(a, b)
        assert 0 <= score <= 1 and 0 <= lo <= hi <= len(b)


READINGS = (str.lower, lambda x: x.replace(".", "").replace(",", ""), lambda x: x.replace("th", "t"))


def table_script(a, b):
    """The script of the whole table: from the end delete, else insert, else step over both; common ends first."""
    head = next((k for k, (x, y) in enumerate(itertools.zip_longest(a, b)) if x != y), len(a))
    tail = next((k for k, (x, y) in enumerate(itertools.zip_longest(a[head:][::-1], b[head:][::-1])) if x != y), len(a) - head)
    i, j, steps = len(a) - tail, len(b) - tail, []
    d = {(p, q): table_distance(a[head:p], b[head:q]) for p in range(head, i + 1) for q in range(head, j + 1)}
    while i > head or j > head:
        if i > head and (j == head or d[i, j] == d[i - 1, j] + 1):
            i -= 1
            steps.append(("delete", i, j))
        elif j > head and (i == head or d[i, j] == d[i, j - 1] + 1):
            j -= 1
            steps.append(("insert", i, j))
        else:
            i, j = i - 1, j - 1
            steps.append(("equal" if a[i] == b[j] else "replace", i, j))
    return K.Script(head, tail, steps[::-1])


@given(st.text("abA.", max_size=9), st.text("abA.", max_size=9), st.sampled_from((*READINGS, lambda x: x[::2], lambda x: x.replace("a", "XY"))))
def test_told_scripts_are_those_of_the_table(a, b, read):
    for x, y in ((a, b), (a, read(a)), (read(a), a), (a, read(b))):
        s = table_script(x, y)
        assert K.script(x, y) in ([s] if x != y else [K.Script(len(x), 0, [])])
        assert K.edit_counts(x, y) == tuple(map(s.count, ("insert", "delete", "replace")))
        assert K.distance(list(x), list(y)) == K.distance(x, y) == table_distance(x, y)
        assert K.distances([x, y, a], b) == [table_distance(z, b) for z in (x, y, a)]


def test_edits_of_readings_fill_no_table(monkeypatch):
    """What is only lost or replaced by strangers is counted in one pass, also by words, however long the line."""
    line = "The other path, then. " * 2000
    monkeypatch.setattr(K, "distances", None)
    monkeypatch.setattr(K, "_Columns", None)
    assert [K.edit_counts(line, f(line)) for f in READINGS] == [(0, 0, 2000), (0, 4000, 0), (0, 6000, 0)]
    assert [K.distance(line.split(), f(line).split()) for f in READINGS] == [2000, 4000, 6000]
    assert K.page_counts(line.strip(), line.strip().lower(), False)["sub"] == 2000


PAGE = ["The other Path, then.", "", "Ten thorns: 7 and 12.", "The other Path, then.", "ſo daſs — Ten", "thin. Thin."]


def test_lines_read_in_their_places_fill_no_table(monkeypatch):
    """Neither a table of all lines against all nor an assignment, and no steps of a line that only loses or replaces."""
    want = [K.page_counts("\n".join(PAGE * 3), f("\n".join(PAGE * 3)), False) for f in READINGS]
    for name in ("assign", "distances", "_Columns"):
        monkeypatch.setattr(K, name, None)
    monkeypatch.setattr(K, "script", lambda a, b, real=K.script: real(a, b) if isinstance(a, list) else None)
    assert [K.page_counts("\n".join(PAGE * 3), f("\n".join(PAGE * 3)), False) for f in READINGS] == want
    assert [(p["n_lines_matched"], p["caps_lowered"], p["n_punct_ref"], p["punct_kept"]) for p in want] == [(15, 21, 27, 27), (15, 0, 27, 6), (15, 0, 27, 27)]


def as_steps(ref, hyp):
    """The counts of a pair by the steps of the whole table."""
    s = table_script(ref, hyp)
    steps = [*(("equal", k, k) for k in range(s.head)), *s.steps, *(("equal", len(ref) - s.tail + k, len(hyp) - s.tail + k) for k in range(s.tail))]
    kept = [(ref[i], hyp[j]) for o, i, j in steps if o in ("equal", "replace")]
    caps = [(r, h) for r, h in kept if r.isupper() and h in (r, r.lower())]
    glyphs = sum(o == "equal" and ref[i] == "ſ" for o, i, _ in steps) if "ſ" in hyp else 0
    return (len(caps), sum(r != h for r, h in caps)), (ref.count("."), ref.count(".") - sum(o in ("replace", "delete") and ref[i] == "." for o, i, _ in steps)), (ref.count("ſ"), glyphs, hyp.count("ſ"))


@given(st.text("aABſ.", max_size=9), st.text("aABſ.", max_size=9), st.sampled_from((*READINGS, lambda x: x[::2], lambda x: x.replace("a", "XY"))))
def test_told_counts_are_those_of_the_steps(a, b, read):
    for x, y in ((a, b), (a, read(a)), (read(a), a), (a, read(b))):
        assert (K.case_counts(x, y), K.punct_counts(x, y), K.glyph_counts(x, y)) == as_steps(x, y)


@given(st.lists(st.text("abA ", max_size=5), min_size=1, max_size=5), st.data())
def test_own_places_only_where_they_are_cheapest(refs, data):
    outs = data.draw(st.lists(st.text("abA ", max_size=5), min_size=len(refs), max_size=len(refs))) if data.draw(st.booleans()) else [r.lower() for r in refs]
    if not any(refs + outs):
        return
    own, n = K._own_places(refs, outs), len(refs)
    cost = np.array([[1 - K.similarity(a, b) + K.ORDER_WEIGHT * abs(i - j) / n for j, b in enumerate(outs)] for i, a in enumerate(refs)])
    assert (own is not None) == all(cost[i, j] > cost[i, i] + K.SURE for i in range(n) for j in range(n) if i != j)
    if own is not None:
        assert own == [K.similarity(a, b) for a, b in zip(refs, outs)] and K.assign(cost) == [(i, i) for i in range(n)]


def test_pages_read_in_their_places_are_counted_whole(monkeypatch):
    """Neither lines are matched nor is each normalised and aligned for each count, where all lines only lost, gained or replaced members."""
    text = "\n".join(PAGE[:1] + PAGE[2:4] + ["Große  Wäſche, gut.", "thin. Thin."])
    whole = K._side
    monkeypatch.setattr(K, "_side", lambda s: None)
    want = [K.page_counts(text, f(text), False) for f in READINGS]
    monkeypatch.setattr(K, "_side", whole)
    for name in ("match_lines", "normalize", "edit_counts", "distance", "case_counts", "punct_counts", "substitutions"):
        monkeypatch.setattr(K, name, None)
    assert [K.page_counts(text, f(text), False) for f in READINGS] == want


texts = st.lists(st.one_of(st.sampled_from(["The other Path, then. ", "Ein Haus ", "ſo daſs Größe ", "\n", " \n", "12 Ten-", "|", "- - -", "[?]", "aͤ", "İ", "ä", "7 ", "ﬁn Ⓐ "]), st.text("aAbT.,7 ſß\n-", max_size=6)), max_size=12).map("".join)


@given(texts, texts, st.sampled_from((*READINGS, str.upper, lambda x: x[::2], lambda x: x.replace(" ", ""), lambda x: x.replace(".", ".!"), lambda x: x.replace("a", "q").replace("e", "z"))))
def test_counts_of_whole_pages_are_those_of_lines(a, b, read):
    for x, y in ((a, b), (a, read(a)), (read(a), a)):
        with pytest.MonkeyPatch.context() as m:
            m.setattr(K, "_side", lambda s: None)
            m.setattr(K, "_tame", lambda s, chars: False)
            K._plain.cache_clear()
            want = K.page_counts(x, y, False), [K.normalize(x, t) for t in ("L0", "L1", "L2")]
        K._plain.cache_clear()
        assert (K.page_counts(x, y, False), [K.normalize(x, t) for t in ("L0", "L1", "L2")]) == want
        assert list(want[0]) == [*K.COUNTS, "substituted"]


@given(st.lists(st.text("abA ", max_size=5), min_size=1, max_size=10), st.data())
def test_few_lines_are_bounded_as_many_are(refs, data):
    outs = data.draw(st.permutations(refs)) if data.draw(st.booleans()) else [r.lower() for r in refs]
    if any(refs):
        own = [K.similarity(a, b) for a, b in zip(refs, outs)]
        assert K._few_elsewhere(refs, outs, own) == K._elsewhere(refs, outs, own)


def test_marks_stay_marks_in_lower_case():
    """What counting them without lowering a page rests on."""
    import unicodedata

    assert not [c for c in map(chr, range(0x110000)) if c not in K._STEPPED and (len(c.lower()) != 1 or K._is_punctuation.__wrapped__(c) != K._is_punctuation.__wrapped__(c.lower()))]
    assert all(unicodedata.category(c)[0] == "L" for pair in (*K.T.V_AS_U, *K.T.J_AS_I) for c in pair)


EDITED = (*READINGS, str.upper, lambda x: x[::2], lambda x: x.replace(" ", ""), lambda x: x.replace("a", "q").replace("e", "z"), lambda x: x.replace("aa", "a").replace("bb", "b"), lambda x: x.replace("T", "t").replace("h", "T"))


@given(st.lists(st.tuples(st.one_of(texts, st.text("abT \n", max_size=24)), st.sampled_from(EDITED), st.booleans(), st.sampled_from((False,) * 9 + (True,))), max_size=9), st.sampled_from((1, 99, 1 << 17)), st.sampled_from((1, 1 << 22)))
def test_counts_of_many_pages_are_those_of_each(rows, block, table):
    """However they are dealt to blocks."""
    refs = [f(x) if back else x for x, f, back, _ in rows]
    hyps = [x if back else f(x) for x, f, back, _ in rows]
    failed = [f for *_, f in rows]
    want = [K.page_counts(*page) for page in zip(refs, hyps, failed, strict=True)]
    with pytest.MonkeyPatch.context() as m:
        m.setattr(pages, "BLOCK", block)
        m.setattr(pages, "TABLE", table)
        counts, words = pages.page_counts(refs, hyps, failed)
    assert [dict(zip(K.COUNTS, c)) | {"substituted": w} for c, w in zip(counts.tolist(), words, strict=True)] == want


@given(st.lists(st.sampled_from(["a", "b", "c", "d", "e"]), min_size=1, max_size=9), st.data())
def test_words_in_turn_are_those_of_the_table(x, data):
    y = [data.draw(st.sampled_from([w, w, "c", "f"])) for w in x]
    r, h = zip(*[(p, q) for p, q in zip(x, y) if p != q]) if x != y else ((), ())
    edits, read = pages._words_in_turn(" ".join(x) + "\n", " ".join(y) + "\n", list(r), list(h), list(h), [0] * len(r))
    assert edits == table_distance(x, y) and read == [y[j] for op, _, j in table_script(x, y).steps if op == "replace"]


def test_a_batch_of_pages_is_counted_side_by_side(monkeypatch):
    """Pages read in their places aren't counted one by one, failed ones and those with other lines are."""
    text = "\n".join(PAGE[:1] + PAGE[2:4] + ["Große  Wäſche, gut.", "thin. Thin."])
    rows = [(text + f"\nthe {i}th", f(text + f"\nthe {i}th"), False) for i in range(40) for f in READINGS] + [(text, text, True), (text, "thin", False)]
    want = [K.page_counts(*r) for r in rows]
    alone = []
    monkeypatch.setattr(K, "page_counts", lambda *page, real=K.page_counts: alone.append(page) or real(*page))
    out = align._page(*(pa.array(c) for c in zip(*rows)))
    assert out.to_pylist() == want and alone == rows[-2:]
