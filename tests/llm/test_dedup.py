import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from collatio.llm import _hashing as H
from collatio.llm import _repeats as R
from collatio.llm import embeddings, jaccard, substring, suffix
from collatio.llm._components import components

from . import fixtures as X


def test_hashes():
    texts = [b"a b  c\td", b"", b"  ", b"a b c d e", b"x" * 5000]
    w, first = H.words(texts)
    assert list(np.diff(first)) == [4, 0, 0, 5, 1]
    assert list(w[:4]) == list(w[4:8])
    h, at = H.windows(w, first, 3)
    assert list(at) == [0, 1, 4, 5, 6] and list(h[:2]) == list(h[2:4])
    buf, _ = H.join([b"abcabc", b"zabc"])
    assert len(set(H.at(buf, np.array([0, 3, 8]), 3))) == 1
    old, H.SLICE = H.SLICE, 7
    try:
        again, places = H.words(texts)
        assert list(again) == list(w) and list(places) == list(first)
        assert list(H.at(buf, np.array([0, 3, 8]), 3)) == [H.at(buf, np.array([0]), 3)[0]] * 3
    finally:
        H.SLICE = old


@pytest.mark.parametrize("window", [13, 5])
def test_substring(spark, window):
    rows = X.documents()
    got = substring.remove_repeats(X.frame(spark, rows), window).collect()
    want = X.removed_words(rows, window)
    assert len(got) == len(rows)
    for r in got:
        assert (r["n_words"], r["n_removed"], r["text"]) == want[r["doc_id"]]
        assert r["n_removed"] == sum(s["stop"] - s["start"] for s in r["spans"]) and r["row"]["n_words"] == "extra"
        assert all(a["stop"] < b["start"] for a, b in itertools.pairwise(r["spans"]))


def test_substring_edges(spark):
    long = " ".join(f"w{i}" for i in range(20))
    same = substring.remove_repeats(spark.createDataFrame([(1, long), (1, long), (2, long)], "doc_id bigint, text string")).collect()
    assert sorted((r["doc_id"], r["n_removed"]) for r in same) == [(1, 0), (1, 0), (2, 20)]
    assert substring.remove_repeats(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
    kept = substring.remove_repeats(spark.createDataFrame([(1, "a  b\n")], "doc_id bigint, text string"), squeeze=False).first()
    assert kept["text"] == "a  b\n"


def test_suffix(spark):
    rows = X.documents(40)
    rows += [(9, rows[3][1]), (2000, "ab" * 300), (2001, "é" * 120), (2002, "ab" * 200 + "é" * 80)]
    got = suffix.remove_repeats(X.frame(spark, rows)).selectExpr("doc_id", "n_bytes", "n_removed", "size(spans) AS n", "sha2(kept, 256) AS h", "row.row AS place").collect()
    want = X.removed_bytes(rows, 100)
    assert len(got) == len(rows)
    by = {}
    for r in got:
        if r["doc_id"] is None:
            assert r["n_removed"] == 0
        else:
            by.setdefault(r["doc_id"], []).append((r["n_bytes"], r["n_removed"], r["n"], r["h"]))
    assert {k: sorted(v) for k, v in by.items()} == {k: sorted(v) for k, v in want.items()}
    assert suffix.remove_repeats(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
    with pytest.raises(ValueError):
        suffix.remove_repeats(X.frame(spark, rows), 57)


def test_cover():
    differences = {(a - b) % suffix.PERIOD for a in suffix.COVER for b in suffix.COVER}
    assert differences == set(range(suffix.PERIOD))


@pytest.mark.parametrize("words,percent", [(4, 85), (5, 80), (2, 50)])
def test_jaccard(spark, words, percent):
    rows = X.documents(80, seed=4)
    got = {(r["doc_id"]): (r["n_shingles"], r["component_id"]) for r in jaccard.near(X.frame(spark, rows), words, percent).collect()}
    sets = {i: X.shingle_set(t, words) for i, t in rows if i is not None}
    links = [(a, b) for a, b in itertools.combinations(sets, 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    comp = X.components(sets, links)
    assert got.pop(None)[1] is None
    assert got == {i: (len(s), comp[i]) for i, s in sets.items()}


def test_jaccard_blocks(spark):
    """A cluster of many blocks, whose links form chains: each text differs from the next by a little."""
    rng = random.Random(0)
    words, rows = [f"w{i}" for i in range(60)], []
    for i in range(90):
        words[rng.randrange(60)] = f"n{i}"
        rows.append((1000 - i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    old, jaccard.links.__defaults__ = jaccard.links.__defaults__, (8,)
    try:
        got = {r["doc_id"]: r["component_id"] for r in jaccard.near(docs).collect()}
    finally:
        jaccard.links.__defaults__ = old
    sets = {i: X.shingle_set(t, 4) for i, t in rows}
    links = [(a, b) for a, b in itertools.combinations(sets, 2) if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    assert got == X.components(sets, links)
    assert jaccard.near(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_search_merges_alike(monkeypatch):
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 60, 40).astype(np.uint64)) for _ in range(30)]
    lists = {}
    for d, s in enumerate(sets):
        for x in s.tolist():
            lists.setdefault(x, []).append(d)
    for q in sets:
        want = [d for d, s in enumerate(sets) if 100 * len(np.intersect1d(q, s)) >= 50 * len(np.union1d(q, s))]
        for heap in (10**9, 0):
            monkeypatch.setattr(jaccard, "HEAP", heap)
            assert sorted(jaccard.search(q, lists, sets, 50, lambda d: False)) == want


def test_components(spark):
    rng = random.Random(3)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(160)] + [(i, i + 1) for i in range(400, 440)] + [(None, 1), (5, 5)]
    real = [(a, b) for a, b in links if a is not None and a != b]
    want = X.components({x for e in real for x in e}, real)
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == want
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def vectors(n=400, dim=8, seed=0):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        if rows and i % 4 == 1:
            x = np.array(rows[-1][1]) + rng.normal(0, 0.06, dim)
        elif rows and i % 7 == 2:
            x = np.array(rows[-1][1]) * 2
        else:
            x = rng.normal(size=dim)
        rows.append((i, [float(np.float32(v)) for v in x], i // 4 % 3))
    nan, inf = float("nan"), float("inf")
    rows += [(900, None, 0), (901, [0.0] * dim, 0), (902, [nan] * dim, 0), (903, [1.0, None] * (dim // 2), 0), (904, [inf] * dim, 0), (905, rows[0][1], None), (906, [], 0), (907, rows[0][1][: dim - 1], 0), (908, rows[0][1], 0), (909, rows[0][1], 0)]
    return rows


@pytest.mark.parametrize("side,cell", [(1024, 1500), (16, 20)])
def test_embeddings(spark, monkeypatch, side, cell):
    rows = vectors()
    monkeypatch.setattr(embeddings.fit, "__defaults__", (20_000, cell, 4096))
    df = spark.createDataFrame([(i, v, y, "x") for i, v, y in rows], "vec_id bigint, embedding array<float>, label int, cell string")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embeddings.near(df, side=side).collect()}
    good = {i: (np.array(v, float), y) for i, v, y in rows if y is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    cos = lambda a, b: a @ b / np.linalg.norm(a) / np.linalg.norm(b)
    links = [(a, b) for a, b in itertools.combinations(good, 2) if good[a][1] == good[b][1] and len(good[a][0]) == len(good[b][0]) and cos(good[a][0], good[b][0]) >= 0.98]
    assert len(links) > 50
    comp = X.components([i for i, _, _ in rows], links)
    degree = {i: 0 for i, _, _ in rows}
    for a, b in links:
        degree[a] += 1
        degree[b] += 1
    assert got == {i: (degree[i], comp[i], comp[i] == i) for i, _, _ in rows}


def test_embeddings_empty(spark):
    assert embeddings.near(spark.createDataFrame([], "vec_id bigint, embedding array<float>, label int")).count() == 0


def test_cells_are_centred():
    x = np.random.default_rng(0).normal(size=(300, 5))
    c = embeddings.kmeans(x / np.linalg.norm(x, axis=1, keepdims=True), 7)
    assert c.shape == (7, 5) and np.allclose(np.linalg.norm(c, axis=1), 1)


def test_null_ids_of_vectors(spark):
    got = embeddings.near(spark.createDataFrame([(None, [1.0, 0.0], 1), (1, [1.0, 0.0], 1)], "vec_id bigint, embedding array<double>, label int")).orderBy(F.col("vec_id").asc_nulls_first()).collect()
    assert [tuple(r) for r in got] == [(None, 0, None, True), (1, 0, 1, True)]


def test_extreme_vectors(spark):
    rows = [(1, [1e200, 1e200], 0), (2, [1e200, 1.0001e200], 0), (3, [1e-200, 1e-200], 0), (4, [1.0, 0.3], 0), (5, [0.3, 1.0], 0), (6, [5e-324, 0.0], 0), (7, [1e308, 0.0], 0)]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embeddings.near(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")).collect()}
    assert got == {1: (2, 1), 2: (2, 1), 3: (2, 1), 4: (0, 4), 5: (0, 5), 6: (1, 6), 7: (1, 6)}


@pytest.mark.parametrize("width", [1, 4, 32])
def test_an_id_is_one_node(spark, width):
    rng = random.Random(2)
    x, y, z = (" ".join(rng.choices(["ab", "cd", "ef", "gh", "ij", "kl", "mn"], k=40)) for _ in range(3))
    rows = [(1, x), (2, x), (2, y), (3, z), (4, y), (4, z), (5, None), (5, z), (6, "alone in here it is"), (7, "")]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", width)
        got = jaccard.near(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == sorted((i, len(X.shingle_set(t, 4)), 1 if i < 6 else i) for i, t in rows)


def test_null_ids_spread(spark):
    rows = spark.range(4000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("one text").alias("text"))
    sizes = [r["count"] for r in R.chunked(rows, R.Layout([0, 1], 8, 4)).groupBy("chunk").count().collect()]
    assert len(sizes) == 8 and max(sizes) < 1000


@pytest.mark.parametrize("length", [58, 64, 100, 121, 122, 240])
def test_suffixes_are_in_order(length):
    """The order of a bucket equals a plain sort, block by block, and ties are found where they are, however long."""
    rng = random.Random(length)
    for alphabet in (b"ab", b"a\x00\xff", b"abcdefgh "):
        base = bytes(rng.choices(alphabet, k=1200))
        parts = [base[a : a + rng.randint(150, 600)] for a in (rng.randrange(900) for _ in range(12))]
        text = b"".join([*parts, alphabet[:1] * 700, bytes(rng.choices(alphabet, k=300))])
        places = np.arange(len(text) - length + 1)
        s = suffix.Suffixes(text, length)
        keys = [text[p : p + length] for p in places]
        order, new = s.ordered(places)
        got = [keys[i] for i in order]
        assert got == sorted(keys)
        assert new.tolist() == [k == 0 or got[k] != got[k - 1] for k in range(len(got))]
        blocks = list(s.blocks(places, 300))
        assert len(blocks) > 1 and [keys[b[i]] for b in blocks for i in s.ordered(places[b])[0]] == got


def test_chunks_are_bounded_by_bytes(spark, monkeypatch):
    """Results don't depend on how many chunks there are; long texts make more of them."""
    rows = X.documents(40)
    docs = X.frame(spark, rows)
    before = R.layout(docs)
    want = sorted(map(tuple, substring.remove_repeats(docs).select("doc_id", "n_removed").collect()), key=str)
    monkeypatch.setattr(R, "CHUNK_BYTES", 1000)
    plan = R.layout(docs)
    assert plan.chunks == -(-sum(len((t or "").encode()) for _, t in rows) // 1000) > before.chunks and plan.buckets > before.buckets
    assert sorted(map(tuple, substring.remove_repeats(docs).select("doc_id", "n_removed").collect()), key=str) == want
    monkeypatch.setattr(R, "CHUNK_BYTES", 1 << 40)
    assert R.layout(docs.limit(0)).chunks == before.chunks
