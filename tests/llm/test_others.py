import base64
import collections
import gzip
import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from collatio.llm import _store, _tokens, decontam, packing, tokenout, toxicity, urls, warc

from . import fixtures as X

DATA = "/root/testdata/sf0.001"


# ---------------------------------------------------------------------------------------------- tokens, packing
@settings(max_examples=150, deadline=None)
@given(st.text(st.sampled_from(list("abXY.,!'’…-_<|>endoftxΣσİ́ \t\n\x1f\x85 ½²٣中한'stredm")), max_size=25))
def test_ids_are_the_tokenizers(text):
    t = _tokens.tokens(_tokens.default_path())
    want = np.array(t.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    assert t.encode([text.encode()]) == [want]


def test_other_vocabularies_are_encoded_whole():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = ["Two  spaces, Upper Case\n and ümlauts", "", " x"]
    assert isinstance(_tokens.tokens(path), _tokens.Plain) and isinstance(_tokens.tokens(_tokens.default_path()), _tokens.Tokens)
    got = [np.frombuffer(x, "<u4").tolist() for x in _tokens.tokens(path).encode([t.encode() for t in texts])]
    assert got == [e.ids for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]


def test_special_and_many():
    t = _tokens.tokens(_tokens.default_path())
    texts = [x or "" for _, x in X.documents()] + ["a<|endoftext|>b. it's", "x's. İ. ́,"]
    assert t.encode([x.encode() for x in texts]) == [np.array(t.tokenizer.encode(x, add_special_tokens=False).ids, "<u4").tobytes() for x in texts]


@given(st.lists(st.integers(1, 40), max_size=80))
def test_best_fit(lengths):
    """Each length goes to the fullest bin that has room, as a plain search over all bins does."""
    fit, bins = packing.BestFit(40), []
    for n in sorted(lengths, reverse=True):
        room = [40 - sum(b) for b in bins]
        best = min((r for r in room if r >= n), default=None)
        b, at = fit.put(n)
        if best is None:
            assert b == len(bins) and at == 0
            bins.append([])
        else:
            assert 40 - sum(bins[b]) == best and at == sum(bins[b])
        bins[b].append(n)


def test_lots_cost_little(spark):
    """Many lots, of rows all alike too, need as many sequences as one."""
    rng = random.Random(4)
    for texts in ([" ".join(["a b c"] * rng.randint(1, 20)) for _ in range(3000)], ["a b c d"] * 3000):
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
        count = lambda lot: packing.pack(docs, capacity=64, lot=lot).agg(F.count_distinct("sequence_id"), F.count("*")).first()
        many, one = count(512), count(1 << 20)
        assert many[1] == one[1] and many[0] <= 1.02 * one[0]  # of lots far smaller than usual


def test_packing(spark):
    rows = X.documents()
    got = packing.pack(X.frame(spark, rows), capacity=64, lot=50).collect()
    t = _tokens.tokens(_tokens.default_path())
    want = collections.Counter()
    for i, text in rows:
        ids = t.tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
        for k in range(0, len(ids), 64):
            part = np.array(ids[k : k + 64], "<u4")
            want[i, k // 64, k, len(part), zlib.crc32(part.tobytes())] += 1
    assert collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    by = collections.defaultdict(list)
    for r in got:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 64
    lots = len({s >> 32 for s in by})
    assert len(by) <= math.ceil(sum(r["length"] for r in got) / 64 * 1.05) + lots
    assert packing.pack(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


# ---------------------------------------------------------------------------------------------- token output
@given(st.integers(1, 5000), st.integers(0, 2**63))
@settings(max_examples=40, deadline=None)
def test_permutation(n, key):
    f = tokenout.Feistel(n, key)
    slots = f.slot(np.arange(n))
    assert np.array_equal(np.sort(slots), np.arange(n)) and np.array_equal(f.number(slots), np.arange(n))


def test_ids_that_do_not_fit(spark, monkeypatch):
    """An id of more than 16 bits is an error in narrow records, and comes back whole from wide ones."""
    class Large:
        def encode(self, texts):
            return [np.array([7, 65_535 + len(x)], "<u4").tobytes() for x in texts]

    monkeypatch.setattr(tokenout, "tokens", lambda path: Large())
    docs = spark.createDataFrame([(1, ""), (2, "a")], "doc_id bigint, text string")
    with pytest.raises(Exception, match="id 65536 does not fit"):
        tokenout.materialise(docs, 3, length=4)
    with pytest.raises(ValueError, match="end id 70000 does not fit"):
        tokenout.materialise(docs, 3, length=4, end_id=70_000)
    wide = tokenout.read(tokenout.materialise(docs, 3, length=4, end_id=70_000, wide=True), 4, wide=True).collect()
    assert sorted(r["ids"] for r in wide) == [[7, 65_535, 70_000], [7, 65_536, 70_000]]
    assert tokenout.read(tokenout.materialise(docs.where("doc_id = 1"), 3, length=4), 4).first()["ids"] == [7, 65_535, 0]


def test_token_output(spark, tmp_path):
    rows = X.documents()
    docs = X.frame(spark, rows).repartition(3)
    manifest = tokenout.materialise(docs, 5, f"file://{tmp_path}", length=32, shard=40)
    got = tokenout.read(manifest, 32).collect()
    assert sorted(r["slot"] for r in got) == list(range(len(got)))
    t = _tokens.tokens(_tokens.default_path())
    want = collections.Counter()
    for i, text in rows:
        ids = t.tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
        want.update((i, k // 32, tuple(ids[k : k + 32])) for k in range(0, len(ids), 32))
    assert collections.Counter((r["doc_id"], r["piece"], tuple(r["ids"])) for r in got) == want
    some = tokenout.read(manifest, 32, start=55, stop=90).collect()
    assert {(r["slot"], tuple(r["ids"])) for r in some} == {(r["slot"], tuple(r["ids"])) for r in got if 55 <= r["slot"] < 90}
    for m in manifest.collect():
        data = open(m["path"], "rb").read()
        assert len(data) == m["records"] * m["stride"] and zlib.crc32(data) == m["crc32"] and m["first_slot"] == 40 * m["shard"]
    other = {r["slot"]: (r["doc_id"], r["piece"]) for r in tokenout.read(tokenout.materialise(docs, 6, length=32, shard=40), 32).collect()}
    assert other != {r["slot"]: (r["doc_id"], r["piece"]) for r in got}
    assert tokenout.materialise(spark.createDataFrame([], "doc_id bigint, text string"), 1).count() == 0


# ---------------------------------------------------------------------------------------------- toxicity
def labelled(n, seed):
    rng = random.Random(seed)
    plain = ["".join(rng.choices("abcdefgh", k=rng.randint(3, 7))) for _ in range(300)]
    bad = ["zugzug", "quaxel", "wixzor"]
    rows = []
    for i in range(n):
        sentences = [" ".join(rng.choices(plain, k=rng.randint(4, 12))) for _ in range(rng.randint(1, 8))]
        toxic = int(rng.random() < 0.25)
        if toxic:
            k = rng.randrange(len(sentences))
            sentences[k] += f" {rng.choice(bad)}{rng.choice(['', 'en', 'la'])}, no"
        rows.append((i, ". ".join(sentences), toxic))
    return rows


def test_toxicity_is_learnt_and_located():
    rows = labelled(900, 1)
    train, test = rows[:600], rows[600:]
    m = toxicity.fit([t.encode() for _, t, _ in train], np.array([y for _, _, y in train]))
    scores, per = toxicity.score_texts([t.encode() for _, t, _ in test], m, m.slots())
    assert np.mean((scores >= 0.3) == [y for _, _, y in test]) > 0.97
    right = 0
    for (_, text, y), (a, b, s) in zip(test, per, strict=True):
        if y:
            k = int(np.argmax(s))
            right += any(w in text.encode()[a[k] : b[k]].decode() for w in ("zugzug", "quaxel", "wixzor"))
    assert right / sum(y for _, _, y in test) > 0.95


def test_noisy_or():
    m = toxicity.Model(np.zeros(0, np.uint64), np.zeros(0), -1.0)
    one = 1 / (1 + math.e)
    p, _ = toxicity.score_texts([b"a. b. c", b"", b" .. \n", b"a"], m, m.slots())
    assert np.allclose(p, [1 - (1 - one) ** 3, one, one, one])


def test_slopes_are_the_loss_differentiated():
    rng = np.random.default_rng(0)
    off, labels, z = np.array([0, 1, 4, 9]), np.array([1, 0, 1]), rng.normal(size=9)

    def loss(z):
        out = 0.0
        for y, a, b in zip(labels, off, off[1:], strict=False):
            none = math.prod(1 - 1 / (1 + math.exp(-x)) for x in z[a:b])
            out -= math.log(1 - none) if y else math.log(none)
        return out

    got = toxicity.slopes(z, off, labels)
    for k in range(9):
        step = np.eye(9)[k] * 1e-6
        assert abs((loss(z + step) - loss(z - step)) / 2e-6 - got[k]) < 1e-6


def test_scores_are_sums_over_features():
    """A model with features against a plain form: each word's hashes by themselves, once a sentence."""
    rows = labelled(400, 3)
    m = toxicity.fit([t.encode() for _, t, _ in rows], np.array([y for _, _, y in rows]))
    weight = dict(zip(m.keys.tolist(), m.weights.tolist(), strict=True))
    assert len(weight) > 20
    texts = [t for _, t, _ in rows[:40]] + ["Zugzug! zugzug zugzug. Ärger\nquaxel? ..", "", "ZUGZUG", "."]
    for text, p in zip(texts, toxicity.score_texts([t.encode() for t in texts], m, m.slots())[0], strict=True):
        none, sentences = 1.0, [w for w in ("".join(c if c.isalnum() or ord(c) > 127 else " " for c in x).split() for x in text.replace("\n", ".").replace("!", ".").replace("?", ".").split(".")) if w]
        for words in sentences or [[]]:
            features = {h for w in words for _, h in toxicity._features(toxicity.H.join([w.encode()])[0]) for h in h.ravel().tolist()}
            none *= 1 - 1 / (1 + math.exp(-(m.bias + sum(weight.get(h, 0.0) for h in features))))
        assert abs(p - (1 - none)) < 1e-9


def test_held_out_labels_are_predicted(spark):
    """The area under the curve on the rows that the model may not learn from."""
    folder = DATA.replace("0.001", "0.01")
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    got = [(r["score"], labels[r["doc_id"]]) for r in toxicity.query(spark, folder).where("held_out").collect() if r["doc_id"] in labels]
    bad, good = ([s for s, y in got if y == v] for v in (1, 0))
    assert len(bad) >= 5 and np.mean([(b > g) + 0.5 * (b == g) for b in bad for g in good]) > 0.8


def test_toxicity_scores_rows(spark):
    rows = labelled(300, 2)
    m = toxicity.fit([t.encode() for _, t, _ in rows], np.array([y for _, _, y in rows]))
    texts = [(i, t, 0.5) for i, t, _ in rows[:20]] + [(None, None, None), (5, "", 1.0), (5, "", 1.0), (7, "word " * 50_000 + "zugzug", 0.0)]
    got = toxicity.score(spark.createDataFrame(texts, "doc_id bigint, text string, score double"), m).collect()
    assert len(got) == len(texts) and all(0 <= r["score"] <= 1 for r in got)
    assert next(r for r in got if r["doc_id"] == 7 and len(r["text"]) > 1000)["score"] > 0.5
    assert toxicity.score(spark.createDataFrame([], "doc_id bigint, text string"), m).count() == 0
    for n, y, low, high in ((0, 0, 0.05, 0.3), (1, 1, 0.05, 0.3), (60, 1, 0.9, 1), (60, 0, 0, 0.05)):
        only = toxicity.fit([b"a b"] * n, np.full(n, y))
        assert low < toxicity.score_texts([b"q"], only, only.slots())[0][0] < high


def test_held_out_labels_are_not_seen(spark):
    rows = labelled(200, 3)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id bigint, text string")
    true = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id bigint, toxic int")
    turned = true.withColumn("toxic", F.when(toxicity.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = toxicity.train(docs, true), toxicity.train(docs, turned)
    assert np.array_equal(a.keys, b.keys) and np.array_equal(a.weights, b.weights) and a.bias == b.bias
    assert {r[0] for r in true.where(toxicity.held_out()).select("doc_id").collect()} == {i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 4 == 2}


# ---------------------------------------------------------------------------------------------- decontamination
def test_wand_finds_what_a_full_scan_finds():
    rng = random.Random(0)
    words = [f"w{i}" for i in range(80)]
    items = [(i, " ".join(rng.choices(words, k=rng.randint(5, 30)))) for i in range(70)]
    index = decontam.Index(items, 30)
    for _ in range(60):
        terms = sorted({int(t) for t in index.find(decontam._words([" ".join(rng.choices(words, k=40)).encode()])[0]) if t >= 0})
        score = collections.defaultdict(float)
        for t in terms:
            for d, x in zip(index.items[t], index.weights[t], strict=True):
                score[d] += x
        for threshold in (0.3, 0.5, 0.7):
            got = dict(index.wand(terms, threshold))
            want = {d: s for d, s in score.items() if s >= threshold - 1e-9}
            assert got.keys() == want.keys() and all(abs(got[d] - want[d]) < 1e-9 for d in got)
            if want:
                assert index.may(np.zeros(len(terms), np.int64), np.array(terms), 1, threshold)[0]


def test_altered_items_are_found():
    """Recall and precision of the whole search on test items altered at random places, against the rule applied to every pair."""
    rng = random.Random(3)
    words = [f"w{i}" for i in range(3000)]
    items = [(i, f"{' '.join(rng.choices(words, k=rng.randint(20, 50)))}? {' '.join(rng.choices(words, k=rng.randint(3, 9)))}") for i in range(120)]
    index = decontam.Index(items, 60)
    texts, want = [], set()
    for k in range(400):
        i, t = rng.choice(items)
        w = t.split()
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = rng.choice(words)
        texts.append(" ".join([*rng.choices(words, k=rng.randint(0, 200)), *w, *rng.choices(words, k=rng.randint(0, 200))]).encode())
        own = decontam._words([texts[-1]])[0]
        shares = [np.isin(x, decontam.H.windows(own, np.array([0, len(own)]), n)[0]).mean() for n, x in (index.question[i], index.answer[i])]
        if min(shares) >= decontam.OVERLAP - 1e-9:
            want.add((k, i))
    got = {r[:2] for r in decontam.scan(texts, [index])}
    assert got <= want and len(got) >= 0.99 * len(want) > 100


def test_split():
    assert decontam.split("Who? He. She.") == ("Who? ", "He. She.") and decontam.split("a b\nc") == ("a b\n", "c")
    assert decontam.split("One. Two. Three.") == ("One. Two. ", "Three.") and decontam.split("alone") == ("alone", "")


def test_leaks(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(500)]
    text = lambda k: " ".join(rng.choices(words, k=k))
    items = [(i, f"{text(rng.randint(8, 40))}? {text(rng.randint(1, 12))}") for i in range(40)] + [(100, f"{text(300)}. {text(90)}"), (101, None), (102, " "), (None, text(9)), (103, "solo")]
    long = lambda i: next(t for k, t in items if k == i)
    question_only = long(3).split("?")[0]
    docs = [(1, f"{text(200)} {long(0).upper()} {text(100)}"), (2, text(400)), (3, long(100)), (4, f"{text(300)}\n{long(100)}\n{text(50)}"), (5, None), (6, ""), (7, f"{long(1)} {long(2)}"), (7, long(1)), (8, f"{question_only} {text(90)}"), (None, long(0))]
    w = long(4).split()
    w[2] = "altered"
    docs.append((9, text(64) + " " + " ".join(w) + " " + text(64)))
    got = decontam.leaks(spark.createDataFrame([(*d, 1) for d in docs], "doc_id bigint, text string, item_id int"), spark.createDataFrame(items, "item_id bigint, text string")).collect()
    found = {(r["doc_id"], r["item_id"]) for r in got}
    assert found - {(9, 4)} == {(1, 0), (3, 100), (4, 100), (7, 1), (7, 2), (None, 0)}
    kept = decontam.without_leaks(spark.createDataFrame([(*d, k) for k, d in enumerate(docs)], "doc_id bigint, text string, row int"), spark.createDataFrame(items, "item_id bigint, text string"))
    assert kept.columns == ["doc_id", "text", "row"] and {r["row"] for r in kept.collect()} - {10} == {1, 4, 5, 8}
    assert len(got) == len(found) and all(r["question_overlap"] >= 0.8 and r["answer_overlap"] >= 0.8 for r in got)
    _, q = decontam._shingles(decontam.split(long(4))[0])
    assert ((9, 4) in found) == (1 - 3 / len(q) >= 0.8)
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert decontam.leaks(spark.createDataFrame(docs, "doc_id bigint, text string"), none).count() == 0


# ---------------------------------------------------------------------------------------------- urls
PAGES = "page_id bigint, url string, html string, host string"


def test_urls(spark):
    rows = [(1, "https://a.ORG/x?y", None), (2, "http://example.org/es/1", ""), (3, "http://m.example.org/en/17", ""), (4, "http://example.org/en/2", ""), (5, "http://notexample.org", ""), (6, "x.com/fr/", ""), (7, None, ""), (8, "ftp://q.com/fr/#top", ""), (9, "ftp://q.com?z://y/de/", ""), (9, "http://com/de/a", ""), (None, "http://q.com/de/", ""), (10, "http://é.Com/FR/", "")]
    got = urls.judge(spark.createDataFrame([(*r, "h") for r in rows], PAGES)).collect()
    assert len(got) == len(rows)
    by = {(r["page_id"], r["host"]): (r["path"], r["rule"], r["verdict"]) for r in got}
    assert by[1, "a.org"] == ("/x", "org/", "allow") and by[2, "example.org"][1:] == ("example.org/es/", "block")
    assert by[3, "m.example.org"][1:] == ("example.org/en/1", "block") and by[4, "example.org"][1:] == ("org/", "allow")
    assert by[5, "notexample.org"] == ("", None, "allow") and by[6, ""] == ("", None, "allow") and by[7, ""] == ("", None, "allow")
    assert by[8, "q.com"][:2] == ("/fr/", "com/fr/") and by[9, "q.com"][:2] == ("", None) and by[9, "com"][1:] == ("com/de/", "block")
    assert by[10, "é.com"][:2] == ("/FR/", None)
    assert urls.judge(spark.createDataFrame([], PAGES)).count() == 0


def test_propagation(spark):
    """Against the same rounds on dense matrices."""
    rng = random.Random(2)
    n, hosts = 12, [f"h{i}" for i in range(12)]
    weights = np.zeros((n, n))
    for _ in range(40):
        i, j = rng.sample(range(n), 2)
        weights[i, j] += rng.randint(1, 3)
    edges = spark.createDataFrame([(hosts[i], hosts[j], int(weights[i, j])) for i in range(n) for j in range(n) if weights[i, j]], "src string, dst string, n bigint")
    t0, d0 = np.zeros(n), np.zeros(n)
    t0[:3], d0[9:] = 1 / 3, 1 / 3
    seeds = spark.createDataFrame([(hosts[i], float(t0[i]), float(d0[i])) for i in range(n)], "host string, trust double, distrust double")
    got = {r["host"]: (r["trust"], r["distrust"]) for r in urls.propagate(edges, seeds, rounds=7).collect()}

    def run(w, s):
        out = w.sum(1, keepdims=True)
        share = np.divide(w, out, out=np.zeros_like(w), where=out > 0)
        x = 0.15 * s
        for _ in range(7):
            x = 0.15 * s + 0.85 * share.T @ x
        return x

    t, d = run(weights, t0), run(weights.T, d0)
    for i, h in enumerate(hosts):
        a, b = got.get(h, (0.0, 0.0))
        assert abs(a - t[i]) < 1e-9 and abs(b - d[i]) < 1e-9


def test_propagation_settles(spark):
    """A chain of 14 links to the seed of distrust, a cycle on it and a seed of trust, against a linear solve."""
    hosts = [f"h{i:02}" for i in range(16)]
    weights = np.zeros((16, 16))
    for i in range(14):
        weights[i, i + 1] = 1 + i % 3
    weights[6, 5], weights[15, 3], weights[15, 9] = 2, 1, 4
    edges = spark.createDataFrame([(hosts[i], hosts[j], int(weights[i, j])) for i, j in zip(*np.nonzero(weights))], "src string, dst string, n bigint")
    t0, d0 = np.eye(16)[15], np.eye(16)[14]
    seeds = spark.createDataFrame([(hosts[i], float(t0[i]), float(d0[i])) for i in range(16)], "host string, trust double, distrust double")
    got = {r["host"]: (r["trust"], r["distrust"]) for r in urls.propagate(edges, seeds).collect()}

    def solve(w, s):
        out = w.sum(1, keepdims=True)
        share = np.divide(w, out, out=np.zeros_like(w), where=out > 0)
        return np.linalg.solve(np.eye(16) - 0.85 * share.T, 0.15 * s)

    t, d = solve(weights, t0), solve(weights.T, d0)
    assert d[0] > 0 and t[0] == 0
    for i, h in enumerate(hosts):
        assert abs(got[h][0] - t[i]) <= 1e-7 * t[i] and abs(got[h][1] - d[i]) <= 1e-7 * d[i]


def test_long_way_to_a_blocked_seed(spark):
    rows = [(i, f"http://h{i}.net/", f'<a href="http://h{i + 1}.net/">', "") for i in range(12)] + [(12, "http://h12.net/", '<a href="http://spam.com/de/">', ""), (13, "http://spam.com/de/", "", "")]
    assert {r["verdict"] for r in urls.judge(spark.createDataFrame(rows, PAGES)).collect()} == {"block"}


def test_links_decide(spark):
    def page(i, url, *to):
        return (i, url, "".join(f'<p><A class="x" HREF="{t}">t</a>' for t in to), "")

    rows = [page(1, "http://a.org/", "https://good.net/x", "/own", "//also.net/q"), page(2, "http://spam.com/de/", "http://good.net/"), page(3, "http://bad.net/", "http://spam.com/de/x"), page(4, "http://good.net/"), page(5, "http://also.net/"), page(6, "http://far.net/", "http://bad.net/")]
    got = {r["page_id"]: r["verdict"] for r in urls.judge(spark.createDataFrame(rows, PAGES)).collect()}
    assert got == {1: "allow", 2: "block", 3: "block", 4: "allow", 5: "allow", 6: "block"}


# ---------------------------------------------------------------------------------------------- warc
def test_warc(spark, tmp_path):
    html = ["<p>é</p>", "<p>é</p>", "", None, "WARC/1.1\r\n\r\nWARC-Type: x\r\n\r\n" * 3, "z" * 3_000_000, "<p>é</p>"]
    rows = [(i, f"http://a/{i} b\r\nX: y", h, "extra") for i, h in enumerate(html)] + [(None, None, "<p>é</p>", ""), (6, "u", "<p>é</p>", "")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, digest string").repartition(3)
    got = warc.archive(pages, f"file://{tmp_path}", archive_bytes=100_000).collect()
    assert len(got) == len(rows)
    largest = {}
    for i, _, h, _ in rows:
        if i is not None:
            largest[h or ""] = max(largest.get(h or "", -1), i)
    texts = {i: h or "" for i, _, h, _ in rows if i is not None}
    for r in got:
        if r["page_id"] is None:
            assert r["record_type"] == "revisit" and r["refers_to"] == 6
            continue
        h = texts[r["page_id"]]
        assert r["payload_bytes"] == len(h.encode()) and r["payload_digest"] == base64.b32encode(hashlib.sha1(h.encode()).digest()).decode()
        assert (r["record_type"], r["refers_to"]) == (("response", None) if largest[h] == r["page_id"] else ("revisit", largest[h]))
    members = list(tmp_path.glob("*.members.warc.gz"))
    whole = [p for p in tmp_path.glob("*.warc.gz") if p not in members]
    assert members and sorted(gzip.decompress(p.read_bytes()) for p in members) == sorted(gzip.decompress(p.read_bytes()) for p in whole)
    assert warc.archive(spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0


def test_short_payloads_stay(spark):
    pages = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abc"), (4, "u", "abc")], "page_id bigint, url string, html string")
    got = {r["page_id"]: r["record_type"] for r in warc.roles(pages, least=3).collect()}
    assert got == {1: "response", 2: "response", 3: "revisit", 4: "response"}


def test_inflating_members_in_a_row(tmp_path):
    record = warc.record(1, "u", b"payload", "AA", "response", None)
    path = tmp_path / "two.gz"
    path.write_bytes(gzip.compress(record) + gzip.compress(record))
    with path.open("rb") as f:
        data = warc.Inflated(f)
        for _ in range(2):
            head = data.head()
            body = b"".join(data.take(int(warc.headers(head)["content-length"]) + 4))
            assert body.endswith(b"payload\r\n\r\n")
        assert data.head() is None


# ---------------------------------------------------------------------------------------------- store, pipeline
def test_shared_folder(spark):
    assert _store.shared_dir(spark) == _store.shared_dir(spark)
    df = _store.cut(spark.range(5), "x")
    assert df.count() == 5
    _store.drop(spark, df)
    with pytest.raises(Exception):
        spark.read.parquet(_store.new_path(spark, "none")).count()


def test_pipeline_on_odd_rows(spark):
    import corpus_pipeline as P

    good = "some plain words that are in no other text of this small table at all, nor in the benchmark"
    rows = [(1, good, "en", "s", 9, 0.9, "r"), (2, None, None, None, None, None, None), (3, "", "de", "s", 0, 0.1, "x"), (None, good, "en", "s", 5, 0.2, "y"), (5, good, "en", "s", 7, 0.2, "y"), (5, good, "en", "s", 7, 0.2, "y")]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, row string"
    docs = spark.createDataFrame(rows, schema)
    for name, stage in P.STAGES[:-1]:
        docs = _store.cut(stage(spark, docs, DATA), name)
        assert docs.schema.simpleString() == spark.createDataFrame([], schema).schema.simpleString()
    got = sorted(map(tuple, docs.collect()), key=str)
    assert got == sorted([(*r[:4], len(r[1]) if r[1] is not None else None, *r[5:]) for r in rows[:4]], key=str)
    assert {(r["doc_id"], r["length"]) for r in P.pack(spark, docs, DATA).collect()} >= {(2, 1), (3, 1)}
    none = spark.createDataFrame([], schema)
    for _, stage in P.STAGES:
        assert stage(spark, none, DATA).count() == 0


def test_pipeline(spark):
    """Each stage on what its predecessor kept, against the plain forms of the operators."""
    import corpus_pipeline as P

    assert [n for n, _ in P.STAGES] == ["toxicity", "ngram_jaccard_join", "substring_dedup", "benchmark_decontamination", "best_fit_packing"]
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns = docs.columns
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    for i, (name, stage) in enumerate(P.STAGES[:-1]):
        docs = _store.cut(stage(spark, docs, DATA), name)
        assert docs.columns == columns
        after = {r["doc_id"]: r["text"] for r in docs.collect()}
        assert set(after) <= set(before)
        if i == 0:
            labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
            assert np.mean([labels[d] == (d not in after) for d in labels if d in before]) > 0.9
        elif i == 1:
            sets = {d: X.shingle_set(t, 5) for d, t in before.items()}
            ids = sorted(sets)
            links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
            assert set(after) == {d for d, c in X.components(ids, links).items() if d == c}
        elif i == 2:
            want = X.removed_words(list(before.items()), 13)
            for d, t in before.items():
                n, gone, kept = want[d]
                assert after.get(d) == (t if not gone else kept if gone < n else None)
            assert all(r["n_chars"] == len(r["text"]) for r in docs.collect())
        else:
            items = [(" ".join(r["text"].split())) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
            leaked = {d for d, t in before.items() if any(x in " ".join(t.split()) for x in items)}
            assert leaked == set(before) - set(after)
        before = after
    packed = P.pack(spark, docs, DATA).collect()
    assert {r["doc_id"] for r in packed} == set(before)
