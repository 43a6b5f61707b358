import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from collatio import schema as C
from collatio.functions import rates as R
from collatio.functions import text as T
from collatio.operators import bootstrap, facts, judging, profile, runners
from collatio.plans.catalog import QUERIES
from collatio.sources import archives, bundles, pagexml, records


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def lit(x):
    return F.lit(x).cast("double")


def test_facets(spark):
    for x, want in ((1, 1), (10, 0.5), (100, 0), (0.2, 1), (500, 0), (None, None), (float("nan"), None), (0, None)):
        got = value(spark, R.log_facet(lit(x), 1, 100))
        assert got == want or abs(got - want) < 1e-12
    assert value(spark, R.mean_present(lit(1), lit(None))) == 1 and value(spark, R.mean_present(lit(None))) is None
    assert value(spark, R.f1(F.lit(0), F.lit(0), F.lit(0))) is None and value(spark, R.f1(F.lit(0), F.lit(3), F.lit(0))) == 0
    assert value(spark, R.ratio(F.lit(1), F.lit(0))) is None


@pytest.mark.parametrize("x,d,want", [(0.125, 2, "0.12"), (0.5, 0, "0"), (2.675, 2, "2.67"), (1.5, 0, "2")])
def test_printed(spark, x, d, want):
    assert value(spark, R.printed(lit(x), d)) == want


def test_efficiency(spark):
    api = profile.efficiency(lit(10), F.lit("api"), lit(0.01))
    assert abs(value(spark, api) - (0.5 * 0.5 + 0.25 * 0.1 + 0.25 * 2 / 3)) < 1e-12
    assert abs(value(spark, profile.efficiency(lit(10), F.lit("gpu_8gb"), lit(None))) - (0.5 * 0.5 + 0.25 * 0.8) / 0.75) < 1e-12
    with pytest.raises(Exception, match="no hardware class"):
        value(spark, profile.hardware_score(F.lit("abacus")))


def test_cost_basis(spark):
    def basis(hc, hw, usd=None, credits=None, wh=None, s=None):
        return value(spark, profile.cost_basis(F.lit(hc), F.lit(hw), lit(usd), lit(credits), lit(wh), lit(s))).asDict()

    assert basis("api", "api", usd=0.006)["usd_per_page"] == 0.006
    assert abs(basis("transkribus", "cloud", credits=1)["usd_per_page"] - 0.25704) < 1e-12
    assert basis("gpu_24gb", "modal_a100", wh=1.08) == {"usd_per_page": None, "wh_per_page": 1.08, "wh_basis": "measured (GPU board power)"}
    assert basis("cpu", "cpu_local", s=3600)["wh_per_page"] == 35
    assert basis("gpu_8gb", "other", s=10)["wh_per_page"] is None


def test_last_success(spark):
    log = [("p", 1, "e1"), ("p", 2, None), ("p", 3, "e3"), ("q", 4, "e4"), ("q", 5, "e5"), ("r", 6, None), ("r", 7, None)]
    df = spark.createDataFrame(log, "page string, seq int, error string")
    got = {r["page"]: r["seq"] for r in facts.last_success(df, ["page"], "seq", F.col("error").isNotNull()).collect()}
    assert got == {"p": 2, "q": 4, "r": 7}
    manifest = spark.createDataFrame([("p",), ("q",), ("s",)], "page string")
    error = F.col("error").isNotNull()
    assert {r[0] for r in facts.todo(manifest, df, "page", error).collect()} == {"q", "s"}
    assert {r[0] for r in facts.todo(manifest, df, "page", error, retry_errors=False).collect()} == {"s"}
    assert facts.unknown(df, manifest, "page").count() == 2


def test_budget(spark):
    df = spark.createDataFrame([("a", i, 10.0) for i in range(6)], "run string, seq int, cost double")
    assert facts.within_budget(df, "run", "seq", "cost", 25, batch=1).count() == 3
    assert facts.within_budget(df, "run", "seq", "cost", 25, batch=2).count() == 4


def test_score_and_profile(spark):
    pages = spark.createDataFrame([("1", "abp", "Der Wald\nden 25. Mai"), ("2", "forst", "ein Baum steht")], "page_id string, corpus string, gt_text string")
    said = [("s__r0", "s", "1", "Der Wald\nden 25. Mai", None), ("s__r0", "s", "2", "x" * 500, None), ("s__r0", "s", "9", "?", None), ("t__r0", "t", "1", "Der Wild\nden 25. Mai", None), ("t__r0", "t", "2", "", "down")]
    preds = spark.createDataFrame(said, "run_id string, system_id string, page_id string, text string, error string")
    vocab = facts.vocabulary(spark.createDataFrame([("Wild und Wald",)], "text string"))
    rows = facts.score(pages, preds, vocab).cache()
    by = {(r["system_id"], r["page_id"]): r for r in rows.collect()}
    assert len(by) == 4 and by["t", "2"]["error"] and by["t", "2"]["dele"] == by["t", "2"]["n_ref_chars"]
    assert (by["t", "1"]["n_sub_words"], by["t", "1"]["real_word_sub"]) == (1, 1)
    out = {(r["system_id"], r["corpus"]): r for r in profile.text_scores(rows, [["system_id"], ["system_id", "corpus"]]).collect()}
    assert out["s", "abp"]["char_accuracy"] == 1 and out["s", "forst"]["char_accuracy"] == 0
    whole = out["s", None]
    n1, n2 = by["s", "1"]["n_ref_chars"], by["s", "2"]["n_ref_chars"]
    assert abs(whole["cer_page"] - n2 / (n1 + n2)) < 1e-12 and whole["n_pages"] == 2


def test_registered_bootstraps(spark, tmp_path):
    """The queries draw 1000 resamples: brute force on a small table."""
    rows = [(i // 3, "AN"[i % 2], float(1 + i * 7 % 11), (i * 5 % 9) / 100) for i in range(150)]
    lines = spark.createDataFrame(rows, "l_orderkey bigint, l_returnflag string, l_quantity double, l_discount double")
    lines.write.parquet(f"{tmp_path}/lineitem.parquet")
    got = {r["system"]: r for r in QUERIES["bootstrap_interval"](spark, str(tmp_path)).collect()}
    loose = {r["l_returnflag"]: r for r in QUERIES["bootstrap_poisson"](spark, str(tmp_path)).collect()}
    hashes = {(r[0], r[1]): r[2] for r in spark.range(50).crossJoin(spark.range(1000).selectExpr("cast(id as int) as rep")).selectExpr("id", "rep", "pmod(xxhash64(id, rep), 9007199254740992) / 9007199254740992D").collect()}
    steps = np.cumsum([np.exp(-1.0) / math.factorial(k) for k in range(10)])
    for s in "AN":
        pages = sorted({r[0] for r in rows if r[1] == s})
        x, y = (np.array([sum(f(r) for r in rows if r[0] == p and r[1] == s) for p in pages]) for f in (lambda r: r[2] * r[3], lambda r: r[2]))
        idx = np.random.default_rng(0).integers(0, len(x), (1000, len(x)))
        assert np.allclose([got[s]["rate"], got[s]["lo"], got[s]["hi"]], [x.sum() / y.sum(), *np.percentile(x[idx].sum(1) / y[idx].sum(1), [2.5, 97.5])], atol=1e-12)
        times = np.array([[np.sum(hashes[p, k] >= steps) for p in pages] for k in range(1000)])
        assert np.allclose([loose[s]["lo"], loose[s]["hi"]], np.percentile((times @ x) / (times @ y), [2.5, 97.5]), atol=1e-9)


def test_profile_intervals(spark):
    """At both grains the intervals of 1000 resamples of capped edits, drawn all at once here."""
    rng = np.random.default_rng(5)
    zeros = {k: 0 for k in ("punct_kept", "n_punct_ref", "caps_lowered", "n_caps_read", "num_kept", "n_num_ref", "n_num_hyp", "n_lines_matched", "n_lines_ref", "real_word_sub", "n_sub_words", "glyph_kept", "n_glyph_ref", "n_glyph_hyp")}
    pages = [{"page_id": i, "system": "st"[i % 2], "corpus": ("abp", "forst", None)[i % 3], "error": False, "ins": int(rng.integers(0, 9)), "dele": int(rng.integers(0, 90)), "sub": 1, "n_ref_chars": int(rng.integers(0, 60)), "word_edits": int(rng.integers(0, 12)), "n_ref_words": 9} | zeros for i in range(83)]
    pages += [pages[0] | {"page_id": 83, "system": "one", "n_ref_chars": 40, "dele": 10}]
    facts_of = spark.createDataFrame(pages, ", ".join(f"{k} {'string' if k in ('system', 'corpus') else 'boolean' if k == 'error' else 'bigint'}" for k in pages[0])).repartition(3)
    got = profile.text_scores(facts_of, [["system"], ["system", "corpus"]]).collect()
    assert len(got) == 8 + 2
    for r in got:
        same = [p for p in pages if p["system"] == r["system"] and p["corpus"] == r["corpus"]]
        own = [p for p in pages if p["system"] == r["system"]] if r["n_pages"] != len(same) else same
        assert r["n_pages"] == len(own)
        for name, x, y in (("cer", [min(p["ins"] + p["dele"] + p["sub"], p["n_ref_chars"]) for p in own], [p["n_ref_chars"] for p in own]), ("wer", [min(p["word_edits"], 9) for p in own], [9] * len(own))):
            x, y = np.array(x, float), np.array(y, float)
            idx = np.random.default_rng(0).integers(0, len(x), (1000, len(x)))
            want = np.percentile(x[idx].sum(1) / y[idx].sum(1), [2.5, 97.5])
            assert np.allclose([r[f"{name}_page_lo"], r[f"{name}_page_hi"]], want, atol=1e-12) and abs(r[f"{name}_page"] - x.sum() / y.sum()) < 1e-12


def test_draws_some_at_a_time(spark):
    """A group too large to be drawn at once has the same draws."""
    n = 3001
    assert n * bootstrap.RESAMPLES > bootstrap.DRAWS
    got = bootstrap.interval(spark.range(n).selectExpr("'s' as system", "id", "cast(id % 7 as double) as num", "3.0D + id % 4 as den"), ["system"], "num", "den", "id").first()
    x, y, idx = np.arange(n) % 7.0, 3.0 + np.arange(n) % 4, np.random.default_rng(0).integers(0, n, (1000, n))
    assert np.allclose([got["lo"], got["hi"]], np.percentile(x[idx].sum(1) / y[idx].sum(1), [2.5, 97.5]), atol=1e-12)


def test_blocks(spark, monkeypatch):
    """A group of more than a block's rows is dealt to tasks: all draws are made, and the interval is that of drawing from all rows."""
    monkeypatch.setattr(bootstrap, "BLOCK", 100)
    falls = np.array([bootstrap._falls(1030, b, 400, 0, 100) for b in range(11)])
    assert (falls.sum(0) == 1030).all() and abs(falls[:10].mean() - 100) < 2 and abs(falls[10].mean() - 30) < 2
    df = spark.range(1030).selectExpr("if(id < 1000, 's', null) as k", "id", "cast(id % 7 as double) as num", "3.0D + id % 4 as den")
    got = {r["k"]: r for r in bootstrap.interval(df, ["k"], "num", "den", "id").collect()}
    assert set(got) == {None, "s"}
    monkeypatch.setattr(bootstrap, "BLOCK", 1 << 19)
    whole = {r["k"]: r for r in bootstrap.interval(df, ["k"], "num", "den", "id").collect()}
    for k, r in whole.items():
        assert abs(got[k]["rate"] - r["rate"]) < 1e-12 and abs(got[k]["lo"] - r["lo"]) < 0.01 and abs(got[k]["hi"] - r["hi"]) < 0.01


def test_kappa(spark):
    def k(a, b):
        df = spark.createDataFrame(list(zip(a, b, strict=True)), "a string, b string")
        return judging.kappa(df, [], "a", "b").first()["kappa"]

    assert k("abab", "abab") == 1 and k("abab", "aabb") == 0 and k("aaa", "aaa") == 1


def test_parse(spark):
    raw = '```json\n{"spans":[{"type":"Number","severity":5,"ref_span":"1"},{"type":"odd","severity":"x"}],"verdict":"Misleading.","note":"n"}\n```'
    got = value(spark, judging.parse(F.lit(raw)))
    assert got["verdict"] == "misleading" and [(s["type"], s["severity"]) for s in got["spans"]] == [("number_error", 2), ("garble", 0)]
    assert value(spark, judging.parse(F.lit('[{"type":"name"}]')))["verdict"] == "needs_correction"


def test_judge_table(spark):
    spans = [("", "", "number_error", 2)]
    rows = [("s", "p", 0, 0, "a b c", "", "misleading", "", spans), ("s", "p", 1, 0, "d e f", "", "usable", "", []), ("s", "p", 2, 0, "g h i", "", "usable", "", []), ("s", "p", 0, 1, "a b c", "", "misleading", "", []), ("s", "p", 1, 1, "d e f", "", "misleading", "", [])]
    got = judging.table(spark.createDataFrame(rows, C.JUDGED)).first()
    assert got["n_lines"] == 3 and got["n_ref_words"] == 9 and abs(got["number_error_per_100w"] - 100 / 9) < 1e-9
    assert abs(got["share_misleading"] - 1 / 3) < 1e-9 and abs(got["share_misleading_both_passes"] - 3 / 5) < 1e-9


def test_sample(spark):
    rows = [(s, c, f"{c}{i}") for s in "xy" for c in "ab" for i in range(5) if not (s == "y" and i > 2)]
    got = judging.sample(spark.createDataFrame(rows, "system string, corpus string, line string"), "corpus", "system", ["line"], 4, F.col("line")).collect()
    picked = {s: [r["line"] for r in sorted(got, key=lambda r: r["place"]) if r["system"] == s] for s in "xy"}
    assert picked["x"] == picked["y"] == ["a0", "b0", "a1", "b1"]


def test_candidates(spark):
    gt = "one two three\nab cd\nfour five six\nnothing like it was here\nseven eight nine"
    pages = spark.createDataFrame([("p", "c", gt, True), ("q", "c", gt, False), ("r", "c", gt, True)], "page_id string, corpus string, gt_text string, judge_sample boolean")
    said = "one two tree\nab xd\nfour five six\nseven eight nina"
    runs = [("s__r0", "s", "p", said, None), ("s__r0", "s", "q", said, None), ("s__r0", "s", "r", "", None), ("t__r0", "t", "p", said, "down"), ("t__r1", "t", "r", said, None), ("u__r0", "u", "r", said, "")]
    got = judging.candidates(pages, spark.createDataFrame(runs, "run_id string, system_id string, page_id string, text string, error string")).collect()
    lines = [(0, "one two three", "one two tree", "", "ab cd"), (4, "seven eight nine", "seven eight nina", "nothing like it was here", "")]
    assert sorted(map(tuple, got)) == [("s", "c", "p", *x) for x in lines] + [("u", "c", "r", *x) for x in lines]


def test_integrity_coverage_years(spark):
    scores = spark.createDataFrame([("s", None, 0.5, 9), ("s", "a", 0.25, 4), ("t", None, 0.75, 5), ("t", "a", 0.5, 3)], "system_id string, corpus string, numeral_f1 double, n_pages bigint")
    got = profile.with_integrity(scores, spark.createDataFrame([("s", 0.1)], "system_id string, misleading double")).collect()
    assert {(r["system_id"], r["corpus"]): round(r["integrity"], 9) for r in got} == {("s", None): 0.7, ("s", "a"): 0.25, ("t", None): 0.75, ("t", "a"): 0.5}
    assert [tuple(r)[:2] for r in profile.full_coverage(scores, spark.createDataFrame([("a", 4)], "corpus string, n_pages bigint")).select("system_id", "corpus").collect()] == [("s", "a")]
    found = profile.years(spark.createDataFrame([("a", 1801), ("a", 1850), ("a", 0), ("a", None), ("b", None), ("c", 1700)], "corpus string, year int"))
    assert sorted(map(tuple, found.collect())) == [("a", 1801, 1850), ("c", 1700, 1700)]
    claims = spark.createDataFrame([("a", 1801, 1850), ("b", 1, 2), ("c", 1701, 1800)], "corpus string, from int, to int")
    assert {r["corpus"]: r["ok"] for r in profile.check_years(claims, found).collect()} == {"a": True, "b": True, "c": False}


def test_bootstrap(spark):
    rows = [("s", i, float(i % 3), 5.0) for i in range(40)] + [("one", 0, 1.0, 4.0), ("none", 0, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "system string, page int, num double, den double")
    got = {r["system"]: r for r in bootstrap.interval(df, ["system"], "num", "den", "page").collect()}
    x, idx = np.array([i % 3 for i in range(40)], float), np.random.default_rng(0).integers(0, 40, (1000, 40))
    want = np.percentile(x[idx].sum(1) / 200, [2.5, 97.5])
    assert np.allclose([got["s"]["lo"], got["s"]["hi"]], want) and abs(got["s"]["rate"] - x.sum() / 200) < 1e-12
    assert got["one"]["lo"] == got["one"]["hi"] == 0.25 and got["none"]["rate"] is None
    p = {r["system"]: r for r in bootstrap.poisson(df, ["system"], "num", "den", "page", n=400).collect()}["s"]
    assert p["lo"] < p["rate"] < p["hi"] and abs(p["lo"] - want[0]) < 0.03 and abs(p["hi"] - want[1]) < 0.03


def test_claims(spark):
    claims = spark.createDataFrame([("a", 0.12, 2), ("b", 0.5, 1), ("c", 1.0, 0)], "k string, printed double, decimals int")
    metrics = spark.createDataFrame([("a", 0.1249), ("b", 0.61)], "k string, value double")
    assert {r["k"]: r["ok"] for r in profile.check_claims(claims, metrics, ["k"]).collect()} == {"a": True, "b": False, "c": False}
    assert value(spark, profile.cents(lit(0.0005))) == "<0.1" and value(spark, profile.cents(lit(0.25704))) == "26"


XML = """<?xml version="1.0"?><PcGts xmlns="http://example.org/page"><Metadata><Creator> me </Creator></Metadata><Page imageFilename="x.jpg" imageWidth="1000" imageHeight="2000">
<ReadingOrder><OrderedGroup><RegionRefIndexed index="1" regionRef="m"/><RegionRefIndexed index="0" regionRef="l"/></OrderedGroup></ReadingOrder>
<TextRegion id="m"><TextLine id="m1"><Coords points="1,1 2.9,2 bad 3,4"/><TextEquiv index="1"><Unicode>no</Unicode></TextEquiv><TextEquiv index="0"><Unicode>Concl.</Unicode></TextEquiv></TextLine></TextRegion>
<TextRegion id="l"><TextLine id="l1"><Coords points="0,0 1,1"/><TextEquiv><Unicode>erste Zeile</Unicode></TextEquiv></TextLine><TextLine id="l2"><Coords points="5,5"/></TextLine><TextLine id="l3"/></TextRegion></Page></PcGts>"""


def test_pagexml(spark):
    df = spark.createDataFrame([(1, XML.encode().decode().replace('<?xml version="1.0"?>', ""))], "id int, xml string")
    rows = pagexml.lines(df).orderBy("line_idx").collect()
    assert [r["line"] for r in rows] == ["l1", "l2", "m1"]
    assert [(p["x"], p["y"]) for p in rows[2]["polygon"]] == [(1, 1), (2, 2), (3, 4)]
    assert pagexml.text(df, "id").first()["text"] == "erste Zeile\n\nConcl."
    got = df.select(pagexml.parse(F.col("xml")).alias("p")).first()["p"]
    assert (got["image"], got["width"], got["creator"]) == ("x.jpg", 1000, "me")
    known = F.array(F.lit("page7"))
    assert value(spark, pagexml.page_id(F.lit("0007_page7"), F.lit("other"), known)) == "page7"


def test_records(spark, tmp_path):
    path = tmp_path / "a.jsonl"
    path.write_text('{"page_id":"1","text":"x"}\n\n{"page_id":"2","error":"e"}\n')
    got = records.read_lines(spark, str(path), C.BUNDLE_PREDICTION).orderBy("page_id").collect()
    assert [(r["page_id"], r["error"]) for r in got] == [("1", None), ("2", "e")]
    assert records.read_lines(spark, str(tmp_path / "none.jsonl"), C.BUNDLE_PREDICTION).count() == 0
    path.write_text('{"page_id":"1","what":"x"}\n')
    with pytest.raises(Exception, match="not a record"):
        records.read_lines(spark, str(path), C.BUNDLE_PREDICTION).collect()
    files = records.checksums(spark, str(tmp_path))
    listed = files.select("path", "sha256").unionByName(spark.createDataFrame([("gone", "0")], "path string, sha256 string"))
    assert [r["problem"] for r in records.verify(listed, files).collect()] == ["missing"]
    assert bundles.run_id("s") == "s__r0" and not math.isnan(1.0)


class Upper:
    """Fails once on each page, always on "bad", and refuses "no"."""

    def setup(self):
        self.seen = set()

    def predict(self, page):
        if page["page_id"] == "no":
            raise runners.Refused("won't")
        if page["page_id"] == "bad" or page["page_id"] not in self.seen:
            self.seen.add(page["page_id"])
            raise OSError("down")
        return {"text": page["image"].upper(), "tokens_in": 3}


def test_runner(spark):
    pages = spark.createDataFrame([("1", "a"), ("bad", "b"), ("no", "c"), ("2", "d")], "page_id string, image string").coalesce(1)
    got = {r["page_id"]: r for r in runners.run(pages, Upper, attempts=3, sleep=lambda s: None).collect()}
    assert got["1"]["text"] == "A" and got["2"]["text"] == "D" and got["1"]["error"] is None and got["1"]["tokens_in"] == 3
    assert got["bad"]["error"] == "OSError: down" and got["no"]["error"].startswith("Refused")
    assert [runners.wait(k, 0) for k in range(7)] == [2, 4, 8, 16, 32, 60, 60]
    lines = spark.createDataFrame([("p", 1, "b"), ("p", 0, "a")], "page_id string, line_idx int, text string")
    assert runners.regroup(lines).first()["text"] == "a\nb"
    boxes = spark.createDataFrame([("p", 5, 9, "c"), ("p", 5, 2, "b"), ("p", 1, 50, "a")], "page_id string, y int, x int, text string")
    assert runners.reading_order(boxes).first()["text"] == "a\nb\nc"


def test_archives(spark, tmp_path):
    import zipfile

    with zipfile.ZipFile(tmp_path / "r.zip", "w") as z:
        z.writestr("predictions.jsonl", '{"page_id":"1","text":"x"}\n\n{"page_id":"2"}\n')
        z.writestr("page/0001.xml", XML)
        z.writestr("page/mets.xml", "<x/>")
    assert sorted(r["page_id"] for r in archives.records(spark, str(tmp_path), "predictions.jsonl", C.BUNDLE_PREDICTION).collect()) == ["1", "2"]
    xml = archives.layouts(spark, str(tmp_path))
    assert xml.count() == 1 and pagexml.lines(xml.withColumn("xml", F.regexp_replace("xml", r"<\?xml.*?\?>", ""))).count() == 3
    (tmp_path / "c.yaml").write_text("models:\n- {model_id: m, usd_per_m_in: 1.5}\n")
    prices = archives.as_table(spark, archives.read_yaml(spark, str(tmp_path / "c.yaml"))["models"], C.PRICE)
    assert prices.first()["usd_per_m_in"] == 1.5
    with pytest.raises(ValueError):
        archives.as_table(spark, [{"what": 1}], C.PRICE)
    systems = spark.createDataFrame([("s", "m"), ("t", "gone"), ("u", None)], "system_id string, price_key string")
    assert [r[0] for r in facts.orphans(systems, prices, "price_key", "model_id").collect()] == ["gone"]
    assert value(spark, archives.model_of(F.lit("x model_id=123 y"))) == "123" and value(spark, archives.model_of(F.lit("x"))) is None
    records.write_table(systems, str(tmp_path / "t"), ["system_id"])
    assert archives.read_table(spark, str(tmp_path / "t")).count() == 3
    records.write_lines(systems, str(tmp_path / "l"))
    records.write_lines(systems, str(tmp_path / "l"), append=True)
    assert spark.read.json(str(tmp_path / "l")).count() == 6


def test_replies_are_read_once(spark):
    """The plan names the JSON once, whatever is taken from it, and a slug is made once, not for each alias."""
    plan = spark.range(1).select(judging.parse(F.col("id").cast("string")).alias("p"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") == 1 and plan.count("translate(") <= 1


def test_failed_pages(spark):
    texts = ["", " \n\t", "| --- |\n|", "***\n- - -", " ", None, "a", "- - a", "*", "**", ":", "_ \n.", "--", "̈"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", facts.failed(F.col("t"), F.lit(None)).alias("f"), (T.normalize(F.col("t"), "L0") == "").alias("want")).collect()
    assert [r.f for r in rows] == [r.want for r in rows] == [True] * 6 + [False] * 6 + [True, False]


def test_words_read_for_others_are_not_grouped_before_they_are_looked_up(spark, monkeypatch):
    """A repeated word counts each time, and the words of all pages aren't shuffled by page and word to be told so."""
    pages = spark.createDataFrame([("p", "c", "ein Hans und ein Hans am Herz"), ("q", "c", "gut")], "page_id string, corpus string, gt_text string")
    said = spark.createDataFrame([("r", "s", "p", "ein haus und ein haus am xx", None), ("r", "s", "q", "gut", None)], "run_id string, system_id string, page_id string, text string, error string")
    out = facts.score(pages, said, spark.createDataFrame([("haus",), ("gut",)], "word string"))
    assert {r.page_id: (r.n_sub_words, r.real_word_sub) for r in out.collect()} == {"p": (3, 2), "q": (0, 0)}
    groups = [line for line in out._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Aggregate" in line]
    assert groups and not [g for g in groups if "page_id" in g.split("]")[0] and "word" in g.split("]")[0]]
    kept = []
    monkeypatch.setattr(facts, "cut", lambda df, name, real=facts.cut: kept.append(df.columns) or real(df, name))
    assert {r.real_word_sub for r in facts.score(pages, said).collect()} == {None} and "substituted" not in kept[0]
