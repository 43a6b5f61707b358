"""Tables, sinks and sources on small rows."""

import pytest
from pyspark.sql import functions as F

from collatio.operators import bootstrap, facts, runners, tables
from collatio.sources import archives, pagexml, records, scratch


def test_numbers_without_a_window(spark):
    rows = spark.range(500).select((F.col("id") % 3 == 0).alias("k"), (F.col("id") * 7919 % 1009).alias("o"))
    got = facts.numbered(rows.repartition(7), ["k"], [F.col("o").desc()], "i").collect()
    for key in (True, False):
        own = sorted((r["i"], r["o"]) for r in got if r["k"] == key)
        assert [i for i, _ in own] == list(range(len(own))) and [o for _, o in own] == sorted((o for _, o in own), reverse=True)
    assert facts.numbered(rows.limit(0), ["k"], [F.col("o")], "i").count() == 0


def test_counted_draws_are_the_draws(spark):
    n, a, b = 30, 7919, 104729
    rows = [("s", i * 3, float(i % 5), 1.0 + i % 4) for i in range(n)]
    got = bootstrap.indexed(spark.createDataFrame(rows, "k string, o int, x double, y double"), ["k"], "x", "y", "o", 12).first()
    rates = []
    for r in range(12):
        drawn = [rows[(r * a + i * b + r * i) % n] for i in range(n)]
        rates.append(sum(d[2] for d in drawn) / sum(d[3] for d in drawn))
    rates.sort()
    at = 0.025 * 11
    assert abs(got["lo"] - (rates[0] + at * (rates[1] - rates[0]))) < 1e-12


def test_systems_without_scores_or_answers(spark):
    systems = spark.createDataFrame([("a", "api", "api"), ("b", "cpu", "cpu_local"), ("c", "cpu", "cpu_local"), ("d", "transkribus", "x")], "system_id string, hardware_class string, hardware string")
    rates = spark.createDataFrame([(s, None, 0.5) for s in "abd"], "system_id string, corpus string, numeral_f1 double")
    predictions = spark.createDataFrame([("a__r0", "a", 1, 2.0, 0.5, None, None), ("a__r1", "a", 1, 9.0, 9.0, None, None), ("b__r0", "b", 1, 2.0, None, None, "bad"), ("c__r0", "c", 1, 2.0, None, None, None), ("d__r0", "d", 1, 10.0, None, None, None), ("d__r0", "d", 9, 99.0, None, None, None)],
                                        "run_id string, system_id string, page_id int, latency_s double, cost_usd double, energy_wh double, error string")
    rows = tables.answered(predictions, spark.createDataFrame([(1, "x")], "page_id int, corpus string"))
    out = tables.summary(systems, rates, rows, spark.createDataFrame([("d", 2.0)], "system_id string, credits_per_page double"), spark.createDataFrame([("a", 0.1)], "system_id string, misleading double"))
    got = {r["system_id"]: (r["integrity"], r["s_per_page"], r["price_basis"]) for r in out.collect()}
    assert got == {"a": (0.7, 2.0, "list price"), "d": (0.5, 10.0, "credits")}
    assert [r[0] for r in tables.repeats(predictions).collect()] == ["a__r1"]


def test_registry():
    runners.register("fraction", "types", "MappingProxyType")
    with pytest.raises(TypeError):  # it is looked up and called
        runners.make({"s": {"runner": "fraction"}}, "s")
    with pytest.raises(KeyError, match="known: s"):
        runners.make({"s": {"runner": "fraction"}}, "t")
    with pytest.raises(KeyError, match="unknown runner"):
        runners.make({"s": {"runner": "none"}}, "s")


def test_sinks(spark, tmp_path):
    records.write_document(f"{tmp_path}/a/d.json", {"ä": [1]})
    assert (tmp_path / "a/d.json").read_text() == '{\n  "ä": [\n    1\n  ]\n}\n' and len(list((tmp_path / "a").iterdir())) == 1
    files = spark.createDataFrame([("x.zip", "b/2", b"two"), ("x.zip", "1", b""), ("y.zip", "z", b"\x00")], "archive string, name string, content binary")
    assert {(r[0], r[1]) for r in archives.write(files, f"{tmp_path}/z").collect()} == {("x.zip", 2), ("y.zip", 1)}
    assert [r["name"] for r in archives.members(spark, f"{tmp_path}/z/x.zip").collect()] == ["1", "b/2"]


def test_layouts_of_other_models_and_pages(spark):
    page = lambda creator, text: f'<PcGts><Metadata><Creator>{creator}</Creator></Metadata><Page imageFilename="i.jpg"><TextRegion id="a"><TextLine id="l"><Coords points="1,1 2,2"/><TextEquiv><Unicode>{text}</Unicode></TextEquiv></TextLine></TextRegion></Page></PcGts>'
    rows = [("e/0001_p.xml", page("x:model_id=7", "old")), ("e/0002_p.xml", page("x:model_id=42", "new")), ("e/0003_p.xml", page("", "late")), ("e/q.xml", page("none", " ")), ("e/u.xml", page("none", "unknown"))]
    known = spark.createDataFrame([("p",), ("q",)], "page_id string")
    got, meta = pagexml.imported(spark.createDataFrame(rows, "path string, xml string"), known, "42", wall_s=8.0, credits_used=None, pages_run=4)
    assert {tuple(r) for r in got.collect()} == {("p", "new", "new", None, 2.0), ("q", " ", " ", "empty", 2.0)}
    assert meta.first().asDict() == {"n_pages": 2, "pages_run": 4, "wall_s_total": 8.0, "credits_used": None, "credits_per_page": None}


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    class Context:
        applicationId, master = "x", "spark://host:7077"

        def getConf(self):
            return {}

    class Session:
        class conf:
            get = staticmethod(lambda *a: None)

        sparkContext = Context()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch.shared_dir(Session())
