import subprocess
import sys

import __spark_entry__ as registry
from collatio.plans import catalog


def test_names():
    queries, sql = registry.queries(), registry.oracle_sql()
    assert set(sql) <= set(queries) and set(catalog.QUERIES) <= set(queries)
    assert all(callable(f) for f in queries.values())


def test_without_the_subpackage(tmp_path):
    """The registry imports where the llm folder and the pipeline are gone."""
    code = """
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name == "corpus_pipeline" or name.startswith("collatio.llm"):
            raise ModuleNotFoundError(name=name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as r
assert r.llm is None and "char_rate_by_system" in r.queries() and not any(n.startswith("op") for n in r.queries())
"""
    subprocess.run([sys.executable, "-c", code], check=True, cwd=registry.__file__.rpartition("/")[0])


def test_entry(spark):
    assert registry.entry(spark).count() == 12


def test_streams(spark):
    for name in ("stream_last_success", "stream_hourly_load"):
        assert registry.queries()[name](spark, registry.ENTRY_DIR).count() > 0
    a = registry.queries()["stream_last_success"](spark, registry.ENTRY_DIR)
    b = registry.queries()["last_success"](spark, registry.ENTRY_DIR)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.select(a.columns).collect()))
