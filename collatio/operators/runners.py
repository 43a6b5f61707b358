"""Running a recogniser over pages: set up once a task, retried calls, one record a page, errors kept as records.

A runner is any object with predict(page) -> dict, or predict_batch(pages) -> list of dicts; setup() and teardown() are called
where it has them. The dict holds what a prediction's fields hold. What is called is outside this library.
"""

from __future__ import annotations

import importlib
import random
import time
from collections.abc import Callable, Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FIELDS = "page_id string, text string, latency_s double, tokens_in bigint, tokens_out bigint, cost_usd double, energy_wh double, error string, created_at string"
ATTEMPTS, LONGEST = 5, 60.0


#: Recognisers by name: the module and the class in it. A module is imported when its recogniser is made, so what it needs stays optional.
REGISTRY: dict[str, tuple[str, str]] = {}


def register(name: str, module: str, attribute: str) -> None:
    REGISTRY[name] = module, attribute


def make(systems: dict[str, dict], system_id: str, params: dict | None = None):
    """The recogniser of a configured system."""
    if system_id not in systems:
        raise KeyError(f"unknown system {system_id!r}; known: {', '.join(systems)}")
    spec = systems[system_id]
    if spec["runner"] not in REGISTRY:
        raise KeyError(f"unknown runner {spec['runner']!r}; known: {', '.join(REGISTRY)}")
    module, attribute = REGISTRY[spec["runner"]]
    return getattr(importlib.import_module(module), attribute)(spec, params)


class Refused(Exception):
    """The recogniser won't read the page; calling again would not help."""


def wait(attempt: int, jitter: float) -> float:
    """Seconds before the next attempt: doubling from two, a minute at most, and a little more by chance."""
    return min(2.0 * 2**attempt, LONGEST) + jitter


def call(f: Callable, *args, attempts: int = ATTEMPTS, sleep: Callable[[float], None] = time.sleep):
    """f's result; other errors than a refusal are tried again after a wait."""
    for k in range(attempts):
        try:
            return f(*args)
        except Refused:
            raise
        except Exception:
            if k == attempts - 1:
                raise
            sleep(wait(k, random.random()))


def run(pages: DataFrame, make: Callable[[], object], batch: int = 8, attempts: int = ATTEMPTS, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """A prediction for each page (page_id and whatever the runner reads). A page that fails is a record with its error."""
    names = [f.split()[0] for f in FIELDS.split(", ")]
    kinds = {"string": pa.string(), "double": pa.float64(), "bigint": pa.int64()}
    schema = pa.schema([(f.split()[0], kinds[f.split()[1]]) for f in FIELDS.split(", ")])

    def one(runner, rows: list[dict]) -> list[dict]:
        began = time.time()
        try:
            if hasattr(runner, "predict_batch"):
                got = call(runner.predict_batch, rows, attempts=attempts, sleep=sleep)
            else:
                got = [call(runner.predict, r, attempts=attempts, sleep=sleep) for r in rows]
        except Exception as e:
            if len(rows) > 1:  # find the page that fails
                return [x for r in rows for x in one(runner, [r])]
            got = [{"text": "", "error": f"{type(e).__name__}: {e}"[:500]}]
        each = (time.time() - began) / len(rows)
        now = datetime.now(timezone.utc).isoformat()
        return [{"latency_s": each, "created_at": now} | g | {"page_id": r["page_id"]} for r, g in zip(rows, got, strict=True)]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runner = make()
        getattr(runner, "setup", lambda: None)()
        try:
            for b in batches:
                rows = b.to_pylist()
                for a in range(0, len(rows), batch):
                    out = one(runner, rows[a : a + batch])
                    yield pa.RecordBatch.from_pylist([{n: x.get(n) for n in names} for x in out], schema=schema)
        finally:
            getattr(runner, "teardown", lambda: None)()

    return pages.mapInArrow(task, FIELDS)


def regroup(lines: DataFrame, page: str = "page_id", idx: str = "line_idx", text: str = "text") -> DataFrame:
    """Pages from recognised lines: texts in order, a line each. The counterpart of exploding pages to lines before a run."""
    own = lines.groupBy(page).agg(F.array_sort(F.collect_list(F.struct(idx, text))).alias("l"))
    return own.select(page, F.array_join(F.col(f"l.{text}"), "\n").alias(text), F.size("l").alias("n_lines"))


def reading_order(boxes: DataFrame, page: str = "page_id", top: str = "y", left: str = "x", text: str = "text") -> DataFrame:
    """Pages from detected lines: from top to bottom, then from left to right."""
    own = boxes.groupBy(page).agg(F.array_sort(F.collect_list(F.struct(F.col(top).alias("y"), F.col(left).alias("x"), F.col(text).alias("t")))).alias("l"))
    return own.select(page, F.array_join(F.col("l.t"), "\n").alias(text))
