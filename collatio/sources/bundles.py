"""Bundles: tasks handed to another machine, and the results that come back."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema as C
from . import archives
from .records import read_lines


def tasks(pages: DataFrame, prompt_id: str, prompt: str, model: str, limit: int | None = None) -> DataFrame:
    """A task for each page: (page_id, image, prompt_id, prompt, model), by page_id; `limit` pages if asked for."""
    out = pages.select("page_id", F.concat(F.lit("images/"), "page_id", F.lit(".jpg")).alias("image"), F.lit(prompt_id).alias("prompt_id"), F.lit(prompt).alias("prompt"), F.lit(model).alias("model"))
    return out.orderBy("page_id").limit(limit) if limit is not None else out


def export(made: DataFrame, system: dict, folder: str, idx: int = 0, images: DataFrame | None = None, version: str = "", created_at: str = "") -> DataFrame:
    """A bundle for another machine as one zip: tasks.jsonl, bundle_meta.json, and images (page_id, content) where there are some.

    made: `tasks`. A bundle is what one machine works through, so its tasks fit the driver. Returns what `archives.write` does.
    """
    spark, name = made.sparkSession, run_id(system["system_id"], idx)
    rows = made.orderBy("page_id").toJSON().collect()
    first = json.loads(rows[0]) if rows else {}
    meta = {
        "bundle": name, "system_id": system["system_id"], "model_id": system.get("model_id"), "run_idx": idx, "prompt_id": first.get("prompt_id"),
        "prompt_sha256": hashlib.sha256(first.get("prompt", "").encode()).hexdigest(), "harness_version": version, "created_at": created_at, "n_pages": len(rows),
    }
    texts = [("tasks.jsonl", "".join(f"{r}\n" for r in rows)), ("bundle_meta.json", json.dumps(meta, ensure_ascii=False, indent=2))]
    files = spark.createDataFrame([(n, bytearray(t.encode())) for n, t in texts], "name string, content binary")
    if images is not None:
        files = files.unionByName(images.select(F.concat(F.lit("images/"), "page_id", F.lit(".jpg")).alias("name"), "content"))
    return archives.write(files.withColumn("archive", F.lit(f"{name}.zip")), folder)


def returned(spark: SparkSession, pattern: str) -> tuple[DataFrame, DataFrame]:
    """What came back in zip files: predictions with the run_id that the bundle's meta names, and run information, null where it is missing."""
    meta = archives.members(spark, pattern, "bundle_meta.json").select("archive", F.from_json(F.decode("content", "UTF-8"), "bundle string, system_id string, run_idx int").alias("m"))
    info = archives.members(spark, pattern, "run_info.json").select("archive", F.from_json(F.decode("content", "UTF-8"), C.BUNDLE_RUN, {"mode": "FAILFAST"}).alias("i"))
    runs = meta.join(info, "archive", "left").select("archive", F.col("m.bundle").alias("run_id"), "m.system_id", "m.run_idx", "i.*")
    rows = archives.records(spark, pattern, "predictions.jsonl", C.BUNDLE_PREDICTION)
    return rows.join(runs.select("archive", "run_id"), "archive").drop("archive"), runs.drop("archive")


def results(spark: SparkSession, folder: str, run_id: str) -> DataFrame:
    """The predictions of a result folder as records of a run."""
    rows = read_lines(spark, f"{folder}/predictions.jsonl", C.BUNDLE_PREDICTION)
    return rows.select(F.lit(run_id).alias("run_id"), "*", F.monotonically_increasing_id().alias("seq"))


def in_manifest_order(rows: DataFrame, manifest: DataFrame, order: str) -> DataFrame:
    """Results of known pages, sorted as the manifest is."""
    return rows.join(manifest.select("page_id", order), "page_id").orderBy(order)


def run_id(system: str, idx: int = 0) -> str:
    return f"{system}__r{idx}"
