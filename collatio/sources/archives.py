"""Zip archives and configuration files as tables."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
import yaml
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import put


def write(files: DataFrame, folder: str) -> DataFrame:
    """Zip files (archive, name, content) into one archive for each `archive`, members by name; returns (archive, members, length).

    An archive is made by one task, so its members must fit one. It is there whole or not at all.
    """

    def run(t: pa.Table) -> pa.Table:
        t, out = t.sort_by("name"), io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for name, content in zip(t["name"].to_pylist(), t["content"].to_pylist(), strict=True):
                z.writestr(zipfile.ZipInfo(name), content, zipfile.ZIP_DEFLATED)
        archive = t["archive"][0].as_py()
        put(f"{folder}/{archive}", out.getvalue())
        return pa.table({"archive": [archive], "members": [t.num_rows], "length": [out.tell()]})

    rows = files.select("archive", "name", F.col("content").cast("binary").alias("content")).groupBy("archive").applyInArrow(run, "archive string, members bigint, length bigint").collect()
    return files.sparkSession.createDataFrame(rows, "archive string, members bigint, length bigint")


def pack(spark: SparkSession, folder: str, out: str, archive: str) -> DataFrame:
    """A release: every file under a folder and SHA256SUMS, their checksums by name, in one archive; returns (name, sha256, length)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    name = F.replace(F.regexp_replace("path", "^[a-z]+:/+", "/"), F.lit("/" + folder.split(":")[-1].strip("/") + "/"), F.lit(""))
    rows = files.select(name.alias("name"), "content", F.sha2("content", 256).alias("sha256"), "length")
    listed = F.array_join(F.array_sort(F.collect_list(F.concat("name", F.lit("\t"), "sha256"))), "\n")
    sums = rows.agg(F.concat(F.regexp_replace(listed, r"([^\t\n]*)\t([0-9a-f]+)", "$2  $1"), F.lit("\n")).alias("c")).select(F.lit("SHA256SUMS").alias("name"), F.encode("c", "UTF-8").alias("content"))
    write(rows.select("name", "content").unionByName(sums).withColumn("archive", F.lit(archive)), out)
    return rows.drop("content")


def members(spark: SparkSession, pattern: str, suffix: str = "") -> DataFrame:
    """(archive, name, content) of the members of all zip files under a path, by name; a file is read by one task."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").option("recursiveFileLookup", True).load(pattern).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for name in sorted(n for n in z.namelist() if n.endswith(suffix) and not n.endswith("/")):
                        yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([name]), pa.array([z.read(name)], pa.binary())], ["archive", "name", "content"])

    return files.mapInArrow(run, "archive string, name string, content binary")


def layouts(spark: SparkSession, pattern: str) -> DataFrame:
    """(path, xml) of the page layouts in zip files; catalogues of the export are left out."""
    rows = members(spark, pattern, ".xml")
    base = F.element_at(F.split("name", "/"), -1)
    return rows.where(~base.isin("mets.xml", "metadata.xml")).select(F.concat("archive", F.lit("!"), "name").alias("path"), F.decode("content", "UTF-8").alias("xml"))


def records(spark: SparkSession, pattern: str, name: str, schema: T.StructType) -> DataFrame:
    """The JSON lines of one member of each archive."""
    rows = members(spark, pattern, name).select("archive", F.explode(F.split(F.decode("content", "UTF-8"), "\n")).alias("line")).where("trim(line) <> ''")
    return rows.select("archive", F.from_json("line", schema, {"mode": "FAILFAST"}).alias("r")).select("archive", "r.*")


def read_yaml(spark: SparkSession, path: str) -> dict:
    """A configuration file; an empty one is an empty mapping. Read through Spark, so any store will do."""
    rows = spark.read.text(path, wholetext=True).collect()
    return (yaml.safe_load(rows[0][0]) if rows else None) or {}


def as_table(spark: SparkSession, rows: list[dict], schema: T.StructType) -> DataFrame:
    """Configured records (systems, prices) as a dimension; a field that the schema lacks is an error."""
    known = {f.name for f in schema}
    for r in rows:
        if extra := set(r) - known:
            raise ValueError(f"unknown fields: {', '.join(sorted(extra))}")
    return spark.createDataFrame([{n: r.get(n) for n in known} for r in rows], schema)


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """A result table in CSV; its types are inferred where no schema is given."""
    reader = spark.read.option("header", True)
    return (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)


def model_of(creator: Column) -> Column:
    """The number of the model that last wrote a layout; null if it names none."""
    return F.nullif(F.regexp_extract(creator, r"model_id=(\d+)", 1), F.lit(""))
