"""Queries that write with a sink and read back with its source, held against the table they started from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema as C
from ..operators import facts
from ..sources import archives, bundles, pagexml, records
from ..sources.scratch import file_system, new_path, put
from .catalog import query, table

_EVENT = T.StructType([T.StructField(n, t()) for n, t in (("event_id", T.LongType), ("user_id", T.LongType), ("event_type", T.StringType), ("value", T.DoubleType), ("ts", T.StringType))])


@query("jsonl_round_trip", "SELECT event_id, user_id, event_type, value, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts FROM events")
def jsonl_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strict JSON lines, written and then appended to."""
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"))
    records.write_lines(rows.where("event_id % 2 = 0"), path := new_path(spark, "events"))
    records.write_lines(rows.where("event_id % 2 = 1"), path, append=True)
    return records.read_lines(spark, path, _EVENT)


@query("run_folders", "SELECT event_type || '__r0' AS run_id, CAST(user_id AS VARCHAR) AS page_id, value AS latency_s, 'model ' || event_type AS model_id FROM events WHERE event_type <> 'error'")
def run_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder for each type of event as a run's; the errors' has no meta record, so it isn't a run."""
    folder, rows = new_path(spark, "runs"), table(spark, sf_dir, "events")
    for name in sorted(r[0] for r in rows.select("event_type").distinct().collect()):
        made = rows.where(F.col("event_type") == name).select(F.col("user_id").cast("string").alias("page_id"), F.col("value").alias("latency_s"))
        records.write_lines(made, f"{folder}/{name}__r0/predictions.jsonl")
        if name != "error":
            records.write_document(f"{folder}/{name}__r0/meta.json", {"run_id": f"{name}__r0", "system_id": name, "model_id": f"model {name}", "run_idx": 0})
    predictions, metas = records.read_runs(spark, folder, C.PREDICTION, C.RUN_META)
    return predictions.join(metas.select("run_id", "model_id"), "run_id").select("run_id", "page_id", "latency_s", "model_id")


@query("judged_store", "SELECT CAST(doc_id AS VARCHAR) AS page_id, CAST(0 AS INTEGER) AS line_idx, CASE toxic WHEN 1 THEN 'misleading' ELSE 'usable' END AS verdict FROM labels WHERE doc_id IN (SELECT doc_id FROM documents WHERE lang = 'en')")
def judged_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts stored twice, of which the later counts, and of pages that are known."""
    folder = new_path(spark, "judged")
    rows = table(spark, sf_dir, "labels").select(F.lit("s").alias("system_id"), F.col("doc_id").cast("string").alias("page_id"), F.lit(0).alias("line_idx"), F.lit(0).alias("pass_idx"), F.when(F.col("toxic") == 1, "misleading").otherwise("usable").alias("verdict"))
    # the order of records is that of the files, so both are one file's, the earlier ones first
    both = rows.withColumn("verdict", F.lit("needs_correction")).withColumn("n", F.lit(0)).unionByName(rows.withColumn("n", F.lit(1)))
    records.write_lines(both.coalesce(1).sortWithinPartitions("n").drop("n"), f"{folder}/s.jsonl")
    known = table(spark, sf_dir, "documents").where("lang = 'en'").select(F.col("doc_id").cast("string").alias("page_id"))
    return records.read_judged(spark, folder, known).select("page_id", "line_idx", "verdict")


@query("csv_round_trip", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    records.write_table(rows, path := new_path(spark, "nation"), ["n_name"])
    return archives.read_table(spark, path, rows.schema)


@query("yaml_dimension", "SELECT * FROM (VALUES ('a', 'Alpha', 'lineup'), ('b', NULL, 'extra')) AS s(system_id, label, role)")
def yaml_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Configured records as a dimension."""
    put(path := f"{new_path(spark, 'config')}/systems.yaml", b"systems:\n- {system_id: a, label: Alpha, role: lineup}\n- {system_id: b, role: extra}\n")
    return archives.as_table(spark, archives.read_yaml(spark, path)["systems"], C.SYSTEM).select("system_id", "label", "role")


@query("json_document", "SELECT n_regionkey, n_name FROM nation")
def json_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "nation").select("n_regionkey", "n_name")
    records.write_document(path := f"{new_path(spark, 'document')}/nations.json", [r.asDict() for r in rows.collect()])
    return spark.read.schema(rows.schema).option("multiLine", True).json(path)


@query("prompt_files", "SELECT 'item-' || item_id AS prompt_id, text AS prompt, sha256(text) AS sha256 FROM benchmark")
def prompt_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_path(spark, "prompts")
    records.write_files(table(spark, sf_dir, "benchmark").select(F.concat(F.lit("item-"), "item_id", F.lit(".txt")).alias("name"), F.col("text").alias("content")), folder)
    return records.read_prompts(spark, folder)


@query("zip_round_trip", "SELECT 'source-' || page_id % 5 || '.zip' AS archive, page_id || '.html' AS name, sha256(coalesce(html, '')) AS sha256 FROM pages")
def zip_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_path(spark, "zips")
    made = table(spark, sf_dir, "pages").select(F.concat(F.lit("source-"), F.col("page_id") % 5, F.lit(".zip")).alias("archive"), F.concat("page_id", F.lit(".html")).alias("name"), F.coalesce("html", F.lit("")).alias("content"))
    archives.write(made, folder)
    got = archives.members(spark, folder)
    return got.select(F.element_at(F.split("archive", "/"), -1).alias("archive"), "name", F.sha2("content", 256).alias("sha256"))


@query("release_pack", "SELECT n_name || '.txt' AS name, sha256(n_name) AS sha256, CAST(strlen(n_name) AS BIGINT) AS length, true AS listed FROM nation")
def release_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files packed with their checksums, which the archive's own list repeats."""
    folder, out = new_path(spark, "release"), new_path(spark, "packed")
    records.write_files(table(spark, sf_dir, "nation").select(F.concat("n_name", F.lit(".txt")).alias("name"), F.col("n_name").alias("content")), folder)
    rows = archives.pack(spark, folder, out, "release.zip")
    sums = archives.members(spark, out, "SHA256SUMS").select(F.explode(F.split(F.decode("content", "UTF-8"), "\n")).alias("line")).where("line <> ''")
    listed = sums.select(F.substring("line", 1, 64).alias("sha256"), F.expr("substring(line, 67)").alias("name"), F.lit(True).alias("listed"))
    return rows.join(listed, ["name", "sha256"], "left").select("name", "sha256", "length", F.coalesce("listed", F.lit(False)).alias("listed"))


@query("bundle_tasks", "SELECT page_id, 'images/' || page_id || '.jpg' AS image, 'p1' AS prompt_id, 'Read it, ÄÖ.' AS prompt, 'm1' AS model FROM (SELECT CAST(item_id AS VARCHAR) AS page_id FROM benchmark) ORDER BY page_id LIMIT 15")
def bundle_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tasks of a bundle of the first fifteen pages, from its archive."""
    pages = table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("page_id"))
    folder = new_path(spark, "bundle")
    bundles.export(bundles.tasks(pages, "p1", "Read it, ÄÖ.", "m1", limit=15), {"system_id": "s", "model_id": "m1"}, folder)
    return archives.records(spark, folder, "tasks.jsonl", C.BUNDLE_TASK).drop("archive")


@query("bundle_results", "SELECT 's__r0' AS run_id, CAST(item_id AS VARCHAR) AS page_id, text, CAST(item_id + 0.5 AS DOUBLE) AS latency_s FROM benchmark WHERE text IS NOT NULL")
def bundle_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a bundle brings back, as records of its run."""
    folder = new_path(spark, "back")
    rows = table(spark, sf_dir, "benchmark").where("text is not null").select(F.col("item_id").cast("string").alias("page_id"), "text", (F.col("item_id") + 0.5).cast("double").alias("latency_s"))
    lines = rows.select(F.to_json(F.struct("*")).alias("j")).agg(F.array_join(F.collect_list("j"), "\n").alias("c"))  # a bundle fits one machine
    texts = spark.createDataFrame([("bundle_meta.json", '{"bundle": "s__r0", "system_id": "s", "run_idx": 0}'), ("run_info.json", '{"gpu": "A10"}')], "name string, content string")
    files = texts.unionByName(lines.select(F.lit("predictions.jsonl").alias("name"), F.col("c").alias("content")))
    archives.write(files.select(F.lit("s__r0.zip").alias("archive"), "name", "content"), folder)
    return bundles.returned(spark, folder)[0].select("run_id", "page_id", "text", "latency_s")


def _layout(text: Column, creator: Column) -> Column:
    line = lambda name, t: F.concat(F.lit(f'<TextLine id="{name}"><Coords points="1,2 30,2 30,40"/><TextEquiv index="0"><Unicode>'), F.regexp_replace(t, "[<&]", ""), F.lit("</Unicode></TextEquiv></TextLine>"))
    blank = F.lit('<TextLine id="l0"><TextEquiv><Unicode>without a polygon</Unicode></TextEquiv></TextLine>')
    return F.concat(F.lit('<PcGts xmlns="urn:page"><Metadata><Creator>'), creator, F.lit('</Creator></Metadata><Page imageFilename="x.jpg" imageWidth="100" imageHeight="200"><TextRegion id="a">'), blank, line("l1", text), line("l2", F.concat(F.lit("second "), text)), F.lit("</TextRegion></Page></PcGts>"))


_XML = "regexp_replace(text, '[<&]', '', 'g')"


@query("layouts_imported", f"SELECT CAST(item_id AS VARCHAR) AS page_id, {_XML} || chr(10) || 'second ' || {_XML} AS text, 30.0 / 1000 AS latency_s, 5.0 / 1000 AS credits_per_page FROM benchmark WHERE item_id % 3 <> 0")
def layouts_imported(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page layouts written to a folder and imported; every third was last written by another model."""
    folder = new_path(spark, "layouts")
    rows = table(spark, sf_dir, "benchmark")
    creator = F.when(F.col("item_id") % 3 == 0, "prov:model_id=7:x").otherwise("prov:model_id=42:x")
    records.write_files(rows.select(F.concat(F.lit("0001_"), "item_id", F.lit(".xml")).alias("name"), _layout(F.col("text"), creator).alias("content")), folder)
    known = rows.select(F.col("item_id").cast("string").alias("page_id"))
    got, meta = pagexml.imported(pagexml.read(spark, folder), known, "42", wall_s=30.0, credits_used=5.0, pages_run=1000)
    return got.crossJoin(F.broadcast(meta.select("credits_per_page"))).select("page_id", "text", "latency_s", "credits_per_page")


@query("checksums_verified", "SELECT n_name || '.txt' AS name, CASE WHEN n_nationkey % 2 = 0 THEN 'altered' ELSE 'missing' END AS problem FROM nation WHERE n_nationkey < 6")
def checksums_verified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of six nations' files some were altered after they were listed, and some deleted."""
    folder, rows = new_path(spark, "listed"), table(spark, sf_dir, "nation").select("n_nationkey", F.concat("n_name", F.lit(".txt")).alias("name"), F.col("n_name").alias("content"))
    records.write_files(rows, folder)
    listed = spark.createDataFrame(records.checksums(spark, folder).collect(), "path string, sha256 string, length bigint")
    records.write_files(rows.where("n_nationkey < 6 and n_nationkey % 2 = 0").withColumn("content", F.lit("other")), folder)
    for r in rows.where("n_nationkey < 6 and n_nationkey % 2 = 1").select("name").collect():
        fs, at = file_system(f"{folder}/{r['name']}")
        fs.delete_file(at)
    return records.verify(listed, records.checksums(spark, folder)).select(F.element_at(F.split("path", "/"), -1).alias("name"), "problem")


@query("orphaned_keys", "SELECT DISTINCT user_id AS c_custkey FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey < 12)")
def orphaned_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cross-check of keys: users that a dimension lacks."""
    return facts.orphans(table(spark, sf_dir, "events").select(F.col("user_id").alias("c_custkey")), table(spark, sf_dir, "customer").where("c_nationkey < 12"), "c_custkey")
