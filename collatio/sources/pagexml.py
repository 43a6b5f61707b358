"""Page layouts in XML: regions in reading order, their lines, polygons and texts."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

POINT = T.StructType([T.StructField("x", T.IntegerType()), T.StructField("y", T.IntegerType())])
LINE = "struct<region:string,line:string,points:string,text:string>"
PAGE = f"struct<image:string,width:int,height:int,creator:string,lines:array<{LINE}>>"


def _local(e: ET.Element) -> str:
    return re.sub(r"^\{.*\}", "", e.tag)


def _children(e: ET.Element, name: str) -> list[ET.Element]:
    return [c for c in e if _local(c) == name]


def _number(s: str | None) -> int | None:
    return int(s) if s and s.isdigit() else None


def _page(xml: bytes | str | None) -> dict | None:
    """A document's page, whatever its namespace; None if there is no page in it."""
    if not xml:
        return None
    root = ET.fromstring(xml)
    page = next((e for e in root.iter() if _local(e) == "Page"), None)
    if page is None:
        return None
    refs = [r for o in _children(page, "ReadingOrder") for r in o.iter() if _local(r) == "RegionRefIndexed" and r.get("regionRef")]
    rank = {r.get("regionRef"): k for k, r in enumerate(sorted(refs, key=lambda r: int(r.get("index", "0"))))}
    regions = sorted((e for e in page if _local(e).endswith("Region")), key=lambda e: rank.get(e.get("id", ""), len(rank)))
    lines = []
    for region in regions:
        for line in _children(region, "TextLine"):
            points = next((c.get("points") for c in _children(line, "Coords")), None)
            texts = _children(line, "TextEquiv")
            text = next((t for t in texts if t.get("index") == "0"), texts[0] if texts else None)
            unicode = next(iter(_children(text, "Unicode")), None) if text is not None else None
            lines.append({"region": region.get("id", ""), "line": line.get("id", ""), "points": points or "", "text": (unicode.text or "") if unicode is not None else ""})
    creator = next((e for m in root.iter() if _local(m) == "Metadata" for e in _children(m, "Creator")), None)
    return {"image": page.get("imageFilename"), "width": _number(page.get("imageWidth")), "height": _number(page.get("imageHeight")), "creator": (creator.text or "").strip() if creator is not None else None, "lines": lines}


def parse(xml: Column) -> Column:
    """struct(image, width, height, creator, lines) of a document; lines in reading order, undeclared regions last."""

    def as_frame(s: pd.Series) -> pd.DataFrame:
        none = {"image": None, "width": None, "height": None, "creator": None, "lines": None}
        return pd.DataFrame([_page(x) or none for x in s], columns=list(none))

    return F.pandas_udf(as_frame, PAGE)(xml)


def points(c: Column) -> Column:
    """array<struct<x,y>> of "x,y x,y": fractions are cut off, malformed pairs skipped."""
    pairs = F.transform(F.split(F.coalesce(c, F.lit("")), r"\s+"), lambda p: F.split(p, ",", 2))
    number = lambda p, i: F.get(p, F.lit(i)).try_cast("double").cast("int")
    made = F.transform(pairs, lambda p: F.struct(number(p, 0).alias("x"), number(p, 1).alias("y")))
    return F.filter(made, lambda p: p["x"].isNotNull() & p["y"].isNotNull())


def box(polygon: Column) -> Column:
    """struct(x0, y0, x1, y1) around a polygon."""
    xs, ys = polygon["x"], polygon["y"]
    return F.struct(F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1"))


def scaled(polygon: Column, fx: Column, fy: Column) -> Column:
    """A polygon in another image's pixels, rounded half to even; with fewer than three points its box."""
    own = F.transform(polygon, lambda p: F.struct(F.bround(p["x"] * fx).cast("int").alias("x"), F.bround(p["y"] * fy).cast("int").alias("y")))
    b = box(own)
    corner = lambda x, y: F.struct(b[x].alias("x"), b[y].alias("y"))
    return F.when(F.size(own) >= 3, own).otherwise(F.array(corner("x0", "y0"), corner("x1", "y0"), corner("x1", "y1"), corner("x0", "y1")))


def lines(pages: DataFrame, xml_col: str = "xml") -> DataFrame:
    """pages' other columns, then line_idx, region, line, polygon and text; lines without a polygon are left out."""
    rest = [F.col(c) for c in pages.columns if c != xml_col]
    got = pages.select(*rest, parse(F.col(xml_col)).alias("p")).select(*rest, F.posexplode("p.lines").alias("line_idx", "l"))
    return got.select(*rest, "line_idx", "l.region", "l.line", points(F.col("l.points")).alias("polygon"), "l.text").where(F.size("polygon") > 0)


def text(pages: DataFrame, key: str, xml_col: str = "xml") -> DataFrame:
    """(key, text): the lines' texts, a line each."""
    got = lines(pages, xml_col).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("line_idx", "text"))).alias("l"))
    return got.select(key, F.array_join(F.col("l.text"), "\n").alias("text"))


def read(spark: SparkSession, folder: str) -> DataFrame:
    """(path, xml) of all layouts under a folder; catalogues of the export are left out."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xml").option("recursiveFileLookup", True).load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    return files.where(~name.isin("mets.xml", "metadata.xml")).select("path", F.decode("content", "UTF-8").alias("xml"))


def page_id(stem: Column, image_stem: Column, known: Column) -> Column:
    """The first of stem, image stem, and both without a leading number, that is among the known ids (an array)."""
    bare = lambda c: F.regexp_replace(c, r"^\d{3,5}_", "")
    options = F.array(stem, image_stem, bare(stem), bare(image_stem))
    return F.get(F.filter(options, lambda x: F.array_contains(known, x)), F.lit(0))


def imported(layouts: DataFrame, known: DataFrame, model_id: str, wall_s: float | None = None, credits_used: float | None = None, pages_run: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Predictions (page_id, text, text_raw, error, latency_s) from a recogniser's export, and how they came about, in one row.

    layouts: path, xml. known: page_id. A page is that of the first layout, by path, whose file or image is named after it; layouts that
    another model wrote last are left out. Seconds and credits are split over the pages that were run, which may be more than are imported.
    """
    stem = lambda c: F.regexp_replace(F.element_at(F.split(c, "[/!]"), -1), "[.][^.]*$", "")
    bare = lambda c: F.regexp_replace(c, r"^\d{3,5}_", "")
    rows = layouts.select("path", parse(F.col("xml")).alias("p")).where("p.lines is not null")
    options = F.array(stem("path"), stem("p.image"), bare(stem("path")), bare(stem("p.image")))
    rows = rows.select("path", "p", F.posexplode(options).alias("nth", "page_id")).join(known.select("page_id").distinct(), "page_id")
    rows = rows.groupBy("path").agg(F.min_by(F.struct("page_id", "p"), "nth").alias("r")).select("path", "r.*")
    drawn = F.filter("p.lines", lambda x: F.size(points(x["points"])) > 0)
    rows = rows.withColumn("text", F.array_join(F.transform(drawn, lambda x: x["text"]), "\n")).withColumn("model", F.nullif(F.regexp_extract(F.coalesce("p.creator", F.lit("")), r"model_id=(\d+)", 1), F.lit("")))
    rows = rows.withColumn("other", F.coalesce(F.col("model") != model_id, F.lit(False)))
    own = rows.where("not other").groupBy("page_id").agg(F.min_by("text", "path").alias("text"))
    n = own.agg(F.count("*").alias("n_pages"))
    run = n.withColumn("pages_run", F.lit(pages_run).cast("long") if pages_run else F.col("n_pages"))
    each = lambda total: F.lit(total).cast("double") / F.nullif(F.col("pages_run"), F.lit(0))
    meta = run.select("n_pages", "pages_run", F.lit(wall_s).cast("double").alias("wall_s_total"), F.lit(credits_used).cast("double").alias("credits_used"), each(credits_used).alias("credits_per_page"), each(wall_s).alias("latency_s"))
    blank = F.regexp_replace("text", r"\s", "") == ""
    made = own.crossJoin(F.broadcast(meta.select("latency_s")))  # one row
    return made.select("page_id", "text", F.col("text").alias("text_raw"), F.when(blank, "empty").alias("error"), "latency_s"), meta.drop("latency_s")
