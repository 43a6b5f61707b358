"""Substring dedup: Rabin-Karp hashes of every fixed-length token window, counted in Spark."""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _hashing as H
from . import _repeats as R
from ._store import cut, release

WINDOW = 13


def _windows(t: pa.Table, window: int):
    """The chunk's documents in order: texts, first word of each, window hashes, their places and their documents' ids."""
    t = R.in_order(t)
    texts = R.texts(t)
    ids = t["doc_id"].to_numpy(zero_copy_only=False)
    w, first = H.words(texts)
    h, at = H.windows(w, first, window)
    return t, texts, ids, first, h, at


def _marks(docs: DataFrame, window: int, plan: R.Layout, id_col: str, text_col: str) -> DataFrame:
    """For each chunk which of its windows an earlier chunk has. A function of its own, so that nothing holds its shuffles."""

    def emit(t: pa.Table) -> pa.Table:
        chunk = t["chunk"][0].as_py()
        _, _, _, _, h, _ = _windows(t, window)
        return R.blocks(chunk, np.unique(h) if chunk >= 0 else h[:0], plan.buckets)

    base = R.chunked(docs, plan, id_col, text_col)
    return cut(R.answers(base.groupBy("chunk").applyInArrow(emit, R.BLOCK)), "op1-marks")


def remove_repeats(docs: DataFrame, window: int = WINDOW, squeeze: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Remove every word that lies in a window of `window` words which also starts in a document with a smaller id.

    A polynomial rolling hash is taken of every window of every whole text. Each chunk of documents counts its
    own windows; the buckets of the hash range count them across chunks (see `_repeats`), and the windows found in
    an earlier document are merged into maximal removal intervals. Windows are judged on the input, not on what is
    left. Two different windows are taken for equal with probability 2**-64 a pair.

    Returns doc_id, n_words, n_removed, spans (array of [start, stop) word places, maximal), text (the kept words
    joined by one space; without `squeeze` a text that loses nothing stays as it is, null or not) and row (a struct of all other input columns, so names can't clash).
    Null or empty texts have no words and come back empty. Texts of fewer than `window` words lose nothing. Rows with
    the same id don't count against each other: equal is not smaller; each comes back. Rows with a null id are
    neither compared nor changed, only their words are joined. An empty table gives an empty table. A chunk holds its documents whole, so the
    longest text bounds what a task holds.
    """
    plan = R.layout(docs, id_col, text_col)
    marks = _marks(docs, window, plan, id_col, text_col)
    release(docs.sparkSession)
    base = R.chunked(docs, plan, id_col, text_col, carry=True)
    out = T.StructType([
        T.StructField("doc_id", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()),
        T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("stop", T.LongType())]))),
        T.StructField("text", T.StringType()), base.schema["row"],
    ])

    def resolve(t: pa.Table, marks: pa.Table) -> pa.Table:
        if not t.num_rows:
            return pa.table({"doc_id": [], "n_words": [], "n_removed": [], "spans": [], "text": [], "row": []}).slice(0, 0)
        chunk = t["chunk"][0].as_py()
        t, texts, ids, first, h, at = _windows(t, window)
        n = int(first[-1])
        covered = np.zeros(n, bool)
        if chunk >= 0 and len(h):
            u, where, back = np.unique(h, return_index=True, return_inverse=True)
            doc = np.searchsorted(first, at, side="right") - 1
            own = ids[doc]
            later = R.flags(u, marks, plan.buckets, "earlier")[back] | (own > own[where][back])
            step = np.zeros(n + 1, np.int32)
            np.add.at(step, at[later], 1)
            np.add.at(step, at[later] + window, -1)
            covered = np.cumsum(step[:-1]) > 0
        gone = np.concatenate([[0], np.cumsum(covered)])
        removed = gone[first[1:]] - gone[first[:-1]]
        spans, kept, there = [], [], t["text"].is_valid().to_pylist()
        for i, text in enumerate(texts):
            own = text.split()
            if not removed[i]:
                spans.append([])
                kept.append(b" ".join(own) if squeeze else text if there[i] else None)
                continue
            mask = covered[first[i] : first[i + 1]]
            edge = np.diff(mask.view(np.int8), prepend=0, append=0)
            spans.append([{"start": int(a), "stop": int(b)} for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True)])
            kept.append(b" ".join(itertools.compress(own, ~mask)))
        return pa.table({
            "doc_id": t["doc_id"], "n_words": pa.array(np.diff(first), pa.int64()), "n_removed": pa.array(removed, pa.int64()),
            "spans": pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))),
            "text": pa.array(kept, pa.binary()).cast(pa.string()), "row": t["row"],
        })

    return base.groupBy("chunk").cogroup(marks.groupBy("chunk")).applyInArrow(resolve, out)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1: doc_id, n_words, n_removed and the digest of the kept words."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return remove_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


SQL = r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS s
        FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 12)) AS i FROM w WHERE len(ws) >= 13)),
dup AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY s) AS m FROM win) WHERE m < doc_id),
gone AS (SELECT DISTINCT doc_id, i + j AS k FROM dup, (SELECT unnest(generate_series(0, 12)) AS j)),
per AS (SELECT doc_id, list(k) AS ks FROM gone GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(len(ks), 0) AS BIGINT) AS n_removed,
       sha256(array_to_string(CASE WHEN ks IS NULL THEN ws ELSE
         [ws[p] for p in generate_series(1, len(ws)) if NOT list_contains(ks, p)] END, ' ')) AS kept_sha256
FROM w LEFT JOIN per USING (doc_id)
"""
