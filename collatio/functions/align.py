"""The alignment kernels as Arrow-batched Column functions, one call a line or a batch of pages."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import kernels as K
from . import pages

PAGE = ", ".join(f"{c} bigint" for c in K.COUNTS) + ", substituted array<string>"
EDITS = "ins bigint, dele bigint, sub bigint"
LINES = "array<struct<line_idx:int,kind:string,hyp_idx:int,sim:double,ref:string,hyp:string>>"


def _page(ref: pa.Array, hyp: pa.Array, failed: pa.Array) -> pa.Array:
    counts, words = pages.page_counts(ref.to_pylist(), hyp.to_pylist(), failed.to_pylist())
    return pa.StructArray.from_arrays([*map(pa.array, np.ascontiguousarray(counts.T)), pa.array(words, pa.list_(pa.string()))], [*K.COUNTS, "substituted"])


def _edits(ref: pd.Series, hyp: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([K.edit_counts(r or "", h or "") for r, h in zip(ref, hyp, strict=True)], columns=["ins", "dele", "sub"])


def _lines(ref: pd.Series, hyp: pd.Series) -> pd.Series:
    def one(r, h):
        p = K.match_lines(K.split_lines(r), K.split_lines(h))
        return [{"line_idx": i, "kind": p.kind[i], "hyp_idx": p.at[i], "sim": p.sim[i], "ref": p.refs[i], "hyp": p.text[i]} for i in range(len(p.refs))]

    return pd.Series([one(r, h) for r, h in zip(ref, hyp, strict=True)])


def _distances(ref: pd.Series, hyp: pd.Series) -> pd.Series:
    return pd.Series([None if r is None or h is None else K.distance(r, h) for r, h in zip(ref, hyp, strict=True)], dtype="Int64")


def _words(ref: pd.Series, hyp: pd.Series) -> pd.DataFrame:
    rows = []
    for r, h in zip(ref, hyp, strict=True):
        a = (r or "").split()
        rows.append((len(a), 0 if r == h else K.distance(a, (h or "").split())))
    return pd.DataFrame(rows, columns=["n", "edits"])


def char_edits(ref: Column, hyp: Column) -> Column:
    """Insertions, deletions and substitutions, by the kernel: Spark's own distance fills a table for each pair, whatever they have in common."""
    return F.pandas_udf(_distances, "bigint")(ref, hyp)


def word_edits(ref: Column, hyp: Column) -> Column:
    """struct(n, edits): the reference's tokens, and the edits between the tokens of both."""
    return F.pandas_udf(_words, "n bigint, edits bigint")(ref, hyp)


def page_counts(ref: Column, hyp: Column, failed: Column) -> Column:
    """struct of all counts of a page and the keys of its substituted words."""
    return F.arrow_udf(_page, PAGE)(ref, hyp, F.coalesce(failed, F.lit(False)))


def edit_counts(ref: Column, hyp: Column) -> Column:
    """struct(ins, dele, sub); insertions are in the hypothesis alone."""
    return F.pandas_udf(_edits, EDITS)(ref, hyp)


def match_lines(ref: Column, hyp: Column) -> Column:
    """The reference's lines with what was read for each: match, merged, split or missing."""
    return F.pandas_udf(_lines, LINES)(ref, hyp)
