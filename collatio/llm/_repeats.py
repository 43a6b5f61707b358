"""Which hashes repeat, across chunks of documents: the exchange under the operators on repeated passages.

Documents are dealt to chunks by ranges of doc_id, so that every document of a chunk comes before
every document of the next. Each chunk reduces its hashes to a sorted distinct list (this
pre-aggregation bounds what a hot passage can send: one entry a chunk, however many documents hold
it), cuts the list into ranges of the hash ("buckets") and sends each as a delta-coded block. A
bucket's task merges the blocks of all chunks, counts each hash and answers every block with one bit
an entry. The chunk that gets the bits back knows everything else itself. So the exchange costs some
five to six bytes for each distinct hash of a chunk and a bit for its way back, and neither a hot
passage nor a hot document gathers in one task.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import width

BLOCK = "bucket int, chunk int, block binary"
MARKS = "chunk int, bucket int, other binary, earlier binary"
#: Points of the quantile sketch that chunk borders are interpolated between; bounds its size.
POINTS = 128
#: Bytes of text to a chunk at most, on average: a chunk is what a task holds, with some ten times as much of temporaries for a part of it.
CHUNK_BYTES = 64 << 20


@dataclass
class Layout:
    """How documents are dealt: quantiles of their ids, and how many chunks and buckets there are."""

    knots: list[int]
    chunks: int
    buckets: int


def layout(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Layout:
    """Two chunks and a bucket for each shuffle partition of the session, more where a chunk would pass CHUNK_BYTES of text.

    A sketch of quantiles depends on the order in which tasks end, so it is taken once and handed to every `chunked`.
    """
    points = F.percentile_approx(F.col(id_col).cast("long"), [i / POINTS for i in range(POINTS + 1)], 10_000)
    got = docs.agg(points.alias("q"), F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0)).alias("size")).first()
    out = sorted(set(got["q"] or [0]))
    least = -(-got["size"] // CHUNK_BYTES)
    n = width(docs.sparkSession)
    return Layout([*out, out[-1] + 1], max(2 * n, least), max(n, -(-least // 2)))


def chunked(docs: DataFrame, plan: Layout, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """docs as (chunk, doc_id, text[, row]), dealt by chunk; row holds the other columns in a struct.

    The chunk is a monotone function of doc_id: between two knots it is interpolated, so chunks are even, by rows, where ids are spread
    evenly between quantiles, and the same knots give the same chunks. Rows of one id are one chunk's. Rows with a null doc_id, which are compared
    with nothing, go in turn to the chunks below 0.
    """
    knots, chunks, n = plan.knots, plan.chunks, len(plan.knots) - 1
    lo, x = F.array(*map(F.lit, knots)), F.col(id_col)
    place = F.greatest(F.lit(0), F.least(F.lit(n - 1), F.size(F.filter(lo, lambda b: b <= x)) - 1))
    a, b = F.element_at(lo, place + 1), F.element_at(lo, place + 2)
    within = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (x - a).cast("double") / (b - a).cast("double")))
    chunk = F.least(F.lit(chunks - 1), F.floor((place + within) * F.lit(chunks / n)).cast("int"))
    other = -1 - (F.monotonically_increasing_id() % chunks).cast("int")
    cols = [F.when(x.isNull(), other).otherwise(chunk).cast("int").alias("chunk"), x.cast("long").alias("doc_id"), F.col(text_col).alias("text")]
    if carry:
        rest = [F.col(f"`{c}`") for c in docs.columns if c not in (id_col, text_col)]
        cols.append((F.struct(*rest) if rest else F.struct(F.lit(None).cast("int").alias("none"))).alias("row"))
    return docs.select(*cols).repartition(max(width(docs.sparkSession), -(-chunks // 2)), "chunk")


def encode(u: np.ndarray) -> bytes:
    """Sorted hashes as differences, one plane a byte: the high planes are nearly constant and compress away."""
    d = np.diff(u, prepend=np.uint64(0))
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(d.view(np.uint8).reshape(-1, 8).T).tobytes())


def decode(block: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(block), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def borders(u: np.ndarray, buckets: int) -> np.ndarray:
    """Where each of the buckets' ranges starts in the sorted hashes u, and the end."""
    low = np.array([((b << 32) // buckets + ((b << 32) % buckets > 0)) << 32 for b in range(1, buckets)], np.uint64)
    return np.concatenate([[0], np.searchsorted(u, low), [len(u)]]).astype(np.int64)


def blocks(chunk: int, u: np.ndarray, buckets: int) -> pa.Table:
    at = borders(u, buckets)
    full = [b for b in range(buckets) if at[b + 1] > at[b]]
    return pa.table({"bucket": pa.array(full, pa.int32()), "chunk": pa.array([chunk] * len(full), pa.int32()), "block": pa.array([encode(u[at[b] : at[b + 1]]) for b in full], pa.binary())})


def answers(sent: DataFrame) -> DataFrame:
    """For each block the bits of its entries that repeat: in any other chunk, and in a chunk with a smaller number."""

    def mark(t: pa.Table) -> pa.Table:
        t = t.sort_by("chunk")
        parts = [decode(x.as_py()) for x in t["block"]]
        every = np.concatenate(parts)
        order = np.argsort(every, kind="stable")
        s = every[order]
        same = s[1:] == s[:-1]
        earlier = np.zeros(len(s), bool)
        earlier[order[1:]] = same
        other = earlier.copy()
        other[order[:-1]] |= same
        rows, a = [], 0
        for chunk, p in zip(t["chunk"].to_pylist(), parts, strict=True):
            own = slice(a, a + len(p))
            a += len(p)
            if other[own].any():
                rows.append((chunk, np.packbits(other[own]).tobytes(), np.packbits(earlier[own]).tobytes()))
        bucket = t["bucket"][0].as_py()
        return pa.table({"chunk": pa.array([r[0] for r in rows], pa.int32()), "bucket": pa.array([bucket] * len(rows), pa.int32()), "other": pa.array([r[1] for r in rows], pa.binary()), "earlier": pa.array([r[2] for r in rows], pa.binary())})

    return sent.groupBy("bucket").applyInArrow(mark, MARKS)


LEVELS = "chunk int, bucket int, levels binary"


def levels(sent: DataFrame) -> DataFrame:
    """For each block and entry in how many chunks it occurs, by the logarithm: 0 for one, 1 for two, 2 for up to four, and so on."""

    def mark(t: pa.Table) -> pa.Table:
        parts = [decode(x.as_py()) for x in t["block"]]
        every = np.concatenate(parts)
        order = np.argsort(every, kind="stable")
        at = np.flatnonzero(np.concatenate([[True], every[order[1:]] != every[order[:-1]]]))
        n = np.diff(np.append(at, len(every)))
        level = np.zeros(len(every), np.uint8)
        level[order] = np.repeat(np.ceil(np.log2(n)).astype(np.uint8), n)
        rows, a = [], 0
        pack = zstandard.ZstdCompressor(level=1)
        for chunk, p in zip(t["chunk"].to_pylist(), parts, strict=True):
            own = level[a : a + len(p)]
            a += len(p)
            if own.any():
                rows.append((chunk, pack.compress(own.tobytes())))
        bucket = t["bucket"][0].as_py()
        return pa.table({"chunk": pa.array([r[0] for r in rows], pa.int32()), "bucket": pa.array([bucket] * len(rows), pa.int32()), "levels": pa.array([r[1] for r in rows], pa.binary())})

    return sent.groupBy("bucket").applyInArrow(mark, LEVELS)


def levels_of(u: np.ndarray, marks: pa.Table, buckets: int) -> np.ndarray:
    """The levels of all buckets, put together again for the chunk's sorted hashes u."""
    out = np.zeros(len(u), np.uint8)
    at = borders(u, buckets)
    for b, packed in zip(marks["bucket"].to_pylist(), marks["levels"].to_pylist(), strict=True):
        out[at[b] : at[b + 1]] = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8)
    return out


def flags(u: np.ndarray, marks: pa.Table, buckets: int, which: str) -> np.ndarray:
    """The bits `which` (other or earlier) of all buckets, put together again for the chunk's sorted hashes u."""
    out = np.zeros(len(u), bool)
    at = borders(u, buckets)
    for b, bits in zip(marks["bucket"].to_pylist(), marks[which].to_pylist(), strict=True):
        n = int(at[b + 1] - at[b])
        out[at[b] : at[b + 1]] = np.unpackbits(np.frombuffer(bits, np.uint8), count=n).view(bool)
    return out


def texts(t: pa.Table) -> list[bytes]:
    """The texts as UTF-8 bytes; null is empty."""
    return [x.as_buffer().to_pybytes() if x.is_valid else b"" for x in t["text"].combine_chunks()] if t.num_rows else []


def in_order(t: pa.Table) -> pa.Table:
    """A chunk's documents by doc_id, nulls last."""
    return t.sort_by([("doc_id", "ascending")])

