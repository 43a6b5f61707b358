"""Best-fit packing: best-fit decreasing with a segment tree over the remaining capacities."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._store import cut, drop, spread
from ._tokens import default_path, tokens

CAPACITY = 2048
#: Pieces that are packed together in one task, and the share of them, from its emptiest sequences, that is packed again with that of other lots.
LOT, AGAIN = 1 << 17, 0.25

PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
NUMBERED = f"{PIECES}, part int, number bigint"


class BestFit:
    """Open bins by their remaining capacity, under a segment tree whose nodes tell whether a capacity below them is in use."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.size = 1 << capacity.bit_length()
        self.used = [0] * (2 * self.size)
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.fill: list[int] = []

    def _count(self, room: int, step: int) -> None:
        at = room + self.size
        while at:
            self.used[at] += step
            at >>= 1

    def _tightest(self, need: int) -> int:
        """The least remaining capacity of an open bin that is at least `need`; -1 if none."""
        at, used = need + self.size, self.used
        if used[at]:
            return need
        while at > 1 and (at & 1 or not used[at + 1]):  # until a right neighbour has an open bin
            at >>= 1
        if at <= 1:
            return -1
        at += 1
        while at < self.size:
            at <<= 1
            if not used[at]:
                at += 1
        return at - self.size

    def put(self, length: int) -> tuple[int, int]:
        """The bin that `length` goes to and its place there; a new bin if none has room."""
        room = self._tightest(length)
        if room < 0:
            b, room = len(self.fill), self.capacity
            self.fill.append(0)
        else:
            b = self.bins[room].pop()
            self._count(room, -1)
        at = self.fill[b]
        self.fill[b] += length
        self.bins[room - length].append(b)
        self._count(room - length, 1)
        return b, at


def pieces(docs: DataFrame, tokenizer_path: str | None = None, capacity: int = CAPACITY, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document's ids, ended by end_id, in pieces of at most `capacity`: doc_id, piece, start, length, ids_crc32.

    A null text is an empty one, and has the end id alone. Every row of docs gives its own pieces, numbered within their task (part, number).
    A text is encoded whole, so the longest one bounds what a task holds. Columns of docs other than the two named, whatever their
    names, are ignored.
    """
    path = tokenizer_path or default_path()
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, own, first = tokens(path), TaskContext.get().partitionId(), 0
        for whole in batches:
            for a in range(0, whole.num_rows, 512):
                b = whole.slice(a, 512)
                rows: list[tuple] = []
                texts = [x.as_buffer().to_pybytes() if x.is_valid else b"" for x in b.column("text")]
                for doc, ids in zip(b.column("doc_id").to_pylist(), t.encode(texts), strict=True):
                    ids += end
                    for k, x in enumerate(range(0, len(ids), 4 * capacity)):
                        part = ids[x : x + 4 * capacity]
                        rows.append((doc, k, x // 4, len(part) // 4, zlib.crc32(part), own, first + len(rows)))
                first += len(rows)
                cols = list(zip(*rows, strict=True))
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32", "part", "number"])

    return spread(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))).mapInArrow(run, NUMBERED)


def pack(docs: DataFrame, tokenizer_path: str | None = None, capacity: int = CAPACITY, end_id: int = 0, lot: int = LOT, again: float = AGAIN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pieces of all documents with sequence_id and offset: sequences of at most `capacity` ids, gapless from 0.

    Pieces are dealt by a hash of their number to lots of about `lot`, and each lot is packed by best-fit decreasing: the longest first,
    ties by doc_id and piece, each into the fullest sequence that has room. Best fit leaves at most one sequence of a lot less than half full,
    so what lots cost together lies in the emptiest sequences of each: those that aren't full, with a share of at most `again` of the lot's
    pieces, are dealt and packed again with those of the other lots, round by round, until they fit one lot. A lot is at least eight times `capacity`, so that it has sequences to leave. Only lengths are shuffled, there are as many lots as the input needs, and repeated rows go to lots like others, so no task grows with the input.
    Null texts, long texts, repeated rows and other columns: see `pieces`. An empty table gives no rows.
    """
    if not 0 < again < 1:
        raise ValueError("again must be a share, or rounds would not shrink")
    lot = max(lot, 8 * capacity)
    left = cut(pieces(docs, tokenizer_path, capacity, end_id, id_col, text_col), "op3-pieces")
    out, turn = None, 0
    while True:
        lots = max(1, round(left.count() / lot))
        dealt = left.withColumn("lot", F.pmod(F.xxhash64("part", "number", F.lit(turn)), F.lit(lots)))
        got = dealt.groupBy("lot").applyInArrow(_packer(capacity, turn, again if lots > 1 else 0.0), f"{NUMBERED}, sequence_id bigint, offset bigint, open boolean")
        if lots > 1:
            got = cut(got, "op3-packed")
            if not turn:
                drop(docs.sparkSession, left)
        done = got.where("not open").select(*left.columns[:5], "sequence_id", "offset")
        out = done if out is None else out.unionByName(done)
        if lots == 1:
            return out
        left, turn = got.where("open").select(*left.columns), turn + 1


def _packer(capacity: int, turn: int, again: float):
    """Packs a lot; the pieces of its emptiest sequences, full ones apart, with a share of `again` of its pieces, are left open."""

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("part", "ascending"), ("number", "ascending")])
        fit = BestFit(capacity)
        got = [fit.put(n) for n in t["length"].to_pylist()]
        own = (turn << 56) + (t["lot"][0].as_py() << 24)
        fill, held = np.array(fit.fill), np.bincount([b for b, _ in got])
        by = np.argsort(fill, kind="stable")
        emptiest = np.zeros(len(fill), bool)
        emptiest[by[np.cumsum(held[by]) <= again * t.num_rows]] = True
        emptiest &= fill < capacity
        t = t.drop_columns(["lot"]).append_column("sequence_id", pa.array([own + b for b, _ in got], pa.int64()))
        return t.append_column("offset", pa.array([at for _, at in got], pa.int64())).append_column("open", pa.array(emptiest[[b for b, _ in got]]))

    return run


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3: all documents, packed."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
