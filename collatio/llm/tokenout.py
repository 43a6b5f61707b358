"""Token-ID output: sequences in training order, in fixed-stride shards for sequential, resumable reads."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._hashing import mix
from ._store import cut, drop, new_path, spread
from ._tokens import default_path, tokens
from .warc import _fs

#: Ids of a sequence, and sequences of a shard.
LENGTH, SHARD = 256, 1 << 15
ROUNDS = 8
#: Sequences that are compressed together on their way, and bytes that a reader takes at once and that are dealt at once.
LOT, READ, DEAL = 1 << 12, 4 << 20, 32 << 20
#: Of zstd, for the blocks on their way. Nothing compresses them again.
LEVEL = 3
#: Stands for a null doc_id in a record.
NONE = -(1 << 63)


class Feistel:
    """A keyed permutation of range(n): a balanced Feistel network on the next even number of bits, walked until it is back below n."""

    def __init__(self, n: int, key: int, rounds: int = ROUNDS):
        self.n = n
        self.half = np.uint64(max(1, ((max(1, n - 1)).bit_length() + 1) // 2))
        self.mask = np.uint64((1 << int(self.half)) - 1)
        seeds = np.arange(1, rounds + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(key & (2**64 - 1))
        self.keys = list(mix(seeds))

    def _walk(self, x: np.ndarray, keys: list, back: bool) -> np.ndarray:
        x = x.astype(np.uint64)
        out, todo = x.copy(), np.arange(len(x))
        while len(todo):
            a, b = out[todo] >> self.half, out[todo] & self.mask
            for k in keys:
                if back:
                    a, b = b ^ (mix(a ^ k) & self.mask), a
                else:
                    a, b = b, a ^ (mix(b ^ k) & self.mask)
            out[todo] = (a << self.half) | b
            todo = todo[out[todo] >= np.uint64(self.n)]  # a cycle leads back to where it started, hence below n
        return out.astype(np.int64)

    def slot(self, number: np.ndarray) -> np.ndarray:
        return self._walk(number, self.keys, False)

    def number(self, slot: np.ndarray) -> np.ndarray:
        return self._walk(slot, self.keys[::-1], True)


def record_type(length: int, wide: bool) -> np.dtype:
    """A record: little-endian doc_id, piece, number of ids, and the ids, with zeros behind the last."""
    return np.dtype([("doc_id", "<i8"), ("piece", "<u4"), ("count", "<u4"), ("ids", "<u4" if wide else "<u2", (length,))])


#: What a block holds of each of its records; their ids follow, without padding.
HEAD = np.dtype([("doc_id", "<i8"), ("piece", "<u4"), ("count", "<u4")])


def _records(block: bytes, n: int, kind: np.dtype) -> np.ndarray:
    """A block's n records, padded."""
    head = np.frombuffer(block, HEAD, n)
    out = np.zeros(n, kind)
    for name in HEAD.names:
        out[name] = head[name]
    out["ids"][np.arange(kind["ids"].shape[0]) < head["count"][:, None]] = np.frombuffer(block, kind["ids"].base, -1, n * HEAD.itemsize)
    return out


def sequences(docs: DataFrame, tokenizer_path: str | None = None, length: int = LENGTH, end_id: int = 0, wide: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document's ids, ended by end_id, in sequences of at most `length`: (part, first, count, block), many sequences a block.

    part and first number a block's sequences: first counts within the part, and a part is a task. A null text is an empty one.
    An id that doesn't fit the records is an error. A text is encoded whole, so the longest one bounds what a task holds.
    """
    path, end, kind = tokenizer_path or default_path(), end_id.to_bytes(4, "little"), record_type(length, wide)["ids"].base
    most = np.iinfo(kind).max
    if end_id > most:
        raise ValueError(f"end id {end_id} does not fit records of ids up to {most}; use wide")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, part, first = tokens(path), TaskContext.get().partitionId(), 0
        pack = zstandard.ZstdCompressor(level=LEVEL)
        for whole in batches:
            for a in range(0, whole.num_rows, 512):
                b = whole.slice(a, 512)
                got = t.encode([x.as_buffer().to_pybytes() if x.is_valid else b"" for x in b.column("text")])
                size = np.array([len(x) // 4 + 1 for x in got], np.int64)
                ids = np.frombuffer(end.join(got) + end, "<u4")
                if (top := int(ids.max())) > most:
                    raise ValueError(f"id {top} does not fit records of ids up to {most}; use wide")
                ids = ids.astype(kind)
                pieces = -(-size // length)
                head = np.zeros(int(pieces.sum()), HEAD)
                head["doc_id"] = np.repeat([NONE if x is None else x for x in b.column("doc_id").to_pylist()], pieces)
                head["piece"] = np.arange(len(head)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                head["count"] = np.minimum(length, np.repeat(size, pieces) - head["piece"].astype(np.int64) * length)
                ends = np.concatenate([[0], np.cumsum(head["count"], dtype=np.int64)])
                for i in range(0, len(head), LOT):
                    own = head[i : i + LOT]
                    block = pack.compress(own.tobytes() + ids[ends[i] : ends[i + len(own)]].tobytes())
                    yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([first], pa.int64()), pa.array([len(own)], pa.int64()), pa.array([block], pa.binary())], ["part", "first", "count", "block"])
                    first += len(own)

    return spread(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))).mapInArrow(run, "part int, first bigint, count bigint, block binary")


MANIFEST = "shard bigint, path string, first_slot bigint, records bigint, stride int, crc32 bigint"


def materialise(docs: DataFrame, key: int, folder: str | None = None, tokenizer_path: str | None = None, length: int = LENGTH, shard: int = SHARD, end_id: int = 0, wide: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write all documents' sequences in training order; returns the manifest: shard, path, first_slot, records, stride, crc32.

    Texts are encoded once, into numbered blocks in the shared folder. The number of a sequence is its place in its block's task, plus
    the counts of the tasks before it, of which the driver holds one number a task; a Feistel permutation of range(n) under the key, walked
    along its cycles, makes it the sequence's slot. Slots are dealt by ranges of `shard`, and each range's task puts its records in order and
    writes them with one stride, so a record's place is (slot - first_slot) * stride and a reader can start anywhere. Every slot is taken
    exactly once, or the task fails. A shard's size bounds a task, whatever the input. Files are named by attempt, and the manifest
    names those of the successful ones, so a lost executor costs its tasks only. The same blocks and key give the same order.

    Null texts are empty and have the end id alone; repeated rows and null ids are sequences like others. An empty table writes nothing.
    ids are 16 bits wide unless `wide`; a larger one fails the task. Columns of docs other than the two named, whatever their names, are ignored.
    """
    spark = docs.sparkSession
    folder = folder or new_path(spark, "op10-shards")
    kind = record_type(length, wide)
    made = cut(sequences(docs, tokenizer_path, length, end_id, wide, id_col, text_col), "op10-sequences", "uncompressed")
    counts = sorted(made.groupBy("part").agg(F.sum("count").alias("n")).collect())
    total, before = 0, {}
    for part, n in counts:
        before[part], total = total, total + n
    order, start = Feistel(max(1, total), key), spark.sparkContext.broadcast(before)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack, unpack = zstandard.ZstdCompressor(level=LEVEL), zstandard.ZstdDecompressor()
        held, slots, size = [], [], 0

        def flush():
            every, at = np.concatenate(held), np.concatenate(slots)
            by = np.argsort(at)
            at = at[by]
            edges = np.flatnonzero(np.diff(at // shard, prepend=-1))
            rows = [(int(at[i] // shard), at[i:j].tobytes(), pack.compress(every[by[i:j]].tobytes())) for i, j in zip(edges, [*edges[1:], len(at)], strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int64(), pa.binary(), pa.binary()), strict=True)], ["shard", "slots", "block"])

        for b in batches:
            for part, first, n, block in zip(*(b.column(c).to_pylist() for c in ("part", "first", "count")), b.column("block"), strict=True):
                own = _records(unpack.decompress(block.as_buffer()), n, kind)
                held.append(own)
                slots.append(order.slot(np.arange(first, first + n) + start.value[part]))
                size += own.nbytes
                if size >= DEAL:
                    yield flush()
                    held, slots, size = [], [], 0
        if held:
            yield flush()

    def write(t: pa.Table) -> pa.Table:
        unpack = zstandard.ZstdDecompressor()
        number = t["shard"][0].as_py()
        base = number * shard
        n = min(shard, total - base)
        out, taken = np.zeros(n, kind), np.zeros(n, np.int64)
        for slots, block in zip(t["slots"].to_pylist(), t["block"], strict=True):
            at = np.frombuffer(slots, np.int64) - base
            out[at] = np.frombuffer(unpack.decompress(block.as_buffer().to_pybytes()), kind)
            np.add.at(taken, at, 1)
        if (taken != 1).any():
            raise ValueError(f"shard {number}: {(taken != 1).sum()} slots are not taken once")
        fs, at = _fs(folder)
        fs.create_dir(at, recursive=True)
        path = f"{at}/{number:08d}-{TaskContext.get().taskAttemptId()}.bin"
        data = out.tobytes()
        with fs.open_output_stream(path, compression=None) as f:
            f.write(data)
        return pa.table({"shard": [number], "path": [path], "first_slot": [base], "records": [n], "stride": pa.array([kind.itemsize], pa.int32()), "crc32": [zlib.crc32(data)]})

    dealt = made.mapInArrow(deal, "shard bigint, slots binary, block binary")
    manifest = cut(dealt.groupBy("shard").applyInArrow(write, MANIFEST), "op10-manifest")
    drop(spark, made)
    return manifest


def read(manifest: DataFrame, length: int = LENGTH, wide: bool = False, start: int = 0, stop: int | None = None, with_ids: bool = True) -> DataFrame:
    """The sequences of slots start to stop, each shard read in order from the first that is asked for: slot, doc_id, piece, shard, length, ids_crc32[, ids]."""
    kind = record_type(length, wide)
    end = stop if stop is not None else 1 << 62

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["slot", "doc_id", "piece", "shard", "length", "ids_crc32", *(["ids"] if with_ids else [])]
        for b in batches:
            for number, path, first, n in zip(*(b.column(c).to_pylist() for c in ("shard", "path", "first_slot", "records")), strict=True):
                lo, hi = max(start, first), min(end, first + n)
                fs, at = _fs(path)
                with fs.open_input_file(at) as f:
                    f.seek(max(0, lo - first) * kind.itemsize)
                    while lo < hi:
                        own = np.frombuffer(f.read(min(hi - lo, READ // kind.itemsize) * kind.itemsize), kind)
                        wide_ids = own["ids"].astype("<u4")
                        ids = [r[:c] for r, c in zip(wide_ids, own["count"].tolist(), strict=True)]
                        doc = pa.array(own["doc_id"], pa.int64(), mask=own["doc_id"] == NONE)
                        yield pa.RecordBatch.from_arrays([
                            pa.array(np.arange(lo, lo + len(own)), pa.int64()), doc, pa.array(own["piece"].astype(np.int32)), pa.array(np.full(len(own), number), pa.int64()),
                            pa.array(own["count"].astype(np.int64)), pa.array(list(map(zlib.crc32, ids)), pa.int64()), *([pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32()))] if with_ids else []),
                        ], names)
                        lo += len(own)

    return manifest.where((F.col("first_slot") < end) & (F.col("first_slot") + F.col("records") > start)).mapInArrow(run, "slot bigint, doc_id bigint, piece int, shard bigint, length bigint, ids_crc32 bigint" + ", ids array<int>" * with_ids)


KEY = 0x5EED


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10: where each sequence of all documents stands, as read back from the shards."""
    manifest = materialise(spark.read.parquet(f"{sf_dir}/documents.parquet"), KEY)
    return read(manifest.repartition(max(1, manifest.count())), with_ids=False).select("doc_id", "piece", "slot", "shard", "length", "ids_crc32")
