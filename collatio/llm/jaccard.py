"""N-gram Jaccard join: T-occurrence search over inverted lists of word shingles, with DivideSkip."""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _hashing as H
from . import _repeats as R
from ._components import components
from ._store import cut, drop, release, width

WORDS, PERCENT = 4, 85
#: Bytes of text hashed at once, and posting entries that a task merges before it sends them.
BATCH, CHUNK = 1 << 20, 1 << 21
#: Documents to a side of a block of the search.
SIDE = 256
#: DivideSkip's weight of the longest list's logarithm in the choice of how many lists are long.
MU = 0.01
#: Entries of short lists up to which they are merged by a heap; more are merged by counting.
HEAP = 4096

SETS = "doc_id bigint, n bigint, a bigint, b bigint, prefix binary, members binary"


def shingles(texts: list[bytes], words: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each text, sorted, and where each text's start (and the end).

    A-Z is lower-cased; words are `[^\\x20\\x09-\\x0D]+`. A text of fewer words has its whole sequence as one shingle.
    """
    w, first = H.words(texts, fold=True)
    h, at = H.windows(w, first, words)
    doc = np.searchsorted(first, at, side="right") - 1
    size = np.diff(first)
    for k in range(1, words):
        for d in np.flatnonzero(size == k):
            short = H.windows(w[first[d] : first[d + 1]], np.array([0, k]), k)[0]
            h, doc = np.append(h, H.mix(short + np.uint64(k))), np.append(doc, d)
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    h, doc = h[new], doc[new]
    return h, np.searchsorted(doc, np.arange(len(texts) + 1))


def _lots(texts: list[bytes], words: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """A chunk's texts some at a time: which, and their shingles."""
    a, held = 0, 0
    for i, t in enumerate(texts):
        held += len(t)
        if held >= BATCH or i == len(texts) - 1:
            yield a, i + 1, *shingles(texts[a : i + 1], words)
            a, held = i + 1, 0


def _signatures(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each set, whatever the order of its members."""
    sums = np.zeros((2, len(h) + 1), np.uint64)
    np.cumsum(H.mix(h ^ np.uint64(0xA5A5A5A5A5A5A5A5)), out=sums[0, 1:])
    np.cumsum(H.mix(h * np.uint64(H.Q)), out=sums[1, 1:])
    return tuple((s[first[1:]] - s[first[:-1]]).view(np.int64) for s in sums)


def needed(n: int, percent: int) -> int:
    """The overlap that a set of n members must reach with any set it links to."""
    return -(-n * percent // 100)


def _pack(*columns: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(b"".join(np.ascontiguousarray(np.ascontiguousarray(c).view(np.uint8).reshape(-1, c.itemsize).T).tobytes() for c in columns))


def _unpack(block: bytes) -> tuple[np.ndarray, ...]:
    """(differences of) hashes, least and largest set size, smallest document."""
    data = np.frombuffer(zstandard.ZstdDecompressor().decompress(block), np.uint8)
    n, at, out = len(data) // 24, 0, []
    for kind in (np.uint64, np.uint32, np.uint32, np.int64):
        size = np.dtype(kind).itemsize
        out.append(np.ascontiguousarray(data[at : at + n * size].reshape(size, n).T).view(kind).ravel())
        at += n * size
    out[0] = np.cumsum(out[0], dtype=np.uint64)
    return tuple(out)


def _runs(h: np.ndarray, low: np.ndarray, high: np.ndarray, percent: int) -> np.ndarray:
    """Entries sorted by (h, low): the number of the run each belongs to.

    A run ends with its hash, and where the next set is too large for any so far: sets that can link are in one run.
    """
    group = np.concatenate([[0], np.cumsum(h[1:] != h[:-1])])
    top = np.maximum.accumulate((group.astype(np.int64) << 32) + high) & 0xFFFFFFFF
    new = np.ones(len(h), bool)
    new[1:] = (group[1:] != group[:-1]) | (low[1:].astype(np.int64) * percent > top[:-1].astype(np.int64) * 100)
    return np.cumsum(new) - 1


def _reduce(h: np.ndarray, low: np.ndarray, high: np.ndarray, doc: np.ndarray, percent: int):
    """One entry a run, and edges from the run's documents to its smallest."""
    order = np.lexsort((low, h))
    h, low, high, doc = h[order], low[order], high[order], doc[order]
    run = _runs(h, low, high, percent)
    at = np.flatnonzero(np.diff(run, prepend=-1))
    root = np.minimum.reduceat(doc, at)
    edges = np.stack([doc, root[run]], axis=1)[doc != root[run]]
    return (h[at], low[at], np.maximum.reduceat(high, at), root), np.unique(edges, axis=0) if len(edges) else edges


def sets(docs: DataFrame, marks: DataFrame, plan: R.Layout, words: int, percent: int) -> DataFrame:
    """Every document's set: its size and signature; and, if it can link at all, its rarest shingles and its members.

    The exchange of `_repeats`, whose answers `marks` holds, tells each chunk in how many chunks each of its shingles occurs. That number, by its
    logarithm, orders shingles from rare to frequent, alike for all documents. A document whose shingles are not nearly all
    found in another one, T of them at least, links with nothing and sends nothing more; nor do copies of a set within a
    chunk, but for the first.
    """
    def describe(t: pa.Table, marks: pa.Table) -> pa.Table:
        if not t.num_rows:
            return pa.table({c: pa.array([]) for c in ("doc_id", "n", "a", "b", "prefix", "members")})
        t = R.in_order(t)
        ids, lots = t["doc_id"].to_pylist(), list(_lots(R.texts(t), words))
        u, count = np.unique(np.concatenate([x[2] for x in lots]), return_counts=True)
        level = R.levels_of(u, marks, plan.buckets)
        shared = (level > 0) | (count > 1)
        out: list[tuple] = []
        seen = set()
        for i, _, h, first in lots:
            a, b = _signatures(h, first)
            k = np.searchsorted(u, h)
            some = np.concatenate([[0], np.cumsum(shared[k])])
            for d in range(len(first) - 1):
                x, y = first[d], first[d + 1]
                n, key = int(y - x), (int(y - x), int(a[d]), int(b[d]))
                prefix = members = None
                if n and ids[i + d] is not None and some[y] - some[x] >= needed(n, percent) and key not in seen:
                    seen.add(key)
                    order = np.argsort(level[k[x:y]], kind="stable")  # by level, then by hash
                    prefix, members = h[x:y][order[: n - needed(n, percent) + 1]].tobytes(), h[x:y].tobytes()
                out.append((ids[i + d], *key, prefix, members))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
        return pa.table([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["doc_id", "n", "a", "b", "prefix", "members"])

    base = R.chunked(docs, plan)
    return base.groupBy("chunk").cogroup(marks.groupBy("chunk")).applyInArrow(describe, SETS)


def _levels(docs: DataFrame, words: int, plan: R.Layout) -> DataFrame:
    def emit(t: pa.Table) -> pa.Table:
        chunk = t["chunk"][0].as_py()
        parts = [h for _, _, h, _ in _lots(R.texts(t), words)] if chunk >= 0 else []
        return R.blocks(chunk, np.unique(np.concatenate([np.zeros(0, np.uint64), *parts])), plan.buckets)

    return cut(R.levels(R.chunked(docs, plan).groupBy("chunk").applyInArrow(emit, R.BLOCK)), "op5-levels")


def candidates(described: DataFrame, percent: int) -> DataFrame:
    """Edges (a, b) whose components hold together every two sets that can link.

    Two sets that link share a shingle among the rarest n - T + 1 of each, T being the overlap needed: the lists of those
    shingles are the short ones, and only they are sent. Each task merges its own lists first, so a list is at most one
    entry a task and run of sizes; the tasks that merge the lists of a range of hashes return edges to a run's smallest
    document, not pairs.
    """
    buckets = width(described.sparkSession)
    lows = np.array([-(-(b << 32) // buckets) << 32 for b in range(1, buckets)], np.uint64)

    def emit(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, kinds = ["bucket", "block", "a", "b"], (pa.int32(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()))
        held, parts = 0, []

        def flush():
            (h, low, high, doc), edges = _reduce(*(np.concatenate(c) for c in zip(*parts, strict=True)), percent)
            at = np.concatenate([[0], np.searchsorted(h, lows), [len(h)]])
            rows = [(b, _pack(np.diff(h[i:j], prepend=np.uint64(0)), low[i:j], high[i:j], doc[i:j]), [], []) for b, (i, j) in enumerate(zip(at[:-1], at[1:], strict=True)) if j > i]
            if len(edges):
                rows.append((int(edges[0, 0]) % buckets, None, edges[:, 0].tolist(), edges[:, 1].tolist()))
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        for b in source:
            for doc, n, prefix in zip(b.column("doc_id").to_pylist(), b.column("n").to_pylist(), b.column("prefix"), strict=True):
                own = np.frombuffer(prefix.as_buffer(), np.uint64)
                parts.append((own, np.full(len(own), n, np.uint32), np.full(len(own), n, np.uint32), np.full(len(own), doc, np.int64)))
                held += len(own)
                if held >= CHUNK:
                    yield flush()
                    held, parts = 0, []
        if parts:
            yield flush()

    def merge(t: pa.Table) -> pa.Table:
        blocks = [_unpack(x.as_py()) for x in t["block"] if x.is_valid]
        edges = [np.stack([np.array(a, np.int64), np.array(b, np.int64)], axis=1) for a, b in zip(t["a"].to_pylist(), t["b"].to_pylist(), strict=True) if a]
        if blocks:
            edges.append(_reduce(*(np.concatenate(c) for c in zip(*blocks, strict=True)), percent)[1])
        every = np.unique(np.concatenate(edges), axis=0) if edges else np.zeros((0, 2), np.int64)
        return pa.table({"a": every[:, 0], "b": every[:, 1]})

    lists = described.where("prefix is not null").select("doc_id", "n", "prefix")
    return lists.mapInArrow(emit, "bucket int, block binary, a array<bigint>, b array<bigint>").groupBy("bucket").applyInArrow(merge, "a bigint, b bigint")


def search(query: np.ndarray, lists: dict[int, list[int]], sets: list[np.ndarray], percent: int, skip) -> list[int]:
    """The documents of the block whose sets link with the query, by DivideSkip; skip(d) leaves out those that needn't be found.

    lists: the inverted lists of the block, documents in order. T is the least overlap that any of them needs. The L
    longest lists are set aside; the short rest is merged (by a heap, or by counting when it is long) for documents on at least
    T - L of them, and these are looked up in the long lists by binary probes. L is T / (MU * log2(longest list) + 1),
    less than T.
    """
    own = [(int(x), lists[int(x)]) for x in query if int(x) in lists]
    need = needed(len(query), percent)
    if len(own) < need:
        return []
    own.sort(key=lambda e: len(e[1]))
    longest = len(own[-1][1])
    n_long = min(need - 1, int(need / (MU * math.log2(longest + 1) + 1)))
    short, long = own[: len(own) - n_long], own[len(own) - n_long :]
    least = need - n_long
    counts: dict[int, int] = {}
    if sum(len(x) for _, x in short) <= HEAP:
        heap = [(x[0], i, 0) for i, (_, x) in enumerate(short)]
        heapq.heapify(heap)
        while heap:
            d, n = heap[0][0], 0
            while heap and heap[0][0] == d:
                _, i, k = heap[0]
                n += 1
                x = short[i][1]
                if k + 1 < len(x):
                    heapq.heapreplace(heap, (x[k + 1], i, k + 1))
                else:
                    heapq.heappop(heap)
            if n >= least:
                counts[d] = n
    else:
        n = np.bincount(np.concatenate([np.array(x) for _, x in short]), minlength=len(sets))
        counts = {int(d): int(n[d]) for d in np.flatnonzero(n >= least)}
    probes = np.sort(np.array([x for x, _ in long], np.uint64)) if long else np.zeros(0, np.uint64)
    found = []
    for d, n in counts.items():
        y = sets[d]
        if len(y) * 100 < len(query) * percent or len(query) * 100 < len(y) * percent or skip(d):
            continue
        if len(probes) <= 16:
            n += sum(1 for _, x in long if (k := bisect_left(x, d)) < len(x) and x[k] == d)
        else:  # the same probes, made in the document's sorted set at once
            k = np.searchsorted(y, probes)
            k[k == len(y)] = 0
            n += int((y[k] == probes).sum())
        if 100 * n >= percent * (len(query) + len(y) - n):
            found.append(d)
    return found


def _find(root: list[int], x: int) -> int:
    while root[x] != x:
        root[x] = root[root[x]]
        x = root[x]
    return x


def _join(ids: list[int], sets: list[np.ndarray], queries: list[int], indexed: list[int], percent: int) -> list[tuple[int, int]]:
    """A forest of the links between the queries and the indexed documents of a block."""
    root = list(range(len(ids)))
    lists: dict[int, list[int]] = {}
    for d in indexed:
        for x in sets[d].tolist():
            lists.setdefault(x, []).append(d)
    forest = []
    for q in queries:
        for d in search(sets[q], lists, sets, percent, lambda d, q=q: _find(root, d) == _find(root, q)):
            a, b = _find(root, q), _find(root, d)
            if a != b:
                root[max(a, b)] = min(a, b)
                forest.append((ids[q], ids[d]))
    return forest


def links(described: DataFrame, members: DataFrame, percent: int, side: int = SIDE) -> DataFrame:
    """A forest (a, b) of the links among the members (doc_id, cluster) of each cluster.

    A small cluster is searched in one block; a larger one is cut into blocks of about `side` documents by a hash, and each two
    blocks meet in a task of their own.
    """
    lots = 4 * width(described.sparkSession)
    sizes = cut(members.groupBy("cluster").agg(F.count("*").alias("size")).where("size > 1"), "op5-clusters")
    own = cut(members.join(sizes, "cluster").withColumn("blocks", F.ceil(F.col("size") / side).cast("int")), "op5-members")
    made = described.where("members is not null").select("doc_id", F.col("members").alias("set")).join(own, "doc_id")
    block = F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int")
    others = F.when(F.col("blocks") == 1, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = made.withColumn("block", block).withColumn("other", F.explode(others))
    low, high = F.least("block", "other"), F.greatest("block", "other")
    lot = F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("cluster"), F.lit(lots))).otherwise(F.xxhash64("cluster", low, high))
    dealt = dealt.select("doc_id", "cluster", "set", "block", low.alias("low"), high.alias("high"), lot.alias("lot"))

    def run(t: pa.Table) -> pa.Table:
        forest: list[tuple[int, int]] = []
        t = t.sort_by([("cluster", "ascending"), ("low", "ascending"), ("high", "ascending"), ("doc_id", "ascending")])
        keys = list(zip(*(t[c].to_pylist() for c in ("cluster", "low", "high")), strict=True))
        ids, block = t["doc_id"].to_pylist(), t["block"].to_pylist()
        a = 0
        while a < len(keys):
            b = a
            while b < len(keys) and keys[b] == keys[a]:
                b += 1
            own = [np.frombuffer(x.as_py(), np.uint64) for x in t["set"][a:b]]
            first = [i for i in range(b - a) if block[a + i] == keys[a][1]]
            second = [i for i in range(b - a) if block[a + i] == keys[a][2]]
            forest += _join(ids[a:b], own, first, second, percent)
            a = b
        return pa.table({"a": pa.array([x for x, _ in forest], pa.int64()), "b": pa.array([x for _, x in forest], pa.int64())})

    return dealt.groupBy("lot").applyInArrow(run, "a bigint, b bigint")


def near(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id: the smallest doc_id that the links reach, itself included.

    A document's set holds its distinct shingles of `words` words, A-Z lower-cased, of the whole text. Two documents link when
    100 * |intersection| >= percent * |union|. Documents with equal sets are one class, whatever their number (a 128-bit
    signature tells them). The classes that can link at all are gathered into clusters by their short lists, and within the
    blocks of a cluster the T-occurrence search finds the links; two documents that are known to be connected needn't be
    compared, so a group of near copies costs about one comparison each. No list is capped.

    Null or empty texts and texts without words have an empty set and link with nothing. Rows with a null id come
    back with their set's size and a null component. Rows that repeat an id are one node, whatever their texts: each comes back, with
    its own set's size and the id's component. Extra columns, whatever their names, are ignored. A text's set is made whole, so the
    longest one bounds what a task holds.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    plan = R.layout(base)
    marks = _levels(base, words, plan)
    release(spark)
    described = cut(sets(base, marks, plan, words, percent), "op5-sets")
    release(spark)
    drop(spark, marks)
    known = described.where("doc_id is not null").select("doc_id", "n", "a", "b")
    keys = ["n", "a", "b"]
    classes = cut(known.where("n > 0").groupBy(*keys).agg(F.min("doc_id").alias("rep")), "op5-classes")
    same = F.struct(*keys)
    several = known.groupBy("doc_id").agg(F.min(same).alias("x"), F.max(same).alias("y")).where("x <> y").select("doc_id")
    several = cut(known.join(several, "doc_id").distinct().join(classes, keys).select("doc_id", "rep"), "op5-several")  # ids of rows with different texts
    ties = several.join(several.groupBy("doc_id").agg(F.min("rep").alias("least")), "doc_id").select(F.col("rep").alias("a"), F.col("least").alias("b"))
    clusters = components(edges := cut(candidates(described, percent), "op5-edges"))
    drop(spark, edges)
    members = clusters.withColumnRenamed("component", "cluster").join(classes.select(F.col("rep").alias("id")).distinct(), "id").select(F.col("id").alias("doc_id"), "cluster")
    comp = components(forest := cut(links(described, members, percent).unionByName(ties), "op5-forest"))
    drop(spark, forest)
    per = cut(classes.join(comp, classes["rep"] == comp["id"], "left").select(*keys, F.coalesce("component", "rep").alias("c")), "op5-per-class")
    whole = several.join(comp, several["rep"] == comp["id"], "left").groupBy("doc_id").agg(F.min(F.coalesce("component", "rep")).alias("own"))
    out = known.join(per, keys, "left").join(whole, "doc_id", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("own", "c", "doc_id").alias("component_id"))
    none = described.where("doc_id is null").select("doc_id", F.col("n").alias("n_shingles"), F.lit(None).cast("long").alias("component_id"))
    return out.unionByName(none)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5: the size of every document's set, and its component."""
    return near(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, sh FROM (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
        ELSE [array_to_string(ws[i:i + 3], ' ') for i in generate_series(1, len(ws) - 3)] END AS l FROM w), unnest(l) AS u(sh)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
link AS (SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id
         GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 85 * (x.n + y.n - count(*))),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a),
comp AS (SELECT a, min(b) AS c FROM reach GROUP BY a)
SELECT documents.doc_id, coalesce(n.n, 0) AS n_shingles, c AS component_id
FROM documents JOIN comp ON comp.a = documents.doc_id LEFT JOIN n ON n.doc_id = documents.doc_id
"""
