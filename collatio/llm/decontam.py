"""Benchmark decontamination: a BM25 inverted index of test items, queried with block-max WAND by every training passage."""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _hashing as H
from ._store import spread
from .toxicity import GAP

K1, B = 1.2, 0.75
#: A passage retrieves an item when it scores this share of what the item scores against itself.
THRESHOLD = 0.6
#: Words of a shingle, and the share of the question's and of the answer's shingles that a leak holds.
SHINGLE, OVERLAP = 5, 0.8
#: Items of an index block.
BLOCK = 4
#: Items and bytes of the indexes that are broadcast at a time; more items take more passes over the documents.
SHARD_ITEMS, SHARD_BYTES = 20_000, 16 << 20
#: Words of the smallest class of items. Passages are twice as long as the longest item of a class and overlap by half.
CLASS = 64

FOUND = "doc_id bigint, item_id bigint, score double, question_overlap double, answer_overlap double, word bigint"


def split(text: str) -> tuple[str, str]:
    """Question and answer: parted after the first question mark, else at the first line feed, else before the last sentence.

    The answer is empty when there is only one part.
    """
    t = text.strip()
    m = re.search(r"\?\s+(?=\S)|\n\s*(?=\S)", t) or next(iter(list(re.finditer(r"[.!]\s+(?=\S)", t))[-1:]), None)
    return (t[: m.end()], t[m.end() :]) if m else (t, "")


def _words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return H.words(texts, fold=True, gaps=GAP)


def _shingles(text: str) -> tuple[int, np.ndarray]:
    """The window length of a part and its distinct windows: SHINGLE words, or all of a shorter part's."""
    w, first = _words([text.encode()])
    k = min(SHINGLE, len(w))
    return k, np.unique(H.windows(w, first, k)[0]) if k else np.zeros(0, np.uint64)


class Index:
    """Postings of normalised BM25 impacts: an item's impacts add up to 1, so one threshold holds for all items."""

    def __init__(self, items: list[tuple[int, str]], longest: int):
        self.longest = longest
        self.ids = [i for i, _ in items]
        texts = [t for _, t in items]
        w, first = _words([t.encode() for t in texts])
        size = np.diff(first)
        mean = max(1.0, float(size.mean()) if len(size) else 1.0)
        item = np.repeat(np.arange(len(items)), size)
        pairs, tf = np.unique(np.stack([w, item.astype(np.uint64)], axis=1), axis=0, return_counts=True)
        self.terms, at, df = np.unique(pairs[:, 0], return_index=True, return_counts=True)
        n = len(items)
        idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
        owner = pairs[:, 1].astype(np.int64)
        impact = np.repeat(idf, df) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size[owner] / mean))
        own = np.bincount(owner, weights=impact, minlength=n)
        weight = impact / own[owner]
        self.items = [owner[a : a + k].tolist() for a, k in zip(at, df, strict=True)]
        self.weights = [weight[a : a + k].tolist() for a, k in zip(at, df, strict=True)]
        self.most = np.array([max(x) for x in self.weights])
        self.blocks: list[dict[int, float]] = []
        for docs, ws in zip(self.items, self.weights, strict=True):
            best: dict[int, float] = {}
            for d, x in zip(docs, ws, strict=True):
                best[d // BLOCK] = max(best.get(d // BLOCK, 0.0), x)
            self.blocks.append(best)
        self.bounds = self._bounds([list(x) for x in self.blocks], [list(x.values()) for x in self.blocks], -(-n // BLOCK))
        parts = [split(t) for t in texts]
        self.question = [_shingles(q) for q, _ in parts]
        self.answer = [_shingles(a) for _, a in parts]

    def find(self, w: np.ndarray) -> np.ndarray:
        """The term's number for each word hash, -1 for words of no item."""
        k = np.searchsorted(self.terms, w)
        k[k == len(self.terms)] = 0
        return np.where(self.terms[k] == w, k, -1) if len(self.terms) else np.full(len(w), -1)

    @staticmethod
    def _bounds(places: list[list[int]], tops: list[list[float]], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """For each term the blocks it is in and how much it counts there at most, in one array."""
        ptr = np.concatenate([[0], np.cumsum([len(x) for x in places])]).astype(np.int64)
        flat = lambda lists, kind: np.array([x for own in lists for x in own], kind)
        return ptr, flat(places, np.int64), flat(tops, np.float64), n

    def may(self, passage: np.ndarray, term: np.ndarray, n: int, threshold: float) -> np.ndarray:
        """Which of n passages, given as distinct (passage, term) pairs, the search can't leave out at once: those that some block's maxima
        lift to the threshold."""
        ptr, places, tops, width = self.bounds
        step = max(1, (1 << 21) // max(1, width))
        edges = np.searchsorted(passage, np.arange(0, n + step, step))
        left = np.zeros(n, bool)
        for lo, a, b in zip(range(0, n, step), edges[:-1], edges[1:], strict=False):
            count = ptr[term[a:b] + 1] - ptr[term[a:b]]
            at = np.repeat(ptr[term[a:b]] - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
            size = min(step, n - lo)
            bound = np.bincount(np.repeat(passage[a:b] - lo, count) * width + places[at], weights=tops[at], minlength=size * width)
            left[lo : lo + size] = bound.reshape(size, width).max(axis=1, initial=0.0) >= threshold - 1e-9
        return left

    def wand(self, terms: list[int], threshold: float) -> list[tuple[int, float]]:
        """Every item that scores at least the threshold for the passage's distinct terms, by block-max WAND.

        Cursors stand on the lists in item order. The pivot is the first item that the lists' maxima can lift to
        the threshold; the maxima of the pivot's block decide whether it is scored or the whole block is left out.
        """
        least, end = threshold - 1e-9, len(self.ids)
        cursors = [[self.items[t][0], 0, t] for t in terms]
        most = self.most
        found = []
        while cursors:
            cursors.sort()
            bound, pivot = 0.0, -1
            for i, (_, _, t) in enumerate(cursors):
                bound += most[t]
                if bound >= least:
                    pivot = i
                    break
            if pivot < 0:
                break
            d = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == d:
                pivot += 1
            block = d // BLOCK
            if sum(self.blocks[t].get(block, 0.0) for _, _, t in cursors[: pivot + 1]) >= least:
                if cursors[0][0] == d:
                    score = sum(self.weights[t][k] for x, k, t in cursors[: pivot + 1])
                    if score >= least:
                        found.append((d, score))
                    goal = d + 1
                else:
                    goal = d
            else:
                goal = (block + 1) * BLOCK
                if pivot + 1 < len(cursors):
                    goal = min(goal, cursors[pivot + 1][0])
                goal = max(goal, d + 1)
            kept = []
            for i, c in enumerate(cursors):
                if i <= pivot and c[0] < goal:
                    docs = self.items[c[2]]
                    k = bisect_left(docs, goal, c[1])
                    if k == len(docs):
                        continue
                    c = [docs[k], k, c[2]]
                if c[0] < end:
                    kept.append(c)
            cursors = kept
        return found


def passes(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", items: int = SHARD_ITEMS, size: int = SHARD_BYTES) -> Iterator[list[Index]]:
    """All items, a bounded number and size at a time, as an index for each class of lengths; read from Spark one row at a time."""
    words = F.size(F.split(F.trim(F.col(text_col)), r"[^\p{L}\p{N}]+"))
    level = F.greatest(F.lit(0), F.ceil(F.log2(words / F.lit(CLASS)))).cast("int")
    rows = benchmark.where(F.col(text_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t"), level.alias("level"))
    batch: dict[int, list[tuple[int, int, str]]] = {}
    held, count = 0, 0
    for r in rows.orderBy("level", "i", "t").toLocalIterator():
        n = len(_words([r["t"].encode()])[0])
        if not n:
            continue
        if count >= items or held >= size:
            yield _indexes(batch)
            batch, held, count = {}, 0, 0
        batch.setdefault(r["level"], []).append((n, r["i"], r["t"]))
        held, count = held + len(r["t"]), count + 1
    if batch:
        yield _indexes(batch)


def _indexes(batch: dict[int, list[tuple[int, int, str]]]) -> list[Index]:
    return [Index([(i, t) for _, i, t in own], max(n for n, _, _ in own)) for own in batch.values()]


def scan(texts: list[bytes], indexes: list[Index], threshold: float = THRESHOLD, overlap: float = OVERLAP) -> list[tuple[int, int, float, float, float, int]]:
    """(text, item, score, question overlap, answer overlap, first word) of every verified leak: each pair's best passage."""
    w, first = _words(texts)
    best: dict[tuple[int, int], tuple] = {}
    for index in indexes:
        for key, got in _retrieved(w, first, index, threshold, overlap):
            if key not in best or got[:3] > best[key][:3]:
                best[key] = got
    return [(d, i, *got) for (d, i), got in best.items()]


def _retrieved(w: np.ndarray, first: np.ndarray, index: Index, threshold: float, overlap: float) -> Iterator[tuple[tuple[int, int], tuple]]:
    """What the texts' passages retrieve from an index, verified."""
    stride = max(CLASS, index.longest)
    term = index.find(w)
    size = np.diff(first)
    segments = -(-size // stride)
    count = np.maximum(1, segments - 1) * (size > 0)
    base = np.concatenate([[0], np.cumsum(count)])
    doc = np.repeat(np.arange(len(size)), size)
    segment = (np.arange(len(w)) - first[:-1][doc]) // stride
    hit = np.flatnonzero(term >= 0)
    pairs = []
    for back in (0, 1):  # a segment's words belong to the passage it begins and to the one it ends
        p = segment[hit] - back
        ok = (p >= 0) & (p < count[doc[hit]])
        pairs.append((base[:-1][doc[hit[ok]]] + p[ok]) * len(index.terms) + term[hit[ok]])
    pairs = np.unique(np.concatenate(pairs))
    passage, terms = pairs // max(1, len(index.terms)), pairs % max(1, len(index.terms))
    for p in np.flatnonzero(index.may(passage, terms, int(base[-1]), threshold)):
        a, b = np.searchsorted(passage, [p, p + 1])
        d = int(np.searchsorted(base, p, side="right") - 1)
        lo = int(first[d] + (p - base[d]) * stride)
        own = w[lo : min(lo + 2 * stride, int(first[d + 1]))]
        made: dict[int, np.ndarray] = {}
        for item, score in index.wand(terms[a:b].tolist(), threshold):
            shares = []
            for k, want in (index.question[item], index.answer[item]):
                if k and k not in made:
                    made[k] = H.windows(own, np.array([0, len(own)]), k)[0]
                shares.append(float(np.isin(want, made[k]).mean()) if k else 1.0)
            if min(shares) >= overlap - 1e-9:
                yield (d, index.ids[item]), (score, *shares, lo - int(first[d]))


def leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, overlap: float = OVERLAP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, item_id) of every document that holds a benchmark item, with score, question_overlap, answer_overlap and word.

    Words are runs of letters and digits, lower-cased. Every whole text is cut into passages that overlap by half and are
    twice as long as the longest item of a class of lengths, so an item of the text lies in one of them. Passages that no block's
    maxima lift to the threshold are left out in bulk; block-max WAND retrieves for each of the others all items
    that reach it. A pair stays when the passage holds the asked share of the question's and of the
    answer's distinct shingles. word is the passage's first word. Null or empty texts and items match nothing; an
    item without an answer needs its question alone; rows with a null item_id are left out. Rows that
    repeat a doc_id (a null one too) or an item_id give one row a pair, the best. Other columns, whatever their names, are ignored. The
    indexes of a pass are broadcast, and their items and bytes are bounded; a larger benchmark takes more passes. A text is searched
    whole, so the longest one bounds what a task holds.
    """
    spark = docs.sparkSession
    base = spread(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")))
    out = spark.createDataFrame([], FOUND)
    kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int64())
    names = ["doc_id", "item_id", "score", "question_overlap", "answer_overlap", "word"]

    def one(indexes: list[Index]) -> DataFrame:
        sent = spark.sparkContext.broadcast(indexes)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in _lots(batches):
                ids = b.column("doc_id").to_pylist()
                rows = [(ids[d], *r) for d, *r in scan(_texts(b), sent.value, threshold, overlap)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        return base.mapInArrow(run, FOUND)

    for indexes in passes(benchmark):
        out = out.unionByName(one(indexes))
    best = F.max(F.struct("score", "question_overlap", "answer_overlap", (-F.col("word")).alias("w"))).alias("b")
    return out.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "b.score", "b.question_overlap", "b.answer_overlap", (-F.col("b.w")).alias("word"))


def without_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, overlap: float = OVERLAP, text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns as they are, whose texts hold no benchmark item: as `leaks` finds them, row by row, so ids don't matter."""
    spark = docs.sparkSession
    base = spread(docs.select(F.col(text_col).alias("text"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")))
    for indexes in passes(benchmark):
        base = base.mapInArrow(_sieve(spark.sparkContext.broadcast(indexes), threshold, overlap), base.schema)
    return base.select("row.*")


def _sieve(sent, threshold: float, overlap: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _lots(batches):
            keep = np.ones(b.num_rows, bool)
            keep[[r[0] for r in scan(_texts(b), sent.value, threshold, overlap)]] = False
            yield b.filter(pa.array(keep))

    return run


def _lots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for a in range(0, whole.num_rows, 256):
            yield whole.slice(a, 256)


def _texts(b: pa.RecordBatch) -> list[bytes]:
    return [x.as_buffer().to_pybytes() if x.is_valid else b"" for x in b.column("text")]


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6: every document that holds a benchmark item."""
    return leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
