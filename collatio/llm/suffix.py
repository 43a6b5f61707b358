"""Repeats of LENGTH bytes: suffixes sorted one bucket at a time, long ties resolved by the ranks of a difference-cover sample.

Two equal strings of LENGTH bytes, at i and j, have an offset k < PERIOD at which both i + k and j + k lie in the cover
sample (8 of every 57 places), whatever i and j are. The sample serves twice.

First, counted from the start of each document, it tells which suffixes can repeat: the bytes sampled repeat among the samples, so a
suffix without a repeated sample among its first PERIOD places has no equal. The samples' distinct hashes are compared in buckets of
an exchange, and the answer is a bit for each, whether it repeats. A hash that two samples share by chance costs work, not a wrong result.

The suffixes left over go to the bucket of the smallest hash of any GRAM bytes among their first LENGTH,
so equal suffixes share a bucket, and so do runs of neighbours: a run is sent as its text, once a chunk, which costs
three bytes a suffix and not a hundred. A bucket keeps each distinct run once, ranks the cover sample of its text (radix on words of eight
bytes, then doubling by whole periods), and sorts its suffixes one block at a time, by their leading two bytes: by words up to the
last place where a cover hit can be, and from there by ranks, at the hit that a suffix and its group's first member
have in common. Neighbours in that order that share LENGTH bytes are repeats, and all but the earliest are marked. A block bounds
what a sort holds, and a bucket its share of the runs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _hashing as H
from . import _repeats as R
from ._store import cut, release

LENGTH = 100
#: A perfect difference set: every difference modulo PERIOD occurs between two of its members.
PERIOD, COVER = 57, (1, 6, 7, 9, 19, 38, 42, 49)
#: Bytes whose smallest hash gives a suffix its bucket.
GRAM = 16
#: Bytes of text looked at together within a chunk, and suffixes sorted together in a bucket.
BATCH, SORTED = 1 << 20, 1 << 18
#: Bytes of a word, and of the prefix by which samples are named before names are doubled.
WORD, NAMED = 8, 64
#: The place of a residue in the cover, and for each two residues the first offset that takes both into it.
SLOT = np.full(PERIOD, -1)
SLOT[list(COVER)] = range(len(COVER))
COMMON = np.array([[next(k for k in range(PERIOD) if SLOT[(a + k) % PERIOD] >= 0 and SLOT[(b + k) % PERIOD] >= 0) for b in range(PERIOD)] for a in range(PERIOD)], np.int64)

RUNS = "bucket int, chunk int, sizes binary, texts binary"
MARKS = "chunk int, bucket int, bits binary"


def smallest(g: np.ndarray, w: int) -> np.ndarray:
    """The least of every w neighbours."""
    span = 1
    while 2 * span <= w:
        g = np.minimum(g[:-span], g[span:])
        span *= 2
    return np.minimum(g[: len(g) - (w - span)], g[w - span :]) if w > span else g


class Runs:
    """A chunk's runs of suffixes: each distinct one is kept once, in order, by bucket."""

    def __init__(self, buckets: int):
        self.buckets = buckets
        self.known: dict[bytes, tuple[int, int]] = {}
        self.texts: dict[int, list[bytes]] = {}
        self.count: dict[int, int] = {}

    def add(self, bucket: int, text: bytes, n: int) -> tuple[int, int, bool]:
        """The run's bucket, the place of its first suffix among the bucket's, and whether it is the first of its kind."""
        have = self.known.get(text)
        if have is not None:
            return *have, False
        at = self.count.get(bucket, 0)
        self.known[text] = bucket, at
        self.texts.setdefault(bucket, []).append(text)
        self.count[bucket] = at + n
        return bucket, at, True

    def table(self, chunk: int) -> pa.Table:
        pack = zstandard.ZstdCompressor(level=3)
        full = sorted(self.texts)
        return pa.table({
            "bucket": pa.array(full, pa.int32()), "chunk": pa.array([chunk] * len(full), pa.int32()),
            "sizes": pa.array([np.array([len(x) for x in self.texts[b]], "<u4").tobytes() for b in full], pa.binary()),
            "texts": pa.array([pack.compress(b"".join(self.texts[b])) for b in full], pa.binary()),
        })


def _changes(keys: np.ndarray) -> np.ndarray:
    """Where sorted keys begin to be others."""
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    return new


def _dense(keys: np.ndarray) -> np.ndarray:
    """The rank of each key, equal ones alike."""
    order = np.argsort(keys)
    out = np.empty(len(keys), np.uint64)
    out[order] = np.cumsum(_changes(keys[order])) - 1
    return out


class Suffixes:
    """The text of a bucket's runs and the ranks of its cover sample; `ordered` sorts suffixes by them."""

    def __init__(self, text: bytes, length: int):
        self.length = length
        padded = text + bytes(length + PERIOD + NAMED)
        self.words = np.ndarray((len(padded) - WORD + 1,), ">u8", padded, strides=(1,))
        periods = -(-len(text) // PERIOD) + 1
        places = (np.arange(periods)[:, None] * PERIOD + np.array(COVER)).ravel()
        places = places[places < len(text)]
        order, new = self._by_words(places, NAMED)
        names = np.zeros(periods * len(COVER), np.uint64)
        names[order] = np.cumsum(new)  # 0 stands behind the end
        depth, step = NAMED, len(COVER)
        while depth < length:  # names of a prefix and of the place whole periods on: longer names
            after = np.zeros_like(names)
            after[:-step] = names[step:]
            names = _dense(names << np.uint64(32) | after)
            depth, step = depth + step // len(COVER) * PERIOD, 2 * step
        self.ranks = names

    def _word(self, places: np.ndarray) -> np.ndarray:
        return self.words[places].astype(np.uint64)

    def _by_words(self, places: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """The order of places by the first `depth` bytes, and where in it these change. Only ties are looked at further."""
        first = self._word(places)
        order = np.argsort(first)
        new = _changes(first[order])
        at, begins = np.arange(len(places)), new
        for d in range(WORD, depth, WORD):
            tied = ~begins | ~np.append(begins[1:], True)
            at = at[tied]
            if not len(at):
                break
            begins, word = begins[tied], self._word(places[order[at]] + d)
            group = np.cumsum(begins) - 1
            mixed = np.zeros(len(at), bool)
            mixed[group[_changes(word) & ~begins]] = True
            mixed = mixed[group]  # groups whose word is the same throughout stay as they are
            own = at[mixed]
            key = group[mixed].astype(np.uint64) << np.uint64(32) | _dense(word[mixed])
            by = np.argsort(key)
            order[own] = order[own[by]]
            new[own] = _changes(key[by])
            begins = new[at]
        return order, new

    def _rank(self, places: np.ndarray) -> np.ndarray:
        return self.ranks[places // PERIOD * len(COVER) + SLOT[places % PERIOD]]

    def ordered(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The order of suffixes, by `length` bytes at least, and where in it their first `length` bytes change."""
        order, new = self._by_words(places, PERIOD - 1)
        same = ~new  # so far: alike up to the first place where a cover hit may be missing
        left = np.flatnonzero(same | np.append(same[1:], False))
        begins, open_ = new[left], left
        known = np.zeros(len(places), bool)  # alike with the one before, by rank
        while len(open_):
            group = np.cumsum(begins) - 1
            p = places[order[open_]]
            pivot = p[np.flatnonzero(begins)][group]
            k = COMMON[p % PERIOD, pivot % PERIOD]
            a, b = self._rank(p + k), self._rank(pivot + k)
            key = group * 3 + (a > b) + (a >= b)
            by = np.argsort(key, kind="stable")
            order[open_] = order[open_[by]]
            key = key[by]
            begins = _changes(key)
            equal = key % 3 == 1
            known[open_[equal & ~begins]] = True
            more = ~equal & (~begins | ~np.append(begins[1:], True))
            open_, begins = open_[more], begins[more]
        at = np.flatnonzero(same & ~known)
        for d in [*range(PERIOD - 1, self.length - WORD, WORD), self.length - WORD]:  # ranks may tell apart what lies behind `length` bytes
            at = at[self._word(places[order[at]] + d) == self._word(places[order[at - 1]] + d)]
        out = np.ones(len(places), bool)
        out[known] = False
        out[at] = False
        return order, out

    def blocks(self, places: np.ndarray, most: int) -> Iterator[np.ndarray]:
        """The numbers of the places, in blocks of about `most` by the leading two bytes."""
        lead = (self._word(places) >> np.uint64(48)).astype(np.int64)
        ends = np.cumsum(np.bincount(lead, minlength=1 << 16))
        block = ((ends - 1) // most)[lead]
        for k in np.unique(block):
            yield np.flatnonzero(block == k)


def mark(sent: DataFrame, length: int, most: int = SORTED) -> DataFrame:
    """For each bucket and chunk the bits of the suffixes that equal an earlier one: of a smaller chunk, or sent before it by the same."""

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("chunk")
        first, size, ends, kept, seen = [], [], [], [], set()
        for sizes, texts in zip(t["sizes"], t["texts"], strict=True):
            data, at, own = zstandard.ZstdDecompressor().decompress(texts.as_py()), 0, np.frombuffer(sizes.as_py(), "<u4").astype(np.int64)
            for n in own.tolist():
                text = data[at : at + n]
                at += n
                first.append(text not in seen)
                if first[-1]:
                    seen.add(text)
                    kept.append(text)
            size.append(own)
            ends.append(int((own - length + 1).sum()))
        del seen
        size, first = np.concatenate(size), np.array(first)
        again = np.ones(sum(ends), bool)  # a whole run that is known repeats
        n, own = size - length + 1, size[first]
        m = own - length + 1
        places = np.arange(m.sum()) + np.repeat(np.cumsum(own - m) - (own - m), m)
        some = np.zeros(len(places), bool)
        s = Suffixes(b"".join(kept), length)
        del kept
        for block in s.blocks(places, most):
            order, new = s.ordered(places[block])
            at = np.flatnonzero(new)
            least = np.minimum.reduceat(block[order], at)
            some[block] = True
            some[least] = False
        again[np.repeat(first, n)] = some
        bits, a = [], 0
        for e in ends:
            bits.append(np.packbits(again[a : a + e]).tobytes())
            a += e
        return pa.table({"chunk": t["chunk"], "bucket": t["bucket"], "bits": pa.array(bits, pa.binary())})

    return sent.groupBy("bucket").applyInArrow(run, MARKS)


class Chunk:
    """A chunk's documents by (doc_id, text), some megabytes at a time."""

    def __init__(self, t: pa.Table, length: int):
        self.table = t.sort_by([("doc_id", "ascending"), ("text", "ascending")])
        self.length, self.sampled = length, length - PERIOD + 1
        self.texts = R.texts(self.table)
        self.number = t["chunk"][0].as_py()
        self.lots, held, lot = [], 0, []
        for i, x in enumerate(self.texts):
            lot.append(i)
            held += len(x)
            if held >= BATCH:
                self.lots.append(lot)
                held, lot = 0, []
        if lot:
            self.lots.append(lot)
        self.cover = np.zeros(PERIOD, bool)
        self.cover[list(COVER)] = True
        self.whole = np.array([self._fingerprint(x) for x in self.texts], np.uint64)

    def _fingerprint(self, x: bytes) -> int:
        """Of a whole text; all texts too short to hold a repeat differ."""
        return int.from_bytes(hashlib.blake2b(x, digest_size=8).digest(), "little") or 1 if len(x) >= self.length else 0

    def joined(self, lot: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The lot's buffer, each place's offset in its text, and how many bytes of the text follow from it."""
        buf, at = H.join([self.texts[i] for i in lot])
        size = np.diff(at)
        offset = np.arange(len(buf)) - np.repeat(at[:-1], size)
        return buf, offset, np.repeat(size - 1, size) - offset

    def samples(self, lot: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """The places of the lot's buffer that are in the sample, and the hashes of the sampled bytes there."""
        buf, offset, after = self.joined(lot)
        places = np.flatnonzero(self.cover[offset % PERIOD] & (after >= self.sampled))
        return places, H.at(buf, places, self.sampled)

    def names(self, sampled: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        """The distinct sample hashes and whole-text fingerprints, sorted, and their counts."""
        return np.unique(np.concatenate([*(h for _, h in sampled), self.whole[self.whole > 0]]), return_counts=True)

    def runs(self, marks: pa.Table, buckets: int, into: Runs) -> Iterator[tuple[list[int], list[tuple[int, int, int, int, bool]], np.ndarray]]:
        """Lot by lot: its documents; its runs of suffixes that can repeat, as (place, number, bucket, place in the bucket, first of its kind);
        and which documents are whole copies of earlier ones, which have no runs."""
        sampled = [self.samples(lot) for lot in self.lots]
        u, counts = self.names(sampled)
        again = R.flags(u, marks, buckets, "other") | (counts > 1)
        earlier = R.flags(u, marks, buckets, "earlier")
        seen: set[int] = set()
        width = self.length - GRAM + 1
        for lot, (places, h) in zip(self.lots, sampled, strict=True):
            buf, _, after = self.joined(lot)
            hit = np.zeros(len(buf) + PERIOD + 1, np.int32)
            hit[places + 1] = again[np.searchsorted(u, h)]
            np.cumsum(hit, out=hit)
            may = (hit[PERIOD : len(buf) + PERIOD] > hit[: len(buf)]) & (after >= self.length)
            copy = np.zeros(len(lot), bool)
            for k, i in enumerate(lot):
                f = int(self.whole[i])
                if f:
                    copy[k] = f in seen or bool(earlier[np.searchsorted(u, self.whole[i])])
                    seen.add(f)
            if copy.any():
                _, at = H.join([self.texts[i] for i in lot])
                for k in np.flatnonzero(copy):
                    may[at[k] : at[k + 1]] = False
            where, found = np.flatnonzero(may), []
            if len(where):
                least = smallest(H.grams(buf, GRAM), width)[where]
                new = np.flatnonzero(np.concatenate([[True], (where[1:] != where[:-1] + 1) | (least[1:] != least[:-1])]))
                data = buf.tobytes()
                bucket = (H.mix(least[new].astype(np.uint64)) >> np.uint64(32)) * np.uint64(into.buckets) >> np.uint64(32)
                bucket = bucket.tolist()
                for a, n, b in zip(where[new].tolist(), np.diff(np.append(new, len(where))).tolist(), bucket, strict=True):
                    found.append((a, n, *into.add(b, data[a : a + n + self.length - 1], n)))
            yield lot, found, copy


def _names(docs: DataFrame, length: int, plan: R.Layout, id_col: str, text_col: str) -> DataFrame:
    def emit(t: pa.Table) -> pa.Table:
        c = Chunk(t, length)
        return R.blocks(c.number, c.names([c.samples(lot) for lot in c.lots])[0] if c.number >= 0 else np.zeros(0, np.uint64), plan.buckets)

    base = R.chunked(docs, plan, id_col, text_col)
    return cut(R.answers(base.groupBy("chunk").applyInArrow(emit, R.BLOCK)), "op9-names")


def _repeats(docs: DataFrame, names: DataFrame, length: int, plan: R.Layout, id_col: str, text_col: str) -> DataFrame:
    def emit(t: pa.Table, marks: pa.Table) -> pa.Table:
        into, number = Runs(plan.buckets), 0
        if t.num_rows:
            c = Chunk(t, length)
            number = c.number
            for _ in c.runs(marks, plan.buckets, into) if number >= 0 else ():
                pass
        return into.table(number)

    base = R.chunked(docs, plan, id_col, text_col)
    sent = base.groupBy("chunk").cogroup(names.groupBy("chunk")).applyInArrow(emit, RUNS)
    return cut(mark(sent, length), "op9-repeats")


def remove_repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Remove every byte covered by a string of `length` bytes that also starts earlier: in a smaller doc_id, or before it in the same document.

    Whole texts are read as UTF-8; matches never cross documents; overlapping matches count; strings are judged on the
    input, not on what is left. Strings are compared, not hashes; but a document that equals an earlier one goes by its fingerprint alone,
    which two different documents share with probability 2**-64 a pair. `length` must be over 57.

    Returns doc_id, n_bytes, n_removed, spans (array of [start, stop) byte places, maximal), kept (binary: what is left may cut a
    character) and row (a struct of all other input columns). Null and empty texts have no bytes. Texts shorter than
    `length` lose nothing. Rows that repeat an id are one document, in the order of their texts; each comes back. Rows with a null id
    are neither compared nor changed. Other columns, whatever their names, come back in row. A chunk holds its documents whole, so the
    longest text bounds what a task holds.
    """
    if length <= PERIOD:
        raise ValueError(f"length must be over {PERIOD}")
    spark = docs.sparkSession
    plan = R.layout(docs, id_col, text_col)
    names = _names(docs, length, plan, id_col, text_col)
    release(spark)
    repeats = _repeats(docs, names, length, plan, id_col, text_col)
    release(spark)
    marks = names.unionByName(repeats, allowMissingColumns=True)
    base = R.chunked(docs, plan, id_col, text_col, carry=True)
    span = T.StructType([T.StructField("start", T.LongType()), T.StructField("stop", T.LongType())])
    out = T.StructType([
        T.StructField("doc_id", T.LongType()), T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()),
        T.StructField("spans", T.ArrayType(span)), T.StructField("kept", T.BinaryType()), base.schema["row"],
    ])

    def resolve(t: pa.Table, marks: pa.Table) -> pa.Table:
        if not t.num_rows:
            return pa.table({n: pa.array([]) for n in ("doc_id", "n_bytes", "n_removed", "spans", "kept", "row")})
        c = Chunk(t, length)
        removed, spans, kept = [0] * len(c.texts), [[] for _ in c.texts], list(c.texts)
        again = {b: np.unpackbits(np.frombuffer(x, np.uint8)) for b, x in zip(marks["bucket"].to_pylist(), marks["bits"].to_pylist(), strict=True) if x is not None}
        marks = marks.filter(pc.is_valid(marks["other"]))
        for lot, found, copy in c.runs(marks, plan.buckets, Runs(plan.buckets)) if c.number >= 0 else ():
            _, at = H.join([c.texts[i] for i in lot])
            step = np.zeros(int(at[-1]) + 1, np.int32)
            for place, n, bucket, first, new in found:
                if new:
                    later = np.flatnonzero(again[bucket][first : first + n]) + place
                    step[later] += 1
                    step[later + length] -= 1
                else:  # its suffixes stand in an earlier run
                    step[place] += 1
                    step[place + n + length - 1] -= 1
            covered = np.cumsum(step[:-1]) > 0
            for j in np.flatnonzero(copy):
                covered[at[j] : at[j + 1] - 1] = True
            some = np.concatenate([[0], np.cumsum(covered)])
            for j in np.flatnonzero(some[at[1:]] > some[at[:-1]]):
                i, text = lot[j], c.texts[lot[j]]
                mask = covered[at[j] : at[j + 1] - 1]
                edge = np.diff(mask.view(np.int8), prepend=0, append=0)
                a, b = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
                removed[i] = int((b - a).sum())
                spans[i] = [{"start": int(x), "stop": int(y)} for x, y in zip(a, b, strict=True)]
                kept[i] = b"".join(text[x:y] for x, y in zip([0, *b], [*a, len(text)], strict=True))
        return pa.table({
            "doc_id": c.table["doc_id"], "n_bytes": pa.array([len(x) for x in c.texts], pa.int64()), "n_removed": pa.array(removed, pa.int64()),
            "spans": pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))), "kept": pa.array(kept, pa.binary()), "row": c.table["row"],
        })

    return base.groupBy("chunk").cogroup(marks.groupBy("chunk")).applyInArrow(resolve, out)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9: doc_id, n_bytes, n_removed, n_spans and the digest of the bytes left."""
    out = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS n FROM documents),
s AS (SELECT doc_id, i, md5(substr(h, 2 * i + 1, 200)) AS k FROM (SELECT doc_id, h, unnest(generate_series(0, n - 100)) AS i FROM d WHERE n >= 100)),
dup AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS r FROM s) WHERE r > 1),
g AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER w + 100 THEN 0 ELSE 1 END AS new FROM dup WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
run AS (SELECT doc_id, no, min(i) AS a, max(i) + 100 AS b FROM (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS no FROM g) GROUP BY doc_id, no),
cut AS (SELECT doc_id, a, b, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS c FROM run),
per AS (SELECT doc_id, sum(b - a) AS gone, count(*) AS runs, max(b) AS last, string_agg(substr(h, 2 * c + 1, 2 * (a - c)), '' ORDER BY a) AS kept FROM cut JOIN d USING (doc_id) GROUP BY doc_id)
SELECT d.doc_id, n AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, CAST(coalesce(runs, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN per USING (doc_id)
"""
