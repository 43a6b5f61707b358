"""Toxicity: multiple-instance learning; sentence scores combined by noisy-or, trained from document labels."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _hashing as H
from ._store import spread

#: Bounds of the labelled sample that the model is fitted on: documents, and bytes of each of them.
SAMPLE_DOCS = 8000
SAMPLE_BYTES = 1 << 16
THRESHOLD = 0.3
#: Features of a word besides itself: its first so many bytes.
PREFIXES = (4, 5, 6)

#: A word is a run of ASCII letters, digits and bytes beyond ASCII; these bytes end a sentence.
GAP = np.ones(256, bool)
GAP[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
STOP = np.zeros(256, bool)
STOP[[0x0A, 0x21, 0x2E, 0x3F]] = True
SLOTS = 22
#: A feature starts with a weight of so many standard deviations of its label-1 texts beyond START_Z, at most START_W.
START_Z, START_W = 4.0, 5.0


@dataclass
class Model:
    """Sorted feature hashes, their weights, and the weight of an empty sentence."""

    keys: np.ndarray
    weights: np.ndarray
    bias: float

    def slots(self) -> np.ndarray:
        table = np.zeros(1 << SLOTS, bool)
        table[self.keys >> np.uint64(64 - SLOTS)] = True
        return table


def _fold(part: np.ndarray) -> np.ndarray:
    """Lower case for ASCII and for the Latin-1 letters in UTF-8."""
    out = H.LOWER[part]
    after = np.flatnonzero(part[:-1] == 0xC3) + 1
    out[after] += np.where((part[after] >= 0x80) & (part[after] <= 0x9E) & (part[after] != 0x97), 32, 0).astype(np.uint8)
    return out


def _features(buf: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Slice by slice: the place of each word in the buffer, and a row of feature hashes for each word."""
    for a, b in H._slices(buf):
        part = _fold(buf[a:b])
        edge = np.diff(GAP[part].view(np.int8), prepend=1, append=1)
        first, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        if not len(first):
            continue
        power, inverse = H._powers(b - a + 1)
        sums = np.zeros(b - a + 1, np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * power[: b - a], out=sums[1:])
        rows = [H.mix((sums[end] - sums[first]) * inverse[first])]
        for k in PREFIXES:
            cut = np.minimum(first + k, end)
            rows.append(H.mix((sums[cut] - sums[first]) * inverse[first] + np.uint64(k << 40)))
        yield first + a, np.stack(rows)


def _find(keys: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The place of each hash in the sorted keys, and whether it is there."""
    k = np.searchsorted(keys, h)
    k[k == len(keys)] = 0
    return k, keys[k] == h if len(keys) else np.zeros(len(h), bool)


def _sentences(buf: np.ndarray) -> np.ndarray:
    """The places where sentences end."""
    return np.flatnonzero(STOP[buf])


def score_texts(texts: list[bytes], model: Model, slots: np.ndarray) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """Each text's noisy-or score; and for each text the start, end and score of its sentences."""
    buf, at = H.join(texts)
    stops = _sentences(buf)
    n = max(1, len(model.keys))
    found, worded = [np.zeros(0, np.int64)], np.zeros(len(stops), bool)
    for place, rows in _features(buf):
        own = np.searchsorted(stops, place)
        worded[own] = True
        for h in rows if len(model.keys) else ():
            may = np.flatnonzero(slots[h >> np.uint64(64 - SLOTS)])
            k, hit = _find(model.keys, h[may])
            found.append(own[may[hit]] * n + k[hit])
    found = np.unique(np.concatenate(found))  # a feature counts once in a sentence
    z = model.bias + np.bincount(found // n, weights=model.weights[found % n] if len(found) else None, minlength=len(stops))
    s = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    begin = np.concatenate([[0], stops[:-1] + 1]) if len(stops) else stops
    first = np.searchsorted(stops, at)  # a text's last byte in the buffer is a line feed: it always ends a sentence
    count = np.concatenate([[0], np.cumsum(worded)])
    worded[first[:-1][count[first[1:]] == count[first[:-1]]]] = True  # a text without words has one sentence, an empty one
    logs = np.concatenate([[0], np.cumsum(np.log1p(-np.minimum(s, 1 - 1e-12)) * worded)])
    p = -np.expm1(logs[first[1:]] - logs[first[:-1]])
    per = [(begin[i:j] - o, stops[i:j] - o, s[i:j]) for i, j, o in zip(first[:-1], first[1:], at[:-1], strict=True)]
    return np.clip(p, 0, 1), per


def slopes(z: np.ndarray, off: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """The derivative of the documents' log loss by each sentence's z; off tells where a document's sentences start, and the end."""
    score = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    logs = np.concatenate([[0], np.cumsum(np.log1p(-np.minimum(score, 1 - 1e-9)))])
    p = np.clip(-np.expm1(logs[off[1:]] - logs[off[:-1]]), 1e-6, 1)
    return score * np.repeat(np.where(labels == 1, -(1 - p) / p, 1.0), np.diff(off))


def fit(texts: list[bytes], labels: np.ndarray, least: int = 3, epochs: int = 12, batch: int = 128, rate: float = 0.25, decay: float = 1e-5) -> Model:
    """Noisy-or over sentences, by AdaGrad on the documents' log loss.

    A sentence's score is sigmoid(bias + sum of its features' weights); a document is toxic unless no sentence is:
    p = 1 - prod(1 - s). With label 0 every sentence is pushed down by s; with label 1 the push up,
    s * (1 - p) / p, goes to the sentences that already explain the label. Features seen in fewer than `least`
    texts are left out; those much likelier in texts of label 1 start with a positive weight. Without texts of both labels the model is the share of
    label 1, drawn towards a tenth by five more texts, so that one or two of them reject nothing.
    """
    share = float(labels.mean()) if len(labels) else 0.5
    if not len(texts) or share in (0.0, 1.0):
        share = (float(labels.sum()) + 0.5) / (len(labels) + 5)
        return Model(np.zeros(0, np.uint64), np.zeros(0), float(np.log(share / (1 - share))))
    keys, counts, fresh = np.zeros(0, np.uint64), np.zeros((2, 0)), []
    for i, t in enumerate(texts):  # features are counted first and made again below: those of all texts would not fit
        own = np.unique(np.concatenate([rows.ravel() for _, rows in _features(H.join([t])[0])] or [keys[:0]]))
        fresh.append((own, np.full(len(own), labels[i])))
        if i % 500 == 499 or i == len(texts) - 1:
            both, back = np.unique(np.concatenate([keys, *(x for x, _ in fresh)]), return_inverse=True)
            y = np.concatenate([x for _, x in fresh])
            counts = np.stack([np.bincount(back, weights=np.concatenate([counts[v], y == v]), minlength=len(both)) for v in (0, 1)])
            keys, fresh = both, []
    often = counts.sum(0) >= least
    keys, counts = keys[often], counts[:, often]
    index = []
    for t in texts:
        buf, _ = H.join([t])
        stops = _sentences(buf)
        found, worded = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for place, rows in _features(buf):
            own = np.searchsorted(stops, place)
            worded.append(own)
            for h in rows:
                k, ok = _find(keys, h)
                found.append(own[ok] * len(keys) + k[ok])
        found, worded = np.unique(np.concatenate(found)), np.unique(np.concatenate(worded))  # sentences without words don't count
        n = max(1, len(keys))
        index.append((np.searchsorted(worded, found // n).astype(np.int32), (found % n).astype(np.int32), max(1, len(worded))))
    sentences = sum(n for _, _, n in index)
    total = counts.sum(0)
    excess = (counts[1] - total * share) / np.sqrt(total * share * (1 - share))
    w, g2 = np.clip(excess - START_Z, 0, START_W), np.full(len(keys), 1e-2)
    bias, b2 = float(np.log(max(1e-6, share * len(texts) / sentences))), 1e-2
    rng = np.random.default_rng(0)
    for _ in range(epochs):
        order = rng.permutation(len(index))
        for a in range(0, len(order), batch):
            own = order[a : a + batch]
            sizes = np.array([index[i][2] for i in own])
            off = np.concatenate([[0], np.cumsum(sizes)])
            s = np.concatenate([index[i][0] + o for i, o in zip(own, off, strict=False)])
            k = np.concatenate([index[i][1] for i in own])
            d = slopes(bias + np.bincount(s, weights=w[k], minlength=off[-1]), off, labels[own])
            grad = np.bincount(k, weights=d[s], minlength=len(w)) / len(own)
            hit = np.flatnonzero(grad)
            g2[hit] += grad[hit] ** 2
            w[hit] -= rate * (grad[hit] / np.sqrt(g2[hit]) + decay * w[hit])
            db = float(d.sum()) / len(own)
            b2 += db * db
            bias -= rate * db / b2**0.5
    keep = np.abs(w) > 0.02
    return Model(keys[keep], w[keep], bias)


def sample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_docs: int = SAMPLE_DOCS, sample_bytes: int = SAMPLE_BYTES) -> tuple[list[bytes], np.ndarray]:
    """At most sample_docs labelled texts of at most sample_bytes bytes, chosen by a hash of their ids; the larger of contradicting labels counts."""
    rows = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("doc_id")).agg(F.max(F.col(label_col)).cast("int").alias("y"))
    few = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs)
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text")).where(F.octet_length("text") <= sample_bytes)
    got = own.join(F.broadcast(few), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(sample_docs).collect()
    return [bytes(r["text"]) for r in got], np.array([r["y"] for r in got], np.int64)


def score(docs: DataFrame, model: Model, text_col: str = "text", least: float = 0.1) -> DataFrame:
    """docs with `score` (0 to 1) and `offending`: start, end (bytes) and score of each sentence that scores at least `least`.

    Whole texts are read, slice by slice. A null text scores as an empty one; both get the score of a single
    empty sentence, so empty texts have a score too. Rows come back once each, repeated or not; columns of docs that
    are named score or offending are replaced.
    """
    keep = [c for c in docs.columns if c not in ("score", "offending")]
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast((model.keys, model.weights, model.bias))
    spans = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(*sent.value)
        slots = m.slots()
        for whole in batches:
            for a in range(0, whole.num_rows, 256):
                b = whole.slice(a, 256)
                texts = [x.as_buffer().to_pybytes() if x.is_valid else b"" for x in b.column(text_col)]
                p, per = score_texts(texts, m, slots)
                bad = [[{"start": int(x), "stop": int(y), "score": float(z)} for x, y, z in zip(*(v[s >= least] for v in (i, j, s)), strict=True)] for i, j, s in per]
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(p, pa.float64()), pa.array(bad, spans)], [*keep, "score", "offending"])

    fields = spread(docs.select(*(F.col(f"`{c}`") for c in keep)))
    schema = T.StructType([*fields.schema, *T.StructType.fromDDL("score double, offending array<struct<start:bigint,stop:bigint,score:double>>")])
    return fields.mapInArrow(run, schema)


def held_out(id_col: str = "doc_id"):
    """Rows whose labels may not be learnt from."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2


def train(docs: DataFrame, labels: DataFrame) -> Model:
    return fit(*sample(docs, labels.where(~held_out())))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2: every document's score by a model that has not seen the held-out labels."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = score(docs, model)
    return out.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), F.size("offending").alias("n_offending"))
