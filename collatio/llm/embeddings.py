"""Embedding near-dedup: spherical k-means deals vectors to cells, blocked cosine products compare within cells."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._components import components
from ._store import cut, drop, width

THRESHOLD = 0.98
#: Vectors that the cells' centres are fitted on, chosen by a hash of their ids; every vector is dealt and compared.
SAMPLE = 20_000
#: Distinct vectors to a cell, about; and centres over all labels, which bounds what is broadcast. With more than CELL * CENTRES distinct
#: vectors cells grow, and products with them, while results stay whole.
CELL, CENTRES = 1500, 4096
#: Vectors to a side of a block of products.
SIDE = 1024


def unit(x: np.ndarray) -> np.ndarray:
    """The rows of x with length 1. Rows are divided by their largest component first, so that no finite one overflows or vanishes."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def kmeans(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means: k unit centres for the unit rows of x, started from rows far from each other."""
    centres = x[:1]
    near = x @ centres[0]
    while len(centres) < min(k, len(x)):
        i = int(np.argmin(near))
        centres = np.vstack([centres, x[i]])
        near = np.maximum(near, x @ x[i])
    for _ in range(rounds):
        own = np.argmax(x @ centres.T, axis=1)
        for c in range(len(centres)):
            s = x[own == c].sum(axis=0)
            if np.linalg.norm(s) > 0:
                centres[c] = s / np.linalg.norm(s)
    return centres


def fit(vectors: DataFrame, sample: int = SAMPLE, cell: int = CELL, centres: int = CENTRES) -> dict[tuple[int, int], np.ndarray]:
    """Centres by (label, dimension), for the largest labels that need more than one cell, from a bounded sample."""
    sizes = vectors.groupBy("label", F.size("vec").alias("dim")).count().where(F.col("count") > cell).orderBy(F.desc("count"), "label", "dim").limit(centres // 2).collect()
    want, left = {}, centres
    for r in sizes:
        k = min(math.ceil(r["count"] / cell), max(0, left))
        if k > 1:
            want[r["label"], r["dim"]], left = k, left - k
    if not want:
        return {}
    rows = vectors.orderBy(F.xxhash64("id"), "id").limit(sample).select("label", "vec").collect()
    out = {}
    for (label, dim), k in want.items():
        x = np.array([r["vec"] for r in rows if r["label"] == label and len(r["vec"]) == dim], np.float64)
        if len(x) >= 2:
            out[label, dim] = kmeans(unit(x), min(k, max(2, len(x) // 4)))
    return out


def near(embeddings: DataFrame, threshold: float = THRESHOLD, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", side: int = SIDE) -> DataFrame:
    """Every row's id with n_links (other vectors linked directly), component_id and kept.

    Vectors with equal, not null labels and equal dimensions link when their cosine in double precision is at least
    the threshold. Equal vectors of a label are one class from the start, so copies never meet each other. Class members go to the cell of
    their nearest centre, and as guests to every cell whose border with their own lies within the threshold's angle: a vector in
    another cell that could reach the threshold lies beyond that border, so no link is lost (recall is 1, whatever the
    centres). A cell's vectors and guests meet in blocks of products of at most about side x side, so a hot cell becomes many tasks,
    and a block returns counts and a forest of its links, not pairs.

    Vectors that are null, empty, zero, or hold a null or non-finite component, and rows with a null label or id, link with
    nothing: 0 links, their own id, kept. Rows that repeat an id and a vector count as links of each other. Extra
    columns are ignored. An empty table gives an empty table.
    """
    v = F.col(vec_col).cast("array<double>")
    whole = F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    base = embeddings.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), v.alias("vec"), F.coalesce(whole, F.lit(False)).alias("whole"))
    base = base.withColumns({"h1": F.xxhash64("vec"), "h2": F.hash("vec")})
    good = base.where("whole")
    keys = ["label", "h1", "h2"]
    classes = cut(good.groupBy(*keys).agg(F.min("id").alias("rep"), F.count("*").alias("weight")), "op4-classes")
    reps = good.join(classes, keys).where("id = rep").groupBy("id", "weight", *keys).agg(F.first("vec").alias("vec"))
    reps = cut(reps, "op4-vectors")
    centres = fit(reps)
    spark = embeddings.sparkSession
    sent = spark.sparkContext.broadcast(centres)
    sine = math.sqrt(max(0.0, 1 - threshold * threshold)) + 1e-9

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple[int, int, bool]] = []
            labels = b.column("label").to_pylist()
            vec = b.column("vec")
            at = vec.offsets.to_numpy()
            flat = vec.values.to_numpy()
            groups: dict[tuple[int, int], list[int]] = {}
            for i, label in enumerate(labels):
                groups.setdefault((label, int(at[i + 1] - at[i])), []).append(i)
            for key, own in groups.items():
                c = sent.value.get(key)
                if c is None:
                    rows += [(i, 0, True) for i in own]
                    continue
                x = unit(np.stack([flat[at[i] : at[i + 1]] for i in own]))
                sims = x @ c.T
                home = np.argmax(sims, axis=1)
                apart = np.sqrt(np.maximum(0, 2 - 2 * c @ c.T))[home]
                reach = sims[np.arange(len(own)), home][:, None] - sims <= sine * apart + 1e-9
                rows += [(own[i], int(j), bool(j == home[i])) for i, j in zip(*np.nonzero(reach), strict=True)]
            rows.sort()
            take = pa.array([r[0] for r in rows], pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(n).take(take) for n in ("id", "label", "weight", "vec")), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.bool_())], ["id", "label", "weight", "vec", "cell", "home"])

    dealt = reps.select("id", "label", "weight", "vec").mapInArrow(deal, "id bigint, label bigint, weight bigint, vec array<double>, cell int, home boolean")
    dealt = cut(dealt.withColumn("dim", F.size("vec")), "op4-dealt")
    cell = ["label", "dim", "cell"]
    sizes = cut(dealt.groupBy(*cell).agg(F.count_if("home").alias("homes"), F.count("*").alias("all")), "op4-cells")
    own = dealt.join(sizes, cell).withColumns({"t_blocks": F.ceil(F.col("homes") / side).cast("int"), "q_blocks": F.ceil(F.col("all") / side).cast("int")})
    t, q = F.pmod(F.xxhash64("id"), F.col("t_blocks")).cast("int"), F.pmod(F.xxhash64("id", F.lit(1)), F.col("q_blocks")).cast("int")
    targets = own.where("home").select(*cell, "id", "weight", "vec", t.alias("t"), F.explode(F.sequence(F.lit(0), F.col("q_blocks") - 1)).alias("q"), F.lit(True).alias("target"))
    queries = own.where("t_blocks > 0").select(*cell, "id", "weight", "vec", F.explode(F.sequence(F.lit(0), F.col("t_blocks") - 1)).alias("t"), q.alias("q"), F.lit(False).alias("target"))
    blocks = targets.unionByName(queries)

    def products(t: pa.Table) -> pa.Table:
        is_target = t["target"].to_numpy(zero_copy_only=False)
        ids, weights = t["id"].to_numpy(), t["weight"].to_numpy()
        x = unit(np.array(t["vec"].combine_chunks().values.to_numpy(), np.float64).reshape(len(ids), -1))
        a, b = np.flatnonzero(~is_target), np.flatnonzero(is_target)
        links = np.zeros(len(a), np.int64)
        low_b = ids[b].copy()
        low_a = ids[a].copy()
        hits = []
        for i in range(0, len(a), side):
            hit = x[a[i : i + side]] @ x[b].T >= threshold
            hit &= ids[a[i : i + side]][:, None] != ids[b][None, :]
            links[i : i + side] = hit @ weights[b]
            hits.append(hit)
        again = len(b) > 0
        while again:
            again = False
            for i, hit in zip(range(0, len(a), side), hits, strict=True):
                most = np.iinfo(np.int64).max
                la = np.minimum(low_a[i : i + side], np.where(hit, low_b[None, :], most).min(axis=1))
                lb = np.minimum(low_b, np.where(hit, la[:, None], most).min(axis=0))
                again |= bool((la != low_a[i : i + side]).any() or (lb != low_b).any())
                low_a[i : i + side], low_b = la, lb
        qa, tb = np.flatnonzero(links), np.flatnonzero(low_b != ids[b])
        return pa.table({"id": np.concatenate([ids[a[qa]], ids[b[tb]]]), "links": np.concatenate([links[qa], np.zeros(len(tb), np.int64)]), "root": np.concatenate([low_a[qa], low_b[tb]])})

    found = cut(blocks.repartition(width(spark), *cell, "t", "q").groupBy(*cell, "t", "q").applyInArrow(products, "id bigint, links bigint, root bigint"), "op4-found")
    linked = found.groupBy("id").agg(F.sum("links").alias("links")).where("links > 0")
    comp = components(found.where("id <> root").select(F.col("id").alias("a"), F.col("root").alias("b")))
    per = classes.join(linked, classes["rep"] == linked["id"], "left").drop("id").join(comp, F.col("rep") == comp["id"], "left")
    per = cut(per.select(*keys, (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n"), F.coalesce("component", "rep").alias("c")), "op4-per-class")
    for done in (reps, dealt, sizes, found):
        drop(spark, done)
    out = good.select("id", *keys).join(per, keys).select("id", "n", "c").unionByName(base.where("not whole").select("id", F.lit(0).cast("long").alias("n"), F.col("id").alias("c")))
    return out.select(F.col("id").alias("vec_id"), F.col("n").alias("n_links"), F.col("c").alias("component_id"), F.col("id").eqNullSafe(F.col("c")).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4: links, component and whether kept, for every vector."""
    return near(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
good AS (SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
         AND len(list_filter(e, lambda x: x <> 0)) > 0),
link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
         WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
reach AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a),
comp AS (SELECT a, min(b) AS c FROM reach GROUP BY a),
n AS (SELECT a, count(*) AS n FROM link GROUP BY a)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, c AS component_id, vec_id = c AS kept
FROM v JOIN comp ON comp.a = vec_id LEFT JOIN n ON n.a = vec_id
"""
