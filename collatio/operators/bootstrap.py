"""Bootstrap intervals of ratios of sums."""

from __future__ import annotations

from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import cut
from .facts import numbered

RESAMPLES, ALPHA = 1000, 0.05
#: Draws that are held at once.
DRAWS = 1 << 21
#: Rows of a group that one task resamples; a group of more is dealt to several.
BLOCK = 1 << 19
_MASK, _P1, _P2, _P3, _P5 = (1 << 64) - 1, *map(np.uint64, (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5))


def interval(facts: DataFrame, keys: list[str], num: str, den: str, order: str, n: int = RESAMPLES, seed: int = 0, alpha: float = ALPHA) -> DataFrame:
    """(.., rate, lo, hi) over the rows of each group, resampled n times as a whole by a seeded generator: `intervals` of one ratio."""
    out = intervals(facts, keys, {"rate": (num, den)}, order, n, seed, alpha)
    return out.select(*keys, "rate", F.col("rate_lo").alias("lo"), F.col("rate_hi").alias("hi"))


def intervals(facts: DataFrame, keys: list[str], ratios: dict[str, tuple[str, str]], order: str, n: int = RESAMPLES, seed: int = 0, alpha: float = ALPHA) -> DataFrame:
    """(.., name, name_lo, name_hi for each ratio) over the rows of each group, all ratios by the same draws.

    The draws depend on the number and order of the rows, so they are sorted by `order`; a resample without a
    denominator is left out. Fewer than two rows give the rate thrice, no denominator three nulls. Resamples are drawn some at a time, which
    gives the same draws as all at once. A group of more than BLOCK rows is dealt to blocks of neighbours, a task each: how many
    of a resample's draws fall into a block is multinomial, and within it they are uniform, which is the law of drawing from all rows.
    Only n sums a block are shuffled.
    """
    columns = [f"{name}{side}" for name in ratios for side in ("", "_lo", "_hi")]
    names = [c for pair in ratios.values() for c in pair]
    sides = [f"s{i}" for i in range(len(names))]
    block, size, place, most = "b__block", "b__size", "b__place", BLOCK
    rows = facts.select(*keys, order, *(F.col(c).cast("double").alias(s) for c, s in zip(names, sides, strict=True)))
    sizes = facts.groupBy(*keys).agg(F.count("*").alias(size))
    rows, sizes = cut(rows, "resampled"), cut(sizes, "sizes")
    same = lambda x, y: reduce(and_, (x[k].eqNullSafe(y[k]) for k in keys), F.lit(True))
    sized = lambda df, some: df.join(F.broadcast(some), same(df, some)).select(df["*"], some[size])  # noqa: E731 - groups are few
    few, many = sizes.where(F.col(size) <= most), sizes.where(F.col(size) > most)
    dealt = sized(rows, few).withColumn(block, F.lit(0).cast("long"))
    if not many.isEmpty():
        kinds = sized(rows, many)
        placed = numbered(kinds, [*keys], [F.col(order), *map(F.col, sides)], place)
        dealt = dealt.unionByName(placed.withColumn(block, F.floor(F.col(place) / most)).drop(place))

    def one(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(order, kind="stable")
        own, total = int(part[block].iloc[0]), int(part[size].iloc[0])
        v = [part[s].to_numpy(float) for s in sides]
        held, sums = len(part), np.zeros((len(v), n))
        if total > held:
            rng = np.random.default_rng([seed, own])
            for r, k in enumerate(_falls(total, own, n, seed, most)):
                drawn = np.bincount(rng.integers(0, held, k, np.uint32), minlength=held).astype(float)
                sums[:, r] = [drawn @ x for x in v]
        else:
            rng = np.random.default_rng(seed)
            step = max(1, DRAWS // held)
            for a in range(0, n if held > 1 else 0, step):
                for r, idx in enumerate(rng.integers(0, held, (min(step, n - a), held), np.uint32), a):
                    drawn = np.bincount(idx, minlength=held).astype(float)
                    sums[:, r] = [drawn @ x for x in v]
        out = pd.DataFrame({k: [part[k].iloc[0]] for k in keys} | {size: [total], "whole": [[float(x.sum()) for x in v]]} | {s: [list(x)] for s, x in zip(sides, sums, strict=True)})
        return out

    def band(parts: pd.DataFrame) -> pd.DataFrame:
        whole = np.sum([np.asarray(x) for x in parts["whole"]], axis=0)
        sums = [np.sum([np.asarray(x) for x in parts[s]], axis=0) for s in sides]
        got = []
        for i in range(0, len(sides), 2):
            x, y = whole[i], whole[i + 1]
            if y <= 0:
                got += [None] * 3
            elif parts[size].iloc[0] < 2:
                got += [x / y] * 3
            else:
                some = sums[i + 1] != 0
                got += [x / y, *np.percentile(sums[i][some] / sums[i + 1][some], [100 * alpha / 2, 100 * (1 - alpha / 2)])]
        return pd.DataFrame([[*(parts[k].iloc[0] for k in keys), *got]], columns=[*keys, *columns])

    types = dict(facts.dtypes)
    own = [f"`{k}` {types[k]}" for k in keys]
    made = dealt.groupBy(*keys, block).applyInPandas(one, ", ".join([*own, f"{size} bigint", "whole array<double>", *(f"{s} array<double>" for s in sides)]))
    return made.groupBy(*keys).applyInPandas(band, ", ".join([*own, *(f"`{c}` double" for c in columns)]))


def _falls(total: int, block: int, n: int, seed: int, most: int) -> np.ndarray:
    """How many draws of each resample of `total` rows fall into a block: halved down to it, each half's number binomial by a seed of its own, so that every block's task finds the same halves."""
    low, high = 0, -(-total // most)
    drawn = np.full(n, total, np.int64)
    while high - low > 1:
        mid = (low + high) // 2
        share = (mid - low) * most / (min(high * most, total) - low * most)
        left = np.random.default_rng([seed, low, high, 1]).binomial(drawn, share)
        low, high, drawn = (low, mid, left) if block < mid else (mid, high, drawn - left)
    return drawn


def poisson(facts: DataFrame, keys: list[str], num: str, den: str, row: str, n: int = RESAMPLES, alpha: float = ALPHA) -> DataFrame:
    """The same interval without a group in one task: every row counts a Poisson(1) number of times in each resample.

    The number comes from a hash of (row, resample) through the distribution function, so it is the same on every attempt. Rows are
    counted by arrays in a task, which gives n partial sums a group, whatever the number of rows; only those are shuffled.
    """
    row_hash, types = "p__hash", dict(facts.dtypes)
    rows = facts.select(*keys, F.xxhash64(row).alias(row_hash), F.col(num).cast("double").alias("p__x"), F.col(den).cast("double").alias("p__y"))
    shape = ", ".join([*(f"`{k}` {types[k]}" for k in keys), "rep int", "x double", "y double"])

    def count(batches):
        sums: dict[tuple, np.ndarray] = {}
        for batch in batches:
            members = [batch.column(i).to_pylist() for i in range(len(keys))]
            h, x, y = (batch.column(len(keys) + i) for i in range(3))
            h = h.to_numpy(zero_copy_only=False).view(np.uint64)
            v = np.column_stack([c.fill_null(0).to_numpy(zero_copy_only=False) for c in (x, y)])
            where: dict[tuple, list[int]] = {}
            for i, k in enumerate(zip(*members, strict=True) if keys else [()] * len(h)):
                where.setdefault(k, []).append(i)
            for k, at in where.items():
                total = sums.setdefault(k, np.zeros((n, 2)))
                for a in range(0, len(at), 4096):
                    own = at[a : a + 4096]
                    total += _times(h[own], n) @ v[own]
        for k, total in sums.items():
            yield pa.RecordBatch.from_arrays([*(pa.array([m] * n, f.type) for m, f in zip(k, batch.schema, strict=False)), pa.array(range(n), pa.int32()), pa.array(total[:, 0].copy()), pa.array(total[:, 1].copy())], [*keys, "rep", "x", "y"])

    drawn = rows.mapInArrow(count, shape)
    sums = drawn.groupBy(*keys, "rep").agg(F.sum("x").alias("x"), F.sum("y").alias("y")).where("y <> 0")
    band = sums.groupBy(*keys).agg(F.percentile(F.col("x") / F.col("y"), F.array(F.lit(alpha / 2), F.lit(1 - alpha / 2))).alias("p"))
    point = facts.groupBy(*keys).agg((F.sum(num) / F.nullif(F.sum(den), F.lit(0))).alias("rate"))
    return point.join(band, keys, "left").select(*keys, "rate", F.col("p")[0].alias("lo"), F.col("p")[1].alias("hi"))


def _times(hashes: np.ndarray, n: int) -> np.ndarray:
    """(n, rows): how often each row counts in each resample, from xxhash64(row, resample) as Spark takes it; `hashes` are those of the rows."""
    steps, term, total = [], np.exp(-1.0), 0.0
    for k in range(10):
        total += term
        steps.append(total)
        term /= k + 1
    least = np.ceil(np.array(steps) * (1 << 53)).astype(np.uint64)  # u >= s, in whole 53-bit numbers
    last = np.uint64((1 << 53) - 1)
    # most numbers are told by their upper 12 bits, those beside a step are compared
    cells = np.searchsorted(least, np.arange(1 << 12, dtype=np.uint64) << np.uint64(41), side="right").astype(np.float64)
    cells[(least[least <= last] >> np.uint64(41)).astype(np.int64)] = -1
    out = np.empty((n, len(hashes)))
    base = hashes + _P5 + np.uint64(4)
    h, g = np.empty_like(base), np.empty_like(base)
    for r in range(n):
        np.bitwise_xor(base, np.uint64(r * int(_P1) & _MASK), out=h)
        np.left_shift(h, np.uint64(23), out=g)
        np.right_shift(h, np.uint64(41), out=h)
        h |= g
        h *= _P2
        h += _P3
        for shift, by in ((33, _P2), (29, _P3), (32, None)):
            np.right_shift(h, np.uint64(shift), out=g)
            h ^= g
            if by is not None:
                h *= by
        h &= last
        np.right_shift(h, np.uint64(41), out=g)
        own = np.take(cells, g.view(np.int64), out=out[r], mode="clip")
        near = np.flatnonzero(own < 0)
        own[near] = np.searchsorted(least, h[near], side="right")
    return out


def indexed(facts: DataFrame, keys: list[str], num: str, den: str, order: str, n: int, a: int = 7919, b: int = 104729, alpha: float = ALPHA) -> DataFrame:
    """The interval with draws that SQL can repeat: resample r takes row (r * a + i * b + r * i) mod N in its i-th draw.

    Drawn this way a row comes g times or never, g being the common divisor of b + r and N: it comes if g divides its number less r * a. So
    nothing is drawn or joined; each row is counted as often as it comes, and summed map-side.
    """
    rows = numbered(facts, keys, [F.col(order)], "i")
    sizes = facts.groupBy(*keys).agg(F.count("*").alias("rows")).withColumn("rep", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))))
    gcd = F.pandas_udf(lambda x, y: pd.Series(np.gcd(x.to_numpy(np.int64), y.to_numpy(np.int64))), "bigint")
    times = sizes.select(*keys, F.struct("rep", gcd(F.col("rep") + b, F.col("rows")).alias("g")).alias("r")).groupBy(*keys).agg(F.collect_list("r").alias("reps"))
    drawn = rows.join(F.broadcast(times), keys).select(*keys, "i", num, den, F.explode("reps").alias("r")).where((F.col("i") - F.col("r.rep") * a) % F.col("r.g") == 0)  # n numbers a system
    sums = drawn.groupBy(*keys, F.col("r.rep").alias("rep")).agg((F.sum(F.col(num) * F.col("r.g")) / F.nullif(F.sum(F.col(den) * F.col("r.g")), F.lit(0))).alias("rate"))
    return sums.groupBy(*keys).agg(F.percentile("rate", F.lit(alpha / 2)).alias("lo"), F.percentile("rate", F.lit(1 - alpha / 2)).alias("hi"))
