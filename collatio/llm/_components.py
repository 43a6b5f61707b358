"""Connected components of a graph of links, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import cut, drop

#: Links to a task, about, and the compression of tables that are read once.
LOT, PLAIN = 1 << 20, "uncompressed"


def components(links: DataFrame) -> DataFrame:
    """links (a, b) to (id, component): the smallest id that each linked id reaches, itself included.

    Every round first ties each node's larger neighbours to its smallest one (large star), then each node's smaller
    neighbours and itself (small star); rounds grow as the logarithm of the longest path. The minima are partial
    aggregates, and they are written before they are joined, so a node with many neighbours is neither gathered
    nor stuck in one task: a small table of minima is broadcast by its known size, a large one is joined with
    splitting. The rounds end when every linked id has one link, to an id that has none. Links to itself and repeated links don't matter.
    No link, no row.
    """
    now = cut(links.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links", PLAIN)
    while True:
        ends = now.select(F.col("a").alias("id"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(now.select(F.col("b").alias("id"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        ends = ends.groupBy("id").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
        size, unsettled = ends.agg(F.coalesce(F.sum("up"), F.lit(0)), F.count_if((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("down") > 0)))).first()
        if not unsettled:
            break
        tasks = 1 + size // LOT  # a round's tables are as large as the links, and often few: no task or file for nothing
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = cut(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m")).coalesce(tasks), "links", PLAIN)
        large = cut(both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct().coalesce(tasks), "links", PLAIN)
        lower = cut(large.groupBy("a").agg(F.min("b").alias("m")).coalesce(tasks), "links", PLAIN)
        small = large.join(lower, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        after = cut(small.unionByName(lower.select("a", F.col("m").alias("b"))).where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct().coalesce(tasks), "links", PLAIN)
        for done in (now, least, large, lower):
            drop(links.sparkSession, done)
        now = after
    roots = now.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(roots)
