"""Run logs to facts: which record of a page counts, which pages are known, answered or to do; and the score of a page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import align
from ..functions import text as T
from ..sources.scratch import cut


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt to all cores, by keys or evenly, ahead of work that weighs more than its rows; a given number isn't coalesced again."""
    spark = df.sparkSession
    n = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(n, *keys)


def numbered(df: DataFrame, keys: list[str], order: list, name: str) -> DataFrame:
    """df with row numbers from 0 within each key, by order, which must decide.

    For keys with many rows: a window would sort all of a key's in one task. Rows are sorted by ranges of (key, order) instead, and written;
    a row's number is its place in its part and key, and how many rows of the key the parts before hold: a table of a row or two a part.
    """
    place, part, first, n, before = (f"{name}__{x}" for x in ("place", "part", "first", "n", "before"))
    by = [*(F.col(k) for k in keys), *order]
    rows = df.repartitionByRange(*by).sortWithinPartitions(*by)
    rows = cut(rows.withColumns({part: F.spark_partition_id(), place: F.monotonically_increasing_id()}), "numbered")
    held = rows.groupBy(*keys, part).agg(F.min(place).alias(first), F.count("*").alias(n))
    earlier = Window.partitionBy(*keys).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    held = held.withColumn(before, F.coalesce(F.sum(n).over(earlier), F.lit(0))).drop(n)
    out = rows.join(held, [*keys, part])
    return out.withColumn(name, F.col(place) - F.col(first) + F.col(before)).select(*df.columns, name)


def last_success(log: DataFrame, keys: list[str], seq: str, error: Column) -> DataFrame:
    """One record a key: the last without an error; without any, the first with one.

    An aggregate, not a window: each key's records are reduced before they are shuffled, so a key with many costs no more.
    """
    cols = [c for c in log.columns if c not in keys]
    row = F.struct(*cols)
    good = F.max_by(F.when(~error, row), F.when(~error, F.col(seq)))
    bad = F.min_by(F.when(error, row), F.when(error, F.col(seq)))
    return log.groupBy(*keys).agg(F.coalesce(good, bad).alias("r")).select(*keys, *(F.col(f"r.{c}").alias(c) for c in cols))


def last_by(log: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """The last record of each key."""
    cols = [c for c in log.columns if c not in keys]
    return log.groupBy(*keys).agg(F.max_by(F.struct(*cols), F.col(seq)).alias("r")).select(*keys, "r.*")


def known(log: DataFrame, manifest: DataFrame, on: str | list[str]) -> DataFrame:
    return log.join(manifest, on, "left_semi")


def unknown(log: DataFrame, manifest: DataFrame, on: str | list[str]) -> DataFrame:
    """Records of pages that no manifest holds."""
    return log.join(manifest, on, "left_anti")


def todo(manifest: DataFrame, log: DataFrame, on: str | list[str], error: Column, retry_errors: bool = True) -> DataFrame:
    """Pages still to be run: without a success; or, without retries, without any record."""
    done = log.where(~error) if retry_errors else log
    return manifest.join(done, on, "left_anti")


def failed(text: Column, error: Column) -> Column:
    """A page that gave an error, or nothing but white space, rules and table edges. A text with any other character isn't normalised to tell."""
    return error.isNotNull() | F.when(text.rlike(rf"[^{T.SPACE[1:-1]}|:*_-]"), False).otherwise(T.normalize(text, "L0") == "")


def score(pages: DataFrame, predictions: DataFrame, vocabulary: DataFrame | None = None) -> DataFrame:
    """The score fact: a row for each run and page, counts only.

    pages: page_id, corpus, gt_text. predictions: run_id, system_id, page_id, text, error. vocabulary: word, the keys that
    count as real words; without it real_word_sub is null. Predictions of other pages are dropped. The alignment is one Arrow UDF a page,
    after a shuffle by page so that all cores align. It is done once: its counts are written to the shared folder, and the words read for
    others are looked up from there by a join, so the vocabulary may be of any size. Without one no words are written.
    """
    both = predictions.join(pages.select("page_id", "corpus", "gt_text"), "page_id").withColumn("failed", failed(F.col("text"), F.col("error")))
    rows = spread(both, "run_id", "page_id").select("run_id", "system_id", "page_id", "corpus", F.col("failed").alias("error"), align.page_counts(F.col("gt_text"), F.col("text"), F.col("failed")).alias("c"))
    rows = rows.select("run_id", "system_id", "page_id", "corpus", "error", "c.*", F.size("c.substituted").cast("long").alias("n_sub_words"))
    if vocabulary is None:
        return cut(rows.drop("substituted"), "scores").withColumn("real_word_sub", F.lit(None).cast("long"))
    rows = cut(rows, "scores")
    read = rows.select("run_id", "page_id", F.explode("substituted").alias("word"))
    listed = read.join(vocabulary.select("word", F.lit(True).alias("listed")).distinct(), "word", "left")
    real = listed.where(is_word(F.col("word"), F.coalesce("listed", F.lit(False)))).groupBy("run_id", "page_id").agg(F.count("*").alias("real"))
    return rows.drop("substituted").join(real, ["run_id", "page_id"], "left").withColumn("real_word_sub", F.coalesce("real", F.lit(0))).drop("real")


def vocabulary(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """word: the distinct keys of all tokens."""
    return texts.select(F.explode(T.tokens(F.col(text_col))).alias("t")).select(T.key(F.col("t")).alias("word")).where("word <> ''").distinct()


def is_word(word: Column, listed: Column) -> Column:
    """A key that is all digits, or is listed and has a letter."""
    return (word != "") & (word.rlike(r"^\p{Nd}+$") | (word.rlike(r"\p{L}") & listed))


def contexts(lines: DataFrame, page: str, idx: str, line: str) -> DataFrame:
    """Each line with its neighbours; empty at the ends."""
    w = Window.partitionBy(page).orderBy(idx)
    return lines.withColumns({"context_before": F.lag(line, 1, "").over(w), "context_after": F.lead(line, 1, "").over(w)})


def prorated(lines: DataFrame, batch: str, wall: str, n: str) -> DataFrame:
    """A batch's wall time split over its pages by their lines."""
    return lines.withColumn("share_s", F.col(wall) * F.col(n) / F.sum(n).over(Window.partitionBy(batch)))


def within_budget(log: DataFrame, run: str, seq: str, cost: str, budget: float, batch: int = 1) -> DataFrame:
    """The records made before the budget was spent, tested after each `batch` records of a run."""
    order = Window.partitionBy(run).orderBy(seq)
    rows = log.withColumns({"spent": F.sum(F.coalesce(cost, F.lit(0.0))).over(order.rowsBetween(Window.unboundedPreceding, 0)), "place": F.row_number().over(order)})
    spent_before = F.max(F.when(F.col("place") % batch == 0, F.col("spent"))).over(order.rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("before", F.coalesce(spent_before, F.lit(0.0))).where(F.col("before") <= budget).drop("before", "place")


def orphans(rows: DataFrame, dimension: DataFrame, key: str, other: str | None = None) -> DataFrame:
    """Keys that a dimension lacks; a sound configuration has none."""
    return rows.where(F.col(key).isNotNull()).select(key).distinct().join(dimension.select(F.col(other or key).alias(key)), key, "left_anti")
