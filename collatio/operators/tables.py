"""From facts to the published tables: which runs count, what a system's row holds, and checks of what was printed of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import align
from ..functions import distance as D
from ..functions import rates as R
from ..functions import text as T
from . import facts, profile


def first_runs(rows: DataFrame, run: str = "run_id") -> DataFrame:
    """The rows of runs of index 0: a system's tables describe one run."""
    return rows.where(F.endswith(run, F.lit("__r0")))


def repeats(rows: DataFrame, run: str = "run_id") -> DataFrame:
    """The runs that are scored but not in the tables."""
    return rows.where(~F.endswith(run, F.lit("__r0"))).select(run).distinct()


def answered(predictions: DataFrame, manifest: DataFrame, page: str = "page_id") -> DataFrame:
    """Predictions without an error, of pages that the manifest has, with their corpus: what time, cost and energy are taken from."""
    return first_runs(predictions).where("error is null").join(manifest.select(page, "corpus"), page)


def means(rows: DataFrame, *keys: str) -> DataFrame:
    """Of answered pages: mean cost and energy of those that have one, mean and exact median seconds."""
    return rows.groupBy(*keys).agg(F.avg("cost_usd").alias("usd"), F.avg("energy_wh").alias("wh"), F.avg("latency_s").alias("mean_s"), F.median("latency_s").alias("s_per_page"), F.count("*").alias("n_answered"))


def summary(systems: DataFrame, rates: DataFrame, rows: DataFrame, credits: DataFrame, misleading: DataFrame) -> DataFrame:
    """A row for each system, and for each system and corpus: who it is, its rates, integrity, cost, and efficiency.

    systems: system_id, hardware, hardware_class and whatever names it. rates: `profile.text_rates` or `text_scores` of first runs, by
    system_id and corpus. rows: `answered`, with system_id. credits: system_id, credits_per_page. misleading: system_id, misleading.
    A system without scores or without an answered page is left out; without verdicts its integrity rests on its numerals. The sample of
    verdicts is too small to split, so a corpus's integrity does so too. Cost is a system's, seconds are a corpus's own.
    """
    cost = means(rows, "system_id").select("system_id", "usd", "wh", "mean_s", F.col("s_per_page").alias("system_s"))
    own = means(rows, "system_id", "corpus").select("system_id", "corpus", F.col("s_per_page").alias("corpus_s"))
    out = systems.join(profile.with_integrity(rates, misleading), "system_id").join(cost, "system_id").join(credits, "system_id", "left").join(own, ["system_id", "corpus"], "left")
    out = out.withColumn("s_per_page", F.when(F.col("corpus").isNull(), F.col("system_s")).otherwise(F.col("corpus_s")))
    out = out.withColumn("basis", profile.cost_basis(F.col("hardware_class"), F.col("hardware"), F.col("usd"), F.col("credits_per_page"), F.col("wh"), F.col("mean_s")))
    out = out.withColumn("price", profile.price(F.col("hardware_class"), F.col("basis.usd_per_page"), F.col("basis.wh_per_page")))
    out = out.withColumn("efficiency", profile.efficiency(F.col("s_per_page"), F.col("hardware_class"), F.col("price.usd")))
    named = [c for c in systems.columns if c != "system_id"]
    measured = [c for c in rates.columns if c not in ("system_id", "corpus")]
    return out.select("system_id", *named, "corpus", *measured, "integrity", "efficiency", "s_per_page", F.col("price.usd").alias("price_usd_per_page"), F.col("price.basis").alias("price_basis"), "basis.wh_per_page", "basis.wh_basis")


def lineup(systems: DataFrame) -> DataFrame:
    """The systems that take part in comparisons."""
    return systems.where("role = 'lineup'")


def labelled(rows: DataFrame, systems: DataFrame) -> DataFrame:
    """Rows with the label of their system; one that isn't configured is called by its id."""
    names = systems.select("system_id", F.col("label").alias("configured"))
    return rows.join(names, "system_id", "left").withColumn("label", F.coalesce("configured", "system_id")).drop("configured")


def in_passes(samples: DataFrame, passes: int) -> DataFrame:
    """Each sample once a pass."""
    return samples.withColumn("pass_idx", F.explode(F.sequence(F.lit(0), F.lit(passes - 1))))


def _prints(value: Column, claim: Column) -> Column:
    """Whether a share prints as the claimed number of per cent; no claim is kept by any, and a claim isn't by none."""
    return claim.isNull() | F.coalesce(value.isNotNull() & (R.printed(100 * F.least(value, F.lit(1.0)), 0) == R.printed(claim, 0)), F.lit(False))


def check_quotes(quotes: DataFrame, pages: DataFrame, predictions: DataFrame, judged: DataFrame) -> DataFrame:
    """Quoted lines against what their system's first run reads there.

    quotes: system_id, page_id, line_idx, ref, text, and cer, wer (per cent) and verdict where they are printed. pages: page_id, gt_text.
    judged: system_id, page_id, line_idx, pass_idx, verdict. Adds same_ref, same_text, cer_ok, wer_ok and verdict_ok. The lines of a
    quoted page are matched once, however many quotes it has; a quote of a line that isn't there fails.
    """
    wanted = quotes.select("system_id", "page_id").distinct()
    both = first_runs(predictions).join(wanted, ["system_id", "page_id"], "left_semi").join(pages.select("page_id", "gt_text"), "page_id")
    read = facts.spread(both, "system_id", "page_id").select("system_id", "page_id", F.explode(align.match_lines(F.col("gt_text"), F.col("text"))).alias("l"))
    read = read.select("system_id", "page_id", F.col("l.line_idx").alias("line_idx"), F.col("l.ref").alias("found_ref"), F.col("l.hyp").alias("found_text"))
    said = judged.where("pass_idx = 0").select("system_id", "page_id", "line_idx", F.col("verdict").alias("found_verdict"))
    rows = quotes.join(read, ["system_id", "page_id", "line_idx"], "left").join(said, ["system_id", "page_id", "line_idx"], "left")
    plain = F.struct(T.normalize(F.col("found_ref"), "L1").alias("a"), T.normalize(F.col("found_text"), "L1").alias("b"))
    rows = rows.select("*", F.explode(F.array(plain)).alias("plain"))  # a column of its own: what is built on it must not copy the UDF
    a, b = F.col("plain.a"), F.col("plain.b")
    found = lambda v: F.when(F.col("found_ref").isNotNull(), v)
    same = lambda x, y: F.coalesce(F.col(x) == F.col(y), F.lit(False))
    rows = rows.withColumns({"same_ref": same("found_ref", "ref"), "same_text": same("found_text", "text"), "cer_ok": _prints(found(D.cer(a, b)), F.col("cer")), "wer_ok": _prints(found(D.wer(a, b)), F.col("wer"))})
    return rows.withColumn("verdict_ok", F.col("verdict").isNull() | same("found_verdict", "verdict")).drop("plain", "found_ref", "found_text", "found_verdict")
