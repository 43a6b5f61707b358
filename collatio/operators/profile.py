"""Score facts to tables: rates are ratios of sums, a page's loss is capped by its size, and what wasn't measured is null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema as C
from ..functions import rates as R
from ..functions import text as T
from . import bootstrap


def micro_rate(num: str | Column, den: str | Column) -> Column:
    """Sum over sum."""
    return R.ratio(F.sum(num), F.sum(den))


def _capped(facts: DataFrame) -> DataFrame:
    return facts.withColumns({
        "char_edits": R.capped(F.col("ins") + F.col("dele") + F.col("sub"), F.col("n_ref_chars")), "words_lost": R.capped(F.col("word_edits"), F.col("n_ref_words")),
    })


def text_scores(facts: DataFrame, grains: list[list[str]], order: str = "page_id", n: int = bootstrap.RESAMPLES) -> DataFrame:
    """The rates at each grain, with bootstrap intervals of the character and word error rates; a group's pages are resampled in `order`."""
    dims, c = list(dict.fromkeys(d for g in grains for d in g)), F.col
    names = ["cer_page_lo", "cer_page_hi", "wer_page_lo", "wer_page_hi"]
    rows, types = _capped(facts), dict(facts.dtypes)
    bands = None
    for g in grains:
        band = bootstrap.intervals(rows.select(*g, order, "char_edits", "n_ref_chars", "words_lost", "n_ref_words"), g, {"cer_page": ("char_edits", "n_ref_chars"), "wer_page": ("words_lost", "n_ref_words")}, order, n)
        own = band.select(*((c(d) if d in g else F.lit(None).cast(types[d])).alias(f"b_{d}") for d in dims), F.lit(_grain(dims, g)).alias("b_grain"), *names)
        bands = own if bands is None else bands.unionByName(own)
    out = _rates(rows, grains).alias("r")
    same = c("grain") == c("b_grain")
    for d in dims:
        same &= c(d).eqNullSafe(c(f"b_{d}"))
    shown = out.drop("grain").columns
    at = shown.index("wer_page")
    return out.join(bands, same, "left").select(*shown[:at], *names[:2], "wer_page", *names[2:], *shown[at + 1 :])


def text_rates(facts: DataFrame, grains: list[list[str]]) -> DataFrame:
    """Accuracies, fidelity and numerals at each grain, without intervals."""
    return _rates(_capped(facts), grains).drop("grain")


def _grain(dims: list[str], g: list[str]) -> int:
    """What grouping_id() gives for a grain."""
    return sum(1 << i for i, d in enumerate(reversed(dims)) if d not in g)


def _rates(rows: DataFrame, grains: list[list[str]]) -> DataFrame:
    """The rates and their grain's grouping_id, by grouping sets over one scan: columns not in a grain are null."""
    dims = list(dict.fromkeys(d for g in grains for d in g))
    dip = F.col("corpus").isin(*C.DIPLOMATIC)
    sums = {c: F.sum(c) for c in ("char_edits", "n_ref_chars", "words_lost", "n_ref_words", "punct_kept", "n_punct_ref", "caps_lowered", "n_caps_read", "num_kept", "n_num_ref", "n_num_hyp", "n_lines_matched", "n_lines_ref", "real_word_sub", "n_sub_words")}
    sums |= {f"d_{c}": F.sum(F.when(dip, F.col(c)).otherwise(0)) for c in ("glyph_kept", "n_glyph_ref", "n_glyph_hyp")}
    renamed = rows.withColumns({f"g_{d}": F.col(d) for d in dims})
    out = renamed.groupingSets([[F.col(f"g_{d}") for d in g] for g in grains], *(F.col(f"g_{d}") for d in dims)).agg(
        F.grouping_id().cast("int").alias("grain"), F.count("*").alias("n_pages"), F.sum(F.col("error").cast("long")).alias("n_failed"), *(v.alias(k) for k, v in sums.items())
    )
    c = F.col
    out = out.withColumns({
        "cer_page": R.ratio(c("char_edits"), c("n_ref_chars")), "wer_page": R.ratio(c("words_lost"), c("n_ref_words")),
        "glyph_f1": R.f1(c("d_glyph_kept"), c("d_n_glyph_ref"), c("d_n_glyph_hyp")),
        "punct_kept_share": R.ratio(c("punct_kept"), c("n_punct_ref")), "caps_kept": 1 - R.ratio(c("caps_lowered"), c("n_caps_read")),
        "numeral_f1": R.f1(c("num_kept"), c("n_num_ref"), c("n_num_hyp")), "line_recall": R.ratio(c("n_lines_matched"), c("n_lines_ref")),
        "real_word_share": R.ratio(c("real_word_sub"), c("n_sub_words")),
    })
    return out.select(
        *(c(f"g_{d}").alias(d) for d in dims), "n_pages", "n_failed", (1 - c("cer_page")).alias("char_accuracy"), (1 - c("wer_page")).alias("word_accuracy"),
        R.mean_present(c("glyph_f1"), c("punct_kept_share"), c("caps_kept")).alias("fidelity"), "cer_page", "wer_page", "glyph_f1", c("punct_kept_share").alias("punct_kept"), "caps_kept", "numeral_f1", "line_recall", "real_word_share", "grain",
    )


def integrity(misleading: Column, numeral_f1: Column) -> Column:
    return R.mean_present(1 - misleading, numeral_f1)


def with_integrity(scores: DataFrame, misleading: DataFrame, system: str = "system_id", corpus: str = "corpus") -> DataFrame:
    """Scores with `integrity`. misleading: (system, misleading). The sample is too small to split, so a corpus's row rests on its numerals alone."""
    rows = scores.join(misleading.select(system, "misleading"), system, "left")
    return rows.withColumn("integrity", F.when(F.col(corpus).isNull(), integrity(F.col("misleading"), F.col("numeral_f1"))).otherwise(F.col("numeral_f1"))).drop("misleading")


def full_coverage(scores: DataFrame, corpora: DataFrame, corpus: str = "corpus") -> DataFrame:
    """The scores whose n_pages is all that their corpus has."""
    return scores.join(corpora.select(corpus, "n_pages"), [corpus, "n_pages"], "left_semi")


def years(pages: DataFrame, corpus: str = "corpus", year: str = "year") -> DataFrame:
    """The first and last year of each corpus that has a dated page; 0 is no date."""
    return pages.where(F.col(year) != 0).groupBy(corpus).agg(F.min(year).alias("first"), F.max(year).alias("last"))


def check_years(claims: DataFrame, found: DataFrame, corpus: str = "corpus") -> DataFrame:
    """Printed ranges (corpus, from, to) against `years`: ok if all dated pages lie inside; a corpus without dates is."""
    rows = claims.join(found, corpus, "left")
    return rows.withColumn("ok", F.coalesce((F.col("from") <= F.col("first")) & (F.col("last") <= F.col("to")), F.lit(True)))


def corpora(pages: DataFrame, corpus: str = "corpus", text: str = "gt_text", n_lines: str = "n_lines_gt", sampled: str = "judge_sample") -> DataFrame:
    """Pages, lines, lines that are scored, words and sampled pages of each corpus."""
    return pages.groupBy(corpus).agg(
        F.count("*").alias("n_pages"), F.sum(n_lines).alias("n_lines"), F.sum(F.size(T.split_lines(F.col(text)))).alias("n_lines_scored"),
        F.sum(F.size(T.tokens(F.col(text)))).alias("n_words"), F.count_if(sampled).alias("n_judge_sample_pages"),
    )


def latency(log: DataFrame, keys: list[str], seconds: str) -> DataFrame:
    """The exact median of answered pages."""
    return log.groupBy(*keys).agg(F.median(seconds).alias("s_per_page"), F.count("*").alias("n"))


# ---------------------------------------------------------------------------------------------- cost and efficiency
def cost_usd(tokens_in: Column, tokens_out: Column, thinking: Column, p_in: Column, p_out: Column, p_thinking: Column) -> Column:
    """List price of a call; thinking goes by its own rate, else by the output's. Null without a price."""
    zero = F.lit(0)
    return (F.coalesce(tokens_in, zero) * p_in + F.coalesce(tokens_out, zero) * p_out + F.coalesce(thinking, zero) * F.coalesce(p_thinking, p_out)) / 1e6


def cost_basis(hardware_class: Column, hardware: Column, usd: Column, credits: Column, wh: Column, seconds: Column) -> Column:
    """struct(usd_per_page, wh_per_page, wh_basis) from a system's means: list price, credits, measured or estimated energy."""
    none = F.lit(None).cast("double")
    estimate = seconds * C.CPU_WATTS / 3600
    on_cpu = hardware == "cpu_local"
    hosted = hardware_class.isin(*C.HOSTED)
    return F.struct(
        F.when(hardware_class == "api", usd).when(hardware_class == "transkribus", credits * C.EUR_PER_CREDIT * C.USD_PER_EUR).otherwise(none).alias("usd_per_page"),
        F.when(hosted, none).when(wh.isNotNull(), wh).when(on_cpu, estimate).otherwise(none).alias("wh_per_page"),
        F.when(hosted, "not measured").when(wh.isNotNull(), "measured (GPU board power)").when(on_cpu, f"estimated ({C.CPU_WATTS:g} W x seconds)").otherwise("not measured").alias("wh_basis"),
    )


def price(hardware_class: Column, usd_per_page: Column, wh_per_page: Column, usd_per_kwh: float = C.EUR_PER_KWH * C.USD_PER_EUR) -> Column:
    """struct(usd, basis): what a page costs, and by what."""
    hosted = hardware_class.isin(*C.HOSTED)
    return F.struct(
        F.when(hosted, usd_per_page).otherwise(wh_per_page / 1000 * usd_per_kwh).alias("usd"),
        F.when(hardware_class == "api", "list price").when(hosted, "credits").when(wh_per_page.isNotNull(), "electricity").otherwise("not priced").alias("basis"),
    )


def hardware_score(hardware_class: Column) -> Column:
    """By the smallest machine that runs a page; another class is an error."""
    out = F.raise_error(F.concat(F.lit("no hardware class "), hardware_class)).cast("double")
    for name, value in C.HARDWARE_SCORES.items():
        out = F.when(hardware_class == name, value).otherwise(out)
    return out


def efficiency(seconds: Column, hardware_class: Column, usd: Column) -> Column:
    """The weighted mean of speed, hardware and price, on fixed anchors, so that a new system changes no other's."""
    facets = {"speed": R.log_facet(seconds, *C.SPEED), "hardware": hardware_score(hardware_class), "price": R.log_facet(usd, *C.PRICE_RANGE)}
    return R.weighted_mean(facets, C.WEIGHTS)


def hardware_of(gpu: Column) -> Column:
    """The machine by its GPU's name; an unknown one is an error."""
    out = F.raise_error(F.concat(F.lit("unknown GPU "), gpu)).cast("string")
    for name, value in (("A10", "modal_a10"), ("A100", "modal_a100"), ("H100", "modal_h100")):
        out = F.when(F.contains(gpu, F.lit(name)), value).otherwise(out)
    return out


# ---------------------------------------------------------------------------------------------- extremes and claims
def extremes(table: DataFrame, name: str, columns: list[str]) -> DataFrame:
    """(metric, highest, lowest): who holds the extremes; ties go to the smallest name, nulls are out."""
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("v")) for c in columns)))
    rows = table.select(F.col(name).alias("name"), pairs.alias("p")).select("name", "p.*").where("v is not null")
    best = rows.groupBy("metric").agg(F.min(F.struct((-F.col("v")).alias("v"), "name"))["name"].alias("highest"), F.min(F.struct("v", "name"))["name"].alias("lowest"))
    return best


def check_claims(claims: DataFrame, metrics: DataFrame, on: list[str]) -> DataFrame:
    """Claims (.., printed, decimals) against metrics (.., value): ok when the value prints as claimed; a claim without a metric fails."""
    rows = claims.join(metrics, on, "left")
    near = F.abs(F.col("value") - F.col("printed")) <= 0.5 * F.pow(F.lit(10.0), -F.col("decimals")) + 1e-9
    return rows.withColumn("ok", F.coalesce(near, F.lit(False)))


def cents(usd: Column) -> Column:
    """A price as printed in cents: below a tenth as such, from ten on without decimals."""
    v = 100 * usd
    return F.when(v < 0.1, "<0.1").when(v >= 10, R.printed(v, 0)).otherwise(R.printed(v, 1))
