"""Reviewers' verdicts: parsing, agreement, shares and rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schema as C
from ..functions import align
from ..functions import rates as R
from ..functions import text as T
from . import facts

REPLY = "struct<spans:array<struct<ref_span:string,hyp_span:string,type:string,severity:string>>,verdict:string,note:string>"


def _slug(c: Column) -> Column:
    return F.translate(F.lower(T.strip(c)), " -", "__")


def _with(value: Column, f) -> Column:
    """f(value), value taken once: an expression that f names several times would be evaluated as often."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def span_type(label: Column) -> Column:
    """A label on the closed list: itself, by an alias, or garble."""
    listed = {t: t for t in C.SPAN_TYPES}
    names = F.create_map(*(F.lit(x) for pair in (dict(C.ALIASES) | listed).items() for x in pair))
    return F.coalesce(F.try_element_at(names, _slug(F.coalesce(label, F.lit("")))), F.lit("garble"))


def verdict(label: Column) -> Column:
    """A verdict on the closed list: itself, or by what it contains."""
    slug = F.replace(F.lower(T.strip(F.coalesce(label, F.lit("needs_correction")))), F.lit(" "), F.lit("_"))
    return _with(slug, lambda x: F.when(x.isin(*C.VERDICTS), x).when(F.contains(x, F.lit("mislead")), "misleading").when(F.contains(x, F.lit("usable")), "usable").otherwise("needs_correction"))


def parse(raw: Column) -> Column:
    """struct(spans, verdict, note) from a reviewer's JSON, fenced or not; a bare list is its spans. Null if it isn't JSON."""
    body = T.strip(F.regexp_replace(T.strip(raw), r"(?m)^```(?:json)?|```$", ""))
    severity = lambda s: F.greatest(F.lit(0), F.least(F.lit(2), F.coalesce(F.expr("cast(null as int)"), s.try_cast("int"), F.lit(0))))

    def read(text: Column) -> Column:
        return F.from_json(F.when(F.startswith(text, F.lit("[")), F.concat(F.lit('{"spans":'), text, F.lit("}"))).otherwise(text), REPLY)

    def made(reply: Column) -> Column:
        spans = F.transform(F.coalesce(reply["spans"], F.array()), lambda s: F.struct(F.coalesce(s["ref_span"], F.lit("")).alias("ref_span"), F.coalesce(s["hyp_span"], F.lit("")).alias("hyp_span"), span_type(s["type"]).alias("type"), severity(s["severity"]).alias("severity")))
        return F.when(reply.isNotNull(), F.struct(spans.alias("spans"), verdict(reply["verdict"]).alias("verdict"), F.substring(F.coalesce(reply["note"], F.lit("")), 1, 300).alias("note")))

    return _with(_with(body, read), made)


def kappa(pairs: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """Cohen's kappa of two labels: 1 when chance alone would agree; no row for no pair. By the contingency table."""
    cells = pairs.groupBy(*keys, F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"))
    sides = cells.select(*keys, "n", F.explode(F.array(F.struct(F.lit("a").alias("side"), F.col("a").cast("string").alias("label")), F.struct(F.lit("b").alias("side"), F.col("b").cast("string").alias("label")))).alias("s"))
    margins = sides.groupBy(*keys, F.col("s.label").alias("label")).agg(F.sum(F.when(F.col("s.side") == "a", F.col("n")).otherwise(0)).alias("na"), F.sum(F.when(F.col("s.side") == "b", F.col("n")).otherwise(0)).alias("nb"))
    chance = margins.groupBy(*keys).agg(F.sum(F.col("na") * F.col("nb")).alias("both"))
    seen = cells.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)).alias("same"))
    rows = seen.join(chance, keys) if keys else seen.crossJoin(chance)  # one row each without keys
    observed, expected = F.col("same") / F.col("n"), F.col("both") / (F.col("n") * F.col("n"))
    return rows.select(*keys, "n", F.when(expected < 1, (observed - expected) / F.nullif(1 - expected, F.lit(0.0))).otherwise(1.0).alias("kappa"))


def table(judged: DataFrame) -> DataFrame:
    """For each system what the first pass found per 100 words and its verdicts' shares, the misleading share of both passes, and kappa.

    judged: one record for each system, page, line and pass. One pass over it: a line's records are put together, and all else is
    sums over lines. Verdicts are on the closed list, so kappa's margins are sums too.
    """
    c, first = F.col, F.col("pass_idx") == 0
    types = [F.when(first, F.size(F.filter("spans.type", F.lit(t).__eq__))).otherwise(0).alias(t) for t in C.SPAN_TYPES]
    rows = judged.select("system_id", "page_id", "line_idx", "pass_idx", "verdict", F.when(first, F.size(T.tokens(c("ref")))).alias("words"), *types)
    lines = rows.groupBy("system_id", "page_id", "line_idx").agg(
        F.max(F.when(first, c("verdict"))).alias("a"), F.max(F.when(c("pass_idx") == 1, c("verdict"))).alias("b"), F.count_if(first).alias("firsts"), F.sum("words").alias("words"),
        F.count("verdict").alias("n"), F.count_if(c("verdict") == "misleading").alias("misleading"), *(F.sum(t).alias(t) for t in C.SPAN_TYPES),
    )
    both = c("a").isNotNull() & c("b").isNotNull()
    sums = lines.groupBy("system_id").agg(
        F.sum("firsts").alias("n_lines"), F.sum("words").alias("n_ref_words"), F.sum("n").alias("n"), F.sum("misleading").alias("misleading"), *(F.sum(t).alias(t) for t in C.SPAN_TYPES),
        F.count_if(c("a").isNotNull()).alias("n_a"), *(F.count_if(c("a") == v).alias(f"a_{v}") for v in C.VERDICTS),
        F.count_if(both).alias("pairs"), F.count_if(both & (c("a") == c("b"))).alias("same"), *(F.count_if(both & (c(s) == v)).alias(f"{s}{s}_{v}") for s in "ab" for v in C.VERDICTS),
    )
    pairs = F.nullif(c("pairs").cast("double"), F.lit(0.0))
    observed, expected = c("same") / pairs, sum((c(f"aa_{v}") * c(f"bb_{v}") for v in C.VERDICTS), F.lit(0)) / (pairs * pairs)
    agreed = F.when(expected < 1, (observed - expected) / F.nullif(1 - expected, F.lit(0.0))).when(c("pairs") > 0, 1.0)
    per_words = [R.ratio(100.0 * c(t), c("n_ref_words")).alias(f"{t}_per_100w") for t in C.SPAN_TYPES]
    shares = [R.ratio(c(f"a_{v}").cast("double"), c("n_a")).alias(f"share_{v}") for v in C.VERDICTS]
    return sums.where("n_lines > 0").select("system_id", "n_lines", "n_ref_words", *per_words, *shares, R.ratio(c("misleading").cast("double"), c("n")).alias("share_misleading_both_passes"), agreed.alias("kappa_verdict"))


def candidates(pages: DataFrame, predictions: DataFrame) -> DataFrame:
    """Lines that may be shown to a reviewer: system_id, corpus, page_id, line_idx, ref, hyp, context_before, context_after.

    pages: page_id, corpus, gt_text, judge_sample. predictions: run_id, system_id, page_id, text, error, one a run and page. Of flagged
    pages that a system's first run answered, the lines that aren't missing, have three words or more and differ in a word, at tier L1.
    """
    answered = predictions.where(F.endswith("run_id", F.lit("__r0")) & (F.coalesce("error", F.lit("")) == "") & (F.coalesce("text", F.lit("")) != ""))
    both = answered.join(pages.where("judge_sample").select("page_id", "corpus", "gt_text"), "page_id")
    rows = facts.spread(both, "run_id", "page_id").select("system_id", "corpus", "page_id", align.match_lines(F.col("gt_text"), F.col("text")).alias("lines"))
    near = lambda i: F.coalesce(F.get("lines", i)["ref"], F.lit(""))
    own = F.transform("lines", lambda x, i: F.struct(x["line_idx"].alias("line_idx"), x["kind"].alias("kind"), x["ref"].alias("ref"), x["hyp"].alias("hyp"), near(i - 1).alias("context_before"), near(i + 1).alias("context_after")))
    rows = rows.select("system_id", "corpus", "page_id", F.explode(own).alias("l")).select("system_id", "corpus", "page_id", "l.*").where("kind <> 'missing'")
    a, b = (T.tokens(T.normalize(F.col(c), "L1")) for c in ("ref", "hyp"))
    return rows.where((F.size(a) >= 3) & (a != b)).drop("kind")


def sample(candidates: DataFrame, corpus: str, system: str, line: list[str], per_system: int, order: Column) -> DataFrame:
    """Each system's first lines in one shared order: in every corpus lines of more systems first, then by `order`; corpora in turn.

    candidates: a row for each system and line. Lines are ranked within their corpus and dealt by (rank, corpus).
    The planner keeps only the first per_system rows of each task's share of a system before they are gathered.
    """
    lines = candidates.groupBy(corpus, *line).agg(F.count_distinct(system).alias("n_systems")).withColumn("o", order)
    turn = facts.numbered(lines, [corpus], [F.desc("n_systems"), F.col("o"), *map(F.col, line)], "turn")
    own = candidates.join(turn.select(corpus, *line, "turn"), [corpus, *line])
    rank = Window.partitionBy(system).orderBy("turn", corpus, *line)
    return own.withColumn("place", F.row_number().over(rank)).where(F.col("place") <= per_system)


def prompt(template: str, ref: Column, hyp: Column, before: Column, after: Column, language: Column, genre: Column) -> Column:
    """The reviewer's prompt for a line; its edges and an empty reading are named."""
    def named(c: Column, name: str) -> Column:
        return F.when(F.coalesce(c, F.lit("")) == "", name).otherwise(c)

    return T.fill(template, context_before=named(before, "(start of page)"), context_after=named(after, "(end of page)"), ref=ref, hyp=named(hyp, "(empty)"), language=language, genre=genre)
