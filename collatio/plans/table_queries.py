"""Queries on pages scored whole, on the published tables, and on checks of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema as C
from ..functions import align
from ..functions import text as T
from ..operators import facts, judging, profile, tables
from . import sql as Q
from .catalog import query, table
from .fact_queries import _FACTS_SQL, _line_facts
from .text_queries import SYSTEMS, readings


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as pages, their roles as corpora."""
    return table(spark, sf_dir, "conversations").select(F.format_string("%d-%d", "conv_id", "turn").alias("page_id"), F.col("role").alias("corpus"), F.col("text").alias("gt_text"))


def _said(turns: DataFrame, *systems: tuple[str, str | None]) -> DataFrame:
    """Predictions that copy the page; a system with an error fails on all."""
    each = F.array(*(F.struct(F.lit(f"{s}__r0").alias("run_id"), F.lit(s).alias("system_id"), F.lit(e).cast("string").alias("error")) for s, e in systems))
    return turns.select("page_id", F.col("gt_text").alias("text"), F.explode(each).alias("s")).select("s.*", "page_id", "text")


# ---------------------------------------------------------------------------------------------- pages
_TURNS = "SELECT conv_id || '-' || turn AS page_id, role AS corpus, coalesce(text, '') AS text FROM conversations"
_LINE = f"SELECT page_id, {Q.normalize('l', 'L0')} AS l0, {Q.normalize('l', 'L1')} AS l1, {Q.normalize('l', 'L2')} AS l2 FROM (SELECT page_id, unnest({Q.split_lines('text')}) AS l FROM t)"
_NUMBERS = f"len(list_filter(list_transform({Q.tokens('l1')}, lambda w: {Q.strip_token('w')}), lambda w: regexp_matches(w, '\\p{{Nd}}')))"
_OF_LINES = f"""CAST(count(*) AS BIGINT) AS n_lines_ref, CAST(sum(len(regexp_extract_all(l0, {Q.quote(T.PERIOD_CLASS)}))) AS BIGINT) AS n_glyph_ref,
CAST(sum(len(regexp_extract_all(l2, '[\\p{{P}}\\p{{S}}]'))) AS BIGINT) AS n_punct_ref, CAST(sum(len(regexp_extract_all(l1, '\\p{{Lu}}'))) AS BIGINT) AS n_caps, CAST(sum({_NUMBERS}) AS BIGINT) AS n_num_ref"""
_PAGES = f"""t AS ({_TURNS}), l AS (SELECT page_id, {_OF_LINES} FROM ({_LINE}) GROUP BY page_id),
p AS (SELECT t.page_id, corpus, length({Q.normalize('text', 'L1')}) AS n_ref_chars, len({Q.tokens(Q.normalize('text', 'L1'))}) AS n_ref_words, coalesce(n_lines_ref, 0) AS n_lines_ref, coalesce(n_glyph_ref, 0) AS n_glyph_ref,
coalesce(n_punct_ref, 0) AS n_punct_ref, coalesce(n_caps, 0) AS n_caps, coalesce(n_num_ref, 0) AS n_num_ref FROM t LEFT JOIN l USING (page_id))"""
_KEPT = {"n_ref_chars": "n_ref_chars", "n_ref_words": "n_ref_words", "ins": "0", "dele": "0", "sub": "0", "word_edits": "0", "n_lines_ref": "n_lines_ref", "n_lines_matched": "n_lines_ref", "n_glyph_ref": "n_glyph_ref", "glyph_kept": "n_glyph_ref", "n_glyph_hyp": "n_glyph_ref",
         "n_punct_ref": "n_punct_ref", "punct_kept": "n_punct_ref", "n_caps_read": "n_caps", "caps_lowered": "0", "n_num_ref": "n_num_ref", "num_kept": "n_num_ref", "n_num_hyp": "n_num_ref", "n_sub_words": "0", "real_word_sub": "0"}
_LOST = _KEPT | {"dele": "n_ref_chars", "word_edits": "n_ref_words"} | dict.fromkeys(("n_lines_matched", "glyph_kept", "n_glyph_hyp", "punct_kept", "n_caps_read", "num_kept", "n_num_hyp"), "0")


def _bound(system: str, failed: str, counts: dict[str, str]) -> str:
    return f"SELECT '{system}__r0' AS run_id, '{system}' AS system_id, page_id, corpus, {failed} AS error, {', '.join(f'CAST({v} AS BIGINT) AS {k}' for k, v in counts.items())} FROM p"


@query("score_bounds", f"WITH {_PAGES} {_bound('same', 'n_ref_chars = 0', _KEPT)} UNION ALL {_bound('none', 'true', _LOST)}")
def score_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn scored against itself, where nothing is lost, and as a failed page, where all is."""
    turns = _turns(spark, sf_dir)
    return facts.score(turns, _said(turns, ("same", None), ("none", "refused")), facts.vocabulary(table(spark, sf_dir, "benchmark")))


_READ = " UNION ALL ".join(f"SELECT page_id, '{s}' AS system_id, {Q.normalize('text', 'L1')} AS ref, {Q.normalize(q('text'), 'L1')} AS hyp FROM t" for s, (_, q) in SYSTEMS.items())


@query("score_edits", f"""WITH t AS ({_TURNS}), r AS ({_READ}), k AS (SELECT *, {Q.known('ref', 'hyp')} AS k FROM r)
SELECT system_id, page_id, CAST(length(ref) AS BIGINT) AS n_ref_chars, CAST({Q.char_edits('ref', 'hyp', 'k')} AS BIGINT) AS edits, CAST(length(hyp) - length(ref) AS BIGINT) AS surplus, CAST(len({Q.tokens('ref')}) AS BIGINT) AS n_ref_words FROM k""")
def score_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The score facts of three systems on all turns: edits of whole pages, and by how much insertions exceed deletions."""
    turns = _turns(spark, sf_dir)
    said = turns.select("page_id", F.explode(readings(F.col("gt_text"))).alias("r")).select(F.concat("r.system", F.lit("__r0")).alias("run_id"), F.col("r.system").alias("system_id"), "page_id", F.col("r.hyp").alias("text"), F.lit(None).cast("string").alias("error"))
    return facts.score(turns, said).select("system_id", "page_id", "n_ref_chars", (F.col("ins") + F.col("dele") + F.col("sub")).alias("edits"), (F.col("ins") - F.col("dele")).alias("surplus"), "n_ref_words")


@query("match_same_lines", f"WITH t AS ({_TURNS}) SELECT page_id, CAST(i - 1 AS INTEGER) AS line_idx, 'match' AS kind, CAST(i - 1 AS INTEGER) AS hyp_idx, l[i] AS hyp FROM (SELECT page_id, l, unnest(generate_series(1, len(l))) AS i FROM (SELECT page_id, {Q.split_lines('text')} AS l FROM t))")
def match_same_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of each turn against themselves: each finds its own, repeated lines too."""
    rows = facts.spread(_turns(spark, sf_dir), "page_id").select("page_id", F.explode(align.match_lines(F.col("gt_text"), F.col("gt_text"))).alias("l"))
    return rows.select("page_id", "l.line_idx", "l.kind", "l.hyp_idx", "l.hyp")


@query("quote_check", f"""WITH t AS ({_TURNS}), q AS (SELECT page_id, ({Q.split_lines('text')})[1] AS ref FROM t WHERE len({Q.split_lines('text')}) > 0)
SELECT page_id, system_id, CAST(0 AS INTEGER) AS line_idx, system_id <> 'ghost' AS same_ref, system_id = 'same' AS same_text, system_id = 'same' AS cer_ok, system_id = 'same' AS verdict_ok FROM q, (VALUES ('same'), ('other'), ('ghost')) AS s(system_id)""")
def quote_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first line of every turn quoted from a system that reads it so, from one that is misquoted, and from one that read nothing."""
    turns = _turns(spark, sf_dir)
    first = turns.withColumn("ref", F.get(T.split_lines(F.col("gt_text")), F.lit(0))).where("ref is not null")
    each = F.array(*(F.struct(F.lit(s).alias("system_id"), F.lit(v).alias("verdict"), F.lit(c).alias("cer")) for s, v, c in (("same", "usable", 0.0), ("other", "misleading", 5.0), ("ghost", "usable", 0.0))))
    quotes = first.select("page_id", "ref", F.explode(each).alias("s")).select("s.*", "page_id", F.lit(0).alias("line_idx"), "ref", F.when(F.col("s.system_id") == "other", F.concat("ref", F.lit("!"))).otherwise(F.col("ref")).alias("text"), F.lit(None).cast("double").alias("wer"))
    judged = quotes.where("system_id <> 'ghost'").select("system_id", "page_id", "line_idx", F.lit(0).alias("pass_idx"), F.lit("usable").alias("verdict"))
    got = tables.check_quotes(quotes, turns, _said(turns, ("same", None), ("other", None)), judged)
    return got.select("page_id", "system_id", "line_idx", "same_ref", "same_text", "cer_ok", "verdict_ok")


# ---------------------------------------------------------------------------------------------- tables
_SYSTEMS = [("A", "Alpha", "api", "api", "lineup"), ("N", "Nu", "gpu_24gb", "modal_a10", "lineup"), ("R", "Rho", "cpu", "cpu_local", "extra"), ("X", "no scores", "api", "api", "lineup")]
_SYSTEM_ROWS = ", ".join(f"({', '.join(map(Q.quote, r))})" for r in _SYSTEMS)


def _systems(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(_SYSTEMS, "system_id string, label string, hardware_class string, hardware string, role string")


def _predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as predictions: the return flag is the system, odd line numbers are its first run, small discounts its failures."""
    c = F.col
    return table(spark, sf_dir, "lineitem").select(
        F.concat("l_returnflag", F.lit("__r"), ((c("l_linenumber") + 1) % 2).cast("string")).alias("run_id"), c("l_returnflag").alias("system_id"), c("l_orderkey").alias("page_id"), c("l_quantity").alias("latency_s"),
        F.when(c("l_linenumber") < 5, c("l_tax")).alias("cost_usd"), F.when(c("l_returnflag") == "N", c("l_discount")).alias("energy_wh"), F.when(c("l_discount") < 0.02, "failed").alias("error"),
    )


_PREDICTIONS = """SELECT l_returnflag AS system_id, l_orderkey AS page_id, l_quantity AS latency_s, CASE WHEN l_linenumber < 5 THEN l_tax END AS cost_usd, CASE WHEN l_returnflag = 'N' THEN l_discount END AS energy_wh,
CASE WHEN o_orderstatus = 'F' THEN 'abp' ELSE 'other' END AS corpus FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_linenumber % 2 = 1 AND l_discount >= 0.02"""


def _manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("page_id"), F.when(F.col("o_orderstatus") == "F", "abp").otherwise("other").alias("corpus"))


_MEANS = "avg(cost_usd) AS usd, avg(energy_wh) AS wh, avg(latency_s) AS mean_s, median(latency_s) AS s_per_page, count(*) AS n_answered"


@query("means_of_answered", f"SELECT system_id, corpus, {_MEANS} FROM ({_PREDICTIONS}) GROUP BY ALL")
def means_of_answered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cost, energy and seconds of the answered known pages of first runs."""
    return tables.means(tables.answered(_predictions(spark, sf_dir), _manifest(spark, sf_dir)), "system_id", "corpus")


@query("repeated_runs", "SELECT DISTINCT l_returnflag || '__r1' AS run_id FROM lineitem WHERE l_linenumber % 2 = 0")
def repeated_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.repeats(_predictions(spark, sf_dir))


_WATTS, _KWH = C.CPU_WATTS, C.EUR_PER_KWH * C.USD_PER_EUR


@query("profile_summary", f"""WITH f AS ({_FACTS_SQL}), a AS ({_PREDICTIONS}), s(system_id, label, hardware_class, hardware, role) AS (VALUES {_SYSTEM_ROWS}),
g AS (SELECT system AS system_id, corpus, count(*) AS n_pages, {Q.ratio('sum(least(ins + dele + sub, n_ref_chars))', 'sum(n_ref_chars)')} AS cer_page, sum(num_kept) AS nk, sum(n_num_ref) AS nr, sum(n_num_hyp) AS nh FROM f GROUP BY GROUPING SETS ((system), (system, corpus))),
r AS (SELECT *, {Q.f1('nk', 'nr', 'nh')} AS numeral_f1 FROM g),
m AS (SELECT l_returnflag AS system_id, avg(CAST(l_linenumber % 3 = 1 AS DOUBLE)) AS misleading FROM lineitem WHERE l_returnflag <> 'R' GROUP BY 1),
c AS (SELECT system_id, {_MEANS} FROM a GROUP BY 1), o AS (SELECT system_id, corpus, median(latency_s) AS own FROM a GROUP BY ALL),
j AS (SELECT s.*, r.corpus, n_pages, cer_page, numeral_f1, misleading, usd, wh, mean_s, CASE WHEN r.corpus IS NULL THEN s_per_page ELSE own END AS sec FROM s JOIN r USING (system_id) JOIN c USING (system_id) LEFT JOIN m USING (system_id) LEFT JOIN o ON o.system_id = s.system_id AND o.corpus = r.corpus),
b AS (SELECT *, CASE WHEN hardware_class = 'api' THEN usd END AS u, CASE WHEN hardware_class = 'api' THEN NULL WHEN wh IS NOT NULL THEN wh WHEN hardware = 'cpu_local' THEN mean_s * {_WATTS} / 3600 END AS w FROM j),
p AS (SELECT *, CASE WHEN hardware_class = 'api' THEN u ELSE w / 1000 * {_KWH} END AS price FROM b),
e AS (SELECT *, {Q.log_facet('sec', *C.SPEED)} AS speed, CASE hardware_class {' '.join(f"WHEN '{k}' THEN {v}" for k, v in C.HARDWARE_SCORES.items())} END AS hw, {Q.log_facet('price', *C.PRICE_RANGE)} AS cheap FROM p)
SELECT system_id, label, role, corpus, n_pages, cer_page, CASE WHEN corpus IS NULL AND misleading IS NOT NULL THEN (1 - misleading + numeral_f1) / 2 ELSE numeral_f1 END AS integrity, sec AS s_per_page, price AS price_usd_per_page,
CASE WHEN hardware_class = 'api' THEN 'list price' WHEN w IS NOT NULL THEN 'electricity' ELSE 'not priced' END AS price_basis, w AS wh_per_page,
(coalesce(speed, 0) * {C.WEIGHTS['speed']} + hw * {C.WEIGHTS['hardware']} + coalesce(cheap, 0) * {C.WEIGHTS['price']}) / (CASE WHEN speed IS NULL THEN 0 ELSE {C.WEIGHTS['speed']} END + {C.WEIGHTS['hardware']} + CASE WHEN cheap IS NULL THEN 0 ELSE {C.WEIGHTS['price']} END) AS efficiency FROM e""")
def profile_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The profile table, by system and by system and corpus; a system without scores is left out, one without verdicts isn't."""
    rates = profile.text_rates(_line_facts(spark, sf_dir), [["system"], ["system", "corpus"]]).withColumnRenamed("system", "system_id")
    misleading = table(spark, sf_dir, "lineitem").where("l_returnflag <> 'R'").groupBy(F.col("l_returnflag").alias("system_id")).agg(F.avg((F.col("l_linenumber") % 3 == 1).cast("double")).alias("misleading"))
    credits = spark.createDataFrame([], "system_id string, credits_per_page double")
    out = tables.summary(_systems(spark), rates, tables.answered(_predictions(spark, sf_dir), _manifest(spark, sf_dir)), credits, misleading)
    return out.select("system_id", "label", "role", "corpus", "n_pages", "cer_page", "integrity", "s_per_page", "price_usd_per_page", "price_basis", "wh_per_page", "efficiency")


@query("lineup_labels", f"WITH s(system_id, label, hardware_class, hardware, role) AS (VALUES {_SYSTEM_ROWS}) SELECT event_type AS system_id, coalesce(label, event_type) AS label, count(*) AS n FROM (SELECT upper(substr(event_type, 1, 1)) AS event_type FROM events) LEFT JOIN (SELECT * FROM s WHERE role = 'lineup') ON event_type = system_id GROUP BY ALL")
def lineup_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows counted by the label of their system, if it takes part, else by its id."""
    rows = table(spark, sf_dir, "events").groupBy(F.upper(F.substring("event_type", 1, 1)).alias("system_id")).agg(F.count("*").alias("n"))
    return tables.labelled(rows, tables.lineup(_systems(spark))).select("system_id", "label", "n")


@query("samples_in_passes", "SELECT doc_id, pass_idx FROM labels, (VALUES (0), (1)) AS p(pass_idx)")
def samples_in_passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.in_passes(table(spark, sf_dir, "labels").select("doc_id"), 2)


@query("kappa_by_source", """WITH d AS (SELECT source, quality, toxic FROM labels JOIN documents USING (doc_id)), n AS (SELECT source, CAST(count(*) AS DOUBLE) AS n, sum(CAST(quality = toxic AS INTEGER)) AS same, CAST(sum(quality) AS DOUBLE) AS q, CAST(sum(toxic) AS DOUBLE) AS t FROM d GROUP BY 1),
e AS (SELECT source, n, same / n AS o, (q * t + (n - q) * (n - t)) / (n * n) AS x FROM n) SELECT source, CAST(n AS BIGINT) AS n, CASE WHEN x < 1 THEN (o - x) / (1 - x) ELSE 1.0 END AS kappa FROM e""")
def kappa_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    return judging.kappa(rows, ["source"], "quality", "toxic")
