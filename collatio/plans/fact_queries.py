"""Queries on run logs, tables of rates, verdicts, samples and claims."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schema as C
from ..functions import rates as R
from ..operators import bootstrap, facts, judging, profile
from ..sources import pagexml
from ..sources.scratch import new_path
from ..streaming import log as stream
from . import sql as Q
from .catalog import query, table
from .text_queries import once, readings, scored

def _error():
    return F.col("event_type") == "error"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run log: a user is a page, a type a system, value its seconds."""
    return table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", "ts", "props")


# ---------------------------------------------------------------------------------------------- run logs
_LAST = """(SELECT user_id, event_id, event_type, value, row_number() OVER (PARTITION BY user_id ORDER BY event_type = 'error', CASE WHEN event_type <> 'error' THEN event_id END DESC, event_id) AS rn FROM events)"""


@query("last_success", f"SELECT user_id, event_id, event_type, value FROM {_LAST} WHERE rn = 1")
def last_success(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.last_success(_events(spark, sf_dir).select("user_id", "event_id", "event_type", "value"), ["user_id"], "event_id", _error())


@query("stream_last_success", f"SELECT user_id, event_id, event_type, value FROM {_LAST} WHERE rn = 1")
def stream_last_success(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rows from the log as a stream, a file at a time, with state in the shared folder."""
    folder = _scratch(spark)
    source = table(spark, sf_dir, "events")
    rows = spark.readStream.schema(source.schema).option("maxFilesPerTrigger", 1).parquet(f"{sf_dir}/events.parquet*").select("user_id", "event_id", "event_type", "value")
    stream.upsert_last_success(rows, f"{folder}/state", f"{folder}/checkpoint", ["user_id"], "event_id", _error())
    return stream.current(spark, f"{folder}/state")


@query("stream_hourly_load", """SELECT event_type, window_start, mean_value, n FROM (SELECT event_type, CAST(date_trunc('hour', ts) AS TIMESTAMP) AS window_start, avg(value) AS mean_value, count(*) AS n FROM events GROUP BY 1, 2)
WHERE window_start + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 1 DAY FROM events)""")
def stream_hourly_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean load by type and hour, of the hours that the watermark has passed."""
    folder = _scratch(spark)
    source = table(spark, sf_dir, "events")
    rows = spark.readStream.schema(source.schema).parquet(f"{sf_dir}/events.parquet*").withColumn("ts", F.col("ts").cast("timestamp"))
    stream.drain(stream.windows(rows, "ts", "value", ["event_type"]), f"{folder}/out", f"{folder}/checkpoint")
    return spark.read.parquet(f"{folder}/out").withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


def _scratch(spark: SparkSession) -> str:
    """A folder that all executors share."""
    return new_path(spark, "stream")


@query("known_pages", "SELECT doc_id, quality, toxic FROM labels WHERE doc_id IN (SELECT doc_id FROM documents)")
def known_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.known(table(spark, sf_dir, "labels"), table(spark, sf_dir, "documents"), "doc_id")


@query("unknown_pages", "SELECT user_id, count(*) AS n FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) GROUP BY user_id")
def unknown_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("user_id"))
    return facts.unknown(_events(spark, sf_dir), manifest, "user_id").groupBy("user_id").agg(F.count("*").alias("n"))


@query("todo_retrying", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events WHERE event_type <> 'error')")
def todo_retrying(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = table(spark, sf_dir, "customer").select("c_custkey")
    return facts.todo(manifest, _events(spark, sf_dir).withColumn("c_custkey", F.col("user_id")), "c_custkey", _error())


@query("todo_seen_once", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events)")
def todo_seen_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = table(spark, sf_dir, "customer").select("c_custkey")
    return facts.todo(manifest, _events(spark, sf_dir).withColumn("c_custkey", F.col("user_id")), "c_custkey", _error(), retry_errors=False)


@query("last_by_key", "SELECT user_id, event_type, arg_max(event_id, event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY ALL")
def last_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.last_by(_events(spark, sf_dir).select("user_id", "event_type", "event_id", "value"), ["user_id", "event_type"], "event_id")


@query("running_budget", """SELECT user_id, event_id, spent FROM (SELECT user_id, event_id, spent, coalesce(max(CASE WHEN place % 4 = 0 THEN spent END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
FROM (SELECT user_id, event_id, CAST(sum(CAST(round(value * 100) AS BIGINT)) OVER w AS BIGINT) AS spent, row_number() OVER w AS place FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))) WHERE before <= 50000""")
def running_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = _events(spark, sf_dir).withColumn("cents", F.round(F.col("value") * 100).cast("long"))
    return facts.within_budget(log, "user_id", "event_id", "cents", 50000, batch=4).select("user_id", "event_id", F.col("spent").cast("long").alias("spent"))


@query("prorate_by_lines", "SELECT l_orderkey, l_linenumber, o_totalprice * l_quantity / sum(l_quantity) OVER (PARTITION BY l_orderkey) AS share_s FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def prorate_by_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return facts.prorated(rows, "l_orderkey", "o_totalprice", "l_quantity").select("l_orderkey", "l_linenumber", "share_s")


@query("line_context", "SELECT conv_id, turn, lag(text, 1, '') OVER w AS context_before, lead(text, 1, '') OVER w AS context_after FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def line_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.contexts(table(spark, sf_dir, "conversations"), "conv_id", "turn", "text").select("conv_id", "turn", "context_before", "context_after")


@query("failed_pages", f"SELECT conv_id, turn, {Q.normalize('text', 'L0')} = '' AS failed FROM conversations")
def failed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", facts.failed(F.col("text"), F.lit(None)).alias("failed"))


# ---------------------------------------------------------------------------------------------- cost, time, efficiency
@query("median_latency", "SELECT event_type, median(value) AS s_per_page, count(*) AS n FROM events WHERE event_type <> 'error' GROUP BY event_type")
def median_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.latency(_events(spark, sf_dir).where(~_error()), ["event_type"], "value")


@query("latency_by_day", "SELECT event_type, CAST(ts AS DATE) AS day, median(value) AS s_per_page, count(*) AS n FROM events GROUP BY ALL")
def latency_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.latency(_events(spark, sf_dir).withColumn("day", F.to_date("ts")), ["event_type", "day"], "value")


_TOKENS = "CAST(l_quantity AS BIGINT) * 100 AS tin, CAST(l_extendedprice AS BIGINT) AS tout, l_linenumber * 10 AS tthink, p_retailprice / 1000 AS p_in, p_retailprice / 100 AS p_out, CASE WHEN p_size > 25 THEN p_retailprice / 50 END AS p_think"


@query("cost_usd", f"SELECT l_orderkey, l_linenumber, l_partkey, (tin * p_in + tout * p_out + tthink * coalesce(p_think, p_out)) / 1e6 AS usd FROM (SELECT *, {_TOKENS} FROM lineitem JOIN part ON l_partkey = p_partkey)")
def cost_usd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line item as a call, its part as the model's price."""
    c = F.col
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), c("l_partkey") == c("p_partkey"), "left")  # a call without a known price stays, with none
    usd = profile.cost_usd(F.round("l_quantity").cast("long") * 100, F.bround("l_extendedprice").cast("long"), c("l_linenumber") * 10, c("p_retailprice") / 1000, c("p_retailprice") / 100, F.when(c("p_size") > 25, c("p_retailprice") / 50))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", usd.alias("usd"))


_CLASS = "CASE c_nationkey % 6 WHEN 0 THEN 'cpu' WHEN 1 THEN 'gpu_8gb' WHEN 2 THEN 'gpu_24gb' WHEN 3 THEN 'gpu_80gb' WHEN 4 THEN 'api' ELSE 'transkribus' END"
_BASIS = f"""SELECT c_custkey, hc, sec,
CASE WHEN hc = 'api' THEN abs(c_acctbal) / 10000 WHEN hc = 'transkribus' THEN 1.5 * {C.EUR_PER_CREDIT} * {C.USD_PER_EUR} END AS usd_per_page,
CASE WHEN hc IN ('api', 'transkribus') THEN NULL WHEN c_custkey % 3 = 0 THEN abs(c_acctbal) / 100 WHEN hc = 'cpu' THEN sec * {C.CPU_WATTS} / 3600 END AS wh_per_page,
CASE WHEN hc IN ('api', 'transkribus') THEN 'not measured' WHEN c_custkey % 3 = 0 THEN 'measured (GPU board power)' WHEN hc = 'cpu' THEN 'estimated ({C.CPU_WATTS:g} W x seconds)' ELSE 'not measured' END AS wh_basis
FROM (SELECT *, {_CLASS} AS hc, 1 + abs(c_acctbal) / 50 AS sec FROM customer)"""


def _basis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer as a system of some hardware class, its balance as time, cost and energy."""
    c = F.col
    classes = list(C.HARDWARE_SCORES)
    rows = table(spark, sf_dir, "customer").withColumn("hc", F.element_at(F.array(*map(F.lit, classes)), F.col("c_nationkey") % 6 + 1)).withColumn("sec", 1 + F.abs("c_acctbal") / 50)
    wh = F.when(c("c_custkey") % 3 == 0, F.abs("c_acctbal") / 100)
    basis = profile.cost_basis(c("hc"), F.when(c("hc") == "cpu", "cpu_local").otherwise("other"), F.abs("c_acctbal") / 10000, F.lit(1.5), wh, c("sec"))
    return rows.select("c_custkey", "hc", "sec", basis.alias("b")).select("c_custkey", "hc", "sec", "b.*")


@query("cost_basis", _BASIS)
def cost_basis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _basis(spark, sf_dir)


_HW = " ".join(f"WHEN '{k}' THEN {v}" for k, v in C.HARDWARE_SCORES.items())
_PRICE = f"CASE WHEN hc IN ('api', 'transkribus') THEN usd_per_page ELSE wh_per_page / 1000 * {C.EUR_PER_KWH * C.USD_PER_EUR} END"


@query("efficiency", f"""WITH b AS ({_BASIS}), f AS (SELECT c_custkey, {Q.log_facet('sec', *C.SPEED)} AS speed, CASE hc {_HW} END AS hardware, {Q.log_facet('(' + _PRICE + ')', *C.PRICE_RANGE)} AS price FROM b)
SELECT c_custkey, (coalesce(speed * 0.5, 0) + coalesce(hardware * 0.25, 0) + coalesce(price * 0.25, 0)) / (CASE WHEN speed IS NULL THEN 0 ELSE 0.5 END + CASE WHEN hardware IS NULL THEN 0 ELSE 0.25 END + CASE WHEN price IS NULL THEN 0 ELSE 0.25 END) AS efficiency FROM f""")
def efficiency(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    rows = _basis(spark, sf_dir).withColumn("p", profile.price(c("hc"), c("usd_per_page"), c("wh_per_page")))
    return rows.select("c_custkey", profile.efficiency(c("sec"), c("hc"), c("p.usd")).alias("efficiency"))


# ---------------------------------------------------------------------------------------------- tables of rates
@query("micro_rates", "SELECT l_returnflag, l_linestatus, sum(l_extendedprice * l_discount) / nullif(sum(l_extendedprice), 0) AS rate, count(*) AS n FROM lineitem GROUP BY ALL")
def micro_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(profile.micro_rate(F.col("l_extendedprice") * F.col("l_discount"), F.col("l_extendedprice")).alias("rate"), F.count("*").alias("n"))


def _count(expr: str) -> str:
    return f"CAST({expr} AS BIGINT)"


#: Line items as score facts: the ship year's parity the corpus, the return flag the system.
_FACTS = {
    "n_ref_chars": "l_quantity * 10", "ins": "l_linenumber", "dele": "l_quantity % 7", "sub": "l_suppkey % 300", "n_ref_words": "l_quantity * 2", "word_edits": "l_partkey % 60", "n_punct_ref": "l_quantity",
    "punct_kept": "l_quantity - l_quantity % 3", "n_caps_read": "l_linenumber + 1", "caps_lowered": "l_linenumber % 2", "n_num_ref": "l_linenumber % 4", "num_kept": "l_linenumber % 2", "n_num_hyp": "l_linenumber % 3", "n_lines_matched": "l_quantity - l_quantity % 5",
    "n_lines_ref": "l_quantity", "n_sub_words": "l_partkey % 9", "real_word_sub": "l_partkey % 3", "n_glyph_ref": "l_suppkey % 5", "glyph_kept": "l_suppkey % 2", "n_glyph_hyp": "l_suppkey % 4",
}
_FACTS_SQL = f"SELECT l_returnflag AS system, CASE WHEN l_linestatus = 'F' THEN 'abp' ELSE 'other' END AS corpus, l_discount > 0.08 AS error, {', '.join(f'{_count(v)} AS {k}' for k, v in _FACTS.items())} FROM lineitem"


@query("profile_grouping_sets", f"""WITH f AS ({_FACTS_SQL}), g AS (SELECT system, corpus, count(*) AS n_pages, sum(CAST(error AS INTEGER)) AS n_failed, sum(least(ins + dele + sub, n_ref_chars)) AS ce, sum(n_ref_chars) AS nc, sum(least(word_edits, n_ref_words)) AS we, sum(n_ref_words) AS nw,
sum(CASE WHEN corpus = 'abp' THEN glyph_kept ELSE 0 END) AS gk, sum(CASE WHEN corpus = 'abp' THEN n_glyph_ref ELSE 0 END) AS gr, sum(CASE WHEN corpus = 'abp' THEN n_glyph_hyp ELSE 0 END) AS gh,
sum(punct_kept) AS pk, sum(n_punct_ref) AS pr, sum(caps_lowered) AS cl, sum(n_caps_read) AS cr, sum(num_kept) AS nk, sum(n_num_ref) AS nr, sum(n_num_hyp) AS nh, sum(n_lines_matched) AS lm, sum(n_lines_ref) AS lr, sum(real_word_sub) AS rw, sum(n_sub_words) AS sw
FROM f GROUP BY GROUPING SETS ((system), (system, corpus))),
r AS (SELECT *, {Q.ratio('ce', 'nc')} AS cer_page, {Q.ratio('we', 'nw')} AS wer_page, {Q.f1('gk', 'gr', 'gh')} AS glyph_f1, {Q.ratio('pk', 'pr')} AS punct_kept, 1 - {Q.ratio('cl', 'cr')} AS caps_kept, {Q.f1('nk', 'nr', 'nh')} AS numeral_f1, {Q.ratio('lm', 'lr')} AS line_recall, {Q.ratio('rw', 'sw')} AS real_word_share FROM g)
SELECT system, corpus, n_pages, CAST(n_failed AS BIGINT) AS n_failed, 1 - cer_page AS char_accuracy, 1 - wer_page AS word_accuracy, (coalesce(glyph_f1, 0) + coalesce(punct_kept, 0) + coalesce(caps_kept, 0)) / (CAST(glyph_f1 IS NOT NULL AS INTEGER) + CAST(punct_kept IS NOT NULL AS INTEGER) + CAST(caps_kept IS NOT NULL AS INTEGER)) AS fidelity,
cer_page, wer_page, glyph_f1, punct_kept, caps_kept, numeral_f1, line_recall, real_word_share FROM r""")
def profile_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rates of a system, and of a system and corpus, from one scan; `profile_intervals` has the bootstrap intervals too, which SQL can't repeat."""
    return profile.text_rates(_line_facts(spark, sf_dir), [["system"], ["system", "corpus"]])


def _line_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = [F.expr(v).cast("long").alias(k) for k, v in _FACTS.items()]
    page = (F.col("l_orderkey").cast("long") * 8 + F.col("l_linenumber")).alias("page_id")
    return table(spark, sf_dir, "lineitem").select(page, F.col("l_returnflag").alias("system"), F.when(F.col("l_linestatus") == "F", "abp").otherwise("other").alias("corpus"), (F.col("l_discount") > 0.08).alias("error"), *counts)


@query("profile_intervals")
def profile_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same table whole, with intervals of 1000 resamples."""
    return profile.text_scores(_line_facts(spark, sf_dir), [["system"], ["system", "corpus"]])


@query("profile_of_turns")
def profile_of_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole table of each system, and of each system and corpus; pages are scored once, for the rates and the intervals of both grains."""
    scored(spark, sf_dir).write.parquet(path := f"{_scratch(spark)}/scores")
    return profile.text_scores(spark.read.parquet(path), [["system_id"], ["system_id", "corpus"]])


@query("corpora_table", f"""SELECT source AS corpus, count(*) AS n_pages, CAST(sum(n_chars) AS BIGINT) AS n_lines, CAST(sum(len({Q.split_lines('text')})) AS BIGINT) AS n_lines_scored, CAST(sum(len({Q.tokens('text')})) AS BIGINT) AS n_words, count(*) FILTER (toxic = 1) AS n_judge_sample_pages
FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source""")
def corpora_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    pages = pages.select(F.col("source").alias("corpus"), F.col("text").alias("gt_text"), F.col("n_chars").alias("n_lines_gt"), F.coalesce(F.col("toxic") == 1, F.lit(False)).alias("judge_sample"))
    return profile.corpora(pages)


@query("runs_table", """SELECT event_type, user_id, count(*) AS n_pages, count(*) FILTER (value > 100) AS n_failed, min(ts) AS started_at, max(ts) AS finished_at, CAST(row_number() OVER (PARTITION BY event_type ORDER BY user_id) - 1 AS INTEGER) AS run_idx,
event_type || '__r' || CAST(row_number() OVER (PARTITION BY event_type ORDER BY user_id) - 1 AS VARCHAR) AS run_id FROM events GROUP BY event_type, user_id""")
def runs_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = _events(spark, sf_dir).groupBy("event_type", "user_id").agg(F.count("*").alias("n_pages"), F.count_if(F.col("value") > 100).alias("n_failed"), F.min("ts").alias("started_at"), F.max("ts").alias("finished_at"))
    return facts.numbered(runs, ["event_type"], [F.col("user_id")], "run_idx").withColumn("run_idx", F.col("run_idx").cast("int")).withColumn("run_id", F.concat("event_type", F.lit("__r"), F.col("run_idx").cast("string")))


@query("extremes", """WITH t AS (SELECT c_mktsegment AS name, avg(c_acctbal) AS balance, count(*) AS n, max(c_custkey) AS last FROM customer GROUP BY 1),
u AS (SELECT name, 'balance' AS metric, balance AS v FROM t UNION ALL SELECT name, 'n', n FROM t UNION ALL SELECT name, 'last', last FROM t)
SELECT metric, min(CASE WHEN v = hi THEN name END) AS highest, min(CASE WHEN v = lo THEN name END) AS lowest FROM (SELECT *, max(v) OVER (PARTITION BY metric) AS hi, min(v) OVER (PARTITION BY metric) AS lo FROM u) GROUP BY metric""")
def extremes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("name")).agg(F.avg("c_acctbal").alias("balance"), F.count("*").alias("n"), F.max("c_custkey").alias("last"))
    return profile.extremes(rows, "name", ["balance", "n", "last"])


@query("claims_check", """WITH m AS (SELECT l_returnflag AS flag, avg(l_discount) AS value FROM lineitem GROUP BY 1), c(flag, printed, decimals) AS (VALUES ('A', 0.05, 2), ('N', 0.5, 1), ('R', 0.1, 1), ('X', 0.1, 1))
SELECT c.flag, value, CAST(printed AS DOUBLE) AS printed, coalesce(abs(value - printed) <= 0.5 * pow(10.0, -decimals) + 1e-9, false) AS ok FROM c LEFT JOIN m USING (flag)""")
def claims_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    claims = spark.createDataFrame([("A", 0.05, 2), ("N", 0.5, 1), ("R", 0.1, 1), ("X", 0.1, 1)], "flag string, printed double, decimals int")
    metrics = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("flag")).agg(F.avg("l_discount").alias("value"))
    return profile.check_claims(claims, metrics, ["flag"]).select("flag", "value", "printed", "ok")


@query("bootstrap_ci", """WITH f AS (SELECT l_returnflag AS system, l_orderkey, sum(l_quantity * l_discount) AS num, sum(l_quantity) AS den FROM lineitem GROUP BY ALL),
p AS (SELECT system, num, den, row_number() OVER (PARTITION BY system ORDER BY l_orderkey) - 1 AS i, count(*) OVER (PARTITION BY system) AS n FROM f),
d AS (SELECT system, rep, (rep * 7919 + i * 104729 + rep * i) % n AS i FROM p, (SELECT unnest(generate_series(0, 39)) AS rep)),
r AS (SELECT d.system, rep, sum(num) / nullif(sum(den), 0) AS rate FROM d JOIN p ON d.system = p.system AND d.i = p.i GROUP BY ALL)
SELECT system, quantile_cont(rate, 0.025) AS lo, quantile_cont(rate, 0.975) AS hi FROM r GROUP BY system""")
def bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sketch of 40 resamples, by draws that its SQL repeats; `bootstrap_interval` has the operator's 1000."""
    return bootstrap.indexed(_order_pages(spark, sf_dir, "system"), ["system"], "num", "den", "l_orderkey", 40)


def _order_pages(spark: SparkSession, sf_dir: str, system: str) -> DataFrame:
    """Each system's share of an order as a page."""
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias(system), "l_orderkey").agg(F.sum(F.col("l_quantity") * F.col("l_discount")).alias("num"), F.sum("l_quantity").alias("den"))


@query("bootstrap_interval")
def bootstrap_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bootstrap.interval(_order_pages(spark, sf_dir, "system"), ["system"], "num", "den", "l_orderkey")


@query("bootstrap_poisson")
def bootstrap_poisson(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of an order are drawn together, so they are summed before they are resampled."""
    return bootstrap.poisson(_order_pages(spark, sf_dir, "l_returnflag"), ["l_returnflag"], "num", "den", "l_orderkey")


# ---------------------------------------------------------------------------------------------- verdicts
@query("kappa", """WITH n AS (SELECT count(*) AS n, sum(CAST(quality = toxic AS INTEGER)) AS same, sum(quality) AS q, sum(toxic) AS t FROM labels), e AS (SELECT n, same / n AS o, (q * t + (n - q) * (n - t)) / (n * n) AS x FROM (SELECT CAST(n AS DOUBLE) AS n, same, CAST(q AS DOUBLE) AS q, CAST(t AS DOUBLE) AS t FROM n))
SELECT CAST(n AS BIGINT) AS n, CASE WHEN x < 1 THEN (o - x) / (1 - x) ELSE 1.0 END AS kappa FROM e""")
def kappa(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judging.kappa(table(spark, sf_dir, "labels"), [], "quality", "toxic")


@query("verdict_shares", "SELECT source, count(*) AS n, avg(CAST(toxic AS DOUBLE)) AS share_toxic, avg(CAST(quality AS DOUBLE)) AS share_good FROM labels JOIN documents USING (doc_id) GROUP BY source")
def verdict_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    return rows.groupBy("source").agg(F.count("*").alias("n"), F.avg("toxic").alias("share_toxic"), F.avg("quality").alias("share_good"))


@query("f1_labels", f"SELECT source, {Q.f1('k', 'r', 'h')} AS f1 FROM (SELECT source, sum(CAST(quality = 0 AND toxic = 1 AS INTEGER)) AS k, sum(1 - quality) AS r, sum(toxic) AS h FROM labels JOIN documents USING (doc_id) GROUP BY source)")
def f1_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    sums = rows.groupBy("source").agg(F.sum((1 - F.col("quality")) * F.col("toxic")).alias("k"), F.sum(1 - F.col("quality")).alias("r"), F.sum("toxic").alias("h"))
    return sums.select("source", R.f1(F.col("k"), F.col("r"), F.col("h")).alias("f1"))


_TYPE = f"CASE event_id % 4 {' '.join(f'WHEN {i} THEN {Q.quote(t)}' for i, t in enumerate(('Number', 'garble', 'name_error', 'no such type')))} END"
_VERDICT = "CASE event_id % 3 WHEN 0 THEN 'Usable.' WHEN 1 THEN 'quite Misleading' ELSE 'needs correction' END"
_RAW = f"""'{{"spans":[{{"type":"' || {_TYPE} || '","severity":' || CAST(event_id % 7 AS VARCHAR) || '}}],"verdict":"' || {_VERDICT} || '","note":"' || event_type || '"}}'"""


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as reviewers' replies: the type is the system, two events in turn are the passes of a line."""
    names = F.array(*map(F.lit, ("Number", "garble", "name_error", "no such type")))
    labels = F.array(*map(F.lit, ("Usable.", "quite Misleading", "needs correction")))
    n = F.col("event_id")
    raw = F.concat(F.lit('{"spans":[{"type":"'), F.element_at(names, (n % 4 + 1).cast("int")), F.lit('","severity":'), (n % 7).cast("string"), F.lit('}],"verdict":"'), F.element_at(labels, (n % 3 + 1).cast("int")), F.lit('","note":"'), F.col("event_type"), F.lit('"}'))
    log = facts.spread(table(spark, sf_dir, "events").select("event_id", "event_type", "user_id"))  # one small file would be one task's
    return log.select(n, F.col("event_type").alias("system_id"), F.col("user_id").alias("page_id"), raw.alias("raw"))


@query("parse_verdicts", """SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'number_error' WHEN 1 THEN 'garble' WHEN 2 THEN 'name_error' ELSE 'garble' END AS type, CAST(least(2, event_id % 7) AS INTEGER) AS severity,
CASE event_id % 3 WHEN 0 THEN 'usable' WHEN 1 THEN 'misleading' ELSE 'needs_correction' END AS verdict, event_type AS note FROM events""")
def parse_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _judged(spark, sf_dir).select("event_id", once(judging.parse(F.col("raw"))).alias("p"))
    return rows.select("event_id", F.col("p.spans")[0]["type"].alias("type"), F.col("p.spans")[0]["severity"].alias("severity"), "p.verdict", "p.note")


_SHARES = ", ".join(f"avg(CAST(verdict = '{v}' AS DOUBLE)) FILTER (pass_idx = 0) AS share_{v}" for v in C.VERDICTS)
_RATES = ", ".join(f"100.0 * count(*) FILTER (pass_idx = 0 AND type = '{t}') / nullif(sum(CASE WHEN pass_idx = 0 THEN words END), 0) AS {t}_per_100w" for t in C.SPAN_TYPES)


@query("judge_table", f"""WITH e AS (SELECT event_type AS system_id, user_id AS page_id, event_id, row_number() OVER (PARTITION BY event_type, user_id ORDER BY event_id) - 1 AS k, event_id % 5 + 1 AS words,
CASE event_id % 4 WHEN 0 THEN 'number_error' WHEN 1 THEN 'garble' WHEN 2 THEN 'name_error' ELSE 'garble' END AS type, CASE event_id % 3 WHEN 0 THEN 'usable' WHEN 1 THEN 'misleading' ELSE 'needs_correction' END AS verdict FROM events),
j AS (SELECT *, k // 2 AS line_idx, k % 2 AS pass_idx FROM e),
p AS (SELECT a.system_id, a.verdict AS x, b.verdict AS y FROM j a JOIN j b USING (system_id, page_id, line_idx) WHERE a.pass_idx = 0 AND b.pass_idx = 1),
o AS (SELECT system_id, count(*) AS n, avg(CAST(x = y AS DOUBLE)) AS o FROM p GROUP BY 1),
x AS (SELECT system_id, sum(nx * ny) AS c FROM (SELECT system_id, v, count(*) FILTER (s = 0) AS nx, count(*) FILTER (s = 1) AS ny FROM (SELECT system_id, x AS v, 0 AS s FROM p UNION ALL SELECT system_id, y, 1 FROM p) GROUP BY ALL) GROUP BY 1),
k AS (SELECT system_id, (o - c / (CAST(n AS DOUBLE) * n)) / (1 - c / (CAST(n AS DOUBLE) * n)) AS kappa_verdict FROM o JOIN x USING (system_id))
SELECT j.system_id, count(*) FILTER (pass_idx = 0) AS n_lines, CAST(sum(CASE WHEN pass_idx = 0 THEN words END) AS BIGINT) AS n_ref_words, {_RATES}, {_SHARES}, avg(CAST(verdict = 'misleading' AS DOUBLE)) AS share_misleading_both_passes, any_value(kappa_verdict) AS kappa_verdict FROM j JOIN k USING (system_id) GROUP BY j.system_id""")
def judge_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.row_number().over(Window.partitionBy("system_id", "page_id").orderBy("event_id")) - 1
    rows = _judged(spark, sf_dir).withColumns({"k": k, "ref": F.repeat(F.lit("w "), (F.col("event_id") % 5 + 1).cast("int"))}).select("*", once(judging.parse(F.col("raw"))).alias("p"))
    return judging.table(rows.select("system_id", "page_id", (F.col("k") / 2).cast("int").alias("line_idx"), (F.col("k") % 2).alias("pass_idx"), "ref", "p.verdict", "p.spans"))


@query("sample_round_robin", f"""WITH c AS (SELECT DISTINCT event_type AS system, user_id % 4 AS corpus, user_id AS page, CAST(value AS BIGINT) % 5 AS line FROM events),
l AS (SELECT corpus, page, line, count(DISTINCT system) AS ns, (page * 7919 + line * 104729) % 10007 AS o FROM c GROUP BY ALL),
t AS (SELECT *, row_number() OVER (PARTITION BY corpus ORDER BY ns DESC, o, page, line) AS turn FROM l),
s AS (SELECT c.system, c.corpus, c.page, c.line, row_number() OVER (PARTITION BY c.system ORDER BY turn, c.corpus, c.page, c.line) AS place FROM c JOIN t USING (corpus, page, line))
SELECT system, corpus, page, line, CAST(place AS INTEGER) AS place FROM s WHERE place <= 100""")
def sample_round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hundred lines of each system, in one order they share."""
    c = F.col
    rows = table(spark, sf_dir, "events").select(c("event_type").alias("system"), (c("user_id") % 4).alias("corpus"), c("user_id").alias("page"), (F.bround("value").cast("long") % 5).alias("line")).distinct()
    return judging.sample(rows, "corpus", "system", ["page", "line"], 100, (c("page") * 7919 + c("line") * 104729) % 10007).select("system", "corpus", "page", "line", "place")


@query("judge_candidates")
def judge_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as pages, their roles as corpora; the turns of every eighth conversation are flagged."""
    turns = table(spark, sf_dir, "conversations").select(F.format_string("%d-%d", "conv_id", "turn").alias("page_id"), F.col("role").alias("corpus"), F.col("text").alias("gt_text"), (F.col("conv_id") % 8 == 0).alias("judge_sample"))
    said = turns.where("judge_sample").select("page_id", F.explode(readings(F.col("gt_text"))).alias("r"))
    return judging.candidates(turns, said.select(F.concat("r.system", F.lit("__r0")).alias("run_id"), "r.system", "page_id", F.col("r.hyp").alias("text"), F.lit(None).cast("string").alias("error")).withColumnRenamed("system", "system_id"))


@query("sample_of_candidates")
def sample_of_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hundred lines of each system that pass the reviewers' filter."""
    judge_candidates(spark, sf_dir).write.parquet(path := f"{_scratch(spark)}/candidates")
    rows = judging.sample(spark.read.parquet(path), "corpus", "system_id", ["page_id", "line_idx"], 100, F.xxhash64("page_id", "line_idx"))
    return rows.select("system_id", "corpus", "page_id", "line_idx", "ref", "hyp", "context_before", "context_after", "place")


@query("integrity", f"""WITH f AS ({_FACTS_SQL}), m AS (SELECT l_returnflag AS system, avg(CAST(l_linenumber % 3 = 1 AS DOUBLE)) AS misleading FROM lineitem GROUP BY 1),
g AS (SELECT system, corpus, sum(num_kept) AS nk, sum(n_num_ref) AS nr, sum(n_num_hyp) AS nh FROM f GROUP BY GROUPING SETS ((system), (system, corpus))), r AS (SELECT system, corpus, {Q.f1('nk', 'nr', 'nh')} AS numeral_f1 FROM g)
SELECT system, corpus, numeral_f1, CASE WHEN corpus IS NULL THEN (1 - misleading + numeral_f1) / 2 ELSE numeral_f1 END AS integrity FROM r JOIN m USING (system)""")
def integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rates of `profile_grouping_sets` with integrity; every third line number is a misleading verdict."""
    misleading = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("system")).agg(F.avg((F.col("l_linenumber") % 3 == 1).cast("double")).alias("misleading"))
    scores = profile.text_rates(_line_facts(spark, sf_dir), [["system"], ["system", "corpus"]])
    return profile.with_integrity(scores, misleading, "system").select("system", "corpus", "numeral_f1", "integrity")


@query("full_coverage", """WITH p AS (SELECT user_id % 4 AS corpus, event_type AS system_id, user_id FROM events), c AS (SELECT corpus, count(DISTINCT user_id) AS n_pages FROM p GROUP BY 1)
SELECT corpus, system_id, n_pages FROM (SELECT corpus, system_id, count(DISTINCT user_id) AS n_pages FROM p GROUP BY ALL) JOIN c USING (corpus, n_pages)""")
def full_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types of events that all users of a corpus have."""
    pages = table(spark, sf_dir, "events").select((F.col("user_id") % 4).alias("corpus"), F.col("event_type").alias("system_id"), "user_id")
    corpora = pages.groupBy("corpus").agg(F.count_distinct("user_id").alias("n_pages"))
    return profile.full_coverage(pages.groupBy("corpus", "system_id").agg(F.count_distinct("user_id").alias("n_pages")), corpora)


@query("corpus_years", """SELECT o_orderpriority AS corpus, CAST(1992 AS INTEGER) AS "from", CAST(1998 AS INTEGER) AS "to", CAST(min(year(o_orderdate)) AS INTEGER) AS first, CAST(max(year(o_orderdate)) AS INTEGER) AS last, min(year(o_orderdate)) >= 1992 AND max(year(o_orderdate)) <= 1998 AS ok FROM orders GROUP BY 1""")
def corpus_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as pages, their priority as the corpus, against a printed range."""
    found = profile.years(table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("corpus"), F.year("o_orderdate").alias("year")))
    claims = found.select("corpus", F.lit(1992).alias("from"), F.lit(1998).alias("to"))
    return profile.check_years(claims, found)


@query("judge_prompts", """SELECT conv_id, turn, 'Ref: ' || text || ' {json} before ' || CASE WHEN b = '' THEN '(start of page)' ELSE b END || ' after ' || CASE WHEN a = '' THEN '(end of page)' ELSE a END AS prompt
FROM (SELECT conv_id, turn, text, lag(text, 1, '') OVER w AS b, lead(text, 1, '') OVER w AS a FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))""")
def judge_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = facts.contexts(table(spark, sf_dir, "conversations"), "conv_id", "turn", "text")
    none = F.lit("")
    made = judging.prompt("Ref: {ref} {{json}} before {context_before} after {context_after}", F.col("text"), none, F.col("context_before"), F.col("context_after"), none, none)
    return rows.select("conv_id", "turn", made.alias("prompt"))


# ---------------------------------------------------------------------------------------------- nested and markup
@query("json_props", "SELECT event_type, count(*) AS n, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS total FROM events GROUP BY event_type")
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).groupBy("event_type").agg(F.count("*").alias("n"), F.sum(F.from_json("props", "k bigint")["k"]).alias("total"))


@query("xml_lines", """SELECT item_id, CAST(0 AS INTEGER) AS line_idx, 'b' AS region, 'l2' AS line, CAST(3 AS INTEGER) AS n_points, CAST(30 AS INTEGER) AS x1, md5('second ' || regexp_replace(text, '[<&]', '', 'g')) AS md5 FROM benchmark
UNION ALL SELECT item_id, 1, 'a', 'l1', 3, 30, md5(regexp_replace(text, '[<&]', '', 'g')) FROM benchmark""")
def xml_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item as a page of two regions, the second of which is read first."""
    def line(name: str, text) -> list:
        return [F.lit(f'<TextLine id="{name}"><Coords points="1,2 30.7,2 x 30,40"/><TextEquiv index="1"><Unicode>no</Unicode></TextEquiv><TextEquiv index="0"><Unicode>'), F.regexp_replace(text, "[<&]", ""), F.lit("</Unicode></TextEquiv></TextLine>")]

    order = '<ReadingOrder><OrderedGroup><RegionRefIndexed index="1" regionRef="a"/><RegionRefIndexed index="0" regionRef="b"/></OrderedGroup></ReadingOrder>'
    xml = F.concat(F.lit(f'<PcGts xmlns="urn:page"><Page imageFilename="p.jpg" imageWidth="1000" imageHeight="2000">{order}<TextRegion id="a">'), *line("l1", F.col("text")), F.lit('</TextRegion><TextRegion id="b">'), *line("l2", F.concat(F.lit("second "), "text")), F.lit("</TextRegion></Page></PcGts>"))
    rows = pagexml.lines(table(spark, sf_dir, "benchmark").select("item_id", xml.alias("xml")))
    return rows.select("item_id", "line_idx", "region", "line", F.size("polygon").alias("n_points"), pagexml.box(F.col("polygon"))["x1"].alias("x1"), F.md5("text").alias("md5"))


@query("checksums", "SELECT page_id, sha256(html) AS sha256 FROM pages")
def checksums(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.sha2("html", 256).alias("sha256"))


@query("preflight_tokens", "SELECT role, count(*) AS n_calls, CAST(sum(length(text) // 4 + 20) AS BIGINT) AS tokens_in, 180 * count(*) AS tokens_out FROM conversations GROUP BY role")
def preflight_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").groupBy("role").agg(F.count("*").alias("n_calls"), F.sum(F.expr("length(text) div 4 + 20")).alias("tokens_in"), (180 * F.count("*")).alias("tokens_out"))


@query("multiset_union", "SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels UNION ALL SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels WHERE toxic = 1")
def multiset_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids without a verdict, and ids with a bad one."""
    docs, labels = table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels")
    return docs.subtract(labels.select("doc_id")).unionByName(docs.intersect(labels.where("toxic = 1").select("doc_id")))
