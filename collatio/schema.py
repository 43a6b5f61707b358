"""The records' schemas, and checks that a stored record has no other fields."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


S, I, L, D, B = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType(), T.BooleanType()

FACETS = _struct(genre=S, period_bin=S, script=S, languages=T.ArrayType(S), layout_class=S, condition=S, source_type=S, provenance=S)
PAGE = _struct(page_id=S, corpus=S, image_path=S, width=I, height=I, sha256=S, gt_text=S, gt_source=S, n_lines_gt=I, facets=FACETS, year=I, judge_sample=B, notes=S)
PREDICTION = _struct(page_id=S, text=S, text_raw=S, latency_s=D, tokens_in=L, tokens_out=L, tokens_thinking=L, cost_usd=D, gpu_s=D, energy_wh=D, error=S, created_at=S)
RUN_META = _struct(run_id=S, system_id=S, model_id=S, provider=S, prompt_id=S, prompt_sha256=S, hardware=S, harness_version=S, started_at=S, finished_at=S, run_idx=I, params=T.VariantType(), gpu_name=S, git_commit=S, n_pages=I, n_errors=I, notes=S)
SYSTEM = _struct(system_id=S, label=S, runner=S, model_id=S, provider=S, family=S, hardware=S, hardware_class=S, weights=S, role=S, price_key=S)
PRICE = _struct(model_id=S, provider=S, usd_per_m_in=D, usd_per_m_out=D, usd_per_m_thinking=D, verified_on=S, source_url=S, notes=S)
SPAN = _struct(ref_span=S, hyp_span=S, type=S, severity=I)
JUDGED = _struct(system_id=S, page_id=S, line_idx=I, pass_idx=I, ref=S, hyp=S, verdict=S, note=S, spans=T.ArrayType(SPAN))
BUNDLE_TASK = _struct(page_id=S, image=S, prompt_id=S, prompt=S, model=S)
BUNDLE_PREDICTION = _struct(page_id=S, text=S, latency_s=D, tokens_in=L, tokens_out=L, error=S, energy_wh=D)
BUNDLE_RUN = _struct(gpu=S, platform=S, torch_version=S, model_revision=S, started_at=S, finished_at=S, total_wall_s=D, notes=S)

# They must be as they are for right results.
SPAN_TYPES = ("garble", "spelling_or_normalisation", "abbreviation_expansion", "meaning_preserving_substitution", "meaning_changing_substitution", "name_error", "number_error", "omission", "hallucinated_insertion", "punctuation_case")
VERDICTS = ("usable", "needs_correction", "misleading")
ALIASES = {"normalisation": "spelling_or_normalisation", "spelling": "spelling_or_normalisation", "name": "name_error", "number": "number_error", "insertion": "hallucinated_insertion", "punctuation": "punctuation_case"}
HOSTED = ("api", "transkribus")
HARDWARE_SCORES = {"cpu": 1.0, "gpu_8gb": 0.8, "gpu_24gb": 0.5, "gpu_80gb": 0.2, "api": 0.1, "transkribus": 0.1}
WEIGHTS = {"speed": 0.5, "hardware": 0.25, "price": 0.25}
SPEED, PRICE_RANGE = (1.0, 100.0), (0.001, 1.0)
EUR_PER_KWH, USD_PER_EUR, CPU_WATTS, EUR_PER_CREDIT = 0.38, 1.08, 35.0, 0.238
DIPLOMATIC = ("abp",)
