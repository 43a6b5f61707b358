"""The queries of this subpackage and their SQL, for the registry."""

from . import decontam, embeddings, jaccard, packing, substring, suffix, tokenout, toxicity, urls, warc

QUERIES = {
    "op1_substring_dedup": substring.query,
    "op2_toxicity": toxicity.query,
    "op3_best_fit_packing": packing.query,
    "op4_embedding_near_dedup": embeddings.query,
    "op5_ngram_jaccard_join": jaccard.query,
    "op6_benchmark_decontamination": decontam.query,
    "op7_url_filters": urls.query,
    "op8_warc": warc.query,
    "op9_suffix_array_dedup": suffix.query,
    "op10_token_output": tokenout.query,
}
#: The others have no SQL that fits (see README); they are tested against brute force.
SQL = {
    "op1_substring_dedup": substring.SQL,
    "op4_embedding_near_dedup": embeddings.SQL,
    "op5_ngram_jaccard_join": jaccard.SQL,
    "op7_url_filters": urls.SQL,
    "op8_warc": warc.SQL,
    "op9_suffix_array_dedup": suffix.SQL,
}
