"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from undertext.llm import decontam, jaccard, licenses, lm, mixing, packing, quality, runs, tokencount, tokenstore, turns, urls, warc

QUERIES = {
    "op1_mix_sources": mixing.op1_mix_sources,
    "op2_decontaminate": decontam.op2_decontaminate,
    "op3_license_scan": licenses.op3_license_scan,
    "op4_token_counts": tokencount.op4_token_counts,
    "op5_ngram_jaccard": jaccard.op5_ngram_jaccard,
    "op6_lm_scoring": lm.op6_lm_scoring,
    "op7_quality_rules": quality.op7_quality_rules,
    "op8_url_filters": urls.op8_url_filters,
    "op9_warc_archive": warc.op9_warc_archive,
    "op10_token_store": tokenstore.op10_token_store,
    "op11_periodic_runs": runs.op11_periodic_runs,
    "op12_best_fit_packing": packing.op12_best_fit_packing,
    "op13_conversation_repair": turns.op13_conversation_repair,
}

SQL: dict[str, str] = {
    "op8_url_filters": urls.SQL,
    "op9_warc_archive": warc.SQL,
}
