"""Registered queries of the training-data operators, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

import corpus_pipeline
from canopy.llm import (conversation_repair, decontaminate, exact_dedup, lang_id, ngram_join, order_minhash, periodic_runs, pii, quality,
                        sentencepiece_scan, sharding, url_filter, warc)
from canopy.llm.common import LlmQuery

LLM_QUERIES: dict[str, LlmQuery] = {
    "op1_exact_dedup": LlmQuery(exact_dedup.op1_exact_dedup, exact_dedup.SQL),
    "op2_ngram_join": LlmQuery(ngram_join.op2_ngram_join),
    "op3_pii": LlmQuery(pii.op3_pii),
    "op4_quality": LlmQuery(quality.op4_quality),
    "op5_sentencepiece": LlmQuery(sentencepiece_scan.op5_sentencepiece),
    "op6_decontaminate": LlmQuery(decontaminate.op6_decontaminate),
    "op7_url_filter": LlmQuery(url_filter.op7_url_filter, url_filter.SQL),
    "op8_sharding": LlmQuery(sharding.op8_sharding),
    "op9_warc": LlmQuery(warc.op9_warc, warc.SQL),
    "op10_lang_id": LlmQuery(lang_id.op10_lang_id),
    "op11_fingerprints": LlmQuery(order_minhash.op11_fingerprints),
    "op12_periodic_runs": LlmQuery(periodic_runs.op12_periodic_runs),
    "op13_conversation_repair": LlmQuery(conversation_repair.op13_conversation_repair),
    "pipeline": LlmQuery(corpus_pipeline.run, corpus_pipeline.ORACLE_SQL),
}
