"""The numbered queries over the driver's tables, and SQL for those that SQL can express."""

from __future__ import annotations

import corpus_pipeline
from histmetrics.llm import (
    chat,
    codes,
    html_text,
    minhash,
    mixing,
    negatives,
    packing,
    quality,
    rules,
    secret_scan,
    suffixes,
    toxicity,
    vectors,
)
from histmetrics.llm.common import table

QUERIES = {
    "pipeline": corpus_pipeline.run,
    "op1_quality_classifier": lambda spark, sf: quality.classify_documents(
        table(spark, sf, "documents"), table(spark, sf, "labels")
    ),
    "op2_minhash_near_dedup": lambda spark, sf: minhash.near_duplicates(table(spark, sf, "documents")),
    "op3_mix_sources": lambda spark, sf: mixing.mix_documents(table(spark, sf, "documents")),
    "op4_suffix_dedup": lambda spark, sf: suffixes.remove_repeats(table(spark, sf, "documents")),
    "op5_toxicity": lambda spark, sf: toxicity.classify_documents(table(spark, sf, "documents"), table(spark, sf, "labels")),
    "op6_embedding_near_dedup": lambda spark, sf: vectors.near_vectors(table(spark, sf, "embeddings")),
    "op7_best_fit_packing": lambda spark, sf: packing.pack_documents(table(spark, sf, "documents")),
    "op8_html_extraction": lambda spark, sf: html_text.extract_pages(table(spark, sf, "pages")),
    "op9_secret_scans": lambda spark, sf: secret_scan.scan_documents(table(spark, sf, "documents")),
    "op10_quality_rules": lambda spark, sf: rules.quality_rules(table(spark, sf, "documents"), table(spark, sf, "labels")),
    "op11_chat_formatting": lambda spark, sf: chat.format_digests(table(spark, sf, "conversations")),
    "op12_vector_codes": lambda spark, sf: codes.compress_vectors(table(spark, sf, "embeddings")),
    "op13_hard_negatives": lambda spark, sf: negatives.mine_negatives(table(spark, sf, "embeddings")),
}

ORACLE = {
    "op3_mix_sources": mixing.SQL,
    "op11_chat_formatting": chat.SQL,
    "op12_vector_codes": codes.SQL,
    "op13_hard_negatives": negatives.SQL,
}
