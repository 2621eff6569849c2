"""The queries and oracle SQL of this subpackage."""

from __future__ import annotations

import corpus_pipeline
from docloom.llm import blocks, bpe, collocations, jaccard, merkle, packing, pii, quality, rules, secret_scan, substring, toxicity, warc


def queries():
    return {
        "op1_toxicity": toxicity.op1_toxicity,
        "op2_bpe": bpe.op2_bpe,
        "op3_packing": packing.op3_packing,
        "op4_warc": warc.op4_warc,
        "op5_exact_dedup": blocks.op5_exact_dedup,
        "op6_quality": quality.op6_quality,
        "op7_jaccard": jaccard.op7_jaccard,
        "op8_quality_rules": rules.op8_quality_rules,
        "op9_substring": substring.op9_substring,
        "op10_pii": pii.op10_pii,
        "op11_collocations": collocations.op11_collocations,
        "op12_merkle": merkle.op12_merkle,
        "op13_secrets": secret_scan.op13_secrets,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql():
    return {
        "op4_warc": warc.op4_sql(),
        "op5_exact_dedup": blocks.op5_sql(),
        "op7_jaccard": jaccard.op7_sql(),
        "op8_quality_rules": rules.op8_sql(),
        "op9_substring": substring.op9_sql(),
        "op11_collocations": collocations.op11_sql(),
        "op12_merkle": merkle.op12_sql(),
    }
