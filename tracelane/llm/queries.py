"""The queries of this subpackage, by name, and SQL for those that SQL can express."""

from __future__ import annotations

from . import ann, exact_topk, langid, mixing, ngram_join, pii, sharding, spm, toxicity, warc

QUERIES = {
    "op1_language_id": langid.query,
    "op2_toxicity": toxicity.query,
    "op3_ngram_jaccard_join": ngram_join.query,
    "op4_pii": pii.query,
    "op5_sentencepiece": spm.query,
    "op6_mixing": mixing.query,
    "op7_sharding": sharding.query,
    "op8_exact_topk": exact_topk.query,
    "op9_warc": warc.query,
    "op10_ann": ann.query,
}
ORACLES = {"op3_ngram_jaccard_join": ngram_join.ORACLE, "op6_mixing": mixing.ORACLE, "op8_exact_topk": exact_topk.ORACLE, "op9_warc": warc.ORACLE}
