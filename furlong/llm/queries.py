"""The queries of this subpackage and their SQL."""

from . import bpe, exact_dedup, fingerprint, jaccard_join, language_id, mixing, pii, quality, toxicity, warc

_ALL = {
    "op1_language_id": language_id,
    "op2_bpe": bpe,
    "op3_jaccard_join": jaccard_join,
    "op4_warc": warc,
    "op5_mixing": mixing,
    "op6_quality": quality,
    "op7_fingerprint": fingerprint,
    "op8_exact_dedup": exact_dedup,
    "op9_toxicity": toxicity,
    "op10_pii": pii,
}

QUERIES = {name: module.query for name, module in _ALL.items()}
SQL = {name: module.SQL for name, module in _ALL.items() if module.SQL}
