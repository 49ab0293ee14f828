"""Queries of this subpackage for __spark_entry__.py, and their SQL where SQL can say it."""

from __future__ import annotations

from locusframe.llm import hashing, jaccard, katz, kneser, langid, media, mixing, packing, pii, runs, secrets, sharding, trie

QUERIES = {
    "op1_mixing": mixing.op1_mixing,
    "op2_media": media.op2_media,
    "op3_katz": katz.op3_katz,
    "op4_pii_surrogates": pii.op4_pii_surrogates,
    "op5_packing": packing.op5_packing,
    "op6_multi_index": hashing.op6_multi_index,
    "op7_secrets": secrets.op7_secrets,
    "op8_jaccard_join": jaccard.op8_jaccard_join,
    "op9_quality": kneser.op9_quality,
    "op10_language_id": langid.op10_language_id,
    "op11_runs": runs.op11_runs,
    "op12_trie": trie.op12_trie,
    "op13_sharding": sharding.op13_sharding,
}
ORACLES = {"op1_mixing": mixing.ORACLE, "op7_secrets": secrets.ORACLE}
