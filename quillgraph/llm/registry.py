"""Queries and SQL of the training-data operators, for ``__spark_entry__.py``."""

from __future__ import annotations

from quillgraph.llm import bpe, chat, decontaminate, fingerprint, jaccard, langid, packing, secrets, sharding, substrings

QUERIES = {
    "op1_decontaminate": decontaminate.op1_decontaminate,
    "op3_bpe": bpe.op3_bpe,
    "op2_secrets": secrets.op2_secrets,
    "op4_packing": packing.op4_packing,
    "op5_shard": sharding.op5_shard,
    "op6_substrings": substrings.op6_substrings,
    "op7_fingerprint": fingerprint.op7_fingerprint,
    "op8_langid": langid.op8_langid,
    "op9_jaccard": jaccard.op9_jaccard,
    "op10_chat": chat.op10_chat,
}
ORACLE_SQL = {"op6_substrings": substrings.OP6_SQL, "op9_jaccard": jaccard.OP9_SQL, "op1_decontaminate": decontaminate.OP1_SQL, "op10_chat": chat.OP10_SQL}
