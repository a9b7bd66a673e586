"""The subpackage's queries and their SQL."""

from __future__ import annotations

from mixlode.llm import jaccard, langid, licenses, mixing, mpeg, packing, sharding, tokencount, vectors, warc


def queries() -> dict:
    ops = [sharding.op1_sharding, mixing.op2_mixing, jaccard.op3_jaccard_join, packing.op4_packing, tokencount.op5_token_counts, mpeg.op6_media, langid.op7_language_id, warc.op8_warc, vectors.op9_embedding_dedup, licenses.op10_licenses]
    return {f.__name__: f for f in ops}


def oracle_sql() -> dict[str, str]:
    return {"op2_mixing": mixing.SQL, "op3_jaccard_join": jaccard.SQL, "op8_warc": warc.SQL, "op9_embedding_dedup": vectors.SQL, "op10_licenses": licenses.sql()}
