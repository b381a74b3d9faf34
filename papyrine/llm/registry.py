"""The queries of this subpackage and, where SQL can express one, its DuckDB SQL."""

from __future__ import annotations

from papyrine.llm import bpe, embeddings, fingerprint, fmindex, langid, mixing, quality, simhash, suffixes, urlfilter


def queries() -> dict:
    return {
        "op1_bpe": bpe.op1_bpe,
        "op2_url_filter": urlfilter.op2_url_filter,
        "op3_mixing": mixing.op3_mixing,
        "op4_language": langid.op4_language,
        "op5_simhash": simhash.op5_simhash,
        "op6_embeddings": embeddings.op6_embeddings,
        "op7_quality": quality.op7_quality,
        "op8_substrings": fmindex.op8_substrings,
        "op9_suffixes": suffixes.op9_suffixes,
        "op10_fingerprint": fingerprint.op10_fingerprint,
    }


def oracle_sql() -> dict[str, str]:
    return {"op8_substrings": fmindex.OP8_SQL, "op9_suffixes": suffixes.OP9_SQL}
