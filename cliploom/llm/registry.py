"""The corpus queries under their registered names."""

from __future__ import annotations

from . import fingerprints, languages, licenses, media, merkle, mixing, near_copies, packing, perplexity, personal, ranked_search, substrings, token_files


def queries() -> dict:
    return {
        "op1_near_copies": near_copies.op1_near_copies,
        "op2_substrings": substrings.op2_substrings,
        "op3_token_files": token_files.op3_token_files,
        "op4_language": languages.op4_language,
        "op5_licenses": licenses.op5_licenses,
        "op6_pack": packing.op6_pack,
        "op7_fingerprints": fingerprints.op7_fingerprints,
        "op8_media": media.op8_media,
        "op9_personal": personal.op9_personal,
        "op10_mix_sources": mixing.op10_mix_sources,
        "op11_ranked": ranked_search.op11_ranked,
        "op12_perplexity": perplexity.op12_perplexity,
        "op13_merkle": merkle.op13_merkle,
    }


def oracle_sql() -> dict:
    return {"op5_licenses": licenses.OP5_SQL, "op10_mix_sources": mixing.OP10_SQL, "op11_ranked": ranked_search.OP11_SQL, "op13_merkle": merkle.OP13_SQL}
