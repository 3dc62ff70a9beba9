"""Queries of the training-data operators and their SQL."""

from __future__ import annotations

from . import decontaminate, language, media, oracles, packing, quality, sharding, simhash, substring, suffixes, tokenfiles


def queries() -> dict:
    return {
        "op1_suffix_dedup": suffixes.op1_suffix_dedup,
        "op2_rendezvous_shards": sharding.op2_rendezvous_shards,
        "op3_attention_quality": quality.op3_attention_quality,
        "op4_winnow_hits": decontaminate.op4_winnow_hits,
        "op5_language_id": language.op5_language_id,
        "op6_cover_dedup": substring.op6_cover_dedup,
        "op7_png_media": media.op7_png_media,
        "op8_arrow_token_file": tokenfiles.op8_arrow_token_file,
        "op10_differencing_packs": packing.op10_differencing_packs,
        "op9_simhash_components": simhash.op9_simhash_components,
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_winnow_hits": oracles.WINNOW_HITS, "op6_cover_dedup": oracles.COVER_DEDUP}
