"""Queries of this subpackage: name -> callable(spark, sf_dir), and their SQL where SQL can express them."""

from __future__ import annotations

from . import extraction, huffman, jaccard, media, mixing, packing, passages, quality, suffixes, toxicity

QUERIES = {
    "op1_quality_rules": quality.op1_quality_rules,
    "op2_substring_dedup": passages.op2_substring_dedup,
    "op3_packing": packing.op3_packing,
    "op4_mixing": mixing.op4_mixing,
    "op5_html_extraction": extraction.op5_html_extraction,
    "op6_media": media.op6_media,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_huffman": huffman.op8_huffman,
    "op9_ngram_jaccard": jaccard.op9_ngram_jaccard,
    "op10_suffix_dedup": suffixes.op10_suffix_dedup,
}
ORACLES = {"op4_mixing": mixing.OP4_SQL, "op9_ngram_jaccard": jaccard.OP9_SQL, "op10_suffix_dedup": suffixes.OP10_SQL}
