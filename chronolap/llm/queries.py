"""The operators over their whole tables, by query name, and the SQL where it can express them."""

import public_tokenizers

from chronolap.llm import bpe, langid, licenses, lines, media, near, packing, scoring, substrings, topk
from chronolap.session import table

QUERIES = {
    "op1_lm_scoring": lambda s, d: scoring.query(table(s, d, "documents")),
    "op2_license_scan": lambda s, d: licenses.query(table(s, d, "documents")),
    "op3_minhash_forest": lambda s, d: near.near_duplicates(table(s, d, "documents"), 3, 85),
    "op4_language_id": lambda s, d: langid.query(table(s, d, "documents")),
    "op5_substring_dedup": lambda s, d: substrings.query(table(s, d, "documents")),
    "op6_line_dedup": lambda s, d: lines.query(table(s, d, "documents")),
    "op7_best_fit_packing": lambda s, d: packing.query(table(s, d, "documents"), public_tokenizers.path("word_bpe_49k.json")),
    "op8_exact_topk": lambda s, d: topk.query(table(s, d, "embeddings")),
    "op9_media_columns": lambda s, d: media.query(table(s, d, "documents")),
    "op10_byte_bpe": lambda s, d: bpe.query(table(s, d, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN),
}

ORACLE = {"op8_exact_topk": topk.SQL}
