"""The registered queries of this subpackage and their DuckDB twins."""

from __future__ import annotations

import public_tokenizers

from sqltally.llm import alignment, bpe, collocations, hamming, jaccard, licenses, lines, neardup, packing, quality, secrets, spotsigs, toxicity
from sqltally.llm.common import read

QUERIES = {
    "op1_license_scan": lambda spark, d: licenses.query(read(spark, d, "documents")),
    "op2_secret_scan": lambda spark, d: secrets.query(read(spark, d, "documents")),
    "op3_byte_bpe": lambda spark, d: bpe.query(
        read(spark, d, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN),
    "op4_line_dedup": lambda spark, d: lines.query(read(spark, d, "documents")),
    "op5_toxicity": lambda spark, d: toxicity.query(read(spark, d, "documents"), read(spark, d, "labels")),
    "op6_quality_bayes": lambda spark, d: quality.query(read(spark, d, "documents"), read(spark, d, "labels")),
    "op7_order_minhash": lambda spark, d: neardup.query(read(spark, d, "documents")),
    "op8_best_two_fit": lambda spark, d: packing.query(
        read(spark, d, "documents"), public_tokenizers.path("byte_bpe_50k.json")),
    "op9_hamming_topk": lambda spark, d: hamming.query(read(spark, d, "embeddings")),
    "op10_spotsigs": lambda spark, d: spotsigs.query(read(spark, d, "documents")),
    "op11_token_alignment": lambda spark, d: alignment.query(
        read(spark, d, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")),
    "op12_collocations": lambda spark, d: collocations.query(read(spark, d, "documents")),
    "op13_jaccard_join": lambda spark, d: jaccard.query(read(spark, d, "documents")),
}

ORACLE = {
    "op1_license_scan": licenses.oracle_sql(),
    "op4_line_dedup": lines.ORACLE,
    "op6_quality_bayes": quality.oracle_sql(),
    "op9_hamming_topk": hamming.ORACLE,
    "op10_spotsigs": spotsigs.ORACLE,
    "op12_collocations": collocations.ORACLE,
    "op13_jaccard_join": jaccard.ORACLE,
}
