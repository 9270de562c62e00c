"""The corpus queries and the DuckDB SQL of those that SQL can express."""

from . import decontaminate, exact, packing, pii, secrets, sharding, simhash, substrings, tokenfile, toxicity

QUERIES = {
    "op1_seed_align_decontamination": decontaminate.op1_seed_align_decontamination,
    "op2_keyed_surrogates": pii.op2_keyed_surrogates,
    "op3_bm25_packing": packing.op3_bm25_packing,
    "op4_huffman_token_file": tokenfile.op4_huffman_token_file,
    "op5_ordinal_toxicity": toxicity.op5_ordinal_toxicity,
    "op6_compact_window_passages": substrings.op6_compact_window_passages,
    "op7_exact_dedup": exact.op7_exact_dedup,
    "op8_simhash_pigeonring": simhash.op8_simhash_pigeonring,
    "op9_zstd_secrets": secrets.op9_zstd_secrets,
    "op10_histogram_shards": sharding.op10_histogram_shards,
}
ORACLES = {"op7_exact_dedup": exact.ORACLE, "op8_simhash_pigeonring": simhash.ORACLE, "op10_histogram_shards": sharding.ORACLE}
