"""The registered queries of this subpackage and their SQL."""

from tarn.llm import exact_dedup, jaccard_join, lm, mixing, packing, quality, sharding, substring_dedup, toxicity, url_filters
from tarn.session import shipped

QUERIES = {
    "op1_url_filters": url_filters.op1_url_filters,
    "op2_mixing": mixing.op2_mixing,
    "op3_lm_scoring": lm.op3_lm_scoring,
    "op4_packing": packing.op4_packing,
    "op5_jaccard_join": jaccard_join.op5_jaccard_join,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_quality": quality.op7_quality,
    "op8_sharding": sharding.op8_sharding,
    "op9_exact_dedup": exact_dedup.op9_exact_dedup,
    "op10_substring_dedup": substring_dedup.op10_substring_dedup,
}
QUERIES = {name: shipped(f) for name, f in QUERIES.items()}

SQL = {
    "op1_url_filters": url_filters.SQL,
    "op2_mixing": mixing.SQL,
    "op5_jaccard_join": jaccard_join.SQL,
    "op9_exact_dedup": exact_dedup.SQL,
    "op10_substring_dedup": substring_dedup.SQL,
}
