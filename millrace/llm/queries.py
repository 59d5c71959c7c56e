"""The queries of the training-data operators: name -> function of (spark, sf_dir), and their SQL."""

from __future__ import annotations

from .embed_dedup import op5_embedding_near_dedup
from .langid import op8_language_id
from .license_scan import OP4_SQL, op4_license_scan
from .mixing import OP9_SQL, op9_mixing
from .piece_sampling import op3_piece_sampling
from .quality import op10_quality
from .sharding import op1_sharding
from .simhash import op2_simhash_near_dedup
from .suffix_dedup import op7_suffix_dedup
from .topk import OP6_SQL, op6_exact_topk

QUERIES = {
    "op1_sharding": op1_sharding,
    "op2_simhash_near_dedup": op2_simhash_near_dedup,
    "op3_piece_sampling": op3_piece_sampling,
    "op4_license_scan": op4_license_scan,
    "op5_embedding_near_dedup": op5_embedding_near_dedup,
    "op6_exact_topk": op6_exact_topk,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_language_id": op8_language_id,
    "op9_mixing": op9_mixing,
    "op10_quality": op10_quality,
}

ORACLE_SQL = {
    "op4_license_scan": OP4_SQL,
    "op6_exact_topk": OP6_SQL,
    "op9_mixing": OP9_SQL,
}
