"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from .ann import op7_learned_partitions
from .bpe import op10_byte_bpe
from .embed_dedup import OP2_SQL, op2_embedding_dedup
from .hard_negatives import OP11_SQL, op11_hard_negatives
from .merkle import OP13_SQL, op13_merkle
from .packing import op8_curve_packing
from .pii import op9_pii
from .quality import op1_quality
from .sharding import op5_sampled_splitters
from .simhash import op3_simhash
from .token_planes import op4_token_planes
from .toxicity import op6_toxicity
from .url_filter import OP12_SQL, op12_url_filter

QUERIES = {
    "op1_quality": op1_quality,
    "op2_embedding_dedup": op2_embedding_dedup,
    "op3_simhash": op3_simhash,
    "op4_token_planes": op4_token_planes,
    "op5_sampled_splitters": op5_sampled_splitters,
    "op6_toxicity": op6_toxicity,
    "op7_learned_partitions": op7_learned_partitions,
    "op8_curve_packing": op8_curve_packing,
    "op9_pii": op9_pii,
    "op10_byte_bpe": op10_byte_bpe,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_url_filter": op12_url_filter,
    "op13_merkle": op13_merkle,
}
#: The others learn, hash or tokenize in ways that SQL can't; tests hold them against plain versions.
ORACLES = {"op2_embedding_dedup": OP2_SQL, "op11_hard_negatives": OP11_SQL, "op12_url_filter": OP12_SQL, "op13_merkle": OP13_SQL}
