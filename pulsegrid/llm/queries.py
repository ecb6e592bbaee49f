"""The queries that this subpackage registers, and SQL for those that SQL can express."""

from .dsir import OP13_SQL, op13_dsir
from .fmindex import OP12_SQL, op12_fm_index
from .joins import OP8_SQL, op8_jaccard
from .merkle import OP11_SQL, op11_merkle
from .mix import OP6_SQL, op6_mix
from .ogg import op3_ogg
from .packing import op5_packing
from .prefix import op7_token_counts
from .quality import op1_quality
from .rules import OP4_SQL, op4_rules
from .secrets import op10_secrets
from .shards import OP9_SQL, op9_shards
from .tokens import op2_tokens

QUERIES = {"op1_quality": op1_quality, "op2_tokens": op2_tokens, "op3_ogg": op3_ogg, "op4_rules": op4_rules, "op5_packing": op5_packing, "op6_mix": op6_mix, "op7_token_counts": op7_token_counts, "op8_jaccard": op8_jaccard, "op9_shards": op9_shards, "op10_secrets": op10_secrets, "op11_merkle": op11_merkle, "op12_fm_index": op12_fm_index, "op13_dsir": op13_dsir}
ORACLES = {"op4_rules": OP4_SQL, "op6_mix": OP6_SQL, "op8_jaccard": OP8_SQL, "op9_shards": OP9_SQL, "op11_merkle": OP11_SQL, "op12_fm_index": OP12_SQL, "op13_dsir": OP13_SQL}
