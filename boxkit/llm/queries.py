"""The registered queries of this subpackage, and the SQL that gives the same rows."""

from __future__ import annotations

from .conversation_repair import op12_conversation_repair
from .decontaminate import op2_decontaminate
from .embedding_dedup import op1_embedding_dedup
from .jaccard_join import op5_jaccard_join
from .license_scan import op10_license_scan
from .mixing import op8_mix
from .oracles import ORACLES
from .recompression_dedup import op9_recompression_dedup
from .reshard import op6_reshard
from .secret_scan import op4_secret_scan
from .spelling_groups import op11_spelling_groups
from .suffix_dedup import op7_suffix_dedup
from .toxicity import op3_toxicity
from .vector_search import op13_vector_search

QUERIES = {
    "op1_embedding_dedup": op1_embedding_dedup,
    "op2_decontaminate": op2_decontaminate,
    "op3_toxicity": op3_toxicity,
    "op4_secret_scan": op4_secret_scan,
    "op5_jaccard_join": op5_jaccard_join,
    "op6_reshard": op6_reshard,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_mix": op8_mix,
    "op9_recompression_dedup": op9_recompression_dedup,
    "op10_license_scan": op10_license_scan,
    "op11_spelling_groups": op11_spelling_groups,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_vector_search": op13_vector_search,
}

__all__ = ["ORACLES", "QUERIES"]
