"""The registered queries of this subpackage, and SQL where SQL can express one."""

from __future__ import annotations

from .ann import op10_neighbours
from .chat import OP1_SQL, op1_chat
from .decontamination import op2_decontamination
from .ego_join import OP12_SQL, op12_ego_join
from .html_extraction import op3_html
from .jaccard_join import OP6_SQL, op6_jaccard
from .lm_score import op5_lm
from .packing import op7_packing
from .quality import op8_quality
from .resharding import op9_resharding
from .secrets import op4_secrets
from .tiered_search import OP13_SQL, op13_tiered_search
from .token_alignment import op11_alignment

QUERIES = {
    "op1_chat": op1_chat,
    "op2_decontamination": op2_decontamination,
    "op3_html": op3_html,
    "op4_secrets": op4_secrets,
    "op5_lm": op5_lm,
    "op6_jaccard": op6_jaccard,
    "op7_packing": op7_packing,
    "op8_quality": op8_quality,
    "op9_resharding": op9_resharding,
    "op10_neighbours": op10_neighbours,
    "op11_alignment": op11_alignment,
    "op12_ego_join": op12_ego_join,
    "op13_tiered_search": op13_tiered_search,
}

ORACLE_SQL = {
    "op1_chat": OP1_SQL,
    "op6_jaccard": OP6_SQL,
    "op12_ego_join": OP12_SQL,
    "op13_tiered_search": OP13_SQL,
}
