"""The registered queries of this subpackage and the SQL that gives the same rows."""

from __future__ import annotations

from .conversation_trie import OP11_SQL, op11_trie
from .decontaminate import OP5_SQL, op5_decontaminate
from .exact_dedup import OP7_SQL, op7_exact_dedup
from .langid import op2_langid
from .licenses import OP10_SQL, op10_licenses
from .mixing import OP9_SQL, op9_mix
from .near_dedup import OP8_SQL, op8_near_dedup
from .packing import op13_pack
from .pages import OP1_SQL, op1_extract
from .quality import op3_quality
from .secrets import OP6_SQL, op6_secrets
from .token_alignment import op12_align
from .topk import OP4_SQL, op4_topk

QUERIES = {"op1_extract": op1_extract, "op2_langid": op2_langid, "op3_quality": op3_quality, "op4_topk": op4_topk, "op5_decontaminate": op5_decontaminate, "op6_secrets": op6_secrets, "op7_exact_dedup": op7_exact_dedup, "op8_near_dedup": op8_near_dedup, "op9_mix": op9_mix, "op10_licenses": op10_licenses, "op11_trie": op11_trie, "op12_align": op12_align, "op13_pack": op13_pack}
ORACLE_SQL = {"op1_extract": OP1_SQL, "op4_topk": OP4_SQL, "op5_decontaminate": OP5_SQL, "op6_secrets": OP6_SQL, "op7_exact_dedup": OP7_SQL, "op8_near_dedup": OP8_SQL, "op9_mix": OP9_SQL, "op10_licenses": OP10_SQL, "op11_trie": OP11_SQL}
