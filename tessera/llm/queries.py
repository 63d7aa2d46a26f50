"""The queries of this subpackage and, where SQL can express one, its DuckDB statement."""

from __future__ import annotations

from .bitplanes import OP13_SQL, op13_bitplanes
from .chat import OP6_SQL, op6_chat
from .collocations import OP11_SQL, op11_collocations
from .decontaminate import op3_decontaminate
from .egojoin import OP5_SQL, op5_embedding
from .licenses import op4_licences
from .lm import op2_lm
from .minhash import op7_minhash
from .mixing import OP8_SQL, op8_mixing
from .pii import op9_pii
from .substring import OP1_SQL, op1_substring
from .toxicity import op10_toxicity
from .urlfilter import OP12_SQL, op12_urls

QUERIES = {
    "op1_substring": op1_substring,
    "op2_lm": op2_lm,
    "op3_decontaminate": op3_decontaminate,
    "op4_licences": op4_licences,
    "op5_embedding": op5_embedding,
    "op6_chat": op6_chat,
    "op7_minhash": op7_minhash,
    "op8_mixing": op8_mixing,
    "op9_pii": op9_pii,
    "op10_toxicity": op10_toxicity,
    "op11_collocations": op11_collocations,
    "op12_urls": op12_urls,
    "op13_bitplanes": op13_bitplanes,
}
ORACLE = {
    "op1_substring": OP1_SQL,
    "op5_embedding": OP5_SQL,
    "op6_chat": OP6_SQL,
    "op8_mixing": OP8_SQL,
    "op11_collocations": OP11_SQL,
    "op12_urls": OP12_SQL,
    "op13_bitplanes": OP13_SQL,
}
