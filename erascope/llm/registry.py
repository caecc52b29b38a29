"""The numbered queries and their SQL."""

from __future__ import annotations

from .chat import OP2_SQL, op2_chat
from .decontaminate import OP4_SQL, op4_decontaminate
from .fingerprints import op3_fingerprints
from .language_id import op9_language_id
from .language_model import op7_ctw
from .lexical_search import OP11_SQL, op11_lexical_search
from .mixing import op10_mixing
from .secrets import op8_secrets
from .simhash import op5_simhash
from .token_alignment import op12_token_alignment
from .token_counts import op1_token_counts
from .url_filter import OP13_SQL, op13_url_filter
from .warc import OP6_SQL, op6_warc

QUERIES = {
    "op1_token_counts": op1_token_counts,
    "op2_chat": op2_chat,
    "op3_fingerprints": op3_fingerprints,
    "op4_decontaminate": op4_decontaminate,
    "op5_simhash": op5_simhash,
    "op6_warc": op6_warc,
    "op7_ctw": op7_ctw,
    "op8_secrets": op8_secrets,
    "op9_language_id": op9_language_id,
    "op10_mixing": op10_mixing,
    "op11_lexical_search": op11_lexical_search,
    "op12_token_alignment": op12_token_alignment,
    "op13_url_filter": op13_url_filter,
}
ORACLES: dict[str, str] = {
    "op2_chat": OP2_SQL,
    "op4_decontaminate": OP4_SQL,
    "op6_warc": OP6_SQL,
    "op11_lexical_search": OP11_SQL,
    "op13_url_filter": OP13_SQL,
}
