"""Queries of this folder and their SQL."""

from __future__ import annotations

from .bpe import op1_byte_bpe
from .chat import OP2_SQL, op2_chat
from .collocations import OP12_SQL, op12_collocations
from .decontam import OP5_SQL, op5_decontamination
from .fingerprints import op10_fingerprints
from .html_extract import OP4_SQL, op4_html
from .line_dedup import OP9_SQL, op9_line_dedup
from .ngram_join import OP7_SQL, op7_ngram_join
from .periodic_runs import op11_periodic_runs
from .quality import op8_quality
from .sharding import op6_sharding
from .token_counts import op13_token_counts
from .warc import OP3_SQL, op3_warc

QUERIES = {
    "op1_byte_bpe": op1_byte_bpe,
    "op2_chat": op2_chat,
    "op3_warc": op3_warc,
    "op4_html": op4_html,
    "op5_decontamination": op5_decontamination,
    "op6_sharding": op6_sharding,
    "op7_ngram_join": op7_ngram_join,
    "op8_quality": op8_quality,
    "op9_line_dedup": op9_line_dedup,
    "op10_fingerprints": op10_fingerprints,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_collocations": op12_collocations,
    "op13_token_counts": op13_token_counts,
}

ORACLE_SQL: dict[str, str] = {
    "op2_chat": OP2_SQL,
    "op3_warc": OP3_SQL,
    "op4_html": OP4_SQL,
    "op5_decontamination": OP5_SQL,
    "op7_ngram_join": OP7_SQL,
    "op9_line_dedup": OP9_SQL,
    "op12_collocations": OP12_SQL,
}
