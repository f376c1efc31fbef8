"""The corpus operators' queries, with SQL where SQL can express them."""

from __future__ import annotations

from .chat import op4, op4_sql
from .decontam import op12, op12_sql
from .jaccard import op7
from .langid import op9
from .media import op2
from .mixing import op6, op6_sql
from .packing import op1
from .quality import op5
from .repair import op13, op13_sql
from .resample import op11, op11_sql
from .rules import op8
from .urlfilter import op10, op10_sql
from .warc import op3, op3_sql

QUERIES = {
    "op1_pack_windows": op1,
    "op2_media_columns": op2,
    "op3_warc_ranges": op3,
    "op4_chat_prefixes": op4,
    "op5_quality_classifier": op5,
    "op6_mix_sources": op6,
    "op7_jaccard_join": op7,
    "op8_quality_rules": op8,
    "op9_language_id": op9,
    "op10_url_cascade": op10,
    "op11_importance_resample": op11,
    "op12_decontaminate": op12,
    "op13_repair_turns": op13,
}

SQL = {
    "op3_warc_ranges": op3_sql(),
    "op10_url_cascade": op10_sql(),
    "op4_chat_prefixes": op4_sql(),
    "op6_mix_sources": op6_sql(),
    "op11_importance_resample": op11_sql(),
    "op12_decontaminate": op12_sql(),
    "op13_repair_turns": op13_sql(),
}
