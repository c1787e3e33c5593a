"""Queries of the training-data operators, and their SQL."""

from __future__ import annotations

from corpus_pipeline import ORACLE_SQL, run

from .chat import OP3_SQL, op3_chat_rotation
from .decontaminate import op10_decontamination
from .fill_middle import OP13_SQL, op13_fill_in_middle
from .jaccard_join import op9_jaccard_join
from .license_scan import op1_license_scan
from .near_duplicates import op11_near_duplicates
from .packing import op5_packing
from .pii import op8_pii
from .quality import op6_quality
from .ranked_search import OP12_SQL, op12_ranked_search
from .suffix_dedup import op7_suffix_dedup
from .token_files import op2_token_files
from .warc_zip import op4_warc_zip

QUERIES = {
    "pipeline": run,
    "op1_license_scan": op1_license_scan,
    "op2_token_files": op2_token_files,
    "op3_chat_rotation": op3_chat_rotation,
    "op4_warc_zip": op4_warc_zip,
    "op5_packing": op5_packing,
    "op6_quality": op6_quality,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_pii": op8_pii,
    "op9_jaccard_join": op9_jaccard_join,
    "op10_decontamination": op10_decontamination,
    "op11_near_duplicates": op11_near_duplicates,
    "op12_ranked_search": op12_ranked_search,
    "op13_fill_in_middle": op13_fill_in_middle,
}
SQL: dict[str, str] = {
    "op3_chat_rotation": OP3_SQL,
    "op12_ranked_search": OP12_SQL,
    "op13_fill_in_middle": OP13_SQL,
}
if ORACLE_SQL:
    SQL["pipeline"] = ORACLE_SQL
