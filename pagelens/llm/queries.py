"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from pagelens.llm.decontaminate import OP9_SQL, op9_decontaminate
from pagelens.llm.fingerprint import op7_fingerprint
from pagelens.llm.langid import op8_language
from pagelens.llm.near_dedup import op4_near_dedup
from pagelens.llm.quality import op3_quality
from pagelens.llm.segment import op10_segmentations
from pagelens.llm.substring_dedup import OP1_SQL, op1_substring_dedup
from pagelens.llm.toxicity import op2_toxicity
from pagelens.llm.url_filter import OP5_SQL, op5_url_filter
from pagelens.llm.warc import OP6_SQL, op6_warc

QUERIES = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_toxicity": op2_toxicity,
    "op3_quality": op3_quality,
    "op4_near_dedup": op4_near_dedup,
    "op5_url_filter": op5_url_filter,
    "op6_warc": op6_warc,
    "op7_fingerprint": op7_fingerprint,
    "op8_language": op8_language,
    "op9_decontaminate": op9_decontaminate,
    "op10_segmentations": op10_segmentations,
}
ORACLE_SQL = {
    "op1_substring_dedup": OP1_SQL,
    "op6_warc": OP6_SQL,
    "op9_decontaminate": OP9_SQL,
    "op5_url_filter": OP5_SQL,
}
