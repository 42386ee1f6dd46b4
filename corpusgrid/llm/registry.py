"""Queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from corpusgrid.llm.bpe import op9_bpe
from corpusgrid.llm.fingerprints import op7_fingerprints
from corpusgrid.llm.langid import op4_language_id
from corpusgrid.llm.lines import OP2_SQL, op2_line_dedup
from corpusgrid.llm.media import op1_media
from corpusgrid.llm.mixing import OP6_SQL, op6_mixing
from corpusgrid.llm.neardup import op3_near_duplicates
from corpusgrid.llm.ngramlm import op10_lm_scoring
from corpusgrid.llm.tokenfiles import op5_token_files
from corpusgrid.llm.warc import OP8_SQL, op8_warc

QUERIES = {
    "op1_media": op1_media,
    "op2_line_dedup": op2_line_dedup,
    "op3_near_duplicates": op3_near_duplicates,
    "op4_language_id": op4_language_id,
    "op5_token_files": op5_token_files,
    "op6_mixing": op6_mixing,
    "op7_fingerprints": op7_fingerprints,
    "op8_warc": op8_warc,
    "op9_bpe": op9_bpe,
    "op10_lm_scoring": op10_lm_scoring,
}
ORACLES = {"op2_line_dedup": OP2_SQL, "op6_mixing": OP6_SQL, "op8_warc": OP8_SQL}
