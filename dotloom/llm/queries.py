"""Queries of this subpackage by name, and DuckDB SQL where SQL can express them."""

from dotloom.llm.decontam import op10_decontaminate
from dotloom.llm.jaccard import op4_jaccard
from dotloom.llm.lines import OP11_SQL, op11_lines
from dotloom.llm.media import op5_media
from dotloom.llm.pii import op6_pii
from dotloom.llm.quality import op1_quality
from dotloom.llm.spiece import op9_sentencepiece
from dotloom.llm.snapshots import OP13_SQL, op13_snapshots
from dotloom.llm.substring import OP8_SQL, op8_substring
from dotloom.llm.suffixes import op3_suffixes
from dotloom.llm.toxicity import op7_toxicity
from dotloom.llm.whitening import op12_whitening
from dotloom.llm.warc import OP2_SQL, op2_warc

QUERIES = {
    "op1_quality": op1_quality,
    "op2_warc": op2_warc,
    "op3_suffixes": op3_suffixes,
    "op4_jaccard": op4_jaccard,
    "op5_media": op5_media,
    "op6_pii": op6_pii,
    "op7_toxicity": op7_toxicity,
    "op8_substring": op8_substring,
    "op9_sentencepiece": op9_sentencepiece,
    "op10_decontaminate": op10_decontaminate,
    "op11_lines": op11_lines,
    "op12_whitening": op12_whitening,
    "op13_snapshots": op13_snapshots,
}

ORACLE_SQL: dict[str, str] = {
    "op2_warc": OP2_SQL,
    "op8_substring": OP8_SQL,
    "op11_lines": OP11_SQL,
    "op13_snapshots": OP13_SQL,
}
