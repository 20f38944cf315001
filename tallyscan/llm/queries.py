"""Registered queries of the subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from tallyscan.llm.decontaminate import OP1_SQL, op1_decontaminate
from tallyscan.llm.embeddings import op5_embeddings
from tallyscan.llm.exactdedup import OP11_SQL, op11_copies
from tallyscan.llm.langid import op8_langid
from tallyscan.llm.linededup import OP10_SQL, op10_lines
from tallyscan.llm.negatives import OP13_SQL, op13_negatives
from tallyscan.llm.passages import op2_passages
from tallyscan.llm.pieces import op7_pieces
from tallyscan.llm.spelling import op12_spelling
from tallyscan.llm.suffixes import OP6_SQL, op6_suffixes
from tallyscan.llm.toxicity import op3_toxicity
from tallyscan.llm.warc import OP9_SQL, op9_warc
from tallyscan.llm.simhash import op4_simhash

QUERIES = {
    "op1_decontaminate": op1_decontaminate,
    "op2_passages": op2_passages,
    "op3_toxicity": op3_toxicity,
    "op4_simhash": op4_simhash,
    "op5_embeddings": op5_embeddings,
    "op6_suffixes": op6_suffixes,
    "op7_pieces": op7_pieces,
    "op8_langid": op8_langid,
    "op9_warc": op9_warc,
    "op10_lines": op10_lines,
    "op11_copies": op11_copies,
    "op12_spelling": op12_spelling,
    "op13_negatives": op13_negatives,
}
ORACLES: dict[str, str] = {
    "op1_decontaminate": OP1_SQL,
    "op6_suffixes": OP6_SQL,
    "op9_warc": OP9_SQL,
    "op10_lines": OP10_SQL,
    "op11_copies": OP11_SQL,
    "op13_negatives": OP13_SQL,
}
