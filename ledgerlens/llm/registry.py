"""Queries of the training-data operators, and DuckDB SQL where SQL can express them."""

from __future__ import annotations

from ledgerlens.llm.chat import op3_chat
from ledgerlens.llm.decontamination import OP9_SQL, op9_decontaminate
from ledgerlens.llm.html_text import op1_html
from ledgerlens.llm.knn import OP5_SQL, op5_knn
from ledgerlens.llm.language import op4_language
from ledgerlens.llm.line_dedup import OP2_SQL, op2_lines
from ledgerlens.llm.mixing import OP6_SQL, op6_mix
from ledgerlens.llm.sharding import op10_shard
from ledgerlens.llm.simhash import op7_simhash
from ledgerlens.llm.toxicity import op8_toxicity

QUERIES = {
    "op1_html": op1_html,
    "op2_lines": op2_lines,
    "op3_chat": op3_chat,
    "op4_language": op4_language,
    "op5_knn": op5_knn,
    "op6_mix": op6_mix,
    "op7_simhash": op7_simhash,
    "op8_toxicity": op8_toxicity,
    "op9_decontaminate": op9_decontaminate,
    "op10_shard": op10_shard,
}
ORACLES = {"op2_lines": OP2_SQL, "op5_knn": OP5_SQL, "op6_mix": OP6_SQL, "op9_decontaminate": OP9_SQL}
