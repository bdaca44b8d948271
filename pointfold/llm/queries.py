"""The queries of this subpackage, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pointfold.llm.bpe import op7_bpe
from pointfold.llm.chat import OP2_SQL, op2_chat_format
from pointfold.llm.hard_negatives import OP12_SQL, op12_hard_negatives
from pointfold.llm.imatch import op9_imatch
from pointfold.llm.jaccard_join import op5_jaccard_join
from pointfold.llm.line_dedup import OP3_SQL, op3_line_dedup
from pointfold.llm.lz_dedup import op4_lz_dedup
from pointfold.llm.mixing import op8_mix_sources
from pointfold.llm.quality import op13_quality
from pointfold.llm.suffix_dedup import op1_suffix_dedup
from pointfold.llm.toxicity import op10_toxicity
from pointfold.llm.vector_graph import op6_vector_graph
from pointfold.llm.whitening import op11_whitening

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_suffix_dedup, op2_chat_format, op3_line_dedup, op4_lz_dedup, op5_jaccard_join, op6_vector_graph, op7_bpe, op8_mix_sources, op9_imatch, op10_toxicity, op11_whitening, op12_hard_negatives, op13_quality)}

SQL: dict[str, str] = {"op2_chat_format": OP2_SQL, "op3_line_dedup": OP3_SQL, "op12_hard_negatives": OP12_SQL}
