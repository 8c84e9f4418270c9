"""The queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from gridbill.llm.alignment import op11_alignment
from gridbill.llm.bpe import op1_bpe
from gridbill.llm.decontam import ORACLE as TEMPLATE_SQL
from gridbill.llm.decontam import op9_templates
from gridbill.llm.jaccard import op3_jaccard
from gridbill.llm.mtree import ORACLE as TOP_SQL
from gridbill.llm.mtree import op10_mtree
from gridbill.llm.pii import op6_pii
from gridbill.llm.quality import op5_quality
from gridbill.llm.records import op7_records
from gridbill.llm.repair import op12_repair
from gridbill.llm.sharding import ORACLE as SHARD_SQL
from gridbill.llm.sharding import op2_sharding
from gridbill.llm.toxicity import op4_toxicity
from gridbill.llm.warc import op13_warc
from gridbill.llm.wrappers import op8_wrappers

QUERIES = {
    "op1_bpe": op1_bpe,
    "op2_sharding": op2_sharding,
    "op3_jaccard": op3_jaccard,
    "op4_toxicity": op4_toxicity,
    "op5_quality": op5_quality,
    "op6_pii": op6_pii,
    "op7_records": op7_records,
    "op8_wrappers": op8_wrappers,
    "op9_templates": op9_templates,
    "op10_mtree": op10_mtree,
    "op11_alignment": op11_alignment,
    "op12_repair": op12_repair,
    "op13_warc": op13_warc,
}
ORACLE: dict[str, str] = {"op2_sharding": SHARD_SQL, "op9_templates": TEMPLATE_SQL, "op10_mtree": TOP_SQL}
