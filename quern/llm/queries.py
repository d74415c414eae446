"""The operators as driver queries, with SQL where it can express them."""

from __future__ import annotations

from quern.llm.exact_dedup import OP9_SQL, op9_exact_dedup
from quern.llm.kd_shards import op4_kd_shards
from quern.llm.line_runs import OP12_SQL, op12_line_dedup
from quern.llm.mixing import op8_mixing
from quern.llm.packing import op3_packing
from quern.llm.pii import op7_pii
from quern.llm.quality import OP10_SQL, op10_quality
from quern.llm.simhash import op6_simhash
from quern.llm.toxicity import op2_toxicity
from quern.llm.url_filter import OP5_SQL, op5_url_filter
from quern.llm.vector_codes import OP11_SQL, op11_vector_codes
from quern.llm.warc import OP1_SQL, op1_warc
from quern.llm.whitening import op13_whitening

QUERIES = {
    f.__name__: f
    for f in (op1_warc, op2_toxicity, op3_packing, op4_kd_shards, op5_url_filter, op6_simhash, op7_pii, op8_mixing, op9_exact_dedup, op10_quality, op11_vector_codes, op12_line_dedup, op13_whitening)
}

ORACLE_SQL = {"op1_warc": OP1_SQL, "op5_url_filter": OP5_SQL, "op9_exact_dedup": OP9_SQL, "op10_quality": OP10_SQL, "op11_vector_codes": OP11_SQL, "op12_line_dedup": OP12_SQL}
