"""The queries of the training-data operators, by name."""

from __future__ import annotations

from veilspark.llm.embeddings import op2_embeddings
from veilspark.llm.exact import op9_exact
from veilspark.llm.html import op10_html
from veilspark.llm.mixing import op4_mixing
from veilspark.llm.packing import op5_packing
from veilspark.llm.pii import op6_pii
from veilspark.llm.quality import op1_quality
from veilspark.llm.simhash import op3_simhash
from veilspark.llm.toxicity import op8_toxicity
from veilspark.llm.urls import op7_urls

QUERIES = {f.__name__: f for f in (op1_quality, op2_embeddings, op3_simhash, op4_mixing, op5_packing, op6_pii, op7_urls, op8_toxicity, op9_exact, op10_html)}
#: None can be said in SQL: models, xxhash and tokenizers have no SQL form.  tests/llm holds them against brute force.
ORACLES: dict[str, str] = {}
