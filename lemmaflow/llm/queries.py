"""The registered queries of this subpackage and their DuckDB counterparts."""

from __future__ import annotations

from .align import op13_align
from .fingerprint import op8_fingerprint
from .licenses import OP11_SQL, op11_license_scan
from .linededup import op9_line_dedup
from .mixing import OP4_SQL, op4_mixing
from .ngramjoin import op1_ngram_join
from .pieces import op7_sentencepiece
from .pii import op3_pii
from .quality import OP6_SQL, op6_quality
from .resample import OP12_SQL, op12_importance_resample
from .tokenstore import op5_token_store
from .toxicity import op2_toxicity
from .warc import op10_warc

QUERIES = {f.__name__: f for f in (op1_ngram_join, op2_toxicity, op3_pii, op4_mixing, op5_token_store, op6_quality, op7_sentencepiece, op8_fingerprint, op9_line_dedup, op10_warc, op11_license_scan, op12_importance_resample, op13_align)}
ORACLE_SQL: dict[str, str] = {"op4_mixing": OP4_SQL, "op6_quality": OP6_SQL, "op11_license_scan": OP11_SQL, "op12_importance_resample": OP12_SQL}
