"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from . import centroids, chat, near, passages, phrases, pipeline, secrets, suffixes, warc
from .centroids import op11_centroids
from .chat import op5_chat
from .decontaminate import op4_decontamination
from .fingerprints import op1_fingerprints
from .near import op7_near
from .packing import op2_packing
from .passages import op13_passages
from .phrases import op12_phrases
from .quality import op6_quality
from .secrets import op9_secrets
from .suffixes import op8_suffixes
from .toxicity import op3_toxicity
from .warc import op10_warc

QUERIES = {f.__name__: f for f in (op1_fingerprints, op2_packing, op3_toxicity, op4_decontamination, op5_chat, op6_quality, op7_near, op8_suffixes, op9_secrets, op10_warc, op11_centroids, op12_phrases, op13_passages)} | {"pipeline": pipeline.run}
ORACLES = {"op5_chat": chat.ORACLE, "op7_near": near.ORACLE, "op8_suffixes": suffixes.ORACLE, "op9_secrets": secrets.ORACLE, "op10_warc": warc.ORACLE, "op11_centroids": centroids.ORACLE, "op12_phrases": phrases.ORACLE, "op13_passages": passages.ORACLE} | ({"pipeline": pipeline.ORACLE_SQL} if pipeline.ORACLE_SQL else {})
