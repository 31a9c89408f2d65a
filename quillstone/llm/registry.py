"""The queries of this subpackage, and the pipeline that stands at the top of the repository."""

from __future__ import annotations

from corpus_pipeline import run as pipeline

from .audit import SQL as AUDIT_SQL
from .audit import op13_audit
from .decontaminate import SQL as DECONTAMINATION_SQL
from .decontaminate import op10_decontaminate
from .html import op3_html
from .katz import op4_katz
from .lines import SQL as LINES_SQL
from .lines import op9_lines
from .quality import SQL as QUALITY_SQL
from .quality import op2_quality
from .sentencepieces import op5_sentencepiece
from .sharding import op8_sharding
from .simhash import op1_simhash
from .spelling import op12_spelling
from .suffixes import op7_suffixes
from .token_counts import op6_token_counts
from .token_files import op11_token_files

QUERIES = {q.__name__: q for q in (op1_simhash, op2_quality, op3_html, op4_katz, op5_sentencepiece, op6_token_counts, op7_suffixes, op8_sharding, op9_lines, op10_decontaminate, op11_token_files, op12_spelling, op13_audit)} | {"pipeline": pipeline}
ORACLES: dict[str, str] = {"op2_quality": QUALITY_SQL, "op9_lines": LINES_SQL, "op10_decontaminate": DECONTAMINATION_SQL, "op13_audit": AUDIT_SQL}
