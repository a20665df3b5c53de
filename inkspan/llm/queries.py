"""The queries of the training-data operators, and SQL where it can say the same."""

from __future__ import annotations

from .conversation_repair import ORACLE as REPAIR_SQL
from .conversation_repair import op13_conversation_repair
from .decontaminate import op7_decontamination
from .jaccard_join import op9_ngram_jaccard_join
from .language_id import op10_language_id
from .main_text import op4_main_text
from .pii import op5_pii
from .quality_rules import op2_quality_rules
from .secret_scan import ORACLE as SECRET_SQL
from .secret_scan import op11_secret_scan
from .sentencepiece_codec import op1_sentencepiece
from .transducer_counts import op8_token_counts
from .url_filter import ORACLE as URL_SQL
from .url_filter import op3_url_filter
from .vector_codes import ORACLE as VECTOR_SQL
from .vector_codes import op12_vector_codes
from .warc import ORACLE as WARC_SQL
from .warc import op6_warc

QUERIES = {f.__name__: f for f in (op1_sentencepiece, op2_quality_rules, op3_url_filter, op4_main_text, op5_pii, op6_warc, op7_decontamination, op8_token_counts, op9_ngram_jaccard_join, op10_language_id, op11_secret_scan, op12_vector_codes, op13_conversation_repair)}

ORACLES: dict[str, str] = {"op3_url_filter": URL_SQL, "op6_warc": WARC_SQL, "op11_secret_scan": SECRET_SQL, "op12_vector_codes": VECTOR_SQL, "op13_conversation_repair": REPAIR_SQL}
