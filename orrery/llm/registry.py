"""The queries of this subpackage by name, and DuckDB SQL for those that SQL can express."""

from .chat import OP4_SQL, op4_chat_format
from .exact import OP8_SQL, op8_exact_dedup
from .fingerprints import op5_document_fingerprint
from .html_main import op9_html_extract
from .language import op6_language_id
from .lexical import OP13_SQL, op13_lexical_search
from .negatives import OP12_SQL, op12_hard_negatives
from .packing import op10_best_fit_packing
from .pieces import op7_sentencepiece
from .repetition import op11_quality_rules
from .secrets import op1_secret_scan
from .simhash import op3_simhash
from .warc import OP2_SQL, op2_warc

QUERIES = {
    "op1_secret_scan": op1_secret_scan,
    "op2_warc": op2_warc,
    "op3_simhash": op3_simhash,
    "op4_chat_format": op4_chat_format,
    "op5_document_fingerprint": op5_document_fingerprint,
    "op6_language_id": op6_language_id,
    "op7_sentencepiece": op7_sentencepiece,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_html_extract": op9_html_extract,
    "op10_best_fit_packing": op10_best_fit_packing,
    "op11_quality_rules": op11_quality_rules,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_lexical_search": op13_lexical_search,
}

ORACLES: dict[str, str] = {
    "op2_warc": OP2_SQL,
    "op4_chat_format": OP4_SQL,
    "op8_exact_dedup": OP8_SQL,
    "op12_hard_negatives": OP12_SQL,
    "op13_lexical_search": OP13_SQL,
}
