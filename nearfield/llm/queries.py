"""The queries of the llm operators, over whole tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from nearfield.llm.language_id import op1_language_id
from nearfield.llm.merkle import op7_merkle_fingerprint
from nearfield.llm.mixing import op4_source_mixing
from nearfield.llm.ngram_join import op2_ngram_join
from nearfield.llm.oracles import OP2, OP6, OP7, OP8
from nearfield.llm.packing import op3_best_fit_packing
from nearfield.llm.pii import op9_personal_data
from nearfield.llm.quality_model import op5_quality_resampling
from nearfield.llm.quality_rules import op8_quality_rules
from nearfield.llm.secret_scan import op6_secret_scan
from nearfield.llm.token_files import op10_token_files

QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_ngram_join": op2_ngram_join,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_source_mixing": op4_source_mixing,
    "op5_quality_resampling": op5_quality_resampling,
    "op6_secret_scan": op6_secret_scan,
    "op7_merkle_fingerprint": op7_merkle_fingerprint,
    "op8_quality_rules": op8_quality_rules,
    "op9_personal_data": op9_personal_data,
    "op10_token_files": op10_token_files,
}

#: Tokenising, fitted models, seeded sampling and expectation-maximisation are beyond SQL; their tests hold them against plain versions.
ORACLES: dict[str, str] = {
    "op2_ngram_join": OP2,
    "op6_secret_scan": OP6,
    "op7_merkle_fingerprint": OP7,
    "op8_quality_rules": OP8,
}
