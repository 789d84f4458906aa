"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from sievewright.llm.embedding_dups import OP2_SQL, op2_embedding_dups
from sievewright.llm.html_extraction import op10_html_extraction
from sievewright.llm.license_scan import OP13_SQL, op13_license_scan
from sievewright.llm.merkle_manifest import OP12_SQL, op12_merkle_manifest
from sievewright.llm.packing import op7_best_fit_packing
from sievewright.llm.pii import op5_pii
from sievewright.llm.quality_classifier import op6_quality_classifier
from sievewright.llm.quality_rules import OP9_SQL, op9_quality_rules
from sievewright.llm.sentencepiece_codec import op1_sentencepiece
from sievewright.llm.simhash import op8_simhash
from sievewright.llm.source_audit import OP11_SQL, op11_source_audit
from sievewright.llm.suffix_tree import op3_lm_scoring
from sievewright.llm.warc import OP4_SQL, op4_warc

QUERIES = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_embedding_dups": op2_embedding_dups,
    "op3_lm_scoring": op3_lm_scoring,
    "op4_warc": op4_warc,
    "op5_pii": op5_pii,
    "op6_quality_classifier": op6_quality_classifier,
    "op7_best_fit_packing": op7_best_fit_packing,
    "op8_simhash": op8_simhash,
    "op9_quality_rules": op9_quality_rules,
    "op10_html_extraction": op10_html_extraction,
    "op11_source_audit": op11_source_audit,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_license_scan": op13_license_scan,
}
SQL = {"op2_embedding_dups": OP2_SQL, "op4_warc": OP4_SQL, "op9_quality_rules": OP9_SQL, "op11_source_audit": OP11_SQL, "op12_merkle_manifest": OP12_SQL, "op13_license_scan": OP13_SQL}
