"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from . import byte_bpe, decontaminate, html_template, jaccard_join, license_scan, quality_classifier, quality_rules, secret_scan, token_store, warc

QUERIES = {
    "op1_warc": warc.op1_warc,
    "op2_quality_rules": quality_rules.op2_quality_rules,
    "op3_ngram_jaccard_join": jaccard_join.op3_ngram_jaccard_join,
    "op4_license_scan": license_scan.op4_license_scan,
    "op5_html_template": html_template.op5_html_template,
    "op6_secret_scan": secret_scan.op6_secret_scan,
    "op7_quality_classifier": quality_classifier.op7_quality_classifier,
    "op8_decontamination": decontaminate.op8_decontamination,
    "op9_byte_bpe": byte_bpe.op9_byte_bpe,
    "op10_token_store": token_store.op10_token_store,
}
ORACLE_SQL = {"op1_warc": warc.OP1_SQL, "op2_quality_rules": quality_rules.OP2_SQL}
