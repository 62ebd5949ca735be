"""The subpackage's queries and their SQL."""

from . import decontaminate, language, language_model, line_dedup, packing, pii, quality_classifier, quality_rules, simhash, token_files

QUERIES = {
    "op1_simhash": simhash.op1_simhash,
    "op2_quality_rules": quality_rules.op2_quality_rules,
    "op3_pii": pii.op3_pii,
    "op4_decontaminate": decontaminate.op4_decontaminate,
    "op5_language": language.op5_language,
    "op6_packing": packing.op6_packing,
    "op7_line_dedup": line_dedup.op7_line_dedup,
    "op8_token_files": token_files.op8_token_files,
    "op9_language_model": language_model.op9_language_model,
    "op10_quality_classifier": quality_classifier.op10_quality_classifier,
}
ORACLES = {
    "op2_quality_rules": quality_rules.ORACLE_SQL,
    "op7_line_dedup": line_dedup.ORACLE_SQL,
}
