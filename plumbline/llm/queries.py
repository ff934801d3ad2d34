"""The queries of the corpus operators, and the SQL that checks those which SQL can express."""

from __future__ import annotations

from plumbline.llm.classifier import op10_quality_classifier
from plumbline.llm.conversation_repair import op11_conversation_repair
from plumbline.llm.decontamination import OP2_SQL, op2_decontamination
from plumbline.llm.hamming_search import op12_hamming_search
from plumbline.llm.host_rules import OP6_SQL, op6_host_rules
from plumbline.llm.licenses import OP9_SQL, op9_licenses
from plumbline.llm.mixing import op3_mixing
from plumbline.llm.ngram_join import op8_ngram_jaccard
from plumbline.llm.ngram_lm import op5_lm_scores
from plumbline.llm.paragraph_dedup import op4_paragraph_dedup
from plumbline.llm.pii import op1_pii
from plumbline.llm.target_sampling import OP13_SQL, op13_target_sampling
from plumbline.llm.warc import op7_warc

QUERIES = {
    "op1_pii": op1_pii,
    "op2_decontamination": op2_decontamination,
    "op3_mixing": op3_mixing,
    "op4_paragraph_dedup": op4_paragraph_dedup,
    "op5_lm_scores": op5_lm_scores,
    "op6_host_rules": op6_host_rules,
    "op7_warc": op7_warc,
    "op8_ngram_jaccard": op8_ngram_jaccard,
    "op9_licenses": op9_licenses,
    "op10_quality_classifier": op10_quality_classifier,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_hamming_search": op12_hamming_search,
    "op13_target_sampling": op13_target_sampling,
}

ORACLE_SQL = {"op2_decontamination": OP2_SQL, "op6_host_rules": OP6_SQL, "op9_licenses": OP9_SQL, "op13_target_sampling": OP13_SQL}
