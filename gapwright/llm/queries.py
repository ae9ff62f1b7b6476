"""Registered queries of this subpackage, and the DuckDB SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers

from ..session import table
from .bpe import bpe_query
from .collocations import COLLOCATIONS_SQL, collocations_query
from .line_dedup import line_dedup_query
from .media import media_query
from .minhash import minhash_query
from .packing import packing_query
from .quality_classifier import classifier_query
from .quality_rules import RULES_SQL, rules_query
from .secrets import SECRETS_SQL, secrets_query
from .spelling import spelling_query
from .token_files import token_files_query
from .toxicity import toxicity_query
from .warc import WARC_SQL, warc_query

BYTE_BPE, WORD_BPE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")

QUERIES = {
    "op1_line_dedup": lambda spark, sf: line_dedup_query(table(spark, sf, "documents")),
    "op2_media": lambda spark, sf: media_query(table(spark, sf, "documents")),
    "op3_packing": lambda spark, sf: packing_query(table(spark, sf, "documents"), BYTE_BPE),
    "op4_quality_rules": lambda spark, sf: rules_query(table(spark, sf, "documents")),
    "op5_quality_classifier": lambda spark, sf: classifier_query(table(spark, sf, "documents"), table(spark, sf, "labels")),
    "op6_bpe": lambda spark, sf: bpe_query(table(spark, sf, "documents"), BYTE_BPE),
    "op7_toxicity": lambda spark, sf: toxicity_query(table(spark, sf, "documents"), table(spark, sf, "labels")),
    "op8_token_files": lambda spark, sf: token_files_query(table(spark, sf, "documents"), WORD_BPE),
    "op9_minhash": lambda spark, sf: minhash_query(table(spark, sf, "documents")),
    "op10_warc": lambda spark, sf: warc_query(table(spark, sf, "pages")),
    "op11_secrets": lambda spark, sf: secrets_query(table(spark, sf, "documents")),
    "op12_spelling": lambda spark, sf: spelling_query(table(spark, sf, "documents")),
    "op13_collocations": lambda spark, sf: collocations_query(table(spark, sf, "documents")),
}
ORACLE_SQL: dict[str, str] = {"op4_quality_rules": RULES_SQL, "op10_warc": WARC_SQL, "op11_secrets": SECRETS_SQL, "op13_collocations": COLLOCATIONS_SQL}
