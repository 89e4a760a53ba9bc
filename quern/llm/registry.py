"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from importlib import import_module

#: Query name: module of this package that has it, under the same name.
MODULES = {
    "op10_secret_ledger": "secret_ledger",
    "op4_personal_data": "personal_data",
    "op5_jaccard_groups": "jaccard_groups",
    "op6_weak_quality": "weak_quality",
    "op7_bpe_rounds": "bpe",
    "op8_bpe_counts": "bpe",
    "op1_warc_revisits": "warc_revisits",
    "op2_template_leaks": "template_leaks",
    "op3_subword_classifier": "subword_classifier",
    "op9_feistel_shards": "feistel_shards",
}


def queries() -> dict:
    return {name: getattr(import_module(f"quern.llm.{module}"), name) for name, module in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    found = {name: getattr(import_module(f"quern.llm.{module}"), "ORACLE_SQL", None) for name, module in MODULES.items()}
    return {name: sql for name, sql in found.items() if sql}
