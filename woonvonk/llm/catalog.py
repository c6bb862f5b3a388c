"""The registered queries of this package and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from woonvonk.llm import (
    bag_search, bpe, html_crf, line_dedup, ngram_join, nn_descent, packing, quotes, rules, runs, surrogates, token_files, toxicity,
)

JOBS: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_html_extraction": html_crf.op1,
    "op2_pack_sequences": packing.op2,
    "op3_nn_descent": nn_descent.op3,
    "op4_ngram_join": ngram_join.op4,
    "op5_byte_bpe": bpe.op5,
    "op6_line_dedup": line_dedup.op6,
    "op7_quotation_linking": quotes.op7,
    "op8_rule_ledger": rules.op8,
    "op9_surrogates": surrogates.op9,
    "op10_toxicity": toxicity.op10,
    "op11_periodic_runs": runs.op11,
    "op12_bag_search": bag_search.op12,
    "op13_token_files": token_files.op13,
}

SQL: dict[str, str] = {
    "op3_nn_descent": nn_descent.OP3_SQL,
    "op4_ngram_join": ngram_join.OP4_SQL,
    "op6_line_dedup": line_dedup.OP6_SQL,
    "op7_quotation_linking": quotes.OP7_SQL,
    "op8_rule_ledger": rules.OP8_SQL,
    "op12_bag_search": bag_search.OP12_SQL,
}


def jobs() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(JOBS)


def sql() -> dict[str, str]:
    return dict(SQL)
