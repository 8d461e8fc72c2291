"""Registered queries of this subpackage, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from geohotspots.llm import (
    decontaminate,
    license_scan,
    line_dedup,
    page_wrappers,
    periodic_runs,
    pfair_mix,
    pii_lstm,
    pitman_yor,
    quality_crf,
    rule_ledger,
    secret_cnn,
    simhash_bk,
    spelling_variants,
)
from geohotspots.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality_crf.train(docs, table(spark, sf_dir, "labels"))
    return quality_crf.score(docs, model).select("doc_id", "held_out", "score", "predicted")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_report(table(spark, sf_dir, "documents"))


def op3_char_lstm_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pii_lstm.personal_data(docs, pii_lstm.train(docs))


def op4_rule_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rule_ledger.verdicts(table(spark, sf_dir, "documents"))


def op5_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.overlaps(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    )


def op6_char_cnn_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return secret_cnn.secrets(docs, secret_cnn.train(docs))


def op7_pfair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return pfair_mix.mix(docs)


def op8_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pitman_yor.score(table(spark, sf_dir, "documents"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op10_simhash_bktree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_bk.near_duplicates(table(spark, sf_dir, "documents"))


def op11_basic_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.run_report(table(spark, sf_dir, "documents"))


def op12_wrappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_wrappers.page_texts(table(spark, sf_dir, "pages"))


def op13_partenum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants.variants(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    q.__name__: q
    for q in (
        op1_line_crf,
        op2_line_dedup,
        op3_char_lstm_pii,
        op4_rule_ledger,
        op5_spaced_seeds,
        op6_char_cnn_secrets,
        op7_pfair_mix,
        op8_pitman_yor,
        op9_license_scan,
        op10_simhash_bktree,
        op11_basic_factors,
        op12_wrappers,
        op13_partenum,
    )
}

ORACLES: dict[str, str] = {
    "op4_rule_ledger": rule_ledger.oracle_sql(),
    "op5_spaced_seeds": decontaminate.oracle_sql(),
    "op7_pfair_mix": pfair_mix.oracle_sql(),
}
