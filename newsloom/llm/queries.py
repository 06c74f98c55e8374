"""The registered queries of the numbered operators: each applies one to its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from newsloom.llm import divergence, license_scan, resample, url_filter, warc
from newsloom.llm.ann import search
from newsloom.llm.chat_tools import format_chats
from newsloom.llm.common import table
from newsloom.llm.decontaminate import find_leaks
from newsloom.llm.mixing import mixed
from newsloom.llm.quality import score_quality
from newsloom.llm.simhash import near_duplicates
from newsloom.llm.token_store import read_tokens, write_tokens
from newsloom.llm.toxicity import score_toxicity

#: Target weights of the mixture: the largest source is held to a tenth, the others share the rest evenly.
TARGET_WEIGHTS = {"src0": 0.10} | {f"src{i}": 0.90 / 19 for i in range(1, 20)}


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(table(spark, sf_dir, "documents"))


def op3_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages"))


def op5_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_tokens(spark, write_tokens(table(spark, sf_dir, "documents"), tokenizer_path()))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(table(spark, sf_dir, "documents").select("doc_id", "source"), TARGET_WEIGHTS)


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.read_archives(spark, warc.write_archives(table(spark, sf_dir, "pages")))


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chats(table(spark, sf_dir, "conversations"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resample.resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), carry=["doc_id"])
    return out.select("doc_id", "n_features", "weight", "score", "rank")


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": op1_quality,
    "op2_license_scan": op2_license_scan,
    "op3_ann": op3_ann,
    "op4_url_filter": op4_url_filter,
    "op5_token_store": op5_token_store,
    "op6_mixing": op6_mixing,
    "op7_decontamination": op7_decontamination,
    "op8_warc": op8_warc,
    "op9_chat_format": op9_chat_format,
    "op10_simhash": op10_simhash,
    "op11_divergence": op11_divergence,
    "op12_resampling": op12_resampling,
    "op13_toxicity": op13_toxicity,
}

#: DuckDB SQL, where it can express the query.
ORACLES: dict[str, str] = {"op2_license_scan": license_scan.oracle(), "op4_url_filter": url_filter.ORACLE, "op8_warc": warc.ORACLE, "op11_divergence": divergence.ORACLE, "op12_resampling": resample.ORACLE}
