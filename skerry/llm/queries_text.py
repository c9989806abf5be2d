"""p6, p7 and p8: token ids, a mixture by source, and subject areas of the corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skerry.llm.bpe import count_tokens, encode_corpus
from skerry.llm.mixture import mix
from skerry.llm.subjects import subject_areas
from skerry.runtime import table


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_corpus(table(spark, sf_dir, "documents"))


def _mixed(spark: SparkSession, sf_dir: str, total: float | str | None = None) -> tuple[DataFrame, DataFrame]:
    docs = count_tokens(table(spark, sf_dir, "documents").select("doc_id", F.trim(F.lower("source")).alias("source"), "text"))
    return mix(docs, table(spark, sf_dir, "mix_targets"), "source", "doc_id", "n_tokens", total)


def p7_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, source, size in tokens, and how often the document stands in the mixture."""
    return _mixed(spark, sf_dir)[0]


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixed(spark, sf_dir)[1]


def p7_available_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of a mixture as large as all sources with a target: scarce ones give all their repeats, others fill up."""
    return _mixed(spark, sf_dir, "available")[1]


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _areas(spark, sf_dir).select("doc_id", "subject")


def _areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subject_areas(*[table(spark, sf_dir, t) for t in ("documents", "subject_examples", "subjects")])


def p8_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Make-up of the corpus by subject: documents that treat it, and their sentences on it."""
    return _areas(spark, sf_dir).groupBy("subject").agg(F.count(F.lit(1)).alias("documents"), F.sum("sentences").alias("sentences"))


QUERIES = {"p6_ids": p6_ids, "p7_mixture": p7_mixture, "p7_shares": p7_shares, "p7_available_shares": p7_available_shares, "p8_found": p8_found, "p8_composition": p8_composition}
SQL: dict[str, str] = {}
