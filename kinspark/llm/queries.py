"""The corpus operators as registered queries over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict = {}
ORACLES: dict = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def register(name: str, sql: str | None = None):
    """Adds a query; the SQL, where there is any, must give the same rows."""

    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


from kinspark.llm import chat, licenses  # noqa: E402


@register("op8_license_scan")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.report(table(spark, sf_dir, "documents"))


@register("op10_chat_formatting", chat.SQL)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.report(rows.unionByName(spark.createDataFrame(chat.PLANTED, rows.schema)))


from kinspark.llm import pii, secret_scan  # noqa: E402


@register("op5_secret_scan")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.report(table(spark, sf_dir, "documents"))


@register("op7_pii")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"))


from kinspark.llm import quality_rules  # noqa: E402


@register("op1_quality_rules")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


from kinspark.llm import decontaminate  # noqa: E402


@register("op3_decontaminate", decontaminate.SQL)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


from kinspark.llm import near_dup  # noqa: E402


@register("op4_minhash_near_dup", near_dup.SQL)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.report(table(spark, sf_dir, "documents"), k=2)


from kinspark.llm import line_dedup  # noqa: E402


@register("op2_line_dedup", line_dedup.SQL)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.report(table(spark, sf_dir, "documents"))


from kinspark.llm import sentencepiece_lattice  # noqa: E402


@register("op9_sentencepiece")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_lattice.report(table(spark, sf_dir, "documents"))


from kinspark.llm import lm_score  # noqa: E402


@register("op6_lm_score")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.report(table(spark, sf_dir, "documents"))
