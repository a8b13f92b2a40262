"""Text sinks: one line, or several, per individual, in output order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinspark.functions import vec
from kinspark.operators.pedigree import founder_groups_sorted


def rows_of(cells: DataFrame, values: list[Column], order: DataFrame, form: str = "%.4f", blank: bool = False) -> DataFrame:
    """value, ord: a line for every id and value, loci in order. order: id, ord.

    blank: an empty line stands before each individual."""
    stacked = F.array(*values)
    x = cells.select("id", "locus", F.posexplode(stacked).alias("row", "v"))
    x = x.groupBy("id", "row").agg(F.sort_array(F.collect_list(F.struct("locus", "v"))).alias("r"))
    text = F.concat_ws(" ", F.col("id"), F.array_join(F.transform("r", lambda r: F.printf(F.lit(form), r["v"])), " "))
    if blank:
        text = F.when(F.col("row") == 0, F.concat(F.lit("\n"), text)).otherwise(text)
    return x.join(order.select("id", "ord"), "id").select(text.alias("value"), "ord", "row")


def write(rows: DataFrame, path: str) -> None:
    """Lines in order, as a folder of text parts whose names sort in line order."""
    rows.orderBy("ord", "row").select("value").write.mode("overwrite").text(path)


def dosages(probs: DataFrame, order: DataFrame, x_chromosome: bool = False) -> DataFrame:
    male = (F.col("sex") == 0) if x_chromosome else None
    return rows_of(probs, [vec.dosage(vec.cols("x"), male)], order)


def phased(probs: DataFrame, order: DataFrame) -> DataFrame:
    return rows_of(probs, vec.cols("x"), order, blank=True)


def unphased(probs: DataFrame, order: DataFrame) -> DataFrame:
    return rows_of(probs, [F.col("x0"), F.col("x1") + F.col("x2"), F.col("x3")], order, blank=True)


def called(probs: DataFrame, order: DataFrame, threshold: float, x_chromosome: bool = False) -> DataFrame:
    male = (F.col("sex") == 0) if x_chromosome else None
    return rows_of(probs, [vec.called_genotype(vec.cols("x"), threshold, male)], order, "%d")


def haplotypes(probs: DataFrame, order: DataFrame, threshold: float) -> DataFrame:
    return rows_of(probs, list(vec.called_haplotypes(vec.cols("x"), threshold)), order, "%d")


def inheritance(state: DataFrame, order: DataFrame) -> DataFrame:
    return rows_of(state, vec.cols("s"), order)


def frequencies(aap: DataFrame) -> DataFrame:
    """Tab-separated columns of the groups, numbered ones first; a header line."""
    groups = founder_groups_sorted([r["mf"] for r in aap.select("mf").distinct().collect()])  # one row a founder group
    x = aap.groupBy("locus").agg(*[F.max(F.when(F.col("mf") == g, F.printf(F.lit("%.2f"), "p"))).alias(g) for g in groups])
    body = x.select(F.concat_ws("\t", *[F.col(f"`{g}`") for g in groups]).alias("value"), F.col("locus").alias("ord"), F.lit(0).alias("row"))
    head = aap.sparkSession.createDataFrame([("\t".join(groups), 0, 0)], "value string, ord int, row int")
    return head.unionByName(body)


def per_locus(values: DataFrame, column: str) -> DataFrame:
    return values.select(F.printf(F.lit("%f"), F.col(column)).alias("value"), F.col("locus").alias("ord"), F.lit(0).alias("row"))


def phenotype_table(table: DataFrame) -> DataFrame:
    x = table.groupBy("state").agg(F.sort_array(F.collect_list(F.struct("pheno", "p"))).alias("r"))
    return x.select(F.array_join(F.transform("r", lambda r: F.printf(F.lit("%.2f"), r["p"])), " ").alias("value"), F.col("state").alias("ord"), F.lit(0).alias("row"))


def phenotype_rows(probs: DataFrame, order: DataFrame) -> DataFrame:
    text = F.concat_ws(" ", "id", F.printf(F.lit("%.4f"), "prob"))
    text = F.when(F.col("pheno") == 0, F.concat(F.lit("\n"), text)).otherwise(text)
    return probs.join(order.select("id", "ord"), "id").select(text.alias("value"), "ord", F.col("pheno").alias("row"))
