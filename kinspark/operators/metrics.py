"""Accuracy against known values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _correlation() -> Column:
    """Pearson's r of est and real; null where one of them is constant."""
    varies = (F.max("est") - F.min("est") > 1e-12) & (F.max("real") - F.min("real") > 1e-12)
    return F.when(varies, F.covar_pop("est", "real") / F.nullif(F.stddev_pop("est") * F.stddev_pop("real"), F.lit(0.0)))


def marker_accuracy(pairs: DataFrame) -> DataFrame:
    """locus, r: correlation over individuals of est and real; none where one is constant."""
    return pairs.groupBy("locus").agg(_correlation().alias("r")).where("r is not null")


def individual_accuracy(pairs: DataFrame) -> DataFrame:
    """id, r: correlation over loci."""
    return pairs.groupBy("id").agg(_correlation().alias("r")).where("r is not null")


def mean_accuracy(rows: DataFrame) -> DataFrame:
    return rows.agg(F.round(F.avg("r"), 3).alias("accuracy"))


def report(rows: DataFrame) -> DataFrame:
    """Rows with column r, the most accurate first."""
    return rows.orderBy(F.desc("r"), *[c for c in rows.columns if c != "r"])


def realised_rates(cells: DataFrame) -> DataFrame:
    """locus, freq, error: alternative-allele frequency of real and share of wrong calls."""
    wrong = F.when(F.col("est") != 9, (F.col("est") != F.col("real")).cast("double"))
    return cells.groupBy("locus").agg((F.avg("real") / 2).alias("freq"), F.avg(wrong).alias("error"))


def mismatches(a: DataFrame, b: DataFrame) -> DataFrame:
    """n_wrong, n_unmatched: cells (id, row, locus, v) that differ or have no partner."""
    x = a.withColumnRenamed("v", "va").join(b.withColumnRenamed("v", "vb"), ["id", "row", "locus"], "full")
    alone = F.col("va").isNull() | F.col("vb").isNull()
    return x.agg(F.count_if(~alone & (F.col("va") != F.col("vb"))).alias("n_wrong"), F.count_if(alone).alias("n_unmatched"))
