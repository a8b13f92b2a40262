"""Re-estimation between cycles: frequencies, error rates, phenotype penetrances."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kinspark.functions import vec
from kinspark.functions.vec import STATES, lit
from kinspark.session import cut


def aap_newton(cells: DataFrame, start: DataFrame, rounds: int = 6) -> DataFrame:
    """mf, locus, p: Newton's maximum of the likelihood of all genotyped individuals'
    penetrances, with one pseudo-individual per state. start: mf, locus, p.

    Groups differ by their start alone; each distinct start of a locus is refined once
    a round, from sums pre-aggregated per locus."""
    seen = cells.where("genotyped").select("locus", *vec.cols("p"))
    for i in STATES:
        pseudo = start.select("locus").distinct().select("locus", *[lit(i == k).alias(f"p{k}") for k in STATES])
        seen = seen.unionByName(pseudo)
    seen = cut(seen)
    het = F.col("p1") + F.col("p2")
    now = start.select("mf", "locus", vec.clamp(F.col("p"), 0.01, 0.99).alias("p"), F.lit(False).alias("still"))
    for _ in range(rounds):
        x = seen.join(now.withColumnRenamed("p", "f"), "locus")
        p = F.col("f")
        like = F.col("p0") * (1 - p) * (1 - p) + het * p * (1 - p) + F.col("p3") * p * p
        first = (het - 2 * F.col("p0")) + 2 * p * (F.col("p0") + F.col("p3") - het)
        second = 2 * (F.col("p0") + F.col("p3") - het)
        sums = x.groupBy("mf", "locus").agg(F.sum(first / like).alias("u"), F.sum(second / like - (first / like) * (first / like)).alias("h"))
        y = now.join(sums, ["mf", "locus"], "left")
        delta = F.when((F.coalesce("u", lit(0)) == 0) | (F.coalesce("h", lit(0)) == 0), lit(0)).otherwise(-F.col("u") / F.nullif("h", lit(0)))
        new = vec.clamp(F.col("p") + delta, 0.01, 0.99)
        now = y.select("mf", "locus", F.when(F.col("still"), F.col("p")).otherwise(new).alias("q"), "p", "still")
        now = cut(now).select("mf", "locus", F.col("q").alias("p"), (F.col("still") | (F.abs(F.col("q") - F.col("p")) < 1e-4)).alias("still"))
    return now.select("mf", "locus", "p")


def aap_from_founders(probs: DataFrame, founders: DataFrame) -> DataFrame:
    """mf, locus, p: mean alternative-allele share of founders' genotype probabilities."""
    x = probs.join(founders.select("id", "mf"), "id")
    p = F.avg(0.5 * (F.col("x1") + F.col("x2")) + F.col("x3"))
    return x.groupBy("mf", "locus").agg(vec.clamp(p, 0.01, 0.99).alias("p"))


def genotype_error(cells: DataFrame) -> DataFrame:
    """locus, ge. cells: locus, g, x0..3."""
    wrong = F.when(F.col("g") == 0, 1 - F.col("x0")).when(F.col("g") == 1, F.col("x0") + F.col("x3")).when(F.col("g") == 2, 1 - F.col("x3"))
    e = (lit(1e-4) + F.coalesce(F.sum(wrong), lit(0))) / (1 + F.count_if(F.coalesce("g", F.lit(9)) != 9))
    return cells.groupBy("locus").agg(vec.clamp(e, 1e-4, 0.05).alias("ge"))


def read_error(cells: DataFrame) -> DataFrame:
    """locus, se. cells: locus, ref, alt, x0..3."""
    ref, alt = F.coalesce("ref", F.lit(0)), F.coalesce("alt", F.lit(0))
    bad = F.col("x0") * alt + F.col("x3") * ref
    all_ = (F.col("x0") + F.col("x3")) * (ref + alt)
    return cells.groupBy("locus").agg(vec.clamp((lit(1e-3) + F.sum(bad)) / (1 + F.sum(all_)), 1e-4, 0.01).alias("se"))


def phenotype_penetrance(pheno: DataFrame, probs: DataFrame, states: int) -> DataFrame:
    """state, pheno, p: records weighted by their bearers' genotype probabilities; records
    out of range don't count; a state that nobody is in keeps even chances."""
    x = pheno.where(F.col("pheno").between(0, states - 1)).join(probs.groupBy("id").agg(*[F.sum(f"x{i}").alias(f"x{i}") for i in STATES]), "id")
    x = x.groupBy("pheno").agg(*[F.sum(f"x{i}").alias(f"x{i}") for i in STATES])
    rows = F.array(*[F.struct(F.lit(i).alias("state"), F.col(f"x{i}").alias("n")) for i in STATES])
    x = x.select("pheno", F.explode(rows).alias("r")).select("pheno", "r.*")
    total = F.sum("n").over(Window.partitionBy("state"))  # at most 4 x states rows
    every = x.sparkSession.range(states).select(F.col("id").cast("int").alias("pheno")).crossJoin(x.sparkSession.range(4).select(F.col("id").cast("int").alias("state")))
    y = every.join(x, ["pheno", "state"], "left").withColumn("n", F.coalesce("n", lit(0))).withColumn("t", total)
    return y.select("state", "pheno", F.when(F.col("t") > 0, F.col("n") / F.nullif("t", lit(0))).otherwise(lit(1 / states)).alias("p"))


def haldane(share):
    """Map distance of a recombination share; null from one half on."""
    return -F.ln(1 - 2 * share) / 2


def information(p):
    """One less the binary entropy, in bits."""
    q = F.greatest(F.least(p, lit(1 - 1e-12)), lit(1e-12))
    return 1 + q * F.log2(q) + (1 - q) * F.log2(1 - q)


def recombination_distance(seg: DataFrame, breaks: list[int]) -> DataFrame:
    """left, right, distance for consecutive break points, from the fathers' side of the
    inheritance, each individual weighted by its certainty. seg: id, locus, s0..3."""
    x = seg.where(F.col("locus").isin(breaks)).select("id", "locus", ((F.col("s2") + F.col("s3")) / vec.total(vec.cols("s"))).alias("p"))
    pairs = list(zip(breaks, breaks[1:], strict=False))
    nxt = F.coalesce(*[F.when(F.col("locus") == a, F.lit(b)) for a, b in pairs])
    left = x.select("id", F.col("locus").alias("left"), nxt.alias("right"), F.col("p").alias("a")).where("right is not null")
    y = left.join(x.select("id", F.col("locus").alias("right"), F.col("p").alias("b")), ["id", "right"])
    w = information(F.col("a")) * information(F.col("b"))
    share = F.sum(w * (F.col("a") * (1 - F.col("b")) + (1 - F.col("a")) * F.col("b"))) / F.nullif(F.sum(w), lit(0))
    return y.groupBy("left", "right").agg(share.alias("share")).select("left", "right", haldane(F.col("share")).alias("distance"))
