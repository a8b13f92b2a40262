"""From observations to penetrances and founders' priors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinspark.functions import vec
from kinspark.functions.vec import STATES, cols, lit


def grid(ids: DataFrame, loci: DataFrame) -> DataFrame:
    """One row per individual and locus: the list of loci, one row, is exploded beside each id."""
    one = loci.agg(F.sort_array(F.collect_set("locus")).alias("loci"))
    return ids.join(F.broadcast(one), F.lit(True)).withColumn("locus", F.explode("loci")).drop("loci")


def filled_from_phase(geno: DataFrame, hap: DataFrame) -> DataFrame:
    """id, locus, g: a missing call becomes the sum of the phased alleles, if both are known."""
    x = geno.join(hap, ["id", "locus"], "full")
    both = (F.col("pat") != 9) & (F.col("mat") != 9)
    g = F.coalesce("g", F.lit(9))
    return x.select("id", "locus", F.when((g == 9) & both, F.col("pat") + F.col("mat")).otherwise(g).cast("int").alias("g"))


def penetrance(cells: DataFrame, x_chromosome: bool = False, phenotyped: bool = False) -> DataFrame:
    """Adds p0..3, normalised, and genotyped. cells: id, locus, sex, g, ref, alt, ge, se and,
    where phenotyped, h0..3, the phenotype's logarithms."""
    male = (F.col("sex") == 0) if x_chromosome else None
    g = F.coalesce("g", F.lit(9))
    ref, alt = F.coalesce("ref", F.lit(0)), F.coalesce("alt", F.lit(0))
    x = vec.step(cells, "__r", vec.read_log_likelihood(ref, alt, F.col("se"), male))
    logs = [a + F.col(f"__r{i}") + (F.coalesce(f"h{i}", lit(0)) if phenotyped else 0) for i, a in enumerate(vec.ln([F.greatest(c, lit(1e-300)) for c in vec.genotype_likelihood(g, F.col("ge"), male)]))]
    x = vec.add_exp_norm(x, "p", logs).drop(*[f"__r{i}" for i in STATES])
    return x.withColumn("genotyped", (g != 9) | (ref != 0) | (alt != 0))


def phenotype_logs(pheno: DataFrame, table: DataFrame) -> DataFrame:
    """id, h0..3: sums of ln p(record | state), once per record. table: state, pheno, p."""
    wide = table.groupBy("pheno").agg(*[F.max(F.when(F.col("state") == i, F.col("p"))).alias(f"w{i}") for i in STATES])
    x = pheno.join(F.broadcast(wide), "pheno")  # as many rows as phenotype states
    return x.groupBy("id").agg(*[F.sum(F.ln(F.greatest(f"w{i}", lit(1e-300)))).alias(f"h{i}") for i in STATES])


def het_midpoint(genotypes: DataFrame, n_loci: int) -> DataFrame:
    """id, locus: the heterozygous locus nearest to the middle, the later of two equally
    near. Of an even number of loci the first is never looked at, as it has always been."""
    mid = n_loci // 2
    x = genotypes.where((F.col("g") == 1) & (F.abs(F.col("locus") - mid) < n_loci / 2))
    return x.groupBy("id").agg(F.min_by("locus", F.struct(F.abs(F.col("locus") - mid), -F.col("locus"))).alias("locus"))


def anchor(cells: DataFrame, anchors: DataFrame) -> DataFrame:
    """Penetrances with founders' anchor loci set to the phase Aa, whatever else is known."""
    x = cells.join(anchors.select("id", "locus", F.lit(True).alias("__a")), ["id", "locus"], "left")
    e = F.col("ge")
    new = [e / 3, e / 3, 1 - e, e / 3]
    return x.withColumns({f"p{i}": F.when(F.col("__a"), new[i]).otherwise(F.col(f"p{i}")) for i in STATES}).drop("__a")


def founder_prior(founders: DataFrame, aap: DataFrame) -> DataFrame:
    """id, locus, a0..3 from the clamped frequency of each founder's group; 0.5 for a
    group without any. founders: id, mf, locus. aap: mf, locus, p."""
    x = founders.join(aap, ["mf", "locus"], "left").withColumn("p", vec.clamp(F.coalesce("p", lit(0.5)), 0.01, 0.99))
    return x.select("id", "locus", *vec.named(vec.hwe(F.col("p")), "a"))


def with_external(cells: DataFrame, external: DataFrame) -> DataFrame:
    """Penetrances times external ones (id, state, locus, p), as they are."""
    wide = external.groupBy("id", "locus").agg(*[F.max(F.when(F.col("state") == i, F.col("p"))).alias(f"x{i}") for i in STATES])
    x = cells.join(wide, ["id", "locus"], "left")
    return x.withColumns({f"p{i}": F.col(f"p{i}") * F.coalesce(f"x{i}", lit(1)) for i in STATES}).drop(*[f"x{i}" for i in STATES])


def genotype_probability(state: DataFrame) -> DataFrame:
    """id, locus, sex and x0..3: anterior times posterior times penetrance, normalised."""
    x = vec.add_norm(state, "x", vec.times(cols("a"), cols("q"), cols("p")))
    return x.select(*[c for c in ("id", "locus", "sex") if c in state.columns], *cols("x"))


def phenotype_probability(probs: DataFrame, table: DataFrame) -> DataFrame:
    """id, pheno, prob: over all loci, normalised over the phenotype states."""
    wide = table.groupBy("pheno").agg(*[F.max(F.when(F.col("state") == i, F.col("p"))).alias(f"w{i}") for i in STATES])
    lists = wide.agg(F.sort_array(F.collect_list(F.struct("pheno", *cols("w")))).alias("ws"))
    x = probs.groupBy("id").agg(*[F.sum(f"x{i}").alias(f"x{i}") for i in STATES]).join(F.broadcast(lists), F.lit(True))
    raw = F.transform("ws", lambda w: F.struct(w["pheno"].alias("pheno"), vec.total([w[f"w{i}"] * F.col(f"x{i}") for i in STATES]).alias("prob")))
    x = x.select("id", raw.alias("r")).withColumn("t", F.aggregate("r", lit(0), lambda a, r: a + r["prob"]))
    return x.select("id", "t", F.explode("r").alias("r")).select("id", "r.pheno", (F.col("r.prob") / F.col("t")).alias("prob"))
