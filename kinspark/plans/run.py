"""A whole analysis: options, ingest, peeling cycles, re-estimation, results.

python -m kinspark.plans.run -out_file out -ped_file ped.txt -geno_file geno.txt -method multi
"""

from __future__ import annotations

import argparse
import warnings
from dataclasses import dataclass, field, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinspark.functions import vec
from kinspark.functions.vec import STATES, cols, lit
from kinspark.operators import estimate, likelihood, linkage, peeling
from kinspark.operators import pedigree as P
from kinspark.session import cut, local_session
from kinspark.sources import sinks
from kinspark.sources import text as S


@dataclass
class Options:
    """Inputs are lists of paths; -method is single or multi, hybrid being single with
    inheritance files."""

    out_file: str = ""
    method: str = "multi"
    ped_file: list[str] = field(default_factory=list)
    geno_file: list[str] = field(default_factory=list)
    hap_file: list[str] = field(default_factory=list)
    seq_file: list[str] = field(default_factory=list)
    pheno_file: list[str] = field(default_factory=list)
    plink_file: list[str] = field(default_factory=list)
    penetrance: list[str] = field(default_factory=list)
    alt_allele_prob_file: list[str] = field(default_factory=list)
    pheno_penetrance_file: str = ""
    map_file: str = ""
    seg_map_file: str = ""
    seg_file: list[str] = field(default_factory=list)
    start_snp: int = 0
    stop_snp: int = 0
    main_metafounder: str = "MF_1"
    no_dosage: bool = False
    seg_prob: bool = False
    no_param: bool = False
    alt_allele_prob: bool = False
    pheno_penetrance: bool = False
    geno_prob: bool = False
    phased_geno_prob: bool = False
    pheno_prob: bool = False
    geno: bool = False
    hap: bool = False
    geno_threshold: list[float] = field(default_factory=list)
    hap_threshold: list[float] = field(default_factory=list)
    out_id_order: str = "id"
    out_id_only: bool = False
    n_cycle: int = 5
    rec_length: float = 1.0
    geno_error_prob: float = 1e-4
    seq_error_prob: float = 1e-3
    mutation_rate: float = 1e-8
    est_geno_error_prob: bool = False
    est_seq_error_prob: bool = False
    est_alt_allele_prob: bool = False
    update_alt_allele_prob: bool = False
    update_pheno_penetrance: bool = False
    no_phase_founder: bool = False
    x_chr: bool = False

    def check(self) -> None:
        if self.method not in ("single", "multi"):
            raise ValueError(f"method {self.method!r}: single or multi; hybrid is single with -seg_file, -seg_map_file and -map_file")
        if self.seg_file and self.method == "single" and not (self.map_file and self.seg_map_file):
            raise ValueError("inheritance files need -map_file and -seg_map_file")
        if self.pheno_file and not self.pheno_penetrance_file:
            raise ValueError("a phenotype file needs a phenotype penetrance file")
        if bool(self.start_snp) != bool(self.stop_snp):
            raise ValueError("give both -start_snp and -stop_snp")
        if not self.main_metafounder.startswith("MF_"):
            raise ValueError("-main_metafounder must start with MF_")
        if self.seg_file and self.method == "multi":
            warnings.warn("multi-locus peeling ignores inheritance files", stacklevel=2)
        if self.penetrance and (self.est_geno_error_prob or self.est_seq_error_prob):
            warnings.warn("external penetrances switch the estimation of error rates off", stacklevel=2)
            self.est_geno_error_prob = self.est_seq_error_prob = False


class Analysis:
    """Ingest on construction; run() peels; results as DataFrames and text."""

    def __init__(self, spark: SparkSession, options: Options):
        options.check()
        self.spark, self.o = spark, options
        o, w = options, {"start": options.start_snp, "stop": options.stop_snp}
        ped = S.pedigree(spark, o.ped_file) if o.ped_file else None
        geno = S.genotypes(spark, o.geno_file, **w) if o.geno_file else None
        for prefix in o.plink_file:
            more, _, calls = S.plink(spark, prefix)
            ped = more if ped is None and not o.ped_file else ped
            geno = calls if geno is None else geno.unionByName(calls)
        if ped is None:
            ped = spark.createDataFrame([], "id string, sire string, dam string, sex int")
        hap = S.haplotypes(spark, o.hap_file, **w) if o.hap_file else None
        seq = S.reads(spark, o.seq_file, **w) if o.seq_file else None
        pheno = S.phenotypes(spark, o.pheno_file) if o.pheno_file else None
        ext = S.four_rows(spark, o.penetrance, **w) if o.penetrance else None
        sources = [x for x in (geno, hap, seq, ext) if x is not None]
        loci = cut((sources[0] if len(sources) == 1 else _union([x.select("locus") for x in sources])).select("locus").distinct()) if sources else spark.createDataFrame([(1,)], "locus int")
        n_loci = loci.count()
        if pheno is not None and n_loci > 1:
            raise ValueError("phenotypes need single-locus genotypes")
        base = P.check_groups(ped.select("id", "sire", "dam", "sex"), o.main_metafounder)
        files = {"genotypes": geno, "haplotypes": hap, "reads": seq, "phenotypes": pheno}
        files = {k: x for k, x in files.items() if x is not None}
        known = P.union_ids(base, *files.values())
        #: file, id: individuals that the pedigree has not. Those of penetrance files are ignored, others become unrelated founders.
        self.strangers = None
        if (o.ped_file or o.plink_file) and (files or ext is not None):
            found = ([P.strangers(base, files)] if files else []) + ([P.strangers(known, {"penetrances": ext})] if ext is not None else [])
            self.strangers = cut(_union(found))
            for r in self.strangers.groupBy("file").agg(F.count("*").alias("n"), F.min("id").alias("first")).collect():  # one row a kind of file
                what = "they are ignored" if r["file"] == "penetrances" else "they are taken as unrelated founders"
                warnings.warn(f"{r['n']} individuals in {r['file']} are not in the pedigree, {r['first']} first; {what}", stacklevel=2)
        base = known
        full = P.with_founders(P.with_dummies(base), o.main_metafounder)
        self.individuals = cut(P.generations(cut(full)))
        self.fams, self.kids = P.families(self.individuals)
        self.pheno, self.table = pheno, S.phenotype_penetrance(spark, o.pheno_penetrance_file) if o.pheno_penetrance_file else None
        self.ge = loci.withColumn("ge", lit(o.geno_error_prob))
        self.se = loci.withColumn("se", lit(o.seq_error_prob))
        self.loci, self.n_loci, self.ext = loci, n_loci, ext
        x = likelihood.grid(self.individuals.select("id", "sex", "is_founder", "mf"), loci)
        if geno is not None or hap is not None:
            g = geno if geno is not None else hap.select("id", "locus", F.lit(9).alias("g"))
            x = x.join(likelihood.filled_from_phase(g, hap) if hap is not None else g, ["id", "locus"], "left")
        else:
            x = x.withColumn("g", F.lit(9))
        x = x.join(seq, ["id", "locus"], "left") if seq is not None else x.withColumns({"ref": F.lit(0), "alt": F.lit(0)})
        self.data = cut(x)
        self.markers = S.marker_map(spark, o.map_file, **w) if o.map_file else None
        self.order = self._order()
        self.aap = self._frequencies()

    def _order(self) -> DataFrame:
        name = self.o.out_id_order
        files = {"pedigree": self.o.ped_file, "genotypes": self.o.geno_file, "sequence": self.o.seq_file, "segregation": self.o.seg_file}
        ids = None
        if name != "id":
            ids = S.keyed(S.lines(self.spark, files[name]), F.col("tokens")[0]) if files[name] else None
        return cut(P.output_order(self.individuals, ids, self.o.out_id_only)).select("id", "ord")

    def _frequencies(self) -> DataFrame:
        """mf, locus, p for the pedigree's groups; 0.5 for one without."""
        groups = self.individuals.where("is_founder").select("mf").distinct()
        x = likelihood.grid(groups, self.loci)
        if not self.o.alt_allele_prob_file:
            return cut(x.withColumn("p", lit(0.5)))
        given = S.frequencies(self.spark, self.o.alt_allele_prob_file, self.o.start_snp, self.o.stop_snp)
        for r in P.unmatched_groups(given, groups).collect():  # one row a founder group
            what = "its frequencies are ignored" if r["side"] == "not in the pedigree" else "one half is taken"
            warnings.warn(f"founder group {r['mf']} is {r['side']}; {what}", stacklevel=2)
        return cut(x.join(given, ["mf", "locus"], "left").withColumn("p", vec.clamp(F.coalesce("p", lit(0.5)), 0.01, 0.99)))

    def penetrance(self) -> DataFrame:
        """id, locus, p0..3, genotyped: observations, phenotype, founders' anchors, external."""
        x = self.data.join(self.ge.join(self.se, "locus"), "locus")  # a row a locus: broadcast where small, as the planner sees fit
        if self.pheno is not None:
            x = x.join(likelihood.phenotype_logs(self.pheno, self.table), "id", "left")
        x = likelihood.penetrance(x, self.o.x_chr, self.pheno is not None)
        if not self.o.no_phase_founder:
            calls = self.data.where("is_founder") if not self.o.x_chr else self.data.where("is_founder and sex = 1")
            low = (self.o.start_snp or 1) if self.o.start_snp else 1
            at = likelihood.het_midpoint(calls.select("id", (F.col("locus") - low).alias("locus"), "g"), self.n_loci)
            x = likelihood.anchor(x, at.withColumn("locus", F.col("locus") + low))
        if self.ext is not None:
            x = likelihood.with_external(x, self.ext)
        return x.select("id", "locus", *cols("p"), "genotyped")

    def _prior(self) -> DataFrame:
        return likelihood.founder_prior(self.data.where("is_founder").select("id", "mf", "locus"), self.aap)

    def _inheritance(self) -> DataFrame | None:
        if not (self.o.seg_file and self.o.method == "single"):
            return None
        segs = S.marker_map(self.spark, self.o.seg_map_file).select(F.col("locus").cast("long").alias("seg"), "pos")
        return linkage.interpolate(S.inheritance(self.spark, self.o.seg_file), linkage.brackets(self.markers, segs))

    def run(self) -> Analysis:
        o = self.o
        pen = cut(self.penetrance())
        if o.est_alt_allele_prob:
            if self.individuals.where("is_founder").select("mf").distinct().limit(2).count() > 1:
                warnings.warn("frequencies are estimated from all individuals alike, though there are several founder groups", stacklevel=2)
            self.aap = cut(estimate.aap_newton(pen, self.aap))
        flat = {f"{p}{i}": lit(0.25) for p in "aqs" for i in STATES}
        state = self.data.select("id", "locus", "sex").withColumns(flat).join(pen.drop("genotyped"), ["id", "locus"])
        state = state.select("id", "locus", "sex", *cols("a"), *cols("p"), *cols("q"), *cols("s"))
        if o.alt_allele_prob_file or o.est_alt_allele_prob:
            state = put(state, self._prior(), "a")
        seg = self._inheritance()
        if seg is not None:
            state = put(state, seg, "s")
        rates = None
        if o.method == "multi":
            self.rates = rates = cut(linkage.transmission_rates(self.markers if self.markers is not None else self.loci, o.rec_length))
        model = peeling.Model(o.mutation_rate, o.x_chr)
        self.peeling = run = peeling.Peeling(self.individuals, self.fams, self.kids, state, peeling.first_messages(self.fams, self.loci), model, rates)
        for _ in range(o.n_cycle):
            run.cycle()
            if o.est_geno_error_prob or o.est_seq_error_prob:
                seen = cut(self.data.drop("sex").join(self.probabilities(), ["id", "locus"]))
                self.ge = cut(estimate.genotype_error(seen)) if o.est_geno_error_prob else self.ge
                self.se = cut(estimate.read_error(seen)) if o.est_seq_error_prob else self.se
                new = cut(self.penetrance())
                run.map_state(lambda s, new=new: put(s, new, "p"))
            if o.update_pheno_penetrance:
                if self.pheno is None or self.table is None:
                    warnings.warn("updating the phenotype penetrance needs both phenotype files", stacklevel=2)
                else:
                    k = self.table.agg(F.max("pheno")).first()[0] + 1
                    self.table = cut(estimate.phenotype_penetrance(self.pheno, self.probabilities(), k))
            if o.update_alt_allele_prob:
                self.aap = cut(estimate.aap_from_founders(self.probabilities(), self.individuals.where("is_founder")))
                prior = cut(self._prior())
                run.map_state(lambda s, prior=prior: put(s, prior, "a"))
        return self

    def probabilities(self) -> DataFrame:
        """id, locus, sex, x0..3."""
        return likelihood.genotype_probability(self.peeling.state())

    def phenotype_probabilities(self) -> DataFrame:
        return likelihood.phenotype_probability(self.probabilities(), self.table)

    def outputs(self) -> dict[str, DataFrame]:
        """File suffix to lines, as the options ask."""
        o, probs = self.o, cut(self.probabilities())
        out: dict[str, DataFrame] = {}
        if not o.no_dosage:
            out["dosage.txt"] = sinks.dosages(probs, self.order, o.x_chr)
        if o.phased_geno_prob:
            out["phased_geno_prob.txt"] = sinks.phased(probs, self.order)
        if o.geno_prob:
            out["geno_prob.txt"] = sinks.unphased(probs, self.order)
        if o.geno:
            for t in o.geno_threshold or [1 / 3]:
                out[f"geno_{max(t, 1 / 3)}.txt"] = sinks.called(probs, self.order, t, o.x_chr)
        if o.hap:
            for t in o.hap_threshold or [1 / 2]:
                out[f"hap_{max(t, 1 / 2)}.txt"] = sinks.haplotypes(probs, self.order, t)
        if not o.no_param:
            out["geno_error_prob.txt"] = sinks.per_locus(self.ge, "ge")
            out["seq_error_prob.txt"] = sinks.per_locus(self.se, "se")
            if o.method == "multi":
                out["rec_prob.txt"] = sinks.per_locus(self.rates, "rate")
        if o.alt_allele_prob:
            out["alt_allele_prob.txt"] = sinks.frequencies(self.aap)
        if o.pheno_prob:
            if self.table is None:
                warnings.warn("phenotype probabilities need a phenotype penetrance file", stacklevel=2)
            else:
                out["pheno_prob.txt"] = sinks.phenotype_rows(self.phenotype_probabilities(), self.order)
        if o.pheno_penetrance and self.table is not None:
            out["pheno_penetrance.txt"] = sinks.phenotype_table(self.table)
        if o.seg_prob and o.method == "multi":
            out["seg_prob.txt"] = sinks.inheritance(self.peeling.state(), self.order)
        return out

    def dump(self, path: str) -> None:
        """The peeling's whole state, for inspection: tables state and messages under path."""
        self.peeling.state().write.mode("overwrite").parquet(f"{path}/state")
        if self.peeling.messages:
            _union(list(self.peeling.messages.values())).write.mode("overwrite").parquet(f"{path}/messages")

    def write(self) -> None:
        for suffix, rows in self.outputs().items():
            sinks.write(rows, f"{self.o.out_file}.{suffix}")


def put(state: DataFrame, new: DataFrame, prefix: str) -> DataFrame:
    """State with one vector replaced where new has the individual and locus."""
    x = state.join(new.select("id", "locus", *[F.col(f"{prefix}{i}").alias(f"new{i}") for i in STATES]), ["id", "locus"], "left")
    return x.select(*[F.coalesce(f"new{c[1:]}", c).alias(c) if c[0] == prefix and c[1:].isdigit() else F.col(c) for c in state.columns])


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def parse(argv: list[str] | None = None) -> Options:
    p = argparse.ArgumentParser(prog="kinspark", description="Calls, phases and imputes genotypes in pedigrees.")
    for f in fields(Options):
        name, kind = f"-{f.name}", str(f.type)
        if kind == "bool":
            p.add_argument(name, action="store_true")
        elif kind.startswith("list"):
            p.add_argument(name, nargs="*", default=[], type=float if "float" in kind else str)
        else:
            p.add_argument(name, default=f.default, type={"int": int, "float": float}.get(kind, str), required=f.name == "out_file")
    return Options(**vars(p.parse_args(argv)))


def main(argv: list[str] | None = None) -> None:
    options = parse(argv)
    spark = SparkSession.getActiveSession() or local_session()
    Analysis(spark, options).run().write()


if __name__ == "__main__":
    main()
