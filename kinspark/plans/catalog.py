"""The registered queries of the pedigree engine and their DuckDB counterparts.

Oracles are written in tall form (one row per state), apart from the column
builders, so that they check the algebra and not just the engine.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kinspark.functions import vec
from kinspark.functions.vec import STATES, cols, lit
from kinspark.operators import blocks, estimate, likelihood, linkage, metrics, peeling
from kinspark.operators import pedigree as P
from kinspark.plans import oracles as O
from kinspark.plans import run as R
from kinspark.plans import testbed as B
from kinspark.session import shared_dir
from kinspark.sources import sinks
from kinspark.sources import text as S

QUERIES: dict = {}
ORACLES: dict = {}
FLAGSHIP = "peeling_cycle"
GE, SE = 1e-4, 1e-3


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


def rounded(df: DataFrame, *keys: str, places: int = 6) -> DataFrame:
    """Doubles rounded: the engines sum in different orders."""
    return df.select(*keys, *[F.round(F.col(c), places).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes if c not in keys])


def observed(spark: SparkSession, d: str) -> DataFrame:
    """Cells with penetrances from calls and reads, and the individual's columns."""
    x = B.cells(spark, d).join(B.pedigree(spark, d), "id").withColumns({"ge": lit(GE), "se": lit(SE)})
    return likelihood.penetrance(x)


def uniform(prefix: str) -> dict:
    return {f"{prefix}{i}": lit(0.25) for i in STATES}


def first_state(spark: SparkSession, d: str) -> DataFrame:
    x = observed(spark, d).withColumns(uniform("a") | uniform("q") | uniform("s"))
    return x.select("id", "locus", "sex", *cols("a"), *cols("p"), *cols("q"), *cols("s"))


def loci(spark: SparkSession) -> DataFrame:
    return spark.range(1, 8).select(F.col("id").cast("int").alias("locus"))


# ---------------------------------------------------------------- pedigree


@query("ped_families", O.FAMILIES)
def ped_families(spark, d):
    fams, kids = P.families(B.pedigree(spark, d))
    x = kids.groupBy("fam").agg(F.count("*").alias("n_children"), F.min("child").alias("first_child")).join(fams, "fam")
    return x.select("sire", "dam", "gen", "n_children", "first_child")


@query("ped_generations", O.GENERATIONS)
def ped_generations(spark, d):
    x = B.pedigree(spark, d)
    s = x.select(F.col("id").cast("string").alias("id"), F.coalesce(F.concat(F.lit("i"), F.col("sire").cast("string")), F.lit("0")).alias("sire"), F.coalesce(F.concat(F.lit("i"), F.col("dam").cast("string")), F.lit("0")).alias("dam"), "sex")
    s = s.withColumn("id", F.concat(F.lit("i"), "id"))
    y = P.generations(P.with_founders(s))
    return y.select(F.substring("id", 2, 30).cast("long").alias("id"), "gen")


def _half_known(spark, d):
    """Every seventh non-founder loses its sire, every eleventh its dam."""
    x = B.pedigree(spark, d)
    name = lambda c: F.concat(F.lit("i"), F.col(c).cast("string"))
    sire = F.when(F.col("is_founder"), F.col("mf")).when(F.col("id") % 7 == 0, F.lit("0")).otherwise(name("sire"))
    dam = F.when(F.col("is_founder"), F.lit("0")).when(F.col("id") % 11 == 0, F.lit("0")).otherwise(name("dam"))
    return x.select(name("id").alias("id"), sire.alias("sire"), dam.alias("dam"), "sex")


@query("ped_dummy_parents", O.DUMMIES)
def ped_dummy_parents(spark, d):
    x = P.with_dummies(_half_known(spark, d))
    return x.select("id", "sire", "dam", F.col("sex").cast("long").alias("sex"), "is_dummy")


@query("metafounder_assign", O.GROUPS)
def metafounder_assign(spark, d):
    x = P.with_founders(_half_known(spark, d).transform(P.check_groups), "MF_9")
    return x.where("is_founder").groupBy("mf").agg(F.count("*").alias("n"), F.min("id").alias("first"))


@query("metafounder_antijoin", O.GROUPS_MISSING)
def metafounder_antijoin(spark, d):
    given = spark.sql("select explode(array('MF_1', 'MF_3', 'MF_8', 'MF_12')) as mf")
    return P.unmatched_groups(given, B.pedigree(spark, d).where("is_founder"))


@query("genotyped_founders", O.GENOTYPED_FOUNDERS)
def genotyped_founders(spark, d):
    return P.genotyped_founders(B.pedigree(spark, d), B.cells(spark, d)).select("id", "mf")


@query("ids_not_in_pedigree", O.STRANGERS)
def ids_not_in_pedigree(spark, d):
    """Ids that other files have and the pedigree has not, of every third individual's pedigree."""
    ped = B.pedigree(spark, d)
    return P.strangers(ped.where("id % 3 <> 0"), {"genotypes": B.cells(spark, d), "phenotypes": ped.where("pheno = 1")})


@query("id_union_order", O.UNION_ORDER)
def id_union_order(spark, d):
    """Every id in output order: row by row, with the id before it."""
    ped = B.pedigree(spark, d).select(F.col("id").cast("string").alias("id"), F.lit("0").alias("sire"), F.lit("0").alias("dam"), "sex")
    sup = spark.read.parquet(f"{d}/supplier.parquet").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("id"), F.col("s_suppkey").alias("line"))
    x = P.union_ids(ped, sup).withColumn("is_dummy", F.lit(False))
    x = P.output_order(x, sup.where("line % 2 = 0"))
    return x.select("id", F.row_number().over(Window.orderBy("ord")).cast("long").alias("place"))


# ---------------------------------------------------------------- scans
# Tables of the driver are written as text lines and read by the library's scans.


def written(spark: SparkSession, lines: DataFrame) -> str:
    """The path of the lines (value, ord, row) as text in the shared folder."""
    at = f"{shared_dir(spark)}/text-{uuid.uuid4().hex}"
    sinks.write(lines, at)
    return at


def id_order(x: DataFrame) -> DataFrame:
    return x.select(F.col("id"), F.col("id").alias("ord")).distinct()


def cell_lines(x: DataFrame, *values, form: str = "%d") -> DataFrame:
    return sinks.rows_of(x, [F.col(v) if isinstance(v, str) else v for v in values], id_order(x), form)


def plain_lines(x: DataFrame, *columns) -> DataFrame:
    """A line of tokens for every row of a table with column ord."""
    return x.select(F.concat_ws(" ", *columns).alias("value"), "ord", F.lit(0).alias("row"))


def pedigree_lines(spark, d) -> DataFrame:
    x = B.pedigree(spark, d).withColumn("ord", F.col("id"))
    name = lambda c: F.when(F.col("is_founder"), F.col("mf") if c == "sire" else F.lit("0")).otherwise(F.col(c).cast("string"))
    return plain_lines(x, "id", name("sire"), name("dam"), "sex", F.lit("a note"))


def to_long(x: DataFrame) -> DataFrame:
    return x.withColumn("id", F.col("id").cast("long"))


@query("scan_pedigree", O.SCAN_PEDIGREE)
def scan_pedigree(spark, d):
    return to_long(S.pedigree(spark, written(spark, pedigree_lines(spark, d))).drop("place"))


@query("scan_genotypes", O.SCAN_GENOTYPES)
def scan_genotypes(spark, d):
    return to_long(S.genotypes(spark, written(spark, cell_lines(B.cells(spark, d), "g"))))


@query("scan_haplotypes", O.SCAN_HAPLOTYPES)
def scan_haplotypes(spark, d):
    return to_long(S.haplotypes(spark, written(spark, cell_lines(B.cells(spark, d), F.col("ref") % 2, F.col("alt") % 2))))


@query("scan_reads", O.SCAN_READS)
def scan_reads(spark, d):
    return to_long(S.reads(spark, written(spark, cell_lines(B.cells(spark, d), "ref", "alt"))))


@query("snp_window", O.SNP_WINDOW)
def snp_window(spark, d):
    x = B.cells(spark, d)
    g = S.genotypes(spark, written(spark, cell_lines(x, "g")), 2, 4)
    r = S.reads(spark, written(spark, cell_lines(x, "ref", "alt")), 2, 4)
    return g.join(r, ["id", "locus"]).groupBy("locus").agg(F.sum("ref").alias("ref"), F.sum("alt").alias("alt"), F.count_if(F.col("g") != 9).alias("called"))


@query("scan_phenotypes", O.SCAN_PHENOTYPES)
def scan_phenotypes(spark, d):
    ped = B.pedigree(spark, d).withColumn("ord", F.col("id"))
    twice = ped.where("id % 4 = 0").withColumn("pheno", F.lit(0))
    return to_long(S.phenotypes(spark, written(spark, plain_lines(ped.unionByName(twice), "id", "pheno"))))


@query("scan_external_penetrance", O.SCAN_EXTERNAL)
def scan_external_penetrance(spark, d):
    x = _seg_vectors(spark, d).withColumn("locus", F.col("seg"))
    return rounded(to_long(S.four_rows(spark, written(spark, cell_lines(x, *[f"s{i}" for i in STATES], form="%.4f")))), "id", "state", "locus")


@query("scan_inheritance", O.SCAN_INHERITANCE)
def scan_inheritance(spark, d):
    x = _seg_vectors(spark, d).withColumn("locus", F.col("seg"))
    return rounded(to_long(S.inheritance(spark, written(spark, sinks.inheritance(x, id_order(x))))), "id", "seg")


@query("scan_frequencies", O.SCAN_FREQUENCIES)
def scan_frequencies(spark, d):
    x = _frequencies(spark).select(F.col("mf").alias("id"), "locus", "p")
    return rounded(S.frequencies(spark, written(spark, cell_lines(x, "p", form="%.3f"))), "mf", "locus")


@query("scan_map", O.SCAN_MAP)
def scan_map(spark, d):
    x = _map(spark).withColumn("ord", -F.col("locus"))
    return S.marker_map(spark, written(spark, plain_lines(x, F.lit("1"), F.concat(F.lit("m"), F.col("locus").cast("string")), "pos")), 2, 6)


@query("scan_pheno_penetrance", O.SCAN_TABLE)
def scan_pheno_penetrance(spark, d):
    return rounded(S.phenotype_penetrance(spark, written(spark, sinks.phenotype_table(_table(spark)))), "state", "pheno")


# ---------------------------------------------------------------- likelihoods


@query("geno_penetrance", O.PEN_GENO)
def geno_penetrance(spark, d):
    x = B.cells(spark, d).select("id", "locus", *vec.named(vec.norm(vec.genotype_likelihood(F.col("g"), lit(GE))), "p"))
    return rounded(x, "id", "locus")


@query("reads_penetrance", O.PEN_READS)
def reads_penetrance(spark, d):
    x = vec.add_exp_norm(B.cells(spark, d), "p", vec.read_log_likelihood(F.col("ref"), F.col("alt"), lit(SE)))
    return rounded(x.select("id", "locus", *cols("p")), "id", "locus")


@query("geno_reads_penetrance", O.PEN_BOTH)
def geno_reads_penetrance(spark, d):
    return rounded(observed(spark, d).select("id", "locus", *cols("p")), "id", "locus")


@query("genotyped_mask", O.MASK)
def genotyped_mask(spark, d):
    return observed(spark, d).groupBy("locus").agg(F.count_if("genotyped").alias("n"), F.count("*").alias("all"))


@query("fill_from_phase", O.FILLED)
def fill_from_phase(spark, d):
    x = B.cells(spark, d)
    hap = x.where("(id + locus) % 3 <> 0").select("id", "locus", F.when(F.col("id") % 5 == 0, 9).otherwise(F.col("ref") % 2).alias("pat"), (F.col("alt") % 2).alias("mat"))
    return likelihood.filled_from_phase(x.select("id", "locus", "g"), hap)


def _table(spark):
    return spark.createDataFrame([(s, k, p) for s, ps in enumerate(((0.9, 0.1), (0.8, 0.2), (0.7, 0.3), (0.1, 0.9))) for k, p in enumerate(ps)], "state int, pheno int, p double")


@query("pheno_penetrance_product", O.PEN_PHENO)
def pheno_penetrance_product(spark, d):
    ped = B.pedigree(spark, d)
    records = ped.select("id", "pheno").union(ped.where("id % 4 = 0").select("id", F.lit(0)))
    x = likelihood.phenotype_logs(records, _table(spark))
    return rounded(vec.add_exp_norm(x, "h", cols("h")), "id")


@query("het_midpoint", O.HET)
def het_midpoint(spark, d):
    return likelihood.het_midpoint(B.cells(spark, d).select("id", (F.col("locus") - 1).alias("locus"), "g"), 7)


@query("anchor_founders", O.ANCHOR)
def anchor_founders(spark, d):
    x = observed(spark, d)
    at = likelihood.het_midpoint(x.where("is_founder").select("id", (F.col("locus") - 1).alias("locus"), "g"), 7)
    return rounded(likelihood.anchor(x, at.withColumn("locus", F.col("locus") + 1)).where("is_founder").select("id", "locus", *cols("p")), "id", "locus")


def _frequencies(spark):
    return spark.createDataFrame([(f"MF_{g}", i, g * 0.2 - 0.205 + i / 100) for g in (1, 2, 3, 5) for i in B.LOCI], "mf string, locus int, p double")


@query("hwe_prior", O.HWE)
def hwe_prior(spark, d):
    return rounded(_frequencies(spark).select("mf", "locus", *vec.named(vec.hwe(F.col("p")), "a")), "mf", "locus")


@query("founder_prior_clamped", O.PRIOR)
def founder_prior_clamped(spark, d):
    founders = B.pedigree(spark, d).where("is_founder").select("id", "mf")
    return rounded(likelihood.founder_prior(likelihood.grid(founders, loci(spark)), _frequencies(spark)), "id", "locus")


@query("external_penetrance", O.EXTERNAL)
def external_penetrance(spark, d):
    x = observed(spark, d).select("id", "locus", *cols("p"))
    ext = x.where("id % 2 = 0").select("id", "locus", F.explode(F.array(*[F.struct(F.lit(i).alias("state"), ((F.col("id") + i) % 4 + 1).cast("double").alias("p")) for i in STATES])).alias("e")).select("id", "e.state", "locus", "e.p")
    return rounded(likelihood.with_external(x, ext), "id", "locus")


# ---------------------------------------------------------------- outputs


def probabilities(spark, d):
    return likelihood.genotype_probability(first_state(spark, d))


@query("geno_prob", O.PROB)
def geno_prob(spark, d):
    return rounded(probabilities(spark, d).drop("sex"), "id", "locus")


@query("dosage", O.DOSAGE)
def dosage(spark, d):
    return rounded(probabilities(spark, d).select("id", "locus", vec.dosage(cols("x")).alias("dosage")), "id", "locus")


@query("dosage_x", O.DOSAGE_X)
def dosage_x(spark, d):
    x = B.cells(spark, d).join(B.pedigree(spark, d), "id").withColumns({"ge": lit(GE), "se": lit(SE)})
    x = likelihood.penetrance(x.withColumn("g", F.when(F.col("g") == 2, 1).otherwise(F.col("g"))), x_chromosome=True)
    return rounded(x.select("id", "locus", vec.dosage(cols("p"), F.col("sex") == 0).alias("dosage")), "id", "locus")


@query("call_genotype", O.CALL)
def call_genotype(spark, d):
    return probabilities(spark, d).select("id", "locus", vec.called_genotype(cols("x"), 0.9).alias("g"))


@query("call_phase", O.PHASE)
def call_phase(spark, d):
    pat, mat = vec.called_haplotypes(cols("x"), 0.6)
    return probabilities(spark, d).select("id", "locus", pat.alias("pat"), mat.alias("mat"))


def parsed(rows: DataFrame) -> DataFrame:
    """id, row, locus, v of a sink's lines."""
    t = F.split(F.trim(F.col("value")), " ")
    x = rows.select(F.get(t, F.lit(0)).cast("long").alias("id"), "row", F.posexplode(F.slice(t, F.lit(2), F.size(t) - 1)).alias("i", "v"))
    return x.select("id", "row", (2 * F.col("i") + 1).alias("locus"), F.col("v").cast("double").alias("v"))


def tenths(spark, d) -> DataFrame:
    """Probabilities of few decimals, which every way of rounding writes alike, at the loci 1, 3, 5, 7."""
    x = _seg_vectors(spark, d).join(B.pedigree(spark, d).select("id", "sex"), "id")
    return x.select("id", F.col("seg").alias("locus"), "sex", *[F.col(f"s{i}").alias(f"x{i}") for i in STATES])


def _sink(write):
    def run(spark, d):
        x = tenths(spark, d)
        return rounded(parsed(write(x, id_order(x))), "id", "row", "locus")

    return run


query("sink_dosages", O.SINK_DOSAGES)(_sink(sinks.dosages))
query("sink_dosages_x", O.SINK_DOSAGES_X)(_sink(lambda x, o: sinks.dosages(x, o, True)))
query("geno_prob_unphased", O.SINK_UNPHASED)(_sink(sinks.unphased))
query("phased_stack", O.SINK_PHASED)(_sink(sinks.phased))
query("sink_called", O.SINK_CALLED)(_sink(lambda x, o: sinks.called(x, o, 0.45)))
query("sink_haplotypes", O.SINK_HAPLOTYPES)(_sink(lambda x, o: sinks.haplotypes(x, o, 0.55)))


@query("pheno_prob", O.PHENO_PROB)
def pheno_prob(spark, d):
    return rounded(likelihood.phenotype_probability(probabilities(spark, d), _table(spark)), "id", "pheno")


@query("aap_pivot", O.PIVOT)
def aap_pivot(spark, d):
    """The text of frequencies: a header, then a line for every locus."""
    return sinks.frequencies(_frequencies(spark).withColumn("p", F.col("p") + 0.002)).select("value", F.col("ord").alias("line"))


@query("sink_phenotypes", O.SINK_PHENOTYPES)
def sink_phenotypes(spark, d):
    ped = B.pedigree(spark, d)
    x = ped.select("id", F.explode(F.array(F.lit(0), F.lit(1))).alias("pheno")).withColumn("prob", (F.col("id") % 7 + F.col("pheno")) / 8.0)
    return sinks.phenotype_rows(x, id_order(ped)).select(F.ltrim(F.regexp_replace("value", "^\n", "")).alias("value"), "row")


@query("sink_parameters", O.SINK_PARAMETERS)
def sink_parameters(spark, d):
    x = B.cells(spark, d).groupBy("locus").agg((F.sum("alt") % 64 / 64.0).alias("rate"))
    return sinks.per_locus(x, "rate").select("value", F.col("ord").alias("line"))


def _seg_vectors(spark, d, step: int = 2):
    """Inheritance vectors at loci 1, 3, 5, 7, four shapes by id."""
    ids = B.pedigree(spark, d).select("id")
    at = spark.range(1, 8, step).select(F.col("id").cast("long").alias("seg"))
    x = ids.join(F.broadcast(at), F.lit(True))
    raw = [((F.col("id") + F.col("seg") * (i + 1)) % 4 + 1).cast("double") for i in STATES]
    return x.select("id", "seg", *vec.named(vec.norm(raw), "s"))


def _map(spark):
    return loci(spark).withColumn("pos", (F.col("locus") * (F.col("locus") + 1) * 500).cast("long"))


@query("seg_prob_stack", O.SINK_PHASED)
def seg_prob_stack(spark, d):
    x = _seg_vectors(spark, d).withColumn("locus", F.col("seg"))
    return rounded(parsed(sinks.inheritance(x, id_order(x))), "id", "row", "locus")


@query("seg_rows_left_default", O.SEG_DEFAULT)
def seg_rows_left_default(spark, d):
    """Inheritance files give some individuals' vectors; the others keep even chances."""
    state = likelihood.grid(B.pedigree(spark, d).select("id"), spark.range(1, 8, 2).select(F.col("id").alias("locus"))).withColumns(uniform("s"))
    some = _seg_vectors(spark, d).where("id % 3 = 0").withColumnRenamed("seg", "locus")
    return rounded(R.put(state, some, "s").withColumnRenamed("locus", "seg"), "id", "seg")


# ---------------------------------------------------------------- along the loci


@query("transmission_rates", O.RATES)
def transmission_rates(spark, d):
    return rounded(linkage.transmission_rates(_map(spark), 1.0), "locus", places=9)


@query("bracket_join", O.BRACKETS)
def bracket_join(spark, d):
    segs = _map(spark).where("locus in (2, 4, 6)").select(F.col("locus").cast("long").alias("seg"), "pos")
    return rounded(linkage.brackets(_map(spark), segs), "locus")


@query("seg_interpolate", O.INTERPOLATE)
def seg_interpolate(spark, d):
    segs = _map(spark).where("locus % 2 = 1").select(F.col("locus").cast("long").alias("seg"), "pos")
    return rounded(linkage.interpolate(_seg_vectors(spark, d), linkage.brackets(_map(spark), segs)), "id", "locus")


@query("forward_backward", O.FORWARD_BACKWARD)
def forward_backward(spark, d):
    x = _seg_vectors(spark, d, 1).select(F.col("id").alias("child"), F.col("seg").cast("int").alias("locus"), *vec.named(cols("s"), "e"))
    return rounded(linkage.forward_backward(x, linkage.transmission_rates(_map(spark))), "child", "locus")


# ---------------------------------------------------------------- algebra of one family


def _parts(spark, d):
    """State, families and children; beliefs from observations alone."""
    ped = B.pedigree(spark, d)
    fams, kids = P.families(ped)
    return first_state(spark, d), fams, kids, peeling.first_messages(fams, loci(spark))


MODEL = peeling.Model()


@query("joint_parents", O.JOINT)
def joint_parents(spark, d):
    state, fams, _, messages = _parts(spark, d)
    x = peeling.parent_terms(fams, state, messages).join(fams, "fam")
    rows = F.posexplode(F.array(*cols("j", 16))).alias("ab", "p")
    return rounded(x.select("sire", "dam", "locus", rows), "sire", "dam", "locus", "ab")


def _children(spark, d):
    """Children's terms with inheritance vectors by id."""
    state, fams, kids, messages = _parts(spark, d)
    seg = _seg_vectors(spark, d, 1).select("id", F.col("seg").cast("int").alias("locus"), *cols("s"))
    state = state.drop(*[f"s{i}" for i in STATES]).join(seg, ["id", "locus"])
    return peeling.child_terms(kids, state, MODEL)


@query("child_seg_tensor", O.TENSOR)
def child_seg_tensor(spark, d):
    x = _seg_vectors(spark, d)
    rows = F.posexplode(F.array(*peeling.child_tensor(MODEL, cols("s")))).alias("abk", "p")
    return rounded(x.select("id", "seg", rows), "id", "seg", "abk")


@query("child_to_parents", O.TO_PARENTS)
def child_to_parents(spark, d):
    x = _children(spark, d)
    return rounded(x.select("child", "locus", F.posexplode(F.array(*[F.exp(c) for c in cols("c", 16)])).alias("ab", "p")), "child", "locus", "ab")


@query("parent_to_child", O.TO_CHILD)
def parent_to_child(spark, d):
    x = _children(spark, d)
    pair = vec.norm([lit(i + 1) for i in range(16)])
    return rounded(x.select("child", "locus", *vec.named(peeling.parents_to_child(MODEL, cols("g"), pair), "a")), "child", "locus")


@query("point_seg_norm", O.POINT)
def point_seg_norm(spark, d):
    x = _children(spark, d)
    pair = vec.norm([lit(i + 1) for i in range(16)])
    return rounded(x.select("child", "locus", *vec.named(peeling.point_inheritance(MODEL, pair, cols("v")), "e")), "child", "locus")


@query("marginal_sire_dam", O.MARGINALS)
def marginal_sire_dam(spark, d):
    state, fams, _, messages = _parts(spark, d)
    x = peeling.parent_terms(fams, state, messages).join(fams, "fam")
    j = cols("j", 16)
    return rounded(x.select("sire", "dam", "locus", *vec.named(peeling.marginal_sire(j, cols("d")), "x"), *vec.named(peeling.marginal_dam(j, cols("f")), "y")), "sire", "dam", "locus")


@query("point_seg_plain", O.POINT_PLAIN)
def point_seg_plain(spark, d):
    x = _children(spark, d)
    pair = vec.norm([lit(i + 1) for i in range(16)])
    return rounded(x.select("child", "locus", *vec.named(peeling.point_inheritance(MODEL, pair, cols("v"), normed=False), "e")), "child", "locus")


@query("distinct_parents", O.PARENTS)
def distinct_parents(spark, d):
    """For each generation the parents of its families."""
    fams, _ = P.families(B.pedigree(spark, d))
    return reduce(DataFrame.unionByName, [P.distinct_parents(fams.where(F.col("gen") == g)).withColumn("gen", F.lit(g)) for g in range(1, 5)])


@query("double_hemizygous", O.DOUBLED)
def double_hemizygous(spark, d):
    return B.cells(spark, d).select("id", "locus", vec.doubled(F.col("g")).alias("g"))


@query("output_without_dummies", O.ONLY)
def output_without_dummies(spark, d):
    """Output order restricted to a file's individuals: dummies and others go."""
    half = _half_known(spark, d)
    ids = B.pedigree(spark, d).where("id % 3 = 1").select(F.concat(F.lit("i"), F.col("id").cast("string")).alias("id"), F.col("id").alias("line"))
    x = P.output_order(P.with_dummies(half), ids, only=True)
    return x.select("id", F.row_number().over(Window.orderBy("ord")).cast("long").alias("place"))


@query("accuracy_report", O.REPORT)
def accuracy_report(spark, d):
    return rounded(metrics.report(metrics.marker_accuracy(_compared(spark, d))), "locus")


@query("leave_one_out", O.LEAVE)
def leave_one_out(spark, d):
    return rounded(_merged(spark, d).select("sire", "dam", "role", "locus", *cols("m")), "sire", "dam", "role", "locus")


def _merged(spark, d):
    """Messages by family and locus that differ by their keys, leave-one-out done."""
    _, fams, _, messages = _parts(spark, d)
    x = messages.join(fams.select("fam", "sire", "dam"), "fam")
    n = [((F.col("sire") + 2 * F.col("dam") + F.col("locus") * (i + 1)) % 7 + 1).cast("double") / 10 for i in STATES]
    return peeling.leave_one_out(vec.step(x, "n", n))


@query("parent_posterior", O.POSTERIOR)
def parent_posterior(spark, d):
    return rounded(peeling.posteriors(_merged(spark, d)), "id", "locus")


@query("expnorm", O.EXPNORM)
def expnorm(spark, d):
    x = B.cells(spark, d).select("id", "locus", *vec.named([F.col("ref") * -300.0 * i + F.col("alt") * 7.0 for i in STATES], "e"))
    return rounded(vec.add_exp_norm(x, "e", cols("e")), "id", "locus")


@query("haldane_entropy", O.HALDANE)
def haldane_entropy(spark, d):
    p = (F.col("id") % 48 + 1) / 100.0
    return rounded(B.pedigree(spark, d).select("id", estimate.haldane(p).alias("distance"), estimate.information(p).alias("information")), "id")


@query("peel_down_one_gen", O.DOWN)
def peel_down_one_gen(spark, d):
    state, fams, kids, messages = _parts(spark, d)
    fams = fams.where("gen = 1")
    x = peeling.peel_down(fams, kids.join(fams.select("fam"), "fam", "left_semi"), state, messages, MODEL)
    return rounded(x, "child", "locus")


@query("peel_up_one_gen", O.UP)
def peel_up_one_gen(spark, d):
    state, fams, kids, messages = _parts(spark, d)
    top = fams.where("gen = 4")
    x = peeling.peel_up(top, kids.join(top.select("fam"), "fam", "left_semi"), state, messages, MODEL).join(fams, "fam")
    return rounded(x.select("sire", "dam", "role", "locus", *cols("n")), "sire", "dam", "role", "locus")


def _dosages(x: DataFrame) -> DataFrame:
    return rounded(x.select("id", "locus", vec.dosage(cols("x")).alias("dosage")), "id", "locus")


@query("peeling_cycle", O.CYCLE)
def peeling_cycle(spark, d):
    """A whole cycle, all generations down and up: the loop that analyses run."""
    state, fams, kids, messages = _parts(spark, d)
    run = peeling.Peeling(B.pedigree(spark, d).select("id", "gen"), fams, kids, state, messages, MODEL)
    run.cycle()
    return _dosages(likelihood.genotype_probability(run.state()))


@query("single_locus_2cycles", O.CYCLES)
def single_locus_2cycles(spark, d):
    """Two cycles, with a locus's whole pedigree in one task where that fits, else by joins."""
    rows = first_state(spark, d).join(B.pedigree(spark, d).select("id", "gen", "sire", "dam"), "id")
    return _dosages(blocks.cycles(rows, 2))


@query("analysis_single", O.CYCLE)
def analysis_single(spark, d):
    """A whole analysis from text files: scans, penetrances, a cycle, dosages."""
    x = B.cells(spark, d)
    ped = pedigree_lines(spark, d).select(F.regexp_replace("value", "MF_[0-9]+", "0").alias("value"), "ord", "row")
    o = R.Options(method="single", ped_file=[written(spark, ped)], geno_file=[written(spark, cell_lines(x, "g"))], seq_file=[written(spark, cell_lines(x, "ref", "alt"))], n_cycle=1, no_phase_founder=True, geno_error_prob=GE, seq_error_prob=SE)
    return to_long(_dosages(R.Analysis(spark, o).run().probabilities()))


@query("multi_locus_down_one_gen", O.MULTI_DOWN)
def multi_locus_down_one_gen(spark, d):
    state, fams, kids, messages = _parts(spark, d)
    fams = fams.where("gen = 1")
    kids = kids.join(fams.select("fam"), "fam", "left_semi")
    return rounded(peeling.peel_down(fams, kids, state, messages, MODEL, linkage.transmission_rates(_map(spark))), "child", "locus")


@query("multi_locus_1cycle", O.MULTI_CYCLE)
def multi_locus_1cycle(spark, d):
    """A whole cycle, all generations down and up, with smoothing along the loci."""
    state, fams, kids, messages = _parts(spark, d)
    run = peeling.Peeling(B.pedigree(spark, d).select("id", "gen"), fams, kids, state, messages, MODEL, linkage.transmission_rates(_map(spark)))
    run.cycle()
    return rounded(run.state().select("id", "locus", *cols("a"), *cols("q"), *cols("s")), "id", "locus")


@query("x_chr_transmission", O.X_TENSOR)
def x_chr_transmission(spark, d):
    rows = [(kind, a, b, k, s, vec.tensor(kind, 1e-8)[a][b][k][s]) for kind in ("autosome", "xx", "xy") for a in STATES for b in STATES for k in STATES for s in STATES]
    return rounded(spark.createDataFrame(rows, "kind string, a int, b int, k int, d int, w double"), "kind", "a", "b", "k", "d", places=9)


# ---------------------------------------------------------------- estimators


@query("aap_newton", O.NEWTON)
def aap_newton(spark, d):
    return rounded(estimate.aap_newton(observed(spark, d), _frequencies(spark)), "mf", "locus", places=5)


@query("aap_founder_mean", O.FOUNDER_MEAN)
def aap_founder_mean(spark, d):
    return rounded(estimate.aap_from_founders(probabilities(spark, d), B.pedigree(spark, d).where("is_founder")), "mf", "locus")


def _judged(spark, d):
    """Probabilities from reads alone beside the calls."""
    x = vec.add_exp_norm(B.cells(spark, d), "x", vec.read_log_likelihood(F.col("ref"), F.col("alt"), lit(SE)))
    return x.select("id", "locus", "g", "ref", "alt", *cols("x"))


@query("geno_error_em", O.GENO_ERROR)
def geno_error_em(spark, d):
    return rounded(estimate.genotype_error(_judged(spark, d)), "locus")


@query("seq_error_em", O.SEQ_ERROR)
def seq_error_em(spark, d):
    x = vec.step(B.cells(spark, d), "x", vec.norm(vec.genotype_likelihood(F.col("g"), lit(GE))))
    return rounded(estimate.read_error(x), "locus")


@query("pheno_penetrance_em", O.PHENO_EM)
def pheno_penetrance_em(spark, d):
    return rounded(estimate.phenotype_penetrance(B.pedigree(spark, d).select("id", "pheno"), _judged(spark, d), 2), "state", "pheno")


@query("penetrance_rebuild", O.REBUILD)
def penetrance_rebuild(spark, d):
    e = estimate.genotype_error(_judged(spark, d))
    x = B.cells(spark, d).join(F.broadcast(e), "locus").withColumns({"sex": F.lit(0), "se": lit(0.005)})
    return rounded(likelihood.penetrance(x).select("id", "locus", *cols("p")), "id", "locus")


@query("marker_accuracy", O.MARKER)
def marker_accuracy(spark, d):
    return rounded(metrics.marker_accuracy(_compared(spark, d)), "locus")


def _compared(spark, d):
    x = _judged(spark, d)
    return x.where("g <> 9").select("id", "locus", vec.dosage(cols("x")).alias("est"), F.col("g").cast("double").alias("real"))


@query("individual_accuracy", O.INDIVIDUAL)
def individual_accuracy(spark, d):
    return rounded(metrics.individual_accuracy(_compared(spark, d)), "id", places=4)


@query("realised_rates", O.REALISED)
def realised_rates(spark, d):
    x = B.cells(spark, d).where("g <> 9").select("locus", F.col("g").alias("real"), F.when(F.col("ref") + F.col("alt") == 0, 9).otherwise(F.col("alt") % 3).alias("est"))
    return rounded(metrics.realised_rates(x), "locus")


@query("golden_mismatches", O.MISMATCH)
def golden_mismatches(spark, d):
    x = B.cells(spark, d)
    a = x.where("id % 10 <> 1").select("id", F.lit(0).alias("row"), "locus", F.col("g").alias("v"))
    return metrics.mismatches(a, x.where("id % 10 <> 2").select("id", F.lit(0).alias("row"), "locus", (F.col("alt") % 3).alias("v")))


@query("recombination_distance", O.DISTANCE)
def recombination_distance(spark, d):
    x = _seg_vectors(spark, d, 1).select("id", F.col("seg").cast("int").alias("locus"), *cols("s"))
    return rounded(estimate.recombination_distance(x, [1, 3, 4, 7]), "left", "right")
