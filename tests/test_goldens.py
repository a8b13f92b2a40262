"""Whole analyses of tiny inputs against known results."""

import pytest
from pyspark.sql import functions as F

from kinspark.plans.run import Analysis, Options, parse


def write(tmp_path, **files):
    out = {}
    for name, text in files.items():
        p = tmp_path / f"{name}.txt"
        p.write_text(text)
        out[name] = [str(p)]
    return out


def lines(a: Analysis, suffix: str) -> list[str]:
    rows = a.outputs()[suffix].orderBy("ord", "row").collect()
    return [x for r in rows for x in r["value"].split("\n") if x]


PED = "A 0 0\nB 0 0\nC A B\n"


def test_trio(spark, tmp_path):
    f = write(tmp_path, ped_file=PED, geno_file="A 2 2 0 0 0\nB 0 0 2 2 2\nC 9 9 9 9 9\n")
    a = Analysis(spark, Options(method="single", geno=True, hap=True, n_cycle=1, **f)).run()
    assert lines(a, "geno_0.3333333333333333.txt")[2] == "C 1 1 1 1 1"
    assert lines(a, "hap_0.5.txt")[4:] == ["C 1 1 0 0 0", "C 0 0 1 1 1"]


REC_PED = "M0 0 0 0\nF0 0 0 1\nM1 M0 F0 0\nF1 M0 F0 1\nM2 M1 F1 0\nF2 M1 F1 1\n"
REC_GENO = "M0 0 0 0 0 0\nF0 2 2 2 2 2\nM1 1 1 1 1 1\nF1 1 1 1 1 1\nM2 1 1 2 2 2\nF2 0 0 0 0 0\n"


def test_recombination(spark, tmp_path):
    f = write(tmp_path, ped_file=REC_PED, geno_file=REC_GENO)
    a = Analysis(spark, Options(method="multi", seg_prob=True, phased_geno_prob=True, geno_error_prob=1e-8, n_cycle=2, rec_length=1e-5, **f)).run()
    seg = {(r["id"], r["locus"]): [round(r[f"s{i}"], 2) for i in range(4)] for r in a.peeling.state().where("id in ('M2', 'F2')").collect()}
    assert all(seg["F2", i] == [1, 0, 0, 0] for i in range(1, 6))
    assert all(seg["M2", i] == [0, 0, 0, 1] for i in range(3, 6)) and all(seg["M2", i] == [0, 0.5, 0.5, 0] for i in (1, 2))
    p = {(r["id"], r["locus"]): [round(r[f"x{i}"], 2) for i in range(4)] for r in a.probabilities().where("id = 'M2'").collect()}
    assert p["M2", 1] == [0, 0.5, 0.5, 0] and p["M2", 4] == [0, 0, 0, 1]


PHENO = {"ped_file": "id1 0 0\nid2 0 0\nid3 0 0\n", "geno_file": "id1 2\n"}
TABLE = "0.9 0.1\n0.9 0.1\n0.9 0.1\n0.1 0.9\n"


def test_phenotypes(spark, tmp_path):
    f = write(tmp_path, pheno_file="id2 1\nid3 0\n", pheno_penetrance_file=TABLE, **PHENO)
    f["pheno_penetrance_file"] = f["pheno_penetrance_file"][0]
    a = Analysis(spark, Options(method="single", pheno_prob=True, n_cycle=1, **f)).run()
    assert lines(a, "dosage.txt") == ["id1 1.9998", "id2 1.6667", "id3 0.7143"]
    assert lines(a, "pheno_prob.txt") == ["id1 0.1001", "id1 0.8999", "id2 0.3000", "id2 0.7000", "id3 0.8714", "id3 0.1286"]


def test_repeated_phenotype_records(spark, tmp_path):
    f = write(tmp_path, pheno_file="id2 1\nid3 0\nid3 0\n", pheno_penetrance_file=TABLE, **PHENO)
    f["pheno_penetrance_file"] = f["pheno_penetrance_file"][0]
    a = Analysis(spark, Options(method="single", n_cycle=1, **f)).run()
    assert lines(a, "dosage.txt")[2] == "id3 0.6721"


def test_ungenotyped_founder(spark, tmp_path):
    f = write(tmp_path, ped_file="A 0 0\nB 0 0\nC A B\n", geno_file="A 9\nB 2\nC 1\n")
    a = Analysis(spark, Options(method="single", n_cycle=2, **f)).run()
    assert round(float(lines(a, "dosage.txt")[1].split()[1])) == 2


def test_dummies_order_and_window(spark, tmp_path):
    f = write(tmp_path, ped_file="a 0 0\nb 0 0\nc a 0\nd 0 b\n", geno_file="d 0 1 2 0\nc 1 1 1 1\n")
    a = Analysis(spark, Options(method="single", n_cycle=1, out_id_order="genotypes", out_id_only=True, start_snp=2, stop_snp=3, **f)).run()
    assert [x.split()[0] for x in lines(a, "dosage.txt")] == ["d", "c"]
    assert all(len(x.split()) == 3 for x in lines(a, "dosage.txt"))
    assert {r["id"] for r in a.individuals.where("is_dummy").collect()} == {"MotherOfc", "FatherOfd"}


def test_frequencies_are_clamped_and_ordered(spark, tmp_path):
    f = write(tmp_path, ped_file="a MF_2 MF_2\nb MF_10 MF_10\nc MF_1 MF_1\n", geno_file="a 0\nb 2\nc 1\n", alt_allele_prob_file="MF_2 0.001\nMF_10 0.999\n")
    a = Analysis(spark, Options(method="single", n_cycle=1, alt_allele_prob=True, **f)).run()
    assert lines(a, "alt_allele_prob.txt") == ["MF_1\tMF_2\tMF_10", "0.50\t0.01\t0.99"]


def test_bad_inputs(spark, tmp_path):
    f = write(tmp_path, ped_file="MF_1 0 0\n", geno_file="MF_1 0\n")
    with pytest.raises(Exception, match="founder group"):
        Analysis(spark, Options(method="single", **f))
    with pytest.raises(ValueError, match="hybrid"):
        Options(method="hybrid").check()
    with pytest.raises(ValueError, match="penetrance"):
        Options(pheno_file=["x"]).check()
    assert parse(["-out_file", "x", "-geno_threshold", "0.5", "0.9", "-geno"]).geno_threshold == [0.5, 0.9]


def test_hybrid_interpolates(spark, tmp_path):
    seg = "\n".join(f"C {a} {b}" for a, b in ((1, 0), (0, 0), (0, 0), (0, 1))) + "\n"
    f = write(tmp_path, ped_file=PED, geno_file="A 1 1 1\nB 1 1 1\nC 9 9 9\n", seg_file=seg)
    maps = write(tmp_path, map_file="1 a 10\n1 b 20\n1 c 30\n", seg_map_file="1 a 10\n1 c 30\n")
    a = Analysis(spark, Options(method="single", n_cycle=1, map_file=maps["map_file"][0], seg_map_file=maps["seg_map_file"][0], **f)).run()
    got = {r["locus"]: [round(r[f"s{i}"], 2) for i in range(4)] for r in a.peeling.state().where(F.col("id") == "C").collect()}
    assert got == {1: [1, 0, 0, 0], 2: [0.5, 0, 0, 0.5], 3: [0, 0, 0, 1]}


def test_sex_chromosome(spark, tmp_path):
    f = write(tmp_path, ped_file="S 0 0 0\nD 0 0 1\nX S D 0\nY S D 1\n", geno_file="S 1\nD 0\nX 9\nY 9\n")
    a = Analysis(spark, Options(method="single", n_cycle=2, geno=True, hap=True, x_chr=True, **f)).run()
    assert lines(a, "geno_0.3333333333333333.txt")[2:] == ["X 0", "Y 1"]
    assert lines(a, "hap_0.5.txt")[4:] == ["X 9", "X 0", "Y 1", "Y 0"]


def unrelated(tmp_path):
    """Individuals known from one kind of file each, with the same genotype at five loci."""
    row = lambda i, *vs: "".join(f"{i} {' '.join([str(v)] * 5)}\n" for v in vs)
    states = ("aa", "aA", "Aa", "AA")
    files = {
        "geno_file": "".join(row(f"geno{g}", g) for g in range(3)),
        "hap_file": "".join(row(f"hap{s}", *("01"[c == "A"] for c in s)) for s in states),
        "seq_file": "".join(row(f"seq{g}", r, a) for g, (r, a) in enumerate(((10, 0), (10, 10), (0, 10)))),
        "penetrance": "".join(row(f"pen{s}", *(int(s == x) for x in states)) for s in states),
        "ped_file": "".join(f"pen{s} 0 0\n" for s in states),
    }
    want = {f"geno{g}": g for g in range(3)} | {f"seq{g}": g for g in range(3)} | {k + s: s.count("A") for k in ("hap", "pen") for s in states}
    return write(tmp_path, **files), want


def test_every_kind_of_file(spark, tmp_path):
    f, want = unrelated(tmp_path)
    with pytest.warns(UserWarning, match="not in the pedigree"):
        a = Analysis(spark, Options(method="multi", geno=True, geno_threshold=[0.1], est_geno_error_prob=True, est_seq_error_prob=True, seg_prob=True, **f)).run()
    assert sorted(lines(a, "geno_0.3333333333333333.txt")) == sorted(f"{i} {' '.join([str(g)] * 5)}" for i, g in want.items())
    assert {(r["file"], r["id"]) for r in a.strangers.collect()} == {({"geno": "genotypes", "hap": "haplotypes", "seq": "reads"}[k], i) for i in want for k in ("geno", "hap", "seq") if i.startswith(k)}


def test_window_of_every_kind_of_file(spark, tmp_path):
    f, want = unrelated(tmp_path)
    a = Analysis(spark, Options(method="multi", geno=True, geno_threshold=[0.1], start_snp=2, stop_snp=4, n_cycle=1, **f)).run()
    assert sorted(lines(a, "geno_0.3333333333333333.txt")) == sorted(f"{i} {g} {g} {g}" for i, g in want.items())


def test_frequencies_of_founder_groups(spark, tmp_path):
    f = write(tmp_path, ped_file="M0 MF_1 MF_1\nF0 MF_2 MF_2\n", geno_file="M0 0 0\nF0 2 2\n")
    a = Analysis(spark, Options(method="multi", update_alt_allele_prob=True, alt_allele_prob=True, **f)).run()
    assert lines(a, "alt_allele_prob.txt") == ["MF_1\tMF_2", "0.01\t0.99", "0.01\t0.99"]
    b = Analysis(spark, Options(method="multi", n_cycle=1, est_alt_allele_prob=True, **f))
    with pytest.warns(UserWarning, match="several founder groups"):
        b.run()


#: Calls on X with recombination and gaps, and what they should give.
X_PED = "fm 0 0 1\nff 0 0 0\nmm 0 0 1\nmf 0 0 0\nf ff fm 0\nm mf mm 1\npfem1 f m 1\npfem2 f m 1\npfem3 f m 1\npmal1 f m 0\npmal2 f m 0\npmal3 f m 0\n"
X_CALLS = {"fm": "111111", "ff": "000000", "mm": "000000", "mf": "111111", "f": "199900", "m": "111991", "pfem1": "222111", "pfem2": "111099", "pfem3": "222090", "pmal1": "099000", "pmal2": "111111", "pmal3": "991000"}
X_TRUE = X_CALLS | {"f": "111000", "m": "111111", "pfem2": "111000", "pfem3": "222000", "pmal1": "000000", "pmal3": "111000"}
X_HAPS = {"f": ("999999", "111000"), "ff": ("999999", "000000"), "fm": ("000111", "111000"), "m": ("111111", "000000"), "mf": ("999999", "111111"), "mm": ("000000", "000000"), "pfem1": ("111000", "111111"), "pfem2": ("111000", "000000"), "pfem3": ("111000", "111000"), "pmal1": ("999999", "000000"), "pmal2": ("999999", "111111"), "pmal3": ("999999", "111000")}


def test_sex_chromosome_with_recombination(spark, tmp_path):
    """At most two wrong genotypes and five wrong alleles."""
    f = write(tmp_path, ped_file=X_PED, geno_file="".join(f"{i} {' '.join(c)}\n" for i, c in X_CALLS.items()))
    a = Analysis(spark, Options(method="multi", n_cycle=3, geno=True, hap=True, x_chr=True, **f)).run()
    geno = {x.split()[0]: "".join(x.split()[1:]) for x in lines(a, "geno_0.3333333333333333.txt")}
    assert sum(x != y for i in X_TRUE for x, y in zip(geno[i], X_TRUE[i], strict=True)) <= 2
    haps: dict = {}
    for x in lines(a, "hap_0.5.txt"):
        haps.setdefault(x.split()[0], []).append("".join(x.split()[1:]))
    assert sum(x != y for i in X_HAPS for h, t in zip(haps[i], X_HAPS[i], strict=True) for x, y in zip(h, t, strict=True)) <= 5
