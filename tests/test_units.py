"""Invariants of the algebra, the smoother and the scans."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinspark.functions import vec
from kinspark.operators import estimate, linkage, metrics, peeling
from kinspark.operators import pedigree as P
from kinspark.sources import text as S


@pytest.mark.parametrize("kind", ["autosome", "xx", "xy"])
def test_tensor_is_a_distribution_over_children(kind):
    t = np.array(vec.tensor(kind, 1e-3))
    assert np.allclose(t.sum(axis=2), 1)


def test_smoother_equals_enumeration():
    rng = np.random.default_rng(1)
    e, rates = rng.random((2, 4, 4)), np.array([0.1, 0.5, 0.3])
    got = linkage.smooth(e, rates)
    for n in range(2):
        want = np.zeros((4, 4))
        for path in itertools.product(range(4), repeat=4):
            p = np.prod([e[n, i, s] for i, s in enumerate(path)])
            for i, r in enumerate(rates):
                p *= {0: (1 - r) ** 2, 1: r * (1 - r), 2: r * r}[bin(path[i] ^ path[i + 1]).count("1")]
            for i, s in enumerate(path):
                want[i, s] += p
        assert np.allclose(got[n], want / want.sum(axis=1, keepdims=True))


def test_smoother_without_linkage_returns_evidence():
    e = np.random.default_rng(2).random((3, 5, 4))
    assert np.allclose(linkage.smooth(e, np.full(4, 0.5)), e / e.sum(axis=2, keepdims=True))


def test_one_family_leaves_uniform(spark):
    m = spark.createDataFrame([(1, "sire", 7, 1, 0.1, 0.2, 0.3, 0.4)], "fam long, role string, parent long, locus int, n0 double, n1 double, n2 double, n3 double")
    m = m.withColumns({f"m{i}": F.lit(0.0) for i in range(4)})
    assert [round(peeling.leave_one_out(m).first()[f"m{i}"], 9) for i in range(4)] == [0.25] * 4


def test_exp_norm_is_shift_invariant(spark):
    df = spark.createDataFrame([(-1000.0, -1001.0, -1002.0, -1003.0), (1000.0, 999.0, 998.0, 997.0)], "e0 double, e1 double, e2 double, e3 double")
    a, b = vec.add_exp_norm(df, "e", vec.cols("e")).collect()
    assert [round(x, 12) for x in a] == [round(x, 12) for x in b] and abs(sum(a) - 1) < 1e-12


def test_generations_with_parents_from_different_ones(spark):
    ped = spark.createDataFrame([("a", "0", "0", 0), ("b", "0", "0", 1), ("c", "a", "b", 0), ("d", "c", "b", 1)], "id string, sire string, dam string, sex int")
    got = {r["id"]: r["gen"] for r in P.generations(P.with_founders(ped)).collect()}
    assert got == {"a": 0, "b": 0, "c": 1, "d": 2}


def test_a_cycle_is_refused(spark):
    ped = spark.createDataFrame([("a", "b", "b", 0), ("b", "a", "a", 1)], "id string, sire string, dam string, sex int")
    with pytest.raises(ValueError, match="cycle"):
        P.generations(P.with_founders(ped))


def test_scans(spark, tmp_path):
    f = tmp_path / "h.txt"
    f.write_text("b 1 0\nb 0 1\n\n a  1 1\na 9 0\n")
    got = {(r["id"], r["locus"]): (r["pat"], r["mat"]) for r in S.haplotypes(spark, str(f)).collect()}
    assert got == {("b", 1): (1, 0), ("b", 2): (0, 1), ("a", 1): (1, 9), ("a", 2): (1, 0)}
    g = tmp_path / "s.txt"
    g.write_text("a 0.5 0.5\na 0.5 0.5\n")
    with pytest.raises(Exception, match="four equal lines"):
        S.four_rows(spark, str(g)).collect()


def test_plink(spark, tmp_path):
    (tmp_path / "x.fam").write_text("f a 0 0 1 -9\nf b 0 0 2 -9\nf c a b 1 -9\n")
    (tmp_path / "x.bim").write_text("1 s1 0 10 A G\n1 s2 0 20 A G\n")
    (tmp_path / "x.bed").write_bytes(bytes([0x6C, 0x1B, 0x01, 0b00111000, 0b00000110]))
    _, markers, geno = S.plink(spark, str(tmp_path / "x"))
    assert {(r["id"], r["locus"]): r["g"] for r in geno.collect()} == {("a", 1): 2, ("b", 1): 1, ("c", 1): 0, ("a", 2): 1, ("b", 2): 9, ("c", 2): 2}
    assert markers.count() == 2


def test_accuracy_skips_constants(spark):
    x = spark.createDataFrame([(1, 1, 0.0, 0.0), (2, 1, 1.0, 2.0), (1, 2, 1.0, 1.0), (2, 2, 1.0, 2.0)], "id int, locus int, est double, real double")
    assert [(r["locus"], round(r["r"], 6)) for r in metrics.marker_accuracy(x).collect()] == [(1, 1.0)]
    assert metrics.mean_accuracy(metrics.marker_accuracy(x)).first()[0] == 1.0


def test_unseen_phenotype_state_keeps_even_chances(spark):
    pheno = spark.createDataFrame([("a", 0), ("a", 5)], "id string, pheno int")
    probs = spark.createDataFrame([("a", 1.0, 0.0, 0.0, 0.0)], "id string, x0 double, x1 double, x2 double, x3 double")
    got = {(r["state"], r["pheno"]): r["p"] for r in estimate.phenotype_penetrance(pheno, probs, 2).collect()}
    assert got[0, 0] == 1.0 and got[3, 0] == got[3, 1] == 0.5


def test_union_order_has_a_place_for_every_id(spark):
    from kinspark.plans import catalog

    d = "/root/testdata/sf0.01"
    want = spark.read.parquet(f"{d}/customer.parquet").count() + spark.read.parquet(f"{d}/supplier.parquet").count()
    got = catalog.QUERIES["id_union_order"](spark, d)
    assert got.agg(F.count("*"), F.countDistinct("id"), F.max("place")).first()[:] == (want, want, want) and want > 200


def test_child_tensor_at_every_locus(spark):
    from kinspark.plans import catalog

    got = catalog.QUERIES["child_seg_tensor"](spark, "/root/testdata/sf0.001")
    assert sorted(r["seg"] for r in got.select("seg").distinct().collect()) == [1, 3, 5, 7]


def test_multi_locus_cycle_equals_enumeration(spark, monkeypatch):
    """A trio and a child's child over seven loci."""
    from kinspark.plans import catalog

    ped = spark.createDataFrame([(1, 0, 0, True, None, None), (2, 0, 1, True, None, None), (3, 0, 1, True, None, None), (4, 1, 0, False, 1, 2), (5, 2, 1, False, 4, 3)], "id long, gen int, sex int, is_founder boolean, sire long, dam long")
    p = np.random.default_rng(8).dirichlet(np.ones(4), (6, 8))
    rows = [(i, at, 0 if i in (1, 4) else 1, *[0.25] * 4, *[float(v) for v in p[i, at]], *[0.25] * 8) for i in range(1, 6) for at in range(1, 8)]
    names = ", ".join(f"{x}{i} double" for x in "apqs" for i in range(4))
    state = spark.createDataFrame(rows, f"id long, locus int, sex int, {names}")
    monkeypatch.setattr(catalog.B, "pedigree", lambda *_: ped)
    monkeypatch.setattr(catalog, "first_state", lambda *_: state)
    got = {(r["id"], r["locus"]): r for r in catalog.QUERIES["multi_locus_1cycle"](spark, "").collect()}
    rates = [r["rate"] for r in linkage.transmission_rates(catalog._map(spark)).orderBy("locus").collect()]
    rates = [r for r in rates if r is not None][:6]
    t = np.zeros((4, 4, 4, 4))
    for a, b, d in itertools.product(range(4), repeat=3):
        t[a, b, 2 * (a // 2 if d < 2 else a % 2) + (b // 2 if d % 2 == 0 else b % 2), d] = 1
    t = t * (1 - 1e-8) + 1e-8 / 4  # what only a mutation explains says nothing of the inheritance
    mean = t.mean(axis=3, keepdims=True)
    vec_of = lambda i, x, at: np.array([got[i, at][f"{x}{k}"] for k in range(4)])

    def smoothed(e):
        """Sums over all paths, by their first and last halves at each locus."""
        paths = np.array(list(itertools.product(range(4), repeat=7)))
        w = np.prod([e[i][paths[:, i]] for i in range(7)], axis=0)
        for i, r in enumerate(rates):
            flips = np.array([bin(k).count("1") for k in range(4)])[paths[:, i] ^ paths[:, i + 1]]
            w = w * np.array([(1 - r) ** 2, r * (1 - r), r * r])[flips]
        return np.array([np.bincount(paths[:, i], w, 4) / w.sum() for i in range(7)])

    e4 = [np.einsum("a,b,k,abkd->d", p[1, at], p[2, at], p[4, at], t / mean) for at in range(1, 8)]
    a4 = [np.einsum("a,b,abk->k", p[1, at], p[2, at], t.mean(axis=3)) for at in range(1, 8)]
    x4 = [a * p[4, at] / (a * p[4, at]).sum() for at, a in enumerate(a4, 1)]
    e5 = [np.einsum("a,b,k,abkd->d", x4[at - 1], p[3, at], p[5, at], t / mean) for at in range(1, 8)]
    s4, s5 = smoothed(e4), smoothed(e5)
    for at in range(1, 8):
        assert np.allclose(vec_of(4, "a", at), a4[at - 1], atol=1e-4)
        assert np.allclose(vec_of(4, "s", at), s4[at - 1], atol=1e-4)
        assert np.allclose(vec_of(5, "s", at), s5[at - 1], atol=1e-4)
        q4 = np.einsum("b,k,abkd,d->a", p[3, at], p[5, at], t, s5[at - 1])
        q4 /= q4.sum()
        assert np.allclose(vec_of(4, "q", at), q4, atol=1e-4)
        q1 = np.einsum("b,k,abkd,d->a", p[2, at], p[4, at] * q4, t, s4[at - 1])
        assert np.allclose(vec_of(1, "q", at), q1 / q1.sum(), atol=1e-4)


def test_peeling_reads_only_the_generations_it_needs(spark):
    """Generations in a line, some with parents of different ones: the loop equals one task's arrays."""
    from kinspark.operators import blocks, likelihood, peeling
    from kinspark.functions.vec import cols

    rows, i = [], 2
    ped = [(0, 0, 0, None, None), (1, 0, 1, None, None)]
    for g in range(1, 4):
        ped += [(i, g, 0, i - 2 if g < 3 else 2, i - 1), (i + 1, g, 1, i - 2 if g < 3 else 2, i - 1)]
        i += 2
    ped.append((i, 4, 0, 0, i - 1))
    r = np.random.default_rng(3)
    for who, g, sex, sire, dam in ped:
        for at in (1, 2):
            p = r.dirichlet(np.ones(4))
            rows.append((who, at, g, sex, sire, dam, *[0.25] * 4, *map(float, p), *[0.25] * 8))
    names = ", ".join(f"{x}{k} double" for x in "apqs" for k in range(4))
    x = spark.createDataFrame(rows, f"id long, locus int, gen int, sex int, sire long, dam long, {names}")
    people = x.select("id", "gen", "sex", "sire", "dam", F.col("sire").isNull().alias("is_founder")).distinct()
    fams, kids = P.families(people)
    state = x.select("id", "locus", "sex", *cols("a"), *cols("p"), *cols("q"), *cols("s"))
    loop = peeling.Peeling(people.select("id", "gen"), fams, kids, state, peeling.first_messages(fams, x.select("locus").distinct()), peeling.Model())
    assert loop.born == {1: [0], 2: [1], 3: [1, 2], 4: [0, 3]}
    loop.cycle()
    got = {(r["id"], r["locus"]): [r[f"x{k}"] for k in range(4)] for r in likelihood.genotype_probability(loop.state()).collect()}
    want = {(r["id"], r["locus"]): [r[f"x{k}"] for k in range(4)] for r in blocks.single_locus(x, 1).collect()}
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k], atol=1e-9) for k in got)


def test_cycles_beyond_one_task(spark):
    """Two cycles by joins, for a pedigree said to be too large for a task, equal those in one task."""
    from kinspark.operators import blocks

    ped = [(0, 0, 0, None, None), (1, 0, 1, None, None), (2, 0, 1, None, None), (3, 1, 0, 0, 1), (4, 1, 1, 0, 1), (5, 1, 1, 0, 2), (6, 2, 0, 3, 5), (7, 2, 1, 3, 4)]
    r = np.random.default_rng(4)
    rows = [(who, at, g, sex, sire, dam, *[0.25] * 4, *map(float, r.dirichlet(np.ones(4))), *[0.25] * 4) for who, g, sex, sire, dam in ped for at in (1, 2)]
    names = ", ".join(f"{x}{k} double" for x in "aps" for k in range(4))
    x = spark.createDataFrame(rows, f"id long, locus int, gen int, sex int, sire long, dam long, {names}")
    for on_x in (False, True):
        got, want = ({(r["id"], r["locus"]): [r[f"x{k}"] for k in range(4)] for r in blocks.cycles(x, 2, x_chromosome=on_x, most=m).collect()} for m in (7, 8))
        assert got.keys() == want.keys() and all(np.allclose(got[k], want[k], atol=1e-9) for k in got)


def test_checkpoints_bound_the_estimated_size(spark):
    from kinspark.session import cut

    x = spark.range(10).select("id")
    for _ in range(9):
        x = cut(x.join(x, "id").join(x, "id"))
    assert "E+" not in x._jdf.queryExecution().logical().stats().simpleString()
    assert sorted(r["id"] for r in x.collect()) == list(range(10))
