"""Single-locus peeling with all cycles inside one grouped pass.

Without linkage, loci never meet: rows are shuffled once, by locus, and each task
runs every cycle over one locus's individuals as arrays. It needs memory in
proportion to the pedigree, not to the number of loci: cycles() does so up to MOST
individuals and takes the joins of peeling.Peeling beyond, which give the same values.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinspark.functions import vec
from kinspark.functions.vec import EPS, STATES, cols
from kinspark.operators import likelihood, peeling
from kinspark.operators.pedigree import families
from kinspark.session import cut

#: Individuals of a locus that one task holds.
MOST = 50_000


def _norm(x: np.ndarray) -> np.ndarray:
    axes = tuple(range(1, x.ndim))
    return x / x.sum(axis=axes, keepdims=True)


def _mix(x: np.ndarray) -> np.ndarray:
    return x * (1 - EPS) + EPS / x[0].size if len(x) else x


def _exp(x: np.ndarray) -> np.ndarray:
    axes = tuple(range(1, x.ndim))
    return _norm(np.exp(x - x.max(axis=axes, keepdims=True))) if len(x) else x


def _sums(index: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros((n, *rows.shape[1:]))
    np.add.at(out, index, rows)
    return out


def peel(gen, kids, fam, sire, dam, pen, ant, seg, tensors, kind, cycles: int):
    """Anterior and posterior after so many cycles. gen: of each family; kids, fam:
    individual and family of each child; sire, dam: individuals; kind: the tensor of each child."""
    n, f = len(pen), len(sire)
    post = np.full((n, 4), 0.25)
    back = {"s": np.full((f, 4), 0.25), "d": np.full((f, 4), 0.25)}  # less the family itself
    said = {"s": np.full((f, 4), 0.25), "d": np.full((f, 4), 0.25)}
    ant = ant.copy()
    ks = np.zeros((len(kids), 4, 4, 4))
    for i, tensor in enumerate(tensors):
        ks[kind == i] = np.einsum("abkd,cd->cabk", tensor, _norm(seg[kids[kind == i]]))

    def terms(g):
        at = np.flatnonzero(gen == g)
        local = np.full(f, -1)
        local[at] = np.arange(len(at))
        c = np.flatnonzero(gen[fam] == g)
        v = _mix(_norm(post[kids[c]] * pen[kids[c]]))
        logs = np.log(np.einsum("cabk,ck->cab", ks[c], v))
        own = local[fam[c]]
        ps = _norm(ant[sire[at]] * pen[sire[at]] * back["s"][at])
        pd = _norm(ant[dam[at]] * pen[dam[at]] * back["d"][at])
        return at, c, own, logs, _sums(own, logs, len(at)), ps, pd

    order = sorted(set(gen.tolist()))
    for _ in range(cycles):
        for g in order:
            at, c, own, logs, total, ps, pd = terms(g)
            joint = _mix(_norm(ps[:, :, None] * pd[:, None, :]))
            r = _exp(np.log(joint)[own] + total[own] - logs)
            ant[kids[c]] = _norm(np.einsum("cabk,cab->ck", ks[c], r))
        for g in reversed(order):
            at, c, own, logs, total, ps, pd = terms(g)
            both = _exp(total)
            said["s"][at] = _mix(_norm(np.einsum("fab,fb->fa", both, _mix(pd))))
            said["d"][at] = _mix(_norm(np.einsum("fab,fa->fb", both, _mix(ps))))
            for role, parent in (("s", sire), ("d", dam)):
                logs_ = np.log(said[role])
                sums = _sums(parent, logs_, n)
                touched = np.unique(parent[at])
                post[touched] = _exp(sums[touched])
                mine = np.flatnonzero(np.isin(parent, touched))
                back[role][mine] = _exp(sums[parent[mine]] - logs_[mine])
    return ant, post


def single_locus(rows: DataFrame, cycles: int, mutation: float = 1e-8, x_chromosome: bool = False) -> DataFrame:
    """id, locus, x0..3. rows: id, locus, gen, sex, sire, dam (null for founders), a0..3,
    p0..3, s0..3; every parent has rows of its own."""
    kinds = [np.array(vec.tensor(k, mutation)) for k in (("xy", "xx") if x_chromosome else ("autosome", "autosome"))]

    def one(pdf):
        ids = {v: i for i, v in enumerate(pdf["id"])}
        child = np.flatnonzero(pdf["sire"].notna().to_numpy())
        pairs = list(zip(pdf["sire"].iloc[child], pdf["dam"].iloc[child]))
        heads = {p: i for i, p in enumerate(dict.fromkeys(pairs))}
        fam = np.array([heads[p] for p in pairs], int)
        gen = np.zeros(len(heads), int)
        np.maximum.at(gen, fam, pdf["gen"].to_numpy()[child].astype(int))
        sire = np.array([ids[s] for s, _ in heads], int)
        dam = np.array([ids[d] for _, d in heads], int)
        get = lambda p: pdf[[f"{p}{i}" for i in range(4)]].to_numpy(float)
        kind = (pdf["sex"].to_numpy()[child] != 0).astype(int)
        ant, post = peel(gen, child, fam, sire, dam, get("p"), get("a"), get("s"), kinds, kind, cycles)
        x = _norm(ant * post * get("p"))
        out = pdf[["id", "locus"]].copy()
        for i in range(4):
            out[f"x{i}"] = x[:, i]
        return out

    kind = dict(rows.dtypes)
    return rows.groupBy("locus").applyInPandas(one, f"id {kind['id']}, locus {kind['locus']}, x0 double, x1 double, x2 double, x3 double")


def cycles(rows: DataFrame, n: int, mutation: float = 1e-8, x_chromosome: bool = False, most: int = MOST) -> DataFrame:
    """single_locus(), or for pedigrees of more than most individuals the same by joins."""
    people = cut(rows.select("id", "gen", "sex", "sire", "dam").distinct())
    if people.count() <= most:
        return single_locus(rows, n, mutation, x_chromosome)
    fams, kids = families(people.withColumn("is_founder", F.col("sire").isNull()))
    state = rows.select("id", "locus", "sex", *cols("a"), *cols("p"), *[vec.lit(0.25).alias(f"q{i}") for i in STATES], *cols("s"))
    loop = peeling.Peeling(people.select("id", "gen"), fams, kids, state, peeling.first_messages(fams, rows.select("locus").distinct()), peeling.Model(mutation, x_chromosome))
    for _ in range(n):
        loop.cycle()
    return likelihood.genotype_probability(loop.state()).drop("sex")
