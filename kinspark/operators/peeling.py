"""Peeling: beliefs passed down and up a pedigree, one generation at a time.

Everything but the smoothing along loci is independent per locus, and a family
needs its parents, its children and its own messages only: equi-joins on
(individual, locus) and (family, locus), sums of logarithms in place of products,
columns in place of arrays. The state of each generation is a table of its own, and
so are the messages of its families: a step reads and rewrites its parents' and
children's generations only, so a cycle's work is linear in the generations. Each
step is checkpointed, which keeps plans small and survives lost executors.

State: id, locus, sex, a0..3 anterior, p0..3 penetrance, q0..3 posterior, s0..3
inheritance. Messages: fam, role, parent, locus, n0..3 (a family's message about
the parent) and m0..3 (what the parent's other families say).
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kinspark.functions import vec
from kinspark.functions.vec import STATES, cols
from kinspark.operators import linkage
from kinspark.operators.pedigree import distinct_parents
from kinspark.session import cut

SIRE, DAM = "sire", "dam"
PAIR = range(16)


@dataclass(frozen=True)
class Model:
    mutation: float = 1e-8
    x_chromosome: bool = False


def _by_sex(model: Model, build) -> list[Column]:
    """build(tensor) for autosomes; on X a son's or a daughter's by the sex column."""
    if not model.x_chromosome:
        return build(vec.tensor("autosome", model.mutation))
    sons, daughters = build(vec.tensor("xy", model.mutation)), build(vec.tensor("xx", model.mutation))
    return [F.when(F.col("sex") == 0, s).otherwise(d) for s, d in zip(sons, daughters, strict=True)]


def child_tensor(model: Model, seg: list[Column]) -> list[Column]:
    """S[a, b, k] = sum over d of T[a, b, k, d] seg[d], 64 columns."""
    return _by_sex(model, lambda t: [vec.summed(t[a][b][k], seg) for a in STATES for b in STATES for k in STATES])


def child_to_parents(model: Model, seg: list[Column], child: list[Column]) -> list[Column]:
    """C[a, b] = sum over k of S[a, b, k] child[k], 16 columns."""
    s = child_tensor(model, seg)
    return [vec.total([s[16 * a + 4 * b + k] * child[k] for k in STATES]) for a in STATES for b in STATES]


def parents_to_child(model: Model, seg: list[Column], pair: list[Column]) -> list[Column]:
    """A[k] = sum over a, b of S[a, b, k] pair[a, b]."""
    s = child_tensor(model, seg)
    return [vec.total([s[4 * ab + k] * pair[ab] for ab in PAIR]) for k in STATES]


def point_inheritance(model: Model, pair: list[Column], child: list[Column], normed: bool = True) -> list[Column]:
    """P[d] = sum over a, b, k of T[a, b, k, d] pair[a, b] child[k], normed: / mean over d of T."""

    def build(t):
        out = []
        for d in STATES:
            terms = []
            for ab in PAIR:
                ws = [(t[ab // 4][ab % 4][k], sum(t[ab // 4][ab % 4][k]) / 4 if normed else 1.0) for k in STATES]
                terms.append(pair[ab] * vec.summed([w[d] / n if n else 0.0 for w, n in ws], child))
            out.append(vec.total(terms))
        return out

    return _by_sex(model, build)


def joint(sire: list[Column], dam: list[Column]) -> list[Column]:
    """Outer product of the parents' vectors."""
    return [s * d for s in sire for d in dam]


def marginal_sire(pair: list[Column], dam: list[Column]) -> list[Column]:
    return [vec.total([pair[4 * a + b] * dam[b] for b in STATES]) for a in STATES]


def marginal_dam(pair: list[Column], sire: list[Column]) -> list[Column]:
    return [vec.total([pair[4 * a + b] * sire[a] for a in STATES]) for b in STATES]


def parent_terms(fams: DataFrame, state: DataFrame, messages: DataFrame) -> DataFrame:
    """fam, locus, j0..15 (joint prior, mixed), f0..3 and d0..3 (sire and dam, mixed)."""
    belief = vec.times(cols("a"), cols("p"))  # the messages stand for the posterior, less this family

    def side(role: str, prefix: str) -> DataFrame:
        own = state.select(F.col("id").alias(role), "locus", *vec.named(belief, "b"))
        x = fams.select("fam", role).join(own, role)
        x = x.join(messages.where(F.col("role") == role).select("fam", "locus", *cols("m")), ["fam", "locus"])
        x = vec.add_norm(x.select("fam", "locus", *vec.named(vec.times(cols("b"), cols("m")), prefix)), prefix, cols(prefix))
        return x.select("fam", "locus", *cols(prefix))

    x = side(SIRE, "f").join(side(DAM, "d"), ["fam", "locus"])
    x = vec.add_norm(x, "j", joint(cols("f"), cols("d")), smoothed=True)
    return x.select("fam", "locus", *cols("j", 16), *vec.named(vec.smooth(cols("f")), "f"), *vec.named(vec.smooth(cols("d")), "d"))


def child_terms(kids: DataFrame, state: DataFrame, model: Model) -> DataFrame:
    """fam, child, sex, locus, v0..3, g0..3, c0..15: each child's own evidence, and its
    logarithm of the message to the pair of parents."""
    x = kids.join(state.select(F.col("id").alias("child"), "locus", *cols("p"), *cols("q"), *cols("s")), "child")
    x = vec.add_norm(x, "v", vec.times(cols("q"), cols("p")), smoothed=True)
    x = vec.add_norm(x, "g", cols("s"))
    c = child_to_parents(model, cols("g"), cols("v"))
    return x.select("fam", "child", "sex", "locus", *cols("v"), *cols("g"), *vec.named(vec.ln(c), "c"))


def family_sums(children: DataFrame) -> DataFrame:
    """fam, locus, l0..15: sums of the children's logarithms, partly summed before the shuffle."""
    return children.groupBy("fam", "locus").agg(*[F.sum(f"c{i}").alias(f"l{i}") for i in PAIR])


def peel_down(fams: DataFrame, kids: DataFrame, state: DataFrame, messages: DataFrame, model: Model, rates: DataFrame | None = None) -> DataFrame:
    """child, locus, a0..3 for the children of the families; with rates (locus, rate)
    also s0..3, smoothed along the loci."""
    children = child_terms(kids, state, model)
    x = children.join(family_sums(children), ["fam", "locus"]).join(parent_terms(fams, state, messages), ["fam", "locus"])
    r = [F.ln(F.col(f"j{i}")) + F.col(f"l{i}") - F.col(f"c{i}") for i in PAIR]
    x = vec.add_exp_norm(x.select("fam", "child", "sex", "locus", *cols("v"), *cols("g"), *vec.named(r, "r")), "r", cols("r", 16))
    x = vec.add_norm(x, "a", parents_to_child(model, cols("g"), cols("r", 16)))
    if rates is None:
        return x.select("child", "locus", *cols("a"))
    x = vec.step(x, "e", point_inheritance(model, cols("r", 16), cols("v")))
    x = cut(x.select("child", "locus", *cols("a"), *cols("e")))
    seg = linkage.forward_backward(x.select("child", "locus", *cols("e")), rates)
    seg = seg.select("child", "locus", *vec.named(vec.smooth(cols("s")), "s"))
    return x.select("child", "locus", *cols("a")).join(seg, ["child", "locus"])


def peel_up(fams: DataFrame, kids: DataFrame, state: DataFrame, messages: DataFrame, model: Model) -> DataFrame:
    """fam, role, locus, n0..3: what each family says about its parents."""
    x = family_sums(child_terms(kids, state, model)).join(parent_terms(fams, state, messages), ["fam", "locus"])
    x = vec.add_exp_norm(x, "l", cols("l", 16))
    x = vec.add_norm(x, "x", marginal_sire(cols("l", 16), cols("d")), smoothed=True)
    x = vec.add_norm(x, "y", marginal_dam(cols("l", 16), cols("f")), smoothed=True)
    rows = F.array(
        F.struct(F.lit(SIRE).alias("role"), *vec.named(cols("x"), "n")),
        F.struct(F.lit(DAM).alias("role"), *vec.named(cols("y"), "n")),
    )
    return x.select("fam", "locus", F.explode(rows).alias("m")).select("fam", "m.role", "locus", *[F.col(f"m.n{i}").alias(f"n{i}") for i in STATES])


def leave_one_out(messages: DataFrame) -> DataFrame:
    """Messages with m0..3 set anew, and t0..3: sums over all families of the parent.

    An individual's families, not all rows, meet in a partition of the window."""
    w = Window.partitionBy("parent", "role", "locus")
    x = messages.withColumns({f"t{i}": F.sum(F.ln(F.col(f"n{i}"))).over(w) for i in STATES})
    return vec.add_exp_norm(x, "m", [F.col(f"t{i}") - F.ln(F.col(f"n{i}")) for i in STATES])


def posteriors(messages: DataFrame) -> DataFrame:
    """id, locus, q0..3: all families' messages about a parent multiplied; the dam's role
    wins for an individual that is both."""
    x = messages.groupBy("parent", "role", "locus").agg(*[F.sum(F.ln(F.col(f"n{i}"))).alias(f"q{i}") for i in STATES])
    x = vec.add_exp_norm(x, "q", cols("q"))
    x = x.groupBy("parent", "locus").agg(F.min_by(F.struct(*cols("q")), F.col("role")).alias("q"))
    return x.select(F.col("parent").alias("id"), "locus", "q.*")


def first_messages(fams: DataFrame, loci: DataFrame) -> DataFrame:
    """Uniform messages for every family, role and locus. loci has one row a locus."""
    rows = fams.select("fam", F.explode(F.array(F.struct(F.lit(SIRE).alias("role"), F.col("sire").alias("parent")), F.struct(F.lit(DAM).alias("role"), F.col("dam").alias("parent")))).alias("r"))
    rows = rows.select("fam", "r.*").join(loci.select(F.collect_list("locus").alias("loci")).select("loci"), F.lit(True))
    flat = {f"{p}{i}": vec.lit(0.25) for p in "nm" for i in STATES}
    return rows.select("fam", "role", "parent", F.explode("loci").alias("locus")).withColumns(flat)


class Peeling:
    """Iterated peeling over the generations of a pedigree.

    State and messages are kept by generation (messages by that of their family). A
    step reads its children's generation and those its families' parents belong to,
    and rewrites what it changes only; which generations that are is found once."""

    def __init__(self, individuals: DataFrame, fams: DataFrame, kids: DataFrame, state: DataFrame, messages: DataFrame, model: Model, rates: DataFrame | None = None):
        """individuals: id, gen. rates None: single locus, inheritance stays as given."""
        fams, kids, self.model, self.rates = cut(fams), cut(kids), model, rates
        gens = sorted(r["gen"] for r in individuals.select("gen").distinct().collect())  # one row a generation
        self.steps = [g for g in gens if g > 0]
        whole = cut(state.join(individuals.select("id", "gen"), "id"))
        self.columns = list(state.columns)
        self.states = {g: whole.where(F.col("gen") == g).select(*self.columns) for g in gens}
        self.fams = {g: cut(fams.where(F.col("gen") == g)) for g in self.steps}
        self.kids = {g: cut(kids.join(f.select("fam"), "fam", "left_semi")) for g, f in self.fams.items()}
        names = messages.columns
        sent = cut(messages.join(fams.select("fam", F.col("gen").alias("__gen")), "fam"))
        self.messages = {g: sent.where(F.col("__gen") == g).select(*names) for g in self.steps}
        links = fams.select("gen", F.explode(F.array("sire", "dam")).alias("parent"))
        links = cut(links.join(individuals.select(F.col("id").alias("parent"), F.col("gen").alias("born")), "parent").distinct())
        pairs = links.select("gen", "born").distinct().collect()  # at most as many as pairs of generations
        self.born = {g: sorted({r["born"] for r in pairs if r["gen"] == g}) for g in self.steps}
        meets = links.alias("x").join(links.alias("y"), "parent").select(F.col("x.gen").alias("g"), F.col("y.gen").alias("h")).distinct().collect()
        self.meets = {g: sorted({r["h"] for r in meets if r["g"] == g}) for g in self.steps}

    def state(self, gens: list[int] | None = None) -> DataFrame:
        """All individuals' rows, or those of some generations."""
        return reduce(DataFrame.unionByName, [self.states[g] for g in (self.states if gens is None else gens)])

    def down(self, g: int) -> None:
        near = self.state([*(h for h in self.born[g] if h != g), g])
        new = peel_down(self.fams[g], self.kids[g], near, self.messages[g], self.model, self.rates).withColumnRenamed("child", "id")
        self.states[g] = _replace(self.states[g], new, ("a", "s") if self.rates is not None else ("a",))

    def up(self, g: int) -> None:
        near = self.state([*(h for h in self.born[g] if h != g), g])
        new = peel_up(self.fams[g], self.kids[g], near, self.messages[g], self.model)
        names = self.messages[g].columns
        touched = cut(distinct_parents(self.fams[g]))
        own = self.messages[g].drop(*[f"n{i}" for i in STATES]).join(new, ["fam", "role", "locus"]).select(*names, F.lit(g).alias("gen"))
        # The parents' other families, whose messages about them stay as they are.
        other = [self.messages[h].join(touched, "parent", "left_semi").select(*names, F.lit(h).alias("gen")) for h in self.meets[g] if h != g]
        mine = cut(leave_one_out(reduce(DataFrame.unionByName, other, own)).select(*names, "gen"))
        self.messages[g] = mine.where(F.col("gen") == g).select(*names)
        for h in self.meets[g]:
            if h != g:
                rest = self.messages[h].join(touched, "parent", "left_anti").select(*names)
                self.messages[h] = cut(rest.unionByName(mine.where(F.col("gen") == h).select(*names)))
        new_q = cut(posteriors(mine))
        for h in self.born[g]:
            self.states[h] = _replace(self.states[h], new_q, ("q",))

    def cycle(self) -> None:
        for g in self.steps:
            self.down(g)
        for g in reversed(self.steps):
            self.up(g)

    def map_state(self, change) -> None:
        """Applies change (state -> state, the same columns) to every generation."""
        self.states = {g: cut(change(s).select(*self.columns)) for g, s in self.states.items()}


def _replace(state: DataFrame, new: DataFrame, prefixes: tuple[str, ...]) -> DataFrame:
    """State with the vectors of matching rows replaced."""
    take = [f"{p}{i}" for p in prefixes for i in STATES]
    x = state.join(new.select("id", "locus", *[F.col(c).alias(f"new_{c}") for c in take]), ["id", "locus"], "left")
    return cut(x.select(*[F.coalesce(f"new_{c}", c).alias(c) if c in take else F.col(c) for c in state.columns]))
