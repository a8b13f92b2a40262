"""Column algebra over 4-vectors of genotype or inheritance states.

Genotype states: 0 aa, 1 aA, 2 Aa, 3 AA, the paternal allele first. Inheritance
states: 0 pp, 1 pm, 2 mp, 3 mm, which of the father's haplotypes first. A vector
is a list of columns; a 4 x 4 table of parents is a list of 16, sire-major.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: mixing with the uniform distribution after each message.
EPS = 1e-6
STATES = range(4)


def lit(x: float) -> Column:
    return F.lit(float(x))


def cols(prefix: str, n: int = 4, of: str | None = None) -> list[Column]:
    return [F.col(f"{of}.{prefix}{i}" if of else f"{prefix}{i}") for i in range(n)]


def named(vec: list[Column], prefix: str) -> list[Column]:
    return [c.alias(f"{prefix}{i}") for i, c in enumerate(vec)]


def total(vec) -> Column:
    return reduce(lambda a, b: a + b, vec)


def times(*vecs: list[Column]) -> list[Column]:
    return [reduce(lambda a, b: a * b, xs) for xs in zip(*vecs, strict=True)]


def norm(vec: list[Column]) -> list[Column]:
    s = total(vec)
    return [x / s for x in vec]


def smooth(vec: list[Column], eps: float = EPS) -> list[Column]:
    return [x * lit(1 - eps) + lit(eps / len(vec)) for x in vec]


def exp_norm(vec: list[Column]) -> list[Column]:
    top = F.greatest(*vec)
    return norm([F.exp(x - top) for x in vec])


def ln(vec: list[Column]) -> list[Column]:
    return [F.ln(x) for x in vec]


def step(df: DataFrame, prefix: str, vec: list[Column]) -> DataFrame:
    """Adds a vector as columns prefix0, prefix1, ..."""
    return df.withColumns({f"{prefix}{i}": c for i, c in enumerate(vec)})


def add_norm(df: DataFrame, prefix: str, vec: list[Column], smoothed: bool = False) -> DataFrame:
    """Adds the normalised vector, its products computed once."""
    df = step(df, prefix, vec)
    out = norm(cols(prefix, len(vec)))
    return step(df, prefix, smooth(out) if smoothed else out)


def add_exp_norm(df: DataFrame, prefix: str, vec: list[Column]) -> DataFrame:
    n = len(vec)
    df = step(df, prefix, vec)
    df = df.withColumn(f"__{prefix}", F.greatest(*cols(prefix, n)))
    df = step(df, prefix, [F.exp(x - F.col(f"__{prefix}")) for x in cols(prefix, n)]).drop(f"__{prefix}")
    return step(df, prefix, norm(cols(prefix, n)))


# ------------------------------------------------------------ inheritance


def received(state: int, half: int) -> int:
    """Allele (0 or 1) that a parent in a genotype state hands on: half 0 paternal, 1 maternal."""
    return (state >> 1) if half == 0 else (state & 1)


def chance(kind: str, a: int, b: int, k: int, d: int) -> float:
    """Of a child in state k, given sire state a, dam state b, inheritance d, without
    mutation. Kinds: autosome; xx, a daughter, who has the sire's only (maternal)
    allele; xy, a son, whose paternal slot says nothing."""
    mine = received(b, d & 1) == (k & 1)
    if kind == "xy":
        return 0.5 * mine
    from_sire = received(a, d >> 1 if kind == "autosome" else 1)
    return float(mine and from_sire == (k >> 1))


def tensor(kind: str, mutation: float) -> list:
    """t[a][b][k][d] with mutation mixed in."""
    return [[[[chance(kind, a, b, k, d) * (1 - mutation) + mutation / 4 for d in STATES] for k in STATES] for b in STATES] for a in STATES]


def summed(weights: list[float], vec: list[Column]) -> Column:
    """A weighted sum; equal weights are factored, zeros left out."""
    by: dict[float, list[Column]] = {}
    for w, c in zip(weights, vec, strict=True):
        if w:
            by.setdefault(w, []).append(c)
    return total([lit(w) * total(cs) for w, cs in by.items()]) if by else lit(0)


# ------------------------------------------------------------ likelihoods


def hwe(p: Column) -> list[Column]:
    """Hardy-Weinberg proportions of the phased states."""
    q = lit(1) - p
    return [q * q, p * q, p * q, p * p]


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.least(x, lit(high)), lit(low))


def genotype_likelihood(g: Column, e: Column, x_male: Column | None = None) -> list[Column]:
    """Of each state, given a called genotype; 9 or null says nothing."""
    h = e / 2
    table = {0: [1 - e, h, h, h], 1: [h, 1 - e, 1 - e, h], 2: [h, h, h, 1 - e]}
    out = [F.when(g == 0, table[0][i]).when(g == 1, table[1][i]).when(g == 2, table[2][i]).otherwise(lit(1)) for i in STATES]
    if x_male is None:
        return out
    haploid = [F.when(g == 0, e if i & 1 else 1 - e).when(g == 1, 1 - e if i & 1 else e).otherwise(lit(1)) for i in STATES]
    return [F.when(x_male, a).otherwise(b) for a, b in zip(haploid, out, strict=True)]


def read_log_likelihood(ref: Column, alt: Column, e: Column, x_male: Column | None = None) -> list[Column]:
    """Natural logarithms, given counts of reference and alternative reads."""
    good, bad, half = F.ln(1 - e), F.ln(e), F.ln(lit(0.5))
    low, high, mid = ref * good + alt * bad, ref * bad + alt * good, (ref + alt) * half
    out = [low, mid, mid, high]
    if x_male is None:
        return out
    return [F.when(x_male, high if i & 1 else low).otherwise(out[i]) for i in STATES]


def doubled(g: Column) -> Column:
    """A hemizygous call as the diploid one: 1 becomes 2, missing stays missing."""
    return F.when(g == 1, F.lit(2)).otherwise(g)


def dosage(g: list[Column], x_male: Column | None = None) -> Column:
    """Expected alternative alleles; sons on X count state 1 alone, as calls of theirs
    have always been reported."""
    both = g[1] + g[2] + 2 * g[3]
    return both if x_male is None else F.when(x_male, g[1]).otherwise(both)


def call(ps: list[Column], values: list[int], threshold: float) -> Column:
    """The value of the first largest probability, or 9 unless it exceeds the threshold."""
    top = F.greatest(*ps)
    pick = F.coalesce(*[F.when(p == top, F.lit(v)) for p, v in zip(ps, values, strict=True)])
    return F.when(top <= lit(threshold + 1e-9), F.lit(9)).otherwise(pick).cast("int")


def called_genotype(g: list[Column], threshold: float, x_male: Column | None = None) -> Column:
    t = max(threshold, 1 / 3)
    plain = call([g[0], g[1] + g[2], g[3]], [0, 1, 2], t)
    return plain if x_male is None else F.when(x_male, call([g[0] + g[2], g[1] + g[3]], [0, 1], t)).otherwise(plain)


def called_haplotypes(g: list[Column], threshold: float) -> tuple[Column, Column]:
    """Paternal and maternal alleles; an even split is missing."""
    t = max(threshold, 1 / 2)
    return call([g[0] + g[1], g[2] + g[3]], [0, 1], t), call([g[0] + g[2], g[1] + g[3]], [0, 1], t)
