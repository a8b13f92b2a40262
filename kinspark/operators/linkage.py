"""Along the loci: transmission rates, forward-backward smoothing, marker brackets."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kinspark.functions import vec


def transmission_rates(loci: DataFrame, length: float = 1.0) -> DataFrame:
    """locus, rate to the next locus: its share of the map (of even steps without
    positions, column pos) times the length in Morgan. The last locus has none.

    A marker map has one row a locus, so one ordered window over it is small."""
    w = Window.orderBy("locus")
    whole = Window.partitionBy()
    pos = F.col("pos").cast("double") if "pos" in loci.columns else F.row_number().over(w).cast("double")
    x = loci.select("locus", pos.alias("pos"))
    span = F.nullif(F.max("pos").over(whole) - F.min("pos").over(whole), F.lit(0.0))
    return x.select("locus", ((F.lead("pos").over(w) - F.col("pos")) / span * length).alias("rate")).where("rate is not null")


def _step(m: np.ndarray, rate: float) -> np.ndarray:
    """One transition: no, one or two recombinations."""
    same, one, two = (1 - rate) ** 2, rate * (1 - rate), rate**2
    a, b, c, d = m.T
    return np.stack([same * a + one * (b + c) + two * d, same * b + one * (a + d) + two * c, same * c + one * (a + d) + two * b, same * d + one * (b + c) + two * a], axis=1)


def smooth(points: np.ndarray, rates: np.ndarray) -> np.ndarray:
    """Posterior over inheritance of (individuals, loci, 4) point evidence."""
    n, loci, _ = points.shape
    out = points.copy()
    for order, rate in ((range(1, loci), lambda i: rates[i - 1]), (range(loci - 2, -1, -1), lambda i: rates[i])):
        message = np.full((n, 4), 0.25)
        back = -1 if order.step == 1 else 1
        for i in order:
            m = message * points[:, i + back]
            message = _step(m / m.sum(axis=1, keepdims=True), rate(i))
            out[:, i] *= message
    return out / out.sum(axis=2, keepdims=True)


def forward_backward(points: DataFrame, rates: DataFrame) -> DataFrame:
    """child, locus, s0..3 from e0..3. The recursion normalises at every locus, which no
    window frame expresses; children are smoothed many at a time in Arrow batches."""
    rows = points.groupBy("child").agg(F.sort_array(F.collect_list(F.struct("locus", *vec.cols("e")))).alias("r"))
    steps = np.array([r["rate"] for r in rates.orderBy("locus").collect()])  # one number a locus
    shared = points.sparkSession.sparkContext.broadcast(steps)
    rows = rows.select("child", F.transform("r", lambda r: r["locus"]).alias("loci"), F.flatten(F.transform("r", lambda r: F.array(*[r[f"e{i}"] for i in range(4)]))).alias("e"))

    def run(batches):
        for b in batches:
            out = [None] * len(b)
            for n in b["e"].map(len).unique():
                at = np.flatnonzero(b["e"].map(len).to_numpy() == n)
                e = np.stack(b["e"].iloc[at].to_list()).reshape(len(at), n // 4, 4)
                for i, s in zip(at, smooth(e, shared.value)):
                    out[i] = s.ravel()
            yield b[["child", "loci"]].assign(s=out)

    kind, locus = dict(points.dtypes)["child"], dict(points.dtypes)["locus"]
    done = rows.mapInPandas(run, f"child {kind}, loci array<{locus}>, s array<double>")
    x = done.select("child", "s", F.posexplode("loci").alias("i", "locus"))
    return x.select("child", "locus", *[F.get("s", 4 * F.col("i") + i).alias(f"s{i}") for i in range(4)])


def brackets(snps: DataFrame, segs: DataFrame) -> DataFrame:
    """locus, left, right, weight of the left: the inheritance markers around each snp.

    Left is the last marker strictly before the snp, right the next one; beyond the
    ends both are the end marker. Maps are ordered by position."""
    rows = snps.select("pos", "locus", F.lit(None).cast("long").alias("seg"), F.lit(None).cast("double").alias("at"), F.lit(0).alias("kind"))
    rows = rows.unionByName(segs.select("pos", F.lit(None).cast(dict(snps.dtypes)["locus"]).alias("locus"), F.col("seg").cast("long").alias("seg"), F.col("pos").cast("double").alias("at"), F.lit(1).alias("kind")))
    before = Window.orderBy("pos", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    after = Window.orderBy("pos", "kind").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    x = rows.select("*", F.last("seg", True).over(before).alias("l"), F.last("at", True).over(before).alias("la"), F.first("seg", True).over(after).alias("r"), F.first("at", True).over(after).alias("ra"))
    weight = F.when(F.col("l").isNotNull() & F.col("r").isNotNull(), 1 - (F.col("pos") - F.col("la")) / (F.col("ra") - F.col("la"))).otherwise(F.lit(0.0))
    return x.where("kind = 0").select("locus", F.coalesce("l", "r").alias("left"), F.coalesce("r", "l").alias("right"), weight.alias("weight"))


def interpolate(seg: DataFrame, near: DataFrame) -> DataFrame:
    """id, locus, s0..3 between the bracketing markers. seg: id, seg, s0..3."""
    left = seg.select("id", F.col("seg").alias("left"), *[F.col(f"s{i}").alias(f"l{i}") for i in range(4)])
    right = seg.select("id", F.col("seg").alias("right"), *[F.col(f"s{i}").alias(f"r{i}") for i in range(4)])
    x = near.join(left, "left").join(right, ["id", "right"])
    w = F.col("weight")
    return x.select("id", "locus", *[(w * F.col(f"l{i}") + (1 - w) * F.col(f"r{i}")).alias(f"s{i}") for i in range(4)])
