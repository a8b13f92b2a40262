"""Pedigree structure: founders, dummy parents, founder groups, generations, families."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinspark.session import cut

UNKNOWN = "0"
GROUP = "MF_"


def is_group(c: Column) -> Column:
    return c.startswith(GROUP)


def known(c: Column) -> Column:
    """A parent that is an individual, not unknown and not a founder group."""
    return F.coalesce((c != UNKNOWN) & ~is_group(c), F.lit(False))


def check_groups(ped: DataFrame, main: str = "MF_1") -> DataFrame:
    """Fails where a founder group stands as an individual or the main group's name is no group's."""
    if not main.startswith(GROUP):
        raise ValueError(f"main founder group {main!r} must start with {GROUP}")
    bad = F.when(is_group(F.col("id")), F.raise_error(F.concat(F.lit("founder group used as an individual: "), F.col("id")))).otherwise(F.col("id"))
    return ped.withColumn("id", bad)


def with_dummies(ped: DataFrame) -> DataFrame:
    """One unknown parent becomes a new founder, MotherOf<id> or FatherOf<id>; parents
    without a row of their own become founders."""
    s, d = known(F.col("sire")), known(F.col("dam"))
    full = ped.withColumns({
        "sire": F.when(~s & d, F.concat(F.lit("FatherOf"), F.col("id"))).otherwise(F.col("sire")),
        "dam": F.when(s & ~d, F.concat(F.lit("MotherOf"), F.col("id"))).otherwise(F.col("dam")),
    })
    up = full.select(F.col("sire").alias("id"), F.lit(0).alias("sex")).union(full.select("dam", F.lit(1)))
    up = up.where(known(F.col("id"))).groupBy("id").agg(F.min("sex").alias("sex"))
    new = up.join(ped.select("id"), "id", "left_anti")
    dummy = F.col("id").startswith("FatherOf") | F.col("id").startswith("MotherOf")
    rows = new.select("id", F.lit(UNKNOWN).alias("sire"), F.lit(UNKNOWN).alias("dam"), "sex", dummy.alias("is_dummy"))
    return full.select("id", "sire", "dam", "sex", F.lit(False).alias("is_dummy")).unionByName(rows)


def with_founders(ped: DataFrame, main: str = "MF_1") -> DataFrame:
    """Adds is_founder and, for founders, their group: that named by a parent, else the main one."""
    founder = ~known(F.col("sire")) & ~known(F.col("dam"))
    group = F.when(is_group(F.col("sire")), F.col("sire")).when(is_group(F.col("dam")), F.col("dam")).otherwise(F.lit(main))
    return ped.withColumn("is_founder", founder).withColumn("mf", F.when(founder, group))


def generations(ped: DataFrame, limit: int = 10_000) -> DataFrame:
    """Adds gen: 0 for founders, else one more than the later parent. One round a
    generation; rounds keep only individuals that are still open."""
    links = cut(ped.select("id", F.explode(F.filter(F.array("sire", "dam"), known)).alias("parent")))
    done = cut(ped.where(F.col("is_founder")).select("id", F.lit(0).alias("gen")))
    open_ = cut(ped.where(~F.col("is_founder")).select("id"))
    for g in range(1, limit):
        if open_.isEmpty():
            return ped.join(done, "id")
        waiting = links.join(open_, "id").join(open_.select(F.col("id").alias("parent")), "parent", "left_semi").select("id").distinct()
        now = cut(open_.join(waiting, "id", "left_anti").select("id", F.lit(g).alias("gen")))
        if now.isEmpty():
            raise ValueError("the pedigree has a cycle")
        done, open_ = done.union(now), cut(open_.join(now, "id", "left_anti"))
    raise ValueError("too many generations")


def families(ped: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(fam, sire, dam, gen) and (fam, child, sex): full sibs, scheduled with their generation."""
    kids = ped.where(~F.col("is_founder"))
    fam = F.xxhash64("sire", "dam").alias("fam")
    heads = kids.groupBy("sire", "dam").agg(F.max("gen").alias("gen")).select(fam, "sire", "dam", "gen")
    return heads, kids.select(fam, F.col("id").alias("child"), "sex")


def distinct_parents(fams: DataFrame) -> DataFrame:
    """parent: every sire and dam of the families once."""
    return fams.select(F.explode(F.array("sire", "dam")).alias("parent")).distinct()


def union_ids(ped: DataFrame, *others: DataFrame) -> DataFrame:
    """Ids that only other files have become unrelated founders."""
    extra = others[0].select("id").distinct() if others else None
    for o in others[1:]:
        extra = extra.union(o.select("id")).distinct()
    if extra is None:
        return ped
    new = extra.join(ped.select("id"), "id", "left_anti").select("id", F.lit(UNKNOWN).alias("sire"), F.lit(UNKNOWN).alias("dam"), F.lit(0).alias("sex"))
    return ped.select("id", "sire", "dam", "sex").unionByName(new)


def output_order(ped: DataFrame, file_ids: DataFrame | None, only: bool = False) -> DataFrame:
    """Adds ord: the position in the chosen file (columns id, line), others after it by
    name. only: others and dummies go."""
    if file_ids is None:
        x = ped.withColumn("line", F.lit(None).cast("long"))
    else:
        x = ped.join(file_ids.groupBy("id").agg(F.min("line").alias("line")), "id", "left")
    if only and file_ids is not None:
        x = x.where(F.col("line").isNotNull() & ~F.col("is_dummy"))
    return x.withColumn("ord", F.struct(F.col("line").isNull().alias("late"), F.col("line"), F.col("id"))).drop("line")


def founder_groups_sorted(groups: list[str]) -> list[str]:
    """Numbered groups by number, then the others by name."""
    def key(g: str):
        tail = g.split("_", 1)[1] if "_" in g else g
        return (0, int(tail), "") if tail.isdigit() else (1, 0, tail)

    return sorted(groups, key=key)


def genotyped_founders(ped: DataFrame, genotypes: DataFrame) -> DataFrame:
    """Founders with a called genotype at any locus."""
    has = genotypes.where("g is not null and g <> 9").select("id").distinct()
    return ped.where(F.col("is_founder")).join(has, "id", "left_semi")



def unmatched_groups(given: DataFrame, founders: DataFrame) -> DataFrame:
    """mf, side: groups with frequencies that no founder has, and the other way round."""
    a, b = given.select("mf").distinct(), founders.select("mf").distinct()
    return a.join(b, "mf", "left_anti").select("mf", F.lit("not in the pedigree").alias("side")).union(b.join(a, "mf", "left_anti").select("mf", F.lit("without frequency").alias("side")))


def strangers(ped: DataFrame, files: dict[str, DataFrame]) -> DataFrame:
    """file, id: ids that a file has and the pedigree has not."""
    out = None
    for name, rows in files.items():
        x = rows.select("id").distinct().join(ped.select("id"), "id", "left_anti").select(F.lit(name).alias("file"), "id")
        out = x if out is None else out.unionByName(x)
    return out
