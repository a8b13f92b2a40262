"""Scans of white-space separated pedigree, genotype, read and map files.

Files have no header; rows of several lines per id (haplotypes, reads, inheritance,
penetrance) keep their order by file, block and line within the block, so that large
files are read in parallel. Loci are numbered from 1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def lines(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """tokens (array), place (orders lines over all files), of lines that aren't blank."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    raw = spark.read.text(paths)
    at = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n"))
    x = raw.select(F.split(F.trim(F.regexp_replace("value", r"\s+", " ")), " ").alias("tokens"), at.alias("place"))
    return x.where(F.col("tokens")[0] != "")


def _kth(x: DataFrame) -> DataFrame:
    """Adds k, the place of a line among those of its id."""
    return x.withColumn("k", F.row_number().over(Window.partitionBy("id").orderBy("place")) - 1)


def _values(x: DataFrame, kind: str, *keep: str, start: int | None = None, stop: int | None = None) -> DataFrame:
    """One row per value of the line: keep, locus, v; loci start to stop, from 1, inclusive."""
    rest = F.slice("tokens", F.lit(2), F.greatest(F.size("tokens") - 1, F.lit(0)))
    y = x.select(*keep, F.posexplode(rest).alias("i", "t")).select(*keep, (F.col("i") + 1).alias("locus"), F.col("t").cast(kind).alias("v"))
    return y.where(F.col("locus").between(start, stop)) if start and stop else y


def pedigree(spark: SparkSession, paths) -> DataFrame:
    """id, sire, dam, sex (0 male, 1 female, by default 0), line; tokens after the fourth are ignored."""
    x = lines(spark, paths)
    t = F.col("tokens")
    sex = F.when(F.get(t, F.lit(3)).rlike("^[01]$"), F.get(t, F.lit(3)).cast("int")).otherwise(F.lit(0))
    return x.select(t[0].alias("id"), F.coalesce(F.get(t, F.lit(1)), F.lit("0")).alias("sire"), F.coalesce(F.get(t, F.lit(2)), F.lit("0")).alias("dam"), sex.alias("sex"), "place")


def genotypes(spark: SparkSession, paths, start=None, stop=None) -> DataFrame:
    """id, locus, g."""
    x = lines(spark, paths).select(F.col("tokens")[0].alias("id"), "tokens")
    return _values(x, "int", "id", start=start, stop=stop).withColumnRenamed("v", "g")


def _pair(spark, paths, names, kind, start, stop) -> DataFrame:
    x = _kth(lines(spark, paths).select(F.col("tokens")[0].alias("id"), "tokens", "place"))
    y = _values(x, kind, "id", "k", start=start, stop=stop)
    return y.groupBy("id", "locus").agg(*[F.max(F.when(F.col("k") % 2 == i, F.col("v"))).alias(n) for i, n in enumerate(names)])


def haplotypes(spark: SparkSession, paths, start=None, stop=None) -> DataFrame:
    """id, locus, pat, mat: the first line of an id is paternal."""
    return _pair(spark, paths, ("pat", "mat"), "int", start, stop)


def reads(spark: SparkSession, paths, start=None, stop=None) -> DataFrame:
    """id, locus, ref, alt: the first line of an id counts the reference allele."""
    return _pair(spark, paths, ("ref", "alt"), "bigint", start, stop)


def phenotypes(spark: SparkSession, paths) -> DataFrame:
    """id, pheno; repeated ids are repeated records."""
    return lines(spark, paths).select(F.col("tokens")[0].alias("id"), F.col("tokens")[1].cast("int").alias("pheno"))


def phenotype_penetrance(spark: SparkSession, path) -> DataFrame:
    """state, pheno, p: four lines, one a genotype state."""
    x = lines(spark, path).withColumn("state", F.row_number().over(Window.orderBy("place")) - 1)  # four lines
    return x.select("state", F.posexplode("tokens").alias("pheno", "t")).select("state", "pheno", F.col("t").cast("double").alias("p"))


def frequencies(spark: SparkSession, paths, start=None, stop=None) -> DataFrame:
    """mf, locus, p; fails on a line that doesn't begin with a founder group."""
    name = F.col("tokens")[0]
    good = F.when(name.startswith("MF_"), name).otherwise(F.raise_error(F.concat(F.lit("not a founder group: "), name)))
    return _values(lines(spark, paths).select(good.alias("mf"), "tokens"), "double", "mf", start=start, stop=stop).withColumnRenamed("v", "p")


def marker_map(spark: SparkSession, path, start=None, stop=None) -> DataFrame:
    """locus, chr, name, pos; loci in the order of positions."""
    t = F.col("tokens")
    x = lines(spark, path).select(t[0].alias("chr"), t[1].alias("name"), t[2].cast("bigint").alias("pos"), "place")
    x = x.withColumn("locus", F.row_number().over(Window.orderBy("pos", "place"))).drop("place")  # one row a marker
    return x.where(F.col("locus").between(start, stop)) if start and stop else x


def four_rows(spark: SparkSession, paths, start=None, stop=None) -> DataFrame:
    """id, state, locus, p of inheritance or penetrance files: four lines per id.

    Fails where an id has another number of lines, or lines differ in length."""
    x = lines(spark, paths).select(F.col("tokens")[0].alias("id"), "tokens", "place")
    w = Window.partitionBy("id")
    bad = (F.count("*").over(w) != 4) | (F.min(F.size("tokens")).over(w) != F.max(F.size("tokens")).over(w))
    x = _kth(x.withColumn("id", F.when(bad, F.raise_error(F.concat(F.lit("not four equal lines: "), F.col("id")))).otherwise(F.col("id"))))
    return _values(x, "double", "id", "k", start=start, stop=stop).withColumnsRenamed({"k": "state", "v": "p"})


def inheritance(spark: SparkSession, paths, start=None, stop=None) -> DataFrame:
    """id, seg, s0..3."""
    x = four_rows(spark, paths, start, stop)
    return x.groupBy("id", F.col("locus").cast("long").alias("seg")).agg(*[F.max(F.when(F.col("state") == i, F.col("p"))).alias(f"s{i}") for i in range(4)])


def plink(spark: SparkSession, prefix: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(pedigree, map, genotypes) of prefix.bed, .bim and .fam, variant-major.

    The bed file is read whole by one task, which limits it to 2 GB; larger panels come
    as text. Two bits a sample: 0 both first alleles, 1 missing, 2 both, 3 none, counted
    as alternative."""
    fam = lines(spark, prefix + ".fam").withColumn("i", F.row_number().over(Window.orderBy("place")) - 1)
    t = F.col("tokens")
    ped = fam.select(t[1].alias("id"), t[2].alias("sire"), t[3].alias("dam"), F.when(t[4] == "2", 1).otherwise(0).alias("sex"), "place")
    bim = lines(spark, prefix + ".bim").withColumn("locus", F.row_number().over(Window.orderBy("place")))
    markers = bim.select("locus", t[0].alias("chr"), t[1].alias("name"), t[3].cast("bigint").alias("pos"))
    n = fam.count()
    width = (n + 3) // 4
    raw = spark.read.format("binaryFile").load(prefix + ".bed").select(F.hex(F.expr("substring(content, 4)")).alias("h"))
    byte = raw.select(F.posexplode(F.expr("transform(sequence(0, length(h) div 2 - 1), i -> cast(conv(substr(h, 2 * i + 1, 2), 16, 10) as int))")).alias("j", "b"))
    bits = byte.select((F.floor(F.col("j") / width) + 1).cast("int").alias("locus"), (F.col("j") % width).alias("q"), "b")
    cells = bits.select("locus", F.posexplode(F.array(*[F.shiftright("b", 2 * k).bitwiseAND(F.lit(3)) for k in range(4)])).alias("k", "code"), "q")
    cells = cells.select("locus", (F.col("q") * 4 + F.col("k")).alias("i"), F.when(F.col("code") == 0, 2).when(F.col("code") == 1, 9).when(F.col("code") == 2, 1).otherwise(0).alias("g"))
    return ped, markers, cells.join(fam.select("i", t[1].alias("id")), "i").select("id", "locus", "g")


def keyed(x: DataFrame, key: Column) -> DataFrame:
    """Each key with the place of its first appearance, which orders as the file does: id, line."""
    return x.groupBy(key.alias("id")).agg(F.min("place").alias("line"))
