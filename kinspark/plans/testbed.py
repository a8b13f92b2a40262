"""Pedigree relations derived from the driver's star schema, in SQL that both engines read.

Customers are individuals in five generations; order lines give read counts and
genotypes at the loci 1 to 7. The data are not Mendelian: they test arithmetic.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

LOCI = range(1, 8)

_PED = """
SELECT id, gen, sex, mf, pheno, gen = 0 AS is_founder,
       CASE WHEN gen > 0 THEN (gen - 1) * h + 2 * ((({id9}) * 7) % ({h2})) END AS sire,
       CASE WHEN gen > 0 THEN (gen - 1) * h + 2 * ((({id3}) * 11) % ({h2})) + 1 END AS dam
FROM (SELECT c_custkey AS id, {gen} AS gen, CAST(c_custkey % 2 AS INT) AS sex, h,
             concat('MF_', CAST(n_regionkey + 1 AS {str})) AS mf, CASE WHEN c_mktsegment = 'BUILDING' THEN 1 ELSE 0 END AS pheno
      FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey JOIN (SELECT {n5} AS h FROM {customer}) ON true) t
"""
_CELLS = """
SELECT i.id, i.locus, CAST(coalesce(r.ref, 0) AS INT) AS ref, CAST(coalesce(r.alt, 0) AS INT) AS alt,
       CAST(coalesce(CASE WHEN r.g = 3 THEN 9 ELSE r.g END, 9) AS INT) AS g
FROM (SELECT c_custkey AS id, l.locus FROM {customer} JOIN ({loci}) l ON true) i
LEFT JOIN (SELECT o_custkey, l_linenumber, CAST(sum(l_quantity) AS BIGINT) % 4 AS g,
                  sum(CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END) AS ref, sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS alt
           FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey GROUP BY o_custkey, l_linenumber) r
       ON r.o_custkey = i.id AND r.l_linenumber = i.locus
"""
_LOCI = " UNION ALL ".join(f"SELECT {i} AS locus" for i in LOCI)


def _fill(sql: str, duck: bool, **tables) -> str:
    div = (lambda a, b: f"({a} // {b})") if duck else (lambda a, b: f"({a} div {b})")
    return sql.format(id9=div("id", 9), id3=div("id", 3), h2=div("h", 2), gen=f"CAST({div('c_custkey', 'h')} AS INT)", n5=div("count(*)", 5), str="VARCHAR" if duck else "STRING", loci=_LOCI, **tables)


NAMES = ("customer", "nation", "lineitem", "orders")
#: The same relations as DuckDB expressions for the oracles.
PED_SQL = _fill(_PED, True, **{t: t for t in NAMES})
CELLS_SQL = _fill(_CELLS, True, **{t: t for t in NAMES})
WITH = f"ped AS MATERIALIZED ({PED_SQL}), cells AS MATERIALIZED ({CELLS_SQL})"


def _run(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    frames = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in NAMES}
    return spark.sql(_fill(sql, False, **{t: "{" + t + "}" for t in NAMES}), **{t: f for t, f in frames.items() if "{" + t + "}" in sql})


def pedigree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, gen, sex, mf, pheno, is_founder, sire, dam."""
    return _run(spark, sf_dir, _PED)


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, locus, ref, alt, g; no reads and a missing call where there are no lines."""
    return _run(spark, sf_dir, _CELLS)
