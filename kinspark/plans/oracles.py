"""DuckDB counterparts of the pedigree queries, in tall form: one row per state k."""

from __future__ import annotations

from kinspark.plans.testbed import WITH

K = "k4 AS (SELECT unnest(range(4))::INT AS k)"
S_ = range(4)


def wide(source: str, keys: str, prefix: str, value: str = "v", n: int = 4, places: int = 6) -> str:
    got = ", ".join(f"round(max({value}) FILTER (k = {i}), {places}) AS {prefix}{i}" for i in range(n))
    return f"SELECT {keys}, {got} FROM {source} GROUP BY {keys}"


def _called(e: str) -> str:
    return f"CASE g WHEN 9 THEN 1.0::DOUBLE WHEN 0 THEN CASE WHEN k = 0 THEN 1 - {e} ELSE {e} / 2 END WHEN 1 THEN CASE WHEN k IN (1, 2) THEN 1 - {e} ELSE {e} / 2 END ELSE CASE WHEN k = 3 THEN 1 - {e} ELSE {e} / 2 END END"


def _reads(e: str) -> str:
    return f"CASE WHEN k = 0 THEN pow(1 - {e}, ref) * pow({e}, alt) WHEN k = 3 THEN pow({e}, ref) * pow(1 - {e}, alt) ELSE pow(0.5::DOUBLE, ref + alt) END"


GE, SE = "1e-4::DOUBLE", "1e-3::DOUBLE"
GENO = f"{WITH}, {K}, raw AS (SELECT id, locus, k, {_called(GE)} AS v FROM cells, k4), pen AS MATERIALIZED (SELECT id, locus, k, v / sum(v) OVER (PARTITION BY id, locus) AS v FROM raw)"
READ = GENO.replace(_called(GE), _reads(SE))
BOTH = GENO.replace(_called(GE), f"({_called(GE)}) * ({_reads(SE)})")
PROB_ = BOTH
TABLE = "tab(k, pheno, p) AS (VALUES (0, 0, 0.9::DOUBLE), (0, 1, 0.1), (1, 0, 0.8), (1, 1, 0.2), (2, 0, 0.7), (2, 1, 0.3), (3, 0, 0.1), (3, 1, 0.9))"

FAMILIES = f"WITH {WITH} SELECT sire, dam, max(gen) AS gen, count(*) AS n_children, min(id) AS first_child FROM ped WHERE sire IS NOT NULL GROUP BY sire, dam"
GENERATIONS = f"""WITH RECURSIVE {WITH}, g AS (
  SELECT id, 0 AS gen FROM ped WHERE sire IS NULL
  UNION SELECT p.id, g.gen + 1 FROM ped p JOIN g ON p.sire = g.id OR p.dam = g.id)
SELECT id, max(gen)::INT AS gen FROM g GROUP BY id"""
HALF = f"""{WITH}, half AS (SELECT 'i' || id AS id, sex,
  CASE WHEN is_founder THEN mf WHEN id % 7 = 0 THEN '0' ELSE 'i' || sire END AS sire,
  CASE WHEN is_founder OR id % 11 = 0 THEN '0' ELSE 'i' || dam END AS dam FROM ped)"""
DUMMIES = f"""WITH {HALF}, x AS (SELECT id, sex, sire LIKE 'i%' AS s, dam LIKE 'i%' AS d, sire, dam FROM half)
SELECT id, CASE WHEN d AND NOT s THEN 'FatherOf' || id ELSE sire END AS sire, CASE WHEN s AND NOT d THEN 'MotherOf' || id ELSE dam END AS dam, sex::BIGINT AS sex, false AS is_dummy FROM x
UNION ALL SELECT 'FatherOf' || id, '0', '0', 0, true FROM x WHERE d AND NOT s
UNION ALL SELECT 'MotherOf' || id, '0', '0', 1, true FROM x WHERE s AND NOT d"""
GROUPS = f"""WITH {HALF}, f AS (SELECT id, CASE WHEN sire LIKE 'MF%' THEN sire ELSE 'MF_9' END AS mf FROM half WHERE sire NOT LIKE 'i%' AND dam NOT LIKE 'i%')
SELECT mf, count(*) AS n, min(id) AS first FROM f GROUP BY mf"""
GROUPS_MISSING = f"""WITH {WITH}, given(mf) AS (VALUES ('MF_1'), ('MF_3'), ('MF_8'), ('MF_12')), mine AS (SELECT DISTINCT mf FROM ped WHERE is_founder)
SELECT mf, 'not in the pedigree' AS side FROM (SELECT mf FROM given EXCEPT SELECT mf FROM mine)
UNION ALL SELECT mf, 'without frequency' FROM (SELECT mf FROM mine EXCEPT SELECT mf FROM given)"""
UNION_ORDER = f"""WITH {WITH}, u AS (SELECT id::VARCHAR AS id, NULL AS line FROM ped UNION ALL
  SELECT 's' || s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN s_suppkey END FROM supplier)
SELECT id, row_number() OVER (ORDER BY line IS NULL, line, id) AS place FROM u"""
GENOTYPED_FOUNDERS = f"WITH {WITH} SELECT id, mf FROM ped WHERE is_founder AND id IN (SELECT id FROM cells WHERE g <> 9)"
STRANGERS = f"WITH {WITH} SELECT 'genotypes' AS file, id FROM ped WHERE id % 3 = 0 UNION ALL SELECT 'phenotypes', id FROM ped WHERE id % 3 = 0 AND pheno = 1"
SCAN_PEDIGREE = f"WITH {WITH} SELECT id, CASE WHEN is_founder THEN mf ELSE sire::VARCHAR END AS sire, CASE WHEN is_founder THEN '0' ELSE dam::VARCHAR END AS dam, sex FROM ped"
SCAN_GENOTYPES = f"WITH {WITH} SELECT id, locus, g FROM cells"
SCAN_HAPLOTYPES = f"WITH {WITH} SELECT id, locus, ref % 2 AS pat, alt % 2 AS mat FROM cells"
SCAN_READS = f"WITH {WITH} SELECT id, locus, ref::BIGINT AS ref, alt::BIGINT AS alt FROM cells"
SCAN_PHENOTYPES = f"WITH {WITH} SELECT id, pheno FROM ped UNION ALL SELECT id, 0 FROM ped WHERE id % 4 = 0"
SNP_WINDOW = f"WITH {WITH} SELECT locus, sum(ref)::BIGINT AS ref, sum(alt)::BIGINT AS alt, count(*) FILTER (g <> 9) AS called FROM cells WHERE locus BETWEEN 2 AND 4 GROUP BY locus"

PEN_GENO = f"WITH {GENO} {wide('pen', 'id, locus', 'p')}"
PEN_READS = f"WITH {READ} {wide('pen', 'id, locus', 'p')}"
PEN_BOTH = f"WITH {BOTH} {wide('pen', 'id, locus', 'p')}"
MASK = f'WITH {WITH} SELECT locus, count(*) FILTER (g <> 9 OR ref <> 0 OR alt <> 0) AS n, count(*) AS "all" FROM cells GROUP BY locus'
FILLED = f"""WITH {WITH} SELECT id, locus, (CASE WHEN g = 9 AND (id + locus) % 3 <> 0 AND id % 5 <> 0 THEN ref % 2 + alt % 2 ELSE g END)::INT AS g FROM cells"""
PEN_PHENO = f"""WITH {WITH}, {TABLE}, rec AS (SELECT id, pheno FROM ped UNION ALL SELECT id, 0 FROM ped WHERE id % 4 = 0),
w AS (SELECT id, k, product(p) AS v FROM rec JOIN tab USING (pheno) GROUP BY id, k), n AS (SELECT id, k, v / sum(v) OVER (PARTITION BY id) AS v FROM w) {wide('n', 'id', 'h')}"""
HET = f"""WITH {WITH}, h AS (SELECT id, locus - 1 AS l, abs(locus - 1 - 3) AS far FROM cells WHERE g = 1)
SELECT id, l AS locus FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY far, l DESC) AS r FROM h) WHERE r = 1"""
ANCHOR = f"""WITH {BOTH}, h AS (SELECT id, locus, row_number() OVER (PARTITION BY id ORDER BY abs(locus - 4), locus DESC) AS r FROM cells WHERE g = 1),
x AS (SELECT pen.id, pen.locus, k, CASE WHEN r = 1 THEN CASE WHEN k = 2 THEN 1 - {GE} ELSE {GE} / 3 END ELSE v END AS v
      FROM pen LEFT JOIN h ON h.id = pen.id AND h.locus = pen.locus WHERE pen.id IN (SELECT id FROM ped WHERE is_founder)) {wide('x', 'id, locus', 'p')}"""
FREQ = "freq AS (SELECT 'MF_' || g AS mf, l::INT AS locus, g * 0.2::DOUBLE - 0.205::DOUBLE + l / 100.0::DOUBLE AS p FROM unnest([1, 2, 3, 5]) a(g), unnest(range(1, 8)) b(l))"


def _hardy(p: str) -> str:
    return f"CASE k WHEN 0 THEN (1 - {p}) ^ 2 WHEN 3 THEN {p} ^ 2 ELSE {p} * (1 - {p}) END"


HWE = f"WITH {FREQ}, {K}, x AS (SELECT mf, locus, k, {_hardy('p')} AS v FROM freq, k4) {wide('x', 'mf, locus', 'a')}"
PRIOR = f"""WITH {WITH}, {FREQ}, {K}, y AS (SELECT id, l.locus, least(greatest(coalesce(p, 0.5), 0.01), 0.99) AS p
  FROM ped, (SELECT DISTINCT locus FROM cells) l LEFT JOIN freq f ON f.mf = ped.mf AND f.locus = l.locus WHERE is_founder),
x AS (SELECT id, locus, k, {_hardy('p')} AS v FROM y, k4) {wide('x', 'id, locus', 'a')}"""
EXTERNAL = f"WITH {BOTH}, x AS (SELECT id, locus, k, v * CASE WHEN id % 2 = 0 THEN (id + k) % 4 + 1 ELSE 1 END AS v FROM pen) {wide('x', 'id, locus', 'p')}"

PROB = f"WITH {PROB_} {wide('pen', 'id, locus', 'x')}"
DOSAGE = f"WITH {PROB_} SELECT id, locus, round(sum(v * CASE k WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END), 6) AS dosage FROM pen GROUP BY id, locus"
DOSAGE_X = f"""WITH {WITH}, {K}, c AS (SELECT c.id, locus, ref, alt, sex, CASE WHEN g = 2 THEN 1 ELSE g END AS g FROM cells c JOIN ped ON ped.id = c.id),
m AS (SELECT id, locus, k, sex, CASE WHEN g = 9 THEN 1 WHEN g = k % 2 THEN 1 - {GE} ELSE {GE} END
        * CASE WHEN k % 2 = 0 THEN pow(1 - {SE}, ref) * pow({SE}, alt) ELSE pow({SE}, ref) * pow(1 - {SE}, alt) END AS v FROM c, k4 WHERE sex = 0
      UNION ALL SELECT id, locus, k, sex, ({_called(GE)}) * ({_reads(SE)}) FROM c, k4 WHERE sex = 1),
n AS (SELECT *, v / sum(v) OVER (PARTITION BY id, locus) AS x FROM m)
SELECT id, locus, round(sum(x * CASE WHEN sex = 0 THEN CASE WHEN k = 1 THEN 1 ELSE 0 END ELSE CASE k WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END END), 6) AS dosage FROM n GROUP BY id, locus"""
W_ = f"WITH {PROB_}, w AS (SELECT id, locus, max(v) FILTER (k = 0) AS a, max(v) FILTER (k = 1) AS b, max(v) FILTER (k = 2) AS c, max(v) FILTER (k = 3) AS d FROM pen GROUP BY id, locus)"
CALL = f"{W_} SELECT id, locus, (CASE WHEN greatest(a, b + c, d) <= 0.9 + 1e-9 THEN 9 WHEN a >= b + c AND a >= d THEN 0 WHEN b + c >= d THEN 1 ELSE 2 END)::INT AS g FROM w"
PHASE = f"""{W_} SELECT id, locus, (CASE WHEN greatest(a + b, c + d) <= 0.6 + 1e-9 THEN 9 WHEN a + b >= c + d THEN 0 ELSE 1 END)::INT AS pat,
  (CASE WHEN greatest(a + c, b + d) <= 0.6 + 1e-9 THEN 9 WHEN a + c >= b + d THEN 0 ELSE 1 END)::INT AS mat FROM w"""
PHENO_PROB = f"""WITH {PROB_}, {TABLE}, s AS (SELECT id, pheno, sum(v * p) AS v FROM pen JOIN tab USING (k) GROUP BY id, pheno)
SELECT id, pheno, round(v / sum(v) OVER (PARTITION BY id), 6) AS prob FROM s"""
_GROUPS = (1, 2, 3, 5)
PIVOT = f"""WITH {FREQ} SELECT 0 AS line, array_to_string(['MF_1', 'MF_2', 'MF_3', 'MF_5'], chr(9)) AS value
UNION ALL SELECT locus, {" || chr(9) || ".join(f"printf('%.2f', max(p + 0.002) FILTER (mf = 'MF_{g}'))" for g in _GROUPS)} FROM freq GROUP BY locus"""
SCAN_FREQUENCIES = f"WITH {FREQ} SELECT mf, locus, round(p, 6) AS p FROM freq"
SCAN_TABLE = f"WITH {TABLE} SELECT k AS state, pheno, p FROM tab"
SINK_PHENOTYPES = f"WITH {WITH} SELECT id || ' ' || printf('%.4f', (id % 7 + f) / 8.0::DOUBLE) AS value, f AS \"row\" FROM ped, (VALUES (0), (1)) q(f)"
SINK_PARAMETERS = f"WITH {WITH} SELECT locus AS line, printf('%.6f', (sum(alt) % 64) / 64.0::DOUBLE) AS value FROM cells GROUP BY locus"


def _seg(step: int) -> str:
    return f"{WITH}, {K}, sraw AS (SELECT id, s AS seg, k, ((id + s * (k + 1)) % 4 + 1)::DOUBLE AS v FROM ped, unnest(range(1, 8, {step})) t(s), k4), seg AS MATERIALIZED (SELECT id, seg, k, v / sum(v) OVER (PARTITION BY id, seg) AS v FROM sraw)"


_CELL = 'seg::INT AS locus'
SINK_PHASED = f'WITH {_seg(2)} SELECT id, k AS "row", {_CELL}, round(v, 6) AS v FROM seg'
SINK_UNPHASED = f'WITH {_seg(2)} SELECT id, (CASE k WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)::INT AS "row", {_CELL}, round(sum(v), 6) AS v FROM seg GROUP BY ALL'
SINK_DOSAGES = f'WITH {_seg(2)} SELECT id, 0 AS "row", {_CELL}, round(sum(v * CASE k WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END), 6) AS v FROM seg GROUP BY ALL'
SINK_DOSAGES_X = f'WITH {_seg(2)} SELECT seg.id, 0 AS "row", {_CELL}, round(sum(v * CASE WHEN sex = 0 THEN CASE WHEN k = 1 THEN 1 ELSE 0 END ELSE CASE k WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END END), 6) AS v FROM seg JOIN ped ON ped.id = seg.id GROUP BY ALL'
_STATES = f"WITH {_seg(2)}, w AS (SELECT id, seg, max(v) FILTER (k = 0) AS a, max(v) FILTER (k = 1) AS b, max(v) FILTER (k = 2) AS c, max(v) FILTER (k = 3) AS d FROM seg GROUP BY id, seg)"
SINK_CALLED = f'{_STATES} SELECT id, 0 AS "row", {_CELL}, (CASE WHEN greatest(a, b + c, d) <= 0.45 + 1e-9 THEN 9 WHEN a >= b + c AND a >= d THEN 0 WHEN b + c >= d THEN 1 ELSE 2 END)::DOUBLE AS v FROM w'
SINK_HAPLOTYPES = f"""{_STATES} SELECT id, 0 AS "row", {_CELL}, (CASE WHEN greatest(a + b, c + d) <= 0.55 + 1e-9 THEN 9 WHEN a + b >= c + d THEN 0 ELSE 1 END)::DOUBLE AS v FROM w
UNION ALL SELECT id, 1, seg::INT, (CASE WHEN greatest(a + c, b + d) <= 0.55 + 1e-9 THEN 9 WHEN a + c >= b + d THEN 0 ELSE 1 END)::DOUBLE FROM w"""
_FOURTH = "((seg + 1) // 2)"
SCAN_EXTERNAL = f"WITH {_seg(2)} SELECT id, k AS state, {_FOURTH}::INT AS locus, round(v, 6) AS p FROM seg"
SCAN_INHERITANCE = f"WITH {_seg(2)}, y AS (SELECT id, {_FOURTH}::BIGINT AS seg, k, v FROM seg) {wide('y', 'id, seg', 's')}"
SEG_DEFAULT = f"WITH {_seg(2)}, x AS (SELECT id, seg, k, CASE WHEN id % 3 = 0 THEN v ELSE 0.25 END AS v FROM seg) {wide('x', 'id, seg', 's')}"
SCAN_MAP = "WITH map AS (SELECT l::INT AS locus, (l * (l + 1) * 500)::BIGINT AS pos FROM unnest(range(1, 8)) t(l)) SELECT locus, '1' AS chr, 'm' || locus AS name, pos FROM map WHERE locus BETWEEN 2 AND 6"
MAP = "map AS (SELECT l::INT AS locus, (l * (l + 1) * 500)::BIGINT AS pos FROM unnest(range(1, 8)) t(l))"
RATE = f"{MAP}, rate AS (SELECT locus, (lead(pos) OVER (ORDER BY locus) - pos) / (max(pos) OVER () - min(pos) OVER ())::DOUBLE AS rate FROM map)"
RATES = f"WITH {RATE} SELECT locus, round(rate, 9) AS rate FROM rate WHERE rate IS NOT NULL"


def _brackets(where: str) -> str:
    return f"""{MAP}, mk AS (SELECT locus::BIGINT AS seg, pos FROM map WHERE {where}),
near AS (SELECT m.locus, m.pos, (SELECT max(pos) FROM mk WHERE mk.pos < m.pos) AS lp, (SELECT min(pos) FROM mk WHERE mk.pos >= m.pos) AS rp FROM map m),
br AS MATERIALIZED (SELECT locus, coalesce(l.seg, r.seg) AS "left", coalesce(r.seg, l.seg) AS "right", CASE WHEN lp IS NULL OR rp IS NULL THEN 0.0::DOUBLE ELSE 1 - (near.pos - lp) / (rp - lp)::DOUBLE END AS weight
       FROM near LEFT JOIN mk l ON l.pos = lp LEFT JOIN mk r ON r.pos = rp)"""


BRACKETS = f'WITH {_brackets("locus IN (2, 4, 6)")} SELECT locus, "left", "right", round(weight, 6) AS weight FROM br'
INTERPOLATE = f"""WITH {_seg(2)}, {_brackets("locus % 2 = 1")}, x AS (SELECT a.id, br.locus, a.k, weight * a.v + (1 - weight) * b.v AS v
  FROM br JOIN seg a ON a.seg = br."left" JOIN seg b ON b.seg = br."right" AND b.id = a.id AND b.k = a.k) {wide('x', 'id, locus', 's')}"""



def _move(a: str, b: str) -> str:
    return f"CASE bit_count(xor({a}, {b})) WHEN 0 THEN (1 - r) * (1 - r) WHEN 1 THEN r * (1 - r) ELSE r * r END"


def _messages(name: str, back: int) -> str:
    """Unrolled over the seven loci; back -1 forward, 1 backward."""
    order = list(range(1, 8)) if back < 0 else list(range(7, 0, -1))
    parts = [f"{name}{order[0]} AS MATERIALIZED (SELECT id, k, 0.25::DOUBLE AS v FROM seg WHERE seg = {order[0]})"]
    for before, at in zip(order, order[1:]):
        gap = min(before, at)
        parts.append(f"""{name}{at} AS MATERIALIZED (SELECT t.id, k4.k, sum(t.v * {_move('k4.k', 't.k')}) AS v
  FROM (SELECT m.id, m.k, m.v * e.v / sum(m.v * e.v) OVER (PARTITION BY m.id) AS v FROM {name}{before} m JOIN seg e ON e.id = m.id AND e.k = m.k AND e.seg = {before}) t, k4,
       (SELECT rate AS r FROM rate WHERE locus = {gap}) GROUP BY t.id, k4.k)""")
    return ", ".join(parts)


FORWARD_BACKWARD = f"""WITH {_seg(1)}, {RATE}, {_messages('fw', -1)}, {_messages('bw', 1)}, y AS ({" UNION ALL ".join(f"SELECT e.id, {i} AS locus, e.k, e.v * f.v * b.v AS v FROM seg e JOIN fw{i} f ON f.id = e.id AND f.k = e.k JOIN bw{i} b ON b.id = e.id AND b.k = e.k WHERE e.seg = {i}" for i in range(1, 8))}),
x AS (SELECT id AS child, locus, k, v / sum(v) OVER (PARTITION BY id, locus) AS v FROM y) {wide('x', 'child, locus', 's')}"""

# ------------------------------------------------------------ one family

MU = "1e-8::DOUBLE"
FAM = "fam AS MATERIALIZED (SELECT sire, dam, max(gen) AS gen FROM ped WHERE sire IS NOT NULL GROUP BY sire, dam)"
TENSOR_ = f"""ten AS MATERIALIZED (SELECT a, b, k, d, (CASE WHEN CASE WHEN d < 2 THEN a // 2 ELSE a % 2 END = k // 2 AND CASE WHEN d % 2 = 0 THEN b // 2 ELSE b % 2 END = k % 2 THEN 1 - {MU} ELSE 0 END + {MU} / 4)::DOUBLE AS w
  FROM unnest(range(4)) q(a), unnest(range(4)) r(b), unnest(range(4)) s(k), unnest(range(4)) t(d))"""
MIX4, MIX16 = "{x} * (1 - 1e-6) + 1e-6 / 4", "{x} * (1 - 1e-6) + 1e-6 / 16"


def _pair(role: str, ant: str, msg: str, name: str, where: str = "true") -> str:
    """Normalised, not mixed: prior times penetrance times the other families' message."""
    return f"""{name} AS MATERIALIZED (SELECT f.sire, f.dam, p.locus, p.k, a.v * p.v * m.v / sum(a.v * p.v * m.v) OVER (PARTITION BY f.sire, f.dam, p.locus) AS v
  FROM fam f JOIN pen p ON p.id = f.{role} JOIN {ant} a ON a.id = p.id AND a.locus = p.locus AND a.k = p.k
  JOIN {msg} m ON m.sire = f.sire AND m.dam = f.dam AND m.locus = p.locus AND m.k = p.k AND m.role = '{role}' WHERE {where})"""


def _joint(ps: str, pd: str, name: str) -> str:
    return f"{name} AS MATERIALIZED (SELECT s.sire, s.dam, s.locus, s.k AS a, d.k AS b, {MIX16.format(x='s.v * d.v / sum(s.v * d.v) OVER (PARTITION BY s.sire, s.dam, s.locus)')} AS v FROM {ps} s JOIN {pd} d ON s.sire = d.sire AND s.dam = d.dam AND s.locus = d.locus)"


START = f"ant0 AS MATERIALIZED (SELECT id, locus, k, 0.25::DOUBLE AS v FROM pen), post0 AS MATERIALIZED (SELECT * FROM ant0), msg0 AS MATERIALIZED (SELECT sire, dam, role, locus, k, 0.25::DOUBLE AS v, 0.25::DOUBLE AS n FROM fam, (VALUES ('sire'), ('dam')) r(role), (SELECT DISTINCT locus FROM cells) l, k4)"
FIRST = f"{BOTH}, {FAM}, {START}, {_pair('sire', 'ant0', 'msg0', 'ps')}, {_pair('dam', 'ant0', 'msg0', 'pd')}, {_joint('ps', 'pd', 'j')}"
JOINT = f"WITH {FIRST} SELECT sire, dam, locus, (4 * a + b)::INT AS ab, round(v, 6) AS p FROM j"
MARGINALS = f"""WITH {FIRST}, x AS (SELECT j.sire, j.dam, j.locus, j.a AS k, sum(j.v * ({MIX4.format(x='d.v')})) AS v FROM j JOIN pd d ON d.sire = j.sire AND d.dam = j.dam AND d.locus = j.locus AND d.k = j.b GROUP BY ALL),
y AS (SELECT j.sire, j.dam, j.locus, j.b AS k, sum(j.v * ({MIX4.format(x='s.v')})) AS w FROM j JOIN ps s ON s.sire = j.sire AND s.dam = j.dam AND s.locus = j.locus AND s.k = j.a GROUP BY ALL),
z AS (SELECT * FROM x JOIN y USING (sire, dam, locus, k)) SELECT sire, dam, locus, {", ".join(f"round(max(v) FILTER (k = {i}), 6) AS x{i}, round(max(w) FILTER (k = {i}), 6) AS y{i}" for i in S_)} FROM z GROUP BY sire, dam, locus"""
TENSOR = f"WITH {_seg(2)}, {TENSOR_} SELECT id, seg, (16 * a + 4 * b + t.k)::INT AS abk, round(sum(w * v), 6) AS p FROM ten t JOIN seg ON seg.k = t.d GROUP BY id, seg, a, b, t.k"
KID = f"""{BOTH}, {TENSOR_}, sraw AS (SELECT id, s AS seg, k, ((id + s * (k + 1)) % 4 + 1)::DOUBLE AS v FROM ped, unnest(range(1, 8)) t(s), k4), seg AS MATERIALIZED (SELECT id, seg, k, v / sum(v) OVER (PARTITION BY id, seg) AS v FROM sraw),
vv AS MATERIALIZED (SELECT id, locus, k, {MIX4.format(x='v')} AS v FROM pen WHERE id IN (SELECT id FROM ped WHERE NOT is_founder)),
sk AS MATERIALIZED (SELECT id, seg::INT AS locus, a, b, t.k, sum(w * v) AS v FROM seg JOIN ten t ON t.d = seg.k WHERE id IN (SELECT id FROM ped WHERE NOT is_founder) GROUP BY ALL)"""
TO_PARENTS = f"WITH {KID} SELECT id AS child, locus, (4 * a + b)::INT AS ab, round(sum(sk.v * vv.v), 6) AS p FROM sk JOIN vv USING (id, locus, k) GROUP BY id, locus, a, b"
TO_CHILD = f"WITH {KID}, x AS (SELECT id AS child, locus, k, sum(v * (4 * a + b + 1) / 136.0::DOUBLE) AS v FROM sk GROUP BY ALL) {wide('x', 'child, locus', 'a')}"
POINT = f"""WITH {KID}, nt AS (SELECT a, b, k, sum(w) / 4 AS n FROM ten GROUP BY ALL),
x AS (SELECT vv.id AS child, locus, t.d AS k, sum(w * (4 * a + b + 1) / 136.0::DOUBLE * vv.v / n) AS v FROM vv JOIN ten t ON t.k = vv.k JOIN nt USING (a, b) WHERE nt.k = t.k GROUP BY ALL) {wide('x', 'child, locus', 'e')}"""
POINT_PLAIN = f"""WITH {KID}, x AS (SELECT vv.id AS child, locus, t.d AS k, sum(w * (4 * a + b + 1) / 136.0::DOUBLE * vv.v) AS v FROM vv JOIN ten t ON t.k = vv.k GROUP BY ALL) {wide('x', 'child, locus', 'e')}"""
PARENTS = f"WITH {WITH} SELECT sire AS parent, gen FROM ped WHERE sire IS NOT NULL UNION SELECT dam, gen FROM ped WHERE dam IS NOT NULL"
DOUBLED = f"WITH {WITH} SELECT id, locus, CASE g WHEN 1 THEN 2 ELSE g END AS g FROM cells"
ONLY = f"WITH {WITH} SELECT 'i' || id AS id, row_number() OVER (ORDER BY id) AS place FROM ped WHERE id % 3 = 1"
MSG = f"""{WITH}, {K}, {FAM}, m AS (SELECT sire, dam, role, CASE role WHEN 'sire' THEN sire ELSE dam END AS parent, locus, k, ((sire + 2 * dam + locus * (k + 1)) % 7 + 1)::DOUBLE / 10 AS n
  FROM fam, (VALUES ('sire'), ('dam')) r(role), (SELECT DISTINCT locus FROM cells) l, k4)"""
LEAVE = f"""WITH {MSG}, x AS (SELECT *, product(n) OVER (PARTITION BY parent, role, locus, k) / n AS w FROM m), y AS (SELECT *, w / sum(w) OVER (PARTITION BY sire, dam, role, locus) AS v FROM x) {wide('y', 'sire, dam, role, locus', 'm')}"""
POSTERIOR = f"""WITH {MSG}, x AS (SELECT parent AS id, locus, k, product(n) AS w FROM m GROUP BY ALL), y AS (SELECT *, w / sum(w) OVER (PARTITION BY id, locus) AS v FROM x) {wide('y', 'id, locus', 'q')}"""
EXPNORM = f"""WITH {WITH}, {K}, x AS (SELECT id, locus, k, ref * -300.0 * k + alt * 7.0 AS v FROM cells, k4), y AS (SELECT *, exp(v - max(v) OVER (PARTITION BY id, locus)) AS e FROM x), z AS (SELECT *, e / sum(e) OVER (PARTITION BY id, locus) AS w FROM y) {wide('z', 'id, locus', 'e', 'w')}"""
HALDANE = f"""WITH {WITH}, x AS (SELECT id, (id % 48 + 1) / 100.0::DOUBLE AS p FROM ped)
SELECT id, round(-ln(1 - 2 * p) / 2, 6) AS distance, round(1 + p * log2(p) + (1 - p) * log2(1 - p), 6) AS information FROM x"""


class Chain:
    """Full peeling steps as materialised common tables."""

    def __init__(self):
        self.parts, self.n, self.ant, self.post, self.msg = [], 0, "ant0", "post0", "msg0"

    def _kids(self, t: str, g: int) -> None:
        self.parts += [
            _pair("sire", self.ant, self.msg, f"ps{t}", f"f.gen = {g}"),
            _pair("dam", self.ant, self.msg, f"pd{t}", f"f.gen = {g}"),
            f"v{t} AS MATERIALIZED (SELECT i.sire, i.dam, i.id, p.locus, p.k, {MIX4.format(x='q.v * p.v / sum(q.v * p.v) OVER (PARTITION BY p.id, p.locus)')} AS v FROM ped i JOIN pen p ON p.id = i.id JOIN {self.post} q ON q.id = p.id AND q.locus = p.locus AND q.k = p.k WHERE i.gen = {g})",
            f"c{t} AS MATERIALIZED (SELECT sire, dam, id, locus, a, b, ln(sum(s.w * v)) AS v FROM v{t} v JOIN flat s ON s.k = v.k GROUP BY ALL)",
            f"l{t} AS MATERIALIZED (SELECT sire, dam, locus, a, b, sum(v) AS v FROM c{t} GROUP BY ALL)",
        ]

    def down(self, g: int) -> str:
        self.n += 1
        t = str(self.n)
        self._kids(t, g)
        self.parts += [
            _joint(f"ps{t}", f"pd{t}", f"j{t}"),
            f"r{t} AS MATERIALIZED (SELECT c.sire, c.dam, c.id, c.locus, c.a, c.b, ln(j.v) + l.v - c.v AS v FROM c{t} c JOIN l{t} l USING (sire, dam, locus, a, b) JOIN j{t} j USING (sire, dam, locus, a, b))",
            f"e{t} AS MATERIALIZED (SELECT *, exp(v - max(v) OVER (PARTITION BY id, locus)) AS e FROM r{t})",
            f"a{t} AS MATERIALIZED (SELECT id, locus, s.k, sum(e * s.w) AS v FROM e{t} JOIN flat s USING (a, b) GROUP BY id, locus, s.k)",
            f"new{t} AS MATERIALIZED (SELECT id, locus, k, v / sum(v) OVER (PARTITION BY id, locus) AS v FROM a{t})",
            f"ant{t} AS MATERIALIZED (SELECT id, locus, k, coalesce(n.v, o.v) AS v FROM {self.ant} o LEFT JOIN new{t} n USING (id, locus, k))",
        ]
        self.ant = f"ant{t}"
        return f"new{t}"

    def up(self, g: int) -> str:
        self.n += 1
        t = str(self.n)
        self._kids(t, g)
        part = "PARTITION BY sire, dam, locus"
        self.parts += [
            f"f{t} AS MATERIALIZED (SELECT sire, dam, locus, a, b, exp(v - max(v) OVER ({part})) AS v FROM l{t})",
            f"u{t} AS MATERIALIZED (SELECT 'sire' AS role, f.sire, f.dam, f.locus, f.a AS k, sum(f.v * ({MIX4.format(x='d.v')})) AS v FROM f{t} f JOIN pd{t} d ON d.sire = f.sire AND d.dam = f.dam AND d.locus = f.locus AND d.k = f.b GROUP BY ALL UNION ALL SELECT 'dam', f.sire, f.dam, f.locus, f.b, sum(f.v * ({MIX4.format(x='s.v')})) FROM f{t} f JOIN ps{t} s ON s.sire = f.sire AND s.dam = f.dam AND s.locus = f.locus AND s.k = f.a GROUP BY ALL)",
            f"w{t} AS MATERIALIZED (SELECT role, sire, dam, locus, k, {MIX4.format(x='v / sum(v) OVER (PARTITION BY role, sire, dam, locus)')} AS n FROM u{t})",
            f"n{t} AS MATERIALIZED (SELECT m.sire, m.dam, m.role, m.locus, m.k, m.v, coalesce(w.n, m.n) AS n, CASE m.role WHEN 'sire' THEN m.sire ELSE m.dam END AS parent FROM {self.msg} m LEFT JOIN w{t} w USING (sire, dam, role, locus, k))",
            f"touched{t} AS MATERIALIZED (SELECT unnest([sire, dam]) AS parent FROM fam WHERE gen = {g})",
            f"o{t} AS MATERIALIZED (SELECT *, exp(sum(ln(n)) OVER (PARTITION BY parent, role, locus, k) - ln(n)) AS raw FROM n{t} WHERE parent IN (SELECT parent FROM touched{t}))",
            f"msg{t} AS MATERIALIZED (SELECT sire, dam, role, locus, k, raw / sum(raw) OVER (PARTITION BY sire, dam, role, locus) AS v, n FROM o{t} UNION ALL SELECT sire, dam, role, locus, k, v, n FROM n{t} WHERE parent NOT IN (SELECT parent FROM touched{t}))",
            f"z{t} AS MATERIALIZED (SELECT parent AS id, locus, k, exp(sum(ln(n))) AS v FROM o{t} GROUP BY ALL)",
            f"post{t} AS MATERIALIZED (SELECT id, locus, k, coalesce(z.v / sum(z.v) OVER (PARTITION BY id, locus), o.v) AS v FROM {self.post} o LEFT JOIN z{t} z USING (id, locus, k))",
        ]
        self.msg, self.post = f"msg{t}", f"post{t}"
        return f"w{t}"


class Linked(Chain):
    """The same with inheritance that children's loci share: vectors by individual and
    locus (table seg0 at first), found anew with every step down."""

    def __init__(self):
        super().__init__()
        self.seg = "seg0"

    def _kids(self, t: str, g: int) -> None:
        super()._kids(t, g)
        self.parts[-2] = f"c{t} AS MATERIALIZED (SELECT sire, dam, id, locus, a, b, ln(sum(s.w * v)) AS v FROM v{t} v JOIN sk{t} s USING (id, locus, k) GROUP BY ALL)"
        self.parts.insert(-2, f"sk{t} AS MATERIALIZED (SELECT q.id, q.locus, t.a, t.b, t.k, sum(t.w * q.v) AS w FROM {self.seg} q JOIN ten t ON t.d = q.k WHERE q.id IN (SELECT id FROM ped WHERE gen = {g}) GROUP BY ALL)")

    def down(self, g: int) -> str:
        got = super().down(g)
        t = str(self.n)
        i = next(i for i, x in enumerate(self.parts) if x.startswith(f"a{t} AS"))
        self.parts[i] = f"a{t} AS MATERIALIZED (SELECT id, locus, s.k, sum(e * s.w) AS v FROM e{t} JOIN sk{t} s USING (id, locus, a, b) GROUP BY id, locus, s.k)"
        self.parts.append(f"pt{t} AS MATERIALIZED (SELECT e.id, e.locus, t.d AS k, sum(t.w / n.w * e.e * v.v) AS v FROM e{t} e JOIN ten t USING (a, b) JOIN flat n ON n.a = t.a AND n.b = t.b AND n.k = t.k JOIN v{t} v ON v.id = e.id AND v.locus = e.locus AND v.k = t.k GROUP BY ALL)")
        for name, order in ((f"fw{t}_", range(1, 8)), (f"bw{t}_", range(7, 0, -1))):
            order = list(order)
            self.parts.append(f"{name}{order[0]} AS MATERIALIZED (SELECT id, k, 0.25::DOUBLE AS v FROM pt{t} WHERE locus = {order[0]})")
            for before, at in zip(order, order[1:]):
                self.parts.append(f"""{name}{at} AS MATERIALIZED (SELECT q.id, k4.k, sum(q.v * {_move('k4.k', 'q.k')}) AS v
  FROM (SELECT m.id, m.k, m.v * e.v / sum(m.v * e.v) OVER (PARTITION BY m.id) AS v FROM {name}{before} m JOIN pt{t} e ON e.id = m.id AND e.k = m.k AND e.locus = {before}) q, k4,
       (SELECT rate AS r FROM rate WHERE locus = {min(before, at)}) GROUP BY q.id, k4.k)""")
        both = " UNION ALL ".join(f"SELECT e.id, e.locus, e.k, e.v * f.v * b.v AS v FROM pt{t} e JOIN fw{t}_{i} f ON f.id = e.id AND f.k = e.k JOIN bw{t}_{i} b ON b.id = e.id AND b.k = e.k WHERE e.locus = {i}" for i in range(1, 8))
        self.parts += [
            f"sm{t} AS MATERIALIZED (SELECT id, locus, k, {MIX4.format(x='v / sum(v) OVER (PARTITION BY id, locus)')} AS v FROM ({both}))",
            f"sg{t} AS MATERIALIZED (SELECT id, locus, k, coalesce(n.v, o.v) AS v FROM {self.seg} o LEFT JOIN sm{t} n USING (id, locus, k))",
        ]
        self.seg = f"sg{t}"
        return got


_FLAT = "flat AS MATERIALIZED (SELECT a, b, k, sum(w) / 4 AS w FROM ten GROUP BY a, b, k)"
_HEAD = f"{BOTH}, {FAM}, {TENSOR_}, {_FLAT}, {START}"


def _one(kind: str, g: int, tail: str) -> str:
    c = Chain()
    got = getattr(c, kind)(g)
    return f"WITH {_HEAD}, {', '.join(c.parts)} {tail.replace('GOT', got)}"


DOWN = _one("down", 1, wide("(SELECT id AS child, locus, k, v FROM GOT)", "child, locus", "a"))
UP = _one("up", 4, wide("GOT", "sire, dam, role, locus", "n", "n"))


def _cycles(n: int) -> str:
    c = Chain()
    for _ in range(n):
        for g in range(1, 5):
            c.down(g)
        for g in range(4, 0, -1):
            c.up(g)
    return f"""WITH {_HEAD}, {', '.join(c.parts)}, fin AS (SELECT id, locus, k, p.v * a.v * q.v / sum(p.v * a.v * q.v) OVER (PARTITION BY id, locus) AS v
  FROM pen p JOIN {c.ant} a USING (id, locus, k) JOIN {c.post} q USING (id, locus, k))
SELECT id, locus, round(sum(v * CASE k WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END), 6) AS dosage FROM fin GROUP BY id, locus"""


CYCLE, CYCLES = _cycles(1), _cycles(2)
_LINKED = f"{_HEAD}, {RATE}, seg0 AS MATERIALIZED (SELECT * FROM ant0)"


def _vectors(tables: dict[str, str]) -> str:
    """One row an individual and locus, columns a0 and so on of each table."""
    some = [f"SELECT id, locus, '{p}' AS p, k, v FROM {t}" for p, t in tables.items()]
    got = ", ".join(f"round(max(v) FILTER (p = '{p}' AND k = {i}), 6) AS {p}{i}" for p in tables for i in S_)
    return f"SELECT id, locus, {got} FROM ({' UNION ALL '.join(some)}) GROUP BY id, locus"


def _linked_down() -> str:
    c = Linked()
    got = c.down(1)
    return f"WITH {_LINKED}, {', '.join(c.parts)} SELECT id AS child, * EXCLUDE (id) FROM ({_vectors({'a': got, 's': f'sm{c.n}'})})"


def _linked_cycle() -> str:
    c = Linked()
    for g in range(1, 5):
        c.down(g)
    for g in range(4, 0, -1):
        c.up(g)
    return f"WITH {_LINKED}, {', '.join(c.parts)} {_vectors({'a': c.ant, 'q': c.post, 's': c.seg})}"


MULTI_DOWN, MULTI_CYCLE = _linked_down(), _linked_cycle()
_X = """SELECT kind, a::INT AS a, b::INT AS b, k::INT AS k, d::INT AS d, round((CASE kind
  WHEN 'autosome' THEN CASE WHEN CASE WHEN d < 2 THEN a // 2 ELSE a % 2 END = k // 2 AND m THEN 1 ELSE 0 END
  WHEN 'xx' THEN CASE WHEN a % 2 = k // 2 AND m THEN 1 ELSE 0 END ELSE CASE WHEN m THEN 0.5 ELSE 0 END END)::DOUBLE * (1 - 1e-8::DOUBLE) + 1e-8::DOUBLE / 4, 9) AS w
FROM (SELECT *, CASE WHEN d % 2 = 0 THEN b // 2 ELSE b % 2 END = k % 2 AS m FROM (VALUES ('autosome'), ('xx'), ('xy')) x(kind), unnest(range(4)) q(a), unnest(range(4)) r(b), unnest(range(4)) s(k), unnest(range(4)) t(d))"""
X_TENSOR = _X

# ------------------------------------------------------------ estimators


def _newton(rounds: int) -> str:
    parts = [f"it0 AS MATERIALIZED (SELECT mf, locus, least(greatest(p, 0.01), 0.99) AS p, false AS still FROM freq)"]
    for i in range(rounds):
        parts.append(f"""it{i + 1} AS MATERIALIZED (SELECT mf, locus, CASE WHEN still THEN p ELSE q END AS p, still OR abs(q - p) < 1e-4 AS still FROM (
  SELECT t.mf, t.locus, t.p, t.still, least(greatest(t.p + CASE WHEN sum(f1 / f) = 0 OR sum(f2 / f - (f1 / f) ^ 2) = 0 THEN 0 ELSE -sum(f1 / f) / sum(f2 / f - (f1 / f) ^ 2) END, 0.01), 0.99) AS q
  FROM (SELECT t.mf, t.locus, t.p, t.still, d0 * (1 - p) ^ 2 + d1 * p * (1 - p) + d3 * p ^ 2 AS f, (d1 - 2 * d0) + 2 * p * (d0 + d3 - d1) AS f1, 2 * (d0 + d3 - d1) AS f2
        FROM it{i} t JOIN ev USING (locus)) t GROUP BY t.mf, t.locus, t.p, t.still))""")
    return ", ".join(parts)


NEWTON = f"""WITH {BOTH}, {FREQ}, ev AS MATERIALIZED (
  SELECT pen.locus, max(v) FILTER (k = 0) AS d0, sum(v) FILTER (k IN (1, 2)) AS d1, max(v) FILTER (k = 3) AS d3
  FROM pen JOIN cells c ON c.id = pen.id AND c.locus = pen.locus WHERE g <> 9 OR ref <> 0 OR alt <> 0 GROUP BY pen.id, pen.locus
  UNION ALL SELECT locus, d0, d1, d3 FROM (SELECT DISTINCT locus FROM cells), (VALUES (1.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE), (0, 1, 0), (0, 1, 0), (0, 0, 1)) q(d0, d1, d3)),
{_newton(6)} SELECT mf, locus, round(p, 5) AS p FROM it6"""
FOUNDER_MEAN = f"""WITH {PROB_} SELECT mf, locus, round(least(greatest(sum(v * CASE k WHEN 0 THEN 0 WHEN 3 THEN 1 ELSE 0.5 END) / count(DISTINCT pen.id), 0.01), 0.99), 6) AS p
FROM pen JOIN ped ON ped.id = pen.id WHERE is_founder GROUP BY mf, locus"""
GENO_ERR = f"""gerr AS (SELECT c.locus, least(greatest((1e-4 + coalesce(sum(CASE g WHEN 0 THEN CASE WHEN k <> 0 THEN v ELSE 0 END WHEN 1 THEN CASE WHEN k IN (0, 3) THEN v ELSE 0 END WHEN 2 THEN CASE WHEN k <> 3 THEN v ELSE 0 END END), 0))
  / (1 + count(*) FILTER (g <> 9) / 4), 1e-4), 0.05) AS ge FROM cells c JOIN pen ON pen.id = c.id AND pen.locus = c.locus GROUP BY c.locus)"""
GENO_ERROR = f"WITH {READ}, {GENO_ERR} SELECT locus, round(ge, 6) AS ge FROM gerr"
SEQ_ERROR = f"""WITH {GENO} SELECT c.locus, round(least(greatest((1e-3 + sum(CASE k WHEN 0 THEN v * alt WHEN 3 THEN v * ref ELSE 0 END)) / (1 + sum(CASE WHEN k IN (0, 3) THEN v * (ref + alt) ELSE 0 END)), 1e-4), 0.01), 6) AS se
FROM cells c JOIN pen ON pen.id = c.id AND pen.locus = c.locus GROUP BY c.locus"""
PHENO_EM = f"""WITH {READ}, x AS (SELECT k AS state, pheno, sum(v) AS n FROM pen JOIN ped ON ped.id = pen.id GROUP BY ALL)
SELECT s.k AS state, p.pheno, round(coalesce(n, 0) / sum(coalesce(n, 0)) OVER (PARTITION BY s.k), 6) AS p FROM k4 s CROSS JOIN (SELECT unnest([0, 1])::INT AS pheno) p LEFT JOIN x ON x.state = s.k AND x.pheno = p.pheno"""
REBUILD = f"""WITH {READ}, {GENO_ERR}, again AS (SELECT id, cells.locus, k, ({_called('ge')}) * ({_reads('0.005::DOUBLE')}) AS v FROM cells JOIN gerr ON gerr.locus = cells.locus, k4),
x AS (SELECT id, locus, k, v / sum(v) OVER (PARTITION BY id, locus) AS v FROM again) {wide('x', 'id, locus', 'p')}"""
CMP = f"{READ}, cmp AS (SELECT c.id, c.locus, sum(v * CASE k WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END) AS est, any_value(g)::DOUBLE AS real FROM cells c JOIN pen ON pen.id = c.id AND pen.locus = c.locus WHERE g <> 9 GROUP BY c.id, c.locus)"
MARKER = f"WITH {CMP} SELECT locus, round(corr(est, real), 6) AS r FROM cmp GROUP BY locus HAVING r IS NOT NULL AND NOT isnan(r)"
REPORT = MARKER + " ORDER BY r DESC"
INDIVIDUAL = f"WITH {CMP} SELECT id, round(corr(est, real), 4) AS r FROM cmp GROUP BY id HAVING count(DISTINCT real) > 1 AND count(DISTINCT round(est, 12)) > 1"
REALISED = f"""WITH {WITH}, x AS (SELECT locus, g AS real, CASE WHEN ref + alt = 0 THEN 9 ELSE alt % 3 END AS est FROM cells WHERE g <> 9)
SELECT locus, round(avg(real) / 2, 6) AS freq, round(avg(CASE WHEN est <> 9 THEN CASE WHEN est <> real THEN 1.0 ELSE 0.0 END END), 6) AS error FROM x GROUP BY locus"""
MISMATCH = f"WITH {WITH} SELECT count(*) FILTER (id % 10 NOT IN (1, 2) AND g <> alt % 3) AS n_wrong, count(*) FILTER (id % 10 IN (1, 2)) AS n_unmatched FROM cells"
DISTANCE = f"""WITH {_seg(1)}, p AS (SELECT id, seg, sum(v) FILTER (k >= 2) AS p FROM seg WHERE seg IN (1, 3, 4, 7) GROUP BY ALL),
i AS (SELECT *, 1 + p * log2(p) + (1 - p) * log2(1 - p) AS h, lead(p) OVER w AS q, lead(seg) OVER w AS nxt FROM p WINDOW w AS (PARTITION BY id ORDER BY seg)),
j AS (SELECT a.seg AS "left", a.nxt AS "right", a.h * b.h AS w, a.p * (1 - b.p) + (1 - a.p) * b.p AS x FROM i a JOIN i b ON b.id = a.id AND b.seg = a.nxt)
SELECT "left"::INT AS "left", "right"::INT AS "right", CASE WHEN sum(w * x) / sum(w) < 0.5 THEN round(-ln(1 - 2 * sum(w * x) / sum(w)) / 2, 6) END AS distance FROM j GROUP BY 1, 2"""
