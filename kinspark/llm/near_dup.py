"""Near-duplicates: circulant MinHash, banding, exact Jaccard verification.

A document's set holds the hashes of its distinct word shingles. Equal sets become
one node. Two permutations make all signature coordinates: the first scatters the
set over a circle of CIRCLE places, the second, shifted by k, gives coordinate k.
Nodes that agree on all rows of a band share a bucket.

Pairs are verified on full sets, never all pairs of a bucket: first every member
against its bucket's center. Of buckets that still hold several components, each
member has a hub, the center with the most company. Two members with one hub can be
similar, without both being similar to the hub, only if they share one of the rarer
shingles in which they differ from it (_shared_differences); those meet by an
equi-join, so members that differ from their hub in ways of their own cost nothing.
Two members with different hubs meet in their buckets: those outside the largest
component against all others in other components. Pairs inside one component need
no test, so no link that could join components is left out and no bucket is cut
short.

Ahead of verification a pair's sizes and sketches are compared: two bits of each
of the 240 coordinates. A pair at the least similarity has 432 equal bits of 480 on
average, with a deviate of 7.9; pairs with fewer than AGREE are dropped, which a
linked pair meets with probability 2e-8.

Recall: a pair at the least similarity is missed with probability
(1 - 0.8^ROWS)^BANDS = 5e-6.

Defined results: null, blank and wordless texts have empty sets, linked with
nothing; texts with fewer words than a shingle have one shingle, the whole; equal
doc_ids are one id; a null doc_id never names a component unless all are null;
extra columns are ignored here; an empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinspark.llm import text as T
from kinspark.llm.components import components
from kinspark.llm.sizes import small
from kinspark.llm.workers import tidy
from kinspark.session import cut

ROWS, BANDS, CIRCLE, SEED = 6, 40, 1 << 21, 20_011
LEAST = 80  # per cent
AGREE = 388  # of the 2 * ROWS * BANDS sketch bits


def shingle_set(text: Column, k: int) -> tuple[dict[str, Column], ...]:
    """Successive projections that end in column set, an array of distinct hashes."""
    n = "size(__w)"
    window = ", ".join(f"__w[i + {j}]" for j in range(k))
    return (
        {"__w": T.words(T.ascii_lower(text))},
        {"set": F.expr(f"if({n} = 0, cast(array() as array<bigint>), if({n} < {k}, array(xxhash64(array_join(__w, ' '))), array_distinct(transform(sequence(0, {n} - {k}), i -> xxhash64({window})))))")},
    )


def with_sets(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, fp (hash of the text), set, node (hash of the sorted set)."""
    x = docs.select("doc_id", "text", F.xxhash64("text").alias("fp"))
    for step in shingle_set(F.col("text"), k):
        x = x.withColumns(step)
    x = x.select("doc_id", "fp", F.sort_array("set").alias("set"))
    return x.select("doc_id", "fp", "set", F.xxhash64("set").alias("node"))


def _circle(seed: int) -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(seed)
    scatter = draw.permutation(CIRCLE).astype(np.int32)
    second = draw.permutation(CIRCLE).astype(np.int32)
    wide = np.concatenate([second, second[: ROWS * BANDS]])
    return scatter, np.lib.stride_tricks.sliding_window_view(wide, ROWS * BANDS)


def signature(places: np.ndarray, view: np.ndarray) -> np.ndarray:
    """All coordinates of one set: minima over its places of the shifted second permutation."""
    out = view[places[:4096]].min(axis=0)
    for a in range(4096, len(places), 4096):
        np.minimum(out, view[places[a : a + 4096]].min(axis=0), out=out)
    return out


def _sign(batches):
    scatter, view = _circle(SEED)
    mix = np.random.default_rng(SEED + 1).integers(1, 2**63, (BANDS, ROWS), dtype=np.uint64) | np.uint64(1)
    for b in batches:
        sets = b.column("set")
        flat = scatter[sets.values.to_numpy() & (CIRCLE - 1)]
        at = sets.offsets.to_numpy()
        size = np.diff(at)
        keys = np.zeros((len(size), BANDS), np.uint64)
        bits = np.zeros((len(size), 64), np.uint8)
        for i in np.flatnonzero(size):
            sig = signature(flat[at[i] : at[i + 1]], view)
            keys[i] = ((sig.reshape(BANDS, ROWS).astype(np.uint64) + np.uint64(1)) * mix).sum(axis=1, dtype=np.uint64)
            two = (sig.astype(np.uint32) * np.uint32(2654435761) >> np.uint32(13)).astype(np.uint8) & 3
            bits[i, :60] = np.packbits(np.concatenate([two & 1, two >> 1]))
        keys ^= keys >> np.uint64(29)
        keys *= np.uint64(0x9E3779B97F4A7C15)
        lists = pa.FixedSizeListArray.from_arrays(pa.array(keys.view(np.int64).ravel()), BANDS).cast(pa.list_(pa.int64()))
        sketch = pa.FixedSizeListArray.from_arrays(pa.array(bits.view(np.int64).ravel()), 8).cast(pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("fp"), b.column("node"), pa.array(size.astype(np.int64)), lists, sketch], names=["doc_id", "fp", "node", "n_shingles", "keys", "sketch"])


def signed(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, fp, node, n_shingles, keys (one per band), sketch, in the shared folder."""
    sets = with_sets(docs, k)
    kind = dict(sets.dtypes)["doc_id"]
    return cut(sets.mapInArrow(tidy(_sign), f"doc_id {kind}, fp bigint, node bigint, n_shingles bigint, keys array<bigint>, sketch array<bigint>"))


def _sets_of(nodes: DataFrame, docs: DataFrame, base: DataFrame, k: int) -> DataFrame:
    """node, set: one document of each node is read again for its set."""
    some = cut(base.join(small(nodes), "node").groupBy("node").agg(F.min("doc_id").alias("id")).select("id").distinct())
    read = docs.select("doc_id", "text").join(small(some), F.col("doc_id").eqNullSafe(F.col("id")), "left_semi")
    return cut(with_sets(read, k).join(small(nodes), "node", "left_semi").groupBy("node").agg(F.first("set").alias("set")))


def _both(pairs: DataFrame, docs: DataFrame, base: DataFrame, k: int) -> DataFrame:
    """pairs (u, v) with their full sets a and b."""
    nodes = cut(pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct())
    sets = _sets_of(nodes, docs, base, k)
    x = pairs.join(sets.select(F.col("node").alias("u"), F.col("set").alias("a")), "u")
    return x.join(sets.select(F.col("node").alias("v"), F.col("set").alias("b")), "v")


def _verify(pairs: DataFrame, docs: DataFrame, base: DataFrame, k: int, least: int) -> DataFrame:
    """Those pairs (u, v) whose sets are similar enough."""
    x = _both(pairs, docs, base, k)
    x = x.select("u", "v", F.size("a").alias("na"), F.size("b").alias("nb"), F.size(F.array_intersect("a", "b")).alias("both"))
    return T.fence(x, ["both"]).where(100 * F.col("both") >= least * (F.col("na") + F.col("nb") - F.col("both"))).select("u", "v")


def _shared_differences(members: DataFrame, docs: DataFrame, base: DataFrame, k: int, least: int) -> DataFrame:
    """Pairs (x, y) with one hub that may be similar though not both are similar to it.

    members: hub, node, root, n. D(z) are the shingles that only one of z and the hub
    has, plus of them z's and minus the hub's. With s of D(x) and D(y) in common, x and
    y are similar if and only if (100 + least) s >= w(x) + w(y) - (100 - least) |hub|,
    where w(z) = least * plus + 100 * minus; and z is similar to the hub if and only if
    w(z) <= (100 - least) |hub|. So a member that isn't (a far one) shares with any
    partner y more than w(y) / (100 + least) of D(y): one of y's rarest that remain
    when so many are left out is among them. Those rarest are joined to the far ones'
    differences, of which the commonest are left out by the same bound. Both lists are
    in the same order, so a pair's first common shingle tells how many may follow."""
    x = _both(members.where("node <> hub").select(F.col("hub").alias("u"), F.col("node").alias("v"), "root", "n"), docs, base, k)
    x = x.select("u", "v", "root", "n", F.size("a").alias("core"), F.array_except("b", "a").alias("plus"), F.array_except("a", "b").alias("minus"))
    x = x.withColumn("w", (least * F.size("plus") + 100 * F.size("minus")).cast("long")).withColumn("over", F.col("w") - (100 - least) * F.col("core"))
    diffs = cut(x.select("u", "v", "root", "n", "w", "over", F.concat("plus", F.transform("minus", lambda t: F.bitwise_not(t))).alias("d")))
    each = diffs.select("u", "v", F.explode("d").alias("t"))
    common = each.groupBy("u", "t").agg(F.count("*").alias("c"))
    ranked = each.join(common, ["u", "t"]).groupBy("u", "v").agg(F.sort_array(F.collect_list(F.struct("c", "t"))).alias("d"))
    ranked = cut(ranked.join(diffs.drop("d"), ["u", "v"]))
    full = 100 + least
    own = F.size("d") - F.floor(F.col("w") / full)
    far = F.size("d") - F.greatest(F.lit(1), F.ceil(F.col("over") / full)) + 1
    rare = lambda y, n: y.where(n > 0).select("u", "v", "root", "n", "w", "over", F.size("d").alias("size"), F.posexplode(F.slice("d", F.lit(1), n.cast("int"))["t"]).alias("at", "t"))
    side = lambda y, n, s: rare(y, n).select("u", "t", F.col("v").alias(s), F.col("root").alias(f"r{s}"), F.col("n").alias(f"n{s}"), F.col("w").alias(f"w{s}"), F.col("over").alias(f"o{s}"), (F.col("size") - F.col("at")).alias(f"rest{s}"))
    left, right = side(ranked.where("over > 0"), far, "x"), side(ranked, own, "y")
    # From its first common shingle on, no pair has more in common than the shorter rest.
    apart = F.expr(f"rx <> ry and 100 * least(nx, ny) >= {least} * greatest(nx, ny) and {full} * least(restx, resty) >= wx + oy")
    return left.join(right, (left["u"] == right["u"]) & (left["t"] == right["t"]) & apart).select(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v")).distinct()


def classes(docs: DataFrame, k: int = 5, least: int = LEAST) -> DataFrame:
    """doc_id, fp, node, n_shingles, root: root names the component (null for empty sets)."""
    base = signed(docs, k)
    nodes = base.where("n_shingles > 0").groupBy("node").agg(F.first("keys").alias("keys"))
    rows = nodes.select("node", F.posexplode("keys").alias("band", "key")).select("node", F.xxhash64("band", "key").alias("key"))
    buckets = cut(rows.groupBy("key").agg(F.count("*").alias("c")).where("c > 1"))
    rows = cut(rows.join(buckets, "key"))
    info = base.join(small(cut(rows.select("node").distinct())), "node").groupBy("node").agg(F.first("n_shingles").alias("n"), F.first("sketch").alias("sk"))
    # The center of a bucket is its member with the most company over all its buckets:
    # of a group of copies, the text that the others were made from.
    company = rows.groupBy("node").agg(F.sum("c").alias("company"))
    rows = cut(rows.drop("c").join(company.join(info, "node"), "node"))
    centers = rows.groupBy("key").agg(F.max_by(F.struct("node", "n", "sk", "company"), F.struct("company", "node")).alias("m"))
    centers = centers.select("key", F.col("m.node").alias("u"), F.col("m.n").alias("n_u"), F.col("m.sk").alias("sk_u"), F.col("m.company").alias("rank"))
    star = rows.select("key", F.col("node").alias("v"), F.col("n").alias("n_v"), F.col("sk").alias("sk_v")).join(centers, (rows["key"] == centers["key"]) & F.expr("u <> v") & _likely(least))
    pairs = cut(star.select("u", "v").distinct())
    edges = cut(_verify(pairs, docs, base, k, least))
    roots = components(edges)
    # Buckets that still hold several components.
    known = rows.select("key", "node", "n", "sk").join(roots.withColumnRenamed("u", "node"), "node", "left").select("key", "node", "n", "sk", F.coalesce("root", "node").alias("root"))
    parts = known.groupBy("key", "root").agg(F.count("*").alias("c"))
    split = parts.groupBy("key").agg(F.max_by("root", F.struct("c", "root")).alias("main"), F.count("*").alias("parts")).where("parts > 1").select("key", "main")
    open_ = cut(known.join(split, "key"))
    # Each node's hub: of its open buckets' centers the one with the most company.
    hubs = open_.select("key", "node").join(centers.select("key", "u", "rank"), "key").groupBy("node").agg(F.max_by("u", F.struct("rank", "u")).alias("hub"))
    open_ = cut(open_.join(hubs, "node"))
    again = _shared_differences(open_.select("hub", "node", "root", "n").distinct(), docs, base, k, least)
    x, y = _named(info, "u"), _named(info, "v")
    again = again.join(x, "u").join(y, "v").where(_likely(least)).select("u", "v")
    # Pairs with two hubs meet in their buckets. Each pair of components on one side
    # only: the larger root beside the main one, or the smaller root first.
    left = open_.where("root <> main").select("key", *[F.col(c).alias(f"{c}_u") for c in ("n", "sk")], F.col("node").alias("x"), F.col("root").alias("rx"), F.col("hub").alias("hx"))
    right = open_.select("key", *[F.col(c).alias(f"{c}_v") for c in ("n", "sk")], F.col("node").alias("y"), F.col("root").alias("ry"), F.col("hub").alias("hy"), "main")
    apart = F.expr("hx <> hy and rx <> ry and (ry = main or rx < ry)")
    cross = left.join(right, (left["key"] == right["key"]) & apart & _likely(least))
    again = again.union(cross.select(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v"))).distinct()
    tested = pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
    again = cut(again.join(tested, ["u", "v"], "left_anti"))
    if not again.isEmpty():
        roots = components(edges.union(_verify(again, docs, base, k, least)))
    root = F.when(F.col("n_shingles") > 0, F.coalesce("root", "node"))
    return base.drop("keys", "sketch").join(roots.withColumnRenamed("u", "node"), "node", "left").select("doc_id", "fp", "node", "n_shingles", root.alias("root"))


def _named(info: DataFrame, side: str) -> DataFrame:
    return info.select(F.col("node").alias(side), F.col("n").alias(f"n_{side}"), F.col("sk").alias(f"sk_{side}"))


def _likely(least: int) -> Column:
    """Neither the sizes nor the sketches rule the similarity out."""
    sizes = 100 * F.least("n_u", "n_v") >= least * F.greatest("n_u", "n_v")
    apart = sum((F.bit_count(F.get("sk_u", F.lit(i)).bitwiseXOR(F.get("sk_v", F.lit(i)))) for i in range(8)), F.lit(0))
    return sizes & (apart <= 2 * ROWS * BANDS - AGREE)


def thin(docs: DataFrame, k: int = 5, least: int = LEAST) -> DataFrame:
    """One document of each class, that with the smallest id, and all documents
    without words; all columns as they are. Of repeated rows one stays."""
    x = cut(classes(docs, k, least).where("root is not null"))
    firsts = cut(x.groupBy("root").agg(F.min("doc_id").alias("first")))
    judged = x.join(firsts, "root").select("doc_id", "fp", "root", F.col("doc_id").eqNullSafe(F.col("first")).alias("stays"))
    key = [F.col("doc_id").alias("__d"), F.col("fp").alias("__f")]
    same = lambda: F.col("doc_id").eqNullSafe(F.col("__d")) & F.xxhash64("text").eqNullSafe(F.col("__f"))
    gone = cut(judged.where("not stays").select(*key).distinct())
    out = docs.join(small(gone), same(), "left_anti")
    again = judged.where("stays").groupBy("root").agg(F.count("*").alias("c"), F.min(F.struct("doc_id", "fp")).alias("m")).where("c > 1")
    again = cut(again.select("m.*").select(*key))
    if again.isEmpty():
        return out
    rows = cut(judged.where("stays").join(again, F.col("doc_id").eqNullSafe(F.col("__d")), "left_semi").select(*key).distinct())
    once = out.join(small(rows), same(), "left_semi").dropDuplicates(["doc_id"])
    return out.join(small(rows), same(), "left_anti").unionByName(once)


def report(docs: DataFrame, k: int = 5, least: int = LEAST) -> DataFrame:
    """One row per document: n_shingles, component_id, kept."""
    x = cut(classes(docs, k, least))
    names = cut(x.where("root is not null").groupBy("root").agg(F.min("doc_id").alias("component_id")))
    out = x.join(names, "root", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    return out.select("*", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


_W = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"
SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_W} AS w FROM documents),
g AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN w
             ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS g FROM w),
f AS (SELECT md5(array_to_string(list_sort(g), chr(10))) AS node, min(doc_id) AS least, any_value(g) AS g FROM g WHERE len(g) > 0 GROUP BY 1),
s AS (SELECT node, least, len(g) AS n, unnest(g) AS s FROM f),
c AS (SELECT s, count(*) AS c FROM s GROUP BY 1),
r AS (SELECT node, least, n, s, row_number() OVER (PARTITION BY node ORDER BY c, s) AS k FROM s JOIN c USING (s)),
p AS (SELECT DISTINCT a.least AS a, b.least AS b FROM r a JOIN r b ON a.s = b.s AND a.least < b.least
      WHERE a.k <= a.n - ceil(0.8 * a.n) + 1 AND b.k <= b.n - ceil(0.8 * b.n) + 1 AND 5 * least(a.n, b.n) >= 4 * greatest(a.n, b.n)),
e AS (SELECT p.a, p.b FROM p JOIN s x ON x.least = p.a JOIN s y ON y.least = p.b AND y.s = x.s
      GROUP BY p.a, p.b HAVING 100 * count(*) >= 80 * (any_value(x.n) + any_value(y.n) - count(*))),
b AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
t AS (SELECT least AS a, least AS b FROM f UNION SELECT t.a, b.b FROM t JOIN b ON t.b = b.a),
m AS (SELECT a, min(b) AS component FROM t GROUP BY 1)
SELECT g.doc_id, len(g.g)::BIGINT AS n_shingles, coalesce(component, g.doc_id) AS component_id,
       g.doc_id = coalesce(component, g.doc_id) AS kept
FROM g LEFT JOIN f ON f.node = md5(array_to_string(list_sort(g.g), chr(10))) AND len(g.g) > 0 LEFT JOIN m ON m.a = f.least
"""
