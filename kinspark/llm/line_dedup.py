"""Line dedup: maximal repeated runs of lines; later copies are deleted.

Lines become 64-bit ids. Only lines that occur at least twice can be part of a
repeat; consecutive ones form islands, the only strings the suffix structures are
built over. Prefix doubling names the blocks of 1, 2, 4, ... lines at every
position: a block's name is made from the names of its halves. Suffixes with the
same name of a length form an interval of the suffix array with that common
prefix. Descending through the doubled lengths, one round for each, every suffix
finds the longest prefix that it shares with an earlier suffix: the depth of the
deepest interval in which it isn't the first. Where that depth isn't just what is
left of the suffix before it, a maximal repeated run begins. Runs of at least
MIN_WORDS words are deleted, line by line, wherever they aren't the first copy.

Names come from content rather than from sorted ranks, so all lengths are named
inside one island without a shuffle; intervals are found by grouping names, with
minima pre-aggregated, so one line or run may hold a third of all rows.

The first copy is the one with the smallest (doc_id, text hash, line number).

Defined results: null texts have no lines and stay null; blank lines are lines
without words; repeated rows (same id, same text) are one document; ties cannot
occur; an empty table gives an empty table; texts of any length are taken whole; further columns are kept unless they
bear the name of an output. Line ids may collide: 3e-8 expected pairs in a
million lines, 0.03 in a thousand million.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kinspark.llm import text as T
from kinspark.llm.sizes import small
from kinspark.session import cut

MIN_WORDS = 50
ISLAND = ["doc", "fp", "start"]


def lines(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc, fp, ln (from 0), id, words of every line of every distinct document."""
    x = docs.select(F.col("doc_id").alias("doc"), F.xxhash64(text).alias("fp"), F.split(text, "\n", -1).alias("l"))
    x = x.select("doc", "fp", F.posexplode("l").alias("ln", "line"))
    return x.select("doc", "fp", "ln", F.xxhash64("line").alias("id"), F.regexp_count("line", F.lit(T.BLANK_WORD)).alias("words"))


def islands(every: DataFrame, min_words: int) -> DataFrame:
    """Runs of lines that occur twice or more, long enough to matter: doc, fp,
    start, ids, words (arrays)."""
    often = cut(every.groupBy("id").agg(F.count("*").alias("c")).where("c > 1").select("id"))
    live = every.join(small(often), "id", "left_semi").distinct()
    by_doc = Window.partitionBy("doc", "fp").orderBy("ln")
    live = live.withColumn("start", F.col("ln") - F.row_number().over(by_doc))
    rows = live.groupBy(*ISLAND).agg(F.sort_array(F.collect_list(F.struct("ln", "id", "words"))).alias("rows"), F.sum("words").alias("n"))
    rows = rows.where(F.col("n") >= min_words)
    return rows.select("doc", "fp", F.col("rows")[0]["ln"].alias("start"), F.transform("rows", lambda r: r["id"]).alias("ids"), F.transform("rows", lambda r: r["words"]).alias("words"))


def doubled(runs: DataFrame, levels: int) -> DataFrame:
    """Adds names: names[k][i] stands for the 2^k lines from i on."""
    out = runs.withColumn("names", F.array("ids"))
    for k in range(1, levels):
        half = 1 << (k - 1)
        step = f"if(size(ids) < {2 * half}, cast(array() as array<bigint>), transform(sequence(0, size(ids) - {2 * half}), i -> xxhash64({k}, element_at(names, -1)[i], element_at(names, -1)[i + {half}])))"
        out = out.withColumn("names", F.concat("names", F.array(F.expr(step))))
    return out


PROBE = "struct<i:int,cur:int,name:bigint,best:int>"


def _longest_earlier(runs: DataFrame, levels: int) -> DataFrame:
    """doc, fp, start, depth: for each suffix of an island, the number of lines it
    shares with the best earlier suffix. One round for each doubled length.

    A probe is a suffix in the interval of its first cur lines. Each round splits
    the intervals by the next 2^k lines: probes that aren't alone move into the
    deeper interval, whose first suffix also leaves a probe behind, to stand for
    all of them where shorter extensions are tried. An interval of depth cur has
    one such probe, so there are never more probes than suffixes and intervals."""
    state = None
    for k in reversed(range(levels)):
        size = 1 << k
        start = F.expr(f"transform(sequence(0, size(ids) - 1), i -> cast(struct(i, 0, 0L, 0) as {PROBE}))")
        fresh = runs.where(F.size("ids").between(size, 2 * size - 1)).select(*ISLAND, start.alias("probes"))
        state = fresh if state is None else state.union(fresh)
        blocks = runs.select(F.col("doc").alias("d"), F.col("fp").alias("f"), F.col("start").alias("s"), F.element_at("names", k + 1).alias("block"))
        here = state.join(blocks, _same_island())
        rows = here.select(*ISLAND, "block", F.explode("probes").alias("x")).select(*ISLAND, "x", F.get("block", F.col("x.i") + F.col("x.cur")).alias("block"))
        step = F.when(F.col("block").isNotNull(), F.xxhash64(F.lit(k), "x.name", "block"))
        rows = cut(rows.select(*ISLAND, "x", step.alias("next"), F.struct("doc", "fp", (F.col("start") + F.col("x.i")).alias("ln")).alias("at")))
        groups = rows.where("next is not null").groupBy("next").agg(F.min("at").alias("first"), F.count("*").alias("c")).where("c > 1").select("next", "first")
        met = rows.join(small(cut(groups)), "next", "left")
        deep = F.col("x.cur") + size
        best = F.when(F.col("first") == F.col("at"), F.col("x.best")).otherwise(F.greatest("x.best", deep))
        into = F.struct(F.col("x.i").alias("i"), deep.alias("cur"), F.col("next").alias("name"), best.alias("best"))
        after = F.when(F.col("first").isNull(), F.array("x")).when(F.col("first") == F.col("at"), F.array("x", into)).otherwise(F.array(into))
        moved = met.select(*ISLAND, F.explode(after.cast(f"array<{PROBE}>")).alias("x"))
        state = cut(moved.groupBy(*ISLAND).agg(F.collect_list("x").alias("probes")))
    best = state.select(*ISLAND, F.explode("probes").alias("x")).groupBy(*ISLAND, "x.i").agg(F.max("x.best").alias("best"))
    whole = best.groupBy(*ISLAND).agg(F.sort_array(F.collect_list(F.struct("i", "best"))).alias("r"))
    return whole.select(*ISLAND, F.transform("r", lambda r: r["best"]).alias("depth"))


def _same_island() -> Column:
    return F.col("doc").eqNullSafe(F.col("d")) & (F.col("fp") == F.col("f")) & (F.col("start") == F.col("s"))


def _summed(words: Column) -> Column:
    """Cumulative sums with a leading 0."""
    return T.running(F.concat(words, F.array(F.lit(0))))


def copies(docs: DataFrame, min_words: int = MIN_WORDS, text: str = "text") -> DataFrame:
    """doc, fp, gone: the line numbers to delete, for documents that have any."""
    every = cut(lines(docs, text))
    runs = cut(islands(every, min_words))
    most = runs.agg(F.max(F.size("ids"))).first()[0] or 0
    if not most:
        return every.select("doc", "fp", F.array("ln").alias("gone")).where("false")
    levels = most.bit_length()
    runs = cut(doubled(runs, levels))
    depth = _longest_earlier(runs, levels)
    depth = depth.select(F.col("doc").alias("d"), F.col("fp").alias("f"), F.col("start").alias("s"), "depth")
    x = runs.join(depth, _same_island())
    x = x.select(*ISLAND, "depth", _summed(F.col("words")).alias("upto"))
    maximal = F.expr("filter(sequence(0, size(depth) - 1), i -> depth[i] > 0 and (i = 0 or depth[i] >= get(depth, i - 1)))")
    x = x.select(*ISLAND, "depth", "upto", maximal.alias("at"))
    long = F.filter("at", lambda i: F.get("upto", i + F.get("depth", i)) - F.get("upto", i) >= min_words)
    gone = F.flatten(F.transform(long, lambda i: F.sequence(F.col("start") + i, F.col("start") + i + F.get("depth", i) - 1)))
    x = T.fence(x.select("doc", "fp", F.array_distinct(gone).alias("gone")), ["gone"]).where(F.size("gone") > 0)
    return x.groupBy("doc", "fp").agg(F.flatten(F.collect_list("gone")).alias("gone"))


def shorten(docs: DataFrame, min_words: int = MIN_WORDS, text: str = "text") -> DataFrame:
    """All columns of docs, later copies deleted from the text, and __lines and
    __deleted, their counts."""
    gone = cut(copies(docs, min_words, text).select(F.col("doc").alias("__doc"), F.col("fp").alias("__fp"), F.col("gone").alias("__gone")))
    x = docs.join(small(gone), F.col("doc_id").eqNullSafe(F.col("__doc")) & F.xxhash64(text).eqNullSafe(F.col("__fp")), "left")
    split = F.split(text, "\n", -1)
    keep = F.array_except(F.sequence(F.lit(0), F.size(split) - 1), "__gone")
    left = F.array_join(F.transform(keep, lambda i: F.get(split, i)), "\n")
    return x.select(
        *[F.when(F.col("__gone").isNull(), F.col(text)).otherwise(left).alias(text) if c == text else F.col(c) for c in docs.columns],
        F.coalesce(F.size(split), F.lit(0)).cast("long").alias("__lines"),
        F.coalesce(F.size("__gone"), F.lit(0)).cast("long").alias("__deleted"),
    )


def dedup(docs: DataFrame, min_words: int = MIN_WORDS, text: str = "text") -> DataFrame:
    """docs with later copies deleted from the text; adds n_lines and n_deleted."""
    x = shorten(docs.drop("n_lines", "n_deleted"), min_words, text)
    return x.withColumnsRenamed({"__lines": "n_lines", "__deleted": "n_deleted"})


def report(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """One row per document: line counts, and the digest and length of what stays."""
    x = dedup(docs.select("doc_id", "text"), min_words)
    return x.select("doc_id", "n_lines", "n_deleted", F.length(F.coalesce("text", F.lit(""))).cast("long").alias("chars_left"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("left_sha256"))


SQL = r"""
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents),
a AS (SELECT doc_id, ln - 1 AS ln, l[ln] AS line, len(regexp_extract_all(l[ln], '[^\x20\x09-\x0D]+')) AS words
      FROM d, unnest(range(1, len(l) + 1)) t(ln)),
p AS (SELECT y.doc_id, y.ln, y.words, x.doc_id AS other, y.ln - x.ln AS shift
      FROM a y JOIN a x ON x.line = y.line AND (x.doc_id < y.doc_id OR (x.doc_id = y.doc_id AND x.ln < y.ln))),
r AS (SELECT *, ln - row_number() OVER (PARTITION BY doc_id, other, shift ORDER BY ln) AS run FROM p),
s AS (SELECT *, sum(words) OVER (PARTITION BY doc_id, other, shift, run) AS total FROM r),
g AS (SELECT DISTINCT doc_id, ln FROM s WHERE total >= 50),
k AS (SELECT a.doc_id, count(g.ln) AS n_deleted,
             coalesce(string_agg(a.line, chr(10) ORDER BY a.ln) FILTER (g.ln IS NULL), '') AS kept
      FROM a LEFT JOIN g ON a.doc_id = g.doc_id AND a.ln = g.ln GROUP BY 1)
SELECT d.doc_id, coalesce(len(l), 0)::BIGINT AS n_lines, coalesce(n_deleted, 0)::BIGINT AS n_deleted,
       length(coalesce(kept, ''))::BIGINT AS chars_left, sha256(coalesce(kept, '')) AS left_sha256
FROM d LEFT JOIN k ON d.doc_id = k.doc_id
"""
