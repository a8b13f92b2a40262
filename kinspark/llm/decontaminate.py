"""Benchmark decontamination: prefix-filtered set join with exact verification.

Every item is cut into windows of WINDOW consecutive words (a shorter item is one
window). Document frequencies order a window's words by rarity. Containment of
the whole window makes one word its necessary prefix: the rarest. Documents' words
are joined to these prefix words only; bounds on length and position drop pairs
that can't fit; the words of the window are then compared in place.

Defined results: null and wordless texts have no words and no hits; null item ids
count as the empty string among the sorted ids; repeated documents give repeated
rows, repeated items one id; of equally rare words of a window the first by name is
its key; texts of any length are searched whole; empty tables give no hits or no
rows; further columns
are kept unless they bear the name of an output.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinspark.llm import text as T
from kinspark.llm.sizes import fits, small
from kinspark.session import cut

WINDOW = 10


def _words(df: DataFrame, text: str) -> DataFrame:
    return df.withColumn("w", T.words(T.ascii_lower(F.col(text)), T.PLAIN_WORD)).drop(text)


def windows(items: DataFrame, width: int = WINDOW) -> DataFrame:
    """Distinct windows: win (array of words), items (array of ids as strings)."""
    x = _words(items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), "text"), "text").where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - width + 1, F.lit(1)))
    x = x.select("item", F.explode(F.transform(starts, lambda s: F.slice("w", s, F.lit(width)))).alias("win"))
    return x.groupBy("win").agg(F.sort_array(F.collect_set("item")).alias("items"))


def prefixes(wins: DataFrame, docs: DataFrame) -> DataFrame:
    """word, off, win, items: each window under its rarest word of all documents."""
    vocabulary = wins.select(F.explode("win").alias("word")).distinct()
    seen = docs.select(F.explode("w").alias("word")).join(small(vocabulary), "word").groupBy("word").count()
    rarity = vocabulary.join(seen, "word", "left").select("word", F.coalesce("count", F.lit(0)).alias("seen"))
    spots = wins.select("win", "items", F.posexplode("win").alias("off", "word")).join(small(rarity), "word")
    first = F.min(F.struct("seen", "word", "off")).alias("p")
    return spots.groupBy("win", "items").agg(first).where("p.seen > 0").select("p.word", "p.off", "win", "items")


def hits(docs: DataFrame, keys: DataFrame, width: int = WINDOW) -> DataFrame:
    """doc_id, fp, start, len, items of every occurrence of a window.

    Where the windows are too many to broadcast, a word's row takes the words about it
    along to the shuffled join, not the whole text."""
    found = [F.col("doc_id"), F.col("fp")]
    if fits(keys):
        near = docs.select(*found, "w", F.posexplode("w").alias("at", "word")).join(F.broadcast(keys), "word")
        begin = F.col("at") - F.col("off")
        same = (begin >= 0) & (begin + F.size("win") <= F.size("w")) & (F.slice("w", begin + 1, F.size("win")) == F.col("win"))
    else:
        about = lambda w, i: F.struct(i.alias("at"), w.alias("word"), F.slice("w", F.greatest(i - width + 2, F.lit(1)), F.lit(2 * width - 1) - F.greatest(F.lit(width - 1) - i, F.lit(0))).alias("about"))
        rows = docs.select(*found, F.explode(F.transform("w", about)).alias("x")).select(*found, "x.*")
        near = rows.join(keys, "word")
        begin = F.col("at") - F.col("off")
        first = F.least(F.col("at"), F.lit(width - 1)) - F.col("off")
        same = (begin >= 0) & (F.slice("about", F.greatest(first, F.lit(0)) + 1, F.size("win")) == F.col("win"))
    return near.where(same).select(*found, begin.alias("start"), F.size("win").alias("len"), "items")


def report(docs: DataFrame, items: DataFrame, width: int = WINDOW) -> DataFrame:
    """One row per document: n_words, n_hit, n_items, items_sha256, contaminated, item_ids."""
    some = docs.select("doc_id", "text", F.xxhash64("text").alias("fp"))
    coded = _words(some, "text")
    keys = cut(prefixes(cut(windows(items, width)), coded))
    marked = hits(coded, keys, width).groupBy("doc_id", "fp").agg(F.collect_set(F.struct("start", "len")).alias("spans"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("item_ids"))
    spots = F.flatten(F.transform("spans", lambda s: F.sequence(s["start"], s["start"] + s["len"] - 1)))
    marked = marked.select(F.col("doc_id").alias("d"), F.col("fp").alias("f"), F.size(F.array_distinct(spots)).cast("long").alias("n_hit"), F.sort_array("item_ids").alias("item_ids"))
    count = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(T.ANY_CASE_WORD)).cast("long")
    base = some.select("doc_id", "fp", count.alias("n_words"))
    x = base.join(marked, F.col("doc_id").eqNullSafe(F.col("d")) & F.col("fp").eqNullSafe(F.col("f")), "left")
    ids = F.coalesce("item_ids", F.array().cast("array<string>"))
    return x.select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.size(ids).cast("long").alias("n_items"),
        T.digest(ids).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )


def clean(docs: DataFrame, items: DataFrame, width: int = WINDOW) -> DataFrame:
    """The documents without any hit, all columns as they are."""
    coded = _words(docs.select("doc_id", "text", F.xxhash64("text").alias("fp")), "text")
    keys = cut(prefixes(cut(windows(items, width)), coded))
    bad = cut(hits(coded, keys, width).select(F.col("doc_id").alias("d"), F.col("fp").alias("f")).distinct())
    out = docs.join(small(bad), F.col("doc_id").eqNullSafe(F.col("d")) & F.xxhash64("text").eqNullSafe(F.col("f")), "left_anti")
    return out.select(*docs.columns)


_W = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
SQL = f"""
WITH d AS (SELECT doc_id, {_W} AS w FROM documents),
i AS (SELECT item_id, {_W} AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, least(len(w), 10) AS l, array_to_string(w[s : s + least(len(w), 10) - 1], ' ') AS g
       FROM i, unnest(range(1, greatest(len(w) - 9, 1) + 1)) t(s) WHERE len(w) > 0),
lens AS (SELECT DISTINCT l FROM iw),
dw AS (SELECT doc_id, s, l, array_to_string(w[s : s + l - 1], ' ') AS g
       FROM d, lens, unnest(range(1, greatest(len(w) - l + 2, 1))) t(s) WHERE len(w) >= l),
h AS (SELECT doc_id, s, l, item_id FROM dw JOIN iw USING (l, g)),
n AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM h, unnest(range(s, s + l)) t(p) GROUP BY 1),
m AS (SELECT doc_id, count(DISTINCT item_id) AS n_items,
             sha256(string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR)) AS items_sha256
      FROM h GROUP BY 1)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN m ON d.doc_id = m.doc_id
"""
