"""Quality rules: a learned decision list of threshold conjunctions.

Sequential covering: cell counts of labelled documents, one cell per combination
of feature intervals, are the only thing the learner sees. It grows a conjunction
by information gain on the growing half, prunes it on the other half, keeps it if
it is precise enough there, removes what it covers and goes on. The list becomes
one ordered Spark conditional expression; its value is the rule that rejects a
document, or null.

The learner uses at most SAMPLE labelled rows (those with the smallest hashes of
their ids); measuring and judging cover every document.

Defined results: a null or blank text has no words and fails the base rule;
repeated rows give repeated results; several labels of one document all count;
null labels and labels without a document don't; without bad labels, and on an empty
table, the list is empty and the base rule alone decides; terms of equal gain: the
first feature and lowest cut; the list ends with the first rule that isn't precise
enough, however long it is by then; texts of any length are measured whole; further columns are kept unless they bear
the name of an output.

Word windows are compared by a 64-bit hash whose low bits give way to the
position: in a text of n words, 64 - log2(n) bits decide.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinspark.llm import text as T

#: Labelled rows that the learner may read, and quantiles per feature.
SAMPLE = 20_000
CUTS = 16
#: A rule must reach this precision on the pruning half, with that many bad rows.
PRECISION, SUPPORT = 0.97, 3
BASE = ("word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, the base counts and the counts behind the learned features."""
    t = F.coalesce(F.col(text), F.lit(""))
    blank = r"[\x20\x09-\x0D]+"
    x = docs.withColumn("__w", T.words(F.col(text)))
    lines = F.filter(F.split(t, "\n", -1), lambda s: s.rlike(T.BLANK_WORD))
    x = x.withColumns({
        "n_words": F.size("__w").cast("long"),
        "word_chars": F.length(F.regexp_replace(t, blank, "")).cast("long"),
        "n_symbols": F.regexp_count(t, F.lit(r"[#*$%&|<>]")).cast("long"),
        "n_capitals": F.regexp_count(t, F.lit(r"[A-Z]")).cast("long"),
        "n_marks": F.regexp_count(t, F.lit(r"[!?]")).cast("long"),
        "__lines": lines,
        "__bits": F.ceil(F.log2(F.size("__w") + 2.0)).cast("int"),
    })
    x = x.withColumns({
        "n_lines": F.size("__lines").cast("long"),
        "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
        "__h": F.expr("if(size(__w) < 3, cast(array() as array<bigint>), transform(sequence(0, size(__w) - 3), i -> shiftleft(xxhash64(__w[i], __w[i + 1], __w[i + 2]), __bits) | i))"),
    }).drop("__w", "__lines")
    x = x.withColumn("__h", F.sort_array("__h"))
    twice = "filter(__h, (v, i) -> coalesce(shiftright(v, __bits) = shiftright(get(__h, i - 1), __bits), false) or coalesce(shiftright(v, __bits) = shiftright(get(__h, i + 1), __bits), false))"
    spots = f"flatten(transform({twice}, v -> transform(array(0L, 1L, 2L), k -> (v & (shiftleft(1L, __bits) - 1)) + k)))"
    x = x.withColumn("__spots", F.expr(spots)).drop("__h", "__bits")
    x = x.withColumn("n_repeat_words", F.size(F.array_distinct("__spots")).cast("long")).drop("__spots")
    return T.fence(x, ["n_words", *BASE, "n_capitals", "n_marks", "n_lines"])


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def features() -> dict[str, Column]:
    """Scale-free readings of the counts."""
    share = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    return {
        "letters_per_word": share("word_chars", "n_words"),
        "symbols_per_word": share("n_symbols", "n_words"),
        "marks_per_word": share("n_marks", "n_words"),
        "capitals_per_char": share("n_capitals", "word_chars"),
        "repeat_share": share("n_repeat_words", "n_words"),
        "dup_line_share": share("n_dup_lines", "n_lines"),
        "words_per_line": share("n_words", "n_lines"),
    }


@dataclass(frozen=True)
class Term:
    feature: str
    above: bool  # value > cut, else value <= cut
    cut: float

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.cut:.6g}"

    def column(self) -> Column:
        value = features()[self.feature]
        return value > F.lit(self.cut) if self.above else value <= F.lit(self.cut)


@dataclass(frozen=True)
class Rule:
    terms: tuple[Term, ...]
    bad: int
    good: int

    def __str__(self) -> str:
        return " and ".join(map(str, self.terms))


def cells(labelled: DataFrame) -> tuple[dict[str, list[float]], list]:
    """The cuts per feature, and counts per combination of feature intervals:
    rows (bins, half, bad, good). At most as many cells as labelled rows."""
    fs = features()
    # Spread cuts over all values and over the extremes where junk lives.
    at = [i / CUTS for i in range(1, CUTS)] + [0.97, 0.98, 0.99, 0.995, 0.005, 0.01]
    got = labelled.agg(*[F.percentile_approx(c, at, 10_000).alias(k) for k, c in fs.items()]).first()
    seen = {k: sorted({float(v) for v in got[k] or []}) for k in fs}
    cuts = {k: [(a + b) / 2 for a, b in zip(v, v[1:])] for k, v in seen.items()}  # halfway: a margin on both sides
    bins = [sum([(c > F.lit(v)).cast("int") for v in cuts[k]], F.lit(0)).alias(k) for k, c in fs.items()]
    rows = (
        labelled.select(*bins, "half", "bad")
        .groupBy(*fs, "half")
        .agg(F.sum("bad").alias("bad"), F.sum(1 - F.col("bad")).alias("good"))
        .collect()
    )
    return cuts, [(dict(zip(fs, r[: len(fs)], strict=True)), r["half"], r["bad"], r["good"]) for r in rows]


def _holds(cell: dict, terms, cuts) -> bool:
    return all((cell[t.feature] > cuts[t.feature].index(t.cut)) == t.above for t in terms)


def _score(rows, terms, cuts) -> tuple[int, int]:
    hit = [r for r in rows if _holds(r[0], terms, cuts)]
    return sum(r[2] for r in hit), sum(r[3] for r in hit)


def _grow(rows, cuts) -> tuple[Term, ...]:
    """Adds the term of the highest information gain until no good row is covered."""
    terms: tuple[Term, ...] = ()
    bad, good = sum(r[2] for r in rows), sum(r[3] for r in rows)
    while good and bad:
        best = (0.0, None, rows, bad, good)
        for k, vs in cuts.items():
            by = [[0, 0] for _ in range(len(vs) + 1)]
            for r in rows:
                by[r[0][k]][0] += r[2]
                by[r[0][k]][1] += r[3]
            low = [0, 0]
            for i, v in enumerate(vs):
                low = [low[0] + by[i][0], low[1] + by[i][1]]
                for above, (b, g) in ((False, low), (True, (bad - low[0], good - low[1]))):
                    if b and (gain := b * (math.log2(b / (b + g)) - math.log2(bad / (bad + good)))) > best[0] + 1e-9:
                        best = (gain, Term(k, above, v), None, b, g)
        if best[1] is None:
            break
        terms += (best[1],)
        rows = [r for r in rows if _holds(r[0], best[1:2], cuts)]
        bad, good = best[3], best[4]
    return terms


def _worth(rows, terms, cuts) -> float:
    b, g = _score(rows, terms, cuts)
    return (b - g) / (b + g) if b + g else -1.0


def cover(cuts, rows) -> list[Rule]:
    """Sequential covering over the cells; deterministic for given cells."""
    rows = sorted(rows, key=lambda r: (sorted(r[0].items()), r[1]))
    found: list[Rule] = []
    while True:
        grow, prune = [r for r in rows if r[1] == 0], [r for r in rows if r[1] == 1]
        terms = _grow(grow, cuts)
        if not terms:
            break
        while len(terms) > 1:
            less = max((terms[:i] + terms[i + 1 :] for i in range(len(terms))), key=lambda x: _worth(prune, x, cuts))
            if _worth(prune, less, cuts) < _worth(prune, terms, cuts):
                break
            terms = less
        bad, good = _score(prune, terms, cuts)
        if bad < SUPPORT or bad < PRECISION * (bad + good):
            break
        found.append(Rule(terms, bad, good))
        rows = [r for r in rows if not _holds(r[0], terms, cuts)]
    return found


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> list[Rule]:
    """Fits the list on at most sample labelled documents that pass the base rule."""
    known = labels.where("doc_id is not null and quality in (0, 1)").select("doc_id", "quality")
    some = known.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(sample)
    texts = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id")  # at most sample rows
    rows = measure(texts).where(~base_failed()).select("*", (1 - F.col("quality")).alias("bad"), F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(2)).alias("half"))
    return cover(*cells(rows))


def verdict(rules: list[Rule]) -> Column:
    """The first rule that rejects, as text; null for a document that stays."""
    out = F.lit(None).cast("string")
    for r in reversed(rules):
        test = r.terms[0].column()
        for t in r.terms[1:]:
            test = test & t.column()
        out = F.when(test, F.lit(str(r))).otherwise(out)
    return out


def judge(docs: DataFrame, rules: list[Rule], text: str = "text") -> DataFrame:
    """Adds the counts, base_failed, rejected_by and kept."""
    x = measure(docs, text).withColumn("base_failed", base_failed())
    x = x.withColumn("rejected_by", F.when(~F.col("base_failed"), verdict(rules)))
    return x.withColumn("kept", ~F.col("base_failed") & F.col("rejected_by").isNull())


def keep(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that stay, all columns as they are."""
    whole = docs.select("text", F.struct(*docs.columns).alias("__doc"))
    return judge(whole, learn(docs, labels)).where("kept").select("__doc.*")


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    x = judge(docs.select("doc_id", "text"), learn(docs, labels))
    return x.select("doc_id", "n_words", *BASE, "base_failed", "kept", "rejected_by")
