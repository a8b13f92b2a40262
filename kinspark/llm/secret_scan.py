"""Secret scans: a randomness test battery over candidate tokens.

Three fixed patterns give the base spans. Beyond them, every long token is given
an encoding (decimal, hex, base32, base36, base64) and tested against "symbols
drawn evenly from that alphabet": chi-squared evenness, runs about the middle of
the alphabet, and lag-one serial correlation. The tests' squared deviates add up to
Q, of chi-squared law with three degrees under evenness, whose p-value is the
battery's. Two false-discovery controls over all candidates of the corpus decide:

* Benjamini-Hochberg over the battery's p-values finds the tokens that aren't even:
  words, numbers in order, repeated patterns. They go.
* A token that is left must also be no chance product of writing: the likelihood
  ratio of even symbols over letters in their usual frequencies is an e-value that
  grows with the length, so short tokens hardly ever reach what long ones do. The
  e-value form of the rule bounds the share of false finds by ALPHA.

Both thresholds come from one histogram of Q and of the e-values' magnitudes, whose
size does not depend on the input.

Defined results: a null text counts as empty; repeated rows give repeated results
and count as repeated candidates; equal evidence is accepted or refused together;
texts and tokens of any length are taken whole; an empty table gives an empty table;
further columns are kept unless they bear the name of an output (base, added).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinspark.llm import text as T
from kinspark.session import cut

KINDS = ("assign", "access", "hex", "random")
#: (password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+), 12 or more in the second group.
ASSIGN = r"""(?i)(?:password|passwd|secret|token|api_?key)["']?\x20*+[:=]\x20*+["']?[A-Za-z0-9+/_.=-]++"""
VALUE = r"""[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)$"""
#: AKIA[A-Z0-9]+ of 18 or more characters.
ACCESS = r"AKIA[A-Z0-9]{14,}+"
#: [0-9a-f]+ of 16 or more characters.
HEX = r"(?<![0-9a-f])[0-9a-f]{16,}+"
TOKEN = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+={0,2}"

ALPHA = 0.01
#: Relative letter frequencies a to z in ordinary writing, per cent.
LETTERS = (8.2, 1.5, 2.8, 4.3, 12.7, 2.2, 2.0, 6.1, 7.0, 0.15, 0.77, 4.0, 2.4, 6.7, 7.5, 1.9, 0.095, 6.0, 6.3, 9.1, 2.8, 0.98, 2.4, 0.15, 2.0, 0.074)
#: Share of a capital's lower-case frequency, and the chance of any other symbol.
CAPITAL, OTHER = 0.05, 0.002
ENCODINGS = (
    ("decimal", r"^[0-9]+$", "0123456789"),
    ("hex", r"^(?:[0-9a-f]+|[0-9A-F]+)$", "0123456789abcdef"),
    ("base32", r"^[A-Z2-7]+=*$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("base36", r"^[0-9a-z]+$", "0123456789abcdefghijklmnopqrstuvwxyz"),
    ("base64", r"", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
)
#: Magnitudes of e-values and steps of Q that the histogram tells apart, the last ones open; steps of Q a unit.
TOP_BIN, TOP_Q, Q_UNIT = 300, 400, 4
BLOCK = 8192  # characters


def _plain_log10() -> Column:
    """Map from a symbol to log10 of its chance in ordinary writing."""
    pairs = []
    for i, p in enumerate(LETTERS):
        pairs += [F.lit(chr(97 + i)), F.lit(math.log10(p / 100))]
    return F.create_map(*pairs)


def _with(xs: Column, keep: list[str], **fields) -> Column:
    """Structs of xs with fields added. A step of its own: what a lambda of the next
    step reads is then a value, not an expression to be evaluated for every symbol."""
    return F.transform(xs, lambda x: F.struct(*[x[c].alias(c) for c in keep], *[f(x).alias(c) for c, f in fields.items()]))


def _coded(tokens: Column) -> Column:
    """Spans with the token's encoding, alphabet size, symbol codes and their mean."""
    body = lambda x: F.translate(F.regexp_replace(x["hit"], "=+$", ""), "-_", "+/")
    name = lambda x: F.coalesce(*[F.when(x["body"].rlike(p), F.lit(n)) if p else F.lit(n) for n, p, _ in ENCODINGS])
    alphabet = lambda x: F.coalesce(*[F.when(x["encoding"] == n, F.lit(a)) for n, _, a in ENCODINGS])
    chars = lambda x: F.filter(F.split(F.when(x["encoding"] == "hex", F.lower(x["body"])).otherwise(x["body"]), ""), lambda c: c != "")
    codes = lambda x: F.transform(x["folded"], lambda c: F.instr(x["alphabet"], c) - 1)
    out = _with(tokens, keep=["start", "end"], body=body)
    out = _with(out, keep=["start", "end", "body"], encoding=name)
    out = _with(out, keep=["start", "end", "body", "encoding"], alphabet=alphabet, folded=chars, chars=lambda x: F.filter(F.split(x["body"], ""), lambda c: c != ""))
    out = _with(out, keep=["start", "end", "encoding", "chars"], k=lambda x: F.length(x["alphabet"]), codes=codes)
    mean = lambda x: F.aggregate(x["codes"], F.lit(0.0), lambda a, c: a + c) / F.size(x["codes"])
    return _with(out, keep=["start", "end", "encoding", "chars", "k", "codes"], mean=mean)


def _chi_z(x: Column) -> Column:
    """Wilson-Hilferty deviate of the chi-squared statistic for even symbols."""
    n, k = F.size(x["codes"]).cast("double"), x["k"].cast("double")
    squares = F.aggregate(F.sequence(F.lit(0), x["k"] - 1), F.lit(0.0), lambda a, s: a + F.pow(F.size(F.filter(x["codes"], lambda c: c == s)), 2))
    df = k - 1
    chi = squares * k / n - n
    return (F.pow(F.greatest(chi, F.lit(0.0)) / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df))


def _runs_z(x: Column) -> Column:
    """Deviate of the number of runs above and below the middle of the alphabet."""
    high = F.transform(x["codes"], lambda c: (c >= x["k"] / 2).cast("int"))
    n1 = F.aggregate(high, F.lit(0.0), lambda a, b: a + b)
    n = F.size(high).cast("double")
    n2 = n - n1
    runs = 1 + F.aggregate(F.zip_with(F.slice(high, F.lit(1), F.size(high) - 1), F.slice(high, F.lit(2), F.size(high) - 1), lambda a, b: (a != b).cast("int")), F.lit(0.0), lambda a, b: a + b)
    mean = 1 + 2 * n1 * n2 / n
    var = (mean - 1) * (mean - 2) / (n - 1)
    return F.when(var > 0, (runs - mean) / F.sqrt(var)).otherwise(F.lit(9.0))


def _serial_z(x: Column) -> Column:
    """Deviate of the lag-one correlation of symbol codes."""
    n = F.size(x["codes"]).cast("double")
    mean = x["mean"]
    var = F.aggregate(x["codes"], F.lit(0.0), lambda a, c: a + (c - mean) * (c - mean))
    steps = F.zip_with(F.slice(x["codes"], F.lit(1), F.size(x["codes"]) - 1), F.slice(x["codes"], F.lit(2), F.size(x["codes"]) - 1), lambda a, b: (a - mean) * (b - mean))
    r = F.aggregate(steps, F.lit(0.0), lambda a, b: a + b) / F.when(var > 0, var)
    return F.coalesce((r + 1 / n) * F.sqrt(n), F.lit(9.0))


def _log_e(x: Column, plain: Column) -> Column:
    chance = lambda c: F.coalesce(F.try_element_at(plain, c), F.try_element_at(plain, F.lower(c)) + math.log10(CAPITAL), F.lit(math.log10(OTHER)))
    return F.aggregate(x["chars"], F.lit(0.0), lambda a, c: a - chance(c)) - F.size(x["chars"]) * F.log10(x["k"])


def candidates(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds base (array of (start, ord, end)) and tokens (array of (start, end,
    encoding, q, magnitude)): the battery's step of Q and the e-value's magnitude."""
    t = F.coalesce(F.col(text), F.lit(""))
    assign = F.filter(T.spans(t, ASSIGN, t.rlike(r"(?i)(?:passw|secret|token|api_?key)")), lambda x: F.length(F.regexp_extract(x["hit"], VALUE, 1)) >= 12)
    access = T.spans(t, ACCESS, F.contains(t, F.lit("AKIA")))
    hexes = T.spans(t, HEX)
    as_base = lambda xs, i: F.transform(xs, lambda x: F.struct(x["start"].alias("start"), F.lit(i).alias("ord"), x["end"].alias("end")))
    base = F.array_sort(F.concat(as_base(assign, 0), as_base(access, 1), as_base(hexes, 2)))
    tokens = T.spans(t, TOKEN, t.rlike(r"[A-Za-z0-9+/_-]{20}"))
    plain = _plain_log10()

    def measured(s):
        sum_sq = F.pow(F.greatest(_chi_z(s), F.lit(0.0)), 2) + F.pow(_runs_z(s), 2) + F.pow(_serial_z(s), 2)
        return F.struct(s["start"].alias("start"), s["end"].alias("end"), s["encoding"].alias("encoding"), F.least(F.floor(sum_sq * Q_UNIT), F.lit(TOP_Q)).cast("int").alias("q"), F.greatest(F.least(F.floor(_log_e(s, plain)), F.lit(TOP_BIN)), F.lit(-1)).cast("int").alias("magnitude"))

    listed = docs.withColumn("base", base).withColumn("__tokens", tokens)
    coded = _coded(F.col("__tokens"))
    return listed.withColumn("__tokens", coded).withColumn("tokens", F.transform("__tokens", measured)).drop("__tokens")


def battery_p(q: float) -> float:
    """Chance that even symbols give a Q so large: chi-squared, three degrees."""
    return math.erfc(math.sqrt(q / 2)) + math.sqrt(2 * q / math.pi) * math.exp(-q / 2)


def thresholds(bins: list[tuple[int, int, int]], alpha: float = ALPHA) -> tuple[int, int]:
    """From (step of Q, magnitude, count): the least step that is found uneven, and the
    least magnitude that the e-value rule accepts among the tokens below that step.

    With m candidates, a step is uneven if the chance of it and above, times m, is at
    most alpha times the number of candidates there; a magnitude b is accepted where
    10^b >= m / (alpha * number of tokens at b or above). Neither need exist."""
    m = sum(n for _, _, n in bins)
    uneven, above = TOP_Q + 1, 0
    for step in sorted({q for q, _, _ in bins}, reverse=True):
        above += sum(n for q, _, n in bins if q == step)
        if m * battery_p(step / Q_UNIT) <= alpha * above:
            uneven = step
    least, up = TOP_BIN + 1, 0
    for b in sorted({b for _, b, _ in bins if b >= 0}, reverse=True):
        up += sum(n for q, x, n in bins if x == b and q < uneven)
        if up and b + math.log10(up * alpha) >= math.log10(m):
            least = b
    return uneven, least


def scan(docs: DataFrame, text: str = "text", alpha: float = ALPHA) -> DataFrame:
    """Adds base and added, the method's own spans outside base spans; the texts
    are read once, what remains of them is kept in the shared folder."""
    found = cut(candidates(docs, text).drop(text))
    every = found.select(F.explode("tokens").alias("x")).groupBy("x.q", "x.magnitude").agg(F.count("*").alias("n"))
    uneven, least = thresholds([tuple(r) for r in every.collect()], alpha)  # at most TOP_Q * TOP_BIN rows
    good = F.filter("tokens", lambda x: (x["q"] < uneven) & (x["magnitude"] >= least))
    # Base spans by the blocks of characters that they touch: a token meets those of its own blocks.
    block = lambda at: F.floor(at / BLOCK).cast("int")
    touching = lambda k: F.filter("base", lambda b: (b["start"] < (k + 1) * BLOCK) & (b["end"] > k * BLOCK))
    last = block(F.array_max(F.transform("added", lambda x: x["end"])))
    blocks = F.when((F.size("added") > 0) & (F.size("base") > 0), F.transform(F.sequence(F.lit(0), last), touching))
    meets = lambda x, k: F.exists(F.get("__blocks", k), lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"]))
    new = F.filter("added", lambda x: F.col("__blocks").isNull() | ~F.exists(F.sequence(block(x["start"]), block(x["end"] - 1)), lambda k: meets(x, k)))
    return found.withColumn("added", good).withColumn("__blocks", blocks).withColumn("added", new).drop("tokens", "__blocks")


def report(docs: DataFrame) -> DataFrame:
    """One row per document: base counts, the base spans' digest, all spans."""
    x = scan(docs.select("doc_id", "text"))
    name = F.array(*map(F.lit, KINDS))
    said = lambda xs: F.transform(xs, lambda s: F.concat_ws(":", F.element_at(name, s["ord"] + 1), s["start"], s["end"]))
    count = lambda i: F.size(F.filter("base", lambda s: s["ord"] == i)).cast("long").alias(f"n_{KINDS[i]}")
    more = F.transform("added", lambda s: F.struct(s["start"].alias("start"), F.lit(3).alias("ord"), s["end"].alias("end")))
    return x.select(
        "doc_id",
        count(0),
        count(1),
        count(2),
        T.digest(said(F.col("base"))).alias("base_sha256"),
        F.array_join(said(F.array_sort(F.concat("base", more))), ",").alias("spans"),
    )
