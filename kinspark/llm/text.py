"""Column builders over whole texts, shared by the corpus operators.

A null text has no words, no lines and no spans. Positions are code points.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Words as runs of anything but ASCII white space.
BLANK_WORD = r"[^\x20\x09-\x0D]+"


def _but(keep: str) -> str:
    """Runs of the kept ASCII characters and of anything beyond ASCII. One by one,
    as the engine looks single characters up in a table, but tries ranges in turn."""
    return "[^" + "".join(f"\\x{i:02X}" for i in range(128) if chr(i) not in keep) + "]+"


#: Words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+, and the same with capitals.
PLAIN_WORD = _but("0123456789abcdefghijklmnopqrstuvwxyz")
ANY_CASE_WORD = _but("0123456789abcdefghijklmnopqrstuvwxyz" + UPPER)
NO_WORD = ANY_CASE_WORD.replace("[^", "[", 1)

SPANS = "array<struct<start:int,end:int,hit:string>>"


def ascii_lower(text: Column) -> Column:
    """A-Z only; other letters keep their case."""
    return F.translate(text, UPPER, UPPER.lower())


def words(text: Column, pattern: str = BLANK_WORD) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(0))


def empty_spans() -> Column:
    return F.array().cast(SPANS)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), the value computed once however often use mentions it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


#: Numbers that running() sums in one block.
_BLOCK = 64


def running(numbers: Column) -> Column:
    """For each of an array of integers the sum of those before it.

    aggregate() copies its state at every step, so a growing array in it costs the
    square of its length. Here a number sums up those before it in its block, and a
    block's sum stands for what lies before the block."""
    total = lambda xs: F.aggregate(xs, F.lit(0), lambda a, x: a + x)
    places = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    block = F.lit(_BLOCK)

    def sums(xs: Column) -> Column:
        return F.transform(places(F.ceil(F.size(xs) / block).cast("int")), lambda k: total(F.slice(xs, k * block + 1, block)))

    def upto(xs: Column, before: Column) -> Column:
        at = lambda i: F.floor(i / block).cast("int")
        return F.transform(xs, lambda _, i: F.get(before, at(i)) + total(F.slice(xs, at(i) * block + 1, i % block)))

    return let(numbers, lambda xs: let(sums(xs), lambda of: let(F.transform(of, lambda _, k: total(F.slice(of, F.lit(1), k))), lambda before: upto(xs, before))))


def matches(text: Column, pattern: str | Column, length: Callable[[Column], Column] = F.length) -> Column:
    """All leftmost non-overlapping matches as (start, end, hit); length says in what
    unit positions count.

    The text between matches comes from split(), the matches themselves from
    regexp_extract_all(); lengths added up give the positions."""
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern
    both = F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, pattern, F.lit(0)).alias("hits"))

    def placed(x: Column) -> Column:
        each = F.zip_with(F.slice(x["gaps"], F.lit(1), F.size(x["hits"])), x["hits"], lambda g, h: F.struct(length(g).alias("gap"), length(h).alias("size"), h.alias("hit")))

        def spot(m: Column) -> Column:
            at = running(F.transform(m, lambda y: y["gap"] + y["size"]))
            return F.zip_with(m, at, lambda y, a: F.struct((a + y["gap"]).alias("start"), (a + y["gap"] + y["size"]).alias("end"), y["hit"].alias("hit")))

        return let(each, spot)

    return let(both, placed)


def spans(text: Column, pattern: str, gate: Column | None = None) -> Column:
    """matches(), where texts that fail the gate, a cheaper necessary condition, skip the work."""
    gate = text.rlike(pattern) if gate is None else gate
    return F.when(F.coalesce(gate, F.lit(False)), matches(text, pattern)).otherwise(empty_spans())


def fence(df: DataFrame, names: list[str]) -> DataFrame:
    """The same rows; filters on the named columns stay above their computation.

    Catalyst moves a filter below a projection by putting the computation into the
    filter, once for each mention. It doesn't move one below a generator."""
    rest = [c for c in df.columns if c not in names]
    made = df.select(*rest, F.explode(F.array(F.struct(*names))).alias("__made"))
    return made.select(*rest, *[F.col("__made")[c].alias(c) for c in names])


def digest(parts: Column, sep: str = ",") -> Column:
    """Lower-case hex SHA-256 of an array of strings, joined."""
    return F.sha2(F.array_join(parts, sep), 256)
