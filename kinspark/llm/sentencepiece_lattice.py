"""SentencePiece encoding and decoding over a relational lattice.

Texts fall into chunks that no piece crosses: spaces and the run of characters that
they lead, or a line break. Two characters belong to one run if a chain of pieces
holds them side by side (so letters part from punctuation); a character that no
piece holds beside another stands alone.

Every distinct chunk, called a word here, is encoded once. Its substrings of at most
the longest piece's length are exploded and equi-joined to the piece table
(broadcast; a vocabulary is bounded), edges are grouped by word, and a higher-order
aggregate folds them into the best path (Viterbi). Scores are multiples of 2^-20 and
their sums exact integers. A character without a piece becomes its UTF-8 bytes.
Words are cut into parts ahead of the explosion, rows carry a digest in place of a
word longer than LONG, and the folds' state is small, so that long words take hardly
more than their share.

Where the ids go: words and ids are a table in the shared folder. The most frequent
of them, by their counts in all documents and as many as BYTES hold, are broadcast as
packed arrays. Only if others are left are documents searched for those; they then
meet their ids by a join, which shuffles texts once. That changes no result.

Scores: of a unigram model, as in the file. A merge-rank (BPE) file has no log
probabilities; there a piece of rank r scores -ln(r + 2), Zipf's law. The result
is the best path under the piece table, not the order of merges.

Decoding joins pieces and bytes and drops the leading space. Literal U+2581 in a
text is encoded as bytes, so decoding gives the text back exactly.

Defined results: null and empty texts have no ids and decode to the empty string;
repeated rows give repeated results; of equal paths the one whose last pieces are
longer wins; an empty table gives an empty table; a text of any length is encoded
whole; further columns are kept unless they bear the name of an output (ids, decoded).
"""

from __future__ import annotations

import hashlib
import itertools
import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinspark.llm.workers import short_batches, tidy
from kinspark.session import stored

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Scores count in these units.
UNIT = 1 << 20
#: Words beyond so many characters go by their digest; characters of a part.
LONG, PART = 64, 64
#: Bytes of the broadcast words with their ids.
BYTES = 96 << 20
SLICE = 1_500_000  # characters that a Python worker holds at once, or one text


@dataclass(frozen=True)
class Vocabulary:
    pieces: tuple[tuple[str, int, float], ...]  # piece, id, score
    bytes_: tuple[int, ...]  # id of each byte value
    unknown: float
    longest: int
    raw: tuple[bytes, ...]  # by id, what a piece decodes to
    chunk: str  # regular expression of the chunks


def load(model: str = MODEL) -> Vocabulary:
    """Reads a model file on the driver."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=model)
    n = m.get_piece_size()
    plain = [i for i in range(n) if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i) or m.is_unused(i))]
    scores = {i: m.get_score(i) for i in plain}
    if all(s == int(s) for s in scores.values()):
        scores = {i: -math.log(2 - s) for i, s in scores.items()}
    pieces = tuple((m.id_to_piece(i), i, float(np.float32(scores[i]))) for i in plain)
    crossing = [p for p, _, _ in pieces if MARK in p.lstrip(MARK) or "\n" in p]
    if crossing:
        raise ValueError(f"pieces that cross chunks: {crossing[:5]}")
    byte_ids = {int(m.id_to_piece(i)[3:5], 16): i for i in range(n) if m.is_byte(i)}
    if len(byte_ids) != 256:
        raise ValueError("the model has no byte pieces")
    raw = [b""] * n
    for p, i, _ in pieces:
        raw[i] = p.replace(MARK, " ").encode()
    for v, i in byte_ids.items():
        raw[i] = bytes([v])
    longest = max(len(p) for p, _, _ in pieces)
    if longest > 31:
        raise ValueError("pieces beyond 31 characters")
    return Vocabulary(pieces, tuple(byte_ids[v] for v in range(256)), float(np.float32(min(scores.values()) - 10)), longest, tuple(raw), chunks(p for p, _, _ in pieces))


def chunks(pieces) -> str:
    """The chunks' pattern: runs within one class of characters, each led by spaces."""
    up: dict[str, str] = {}

    def top(c: str) -> str:
        while up.setdefault(c, c) != c:
            c = up[c]
        return c

    for p in pieces:
        p = p.lstrip(MARK)
        for a, b in zip(p, p[1:], strict=False):
            up[top(a)] = top(b)
    runs: dict[str, list[str]] = {}
    for c in sorted(up):
        runs.setdefault(top(c), []).append(c)
    some = [f"[{''.join(map(re.escape, cs))}]+" for cs in sorted(runs.values(), key=len, reverse=True)]
    return f" *(?:{'|'.join([*some, f'[^ \n{MARK}]'])})| +|\n|{MARK}"


def piece_table(spark: SparkSession, v: Vocabulary) -> DataFrame:
    rows = [(p, i, round(s * UNIT)) for p, i, s in v.pieces]
    return spark.createDataFrame(rows, "piece string, id int, score bigint").withColumn("print", F.xxhash64("piece"))


def _key(word: str) -> str:
    """What stands for a word: itself, or a digest that no word equals, as it holds a line break."""
    return word if len(word) <= LONG else "\n" + hashlib.sha256(word.encode()).hexdigest()


def edges(words: DataFrame, v: Vocabulary) -> DataFrame:
    """key, count, edge (b, n, score, id) for all pieces inside words (columns key, word, count).

    The join's key is the substring's 64-bit hash, looked up much faster than
    strings; the strings are compared besides, in a way that is no further key. A
    character without a piece has an edge whose id is -1 less its code point."""
    x = words.where("length(word) > 0").select("key", "count", F.translate("word", " ", MARK).alias("plain"), (F.col("word") == MARK).alias("mark"))
    part = f"if(length(plain) <= {PART}, array(plain), regexp_extract_all(plain, '(?s)(?=(.{{1,{PART + v.longest - 1}}})).{{1,{PART}}}', 1))"
    x = x.select("key", "count", "mark", F.posexplode(F.expr(part)).alias("k", "part"))
    x = x.select("key", "count", "mark", "k", "part", F.explode(F.expr(f"sequence(0, least({PART}, length(part)) - 1)")).alias("i"))
    x = x.select("key", "count", "mark", "k", "part", "i", F.explode(F.expr(f"sequence(1, least({v.longest}, length(part) - i))")).alias("n"))
    x = x.select("key", "count", "mark", (F.col("k") * PART + F.col("i") + F.col("n")).alias("b"), "n", F.expr("substr(part, i + 1, n)").alias("sub")).withColumn("h", F.xxhash64("sub"))
    x = x.join(F.broadcast(piece_table(words.sparkSession, v)), F.expr("h = print and sub >= piece and sub <= piece and not mark"), "left")  # as many rows as the vocabulary
    score = F.coalesce("score", F.lit(round(v.unknown * UNIT)).cast("long"))
    return x.where("id is not null or n = 1").select("key", "count", F.struct("b", "n", score.alias("score"), F.coalesce("id", -1 - F.ascii("sub")).alias("id")).alias("edge"))


def encode_words(words: DataFrame, v: Vocabulary) -> DataFrame:
    """key, count, ids for a DataFrame of distinct words (key, word, count), spread by key: the lattice.

    Grouping by key needs no further shuffle. A node of the best path is 32 times its
    total plus the length of the piece that ends there; the greatest such number is
    the best piece, the longer one of equals. aggregate() copies its state at every
    step: only the nodes in reach of a piece stand there, the lengths (a character
    each, @ for 0) in a string, which is copied at memory speed."""
    lattice = edges(words, v).groupBy("key", "count").agg(F.sort_array(F.collect_list("edge")).alias("es"))
    reach = v.longest + 1
    before = "if(e.b = e.n, 0L, shiftright(if(e.b - e.n = s.b, s.top, get(s.last, size(s.last) - s.b + e.b - e.n)), 5))"
    new = f"({before} + e.score) * 32 + e.n"
    fold = f"""aggregate(es, cast(named_struct('b', 0, 'top', 0, 'last', array(), 'back', '') as struct<b:int,top:bigint,last:array<bigint>,back:string>),
        (s, e) -> if(e.b = s.b, named_struct('b', s.b, 'top', greatest(s.top, {new}), 'last', s.last, 'back', s.back),
            named_struct('b', e.b, 'top', {new},
                'last', if(s.b = 0, s.last, array_append(if(size(s.last) >= {2 * reach}, slice(s.last, {reach + 1}, {reach}), s.last), s.top)),
                'back', if(s.b = 0, '', concat(s.back, char(64 + (s.top & 31)))))),
        s -> concat(s.back, char(64 + (s.top & 31))))"""
    # Backwards over the ends: the piece's length where the path has one, else 0.
    walk = """aggregate(sequence(length(back), 1, -1), struct(length(back) as at, '' as out),
        (s, p) -> if(p = s.at, struct(p - (ascii(get(steps, p - 1)) - 64) as at, concat(s.out, get(steps, p - 1)) as out), struct(s.at as at, concat(s.out, '@') as out)),
        s -> split(reverse(s.out), ''))"""
    # path twice: named once, the optimiser would compute it anew for every edge.
    on = "transform(filter(es, e -> size(path) >= e.b and ascii(get(path, e.b - 1)) = 64 + e.n), e -> e.id)"
    table = "array(" + ",".join(map(str, v.bytes_)) + ")"
    byte = lambda x: f"element_at({table}, {x} + 1)"
    tail = lambda shift: byte(f"128 + (shiftright(-1 - i, {shift}) & 63)")
    head = lambda first, shift: byte(f"{first} + shiftright(-1 - i, {shift})")
    spelled = f"""case when i >= 0 then array(i) when i >= -128 then array({byte("-1 - i")})
        when i >= -2048 then array({head(192, 6)}, {tail(0)}) when i >= -65536 then array({head(224, 12)}, {tail(6)}, {tail(0)})
        else array({head(240, 18)}, {tail(12)}, {tail(6)}, {tail(0)}) end"""
    x = lattice.select("key", "count", "es", F.expr(fold).alias("back")).select("key", "count", "es", "back", F.split("back", "").alias("steps")).select("key", "count", "es", F.expr(walk).alias("path")).select("key", "count", F.expr(on).alias("ids"))
    return x.select("key", "count", F.expr(f"if(exists(ids, i -> i < 0), flatten(transform(ids, i -> {spelled})), ids)").alias("ids"))


def _words(find, most: int = 400_000):
    """Counts of the words of some texts at a time."""

    def rows(seen):
        return pa.RecordBatch.from_arrays([pa.array(list(map(_key, seen)), pa.string()), pa.array([w if len(w) > LONG else None for w in seen], pa.string()), pa.array(list(seen.values()), pa.int64())], names=["key", "word", "count"])

    def run(batches):
        seen: Counter[str] = Counter()
        for b in batches:
            for text in b.column(0):
                if t := text.as_py():
                    seen.update(find(" " + t))
                if len(seen) > most:
                    yield rows(seen)
                    seen = Counter()
        yield rows(seen)

    return run


def coded_words(texts: DataFrame, v: Vocabulary) -> DataFrame:
    """key, count, ids of every distinct word of texts' only column, in the shared folder.

    Counted in the tasks already, words are spread by key once, for the counts and
    the lattice; a fixed number of partitions, as the lattice works far more than the
    size of the words tells."""
    spark = texts.sparkSession
    found = texts.mapInArrow(tidy(_words(re.compile(v.chunk).findall)), "key string, word string, count bigint")
    counts = found.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "key").groupBy("key", "word").agg(F.sum("count").alias("count"))
    words = counts.select("key", F.coalesce("word", "key").alias("word"), "count")
    return stored(encode_words(words.sortWithinPartitions("key"), v))  # edges then come in the order that grouping wants


def _packed(batches):
    for b in batches:
        ids = b.column("ids")
        yield pa.RecordBatch.from_arrays([pa.array([_prints(b.column("key").to_pylist()).tobytes()]), pa.array([np.diff(ids.offsets.to_numpy()).astype(np.int32).tobytes()]), pa.array([ids.values.to_numpy()[ids.offsets[0].as_py() : ids.offsets[-1].as_py()].astype(np.int32).tobytes()])], names=["prints", "sizes", "ids"])


def _prints(keys: list[str]) -> np.ndarray:
    """64-bit hashes."""
    return pd.util.hash_array(np.array(keys, dtype=object), categorize=False) if keys else np.zeros(0, np.uint64)


@dataclass(frozen=True)
class Known:
    """Words by ascending hash, where their ids begin (and the last ones end), and ids."""

    prints: np.ndarray
    begin: np.ndarray
    ids: np.ndarray
    whole: bool  # nothing is left out

    def find(self, prints: np.ndarray) -> np.ndarray:
        """Places, or -1."""
        if not len(self.prints):
            return np.full(len(prints), -1)
        order = np.argsort(prints)  # searching in order finds its way in the processor's cache
        low = prints[order]
        at = np.minimum(np.searchsorted(self.prints, low), len(self.prints) - 1)
        out = np.empty(len(prints), np.int64)
        out[order] = np.where(self.prints[at] == low, at, -1)
        return out


def dictionary(coded: DataFrame, v: Vocabulary, most: int) -> Known:
    """The most frequent words, as many as so many bytes hold: all that occur at least
    so often (by steps of an eighth of a doubling)."""
    wide = np.uint16 if len(v.raw) <= 1 << 16 else np.int32
    step = F.floor(F.log2("count") * 8).cast("int")
    size = F.sum(F.size("ids") * wide().itemsize + 12)
    bins = sorted(((r["step"], r["size"]) for r in coded.groupBy(step.alias("step")).agg(size.alias("size")).collect()), reverse=True)  # some hundred rows
    least, held, whole = None, 0, True
    for at, more in bins:
        held += more
        if held > most:
            whole = False
            break
        least = at
    if least is None:
        return Known(np.zeros(0, np.uint64), np.zeros(1, np.int64), np.zeros(0, wide), whole)
    got = coded.where(step >= least).select("key", "ids").mapInArrow(tidy(_packed), "prints binary, sizes binary, ids binary").toLocalIterator()
    parts: tuple[list, list, list] = ([], [], [])
    for r in got:
        for part, name, kind, stored_as in zip(parts, ("prints", "sizes", "ids"), (np.uint64, np.int32, np.int32), (np.uint64, np.uint32, wide), strict=True):
            part.append(np.frombuffer(r[name], kind).astype(stored_as))
    prints, sizes, ids = (np.concatenate(x) for x in parts)
    for part in parts:
        part.clear()
    order = np.argsort(prints, kind="stable").astype(np.uint32)
    prints = prints[order]
    begin = (np.cumsum(sizes, dtype=np.int64) - sizes).astype(np.uint32)[order]
    sizes = sizes[order]
    flat, step, at = np.empty_like(ids), 100_000, 0  # some words at a time, for the driver's memory
    for a in range(0, len(order), step):
        some = ids[_ranges(begin[a : a + step], sizes[a : a + step])]
        flat[at : at + len(some)] = some
        at += len(some)
    return Known(prints, np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]).astype(np.uint32), flat, whole)


def _ranges(begin: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of ranges, one after the other."""
    ends = np.cumsum(sizes, dtype=np.int64)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(begin.astype(np.int64) - (ends - sizes), sizes)


def _missing(known, chunk: str):
    """For each document the keys of its words that aren't known."""
    find = re.compile(chunk).findall

    def run(batches):
        for b in batches:
            keys = []
            for text in b.column(2):
                t = text.as_py()
                own = list(dict.fromkeys(map(_key, find(" " + t)))) if t else []
                at = known.value.find(_prints(own))
                keys.append([own[i] for i in np.flatnonzero(at < 0)])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(keys, pa.list_(pa.string()))], names=["doc_id", "print", "keys"])

    return run


def _assemble(known, chunk: str, text_at: str, keep: list[str], raw=None):
    """Ids per text, and with raw the text that they decode to; some texts at a time."""
    find = re.compile(chunk).findall
    spell = _speller(raw) if raw is not None else None

    def part(b, texts, table):
        lists = [find(" " + t) if t else [] for t in texts]
        n = np.fromiter(map(len, lists), np.int64, len(lists))
        codes, words = pd.factorize(np.array(list(itertools.chain.from_iterable(lists)), dtype=object))
        del lists
        at = table.find(_prints(list(map(_key, words))))
        begin, sizes, pool = table.begin[at].astype(np.int64), (table.begin[at + 1] - table.begin[at]).astype(np.int64) if len(table.prints) else np.zeros(len(at), np.int64), table.ids
        lost = np.flatnonzero(at < 0)
        if len(lost):
            own = {x["key"]: x["ids"] for extra in b.column("__extra") for x in extra.as_py() or ()}
            more = [own[_key(words[i])] for i in lost]
            sizes[lost] = [len(x) for x in more]
            begin[lost] = len(pool) + np.cumsum(sizes[lost]) - sizes[lost]
            pool = np.concatenate([pool, np.array([i for x in more for i in x], pool.dtype)])
        each = sizes[codes]
        ids = pool[_ranges(begin[codes], each)].astype(np.int32)
        upto = np.concatenate([[0], np.cumsum(each)])[np.concatenate([[0], np.cumsum(n)])].astype(np.int32)
        out = [*[b.column(c) for c in keep], pa.ListArray.from_arrays(pa.array(upto), pa.array(ids))]
        if raw is not None:
            out.append(pa.array(spell(ids, upto), pa.string()))
        return pa.RecordBatch.from_arrays(out, names=[*keep, "ids", *["decoded"] * (raw is not None)])

    def run(batches):
        for b in batches:
            size = np.fromiter((len(t.as_buffer()) if t.is_valid else 0 for t in b.column(text_at)), np.int64, len(b))
            group = np.cumsum(size) // SLICE
            cuts = [*np.flatnonzero(np.diff(group, prepend=-1)), len(b)]
            for x, y in zip(cuts[:-1], cuts[1:], strict=True):
                piece = b.slice(x, y - x)
                yield part(piece, piece.column(text_at).to_pylist(), known.value)

    return run


def _speller(raw: tuple[bytes, ...]):
    """A function from ids and where each text's begin and end, to the texts."""
    sizes = np.fromiter(map(len, raw), np.int64, len(raw))
    begin, every = np.cumsum(sizes) - sizes, np.frombuffer(b"".join(raw), np.uint8)

    def texts(ids: np.ndarray, at: np.ndarray) -> list[str]:
        each = sizes[ids]
        step = 1 << 13  # ids at a time: the places of their bytes then stay in the processor's cache
        spelled = b"".join([every[_ranges(begin[ids[a : a + step]], each[a : a + step])].tobytes() for a in range(0, len(ids), step)])
        ends = np.concatenate([[0], np.cumsum(each)])[at].tolist()
        return [spelled[x + 1 : y].decode("utf-8", "replace") for x, y in itertools.pairwise(ends)]

    return texts


def _same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def encode(docs: DataFrame, v: Vocabulary | None = None, text: str = "text", decoded: bool = False, most: int = BYTES) -> DataFrame:
    """docs with ids, an array of piece ids per text; decoded: also the text they give
    back; most: bytes of the broadcast dictionary."""
    v = v or load()
    short_batches(docs.sparkSession)
    coded = coded_words(docs.select(text), v)
    words = dictionary(coded, v, most)
    known = docs.sparkSession.sparkContext.broadcast(words)
    keep = [c for c in docs.columns if c != "ids" and not (decoded and c == "decoded")]
    x = docs.select(*keep)
    extra = "array<struct<key:string,ids:array<int>>>"
    if words.whole:
        x = x.withColumn("__extra", F.lit(None).cast(extra))
    else:
        kind = dict(docs.dtypes)["doc_id"]
        some = docs.select("doc_id", F.xxhash64(text).alias("print"), F.col(text)).mapInArrow(tidy(_missing(known, v.chunk)), f"doc_id {kind}, print bigint, keys array<string>")
        pairs = some.select(F.col("doc_id").alias("__d"), F.col("print").alias("__p"), F.explode("keys").alias("key")).distinct()
        found = pairs.join(coded.select("key", "ids"), "key").groupBy("__d", "__p").agg(F.collect_list(F.struct("key", "ids")).alias("__extra"))
        x = x.withColumn("__print", F.xxhash64(text)).join(found, _same("doc_id", "__d") & _same("__print", "__p"), "left").drop("__d", "__p", "__print")
    kinds = ", ".join(f"`{c}` {t}" for c, t in docs.dtypes if c in keep)
    return x.mapInArrow(tidy(_assemble(known, v.chunk, text, keep, v.raw if decoded else None)), f"{kinds}, ids array<int>" + ", decoded string" * decoded)


def decode(coded: DataFrame, v: Vocabulary | None = None, ids: str = "ids") -> DataFrame:
    """Adds decoded, the text of the ids."""
    spell = _speller((v or load()).raw)
    coded = coded.drop("decoded")
    names = coded.columns

    def run(batches):
        for b in batches:
            lists = b.column(ids)
            at = lists.offsets.to_numpy()
            out = spell(lists.values.to_numpy()[at[0] : at[-1]], at - at[0])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.string())], names=[*names, "decoded"])

    kinds = ", ".join(f"`{c}` {t}" for c, t in coded.dtypes)
    return coded.mapInArrow(run, f"{kinds}, decoded string")


def report(docs: DataFrame, v: Vocabulary | None = None) -> DataFrame:
    """One row per document: piece count, digest of the ids, exactness of decoding."""
    v = v or load()
    x = encode(docs.select("doc_id", "text"), v, decoded=True)
    return x.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"), (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"))
