"""LM scoring: a causal self-attention model in numpy over subword ids.

Words (lower-cased A-Z, split at ASCII white space) become subword ids of a public
vocabulary. The model predicts the next id from a window of the ids before it:
one layer of causal attention gives the id's class, corpus counts of all training
documents give the id within its class. Windows of CONTEXT positions overlap; each
scores its last STRIDE positions, so every id is scored once, with at least
CONTEXT - STRIDE positions before it, where the text has so many.

Learned from training documents only, those whose crc32(doc_id as text) mod 5 is
not 1: word counts, id counts and attention weights, over all of them. The weights
start from a first fit on the driver (TRAIN_DOCS documents chosen by hash,
TRAIN_WINDOWS windows: where the pass begins, not what it sees). Then every window
of every training document is learned once: documents are dealt to tasks of about
SHARE documents by hash and come in the order of that hash; each task goes on from the
first fit over its own, and the tasks' weights are averaged by their windows. So the
model depends on the documents alone, not on how their rows lie in files or partitions.

Each text is encoded once: a table in the shared folder keeps its ids, from which
learning and scoring read.

The base score needs the count of every token. The FREQUENT most frequent words
travel to the workers; what is left of a document, its rarer words, is joined to
the counts by word.

Defined results: null and empty texts have one token, the end; repeated rows give
repeated results and count as often as they stand; a null doc_id counts as the
empty text and is scored like any other; equally frequent words and ids rank by
their bytes and numbers; texts of any length are scored whole, some windows at a
time; an empty table gives an empty table; further columns are dropped.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinspark.llm.workers import short_batches, tidy
from kinspark.session import stored

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
CONTEXT, STRIDE, WIDTH, CLASSES, FINE = 24, 18, 16, 64, 512
TRAIN_DOCS, TRAIN_WINDOWS, STEPS, BATCH = 1_500, 60_000, 1_000, 256
#: The step of the pass over all documents; weights are summed as whole multiples of 1 / FIXED.
RATE, FIXED = 0.004, 1 << 24
FREQUENT = 120_000
#: Documents that a task learns from.
SHARE = 4_000
#: What scoring hands on.
KEPT = ("doc_id", "fp", "n_tokens", "n_common", "base_common")
#: The end of a text, no word: it holds a blank.
END = b" "


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5 == 1


def split(text: str | None) -> list[bytes]:
    """Words; lower() and split() of bytes know ASCII only, as is wanted."""
    return (text or "").encode().lower().split()


def split_all(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """split() of many texts in Arrow: all words as bytes, and how many each text has."""
    got = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    n, words = pc.list_value_length(got).to_numpy().astype(np.int64), got.flatten()
    real = pc.not_equal(words, "")  # blanks at either end make empty words
    none = np.flatnonzero(~real.to_numpy(zero_copy_only=False))
    if len(none):
        words = words.filter(real)
        n -= np.bincount(np.repeat(np.arange(len(n)), n)[none], minlength=len(n))
    return words.cast(pa.binary()), n


def _chunks(size: np.ndarray, most: int):
    """From and to: rows of about so much size together; one row at least."""
    upto = np.concatenate([[0], np.cumsum(size)])
    a = 0
    while a < len(size):
        z = min(len(size), max(a + 1, int(np.searchsorted(upto, upto[a] + most))))
        yield a, z
        a = z


# ---------------------------------------------------------------- counts


def _count(batches):
    def rows(words, texts):
        got = pc.value_counts(pa.chunked_array([*words, pa.array([END] * (texts > 0), pa.binary())]))
        n = got.field("counts").to_numpy().copy()
        n[np.flatnonzero(pc.equal(got.field("values"), END).to_numpy(zero_copy_only=False))] = texts
        return pa.RecordBatch.from_arrays([got.field("values"), pa.array(n)], names=["word", "n"])

    held, size, texts = [], 0, 0
    for b in batches:
        for a, z in _chunks(pc.fill_null(pc.binary_length(b.column("text")), 0).to_numpy(), 2_000_000):
            words, n = split_all(b.column("text").slice(a, z - a))
            held, size, texts = [*held, words], size + len(words), texts + len(n)
            if size > 2_000_000:
                yield rows(held, texts)
                held, size, texts = [], 0, 0
    if texts:
        yield rows(held, texts)


def word_counts(train: DataFrame) -> DataFrame:
    """word, c over all training documents; counted before the shuffle."""
    return stored(train.select("text").mapInArrow(tidy(_count), "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("c")))


def _ids(spm, words: list[bytes] | pa.Array, end: int) -> list[list[int]]:
    if isinstance(words, list):
        words = pa.array(words, pa.binary())
    got = spm.encode(words.cast(pa.string()).to_numpy(zero_copy_only=False).tolist(), num_threads=1)
    for i in np.flatnonzero(pc.equal(words, END).to_numpy(zero_copy_only=False)):
        got[i] = [end]
    return got


def _flat(ids: list[list[int]], kind: type = np.int32) -> np.ndarray:
    return np.fromiter(chain.from_iterable(ids), kind)


def id_counts(encoded: DataFrame, size: int) -> np.ndarray:
    """Occurrences of every id in all training documents, the end last."""

    def run(batches):
        total = np.zeros(size, np.int64)
        for b in batches:
            for tally in b.column("tally"):
                total += np.frombuffer(tally.as_buffer(), np.int32)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["id", "n"])

    out = np.zeros(size)
    tallies = encoded.select("tally").where(F.col("tally").isNotNull())
    for r in tallies.mapInArrow(tidy(run), "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n")).collect():  # as many rows as the vocabulary
        out[r["id"]] = r["n"]
    return out


# ---------------------------------------------------------------- the model


@dataclass
class Model:
    """Weights; cls and fine map ids to output and input classes, within holds
    log10 P(id | class). Fine class FINE is the beginning, FINE + 1 is padding."""

    weights: dict[str, np.ndarray]
    cls: np.ndarray
    fine: np.ndarray
    within: np.ndarray


def classes(counts: np.ndarray, n: int, singles: int) -> np.ndarray:
    """The most frequent ids alone, the others in classes of about equal mass."""
    order = np.argsort(-counts, kind="stable")
    out = np.empty(len(counts), np.int32)
    out[order[:singles]] = np.arange(singles)
    rest = order[singles:]
    mass = np.cumsum(counts[rest] + 0.5)
    out[rest] = singles + np.minimum(n - singles - 1, (mass / mass[-1] * (n - singles)).astype(np.int32))
    return out


def within_class(counts: np.ndarray, cls: np.ndarray) -> np.ndarray:
    c = counts + 0.5
    return np.log10(c / np.bincount(cls, c, CLASSES)[cls]).astype(np.float32)


def windows(ids: np.ndarray, at: np.ndarray, fine: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Inputs (windows, CONTEXT) as fine classes, and for the last STRIDE positions
    the index of the predicted id, or -1. at: where each text begins, and the end."""
    n = np.diff(at)
    per = -(-n // STRIDE)
    early = CONTEXT - STRIDE
    long = per * STRIDE + early  # each text's room in a row of windows, begun and filled up by padding
    base = np.cumsum(long) - long
    where = np.arange(len(ids)) + np.repeat(base + early - at[:-1], n)
    shown = np.full(long.sum() + CONTEXT, FINE + 1, np.int32)
    place = np.full(len(shown), -1, np.int32 if len(ids) < 2**31 else np.int64)
    place[where] = np.arange(len(ids))
    if len(ids):
        shown[where[1:]] = fine[ids[:-1]]  # what stands before each id
        shown[(base + early)[n > 0]] = FINE
    doc = np.repeat(np.arange(len(n)), per)
    begin = base[doc] + STRIDE * (np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per))
    x = np.lib.stride_tricks.sliding_window_view(shown, CONTEXT)[begin]
    y = np.lib.stride_tricks.sliding_window_view(place, STRIDE)[begin + early]
    return x, y, doc


_LATE = np.arange(CONTEXT - STRIDE, CONTEXT)
_CAUSAL = np.where(np.arange(CONTEXT)[None, :] <= _LATE[:, None], 0, -1e9).astype(np.float32)

_ONES = np.ones(CLASSES, np.float32)
_SPOT = np.arange((FINE + 2) * WIDTH).reshape(-1, WIDTH)


class Room:
    """Arrays by name, used again from step to step: new ones of this size cost page faults."""

    def __init__(self):
        self.held: dict[str, np.ndarray] = {}

    def __call__(self, name: str, *shape: int, kind: type = np.float32) -> np.ndarray:
        size = int(np.prod(shape))
        if name not in self.held or self.held[name].size < size:
            item = np.dtype(kind).itemsize
            free = np.empty(size * item + 64, np.uint8)
            self.held[name] = free[-free.ctypes.data % 64 :][: size * item].view(kind)  # begins with a cache line
        return self.held[name][:size].reshape(shape)


def _products(w: dict) -> tuple[np.ndarray, np.ndarray]:
    """Queries meet keys, and values the output weights, as one small matrix each:
    (h Q) (h K)' = (h Q K') h' and (a (h V)) O = (a h) (V O)."""
    q, k, v = (w["qkv"][:, i * WIDTH : (i + 1) * WIDTH] for i in range(3))
    return q @ k.T, v @ w["out"]


def _across(p: np.ndarray, q: np.ndarray, rows: int = 8 * STRIDE) -> np.ndarray:
    """p' @ q over many rows, some at a time: small products need no packing."""
    p, q = p.reshape(-1, p.shape[-1]), q.reshape(-1, q.shape[-1])
    m = len(p) // rows * rows
    out = p[m:].T @ q[m:]
    if m:
        out += (p[:m].reshape(-1, rows, p.shape[1]).transpose(0, 2, 1) @ q[:m].reshape(-1, rows, q.shape[1])).sum(axis=0)
    return out


def forward(w: dict, x: np.ndarray, room: Room | None = None) -> tuple:
    """Logits of the last STRIDE positions, and what backward() needs. Masked
    positions, later ones and padding, get no attention."""
    room, n = room or Room(), len(x)
    meet, turn = _products(w)
    h = np.take(w["embed"], x, axis=0, out=room("h", n, CONTEXT, WIDTH), mode="clip")
    h += w["place"]
    late = h[:, CONTEXT - STRIDE :]
    # attention s or a above its gradient, and what meets either in dh: see backward()
    both, sides = room("both", n, 2 * STRIDE, CONTEXT), room("sides", n, 2 * STRIDE, WIDTH)
    q = np.matmul(late, meet, out=sides[:, :STRIDE])
    s = np.matmul(q, h.transpose(0, 2, 1), out=both[:, STRIDE:])
    s += _CAUSAL
    if max(s.max(initial=0), -s.diagonal(CONTEXT - STRIDE, 1, 2).min(initial=0)) > 60:
        s -= s.max(axis=2, keepdims=True)
    padded = np.flatnonzero((x[:, 0] == FINE + 1) | (x[:, -1] == FINE + 1))
    if len(padded):
        some = s[padded] + np.where(x[padded] == FINE + 1, np.float32(-1e9), np.float32(0))[:, None, :]
        s[padded] = some - some.max(axis=2, keepdims=True)  # a position of padding sees nothing at all
    a = np.exp(s, out=s)
    a *= 1 / (a @ _ONES[:CONTEXT])[:, :, None]
    o = np.matmul(a, h, out=room("o", n, STRIDE, WIDTH))
    seen = room("seen", n, STRIDE, 2 * WIDTH + 1)  # z, where positive z again, and 1 for the bias
    z = np.matmul(o, turn, out=seen[:, :, :WIDTH])
    z += late
    np.maximum(z, 0, out=seen[:, :, WIDTH:-1])
    seen[:, :, -1] = 1
    logits = np.matmul(seen, np.concatenate([w["class"], w["bias"][None]]), out=room("logits", n, STRIDE, CLASSES))
    return logits.reshape(-1, CLASSES), (h, both, sides, o, seen, meet, turn)


def backward(w: dict, x: np.ndarray, kept: tuple, g: np.ndarray, room: Room | None = None) -> dict:
    """Gradients of the weights for gradient g of the logits."""
    room, n = room or Room(), len(x)
    h, both, sides, o, seen, meet, turn = kept
    ds, a, q, do = both[:, :STRIDE], both[:, STRIDE:], sides[:, :STRIDE], sides[:, STRIDE:]
    late, d = h[:, CONTEXT - STRIDE :], {}
    top = _across(seen, g)
    d["class"], d["bias"] = top[:-1], top[-1]
    dseen = np.matmul(g.reshape(n, STRIDE, CLASSES), w["class"].T.copy(), out=room("dseen", n, STRIDE, 2 * WIDTH))
    dz = np.multiply(dseen[:, :, WIDTH:], seen[:, :, :WIDTH] > 0, out=room("dz", n, STRIDE, WIDTH))
    dz += dseen[:, :, :WIDTH]
    dturn = _across(o, dz)
    np.matmul(dz, turn.T.copy(), out=do)
    mean = np.einsum("nij,nij->ni", do, o)
    np.matmul(do, h.transpose(0, 2, 1), out=ds)
    ds -= mean[:, :, None]  # the sum of a * (do @ h') is do * o
    ds *= a
    dh = np.matmul(both.transpose(0, 2, 1), sides, out=room("dh", n, CONTEXT, WIDTH))
    dq = np.matmul(ds, h, out=room("dq", n, STRIDE, WIDTH))
    dmeet = _across(late, dq)
    dz += np.matmul(dq, meet.T.copy(), out=o)
    dh[:, CONTEXT - STRIDE :] += dz
    wq, wk, wv = (w["qkv"][:, i * WIDTH : (i + 1) * WIDTH] for i in range(3))
    d["qkv"] = np.concatenate([dmeet @ wk, dmeet.T @ wq, dturn @ w["out"].T], axis=1)
    d["out"] = wv.T @ dturn
    d["place"] = dh.sum(axis=0)
    spot = np.take(_SPOT, x, axis=0, out=room("spot", n, CONTEXT, WIDTH, kind=np.int64), mode="clip")
    d["embed"] = np.bincount(spot.ravel(), dh.ravel(), w["embed"].size).reshape(w["embed"].shape)
    return d


class Adam:
    """Steps on weights in place."""

    def __init__(self, w: dict):
        self.w, self.step, self.room = w, 0, Room()
        self.flat = np.concatenate([v.ravel() for v in w.values()])
        self.m1, self.m2, self.d = (np.zeros_like(self.flat) for _ in range(3))
        a = 0
        for k, v in w.items():
            w[k] = self.flat[a : a + v.size].reshape(v.shape)
            a += v.size

    def learn(self, x: np.ndarray, y: np.ndarray, target: np.ndarray, rate: float) -> None:
        """One step on windows x that predict classes target[y], where y is no -1."""
        w, by = self.w, y.ravel()
        self.step += 1
        logits, kept = forward(w, x, self.room)
        if max(logits.max(initial=0), -logits.min(initial=0)) > 60:  # else no exponential leaves 32-bit floats
            logits -= logits.max(axis=1, keepdims=True)
        g = np.exp(logits, out=logits)
        total = g @ _ONES
        at = np.flatnonzero(by >= 0)
        g.ravel()[at * CLASSES + target[by[at]]] -= total[at]
        g *= ((by >= 0) / (total * np.float32(max(1, len(at))))).astype(np.float32)[:, None]
        got = backward(w, x, kept, g, self.room)
        d = np.concatenate([got[k].ravel() for k in w], out=self.d, casting="same_kind")
        self.m1 *= 0.9
        self.m1 += 0.1 * d
        self.m2 *= 0.98
        self.m2 += 0.02 * d * d
        self.flat -= rate * (self.m1 / (1 - 0.9**self.step)) / (np.sqrt(self.m2 / (1 - 0.98**self.step)) + 1e-8)


def train(ids: np.ndarray, at: np.ndarray, counts: np.ndarray, seed: int = 5) -> Model:
    """The first fit: Adam on windows of the sample; deterministic for given ids."""
    cls = classes(counts, CLASSES, CLASSES - 12)
    fine = classes(counts, FINE, FINE - 64)
    draw = np.random.default_rng(seed)
    w = {k: (draw.normal(0, s, shape)).astype(np.float32) for k, s, shape in (("embed", 0.3, (FINE + 2, WIDTH)), ("place", 0.1, (CONTEXT, WIDTH)), ("qkv", 0.25, (WIDTH, 3 * WIDTH)), ("out", 0.25, (WIDTH, WIDTH)), ("class", 0.1, (2 * WIDTH, CLASSES)))}
    mass = np.bincount(cls, counts + 0.5, CLASSES)
    w["bias"] = np.log(mass / mass.sum()).astype(np.float32)
    x, y, _ = windows(ids, at, fine)
    if len(x) > TRAIN_WINDOWS:
        some = draw.choice(len(x), TRAIN_WINDOWS, replace=False)
        x, y = x[some], y[some]
    fit, target = Adam(w), cls[ids]
    for step in range(1, STEPS + 1 if len(x) else 1):
        pick = draw.integers(0, len(x), BATCH)
        fit.learn(x[pick], y[pick], target, 0.01 * min(1, step / 20) * (1 - 0.95 * step / STEPS))
    return Model(w, cls, fine, within_class(counts, cls))


def log10_probability(model: Model, ids: np.ndarray, at: np.ndarray, step: int = 256) -> np.ndarray:
    """One value per text; so many windows at a time bound the memory."""
    x, y, doc = windows(ids, at, model.fine)
    room, spot = Room(), np.arange(step * STRIDE) * CLASSES
    target = model.cls[ids][y].reshape(-1)
    chosen, total = (np.empty(y.size, np.float32) for _ in range(2))
    for a in range(0, len(x), step):
        logits, _ = forward(model.weights, x[a : a + step], room)
        if max(logits.max(initial=0), -logits.min(initial=0)) > 60:  # else no exponential leaves 32-bit floats
            logits -= logits.max(axis=1, keepdims=True)
        part = slice(a * STRIDE, a * STRIDE + len(logits))
        chosen[part] = logits.ravel()[spot[: len(logits)] + target[part]]
        total[part] = np.exp(logits, out=logits) @ _ONES
    got = (chosen - np.log(total)).astype(float) * 0.4342944819032518 + model.within[ids][y].reshape(-1)
    got *= (y >= 0).reshape(-1)
    return np.bincount(doc, got.reshape(y.shape).sum(axis=1), len(at) - 1)


# ---------------------------------------------------------------- scoring


def _encode(spm, lists: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of texts given as words, each with its end; and where they begin."""
    end = spm.get_piece_size()
    words = list(dict.fromkeys(w for ws in lists for w in ws))
    at = {w: i for i, w in enumerate(words)}
    return _gather(_ids(spm, words, end), at, lists, end)


def _gather(ids, at, lists, end):
    ids = [*ids, [end]]
    order = [i for ws in lists for i in (*(at[w] for w in ws), len(ids) - 1)]
    flat = np.fromiter((i for k in order for i in ids[k]), np.int32)
    sizes = [sum(len(ids[at[w]]) for w in ws) + 1 for ws in lists]
    return flat, np.cumsum([0, *sizes])


def _encoded(batches, shared):
    """Some texts at a time, by length: the batch, its rows, how many words each has; each
    word's place in the table, those beyond it being rare; ids and where texts begin."""
    import sentencepiece

    proto, table, logs, begin, flat, _ = shared.value
    spm = sentencepiece.SentencePieceProcessor(model_proto=proto)
    end, known = spm.get_piece_size(), len(logs) - 1  # the last entry is the end
    sizes_known = np.diff(begin).astype(np.int64)
    for b in batches:
        for a, z in _chunks(pc.fill_null(pc.binary_length(b.column("text")), 0).to_numpy(), 2_000_000):
            some, n = split_all(b.column("text").slice(a, z - a))
            spot = pc.fill_null(pc.index_in(some, value_set=table), -1).to_numpy().astype(np.int64)
            rare = np.flatnonzero(spot < 0)
            left = some.take(pa.array(rare))
            new = left.dictionary_encode()
            more = _ids(spm, new.dictionary, end)
            spot[rare] = known + 1 + new.indices.to_numpy()
            # ids of every word, the end after each text
            whole = np.insert(spot, np.cumsum(n), known)
            sizes = np.concatenate([sizes_known, np.fromiter(map(len, more), np.int64, len(more))])
            pool = np.concatenate([flat, _flat(more)])
            starts = np.cumsum(sizes) - sizes
            each = sizes[whole]
            last = np.cumsum(each)
            ids = pool[np.repeat(starts[whole] - (last - each), each) + np.arange(last[-1])]
            at = np.concatenate([[0], last])[np.concatenate([[0], np.cumsum(n + 1)])]
            yield b, slice(a, z), n, spot, rare, left, ids, at


def _kind(shared) -> np.dtype:
    """The narrowest whole numbers that hold every id, the end being the largest."""
    return np.min_scalar_type(int(shared.value[4][-1]))


def _encode_all(shared):
    """Texts as packed ids, and what their words alone tell. Some rows carry a tally:
    how often each id stands in the training texts of theirs and of rows beside them."""

    def run(batches):
        _, _, logs, _, _, unknown = shared.value
        known = len(logs) - 1
        for b, part, n, spot, rare, left, ids, at in _encoded(batches, shared):
            doc = np.repeat(np.arange(len(n)), n)
            common = spot <= known
            base = np.bincount(doc[common], logs[spot[common]], len(n)) + logs[known]
            seen = np.bincount(doc[common], minlength=len(n)) + (logs[known] > unknown)
            # the rare words of each text once, with how often they stand there
            codes = len(logs) + len(left)
            pairs, first, k = np.unique(doc[rare] * codes + spot[rare], return_index=True, return_counts=True)
            cuts = np.concatenate([[0], np.cumsum(np.bincount(pairs // codes, minlength=len(n)))]).astype(np.int32)
            words = pa.StructArray.from_arrays([left.take(pa.array(first)), pa.array(k.astype(np.int64))], names=["word", "k"])
            kind = _kind(shared)
            packed = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer((at * kind.itemsize).astype(np.int32)), pa.py_buffer(ids.astype(kind))])
            kept = np.repeat(b.column("learned")[part].to_numpy(zero_copy_only=False), np.diff(at))
            tally = np.bincount(ids[kept], minlength=shared.value[4][-1] + 1).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c)[part] for c in ("doc_id", "fp", "h")), pa.array(n + 1), pa.array(seen.astype(np.int64)), pa.array(base), pa.ListArray.from_arrays(pa.array(cuts), words), packed, pa.array([tally.tobytes()] + [None] * (len(n) - 1), pa.binary())],
                names=["doc_id", "fp", "h", "n_tokens", "n_common", "base_common", "rare", "ids", "tally"],
            )

    return run


def _unpacked(batches, shared):
    """Some texts at a time, by length: the batch, its rows, ids and where texts begin."""
    kind = _kind(shared)
    for b in batches:
        packed, n = b.column("ids"), len(b)
        upto = np.frombuffer(packed.buffers()[1], np.int32)[packed.offset : packed.offset + n + 1] // kind.itemsize
        flat = np.frombuffer(packed.buffers()[2], kind, upto[-1])
        for a, z in _chunks(b.column("n_tokens").to_numpy() - 1, 400_000):
            yield b, slice(a, z), flat[upto[a] : upto[z]].astype(np.int32), (upto[a : z + 1] - upto[a]).astype(np.int64)


def _regrouped(batches, rows: int = 10_000):
    """The same rows in batches of so many, however the session cuts them."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        while len(b):
            held.append(b.slice(0, rows - sum(map(len, held))))
            b = b.slice(len(held[-1]))
            if sum(map(len, held)) == rows:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held = []
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _learn(shared, first):
    """Goes on from the first fit over all windows of the task's texts: rows of
    (place, sum), the weights times the number of windows; place -1 is that number."""

    def run(batches):
        model = first.value
        fit = Adam({k: v.copy() for k, v in model.weights.items()})
        draw, seen = np.random.default_rng(11), 0
        for _, _, ids, at in _unpacked(_regrouped(batches), shared):
            x, y, _ = windows(ids, at, model.fine)
            order, target = draw.permutation(len(x)), model.cls[ids]
            for part in np.array_split(order, -(-len(order) // BATCH)):
                fit.learn(x[part], y[part], target, RATE * min(1, (fit.step + 1) / 20) / (1 + fit.step / 50) ** 0.5)
            seen += len(x)
        if seen:
            flat = np.concatenate([v.ravel() for v in fit.w.values()])
            sums = np.rint(flat.astype(np.float64) * FIXED).astype(np.int64) * seen
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, len(sums)), pa.int32()), pa.array(np.concatenate([[seen], sums]))], names=["place", "sum"])

    return run


def learn_all(training: DataFrame, shared, model: Model, docs: int) -> tuple[Model, int]:
    """The model after every window of every training document, and how many those are.
    docs: the number of rows of training, which are encoded."""
    first = training.sparkSession.sparkContext.broadcast(model)
    dealt = training.select("ids", "n_tokens", "h").repartition(max(1, -(-docs // SHARE)), "h").sortWithinPartitions("h")
    got = dealt.select("ids", "n_tokens").mapInArrow(tidy(_learn(shared, first)), "place int, sum bigint")
    sums = {r["place"]: int(r["sum"]) for r in got.groupBy("place").agg(F.sum(F.col("sum").cast("decimal(38,0)")).alias("sum")).collect()}  # as many rows as weights
    if not sums:
        return model, 0
    seen = sums[-1]
    flat = np.array([sums[i] / seen / FIXED for i in range(len(sums) - 1)], np.float32)
    w, a = {}, 0
    for k, v in model.weights.items():
        w[k] = flat[a : a + v.size].reshape(v.shape)
        a += v.size
    return Model(w, model.cls, model.fine, model.within), seen


def _score(shared, fitted):
    def run(batches):
        for b, part, ids, at in _unpacked(batches, shared):
            score = pa.array(log10_probability(fitted.value, ids, at))
            yield pa.RecordBatch.from_arrays([*(b.column(c)[part] for c in KEPT), score], names=[*KEPT, "score"])

    return run


def report(docs: DataFrame, model_file: str = MODEL) -> DataFrame:
    """One row per document: token counts, base score and the model's score."""
    import sentencepiece

    spark = docs.sparkSession
    short_batches(spark)
    some = docs.select("doc_id", "text", F.xxhash64("text").alias("fp"), F.xxhash64("doc_id", "text").alias("h"), (~held_out(F.col("doc_id"))).alias("learned"))
    training = some.where("learned")
    counts = word_counts(training)
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v"), F.coalesce(F.sum(F.when(F.col("word") == F.lit(bytearray(END)), F.col("c"))), F.lit(0)).alias("docs")).first()
    with open(model_file, "rb") as f:
        proto = spark.sparkContext.broadcast(f.read())
    spm = sentencepiece.SentencePieceProcessor(model_proto=proto.value)
    got = counts.where(F.col("word") != F.lit(bytearray(END))).orderBy(F.desc("c"), "word").limit(FREQUENT).toArrow()
    top, often = got.column("word").combine_chunks(), got.column("c").to_numpy()
    floor = total["n"] + 0.5 * (total["v"] + 1)
    logs = np.log10((np.append(often, total["docs"]) + 0.5) / floor)
    ids = [*_ids(spm, top, spm.get_piece_size()), [spm.get_piece_size()]]
    begin = np.concatenate([[0], np.cumsum([len(x) for x in ids])])
    flat = _flat(ids)
    unknown = float(np.log10(0.5 / floor))
    shared = spark.sparkContext.broadcast((proto.value, top, logs, begin, flat, unknown))
    kind = dict(docs.dtypes)["doc_id"]
    x = stored(some.mapInArrow(tidy(_encode_all(shared)), f"doc_id {kind}, fp bigint, h bigint, n_tokens bigint, n_common bigint, base_common double, rare array<struct<word:binary,k:bigint>>, ids binary, tally binary"))
    by_id = id_counts(x, len(spm) + 1)
    chosen = F.shiftrightunsigned(F.xxhash64("fp", F.lit(3)), 1)
    most = min(2**63 - 1, 2 * TRAIN_DOCS * 2**63 // max(1, total["docs"]))
    texts = training.where(chosen <= F.lit(most)).orderBy(chosen, "fp").limit(TRAIN_DOCS).select("text").toArrow()
    model = train(*_encode(spm, [split(x.as_py()) for x in texts.column("text")]), by_id)
    del texts
    model, _ = learn_all(x.where(~held_out(F.col("doc_id"))), shared, model, total["docs"])
    fitted = spark.sparkContext.broadcast(model)
    scored = x.select(*KEPT, "ids").mapInArrow(tidy(_score(shared, fitted)), f"doc_id {kind}, fp bigint, n_tokens bigint, n_common bigint, base_common double, score double")
    rare = x.select("doc_id", "fp", F.inline("rare"))
    copies = x.groupBy("doc_id", "fp").agg(F.count("*").alias("copies"))
    logp = F.log10((F.coalesce("c", F.lit(0)) + 0.5) / F.lit(floor))
    sums = rare.join(counts, "word", "left").groupBy("doc_id", "fp").agg(F.sum(F.col("k") * logp).alias("more"), F.sum(F.when(F.col("c") > 0, F.col("k")).otherwise(0)).alias("n_more"))
    key = F.col("doc_id").eqNullSafe(F.col("__d")) & F.col("fp").eqNullSafe(F.col("__f"))
    named = sums.join(copies.withColumnsRenamed({"doc_id": "__d", "fp": "__f"}), key).select("__d", "__f", (F.col("more") / F.col("copies")).alias("more"), (F.col("n_more") / F.col("copies")).cast("long").alias("n_more"))
    return scored.join(named, key, "left").select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "n_tokens",
        (F.col("n_common") + F.coalesce("n_more", F.lit(0))).cast("long").alias("n_known"),
        F.lit(total["n"]).cast("long").alias("train_tokens"),
        (F.col("base_common") + F.coalesce("more", F.lit(0.0))).alias("base_score"),
        "score",
    )
