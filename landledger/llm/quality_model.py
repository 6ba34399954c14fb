"""Quality scores from random-indexing word vectors and a two-layer network.

1. Texts are cut into words, punctuation runs and shape marks (capitals, a word repeated at once); Arrow kernels find the distinct
   words of a slice of texts, which are looked at once.  Each token gets a slot by hash (``SLOTS`` of them; a slot stands for several
   words where the vocabulary is larger) and each slot a sparse random index vector that depends on the slot alone.
2. Every document of the corpus adds, for each token, the index vectors of its neighbours to the token's
   context vector: one pass, partial sums per task, one row per slot and task shuffled.  The slots bound the vectors'
   memory whatever the vocabulary is; no word is dropped.
3. A document is the pooled mean of its tokens' vectors (context plus index), joined by their spread.
4. A two-layer network (numpy) learns from a bounded sample of labelled documents, those with the smallest
   hashes of their ids; a held-out part of that sample calibrates a temperature and a bias.

Labels, language, source and id are never inputs of a score.  Odd inputs: null and empty texts get the score
of the empty pool.  An empty table gives an empty table.  Very long texts are slices of their own.  With labels of one class only, or none, every score is 0.5; with so few that no held-out row of each class is left,
all are learned from and the temperature is ``FEW_HEAT``.  Repeated rows get the same score each.  Other columns are ignored (in the filter kept).  Null ids are never trained on.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pandas.util import hash_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runs import Runs, chosen, cut, distinct, list_ends, runs_of, slices, strings
from .shared import materialise, numbered

SLOTS, WIDTH, NONZERO, REACH = 16_384, 32, 4, 2
#: Labelled documents that are learned from, at most.
MOST_LABELS = 6000
FEW_HEAT = 2.0
HIDDEN, EPOCHS, BATCH, STEP, DECAY = 24, 60, 64, 0.01, 1e-4
PRIOR_TOKENS = 6
#: Texts are worked on together up to so many bytes.
SLICE_BYTES = 1 << 20
#: Tokens whose vectors are in memory at a time (unless one text has more).
POOL_TOKENS = 100_000
_TOKENS = re.compile(r"[^\W_]+|[^\w\s]+|_+")
#: Words of printable ASCII and accented Latin letters, and the same tokens in the form that Arrow's kernels take.
PLAIN = "^[!-~À-ÖØ-öø-ÿ]+$"
PLAIN_TOKEN = "([0-9A-Za-zÀ-ÖØ-öø-ÿ]+|_+|[^0-9A-Za-zÀ-ÖØ-öø-ÿ_]+)"
UPPER, REPEATED, EMPTY = SLOTS - 1, SLOTS - 2, SLOTS - 3


def index_vectors() -> np.ndarray:
    out = np.zeros((SLOTS, WIDTH), np.float32)
    at, sign = _sparse_index()
    np.put_along_axis(out, at, sign.astype(np.float32), 1)
    return out


def _sparse_index() -> tuple[np.ndarray, np.ndarray]:
    """For each slot the places of its components that aren't 0, and their signs."""
    rng = np.random.default_rng(20240229)
    at = rng.random((SLOTS, WIDTH)).argsort(1)[:, :NONZERO]
    return at, rng.choice([-1.0, 1.0], (SLOTS, NONZERO))


def token_slots(tokens: list[str]) -> Runs:
    """Each token's slot, and behind that of a word in capitals the mark for it.  An empty token has none."""
    n = np.fromiter(map(len, tokens), np.int64, len(tokens))
    word = np.fromiter((t[:1].isalnum() for t in tokens), bool, len(tokens))
    capitals = np.fromiter((len(t) > 1 and t[0].isalnum() and t.isupper() for t in tokens), bool, len(tokens))
    # a run of one mark counts as that mark, doubled where it is longer
    keys = np.array([t.lower() if w else t[:1] * min(len(t), 2) for t, w in zip(tokens, word.tolist(), strict=True)], object)
    hashed = hash_array(keys, categorize=False) if len(keys) else np.zeros(0, np.uint64)
    slot = np.where(word, hashed % np.uint64(SLOTS - 64), np.uint64(SLOTS - 64) + hashed % np.uint64(60)).astype(np.uint16)
    lengths = (n > 0) + capitals.astype(np.int64)
    ends = np.cumsum(lengths)
    flat = np.full(int(lengths.sum()), UPPER, np.uint16)
    flat[(ends - lengths)[n > 0]] = slot[n > 0]
    return Runs(flat, ends)


def slots_of(texts: pa.Array) -> Runs:
    """The slots of each text (one slice of them); a text without words has ``EMPTY``."""
    split = pc.utf8_split_whitespace(texts)
    number, words = distinct(split.flatten())
    plain = pc.match_substring_regex(words, PLAIN)
    lists = cut(words.filter(plain), PLAIN_TOKEN)
    token_number, tokens = distinct(lists.flatten())
    of_plain = token_slots(strings(tokens)).take(token_number).joined(list_ends(lists))
    odd = [_TOKENS.findall(w) for w in strings(words.filter(pc.invert(plain)))]
    of_rest = token_slots([t for ts in odd for t in ts]).joined(np.cumsum(np.fromiter(map(len, odd), np.int64, len(odd))))
    table, place = chosen(plain.to_numpy(zero_copy_only=False).astype(bool), of_plain, of_rest)
    # Each word twice: as it is, and as it counts behind itself.
    n = len(table.ends)
    both = Runs(np.concatenate([table.flat, np.insert(table.flat, table.ends, REPEATED)]), np.concatenate([table.ends, len(table.flat) + table.ends + np.arange(1, n + 1)]))
    ends = list_ends(split)
    same = np.append(False, number[1:] == number[:-1])[: len(number)] & (table.lengths[place] > 0)[number]
    same[ends[:-1][ends[:-1] < len(number)]] = False
    flat = both.take(place[number] + n * same).joined(ends)
    bare = np.flatnonzero(flat.lengths == 0)
    if len(bare):  # put EMPTY where a text has nothing
        flat = Runs(np.insert(flat.flat, flat.ends[bare], EMPTY), flat.ends + np.cumsum(flat.lengths == 0))
    return flat


def _add_contexts(total: np.ndarray, slots: Runs, at: np.ndarray, sign: np.ndarray) -> None:
    """Add to each token's row the index vectors of up to REACH tokens on either side in its text."""
    flat, owner = slots.flat.astype(np.int64), np.repeat(np.arange(len(slots.ends)), slots.lengths)
    for k in range(1, REACH + 1):
        inside = owner[k:] == owner[:-k]
        left, right = flat[:-k][inside], flat[k:][inside]
        for a, b in ((left, right), (right, left)):
            for j in range(NONZERO):
                total += np.bincount(a * WIDTH + at[b, j], sign[b, j], total.size)


def context_vectors(texts: DataFrame) -> np.ndarray:
    """SLOTS x WIDTH: the corpus's context vectors, each of length one.  ``texts`` has the column ``text``.

    A task sends SLOTS rows at most; sums per slot are made again on the other side.  What reaches the driver
    is SLOTS rows, whatever the corpus.
    """

    def partial(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, sign = _sparse_index()
        total = np.zeros(SLOTS * WIDTH)
        for b in batches:
            for some in slices(b.column(0).drop_null(), SLICE_BYTES):
                _add_contexts(total, slots_of(some), at, sign)
        total = total.reshape(SLOTS, WIDTH)
        used = np.flatnonzero(np.abs(total).sum(1))
        vectors = pa.FixedSizeListArray.from_arrays(pa.array(total[used].ravel()), WIDTH).cast(pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), vectors], names=["slot", "v"])

    rows = texts.select("text").mapInArrow(partial, "slot int, v array<double>")
    sums = rows.groupBy("slot").agg(*[F.sum(F.get("v", k)).alias(f"v{k}") for k in range(WIDTH)])
    got = sums.toPandas()
    out = np.zeros((SLOTS, WIDTH))
    out[got["slot"].to_numpy(int)] = got.drop(columns="slot").to_numpy(float)
    return (out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def pooled(slots: Runs, vectors: np.ndarray) -> np.ndarray:
    """A row for each text: its tokens' mean, their spread, and their number."""
    out = np.empty((len(slots.ends), 2 * WIDTH + 1))
    lengths = slots.lengths
    starts = slots.ends - lengths
    done = 0
    while done < len(starts):  # some tokens at a time
        stop = max(done + 1, int(np.searchsorted(slots.ends, starts[done] + POOL_TOKENS, "right")))
        v = vectors[slots.flat[starts[done] : slots.ends[stop - 1]]]
        at, n = starts[done:stop] - starts[done], lengths[done:stop, None]
        mean = np.add.reduceat(v, at, axis=0, dtype=np.float64) / n
        square = np.add.reduceat(v * v, at, axis=0, dtype=np.float64) / n
        out[done:stop] = np.hstack([mean, np.sqrt(np.maximum(square - mean * mean, 0)), np.log1p(n) / 10])
        done = stop
    return out


class Network:
    """Input, a tanh layer, one logit; Adam on the log loss, classes weighted alike."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, w: list[np.ndarray]):
        self.mean, self.scale, self.w = mean, scale, w
        self.heat, self.bias = 1.0, 0.0

    def _input(self, x: np.ndarray) -> np.ndarray:
        """Standardised, and drawn towards the average document where few tokens tell little."""
        n = np.expm1(x[:, -1:] * 10)
        return (x - self.mean) / self.scale * (n / (n + PRIOR_TOKENS))

    def logit(self, x: np.ndarray) -> np.ndarray:
        z = self._input(x)
        return np.tanh(z @ self.w[0] + self.w[1]) @ self.w[2] + self.w[3][0]

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x) / self.heat + self.bias, -30, 30)))

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray) -> Network:
        rng = np.random.default_rng(5)
        held = np.arange(len(y)) % 5 == 4
        if len({*y[held]}) < 2 or len({*y[~held]}) < 2:  # too few labels to hold some back
            held[:] = False
        xs, ys = x[~held], y[~held]
        net = cls(xs.mean(0), xs.std(0) + 1e-3, [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)])
        z = net._input(xs)
        share = np.clip(ys.mean(), 0.02, 0.98)
        weight = np.where(ys > 0, 0.5 / share, 0.5 / (1 - share))
        m, v, t = [np.zeros_like(a) for a in net.w], [np.zeros_like(a) for a in net.w], 0
        for _ in range(EPOCHS):
            order = rng.permutation(len(ys))
            for k in range(0, len(order), BATCH):
                b = order[k : k + BATCH]
                h = np.tanh(z[b] @ net.w[0] + net.w[1])
                p = 1 / (1 + np.exp(-np.clip(h @ net.w[2] + net.w[3][0], -30, 30)))
                d = weight[b] * (p - ys[b]) / len(b)
                back = np.outer(d, net.w[2]) * (1 - h * h)
                grads = [z[b].T @ back + DECAY * net.w[0], back.sum(0), h.T @ d + DECAY * net.w[2], np.array([d.sum()])]
                t += 1
                for i, g in enumerate(grads):
                    m[i] = 0.9 * m[i] + 0.1 * g
                    v[i] = 0.999 * v[i] + 0.001 * g * g
                    net.w[i] = net.w[i] - STEP * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
        if held.any():
            net._calibrate(x[held], y[held])
        else:
            net.heat = FEW_HEAT
        return net

    def _calibrate(self, x: np.ndarray, y: np.ndarray) -> None:
        """The temperature (and bias, as training weighted the classes alike) with the least log loss on held-out rows."""
        z = self.logit(x)
        best = np.inf
        for heat in np.geomspace(0.5, 16, 41):
            for bias in np.linspace(-3, 3, 25):
                q = np.clip(z / heat + bias, -30, 30)
                loss = float(np.mean(np.logaddexp(0, q) - y * q))
                if loss < best - 1e-12:
                    best, self.heat, self.bias = loss, float(heat), float(bias)


class Model:
    def __init__(self, vectors: np.ndarray, net: Network | None):
        self.vectors, self.net = vectors, net

    def scores(self, texts: pa.Array) -> np.ndarray:
        if self.net is None:
            return np.full(len(texts), 0.5)
        return np.concatenate([np.zeros(0), *(self.net.probability(pooled(slots_of(some), self.vectors)) for some in slices(texts, SLICE_BYTES))])


def held_out(id_col: str):
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    vectors = context_vectors(texts) + index_vectors() / np.float32(np.sqrt(NONZERO))
    known = labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").alias("y")).filter("id is not null and y is not null")
    known = known.filter(~held_out("id")).groupBy("id").agg(F.max("y").alias("y"))
    # A bounded sample (documented above): the labelled ids with the smallest hashes that are in the documents.
    some = known.join(texts.select("id").distinct(), "id", "left_semi").orderBy(F.xxhash64("id"), "id").limit(MOST_LABELS)
    some = materialise(some, "quality-labels")
    got = texts.join(F.broadcast(some), "id")  # MOST_LABELS rows of two numbers

    def features(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [row for some in slices(b.column(1), SLICE_BYTES) for row in pooled(slots_of(some), vectors)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(x, pa.list_(pa.float64())), b.column(2)], names=["id", "x", "y"])

    kind = got.schema["id"].dataType.simpleString()
    rows = got.select("id", "text", F.col("y").cast("int").alias("y")).mapInArrow(features, f"id {kind}, x array<double>, y int")
    table = rows.groupBy("id").agg(F.min("x").alias("x"), F.max("y").alias("y")).toPandas().sort_values("id")
    y = table["y"].to_numpy(float) if len(table) else np.zeros(0)
    if not len(y) or y.min() == y.max():
        return Model(vectors, None)
    order = np.random.default_rng(11).permutation(len(y))
    return Model(vectors, Network.fit(np.stack(table["x"].to_list())[order], y[order]))


def score_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", model: Model | None = None) -> DataFrame:
    """Columns: the id, held_out, score, predicted."""
    model = model or train(docs, labels, id_col, text_col, label_col)

    def per_batch(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.scores(b.column(1)), pa.float64())], names=["id", "score"])

    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    out = rows.mapInArrow(per_batch, f"id {rows.schema['id'].dataType.simpleString()}, score double")
    return out.select(F.col("id").alias(id_col), held_out("id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` with a score of at least ``least``, all columns as they are."""
    model = train(docs, labels, id_col, text_col, label_col)
    at = docs.columns.index(text_col)

    def per_batch(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(model.scores(b.column(at)) >= least))

    rows = numbered(docs)
    return rows.mapInArrow(per_batch, rows.schema).toDF(*docs.columns)
