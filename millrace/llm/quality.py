"""Quality classifier: a factorisation machine over hashed words and the structure of a text.

score = sigmoid(b + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j), where x holds
the text's hashed words (square roots of counts, to length one), statistics of
its structure and, as metadata, its length. The pair sum is
half of sum_f (sum_i v_if x_i)^2 - sum_i (v_if x_i)^2, so a text costs time in
proportion to its words.

Whole texts are scored where they lie; nothing shuffles. The model is fitted
in one task on at most ``max_rows`` labelled texts, the least by a hash of
their id (a documented bound), by steps on small batches; it has a fixed size.

Null and empty texts have no words and all statistics 0; they get the score
of that. Null labels or ids are not learned from. Without labelled texts of both
kinds every score is the share of label 1 (one half if there are none).
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.arrow import lean
from millrace.llm.words import NOT_SPACE, Words, mix, words_of

MAX_ROWS = 4_000
BUCKETS, RANK, EPOCHS, BATCH = 1 << 14, 8, 8, 128
RATE, DECAY, INIT = 0.08, 2e-5, 0.02

#: Kinds of bytes: other, blank, line end, small letter, capital, digit, sentence mark, symbol, bracket or bar, beyond ASCII.
KINDS = 10


def _kind_table() -> np.ndarray:
    table = np.zeros(256, np.int64)
    groups = (b" \t", b"\n\r", b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".,;:?!'\"", b"#$%&*+=@^~_", b"()[]{}<>|/\\")
    for kind, chars in enumerate(groups, 1):
        table[list(chars)] = kind
    table[128:] = 9
    return table


KIND = _kind_table()
STATISTICS = KINDS + 10


def features(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text, bucket and value of the hashed words, and the statistics of each text."""
    n, counts, text = words.n_texts, words.counts, words.text_of()
    bucket = (mix(words.hashes) % np.uint64(BUCKETS)).astype(np.int64)
    key, times = np.unique(text * BUCKETS + bucket, return_counts=True)
    of = key // BUCKETS
    value = np.sqrt(times) / np.sqrt(np.maximum(counts, 1))[of]

    size = np.diff(words.text_bounds)
    owner = np.repeat(np.arange(n), size)
    kinds = np.bincount(owner * KINDS + KIND[words.data], minlength=n * KINDS).reshape(n, KINDS)
    length = np.maximum(size, 1)[:, None]
    some = np.maximum(counts, 1)
    same = np.zeros(len(text), bool)
    if len(text) > 1:
        same[1:] = (words.hashes[1:] == words.hashes[:-1]) & (text[1:] == text[:-1])
    long_ = words.ends - words.starts
    last = KIND[words.data[words.ends - 1]] if len(text) else text
    first = KIND[words.data[words.starts]] if len(text) else text
    per = lambda flag: np.bincount(text, weights=flag, minlength=n) / some
    distinct = np.bincount(of, minlength=n) / some
    most = np.zeros(n)
    np.maximum.at(most, of, times)
    statistics = np.column_stack(
        [
            kinds / length,
            per(same), per(long_) / 10, per(long_ > 12), per(last == 7), per(last == 6), per(first == 4), per(long_ == 1),
            distinct, most / some, np.log1p(size) / 10,
        ]
    )
    statistics[counts == 0] = 0
    return of, key % BUCKETS, value, statistics


class Model:
    """Weights and factors of the hashed words and of the statistics, which are scaled first."""

    def __init__(self, share: float = 0.5) -> None:
        share = min(max(share, 1e-3), 1 - 1e-3)
        self.bias = float(np.log(share / (1 - share)))
        self.weight = np.zeros(BUCKETS + STATISTICS, np.float32)
        self.factor = np.zeros((BUCKETS + STATISTICS, RANK), np.float32)
        self.mean, self.spread = np.zeros(STATISTICS), np.ones(STATISTICS)

    def sums(self, of, bucket, value, scaled):
        """Linear part, factor sums and their square sums of each text."""
        n = len(scaled)
        starts = np.searchsorted(of, np.arange(n))
        empty = np.bincount(of, minlength=n) == 0
        part = self.factor[bucket] * value[:, None]

        def total(x: np.ndarray) -> np.ndarray:
            if not len(x):
                return np.zeros((n,) + x.shape[1:])
            out = np.add.reduceat(x, np.minimum(starts, len(x) - 1), axis=0)
            out[empty] = 0
            return out

        own = scaled[:, :, None] * self.factor[None, BUCKETS:]
        linear = self.bias + total(self.weight[bucket] * value) + scaled @ self.weight[BUCKETS:]
        return linear, total(part) + own.sum(1), total(part * part) + (own * own).sum(1)

    def scale(self, statistics: np.ndarray) -> np.ndarray:
        return np.clip((statistics - self.mean) / self.spread, -4, 4) / 3

    def score(self, of, bucket, value, statistics) -> np.ndarray:
        linear, first, second = self.sums(of, bucket, value, self.scale(statistics))
        return 1 / (1 + np.exp(-np.clip(linear + 0.5 * (first * first - second).sum(1), -30, 30)))


def fit(texts: list[str | None], labels: list[int]) -> Model:
    """Least logistic loss by adaptive steps over small batches, in a fixed order."""
    y = np.array(labels, np.float64)
    model = Model(float(y.mean()) if len(y) else 0.5)
    if len(np.unique(y)) < 2:
        return model
    of, bucket, value, statistics, first = [], [], [], [], 0
    for words in words_of(pa.array(texts, pa.string()), NOT_SPACE, True):
        o, b, v, s = features(words)
        of.append(o + first)
        bucket.append(b)
        value.append(v)
        statistics.append(s)
        first += words.n_texts
    of, bucket, value, statistics = (np.concatenate(x) for x in (of, bucket, value, statistics))
    model.mean, model.spread = statistics.mean(0), statistics.std(0) + 1e-3
    scaled = model.scale(statistics)
    random = np.random.default_rng(3)
    model.factor = random.normal(0, INIT, model.factor.shape).astype(np.float32)
    bounds = np.searchsorted(of, np.arange(len(y) + 1))
    past = [1e-6, np.full_like(model.weight, 1e-6), np.full_like(model.factor, 1e-6)]
    for _ in range(EPOCHS):
        order = random.permutation(len(y))
        for at in range(0, len(y), BATCH):
            rows = order[at : at + BATCH]
            n = bounds[rows + 1] - bounds[rows]
            cell = np.arange(int(n.sum())) + np.repeat(bounds[rows] - (np.cumsum(n) - n), n)
            o, b, v, s = np.repeat(np.arange(len(rows)), n), bucket[cell], value[cell], scaled[rows]
            linear, total, second = model.sums(o, b, v, s)
            p = 1 / (1 + np.exp(-np.clip(linear + 0.5 * (total * total - second).sum(1), -30, 30)))
            error = (p - y[rows]) / len(rows)
            weight = np.bincount(b, weights=error[o] * v, minlength=len(model.weight))
            weight[BUCKETS:] = error @ s
            pull = (error[o] * v)[:, None] * (total[o] - model.factor[b] * v[:, None])
            factor = np.column_stack([np.bincount(b, weights=pull[:, f], minlength=len(model.weight)) for f in range(RANK)])
            own = s[:, :, None] * (total[:, None, :] - model.factor[None, BUCKETS:] * s[:, :, None])
            factor[BUCKETS:] = (error[:, None, None] * own).sum(0)
            steps = [error.sum(), weight + DECAY * model.weight, factor + DECAY * model.factor]
            for i, g in enumerate(steps):
                past[i] = past[i] + g * g
            model.bias -= RATE * steps[0] / np.sqrt(past[0])
            model.weight -= (RATE * steps[1] / np.sqrt(past[1])).astype(np.float32)
            model.factor -= (RATE * steps[2] / np.sqrt(past[2])).astype(np.float32)
    return model


def _fit_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = [(h, t, y) for b in batches for h, t, y in zip(*(b.column(i).to_pylist() for i in range(3)))]
    rows.sort(key=lambda r: (r[0], r[1] or ""))
    model = fit([r[1] for r in rows], [r[2] for r in rows])
    yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)])], names=["model"])


def least(rows: DataFrame, n: int) -> DataFrame:
    """The ``n`` rows of least ``h``, ties by a hash of the row: the bound is found on ``h`` alone, so only what is within it is sorted."""
    bound = rows.select("h").orderBy("h").limit(n).agg(F.max("h")).first()[0]
    within = rows.filter(F.col("h") <= F.lit(bound).cast("long"))
    return within.orderBy("h", F.xxhash64(*rows.columns)).limit(n)


def train(labelled: DataFrame, text: str = "text", label: str = "quality", key: str = "doc_id", max_rows: int = MAX_ROWS) -> Model:
    """Fit on at most ``max_rows`` labelled rows, those of least hash of the key."""
    rows = labelled.filter(F.col(label).isin(0, 1) & F.col(key).isNotNull())
    rows = rows.select(F.xxhash64(F.col(key).cast("string")).alias("h"), F.col(text).alias("t"), F.col(label).cast("int").alias("y"))
    made = least(rows, max_rows).coalesce(1).mapInArrow(_fit_rows, "model binary").collect()
    return pickle.loads(made[0][0]) if made else Model()


def _scores(sent):
    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            out = [model.score(*features(words)) for words in words_of(batch.column(batch.num_columns - 1), NOT_SPACE, True)]
            score = pa.array(np.concatenate(out) if out else np.zeros(0))
            names = batch.schema.names
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], score], names=[*names[:-1], "score"])

    return scores


def score(docs: DataFrame, model: Model, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """The carried columns (all by default) and ``score`` from 0 to 1, higher where label 1 is likelier."""
    carry = [c for c in (docs.columns if carry is None else carry) if c != "score"]
    rows = docs.select(*carry, F.col(text).alias("__text"))
    sent = docs.sparkSession.sparkContext.broadcast(model)
    fields = [f for f in rows.schema.fields if f.name != "__text"]
    schema = type(rows.schema)(fields).add("score", "double")
    return rows.mapInArrow(lean(_scores(sent)), schema)


def held_out(key: str = "doc_id") -> Column:
    """Every third document, by the checksum of its id as text."""
    return F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(3)) == 1
