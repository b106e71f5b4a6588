"""Toxicity: a linear classifier learned from confirmed toxic texts and unlabelled ones.

The risk is the non-negative positive-unlabelled estimator: with class prior p,
``p * R(toxic as toxic) + max(0, R(unlabelled as clean) - p * R(toxic as clean))``. Where the
second part falls below zero, the step goes back up along it, so that the model cannot buy a
negative risk by learning the unlabelled texts by heart. Texts labelled clean take part only as
what they are in the unlabelled sample.

A text's score is the logistic of a bias and weighted features: the share of its words that are a
given word, or begin with given 4, 5 or 6 bytes, up to ``MOST``. Only text is looked at.

Training happens in one task, on samples bounded in texts and in bytes, so its memory does not
depend on the table or on how long its texts are. The driver gets the weights that are not zero.

Null and empty texts score as the bias alone. Empty tables give an empty result, and columns other than
those named are not looked at; a kept column named like the score gets the suffix ``_input``. Repeated label rows of one id count once (toxic if
any says so); null labels are no labels. Without any toxic example every score is 0.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.llm.common import SALT, blocks, mixed, raw, sample_rows, set_aside, span_hashes, strings, within, words

#: Bounds of the training sample: toxic texts, unlabelled texts, characters of each text, and bytes of either kind together.
TOXIC, UNLABELLED, CHARS = 3000, 6000, 20_000
TOXIC_BYTES, UNLABELLED_BYTES = 6 << 20, 14 << 20
#: Entries of the feature matrix that are multiplied at a time in training.
SLICE = 1 << 18
BITS = 20
PREFIXES = (4, 5, 6)
#: A feature's value is its share of the words up to MOST, times SCALE.
MOST, SCALE = 0.02, 50.0
#: Steps, the size of the first (it falls to 0), and the pull of weights towards 0.
STEPS, RATE, PULL = 300, 0.05, 1e-3
#: A feature is used if this many of the toxic texts have it (all, if there are fewer), at every sample size.
LEAST = 5


def features(texts: pa.Array, used: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashed feature, text, value), each feature of a text once; only those ``used``, if given."""
    data, offsets = raw(pc.utf8_lower(texts))
    a, b, h, owner = words(data, offsets)
    kinds = [h]
    for size in PREFIXES:
        kinds.append(np.where(b - a > size, span_hashes(SALT[data], a, np.minimum(a + size, b)) + np.uint64(size), h))
    index = np.concatenate([(mixed(k + np.uint64(j)) >> np.uint64(64 - BITS)).astype(np.int64) for j, k in enumerate(kinds)])
    count = np.maximum(np.bincount(owner, minlength=len(texts)), 1)
    owner = np.tile(owner, len(kinds))
    if used is not None:
        keep = used[index]
        index, owner = index[keep], owner[keep]
    key, times = np.unique(owner << BITS | index, return_counts=True)
    owner = key >> BITS
    return key & ((1 << BITS) - 1), owner, np.minimum(times / count[owner], MOST) * SCALE


@dataclass
class Classifier:
    weights: np.ndarray
    bias: float

    def __post_init__(self):
        self.used = self.weights != 0

    def scores(self, texts: pa.Array) -> np.ndarray:
        index, owner, value = features(texts, self.used)
        return 1 / (1 + np.exp(-np.clip(self.bias + np.bincount(owner, self.weights[index] * value, len(texts)), -50, 50)))


class Matrix:
    """Features of a sample of texts, row after row: 8 bytes an entry, multiplied slice by slice."""

    def __init__(self, texts: pa.Array, code: np.ndarray):
        """``code``: the number of each used feature, -1 for others."""
        index, value, size = [np.zeros(0, np.int32)], [np.zeros(0, np.float32)], []
        for _, part in blocks(texts):
            feature, owner, share = features(part, code >= 0)
            index.append(code[feature])
            value.append(share.astype(np.float32))
            size.append(np.bincount(owner, minlength=len(part)))
        self.index, self.value = np.concatenate(index), np.concatenate(value)
        self.ends = np.cumsum(np.concatenate([np.zeros(1, np.int64), *size]))
        self.rows = self.ends.size - 1
        # Runs of rows with about SLICE entries; a row has no more than a text has words.
        cuts = np.searchsorted(self.ends, np.arange(0, self.ends[-1] + SLICE, SLICE))
        self.cuts = np.unique(np.clip([*cuts, self.rows], 0, self.rows))

    def _slices(self) -> Iterator[tuple[int, int, slice, np.ndarray]]:
        for a, b in zip(self.cuts[:-1], self.cuts[1:], strict=True):
            yield a, b, slice(self.ends[a], self.ends[b]), np.repeat(np.arange(b - a), np.diff(self.ends[a : b + 1]))

    def times(self, weights: np.ndarray) -> np.ndarray:
        out = np.zeros(self.rows)
        for a, b, part, row in self._slices():
            out[a:b] = np.bincount(row, weights[self.index[part]] * self.value[part], b - a)
        return out

    def summed(self, pull: np.ndarray, n: int) -> np.ndarray:
        """For each feature the sum of its values, each times ``pull`` of its row."""
        out = np.zeros(n)
        for a, b, part, row in self._slices():
            out += np.bincount(self.index[part], pull[a:b][row] * self.value[part], n)
        return out


def risk(z: np.ndarray, n: int, prior: float) -> tuple[float, float]:
    """The two parts of the risk, given the scores of ``n`` toxic and then the unlabelled texts."""
    as_clean = np.logaddexp(0, z)
    return prior * np.logaddexp(0, -z[:n]).mean(), as_clean[n:].mean() - prior * as_clean[:n].mean()


def slope(z: np.ndarray, n: int, prior: float) -> np.ndarray:
    """How the risk moves with each score; where its second part is negative, the way back up along that part."""
    p, m = 1 / (1 + np.exp(-np.clip(z, -50, 50))), z.size - n
    pull = np.empty(z.size)
    if risk(z, n, prior)[1] >= 0:
        pull[:n], pull[n:] = prior * (p[:n] - 1) / n - prior * p[:n] / n, p[n:] / m
    else:
        pull[:n], pull[n:] = prior * p[:n] / n, -p[n:] / m
    return pull


def train(toxic: pa.Array, unlabelled: pa.Array, prior: float, steps: int = STEPS) -> Classifier:
    """Weights that minimise the non-negative risk (logistic loss, Adam, whole sample per step)."""
    weights = np.zeros(1 << BITS)
    n, m = len(toxic), len(unlabelled)
    if n == 0 or m == 0:
        return Classifier(weights, -50.0)
    holding = sum(np.bincount(features(part)[0], minlength=1 << BITS) for _, part in blocks(toxic))
    used = np.flatnonzero(holding >= min(LEAST, n))
    code = np.full(1 << BITS, -1, np.int32)
    code[used] = np.arange(used.size)
    x = Matrix(pa.concat_arrays([toxic, unlabelled]), code)
    w = np.append(np.zeros(used.size), np.log(prior / (1 - prior)))
    first, second = np.zeros_like(w), np.zeros_like(w)
    for k in range(1, steps + 1):
        pull = slope(w[-1] + x.times(w), n, prior)
        gradient = np.append(x.summed(pull, used.size) + PULL * w[:-1], pull.sum())
        first, second = 0.9 * first + 0.1 * gradient, 0.999 * second + 0.001 * gradient**2
        w -= RATE * (1 - k / (steps + 1)) * (first / (1 - 0.9**k)) / (np.sqrt(second / (1 - 0.999**k)) + 1e-9)
    # Shift the scores so that their mean over the unlabelled texts is the prior.
    z = (w[-1] + x.times(w))[n:]
    low, high = -30.0, 30.0
    for _ in range(50):
        middle = (low + high) / 2
        low, high = (middle, high) if (1 / (1 + np.exp(-(z + middle)))).mean() < prior else (low, middle)
    weights[used] = w[:-1]
    return Classifier(weights, float(w[-1] + low))


def fit_classifier(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, usable: Column) -> Classifier:
    """Train on bounded samples, chosen by hash of the key among the rows that are ``usable``.

    The class prior is the share of toxic rows among all usable labelled ones.
    """
    known = labels.filter(usable & F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(key).agg(F.max(label).alias("__toxic"))
    share = known.agg(F.count("*"), F.sum(F.when(F.col("__toxic") == 1, 1).otherwise(0))).first()
    if not share[0] or not share[1]:
        return Classifier(np.zeros(1 << BITS), -50.0)
    short = docs.filter(usable & (F.length(text) <= CHARS)).select(key, text)
    some = F.broadcast(known.filter("__toxic = 1").orderBy(F.xxhash64(F.col(key), F.lit(3)), key).limit(TOXIC).select(key))
    rows = [
        sample_rows(short.join(some, key, "left_semi"), key, text, TOXIC, TOXIC_BYTES).withColumn("kind", F.lit(0)),
        sample_rows(short, key, text, UNLABELLED, UNLABELLED_BYTES).withColumn("kind", F.lit(1)),
    ]
    prior = min(max(share[1] / share[0], 1e-4), 0.9)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # An order of rows of its own, whatever the order of the parts.
        held = sorted(row for batch in batches for row in zip(*(batch.column(c).to_pylist() for c in ("kind", "spread", "text")), strict=True))
        toxic, unlabelled = ([t for k, _, t in held if k == kind] for kind in (0, 1))
        model = train(pa.array(within(toxic, TOXIC_BYTES), pa.large_string()), pa.array(within(unlabelled, UNLABELLED_BYTES), pa.large_string()), prior)
        used = np.flatnonzero(model.used)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(used, -1).astype(np.int32)), pa.array(np.append(model.weights[used], model.bias))], names=["feature", "weight"])

    learned = rows[0].unionByName(rows[1]).coalesce(1).mapInArrow(run, "feature int, weight double").toArrow()
    feature, weight = (learned.column(c).to_numpy() for c in ("feature", "weight"))
    weights = np.zeros(1 << BITS)
    weights[feature[feature >= 0]] = weight[feature >= 0]
    return Classifier(weights, float(weight[feature < 0][0]) if weight.size else -50.0)


def score_toxicity(df: DataFrame, text: str, model: Classifier, keep: Sequence[str] = (), name: str = "score") -> DataFrame:
    """``keep`` columns and the score of each row; one narrow pass.

    The weights that are not zero go to the executors once, as a broadcast variable of a size
    bounded by the training sample.
    """
    used = np.flatnonzero(model.used)
    shipped = df.sparkSession.sparkContext.broadcast((used, model.weights[used], model.bias))
    df = set_aside(df, name)
    keep = [f"{c}_input" if c.lower() == name.lower() else c for c in keep]
    schema = T.StructType([*[df.schema[c] for c in keep], T.StructField(name, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, values, bias = shipped.value
        weights = np.zeros(1 << BITS)
        weights[at] = values
        local = Classifier(weights, bias)
        for batch in batches:
            parts = [local.scores(part) for _, part in blocks(strings(batch.column(len(keep))))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(np.concatenate(parts) if parts else np.zeros(0), pa.float64())], names=schema.names)

    return df.select(*[df[c] for c in keep], df[text].alias("__text")).mapInArrow(run, schema)
