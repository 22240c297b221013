"""Quality classifier by positive-unlabelled learning.

An additive model over binned style features of the whole text is fitted by
minimising the non-negative unbiased risk

    prior * mean_P loss(g) + max(0, mean_U loss(-g) - prior * mean_P loss(-g))

with the logistic loss, from trusted positives, unlabelled documents and an
estimated class prior.  The fit sees at most ``max_rows`` rows of each kind (a
bound that does not grow with the corpus); every document is scored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import materialize, mix64, prefix_hash, range_hash, steady_memory, text_chunks, words_of

#: Rows of each kind (positive, unlabelled) that the fit may see.
MAX_ROWS = 12_000
BINS = 24
HOLD_OUT_FOLDS = 5
THRESHOLD = 0.3
FEATURES = (
    "log_bytes", "upper", "lower", "digit", "space", "newline", "excl", "symbol", "pipe", "stop", "comma", "quote",
    "high", "log_words", "word_len", "word_len_sd", "distinct_words", "top_word", "distinct_triples",
    "distinct_lines", "odd_ends", "short_words", "long_words", "upper_starts",
)

_CLASS = np.full(256, 7, dtype=np.int64)  # 7: other signs
for _chars, _k in (
    (range(65, 91), 1), (range(97, 123), 2), (range(48, 58), 3), ((32, 9, 11, 12, 13), 4), ((10,), 5), (b"!?", 6),
    (b"|", 8), (b".", 9), (b",;:", 10), (b"'\"-()", 11), (range(128, 256), 12),
):
    _CLASS[list(_chars)] = _k
_ODD = np.isin(_CLASS, (6, 7, 8))


def _distinct(values: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of distinct values in each run and the count of the most frequent."""
    n, top = np.zeros(len(bounds) - 1), np.zeros(len(bounds) - 1)
    for i in np.flatnonzero(np.diff(bounds)):
        run = np.sort(values[bounds[i] : bounds[i + 1]])
        cut = np.flatnonzero(np.concatenate(([True], run[1:] != run[:-1], [True])))
        n[i], top[i] = len(cut) - 1, np.diff(cut).max()
    return n, top


def text_features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of FEATURES for each text of a chunk; a text without words has zeros where nothing is counted."""
    m = len(offsets) - 1
    n_bytes = np.diff(offsets).astype(float)
    doc = np.repeat(np.arange(m), np.diff(offsets))
    hist = np.bincount(doc * 16 + _CLASS[data], minlength=16 * m).reshape(m, 16).astype(float)
    share = hist / np.maximum(n_bytes, 1)[:, None]
    starts, ends, first = words_of(data, offsets)
    n_words = np.diff(first).astype(float)
    per = np.maximum(n_words, 1)
    prefix = prefix_hash(data)
    words = range_hash(prefix, starts, ends)
    length = (ends - starts).astype(float)
    owner = np.repeat(np.arange(m), np.diff(first))

    def mean(x: np.ndarray) -> np.ndarray:
        return np.bincount(owner, weights=x, minlength=m) / per

    word_len = mean(length)
    distinct, top = _distinct(words, first)
    triples = words.copy()
    if len(words) > 2:
        triples[2:] = mix64(mix64(words[:-2]) + words[1:-1]) ^ words[2:]
    n_triples, _ = _distinct(triples, first)
    newline = np.flatnonzero(data == 10)
    line_start = np.unique(np.concatenate((offsets[:-1][n_bytes > 0], newline[newline + 1 < len(data)] + 1)))
    line_end = np.concatenate((line_start[1:], [len(data)])) if len(line_start) else line_start
    line_bounds = np.searchsorted(line_start, offsets)
    n_lines, _ = _distinct(range_hash(prefix, line_start, line_end), line_bounds)
    lines = np.maximum(np.diff(line_bounds), 1)
    last = data[ends - 1] if len(ends) else data[:0]
    begin = data[starts] if len(starts) else data[:0]
    return np.column_stack(
        [
            np.log1p(n_bytes), *(share[:, k] for k in range(1, 13)),
            np.log1p(n_words), word_len, np.sqrt(np.maximum(mean(length**2) - word_len**2, 0)),
            distinct / per, top / per, n_triples / per, n_lines / lines,
            mean(_ODD[last].astype(float)), mean((length <= 2).astype(float)), mean((length >= 12).astype(float)),
            mean((_CLASS[begin] == 1).astype(float)),
        ]
    )


def featurise(docs: DataFrame) -> DataFrame:
    """doc_id and features (array<double>) of every row; null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steady_memory()
        for batch in batches:
            for i, j, data, offsets in text_chunks(batch.column(1)):
                x = text_features(data, offsets)
                flat = pa.ListArray.from_arrays(
                    pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel())
                )
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), flat], names=["doc_id", "features"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id bigint, features array<double>")


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(HOLD_OUT_FOLDS)) == 0


class Model:
    """An additive model: a weight for each feature's bin, and a bias."""

    def __init__(self, edges: np.ndarray, weights: np.ndarray, bias: float):
        self.edges, self.weights, self.bias = edges, weights, bias

    def bins(self, x: np.ndarray) -> np.ndarray:
        cols = [np.searchsorted(e, x[:, k], side="right") + k * BINS for k, e in enumerate(self.edges)]
        return np.column_stack(cols)

    def score(self, x: np.ndarray) -> np.ndarray:
        g = self.weights[self.bins(x)].sum(axis=1) + self.bias
        return 1 / (1 + np.exp(-np.clip(g, -30, 30)))


def fit(pos: np.ndarray, unl: np.ndarray, prior: float, steps: int = 1000, rate: float = 0.1, decay: float = 1e-5) -> Model:
    """Minimises the non-negative risk by Adam over all rows at once.

    Where the negative part falls below zero, its gradient is reversed (the
    usual correction), so the model does not overfit the unlabelled rows.
    """
    prior = float(np.clip(prior, 0.01, 0.99))
    width = len(FEATURES)
    if not len(pos) or not len(unl):
        return Model(np.zeros((width, BINS - 1)), np.zeros(width * BINS), float(np.log(prior / (1 - prior))))
    both = np.concatenate((pos, unl))
    q = np.linspace(0, 1, BINS + 1)[1:-1]
    # half of the edges follow the ranks, half the range, so rare extremes get bins of their own
    ranks = np.quantile(both, q[::2], axis=0).T
    lo, hi = both.min(axis=0), both.max(axis=0)
    span = lo[:, None] + (hi - lo)[:, None] * q[1::2][None, :]
    edges = np.sort(np.concatenate((ranks, span), axis=1), axis=1)
    model = Model(edges, np.zeros(width * BINS), float(np.log(prior / (1 - prior))))
    bp, bu = model.bins(pos), model.bins(unl)
    size = width * BINS

    def risk_gradient(bins: np.ndarray, per_row: np.ndarray) -> np.ndarray:
        w = np.bincount(bins.ravel(), weights=np.repeat(per_row, width), minlength=size)
        return np.append(w, per_row.sum())

    theta, m, v = np.append(model.weights, model.bias), np.zeros(size + 1), np.zeros(size + 1)
    for step in range(1, steps + 1):
        sp = 1 / (1 + np.exp(-np.clip(theta[bp].sum(axis=1) + theta[-1], -30, 30)))
        su = 1 / (1 + np.exp(-np.clip(theta[bu].sum(axis=1) + theta[-1], -30, 30)))
        negative = -np.log1p(-su + 1e-12).mean() + prior * np.log1p(-sp + 1e-12).mean()
        grad_negative = risk_gradient(bu, su / len(su)) - risk_gradient(bp, prior * sp / len(sp))
        if negative >= 0:
            grad = risk_gradient(bp, -prior * (1 - sp) / len(sp)) + grad_negative
        else:
            grad = -grad_negative
        grad[:-1] += decay * theta[:-1]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        theta -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Model(edges, theta[:-1], float(theta[-1]))


def estimate_prior(pos: np.ndarray, unl: np.ndarray, folds: int = 4, steps: int = 100, delta: float = 0.1) -> float:
    """Share of positives among the unlabelled rows, from positives and unlabelled rows alone.

    Each fold is scored by a model of the other folds.  Above a score t lie a
    share p of the positives and u of the unlabelled rows; u / p is at least
    the prior, and comes near it where negatives are rare.  The score whose
    upper bound (u + e) / (p - e) is least is taken, e being the deviation of
    a share that a sample of that size exceeds with chance ``delta``.  Too few
    rows give one half.
    """
    if len(pos) < 40 or len(unl) < 40:
        return 0.5
    p, u = np.empty(len(pos)), np.empty(len(unl))
    for k in range(folds):
        own_p, own_u = np.arange(len(pos)) % folds == k, np.arange(len(unl)) % folds == k
        scorer = fit(pos[~own_p], unl[~own_u], 0.5, steps)
        p[own_p], u[own_u] = scorer.score(pos[own_p]), scorer.score(unl[own_u])
    p.sort()
    u.sort()
    off = sum(np.sqrt(np.log(4 / delta) / (2 * len(x))) for x in (p, u)) / 2
    at = np.unique(p)
    share_p = 1 - np.searchsorted(p, at, side="left") / len(p)
    share_u = 1 - np.searchsorted(u, at, side="left") / len(u)
    ok = share_p > 2 * off
    if not ok.any():
        return 0.5
    best = np.argmin((share_u[ok] + off) / (share_p[ok] - off))
    return float(np.clip(share_u[ok][best] / share_p[ok][best], 0.02, 0.98))


def train(features: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Model:
    """Fits on rows that are not held out: trusted positives by label, and any rows as unlabelled.

    Where labels repeat a doc_id, its lowest label counts.  Negative labels are
    used for nothing else; the class prior is estimated from the two samples.
    """
    known = (
        labels.filter("doc_id is not null and quality is not null")
        .filter(~held_out(F.col("doc_id")))
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.min("quality").alias("quality"))
    )
    order = [F.xxhash64("doc_id", F.lit(7)), F.col("doc_id")]
    trusted = known.filter("quality = 1").orderBy(*order).limit(max_rows).select("doc_id")
    pos = features.join(F.broadcast(trusted), "doc_id").select("features").limit(max_rows)  # max_rows rows at most
    unl = features.filter(~held_out(F.col("doc_id"))).orderBy(*order).limit(max_rows).select("features")

    def matrix(df: DataFrame) -> np.ndarray:
        rows = [r.features for r in df.collect()]
        return np.array(sorted(rows), dtype=float).reshape(len(rows), len(FEATURES))

    good, any_ = matrix(pos), matrix(unl)
    return fit(good, any_, estimate_prior(good, any_))


def score_features(features: DataFrame, model: Model) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steady_memory()
        for batch in batches:
            if batch.num_rows:
                x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(model.score(x))], names=["doc_id", "score"]
                )

    return features.select("doc_id", "features").mapInArrow(run, "doc_id bigint, score double")


def score_documents(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs``.

    Empty and null texts are scored like others; without labels or positives
    every score is one half.  Extra columns are ignored, rows that repeat are
    scored each.
    """
    features = materialize(featurise(docs), "quality-features")
    out = score_features(features, train(features, labels, max_rows))
    return out.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )


def keep_good(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """The rows of ``docs``, all columns, that the classifier does not reject.

    The features travel with no text: a row's verdict is computed beside it.
    """
    features = materialize(featurise(docs), "quality-features")
    model = train(features, labels, max_rows)
    names = docs.columns
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steady_memory()
        for batch in batches:
            ok = np.zeros(batch.num_rows, dtype=bool)
            for i, j, data, offsets in text_chunks(batch.column(at)):
                ok[i:j] = model.score(text_features(data, offsets)) >= THRESHOLD
            yield batch.filter(pa.array(ok))

    return docs.mapInArrow(run, docs.schema)
