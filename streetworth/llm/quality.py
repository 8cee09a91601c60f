"""Quality classifier: a regularised quadratic discriminant over document statistics.

Each text becomes a vector of statistics (shares of kinds of characters, lengths of words and lines, repetition), transformed towards normal. For each label
the mean and the covariance come from sums over all its training rows, added up by partition. Covariances shrink towards the pooled one and its diagonal; a
score is the difference of the two Gaussian log-densities, with Mahalanobis distances from Cholesky factors that are computed once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructType

from streetworth.llm import _text as T

NAMES = ("bytes", "words", "word_length", "word_spread", "capitals", "digits", "symbols", "stops", "commas", "beyond_ascii", "spaces", "lines", "repeated_lines", "distinct_words", "repeated_pairs", "marked_words", "long_words")
_KINDS = {"capitals": range(65, 91), "digits": range(48, 58), "symbols": b"#$%&*+/<=>@\\^_`{|}~!", "stops": b".?;:", "commas": b",", "beyond_ascii": range(128, 256), "spaces": b" \t\r\n", "lines": b"\n"}
_CLASS = np.zeros((len(_KINDS), 256), bool)
for _i, _bytes in enumerate(_KINDS.values()):
    _CLASS[_i, list(_bytes)] = True
_NEWLINE = np.zeros(256, bool)
_NEWLINE[10] = True


def _repeats(hashes: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """For each text, the share of its hashes that are not the first of their kind."""
    n = np.diff(firsts)
    kinds = np.array([len(T.distinct(hashes[a:b])) for a, b in zip(firsts[:-1], firsts[1:], strict=True)], float)
    return 1 - kinds / np.maximum(n, 1) - (n == 0)


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """[texts, len(NAMES)] transformed statistics: log(1 + x) of lengths, log((s + 0.002) / (1.002 - s)) of shares. An empty text has shares of 0."""

    def sums(flags: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
        return np.diff(total[offsets]).astype(float)

    n = np.diff(offsets).astype(float)
    some = np.maximum(n, 1)
    counts = {k: sums(_CLASS[i][data]) for i, k in enumerate(_KINDS)}
    starts, ends, firsts = T.words(data, offsets)
    lengths = (ends - starts).astype(float)
    w = np.diff(firsts).astype(float)
    of_words = lambda x: np.diff(np.concatenate(([0.0], np.cumsum(x)))[firsts])
    mean = of_words(lengths) / np.maximum(w, 1)
    spread = np.sqrt(np.maximum(of_words(lengths**2) / np.maximum(w, 1) - mean**2, 0))
    marked = of_words(_CLASS[list(_KINDS).index("symbols")][data[ends - 1]]) if len(ends) else w
    hashes = T.hash_ranges(T.LOWER[data], starts, ends)
    line_starts, line_ends = T.spans_of(~_NEWLINE[data], offsets)
    lines = T.hash_ranges(data, line_starts, line_ends)
    pairs, pair_firsts = T.shingles(hashes, firsts, 2)
    share = lambda s: np.log((np.clip(s, 0, 1) + 0.002) / (1.002 - np.clip(s, 0, 1)))
    columns = [
        np.log1p(n), np.log1p(w), np.log1p(mean), np.log1p(spread), *[share(counts[k] / some) for k in _KINDS],
        share(_repeats(lines, np.searchsorted(line_starts, offsets))), share(_repeats(hashes, firsts)), share(_repeats(pairs, pair_firsts)),
        share(marked / np.maximum(w, 1)), share(of_words(lengths > 20) / np.maximum(w, 1)),
    ]
    return np.array(columns).T


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, data, offsets in T.slices(batches):
        x = statistics(data, offsets)
        kept = [i for i, name in enumerate(rows.schema.names) if name != "text"]
        yield pa.record_batch([*(rows.column(i) for i in kept), pa.array(list(x), pa.list_(pa.float64()))], names=[*(rows.schema.names[i] for i in kept), "x"])


def measure(docs: DataFrame) -> DataFrame:
    """docs without text, with x, the vector of statistics of the whole text; a null text counts as empty. Other columns stay (one named x is replaced); repeated rows
    are measured each; an empty table gives no rows."""
    docs = docs.drop("x")
    fields = [f for f in docs.schema.fields if f.name != "text"]
    return docs.mapInArrow(_measured, StructType(fields).add("x", ArrayType(DoubleType())))


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each label of the partition: count, sums, sums of products."""
    d = len(NAMES)
    n, s, p = np.zeros(2), np.zeros((2, d)), np.zeros((2, d, d))
    for batch in batches:
        x = np.array(batch.column(0).flatten(), float).reshape(-1, d)
        y = np.array(batch.column(1).to_pylist())
        for label in (0, 1):
            own = x[y == label]
            n[label] += len(own)
            s[label] += own.sum(0)
            p[label] += own.T @ own
    yield pa.record_batch({"label": pa.array([0, 1], pa.int32()), "at": pa.array([-1, -1], pa.int32()), "value": pa.array([[n[k], *s[k], *p[k].ravel()] for k in (0, 1)], pa.list_(pa.float64()))})


def train(measured: DataFrame, to_pooled: float = 0.2, to_diagonal: float = 0.1):
    """The model from measured(x, label), label 0 or 1; other labels are not read.

    The driver gets one row of 1 + d + d * d numbers for each label, summed by Spark. With one label only, or none, every score is that label, or 0.5. A row that is
    repeated, or joined to several labels, counts as often.
    """
    d = len(NAMES)
    parts = measured.where("label in (0, 1)").select("x", "label").mapInArrow(_moments, "label int, at int, value array<double>")
    parts = parts.select("label", F.posexplode("value").alias("i", "v")).groupBy("label", "i").agg(F.sum("v").alias("v"))
    total = np.zeros((2, 1 + d + d * d))
    for r in parts.collect():
        total[r["label"], r["i"]] = r["v"]
    n = total[:, 0]
    if not n.all():
        return None, float(n[1] > 0) if n.any() else 0.5
    means = total[:, 1 : d + 1] / n[:, None]
    scatter = total[:, d + 1 :].reshape(2, d, d) - n[:, None, None] * means[:, :, None] * means[:, None, :]
    pooled = scatter.sum(0) / n.sum() + 1e-6 * np.eye(d)
    factors = []
    for k in (0, 1):
        own = (1 - to_pooled) * scatter[k] / n[k] + to_pooled * pooled
        own = (1 - to_diagonal) * own + to_diagonal * np.diag(np.diag(pooled))
        factors.append(np.linalg.cholesky(own))
    inverse = [np.linalg.inv(f) for f in factors]
    logs = [np.log(n[k] / n.sum()) - np.log(np.diag(factors[k])).sum() for k in (0, 1)]
    return (means, inverse, logs), 0.5


def _scored(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, plain = shared.value
        d = len(NAMES)
        for batch in batches:
            at = batch.schema.get_field_index("x")
            x = np.array(batch.column(at).flatten(), float).reshape(-1, d)
            score = np.full(len(x), plain)
            if model:
                means, inverse, logs = model
                density = [logs[k] - 0.5 * (((x - means[k]) @ inverse[k].T) ** 2).sum(1) for k in (0, 1)]
                score = 1 / (1 + np.exp(-np.arcsinh(density[1] - density[0])))  # monotone in the posterior, without ties at 0 and 1
            kept = [i for i in range(batch.num_columns) if i != at]
            yield pa.record_batch([*(batch.column(i) for i in kept), pa.array(score)], names=[*(batch.schema.names[i] for i in kept), "score"])

    return run


def score(measured: DataFrame, model) -> DataFrame:
    """measured without x, with score in (0, 1): higher, label 1 is likelier."""
    fields = [f for f in measured.schema.fields if f.name != "x"]
    return measured.mapInArrow(_scored(measured.sparkSession.sparkContext.broadcast(model)), StructType(fields).add("score", "double"))
