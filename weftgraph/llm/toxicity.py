"""Toxicity: a character n-gram linear classifier whose features are scaled by naive Bayes log-count ratios.

A text's features are the hashed byte n-grams present in it (A-Z lower-cased, runs of white space as one space),
each scaled by r = log of its smoothed share among toxic over that among other texts; a logistic regression with
an L2 penalty, fitted by Adam, weights the scaled features. It learns on the driver from at most ``bound`` labelled rows of at
most labelled.SAMPLE_BYTES of text (a documented sample, taken by hash; executors send hashed features). All rows are scored, whole. Labels, language, source and
id are no inputs.

Cases: null and empty texts have no features and get the bias. Repeated rows score alike. Without usable labels
all score 0.5. Very long texts are
scored whole. Other columns are carried along by score(), whatever their names; the query leaves them out.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm.common import as_bytes, free_name, held_out, map_arrow, positional, table
from weftgraph.llm.labelled import FOLDS, training_rows

BUCKETS, GRAMS, BOUND, THRESHOLD = 1 << 18, (4, 5), 5000, 0.5


def features(raw: bytes, buckets: int = BUCKETS, grams: tuple[int, ...] = GRAMS) -> np.ndarray:
    """Distinct hashed n-grams, in no order."""
    b = np.frombuffer(b" " + b" ".join(raw.lower().split()) + b" ", np.uint8).astype(np.uint64)
    parts, h = [], np.zeros(len(b), np.uint64)
    for n in range(1, max(grams) + 1):
        h = h[: len(b) - n + 1] * np.uint64(0x9E3779B97F4A7C15) + b[n - 1 :] + np.uint64(1) if n <= len(b) else h[:0]
        if n in grams:
            parts.append((h * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - buckets.bit_length() + 1))
    at = np.concatenate(parts).astype(np.int32)
    # The last to write its place is the one that stays: distinct members without a sort.
    place = _scratch(buckets)
    order = np.arange(len(at), dtype=np.int32)
    place[at] = order
    return at[place[at] == order]


_places: dict[int, np.ndarray] = {}


def _scratch(buckets: int) -> np.ndarray:
    if buckets not in _places:
        _places[buckets] = np.empty(buckets, np.int32)
    return _places[buckets]


def fit(rows: list[np.ndarray], y: np.ndarray, alpha: float = 1.0, epochs: int = 6, steps: int = 300, batch: int = 128, rate: float = 0.02, decay: float = 3e-3, seed: int = 3, buckets: int = BUCKETS) -> tuple[float, np.ndarray]:
    """(bias, weights): the weights already hold the log-count ratios."""
    if not len(y) or y.min() == y.max():
        return (0.0 if not len(y) else (3.0 if y[0] else -3.0)), np.zeros(buckets, np.float32)
    p, q = np.full(buckets, alpha), np.full(buckets, alpha)
    for x, toxic in zip(rows, y, strict=True):  # a row's n-grams are distinct
        (p if toxic else q)[x] += 1
    r = (np.log(p / (y.sum() + 2 * alpha)) - np.log(q / ((1 - y).sum() + 2 * alpha))).astype(np.float32)
    r[(p + q) <= 2 * alpha] = 0  # never seen
    rng = np.random.default_rng(seed)
    w, m, s, step = np.zeros(buckets, np.float32), np.zeros(buckets, np.float32), np.zeros(buckets, np.float32), 0
    bias, mb, vb = float(np.log(y.mean() / (1 - y.mean()))), 0.0, 0.0
    for _ in range(max(epochs, -(-steps * batch // len(y)))):  # few rows are seen more often
        order = rng.permutation(len(y))
        for k in range(0, len(y), batch):
            some = order[k : k + batch]
            i = np.concatenate([rows[x] for x in some])
            each = np.repeat(np.arange(len(some)), [len(rows[x]) for x in some])
            z = bias + np.bincount(each, w[i] * r[i], len(some))
            g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[some]) / len(some)
            grad = np.bincount(i, g[each] * r[i], buckets).astype(np.float32) + decay * w
            step += 1
            m += 0.1 * (grad - m)
            s += 0.01 * (grad * grad - s)
            gb = float(g.sum())
            mb, vb = mb + 0.1 * (gb - mb), vb + 0.01 * (gb * gb - vb)
            a, b = 1 - 0.9**step, 1 - 0.99**step
            w -= rate * (m / a) / (np.sqrt(s / b) + 1e-6)
            bias -= rate * (mb / a) / ((vb / b) ** 0.5 + 1e-6)
    return bias, (w * r).astype(np.float32)


def train(docs: DataFrame, labels: DataFrame, bound: int = BOUND, text: str = "text") -> tuple[float, np.ndarray]:
    def seen(b: pa.RecordBatch) -> dict:
        # Steps between sorted n-grams take a third of the room that the n-grams would take in the driver.
        steps = (np.diff(np.sort(features(raw)), prepend=0).astype("<i4") for raw in as_bytes(b.column(1)))
        return {"doc_id": b.column(0), "y": b.column(2), "at": [zlib.compress(x.tobytes(), 1) for x in steps]}

    sample = training_rows(docs, labels, "toxic", bound, 13, text).select(F.col("doc_id").cast("string"), "text", "y")
    rows = sorted(map(tuple, map_arrow(sample, "doc_id string, y int, at binary", seen).collect()))
    return fit([np.cumsum(np.frombuffer(zlib.decompress(r[2]), "<i4"), dtype=np.int32) for r in rows], np.array([r[1] for r in rows], np.float64))


def score(docs: DataFrame, model: tuple[float, np.ndarray], text: str = "text") -> DataFrame:
    """All rows with a last column ``_score`` (see free_name), the probability of toxicity."""
    from pyspark.sql.types import DoubleType, StructField, StructType

    held = docs.sparkSession.sparkContext.broadcast(model)  # its size is fixed by BUCKETS
    names, out = docs.columns, free_name(docs, "_score")

    def run(batches):
        bias, w = held.value
        for b in batches:
            z = np.array([bias + float(w[features(raw)].sum()) for raw in as_bytes(b.column(names.index(text)))], np.float64)
            p = pa.array(1 / (1 + np.exp(-np.clip(z, -500, 500))), pa.float64())
            yield pa.RecordBatch.from_arrays([*b.columns, p], names=[*names, out])

    return positional(docs).mapInArrow(run, StructType([*docs.schema.fields, StructField(out, DoubleType())]))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity score of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out(F.col("doc_id"), FOLDS).alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= THRESHOLD).cast("int").alias("predicted"))
