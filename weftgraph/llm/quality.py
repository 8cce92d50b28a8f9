"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata (``n_chars``).

The score is sigmoid(b + sum w_i x_i + 1/2 sum_f [(sum v_if x_i)^2 - sum v_if^2 x_i^2]), the sum-of-squares identity
that makes pairwise interactions linear in the features. It is fitted on the driver by Adam from at most ``bound``
labelled rows (a documented sample, taken by hash); executors send hashed features, not texts. All rows are scored,
whole. Labels, language, source and id are no inputs.

Cases: null and empty texts get the score of no features, from 0 to 1. Repeated rows score alike. Without usable
labels the model is the prior 0.5 for all. Very long texts are
scored whole. Other columns are carried along by score(), whatever their names; the query leaves them out.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm.common import as_bytes, free_name, held_out, map_arrow, positional, table
from weftgraph.llm.labelled import FOLDS, training_rows

BUCKETS, RANK, BOUND, THRESHOLD = 1 << 15, 8, 8000, 0.3
_marks = [c for c in range(33, 127) if not chr(c).isalnum()]
_classes = np.zeros((256, 6 + len(_marks)), np.float32)
_classes[65:91, 0] = _classes[97:123, 1] = _classes[48:58, 2] = _classes[32, 3] = _classes[10, 4] = _classes[128:, 5] = 1
for _i, _c in enumerate(_marks):
    _classes[_c, 6 + _i] = 5
STRUCTURE = _classes.shape[1] + 10


def features(raw: bytes, said: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Indices and values: structure first, with the length that the metadata say, then hashed words by their share."""
    x = np.zeros(STRUCTURE, np.float32)
    words = raw.lower().split()
    n, size = len(words), len(raw)
    shares = np.bincount(np.frombuffer(raw, np.uint8), minlength=256).astype(np.float32) @ _classes / max(size, 1)
    x[: len(shares)] = np.minimum(shares, 1)
    at = np.fromiter(map(zlib.crc32, words), np.int64, n) & (BUCKETS - 1)
    u, c = np.unique(at, return_counts=True)
    lines = raw.split(b"\n")
    s = len(shares)
    x[s] = 1 - len(u) / max(n, 1)
    x[s + 1] = np.count_nonzero(at[1:] == at[:-1]) / max(n, 1)
    x[s + 2] = 1 - len(set(lines)) / len(lines)
    x[s + 3] = c.max() / n if n else 0
    x[s + 4] = min(size / max(n, 1) / 20, 2)
    x[s + 5] = np.log1p(n) / 10
    x[s + 6] = np.log1p(size) / 12
    x[s + 7] = not n
    if said is not None:
        x[s + 8] = np.log1p(max(said, 0)) / 12
        x[s + 9] = said != size - np.count_nonzero(np.frombuffer(raw, np.uint8) >> 6 == 2)  # characters
    value = c.astype(np.float32)
    return np.concatenate([np.arange(STRUCTURE), u + STRUCTURE]).astype(np.int32), np.concatenate([x, value / max(np.sqrt(value @ value), 1)]).astype(np.float32)


@dataclass
class Machine:
    bias: float
    w: np.ndarray
    v: np.ndarray

    def logit(self, i: np.ndarray, x: np.ndarray) -> float:
        vx = self.v[i] * x[:, None]
        return float(self.bias + self.w[i] @ x + 0.5 * ((vx.sum(0) ** 2).sum() - (vx * vx).sum()))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, rank: int = RANK, epochs: int = 8, batch: int = 256, rate: float = 0.02, decay: float = 1e-5, seed: int = 3) -> Machine:
    """Adam on the log loss."""
    rng = np.random.default_rng(seed)
    size = BUCKETS + STRUCTURE
    p = np.zeros((size, rank + 1), np.float32)
    p[:, 1:] = rng.normal(0, 0.01, (size, rank))
    bias, mb, vb = 0.0, 0.0, 0.0
    m, s, step = np.zeros_like(p), np.zeros_like(p), 0
    if not len(y) or y.min() == y.max():
        return Machine(0.0 if not len(y) else (3.0 if y[0] else -3.0), np.zeros(size, np.float32), np.zeros((size, rank), np.float32))
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for k in range(0, len(y), batch):
            some = order[k : k + batch]
            i = np.concatenate([rows[r][0] for r in some])
            x = np.concatenate([rows[r][1] for r in some])
            starts = np.concatenate([[0], np.cumsum([len(rows[r][0]) for r in some])[:-1]])
            each = np.repeat(np.arange(len(some)), np.diff(np.append(starts, len(i))))
            vx = p[i, 1:] * x[:, None]
            sums = np.add.reduceat(vx, starts)
            z = bias + np.add.reduceat(p[i, 0] * x, starts) + 0.5 * ((sums**2).sum(1) - np.add.reduceat((vx * vx).sum(1), starts))
            g = ((1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[some]) / len(some)).astype(np.float32)
            gx = g[each] * x
            flat = np.column_stack([gx, gx[:, None] * (sums[each] - vx)])
            grad = np.stack([np.bincount(i, flat[:, f], size) for f in range(rank + 1)], 1).astype(np.float32) + decay * p
            step += 1
            m += 0.1 * (grad - m)
            s += 0.01 * (grad * grad - s)
            gb = float(g.sum())
            mb, vb = mb + 0.1 * (gb - mb), vb + 0.01 * (gb * gb - vb)
            a, b = 1 - 0.9**step, 1 - 0.99**step
            p -= rate * (m / a) / (np.sqrt(s / b) + 1e-7)
            bias -= rate * (mb / a) / ((vb / b) ** 0.5 + 1e-7)
    return Machine(bias, p[:, 0].copy(), p[:, 1:].copy())


def _said(docs: DataFrame) -> Column:
    """The metadata's length, null where the table has none."""
    return (F.col("n_chars") if "n_chars" in docs.columns else F.lit(None)).try_cast("bigint")


def train(docs: DataFrame, labels: DataFrame, bound: int = BOUND, text: str = "text") -> Machine:
    def seen(b: pa.RecordBatch) -> dict:
        got = [features(raw, said) for raw, said in zip(as_bytes(b.column(1)), b.column(3).to_pylist(), strict=True)]
        return {"doc_id": b.column(0), "y": b.column(2), "at": [i.tobytes() for i, _ in got], "x": [x.tobytes() for _, x in got]}

    sample = training_rows(docs, labels, "quality", bound, 11, text, also={"said": _said(docs)}).select(F.col("doc_id").cast("string"), "text", "y", "said")
    rows = sorted(map(tuple, map_arrow(sample, "doc_id string, y int, at binary, x binary", seen).collect()))
    return fit([(np.frombuffer(r[2], np.int32), np.frombuffer(r[3], np.float32)) for r in rows], np.array([r[1] for r in rows], np.float32))


def score(docs: DataFrame, machine: Machine, text: str = "text") -> DataFrame:
    """All rows with a last column ``_score`` (see free_name), the probability of good quality."""
    held = docs.sparkSession.sparkContext.broadcast(machine)  # its size is fixed by BUCKETS and RANK
    names, out = docs.columns, free_name(docs, "_score")

    def run(batches):
        for b in batches:
            said = b.column(len(names)).to_pylist()
            z = np.array([held.value.logit(*features(*x)) for x in zip(as_bytes(b.column(names.index(text))), said, strict=True)], np.float64)
            p = pa.array(1 / (1 + np.exp(-np.clip(z, -500, 500))), pa.float64())
            yield pa.RecordBatch.from_arrays([*b.columns[: len(names)], p], names=[*names, out])

    from pyspark.sql.types import DoubleType, StructField, StructType

    return positional(docs.select("*", _said(docs).alias(out))).mapInArrow(run, StructType([*docs.schema.fields, StructField(out, DoubleType())]))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality score of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars")
    out = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out(F.col("doc_id"), FOLDS).alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= THRESHOLD).cast("int").alias("predicted"))
