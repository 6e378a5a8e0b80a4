"""Quality classifier: naive Bayes features under a linear support vector machine.

A text is the set of its hashed byte n-grams, and of the steps that the share of its repeated word 3-grams exceeds. Each indicator is scaled by the log ratio of its frequencies in the two classes;
a hinge-loss model over the scaled indicators is fitted by dual coordinate descent, and a logistic curve turns margins into scores.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from pitgrid.llm.common import map_rows

BITS = 18
ORDERS = (1, 2, 3, 4)
#: most labelled rows that a fit reads; scoring has no bound
MAX_LABELLED = 10_000
_REPEATS = np.array([0.0, 0.02, 0.05, 0.1, 0.2, 0.35, 0.5, 0.7, 0.9])
_MIX = np.uint64(0x9E3779B97F4A7C15)
_scratch = np.zeros(1 << BITS, dtype=bool)


def features(text: bytes | None, orders: tuple[int, ...] = ORDERS) -> np.ndarray:
    """Sorted numbers of the indicators of a UTF-8 text; an empty text has the one of its (zero) repetition."""
    raw = np.frombuffer(text or b"", dtype=np.uint8)
    code = np.zeros(len(raw), dtype=np.uint64)
    for n in range(1, max(orders) + 1):
        if len(raw) < n:
            break
        code = (code[: len(raw) - n + 1] << np.uint64(8)) | raw[n - 1 :]
        if n in orders:
            _scratch[((code + np.uint64(n << 40)) * _MIX) >> np.uint64(64 - BITS)] = True
    words = (text or b"").split()
    grams = list(zip(words, words[1:], words[2:]))
    share = 1 - len(set(grams)) / len(grams) if grams else 0.0
    steps = np.flatnonzero(share > _REPEATS).astype(np.uint64)
    _scratch[((steps + np.uint64(1 << 60)) * _MIX) >> np.uint64(64 - BITS)] = True
    found = np.flatnonzero(_scratch)
    _scratch[found] = False
    return found


def fit(rows: list[np.ndarray], labels: np.ndarray, c: float = 1.0, epochs: int = 12, smooth: float = 1.0, seed: int = 7) -> tuple[np.ndarray, float, float]:
    """(weights over indicators, slope, shift): score = logistic(slope x (weights . x / norm) + shift).

    The last fifth of the rows, in the given order, sets the curve only. Without both classes the weights are zero and
    the curve gives the (smoothed) share of label 1.
    """
    size = 1 << BITS
    prior = (float(labels.sum()) + 1.0) / (len(labels) + 2.0)
    part = len(rows) - len(rows) // 5
    y = np.where(labels > 0, 1.0, -1.0)
    if part == len(rows) or len(set(y[:part])) < 2 or len(set(y[part:])) < 2:
        return np.zeros(size, dtype=np.float32), 1.0, float(np.log(prior / (1 - prior)))
    counts = {s: np.full(size, smooth) for s in (1.0, -1.0)}
    for x, s in zip(rows[:part], y[:part], strict=True):
        counts[s][x] += 1
    ratio = np.log(counts[1.0] / (np.sum(y[:part] > 0) + 2 * smooth)) - np.log(counts[-1.0] / (np.sum(y[:part] < 0) + 2 * smooth))
    scaled = [ratio[x] / max(1e-9, float(np.linalg.norm(ratio[x]))) for x in rows]
    w, a = np.zeros(size), np.zeros(part)
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(part):
            x, v = rows[i], scaled[i]
            grad = y[i] * (w[x] @ v) - 1.0
            new = min(max(a[i] - grad, 0.0), c)  # rows have norm 1
            if new != a[i]:
                w[x] += (new - a[i]) * y[i] * v
                a[i] = new
    margin = np.array([w[x] @ v for x, v in zip(rows[part:], scaled[part:], strict=True)])
    goal = (y[part:] + 1) / 2
    goal = goal * 0.998 + 0.001
    slope, shift = 1.0, 0.0
    for _ in range(50):  # Newton steps of a logistic fit in two unknowns
        p = 1 / (1 + np.exp(-np.clip(slope * margin + shift, -30, 30)))
        g = np.array([np.sum((p - goal) * margin) + 1e-3 * slope, np.sum(p - goal)])
        r = p * (1 - p) + 1e-9
        h = np.array([[np.sum(r * margin**2) + 1e-3, np.sum(r * margin)], [np.sum(r * margin), np.sum(r) + 1e-6]])
        move = np.linalg.solve(h, g)
        slope, shift = slope - np.clip(move[0], -5, 5), shift - np.clip(move[1], -5, 5)
    return np.stack([ratio, w]).astype(np.float32), float(slope), float(shift)


def score(text: bytes | None, model: tuple[np.ndarray, float, float]) -> float:
    weights, slope, shift = model
    margin = 0.0
    if weights.ndim == 2:
        x = features(text)
        v = weights[0, x]
        margin = float(weights[1, x] @ v) / max(1e-9, float(np.linalg.norm(v)))
    return float(1 / (1 + np.exp(-np.clip(slope * margin + shift, -30, 30))))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
          max_labelled: int = MAX_LABELLED) -> tuple[np.ndarray, float, float]:
    """Model from the labelled rows of ``docs``: at most ``max_labelled``, those of the smallest hashes of doc_id.

    Rows without id or label are left out; several labels of an id: the greatest counts. The sample's size bounds
    the broadcast of its ids, the one task that fits, and the model that comes to the driver.
    """
    sample = (
        labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
        .groupBy(F.col(id_col).cast("long").alias("_id")).agg(F.max(F.col(label_col).cast("int")).alias("_label"))
        .orderBy(F.xxhash64("_id"), "_id").limit(max_labelled)
    )
    texts = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").cast("binary").alias("_text"))
    rows = texts.join(F.broadcast(sample), "_id").select("_id", "_label", "_text")
    rows = map_rows(rows, lambda: lambda i, y, t: ((i, y, features(t).astype("<i4").tobytes()),), "id long, label int, x binary")

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [r for b in batches for r in zip(*[c.to_pylist() for c in b.columns], strict=True)]
        # in an order that neither tasks nor retries change, unrelated to the ids' order
        found.sort(key=lambda r: (r[0] * 0x9E3779B97F4A7C15 % (1 << 64), r[0], r[2]))
        w, slope, shift = fit([np.frombuffer(x, "<i4") for _, _, x in found], np.array([y for _, y, _ in found]))
        yield pa.RecordBatch.from_pydict({"w": [w.tobytes()], "slope": [slope], "shift": [shift]})

    got = rows.repartition(1).mapInArrow(fitted, "w binary, slope double, shift double").collect()
    w = np.frombuffer(bytes(got[0]["w"]), dtype=np.float32)
    return (w.reshape(2, -1) if len(w) > 1 << BITS else w), got[0]["slope"], got[0]["shift"]


def scores(docs: DataFrame, model: tuple[np.ndarray, float, float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) per row of ``docs``, whole texts. Null and empty texts get a score as well; other columns are not read."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string").cast("binary"))
    return map_rows(rows, lambda: lambda i, t: ((i, score(t, shared.value)),), "doc_id long, score double")


def held_out(doc_id) -> Column:
    """Whether a row's label is kept from training: crc32 of its id as text leaves no remainder by 5. A null id is not held out (and never trained on)."""
    return F.coalesce((F.crc32(F.col(doc_id).cast("string")) % 5) == 0, F.lit(False))
